"""Deriving the graph from extraction facts by aggregation instead of row-by-row upserts.

Facts are ordered by ``seq``: of entities ``(seq, norm_name, name, type, description)``, of relations ``(seq, chunk_id,
src_id, dst_id, type, description, confidence)``. What came first wins, whatever order the partitions are read in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_entities(facts: DataFrame) -> DataFrame:
    """``(norm_name, name, type, description, aliases, search_text, occurrences)``: the first name, type and non-null
    description of each key, and every spelling other than the key as an alias."""
    rows = facts.where("norm_name IS NOT NULL AND norm_name <> ''")
    merged = rows.groupBy("norm_name").agg(
        F.min_by("name", "seq").alias("name"),
        F.min_by("type", "seq").alias("type"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"),
        F.array_sort(F.collect_set(F.when(F.col("name") != F.col("norm_name"), F.col("name")))).alias("aliases"),
        F.count("*").alias("occurrences"),
    )
    return merged.withColumn("search_text", F.concat_ws(" ", "name", "aliases"))


def resolve_endpoints(facts: DataFrame, entity_facts: DataFrame) -> DataFrame:
    """Relation facts ``(seq, src_norm, dst_norm, ..)`` whose ends were known when they came: an end counts if the entity's
    first fact isn't later. Others are left out."""
    known = entity_facts.groupBy("norm_name").agg(F.min("seq").alias("known_at"))
    rows = facts
    for end in ("src_norm", "dst_norm"):
        rows = rows.join(known.toDF(end, "_at"), end).where("_at <= seq").drop("_at")
    return rows


def merge_relations(facts: DataFrame) -> DataFrame:
    """``(src_id, dst_id, type, weight, confidence, description, evidence_chunks)``: number of facts, mean confidence,
    first non-null description, and the number of distinct chunks as evidence."""
    return facts.groupBy("src_id", "dst_id", "type").agg(
        F.count("*").alias("weight"),
        F.avg("confidence").alias("confidence"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"),
        F.count_distinct("chunk_id").alias("evidence_chunks"),
    )


def inner_edges(edges: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """``(group, *edges)``: the edges with columns ``src_id`` and ``dst_id`` of which a group ``(group, member)`` has both
    ends, once per group.

    Each edge starts from the end that fewer groups have, and the other end is looked up by group and member together:
    rows in between are bounded by the rarer end, so the edges of a hub cost what its neighbours cost.
    """
    seen = members.select(group, "member").distinct()
    often = seen.groupBy("member").agg(F.count("*").alias("n"))
    ends = edges.join(often.toDF("src_id", "_s"), "src_id").join(often.toDF("dst_id", "_o"), "dst_id")
    start = F.col("_s") <= F.col("_o")
    ends = ends.withColumn("_rare", F.when(start, F.col("src_id")).otherwise(F.col("dst_id"))).withColumn("_other", F.when(start, F.col("dst_id")).otherwise(F.col("src_id")))
    half = ends.join(seen.withColumnRenamed("member", "_rare"), "_rare")
    return half.join(seen.withColumnRenamed("member", "_other"), [group, "_other"]).select(group, *edges.columns)


def relation_evidence(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(relation_id, chunk_id)``: the chunks that mention both ends of a relation, each once."""
    ends = relations.select(F.col("id").alias("relation_id"), "src_id", "dst_id")
    return inner_edges(ends, mentions.select("chunk_id", F.col("entity_id").alias("member")), "chunk_id").select("relation_id", "chunk_id")


def degree_by_occurrence(relations: DataFrame) -> DataFrame:
    """``(id, degree)``: occurrences of relations at either end; a loop counts twice."""
    ends = relations.select("weight", F.explode(F.array("src_id", "dst_id")).alias("id"))
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def degree_distinct(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(id, degree)`` of every entity: the number of relations that touch it; a loop counts once."""
    ends = relations.select("id", F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("entity_id"))
    counts = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    return entities.select("id").join(counts.withColumnRenamed("entity_id", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def upsert_sources(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """The sources after a scan: new and changed files are pending without an error, disabled ones stay as they are."""
    new = scanned.select("path", F.col("content_hash").alias("new_hash"), F.col("size_bytes").alias("new_size"))
    rows = known.select("path", "content_hash", "size_bytes", "state", "error").join(new, "path", "full_outer")
    fresh = F.col("new_hash").isNotNull() & (F.col("state").isNull() | (F.col("state") != "disabled") & ~F.col("content_hash").eqNullSafe(F.col("new_hash")))
    return rows.select(
        "path",
        F.when(fresh, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(fresh, F.col("new_size")).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(fresh, "pending").otherwise(F.col("state")).alias("state"),
        F.when(~fresh, F.col("error")).alias("error"),
    )


def recovered(sources: DataFrame) -> DataFrame:
    """Sources after an interrupted run: whatever isn't merged, deleted or disabled is pending again."""
    return sources.withColumn("state", F.when(F.col("state").isin("merged", "deleted", "disabled"), F.col("state")).otherwise("pending"))


def quarantined(extracted: DataFrame) -> DataFrame:
    """``(path, ordinal, raw_output, error_code, detail)`` of the answers that failed; one that is merely empty didn't."""
    code = F.coalesce("error", F.when(F.col("outcome") == "PARSE_FAILED", "PARSE_FAILED"))
    detail = F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" items didn't hold"))).otherwise(F.col("error"))
    return extracted.withColumn("error_code", code).where("error_code IS NOT NULL").select("path", "ordinal", F.col("raw").alias("raw_output"), "error_code", detail.alias("detail"))
