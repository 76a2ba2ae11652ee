"""Forgetting, correcting and reviewing what the graph holds, and reporting its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.functions.text import norm_name
from sparkweft.operators.scan import under_roots


def forget_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files ``(path)``: their chunks, mentions and evidence go, then relations without any
    evidence left, then entities that neither a relation nor a mention holds."""
    sources = tables["sources"].join(paths.select("path").distinct(), "path", "left_anti")
    chunks = tables["chunks"].join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    kept = chunks.select(F.col("id").alias("chunk_id")).distinct()
    mentions = tables["mentions"].join(kept, "chunk_id", "left_semi")
    evidence = tables["evidence"].join(kept, "chunk_id", "left_semi")
    relations = tables["relations"].join(evidence.select(F.col("relation_id").alias("id")).distinct(), "id", "left_semi")
    return {"sources": sources, "chunks": chunks, "mentions": mentions, "evidence": evidence, "relations": relations, "entities": without_orphans(tables["entities"], relations, mentions)}


def forget_entities(tables: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """The tables without the entities ``(name)``, their relations and mentions."""
    gone = tables["entities"].join(names.select(norm_name(F.col("name")).alias("norm_name")).distinct(), "norm_name", "left_semi").select("id").distinct()
    relations = tables["relations"].join(gone.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(gone.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
    return {**tables, "entities": tables["entities"].join(gone, "id", "left_anti"), "relations": relations, "mentions": tables["mentions"].join(gone.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")}


def held(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(id)`` of the entities that a relation or a mention holds."""
    ends = relations.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return ends.unionByName(mentions.select(F.col("entity_id").alias("id"))).distinct()


def without_orphans(entities: DataFrame, relations: DataFrame, mentions: DataFrame) -> DataFrame:
    return entities.join(held(relations, mentions), "id", "left_semi")


def orphans(entities: DataFrame, relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities without a relation and without a mention."""
    return entities.join(held(relations, mentions), "id", "left_anti")


def exclude_relations(relations: DataFrame, excluded: DataFrame) -> DataFrame:
    """Relations with ``excluded`` as a column of its own, so that later extraction can't bring one back."""
    return relations.join(excluded.select("id").distinct().withColumn("excluded", F.lit(True)), "id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def correct_relations(relations: DataFrame, entities: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations and entities after corrections ``(id, s, r, o)``, blank fields meaning no change. A name that isn't known
    becomes a concept; what was corrected has confidence 1. New entities get the ids after the greatest."""
    blank_free = corrections.select("id", *(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("s", "r", "o")))
    named = blank_free.select(F.explode(F.array("s", "o")).alias("name")).where("name IS NOT NULL").select(norm_name(F.col("name")).alias("norm_name"), "name")
    missing = named.join(entities.select("norm_name"), "norm_name", "left_anti").groupBy("norm_name").agg(F.min("name").alias("name"))
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = missing.select((F.lit(top) + F.row_number().over(W.orderBy("norm_name"))).cast("long").alias("id"), "norm_name", "name", F.lit("concept").alias("type"))
    every = entities.unionByName(new, allowMissingColumns=True)
    keys = every.select("id", "norm_name")
    ends = blank_free.withColumn("s_norm", norm_name(F.col("s"))).withColumn("o_norm", norm_name(F.col("o")))
    ends = ends.join(keys.toDF("new_src", "s_norm"), "s_norm", "left").join(keys.toDF("new_dst", "o_norm"), "o_norm", "left").select("id", "new_src", "new_dst", F.col("r").alias("new_type"))
    rows = relations.join(ends, "id", "left")
    src, dst, kind = F.coalesce("new_src", "src_id"), F.coalesce("new_dst", "dst_id"), F.coalesce("new_type", "type")
    moved = (src != F.col("src_id")) | (dst != F.col("dst_id")) | (kind != F.col("type"))
    rows = rows.withColumn("confidence", F.when(moved, 1.0).otherwise(F.col("confidence")))
    return rows.withColumns({"src_id": src, "dst_id": dst, "type": kind}).select(relations.columns), every


def review_sample(relations: DataFrame, judged: DataFrame, limit: int = 20) -> DataFrame:
    """``(id, confidence, rank)``: relations to review, the least certain first, sure ones (1 and above) only to fill up;
    neither excluded nor judged ones, and never more than ``limit`` (on purpose: the engine surveyed may give more)."""
    rows = relations.where("confidence >= 0").join(judged.select("id").distinct(), "id", "left_anti")
    key = F.struct((F.col("confidence") >= 1).alias("sure"), F.when(F.col("confidence") < 1, F.col("confidence")).alias("c"), F.col("id").alias("i"))
    best = rows.select("id", "confidence", key.alias("k")).orderBy("k").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy("k"))).select("id", "confidence", "rank")


def review_stats(events: DataFrame) -> DataFrame:
    """One row of counts from verdicts ``(relation_id, verdict, corrected, confidence)``: a correction counts as sampled and
    corrected only, unsure as nothing; the band of low confidence is above 0 and below 0.8."""
    judged = ~F.col("corrected") & F.col("verdict").isin("correct", "wrong")
    low = judged & (F.col("confidence") > 0) & (F.col("confidence") < 0.8)
    right = F.col("verdict") == "correct"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return events.agg(n(F.col("corrected") | judged).alias("sampled"), n(judged & right).alias("correct"), n(F.col("corrected")).alias("corrected"), n(low).alias("low_sampled"), n(low & right).alias("low_correct"), n(judged & ~right).alias("excluded"))


def status(sources: DataFrame) -> DataFrame:
    """Counts of files by what they mean for the index: one row."""
    state = F.col("state")
    return sources.agg(
        F.count_if(state == "merged").alias("indexed"), F.count_if(~state.isin("merged", "deleted")).alias("stale"), F.count_if(state == "quarantined").alias("quarantined"),
        F.count_if(F.col("error") == "skipped-binary").alias("skipped_binary"), F.count_if(state.isin("pending", "extracting")).alias("changed"),
    )


def health(sources: DataFrame, relations: DataFrame, events: DataFrame, roots: list[str]) -> DataFrame:
    """One row: coverage, quarantine rate, precision of reviews (null without any), excluded relations, and sources whose
    real path lies outside the roots."""
    files = status(sources)
    escaped = sources.agg(F.count_if((F.col("state") != "deleted") & ~under_roots(F.col("abs_path"), roots)).alias("escaped"))
    excluded = relations.agg(F.count_if(F.col("confidence") < 0).alias("excluded_relations"))
    reviews = review_stats(events).drop("excluded")
    row = files.join(escaped, F.lit(True)).join(excluded, F.lit(True)).join(reviews, F.lit(True))  # one row each
    share = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return row.select(
        "indexed", "stale", "quarantined", share("indexed", F.col("indexed") + F.col("stale")).alias("coverage"), share("quarantined", F.col("indexed") + F.col("quarantined")).alias("quarantine_rate"),
        "sampled", "correct", "corrected", share("correct", F.col("sampled")).alias("precision"), share("low_correct", F.col("low_sampled")).alias("low_precision"), "excluded_relations", "escaped",
    )


def source_stats(sources: DataFrame, chunks: DataFrame, mentions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(source_id, chunks, entities, relations)`` of every source: its chunks, and the distinct entities and relations that
    they support."""
    of = chunks.select(F.col("id").alias("chunk_id"), "source_id").distinct()
    a = of.groupBy("source_id").agg(F.count("*").alias("chunks"))
    b = mentions.select("chunk_id", "entity_id").distinct().join(of, "chunk_id").groupBy("source_id").agg(F.count_distinct("entity_id").alias("entities"))
    c = evidence.select("chunk_id", "relation_id").distinct().join(of, "chunk_id").groupBy("source_id").agg(F.count_distinct("relation_id").alias("relations"))
    rows = sources.select(F.col("id").alias("source_id")).distinct()
    for x in (a, b, c):
        rows = rows.join(x, "source_id", "left")
    return rows.na.fill(0, ["chunks", "entities", "relations"])


def community_list(entities: DataFrame, limit: int = 50, top: int = 8) -> DataFrame:
    """``(community_id, size, top)``: the largest communities with the names of their members of highest degree."""
    inside = entities.where("community_id IS NOT NULL")
    sizes = inside.groupBy("community_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community_id").limit(min(max(limit, 1), 50))
    order = W.partitionBy("community_id").orderBy(F.desc("degree"), "id")
    names = inside.join(sizes.select("community_id"), "community_id", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    lists = names.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("top"))
    return sizes.join(lists, "community_id")


_LINES = 64


def evidence_text(chunks: DataFrame, sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(path, first, last, chunk_id)``: for each wanted line range the first chunk of the file that holds all of it.

    Ranges and chunks meet by stretches of lines, so a file with many of both isn't compared all by all.
    """
    of = sources.select(F.col("id").alias("source_id"), "path").distinct()
    stretches = F.explode(F.expr(f"sequence(start_line div {_LINES}, greatest(start_line, end_line) div {_LINES})")).alias("_stretch")
    rows = chunks.select(F.col("id").alias("chunk_id"), "source_id", "ordinal", "start_line", "end_line").where("start_line IS NOT NULL AND end_line IS NOT NULL").distinct()
    rows = rows.select("*", stretches).join(of, "source_id")
    hit = wanted.withColumn("_stretch", F.expr(f"first div {_LINES}")).join(rows, ["path", "_stretch"]).where("start_line <= first AND end_line >= last")
    return hit.groupBy("path", "first", "last").agg(F.min_by("chunk_id", F.struct("ordinal", "chunk_id")).alias("chunk_id"))


def changes_preview(diff: DataFrame, shown: int = 20) -> DataFrame:
    """``(change, n, paths)``: how many files a run would touch, and the first paths of each kind."""
    counts = diff.groupBy("change").agg(F.count("*").alias("n"))
    first = diff.withColumn("k", F.row_number().over(W.partitionBy("change").orderBy("path"))).where(F.col("k") <= shown)
    return counts.join(first.groupBy("change").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths")), "change")


def set_enabled(sources: DataFrame, paths: DataFrame, enabled: bool) -> DataFrame:
    """Sources after some were disabled, or enabled again, which makes them pending."""
    rows = sources.join(paths.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    state = F.when(F.col("_hit") & F.lit(enabled) & (F.col("state") == "disabled"), "pending").when(F.col("_hit") & ~F.lit(enabled), "disabled").otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("_hit")


def reset_to_pending(sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sources after those of ``chosen`` (path) were marked to be indexed again, as for a quarantined one."""
    rows = sources.join(chosen.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return rows.withColumn("state", F.when(F.col("_hit"), "pending").otherwise(F.col("state"))).withColumn("error", F.when(F.col("_hit").isNull(), F.col("error"))).drop("_hit")
