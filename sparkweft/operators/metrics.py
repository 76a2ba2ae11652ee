"""Measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.operators.lexical import names_in_texts
from sparkweft.sources.tables import checkpointed


def percentile(values: Column, p: float) -> Column:
    """The element at position floor(p · n) of the sorted values, the last if that is beyond; not interpolated."""
    return F.element_at(F.array_sort(values), F.least(F.size(values), F.floor(F.lit(p / 100.0) * F.size(values)).cast("int") + 1))


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(group, *shares)``: the same element of each group's sorted values, found by counting equal ones, so that no group is
    gathered into a row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy(group).orderBy(value))).withColumn("all", F.sum("n").over(W.partitionBy(group)))
    place = lambda p: F.least(F.col("all"), F.floor(F.lit(p / 100.0) * F.col("all")) + 1)
    return upto.groupBy(group).agg(*(F.min(F.when(F.col("upto") >= place(p), F.col(value))).alias(name) for name, p in shares.items()))


def _met(found: DataFrame, names: DataFrame) -> DataFrame:
    """``(qid, id, name)``: the names ``(qid, name)`` that texts of their question contain, whatever their letter case."""
    key = ["rank"] if "rank" in found.columns else []
    texts = found.select(F.col("qid").alias("grp"), F.xxhash64(*key, "text").alias("id"), F.lower("text").alias("text"))
    return names_in_texts(texts, names.select(F.col("qid").alias("grp"), F.lower("name").alias("name"))).withColumnRenamed("grp", "qid")


def _share_found(found: DataFrame, golden: DataFrame, name: str) -> DataFrame:
    met = _met(found, golden.select("qid", F.col("alias").alias("name"))).select("qid", "name").distinct().withColumn("hit", F.lit(1.0))
    rows = golden.select("qid", "grp", F.lower("alias").alias("name")).join(met, ["qid", "name"], "left").groupBy("qid", "grp").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("hit"))
    return rows.groupBy("qid").agg(F.avg("hit").alias(name))


def entity_hit(found: DataFrame, golden: DataFrame) -> DataFrame:
    """``(qid, entity_hit)``: of the golden groups ``(qid, grp, alias)`` the share of which an alias is in a text ``(qid,
    rank, text)`` among the first five."""
    return _share_found(found.where("rank <= 5"), golden, "entity_hit")


def relation_recall(found: DataFrame, golden: DataFrame) -> DataFrame:
    """``(qid, relation_recall)``: the share of golden pairs ``(qid, s, o)`` whose ends occur in one text."""
    pairs = golden.select("qid", F.lower("s").alias("s"), F.lower("o").alias("o"), F.col("s").alias("_s"), F.col("o").alias("_o"))
    met = checkpointed(_met(found, pairs.select("qid", F.explode(F.array("s", "o")).alias("name"))).distinct())  # read four times
    often = met.groupBy("qid", "name").agg(F.count("*").alias("n"))
    rows = pairs.join(often.toDF("qid", "s", "_ns"), ["qid", "s"]).join(often.toDF("qid", "o", "_no"), ["qid", "o"])
    rare = F.col("_ns") <= F.col("_no")  # from the rarer end, as a frequent one is in nearly every text
    rows = rows.select("qid", "_s", "_o", F.when(rare, F.col("s")).otherwise(F.col("o")).alias("name"), F.when(rare, F.col("o")).otherwise(F.col("s")).alias("other"))
    both = rows.join(met, ["qid", "name"]).join(met.withColumnRenamed("name", "other"), ["qid", "id", "other"], "left_semi").select("qid", "_s", "_o").distinct()
    hits = pairs.select("qid", "_s", "_o").distinct().join(both.withColumn("hit", F.lit(1.0)), ["qid", "_s", "_o"], "left")
    return hits.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("relation_recall"))


def reciprocal_rank(ranked: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """``(qid, mrr)``: the mean over golden groups of 1 / the rank of their first name in ``(qid, rank, name)``, 0 beyond k."""
    same = golden.withColumn("name", F.lower(F.trim("alias"))).select("qid", "grp", "name")
    met = same.join(ranked.select("qid", "rank", F.lower(F.trim("name")).alias("name")), ["qid", "name"], "left").groupBy("qid", "grp").agg(F.min("rank").alias("rank"))
    return met.groupBy("qid").agg(F.avg(F.coalesce(F.when(F.col("rank") <= k, 1.0 / F.col("rank")), F.lit(0.0))).alias("mrr"))


def coverage(found: DataFrame, points: DataFrame) -> DataFrame:
    """``(qid, coverage)``: the share of points ``(qid, grp, alias)`` of which an alias is in any text."""
    return _share_found(found, points, "coverage")


def precision_recall(returned: DataFrame, golden: DataFrame) -> DataFrame:
    """``(qid, precision, recall, f1)`` of the sets of items ``(qid, item)``; an empty golden set has recall 1."""
    a, b = returned.select("qid", "item").distinct(), golden.select("qid", "item").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["qid", "item"], "full_outer").groupBy("qid").agg(F.count("a").alias("n"), F.count("b").alias("m"), F.count(F.col("a") + F.col("b")).alias("k"))
    p = F.coalesce(F.col("k") / F.nullif("n", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("k") / F.nullif("m", F.lit(0)), F.lit(1.0))
    rows = both.select("qid", p.alias("precision"), r.alias("recall"))
    return rows.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


#: Fixed values of the gates: how far local measures may fall, what global coverage must gain, what traversals must reach.
MAY_FALL, MUST_GAIN, LEAST_PRECISION, LEAST_RECALL = 0.02, 0.05, 0.8, 0.7


def gates(flat: dict[str, float], graph: dict[str, float]) -> dict[str, bool]:
    """Whether the graph's measures hold against the plain index's: as good locally, better globally, and sound traversals."""
    local = all(graph[m] >= flat[m] - MAY_FALL for m in ("entity_hit", "relation_recall"))
    return {"local": local, "global": graph["coverage"] >= flat["coverage"] + MUST_GAIN, "traversal": graph["precision"] >= LEAST_PRECISION and graph["recall"] >= LEAST_RECALL}
