"""Combining documents of several sources so that each has a target share of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.llm.bpe import VOCABULARY, count_tokens
from sparkweft.sources.tables import once_per_key, written

SEED = 20250


def _targets(targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats)``, one row per source; of repeated rows the greatest counts."""
    share = F.when(F.col("target_share") > 0, F.col("target_share").cast("double")).otherwise(0.0)
    most = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("long")
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(share.alias("s"), most.alias("m"))).alias("x"))
    return rows.select("source", F.col("x.s").alias("target_share"), F.col("x.m").alias("max_repeats"))


def _wanted(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, source, text)`` of the documents whose source is in ``targets``, once per id. Sources of the mixture table
    are few, so they are broadcast, and texts stay where they are but for those of repeated ids."""
    rows = once_per_key(documents.select("doc_id", "source", "text"), "doc_id")
    return rows.join(F.broadcast(_targets(targets).select("source")), "source", "left_semi").select("doc_id", "source", "text")


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the wanted documents, counted once and written without their texts."""
    return written(count_tokens(_wanted(documents, targets), ["doc_id", "source"], vocabulary=vocabulary), "sized")


def repetition_rates(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, fill: bool = False) -> DataFrame:
    """``(source, target_share, max_repeats, n_docs, n_tokens, meant_share, rate, deviation)``: how often each document of a
    source is to be repeated on average, and the standard deviation of the tokens that the draws then give the source.

    By default the mix is the largest in which no source hits its ``max_repeats``, so all shares are reached; a share of a
    source without tokens is spread over the others in proportion. With ``total_tokens`` set, or ``fill`` for as many
    tokens as the wanted sources have, a source that is too small for its share is repeated ``max_repeats`` times and
    falls short, which the report shows.
    """
    squares = F.sum(F.col("n_tokens").cast("double") ** 2).alias("squares")
    sizes = documents.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), squares)
    rows = _targets(targets).join(sizes, "source", "left").na.fill(0, ["n_docs", "n_tokens", "squares"])
    live = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everything = W.partitionBy(F.lit(1))  # a row per source of the mixture table
    rows = rows.withColumn("part", F.when(live, F.col("target_share")) / F.sum(F.when(live, F.col("target_share"))).over(everything))
    reached = F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("part")).over(everything)
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("n_tokens").over(everything).cast("double") if fill else reached
    rows = rows.withColumn("total", total)
    rate = F.coalesce(F.when(live, F.least(F.col("part") * F.col("total") / F.col("n_tokens"), F.col("max_repeats").cast("double"))), F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("over", F.col("rate") - F.floor("rate"))
    deviation = F.sqrt(F.col("squares") * F.col("over") * (1 - F.col("over")))
    return rows.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", F.coalesce("part", F.lit(0.0)).alias("meant_share"), "rate", deviation.alias("deviation"))


def _repeated(documents: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    known = F.broadcast(rates.select("source", "rate", "max_repeats"))  # a row per source of the mixture table
    return documents.join(known, "source").withColumn("times", F.least(times, F.col("max_repeats")).cast("int")).where("times > 0")


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, vocabulary: str = VOCABULARY, fill: bool = False) -> DataFrame:
    """``(doc_id, copy_no, source, n_tokens, text)`` of the mixture: each document floor(rate) times and once more by a
    Bernoulli draw seeded with its id, with the fraction of the rate as probability.

    Whether a document is drawn depends on its id and the seed alone, not on partitioning or a retry of a task. No
    document is repeated more than ``max_repeats`` times. Rows without an id or of sources that aren't wanted aren't
    part of the mixture; empty and null texts have no tokens and come with their source; repeated ids count once (of
    rows that differ the greatest); a null ``max_repeats`` is 1, a null, zero or negative share wants nothing. Empty
    tables give an empty mixture. Texts aren't shuffled: sizes are summed up first, then the documents drawn are read again.
    """
    rates = written(repetition_rates(sized(documents, targets, vocabulary), targets, total_tokens, fill), "rates")
    drawn = _repeated(_wanted(documents, targets), rates, seed)
    rows = count_tokens(drawn, ["doc_id", "source", "times", "text"], vocabulary=vocabulary)
    return rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"), "source", "n_tokens", "text")


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, vocabulary: str = VOCABULARY, fill: bool = False) -> DataFrame:
    """A row per wanted source: its size and rate, the tokens and share that ``mix_sources`` gives it, ``likely_error``,
    three standard deviations of that share by the draws, and ``capped``, whether the cap on repeats keeps it short."""
    docs = sized(documents, targets, vocabulary)
    rates = written(repetition_rates(docs, targets, total_tokens, fill), "rates")
    got = _repeated(docs, rates, seed).groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("mixed_tokens"), F.max("times").alias("most_copies"))
    rows = rates.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
    every = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    rows = rows.withColumn("actual_share", F.col("mixed_tokens") / every).withColumn("likely_error", 3 * F.col("deviation") / every)
    return rows.withColumn("capped", (F.col("rate") > 0) & (F.col("rate") >= F.col("max_repeats")) & (F.col("actual_share") < F.col("meant_share") - F.col("likely_error"))).drop("deviation")
