"""How typical a term is of a text compared with the whole collection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.sources.tables import once_per_key, with_keys, written

_TERM = re.compile(r"[^\W_]{3,}")
_SLICE, _HELD = 512, 150_000
#: Terms that one chunk in so many holds are joined by broadcast, others by a shuffle without hot keys. As each chunk
#: counts once for each of its terms, there are at most so many times the mean number of terms of a chunk.
_FREQUENT = 1000


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of at least three characters, lower-cased."""
    return _TERM.findall(text.lower()) if text else []


def _once(chunks: DataFrame) -> DataFrame:
    return once_per_key(chunks.select(F.col("id").cast("long").alias("id"), "text"), "id")


def term_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(term, df, ctf)`` of every term, the number of chunks that hold it and how often it occurs in all, and one row
    ``(chunks, terms)`` with the number of all chunks and of all occurrences.

    Terms are counted within each partition before they are shuffled, so a common one costs a row per partition. Texts
    aren't moved but for those of ids that occur again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, int] = {}
        ctf: dict[str, int] = {}
        n, total = 0, 0

        def flush() -> pa.RecordBatch:
            terms = [None, *df]
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([total, *ctf.values()], pa.int64())], ["term", "df", "ctf"])

        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                for text in batch.column("text").to_pylist():
                    n += 1
                    counts = Counter(terms_of(text))
                    for term, tf in counts.items():
                        df[term] = df.get(term, 0) + 1
                        ctf[term] = ctf.get(term, 0) + tf
                    total += counts.total()
                if len(df) > _HELD:
                    yield flush()
                    df, ctf, n, total = {}, {}, 0, 0
        yield flush()

    counted = _once(chunks).select("text").mapInArrow(run, "term string, df long, ctf long")
    summed = written(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")), "terms")
    return summed.where("term IS NOT NULL"), summed.where("term IS NULL").select(F.col("df").alias("chunks"), F.col("ctf").alias("terms"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, term, tf, length)`` of every term of every chunk; ``length`` is the number of all terms of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    counts = Counter(terms_of(text))
                    out[0].extend([i] * len(counts))
                    out[1].extend(counts)
                    out[2].extend(counts.values())
                    out[3].extend([counts.total()] * len(counts))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(out)], ["chunk_id", "term", "tf", "length"])

    rows = chunks.select(F.col("id").cast("long").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "chunk_id long, term string, tf long, length long")


def likelihood_ratio(tf: Column, length: Column, ctf: Column, terms: Column) -> Column:
    """The log-likelihood ratio of the table (this term or another) by (this chunk or the rest), negative where the chunk
    holds less of the term than the collection does."""

    def part(seen: Column, rows: Column, columns: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * terms / (rows * columns))).otherwise(0.0)

    rest, other = terms - length, terms - ctf
    a, b, c = tf, ctf - tf, length - tf
    d = rest - b
    ratio = 2 * (part(a, ctf, length) + part(b, ctf, rest) + part(c, other, length) + part(d, other, rest))
    return F.when(a * terms >= ctf * length, ratio).otherwise(-ratio)


def term_scores(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(chunk_id, term, tf, df, score, tf_idf)`` of every pair of a chunk and a term that it holds.

    ``score`` is the log-likelihood ratio, ``tf_idf`` is tf · ln(N / df). The statistics always cover all chunks; with
    ``only`` (a column ``chunk_id``) just those chunks are scored. Chunks count once per id
    (of different texts under one id the greatest); null and empty texts count as chunks without terms; a null id
    doesn't count; extra columns are ignored; an empty table gives no rows.
    """
    stats, totals = term_statistics(chunks)
    rows = chunks.select(F.col("id").cast("long").alias("id"), "text")
    if only is not None:
        rows = with_keys(rows, "id", only.select(F.col("chunk_id").cast("long").alias("id")))
    pairs = written(chunk_terms(_once(rows)), "pairs")
    total = totals.first()
    n, terms = (total["chunks"], total["terms"]) if total else (0, 0)
    frequent = F.col("df") >= n / _FREQUENT
    common = stats.where(frequent)
    scored = pairs.join(F.broadcast(common), "term").unionByName(pairs.join(F.broadcast(common.select("term")), "term", "left_anti").join(stats.where(~frequent), "term"))
    score = likelihood_ratio(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("ctf").cast("double"), F.lit(float(terms)))
    return scored.select("chunk_id", "term", "tf", "df", score.alias("score"), (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("tf_idf"))


def most_typical(scores: DataFrame, by: str = "tf_idf") -> DataFrame:
    """``(chunk_id, term)``: the term with the highest value of ``by``; of equal ones that with the higher likelihood
    ratio, then the first in the alphabet. One row per chunk that holds a term."""
    best = scores.groupBy("chunk_id").agg(F.min(F.struct((-F.round(by, 9)).alias("v"), (-F.round("score", 9)).alias("s"), "term")).alias("x"))
    return best.select("chunk_id", F.col("x.term").alias("term"))
