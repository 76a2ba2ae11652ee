"""Scanning authorised folders, routing files by kind, and comparing a scan with the index."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import extension, glob_regex
from sparkweft.functions.vocabulary import DEFAULT_EXCLUDES, DOC_EXTENSIONS, IMAGE_MIME, LEGACY_EXTENSIONS, EngineError


def assert_authorized(root: str, authorized: list[str]) -> str:
    """The real path of ``root`` if it lies in an authorised folder."""
    real = os.path.realpath(root)
    if not any(real == a or real.startswith(a + "/") for a in map(os.path.realpath, authorized)):
        raise EngineError("NOT_AUTHORIZED", root)
    return real


def is_excluded(path: Column, excludes: list[str] | None = None) -> Column:
    """Whether a folder or the file of a relative path is hidden or matches a pattern; ``excludes`` add to the defaults."""
    rules = [glob_regex(p) for p in dict.fromkeys([*DEFAULT_EXCLUDES, *(excludes or [])])]
    return F.exists(F.split(path, "/"), lambda s: s.rlike(r"^\.") | s.rlike("|".join(rules)))


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether an absolute path is one of the roots or lies in one."""
    return F.lit(False) if not roots else F.coalesce(*[F.when((path == r) | path.startswith(r.rstrip("/") + "/"), True) for r in roots], F.lit(False))


def scan_roots(spark: SparkSession, roots: list[str], authorized: list[str], excludes: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(root, path, abs_path, size_bytes, mtime_ms, content_hash, content)`` of the files, and the roots that were refused.

    Paths are relative to their own root, and the root is part of the key, so equal paths under two roots stay apart.
    """
    good, refused = [], []
    for root in roots:
        if not os.path.exists(root):
            refused.append((root, "missing"))
            continue
        try:
            good.append(assert_authorized(root, authorized))
        except EngineError as e:
            refused.append((root, e.code))
    found = None
    for root in good:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        absolute = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/*", "/")
        rows = files.select(F.lit(root).alias("root"), F.substr(absolute, F.lit(len(root) + 2)).alias("path"), absolute.alias("abs_path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), F.sha2("content", 256).alias("content_hash"), "content")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "root string, path string, abs_path string, size_bytes long, mtime_ms long, content_hash string, content binary")
    return found.where(~is_excluded(F.col("path"), excludes)), refused


def is_binary(content: Column) -> Column:
    """Whether the bytes hold a zero byte."""
    return F.locate("\x00", F.decode(content, "ISO-8859-1")) > 0


def route(path: Column, binary: Column | None = None) -> Column:
    """How a file is read: image, document, legacy, binary or text. The extension beats the test of the bytes."""
    ext = extension(path)
    known = F.when(ext.isin(*IMAGE_MIME), "image").when(ext.isin(*DOC_EXTENSIONS), "document").when(ext.isin(*LEGACY_EXTENSIONS), "legacy")
    return known.when(binary, "binary").otherwise("text") if binary is not None else known.otherwise("text")


def image_mime(path: Column) -> Column:
    pairs = [F.lit(x) for pair in IMAGE_MIME.items() for x in pair]
    return F.create_map(*pairs)[extension(path)]


def diff_against_index(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, change)``: added, changed or removed files of a scan against the index, unchanged ones left out.

    A disabled source never counts as changed, but may be removed; a deleted one isn't removed again.
    """
    a = scanned.select("path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("here"))
    b = known.select("path", F.col("content_hash").alias("old_hash"), "state", F.lit(True).alias("there"))
    change = (
        F.when(F.col("there").isNull(), "added")
        .when(F.col("here").isNull(), F.when(F.coalesce("state", F.lit("")) != "deleted", "removed"))
        .when((F.coalesce("state", F.lit("")) != "disabled") & (F.col("new_hash") != F.col("old_hash")), "changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def estimate_cost(files: int) -> dict[str, int]:
    """Files to index and model calls to expect: one per file and a tenth more for summaries."""
    return {"files": files, "calls": files + -(-files // 10)}
