"""Reading tables and choosing a durable folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def read_table(spark: SparkSession, base_dir: str, name: str, columns: list[str] | None = None, spread: bool = False) -> DataFrame:
    """``base_dir/name.parquet`` with only ``columns`` (all if None).

    With ``spread`` a table in fewer pieces than there are cores is dealt out to all of them, for work in Python that a
    single row group would otherwise give to one task. Larger tables have pieces enough and aren't touched.
    """
    df = spark.read.parquet(f"{base_dir}/{name}.parquet")
    df = df if columns is None else df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and everything runs on one machine (as in tests) is a temporary folder made, and kept for the
    session; on a cluster a folder of one machine would lose data, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkweft-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as parquet into the shared folder and read back (columnar, so later scans prune columns).

    The folder stays until ``clear_written``, because the result is lazy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkweft-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many folders ``written`` has made and ``clear_written`` hasn't removed."""
    return len(_WRITTEN)


def clear_written(spark: SparkSession, since: int = 0) -> int:
    """Removes the folders that ``written`` made in this process after the first ``since``, once nothing that reads them is
    run any more."""
    jvm, n = spark._jvm, 0
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


#: Bits of the map of keys that rows are sorted out by; in words of 64 there are at most 2^20 rows to broadcast.
_MAP_BITS = 1 << 26


def _placed(key: str) -> list:
    at = F.pmod(F.xxhash64(key), F.lit(_MAP_BITS))
    return [F.floor(at / 64).cast("int").alias("_word"), (at % 64).cast("int").alias("_bit")]


def _marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``_hit``, true for every row whose key is among ``keys``, and by chance for a few others.

    What is broadcast is a bit map of the hashed keys, whose size is bounded however many keys there are.
    """
    words = keys.select(*_placed(keys.columns[0])).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    rows = df.select("*", *_placed(key)).join(F.broadcast(words), "_word", "left")
    return rows.withColumn("_hit", F.expr("coalesce(shiftright(_bits, _bit) & 1L = 1L, false)")).drop("_word", "_bit", "_bits")


def with_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in the only column of ``keys``. Rows of other keys, but for a few, are sorted out
    where they are, so wide rows aren't shuffled to be dropped."""
    ids = keys.toDF(key).distinct()
    return _marked(df, key, ids).where("_hit").drop("_hit").join(ids, key, "left_semi")


def once_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key that isn't null, of rows that repeat one the greatest. Only rows of repeated keys are moved, and a
    few others by chance; all else stays where it is."""
    rest = [c for c in df.columns if c != key]
    rows = df.where(F.col(key).isNotNull())
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    rows = _marked(rows, key, again)
    picked = rows.where("_hit").groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))
    return rows.where("NOT _hit").select(*df.columns).unionByName(picked.select(*df.columns))
