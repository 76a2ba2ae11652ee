"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_listing(listing: DataFrame) -> DataFrame:
    """One row ``(snapshot_no, path, content_hash)`` per path of a snapshot.

    The row with the latest ``scanned_at`` counts (a null time is the oldest; of equal times the greatest hash counts,
    so that the result doesn't depend on the order of rows). Paths lose leading ``./``; hashes lose an algorithm prefix
    and their letter case; an empty hash is null. Rows without a path or a snapshot number are left out.
    """
    digest = F.lower(F.regexp_replace("content_hash", r"^\s*[A-Za-z][A-Za-z0-9_-]*:|\s+", ""))
    rows = listing.select(
        F.col("snapshot_no").cast("int").alias("snapshot_no"),
        F.regexp_replace("path", r"^(\./+)+", "").alias("path"),
        F.struct(
            F.col("scanned_at").isNotNull().alias("timed"),
            F.col("scanned_at").alias("at"),
            F.when(digest != "", digest).alias("digest"),
        ).alias("state"),
    ).where("snapshot_no IS NOT NULL AND path IS NOT NULL")
    return rows.groupBy("snapshot_no", "path").agg(F.max("state").alias("state")).select("snapshot_no", "path", F.col("state.digest").alias("content_hash"))


def snapshot_changes(listing: DataFrame) -> DataFrame:
    """``(snapshot_no, path, change)`` of every snapshot against the one numbered one less.

    Identical rows are removed by EXCEPT ALL both ways, which is one aggregation here: every row counts +1 as it is and -1
    as the predecessor of the next snapshot, so the table is read and shuffled once; what is left above zero is what only
    the later snapshot has, below zero what only the earlier one has. The residues are full-joined by key, so the join
    sees what differs rather than two whole snapshots. ``change`` is ``added``, ``removed`` or ``changed``.

    Defined cases: a null hash on either side is no change; a snapshot whose predecessor is missing yields no rows, nor
    does the first; an empty table yields none; repeated rows count once. Extra columns are ignored. Keys are
    (snapshot, path), so one hot snapshot spreads over all tasks.
    """
    now = canonical_listing(listing)
    numbers = listing.select(F.col("snapshot_no").cast("int").alias("snapshot_no")).where("snapshot_no IS NOT NULL").distinct()
    consecutive = numbers.join(numbers.select((F.col("snapshot_no") + 1).alias("snapshot_no")), "snapshot_no", "left_semi")
    roles = F.explode(F.array(F.struct(F.lit(0).alias("later"), F.lit(1).alias("sign")), F.struct(F.lit(1).alias("later"), F.lit(-1).alias("sign"))))
    signed = now.select("snapshot_no", "path", "content_hash", roles.alias("r")).select((F.col("snapshot_no") + F.col("r.later")).alias("snapshot_no"), "path", "content_hash", "r.sign")
    differ = signed.join(consecutive, "snapshot_no", "left_semi").groupBy("snapshot_no", "path", "content_hash").agg(F.sum("sign").alias("surplus"))
    fresh, stale = differ.where("surplus > 0").drop("surplus"), differ.where("surplus < 0").drop("surplus")
    a = fresh.withColumn("here", F.lit(True))
    b = stale.withColumnRenamed("content_hash", "old_hash").withColumn("there", F.lit(True))
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(F.col("content_hash") != F.col("old_hash"), "changed")
    return a.join(b, ["snapshot_no", "path"], "full_outer").select("snapshot_no", "path", change.alias("change")).where("change IS NOT NULL")
