from datetime import datetime

from conftest import rows

from sparkweft.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, scanned_at timestamp_ntz, path string, content_hash string, here string, change string"


def day(n):
    return datetime(2025, 1, n)


def listing(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def test_added_changed_removed(spark):
    data = [(1, day(1), "a", "AA"), (1, day(1), "b", "bb"), (1, day(1), "c", "cc"), (2, day(2), "./a", "sha256:aa"), (2, day(2), "b", "b2"), (2, day(2), "d", "dd")]
    assert rows(snapshot_changes(listing(spark, data))) == [(2, "b", "changed"), (2, "c", "removed"), (2, "d", "added")]


def test_latest_row_counts_and_repeats_dont(spark):
    data = [(1, day(1), "a", "1"), (2, day(3), "a", "1"), (2, day(2), "a", "2"), (2, day(3), "a", "1"), (2, None, "a", "9")]
    assert rows(snapshot_changes(listing(spark, data))) == []


def test_nulls_gaps_and_empty_tables(spark):
    data = [(1, day(1), "a", None), (2, day(2), "a", "1"), (2, day(2), None, "1"), (None, day(2), "z", "1"), (4, day(4), "q", "1"), (5, day(5), "q", "2"), (5, day(5), "r", None)]
    assert rows(snapshot_changes(listing(spark, data))) == [(5, "q", "changed"), (5, "r", "added")]
    assert snapshot_changes(listing(spark, data).limit(0)).count() == 0
