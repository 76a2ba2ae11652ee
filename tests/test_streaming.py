from datetime import datetime

from conftest import rows

from sparkweft.streaming.ingest import event_counts

EVENTS = [("2025-01-01 00:01:00", "view"), ("2025-01-01 00:04:59", "view"), ("2025-01-01 00:05:00", "buy"), ("2025-01-01 01:00:00", "view")]
WANT = sorted([(datetime(2025, 1, 1, 0, 0), "view", 2), (datetime(2025, 1, 1, 0, 5), "buy", 1), (datetime(2025, 1, 1, 1, 0), "view", 1)], key=repr)


def test_windows_of_a_table_and_of_a_stream_with_late_rows(spark, tmp_path):
    table = spark.createDataFrame(EVENTS, "ts string, event_type string").selectExpr("cast(ts AS timestamp) AS ts", "event_type")
    assert rows(event_counts(table)) == WANT
    late = spark.createDataFrame([("2025-01-01 00:02:00", "view"), ("2025-01-01 02:00:00", "buy")], "ts string, event_type string").selectExpr("cast(ts AS timestamp) AS ts", "event_type")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (table, late, late.where("event_type = 'none'")):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        query = event_counts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    # what came after its window was closed by the watermark isn't counted; the last window is still open
    assert rows(spark.read.parquet(out)) == WANT
