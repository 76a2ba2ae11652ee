import pytest
from conftest import rows

from sparkweft.sources import tables


def test_rows_of_keys_and_one_row_per_key(spark, monkeypatch):
    df = spark.createDataFrame([(n % 40, f"t{n}") for n in range(60)] + [(None, "x"), (7, None)], "id long, text string")
    want = {}
    for i, t in ((n % 40, f"t{n}") for n in range(60)):
        want[i] = max(t, want.get(i, ""))
    keys = spark.createDataFrame([(3,), (3,), (39,), (100,)], "k long")
    for bits in (64, 1 << 26):  # where every word is hit by chance, and where hardly one is
        monkeypatch.setattr(tables, "_MAP_BITS", bits)
        assert rows(tables.once_per_key(df, "id")) == sorted(want.items(), key=repr)
        assert {r.text for r in tables.with_keys(df, "id", keys).collect()} == {"t3", "t43", "t39"}
    assert tables.once_per_key(df.limit(0), "id").count() == 0 and tables.with_keys(df, "id", keys.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://h:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        tables.shared_dir(Session)
