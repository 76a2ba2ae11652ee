import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparkweft.functions.vocabulary import EngineError
from sparkweft.operators import documents, merge, scan


def test_scan_reads_authorised_folders_only(spark, tmp_path):
    (tmp_path / "ok/sub dir").mkdir(parents=True)
    (tmp_path / "ok/.git").mkdir()
    (tmp_path / "other").mkdir()
    for name, data in (("ok/a.md", b"# a"), ("ok/sub dir/b+c.txt", b"x"), ("ok/.git/c", b"x"), ("ok/my_secret.txt", b"x"), ("ok/.env.local", b"x"), ("ok/z.bin", b"a\0b"), ("other/o.md", b"x")):
        (tmp_path / name).write_bytes(data)
    files, refused = scan.scan_roots(spark, [str(tmp_path / "ok"), str(tmp_path / "other"), str(tmp_path / "none")], [str(tmp_path / "ok")])
    assert [r[1] for r in refused] == ["NOT_AUTHORIZED", "missing"]
    assert [r[0] for r in rows(files.select("path"))] == ["a.md", "sub dir/b+c.txt", "z.bin"]
    assert files.where("path = 'a.md'").first().content_hash == hashlib.sha256(b"# a").hexdigest()
    states = {r.path: (r.state, r.error) for r in documents.text_of_file(files).collect()}
    assert states == {"a.md": ("pending", None), "sub dir/b+c.txt": ("pending", None), "z.bin": ("failed", "skipped-binary")}
    with pytest.raises(EngineError):
        scan.assert_authorized(str(tmp_path / "other"), [str(tmp_path / "ok")])


def test_diff_against_index(spark):
    known = spark.createDataFrame([("same", "1", "merged"), ("new hash", "1", "merged"), ("off", "1", "disabled"), ("gone", "1", "merged"), ("off gone", "1", "disabled"), ("was deleted", "1", "deleted")], "path string, content_hash string, state string")
    found = spark.createDataFrame([("same", "1"), ("new hash", "2"), ("off", "2"), ("fresh", "3")], "path string, content_hash string")
    assert rows(scan.diff_against_index(found, known)) == [("fresh", "added"), ("gone", "removed"), ("new hash", "changed"), ("off gone", "removed")]
    assert scan.diff_against_index(found.limit(0), known.limit(0)).count() == 0


def test_routes(spark):
    df = spark.createDataFrame([("a.PNG",), ("b.docx",), ("c.doc",), ("d.ts",), ("e",)], "path string")
    assert [r[0] for r in df.select(scan.route(F.col("path"), F.lit(True))).collect()] == ["image", "document", "legacy", "binary", "binary"]
    assert [r[0] for r in df.select(scan.image_mime(F.col("path"))).collect()] == ["image/png", None, None, None, None]


def test_upsert_and_recover(spark):
    known = spark.createDataFrame([("a", "1", 5, "merged", None), ("b", "1", 5, "failed", "x"), ("c", "1", 5, "disabled", None)], "path string, content_hash string, size_bytes long, state string, error string")
    found = spark.createDataFrame([("a", "1", 5), ("b", "2", 6), ("c", "2", 6), ("d", "3", 7)], "path string, content_hash string, size_bytes long")
    after = {r.path: tuple(r)[1:] for r in merge.upsert_sources(known, found).collect()}
    assert after == {"a": ("1", 5, "merged", None), "b": ("2", 6, "pending", None), "c": ("1", 5, "disabled", None), "d": ("3", 7, "pending", None)}
    assert {r.path: r.state for r in merge.recovered(known).collect()} == {"a": "merged", "b": "pending", "c": "disabled"}
