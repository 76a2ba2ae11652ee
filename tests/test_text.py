from pyspark.sql import functions as F

from sparkweft.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_norm_name(spark):
    for given, key in ((" Chunk_Fold ", "chunkfold"), ("API 网关", "api网关"), ("a.b-c/d\\(e)", "abcde"), ("「保留」", "「保留」"), ("", ""), (None, None)):
        assert one(spark, given, text.norm_name) == key


def test_estimate_tokens(spark):
    for given, n in (("", 0), ("abc", 1), ("abcd", 2), ("中文", 2), ("中 a ﻿b", 2), ("カナ", 2), ("한글", 1), (None, None)):
        assert one(spark, given, text.estimate_tokens) == n


def test_extract_terms(spark):
    assert one(spark, "Hello, hello wor ab 知识图谱 X图谱", text.extract_terms) == ["hello", "wor", "知识图", "识图谱", "X图谱"]
    assert one(spark, "", text.extract_terms) == []


def test_slugify(spark):
    for given, slug in (("My KB!", "my-kb"), ("知识", "kb"), ("--a--b--", "a-b"), ("x" * 60, "x" * 40)):
        assert one(spark, given, text.slugify) == slug


def test_strip_fences(spark):
    for given, body in (('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("no object", "no object"), ("} {", "} {"), ("", "")):
        assert one(spark, given, text.strip_fences) == body


def test_fingerprint_is_known(spark):
    assert spark.range(1).select(text.fingerprint(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("y")).first()["y"] == "8a6ae15122001229"


def test_shown_and_extension(spark):
    assert one(spark, "a" * 4001, text.shown) == "a" * 4000 + "…[截断]"
    assert one(spark, "a" * 4000, text.shown) == "a" * 4000
    assert [one(spark, p, text.extension) for p in ("a/b.TS", "Makefile", "x.tar.gz")] == [".ts", "", ".gz"]
