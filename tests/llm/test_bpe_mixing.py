import os

import numpy as np
import pytest
from conftest import rows

from sparkweft.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_like_the_public_library(reference):
    import random

    draw = random.Random(5)
    texts = ["Hello world's  end\n\n\n x", "<|endoftext|> is text", "  \t lead", "日本語 текст é é ½²", "a\x1cb \x1d c", "=" * 3000, " " * 400 + "x", "\r\n\r\n", "x y", "𝒳😀 ﻿"]
    texts += ["".join(draw.choice("aeThe 's\n\t12-=_é中  😀\x1c.") for _ in range(200)) for _ in range(300)]
    for text, packed in zip(texts, bpe.encoder().encode(texts)):
        assert np.frombuffer(packed, "<i4").tolist() == reference(text), text


def test_every_token_encodes_to_itself():
    trie = bpe.encoder().trie
    ids = [i for i in trie.bytes_of if i in trie.rank]
    got = trie.encode_words([trie.bytes_of[i] for i in ids])
    assert all(np.frombuffer(got[trie.bytes_of[i]], "<i4").tolist() == [i] for i in ids)


def test_tables(spark, reference):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello", "x"), (None, "a", "x"), (4, "long " * 20000, "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()]
    assert got[:5] == [(1, reference("Hello")), (2, []), (3, []), (1, reference("Hello")), (None, reference("a"))]
    assert got[5] == (4, reference("long " * 20000))
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert [r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()][:3] == [len(reference("Hello")), 0, 0]


DOCS = "doc_id long, source string, text string, rate string"
TARGET = "source string, target_share double, max_repeats int"


def test_shares_are_reached_and_repeats_capped(spark):
    docs = [(n, "big", "word " * 40, "x") for n in range(400)] + [(1000 + n, "small", "word " * 40, "x") for n in range(20)] + [(5000, "other", "word", "x"), (None, "big", "w", "x"), (0, "big", "word " * 40, "x")]
    docs = spark.createDataFrame([*docs, (6000, "big", None, "x")], DOCS)
    target = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("none", 0.1, 3), ("small", 0.3, 3), (None, 0.1, 1)], TARGET)
    report = {r.source: r for r in mixing.mix_report(docs, target).collect()}
    assert report["small"].rate == 3.0 and report["small"].most_copies == 3 and report["none"].mixed_tokens == 0
    assert abs(report["small"].actual_share - 1 / 3) < 0.06 and abs(report["big"].actual_share - 2 / 3) < 0.06
    mixed = mixing.mix_sources(docs, target)
    per = mixed.groupBy("doc_id", "source").count().collect()
    assert max(r["count"] for r in per if r.source == "small") == 3 and {r.source for r in per} == {"big", "small"}
    assert rows(mixed.select("doc_id", "copy_no")) == rows(mixing.mix_sources(docs.repartition(7), target).select("doc_id", "copy_no"))
    assert sum(r.mixed_tokens for r in report.values()) == mixed.groupBy().sum("n_tokens").first()[0]


def test_a_larger_mix_falls_short_where_it_must(spark):
    docs = spark.createDataFrame([(n, "a" if n < 90 else "b", "word " * 10, "") for n in range(100)], DOCS)
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGET)
    report = {r.source: r for r in mixing.mix_report(docs, target, total_tokens=2000).collect()}
    assert report["b"].rate == 2.0 and report["a"].rate == 1.0 and report["b"].actual_share < 0.25
    full = {r.source: r for r in mixing.mix_report(docs, target, fill=True).collect()}
    assert full["b"].capped and not full["a"].capped and full["b"].meant_share == 0.5 and full["b"].actual_share < 0.4 and full["b"].likely_error == 0
    assert mixing.mix_sources(docs.limit(0), target).count() == 0 and mixing.mix_sources(docs, target.limit(0)).count() == 0
