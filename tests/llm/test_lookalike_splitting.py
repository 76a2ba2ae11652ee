import random
import unicodedata

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.llm import lookalike, queries, splitting

SAME = [("Cache", "Сache"), ("Cache", "Ca​che"), ("a b", "a b"), ("a b", "a　b"), ("Overflow", "Ｏｖｅｒｆｌｏｗ"), ("office", "oﬃce"), ("é", "é"), ("a-b", "a‐b"), ("a-b", "a－b"), ("Hub", "Ηub"), ("go", "gօ"), ("キ", "ﾀ".replace("ﾀ", "ｷ")), ("列", "列"), ("ice", "ісе"), ("I", "І"), ("a﻿b", "a­b")]
DIFFERENT = [("l", "I"), ("1", "l"), ("O", "0"), ("rn", "m"), ("a", "A"), ("a", "á"), ("e", "é"), ("ı", "i"), ("ß", "b"), ("ö", "o"), ("ab", "a b"), ("‐a", "—a"), ("ñ", "n")]


@pytest.fixture(scope="module")
def classes(spark):
    texts = [(x,) for pair in SAME + DIFFERENT for x in pair]
    return lookalike.look_alike_classes(spark.createDataFrame(texts, "t string"), "t")


@pytest.mark.parametrize("a,b", SAME)
def test_same(classes, a, b):
    assert classes.canonical(a) == classes.canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(classes, a, b):
    assert classes.canonical(a) != classes.canonical(b)


def test_forms_are_stable_and_ascii_stays(classes):
    for a, b in SAME + DIFFERENT:
        for x in (a, b):
            assert classes.canonical(classes.canonical(x)) == classes.canonical(x)
            if x.isascii():
                assert classes.canonical(x) == x
    assert classes.canonical(None) is None and classes.canonical("") == ""
    assert unicodedata.is_normalized("NFC", classes.canonical("é"))


def test_tables(spark):
    df = spark.createDataFrame([(1, "Cache", 0), (1, "Cache", 0), (2, "Сache", 0), (3, "C­ache", 0), (4, "cache", 0), (5, None, 0), (6, "", 0), (None, "Сache", 0), (7, "Cache", 0)], "id long, name string, form int")
    assert rows(lookalike.same_looking(df)) == [(1, 2), (1, 3), (2, 3), (2, 7), (3, 7)]
    assert lookalike.same_looking(df.limit(0)).count() == 0
    many = spark.createDataFrame([(n, "Cache") for n in range(1, 101)] + [(200, "Сache")], "id long, name string")
    assert rows(lookalike.same_looking(many)) == [(1, 200)]
    out = lookalike.canonical_texts(df, "name")
    assert out.columns == df.columns and [r.name for r in out.where("id = 2 OR id = 5").orderBy("id").collect()] == ["Cache", None]


def test_p5_found_has_every_pair_of_a_frequent_spelling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookalike, "_SALT_ROWS", 16)  # several keys for one form
    named = [(n, "Office") for n in range(1, 66)] + [(200, "\u041effice"), (201, "Off\u00adice"), (201, "Off\u00adice"), (300, "Other")]
    spark.createDataFrame(named, "id long, name string").write.parquet(str(tmp_path / "entities.parquet"))
    want = [(n, m) for n in range(1, 66) for m in (200, 201)] + [(200, 201)]
    assert rows(queries.QUERIES["p5_found"](spark, str(tmp_path))) == sorted(want, key=repr)


def check(text, limit=1400, overlap=100):
    spans = splitting.cut_points(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and splitting.estimate(text[c:b]) <= overlap
    assert all(splitting.estimate(text[a:b]) <= limit for a, b in spans)
    return spans


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab c\n.。中#́ ", max_size=400), st.sampled_from([(10, 2), (12, 0), (30, 5)]))
def test_pieces_cover_the_text_within_the_limit(text, sizes):
    check(text, *sizes)


def test_cuts_fall_on_natural_boundaries():
    draw = random.Random(1)
    text = "\n\n".join(" ".join(draw.choice(["alpha", "beta", "gamma"]) for _ in range(60)) + "." for _ in range(60))
    assert all(text[:b].endswith("\n\n") for _, b in check(text)[:-1])
    long = " ".join(f"w{draw.random()}" for _ in range(3000))
    assert all(long[b - 1] == " " for _, b in check(long)[:-1])


def test_an_edit_moves_only_neighbouring_cuts():
    draw = random.Random(2)
    text = "\n".join(" ".join(draw.choice("abcdefgh") * 5 for _ in range(12)) for _ in range(900))
    a = {text[x:y] for x, y in check(text)}
    changed = text[:9000] + "one more line\n" + text[9000:]
    b = {changed[x:y] for x, y in check(changed)}
    assert len(a) > 10 and len(a - b) <= 3


def test_estimates():
    for text, n in (("", 0), (None, 0), ("abc", 1), ("abcd", 2), ("中文", 2), ("　 ﻿\u0085\n", 0), ("中a", 2)):
        assert splitting.estimate(text) == n


def test_split_tables(spark):
    text = "line of words\n" * 900
    df = spark.createDataFrame([(1, 11, text, 0), (1, 11, text, 0), (2, None, text, 0), (3, 1, "short", 0), (4, 1, None, 0), (5, 1, "", 0), (None, 1, text, 0)], "id long, start_line int, text string, piece_no int")
    got = splitting.split_oversized(df).where("chunk_id = 1").orderBy("piece_no").collect()
    assert [r.piece_no for r in got] == list(range(1, len(got) + 1)) and got[0].start_line == 11 and got[-1].end_line == 910
    assert all(r.token_est <= 1400 and r.text == text[r.start : r.end] and r.text.count("\n") == r.end_line - r.start_line + 1 for r in got)
    assert rows(splitting.oversized(df)) == [(1,), (2,)] and splitting.oversized(df.limit(0)).count() == 0


def test_groups_of_look_alikes(spark):
    data = [(n, "Office") for n in range(5, 1000)] + [(1, "Оffice"), (2, "Office​"), (3, "other"), (4, None), (None, "Office"), (5, "Office")]
    got = {r.id: (r.group_id, r.spellings, r.links) for r in lookalike.look_alike_groups(spark.createDataFrame(data, "id long, name string")).collect()}
    assert got[1] == (1, 3, 996) and got[2] == (1, 3, 996) and got[7] == (1, 3, 2) and got[3] == (3, 1, 0) and len(got) == 998


def test_two_texts_under_one_id_arent_mixed(spark):
    a, b = ("word " * 6000, "term " * 9000)
    got = splitting.split_oversized(spark.createDataFrame([(1, a), (1, b)], "id long, text string")).orderBy("piece_no").collect()
    assert {w for r in got for w in r.text.split()} == {"word"} and [r.piece_no for r in got] == list(range(1, len(got) + 1))
