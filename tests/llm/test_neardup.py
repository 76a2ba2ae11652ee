import random

from conftest import rows

from sparkweft.llm import neardup, queries

HOW = {"threshold": 0.7, "shingle": 3, "least_words": 20}


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(n):
        base = [draw.choice(words) for _ in range(draw.randrange(20, 90))]
        texts.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 2])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 3, 8])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(", ".join(copy).upper())
    return texts + ["too short", "", None]


def brute(rows_):
    sets = {}
    for i, t in rows_:
        if i is not None and t and len(neardup.words_of(t)) >= 20:
            sets[i] = neardup.shingles_of(t, 3)
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}


def test_pairs_and_groups_like_brute_force(spark):
    data = list(enumerate(corpus(3), 1))
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in data] + [(1, data[0][1], "q", 1), (None, data[0][1], "q", 1)], "id long, text string, a string, size int")
    want = brute(data)
    pairs, members = neardup.similar_classes(df, **HOW)
    got = [tuple(r) for r in neardup.similar_pairs(pairs, members).collect()]
    assert len(want) > 15 and set(got) == want and len(got) == len(want)
    parent = {i: i for i, _ in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    groups = {r.id: r.group_id for r in neardup.similar_groups(df, **HOW).collect()}
    assert groups == {i: root(i) for i, _ in data}


def test_crowded_nodes_lose_no_pair(spark):
    data = list(enumerate(corpus(4, 40), 1))
    pairs, members = neardup.similar_classes(spark.createDataFrame(data, "id long, text string"), crowd=1, **HOW)
    assert {tuple(r) for r in neardup.similar_pairs(pairs, members).collect()} == brute(data)


def test_many_copies_are_linked_to_one(spark):
    text = " ".join(f"w{k}" for k in range(30))
    near = text.replace("w29", "other")
    df = spark.createDataFrame([(n, text) for n in range(1, 101)] + [(200, near)], "id long, text string")
    pairs, members = neardup.similar_classes(df, **HOW)
    assert rows(pairs.select("a", "b")) == [(1, 200)]
    got = {tuple(r) for r in neardup.similar_pairs(pairs, members).collect()}
    assert got == {(1, n) for n in range(2, 101)} | {(1, 200)}


def test_p2_found_has_every_pair_of_a_large_class(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK_ROWS", 16)  # several blocks for one class
    text = " ".join(f"w{k}" for k in range(30))
    data = [(n, text.upper() if n % 3 else text) for n in range(1, 71)]
    data += [(n, text.replace("w29", "other")) for n in range(100, 140)] + [(200, text.replace("w0 ", "first ")), (201, "too short")]
    spark.createDataFrame(data, "id long, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = rows(queries.QUERIES["p2_found"](spark, str(tmp_path)))
    assert got == sorted(brute(data), key=repr) and len(got) > 70 * 69 // 2


def test_depth_is_shortened_until_the_recall_is_reached():
    assert neardup.forest_depth(0.7, 24, 8, 0.998) == 4
    assert neardup.forest_depth(0.95, 24, 8, 0.998) == 8
    assert neardup.forest_depth(0.1, 2, 8, 0.999) == 1


def edited(draw, base, edits):
    copy = list(base)
    for at in draw.sample(range(len(copy)), edits):
        copy[at] = f"new{draw.randrange(10**6)}"
    return " ".join(copy)


def looks(spark, monkeypatch, texts, **how):
    """The pairs found, and how many times candidates of a shorter prefix were verified."""
    calls, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda *a: calls.append(1) or verified(*a))
    pairs, members = neardup.similar_classes(spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string"), **{**HOW, **how})
    return {tuple(r) for r in neardup.similar_pairs(pairs, members).collect()}, len(calls)


def test_prefixes_are_shortened_only_until_the_recall_is_reached(spark, monkeypatch):
    draw = random.Random(11)
    bases = [[f"w{draw.randrange(5000)}" for _ in range(120)] for _ in range(40)]
    close = [t for b in bases for t in (" ".join(b), edited(draw, b, 1))]
    found, once = looks(spark, monkeypatch, close)
    assert found == brute(enumerate(close, 1)) and len(found) == 40 and once == 1  # whole paths find them all
    far = [t for b in bases for t in (" ".join(b), edited(draw, b, 6))]
    want = brute(enumerate(far, 1))
    found, steps = looks(spark, monkeypatch, far)
    assert len(want) > 30 and steps > 1 and len(found & want) >= 0.998 * len(want) and found <= want
    monkeypatch.undo()
    some, _ = looks(spark, monkeypatch, far, overall=0.0)
    assert some < want  # whole paths alone miss some, so the steps did find them


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    pairs, members = neardup.similar_classes(df, **HOW)
    assert pairs.count() == members.count() == 0 and neardup.similar_groups(df, **HOW).count() == 0
