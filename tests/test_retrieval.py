import sqlite3

from conftest import rows
from pyspark.sql import functions as F

from sparkweft.operators import lexical, metrics, retrieval
from sparkweft.operators.governance import correct_relations, review_sample, review_stats


def test_bm25_equals_the_database_engine(spark):
    texts = ["The Cache warms the cache", "aaaa AAAA", "知识图谱检索与图谱", "ÉCO éco cache", "", "nothing here", "cache"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='trigram')")
    db.executemany("INSERT INTO t (rowid, text) VALUES (?, ?)", enumerate(texts, 1))
    table = spark.createDataFrame([(n, t, True) for n, t in enumerate(texts, 1)], "id long, text string, shown boolean")
    for question in ("cache", "aaa", "知识图谱", "cache the", "zz"):
        terms = spark.createDataFrame([(1, question)], "qid long, question string")
        got = {r.id: r.score for r in lexical.bm25(table, terms, 5).collect()}
        words = [r.term for r in lexical.question_terms(terms).collect()]
        want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY 2 LIMIT 5", (" OR ".join(f'"{w}"' for w in words),))) if words else {}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_hidden_texts_count_but_arent_shown(spark):
    table = spark.createDataFrame([(1, "cache one", True), (2, "cache two", False), (3, "other", True), (4, "third", True), (5, "fifth", True)], "id long, text string, shown boolean")
    got = lexical.bm25(table, spark.createDataFrame([(1, "cache")], "qid long, question string"), 5)
    assert [r.id for r in got.collect()] == [1]


def test_spellings_of_a_term_count_each(spark):
    table = spark.createDataFrame([(1, "x图谱 here"), (2, "nothing")], "id long, text string")
    assert rows(lexical.count_terms(table, ["X图谱", "x图谱"])) == [(1, "X图谱", 1), (1, "x图谱", 1)]


def test_token_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 3, 9), (1, 4, 1)], "g long, n long, cost long")
    assert [r.n for r in retrieval.within_budget(df, "g", [F.col("n")], "cost", 8).collect()] == [1, 2]


def test_seeds_and_fusion(spark):
    entity_hits = spark.createDataFrame([(1, 5, 1)], "qid long, id long, rank int")
    chunk_hits = spark.createDataFrame([(1, 100, 1), (1, 101, 2)], "qid long, id long, rank int")
    mentions = spark.createDataFrame([(100, 6), (101, 6), (101, 7), (100, 5)], "chunk_id long, entity_id long")
    seeds = retrieval.build_seeds(entity_hits, chunk_hits, mentions, 12)
    assert rows(seeds) == [(1, 5, 12.0), (1, 6, 1.5), (1, 7, 0.5)]
    scores = spark.createDataFrame([(1, 5, 0.1), (1, 6, 0.4), (1, 8, 0.2)], "qid long, id long, score double")
    assert [(r.id, r.rank) for r in retrieval.fuse(scores, seeds).orderBy("rank").collect()] == [(5, 1), (6, 2), (8, 3)]


def test_corrections(spark):
    relations = spark.createDataFrame([(1, 1, 2, "uses", 0.4), (2, 1, 2, "calls", 0.4)], "id long, src_id long, dst_id long, type string, confidence double")
    entities = spark.createDataFrame([(1, "a", "A", "module"), (2, "b", "B", "module")], "id long, norm_name string, name string, type string")
    fixes = spark.createDataFrame([(1, " ", "tests", "New One"), (2, "", "", None)], "id long, s string, r string, o string")
    after, every = correct_relations(relations, entities, fixes)
    assert rows(after) == [(1, 1, 3, "tests", 1.0), (2, 1, 2, "calls", 0.4)]
    assert rows(every)[-1] == (3, "newone", "New One", "concept")


def test_reviews(spark):
    relations = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, -1.0), (4, 0.4), (5, 0.4), (6, None)], "id long, confidence double")
    judged = spark.createDataFrame([(5,)], "id long")
    assert [r.id for r in review_sample(relations, judged, 3).orderBy("rank").collect()] == [4, 2, 1]
    assert [r.id for r in review_sample(relations, judged, 2).orderBy("rank").collect()] == [4, 2]
    events = spark.createDataFrame([(1, "correct", False, 0.5), (2, "wrong", False, 0.9), (3, "unsure", False, 0.5), (4, "wrong", True, 0.5)], "relation_id long, verdict string, corrected boolean, confidence double")
    assert tuple(review_stats(events).first()) == (3, 1, 1, 1, 1, 1)


def test_measures(spark):
    found = spark.createDataFrame([(1, 1, "Uses the Cache"), (1, 6, "the Index")], "qid long, rank int, text string")
    gold = spark.createDataFrame([(1, 1, "cache"), (1, 1, "Store"), (1, 2, "index")], "qid long, grp long, alias string")
    assert metrics.entity_hit(found, gold).first().entity_hit == 0.5
    assert metrics.coverage(found, gold).first().coverage == 1.0
    ranked = spark.createDataFrame([(1, 2, "Cache"), (1, 9, "index")], "qid long, rank int, name string")
    assert metrics.reciprocal_rank(ranked, gold).first().mrr == 0.25
    a, b = (spark.createDataFrame([(1, x) for x in v], "qid long, item string") for v in ("ab", "bcd"))
    assert [round(x, 4) for x in tuple(metrics.precision_recall(a, b).first())[1:]] == [0.5, 0.3333, 0.4]
    assert spark.range(1).select(metrics.percentile(F.array(*map(F.lit, [5, 1, 4, 2])), 50)).first()[0] == 4
    good = {"entity_hit": 1.0, "relation_recall": 1.0, "coverage": 0.9, "precision": 0.9, "recall": 0.8}
    assert metrics.gates({**good, "coverage": 0.8}, good) == {"local": True, "global": True, "traversal": True}


def test_model_scores_fall_back_per_batch(spark):
    def model(question, part):
        if "s3" in part:
            raise ValueError
        return [99, -1, 4][: len(part)] if len(part) == 3 else [1]

    assert retrieval.score_summaries(["a", "b", "c", "s3", "s4 cache", "x", "y"], "cache", ["cache"], model, 3) == [10.0, 0.0, 4.0, 0.0, 1.0, 0.0, 1.0]
    summaries = spark.createDataFrame([(n, "cache" if n == 7 else "other") for n in range(12)], "community_id long, summary string").coalesce(1)
    asked = spark.createDataFrame([(1, "cache")], "qid long, question string")
    got = retrieval.rank_summaries_by_model(summaries, asked, lambda q, part: [5.0 if "cache" in s else 1.0 for s in part], 2)
    assert [(r.community_id, r.rank) for r in got.orderBy("rank").collect()] == [(7, 1), (0, 2)]
    assert [r.community_id for r in retrieval.rank_summaries(summaries, asked, 1).collect()] == [7]


def graph_tables(spark):
    """Three services that call one another, one of them under another name too, and one that nothing is linked to."""
    sources = [(1, "order.md", "merged"), (2, "stock.md", "merged"), (3, "hidden.md", "disabled")]
    chunks = [(10, 1, 1, 4, "Order Service calls Stock Service"), (11, 2, 1, 2, "Stock Service tells Mail Service"), (12, 3, 1, 9, "Lonely Thing"), (13, 2, 3, 6, "Lonely Thing by itself")]
    entities = [(1, "orderservice", "Order Service", "Order Service Purchasing", "module", 1, 7), (2, "stockservice", "Stock Service", "Stock Service", "module", 2, 7), (3, "mailservice", "Mail Service", "Mail Service", "module", 1, 7), (4, "lonelything", "Lonely Thing", "Lonely Thing", "concept", 0, None)]
    relations = [(1, 1, 2, "calls", 3, 0.9), (2, 2, 3, "calls", 1, 0.8), (3, 1, 3, "uses", 9, -1.0)]
    mentions = [(1, 10, 1), (2, 10, 2), (3, 11, 2), (4, 11, 3), (5, 12, 4), (6, 13, 4)]
    frame = spark.createDataFrame
    return {
        "sources": frame(sources, "id long, path string, state string"),
        "chunks": frame(chunks, "id long, source_id long, start_line int, end_line int, text string"),
        "entities": frame([(*e[:5], None, *e[5:]) for e in entities], "id long, norm_name string, name string, search_text string, type string, description string, degree long, community_id long"),
        "relations": frame(relations, "id long, src_id long, dst_id long, type string, weight long, confidence double"),
        "mentions": frame([(*m, 0, 1) for m in mentions], "id long, chunk_id long, entity_id long, span_start int, span_end int"),
        "summaries": frame([(7, "orders and stock", ["Order Service"])], "community_id long, summary string, top array<string>"),
    }


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def test_local_search_by_alias_with_evidence_and_without_a_seed(spark):
    tables = graph_tables(spark)
    found = retrieval.local_search(tables, questions(spark, "purchasing", "xyzzy"), iterations=4)
    assert {r.qid: r.outcome for r in found["outcomes"].collect()} == {0: "ok", 1: "NO_SEED"}
    pack = retrieval.evidence_pack(tables, found)
    assert [r.name for r in pack["entities"].where("qid = 0").orderBy("rank").collect()][0] == "Order Service"
    assert rows(pack["relations"].select("s", "r", "o", "w", "path", "lines")) == [("Order Service", "calls", "Stock Service", 3, "order.md", "1-4"), ("Stock Service", "calls", "Mail Service", 1, "order.md", "1-4")]
    assert {r.path for r in pack["chunks"].collect()} == {"order.md", "stock.md"} and pack["chunks"].where("text LIKE 'Order%'").first().lines == "1-4"
    assert pack["communities"].first().note == retrieval.SUMMARY_NOTE
    assert {r.coverage for r in pack["outcomes"].collect()} == {"3 files / 4 entities / 3 relations"}


def test_walks_for_many_questions_are_exact(spark):
    from sparkweft.operators.graph import personalized_pagerank

    tables = graph_tables(spark)
    more = spark.range(10, 40).select("id", F.concat(F.lit("n"), "id").alias("name"))
    nodes = tables["entities"].select("id", "name").unionByName(more)
    seeds = {0: {1: 2.0, 4: 1.0}, 1: {2: 1.0}, 2: {4: 1.0, 12: 3.0}}
    many = retrieval.pagerank_many(nodes, tables["relations"], spark.createDataFrame([(q, i, w) for q, s in seeds.items() for i, w in s.items()], "qid long, id long, weight double"), keep=5)
    for q, s in seeds.items():
        one = {r.id: r.score for r in personalized_pagerank(nodes, tables["relations"], spark.createDataFrame(list(s.items()), "id long, weight double"), tolerance=None).collect()}
        got = {r.id: r.score for r in many.where(F.col("qid") == q).collect()}
        assert all(abs(got[i] - one[i]) < 1e-12 for i in got)
        best = sorted(one, key=lambda i: (-round(one[i], 9), i))[:5]
        assert set(best) <= set(got)


def test_traversal_lists_ambiguous_names_and_places(spark):
    tables = graph_tables(spark)
    walk = retrieval.traversal_search(tables, questions(spark, "Order Service", "service", "nothing at all"), hops=1, direction="out")
    assert {r.qid: (r.outcome, len(r.candidates)) for r in walk["seeds"].collect()} == {0: ("ok", 0), 1: ("ambiguous", 3), 2: ("NO_SEED", 0)}
    edges = retrieval.with_evidence(walk["edges"], tables).collect()
    assert [(r.s, r.o, r.path, r.lines) for r in edges] == [("Order Service", "Stock Service", "order.md", "1-4")]
    nowhere = retrieval.places(spark.createDataFrame([(99,)], "entity_id long"), tables).first()
    assert (nowhere.path, nowhere.lines) == (retrieval.NO_PLACE, retrieval.NO_LINES)


def test_global_search_needs_summaries(spark):
    import pytest

    from sparkweft.functions.vocabulary import EngineError

    tables = graph_tables(spark)
    with pytest.raises(EngineError, match="NOT_INDEXED"):
        retrieval.global_search(tables, tables["summaries"].limit(0), questions(spark, "orders"))
    got = retrieval.global_search(tables, tables["summaries"], questions(spark, "orders"), scorer=lambda q, part: [1.0] * len(part))
    assert {r.chunk_id for r in got["chunks"].collect()} == {10, 11}


def test_a_source_of_many_texts_and_names_doesnt_pair_them(spark):
    """4000 texts and 60 000 names of one group: every name reaches the texts once, not with each of them."""
    import time

    texts = spark.range(4000, numPartitions=1).select(F.lit(1).cast("long").alias("grp"), "id", F.concat(F.lit("tells of name"), "id", F.lit("x")).alias("text"))
    names = spark.range(60_000, numPartitions=1).select(F.lit(1).cast("long").alias("grp"), F.concat(F.lit("name"), "id", F.lit("x")).alias("name"))
    began = time.time()
    met = rows(lexical.names_in_texts(texts, names).select("id", "name"))
    assert met == sorted(((i, f"name{i}x") for i in range(4000)), key=repr)
    assert time.time() - began < 18


def test_names_meet_texts_in_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_NAMES", 2)
    monkeypatch.setattr(lexical, "_TEXTS", 2)
    texts = spark.createDataFrame([(g, i, "a b c d") for g in (1, 2) for i in range(2**60, 2**60 + 5)] + [(3, 1, ""), (4, 2, None)], "grp long, id long, text string")
    names = spark.createDataFrame([(1, n) for n in "abcde"] + [(2, "d"), (2, "d"), (2, ""), (3, "a"), (5, "a")], "grp long, name string")
    want = [(1, i, n) for i in range(2**60, 2**60 + 5) for n in "abcd"] + [(2, i, "d") for i in range(2**60, 2**60 + 5)]
    assert rows(lexical.names_in_texts(texts, names)) == sorted(want, key=repr)


def test_relation_recall_meets_names_once(spark):
    """The names are found once, whatever the joins read them for."""
    found = spark.createDataFrame([(1, 1, "Alpha calls beta"), (1, 2, "alpha alone"), (2, 1, "gamma")], "qid long, rank int, text string")
    gold = spark.createDataFrame([(1, "Alpha", "Beta"), (1, "Alpha", "Gamma"), (2, "Gamma", "gamma"), (3, "x", "y")], "qid long, s string, o string")
    got = metrics.relation_recall(found, gold)
    assert rows(got) == [(1, 0.5), (2, 1.0), (3, 0.0)]
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_bm25_keeps_the_best_of_each_part_only(spark):
    """400 texts in 4 parts, of which half tie: 2 rows of each part and question are left to be compared, not 400."""
    texts = spark.range(1, 401, numPartitions=4).select("id", F.concat(F.lit("cache "), F.when(F.col("id") % 2 == 0, "cache ").otherwise("other ")).alias("text"), F.lit(True).alias("shown"))
    asked = questions(spark, "cache", "other cache")
    got = lexical.bm25(texts, asked, 2)
    assert rows(got.select("qid", "rank", "id")) == [(0, 1, 2), (0, 2, 4), (1, 1, 1), (1, 2, 3)]
    plan = got._jdf.queryExecution()
    counted = lexical._counted(texts.withColumn("d", F.length("text").cast("long") - 2), ["cache", "other"])
    left = lexical._best(counted, [(0, "cache"), (1, "cache"), (1, "other")], {"cache": 400, "other": 200}, 400, 10.0, 2, "long")
    assert left.count() == 16 and "Join" not in plan.executedPlan().toString()
    assert rows(lexical.bm25(texts, asked, 2, block=1)) == rows(got)


def test_walks_leave_a_row_for_what_may_be_wanted_only(spark, monkeypatch):
    """50 walks over 300 linked nodes: their seeds and the first 5, not all that they reach; the same as by rows."""
    edges = [(n, 1 + n * 7 % 300, 1 + n * 11 % 299, "uses", 1 + n % 4, 1.0) for n in range(900)] + [(900, 3, 999, "uses", 2, 1.0)]
    relations = spark.createDataFrame(edges, "id long, src_id long, dst_id long, type string, weight long, confidence double")
    nodes = spark.range(1, 330)
    seeds = spark.createDataFrame([(q, i, w) for q in range(50) for i, w in ((1 + q, 2.0), (1 + q * 5 % 320, 1.0), (320, 0.5))], "qid long, id long, weight double").dropDuplicates(["qid", "id"])
    held = retrieval.pagerank_many(nodes, relations, seeds, keep=5)
    assert held.count() <= 50 * (3 + 5 + 5)
    monkeypatch.setattr(retrieval, "_HELD", 0)
    walked = retrieval.pagerank_many(nodes, relations, seeds, keep=5)
    best = lambda found: [(r.qid, r.id, round(r.score, 9), r.rank) for r in retrieval.fuse(found.join(nodes, "id"), seeds, 5).orderBy("qid", "rank").collect()]
    assert len(best(held)) == 250 and [r[:2] for r in best(held)] == [r[:2] for r in best(walked)]
