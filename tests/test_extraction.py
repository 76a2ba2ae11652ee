import json

from conftest import rows
from pyspark.sql import functions as F

from sparkweft.functions.vocabulary import EngineError
from sparkweft.operators import extraction, merge


def test_validation_keeps_the_closed_sets(spark):
    good = {"entities": [{"n": "A", "t": "module", "d": None, "c": 0.9}, {"n": "B", "t": "planet", "c": 0.9}, {"n": "C", "t": "api", "c": 0.2}], "relations": [{"s": "A", "r": "uses", "o": "C", "c": 1.0}, {"s": "A", "r": "eats", "o": "C", "c": 1}]}
    answers = [f"```json\n{json.dumps(good)}\n```", '{"entities": [], "relations": []}', '{"entities": [{"n": "A", "t": "nope", "c": 0.9}]}', "no json", None]
    df = extraction.validate_output(spark.createDataFrame(list(enumerate(answers)), "id int, raw string"), "raw").orderBy("id")
    got = [(len(r.entities), len(r.relations), r.dropped, r.outcome) for r in df.collect()]
    assert got == [(1, 1, 3, "ok"), (0, 0, 0, "EMPTY"), (0, 0, 1, "PARSE_FAILED"), (0, 0, 0, "PARSE_FAILED"), (0, 0, 0, "PARSE_FAILED")]


def test_mentions_like_a_search(spark):
    text = "Cache then cache, then CACHE\\E aab aaa"
    names = ["cache", "aa", "CACHE\\E", "zz"]
    chunks = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    wanted = spark.createDataFrame([(1, n, x) for n, x in enumerate(names)] + [(2, 0, "cache")], "chunk_id long, entity_id long, name string")
    want = []
    for n, name in enumerate(names):
        at = text.lower().find(name.lower())
        while at >= 0:
            want.append((1, n, at, at + len(name)))
            at = text.lower().find(name.lower(), at + len(name))
    assert rows(extraction.compute_mentions(chunks, wanted)) == sorted(want, key=repr)


def test_completer_repairs_and_halves(spark):
    def model(text, path):
        if len(text) > 8:
            raise EngineError("CONTEXT_WINDOW", "too long")
        return "{}" if "good" in text else "sorry"

    chunks = spark.createDataFrame([(1, "p", "good"), (2, "p", "bad"), (3, "p", "good\ngood\n")], "id long, path string, text string")
    got = rows(extraction.complete_chunks(chunks, model))
    assert got == [(1, "{}", 1, None), (2, "sorry", 2, "PARSE_FAILED"), (3, "{}", 1, None), (3, "{}", 1, None)]
    assert extraction.halves("a\nb") == ["a\n", "b"] and extraction.halves("a") == ["a"]


def test_first_fact_wins_and_weights_add_up(spark):
    facts = spark.createDataFrame([(2, "cache", "Cache", "module", "late"), (1, "cache", "CACHE", "api", None), (3, "cache", "cache", "api", "x"), (4, "", "", "api", None)], "seq long, norm_name string, name string, type string, description string")
    r = merge.merge_entities(facts).first()
    assert (r.name, r.type, r.description, r.aliases, r.occurrences) == ("CACHE", "api", "late", ["CACHE", "Cache"], 3)
    relations = spark.createDataFrame([(1, 9, 1, 2, "uses", None, 0.5), (2, 9, 1, 2, "uses", "d", 1.0)], "seq long, chunk_id long, src_id long, dst_id long, type string, description string, confidence double")
    assert tuple(merge.merge_relations(relations).first()) == (1, 2, "uses", 2, 0.75, "d", 1)
    ends = spark.createDataFrame([(1, "a", "b"), (3, "a", "b")], "seq long, src_norm string, dst_norm string")
    known = spark.createDataFrame([("a", 1), ("b", 2)], "norm_name string, seq long")
    assert [r.seq for r in merge.resolve_endpoints(ends, known).collect()] == [3]


def test_precomputed_items_go_to_their_chunks(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "has A"), (1, 11, 1, "has A and B")], "source_id long, id long, ordinal int, text string")
    names = spark.createDataFrame([(1, "A"), (1, "B")], "source_id long, name string")
    relations = spark.createDataFrame([(1, 5, "B", "Z")], "source_id long, rel_id long, s string, o string")
    found, first = extraction.assign_precomputed(chunks, names, relations)
    assert rows(found) == [(10, "A"), (11, "A"), (11, "B")] and rows(first) == [(11, 5)]


def test_answers_that_are_no_json_or_of_another_shape(spark):
    answers = ['{"entities": [broken', '{"entities": [{"n": "A", "t": "module", "c": 0.9},]}', '{"entities": []} and }', "[1]", '{"entities": "x"}', '{"entities": [{"n": 5, "t": "module", "c": 0.9}]}', '{"entities": [null]}', "{}"]
    df = extraction.validate_output(spark.createDataFrame(list(enumerate(answers)), "id int, raw string"), "raw").orderBy("id")
    assert [r.outcome for r in df.collect()] == ["PARSE_FAILED"] * 3 + ["EMPTY"] * 5


def test_models_are_asked_again_with_the_error_and_given_up_in_time(spark):
    import time

    from sparkweft.operators import models

    asked = []

    def chat(system, user):
        asked.append(system)
        return iter(['{"entities": ', "["]) if system == models.EXTRACTION else '{"entities": []}'

    completer = models.ChatCompleter(chat)
    assert models.within(lambda: completer("t", "p")) == '{"entities": [' and models.within(lambda: completer.repair("x", "e")) == '{"entities": []}'
    assert all(t in models.EXTRACTION for t in ("external_dependency", "depends_on"))

    def stalls(text, path):
        yield "{"
        time.sleep(0.5 if "slow" in text else 0)
        yield "}"

    chunks = spark.createDataFrame([(1, "p", "slow"), (2, "p", "fast")], "id long, path string, text string")
    assert rows(extraction.complete_chunks(chunks, stalls, idle=0.2)) == [(1, None, 0, "TIMEOUT"), (2, "{}", 1, None)]
    assert models.summarizer_of(lambda s, u: 'so: {"summary": "short"}')(["A"], []) == "short" and models.summarizer_of(lambda s, u: "plain")([], []) == "plain"
    assert models.scorer_of(lambda s, u: '{"scores": [3, 4]}')("q", ["a", "b"]) == [3.0, 4.0]


def test_items_of_images_go_to_the_chunks_that_name_them(spark):
    chunks = spark.createDataFrame([(1, 7, 0, "the Cache"), (2, 7, 1, "Disk and Cache"), (3, 8, 0, "Disk")], "id long, source_id long, ordinal int, text string")
    names = spark.createDataFrame([(7, "Cache"), (7, "Disk"), (8, "Cache")], "source_id long, name string")
    told = spark.createDataFrame([(7, 70, "Disk", "None"), (7, 71, "Disk", "Cache"), (8, 72, "x", "y")], "source_id long, rel_id long, s string, o string")
    found, first = extraction.assign_precomputed(chunks, names, told)
    assert rows(found) == [(1, "Cache"), (2, "Cache"), (2, "Disk")] and rows(first) == [(1, 71), (2, 70)]


def test_precomputed_relations_of_a_hub_arent_joined_with_all_its_texts(spark):
    """300 texts of a source hold an end that 300 relations share: the join has a row per relation and end, not 90 000."""
    chunks = spark.range(300).select("id", F.lit(7).cast("long").alias("source_id"), (300 - F.col("id")).cast("int").alias("ordinal"), F.concat(F.lit("Hub and e"), "id", F.lit("x")).alias("text"))
    names = spark.createDataFrame([(7, "Hub")], "source_id long, name string")
    told = spark.range(300).select(F.lit(7).cast("long").alias("source_id"), F.col("id").alias("rel_id"), F.lit("Hub").alias("s"), F.concat(F.lit("e"), "id", F.lit("x")).alias("o"))
    _, first = extraction.assign_precomputed(chunks, names, told)
    assert rows(first) == sorted(((299, r) for r in range(300)), key=repr)
    assert most_joined(first) <= 1000


def most_joined(df):
    """The most rows that a join of the plan gives, as it was run."""
    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(node.executedPlan())
        elif "QueryStage" in node.nodeName() or node.nodeName().endswith("QueryStage"):
            yield from walk(node.plan())
        if "Join" in node.nodeName():
            yield node.metrics().apply("numOutputRows").value()
        children = node.children()
        for n in range(children.size()):
            yield from walk(children.apply(n))

    return max(walk(df._jdf.queryExecution().executedPlan()))
