import random
from collections import defaultdict

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.operators import graph

EDGE = "id long, src_id long, dst_id long, type string, weight long, description string, confidence double"


def edges(spark, data):
    return spark.createDataFrame([(n, a, b, t, w, None, c) for n, (a, b, t, w, c) in enumerate(data, 1)], EDGE)


def random_edges(seed, n=18, m=30):
    draw = random.Random(seed)
    return [(draw.randrange(1, n), draw.randrange(1, n), draw.choice(["uses", "calls"]), draw.randrange(1, 5), draw.choice([None, 0.5, 1.0, -1.0])) for _ in range(m)]


def queue_walk(data, seeds, hops, direction, budget):
    """The same walk with a queue, one node at a time."""
    near = defaultdict(list)
    for n, (a, b, _, w, c) in enumerate(data, 1):
        if c is not None and c < 0:
            continue
        if direction in ("out", "both"):
            near[a].append((-w, n, b))
        if direction in ("in", "both") and not (direction == "both" and a == b):
            near[b].append((-w, n, a))
    seen, used, cut, front = dict.fromkeys(sorted(seeds)), set(), False, sorted(seeds)
    for _ in range(hops):
        following = []
        for node in front:
            for _w, n, other in sorted(near[node]):
                used.add(n)
                if other not in seen:
                    if len(seen) >= budget:
                        cut = True
                    else:
                        seen[other] = None
                        following.append(other)
        front = following
    return set(seen), used, cut


def test_traverse_like_a_queue(spark):
    for seed, (direction, budget) in enumerate([("both", 100), ("out", 5), ("in", 6), ("both", 4)]):
        data = random_edges(seed)
        seeds = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "qid long, id long")
        nodes, used, flags = graph.traverse(edges(spark, data), seeds, 3, direction, None, budget)
        for qid, start in ((7, [1, 2]), (8, [3])):
            want = queue_walk(data, start, 3, direction, budget)
            assert {r.id for r in nodes.collect() if r.qid == qid} == want[0]
            assert {r.relation_id for r in used.collect() if r.qid == qid} == want[1]
            assert {r.truncated for r in flags.collect() if r.qid == qid} == {want[2]}


def test_pagerank_against_plain_python(spark):
    data = [(1, 2, "uses", 2, 1.0), (2, 3, "uses", 1, 1.0), (3, 3, "uses", 1, 1.0), (1, 2, "calls", 1, 1.0)]
    nodes = [1, 2, 3, 4]
    weight = defaultdict(float)
    for a, b, _, w, _ in data:
        weight[a, b] += w
        weight[b, a] += w
    total = {n: sum(w for (a, _), w in weight.items() if a == n) for n in nodes}
    jump = {1: 0.75, 4: 0.25}
    score = {n: jump.get(n, 0.0) for n in nodes}
    for _ in range(20):
        even = sum(score[n] for n in nodes if not total[n]) / len(nodes)
        score = {n: 0.85 * (sum(score[a] * w / total[a] for (a, b), w in weight.items() if b == n) + even) + 0.15 * jump.get(n, 0.0) for n in nodes}
    table = spark.createDataFrame([(n,) for n in nodes], "id long")
    got = graph.personalized_pagerank(table, edges(spark, data), spark.createDataFrame([(1, 3.0), (4, 1.0)], "id long, weight double"), tolerance=None)
    assert all(abs(r.score - score[r.id]) < 1e-12 for r in got.collect())
    assert graph.personalized_pagerank(table, edges(spark, data), spark.createDataFrame([], "id long, weight double")).count() == 0


def test_labels_two_triangles_and_a_bridge(spark):
    data = [(1, 2, "u", 1, 1.0), (2, 3, "u", 1, 1.0), (1, 3, "u", 1, 1.0), (4, 5, "u", 1, 1.0), (5, 6, "u", 1, 1.0), (4, 6, "u", 1, 1.0)]
    label = graph.propagate_labels([1, 2, 3, 4, 5, 6, 9], [(a, b, w) for a, b, _, w, _ in data] + [(3, 4, 0.1)])
    assert label[1] == label[2] == label[3] != label[4] == label[5] == label[6] and label[9] == 9
    got = dict(rows(graph.communities_exact(spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 9)], "id long"), edges(spark, data))))
    assert got == {1: got[1], 2: got[1], 3: got[1], 4: got[4], 5: got[4], 6: got[4], 9: 9}
    assert len(set(dict(rows(graph.communities(spark.createDataFrame([(n,) for n in range(1, 7)], "id long"), edges(spark, data)))).values())) == 2


def test_labels_run_until_none_moves(spark, caplog):
    ids = [*range(0, 20), 101, 103]
    links = [(n, n + 1, "u", 100 - n, 1.0) for n in range(19)] + [(101, 103, "u", 1, 1.0)]
    nodes, table = spark.createDataFrame([(n,) for n in ids], "id long"), edges(spark, links)
    label = dict(rows(graph.communities(nodes, table)))
    assert not caplog.records and label[101] == label[103]
    votes = defaultdict(lambda: defaultdict(float))
    for a, b, _, w, _ in links:
        votes[a][label[b]] += w
        votes[b][label[a]] += w
    assert all(label[n] == min(v, key=lambda x: (-v[x], x)) for n, v in votes.items())
    graph.communities(nodes, table, rounds=2)
    assert "still changed" in caplog.text


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), max_size=14))
def test_components_like_union_find(spark, pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = rows(graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")))
    assert got == sorted([(x, root(x)) for x in parent], key=repr)


def test_long_path_is_one_component(spark):
    got = graph.connected_components(spark.range(1, 60).selectExpr("id AS src", "id + 1 AS dst"))
    assert {tuple(r) for r in got.collect()} == {(n, 1) for n in range(1, 61)}


def test_evidence_spans_and_limits(spark):
    relations = edges(spark, [(1, 2, "uses", 1, 1.0)])
    mentions = spark.createDataFrame([(n, 10 if n < 15 else 11, 1 + n % 2, n, n + 1) for n in range(1, 17)], "id long, chunk_id long, entity_id long, span_start int, span_end int")
    shown = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    evidence = spark.createDataFrame([(1, 10), (1, 11), (1, 13)], "relation_id long, chunk_id long")
    assert rows(graph.evidence_spans(evidence, relations, mentions, shown)) == [(1, 10, 1, 2)]
    assert rows(graph.chunks_for_entities(mentions, shown, 2)) == [(1, 10, 1), (2, 10, 1)]


def test_community_table_and_changes(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, label long")
    table = graph.community_table(labels)
    assert ("8a6ae15122001229", 3) in [(r.fingerprint, r.member_count) for r in table.collect()]
    assert graph.changed_communities(table, table.where("label = 1")).select("label").collect()[0][0] == 4


def test_edges_within_groups_with_a_hub(spark):
    import random

    from sparkweft.operators.merge import inner_edges, relation_evidence

    draw = random.Random(5)
    seen = {(c, 0) for c in range(120)} | {(draw.randrange(120), e) for e in range(1, 60) for _ in range(draw.randrange(4))}
    edges = [(n, 0, e) for n, e in enumerate(range(1, 60))] + [(100, 0, 0), (101, 3, 4), (102, 4, 3), (103, 5, 999)]
    mentions = spark.createDataFrame([(c, e) for c, e in sorted(seen)] * 2, "chunk_id long, entity_id long")
    relations = spark.createDataFrame(edges, "id long, src_id long, dst_id long")
    want = sorted((n, c) for n, s, o in edges for c in range(120) if (c, s) in seen and (c, o) in seen)
    assert sorted(map(tuple, relation_evidence(relations, mentions).collect())) == want
    assert inner_edges(relations.limit(0), mentions.withColumnRenamed("entity_id", "member"), "chunk_id").count() == 0
