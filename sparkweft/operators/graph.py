"""Graph operators over edge tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.operators.merge import inner_edges
from sparkweft.sources.tables import checkpointed, once_per_key

_LOG = logging.getLogger(__name__)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of the edges ``(src, dst)``, the component being its least node.

    Alternating star contraction: in turn each node's larger neighbours and then its smaller ones are linked to the least
    node around it, so paths halve and a hub's edges stay edges rather than gathering in a row. Ends when nothing moves.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links, state = checkpointed(links), None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("u") == F.col("v"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.where("u <> v").union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(links.select("v", "v").distinct().toDF("id", "component").join(roots.select("id"), "id", "left_anti")).distinct()


def once(table: DataFrame) -> DataFrame:
    """A table in which redelivered rows count once."""
    return table.distinct()


def live_edges(relations: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges that reviewers haven't excluded (confidence below 0), of the given types; a null confidence stays."""
    rows = relations.where("confidence IS NULL OR confidence >= 0")
    return rows.where(F.col("type").isin(types)) if types else rows


def directed(relations: DataFrame, direction: str = "both") -> DataFrame:
    """``(node, other, relation_id, type, weight)``: the edges as seen from each node. A loop is seen once."""
    out = relations.select(F.col("src_id").alias("node"), F.col("dst_id").alias("other"), F.col("id").alias("relation_id"), "type", "weight")
    back = relations.select(F.col("dst_id").alias("node"), F.col("src_id").alias("other"), F.col("id").alias("relation_id"), "type", "weight")
    return {"out": out, "in": back, "both": out.unionByName(back.where("node <> other"))}[direction]


def neighbors(relations: DataFrame, nodes: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """``(node, other, relation_id, type, weight, position)`` of every node asked for, heaviest edges first."""
    rows = directed(live_edges(relations, types), direction).join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return rows.withColumn("position", F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "relation_id")))


def traverse(relations: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "both", types: list[str] | None = None, budget: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first from the seeds ``(qid, id)`` of many questions at once: nodes ``(qid, id, hop, position)``, edges
    ``(qid, relation_id)`` and ``(qid, truncated)``.

    Nodes are admitted level by level in the order in which a queue meets them (frontier position, weight, relation) until
    a question has ``budget`` nodes, its seeds among them; edges to nodes that aren't admitted are kept, and ``truncated``
    tells that there were some.
    """
    edges = checkpointed(directed(live_edges(relations, types), direction))
    order = W.partitionBy("qid").orderBy("id")
    seen = checkpointed(seeds.select("qid", "id").distinct().withColumn("position", F.row_number().over(order)).withColumn("hop", F.lit(0)))
    walked, refused, frontier = None, None, seen
    for hop in range(1, hops + 1):
        steps = frontier.select("qid", F.col("id").alias("node"), F.col("position").alias("at")).join(edges, "node")
        steps = checkpointed(steps.select("qid", "at", "other", "relation_id", "weight"))
        walked = steps.select("qid", "relation_id") if walked is None else walked.unionByName(steps.select("qid", "relation_id"))
        met = steps.withColumnRenamed("other", "id").join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        first = met.groupBy("qid", "id").agg(F.min(F.struct("at", (-F.col("weight")).alias("w"), "relation_id")).alias("key"))
        counts = seen.groupBy("qid").agg(F.count("*").alias("taken"))
        ranked = first.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("key"))).join(counts, "qid")
        ranked = checkpointed(ranked.select("qid", "id", (F.col("taken") + F.col("n")).cast("int").alias("position")))
        frontier = ranked.where(F.col("position") <= budget).withColumn("hop", F.lit(hop))
        over = ranked.where(F.col("position") > budget).select("qid").distinct()
        refused = over if refused is None else refused.unionByName(over)
        seen = checkpointed(seen.unionByName(frontier.select("qid", "id", "position", "hop")))
        if frontier.isEmpty():
            break
    flags = seeds.select("qid").distinct().join(refused.distinct().withColumn("t", F.lit(True)), "qid", "left").select("qid", F.coalesce("t", F.lit(False)).alias("truncated"))
    return seen.select("qid", "id", "hop", "position"), walked.distinct(), flags


def relations_among(relations: DataFrame, chosen: DataFrame, limit: int = 40) -> DataFrame:
    """``(qid, relation_id, rank)``: the heaviest edges with both ends among the nodes ``(qid, id)`` of a question."""
    edges = live_edges(relations).select(F.col("id").alias("relation_id"), "src_id", "dst_id", "weight")
    inner = inner_edges(edges, chosen.select("qid", F.col("id").alias("member")), "qid")
    order = W.partitionBy("qid").orderBy(F.desc("weight"), "relation_id")
    return inner.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "relation_id", "rank")


def shown_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose source isn't disabled."""
    return chunks.join(sources.where("state = 'disabled'").select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti")


def searchable_texts(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """``(id, text, shown)`` of the chunks that have a text, once per id; those of disabled sources aren't shown."""
    hidden = sources.where("state = 'disabled'").select(F.col("id").alias("source_id"), F.lit(False).alias("shown")).distinct()
    rows = once_per_key(chunks.select("id", "source_id", "text").where("text IS NOT NULL"), "id").join(hidden, "source_id", "left")
    return rows.select("id", "text", F.coalesce("shown", F.lit(True)).alias("shown"))


def chunks_for_entities(mentions: DataFrame, shown: DataFrame, limit: int = 2) -> DataFrame:
    """``(entity_id, chunk_id, position)``: the chunks of the first ``limit`` mentions of each entity, counting only shown
    chunks; several mentions in one chunk use up the limit but yield it once."""
    rows = mentions.select("id", "entity_id", "chunk_id").join(shown.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    first = rows.withColumn("position", F.row_number().over(W.partitionBy("entity_id").orderBy("id"))).where(F.col("position") <= limit)
    return first.groupBy("entity_id", "chunk_id").agg(F.min("position").alias("position"))


def first_evidence(mentions: DataFrame, shown: DataFrame) -> DataFrame:
    """``(entity_id, chunk_id)``: the chunk of an entity's first mention."""
    rows = mentions.select("id", "entity_id", "chunk_id").join(shown.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return rows.groupBy("entity_id").agg(F.min_by("chunk_id", "id").alias("chunk_id"))


def evidence_spans(evidence: DataFrame, relations: DataFrame, mentions: DataFrame, shown: DataFrame, limit: int = 12) -> DataFrame:
    """``(relation_id, chunk_id, span_start, span_end)``: where a relation's evidence mentions its ends. The first ``limit``
    mentions count, then the first of each chunk; a chunk without a mention has null spans."""
    ends = relations.select(F.col("id").alias("relation_id"), F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("entity_id"))
    proofs = evidence.join(shown.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    spans = proofs.join(ends, "relation_id").join(mentions.select(F.col("id").alias("mention_id"), "chunk_id", "entity_id", "span_start", "span_end"), ["chunk_id", "entity_id"], "left")
    met = spans.groupBy("relation_id", "chunk_id").agg(F.max(F.col("mention_id").isNotNull()).alias("met"))
    rows = spans.join(met, ["relation_id", "chunk_id"]).where("mention_id IS NOT NULL OR NOT met").select("relation_id", "chunk_id", "mention_id", "span_start", "span_end").distinct()
    order = W.partitionBy("relation_id").orderBy("chunk_id", F.asc_nulls_last("mention_id"))
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return rows.groupBy("relation_id", "chunk_id").agg(F.min(F.struct("n", "span_start", "span_end")).alias("x")).select("relation_id", "chunk_id", "x.span_start", "x.span_end")


def undirected(relations: DataFrame) -> DataFrame:
    """``(node, other, weight)`` both ways, parallel edges added up; a loop is there twice."""
    out = relations.select(F.col("src_id").alias("node"), F.col("dst_id").alias("other"), F.col("weight").cast("double").alias("weight"))
    return out.union(out.select("other", "node", "weight")).groupBy("node", "other").agg(F.sum("weight").alias("weight"))


def personalized_pagerank(nodes: DataFrame, relations: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float | None = 1e-6, keep_every: int = 4) -> DataFrame:
    """``(id, score)`` of all nodes for seeds ``(id, weight)``: random walks over undirected weighted edges that jump back to
    the seeds. The mass of nodes without edges is spread evenly. Stops when the scores move by less than ``tolerance`` in
    all (None: never early). Nothing is broadcast but one number; lineage is cut every few rounds in the shared folder."""
    edges = undirected(relations)
    total = edges.groupBy("node").agg(F.sum("weight").alias("total"))
    step = checkpointed(edges.join(total, "node").where("total > 0").select("node", "other", (F.col("weight") / F.col("total")).alias("p")))
    mass = seeds.agg(F.sum("weight")).first()[0] or 0
    if mass <= 0:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    start = seeds.groupBy("id").agg((F.sum("weight") / F.lit(float(mass))).alias("jump"))
    rank = nodes.select("id").distinct().join(start, "id", "left").join(step.select(F.col("node").alias("id")).distinct().withColumn("linked", F.lit(True)), "id", "left")
    rank = checkpointed(rank.select("id", F.coalesce("jump", F.lit(0.0)).alias("jump"), F.col("linked").isNotNull().alias("linked"), F.coalesce("jump", F.lit(0.0)).alias("score")))
    n, idle, lost = rank.agg(F.count("*"), F.count_if(~F.col("linked")), F.sum(F.when(~F.col("linked"), F.col("jump")))).first()
    home = lost = lost or 0.0  # what the nodes without edges hold; nothing flows to them, so it follows by itself
    for k in range(1, iterations + 1):
        moved = step.join(rank.select(F.col("id").alias("node"), "score"), "node").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        score = damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / max(n, 1))) + (1 - damping) * F.col("jump")
        lost = idle * damping * lost / max(n, 1) + (1 - damping) * home
        after = rank.withColumnRenamed("score", "before").join(moved, "id", "left").select("id", "jump", "linked", "before", score.alias("score"))
        if tolerance is not None or k % keep_every == 0 or k == iterations:
            after = checkpointed(after)
        rank = after.select("id", "jump", "linked", "score")
        if tolerance is not None and (after.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    return rank.select("id", "score")


def propagate_labels(nodes: list[int], edges: list[tuple[int, int, float]], sweeps: int = 30) -> dict[int, int]:
    """Community labels by sequential propagation: nodes in ascending order take the label with most weight around them,
    the least of equal ones, until a sweep changes nothing."""
    around: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    label = {n: n for n in sorted(nodes)}
    for _ in range(sweeps):
        moved = False
        for n in label:
            votes: dict[int, float] = {}
            for other, w in around.get(n, ()):
                if other in label:
                    votes[label[other]] = votes.get(label[other], 0.0) + w
            if votes:
                best = min(votes, key=lambda v: (-votes[v], v))
                moved |= best != label[n]
                label[n] = best
        if not moved:
            break
    return label


def communities_exact(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``(id, label)`` by sequential propagation within each connected component, which is exact: labels never cross one.

    Components are worked on in parallel, but each within one task, so this is for graphs whose components fit there;
    ``communities`` is the way for others.
    """
    edges = relations.select("src_id", "dst_id", F.col("weight").cast("double").alias("weight"))
    roots = connected_components(edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    grouped = edges.join(roots.select(F.col("id").alias("src_id"), "component"), "src_id")

    def run(pdf):
        import pandas as pd

        label = propagate_labels(sorted({*pdf.src_id, *pdf.dst_id}), list(zip(pdf.src_id, pdf.dst_id, pdf.weight)))
        return pd.DataFrame(list(label.items()), columns=["id", "label"])

    found = grouped.select("component", "src_id", "dst_id", "weight").groupBy("component").applyInPandas(run, "id long, label long")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def communities(nodes: DataFrame, relations: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, label)`` by propagation in rounds, for graphs of any size. It may differ from ``communities_exact``: of each pair
    of rounds one moves a half of the nodes and the other the rest, so that neighbours don't swap labels for ever. The
    halves are drawn anew for each pair, so nodes of one half in one pair part in another.

    Ends when a pair of rounds changes nothing, which is when no node would move, or after ``rounds`` rounds (60 are 30
    sweeps); then a warning is logged, for labels may be unfinished."""
    edges = checkpointed(undirected(relations).where("node <> other"))
    labels = checkpointed(nodes.select("id", F.col("id").alias("label")).distinct())
    moved = False
    for k in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select(F.col("node").alias("id"), F.col("best.label").alias("new"))
        half = F.col("id") if k < 2 else F.xxhash64("id", F.lit(k // 2))
        turn = F.pmod(half, F.lit(2)) == k % 2
        after = checkpointed(labels.join(best, "id", "left").select("id", F.when(turn, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"), "label"))
        after = after.toDF("id", "label", "before")
        moved = (k % 2 == 1 and moved) or not after.where("label <> before").isEmpty()
        labels = after.select("id", "label")
        if not moved and k % 2:
            return labels
    _LOG.warning("communities: labels still changed after %d rounds", rounds)
    return labels


def community_table(labels: DataFrame) -> DataFrame:
    """``(label, fingerprint, member_count)``: one row per community, named by its sorted members.

    The fingerprint needs all members of a community in one row, which for ids is eight bytes each.
    """
    from sparkweft.functions.text import fingerprint

    return labels.groupBy("label").agg(fingerprint(F.collect_set("id")).alias("fingerprint"), F.count_distinct("id").alias("member_count"))


def changed_communities(new: DataFrame, old: DataFrame) -> DataFrame:
    """The communities whose fingerprint wasn't there before: those that need a new summary."""
    return new.join(old.select("fingerprint").distinct(), "fingerprint", "left_anti")


def summary_inputs(entities: DataFrame, relations: DataFrame, members: int = 8, edges: int = 8) -> DataFrame:
    """``(community_id, members, edges, top)``: what a summary is written from: the members of highest degree, the heaviest
    edges among these members as ``source type target``, and the first five names."""
    inside = entities.where("community_id IS NOT NULL")
    order = W.partitionBy("community_id").orderBy(F.desc("degree"), "id")
    best = inside.withColumn("n", F.row_number().over(order)).where(F.col("n") <= members)
    names = best.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("members"))
    ends = best.select("id", "name", "community_id")
    among = live_edges(relations).join(ends.toDF("src_id", "s", "community_id"), "src_id").join(ends.toDF("dst_id", "o", "community_id"), ["dst_id", "community_id"])
    heavy = among.withColumn("n", F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("weight"), "id"))).where(F.col("n") <= edges)
    lines = heavy.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "s", "type", "o").alias("line")))), lambda x: x["line"]).alias("edges"))
    return names.join(lines, "community_id", "left").select("community_id", "members", F.coalesce("edges", F.array().cast("array<string>")).alias("edges"), F.slice("members", 1, 5).alias("top"))


def summaries_by_model(inputs: DataFrame, summarize: Callable[[list[str], list[str]], str]) -> DataFrame:
    """``(community_id, summary, top)`` by a model that is given the members and edges of a community, asked where the
    community is; where it fails the template stands in."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for members, edges in zip(pdf["members"], pdf["edges"]):
                try:
                    out.append(summarize(list(members), list(edges)))
                except Exception:  # noqa: BLE001 - an index run must not fail with its summaries
                    out.append(None)
            yield pdf.assign(told=out)[["community_id", "told"]]

    told = inputs.select("community_id", "members", "edges").mapInPandas(run, "community_id long, told string")
    return summary_text(inputs).join(told, "community_id").select("community_id", F.coalesce("told", "summary").alias("summary"), "top")


def summary_text(inputs: DataFrame) -> DataFrame:
    """``(community_id, summary, top)`` by a template, where no model writes one."""
    text = F.concat_ws("; ", F.array_join("members", ", "), F.array_join("edges", ", "))
    return inputs.select("community_id", text.alias("summary"), "top")
