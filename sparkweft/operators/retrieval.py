"""The retrieval modes over the graph tables, for many questions in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.functions.text import estimate_tokens, extract_terms, norm_name
from sparkweft.functions.text import shown as shown_text
from sparkweft.functions.vocabulary import EngineError
from sparkweft.operators import graph, lexical
from sparkweft.sources.tables import checkpointed, once_per_key, with_keys


def within_budget(rows: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs add up to at most ``budget``: the first row beyond it ends the list."""
    spent = F.sum(cost).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).where(F.col("spent") <= budget)


def build_seeds(entity_hits: DataFrame, chunk_hits: DataFrame, mentions: DataFrame, limit: int = 12) -> DataFrame:
    """``(qid, id, weight)``: entities that a question names weigh ``limit`` less their rank; entities mentioned in the
    chunks it finds add 1 / rank for each mention and fill what is left of the limit."""
    direct = entity_hits.where(F.col("rank") <= limit).select("qid", "id", (F.lit(limit + 1.0) - F.col("rank")).alias("weight"))
    reverse = chunk_hits.select("qid", F.col("id").alias("chunk_id"), (1.0 / F.col("rank")).alias("w")).join(mentions.select("chunk_id", "entity_id"), "chunk_id")
    reverse = reverse.groupBy("qid", F.col("entity_id").alias("id")).agg(F.sum("w").alias("weight")).join(direct.select("qid", "id"), ["qid", "id"], "left_anti")
    both = direct.withColumn("first", F.lit(0)).unionByName(reverse.withColumn("first", F.lit(1)))
    order = W.partitionBy("qid").orderBy("first", F.desc(F.round("weight", 9)), "id")
    return both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("qid", "id", "weight")


def fuse(scores: DataFrame, seeds: DataFrame, top: int = 25) -> DataFrame:
    """``(qid, id, score, rank)``: half the seed weight and half the rank score, each against its greatest value."""
    rows = scores.join(seeds.withColumnRenamed("weight", "seed"), ["qid", "id"], "left")
    rows = rows.join(rows.groupBy("qid").agg(F.max("seed").alias("most_seed"), F.max("score").alias("most_score")), "qid")
    fused = 0.5 * F.coalesce(F.col("seed") / F.col("most_seed"), F.lit(0.0)) + 0.5 * F.coalesce(F.col("score") / F.nullif("most_score", F.lit(0.0)), F.lit(0.0))
    order = W.partitionBy("qid").orderBy(F.desc(F.round("fused", 9)), "id")
    return rows.withColumn("fused", fused).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("qid", "id", F.col("fused").alias("score"), "rank")


def _even_share(step: DataFrame, linked: DataFrame, nodes: DataFrame, damping: float, iterations: int) -> tuple[DataFrame, int]:
    """``(id, even)`` of all nodes: the score that a walk adds to each for a unit of seed weight on nodes without edges.

    What such nodes lose is spread over all nodes alike and then flows on, the same way for every question, so it is
    walked once. What they hold themselves follows a recurrence, as nothing flows to them but their even part.
    """
    linked = linked.withColumn("linked", F.lit(True))
    flow = checkpointed(nodes.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked")))
    n, idle = flow.agg(F.count("*"), F.count_if(~F.col("linked"))).first()
    lost = [1.0]
    for _ in range(1, iterations):
        lost.append(1 - damping + damping * lost[-1] * idle / max(n, 1))
    flow = flow.select("id", F.lit(1.0 / max(n, 1)).alias("u"), F.lit(damping * lost[-1] / max(n, 1)).alias("even"))
    for j in range(1, iterations):
        moved = step.join(flow.select(F.col("id").alias("node"), "u"), "node").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("p") * F.col("u")).alias("got"))
        flow = flow.join(moved, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("u"), (F.col("even") + F.coalesce("got", F.lit(0.0)) * (damping ** (j + 1) * lost[iterations - 1 - j])).alias("even"))
        if j % 4 == 0:
            flow = checkpointed(flow)
    return flow.select("id", "even"), n


def _walks_by_rows(step: DataFrame, linked: DataFrame, nodes: DataFrame, jump: DataFrame, damping: float, iterations: int, keep: int) -> DataFrame:
    """``(qid, id, score)`` with a row for each node that a question's walk has reached and the first ``keep`` of the others.

    The even part that nodes without edges give to all nodes is worked out once and added in proportion to the seed
    weight on such nodes, so questions never have a row for every node.
    """
    ids = nodes.select("id").distinct()
    step = checkpointed(step.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").join(ids.withColumnRenamed("id", "other"), "other", "left_semi"))
    jump = checkpointed(jump.join(ids, "id", "left_semi").select("qid", "id", "jump"))
    idle = jump.join(linked, "id", "left_anti").groupBy("qid").agg(F.sum("jump").alias("idle"))
    rank = jump.select("qid", "id", F.col("jump").alias("score"))
    for k in range(1, iterations + 1):
        moved = rank.join(step, rank["id"] == step["node"]).select("qid", F.col("other").alias("id"), (damping * F.col("score") * F.col("p")).alias("score"))
        back = jump.select("qid", "id", ((1 - damping) * F.col("jump")).alias("score"))
        rank = moved.unionByName(back).groupBy("qid", "id").agg(F.sum("score").alias("score"))
        if k % 4 == 0 or k == iterations:
            rank = checkpointed(rank)
    idle = checkpointed(jump.select("qid").distinct().join(idle, "qid", "left").select("qid", F.coalesce("idle", F.lit(0.0)).alias("idle")))
    even = None
    if not idle.where("idle > 0").isEmpty():
        even = checkpointed(_even_share(step, linked, nodes, damping, iterations)[0])
    # no node that a walk hasn't reached can come before the first ones by their even part, or by id where that is nothing
    firsts = [([r.id for r in ids.orderBy("id").limit(keep).collect()], "idle = 0")]
    if even is not None:
        firsts.append(([r.id for r in even.orderBy(F.desc(F.round("even", 12)), "id").limit(keep).collect()], "idle > 0"))
    for first, which in firsts:
        more = idle.where(which).select("qid", F.explode(F.array(*map(F.lit, first)).cast("array<long>")).alias("id"), F.lit(0.0).alias("score"))
        rank = rank.unionByName(more)
    rank = rank.groupBy("qid", "id").agg(F.sum("score").alias("score"))
    if even is None:
        return rank
    return rank.join(idle, "qid").join(even, "id").select("qid", "id", (F.col("score") + F.col("idle") * F.col("even")).alias("score"))


class _Walks:
    """Walks over a graph that a worker holds whole, for some questions at a time: a dense column of scores for each.

    Nodes that edges touch are numbered by how many they have, so those with equally many follow one another and their
    sums are one array operation. The others all have the same score but for what seeds give them.
    """

    def __init__(self, ids: np.ndarray, linked: np.ndarray, node: np.ndarray, other: np.ndarray, p: np.ndarray):
        """ids, linked: all nodes, and those that edges touch; node, other, p: the steps, of which those to no node are lost."""
        ids, linked = np.unique(ids), np.unique(linked)
        linked = linked[np.isin(linked, ids)]
        self.n, self.idle = len(ids), np.setdiff1d(ids, linked)
        inside = np.isin(node, linked) & np.isin(other, linked)
        node, other, p = np.searchsorted(linked, node[inside]), np.searchsorted(linked, other[inside]), p[inside]
        often = np.bincount(other, minlength=len(linked))
        by = np.argsort(often, kind="stable")
        at = np.empty(len(linked), np.int64)
        at[by] = np.arange(len(linked))
        order = np.lexsort((node, at[other]))
        self.ids, self.from_, self.p = linked[by], at[node[order]].astype(np.int32), p[order]
        self.sizes, self.first = np.unique(often[by], return_index=True)
        self.by_id = np.argsort(self.ids)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Where linked nodes are in the numbering, -1 for others."""
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), max(len(self.ids) - 1, 0))
        found = self.by_id[at] if len(self.ids) else np.zeros(len(ids), np.int64)
        return np.where(self.ids[found] == ids, found, -1) if len(self.ids) else np.full(len(ids), -1)

    def flow(self, x: np.ndarray) -> np.ndarray:
        """What reaches each node in a step, from the scores of all."""
        out, edge, width = np.zeros_like(x), 0, x.shape[1]
        for k, a, b in zip(self.sizes.tolist(), self.first.tolist(), [*self.first[1:].tolist(), len(self.ids)]):
            if not k:
                continue
            some = max(1, (1 << 18) // (k * width))
            for lo in range(a, b, some):
                hi = min(b, lo + some)
                m = (hi - lo) * k
                p, x_ = self.p[edge : edge + m], x[self.from_[edge : edge + m]]
                out[lo:hi] = p @ x_ if hi - lo == 1 else np.einsum("mk,mkb->mb", p.reshape(-1, k), x_.reshape(-1, k, width))
                edge += m
        return out

    def run(self, seeds: list[tuple[np.ndarray, np.ndarray]], damping: float, iterations: int, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each question, of which ``seeds`` has nodes and shares of weight: the nodes that may be wanted and their scores."""
        jump, places, width = np.zeros((len(self.ids), len(seeds))), [], len(seeds)
        for q, (ids, share) in enumerate(seeds):
            known = np.isin(ids, self.idle) | (self.place(ids) >= 0)
            ids, share = ids[known], share[known]
            at = self.place(ids)
            np.add.at(jump[:, q], at[at >= 0], share[at >= 0])
            places.append((ids, share, at))
        home = np.array([share[at < 0].sum() for _, share, at in places])  # what jumps to nodes without edges
        x, even, lost = jump, np.zeros(width), home
        for k in range(1, iterations + 1):
            even = damping * lost / max(self.n, 1)  # for every node
            x = self.flow(x)
            x *= damping
            x += even
            x += (1 - damping) * jump
            lost = even * len(self.idle) + (1 - damping) * home
        columns = np.ascontiguousarray(x.T)
        for q, (ids, share, at) in enumerate(places):
            own, score = at[at >= 0], columns[q]
            apart = self.idle[: keep + len(ids)]
            apart = apart[~np.isin(apart, ids)][:keep]
            most = max(score.max(initial=0.0), even[q]) or 1.0
            v = 0.5 * score / most
            v[own] = -1.0
            floor = np.partition(v, len(v) - keep)[len(v) - keep] if len(v) > keep else -1.0
            near = np.flatnonzero(v >= max(floor - 3e-9, -0.5))
            near = near[lexical.first_rows(np.zeros(len(near), int), v[near], self.ids[near], keep)] if len(near) > keep else near
            idle = at < 0
            yield np.r_[ids, self.ids[near], apart], np.r_[np.where(idle, even[q] + (1 - damping) * share if iterations else share, score[at] if len(score) else 0.0), score[near], np.full(len(apart), even[q])]


#: Up to so many edges and nodes every worker holds the graph (some 30 bytes each) and cells of scores at a time (8 bytes
#: each, a few times over); beyond, walks go by rows.
_HELD, _CELLS = 8_000_000, 4_000_000


def _walks_held(spark: SparkSession, step: DataFrame, linked: DataFrame, nodes: DataFrame, jump: DataFrame, damping: float, iterations: int, keep: int) -> DataFrame:
    """``(qid, id, score)`` of the seeds of each question and of the nodes that may be among the first ``keep`` of the others."""
    steps, column = step.toArrow(), lambda df: df.toArrow().column(0).to_numpy()
    walks = _Walks(column(nodes.select("id").distinct()), column(linked), *(steps.column(c).to_numpy() for c in ("node", "other", "p")))
    sent = spark.sparkContext.broadcast(walks)
    width = int(min(64, max(4, _CELLS // max(len(walks.ids), 1))))
    kinds = dict(jump.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), width):
                some = pdf.iloc[lo : lo + width]
                for qid, (ids, scores) in zip(some["qid"], sent.value.run(list(zip(some["ids"], some["shares"])), damping, iterations, keep)):
                    yield pd.DataFrame({"qid": qid, "id": ids, "score": scores})

    listed = jump.groupBy("qid").agg(F.collect_list(F.struct("id", "jump")).alias("s")).select("qid", F.col("s.id").alias("ids"), F.col("s.jump").alias("shares"))  # seeds of one question
    rows = checkpointed(listed.repartition(2 * spark.sparkContext.defaultParallelism, "qid").mapInPandas(run, f"qid {kinds['qid']}, id long, score double"))
    sent.unpersist()
    return rows


def pagerank_many(nodes: DataFrame, relations: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 20, keep: int = 25) -> DataFrame:
    """``(qid, id, score)``: walks for many questions at once, exact. The seeds of a question have a row, and so have the
    nodes that may be among the first ``keep`` of the others; the rest score no more than these. What flows to an id that
    is no node is lost.

    The work is that of a walk over the whole graph for each question, but what is kept follows the questions only. Graphs
    of more than 8 million edges and nodes are walked by rows, which may be as many as questions times nodes.
    """
    edges = graph.undirected(relations)
    total = edges.groupBy("node").agg(F.sum("weight").alias("total"))
    step = checkpointed(edges.join(total, "node").where("total > 0").select("node", "other", (F.col("weight") / F.col("total")).alias("p")))
    mass = seeds.groupBy("qid").agg(F.sum("weight").alias("mass"))
    jump = checkpointed(seeds.join(mass, "qid").select("qid", "id", (F.col("weight") / F.col("mass")).alias("jump")))
    linked = step.select(F.col("node").alias("id")).distinct()
    if step.count() + nodes.count() <= _HELD:
        return _walks_held(nodes.sparkSession, step, linked, nodes, jump, damping, iterations, keep)
    return _walks_by_rows(step, linked, nodes, jump, damping, iterations, keep)


def entity_texts(entities: DataFrame) -> DataFrame:
    """``(id, text, shown)``: what names an entity in a search: its name and aliases, if the table has them."""
    text = F.coalesce("search_text", "name") if "search_text" in entities.columns else F.col("name")
    return entities.select("id", text.alias("text"), F.lit(True).alias("shown"))


def local_search(tables: dict[str, DataFrame], questions: DataFrame, seed_limit: int = 12, top: int = 25, chunk_limit: int = 12, per_entity: int = 2, budget: int = 6000, iterations: int = 20) -> dict[str, DataFrame]:
    """Evidence for questions ``(qid, question)``: ranked ``entities``, ``relations`` among them, ``chunks``, ``communities``
    and ``outcomes``, where a question that no entity answers to is NO_SEED. Tables: sources, chunks, entities, mentions,
    relations, and summaries if there are any.

    Chunks that the words find come first with their score; then the chunks of the ranked entities, cut at a token budget
    before those already there are left out.
    """
    chunk_limit = min(max(chunk_limit, 3), 50)
    entities, mentions, relations = (graph.once(tables[t]) for t in ("entities", "mentions", "relations"))
    texts = graph.searchable_texts(tables["chunks"], tables["sources"])
    shown = checkpointed(texts.where("shown").select("id"))
    chunk_hits = checkpointed(lexical.bm25(texts, questions, max(8, chunk_limit)))
    entity_hits = lexical.bm25(entity_texts(entities), questions, seed_limit)
    seeds = checkpointed(build_seeds(entity_hits, chunk_hits.where("rank <= 8"), mentions, seed_limit))
    ranked = checkpointed(fuse(pagerank_many(entities, relations, seeds, iterations=iterations, keep=top), seeds, top))
    among = graph.relations_among(relations, ranked, 40)
    near = ranked.select("qid", F.col("id").alias("entity_id"), "rank").join(graph.chunks_for_entities(mentions, shown, per_entity), "entity_id")
    first = checkpointed(near.groupBy("qid", "chunk_id").agg(F.min(F.struct("rank", "position")).alias("at")))
    told = with_keys(tables["chunks"].select("id", "source_id", "text").where("text IS NOT NULL"), "id", first.select("chunk_id"))
    told = told.groupBy("id").agg(F.max(F.struct("source_id", "text"))["text"].alias("text"))  # as texts has them, but of these only
    costed = first.join(told.select(F.col("id").alias("chunk_id"), estimate_tokens(F.col("text")).alias("cost")), "chunk_id")
    cut = within_budget(costed, "qid", [F.col("at"), F.col("chunk_id")], "cost", budget).select("qid", F.col("chunk_id").alias("id"), "at")
    found = chunk_hits.where(F.col("rank") <= chunk_limit).select("qid", "id", "score", F.lit(0).alias("stage"), F.struct("rank", F.lit(0).alias("position")).alias("at"))
    more = cut.join(found.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(None).cast("double").alias("score"), F.lit(1).alias("stage"), "at")
    both = found.unionByName(more).join(seeds.select("qid").distinct(), "qid", "left_semi")
    both = both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("stage", "at", "id"))).where(F.col("rank") <= chunk_limit)
    counted = seeds.groupBy("qid").agg(F.count("*").alias("seeds"))
    outcomes = questions.select("qid").join(counted, "qid", "left").select("qid", F.when(F.col("seeds") > 0, "ok").otherwise("NO_SEED").alias("outcome"))
    out = {"entities": ranked, "relations": among, "chunks": both.select("qid", "id", "score", "rank"), "seeds": seeds, "outcomes": outcomes}
    if "summaries" in tables:
        met = ranked.join(entities.select("id", "community_id"), "id").groupBy("qid", "community_id").agg(F.min("rank").alias("at")).join(tables["summaries"], "community_id")
        out["communities"] = met.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("at"))).where("n <= 3")
    return out


def coverage_of(tables: dict[str, DataFrame]) -> str:
    """How much the graph covers, in words."""
    n = {t: tables[t].select("id").distinct().count() for t in ("sources", "entities", "relations")}
    return f"{n['sources']} files / {n['entities']} entities / {n['relations']} relations"


#: What stands for the place of an entity without evidence, and the note beside a summary.
NO_PLACE, NO_LINES, SUMMARY_NOTE = "(无原文)", "-", "LLM 生成摘要，引用需回到 chunks"


def places(entities: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(entity_id, chunk_id, path, lines)``: where each entity ``(entity_id)`` is first mentioned in a shown chunk."""
    names = tables["sources"].select(F.col("id").alias("source_id"), F.col("path").alias("source_path"), "state").distinct()
    shown = graph.shown_chunks(tables["chunks"].select("id", "source_id", "start_line", "end_line").distinct(), tables["sources"])
    wanted = entities.select("entity_id").distinct()
    met = graph.once(tables["mentions"]).select("id", "chunk_id", "entity_id").join(wanted, "entity_id", "left_semi")
    first = graph.first_evidence(met, shown).join(shown.withColumnRenamed("id", "chunk_id"), "chunk_id").join(names, "source_id", "left")
    rows = wanted.join(first, "entity_id", "left")
    return rows.select("entity_id", "chunk_id", F.coalesce("source_path", F.lit(NO_PLACE)).alias("path"), F.coalesce(F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")), F.lit(NO_LINES)).alias("_lines"), F.col("chunk_id").isNotNull().alias("_here")).select(
        "entity_id", "chunk_id", "path", F.when(F.col("_here"), F.col("_lines")).otherwise(NO_LINES).alias("lines")
    )


def with_evidence(edges: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Edges ``(qid, relation_id, ..)`` with the names of their ends, type and weight, and the place of their source."""
    relations = graph.once(tables["relations"]).select(F.col("id").alias("relation_id"), "src_id", "dst_id", F.col("type").alias("r"), F.col("weight").alias("w"))
    names = graph.once(tables["entities"]).select("id", "name")
    rows = edges.join(relations, "relation_id").join(names.toDF("src_id", "s"), "src_id").join(names.toDF("dst_id", "o"), "dst_id")
    return rows.join(places(rows.select(F.col("src_id").alias("entity_id")), tables).withColumnRenamed("entity_id", "src_id"), "src_id").drop("chunk_id")


def evidence_chunks(picked: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Chunks ``(qid, id, rank, ..)`` with their path, lines and text as evidence shows them."""
    rows = tables["chunks"].select("id", "source_id", "start_line", "end_line", "text").where("text IS NOT NULL")
    rows = once_per_key(with_keys(rows, "id", picked.select("id")), "id")
    names = tables["sources"].select(F.col("id").alias("source_id"), F.col("path").alias("path")).distinct()
    lines = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return picked.join(rows, "id").join(names, "source_id", "left").select(*picked.columns, "path", lines.alias("lines"), shown_text(F.col("text")).alias("text"))


def evidence_pack(tables: dict[str, DataFrame], found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a reader gets: entities, relations and chunks of a search with names, places and texts, community summaries with
    the note that they are second-hand, and ``outcomes`` with the number of seeds and how much the graph covers."""
    known = graph.once(tables["entities"])
    about = known.select("id", "name", "type", "description", *(["community_id"] if "community_id" in known.columns else []))
    pack = {"entities": found["entities"].drop("community_id").join(about, "id"), "chunks": evidence_chunks(found["chunks"].withColumnRenamed("chunk_id", "id") if "chunk_id" in found["chunks"].columns else found["chunks"], tables)}
    if "relations" in found:
        pack["relations"] = with_evidence(found["relations"], tables)
    if "communities" in found:
        told = found["communities"]
        told = told if "summary" in told.columns else told.join(tables["summaries"].select("community_id", "summary", "top"), "community_id")
        pack["communities"] = told.withColumn("note", F.lit(SUMMARY_NOTE))
    if "outcomes" in found:
        counts = found["seeds"].groupBy("qid").agg(F.count("*").alias("seed_hits"))
        pack["outcomes"] = found["outcomes"].join(counts, "qid", "left").na.fill(0, ["seed_hits"]).withColumn("coverage", F.lit(coverage_of(tables)))
    return pack


def rank_summaries(summaries: DataFrame, questions: DataFrame, top: int = 5, fold: bool = False) -> DataFrame:
    """``(qid, community_id, score, rank)``: communities by how many terms of a question their summary contains; all of
    them if there are at most eight. ``fold`` also lower-cases terms of mixed scripts, which are kept as written otherwise."""
    asked = lexical.question_terms(questions)
    matching = asked.withColumn("term", F.lower("term")).distinct() if fold else asked.where(F.col("term") == F.lower("term"))
    hits = lexical.term_hits(summaries.select(F.col("community_id").alias("id"), F.col("summary").alias("text")), matching)
    scored = matching.join(hits, "term").groupBy("qid", F.col("id").alias("community_id")).agg(F.count("*").cast("int").alias("score"))
    first = [r[0] for r in summaries.select("community_id").distinct().orderBy("community_id").limit(max(top, 8) + 1).collect()]
    few = len(first) <= 8  # else the first ids are enough to fill up with, whichever communities were found
    fill = asked.select("qid").distinct().select("qid", F.explode(F.array(*map(F.lit, first)).cast("array<long>")).alias("community_id"), F.lit(0).alias("score"))
    scored = scored.unionByName(fill).groupBy("qid", "community_id").agg(F.max("score").alias("score"))
    scored = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "community_id")))
    return scored if few else scored.where(F.col("rank") <= top)


def score_summaries(summaries: list[str], question: str, terms: list[str], scorer: Callable[[str, list[str]], list[float]], batch: int = 10) -> list[float]:
    """Scores of the summaries of one question by a model, ten at a time, each held between 0 and 10. A batch whose answer
    fails or doesn't fit is scored by the terms it contains."""
    out: list[float] = []
    for at in range(0, len(summaries), batch):
        part = summaries[at : at + batch]
        try:
            got = [min(10.0, max(0.0, float(x))) for x in scorer(question, part)]
        except Exception:  # noqa: BLE001 - a search must not fail with its scorer
            got = []
        out += got if len(got) == len(part) else [float(sum(t in s.lower() for t in terms)) for s in part]
    return out


def rank_summaries_by_model(summaries: DataFrame, questions: DataFrame, scorer: Callable[[str, list[str]], list[float]], top: int = 5) -> DataFrame:
    """``(qid, community_id, score, rank)`` by a model; with eight summaries or fewer all are taken without asking it.

    Communities are scored in groups of ten where they are, so their number isn't bounded by the driver."""
    import pandas as pd

    if summaries.limit(9).count() <= 8:
        return rank_summaries(summaries, questions, top)
    asked = [(r.qid, r.question, list(r.terms)) for r in questions.select("qid", "question", extract_terms(F.col("question")).alias("terms")).toLocalIterator()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for qid, question, terms in asked:
                scores = score_summaries([s or "" for s in pdf["summary"]], question, terms, scorer)
                rows += [(qid, c, s) for c, s in zip(pdf["community_id"], scores)]
            yield pd.DataFrame(rows, columns=["qid", "community_id", "score"])

    scored = summaries.select("community_id", "summary").mapInPandas(run, "qid long, community_id long, score double")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "community_id"))).where(F.col("rank") <= top)


def global_search(tables: dict[str, DataFrame], summaries: DataFrame, questions: DataFrame, top: int = 5, members: int = 12, budget: int = 6000, scorer: Callable[[str, list[str]], list[float]] | None = None) -> dict[str, DataFrame]:
    """Evidence for broad questions: the best communities, up to twelve of their members, a chunk of each within a budget.
    A model may score the communities; where it fails their terms do. Without any summary it is NOT_INDEXED."""
    if summaries.isEmpty():
        raise EngineError("NOT_INDEXED", "no summaries")
    picked = rank_summaries(summaries, questions, top) if scorer is None else rank_summaries_by_model(summaries, questions, scorer, top)
    picked = checkpointed(picked)
    entities, mentions = graph.once(tables["entities"]), graph.once(tables["mentions"])
    inside = entities_by_community(entities, members)
    people = picked.select("qid", "community_id", F.col("rank").alias("community_rank")).join(inside, "community_id")
    shown = graph.searchable_texts(tables["chunks"], tables["sources"]).where("shown").select("id", "text")
    proof = checkpointed(people.join(graph.first_evidence(mentions, shown), F.col("id") == F.col("entity_id")))
    costs = with_keys(shown, "id", proof.select("chunk_id")).select(F.col("id").alias("chunk_id"), estimate_tokens(F.col("text")).alias("cost"))
    proof = proof.join(costs, "chunk_id")
    chunks = within_budget(proof, "qid", [F.col("community_rank"), F.col("rank"), F.col("chunk_id")], "cost", budget)
    return {"communities": picked, "entities": people, "chunks": chunks.select("qid", "chunk_id", "community_rank", "rank")}


def entities_by_community(entities: DataFrame, limit: int = 50) -> DataFrame:
    """``(community_id, id, rank)``: the members of highest degree."""
    order = W.partitionBy("community_id").orderBy(F.desc("degree"), "id")
    return entities.where("community_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("community_id", "id", "rank")


def resolve_seeds(entities: DataFrame, questions: DataFrame) -> DataFrame:
    """``(qid, id, outcome, candidates)``: the entity that a question spells, else the only one that its words find. Several
    are ``ambiguous`` (id null, their names in ``candidates``), none is NO_SEED."""
    exact = questions.select("qid", norm_name(F.col("question")).alias("norm_name")).join(entities.select("id", "norm_name"), "norm_name").groupBy("qid").agg(F.min("id").alias("exact"))
    hits = lexical.bm25(entity_texts(entities), questions, 5).join(entities.select("id", "name"), "id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])  # five at most
    hits = hits.groupBy("qid").agg(F.count("*").alias("n"), F.min("id").alias("fuzzy"), names.alias("names"))
    rows = questions.select("qid").join(exact, "qid", "left").join(hits, "qid", "left")
    outcome = F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "ok").when(F.col("n") > 1, "ambiguous").otherwise("NO_SEED")
    rows = rows.withColumn("outcome", outcome)
    candidates = F.when(F.col("outcome") == "ambiguous", F.col("names")).otherwise(F.array().cast("array<string>"))
    return rows.select("qid", F.coalesce("exact", F.when(F.col("n") == 1, F.col("fuzzy"))).alias("id"), "outcome", candidates.alias("candidates"))


def traversal_search(tables: dict[str, DataFrame], questions: DataFrame, hops: int = 2, direction: str = "both", types: list[str] | None = None, budget: int = 200) -> dict[str, DataFrame]:
    """The graph around the entity that each question names, at most ten hops and 500 nodes."""
    entities, relations = graph.once(tables["entities"]), graph.once(tables["relations"])
    seeds = checkpointed(resolve_seeds(entities, questions))
    nodes, edges, flags = graph.traverse(relations, seeds.where("outcome = 'ok'").select("qid", "id"), min(max(hops, 1), 10), direction, types, min(budget, 500))
    return {"seeds": seeds, "nodes": nodes, "edges": edges, "flags": flags}
