"""One façade over the operators: knowledge bases that are indexed from folders, searched, and governed."""

from __future__ import annotations

import re
import shutil
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.functions.text import estimate_tokens, norm_name
from sparkweft.functions.vocabulary import EngineError
from sparkweft.operators import chunking, documents, extraction, governance, graph, lexical, merge, retrieval, scan
from sparkweft.sources.files import SharedFiles
from sparkweft.sources.store import SCHEMAS, KnowledgeBase, Registry, TableStore, now, numbered
from sparkweft.sources.tables import checkpointed, clear_written, with_keys, written, written_so_far

MAX_IMPORT = 50 * 1024 * 1024


def _held(value: float, least: float, most: float) -> float:
    return min(max(value, least), most)


class GraphEngine:
    """Tables and registry lie under ``base_dir`` on any file system of the session; notes and imported files under
    ``files_dir`` (``base_dir`` if unset), which the driver and the executors must have mounted, as the roots are.

    Settings are held within what makes sense: confidence 0.1 to 1, share of changed relations that makes communities be
    worked out anew 0 to 1, repairs 0 to 2, retries 0 to 5, delay 0 to 30 seconds.
    """

    def __init__(
        self, spark: SparkSession, base_dir: str, completer: extraction.Completer | None = None, vision=None, least_confidence: float = 0.6, recompute_share: float = 0.05,
        summarizer: Callable[[list[str], list[str]], str] | None = None, scorer: Callable[[str, list[str]], list[float]] | None = None, repairs: int = 1, retries: int = 3, delay: float = 0.5, files_dir: str | None = None,
    ):
        self.spark, self.base, self.completer, self.vision, self.summarizer, self.scorer = spark, str(base_dir).rstrip("/"), completer, vision, summarizer, scorer
        self.least, self.recompute_share = _held(least_confidence, 0.1, 1.0), _held(recompute_share, 0.0, 1.0)
        self.repairs, self.retries, self.delay = int(_held(repairs, 0, 2)), int(_held(retries, 0, 5)), _held(delay, 0.0, 30.0)
        if files_dir is None and "://" in self.base:
            raise EngineError("INVALID", "a base that isn't mounted needs files_dir for notes and imports")
        self.files_dir = Path(files_dir or self.base)
        self.registry = Registry(self.base, SharedFiles(spark))

    # --- knowledge bases -------------------------------------------------------------------------------------------

    def list_kbs(self) -> list[KnowledgeBase]:
        return self.registry.list()

    def create_kb(self, name: str, roots: list[str], description: str | None = None) -> KnowledgeBase:
        return self.registry.create(name, roots, description)

    def update_kb(self, kb: str, **changes) -> KnowledgeBase:
        return self.registry.update(self.registry.resolve(kb).id, **changes)

    def delete_kb(self, kb: str) -> None:
        base = self.registry.resolve(kb)
        self.registry.delete(base.id)
        shutil.rmtree(self.files_dir / "kbs" / base.id, ignore_errors=True)

    def _store(self, kb: KnowledgeBase) -> TableStore:
        return TableStore(self.spark, f"{self.base}/kbs/{kb.id}/tables")

    def _open(self, ref: str | None) -> tuple[KnowledgeBase, TableStore]:
        kb = self.registry.resolve(ref)
        return kb, self._store(kb)

    def _own(self, kb: KnowledgeBase, kind: str) -> Path:
        folder = self.files_dir / "kbs" / kb.id / kind
        folder.mkdir(parents=True, exist_ok=True)
        return folder

    def _roots(self, kb: KnowledgeBase) -> list[str]:
        return [*kb.roots, str(self._own(kb, "notes")), str(self._own(kb, "imports"))]

    # --- what is put in --------------------------------------------------------------------------------------------

    def add_text(self, kb: str | None, title: str, text: str) -> str:
        """A note as a file that the next run indexes."""
        if not text.strip() or len(text) > 50_000:
            raise EngineError("INVALID", "a note has 1 to 50000 characters")
        base, _ = self._open(kb)
        slug = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in title.lower()).split())[:40] or "note"
        path = self._own(base, "notes") / f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{slug}.md"
        path.write_text(text, encoding="utf-8")
        return path.name

    def import_files(self, kb: str | None, paths: list[str]) -> dict[str, str]:
        """Copies of files, renamed where a name is taken; hidden and oversized ones are refused."""
        base, _ = self._open(kb)
        folder, done = self._own(base, "imports"), {}
        for p in map(Path, paths):
            if not p.is_file() or p.name.startswith("."):
                done[str(p)] = "refused"
            elif p.stat().st_size > MAX_IMPORT:
                done[str(p)] = "too-large"
            else:
                to, n = folder / p.name, 1
                while to.exists():
                    to, n = folder / f"{p.stem}-{n}{p.suffix}", n + 1
                shutil.copyfile(p, to)
                done[str(p)] = to.name
        return done

    def import_directory(self, kb: str | None, folder: str) -> dict[str, str]:
        return self.import_files(kb, sorted(str(p) for p in Path(folder).iterdir() if p.is_file()))

    # --- indexing --------------------------------------------------------------------------------------------------

    def _scan(self, kb: KnowledgeBase, store: TableStore, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """What the folders hold, and the sources known of those folders."""
        chosen = roots or self._roots(kb)
        found, _ = scan.scan_roots(self.spark, chosen, self._roots(kb))
        known = store.read("sources").where(scan.under_roots(F.col("abs_path"), [str(Path(r).resolve()) for r in chosen]))
        return found, known

    @staticmethod
    def _keyed(df: DataFrame) -> DataFrame:
        """Rows addressed by root and path, so equal paths under two roots stay apart."""
        return df.withColumn("path", F.col("abs_path"))

    def changes(self, kb: str | None = None) -> DataFrame:
        base, store = self._open(kb)
        found, known = self._scan(base, store)
        return governance.changes_preview(scan.diff_against_index(self._keyed(found), self._keyed(known)))

    def estimate(self, kb: str | None = None) -> dict[str, int]:
        base, store = self._open(kb)
        found, known = self._scan(base, store)
        diff = scan.diff_against_index(self._keyed(found), self._keyed(known)).where("change <> 'removed'").select("path")
        again = self._keyed(known).where("state NOT IN ('merged', 'deleted', 'disabled', 'quarantined')").join(self._keyed(found), "path", "left_semi").select("path")
        return scan.estimate_cost(diff.union(again).distinct().count())

    def index(self, kb: str | None = None, roots: list[str] | None = None, on_progress: Callable[[str, int], None] | None = None) -> dict[str, int]:
        """One run: files that are new, changed or unfinished are chunked and read by the completer, those that are gone
        are forgotten, and the graph is derived from all answers. Only the folders scanned lose files. Runs are logged:
        one that ended without an end, as after a crash, is marked aborted by the next."""
        base, store = self._open(kb)
        if self.completer is None:
            raise EngineError("LLM_UNAVAILABLE", "no completer")
        run, kept = {"id": uuid.uuid4().hex, "started_at": datetime.now(timezone.utc)}, written_so_far()
        earlier = store.read("runs").withColumn("status", F.when(F.col("status") == "running", "aborted").otherwise(F.col("status")))
        earlier = checkpointed(earlier)

        def log(status: str, phase: str, files: int = 0, calls: int = 0, tokens_in: int = 0, tokens_out: int = 0) -> None:
            if on_progress:
                on_progress(phase, files)
            ended = None if status == "running" else datetime.now(timezone.utc)
            row = self.spark.createDataFrame([(run["id"], run["started_at"], ended, status, phase, files, calls, tokens_in, tokens_out)], SCHEMAS["runs"])
            store.commit(runs=earlier.unionByName(row))

        self.spark.sparkContext.setJobGroup(f"index-{base.id}", f"index {base.name}", interruptOnCancel=True)
        try:
            log("running", "scanning")
            changes, cost = self._read_files(base, store, roots, lambda phase, files: log("running", phase, files))
            log("running", "deriving", cost["files"])
            self.derive(base, store, lost_files=changes.get("removed", 0))
        except BaseException:
            log("failed", "failed")
            raise
        log("done", "done", **cost)
        self.registry.update(base.id, last_indexed_at=now())
        clear_written(self.spark, kept)  # everything is in the tables now
        return changes

    def _read_files(self, base: KnowledgeBase, store: TableStore, roots: list[str] | None, log: Callable[[str, int], None]) -> tuple[dict[str, int], dict[str, int]]:
        found, known = self._scan(base, store, roots)
        found = self._keyed(found)
        facts = checkpointed(found.drop("content"))
        old = store.read("sources").withColumn("path", F.col("abs_path"))
        diff = checkpointed(scan.diff_against_index(facts, self._keyed(known)))
        gone = diff.where("change = 'removed'").select("path")
        unfinished = self._keyed(known).where("state NOT IN ('merged', 'deleted', 'disabled')").join(facts.select("path"), "path", "left_semi").select("path")
        dirty = checkpointed(diff.where("change <> 'removed'").select("path").union(unfinished).distinct())
        files = dirty.count()
        log("reading", files)
        texts = checkpointed(documents.text_of_file(found.join(dirty, "path", "left_semi"), self.vision))
        chunks = written(chunking.chunk_documents(texts.where("text IS NOT NULL"), "path"), "chunks")
        log("extracting", files)
        asked = extraction.complete_chunks(chunks.select(F.struct("path", "ordinal").alias("key"), "path", "text").withColumn("id", F.xxhash64("key")), self.completer, self.repairs, self.retries, self.delay)
        keys = chunks.select(F.xxhash64(F.struct("path", "ordinal")).alias("chunk_id"), "path", "ordinal")
        at = F.lit(datetime.now(timezone.utc))
        answers = written(asked.withColumn("part", F.lit(0)).join(keys, "chunk_id").select("path", "ordinal", "part", "raw", "calls", "error", at.alias("read_at")), "answers")
        failed = checkpointed(merge.quarantined(extraction.validate_output(answers, "raw", self.least)))
        bad = failed.select("path").distinct().withColumn("bad", F.lit(True))
        state = texts.select("path", F.col("state").alias("read"), F.col("error").alias("why")).join(bad, "path", "left")
        after = F.when(F.col("read") == "failed", "failed").when(F.col("bad"), "quarantined").otherwise("merged")
        fresh = facts.join(state, "path").select("root", "path", "abs_path", "content_hash", "size_bytes", "mtime_ms", after.alias("state"), F.col("why").alias("error"))
        drop = gone.union(dirty).distinct()
        keep = lambda t: store.read(t).join(drop, "path", "left_anti")
        sources = old.join(drop, "path", "left_anti").select(fresh.columns).unionByName(fresh)
        rows = failed.join(chunks.select("path", "ordinal", F.col("text").alias("raw_input")), ["path", "ordinal"])
        rows = rows.select(F.xxhash64("path", "ordinal", F.lit(uuid.uuid4().hex)).alias("id"), "path", "ordinal", "raw_input", "raw_output", "error_code", "detail", at.alias("created_at"), F.lit(False).alias("resolved"))
        waiting = store.read("quarantine").join(drop.withColumn("_again", F.lit(True)), "path", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_again", F.lit(False)))
        store.commit(
            sources=sources, chunks=keep("chunks").select(chunks.columns).unionByName(chunks), answers=keep("answers").select(answers.columns).unionByName(answers),
            quarantine=waiting.select(rows.columns).unionByName(rows),
        )
        asked_for = chunks.agg(F.sum("token_est").alias("n")).first()["n"] or 0
        spent = answers.agg(F.sum("calls").alias("calls"), F.sum(estimate_tokens(F.coalesce("raw", F.lit("")))).alias("n")).first()
        cost = {"files": files, "calls": int(spent["calls"] or 0), "tokens_in": int(asked_for), "tokens_out": int(spent["n"] or 0)}
        return {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}, cost

    def cancel(self, kb: str | None = None) -> None:
        """Ends a run of another thread; what was committed before it stays."""
        self.spark.sparkContext.cancelJobGroup(f"index-{self.registry.resolve(kb).id}")

    def derive(self, kb: KnowledgeBase, store: TableStore, lost_files: int = 0) -> None:
        """The graph tables from the facts: entities, mentions, relations, evidence, degrees, communities and summaries.

        Entities that were forgotten stay out until a file is read again that names them; corrections of relations are
        applied anew. Communities are worked out anew only if enough relations changed, and only those whose members did
        get a new summary.
        """
        sources = numbered(store.read("sources").distinct(), ["path"])
        of = sources.select("path", F.col("id").alias("source_id"))
        chunks = written(numbered(store.read("chunks").join(of, "path"), ["path", "ordinal"]), "chunks")
        items = extraction.validate_output(store.read("answers"), "raw", self.least)
        items = items.join(chunks.select("path", "ordinal", F.col("id").alias("chunk_id")), ["path", "ordinal"])
        gone = store.read("forgotten").groupBy("norm_name").agg(F.max("at").alias("gone_at"))
        named = items.select("chunk_id", "read_at", F.posexplode("entities").alias("n", "e")).select("chunk_id", "read_at", F.struct("chunk_id", "n").alias("seq"), norm_name(F.col("e.n")).alias("norm_name"), F.col("e.n").alias("name"), F.col("e.t").alias("type"), F.col("e.d").alias("description"))
        named = named.where("norm_name <> ''").join(gone, "norm_name", "left").where("gone_at IS NULL OR read_at > gone_at").drop("gone_at", "read_at")
        named = written(named, "named")
        first = named.groupBy("norm_name").agg(F.min("seq").alias("first"))
        entities = numbered(merge.merge_entities(named).join(first, "norm_name").withColumn("a", F.col("first.chunk_id")).withColumn("b", F.col("first.n")).drop("first"), ["a", "b"]).drop("a", "b")
        keys = entities.select("id", "norm_name")
        said = items.select("chunk_id", F.posexplode("relations").alias("n", "r")).select("chunk_id", F.struct("chunk_id", F.lit(1 << 30).alias("n")).alias("seq"), F.col("n").alias("k"), norm_name(F.col("r.s")).alias("src_norm"), norm_name(F.col("r.o")).alias("dst_norm"), F.col("r.r").alias("type"), F.col("r.d").alias("description"), F.col("r.c").alias("confidence"))
        known = named.groupBy("norm_name").agg(F.min(F.struct("chunk_id", F.lit(0).alias("n"))).alias("seq"))
        facts = merge.resolve_endpoints(said, known).join(keys.toDF("src_id", "src_norm"), "src_norm").join(keys.toDF("dst_id", "dst_norm"), "dst_norm")
        facts = written(facts.withColumn("seq", F.struct("chunk_id", "k")).select("seq", "chunk_id", "src_id", "dst_id", "type", "description", "confidence"), "facts")
        merged = merge.merge_relations(facts)
        names = keys.toDF("e_id", "e_norm")
        merged = merged.join(names.toDF("src_id", "s"), "src_id").join(names.toDF("dst_id", "o"), "dst_id").withColumn("relation_key", F.concat_ws(" ", "s", "type", "o"))
        judged = store.read("reviews").groupBy("relation_key").agg(F.max_by("excluded", "at").alias("excluded"))
        merged = merged.join(judged, "relation_key", "left").withColumn("confidence", F.when(F.col("excluded"), -1.0).otherwise(F.col("confidence")))
        fixes = store.read("corrections").groupBy("relation_key").agg(F.max_by(F.struct("s", "r", "o"), "at").alias("x")).select(F.col("relation_key").alias("id"), "x.s", "x.r", "x.o")
        fixed, entities = governance.correct_relations(merged.withColumn("id", F.col("relation_key")), entities, fixes)
        entities = written(entities.withColumn("search_text", F.coalesce("search_text", "name")), "cards")
        keys = entities.select("id", "norm_name")
        # a correction may bring a relation where another is; they are one then
        same = fixed.groupBy("src_id", "dst_id", "type").agg(
            F.sum("weight").alias("weight"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("relation_key"))).alias("description"), F.max("confidence").alias("confidence"),
            F.min("relation_key").alias("relation_key"),
        )
        relations = numbered(same.select("src_id", "dst_id", "type", "weight", "description", "confidence", "relation_key"), ["src_id", "dst_id", "type"])
        moved = fixed.select("relation_key", "src_id", "dst_id", "type").join(relations.select("src_id", "dst_id", "type", F.col("id").alias("relation_id")), ["src_id", "dst_id", "type"]).select("relation_key", "relation_id")
        seen = facts.select("src_id", "dst_id", "type", "chunk_id").distinct().join(merged.select("src_id", "dst_id", "type", "relation_key"), ["src_id", "dst_id", "type"])
        evidence = seen.join(moved, "relation_key").select("relation_id", "chunk_id").distinct()
        wanted = named.select("chunk_id", "norm_name", "name").distinct().join(keys, "norm_name").select("chunk_id", F.col("id").alias("entity_id"), "name")
        mentions = numbered(extraction.compute_mentions(chunks, wanted), ["chunk_id", "span_start", "entity_id"])
        entities = entities.join(merge.degree_distinct(entities, relations), "id")
        prior = {t: store.read(t) for t in ("entities", "relations", "communities", "summaries")} if store.has("communities") else None
        if prior is not None and self._little_changed(relations, prior["relations"], lost_files):
            known = prior["entities"].select("norm_name", "community_id")
            entities = written(entities.join(known, "norm_name", "left"), "entities")
            return store.commit(graph_sources=sources, graph_chunks=chunks, entities=entities, relations=relations, evidence=evidence, mentions=mentions)
        labels = written(graph.communities(entities, relations), "labels")
        table = graph.community_table(labels)
        ids = table.select("label", F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").alias("community_id"))
        entities = written(entities.join(labels.join(ids, "label").select("id", "community_id"), "id", "left"), "entities")
        table = written(table.join(ids, "label"), "communities")
        fresh = table if prior is None else graph.changed_communities(table, prior["communities"])
        # the id of a community is made of its fingerprint, so one whose members stayed keeps its summary
        inputs = graph.summary_inputs(entities, relations).join(fresh.select("community_id"), "community_id", "left_semi")
        summaries = graph.summary_text(inputs) if self.summarizer is None else graph.summaries_by_model(inputs, self.summarizer)
        if prior is not None:
            stayed = table.join(fresh.select("community_id"), "community_id", "left_anti").select("community_id")
            summaries = prior["summaries"].join(stayed, "community_id", "left_semi").unionByName(summaries)
        store.commit(graph_sources=sources, graph_chunks=chunks, entities=entities, relations=relations, evidence=evidence, mentions=mentions, communities=table, summaries=checkpointed(summaries))

    def _little_changed(self, now_: DataFrame, before: DataFrame, lost_files: int) -> bool:
        """Whether too few relations came or went for communities to be worked out anew; a file less counts as one."""
        edges = ["relation_key", "weight"]
        both = now_.select(*edges, F.lit(1).alias("sign")).unionByName(before.select(*edges, F.lit(-1).alias("sign")))
        differ = both.groupBy(*edges).agg(F.sum("sign").alias("n")).where("n <> 0").select("relation_key").distinct().count()
        total = now_.count()
        return total > 0 and (differ + lost_files) / total < self.recompute_share

    def _graph(self, kb: str | None) -> dict[str, DataFrame]:
        _, store = self._open(kb)
        if not store.has("entities"):
            raise EngineError("NOT_INDEXED", str(kb))
        tables = {t: store.read(t) for t in ("entities", "relations", "evidence", "mentions", "communities", "summaries")}
        return {**tables, "sources": store.read("graph_sources"), "chunks": store.read("graph_chunks")}

    # --- searching -------------------------------------------------------------------------------------------------

    def _questions(self, texts: list[str]) -> DataFrame:
        if not texts or any(not t.strip() or len(t) > 500 for t in texts):
            raise EngineError("INVALID", "a question has 1 to 500 characters")
        return self.spark.createDataFrame(list(enumerate(texts)), "qid long, question string")

    def query(self, texts: list[str], kb: str | None = None, mode: str = "local", budget: int = 6000, top: int | None = None, **how) -> dict[str, DataFrame]:
        """Evidence for questions: ids and ranks, and under ``pack`` what a reader gets. A token budget is held within 1000
        to 12000, the number of entities within 5 to 50. If no question finds a seed it is NO_SEED."""
        tables, asked, budget = self._graph(kb), self._questions(texts), int(_held(budget, 1000, 12000))
        if mode == "global":
            found = retrieval.global_search(tables, tables["summaries"], asked, top=5 if top is None else int(_held(top, 1, 50)), budget=budget, scorer=self.scorer, **how)
        elif mode == "local":
            found = retrieval.local_search(tables, asked, top=25 if top is None else int(_held(top, 5, 50)), budget=budget, **how)
            if found["seeds"].isEmpty():
                raise EngineError("NO_SEED", "; ".join(texts))
        else:
            raise EngineError("INVALID", mode)
        return {**found, "pack": retrieval.evidence_pack(tables, found)}

    def traverse(self, names: list[str], kb: str | None = None, hops: int = 2, budget: int = 200, **how) -> dict[str, DataFrame]:
        """The graph around named entities, at most four hops and 500 nodes; edges come with names and places. If no name
        leads anywhere it is NO_SEED; names that fit several entities are listed with these."""
        tables = self._graph(kb)
        found = retrieval.traversal_search(tables, self._questions(names), hops=int(_held(hops, 1, 4)), budget=int(_held(budget, 1, 500)), **how)
        if found["seeds"].where("outcome <> 'NO_SEED'").isEmpty():
            raise EngineError("NO_SEED", "; ".join(names))
        return {**found, "evidence": retrieval.with_evidence(found["edges"], tables)}

    def browse(self, text: str, kb: str | None = None, limit: int = 20) -> dict[str, DataFrame]:
        """``entities`` by what their names or aliases hold (all by id without a text), and their ``neighbors`` with names,
        types, direction and the place of the first evidence."""
        t = self._graph(kb)
        if not text.strip():
            cards = t["entities"].orderBy("id").limit(limit).select("id", F.row_number().over(W.orderBy("id")).alias("rank"))  # limit rows
        else:
            cards = lexical.entity_cards(t["entities"], self._questions([text]), limit).select("id", "rank")
        cards = checkpointed(cards)
        near = graph.neighbors(t["relations"], cards.select("id"))
        names = t["entities"].select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
        ends = t["relations"].select(F.col("id").alias("relation_id"), "src_id")
        proof = self._evidence(t, near.select("relation_id")).groupBy("relation_id").agg(F.min_by(F.struct("path", "lines"), "chunk_id").alias("x"))
        near = near.join(names, "other").join(ends, "relation_id").join(proof, "relation_id", "left")
        near = near.select("node", F.when(F.col("src_id") == F.col("node"), "out").otherwise("in").alias("dir"), "type", "weight", "other", "other_name", "other_type", "relation_id", "x.path", "x.lines")
        return {"entities": t["entities"].join(cards, "id"), "neighbors": near}

    @staticmethod
    def _evidence(t: dict[str, DataFrame], relations: DataFrame) -> DataFrame:
        """``(relation_id, chunk_id, path, lines)`` of the evidence of relations in shown chunks."""
        shown = graph.shown_chunks(t["chunks"].select("id", "source_id", "start_line", "end_line"), t["sources"]).join(t["sources"].select(F.col("id").alias("source_id"), F.col("path").alias("path")), "source_id")
        lines = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
        proofs = t["evidence"].join(relations.distinct(), "relation_id", "left_semi")
        return proofs.join(shown.select(F.col("id").alias("chunk_id"), "path", lines.alias("lines")), "chunk_id").select("relation_id", "chunk_id", "path", "lines")

    def community_list(self, kb: str | None = None, limit: int = 50) -> DataFrame:
        t = self._graph(kb)
        return governance.community_list(t["entities"], limit).join(t["summaries"].select("community_id", "summary"), "community_id", "left")

    def evidence_text(self, path: str, lines: str, kb: str | None = None) -> str | None:
        m = re.search(r"(\d+)-(\d+)", lines)
        if not m:
            return None
        t = self._graph(kb)
        wanted = self.spark.createDataFrame([(path, int(m[1]), int(m[2]))], "path string, first int, last int")
        hit = governance.evidence_text(t["chunks"], t["sources"], wanted).first()
        return t["chunks"].where(F.col("id") == hit.chunk_id).first().text if hit else None

    def graph_all(self, kb: str | None = None) -> tuple[DataFrame, DataFrame]:
        t = self._graph(kb)
        return t["entities"], t["relations"]

    def expand(self, entity_id: int, kb: str | None = None) -> DataFrame:
        t = self._graph(kb)
        if t["entities"].where(F.col("id") == entity_id).isEmpty():
            raise EngineError("INVALID", str(entity_id))
        return graph.neighbors(t["relations"], self.spark.createDataFrame([(entity_id,)], "id long"))

    # --- governing -------------------------------------------------------------------------------------------------

    def status(self, kb: str | None = None) -> DataFrame:
        _, store = self._open(kb)
        return governance.status(store.read("sources"))

    def list_knowledge(self, kb: str | None = None) -> DataFrame:
        t = self._graph(kb)
        stats = governance.source_stats(t["sources"], t["chunks"], t["mentions"], t["evidence"])
        return t["sources"].select(F.col("id").alias("source_id"), "path", "state", "error").join(stats, "source_id")

    def forget(self, kb: str | None = None, paths: list[str] | None = None) -> dict[str, int]:
        """The facts of the files, or of all, are dropped and the graph is derived anew; returns what there was less."""
        base, store = self._open(kb)
        before = {t: store.read(t).count() for t in ("entities", "relations", "mentions") if store.has(t)}
        gone = None if paths is None else self.spark.createDataFrame([(p,) for p in paths], "path string")
        cut = lambda t: store.read(t).limit(0) if gone is None else store.read(t).join(gone, "path", "left_anti")
        store.commit(**{t: cut(t) for t in ("sources", "chunks", "answers")})
        self.derive(base, store)
        return {t: n - store.read(t).count() for t, n in before.items()}

    def _restate(self, kb: str | None, change) -> None:
        _, store = self._open(kb)
        store.commit(sources=checkpointed(change(store.read("sources"))))

    def set_enabled(self, paths: list[str], enabled: bool, kb: str | None = None) -> None:
        chosen = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._restate(kb, lambda s: governance.set_enabled(s, chosen, enabled))

    def reindex(self, paths: list[str], kb: str | None = None) -> None:
        chosen = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._restate(kb, lambda s: governance.reset_to_pending(s, chosen))

    def retry_quarantined(self, kb: str | None = None) -> None:
        self._restate(kb, lambda s: governance.reset_to_pending(s, s.where("state = 'quarantined'").select("path")))

    def forget_entity(self, name: str, kb: str | None = None) -> dict[str, int]:
        """The entity with its mentions and relations is dropped; it comes back only by files that are read again."""
        base, store = self._open(kb)
        before = {t: store.read(t).count() for t in ("entities", "relations", "mentions") if store.has(t)}
        gone = self.spark.createDataFrame([(name,)], "name string").select(norm_name(F.col("name")).alias("norm_name"), F.lit(datetime.now(timezone.utc)).alias("at"))
        store.commit(forgotten=checkpointed(store.read("forgotten").unionByName(gone)))
        self.derive(base, store)
        return {t: n - store.read(t).count() for t, n in before.items()}

    def quarantine(self, kb: str | None = None, resolved: bool = False) -> DataFrame:
        """What couldn't be read, with the text and the answer; what was resolved since only if asked for."""
        rows = self._open(kb)[1].read("quarantine")
        return rows if resolved else rows.where("NOT resolved")

    def resolve_quarantined(self, ids: list[int], kb: str | None = None) -> None:
        _, store = self._open(kb)
        rows = store.read("quarantine")
        store.commit(quarantine=checkpointed(rows.withColumn("resolved", F.col("resolved") | F.col("id").isin(ids))))

    def sample_for_review(self, limit: int = 20, kb: str | None = None) -> dict[str, DataFrame]:
        """``relations`` to review with the names of their ends, the least certain first, and their ``evidence`` with texts."""
        t = self._graph(kb)
        _, store = self._open(kb)
        last = store.read("reviews").groupBy("relation_key").agg(F.max_by("excluded", "at").alias("excluded")).where("excluded")
        judged = t["relations"].join(last.select("relation_key"), "relation_key", "left_semi")
        sample = checkpointed(governance.review_sample(t["relations"], judged, limit))
        names = t["entities"].select("id", "name")
        rows = sample.join(t["relations"].select("id", "src_id", "dst_id", F.col("type").alias("r")), "id").join(names.toDF("src_id", "s"), "src_id").join(names.toDF("dst_id", "o"), "dst_id")
        proofs = self._evidence(t, sample.select(F.col("id").alias("relation_id")))
        texts = with_keys(t["chunks"].select("id", "text"), "id", proofs.select("chunk_id")).withColumnRenamed("id", "chunk_id")
        return {"relations": rows.select("id", "s", "r", "o", "confidence", "rank"), "evidence": proofs.join(texts, "chunk_id")}

    def review(self, relation_id: int, verdict: str, kb: str | None = None, correction: dict[str, str] | None = None) -> dict[str, bool]:
        """Records a verdict; a wrong relation is excluded, and stays so when its files are read again. A ``correction`` with
        ``s``, ``r`` or ``o`` moves an end or changes the type instead, is taken as confirmed and ends an exclusion."""
        if verdict not in ("correct", "wrong", "unsure"):
            raise EngineError("INVALID", verdict)
        t = self._graph(kb)
        base, store = self._open(kb)
        row = t["relations"].where(F.col("id") == relation_id).first()
        if row is None:
            raise EngineError("INVALID", str(relation_id))
        at = datetime.now(timezone.utc)
        event = lambda verdict, corrected, excluded: self.spark.createDataFrame([(row.relation_key, verdict, corrected, row.confidence, excluded, at)], SCHEMAS["reviews"])
        wanted = {k: v.strip() for k, v in (correction or {}).items() if k in ("s", "r", "o") and v and v.strip()}
        if wanted and self._differs(t, row, wanted):
            last = store.read("corrections").where(F.col("relation_key") == row.relation_key).orderBy(F.desc("at")).first()
            s, r, o = (wanted.get(k) or (last[k] if last else None) for k in ("s", "r", "o"))
            fix = self.spark.createDataFrame([(row.relation_key, s, r, o, at)], SCHEMAS["corrections"])
            store.commit(corrections=checkpointed(store.read("corrections").unionByName(fix)), reviews=checkpointed(store.read("reviews").unionByName(event(verdict, True, False))))
            self.derive(base, store)
            return {"excluded": False, "corrected": True}
        if verdict == "unsure":
            return {"excluded": False, "corrected": False}
        wrong = verdict == "wrong"
        relations = t["relations"].withColumn("confidence", F.when((F.col("id") == relation_id) & F.lit(wrong), -1.0).otherwise(F.col("confidence")))
        store.commit(reviews=checkpointed(store.read("reviews").unionByName(event(verdict, False, wrong))), relations=checkpointed(relations))
        return {"excluded": wrong, "corrected": False}

    def _differs(self, t: dict[str, DataFrame], row, wanted: dict[str, str]) -> bool:
        ends = {r.id: r.norm_name for r in t["entities"].where(F.col("id").isin(row.src_id, row.dst_id)).select("id", "norm_name").collect()}
        keys = self.spark.createDataFrame([(wanted.get("s"), wanted.get("o"))], "s string, o string").select(norm_name(F.col("s")).alias("s"), norm_name(F.col("o")).alias("o")).first()
        return keys.s not in (None, ends.get(row.src_id)) or keys.o not in (None, ends.get(row.dst_id)) or wanted.get("r", row.type) != row.type

    def correct_from_selection(self, text: str) -> list[tuple[str, str, str]]:
        """At most five relations that the completer reads out of a selected text."""
        if self.completer is None:
            raise EngineError("LLM_UNAVAILABLE", "no completer")
        raw = self.spark.createDataFrame([(self.completer(text[:2000], ""),)], "raw string")
        row = extraction.validate_output(raw, "raw", self.least).first()
        return [(r.s, r.r, r.o) for r in row.relations[:5]]

    def health(self, kb: str | None = None) -> DataFrame:
        base, store = self._open(kb)
        t = self._graph(kb)
        return governance.health(store.read("sources"), t["relations"], store.read("reviews"), self._roots(base))

    def progress(self, kb: str | None = None) -> DataFrame:
        _, store = self._open(kb)
        return store.read("runs")
