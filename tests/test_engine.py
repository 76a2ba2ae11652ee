import json
import re

import pytest
from conftest import rows

from sparkweft.api import GraphEngine
from sparkweft.functions.vocabulary import EngineError
from sparkweft.sources.store import Registry, numbered
from sparkweft.streaming.ingest import chunk_stream

NAMES = ["Alpha Core", "Beta Store", "Gamma Index", "Delta Queue"]


def reader(text, path):
    """Entities are the names found in the text; each uses the next one."""
    if "broken" in text:
        return "no json here"
    found = sorted((n for n in NAMES if n.lower() in text.lower()), key=lambda n: text.lower().find(n.lower()))
    entities = [{"n": n, "t": "module", "d": None, "c": 0.9} for n in found]
    return json.dumps({"entities": entities, "relations": [{"s": a, "r": "uses", "o": b, "d": None, "c": 0.8} for a, b in zip(found, found[1:])]})


def test_from_folder_to_answers_and_back(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("# One\nAlpha Core reads Beta Store.\n\nBeta Store again.")
    (root / "b.md").write_text("Beta Store feeds Gamma Index.")
    (root / "c.md").write_text("this one is broken")
    engine = GraphEngine(spark, str(tmp_path / "base"), reader)
    with pytest.raises(EngineError):
        engine.query(["x"])
    kb = engine.create_kb("My Base", [str(root)])
    assert engine.estimate() == {"files": 3, "calls": 4}
    assert engine.index("my base") == {"added": 3}
    assert tuple(engine.status().first()) == (2, 1, 1, 0, 0)
    entities, relations = engine.graph_all()
    assert [r.name for r in entities.orderBy("id").collect()] == ["Alpha Core", "Beta Store", "Gamma Index"]
    assert rows(relations.select("src_id", "dst_id", "type", "weight")) == [(1, 2, "uses", 1), (2, 3, "uses", 1)]
    found = engine.query(["where is alpha"], iterations=3)
    assert found["entities"].orderBy("rank").first().id == 1 and found["chunks"].count() >= 1
    walk = engine.traverse(["Alpha Core"], hops=2)
    assert {r.id for r in walk["nodes"].collect()} == {1, 2, 3}
    assert engine.query(["beta"], mode="global")["communities"].count() == 1
    path = str(root.resolve() / "a.md")
    assert engine.evidence_text(path, "1-2").startswith("# One")
    wrong = relations.where("src_id = 2").first().id
    assert engine.review(wrong, "wrong") and engine.health().first().excluded_relations == 1

    (root / "b.md").write_text("Beta Store feeds Delta Queue.")
    (root / "c.md").unlink()
    assert engine.changes().count() == 2
    assert engine.index() == {"changed": 1, "removed": 1}
    assert {r.name for r in engine.graph_all()[0].collect()} == {"Alpha Core", "Beta Store", "Delta Queue"}
    assert engine.forget(paths=[path])["entities"] == 1
    engine.set_enabled([str(root.resolve() / "b.md")], False)
    assert [r.state for r in engine.list_knowledge().select("state").collect()] == ["merged"]
    assert engine.status().first().stale == 1
    assert engine.add_text(None, "A Note", "Alpha Core note").endswith("a-note.md")
    assert engine.correct_from_selection("Alpha Core and Beta Store") == [("Alpha Core", "uses", "Beta Store")]
    engine.delete_kb(kb.id)
    assert engine.list_kbs() == []


def test_registry_rules(tmp_path):
    r = Registry(str(tmp_path))
    a = r.create("Base A", [str(tmp_path)])
    with pytest.raises(EngineError, match="KB_EXISTS"):
        r.create("base-a", [])
    b = r.create("知识", [])
    assert re.match("kb-", b.id) and r.resolve("base a").id == a.id and r.resolve(None, str(tmp_path)).id == a.id
    with pytest.raises(EngineError, match="KB_AMBIGUOUS"):
        r.resolve()
    r.delete(a.id)
    assert r.resolve().id == b.id


def test_numbers_follow_the_order(spark):
    got = numbered(spark.range(500).selectExpr("999 - id AS x").repartition(5), ["x"])
    assert {r.id - r.x for r in got.collect()} == {1 - 500}


def test_files_are_streamed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("one\n\ntwo")
    for n, extra in enumerate((None, "b.md")):
        if extra:
            (folder / extra).write_text("three")
        chunk_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == n + 1


def indexed(spark, tmp_path, texts, **how):
    root = tmp_path / "docs"
    root.mkdir()
    for name, text in texts.items():
        (root / name).write_text(text)
    engine = GraphEngine(spark, str(tmp_path / "base"), reader, **how)
    engine.create_kb("kb", [str(root)])
    return engine, root


def names(engine):
    return {r.name for r in engine.graph_all()[0].collect()}


def test_corrections_and_forgotten_entities_outlive_a_run(spark, tmp_path):
    engine, root = indexed(spark, tmp_path, {"a.md": "Alpha Core reads Beta Store.", "b.md": "Beta Store feeds Gamma Index."})
    engine.index()
    first = engine.graph_all()[1].where("src_id = 1").first()
    assert engine.review(first.id, "wrong") == {"excluded": True, "corrected": False}
    assert engine.review(first.id, "correct", correction={"o": "New Gate", "r": "calls", "s": " "}) == {"excluded": False, "corrected": True}
    assert "New Gate" in names(engine)
    related = lambda: {(r.type, r.confidence) for r in engine.graph_all()[1].where(f"relation_key = '{first.relation_key}'").collect()}
    assert related() == {("calls", 1.0)} and engine.health().first().corrected == 1
    fixed = engine.graph_all()[1].where("type = 'calls'").first()
    assert engine.review(fixed.id, "correct", correction={"o": "new-gate", "r": "calls"}) == {"excluded": False, "corrected": False}  # nothing changes
    sample = engine.sample_for_review(5)
    assert {r.o for r in sample["relations"].collect()} == {"New Gate", "Gamma Index"} and sample["evidence"].where("text LIKE 'Alpha%'").count() == 1
    assert engine.forget_entity("gamma index")["entities"] == 1 and "Gamma Index" not in names(engine)
    (root / "a.md").write_text("Alpha Core reads Beta Store. Changed.")
    engine.index()
    assert related() == {("calls", 1.0)} and names(engine) == {"Alpha Core", "Beta Store", "New Gate"}
    (root / "b.md").write_text("Beta Store feeds Gamma Index once more.")
    engine.index()
    assert "Gamma Index" in names(engine)
    cards = engine.browse("beta")
    assert [r.name for r in cards["entities"].collect()] == ["Beta Store"]
    assert ("out", "Gamma Index", "2-2") not in {(r.dir, r.other_name, r.lines) for r in cards["neighbors"].collect()} and ("out", "Gamma Index", "1-1") in {(r.dir, r.other_name, r.lines) for r in cards["neighbors"].collect()}


def test_quarantine_runs_and_what_was_read_before_a_commit(spark, tmp_path):
    seen = []
    engine, root = indexed(spark, tmp_path, {"a.md": "Alpha Core reads Beta Store.", "c.md": "this one is broken"})
    engine.index(on_progress=lambda phase, files: seen.append((phase, files)))
    assert [p for p, _ in seen] == ["scanning", "reading", "extracting", "deriving", "done"] and seen[-1] == ("done", 2)
    bad = engine.quarantine().collect()
    assert [(r.error_code, r.raw_input, r.raw_output) for r in bad] == [("PARSE_FAILED", "this one is broken", "no json here")]
    _, store = engine._open(None)
    row = spark.createDataFrame([("x", None, None, "running", "reading", 1, 0, 0, 0)], store.read("runs").schema)
    store.commit(runs=store.read("runs").unionByName(row))
    before = engine.query(["alpha"], iterations=2)
    entities = engine.graph_all()[0]
    engine.resolve_quarantined([bad[0].id])
    assert engine.quarantine().count() == 0 and engine.quarantine(resolved=True).count() == 1
    (root / "c.md").write_text("Gamma Index is fine")
    engine.index()
    assert {r.status for r in engine.progress().collect()} == {"done", "aborted"}
    assert engine.quarantine().count() == 0 and entities.count() == 2 and before["pack"]["chunks"].count() == 1
    assert engine.progress().where("status = 'done' AND calls > 0 AND tokens_in > 0").count() == 2
    with pytest.raises(EngineError, match="NO_SEED"):
        engine.query(["xyzzy"])
    with pytest.raises(EngineError, match="NO_SEED"):
        engine.traverse(["xyzzy"])
    with pytest.raises(EngineError, match="INVALID"):
        engine.query(["alpha"], mode="sideways")


def test_few_changes_keep_communities_and_their_summaries(spark, tmp_path):
    told = []

    def summarize(members, edges):
        return f"about {len(members)} and {len(edges)}"

    engine, root = indexed(spark, tmp_path, {f"{n}.md": "Alpha Core reads Beta Store." for n in "abc"}, summarizer=summarize, recompute_share=1.0)
    engine.index()
    summary = engine.community_list().first().summary
    assert summary == "about 2 and 1" and told == []
    (root / "d.md").write_text("Gamma Index alone")
    engine.index()  # no relation changed
    assert engine.graph_all()[0].where("name = 'Gamma Index'").first().community_id is None
    assert engine.community_list().collect()[0].summary == summary
    engine.recompute_share = 0.0
    (root / "e.md").write_text("Gamma Index feeds Delta Queue")
    engine.index()
    assert engine.graph_all()[0].where("community_id IS NULL").count() == 0 and engine.community_list().count() == 2


def test_settings_are_held_and_the_base_may_be_anywhere(spark, tmp_path):
    engine = GraphEngine(spark, f"file://{tmp_path}/far", reader, least_confidence=7, recompute_share=-1, repairs=9, retries=9, delay=99, files_dir=str(tmp_path / "near"))
    assert (engine.least, engine.recompute_share, engine.repairs, engine.retries, engine.delay) == (1.0, 0.0, 2, 5, 30.0)
    kb = engine.create_kb("kb", [])
    assert engine.add_text(None, "T", "text") and (tmp_path / "far" / "kbs.json").exists() and (tmp_path / "near" / "kbs" / kb.id / "notes").exists()
    with pytest.raises(EngineError, match="INVALID"):
        GraphEngine(spark, "hdfs://h/base", reader)
