import math
from collections import Counter

from conftest import rows

from sparkweft.llm import distinctive, provenance

HAND = "\n".join(f"  const a{n} = f{n % 7}({'x' * (n % 9)}, {n})\n  if (b{n}) return c.{'d' * (n % 5 + 1)}()\n  // why {n}\n  for (const e of g{n}) {{ h() }}" for n in range(12))
GENERATED = "\n".join(f"export function encode{n}(m: T{n}, w: W) {{ w.u32({n}).f(m.x{n}) }}" for n in range(14))
DATA = "const t = [\n" + "\n".join("  " + ", ".join(str(n * k) for k in range(14)) + "," for n in range(12)) + "\n]"
MINIFIED = ";".join(f"var a{n}=b.c{n},d=a{n}?{n}:e[{n}]" for n in range(60))


def test_headers():
    for text in ("// Code generated by x. DO NOT EDIT.\nx", "# @generated from a", "/** AUTOGENERATED b (c) */", "// <auto-generated>", "# 此文件由 x 工具自动生成，请勿手工修改", "-- Automatisch erzeugt aus a.xml", "\n\n// machine-made by x2y, run `make`", "# Generated by the x compiler from y.proto -- changes will be lost", "# This file is automatically @generated by Cargo.", "// produced by protobuf-gen, edits are overwritten", "/* This header was exported from x.idl. Never touch it */"):
        assert provenance.header_says(text) == "generated", text
    for text in ("# Vendored from x 1.2", "// Copied verbatim from a/b 2.1", "# third-party code, see LICENSE", "-- taken unchanged from x", "// This is an unmodified copy of a/b.ts", "/*! x.js v1 | (c) the X authors | MIT */", "/**\n * @license X\n * Copyright (c) 2019 X contributors\n */"):
        assert provenance.header_says(text) == "vendored", text
    for text in ("export const B = '// Code generated by x. DO NOT EDIT.'", '// the emitter puts "DO NOT EDIT" above X, this file itself is written by hand', "// rewritten from scratch, not vendored; replaces the copy of x", "// helpers for the generated x: reads @generated marks and skips them", "// rebuilds the cache", "// This pivot is written by the scheduler", "# Written by A. Author, 2019", "# ported from memory, no upstream known", "// lists the @generated files of a tree", '# says "do not edit" and means it', "", "x\n" * 30 + "// Code generated by x. DO NOT EDIT."):
        assert provenance.header_says(text) == "", text


def test_headers_of_prose_and_below_long_comments():
    licence = [f"clause {n} of the terms" for n in range(30)]
    for text in ("# " + "\n# ".join(licence) + "\n#\n# Code generated by x. DO NOT EDIT.\nx = 1", "/*\n" + "\n".join(licence) + "\nCode generated by x. DO NOT EDIT.\n*/\nx"):
        assert provenance.header_says(text) == "generated", text
    assert provenance.header_says("/* a */\n" + "x = 1\n" * 12 + "// Code generated by x. DO NOT EDIT.") == ""
    assert provenance.header_says("<!-- Generated by x, do not edit -->\n# API", prose=True) == "generated"
    assert provenance.header_says("# Generated by hand or by tools\n* auto-generated files", prose=True) == ""
    lines = "\n".join("f(" + "a, " * 150 + end for end in ("b)", "[b]", "{b}", "b;", "b!"))
    assert provenance.line_facts(lines)[4] == 2


def test_origin_of_prose_by_its_head_comment(spark):
    texts = [("docs/a.html", "<!doctype html>\n<!-- Code generated by x. DO NOT EDIT. -->\n<p>a</p>"), ("docs/b.md", "# Generated by a tool?\ntext"), ("requirements.txt", "# autogenerated by x\na==1"), ("docs/c.md", "<!-- Vendored from x 1.2 -->\ntext")]
    sources = spark.createDataFrame([(n, p, f"/srv/{p}") for n, (p, _) in enumerate(texts)], "id long, path string, abs_path string")
    chunks = spark.createDataFrame([(n, n, p, 0, t) for n, (p, t) in enumerate(texts)], "id long, source_id long, path string, ordinal int, text string")
    got = {r.path: r.origin for r in provenance.file_origins(sources, chunks).collect()}
    assert got == {"docs/a.html": "generated", "docs/b.md": "hand-written", "requirements.txt": "generated", "docs/c.md": "vendored"}


def test_origins(spark):
    files = [("src/a.ts", HAND), ("src/b.ts", GENERATED), ("src/c.ts", DATA), ("web/d.js", MINIFIED), ("vendor/e.ts", HAND), ("src/vendor-portal/f.ts", HAND), ("gen/g.java", None), ("package-lock.json", ""), ("scripts/gen-h.ts", HAND), ("src/minify-i.js", HAND), ("docs/j.md", GENERATED), ("dist/k.js", MINIFIED), ("src/l.ts", "// Vendored from x 1\n" + HAND), ("src/m.ts", None)]
    sources = spark.createDataFrame([(n, p, f"/srv/kb/r1/{p}", "x") for n, (p, _) in enumerate(files)] + [(0, "src/a.ts", "/srv/kb/r1/src/a.ts", "x"), (99, None, None, "x")], "id long, path string, abs_path string, origin string")
    chunks = spark.createDataFrame([(n, n, p, 0, t) for n, (p, t) in enumerate(files)] + [(0, 0, "src/a.ts", 0, HAND), (500, None, None, 0, HAND), (501, 1, None, 1, GENERATED)], "id long, source_id long, path string, ordinal int, text string")
    got = {r.path: r.origin for r in provenance.file_origins(sources, chunks).collect()}
    assert got == {"src/a.ts": "hand-written", "src/b.ts": "generated", "src/c.ts": "data", "web/d.js": "minified", "vendor/e.ts": "vendored", "src/vendor-portal/f.ts": "hand-written", "gen/g.java": "generated", "package-lock.json": "generated", "scripts/gen-h.ts": "hand-written", "src/minify-i.js": "hand-written", "docs/j.md": "hand-written", "dist/k.js": "minified", "src/l.ts": "vendored", "src/m.ts": "hand-written"}
    assert provenance.file_origins(sources.limit(0), chunks.limit(0)).count() == 0


def test_copies_across_repositories_are_vendored(spark):
    own = [HAND.replace("const", f"let own{n}").replace("return", f"throw z{n}").replace("for", f"while{n}") for n in range(3)]
    files = [(n, f"src/x{n}.ts", f"/srv/kb/r{n}/src/x{n}.ts", HAND + f"\n  local{n}()") for n in range(6)] + [(10 + n, f"src/y{n}.ts", f"/srv/kb/r{n}/src/y{n}.ts", own[n]) for n in range(3)]
    sources = spark.createDataFrame([f[:3] for f in files], "id long, path string, abs_path string")
    chunks = spark.createDataFrame([(i, i, p, 0, t) for i, p, _, t in files], "id long, source_id long, path string, ordinal int, text string")
    got = {r.path: r.origin for r in provenance.file_origins(sources, chunks).collect()}
    assert {p for p, o in got.items() if o == "vendored"} == {f"src/x{n}.ts" for n in range(6)}
    assert "vendored" not in {r.origin for r in provenance.file_origins(sources, chunks, repositories=7).collect()}
    assert {r.path for r in provenance.file_origins(sources, chunks, markers=False).where("origin = 'vendored'").collect()} == {f"src/x{n}.ts" for n in range(6)}


def test_copies_of_prose_and_copies_before_marks(spark):
    words = " ".join(f"word{n * n % 97} is here" for n in range(80))
    files = [(n, f"docs/x{n}.md" if n % 2 else f"gen/x{n}.md", f"/srv/kb/r{n}/") for n in range(4)]
    sources = spark.createDataFrame([(i, p, r + p) for i, p, r in files], "id long, path string, abs_path string")
    chunks = spark.createDataFrame([(i, i, None, 0, words) for i, p, _ in files], "id long, source_id long, path string, ordinal int, text string")
    assert {r.origin for r in provenance.file_origins(sources, chunks).collect()} == {"vendored"}


def test_long_lines_of_prose_without_a_chunk_path(spark):
    sources = spark.createDataFrame([(1, "notes/a.md", "/srv/kb/r1/notes/a.md"), (2, "src/a.js", "/srv/kb/r1/src/a.js")], "id long, path string, abs_path string")
    chunks = spark.createDataFrame([(i, i, None, 0, MINIFIED) for i in (1, 2)], "id long, source_id long, path string, ordinal int, text string")
    assert {r.path: r.origin for r in provenance.file_origins(sources, chunks).collect()} == {"notes/a.md": "hand-written", "src/a.js": "minified"}


def test_a_passage_in_two_chunks_counts_once(spark):
    sources = spark.createDataFrame([(n, f"src/x{n}.ts", f"/srv/kb/r{n}/src/x{n}.ts") for n in range(6)], "id long, path string, abs_path string")
    chunks = spark.createDataFrame([(2 * n + k, n, f"src/x{n}.ts", k, HAND) for n in range(6) for k in range(2)], "id long, source_id long, path string, ordinal int, text string")
    assert {r.origin for r in provenance.file_origins(sources, chunks).collect()} == {"vendored"}


def test_winnowing_meets_shared_runs():
    shared = " ".join(f"tok{n}" for n in range(60))
    a, b = (set(provenance.winnow(f"{x} {shared} {y}").tolist()) for x, y in (("one two three", "end"), ("other", "more of it here")))
    assert len(a & b) >= 4 and len(provenance.winnow("too few tokens")) == 0


def brute_scores(texts):
    counts = {i: Counter(distinctive.terms_of(t)) for i, t in texts.items()}
    df, ctf = Counter(), Counter()
    for c in counts.values():
        df.update(set(c))
        ctf.update(c)
    total, out = ctf.total(), {}
    for i, c in counts.items():
        n = c.total()
        for term, a in c.items():
            table = [(a, ctf[term], n), (ctf[term] - a, ctf[term], total - n), (n - a, total - ctf[term], n), (total - n - ctf[term] + a, total - ctf[term], total - n)]
            ratio = 2 * sum(x * math.log(x * total / (r * k)) for x, r, k in table if x > 0)
            out[i, term] = (a, df[term], ratio if a * total >= ctf[term] * n else -ratio, a * math.log(len(texts) / df[term]))
    return out


def test_scores_like_brute_force(spark):
    texts = {1: "Cache the cache with index", 2: "the index, the graph", 3: "graph graph graph cache", 4: None, 5: "", 6: "an ab", 7: "知识图谱 the"}
    data = [(i, t, "q") for i, t in texts.items()] + [(1, texts[1], "q"), (1, texts[1], "q"), (None, "cache", "q")]
    df = spark.createDataFrame(data, "id long, text string, term string")
    want = brute_scores(texts)
    got = {(r.chunk_id, r.term): (r.tf, r.df, r.score, r.tf_idf) for r in distinctive.term_scores(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
    probe = spark.createDataFrame([(3,), (3,), (4,), (77,)], "chunk_id long")
    assert rows(distinctive.most_typical(distinctive.term_scores(df, probe))) == [(3, "graph")]
    assert distinctive.term_scores(df.limit(0)).count() == 0


def test_ties_go_to_the_alphabet(spark):
    df = spark.createDataFrame([(1, "beta alpha"), (2, "gamma")], "id long, text string")
    assert (1, "alpha") in rows(distinctive.most_typical(distinctive.term_scores(df)))
