"""Queries of the core operators, each with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.functions import text, vocabulary
from sparkweft.operators import chunking, extraction, governance, graph, lexical, merge, metrics, retrieval, scan, snapshots
from sparkweft.sources.tables import once_per_key, read_table
from sparkweft.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query(
    "p6_found",
    """
    WITH r AS (
      SELECT snapshot_no, regexp_replace(path, '^(\\./+)+', '') AS path, scanned_at,
             nullif(lower(regexp_replace(content_hash, '^[A-Za-z][A-Za-z0-9_-]*:', '')), '') AS h
      FROM file_facts WHERE path IS NOT NULL AND snapshot_no IS NOT NULL),
    s AS (
      SELECT snapshot_no, path, h FROM (
        SELECT *, row_number() OVER (PARTITION BY snapshot_no, path ORDER BY scanned_at DESC NULLS LAST, h DESC NULLS LAST) AS k FROM r)
      WHERE k = 1),
    n AS (SELECT DISTINCT snapshot_no FROM s WHERE snapshot_no - 1 IN (SELECT snapshot_no FROM s)),
    a AS (SELECT * FROM s WHERE snapshot_no IN (SELECT snapshot_no FROM n)),
    b AS (SELECT snapshot_no + 1 AS snapshot_no, path, h FROM s WHERE snapshot_no + 1 IN (SELECT snapshot_no FROM n))
    SELECT coalesce(a.snapshot_no, b.snapshot_no)::INTEGER AS snapshot_no, coalesce(a.path, b.path) AS path,
           CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL OUTER JOIN b ON a.snapshot_no = b.snapshot_no AND a.path = b.path
    WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h
    """,
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(read_table(spark, d, "file_facts", ["snapshot_no", "scanned_at", "path", "content_hash"]))


# --- text functions -----------------------------------------------------------------------------------------------

B_ = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
H_ = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}"
ENTITY = "(SELECT DISTINCT id, norm_name, name, type, description, community_id, degree FROM entities)"
MENTION = "(SELECT DISTINCT id, chunk_id, entity_id, span_start, span_end FROM mentions)"
RELATION = "(SELECT DISTINCT id, src_id, dst_id, type, weight, description, confidence FROM relations)"
SOURCE = "(SELECT DISTINCT id, path, abs_path, content_hash, size_bytes, mtime_ms, state, error FROM sources)"
CHUNK = "(SELECT id, any_value(source_id) AS source_id, any_value(ordinal) AS ordinal, any_value(start_line) AS start_line, any_value(end_line) AS end_line, max(text) AS text FROM chunks GROUP BY id)"
SHOWN = f"(SELECT * FROM {CHUNK} WHERE source_id NOT IN (SELECT id FROM sources WHERE state = 'disabled'))"
LIVE = f"(SELECT * FROM {RELATION} WHERE confidence IS NULL OR confidence >= 0)"
EVIDENCE = f"""(SELECT r.id AS relation_id, a.chunk_id FROM {RELATION} r
  JOIN (SELECT DISTINCT chunk_id, entity_id FROM mentions) a ON a.entity_id = r.src_id
  JOIN (SELECT DISTINCT chunk_id, entity_id FROM mentions) b ON b.entity_id = r.dst_id AND b.chunk_id = a.chunk_id)"""
ASKED = f"(SELECT id AS qid, name AS question FROM {ENTITY} WHERE id % 50 = 0)"


def _norm(x: str) -> str:
    return rf"""regexp_replace(lower(regexp_replace({x}, '^[{B_}]+|[{B_}]+$', '', 'g')), '[{B_}`*_\-./\\()\[\]{{}}<>"''!?,;:]+', '', 'g')"""


def _est(x: str, han: str = H_) -> str:
    return f"ceil(length({x}) - length(regexp_replace({x}, '[{B_}{han}]', '', 'g')) - length(regexp_replace({x}, '[^{B_}]', '', 'g')) + length(regexp_replace({x}, '[{B_}{han}]', '', 'g')) / 3.5)::INTEGER"


def _all_terms(x: str) -> str:
    return rf"flatten([CASE WHEN regexp_matches(w, '[{H_}]') THEN [substr(w, i::BIGINT, 3) FOR i IN range(1, length(w) - 1)] ELSE [lower(w)] END FOR w IN regexp_split_to_array({x}, '[{B_}\p{{P}}\p{{S}}]+') IF length(w) >= 3])"


def _terms(x: str) -> str:
    return f"list_distinct({_all_terms(x)})"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.once(read_table(spark, d, "entities"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.once(read_table(spark, d, "relations"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.once(read_table(spark, d, "mentions"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.once(read_table(spark, d, "sources"))


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once_per_key(read_table(spark, d, "chunks", list(columns)), "id") if columns[1:] else read_table(spark, d, "chunks", ["id"]).distinct()


def _shown(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph.shown_chunks(_chunks(spark, d, "id", "source_id", *columns), _sources(spark, d))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return merge.relation_evidence(_relations(spark, d), _mentions(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches: the names of all entities whose id is divisible by 50."""
    return _entities(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("name").alias("question"))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"sources": _sources(spark, d), "chunks": read_table(spark, d, "chunks"), "entities": _cards(spark, d), "mentions": _mentions(spark, d), "relations": _relations(spark, d)}


@query("norm_name", f"SELECT id, {_norm('name')} AS key FROM {ENTITY}")
def _(spark, d):
    return _entities(spark, d).select("id", text.norm_name(F.col("name")).alias("key"))


@query("token_estimate", f"SELECT id, {_est('text')} AS tokens, {_est('text', H_.replace('x{F900}-', 'x{3400}-').replace('x{FAFF}', 'x{9FFF}'))} AS cost_tokens FROM {CHUNK} WHERE text IS NOT NULL")
def _(spark, d):
    t = F.col("text")
    return _chunks(spark, d, "id", "text").where("text IS NOT NULL").select("id", text.estimate_tokens(t).alias("tokens"), text.estimate_tokens(t, r"㐀-鿿぀-ヿ").alias("cost_tokens"))


@query("extract_terms", f"SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM (SELECT id, {_all_terms('name')} AS l FROM {ENTITY})")
def _(spark, d):
    return _entities(spark, d).select("id", F.array_join(text.extract_terms(F.col("name")), " ").alias("terms"))


@query("slugify", rf"SELECT id, CASE WHEN s = '' THEN 'kb' ELSE substr(s, 1, 40) END AS slug FROM (SELECT id, regexp_replace(regexp_replace(lower(regexp_replace(name, '^[{B_}]+|[{B_}]+$', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM {ENTITY})")
def _(spark, d):
    return _entities(spark, d).select("id", text.slugify(F.col("name")).alias("slug"))


@query(
    "strip_fences",
    rf"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^[{B_}]+|[{B_}]+$', '', 'g') AS t FROM documents),
    f AS (SELECT doc_id, t, regexp_extract(t, '(?is)```(?:json)?\s*(.*?)\s*```', 1) AS f FROM t),
    i AS (SELECT doc_id, regexp_replace(CASE WHEN f <> '' THEN f ELSE t END, '^[{B_}]+|[{B_}]+$', '', 'g') AS s FROM f)
    SELECT doc_id, md5(regexp_replace(CASE WHEN instr(s, '{{') > 0 AND instr(s, '}}') > 0 AND length(s) - instr(reverse(s), '}}') + 1 > instr(s, '{{')
      THEN substr(s, instr(s, '{{'), length(s) - instr(reverse(s), '}}') + 1 - instr(s, '{{') + 1) ELSE s END, '^[{B_}]+|[{B_}]+$', '', 'g')) AS body FROM i
    """,
)
def _(spark, d):
    return read_table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.md5(text.strip_fences(F.col("text"))).alias("body"))


@query("render_evidence", f"SELECT id, length(shown) AS chars, md5(shown) AS body FROM (SELECT id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…[截断]' ELSE text END AS shown FROM {CHUNK} WHERE text IS NOT NULL)")
def _(spark, d):
    shown = text.shown(F.col("text"))
    return _chunks(spark, d, "id", "text").where("text IS NOT NULL").select("id", F.length(shown).cast("long").alias("chars"), F.md5(shown).alias("body"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return read_table(spark, d, "documents", ["doc_id", "text"]).where("text IS NOT NULL").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


# --- scan, routing, comparison ------------------------------------------------------------------------------------


@query(
    "exclude_globs",
    f"""SELECT path, len([s FOR s IN string_split(path, '/') IF s LIKE '.%' OR s = 'node_modules' OR s LIKE '%.pem' OR s LIKE '%secret%' OR s LIKE '%credential%']) > 0 AS excluded FROM {SOURCE}""",
)
def _(spark, d):
    return _sources(spark, d).select("path", scan.is_excluded(F.col("path")).alias("excluded"))


@query(
    "exclude_patterns",
    f"""SELECT path, len([s FOR s IN string_split(path, '/') IF s LIKE '.%' OR s = 'node_modules' OR s LIKE '%.pem' OR s LIKE '%secret%' OR s LIKE '%credential%' OR s LIKE '%.md' OR s LIKE 'p%s' OR s = 'web']) > 0 AS excluded FROM {SOURCE}""",
)
def _(spark, d):
    return _sources(spark, d).select("path", scan.is_excluded(F.col("path"), ["*.md", "p*s", "web"]).alias("excluded"))


@query(
    "route_by_content",
    rf"""SELECT d.doc_id, CASE WHEN e IN ('.png', '.jpg', '.jpeg', '.webp', '.gif') THEN 'image' WHEN e IN ('.docx', '.pptx', '.xlsx', '.pdf') THEN 'document'
      WHEN e IN ('.doc', '.ppt', '.xls') THEN 'legacy' WHEN doc_id % 5 = 0 THEN 'binary' ELSE 'text' END AS route FROM (SELECT doc_id, lower(regexp_extract(path, '(\.[^.]*)$', 1)) AS e FROM documents WHERE text IS NOT NULL AND path IS NOT NULL) d""",
)
def _(spark, d):
    """The bytes of the texts, every fifth with a zero byte behind it."""
    rows = read_table(spark, d, "documents", ["doc_id", "path", "text"]).where("text IS NOT NULL AND path IS NOT NULL")
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\0")))).otherwise(F.encode("text", "UTF-8"))
    return rows.select("doc_id", scan.route(F.col("path"), scan.is_binary(content)).alias("route"))


@query(
    "route_files",
    rf"""SELECT path, e AS ext, CASE WHEN e IN ('.png', '.jpg', '.jpeg', '.webp', '.gif') THEN 'image' WHEN e IN ('.docx', '.pptx', '.xlsx', '.pdf') THEN 'document'
      WHEN e IN ('.doc', '.ppt', '.xls') THEN 'legacy' ELSE 'text' END AS route FROM (SELECT path, lower(regexp_extract(path, '(\.[^.]*)$', 1)) AS e FROM {SOURCE})""",
)
def _(spark, d):
    return _sources(spark, d).select("path", text.extension(F.col("path")).alias("ext"), scan.route(F.col("path")).alias("route"))


@query("authorized_roots", f"SELECT path, abs_path LIKE '/srv/kb/atlas/%' OR abs_path LIKE '/srv/kb/harbor/%' AS inside FROM {SOURCE}")
def _(spark, d):
    return _sources(spark, d).select("path", scan.under_roots(F.col("abs_path"), ["/srv/kb/atlas", "/srv/kb/harbor"]).alias("inside"))


_LATEST = """(SELECT path, h AS content_hash, length(h) * 7 AS size_bytes FROM (
  SELECT regexp_replace(path, '^(\\./+)+', '') AS path, nullif(lower(regexp_replace(content_hash, '^[A-Za-z][A-Za-z0-9_-]*:', '')), '') AS h,
         row_number() OVER (PARTITION BY regexp_replace(path, '^(\\./+)+', '') ORDER BY scanned_at DESC NULLS LAST, nullif(lower(regexp_replace(content_hash, '^[A-Za-z][A-Za-z0-9_-]*:', '')), '') DESC NULLS LAST) AS k
  FROM file_facts WHERE snapshot_no = (SELECT max(snapshot_no) - 1 FROM file_facts)) WHERE k = 1)"""
_DIFF = f"""(SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN CASE WHEN b.state <> 'deleted' THEN 'removed' END
  WHEN b.state <> 'disabled' AND a.content_hash <> b.content_hash THEN 'changed' END AS change
  FROM {_LATEST} a FULL OUTER JOIN {SOURCE} b ON a.path = b.path)"""


def _last_but_one(spark, d):
    scans = read_table(spark, d, "file_facts", ["snapshot_no", "scanned_at", "path", "content_hash"])
    newest = scans.agg(F.max("snapshot_no")).first()[0]
    return snapshots.canonical_listing(scans.where(F.col("snapshot_no") == F.lit((newest or 0) - 1)))


@query("diff_index", f"SELECT path, change FROM {_DIFF} WHERE change IS NOT NULL")
def _(spark, d):
    return scan.diff_against_index(_last_but_one(spark, d), _sources(spark, d))


@query(
    "changes_preview",
    f"""SELECT change, n, paths FROM (SELECT change, count(*) AS n FROM {_DIFF} WHERE change IS NOT NULL GROUP BY change)
    JOIN (SELECT change, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY path) AS k FROM {_DIFF} WHERE change IS NOT NULL) WHERE k <= 20 GROUP BY change) USING (change)""",
)
def _(spark, d):
    return governance.changes_preview(scan.diff_against_index(_last_but_one(spark, d), _sources(spark, d)))


@query("estimate", f"SELECT files, files + ceil(files / 10.0)::BIGINT AS calls FROM (SELECT count(*) AS files FROM {_DIFF} WHERE change IN ('added', 'changed'))")
def _(spark, d):
    diff = scan.diff_against_index(_last_but_one(spark, d), _sources(spark, d))
    return diff.agg(F.count_if(F.col("change") != "removed").alias("files")).select("files", (F.col("files") + F.ceil(F.col("files") / 10)).alias("calls"))


@query(
    "upsert_sources",
    f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN f THEN a.content_hash ELSE b.content_hash END AS content_hash, CASE WHEN f THEN 'pending' ELSE b.state END AS state, CASE WHEN NOT f THEN b.error END AS error, CASE WHEN f THEN a.size_bytes ELSE b.size_bytes END AS size_bytes
    FROM (SELECT a.path AS ap, b.path AS bp, a.path IS NOT NULL AND a.content_hash IS NOT NULL AND (b.path IS NULL OR b.state <> 'disabled' AND b.content_hash IS DISTINCT FROM a.content_hash) AS f FROM {_LATEST} a FULL OUTER JOIN {SOURCE} b ON a.path = b.path) x
    LEFT JOIN {_LATEST} a ON a.path = x.ap LEFT JOIN {SOURCE} b ON b.path = x.bp""",
)
def _(spark, d):
    scanned = _last_but_one(spark, d).withColumn("size_bytes", (F.length("content_hash") * 7).cast("long"))
    return merge.upsert_sources(_sources(spark, d), scanned).select("path", "content_hash", "state", "error", "size_bytes")


# --- chunking and extraction --------------------------------------------------------------------------------------


@query(
    "document_blocks",
    f"""
    WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, regexp_matches(line, '[^{B_}]') AS solid, regexp_matches(line, '^#{{1,6}}[{B_}]') AS head FROM d),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM s WHERE solid),
    h AS (SELECT *, first_value(head) OVER w AS begins, CASE WHEN max(head) OVER (w ROWS UNBOUNDED PRECEDING) THEN 1 ELSE 0 END AS after FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY n)),
    b AS (SELECT doc_id, min(n) AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS body FROM h GROUP BY doc_id, run, CASE WHEN begins THEN 0 ELSE after END)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line)::INTEGER AS block_no, start_line, end_line, {_est('body')} AS token_est FROM b
    """,
)
def _(spark, d):
    return chunking.document_blocks(read_table(spark, d, "documents", ["doc_id", "text"], spread=True), "doc_id")


@query(
    "chunk_documents",
    f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, regexp_matches(line, '[^{B_}]') AS solid, regexp_matches(line, '^#{{1,6}}[{B_}]') AS head FROM d),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM s WHERE solid),
    h AS (SELECT *, first_value(head) OVER w AS begins, CASE WHEN max(head) OVER (w ROWS UNBOUNDED PRECEDING) THEN 1 ELSE 0 END AS after FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY n)),
    k AS (SELECT doc_id, min(n) AS first, max(n) AS last, string_agg(line, chr(10) ORDER BY n) AS body FROM h GROUP BY doc_id, run, CASE WHEN begins THEN 0 ELSE after END),
    b AS MATERIALIZED (SELECT *, {_est('body')} AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS i FROM k),
    g AS (SELECT doc_id, i, 1 AS chunk, cost AS size, cost > 1400 AS big FROM b WHERE i = 1
      UNION ALL SELECT b.doc_id, b.i, CASE WHEN g.big OR b.cost > 1400 OR g.size + b.cost > 1000 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.big OR b.cost > 1400 OR g.size + b.cost > 1000 THEN b.cost ELSE g.size + b.cost END, b.cost > 1400
      FROM g JOIN b ON b.doc_id = g.doc_id AND b.i = g.i + 1),
    z AS MATERIALIZED (SELECT d.doc_id, d.n, d.line, {_est('d.line')} AS cost, b.first FROM b JOIN d ON d.doc_id = b.doc_id AND d.n BETWEEN b.first AND b.last WHERE b.cost > 1400),
    p AS (SELECT doc_id, n, first, 1 AS part, cost AS size FROM z WHERE n = first
      UNION ALL SELECT z.doc_id, z.n, z.first, CASE WHEN p.size + z.cost > 1400 THEN p.part + 1 ELSE p.part END, CASE WHEN p.size + z.cost > 1400 THEN z.cost ELSE p.size + z.cost END FROM p JOIN z ON z.doc_id = p.doc_id AND z.first = p.first AND z.n = p.n + 1),
    c AS (SELECT b.doc_id, min(first) AS start_line, max(last) AS end_line, string_agg(body, chr(10) || chr(10) ORDER BY b.i) AS body FROM b JOIN g ON g.doc_id = b.doc_id AND g.i = b.i WHERE NOT g.big GROUP BY b.doc_id, g.chunk
      UNION ALL SELECT doc_id, min(n), max(n), string_agg(line, chr(10) ORDER BY n) FROM p JOIN z USING (doc_id, n, first) GROUP BY doc_id, first, part)
    SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY start_line) - 1)::INTEGER AS ordinal, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, length(l.line)::INTEGER AS end_col, {_est('body')} AS token_est, md5(body) AS body
    FROM c JOIN d l ON l.doc_id = c.doc_id AND l.n = c.end_line
    """,
)
def _(spark, d):
    rows = chunking.chunk_documents(read_table(spark, d, "documents", ["doc_id", "text"], spread=True), "doc_id")
    return rows.select("doc_id", "ordinal", "start_line", "end_line", "end_col", "token_est", F.md5("text").alias("body"))


@query(
    "validate_items",
    f"""SELECT id, type IN ({', '.join(repr(t) for t in vocabulary.RELATION_TYPES)}) AND confidence > 0 AND confidence <= 1 AND confidence >= 0.6 IS TRUE AS kept
    FROM (SELECT id, type, coalesce(confidence, -1) AS confidence FROM {RELATION})""",
)
def _(spark, d):
    item = F.struct(F.lit("s").alias("s"), F.col("type").alias("r"), F.lit("o").alias("o"), F.lit(None).cast("string").alias("d"), F.col("confidence").alias("c"))
    rows = _relations(spark, d).withColumn("items", F.struct(F.array(item).alias("relations")))
    return rows.select("id", (F.size(extraction.good_relations(F.col("items"), 0.6)) == 1).alias("kept"))


_BODY_CTES = rf"""t AS (SELECT doc_id, regexp_replace(text, '^[{B_}]+|[{B_}]+$', '', 'g') AS t FROM documents),
    f AS (SELECT doc_id, t, regexp_extract(t, '(?is)```(?:json)?\s*(.*?)\s*```', 1) AS f FROM t),
    i AS (SELECT doc_id, regexp_replace(CASE WHEN f <> '' THEN f ELSE t END, '^[{B_}]+|[{B_}]+$', '', 'g') AS s FROM f),
    b AS (SELECT doc_id, regexp_replace(CASE WHEN instr(s, '{{') > 0 AND instr(s, '}}') > 0 AND length(s) - instr(reverse(s), '}}') + 1 > instr(s, '{{')
      THEN substr(s, instr(s, '{{'), length(s) - instr(reverse(s), '}}') + 1 - instr(s, '{{') + 1) ELSE s END, '^[{B_}]+|[{B_}]+$', '', 'g') AS body FROM i)"""


def _formed_sql(names: tuple[str, ...], kind: str) -> str:
    named = " AND ".join(f"json_type(x, '$.{n}') = 'VARCHAR' AND (x->>'$.{n}') <> ''" for n in names)
    return f"coalesce(json_type(x) = 'OBJECT' AND {named} AND json_type(x, '$.{kind}') = 'VARCHAR' AND coalesce(json_type(x, '$.d'), 'NULL') IN ('VARCHAR', 'NULL') AND json_type(x, '$.c') IN ('DOUBLE', 'UBIGINT', 'BIGINT'), FALSE)"


def _good_sql(kind: str, types: list[str]) -> str:
    return f"(x->>'$.{kind}') IN ({', '.join(repr(t) for t in types)}) AND (x->>'$.c')::DOUBLE > 0 AND (x->>'$.c')::DOUBLE <= 1 AND (x->>'$.c')::DOUBLE >= 0.6"


@query(
    "validate_output",
    f"""WITH {_BODY_CTES}, j AS (SELECT doc_id, CASE WHEN body <> '' AND json_valid(body) AND NOT regexp_matches(body, ',\\s*[\\]}}]') THEN body::JSON END AS j FROM b),
    l AS (SELECT doc_id, j, coalesce(json_type(j, '$.entities'), 'ARRAY') = 'ARRAY' AND coalesce(json_type(j, '$.relations'), 'ARRAY') = 'ARRAY' AND json_type(j) = 'OBJECT' AS lists,
      coalesce(json_extract(j, '$.entities[*]'), []) AS e, coalesce(json_extract(j, '$.relations[*]'), []) AS r FROM j),
    o AS (SELECT *, coalesce(lists AND len([x FOR x IN e IF NOT {_formed_sql(("n",), "t")}]) = 0 AND len([x FOR x IN r IF NOT {_formed_sql(("s", "o"), "r")}]) = 0, FALSE) AS formed FROM l),
    k AS (SELECT *, CASE WHEN formed THEN len([x FOR x IN e IF {_good_sql("t", vocabulary.ENTITY_TYPES)}]) ELSE 0 END AS ke, CASE WHEN formed THEN len([x FOR x IN r IF {_good_sql("r", vocabulary.RELATION_TYPES)}]) ELSE 0 END AS kr,
      CASE WHEN formed THEN len(e) + len(r) ELSE 0 END AS every FROM o)
    SELECT doc_id, ke::INTEGER AS entities, kr::INTEGER AS relations, (every - ke - kr)::INTEGER AS dropped, CASE WHEN j IS NULL THEN 'PARSE_FAILED' WHEN ke + kr > 0 THEN 'ok' WHEN every > 0 THEN 'PARSE_FAILED' ELSE 'EMPTY' END AS outcome FROM k""",
)
def _(spark, d):
    rows = extraction.validate_output(read_table(spark, d, "documents", ["doc_id", "text"]), "text")
    return rows.select("doc_id", F.size("entities").alias("entities"), F.size("relations").alias("relations"), "dropped", "outcome")


@query(
    "mentions",
    f"""
    WITH n AS (SELECT DISTINCT m.chunk_id, m.entity_id, e.name FROM mentions m JOIN {ENTITY} e ON e.id = m.entity_id WHERE length(e.name) > 0),
    p AS (SELECT chunk_id, entity_id, length(name) AS k, string_split(lower(c.text), lower(name)) AS parts FROM n JOIN {CHUNK} c ON c.id = n.chunk_id WHERE c.text IS NOT NULL),
    u AS (SELECT chunk_id, entity_id, k, [length(x) FOR x IN parts] AS sizes, unnest(range(1, len(parts))) AS i FROM p)
    SELECT chunk_id, entity_id, (list_sum(sizes[1:i]) + (i - 1) * k)::INTEGER AS span_start, (list_sum(sizes[1:i]) + i * k)::INTEGER AS span_end FROM u
    """,
)
def _(spark, d):
    names = _mentions(spark, d).select("chunk_id", "entity_id").distinct().join(_entities(spark, d).select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return extraction.compute_mentions(read_table(spark, d, "chunks", ["id", "text"]), names)


@query(
    "precomputed_merge",
    f"""
    WITH e AS (SELECT DISTINCT c.source_id, x.name FROM {MENTION} m JOIN {CHUNK} c ON c.id = m.chunk_id JOIN {ENTITY} x ON x.id = m.entity_id),
    r AS (SELECT DISTINCT c.source_id, v.relation_id, s.name AS s, o.name AS o FROM {EVIDENCE} v JOIN {CHUNK} c ON c.id = v.chunk_id JOIN {RELATION} r ON r.id = v.relation_id JOIN {ENTITY} s ON s.id = r.src_id JOIN {ENTITY} o ON o.id = r.dst_id)
    SELECT 'entity' AS kind, c.id AS chunk_id, count(*) AS n FROM e JOIN {CHUNK} c USING (source_id) WHERE contains(c.text, e.name) GROUP BY c.id
    UNION ALL SELECT 'relation', chunk_id, count(*) FROM (SELECT source_id, relation_id, arg_min(c.id, (c.ordinal, c.id)) AS chunk_id FROM r JOIN {CHUNK} c USING (source_id) WHERE contains(c.text, r.s) OR contains(c.text, r.o) GROUP BY 1, 2) GROUP BY chunk_id
    """,
)
def _(spark, d):
    chunks = _chunks(spark, d, "id", "source_id", "ordinal", "text")
    of, named = chunks.select(F.col("id").alias("chunk_id"), "source_id"), _entities(spark, d).select("id", "name")
    names = _mentions(spark, d).join(of, "chunk_id").join(named.toDF("entity_id", "name"), "entity_id").select("source_id", "name").distinct()
    ends = _relations(spark, d).select(F.col("id").alias("rel_id"), "src_id", "dst_id").join(named.toDF("src_id", "s"), "src_id").join(named.toDF("dst_id", "o"), "dst_id")
    told = _evidence(spark, d).select(F.col("relation_id").alias("rel_id"), "chunk_id").join(of, "chunk_id").join(ends, "rel_id").select("source_id", "rel_id", "s", "o").distinct()
    found, first = extraction.assign_precomputed(chunks, names, told)
    count = lambda rows, kind: rows.groupBy("chunk_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "chunk_id", "n")
    return count(found, "entity").unionByName(count(first, "relation"))


# --- merging ------------------------------------------------------------------------------------------------------

_FACTS = f"(SELECT m.id AS seq, e.norm_name, e.name, e.type, e.description FROM {MENTION} m JOIN {ENTITY} e ON e.id = m.entity_id)"


def _entity_facts(spark, d):
    """Each mention as a fact about its entity, keyed by the name's present form so that spellings meet."""
    named = _entities(spark, d).select(F.col("id").alias("entity_id"), "norm_name", "name", "type", "description")
    return _mentions(spark, d).select(F.col("id").alias("seq"), "chunk_id", "entity_id").join(named, "entity_id")


@query(
    "entity_merge",
    f"""SELECT norm_name, arg_min(name, seq) AS name, arg_min(type, seq) AS type, arg_min(description, seq) FILTER (description IS NOT NULL) AS description,
      coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name <> norm_name)), ','), '') AS aliases, count(*) AS occurrences FROM {_FACTS} WHERE norm_name <> '' GROUP BY norm_name""",
)
def _(spark, d):
    merged = merge.merge_entities(_entity_facts(spark, d))
    return merged.select("norm_name", "name", "type", "description", F.array_join("aliases", ",").alias("aliases"), "occurrences")


def _relation_facts(spark, d):
    proofs = _evidence(spark, d).join(_relations(spark, d).withColumnRenamed("id", "relation_id"), "relation_id")
    return proofs.withColumn("seq", F.struct("chunk_id", "relation_id"))


@query(
    "relation_merge",
    f"""SELECT src_id, dst_id, type, count(*) AS weight, round(avg(confidence), 6) AS confidence, arg_min(description, (chunk_id, relation_id)) FILTER (description IS NOT NULL) AS description, count(DISTINCT chunk_id) AS evidence_chunks
    FROM {EVIDENCE} v JOIN {RELATION} r ON r.id = v.relation_id GROUP BY src_id, dst_id, type""",
)
def _(spark, d):
    return merge.merge_relations(_relation_facts(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(
    "resolve_endpoints",
    f"""WITH k AS (SELECT e.norm_name, min(m.id) AS at FROM {MENTION} m JOIN {ENTITY} e ON e.id = m.entity_id GROUP BY 1)
    SELECT r.id AS seq, s.norm_name AS src_norm, o.norm_name AS dst_norm FROM {RELATION} r JOIN {ENTITY} s ON s.id = r.src_id JOIN {ENTITY} o ON o.id = r.dst_id
    JOIN k a ON a.norm_name = s.norm_name JOIN k b ON b.norm_name = o.norm_name WHERE a.at <= r.id AND b.at <= r.id""",
)
def _(spark, d):
    names = _entities(spark, d).select("id", "norm_name")
    facts = _relations(spark, d).select(F.col("id").alias("seq"), "src_id", "dst_id").join(names.toDF("src_id", "src_norm"), "src_id").join(names.toDF("dst_id", "dst_norm"), "dst_id")
    return merge.resolve_endpoints(facts.select("seq", "src_norm", "dst_norm"), _entity_facts(spark, d).select("norm_name", "seq")).select("seq", "src_norm", "dst_norm")


@query("relation_evidence", f"SELECT relation_id, chunk_id FROM {EVIDENCE}")
def _(spark, d):
    return _evidence(spark, d).select("relation_id", "chunk_id")


@query("degree_occurrence", f"SELECT id, sum(weight)::BIGINT AS degree FROM (SELECT src_id AS id, weight FROM {RELATION} UNION ALL SELECT dst_id, weight FROM {RELATION}) GROUP BY id")
def _(spark, d):
    return merge.degree_by_occurrence(_relations(spark, d))


@query("degree_distinct", f"SELECT e.id, count(r.id) AS degree FROM {ENTITY} e LEFT JOIN (SELECT id, src_id AS x FROM {RELATION} UNION ALL SELECT id, dst_id FROM {RELATION} WHERE src_id <> dst_id) r ON r.x = e.id GROUP BY e.id")
def _(spark, d):
    return merge.degree_distinct(_entities(spark, d), _relations(spark, d))


@query(
    "source_stats",
    f"""WITH c AS (SELECT source_id, count(*) AS chunks FROM {CHUNK} GROUP BY 1), e AS (SELECT source_id, count(DISTINCT entity_id) AS entities FROM {MENTION} m JOIN {CHUNK} c ON c.id = m.chunk_id GROUP BY 1),
    r AS (SELECT source_id, count(DISTINCT relation_id) AS relations FROM {EVIDENCE} v JOIN {CHUNK} c ON c.id = v.chunk_id GROUP BY 1)
    SELECT s.id AS source_id, coalesce(chunks, 0) AS chunks, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations
    FROM {SOURCE} s LEFT JOIN c ON c.source_id = s.id LEFT JOIN e ON e.source_id = s.id LEFT JOIN r ON r.source_id = s.id""",
)
def _(spark, d):
    return governance.source_stats(_sources(spark, d), _chunks(spark, d, "id", "source_id"), _mentions(spark, d), _evidence(spark, d))


# --- lexical retrieval --------------------------------------------------------------------------------------------


def _bm25_sql(texts: str, k: int, questions: str = ASKED) -> str:
    """BM25 by arithmetic over ``texts`` (id, text, shown); occurrences are counted by what replacing a term removes."""
    return f"""
    WITH q AS {questions}, t AS (SELECT DISTINCT qid, unnest({_terms("question")}) AS term FROM q), x AS {texts},
    z AS (SELECT count(*)::DOUBLE AS n, avg(greatest(length(text) - 2, 0)) AS mean FROM x),
    h AS (SELECT x.id, u.term, (length(lower(text)) - length(replace(lower(text), lower(term), ''))) / length(term) AS f, greatest(length(text) - 2, 0) AS d, shown
          FROM x, (SELECT DISTINCT term FROM t) u WHERE contains(lower(text), lower(term))),
    i AS (SELECT term, CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS c FROM h GROUP BY term), z),
    s AS (SELECT qid, h.id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score FROM t JOIN h USING (term) JOIN i USING (term), z WHERE shown GROUP BY qid, h.id),
    hits AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id)::INTEGER AS rank FROM s) WHERE rank <= {k})
    """


_CHUNK_TEXTS = f"(SELECT id, text, source_id NOT IN (SELECT id FROM sources WHERE state = 'disabled') AS shown FROM {CHUNK} WHERE text IS NOT NULL)"
_CARDS = f"(SELECT *, concat_ws(' ', name, norm_name) AS search_text FROM {ENTITY})"
_NAME_TEXTS = f"(SELECT id, search_text AS text, TRUE AS shown FROM {_CARDS})"


def _chunk_texts(spark, d):
    return graph.searchable_texts(read_table(spark, d, "chunks", ["id", "source_id", "text"]), _sources(spark, d))


def _cards(spark, d):
    """The entities with the key of an older build as an alias beside the name."""
    return _entities(spark, d).withColumn("search_text", F.concat_ws(" ", "name", "norm_name"))


def _name_texts(spark, d):
    return retrieval.entity_texts(_cards(spark, d))


@query("bm25_chunks", _bm25_sql(_CHUNK_TEXTS, 8) + "SELECT qid, id, round(score, 6) AS score, rank FROM hits")
def _(spark, d):
    return lexical.bm25(_chunk_texts(spark, d), _asked(spark, d), 8).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("bm25_entities", _bm25_sql(_NAME_TEXTS, 12) + "SELECT qid, id, round(score, 6) AS score, rank FROM hits")
def _(spark, d):
    return lexical.bm25(_name_texts(spark, d), _asked(spark, d), 12).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "entity_cards",
    f"""WITH q AS {ASKED}, t AS (SELECT DISTINCT qid, unnest({_terms("question")}) AS term FROM q),
    h AS (SELECT qid, e.id, degree, max(contains(lower(search_text), lower(term))) AS a FROM t, {_CARDS} e WHERE contains(lower(search_text), lower(term)) OR contains(lower(norm_name), lower(term)) GROUP BY qid, e.id, degree),
    k AS (SELECT *, max(a) OVER (PARTITION BY qid) AS any_a FROM h)
    SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY degree DESC, id)::INTEGER AS rank FROM k WHERE a OR NOT any_a) WHERE rank <= 20""",
)
def _(spark, d):
    return lexical.entity_cards(_cards(spark, d), _asked(spark, d), 20)


# --- graph --------------------------------------------------------------------------------------------------------

_BOTH = f"(SELECT src_id AS node, dst_id AS other, id, type, weight FROM {LIVE} UNION ALL SELECT dst_id, src_id, id, type, weight FROM {LIVE} WHERE src_id <> dst_id)"
for _way, _edges in (("out", f"(SELECT src_id AS node, dst_id AS other, id, type, weight FROM {LIVE})"), ("in", f"(SELECT dst_id AS node, src_id AS other, id, type, weight FROM {LIVE})"), ("both", _BOTH)):

    @query(f"neighbors_{_way}", f"SELECT node, other, id AS relation_id, type, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, id)::INTEGER AS position FROM {_edges} WHERE node IN (SELECT id FROM entities)")
    def _(spark, d, way=_way):
        return graph.neighbors(_relations(spark, d), _entities(spark, d).select("id"), way)


@query(
    "reachable_2hop",
    f"""WITH e AS MATERIALIZED {_BOTH}, s AS (SELECT DISTINCT id AS qid FROM entities WHERE id % 50 = 0), a AS (SELECT DISTINCT qid, other AS id FROM s JOIN e ON e.node = qid),
    b AS (SELECT DISTINCT qid, other AS id FROM a JOIN e ON e.node = a.id)
    SELECT qid, id, min(hop)::INTEGER AS hop FROM (SELECT qid, qid AS id, 0 AS hop FROM s UNION ALL SELECT qid, id, 1 FROM a UNION ALL SELECT qid, id, 2 FROM b) GROUP BY qid, id""",
)
def _(spark, d):
    seeds = _entities(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "id")
    return graph.traverse(_relations(spark, d), seeds, 2, "both", None, 1 << 30)[0].select("qid", "id", "hop")


def _walk_sql(seeds: str, hops: int, budget: int) -> str:
    """The levels of a breadth-first walk from ``seeds`` (qid, id), unrolled: ``seen{hops}`` has the nodes in the order of
    their admission, ``walked`` the edges, ``refused`` the questions some node of which wasn't admitted."""
    out = [f"e AS MATERIALIZED {_BOTH}", f"seen0 AS MATERIALIZED (SELECT qid, id, 0 AS hop, row_number() OVER (PARTITION BY qid ORDER BY id) AS position FROM (SELECT DISTINCT qid, id FROM {seeds}))", "f0 AS (SELECT * FROM seen0)"]
    for h in range(1, hops + 1):
        out += [
            f"s{h} AS MATERIALIZED (SELECT f.qid, f.position AS came, e.other AS id, e.id AS rid, e.weight FROM f{h - 1} f JOIN e ON e.node = f.id)",
            f"m{h} AS (SELECT s.*, row_number() OVER (PARTITION BY s.qid, s.id ORDER BY came, weight DESC, rid) AS k FROM s{h} s LEFT JOIN seen{h - 1} o ON o.qid = s.qid AND o.id = s.id WHERE o.id IS NULL)",
            f"c{h} AS (SELECT qid, count(*) AS taken FROM seen{h - 1} GROUP BY qid)",
            f"r{h} AS MATERIALIZED (SELECT m.qid, m.id, {h} AS hop, taken + row_number() OVER (PARTITION BY m.qid ORDER BY came, weight DESC, rid) AS position FROM m{h} m JOIN c{h} c ON c.qid = m.qid WHERE k = 1)",
            f"f{h} AS (SELECT * FROM r{h} WHERE position <= {budget})",
            f"seen{h} AS MATERIALIZED (SELECT * FROM seen{h - 1} UNION ALL SELECT * FROM f{h})",
        ]
    walked = " UNION ".join(f"SELECT qid, rid FROM s{h}" for h in range(1, hops + 1))
    refused = " UNION ".join(f"SELECT qid FROM r{h} WHERE position > {budget}" for h in range(1, hops + 1))
    return ", ".join([*out, f"walked AS ({walked})", f"refused AS ({refused})"])


_SEEDS = "(SELECT DISTINCT id AS qid, id FROM entities WHERE id % 50 = 0)"


def _seeds(spark, d):
    return _entities(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "id")


@query(
    "traverse_budget",
    f"""WITH {_walk_sql(_SEEDS, 4, 20)} SELECT n.qid, nodes, coalesce(edges, 0) AS edges, n.qid IN (SELECT qid FROM refused) AS truncated
    FROM (SELECT qid, count(*) AS nodes FROM seen4 GROUP BY qid) n LEFT JOIN (SELECT qid, count(*) AS edges FROM walked GROUP BY qid) w USING (qid)""",
)
def _(spark, d):
    nodes, edges, flags = graph.traverse(_relations(spark, d), _seeds(spark, d), 4, "both", None, 20)
    counts = nodes.groupBy("qid").agg(F.count("*").alias("nodes")).join(edges.groupBy("qid").agg(F.count("*").alias("edges")), "qid", "left")
    return counts.join(flags, "qid").na.fill(0, ["edges"])


@query("traverse_order", f"WITH {_walk_sql(_SEEDS, 4, 20)} SELECT qid, id, hop::INTEGER AS hop, position::INTEGER AS position FROM seen4")
def _(spark, d):
    return graph.traverse(_relations(spark, d), _seeds(spark, d), 4, "both", None, 20)[0]


@query(
    "reverse_closure",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT dst_id AS node, src_id AS other FROM {LIVE} WHERE type IN ('imports', 'depends_on')),
    r AS (SELECT DISTINCT id AS qid, id FROM entities WHERE id % 50 = 0 UNION SELECT r.qid, e.other FROM r JOIN e ON e.node = r.id)
    SELECT qid, id FROM r""",
)
def _(spark, d):
    seeds = _entities(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "id")
    return graph.traverse(_relations(spark, d), seeds, 1000, "in", ["imports", "depends_on"], 1 << 30)[0].select("qid", "id")


@query(
    "relations_among",
    f"""WITH m AS (SELECT DISTINCT chunk_id AS qid, entity_id AS id FROM mentions)
    SELECT qid, relation_id, rank FROM (SELECT a.qid, r.id AS relation_id, row_number() OVER (PARTITION BY a.qid ORDER BY weight DESC, r.id)::INTEGER AS rank
      FROM {LIVE} r JOIN m a ON a.id = r.src_id JOIN m b ON b.id = r.dst_id AND b.qid = a.qid) WHERE rank <= 40""",
)
def _(spark, d):
    chosen = _mentions(spark, d).select(F.col("chunk_id").alias("qid"), F.col("entity_id").alias("id"))
    return graph.relations_among(_relations(spark, d), chosen, 40)


@query(
    "chunks_for_entities",
    f"""SELECT entity_id, chunk_id, min(k)::INTEGER AS position FROM (SELECT entity_id, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS k FROM {MENTION} WHERE chunk_id IN (SELECT id FROM {SHOWN})) WHERE k <= 2 GROUP BY 1, 2""",
)
def _(spark, d):
    return graph.chunks_for_entities(_mentions(spark, d), _shown(spark, d), 2)


@query("evidence_chunk", f"SELECT entity_id, arg_min(chunk_id, id) AS chunk_id FROM {MENTION} WHERE chunk_id IN (SELECT id FROM {SHOWN}) GROUP BY entity_id")
def _(spark, d):
    return graph.first_evidence(_mentions(spark, d), _shown(spark, d))


@query("entities_in_chunk", "SELECT DISTINCT chunk_id, entity_id FROM mentions")
def _(spark, d):
    return _mentions(spark, d).select("chunk_id", "entity_id").distinct()


@query(
    "evidence_spans",
    f"""WITH e AS (SELECT relation_id, chunk_id FROM {EVIDENCE} WHERE chunk_id IN (SELECT id FROM {SHOWN})),
    s AS (SELECT DISTINCT e.relation_id, e.chunk_id, m.id AS mention_id, m.span_start, m.span_end FROM e JOIN {RELATION} r ON r.id = e.relation_id JOIN {MENTION} m ON m.chunk_id = e.chunk_id AND m.entity_id IN (r.src_id, r.dst_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY chunk_id, mention_id) AS n FROM s)
    SELECT relation_id, chunk_id, arg_min(span_start, n) AS span_start, arg_min_null(span_end, n) AS span_end FROM k WHERE n <= 12 GROUP BY relation_id, chunk_id""",
)
def _(spark, d):
    return graph.evidence_spans(_evidence(spark, d), _relations(spark, d), _mentions(spark, d), _shown(spark, d))


@query("entities_by_community", f"SELECT * FROM (SELECT community_id, id, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, id)::INTEGER AS rank FROM {ENTITY} WHERE community_id IS NOT NULL) WHERE rank <= 50")
def _(spark, d):
    return retrieval.entities_by_community(_entities(spark, d), 50)


def _pagerank_sql(rounds: int) -> str:
    steps = [f"r{k} AS MATERIALIZED (SELECT v.id, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(score), 0) FROM r{k - 1} WHERE id NOT IN (SELECT node FROM p)) / (SELECT count(*) FROM v)) + 0.15 * v.jump AS score FROM v LEFT JOIN (SELECT other AS id, sum(p.p * r.score) AS got FROM p JOIN r{k - 1} r ON r.id = p.node GROUP BY other) g ON g.id = v.id)" for k in range(1, rounds + 1)]
    return f"""WITH u AS (SELECT src_id AS node, dst_id AS other, weight::DOUBLE AS w FROM {RELATION} UNION ALL SELECT dst_id, src_id, weight FROM {RELATION}),
    p AS MATERIALIZED (SELECT node, other, sum(w) / any_value(total) AS p FROM u JOIN (SELECT node, sum(w) AS total FROM u GROUP BY node) USING (node) GROUP BY node, other),
    v AS MATERIALIZED (SELECT id, CASE WHEN id % 50 = 0 THEN 1.0 / (SELECT count(*) FROM {ENTITY} WHERE id % 50 = 0) ELSE 0 END AS jump FROM {ENTITY}),
    r0 AS MATERIALIZED (SELECT id, jump AS score FROM v), {", ".join(steps)}
    SELECT id, round(score, 9) AS score FROM r{rounds}"""


@query("pagerank", _pagerank_sql(20))
def _(spark, d):
    nodes = _entities(spark, d)
    seeds = nodes.where("id % 50 = 0").select("id", F.lit(1.0).alias("weight"))
    return graph.personalized_pagerank(nodes, _relations(spark, d), seeds, tolerance=None).select("id", F.round("score", 9).alias("score"))


@query(
    "pagerank_stopped",
    _pagerank_sql(20).rsplit("SELECT id", 1)[0].rstrip()
    + ", k AS (SELECT coalesce(min(k), 20) AS k FROM ("
    + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.score - b.score)) AS moved FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, 21))
    + ") WHERE moved < 0.05) SELECT id, round(score, 9) AS score FROM ("
    + " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(1, 21))
    + ") WHERE k = (SELECT k FROM k)",
)
def _(spark, d):
    nodes = _entities(spark, d)
    seeds = nodes.where("id % 50 = 0").select("id", F.lit(1.0).alias("weight"))
    return graph.personalized_pagerank(nodes, _relations(spark, d), seeds, tolerance=0.05).select("id", F.round("score", 9).alias("score"))


@query("communities_exact")
def _(spark, d):
    return graph.communities_exact(_entities(spark, d), _relations(spark, d))


@query("communities")
def _(spark, d):
    return graph.communities(_entities(spark, d), _relations(spark, d))


@query(
    "connected_components",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src_id AS a, dst_id AS b FROM {RELATION} UNION SELECT DISTINCT dst_id, src_id FROM {RELATION}),
    r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
    SELECT id, min(root) AS component FROM r WHERE id IN (SELECT a FROM e WHERE a <> b) GROUP BY id""",
)
def _(spark, d):
    return graph.connected_components(_relations(spark, d).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))


@query("community_fingerprint", f"SELECT community_id AS label, substr(sha256(array_to_string(list_sort(list(DISTINCT id)), ',')), 1, 16) AS fingerprint, count(*) AS member_count FROM {ENTITY} WHERE community_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    return graph.community_table(_entities(spark, d).where("community_id IS NOT NULL").select("id", F.col("community_id").alias("label")))


_TOP = f"(SELECT * FROM (SELECT community_id, id, name, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, id) AS n FROM {ENTITY} WHERE community_id IS NOT NULL) WHERE n <= 8)"
_SUMMARIES = f"""(SELECT community_id, array_to_string([members, edges], '; ') AS summary, top FROM (
  SELECT community_id, string_agg(name, ', ' ORDER BY n) AS members, string_agg(name, ', ' ORDER BY n) FILTER (n <= 5) AS top FROM {_TOP} GROUP BY community_id) a
  LEFT JOIN (SELECT community_id, string_agg(line, ', ' ORDER BY n) AS edges FROM (SELECT s.community_id, concat_ws(' ', s.name, r.type, o.name) AS line, row_number() OVER (PARTITION BY s.community_id ORDER BY r.weight DESC, r.id) AS n
    FROM {LIVE} r JOIN {_TOP} s ON s.id = r.src_id JOIN {_TOP} o ON o.id = r.dst_id AND o.community_id = s.community_id) WHERE n <= 8 GROUP BY community_id) b USING (community_id))"""


def _summaries(spark, d):
    return graph.summary_text(graph.summary_inputs(_entities(spark, d), _relations(spark, d)))


@query("community_summary", f"SELECT community_id, CASE WHEN contains(summary, '; ') THEN summary ELSE summary || '; ' END AS summary, top FROM {_SUMMARIES}")
def _(spark, d):
    return _summaries(spark, d).select("community_id", "summary", F.array_join("top", ", ").alias("top"))


@query("graph_all", f"SELECT 'node' AS kind, id, NULL::BIGINT AS src_id, NULL::BIGINT AS dst_id, type FROM {ENTITY} UNION ALL SELECT 'edge', id, src_id, dst_id, type FROM {RELATION}")
def _(spark, d):
    nodes = _entities(spark, d).select(F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("src_id"), F.lit(None).cast("long").alias("dst_id"), "type")
    return nodes.unionByName(_relations(spark, d).select(F.lit("edge").alias("kind"), "id", "src_id", "dst_id", "type"))


@query(
    "expand_node",
    f"""SELECT b.node, b.other, b.id AS relation_id, v.chunk_id FROM {_BOTH} b LEFT JOIN (SELECT relation_id, min(chunk_id) AS chunk_id FROM {EVIDENCE} WHERE chunk_id IN (SELECT id FROM {SHOWN}) GROUP BY 1) v ON v.relation_id = b.id WHERE b.node % 50 = 0""",
)
def _(spark, d):
    near = graph.neighbors(_relations(spark, d), _entities(spark, d).where("id % 50 = 0").select("id"))
    proof = _evidence(spark, d).join(_shown(spark, d).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").groupBy("relation_id").agg(F.min("chunk_id").alias("chunk_id"))
    return near.join(proof, "relation_id", "left").select("node", "other", "relation_id", "chunk_id")


# --- retrieval modes ----------------------------------------------------------------------------------------------


_SEED_CTES = (
    _bm25_sql(_CHUNK_TEXTS, 12).replace("hits AS (", "chunk_hits AS (", 1)
    + f""", z2 AS (SELECT count(*)::DOUBLE AS n, avg(greatest(length(text) - 2, 0)) AS mean FROM {_NAME_TEXTS}),
    h2 AS (SELECT x.id, u.term, (length(lower(text)) - length(replace(lower(text), lower(term), ''))) / length(term) AS f, greatest(length(text) - 2, 0) AS d FROM {_NAME_TEXTS} x, (SELECT DISTINCT term FROM t) u WHERE contains(lower(text), lower(term))),
    i2 AS (SELECT term, CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS c FROM h2 GROUP BY term), z2),
    s2 AS (SELECT qid, h2.id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score FROM t JOIN h2 USING (term) JOIN i2 USING (term), z2 GROUP BY qid, h2.id),
    direct AS (SELECT qid, id, 13.0 - rank AS weight FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS rank FROM s2) WHERE rank <= 12),
    back AS (SELECT qid, m.entity_id AS id, sum(1.0 / c.rank) AS weight FROM chunk_hits c JOIN {MENTION} m ON m.chunk_id = c.id WHERE c.rank <= 8 GROUP BY 1, 2),
    seeds AS MATERIALIZED (SELECT qid, id, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, round(weight, 9) DESC, id) AS k FROM (
      SELECT qid, id, weight::DOUBLE AS weight, 0 AS o FROM direct UNION ALL SELECT qid, id, weight::DOUBLE, 1 FROM back WHERE (qid, id) NOT IN (SELECT (qid, id) FROM direct))) WHERE k <= 12)"""
)


@query("seed_builder", _SEED_CTES + " SELECT qid, id, round(weight, 6) AS weight FROM seeds")
def _(spark, d):
    asked = _asked(spark, d)
    seeds = retrieval.build_seeds(lexical.bm25(_name_texts(spark, d), asked, 12), lexical.bm25(_chunk_texts(spark, d), asked, 8), _mentions(spark, d))
    return seeds.select("qid", "id", F.round("weight", 6).alias("weight"))


def _local_sql(rounds: int = 20) -> str:
    """Local search: a walk over all nodes for each question, then the fused ranks of entities as ``top``."""
    steps = [
        f"""w{k} AS MATERIALIZED (SELECT v.qid, v.id, 0.85 * (coalesce(g.got, 0) + coalesce(l.lost, 0) / (SELECT count(*) FROM {ENTITY})) + 0.15 * v.jump AS score FROM v
        LEFT JOIN (SELECT w.qid, p.other AS id, sum(p.p * w.score) AS got FROM p JOIN w{k - 1} w ON w.id = p.node GROUP BY 1, 2) g ON g.qid = v.qid AND g.id = v.id
        LEFT JOIN (SELECT qid, sum(score) AS lost FROM w{k - 1} WHERE id NOT IN (SELECT node FROM p) GROUP BY qid) l ON l.qid = v.qid)"""
        for k in range(1, rounds + 1)
    ]
    return (
        _SEED_CTES
        + f""", u0 AS (SELECT src_id AS node, dst_id AS other, weight::DOUBLE AS w FROM {RELATION} UNION ALL SELECT dst_id, src_id, weight FROM {RELATION}),
    p AS MATERIALIZED (SELECT node, other, sum(w) / any_value(total) AS p FROM u0 JOIN (SELECT node, sum(w) AS total FROM u0 GROUP BY node) USING (node) GROUP BY node, other),
    v AS MATERIALIZED (SELECT m.qid, e.id, coalesce(s.weight / mass, 0) AS jump FROM (SELECT qid, sum(weight) AS mass FROM seeds GROUP BY qid) m CROSS JOIN (SELECT id FROM {ENTITY}) e LEFT JOIN seeds s ON s.qid = m.qid AND s.id = e.id),
    w0 AS MATERIALIZED (SELECT qid, id, jump AS score FROM v), {", ".join(steps)},
    fused AS (SELECT w.qid, w.id, 0.5 * coalesce(s.weight / max(s.weight) OVER (PARTITION BY w.qid), 0) + 0.5 * w.score / max(w.score) OVER (PARTITION BY w.qid) AS score FROM w{rounds} w LEFT JOIN seeds s ON s.qid = w.qid AND s.id = w.id),
    top AS MATERIALIZED (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM fused) WHERE rank <= 25),
    cfe AS MATERIALIZED (SELECT entity_id, chunk_id, min(k) AS position FROM (SELECT entity_id, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS k FROM {MENTION} WHERE chunk_id IN (SELECT id FROM {SHOWN} WHERE text IS NOT NULL)) WHERE k <= 2 GROUP BY 1, 2),
    place AS MATERIALIZED (SELECT x.entity_id, s.path, concat_ws('-', c.start_line, c.end_line) AS lines FROM (SELECT entity_id, arg_min(chunk_id, id) AS chunk_id FROM {MENTION} WHERE chunk_id IN (SELECT id FROM {SHOWN}) GROUP BY entity_id) x JOIN {CHUNK} c ON c.id = x.chunk_id LEFT JOIN {SOURCE} s ON s.id = c.source_id)"""
    )


@query("local_entities", _local_sql() + f" SELECT qid, id, round(t.score, 6) AS score, rank, name, type FROM top t JOIN {ENTITY} USING (id)")
def _(spark, d):
    tables = _tables(spark, d)
    pack = retrieval.evidence_pack(tables, {k: v for k, v in retrieval.local_search(tables, _asked(spark, d)).items() if k in ("entities", "chunks")})
    return pack["entities"].select("qid", "id", F.round("score", 6).alias("score"), "rank", "name", "type")


@query(
    "local_relations",
    _local_sql()
    + f""" SELECT qid, relation_id, rank, a.name AS s, r.type AS r, b.name AS o, r.weight AS w, coalesce(path, '{retrieval.NO_PLACE}') AS path, coalesce(lines, '-') AS lines
    FROM (SELECT a.qid, r.id AS relation_id, row_number() OVER (PARTITION BY a.qid ORDER BY weight DESC, r.id)::INTEGER AS rank FROM {LIVE} r JOIN top a ON a.id = r.src_id JOIN top b ON b.id = r.dst_id AND b.qid = a.qid) x
    JOIN {RELATION} r ON r.id = x.relation_id JOIN {ENTITY} a ON a.id = r.src_id JOIN {ENTITY} b ON b.id = r.dst_id LEFT JOIN place ON place.entity_id = r.src_id WHERE rank <= 40""",
)
def _(spark, d):
    tables = _tables(spark, d)
    among = retrieval.local_search(tables, _asked(spark, d))["relations"]
    return retrieval.with_evidence(among, tables).select("qid", "relation_id", "rank", "s", "r", "o", "w", "path", "lines")


@query(
    "local_chunks",
    _local_sql()
    + f""", near AS (SELECT t.qid, c.chunk_id, min(t.rank * 10 + c.position) AS pos FROM top t JOIN cfe c ON c.entity_id = t.id GROUP BY 1, 2),
    cut AS (SELECT * FROM (SELECT near.*, sum({_est("text")}) OVER (PARTITION BY qid ORDER BY pos, chunk_id ROWS UNBOUNDED PRECEDING) AS spent FROM near JOIN {CHUNK} c ON c.id = near.chunk_id) WHERE spent <= 6000),
    both_ AS (SELECT qid, id, score, 0 AS stage, rank AS pos FROM chunk_hits WHERE qid IN (SELECT qid FROM seeds) UNION ALL SELECT qid, chunk_id, NULL, 1, pos FROM cut WHERE (qid, chunk_id) NOT IN (SELECT (qid, id) FROM chunk_hits)),
    kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, pos, id)::INTEGER AS rank FROM both_)
    SELECT qid, k.id, round(score, 6) AS score, rank, s.path, concat_ws('-', c.start_line, c.end_line) AS lines, md5(CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…[截断]' ELSE text END) AS body
    FROM kept k JOIN {CHUNK} c ON c.id = k.id LEFT JOIN {SOURCE} s ON s.id = c.source_id WHERE rank <= 12""",
)
def _(spark, d):
    tables = _tables(spark, d)
    rows = retrieval.evidence_chunks(retrieval.local_search(tables, _asked(spark, d))["chunks"], tables)
    return rows.select("qid", "id", F.round("score", 6).alias("score"), "rank", "path", "lines", F.md5("text").alias("body"))


def _rank_sql(summaries: str) -> str:
    return f"""q AS {ASKED}, t AS (SELECT qid, {_terms("question")} AS terms FROM q), s AS MATERIALIZED {summaries},
    picked AS (SELECT qid, community_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, community_id)::INTEGER AS rank FROM (
      SELECT qid, community_id, len([x FOR x IN terms IF contains(lower(summary), x)])::INTEGER AS score FROM t, s WHERE len(terms) > 0)) WHERE rank <= 5 OR (SELECT count(*) FROM s) <= 8)"""


@query("global_rank", f"WITH {_rank_sql(_SUMMARIES)} SELECT * FROM picked")
def _(spark, d):
    return retrieval.rank_summaries(_summaries(spark, d), _asked(spark, d))


_SPLIT = ENTITY.replace("community_id", "id % 12 AS community_id")


@query("global_rank_top", f"WITH {_rank_sql(_SUMMARIES.replace(ENTITY, _SPLIT))} SELECT * FROM picked")
def _(spark, d):
    """Twelve communities, so that only the best five are taken."""
    entities = _entities(spark, d).withColumn("community_id", F.col("id") % 12)
    return retrieval.rank_summaries(graph.summary_text(graph.summary_inputs(entities, _relations(spark, d))), _asked(spark, d))


@query(
    "global_chunks",
    f"""WITH {_rank_sql(_SUMMARIES)},
    m AS (SELECT * FROM (SELECT community_id, id, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, id)::INTEGER AS rank FROM {ENTITY} WHERE community_id IS NOT NULL) WHERE rank <= 12),
    f AS (SELECT entity_id, arg_min(chunk_id, id) AS chunk_id FROM {MENTION} WHERE chunk_id IN (SELECT id FROM {SHOWN} WHERE text IS NOT NULL) GROUP BY entity_id),
    c AS (SELECT p.qid, f.chunk_id, p.rank AS community_rank, m.rank, {_est("text")} AS cost FROM picked p JOIN m USING (community_id) JOIN f ON f.entity_id = m.id JOIN {CHUNK} c ON c.id = f.chunk_id)
    SELECT qid, chunk_id, community_rank, rank FROM (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY community_rank, rank, chunk_id ROWS UNBOUNDED PRECEDING) AS spent FROM c) WHERE spent <= 6000""",
)
def _(spark, d):
    return retrieval.global_search(_tables(spark, d), _summaries(spark, d), _asked(spark, d))["chunks"]


_RESOLVED = (
    _bm25_sql(_NAME_TEXTS, 5)
    + f""", found AS (SELECT qid, count(*) AS n, min(h.id) AS fuzzy, string_agg(name, '|' ORDER BY rank) AS names FROM hits h JOIN {ENTITY} e ON e.id = h.id GROUP BY qid),
    spelled AS (SELECT q.qid, min(e.id) AS exact FROM q JOIN {ENTITY} e ON e.norm_name = {_norm("question")} GROUP BY q.qid),
    resolved AS MATERIALIZED (SELECT q.qid, coalesce(exact, CASE WHEN n = 1 THEN fuzzy END) AS id, CASE WHEN exact IS NOT NULL OR n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'NO_SEED' END AS outcome, names
      FROM q LEFT JOIN spelled USING (qid) LEFT JOIN found USING (qid))"""
)


@query("traversal_seeds", _RESOLVED + " SELECT qid, id, outcome, CASE WHEN outcome = 'ambiguous' THEN names ELSE '' END AS candidates FROM resolved")
def _(spark, d):
    return retrieval.resolve_seeds(_cards(spark, d), _asked(spark, d)).withColumn("candidates", F.array_join("candidates", "|"))


@query("traversal_nodes", _RESOLVED + ", " + _walk_sql("(SELECT qid, id FROM resolved WHERE outcome = 'ok')", 2, 200) + " SELECT qid, id, hop::INTEGER AS hop, position::INTEGER AS position FROM seen2")
def _(spark, d):
    return retrieval.traversal_search(_tables(spark, d), _asked(spark, d))["nodes"]


@query(
    "token_budget",
    f"""SELECT source_id, id, spent FROM (SELECT source_id, id, sum({_est("text")}) OVER (PARTITION BY source_id ORDER BY ordinal, id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM {CHUNK} WHERE text IS NOT NULL) WHERE spent <= 6000""",
)
def _(spark, d):
    rows = _chunks(spark, d, "id", "source_id", "ordinal", "text").where("text IS NOT NULL").select("source_id", "id", "ordinal", text.estimate_tokens(F.col("text")).alias("cost"))
    return retrieval.within_budget(rows, "source_id", [F.col("ordinal"), F.col("id")], "cost", 6000).select("source_id", "id", "spent")


# --- governance ---------------------------------------------------------------------------------------------------

_GONE = "(SELECT id FROM sources WHERE state = 'failed')"
_LEFT_M = f"(SELECT * FROM {MENTION} WHERE chunk_id IN (SELECT id FROM {CHUNK} WHERE source_id NOT IN {_GONE}))"
_LEFT_E = f"(SELECT * FROM {EVIDENCE} WHERE chunk_id IN (SELECT id FROM {CHUNK} WHERE source_id NOT IN {_GONE}))"
_LEFT_R = f"(SELECT * FROM {RELATION} WHERE id IN (SELECT relation_id FROM {_LEFT_E}))"
_HELD = f"(SELECT src_id AS id FROM {_LEFT_R} UNION SELECT dst_id FROM {_LEFT_R} UNION SELECT entity_id FROM {_LEFT_M})"


@query(
    "forget_files",
    f"""SELECT 'chunks' AS kind, count(*) AS kept FROM {CHUNK} WHERE source_id NOT IN {_GONE} UNION ALL SELECT 'mentions', count(*) FROM {_LEFT_M} UNION ALL SELECT 'relations', count(*) FROM {_LEFT_R}
    UNION ALL SELECT 'entities', count(*) FROM {ENTITY} WHERE id IN (SELECT id FROM {_HELD}) UNION ALL SELECT 'evidence', count(*) FROM {_LEFT_E}
    UNION ALL SELECT 'sources', count(*) FROM {SOURCE} WHERE id NOT IN {_GONE}""",
)
def _(spark, d):
    tables = {**_tables(spark, d), "chunks": _chunks(spark, d, "id", "source_id"), "evidence": _evidence(spark, d).select("relation_id", "chunk_id")}
    left = governance.forget_files(tables, _sources(spark, d).where("state = 'failed'").select("path"))
    out = None
    for kind, rows in left.items():
        n = rows.agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "kept")
        out = n if out is None else out.unionByName(n)
    return out


_NAMELESS = f"(SELECT id FROM {ENTITY} WHERE norm_name IN (SELECT {_norm('name')} FROM entities WHERE type = 'unknown'))"


@query(
    "forget_entities",
    f"""SELECT 'relation' AS kind, id FROM {RELATION} WHERE src_id NOT IN {_NAMELESS} AND dst_id NOT IN {_NAMELESS} UNION ALL SELECT 'entity', id FROM {ENTITY} WHERE id NOT IN {_NAMELESS}
    UNION ALL SELECT 'mention', id FROM {MENTION} WHERE entity_id NOT IN {_NAMELESS}""",
)
def _(spark, d):
    """Those whose key is that of the name of an entity of unknown type."""
    tables = _tables(spark, d)
    left = governance.forget_entities(tables, tables["entities"].where("type = 'unknown'").select("name"))
    kinds = [left[f"{t[:-1]}ies" if t == "entity" else t].select(F.lit(k).alias("kind"), "id") for k, t in (("relation", "relations"), ("entity", "entities"), ("mention", "mentions"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("orphans", f"SELECT id FROM {ENTITY} WHERE id NOT IN (SELECT src_id FROM relations) AND id NOT IN (SELECT dst_id FROM relations) AND id NOT IN (SELECT entity_id FROM mentions)")
def _(spark, d):
    return governance.orphans(_entities(spark, d), _relations(spark, d), _mentions(spark, d)).select("id")


@query("exclude_relations", f"SELECT id, confidence < 0.55 IS TRUE AS excluded FROM {RELATION}")
def _(spark, d):
    rows = _relations(spark, d)
    return governance.exclude_relations(rows, rows.where("confidence < 0.55").select("id")).select("id", "excluded")


_FIXES = f"""(SELECT id, CASE WHEN id % 3 = 0 THEN 'Fresh Thing ' || (id % 5) WHEN id % 3 = 1 THEN '  ' END AS s, 'relates_to' AS r, CASE WHEN id % 3 = 1 THEN (SELECT arg_min(name, id) FROM entities) ELSE '' END AS o FROM {RELATION} WHERE confidence < 0.55)"""


@query(
    "correct_relations",
    f"""WITH f AS {_FIXES}, n AS (SELECT id, nullif(trim(s), '') AS s, r, nullif(trim(o), '') AS o FROM f),
    names AS (SELECT DISTINCT {_norm('x')} AS k FROM (SELECT s AS x FROM n UNION SELECT o FROM n) WHERE x IS NOT NULL),
    fresh AS (SELECT k, (SELECT max(id) FROM entities) + row_number() OVER (ORDER BY k) AS id FROM names WHERE k NOT IN (SELECT norm_name FROM entities)),
    keys AS (SELECT norm_name AS k, min(id) AS id FROM {ENTITY} GROUP BY norm_name UNION ALL SELECT k, id FROM fresh),
    a AS (SELECT n.id, x.id AS src, y.id AS dst, n.r FROM n LEFT JOIN keys x ON x.k = {_norm('n.s')} LEFT JOIN keys y ON y.k = {_norm('n.o')}),
    c AS (SELECT r.id, coalesce(a.src, r.src_id) AS src_id, coalesce(a.dst, r.dst_id) AS dst_id, coalesce(a.r, r.type) AS type, r.src_id AS s0, r.dst_id AS o0, r.type AS t0, confidence FROM {RELATION} r LEFT JOIN a ON a.id = r.id)
    SELECT id, src_id, dst_id, type, CASE WHEN src_id <> s0 OR dst_id <> o0 OR type <> t0 THEN 1.0 ELSE confidence END AS confidence FROM c""",
)
def _(spark, d):
    rows, entities = _relations(spark, d), _entities(spark, d)
    known = entities.agg(F.min_by("name", "id").alias("name")).first()
    s = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Fresh Thing "), (F.col("id") % 5).cast("string"))).when(F.col("id") % 3 == 1, "  ")
    changes = rows.where("confidence < 0.55").select("id", s.alias("s"), F.lit("relates_to").alias("r"), F.when(F.col("id") % 3 == 1, F.lit(known["name"] if known else None)).otherwise("").alias("o"))
    # of spellings with one key the table may have several; a correction needs one
    single = entities.groupBy("norm_name").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.min_by("type", "id").alias("type"))
    return governance.correct_relations(rows, single, changes)[0].select("id", "src_id", "dst_id", "type", "confidence")


@query("review_sample", f"SELECT id, confidence, row_number() OVER (ORDER BY confidence >= 1, CASE WHEN confidence < 1 THEN confidence END NULLS FIRST, id)::INTEGER AS rank FROM {RELATION} WHERE confidence >= 0 AND id % 4 <> 0 QUALIFY rank <= 50")
def _(spark, d):
    rows = _relations(spark, d)
    return governance.review_sample(rows, rows.where("id % 4 = 0").select("id"), 50)


_EVENTS = f"(SELECT id AS relation_id, CASE WHEN id % 3 = 0 THEN 'correct' WHEN id % 3 = 1 THEN 'wrong' ELSE 'unsure' END AS verdict, id % 7 = 0 AS corrected, confidence FROM {RELATION})"


def _events(spark, d):
    verdict = F.when(F.col("id") % 3 == 0, "correct").when(F.col("id") % 3 == 1, "wrong").otherwise("unsure")
    return _relations(spark, d).select(F.col("id").alias("relation_id"), verdict.alias("verdict"), (F.col("id") % 7 == 0).alias("corrected"), "confidence")


_STATS = f"""(SELECT count(*) FILTER (corrected OR verdict <> 'unsure') AS sampled, count(*) FILTER (NOT corrected AND verdict = 'correct') AS correct, count(*) FILTER (corrected) AS corrected,
  count(*) FILTER (NOT corrected AND verdict <> 'unsure' AND confidence > 0 AND confidence < 0.8) AS low_sampled, count(*) FILTER (NOT corrected AND verdict = 'correct' AND confidence > 0 AND confidence < 0.8) AS low_correct,
  count(*) FILTER (NOT corrected AND verdict = 'wrong') AS excluded FROM {_EVENTS})"""
_STATUS = f"""(SELECT count(*) FILTER (state = 'merged') AS indexed, count(*) FILTER (state NOT IN ('merged', 'deleted')) AS stale, count(*) FILTER (state = 'quarantined') AS quarantined,
  count(*) FILTER (error = 'skipped-binary') AS skipped_binary, count(*) FILTER (state IN ('pending', 'extracting')) AS changed FROM {SOURCE})"""


@query("review_stats", f"SELECT * FROM {_STATS}")
def _(spark, d):
    return governance.review_stats(_events(spark, d))


@query("status_overview", f"SELECT * FROM {_STATUS}")
def _(spark, d):
    return governance.status(_sources(spark, d))


@query(
    "health",
    f"""SELECT indexed, stale, quarantined, indexed / nullif(indexed + stale, 0) AS coverage, quarantined / nullif(indexed + quarantined, 0) AS quarantine_rate, sampled, correct, corrected,
    correct / nullif(sampled, 0) AS precision, low_correct / nullif(low_sampled, 0) AS low_precision, (SELECT count(*) FROM {RELATION} WHERE confidence < 0) AS excluded_relations,
    (SELECT count(*) FROM {SOURCE} WHERE state <> 'deleted' AND abs_path NOT LIKE '/srv/kb/atlas/%' AND abs_path NOT LIKE '/srv/kb/harbor/%') AS escaped FROM {_STATUS}, {_STATS}""",
)
def _(spark, d):
    return governance.health(_sources(spark, d), _relations(spark, d), _events(spark, d), ["/srv/kb/atlas", "/srv/kb/harbor"])


@query("recovered_sources", f"SELECT path, CASE WHEN state IN ('merged', 'deleted', 'disabled') THEN state ELSE 'pending' END AS state FROM {SOURCE}")
def _(spark, d):
    return merge.recovered(_sources(spark, d)).select("path", "state")


@query("retry_quarantined", f"SELECT path, CASE WHEN state = 'quarantined' THEN 'pending' ELSE state END AS state FROM {SOURCE}")
def _(spark, d):
    rows = _sources(spark, d)
    return governance.reset_to_pending(rows, rows.where("state = 'quarantined'").select("path")).select("path", "state")


@query("enable_sources", f"SELECT path, CASE WHEN state = 'disabled' THEN 'pending' ELSE state END AS state FROM {SOURCE}")
def _(spark, d):
    rows = _sources(spark, d)
    return governance.set_enabled(rows, rows.select("path"), True).select("path", "state")


@query(
    "community_list",
    f"""SELECT community_id, size, top FROM (SELECT community_id, count(*) AS size FROM {ENTITY} WHERE community_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
    JOIN (SELECT community_id, string_agg(name, ', ' ORDER BY n) AS top FROM (SELECT community_id, name, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, id) AS n FROM {ENTITY}) WHERE n <= 8 GROUP BY 1) USING (community_id)""",
)
def _(spark, d):
    return governance.community_list(_entities(spark, d))


@query(
    "evidence_text",
    f"""SELECT w.path, w.first, w.last, arg_min(c.id, (c.ordinal, c.id)) AS chunk_id FROM (SELECT DISTINCT s.path, c.start_line AS first, c.start_line AS last FROM {CHUNK} c JOIN {SOURCE} s ON s.id = c.source_id) w
    JOIN {SOURCE} s ON s.path = w.path JOIN {CHUNK} c ON c.source_id = s.id AND c.start_line <= w.first AND c.end_line >= w.last GROUP BY 1, 2, 3""",
)
def _(spark, d):
    chunks, sources = _chunks(spark, d, "id", "source_id", "ordinal", "start_line", "end_line"), _sources(spark, d)
    wanted = chunks.join(sources.select(F.col("id").alias("source_id"), "path"), "source_id").select("path", F.col("start_line").alias("first"), F.col("start_line").alias("last")).distinct()
    return governance.evidence_text(chunks, sources, wanted)


@query(
    "browse",
    f"""SELECT e.id, e.degree, count(b.id) AS neighbors FROM {ENTITY} e LEFT JOIN {_BOTH} b ON b.node = e.id GROUP BY e.id, e.degree""",
)
def _(spark, d):
    near = graph.directed(graph.live_edges(_relations(spark, d))).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("neighbors"))
    return _entities(spark, d).select("id", "degree").join(near, "id", "left").na.fill(0, ["neighbors"])


# --- measures -----------------------------------------------------------------------------------------------------

_FOUND = f"(SELECT c.source_id AS qid, row_number() OVER (PARTITION BY c.source_id ORDER BY ordinal, c.id)::INTEGER AS rank, c.text FROM {CHUNK} c WHERE text IS NOT NULL)"
_GOLD = f"(SELECT DISTINCT c.source_id AS qid, e.id AS grp, e.name AS alias FROM {MENTION} m JOIN {CHUNK} c ON c.id = m.chunk_id JOIN {ENTITY} e ON e.id = m.entity_id)"


def _found(spark, d):
    order = W.partitionBy("source_id").orderBy("ordinal", "id")
    rows = _chunks(spark, d, "id", "source_id", "ordinal", "text").where("text IS NOT NULL")
    ranks = rows.select("id", F.col("source_id").alias("qid"), F.row_number().over(order).alias("rank"))  # ids are ordered, texts aren't
    return ranks.join(rows.select("id", "text"), "id").select("qid", "rank", "text")


def _gold(spark, d):
    of = _chunks(spark, d, "id", "source_id").select(F.col("id").alias("chunk_id"), F.col("source_id").alias("qid"))
    pairs = _mentions(spark, d).join(of, "chunk_id").select("qid", F.col("entity_id").alias("grp")).distinct()
    return pairs.join(_entities(spark, d).select(F.col("id").alias("grp"), F.col("name").alias("alias")), "grp")


@query("metric_entity_hit", f"SELECT qid, round(avg(hit::INTEGER), 9) AS entity_hit FROM (SELECT g.qid, g.grp, coalesce(max(contains(lower(f.text), lower(g.alias))), FALSE) AS hit FROM {_GOLD} g LEFT JOIN {_FOUND} f ON f.qid = g.qid AND f.rank <= 5 GROUP BY 1, 2) GROUP BY qid")
def _(spark, d):
    return metrics.entity_hit(_found(spark, d), _gold(spark, d)).select("qid", F.round("entity_hit", 9).alias("entity_hit"))


@query("metric_coverage", f"SELECT qid, round(avg(hit::INTEGER), 9) AS coverage FROM (SELECT g.qid, g.grp, coalesce(max(contains(lower(f.text), lower(g.alias))), FALSE) AS hit FROM {_GOLD} g LEFT JOIN {_FOUND} f ON f.qid = g.qid GROUP BY 1, 2) GROUP BY qid")
def _(spark, d):
    return metrics.coverage(_found(spark, d), _gold(spark, d)).select("qid", F.round("coverage", 9).alias("coverage"))


_NAMED_PAIRS = f"(SELECT DISTINCT c.source_id AS qid, s.name AS s, o.name AS o FROM {EVIDENCE} v JOIN {CHUNK} c ON c.id = v.chunk_id JOIN {RELATION} r ON r.id = v.relation_id JOIN {ENTITY} s ON s.id = r.src_id JOIN {ENTITY} o ON o.id = r.dst_id)"


@query("metric_relation_recall", f"SELECT qid, round(avg(hit::INTEGER), 9) AS relation_recall FROM (SELECT g.qid, g.s, g.o, coalesce(max(contains(lower(f.text), lower(g.s)) AND contains(lower(f.text), lower(g.o))), FALSE) AS hit FROM {_NAMED_PAIRS} g LEFT JOIN {_FOUND} f ON f.qid = g.qid GROUP BY 1, 2, 3) GROUP BY qid")
def _(spark, d):
    names = _entities(spark, d).select("id", "name")
    of = _chunks(spark, d, "id", "source_id").select(F.col("id").alias("chunk_id"), F.col("source_id").alias("qid"))
    pairs = _evidence(spark, d).join(of, "chunk_id").select("qid", "relation_id").distinct().join(_relations(spark, d).select(F.col("id").alias("relation_id"), "src_id", "dst_id"), "relation_id")
    golden = pairs.join(names.toDF("src_id", "s"), "src_id").join(names.toDF("dst_id", "o"), "dst_id").select("qid", "s", "o").distinct()
    return metrics.relation_recall(_found(spark, d), golden).select("qid", F.round("relation_recall", 9).alias("relation_recall"))


_RANKED = f"(SELECT community_id AS qid, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, id) AS rank, name FROM {ENTITY} WHERE community_id IS NOT NULL)"


@query("metric_mrr", f"SELECT qid, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0 END), 9) AS mrr FROM (SELECT g.qid, g.grp, min(r.rank) AS r FROM (SELECT community_id AS qid, id AS grp, name AS alias FROM {ENTITY} WHERE community_id IS NOT NULL) g LEFT JOIN {_RANKED} r ON r.qid = g.qid AND lower(trim(r.name)) = lower(trim(g.alias)) GROUP BY 1, 2) GROUP BY qid")
def _(spark, d):
    inside = _entities(spark, d).where("community_id IS NOT NULL")
    ranked = inside.select(F.col("community_id").alias("qid"), F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("degree"), "id")).alias("rank"), "name")
    golden = inside.select(F.col("community_id").alias("qid"), F.col("id").alias("grp"), F.col("name").alias("alias"))
    return metrics.reciprocal_rank(ranked, golden).select("qid", F.round("mrr", 9).alias("mrr"))


@query(
    "metric_precision_recall",
    f"""WITH a AS (SELECT DISTINCT src_id AS qid, dst_id AS item FROM {RELATION} WHERE weight >= 2), b AS (SELECT DISTINCT src_id AS qid, dst_id AS item FROM {RELATION} WHERE confidence >= 0.7),
    c AS (SELECT coalesce(a.qid, b.qid) AS qid, count(a.item) AS n, count(b.item) AS m, count(a.item + b.item) AS k FROM a FULL JOIN b ON a.qid = b.qid AND a.item = b.item GROUP BY 1),
    d AS (SELECT qid, coalesce(k / nullif(n, 0), 0) AS p, coalesce(k / nullif(m, 0), 1) AS r FROM c)
    SELECT qid, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM d""",
)
def _(spark, d):
    rows = _relations(spark, d)
    pairs = lambda c: rows.where(c).select(F.col("src_id").alias("qid"), F.col("dst_id").alias("item"))
    out = metrics.precision_recall(pairs("weight >= 2"), pairs("confidence >= 0.7"))
    return out.select("qid", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("metric_percentile", f"SELECT type, list_sort(list(weight))[least(len(list(weight)), floor(0.5 * len(list(weight)))::INTEGER + 1)] AS p50, list_sort(list(weight))[least(len(list(weight)), floor(0.95 * len(list(weight)))::INTEGER + 1)] AS p95 FROM {RELATION} GROUP BY type")
def _(spark, d):
    return metrics.percentiles(_relations(spark, d), "type", "weight", {"p50": 50, "p95": 95})


# --- streams ------------------------------------------------------------------------------------------------------


@query("event_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return ingest.event_counts(read_table(spark, d, "events", ["ts", "event_type"]))
