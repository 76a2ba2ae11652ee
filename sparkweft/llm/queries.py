"""Queries of the training-data operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import bpe, credentials, distinctive, lookalike, mixing, neardup, pii, provenance, splitting
from sparkweft.sources.tables import read_table

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


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(read_table(spark, d, "chunks", ["id", "text"], spread=True))


@query("p1_redacted")
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_texts(read_table(spark, d, "chunks", ["id", "text"], spread=True))


_NEAR = {"threshold": 0.7, "shingle": 3, "least_words": 20}


_SIMILAR = r"""c AS (SELECT id, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id),
    w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
    s AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    k AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT a, b, k = x.n AND k = y.n AS same FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.7 * (x.n + y.n - k))"""


@query("p2_found", f"WITH {_SIMILAR} SELECT a AS chunk_id_a, b AS chunk_id_b FROM p")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = neardup.similar_classes(read_table(spark, d, "chunks", ["id", "text"], spread=True), **_NEAR)
    return neardup.similar_pairs(pairs, members, expand=None).toDF("chunk_id_a", "chunk_id_b")


@query(
    "p2_groups",
    f"""WITH RECURSIVE {_SIMILAR}, q AS MATERIALIZED (SELECT c.id, coalesce(min(a), c.id) AS class FROM c LEFT JOIN p ON p.b = c.id AND p.same GROUP BY c.id),
    m AS (SELECT class, count(*) AS copies FROM q GROUP BY class),
    e AS MATERIALIZED (SELECT DISTINCT x.class AS a, y.class AS b FROM p JOIN q x ON x.id = p.a JOIN q y ON y.id = p.b WHERE x.class <> y.class UNION SELECT DISTINCT y.class, x.class FROM p JOIN q x ON x.id = p.a JOIN q y ON y.id = p.b WHERE x.class <> y.class),
    l AS (SELECT a AS class, count(*) AS links FROM e GROUP BY a),
    r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
    g AS (SELECT id, min(root) AS root FROM r GROUP BY id)
    SELECT q.id AS chunk_id, coalesce(root, q.class) AS group_id, copies, coalesce(links, 0) AS links FROM q JOIN m ON m.class = q.class LEFT JOIN l ON l.class = q.class LEFT JOIN g ON g.id = q.class""",
)
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(read_table(spark, d, "chunks", ["id", "text"], spread=True), **_NEAR).withColumnRenamed("id", "chunk_id")


def _origins(spark: SparkSession, d: str) -> DataFrame:
    chunks = read_table(spark, d, "chunks", ["id", "source_id", "path", "ordinal", "text"], spread=True)
    scans = read_table(spark, d, "file_facts", ["snapshot_no", "scanned_at", "path", "size_bytes"])
    return provenance.file_origins(read_table(spark, d, "sources", ["id", "path", "abs_path"]), chunks, scans)


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).where("origin <> 'hand-written'").select("path")


@query("p3_origins")
def p3_origins(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d)


_BLANK = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_HAN = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}]"


@query(
    "p4_found",
    f"""
    WITH t AS (SELECT DISTINCT id, regexp_replace(text, '{_BLANK}', '', 'g') AS solid FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT id, length(solid) AS every, length(regexp_replace(solid, '{_HAN}', '', 'g')) AS other FROM t)
    SELECT DISTINCT id AS chunk_id FROM c WHERE ceil((every - other) + other / 3.5) > 1400
    """,
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read_table(spark, d, "chunks", ["id", "start_line", "text"], spread=True))


@query("p4_pieces")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, d, "chunks", ["id", "start_line", "text"], spread=True))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking(read_table(spark, d, "entities", ["id", "name"]), expand=None).toDF("entity_id_a", "entity_id_b")


@query("p5_groups")
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_groups(read_table(spark, d, "entities", ["id", "name"])).withColumnRenamed("id", "entity_id")


@query("p5_names")
def p5_names(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(read_table(spark, d, "entities", ["id", "name", "norm_name"]).distinct(), "name", "norm_name")


@query("p5_texts")
def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(read_table(spark, d, "chunks", ["id", "text"], spread=True), "text")


@query(
    "p7_found",
    r"""
    WITH c AS (SELECT id, max(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id),
    w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS term FROM c),
    t AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
    d AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM t GROUP BY term),
    n AS (SELECT count(*) AS chunks FROM c), z AS (SELECT sum(tf) AS terms FROM t),
    l AS (SELECT id, sum(tf) AS length FROM t WHERE id IN (SELECT chunk_id FROM term_probe) GROUP BY id),
    s AS (SELECT id, term, tf, df, ctf, length, terms, chunks, tf * ln(chunks / df) AS v,
                 ctf - tf AS b, length - tf AS c, terms - ctf - length + tf AS e
          FROM t JOIN d USING (term) JOIN l USING (id), n, z),
    g AS (SELECT *, 2 * (tf * ln(tf * terms / (ctf * length)) + CASE WHEN b > 0 THEN b * ln(b * terms / (ctf * (terms - length))) ELSE 0 END
                       + CASE WHEN c > 0 THEN c * ln(c * terms / ((terms - ctf) * length)) ELSE 0 END
                       + CASE WHEN e > 0 THEN e * ln(e * terms / ((terms - ctf) * (terms - length))) ELSE 0 END)
                    * CASE WHEN tf * terms >= ctf * length THEN 1 ELSE -1 END AS llr FROM s)
    SELECT id AS chunk_id, term FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, round(llr, 9) DESC, term) AS k FROM g) WHERE k = 1
    """,
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.term_scores(read_table(spark, d, "chunks", ["id", "text"], spread=True), read_table(spark, d, "term_probe"))
    return distinctive.most_typical(scores)


@query("p7_scores")
def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(read_table(spark, d, "chunks", ["id", "text"], spread=True))


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(read_table(spark, d, "documents", ["doc_id", "text"], spread=True))


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, d, "documents", ["doc_id", "source", "text"], spread=True), read_table(spark, d, "mix_target"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, d, "documents", ["doc_id", "source", "text"], spread=True), read_table(spark, d, "mix_target"))


@query("p9_shares_full")
def p9_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as the sources have: caps bind, and the report shows what falls short."""
    return mixing.mix_report(read_table(spark, d, "documents", ["doc_id", "source", "text"], spread=True), read_table(spark, d, "mix_target"), fill=True)


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_lines(read_table(spark, d, "documents", ["doc_id", "text"], spread=True), pii.known_names(read_table(spark, d, "name_ref")))


@query("p10_texts")
def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return pii.anonymised(read_table(spark, d, "documents", ["doc_id", "text"], spread=True), pii.known_names(read_table(spark, d, "name_ref")))
