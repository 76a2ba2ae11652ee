"""Files that nobody wrote by hand: tool-made, minified, vendored, and data saved as code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.sources.tables import written

_SLICE = 512
#: Java expressions over a path, in the order in which they decide. Folders and endings that tools and
#: package managers use by convention.
PATH_RULES = [
    ("generated", r"(?i)(^|/)(package-lock\.json|[\w.-]*-lock\.(json|yaml|yml)|[\w.-]+\.lock|lockfile|go\.sum|npm-shrinkwrap\.json)$"),
    ("vendored", r"(?i)(^|/)(_?vendor|vendored|third[_-]?party|node_modules|bower_components|external|externals|deps|site-packages|\.yarn|pods|carthage)/"),
    ("generated", r"(?i)(^|/)(__generated__|_?generated|gen|autogen|codegen|codegen-out|generated-src|\.generated)/|\.(generated|g|designer|pb|pb2|gen|freezed)\.\w+$|(_pb2(_grpc)?|_generated)\.\w+$|\.pb\.(go|cc|h)$"),
    ("minified", r"(?i)\.(min|bundle|chunk)\.(js|mjs|css)$|(^|/)dist/[^\n]*\.(js|mjs|cjs|css)$|(^|/)build/(assets|static)/|\.map$"),
]
_PROSE_NAME = r"\.(md|markdown|txt|rst|log|adoc|html?)$"
_PROSE = re.compile(rf"(?i){_PROSE_NAME}")
#: Formats whose lines are alike although people write them.
_LIST_NAME = r"\.(json|ya?ml|toml|ini|cfg|conf|env|properties|sql|csv|tsv|xml)$"
_COMMENT = re.compile(r"""^\s*(?:///?!?|\#+!?|/\*+!?|\*+(?!/)|--+|;+|<!--|\"{3}|'{3}|%+|REM\b)\s*(?P<said>.*?)\s*(?:\*/|-->|\"{3}|'{3})?\s*$""")
_THIS = r"\bthis (?:file|module|code|class|header|script|document|page|package|schema|source|stylesheet|table|list|output)\b"
_MADE = re.compile(
    rf"(?i)@generated\b(?! (?:marks?|markers?|files?|code|headers?|tags?|annotations?|lines?|comments?)\b)|^</?auto-?generated|^auto-?generated\b|\bcode generated (?:by|from|with)\b|^(?:generated|produced|emitted|rendered|compiled|exported) (?:by|from|with|using|via)\b"
    rf"|\b(?:auto|automatically|machine)[- ]?(?:generated|produced|made|written|created|built|exported|derived)\b|\b(?:generated|produced|created|written|built|exported|derived) automatically\b"
    rf"|{_THIS}.{{0,40}}\b(?:generated|produced|emitted|rendered|compiled|exported|derived) (?:by|from|with|using|via)\b"
    rf"|\b(?:edits?|changes?|modifications?)\b[^.;]{{0,30}}\b(?:lost|overwritten|discarded|thrown away)\b|\b(?:do not|don't|never) (?:edit|modify|change|touch)(?: (?:this file|it|by hand|manually|directly))?[.!]*$"
    r"|自动生成|自動生成|automatisch (?:erzeugt|generiert|erstellt)|généré automatiquement|generado autom|gerado autom|сгенерирован|создан автоматически|自動的に生成"
)
_TAKEN = re.compile(
    r"(?i)^(?:vendored|copied|imported|taken|mirrored|synced|extracted|forked)(?:[, ]+(?:over|verbatim|unchanged|unmodified|as[- ]is|in))* from\b|\b(?:unmodified|verbatim|unchanged|exact|pristine|untouched) (?:copy|snapshot|import|clone|mirror)(?:[^.]{0,20})? of\b"
    r"|\bcopied (?:over |verbatim |unchanged |as[- ]is )*from\b|\bcopyright\b.*\b(?:contributors|authors|developers)\b|\(c\) the .* authors\b|^@licen[cs]e\b|\btaken over (?:as[- ]is|unchanged|verbatim)\b|\bbundled (?:so|here|copy|with|from|for|to|in)\b"
    r"|\bupstream(?: (?:commit|version|revision|tag|release|project|repository|source)\b|:)|^third[- ]party\b"
)
#: What the file itself isn't: speech in quotes, denials, and talk of such files.
_QUOTED_TALK = re.compile(r"[\"“][^\"”]*[\"”]|[`‘][^`’]*[`’]")
_BY_HAND = re.compile(r"(?i)\bby hand[.!]?$|\bhand-?(?:written|made|edited)\b|\b(?:not|never|no longer|isn't|aren't|without being) (?:vendored|generated|copied|bundled|auto-?generated)\b|\bfrom scratch\b|\bhelpers? (?:for|that)\b|\b(?:reads?|skips?|finds?|detects?|ignores?|strips?|checks?|lists?|writes?|emits?|adds?|puts?|removes?|parses?|handles?)\b.{0,30}@generated\b|\bskips? (?:them|it|such)\b")
_DATA_LINE = re.compile(
    r"""^[\s"'`(\[{]*(?:data:[\w/.+-]+;base64,)?[A-Za-z0-9+/=_-]{48,}["'`)\]},;+\s\\]*$|^[\s\d.,+eExXa-fA-F()\[\]{}:;"'_-]*\d[\s\d.,+eExXa-fA-F()\[\]{}:;"'_-]*$|^\s*["']?[\w.-]+["']?\s*[:=]\s*[\[({](?:\s*(?:-?[\d.]+|["'][^"']*["'])\s*,?){2,}\s*[\])}],?$|[A-Za-z0-9+/]{200,}"""
)
_ATOM = re.compile(r"[^\W]+")
_STRING = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`""")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
GRAM, WINDOW = 12, 8


#: Comments of prose, where other signs mean headings and lists: HTML's, those of reStructuredText and of AsciiDoc.
_PROSE_COMMENT = re.compile(r"^\s*(?:<!--|\.\.(?=\s)|//(?!/))\s*(?P<said>.*?)\s*(?:-->)?\s*$")
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
_INSIDE = re.compile(r"^(?P<said>.*?)\s*(?:\*/|-->|\"{3}|'{3})?$")
_PREAMBLE = re.compile(r"(?i)^\s*(?:#!|<\?|<!doctype\b|['\"]use strict['\"])")


def header_says(text: str, lines: int = 10, prose: bool = False) -> str:
    """What the comments at the top say: ``generated``, ``vendored`` or nothing. Strings and talk about such files don't count.

    The top is the first ``lines`` lines, and the comment block that the text begins with however long it is.
    """
    said, leading, close, at = "", True, "", 0
    comment = _PROSE_COMMENT if prose else _COMMENT
    while at <= len(text) and (leading or lines > 0):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, at, lines = text[at:end], end + 1, lines - 1
        bare, m = line.strip(), comment.match(line)
        if close:
            inner, close = bare, "" if close in bare else close
            m = m or leading and _INSIDE.match(inner)
        elif m:
            opened = next((x for x in _BLOCKS if bare.startswith(x[0])), None)
            close = opened[1] if opened and opened[1] not in bare[len(opened[0]) :] else ""
        elif bare and not _PREAMBLE.match(line):
            leading = False
        if not m or _BY_HAND.search(m["said"]):
            continue
        claim = _QUOTED_TALK.sub("", m["said"])
        if _MADE.search(claim):
            return "generated"
        if not said and (_TAKEN.search(claim) or line.lstrip().startswith("/*!")):
            said = "vendored"
    return said


def line_facts(text: str) -> tuple[int, int, int, int, int]:
    """Characters in all, in lines too long to be written, in literal data, and lines in all and of the two commonest shapes."""
    chars = long = data = lines = 0
    shapes: Counter[str] = Counter()
    for line in text.split("\n"):
        if len(line) < 3 or line.isspace():
            continue
        n = len(line)
        chars += n
        lines += 1
        if _DATA_LINE.search(line):
            data += n
        elif n > 250:
            long += n
        shapes[_ATOM.sub("w", _STRING.sub("s", line)).strip()] += 1
    return chars, long, data, lines, sum(c for _, c in shapes.most_common(2))


_CODES: dict[str, int] = {}
_KEPT_CODES = 500_000


def winnow(text: str) -> np.ndarray:
    """Fingerprints of the normalised token stream: comments and blanks gone, numbers and strings alike, letter case kept
    out; of each window of hashed token runs the least."""
    kept = "\n".join(x for x in text.split("\n") if not _COMMENT.match(x))
    tokens = _TOKEN.findall(_STRING.sub(' "" ', kept).lower())
    if len(tokens) < GRAM:
        return np.array([], np.uint64)
    if len(_CODES) > _KEPT_CODES:
        _CODES.clear()
    for t in set(tokens).difference(_CODES):
        _CODES[t] = 7 if t[0].isdigit() else xxhash.xxh3_64_intdigest(t)
    codes = np.array([_CODES[t] for t in tokens], np.uint64)
    runs = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for n in range(GRAM):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[n : n + len(runs)]
    runs ^= runs >> np.uint64(31)
    if len(runs) <= WINDOW:
        return np.array([runs.min()])
    return np.unique(np.lib.stride_tricks.sliding_window_view(runs, WINDOW).min(axis=1))


_FACTS = "source_id long, id long, header string, note string, chars long, long long, data long, lines long, alike long, prints array<long>"


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """A row of facts per chunk that has a text: what its head comment says if it is code (``header``) or prose
    (``note``), its fingerprints, and the measures of its lines, which a chunk whose path tells it to be prose lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                out = []
                for source, i, path, first, text in zip(*(c.to_pylist() for c in whole.slice(at, _SLICE).columns)):
                    header, note = (header_says(text), header_says(text, prose=True)) if first else ("", "")
                    measures = (0, 0, 0, 0, 0) if path and _PROSE.search(path) else line_facts(text)
                    out.append((source, i, header, note, *measures, winnow(text).view(np.int64)))
                columns = list(zip(*out)) or [()] * 10
                lists = pa.array([x.tolist() for x in columns[9]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string() if n in (2, 3) else pa.int64()) for n, c in enumerate(columns[:9])), lists], [f.split(" ")[0] for f in _FACTS.split(", ")])

    first = F.coalesce(F.col("ordinal") == 0, F.lit(False))
    rows = chunks.select(F.col("source_id").cast("long"), F.col("id").cast("long"), "path", first.alias("first"), "text").where("source_id IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, _FACTS)


def recurring_share(facts: DataFrame, files: DataFrame, least: Column) -> DataFrame:
    """``(source_id, prints, recurring)``: how many distinct fingerprints a file has, over all its chunks, and how many of
    them occur in at least so many repositories (null if none).

    Fingerprints of a single file, which are nearly all, are dropped where one shuffle brings equal ones together; what is
    left is counted by repository, and the totals are summed up before they are moved.
    """
    prints = facts.select("source_id", F.explode("prints").alias("print")).repartition("print").distinct()
    within = W.partitionBy("print")
    shared = prints.withColumn("a", F.min("source_id").over(within)).withColumn("b", F.max("source_id").over(within)).where("a <> b").select("source_id", "print")
    rest = written(shared.join(files.select("source_id", "repository"), "source_id"), "shared-prints")
    wide = rest.groupBy("print", "repository").agg(F.lit(1).alias("one")).groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("print")
    recurring = rest.join(wide, "print", "left_semi").groupBy("source_id").agg(F.count("*").alias("recurring"))
    return prints.groupBy("source_id").agg(F.count("*").alias("prints")).join(recurring, "source_id", "left")


def file_origins(sources: DataFrame, chunks: DataFrame, file_facts: DataFrame | None = None, repositories: int | None = None, markers: bool = True) -> DataFrame:
    """``(path, origin, size_bytes)`` of every path of ``sources``: ``generated`` (lock files too), ``minified``,
    ``vendored``, ``data`` or ``hand-written``.

    Winnowed fingerprints of the normalised token streams decide first: a file most of whose fingerprints recur in at
    least ``repositories`` repositories (what is left of ``abs_path`` without ``path``; unset: three quarters of those
    there are, at least 3 and at most 6) is a vendored copy. A copy that is the only one in the collection can't show
    itself so; then marks decide, as far as there are any and ``markers`` isn't off: a path by which tools and package
    managers mark what they write, and the comment at the top. Last comes the content: literal data, long lines, or
    two line shapes only.

    Defined cases: a path without chunks or with null or empty texts is judged by its path alone; a null path has no row;
    repeated rows count once; ``size_bytes`` is that of the latest scan in ``file_facts`` (null if none). A file with a
    third of all chunks is summed up before it is shuffled, and no file is gathered into one row.
    """
    files = sources.where("id IS NOT NULL AND path IS NOT NULL").groupBy(F.col("id").cast("long").alias("source_id")).agg(F.max("path").alias("path"), F.max("abs_path").alias("abs_path"))
    root = F.expr("CASE WHEN endswith(abs_path, path) THEN left(abs_path, length(abs_path) - length(path)) ELSE regexp_extract(abs_path, '^(/[^/]+){0,3}', 0) END")
    files = files.withColumn("repository", F.coalesce(root, F.lit("")))
    if repositories is None:
        known = files.agg(F.count_distinct("repository")).first()[0]
        repositories = min(6, max(3, -(-3 * known // 4)))
    facts = written(chunk_facts(chunks), "file-facts")
    once = facts.select("source_id", "id", "header", "note", "chars", "long", "data", "lines", "alike").distinct()
    sums = once.groupBy("source_id").agg(F.max("header").alias("header"), F.max("note").alias("note"), *(F.sum(c).alias(c) for c in ("chars", "long", "data", "lines", "alike")))
    judged = files.join(sums, "source_id", "left").join(recurring_share(facts, files, F.lit(repositories)), "source_id", "left")
    by_copies = F.when((F.col("prints") >= 8) & (F.col("recurring") >= 0.7 * F.col("prints")), "vendored")
    by_path = F.coalesce(*(F.when(F.col("path").rlike(rule), F.lit(origin)) for origin, rule in PATH_RULES))
    prose, lists = (F.col("path").rlike(f"(?i){kind}") for kind in (_PROSE_NAME, _LIST_NAME))
    header = F.when(prose & ~F.col("path").rlike(r"(?i)\.(txt|log)$"), F.col("note")).otherwise(F.col("header"))
    by_content = F.when(prose | lists, F.lit(None).cast("string")).otherwise(
        F.when(F.col("data") >= 0.6 * F.col("chars"), "data")
        .when(F.col("long") + F.col("data") >= 0.6 * F.col("chars"), "minified")
        .when((F.col("lines") >= 10) & (F.col("alike") >= 0.85 * F.col("lines")), "generated")
    )
    marked = [by_path, F.when(header != "", header)] if markers else []
    origin = F.coalesce(by_copies, *marked, by_content, F.lit("hand-written"))
    out = judged.select("path", origin.alias("origin")).groupBy("path").agg(F.min("origin").alias("origin"))
    if file_facts is None:
        return out.withColumn("size_bytes", F.lit(None).cast("long"))
    latest = file_facts.where("path IS NOT NULL").groupBy(F.regexp_replace("path", r"^(\./+)+", "").alias("path"))
    latest = latest.agg(F.max(F.struct("snapshot_no", "scanned_at", "size_bytes")).alias("x")).select("path", F.col("x.size_bytes").alias("size_bytes"))
    return out.join(latest, "path", "left")
