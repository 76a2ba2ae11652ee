"""Turning raw model output into validated entities, relations and mentions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions.text import strip_fences
from sparkweft.functions.vocabulary import ENTITY_TYPES, RELATION_TYPES
from sparkweft.operators.lexical import names_in_texts
from sparkweft.operators.models import IDLE_SECONDS, TOTAL_SECONDS, braces, within
from sparkweft.sources.tables import once_per_key, with_keys, written

_ENTITY, _RELATION = "struct<n:string,t:string,d:string,c:double>", "struct<s:string,r:string,o:string,d:string,c:double>"
#: Given a chunk's text and path, the raw answer of a model. Anything callable will do; tests use rules.
Completer = Callable[[str, str], str]


def _kind(item: Column, field: str) -> Column:
    """The type of a field as JSON has it: null where it is missing, VOID where it is null."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))


def _spelled(item: Column, field: str, empty: bool = False) -> Column:
    """Whether a field is a string, and not an empty one unless that will do."""
    said = F.coalesce(_kind(item, field) == "STRING", F.lit(False))
    return said if empty else said & (F.length(F.try_variant_get(item, f"$.{field}", "string")) > 0)


def _formed(item: Column, names: tuple[str, ...], kind: str) -> Column:
    note = F.coalesce(_kind(item, "d").isin("STRING", "VOID"), F.lit(True))
    sure = F.coalesce(_kind(item, "c").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    formed = _spelled(item, kind, empty=True) & note & sure
    for name in names:
        formed = formed & _spelled(item, name)
    return formed


def _list(answer: Column, field: str) -> Column:
    """The items of a list, none where it is missing, null where it is no list."""
    return F.when(_kind(answer, field).isNull(), F.expr("cast(array() as array<variant>)")).otherwise(F.try_variant_get(answer, f"$.{field}", "array<variant>"))


def _read(item: Column, fields: tuple[str, ...]) -> Column:
    return F.struct(*(F.try_variant_get(item, f"$.{f}", "double" if f == "c" else "string").alias(f) for f in fields))


def _sure(c: Column, least: float) -> Column:
    return F.coalesce((c > 0) & (c <= 1) & (c >= least) & ~F.isnan(c), F.lit(False))


def good_entities(items: Column, least: float) -> Column:
    return F.filter(items["entities"], lambda e: (F.length(e["n"]) > 0) & F.coalesce(e["t"].isin(ENTITY_TYPES), F.lit(False)) & _sure(e["c"], least))


def good_relations(items: Column, least: float) -> Column:
    return F.filter(items["relations"], lambda r: (F.length(r["s"]) > 0) & (F.length(r["o"]) > 0) & F.coalesce(r["r"].isin(RELATION_TYPES), F.lit(False)) & _sure(r["c"], least))


def validate_output(answers: DataFrame, raw: str, least: float = 0.6) -> DataFrame:
    """The rows of ``answers`` with ``entities``, ``relations``, ``dropped`` (items of other types or confidences) and
    ``outcome``: ok, PARSE_FAILED (no JSON, or nothing left of what was there) or EMPTY (JSON with nothing in it, or not of
    the shape asked for, of which nothing is taken)."""
    body = strip_fences(F.col(raw))
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1  # nothing but blanks follows
    rows = answers.withColumn("_json", F.when(whole, F.try_parse_json(body)))
    answer = F.col("_json")
    rows = rows.withColumn("_e", _list(answer, "entities")).withColumn("_r", _list(answer, "relations"))
    formed = F.col("_e").isNotNull() & F.col("_r").isNotNull() & F.schema_of_variant(answer).startswith("OBJECT")
    formed = formed & F.forall("_e", lambda e: _formed(e, ("n",), "t")) & F.forall("_r", lambda r: _formed(r, ("s", "o"), "r"))
    items = F.struct(F.transform("_e", lambda e: _read(e, ("n", "t", "d", "c"))).alias("entities"), F.transform("_r", lambda r: _read(r, ("s", "r", "o", "d", "c"))).alias("relations"))
    rows = rows.withColumn("_items", F.when(F.coalesce(formed, F.lit(False)), items))
    rows = rows.withColumn("entities", F.coalesce(good_entities(F.col("_items"), least), F.expr(f"cast(array() as array<{_ENTITY}>)")))
    rows = rows.withColumn("relations", F.coalesce(good_relations(F.col("_items"), least), F.expr(f"cast(array() as array<{_RELATION}>)")))
    every = F.coalesce(F.size("_items.entities") + F.size("_items.relations"), F.lit(0))
    kept = F.size("entities") + F.size("relations")
    rows = rows.withColumn("dropped", F.greatest(every, F.lit(0)) - kept)
    outcome = F.when(F.col("_json").isNull(), "PARSE_FAILED").when(kept > 0, "ok").when(F.col("dropped") > 0, "PARSE_FAILED").otherwise("EMPTY")
    return rows.withColumn("outcome", outcome).drop("_items", "_json", "_e", "_r")


def complete_chunks(chunks: DataFrame, completer: Completer, repairs: int = 1, retries: int = 3, delay: float = 0.5, idle: float = IDLE_SECONDS, total: float = TOTAL_SECONDS) -> DataFrame:
    """``(chunk_id, raw, calls, error)``: the model's answer for each chunk, asked where the chunk is.

    An answer that is no JSON is asked for again up to ``repairs`` times, with the error if the completer has a ``repair``.
    A RATE_LIMIT is waited out, twice as long each time; CONTEXT_WINDOW halves the text at the line end nearest its middle,
    once; an answer that stalls for ``idle`` seconds or isn't whole after ``total`` is a TIMEOUT. Errors are rows.
    """

    def ask(text: str, path: str) -> tuple[str | None, int, str | None]:
        calls, tried, waited, call = 0, 0, 0, lambda: completer(text, path)
        while True:
            try:
                raw = within(call, idle, total)
                calls += 1
                try:
                    json.loads(braces(raw))
                    return raw, calls, None
                except ValueError as e:
                    if tried >= repairs:
                        return raw, calls, "PARSE_FAILED"
                    tried, wrong, error = tried + 1, raw, str(e)
                    if hasattr(completer, "repair"):
                        call = lambda: completer.repair(wrong, error)
            except Exception as e:  # noqa: BLE001
                code = getattr(e, "code", "LLM_ERROR")
                if code == "RATE_LIMIT" and waited < retries:
                    time.sleep(delay * 2**waited)
                    waited += 1
                    continue
                return None, calls, code

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, path, text in zip(pdf["id"], pdf["path"], pdf["text"]):
                raw, calls, error = ask(text or "", path or "")
                if error == "CONTEXT_WINDOW":
                    for half in halves(text or ""):
                        raw, more, error = ask(half, path or "")
                        calls += more
                        rows.append((i, raw, calls, error))
                        calls = 0
                else:
                    rows.append((i, raw, calls, error))
            yield pd.DataFrame(rows, columns=["chunk_id", "raw", "calls", "error"])

    return chunks.select("id", "path", "text").mapInPandas(run, "chunk_id long, raw string, calls int, error string")


def halves(text: str) -> list[str]:
    """The text cut behind the line feed nearest its middle (at the middle if there is none), whole if that is an edge."""
    middle = len(text) // 2
    left, right = text.rfind("\n", 0, middle + 1), text.find("\n", middle)
    at = min((abs(p - middle), p) for p in (left, right) if p >= 0)[1] + 1 if max(left, right) >= 0 else middle
    return [text[:at], text[at:]] if 0 < at < len(text) else [text]


def occurrences(text: Column, name: Column) -> Column:
    """Offsets of all occurrences of a name in a text, both lower-cased, that don't overlap.

    The text between them is what splitting by the name leaves, so offsets are running sums of lengths; no Python.
    """
    parts = F.call_function("split", text, F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    walked = F.aggregate(parts, start, lambda a, p: F.struct((a["at"] + F.length(p) + F.length(name)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found")))
    return F.slice(walked["found"], 1, F.size(parts) - 1)


def compute_mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``(chunk_id, entity_id, span_start, span_end)``: every occurrence in a chunk's text of the names ``(chunk_id,
    entity_id, name)`` found in that chunk. Each text is lower-cased once, before it meets its names, and it meets them all
    at once, so it isn't copied for each."""
    ids = names.select("chunk_id").distinct()
    texts = with_keys(chunks.select(F.col("id").alias("chunk_id"), "text").where("text IS NOT NULL"), "chunk_id", ids)
    texts = once_per_key(texts, "chunk_id").select("chunk_id", F.lower("text").alias("text"))
    pairs = names.select("chunk_id", "entity_id", F.lower("name").alias("name")).where("length(name) > 0").distinct()
    listed = pairs.groupBy("chunk_id").agg(F.collect_list(F.struct("entity_id", "name")).alias("names"))  # names of one chunk
    rows = listed.join(texts, "chunk_id")
    found = rows.select("chunk_id", F.explode(F.transform("names", lambda n: F.struct(n["entity_id"].alias("entity_id"), F.length(n["name"]).alias("size"), occurrences(F.col("text"), n["name"]).alias("at")))).alias("n"))
    spans = found.select("chunk_id", "n.entity_id", "n.size", F.explode("n.at").alias("span_start"))
    return spans.select("chunk_id", "entity_id", "span_start", (F.col("span_start") + F.col("size")).alias("span_end"))


def assign_precomputed(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items known for a whole source, given to its chunks: an entity ``(source_id, name)`` to every chunk that contains
    its name, a relation ``(source_id, rel_id, s, o)`` to the first chunk that contains either end."""
    texts = chunks.select(F.col("source_id").alias("grp"), "id", "text").where("text IS NOT NULL")
    ends = relations.select("source_id", "rel_id", F.explode(F.array("s", "o")).alias("name")).distinct()
    names = entities.select("source_id", "name").unionByName(ends.select("source_id", "name")).withColumnRenamed("source_id", "grp")
    met = written(names_in_texts(texts, names), "names").withColumnsRenamed({"grp": "source_id", "id": "chunk_id"})
    found = met.join(entities.select("source_id", "name").distinct(), ["source_id", "name"], "left_semi").select("chunk_id", "name")
    order = chunks.select(F.col("id").alias("chunk_id"), "ordinal").distinct()
    at = met.join(order, "chunk_id").groupBy("source_id", "name").agg(F.min(F.struct("ordinal", "chunk_id")).alias("at"))
    first = at.join(ends, ["source_id", "name"]).groupBy("source_id", "rel_id").agg(F.min("at")["chunk_id"].alias("chunk_id"))  # of either end's first
    return found, first.select("chunk_id", "rel_id")
