"""Cutting documents into line-addressed chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

_BLANK = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff]")
_SOLID = re.compile(f"[^{_BLANK}]")
_HEADING = re.compile(f"#{{1,6}}[{_BLANK}]")


class Block(NamedTuple):
    first: int
    lines: list[str]


class Chunk(NamedTuple):
    ordinal: int
    start_line: int
    end_line: int
    start_col: int
    end_col: int
    text: str
    token_est: int


def tokens(text: str) -> int:
    """One per CJK character and one per 3.5 others that aren't blank, rounded up."""
    han = len(_HAN.findall(text))
    return math.ceil(han + (len(_SOLID.findall(text)) - han) / 3.5)


def blocks(text: str) -> Iterator[Block]:
    """Runs of lines between blank ones. A heading inside a run that doesn't begin with one starts a block of its own."""
    open_block: Block | None = None
    for number, line in enumerate(text.split("\n"), 1):
        blank = not line.strip(_BLANK)
        splits = open_block and not blank and _HEADING.match(line) and not _HEADING.match(open_block.lines[0])
        if open_block and (blank or splits):
            yield open_block
            open_block = None
        if not blank:
            open_block = open_block or Block(number, [])
            open_block.lines.append(line)
    if open_block:
        yield open_block


def _bounded(block: Block, most: int) -> Iterator[Block]:
    """An oversized block in runs of lines under the limit; a line beyond it stands alone."""
    part, size = Block(block.first, []), 0
    for n, line in enumerate(block.lines):
        cost = tokens(line)
        if part.lines and size + cost > most:
            yield part
            part, size = Block(block.first + n, []), 0
        part.lines.append(line)
        size += cost
    yield part


def chunks(text: str | None, target: int = 1000, most: int = 1400) -> list[Chunk]:
    """Blocks filled up to ``target`` estimated tokens; a block above ``most`` is cut between lines."""
    out: list[Chunk] = []

    def emit(group: list[Block], joint: str) -> None:
        body = joint.join("\n".join(b.lines) for b in group)
        last = group[-1]
        out.append(Chunk(len(out), group[0].first, last.first + len(last.lines) - 1, 0, len(last.lines[-1]), body, tokens(body)))

    group: list[Block] = []
    size = 0
    for block in blocks(text or ""):
        cost = tokens("\n".join(block.lines))
        if group and (cost > most or size + cost > target):
            emit(group, "\n\n")
            group, size = [], 0
        if cost > most:
            for part in _bounded(block, most):
                emit([part], "\n")
        else:
            group.append(block)
            size += cost
    if group:
        emit(group, "\n\n")
    return out


def chunk_documents(docs: DataFrame, key: str, text: str = "text", target: int = 1000, most: int = 1400) -> DataFrame:
    """The chunks of every document, addressed by its key. Each document is cut where it is; nothing is shuffled."""
    fields = "ordinal int, start_line int, end_line int, start_col int, end_col int, text string, token_est int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf["_key"], pdf["_text"]) for c in chunks(t, target, most)]
            yield pd.DataFrame(rows, columns=["_key", *Chunk._fields])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInPandas(run, f"_key {kind}, {fields}").withColumnRenamed("_key", key)


def document_blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, block_no, start_line, end_line, token_est)`` of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, b.first, b.first + len(b.lines) - 1, tokens("\n".join(b.lines))) for k, t in zip(pdf["_key"], pdf["_text"]) for n, b in enumerate(blocks(t or ""), 1)]
            yield pd.DataFrame(rows, columns=["_key", "block_no", "start_line", "end_line", "token_est"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInPandas(run, f"_key {kind}, block_no int, start_line int, end_line int, token_est int").withColumnRenamed("_key", key)
