"""Cutting oversized texts into pieces under a limit, at natural boundaries, with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.sources.tables import once_per_key

#: An estimated token is one CJK character or 3.5 others that aren't blank; weights are in sevenths of a token.
_CJK, _OTHER, _TOKEN = 7, 2, 7
_BLANKS = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF], np.uint32)
_LANDMARK = 24  # characters that a landmark's hash is made of
_SLICE = 128
#: Ends of paragraphs, of lines, of sentences and of words: a cut falls behind the match.
_BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n+|\n(?=#{1,6}\s)|\n(?=```)"),
    re.compile(r"\n"),
    re.compile(r"[.!?;:…]+[\"'”’)\]]*(?=\s)|[。！？；…]+[”’」』）]*"),
    re.compile(r"\s+|[,，、;})\]]+"),
]


def weights(codes: np.ndarray) -> np.ndarray:
    """The weight of each code point in sevenths of an estimated token."""
    cjk = ((codes >= 0x3400) & (codes <= 0x9FFF)) | ((codes >= 0xF900) & (codes <= 0xFAFF)) | ((codes >= 0x3040) & (codes <= 0x30FF))
    return np.where(np.isin(codes, _BLANKS), 0, np.where(cjk, _CJK, _OTHER))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def estimate(text: str | None) -> int:
    """Estimated tokens, rounded up."""
    return -(-int(weights(_codes(text)).sum()) // _TOKEN) if text else 0


def _landmarks(codes: np.ndarray) -> np.ndarray:
    """A hash of the characters right before each position, so that a position keeps its hash wherever its text stands."""
    mixed = (codes.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    hashes = np.zeros(len(codes) + 1, np.uint64)
    for n in range(min(_LANDMARK, len(codes))):
        hashes[n + 1 :] += mixed[: len(codes) - n] * np.uint64(pow(0x100000001B3, n, 1 << 64))
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(0xBF58476D1CE4E5B9)


def cut_points(text: str, limit: int = 1400, overlap: int = 100) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces: each at most ``limit`` tokens with what it repeats of the one before it, at most
    ``overlap``. Together they hold every character in order.

    A piece's own part is between half and all of ``limit - overlap``. In that range the position with the least rolling
    hash is the landmark; the cut snaps to the nearest boundary of the strongest kind that the range has, and without any
    falls on the landmark. So an edit moves the cuts around it but not those farther on.
    """
    codes = _codes(text)
    total = np.concatenate([[0], np.cumsum(weights(codes))])
    if -(-int(total[-1]) // _TOKEN) <= limit:
        return [(0, len(text))]
    most = max(1, limit - overlap) * _TOKEN
    hashes = _landmarks(codes)
    ends = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in _BOUNDARIES]
    joint = np.concatenate([[False], [False if c < 0x300 else (0x300 <= c <= 0x36F or c in (0x200D, 0xFE0F)) for c in codes.tolist()], [False]])
    cuts, at = [], 0
    while total[-1] - total[at] > most:
        low = int(np.searchsorted(total, total[at] + most // 2, "left"))
        high = int(np.searchsorted(total, total[at] + most, "right")) - 1
        low, high = max(low, at + 1), max(high, at + 1)
        mark = low + int(np.argmin(hashes[low : high + 1]))
        cut = mark
        for kind in ends:
            near = kind[np.searchsorted(kind, low, "left") : np.searchsorted(kind, high, "right")]
            if len(near):
                cut = int(near[np.argmin(np.abs(near - mark))])
                break
        else:
            while cut > low and (joint[cut + 1] or joint[cut] and codes[cut - 1] == 0x200D):
                cut -= 1
        cuts.append(cut)
        at = cut
    pieces, start = [], 0
    for cut in [*cuts, len(text)]:
        pieces.append((start, cut))
        least = int(np.searchsorted(total, total[cut] - overlap * _TOKEN, "left")) if overlap else cut
        start = least
        for kind in ends[1:]:
            near = kind[np.searchsorted(kind, least, "left") : np.searchsorted(kind, cut, "left")]
            if len(near):
                start = int(near[0])
                break
    return pieces


def split_oversized(chunks: DataFrame, limit: int = 1400, overlap: int = 100, key: str = "id", text: str = "text") -> DataFrame:
    """``(chunk_id, piece_no, start, end, text, token_est, start_line, end_line)`` of every chunk whose text has an
    estimate above ``limit``; ``piece_no`` counts from 1, offsets are code points of the chunk's text.

    Lines are those of the file: the chunk's ``start_line`` (1 where it is null or missing) plus the line feeds before.
    Chunks up to the limit, null and empty texts and rows without a key yield nothing; repeated ids count once (of
    different texts under one id the greatest with its line). Only texts with more characters than the limit, which no
    other text can exceed, leave the JVM, and only those of repeated ids are shuffled.
    """
    schema = "chunk_id long, piece_no int, start int, end int, text string, token_est int, start_line int, end_line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                out = []
                for i, line, t in zip(*(c.to_pylist() for c in whole.slice(at, _SLICE).columns)):
                    spans = cut_points(t, limit, overlap)
                    if len(spans) == 1:
                        continue
                    for n, (a, b) in enumerate(spans, 1):
                        first = line + t.count("\n", 0, a)
                        last = first + t.count("\n", a, max(a, b - 1))
                        out.append((i, n, a, b, t[a:b], estimate(t[a:b]), first, last))
                columns = list(zip(*out)) or [()] * 8
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    line = F.coalesce(F.col("start_line").cast("int"), F.lit(1)) if "start_line" in chunks.columns else F.lit(1)
    rows = chunks.select(chunks[key].cast("long").alias("id"), line.alias("line"), chunks[text].alias("text")).where((F.length("text") > limit) & F.col("id").isNotNull())
    return once_per_key(rows, "id").select("id", "line", "text").mapInArrow(run, schema)


def oversized(chunks: DataFrame, limit: int = 1400, overlap: int = 100) -> DataFrame:
    """``(chunk_id,)`` of the chunks that ``split_oversized`` cuts."""
    return split_oversized(chunks, limit, overlap).where("piece_no = 1").select("chunk_id")
