"""Byte-level BPE encoding of a whole corpus with the vocabulary of a public tokenizer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: how byte-level vocabularies of this kind cut a text into words before merging.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blank-delimited runs. Each of their borders is also a border of WORD, because there a run of one class ends and blanks
#: are cut alike; so a run can be encoded by itself, and the same run anywhere has the same ids.
_RUN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python's blanks that aren't blanks in WORD. Texts with them are cut by WORD alone.
_ODD = re.compile("[\x1c-\x1f]")
_KEPT_RUNS, _KEPT_WORDS, _KEPT_PAIRS, _SLICE = 400_000, 200_000, 1_000_000, 256


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself if visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class TrieEncoder:
    """Encodes words by walking the prefix trie of all distinct words depth-first.

    For every prefix there is one last token such that it and the last token of what precedes it stay side by side when
    their bytes are merged together. So each trie node needs one (last token, where it begins), found from the states of
    its ancestors, and a prefix that many words share is worked out once. Sorted words are a pre-order of the trie, hence
    the path from the root is kept as a stack and no nodes are stored. The ids of a word are read back along the stack.
    """

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = {token: bytes(map(letters.__getitem__, token)) for token in model["vocab"] if all(map(letters.__contains__, token))}
        self.bytes_of = {model["vocab"][token]: raw for token, raw in ids.items()}
        self.id_of = {raw: i for i, raw in self.bytes_of.items()}
        # rank: order of the merge that makes a token, -1 for single bytes; halves: the two tokens it is made of
        self.rank, self.halves, self.joined = {}, {}, {}
        for raw, i in self.id_of.items():
            if len(raw) == 1:
                self.rank[i] = -1
        for n, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = model["vocab"][left], model["vocab"][right]
            made = model["vocab"][left + right]
            self.joined.setdefault(pair, n)
            if made not in self.rank:
                self.rank[made], self.halves[made] = n, pair
        self.longest = [0] * 256
        for raw, i in self.id_of.items():
            if i in self.rank:
                self.longest[raw[-1]] = max(self.longest[raw[-1]], len(raw))
        self._beside: dict[int, bool] = {}

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens while their bytes are merged as one text.

        The merges are undone from the last: of the pieces that touch the border, the one made later is split. If a merge
        of the two pieces would have come before the split one was made, the border doesn't last. Of equal merges the
        leftmost comes first.
        """
        joined, rank, halves = self.joined, self.rank, self.halves
        before = len(joined) + 1
        while True:
            cross = joined.get((left, right))
            if cross is not None and cross < before:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, halves[left][1]
            else:
                before, right = b + 1, halves[right][0]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each word as packed little-endian int32."""
        out: dict[bytes, bytes] = {}
        id_of, rank, longest, beside = self.id_of, self.rank, self.longest, self._beside
        last, begin, previous = [-1], [0], b""
        if len(beside) > _KEPT_PAIRS:
            beside.clear()
        for word in sorted(words):
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for at in range(max(0, end - longest[word[end - 1]]), end):
                    token = id_of.get(word[at:end])
                    if token is None or token not in rank:
                        continue
                    if at:
                        key = last[at] << 20 | token
                        fits = beside.get(key)
                        if fits is None:
                            fits = beside[key] = self._stay_apart(last[at], token)
                        if not fits:
                            continue
                    last.append(token)
                    begin.append(at)
                    break
                else:
                    raise ValueError(f"the vocabulary lacks a byte of {word[at:end]!r}")
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = begin[end]
            out[word] = np.array(ids[::-1], "<i4").tobytes()
            previous = word
        return out


class CorpusEncoder:
    """Encodes texts in slices; runs and words that were seen are looked up."""

    def __init__(self, vocabulary: str):
        self.trie, self.word = TrieEncoder(vocabulary), regex.compile(WORD)
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, runs: set[str]) -> None:
        if len(self.runs) > _KEPT_RUNS:
            self.runs.clear()
        if len(self.words) > _KEPT_WORDS:
            self.words.clear()
        cut = {run: self.word.findall(run) for run in runs if run not in self.runs}
        known = self.words
        fresh = {w.encode("utf-8", "surrogatepass"): w for words in cut.values() for w in words if w not in known}
        for raw, ids in self.trie.encode_words(fresh).items():
            known[fresh[raw]] = ids
        for run, words in cut.items():
            self.runs[run] = b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; none for an empty or a null one."""
        cut = [() if not t else self.word.findall(t) if _ODD.search(t) else _RUN.findall(t) for t in texts]
        self._learn({run for runs in cut for run in runs})
        look = self.runs.__getitem__
        return [b"".join(map(look, runs)) for runs in cut]


_ENCODERS: dict[str, CorpusEncoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> CorpusEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = CorpusEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def _packed(batches: Iterable[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    enc = encoder(vocabulary)
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            yield batch, enc.encode(batch.column("_text").to_pylist())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: the token ids of each row's text, without special tokens.

    An empty or a null text has an empty list; strings of special tokens in a text are ordinary text. Every row of the
    input has one row in the result, repeated rows too; other columns are ignored. ``vocabulary`` is a path that every
    worker can read. Nothing is shuffled, and a worker's tables of seen words are bounded, so they only save time.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, packed in _packed(batches, vocabulary):
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.ListArray.from_arrays(pa.array(ends), values)], ["_key", "ids"])

    schema = T.StructType([T.StructField("_key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema).withColumnRenamed("_key", key)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of ids that ``encode_corpus`` gives for ``text``."""
    inner = {c: f"_k{n}" for n, c in enumerate(keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, packed in _packed(batches, vocabulary):
            counts = pa.array([len(x) // 4 for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in inner.values()), counts], [*inner.values(), "n_tokens"])

    schema = T.StructType([*(T.StructField(k, df.schema[c].dataType) for c, k in inner.items()), T.StructField("n_tokens", T.LongType())])
    counted = df.select(*(df[c].alias(k) for c, k in inner.items()), df[text].alias("_text")).mapInArrow(run, schema)
    return counted.withColumnsRenamed({k: c for c, k in inner.items()})
