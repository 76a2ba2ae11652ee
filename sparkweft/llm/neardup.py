"""Near-duplicate texts: a MinHash LSH forest proposes pairs, which are then verified exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkweft.sources.tables import checkpointed, with_keys, written

_WORD = re.compile(r"[^\W_]+")
_SLICE, _KEPT_WORDS = 512, 500_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def shingles_of(text: str | None, size: int) -> set[tuple[str, ...]]:
    words = words_of(text)
    return set(zip(*(words[n:] for n in range(size))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def forest_depth(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix at which a pair just at the threshold still shares a trie node in some tree with probability ``recall``.

    Starts from the whole signature and takes one value off until the recall is reached, or one value is left.
    """
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Signer:
    """MinHash signatures of texts in batches: ``trees`` tries whose paths are ``deepest`` values long."""

    def __init__(self, shingle: int, trees: int, deepest: int, least_words: int):
        self.shingle, self.trees, self.deepest, self.least = shingle, trees, deepest, max(least_words, shingle)
        draw = np.random.default_rng(7)
        self.times = draw.integers(1, 1 << 32, trees * deepest, dtype=np.uint32) | np.uint32(1)
        self.plus = draw.integers(0, 1 << 32, trees * deepest, dtype=np.uint32)
        self.steps = draw.integers(1, 1 << 63, shingle, dtype=np.uint64) | np.uint64(1)
        self.seen: dict[str, int] = {}

    def _hashed(self, words: list[str]) -> list[int]:
        seen = self.seen
        try:
            return [seen[w] for w in words]
        except KeyError:
            if len(seen) > _KEPT_WORDS:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            return [seen[w] for w in words]

    def shingles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts have words enough; their distinct shingle hashes one after another; where each text begins."""
        rows, sizes, hashes = [], [], []
        for n, text in enumerate(texts):
            words = words_of(text)
            if len(words) >= self.least:
                rows.append(n)
                sizes.append(len(words) - self.shingle + 1)
                hashes += self._hashed(words)
        if not rows:
            return np.array([], int), np.array([], np.uint64), np.array([], int)
        w = np.array(hashes, np.uint64)
        whole = np.zeros(len(w) - self.shingle + 1, np.uint64)
        for n, step in enumerate(self.steps):
            whole += w[n : n + len(whole)] * step
        owner = np.repeat(np.arange(len(rows)), sizes)
        first = np.cumsum([0, *(s + self.shingle - 1 for s in sizes[:-1])])
        at = np.arange(len(owner)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) + np.repeat(first, sizes)
        x = _mixed(whole[at])
        order = np.lexsort((x, owner))
        x, owner = x[order], owner[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        x, owner = x[new], owner[new]
        return np.array(rows), x, np.searchsorted(owner, np.arange(len(rows)))

    def sign(self, texts: list[str | None]):
        """Rows, number of shingles, two hashes of the shingle set, and the signature: per tree the path of ``deepest``
        values of two bytes, so that paths compare as byte strings do."""
        rows, x, starts = self.shingles(texts)
        if not len(rows):
            return rows, starts, starts, starts, np.zeros((0, self.trees * self.deepest), ">u2")
        counts = np.diff(np.append(starts, len(x)))
        one, two = np.add.reduceat(x, starts), np.add.reduceat(_mixed(x ^ _MIX[0]), starts)
        short, buffer = (x >> np.uint64(32)).astype(np.uint32), np.empty(len(x), np.uint32)
        values = np.empty((len(rows), self.trees * self.deepest), np.uint64)
        for n in range(self.trees * self.deepest):
            np.multiply(short, self.times[n], out=buffer)
            np.add(buffer, self.plus[n], out=buffer)
            values[:, n] = np.minimum.reduceat(buffer, starts)
        return rows, counts, one.view(np.int64), two.view(np.int64), (_mixed(values * _MIX[0] + np.uint64(1)) >> np.uint64(48)).astype(">u2")


# --- the operator -------------------------------------------------------------------------------------------------


def signatures(df: DataFrame, key: str, text: str, signer: dict) -> DataFrame:
    """``(id, size, one, two, paths)`` of every row whose text has words enough: ``one`` and ``two`` hash the shingle
    set, so copies have equal ones; ``paths`` has the path in each tree, one after another. Of copies that a task meets
    only the first has its paths, so a text that fills a third of the table is in its nodes once per task. Nothing is
    shuffled."""
    width = 2 * signer["trees"] * signer["deepest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, met = Signer(**signer), set()
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                rows, sizes, one, two, values = sign.sign(batch.column("text").to_pylist())
                data, paths = values.tobytes(), []
                for n, copy in enumerate(zip(one.tolist(), two.tolist())):
                    paths.append(None if copy in met else data[n * width : (n + 1) * width])
                    met.add(copy)
                if len(met) > _KEPT_WORDS:
                    met.clear()
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(paths, pa.binary())], ["id", "size", "one", "two", "paths"])

    rows = df.select(df[key].cast("long").alias("id"), df[text].alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= 2 * signer["least_words"] - 1))
    return rows.mapInArrow(run, "id long, size int, one long, two long, paths binary")


def forest(signed: DataFrame, trees: int, deepest: int, shortest: int) -> DataFrame:
    """``(node, rest, one, members)``: the sorted tries down from the prefixes of ``shortest`` values that several classes
    share. ``rest`` is the path below the node, in order, so that neighbours have the longest prefixes in common.

    One shuffle brings each node together in the order of its paths; a node that only one class is in is dropped there.
    """
    step = F.expr(f"explode(sequence(0, {trees - 1}))")
    rows = signed.where("paths IS NOT NULL").select("one", "paths", step.alias("tree"))
    path = lambda at, n: F.substring(F.col("paths"), F.col("tree") * 2 * deepest + 1 + 2 * at, F.lit(2 * n))
    rows = rows.select(F.xxhash64("tree", path(0, shortest)).alias("node"), path(shortest, deepest - shortest).alias("rest"), "one")
    within = W.partitionBy("node")
    rows = rows.withColumn("low", F.min("one").over(within)).withColumn("high", F.max("one").over(within)).withColumn("members", F.count("*").over(within))
    return rows.where("low <> high").select("node", "rest", "one", "members").distinct()


def met_pairs(nodes: DataFrame, deepest: int, shortest: int) -> DataFrame:
    """``(x, y, depth)``: the pairs of classes that share a node, with the length of the longest prefix that they share in
    any tree."""
    a, b = nodes.select("node", F.col("rest").alias("rest_x"), F.col("one").alias("x")), nodes.select("node", F.col("rest").alias("rest_y"), F.col("one").alias("y"))
    depth = F.lit(shortest)
    for n in range(1, deepest - shortest + 1):
        depth = depth + (F.substring("rest_x", 1, 2 * n) == F.substring("rest_y", 1, 2 * n)).cast("int")
    return a.join(b, "node").where("x < y").select("x", "y", depth.alias("depth")).groupBy("x", "y").agg(F.max("depth").alias("depth"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs whose texts have at least the threshold, compared word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, known = ([], [], []), {}
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if a not in known:
                    known = {a: shingles_of(x, shingle)}
                left, right = known[a], shingles_of(y, shingle)
                common = len(left & right)
                similarity = common / ((len(left) + len(right) - common) or 1)
                if similarity >= threshold:
                    for column, value in zip(kept, (a, b, similarity)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.float64())], ["a", "b", "similarity"])

    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _texts_of(df: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """``(id, text)`` of the given ids, once each; the texts of others stay where they are."""
    rows = df.select(df[key].cast("long").alias("id"), df[text].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return with_keys(rows, "id", ids).groupBy("id").agg(F.max("text").alias("text"))


def _rare_shingle_pairs(texts: DataFrame, signer: dict, threshold: float) -> DataFrame:
    """All pairs that can reach the threshold, by rare shingles: two such texts share one of the first n - ceil(t n) + 1
    of their n shingles in any common order; rare ones come first, so the lists joined are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(**signer)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                rows, x, starts = sign.shingles(batch.column("text").to_pylist())
                sizes = np.diff(np.append(starts, len(x)))
                ids = np.repeat(np.array(batch.column("id").to_pylist(), np.int64)[rows], sizes) if len(rows) else np.array([], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes), pa.int32()), pa.array(x.view(np.int64))], ["id", "size", "x"])

    rows = written(texts.select("id", "text").mapInArrow(run, "id long, size int, x long"), "shingles")
    common = rows.groupBy("x").agg(F.count("*").alias("docs")).where("docs > 1")
    order = W.partitionBy("id").orderBy(F.coalesce("docs", F.lit(1)), "x")
    prefix = rows.join(common, "x", "left").withColumn("k", F.row_number().over(order))
    prefix = prefix.where((F.col("k") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1) & (F.col("docs") > 1)).select("id", "size", "x")
    a, b = (prefix.toDF(f"{s}", f"size_{s}", "x") for s in "ab")
    close = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9
    return a.join(b, "x").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def similar_classes(
    df: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.8, shingle: int = 5, least_words: int = 0,
    trees: int = 24, deepest: int = 8, recall: float = 0.998, overall: float = 0.9995, crowd: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: the pairs ``(a, b, similarity)`` of classes of equal shingle sets whose similarity reaches
    the threshold, each class named by its least id, and ``(id, class, copies)`` of every row with words enough.

    MinHash LSH forest: a text is signed once, its signature being a path in each of ``trees`` sorted prefix tries. Pairs
    are verified exactly in the order of the longest prefix that they share: first those with whole paths in common, then
    the matched prefix is shortened by one value after another. Each pair found stands for 1 / the chance of meeting a
    pair that similar at this length; once the pairs found are ``overall`` of those so expected, shorter prefixes aren't
    looked at. At the latest it ends at the length at which a pair just at the threshold is met with chance ``recall``.

    Copies meet as one class, so a third of all rows being copies costs no more than one class. In a node of more than
    ``crowd`` classes pairs aren't listed; its texts are compared by their rarest shingles instead, which is exact: it
    finds every pair of them that reaches the threshold, whatever the prefix. Rows without a key, and null or short
    texts, have no class; repeated keys count once; extra columns are ignored; an empty table gives empty results.
    """
    signer = {"shingle": shingle, "trees": trees, "deepest": deepest, "least_words": least_words}
    shortest = forest_depth(threshold, trees, deepest, recall)
    signed = written(signatures(df, key, text, signer), "signatures")
    classes = signed.groupBy("one", "two").agg(F.min("id").alias("class"), F.min("size").alias("size"), F.count_distinct("id").alias("copies"))
    nodes = written(forest(signed, trees, deepest, shortest), "forest")
    crowded = nodes.where(F.col("members") > crowd).select("one").distinct()
    met = met_pairs(nodes.where(F.col("members") <= crowd), deepest, shortest)
    named = classes.select("one", "class", "size")
    near = F.least("size_x", "size_y") >= F.greatest("size_x", "size_y") * threshold - 1e-9
    pairs = met.join(named.toDF("x", "class_x", "size_x"), "x").join(named.toDF("y", "class_y", "size_y"), "y").where(near).select("class_x", "class_y", "depth")
    alike = classes.groupBy("one").agg(F.min("class").alias("class_x"), F.max("class").alias("class_y")).where("class_x <> class_y")
    pairs = pairs.unionByName(alike.select("class_x", "class_y", F.lit(deepest).alias("depth")))
    candidates = pairs.select(F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b"), "depth")
    if not crowded.isEmpty():
        ids = classes.join(crowded, "one", "left_semi").select(F.col("class").alias("id"))
        exact = _rare_shingle_pairs(_texts_of(df, key, text, ids), signer, threshold)
        candidates = candidates.unionByName(exact.withColumn("depth", F.lit(deepest))).groupBy("a", "b").agg(F.max("depth").alias("depth"))
    candidates = checkpointed(candidates)
    waiting = {r.depth: r.n for r in candidates.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    ids = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = written(_texts_of(df, key, text, ids), "texts") if waiting else None
    found = None
    for depth in range(deepest, shortest - 1, -1):
        if waiting.get(depth):
            todo = candidates.where(F.col("depth") == depth)
            ids = todo.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            more = checkpointed(_verified(todo.select("a", "b"), with_keys(texts, "id", ids), shingle, threshold))
            found = more if found is None else found.unionByName(more)
        if found is not None and depth > shortest and sum(n for d, n in waiting.items() if d < depth):
            chance = 1 - F.pow(1 - F.pow(F.col("similarity"), depth), trees)
            seen, expected = found.agg(F.count("*"), F.sum(1 / chance)).first()
            if seen and seen >= overall * expected:
                break
    if found is None:
        found = candidates.select("a", "b", F.lit(0.0).alias("similarity")).limit(0)
    members = signed.select("id", "one", "two").distinct().join(classes, ["one", "two"]).select("id", "class", "copies")
    return found, members


_BLOCK_ROWS = 1024


def similar_pairs(pairs: DataFrame, members: DataFrame, expand: int | None = 64) -> DataFrame:
    """``(a, b)``, a < b: the pairs of ids that the class pairs stand for, and the pairs of copies.

    With ``expand`` None every pair is written: classes are dealt out in blocks, and pairs of blocks are joined, so a
    large class is no single task's work. Otherwise the result is an abridged one: the least id of a class of more than
    ``expand`` members stands for it, and each other member is paired with that id only.
    """
    if expand is None:
        return _every_pair(pairs, members)
    linked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    small = F.col("copies") <= expand
    spread = members.join(linked, "class", "left_semi").where(small | (F.col("id") == F.col("class"))).select("id", "class")
    across = pairs.join(spread.toDF("x", "a"), "a").join(spread.toDF("y", "b"), "b").select("x", "y")
    copies = members.where("copies > 1")
    few = copies.where(small).select("id", "class")
    within = few.toDF("x", "class").join(few.toDF("y", "class"), "class").where("x < y").select("x", "y")
    many = copies.where(~small & (F.col("id") != F.col("class"))).select(F.col("class").alias("x"), F.col("id").alias("y"))
    return across.unionByName(within).unionByName(many).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _every_pair(pairs: DataFrame, members: DataFrame) -> DataFrame:
    blocks = F.ceil(F.col("copies") / _BLOCK_ROWS).cast("int")
    sizes = members.where("id = class").select("class", blocks.alias("blocks")).where("blocks > 1")
    within = members.where("id = class AND copies > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    both = pairs.select("a", "b").unionByName(within)
    for side, block in (("a", "i"), ("b", "j")):
        both = both.join(sizes.toDF(side, "blocks"), side, "left")
        both = both.withColumn(block, F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    dealt = members.select("id", "class", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    met = both.join(dealt.toDF("x", "a", "i"), ["a", "i"]).join(dealt.toDF("y", "b", "j"), ["b", "j"])
    return met.where("a <> b OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_groups(df: DataFrame, key: str = "id", **how) -> DataFrame:
    """``(id, group_id, copies, links)`` of every row: the least id that similar texts lead to, the number of equal
    texts (itself among them), and the number of similar classes. A row without a partner is its own group."""
    from sparkweft.operators.graph import connected_components

    pairs, members = similar_classes(df, key, **how)
    roots = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = members.join(roots.select(F.col("id").alias("class"), "component"), "class", "left").join(links, "class", "left")
    named = named.select("id", F.coalesce("component", "class").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    ids = df.select(df[key].cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return ids.join(named, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
