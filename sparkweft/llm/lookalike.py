"""One form for text that looks the same: full-width forms, accents set apart, invisible characters, look-alike letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--[\t\n\r\u0600-\u0605\u06dd]]", regex.V1)
_SPACE = regex.compile(r"[\p{Zs}\t]")


def skeletons(spark: SparkSession, letters: Iterable[str]) -> dict[str, str]:
    """What each character is drawn like, by the confusables data of the Unicode library that comes with the engine."""
    letters = [c for c in letters if c not in "\n\r" and not 0xD800 <= ord(c) <= 0xDFFF]
    if not letters:
        return {}
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    drawn = checker.getSkeleton("\n".join(letters)).split("\n")
    if len(drawn) != len(letters):
        drawn = [checker.getSkeleton(c) for c in letters]
    return dict(zip(letters, drawn))


def _drawn_like(c: str, skeleton: str) -> str:
    """The character that ``c`` is drawn like, or itself.

    The data also join ASCII characters that differ (I, l, 1 and |; O and 0; m and rn), which stay apart here: a capital
    drawn like l is an I. Letters of the Latin alphabet other than ASCII are letters of their own (ı, ß, ø).
    """
    kind = unicodedata.category(c)
    if kind == "Pd" or c in "−⁃˗":
        return "-" if skeleton == "-" or c in "‐‑‒–−" else c
    if len(skeleton) != 1 or kind not in ("Lu", "Ll", "Lo", "Lt", "Nl") or regex.match(r"\p{Latin}", c) and c not in "ɑɡ":
        return c
    if skeleton == "l" and kind == "Lu":
        return "I"
    if skeleton.isascii() and (skeleton.isalpha() and kind == "Lo" or not skeleton.isalpha()):
        return c  # signs of other scripts that only resemble a stroke or a ring
    return skeleton


class Classes:
    """Classes of strings and characters that look the same, joined by union-find, each with a representative.

    ``seen`` gives the characters of a collection with their frequencies, ``drawn`` what each is drawn like. A class never
    has two different ASCII characters. Its representative is its ASCII member, else the most frequent one.
    """

    def __init__(self, seen: dict[str, int], drawn: dict[str, str]):
        self.parent: dict[str, str] = {}
        self.ascii: dict[str, str] = {}
        for c in seen:
            if c.isascii() and not (c == "\t" or _INVISIBLE.match(c)):
                continue
            compatible = unicodedata.normalize("NFKD", c)
            if _INVISIBLE.match(c):
                self._join(c, "")
            elif _SPACE.match(c) or compatible.strip() == "" and compatible:
                self._join(c, " ")
            elif compatible != c:
                self._join(c, "".join(self._like(x, drawn) for x in compatible))
            elif (like := _drawn_like(c, drawn.get(c, c))) != c:
                self._join(c, unicodedata.normalize("NFD", like))
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self._root(x), []).append(x)
        self.form: dict[str, str] = {}
        for members in groups.values():
            best = min(members, key=lambda x: (x.isascii() is False, x == "" and -1, -seen.get(x, 0), x))
            self.form.update({m: best for m in members if m and m != best})
        self.machine = ahocorasick.Automaton()
        for found, form in self.form.items():
            self.machine.add_word(found, (len(found), form))
        if self.form:
            self.machine.make_automaton()

    def _like(self, c: str, drawn: dict[str, str]) -> str:
        return c if c.isascii() else unicodedata.normalize("NFD", _drawn_like(c, drawn.get(c, c)))

    def _root(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _join(self, a: str, b: str) -> None:
        a, b = self._root(a), self._root(b)
        plain = {r: self.ascii.get(r, r if r.isascii() else None) for r in (a, b)}
        if a == b or plain[a] is not None and plain[b] is not None and plain[a] != plain[b]:
            return
        self.parent[a] = b
        known = plain[a] if plain[b] is None else plain[b]
        if known is not None:
            self.ascii[b] = known

    def canonical(self, text: str | None) -> str | None:
        """The form of the text: accents set apart, every longest member of a class replaced from left to right by its
        representative, accents put together again. Null stays null."""
        if not text or text.isascii() and not _INVISIBLE.search(text) and "\t" not in text:
            return text
        apart = unicodedata.normalize("NFD", text)
        if self.form:
            out, at = [], 0
            for end, (length, form) in self.machine.iter_long(apart):
                out += [apart[at : end - length + 1], form]
                at = end + 1
            apart = "".join([*out, apart[at:]])
        return unicodedata.normalize("NFC", apart)


def character_counts(texts: DataFrame, *columns: str) -> dict[str, int]:
    """How often each character that isn't plain ASCII, and each that text is taken apart into, occurs in the columns.

    Counted where the rows are; the driver gets a row per distinct character, of which Unicode has a fixed number.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, int] = {}
            for column in pdf.columns:
                for t in pdf[column]:
                    if t and not t.isascii():
                        for c in regex.sub(r"[\x20-\x7e\n\r]", "", unicodedata.normalize("NFD", t)):
                            counts[c] = counts.get(c, 0) + 1
            yield pd.DataFrame(list(counts.items()), columns=["c", "n"])

    rows = texts.select(*columns).mapInPandas(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {r.c: r.n for r in rows.collect()}


def look_alike_classes(texts: DataFrame, *columns: str) -> Classes:
    """The classes of all characters that occur in the columns."""
    seen = character_counts(texts, *columns)
    parts = {p for c in seen for p in unicodedata.normalize("NFKD", c)} | set(seen)
    seen = {**dict.fromkeys(sorted(parts), 0), **seen, "\t": 0}
    return Classes(seen, skeletons(texts.sparkSession, [c for c in seen if not c.isascii()]))


def canonical_texts(df: DataFrame, *columns: str, classes: Classes | None = None) -> DataFrame:
    """The rows with each of the string columns in one form; everything else, nulls and empty texts too, as it is."""
    import pandas as pd

    classes = classes or look_alike_classes(df, *columns)
    pairs = (classes.form,)

    def run(texts: pd.Series) -> pd.Series:
        machine = _machine(pairs[0])
        return texts.map(machine.canonical, na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, "string")
    return df.withColumns({c: udf(df[c]) for c in columns})


_MACHINES: dict[int, Classes] = {}


def _machine(form: dict[str, str]) -> Classes:
    """The automaton of a mapping, built once per worker."""
    key = hash(frozenset(form.items()))
    if key not in _MACHINES:
        made = Classes({}, {})
        made.form, made.machine = form, ahocorasick.Automaton()
        for found, to in form.items():
            made.machine.add_word(found, (len(found), to))
        if form:
            made.machine.make_automaton()
        _MACHINES[key] = made
    return _MACHINES[key]


_SALT_ROWS = 1024


def same_looking(entities: DataFrame, key: str = "id", name: str = "name", expand: int | None = 64) -> DataFrame:
    """``(a, b)``, a < b: pairs of rows whose names look the same although their characters differ.

    Names are first reduced to distinct spellings, so rows with one spelling are brought to their form as one. With
    ``expand`` None every pair is written, and the rows of a frequent form are dealt out over several keys of the join.
    Otherwise the result is an abridged one: a spelling of more than ``expand`` rows is stood for by its least id, and
    its other rows don't occur. Null and empty names and rows without a key have no partner; repeated rows count once;
    other columns are ignored.
    """
    rows = entities.select(entities[key].cast("long").alias("id"), entities[name].alias("name")).where("id IS NOT NULL AND name <> ''").distinct()
    spelled = rows.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    forms = canonical_texts(spelled.withColumn("form", F.col("name")), "form", classes=look_alike_classes(spelled, "name"))
    several = forms.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("n").alias("rows")).where("spellings > 1")
    forms = forms.join(several.select("form", F.ceil(F.col("rows") / _SALT_ROWS).cast("int").alias("salts")), "form")
    members = rows.join(forms, "name")
    if expand is not None:
        members = members.where((F.col("n") <= expand) | (F.col("id") == F.col("first")))
    x = members.select(F.col("id").alias("x"), F.col("name").alias("name_x"), "form", F.expr("pmod(xxhash64(id), salts)").cast("int").alias("salt"))
    y = members.select(F.col("id").alias("y"), F.col("name").alias("name_y"), "form", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    return x.join(y, ["form", "salt"]).where("x < y AND name_x <> name_y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def look_alike_groups(entities: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """``(id, group_id, spellings, links)`` of every row with a name: the least id of those whose names look the same, how many
    spellings they have, and with how many rows of other spellings the row is linked. Nothing is gathered and no pair is
    written, so a name that a third of all rows share costs a row each. Repeated rows count once."""
    rows = entities.select(entities[key].cast("long").alias("id"), entities[name].alias("name")).where("id IS NOT NULL AND name <> ''").distinct()
    spelled = rows.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    forms = canonical_texts(spelled.withColumn("form", F.col("name")), "form", classes=look_alike_classes(spelled, "name"))
    groups = forms.groupBy("form").agg(F.min("first").alias("group_id"), F.count("*").alias("spellings"), F.sum("n").alias("rows"))
    named = forms.join(groups, "form").select("name", "group_id", "spellings", (F.col("rows") - F.col("n")).alias("links"))
    return rows.join(named, "name").select("id", "group_id", "spellings", "links")
