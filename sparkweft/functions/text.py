"""Scalar text functions as column expressions, so that they run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as the engine's texts mean them: also no-break, ideographic and zero-width no-break space. Java's \\s has ASCII only.
BLANKS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff"


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


#: Fixed value: the blanks and signs that the key of a name is without.
_NO_KEY = rf"[{BLANKS}`*_\-./\\()\[\]{{}}<>\"'!?,;:]+"


def norm_name(name: Column) -> Column:
    """The key under which spellings of a name meet: lower case, without blanks and ASCII punctuation."""
    return F.regexp_replace(F.lower(trimmed(name)), _NO_KEY, "")


def estimate_tokens(text: Column, han: str = CJK) -> Column:
    """One per character of ``han`` and one per 3.5 of the others that aren't blank, rounded up."""
    solid = F.regexp_replace(text, f"[{BLANKS}]", "")
    other = F.length(F.regexp_replace(solid, f"[{han}]", ""))
    return F.ceil(F.length(solid) - other + other / 3.5).cast("int")


def extract_terms(text: Column) -> Column:
    """Search terms in order, each once: words of three letters or more in lower case, and of words with a CJK character
    every run of three characters as it is."""
    words = F.filter(F.split(text, rf"[{BLANKS}\p{{P}}\p{{S}}]+"), lambda w: F.length(w) >= 3)
    grams = F.transform(
        words,
        lambda w: F.when(w.rlike(f"[{CJK}]"), F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))).otherwise(F.array(F.lower(w))),
    )
    return F.array_distinct(F.flatten(grams))


def slugify(name: Column) -> Column:
    """A folder name: ASCII letters and digits joined by hyphens, at most 40, ``kb`` if none."""
    base = F.regexp_replace(F.regexp_replace(F.lower(trimmed(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(base == "", "kb").otherwise(F.substring(base, 1, 40))


def strip_fences(raw: Column) -> Column:
    """The JSON in a model's answer: what the first code fence holds, from the first brace to the last."""
    text = trimmed(raw)
    fence = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    inner = trimmed(F.when(fence != "", fence).otherwise(text))
    first, last = F.locate("{", inner), F.length(inner) - F.locate("}", F.reverse(inner)) + 1
    whole = (first > 0) & F.contains(inner, F.lit("}")) & (last > first)
    return trimmed(F.when(whole, F.substring(inner, first, last - first + 1)).otherwise(inner))


def fingerprint(ids: Column) -> Column:
    """Sixteen hexadecimal digits that name a set of ids."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 16)


def shown(text: Column, most: int = 4000) -> Column:
    """A text as evidence shows it: cut behind ``most`` characters."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…[截断]"))).otherwise(text)


def extension(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(?s)(\.[^.]*)$", 1))


def glob_regex(pattern: str) -> str:
    """The anchored Java expression of a pattern in which only ``*`` is special."""
    return "^" + "".join(".*" if c == "*" else c if c.isalnum() or c in "_/" else "\\" + c for c in pattern) + "$"
