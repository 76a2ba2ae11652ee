"""A lexer for source code, configuration, commands and prose alike: it finds strings of every kind, words, marks and line
ends, and doesn't need to know the language."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """``text[start:end]``; of a string, ``text[inner:outer]`` is what its delimiters enclose."""

    kind: str  # word, string, number, mark, line, tag
    start: int
    end: int
    inner: int
    outer: int


#: Quotes of one line, of several lines (backticks), and what opens the longer kinds. An apostrophe within a word is none.
_SCAN = re.compile(
    r"""(?P<blank>(?:[^\S\n]|\\\r?\n)+)
|(?P<line>\n)
|(?P<long>(?<!\w)[A-Za-z]{0,2}(?P<three>\"{3}|'{3})(?P<body>(?:[^\\"']++|\\[\s\S]|(?!(?P=three))["'])*+)(?P=three))
|(?P<raw>(?<!\w)(?:[ubLU8]{0,2}R"(?P<fence>[^()\\\s]{0,16})\((?P<cooked>[\s\S]*?)\)(?P=fence)"|b?r(?P<hash>\#+)"(?P<plain>[\s\S]*?)"(?P=hash)))
|(?P<string>(?<!\w)[A-Za-z]{0,2}(?:(?P<q>["'])(?P<one>(?:[^\\\n"']++|\\(?:\r\n|[\s\S])|(?!(?P=q))["'])*+)(?P=q)|`(?P<tick>(?:\\[\s\S]|[^`\\]++)*+)`)|(?<=[\w])(?:"(?P<tight>(?:\\.|[^"\\\n]++)*+)"|`(?P<tight2>(?:\\.|[^`\\\n]++)*+)`))
|(?P<tag></?[A-Za-z][\w:.-]*(?:\s[^<>\n]*)?>)
|(?P<word>[^\W\d](?:(?![是为]\s)[\w$])*(?:-(?=[^\W_])[\w$]+)*)
|(?P<number>\d[\w.]*)
|(?P<mark>:=|=>|->|<<[-~]?|[=!<>]=+|[|]{2}=?|&&|\?\?=?|\+=|\?=|--?(?=[A-Za-z])|[\s\S])""",
    re.X,
)
_INNER = {"long": ("body",), "raw": ("cooked", "plain"), "string": ("one", "tick", "tight", "tight2")}


def tokens(text: str, at: int = 0):
    """The tokens from ``at`` on, blanks left out, one by one, so that a caller reads no farther than it needs.

    An unclosed quote is a mark by itself, so what follows it is read as if it weren't there.
    """
    match = _SCAN.match
    size = len(text)
    while at < size:
        m = match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "blank":
            continue
        if kind in _INNER or kind in ("body", "cooked", "plain", "one", "tick", "tight", "tight2"):
            kind = next(k for k in _INNER if m[k] is not None)
            inner = next(g for g in _INNER[kind] if m[g] is not None)
            yield Token("string", m.start(), at, m.start(inner), m.end(inner))
        else:
            yield Token(kind, m.start(), at, m.start(), at)


class Statement:
    """The tokens of one line and, as far as something reads on, of the lines after it, looked at by number."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.end = text, end
        self._more, self._got = tokens(text, start), []

    def __getitem__(self, n: int) -> Token | None:
        while len(self._got) <= n:
            token = next(self._more, None)
            if token is None:
                return None
            self._got.append(token)
        return self._got[n]

    def said(self, n: int) -> str:
        token = self[n]
        return self.text[token.start : token.end] if token else ""

    def inside(self, n: int) -> bool:
        """Whether the token begins on the first line."""
        token = self[n]
        return token is not None and token.start < self.end

    def past(self, n: int) -> int:
        """The number of the first token from ``n`` on that isn't a line end."""
        while (token := self[n]) and token.kind == "line":
            n += 1
        return n
