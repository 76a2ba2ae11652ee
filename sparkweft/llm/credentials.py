"""Credentials written out in source code, configuration, commands and prose: finding and redacting them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.lexer import Statement, Token

REDACTED = "REDACTED"
_SLICE = 256


class Secret(NamedTuple):
    """``text[start:end]`` is secret; ``parts`` are the spans to replace in it, delimiters and escapes left out."""

    start: int
    end: int
    kind: str
    parts: tuple[tuple[int, int], ...]


# --- lexical pieces ---------------------------------------------------------------------------------------------

#: A value without quotes, up to a blank or a separator.
_BARE = re.compile(r"""[^\s"'`;,<>(){}\[\]][^\s"'`;,<>()\[\]]*""")
#: Marks and words that give a value to the name before them.
_ASSIGNS = {"=", ":=", ":", "：", "=>", "->", "?=", "||=", "??=", "+="}
_COPULAS = {"is", "ist", "est", "es", "是", "为"}
_ELSE = {"||", "??", "or", "?:"}
_ASKING = {"get", "find", "read", "load", "fetch", "lookup", "has", "is", "need", "require", "prompt", "ask", "generate", "make", "by", "delete", "remove"}
_FOLLOW = re.compile(r"""[ \t]*(?:\+|\\|\.)?[ \t]*\r?\n[ \t]*(?:--|#|//|\*)?[ \t]*(?:\+|\.)?[ \t]*(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
#: The text of a YAML block, and of a here-document, from the end of the line that opens it.
_BLOCK = re.compile(r"[|>][-+\d]*[ \t]*(?:#[^\n]*)?\r?\Z")
_ENTRY = re.compile(r"\s*(?:[:=]|=>)")
_BLOCK_LINE = re.compile(r"\n(?:[ \t]*\r?(?=\n))*(?P<indent>[ \t]+)(?P<first>\S+)[ \t]*\r?(?=\n|\Z)")
_HERE = re.compile(r"""<<[-~]?\s*["']?(?P<mark>[A-Za-z_]\w*)["']?""")
#: A line of an environment file or of a shell, where a word is a value whatever it looks like.
_SHELL_LINE = re.compile(r"\s*(?:export\s+|set\s+|ENV\s+|[-*]\s+)?(?:[A-Z][A-Z0-9_]*|[A-Za-z]\w*(?:[.-]\w+)+)=(?P<bare>[^\s\"'`$;]+)\s*\Z")
#: A connection string, where a value ends at a semicolon.
_CONNECTION = re.compile(r"(?i)\b(?:uid|user|user ?id|username|server|host|data source|database)\s*=[^;\n]*;")
#: Words by which notes and login files hand over a password, with the value behind them at the line's end.
_TOLD = re.compile(r"(?i)(?<![\w.-])(?:(?:login|account)[ \t]+\S+[ \t]+password|pass|pwd|pw|passcode|(?:login|log-?on|creds?|credentials?|access)[ \t]+(?:for|to|on|of)[ \t]+[\w.-]+[ \t]*[:=]|(?:zugang|zugangsdaten)[ \t]+(?:für|zu)[ \t]+[\w.-]+[ \t]*[:=])[ \t]+(?P<value>[^\s\"'`,;<>(){}\[\]][^\s\"'`;,<>()\[\]]*)[ \t]*(?:\*/|-->)?[ \t]*\r?\Z")
_XML_VALUE = re.compile(r"\s*(?P<value>[^<>\s][^<>\n]*?)\s*</")

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: Prefixes by which issuers mark their keys and tokens, and the alphabets that follow.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{12,}|[sr]k_live_[A-Za-z0-9]{12,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{12,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{20,}|sk-[A-Za-z0-9_-]{20,}|AIza[\w-]{30,}|hf_[A-Za-z0-9]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_[a-f0-9]{32,})"
)
_SIGNED = re.compile(r"(?<![\w.-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?P<user>[^\s/?#@:\"'`]*):(?P<secret>[^\s/?#@\"'`]+|[^\s\"'`@]+)@(?=[\w\[])")
_QUERY = re.compile(r"[?&;](?P<name>[A-Za-z_][\w.-]*)=(?P<secret>[^\s&#\"'`<>;]+)")
_HEADER = re.compile(r"(?i)(?:authorization|proxy-authorization)[\"'`]?\s*[:=,]\s*[\"'`]?(?:(?P<scheme>basic|bearer|token|apikey|digest)\s+)?(?P<secret>[^\s\"'`,;]+)")
_COOKIE = re.compile(r"(?i)(?:set-)?cookie[\"'`]?\s*[:=]\s*[\"'`]?(?P<pairs>[^\"'`\n]+)")
_LOGIN = re.compile(r"(?<!\S)(?:-u|--user)[ =][\"']?[^\s:\"']+:(?P<secret>[^\s\"'@]+)|(?:\blogin\b|\bsshpass\b|\bmysql|\bpsql\b|\bmongo|\s-u[ =]?\S).*?\s-p[ =]?[\"']?(?P<passed>[^\s\"']+)")

#: What a name must hold to take a secret. Values of sure names count unless they are placeholders; values of the others
#: have to look random as well, for their words also name ordinary things.
_SURE = re.compile(r"(?:password|passwd|passphrase|passwort|kennwort|passcode|(?:^|[_\W])(?:pwd|pass|psw|pin)|密码|口令|密钥|пароль|contrase[nñ]a|heslo|clientsecret|secretkey|secretaccesskey|apisecret|cookiesecret|awssecret)$")
_LIKELY = re.compile(r"(?:secret|token|apikey|accesskey|privatekey|authkey|signingkey|encryptionkey|masterkey|sharedkey|sessionkey|licensekey|credentials?|session|sessionid|sid|auth|bearer|sig|signature|jwt|cookie|webhook|hook|key)$")
_QUERY_NAME = re.compile(r"(?i)(?:access_?token|auth_?token|token|sig|signature|api_?key|apikey|key|secret|client_?secret|password|passwd|pwd|auth|code|x-amz-signature|x-amz-security-token)$")
_HOLDERS = re.compile(
    r"(?i)^(?:[<\[{(%$].*|.*[>\]})%]|x{3,}.*|\*+|\.+|-+|_+|•+|…+|#+|0+|\?+|(?:change|replace|fill|insert|put|enter|set|add)[ _-]?(?:me|this|it|here|in|your).*|your[ _-].*|.*[ _-]here|my[ _-].*"
    r"|(?:example|sample|dummy|fake|mock|test|todo|tbd|fixme|none|null|nil|undefined|empty|redacted|masked|hidden|removed|placeholder|secret|password|passwd|token|string|str|bytes|int|number|any|boolean|bool|unknown|object|true|false|void|optional|required|default|n/a|value|text|varchar)(?:[ _-]?(?:key|value|password|token|secret|here))?)$"
)
_REFERS = re.compile(r"(?i)(?:\$\{|\{\{|\$\(|<%|%\(|\$[A-Z_]+\b|process\.env|os\.environ|getenv|env\[|ENV\[|vault[:./]|ssm:|arn:|secretsmanager|keyring|sops:|!vault|file://|op://)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+")


def _anchors() -> ahocorasick.Automaton:
    """What a line must hold for any rule to apply."""
    found = ahocorasick.Automaton()
    for word in (
        "pass", "kennwort", "pwd", "psw", "identified by", "pw ", "pw=", "pw:", "pw\"", "pw'", "密码", "口令", "密钥", "пароль", "contrase", "heslo",
        "secret", "token", "key", "credential", "session", "sid", "auth", "bearer", "sig", "jwt", "cookie", "hook", "private key", "login", "creds", "zugang", "://", "akia", "asia", "ghp_", "gho_", "ghu_",
        "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "xox", "npm_", "pypi-", "sk-", "aiza", "hf_", "sg.", "dop_v1_", "eyj", " -u ", "--user", " -p", "pin",
    ):
        found.add_word(word, len(word))
    found.make_automaton()
    return found


_ANCHORS = _anchors()


def _flips(value: str) -> int:
    """How often the letter case changes; names change it at word borders only."""
    return sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]))


def _random_looking(value: str, least: int = 16) -> bool:
    """Letters and digits mixed as a generator does, or long hexadecimal."""
    core = re.sub(r"[-_.=+/]", "", value)
    if len(core) < least or re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value):
        return False
    digits, upper, lower = (sum(map(f, core)) for f in (str.isdigit, str.isupper, str.islower))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        return len(core) >= 24 and digits > 0 and digits < len(core)
    if not digits:
        return core.isascii() and core.isalpha() and _flips(core) * 4 >= len(core)
    return core.isascii() and (upper > 0) + (lower > 0) + (digits > 1) >= 2 and (upper > 1 or digits > 2) and len(set(core)) >= 8


def _holds_place(value: str) -> bool:
    return not value or bool(_HOLDERS.match(value)) or bool(_REFERS.search(value)) or len(set(value)) < 3


_SPOKEN = {"a", "an", "and", "any", "are", "as", "be", "can", "could", "did", "do", "enter", "expired", "failed", "for", "from", "has", "have", "if", "in", "incorrect", "invalid", "is", "it", "match", "missing", "must", "no", "not", "of", "on", "or", "password", "please", "required", "reset", "should", "that", "the", "this", "to", "too", "was", "with", "wrong", "you", "your"}


def _pass_phrase(value: str) -> bool:
    """Several plain words that don't make a sentence."""
    words = value.split()
    return 3 <= len(words) <= 8 and all(re.fullmatch(r"[a-z]{2,12}", w) for w in words) and not _SPOKEN.intersection(words) and len(set(words)) == len(words)


def _mixed(value: str) -> bool:
    """Letters with digits or other signs among them, as in no ordinary word."""
    return len(value) >= 6 and bool(re.search(r"[^\W\d_]{2}", value) and re.search(r"[\d#%$&*?!@^~+=]", value.rstrip("?!.")))


def _written_out(value: str, quoted: bool) -> bool:
    """Whether the value of a password-like name is the password itself rather than a word for it, a type or a variable."""
    if len(value) < 4 or _holds_place(value) or value.isdigit() and len(value) < 6 or re.fullmatch(r"(?:~|\.{0,2})(?:/[\w.-]+){2,}", value) and not _random_looking(value):
        return False
    if quoted:
        return not re.search(r"\s\S+\s", value) or _pass_phrase(value)
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)*[?!|&:+.-]*", value):  # a variable, unless it is mixed like a password
        mixed = re.search(r"[A-Z]", value[1:]) and re.search(r"[a-z]", value)
        return bool(mixed and "." not in value and (len(re.findall(r"\d", value)) >= 2 or _flips(value) >= 5 and re.search(r"[A-Z]{2}", value)))
    return not re.fullmatch(r"[\W_]+|[\d.:]+", value) and bool(re.search(r"\d", value) or len(set(value)) > 7 and re.search(r"[^\w.]", value))


_NOT_SECRET = {"length", "len", "min", "max", "hash", "digest", "hint", "reset", "expiry", "ttl", "url", "uri", "file", "path", "name", "field", "type", "count", "limit", "label", "policy", "public", "checksum", "fingerprint", "integrity", "etag", "id", "request", "trace", "commit", "sha", "cert", "certificate"}


def _credential_name(name: str) -> str:
    """``sure``, ``likely`` or nothing, by the last words of a camel-case, snake-case or hyphenated name."""
    words = [w.lower() for w in _CAMEL.split(name) if w]
    if not words or words[-1] in _NOT_SECRET or "public" in words:
        return ""
    joined = "".join(words)
    if _SURE.search(joined) or words[-1] in ("pwd", "pass", "psw", "passwd", "pw"):
        return "sure"
    return "likely" if _LIKELY.search(joined) else ""


def _good_argument(name: str, value: str, setter: bool) -> bool:
    """Whether a literal argument is the secret; plain words and dotted names are keys and labels unless a setter takes them."""
    sure = _credential_name(name)
    if sure == "sure":
        return _written_out(value, True) and (setter or not re.fullmatch(r"[^\W\d_]+(?:[\s._:/-]+[^\W\d_]+)*[?!.:…]*", value))
    return bool(sure) and not re.search(r"\s", value) and _random_looking(value) and not _holds_place(value)


def _parts(text: str, start: int, end: int) -> tuple[tuple[int, int], ...]:
    """The span without escape sequences of line ends, which stay as they are."""
    out, at = [], start
    for m in re.finditer(r"\\[nrt]|\\u000[aAdD]|\s+", text[start:end]):
        if start + m.start() > at:
            out.append((at, start + m.start()))
        at = start + m.end()
    if at < end:
        out.append((at, end))
    return tuple(out)


def _pem(text: str, at: re.Match) -> Secret | None:
    """A private key from its first line; the lines between the marks are what is replaced."""
    stop, other = _PEM_END.search(text, at.end()), _PEM.search(text, at.end())
    if stop and other and other.start() < stop.start():
        stop = None
    end = stop.start() if stop else other.start() if other else len(text)
    parts = []
    for m in _PEM_BODY.finditer(text, at.end(), end):
        begin = m.start() + (text[m.start() - 1] == "\\" and text[m.start()] in "nr")
        parts.append((begin, m.end()))
        if not stop and len(parts) > 1 and "\n\n" in text[parts[-2][1] : begin]:
            parts.pop()
            break
    return Secret(at.start(), parts[-1][1], "private_key", tuple(parts)) if parts else None


def _issued_and_carried(text: str, start: int, end: int, line: str) -> Iterator[tuple[int, int, str]]:
    """What needs no name: issued keys, signed sessions, and secrets in URLs, headers, cookies and logins."""
    low = line.lower()
    for m in _ISSUED.finditer(line):
        if not re.search(r"(?i)x{6,}|example", m[0]):
            yield start + m.start(), start + m.end(), "issued_key"
    for m in _SIGNED.finditer(line) if "eyJ" in line else ():
        yield start + m.start(), start + m.end(), "signed_session"
    if "://" in line:
        for m in _URL.finditer(line):
            if not _holds_place(m["secret"]) and len(m["secret"]) >= 4:
                yield start + m.start("secret"), start + m.end("secret"), "url_password"
    for m in _QUERY.finditer(line) if "=" in line else ():
        if _QUERY_NAME.search(m["name"]) and _random_looking(m["secret"]) and not _holds_place(m["secret"]):
            yield start + m.start("secret"), start + m.end("secret"), "url_token"
    for m in _HEADER.finditer(line) if "authorization" in low else ():
        if not _holds_place(m["secret"]) and (m["scheme"] and len(m["secret"]) >= 12 and not m["secret"].isalpha() or _random_looking(m["secret"])):
            yield start + m.start("secret"), start + m.end("secret"), "header"
    for m in _COOKIE.finditer(line) if "cookie" in low else ():
        for pair in re.finditer(r"[\w.-]+=([^;\s]+)", m["pairs"]):
            if _random_looking(pair[1]) and not _holds_place(pair[1]):
                a = start + m.start("pairs") + pair.start(1)
                yield a, a + len(pair[1]), "cookie"
    if (m := _TOLD.search(line)) and _mixed(m["value"]) and _written_out(m["value"], True):
        yield start + m.start("value"), start + m.end("value"), "told"
    for m in _LOGIN.finditer(line) if "-p" in line or "-u" in line else ():
        group = "secret" if m["secret"] else "passed"
        if _written_out(m[group], True):
            yield start + m.start(group), start + m.end(group), "command"


class _Line:
    """The literals that a line assigns or passes to credential-named identifiers, found token by token."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.tokens = Statement(text, start, end)

    def found(self) -> Iterator[tuple[int, int, str]]:
        n = 0
        while self.tokens.inside(n):
            token = self.tokens[n]
            if token.kind == "word" or token.kind == "string":
                yield from self._after_name(n, token)
            elif token.kind == "tag":
                yield from self._in_tag(token)
            n += 1

    def _after_name(self, n: int, token: Token) -> Iterator[tuple[int, int, str]]:
        name = self.text[token.inner : token.outer]
        if token.kind == "string" and (len(name) > 80 or not re.fullmatch(r"[^\W\d][\w.$-]*", name)):
            yield from self._within(token)
            return
        sure = _credential_name(name)
        words = [w.lower() for w in _CAMEL.split(name) if w]
        t, at = self.tokens, n + 1
        if token.kind == "string" and t.said(at) == "," and t.said(n - 1 if n else 0) in ("(", ",") and t[at + 1] and t[at + 1].kind == "string" and t.said(at + 2) in (",", ")"):
            if _good_argument(name, self._inside(t[at + 1]), False):
                yield self._span(t[at + 1], "argument")
            return
        if token.kind == "word" and t.said(at) == "(" and sure and words[0] not in _ASKING:
            yield from self._arguments(at, name, words)
            return
        if not sure and not (words[-1:] == ["by"] and n and t.said(n - 1).lower() == "identified"):
            return
        if token.kind == "word" and self.text[max(0, token.start - 1) : token.start] in ("?", "&"):
            return  # a parameter of a URL
        while t.said(at) in ("]", "?", "!", '"', "'", "`") and t[at].kind == "mark":
            at += 1
        sign = t.said(at)
        if sign in _ASSIGNS or sign.lower() in _COPULAS and token.kind == "word":
            yield from self._assigned(name, sure, at, sign)
        elif sign.startswith("=") and sign.endswith(">"):
            yield from self._assigned(name, sure, at, sign)
        elif t[at] and t.inside(at) and t[at].kind == "string" and (sure == "sure" or not sure) and token.kind == "word":
            if self._password(t[at], True) and not re.fullmatch(r"[^\W\d_]+(?:[\s._:/-]+[^\W\d_]+)*[?!.:…]*", self._inside(t[at])):
                yield self._span(t[at], "argument")
        elif token.kind == "word" and (self.text[max(0, token.start - 1) : token.start] == "-" or name in ("password", "passwd")) and self.text[token.end : token.end + 1] in (" ", "\t"):
            yield from self._bare(name, sure, token.end, "")

    def _inside(self, token: Token) -> str:
        return self.text[token.inner : token.outer]

    def _span(self, token: Token, kind: str) -> tuple[int, int, str]:
        value = self._inside(token)
        return token.inner + len(value) - len(value.lstrip()), token.outer - len(value) + len(value.rstrip()), kind

    def _password(self, token: Token, sure: bool) -> bool:
        value = self._inside(token).strip()
        if not sure:
            return not re.search(r"\s", value) and _random_looking(value) and not _holds_place(value)
        return _written_out(value, True)

    def _within(self, token: Token) -> Iterator[tuple[int, int, str]]:
        """What a string holds that is itself an assignment: a connection string, a command, a document in a document."""
        if re.search(r"[:=]|\s-", self._inside(token)):
            inner = _Line(self.text, token.inner, min(token.outer, self.end))
            for a, b, kind in inner.found():
                if b <= token.outer:
                    yield a, b, kind

    def _arguments(self, at: int, name: str, words: list[str]) -> Iterator[tuple[int, int, str]]:
        """Literals among the arguments of a call named for a secret: those by position; named ones are assignments."""
        depth, n, setter = 0, at, words[0] in ("set", "with", "use")
        while token := self.tokens[n]:
            said = self.tokens.said(n)
            if token.kind == "string" and depth == 1 and self.tokens.said(self._before(n)) in ("(", ",") and self.tokens.said(self.tokens.past(n + 1)) in (",", ")", "+"):
                if _good_argument(name, self._inside(token).strip(), setter):
                    yield self._span(token, "argument")
            elif token.kind == "mark":
                depth += (said in ("(", "[", "{")) - (said in (")", "]", "}"))
                if depth <= 0 or said == ";":
                    return
            n += 1

    def _before(self, n: int) -> int:
        n -= 1
        while n > 0 and self.tokens[n].kind == "line":
            n -= 1
        return n

    def _assigned(self, name: str, sure: str, at: int, sign: str) -> Iterator[tuple[int, int, str]]:
        t, after = self.tokens, at + 1
        if sign in (":", "：", "=") and t.inside(after) and t[after].kind == "word" and t.said(after + 1) in ("=", ":="):
            after += 2  # a type stands between the name and the value
        line_end = not t.inside(after)
        token = t[after]
        if token is None:
            return
        if token.start >= self.end:
            yield from self._on_next_lines(sure, after)
            return
        value = t.past(after)
        opened = 0
        while t.said(value) == "(" and opened < 3:
            value, opened = t.past(value + 1), opened + 1
        token = t[value]
        if token and token.kind == "string":
            good = self._password(token, sure != "likely")
            if good and not (not line_end and t.said(value + 1) == "(") and not (token.start >= self.end and t.said(t.past(value + 1)) == ":"):
                if sure != "sure" or sign.lower() not in _COPULAS or not re.search(r"\s", self._inside(token)):
                    yield self._span(token, "named")
            return
        if sign == ":" and (m := _BLOCK.match(self.text[t[after].start : self.end])):
            yield from self._block(sure, m)
            return
        if here := _HERE.search(self.text, t[after].start, self.end):
            yield from self._here_document(sure, here["mark"])
        if not opened and sure:
            got = [*self._bare(name, sure, t[at].end, sign)]
            yield from got
            if got:
                return
        yield from self._fallback(sure, after)

    def _bare(self, name: str, sure: str, at: int, sign: str) -> Iterator[tuple[int, int, str]]:
        """A value without quotes on the line of its name."""
        while at < self.end and self.text[at] in " \t":
            at += 1
        m = _BARE.match(self.text, at, self.end)
        if not m:
            return
        value, after = m[0], self.text[m.end() : m.end() + 1]
        if sure == "sure":
            good = _written_out(value, False) and not (after in ("(", "["))
            if not good and sign == "=":
                line = self.text[self.start : self.end]
                literal = (whole := _SHELL_LINE.match(line)) and whole["bare"] == value or after in (";", '"', "'", "") and _CONNECTION.search(line)
                good = bool(literal) and _mixed(value) and _written_out(value, True)
        else:
            good = _random_looking(value) and not _holds_place(value) and after != "("
        if good:
            yield m.start(), m.end(), "named"

    def _fallback(self, sure: str, n: int) -> Iterator[tuple[int, int, str]]:
        """A literal that stands in for a missing variable: behind an ``or``, or the second argument of a look-up."""
        t, depth, looked_up = self.tokens, 0, False
        while t.inside(n):
            token, said = t[n], t.said(n)
            if token.kind == "mark":
                depth += (said in ("(", "[", "{")) - (said in (")", "]", "}"))
                if depth < 0 or said == ";" or depth == 0 and said == ",":
                    return
                looked_up = looked_up or said == "(" and t.said(n - 1).lower() in ("getenv", "get", "env", "getproperty", "environ")
            elif token.kind == "string" and n and (t.said(n - 1).lower() in _ELSE or looked_up and t.said(n - 1) == "," and t.said(n + 1) == ")"):
                value = self._inside(token)
                if self._password(token, sure != "likely") and not re.fullmatch(r"[^\W\d_]*(?:[\s._:/-]+[^\W\d_]+)*[?!.:…]*", value):
                    yield self._span(token, "named")
            n += 1

    def _on_next_lines(self, sure: str, n: int) -> Iterator[tuple[int, int, str]]:
        """A literal on the line after a name and its sign, unless it is the key of another entry."""
        value = self.tokens.past(n)
        token = self.tokens[value]
        if value != n + 1 or token is None or token.kind != "string" or self.tokens.said(self.tokens.past(value + 1)) in (":", "=>", "="):
            return
        if self._password(token, sure != "likely"):
            yield self._span(token, "named")

    def _block(self, sure: str, opened: re.Match) -> Iterator[tuple[int, int, str]]:
        m = _BLOCK_LINE.match(self.text, self.end)
        if m and (_written_out(m["first"], False) if sure == "sure" else _random_looking(m["first"]) and not _holds_place(m["first"])):
            last = m.end("first")
            while more := re.compile(rf"[ \t]*\r?\n{m['indent']}[ \t]*\S+(?=[ \t]*\r?(?:\n|\Z))").match(self.text, last):
                last = more.end()
            yield m.start("first"), last, "named"

    def _here_document(self, sure: str, mark: str) -> Iterator[tuple[int, int, str]]:
        """Lines of one word each; longer ones are prose or code."""
        m = re.compile(rf"\n[ \t]*(?P<lines>(?P<first>\S+)(?:[ \t]*\r?\n[ \t]*(?!{mark}\b)\S+)*)[ \t]*\r?\n[ \t]*{mark}\b").match(self.text, self.end)
        if m and (_written_out(m["first"], True) if sure == "sure" else _random_looking(m["first"]) and not _holds_place(m["first"])):
            yield *m.span("lines"), "named"

    def _in_tag(self, token: Token) -> Iterator[tuple[int, int, str]]:
        """The text of an element named for a secret, and its attributes, which are assignments like any other."""
        said = self.text[token.start + 1 : token.end - 1]
        name, _, rest = said.partition(" ")
        sure = _credential_name(name) if not said.startswith("/") else ""
        if sure and (m := _XML_VALUE.match(self.text, token.end)):
            value = m["value"]
            if _written_out(value, True) and not re.search(r"\s", value) if sure == "sure" else _random_looking(value) and not _holds_place(value):
                yield m.start("value"), m.end("value"), "named"
        if "=" in rest:
            for a, b, kind in _Line(self.text, token.start + 1 + len(name), token.end - 1).found():
                if b < token.end:
                    yield a, b, kind


def _in_line(text: str, start: int, end: int) -> Iterator[Secret]:
    for a, b, kind in (*_issued_and_carried(text, start, end, text[start:end]), *_Line(text, start, end).found()):
        parts, last = [*_parts(text, a, b)], b
        while last < len(text) and text[last] in "\"'`" and (more := _FOLLOW.match(text, last + 1)) and re.fullmatch(r"[\w+/=.~-]+", more[2]) and not _ENTRY.match(text, more.end()):
            parts.append(more.span(2))
            last = more.end(2)
        yield Secret(a, last, kind, tuple(parts))


def find_secrets(text: str | None) -> list[Secret]:
    """All secrets in order, without overlaps (of those that overlap the first and longest)."""
    if not text:
        return []
    low = text.replace("İ", "I").lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, done = [], -1
    for at, _ in _ANCHORS.iter(low):
        if at < done:
            continue
        start = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        end = done = len(text) if end < 0 else end
        found += _in_line(text, start, end)
        for m in _PEM.finditer(text, start, end):
            if key := _pem(text, m):
                found.append(key)
    found.sort(key=lambda s: (s.start, -s.end))
    kept: list[Secret] = []
    for s in found:
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
    return kept


def redact(text: str | None) -> str | None:
    """The text with each secret's content replaced; quotes, escapes, line ends and everything around stay."""
    return _replaced(text, find_secrets(text))


def _replaced(text: str | None, secrets: list[Secret]) -> str | None:
    if not secrets:
        return text
    out, at = [], 0
    for a, b in sorted({p for s in secrets for p in s.parts}):
        if a >= at:
            out += [text[at:a], REDACTED]
            at = b
    return "".join([*out, text[at:]])


def secret_lines(text: str | None) -> list[int]:
    """Numbers of the lines, from 1, on which a secret begins."""
    lines, at, n = [], 0, 1
    for s in find_secrets(text):
        n += text.count("\n", at, s.start)
        at = s.start
        if not lines or lines[-1] != n:
            lines.append(n)
    return lines


# --- over tables ------------------------------------------------------------------------------------------------


def credential_lines(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(chunk_id, line_no)`` of the lines on which a credential begins, each once.

    Null and empty texts and rows without a key have none; repeated rows count once; other columns are ignored. Texts
    aren't shuffled, only the lines found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                ids, lines = [], []
                for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    got = secret_lines(t)
                    ids += [i] * len(got)
                    lines += got
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], ["chunk_id", "line_no"])

    rows = chunks.select(chunks[key].cast("long").alias("id"), chunks[text].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "chunk_id long, line_no long").distinct()


def redacted_texts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of the input, with ``text`` redacted and ``n_secrets``, the number of secrets replaced."""
    kind = "struct<redacted:string,n:int>"

    @F.pandas_udf(kind)
    def run(texts):
        import pandas as pd

        found = [(t, find_secrets(t)) for t in texts]
        rows = [(_replaced(t, secrets), len(secrets)) for t, secrets in found]
        return pd.DataFrame(rows, columns=["redacted", "n"])

    rest = [chunks[c] for c in chunks.columns if c not in (text, "n_secrets")]
    done = chunks.select(*rest, run(chunks[text]).alias("_done"))
    return done.select(*[c for c in done.columns if c != "_done"], F.col("_done.redacted").alias(text), F.col("_done.n").alias("n_secrets"))
