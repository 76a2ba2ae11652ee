"""Personal information inside free text: spans proposed by patterns, scored by validators and context, then replaced."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
ENOUGH = 3
_SLICE = 256


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# --- validators ---------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The check digit of payment cards and many national numbers."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(code: str) -> bool:
    """The check of account numbers: letters count as 10 to 35, the first four signs go last."""
    code = re.sub(r"\W", "", code).upper()
    return len(code) > 4 and code.isalnum() and code.isascii() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def resident_id(code: str) -> bool:
    """The check sign of 18-digit resident cards: a weighted sum modulo 11."""
    return bool(re.fullmatch(r"\d{17}[\dXx]", code)) and "10X98765432"[sum(int(c) * (2 ** (17 - n) % 11) for n, c in enumerate(code[:17])) % 11] == code[17].upper()


def letter23(code: str) -> bool:
    """Eight digits and the letter that their remainder by 23 selects."""
    return bool(re.fullmatch(r"\d{8}[A-Z]", code)) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(code[:8]) % 23] == code[8]


def _checked(number: str) -> bool:
    """Whether any of the check digits holds that such a number may have."""
    plain = re.sub(r"[\s./-]", "", number)
    return any(check(plain) for check in (resident_id, letter23, mod97)) or plain.isdigit() and len(plain) >= 9 and luhn(plain)


# --- patterns -----------------------------------------------------------------------------------------------------

_B = r"[ \t\u00a0\u2009\u202f]"
#: Where a mailbox may be: the sign itself, "at" in brackets, or "at" between blanks.
_AT = re.compile(r"[@＠﹫]|(?<=[\[({<])[ \t]*(?:at|AT|At|ät)[ \t]*(?=[\])}>])|(?<=[ \t])(?P<spoken>at|AT)(?=[ \t])")
_DOT = rf"(?:[.．。｡]|{_B}*[\[({{]{_B}*(?:dot|DOT|\.){_B}*[\])}}]{_B}*|{_B}+(?:dot|DOT|punkt|punto){_B}+)"
_LOCAL = re.compile(rf"(?<![\w.+%-])[^\W_](?:[\w.+%-]|{_B}*[\[(]dot[\])]{_B}*)*{_B}*[\[({{<]?{_B}*\Z")
_MAILBOX = re.compile(rf"[\w.+%-]+{_B}*[\[({{<]?{_B}*")
_DOMAIN = re.compile(rf"{_B}*[\])}}>]?{_B}*[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+(?!\w)")
#: Ends of host names that are accepted after a spoken "at", which also stands before files and times.
_HOST_END = re.compile(r"(?i)(?:example|test|invalid|localhost|com|org|net|edu|gov|int|mil|info|biz|name|io|dev|app|ai|co|de|fr|es|it|nl|uk|us|ch|at|be|se|no|fi|dk|pl|cz|pt|ru|ua|cn|jp|kr|in|br|mx|ca|au|nz|eu)$")

_PHONE = re.compile(r"(?<![\w.,:/+#-])(?P<number>(?:\+|\(?0|\(?[1-9])[\d()][\d()./\u2010-\u2013 \t\u00a0-]{5,20}\d)(?P<ext>(?:\s?(?:ext|x|Durchwahl|доб)\.?\s?\d{1,5})?)(?![\w@]|[-./:]\d)")
_PHONE_SHAPES = re.compile(
    r"\+\d{8,15}|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}|00\d{1,3}(?:[ .-]\d{1,9}){2,6}|(?:1[ .-])?\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}"
    r"|\(0\d{1,4}\)[ -]?\d{3,5}(?:[ -]\d{3,5}){0,2}|0\d(?:[ .]\d\d){4}|0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}|0\d{3,5}[ /-]\d{5,7}|1[3-9]\d[ -]?\d{4}[ -]?\d{4}"
)
_CALLS = re.compile(r"(?i)(?:\bmy (?:\w+ )?number\b|\breach (?:me|us|her|him|them)\b|\bring (?:me|us)\b|\btel\b|telef|phone|\bcall\b|mobil|handy|\bcell\b|\bfax\b|reachable|whatsapp|\bsms\b|dial|rufnummer|电话|來電|来电|手机|致电|тел\b|звон|llam|\bappel)")
_ORDERS = re.compile(r"(?i)(?:\b(?:order|ticket|isbn|issn|build|sku|span|line|column|version|release|invoice|retry|port|hash|commit|rfc|pid)\b|№ заказа|订单|\bat \d|\bts=)[^\n.!?]{0,14}$")

_ID_WORD = (
    r"(?:(?:US )?SSN|social security(?: number| no\.?)?|national (?:id(?:entity)?|insurance)(?: number| card| no\.?)?|identity (?:card|number)|id card|ID[- ](?:card|number|no\.?|nr\.?)"
    r"|passport(?: number| no\.?| nr\.?)?|reisepass(?:nummer|nr\.?)?|(?:personal)?ausweis(?:nummer|nr\.?)?|steuer-?(?:id(?:entifikationsnummer)?|nummer|nr\.?)|tax (?:id|number|no\.?|identification number|file number)|TIN|ITIN|VAT(?: number| no\.?| ID)?"
    r"|NIR|DNI|NIE|NIF|CPF|CURP|BSN|PESEL|ИНН|СНИЛС|паспорт|numéro de sécurité sociale|n° de sécu|driver(?:'s|s)? licen[cs]e(?: number| no\.?)?|driving licen[cs]e(?: number| no\.?)?|licen[cs]e (?:number|no\.?)|führerschein(?:nummer|nr\.?)?|permis de conduire"
    r"|身份证(?:号码?)?|护照(?:号码?)?|驾照(?:号码?)?|驾驶证(?:号码?)?|社保(?:号码?)?|税号|纳税人识别号)"
)
_ID = re.compile(rf"(?i)(?<![^\W\d_\u3400-\u9fff]){_ID_WORD}{_B}*(?:is|lautet|[:：#=]|nº|号码?|为|是)?{_B}*(?:no\.?|nr\.?|number)?{_B}*[:：#]?{_B}*(?P<number>[A-Z0-9](?:[A-Z0-9]|[ ./-](?=[A-Z0-9])){{4,24}})(?!\w)")
_ID_TAIL = re.compile(r"(?:[ ./-][a-z]{2,}|[ ./-][A-Za-z]?[a-z]+)+$|[ ][A-Za-z]{2,}$")
_ID_BARE = re.compile(r"(?<![\w./-])(?:\d{3}-\d{2}-\d{4}|\d{6}(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-]|[./]\d)")

#: Digits in groups that say nothing by themselves, and words near them that hint at an id.
_ID_GROUPS = re.compile(r"(?<![\w./:+-])\d{3}[ -]\d{3}[ -]\d{3}(?![\w-]|[./:]\d|[ -]\d)")
_ID_NEAR = re.compile(r"(?i)\b(?:sin|social|insur(?:ed|ance)|citizen|resident|residence|permit|identity|holder|taxpayer|id)\b[^\n]{0,20}\Z")

_CAP = r"[A-ZÀ-ÖØ-ÞĀ-ŽЀ-Я][\w'’]*"
#: Latin letters, digits and joints; other scripts may stand right before an address.
_L = r"(?<![A-Za-z0-9\u00c0-\u024f.,/-])"
#: Per convention of writing an address: words of which a text must hold one, and the pattern of street and number.
_ADDRESSES = [
    (
        (" Street", " St", " Road", " Rd", " Ave", " Drive", " Dr", " Ter", " Court", " Ct", " Sq", " Boulevard", " Blvd", " Lane", " Ln", " Way", " Pl", " Cres", " Close", " Highway", " Hwy", " Parkway", " Pkwy", " Row", " Walk", " Mews", " Gardens", " Grove", " Hill", " Alley", " Quay"),
        rf"{_L}\d{{1,5}}[A-Za-z]?{_B}(?:{_CAP}{_B}){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Terrace|Ter|Court|Ct|Square|Sq|Boulevard|Blvd|Lane|Ln|Way|Place|Pl|Crescent|Cres|Close|Highway|Hwy|Parkway|Pkwy|Row|Walk|Mews|Gardens|Grove|Hill|Alley|Quay)\b\.?",
    ),
    (
        ("str.", "stra", "Stra", "Str.", "gasse", "Gasse", "weg ", "Weg ", "latz ", "llee ", "amm ", "ufer ", "ing ", "steig ", "chaussee "),
        rf"{_L}[A-ZÄÖÜ][\w'’ß-]*(?:str\.|straße|strasse|gasse|weg|platz|allee|damm|ufer|ring|steig|chaussee){_B}\d{{1,4}}{_B}?[a-z]?(?![\w:.]*\d)"
        rf"|{_L}(?:[A-ZÄÖÜ][\w'’ß-]*{_B}){{1,2}}(?:Straße|Str\.|Gasse|Weg|Platz|Allee|Ring|Damm){_B}\d{{1,4}}[a-z]?\b",
    ),
    (
        ("rue ", "venue ", "oulevard ", "bd ", "lace ", "hemin ", "llée ", "mpasse ", "uai ", "oute ", "ours "),
        rf"{_L}\d{{1,4}}(?:{_B}(?:bis|ter|quater))?,?{_B}(?:[Rr]ue|[Aa]venue|[Bb]oulevard|bd|[Pp]lace|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours){_B}(?:de la |de l['’]|du |des |de |d['’])?{_CAP}",
    ),
    (
        ("Calle", "C/", "Aven", "Avda", "Plaza", "Paseo", "Carrera", "Camino", "Via", "Piazza", "Rua", "Praça"),
        rf"{_L}(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Carrera|Camino|Via|Viale|Piazza|Rua|Praça){_B}(?:(?:de la|del|de los|de|la|el|da|do){_B})?(?:{_CAP}{_B}?){{1,3}},?{_B}?(?:n\.?º{_B}?)?\d{{1,5}}\b",
    ),
    (("ул", "просп", "пр-т", "пер"), rf"(?:ул\.|улица|проспект|пр-т|переулок|пер\.){_B}?[А-ЯЁ][\w-]*,?{_B}(?:д\.|дом)?{_B}?\d{{1,4}}"),
    (("号", "號"), r"(?:[\u4e00-\u9fff]{1,4}[省市区县镇]){0,3}[\u4e00-\u9fff]{1,4}?(?:路|街|大道|巷|胡同|弄)\d{1,5}[号號](?:\d{1,5}[室楼栋幢号])*"),
]
_ADDRESSES = [(words, re.compile(pattern)) for words, pattern in _ADDRESSES]
#: A text without any of these, lower-cased, has no word that announces an id number.
_ID_HINTS = ("social", "national", "identi", "id card", "id-", "id n", "passport", "ausweis", "reisepass", "steuer", "tax ", "инн", "снилс", "паспорт", "curité", "n° de", "licen", "schein", "permis", "证", "护照", "驾照", "社保", "税")
_ID_SHORT = re.compile(r"(?i:\b(?:ssn|tin|itin|vat|nir|dni|nie|nif|cpf|curp|bsn|pesel)\b)")
#: Titles that hardly stand before anything but a name.
_FIRM = re.compile(r"(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herr|Frau|Mme|Mlle|Señora?|Г-н|Г-жа)\Z")
#: What stands behind a label but is no person, and the shapes of family names that need no list.
_BODIES = re.compile(r"(?i)(?:team|support|service|services|group|department|centre|center|office|desk|inc|ltd|gmbh|labs?|systems?|committee|board|project|server|cluster|admins?|engineering|platform|operations|research|security|sales|marketing|finance|community|foundation|university|institute|company|street|road|page|list|queue|index|store|cache|table|report|number|address|name|date|status|version)s?\Z")
_FAMILY_SHAPE = re.compile(r"(?:O['’]|Mc|Mac|Fitz|D['’])[A-ZÀ-Þ]\w+\Z")
_LABEL = re.compile(r"""(?i)\b(?:contact(?: person)?|full name|applicant|patient|customer name|employee|attn|attention|ansprechpartner(?:in)?|kontaktperson)["']?\s*[:：=]\s*["']?\Z""")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Don|Doña|Г-н|Г-жа)"
_NAME = re.compile(
    rf"(?<![\w-])(?=(?:(?P<title>{_TITLE})\.?{_B}(?:{_CAP}{_B})?(?P<tf>{_CAP})(?![\w-])|(?P<g>{_CAP}(?:-{_CAP})?)(?:{_B}[A-ZЀ-Я]\.)*{_B}(?P<f>{_CAP}(?:-{_CAP})?)(?![\w-])|(?P<f2>{_CAP}),{_B}(?P<g2>{_CAP}(?:-{_CAP})?)(?:{_B}[A-ZЀ-Я]\.)*(?![\w-])))(?P<at>{_CAP})"
)
_BEFORE = re.compile(
    r"""(?i)(?:\b(?:met|reviewer|reviewed by|author|authors|reported by|submitted by|written by|signed by|approved by|thanks to|thank|applicant|user|username|full name|name|contact|ask for|attn|attention|dear|hello|hi|regards|sincerely|customer|patient|employee|assignee|owner|signed|manager|(?:from|to|cc)(?=\s*:))\b["']?\s*(?:[:=-]+\s*)?["'(<]?|\|\s*)$"""
)
_AFTER = re.compile(r"""(?i)(?:\s+(?:wrote|said|reported|asked|lives|called|joined|signed|approved|reviewed|submitted|replied|confirmed|and I|at the [^.\n]{1,60} and we)\b|\s*\|\s*[+(\d]|,\s*asked\b|["']?\s*[,;]?\s*["']?(?:phone|email|tel)\b)""")
_HAN_NAME = re.compile(
    r"(?:(?P<label>联系人|负责人|申请人|收件人|作者|审核人|经办人|用户名?|姓名|客户|患者|员工)[：:\s]+|(?<![路理自缘])由|感谢|谢谢|请找)(?P<name>[\u4e00-\u9fff·]{2,4}?)"
    r"(?=(?P<does>提交|审核|编写|撰写|反馈|处理|发起|确认)|[，,。；;、\s)）]|负责|已|的|和|与|先生|女士|$)",
    re.M,
)
_HAN_TAKER = re.compile(r"(?:^|[，,。；;、\s])(?P<name>[\u4e00-\u9fff]{2,4}?)(?=收(?:[，,。；;\s]|$)|先生|女士|老师(?:[，,。\s]|$))", re.M)
_HAN_OTHER = re.compile(r"^(?:待定|某某|匿名|本人|我们|他们|你们|大家|系统|用户|管理员|工具|自动|人工|团队|所有|全部|已经|其他)")


class Detector:
    """Finds spans in one text after another. ``given`` and ``family`` are known parts of names; endings of known family
    names tell whether an unknown word may be one."""

    def __init__(self, names: Iterable[tuple[str | None, str | None]]):
        known = [(n, k) for n, k in names if n]
        self.given = {n.lower() for n, k in known if k == "given"}
        self.family = {n.lower() for n, k in known if k == "family"}
        self.endings = {n[-3:] for n in self.family if n.isascii() and len(n) > 4}
        self.han = {n for n in self.family if "\u4e00" <= n[0] <= "\u9fff"}

    def _emails(self, text: str) -> Iterator[Span]:
        for m in _AT.finditer(text):
            domain = _DOMAIN.match(text, m.end())
            local, at = None, m.start()
            while domain and local is None and at > 0:  # a mailbox longer than what was looked at goes on farther back
                at = max(0, 2 * at - m.start() - 100)
                local = _LOCAL.search(text, at, m.start())
                if not _MAILBOX.fullmatch(text, at, m.start()):
                    break
            if not local:
                continue
            end = re.split(_DOT, domain[0])[-1]
            if not end.isalpha() or len(end) < 2 or text[max(0, local.start() - 3) : local.start()] == "://":
                continue
            if m["spoken"] and (not _HOST_END.match(end) or local[0].strip().isdigit() or text[local.start() - 1 : local.start()] in "/\\'`"):
                continue
            yield Span(local.start(), domain.end(), "email")

    def _ids(self, text: str) -> Iterator[Span]:
        """Numbers by label, by shape, or by check digits: a label says most, then a shape that only such numbers have; a
        check digit that holds adds to any of them, and without a label or such a shape it is what decides."""
        low = text.lower()
        for m in _ID.finditer(text) if any(w in low for w in _ID_HINTS) or _ID_SHORT.search(text) else ():
            number = _ID_TAIL.sub("", m["number"])
            digits = re.sub(r"\D", "", number)
            score = 2 + (len(digits) >= 5) - 2 * (len(re.findall(r"[A-Za-z]{5,}", number)) > 0) - (len(digits) < 5) + 2 * _checked(number)
            if score >= ENOUGH and len(digits) >= 3:
                yield Span(m.start("number"), m.start("number") + len(number), "id_number")
        for m in _ID_BARE.finditer(text):
            score = 2 + (m[0][3:4] == "-") + 2 * (resident_id(m[0]) or m[0][0].isalpha() and mod97(m[0])) + (len(m[0]) == 18 and m[0][:17].isdigit())
            if score - 3 * bool(_ORDERS.search(text, max(0, m.start() - 30), m.start())) - 2 * (m[0][0].isalpha() and not mod97(m[0])) >= ENOUGH:
                yield Span(m.start(), m.end(), "id_number")
        for m in _ID_GROUPS.finditer(text):
            score = 1 + bool(_ID_NEAR.search(text, max(0, m.start() - 30), m.start())) + _checked(m[0]) - 3 * bool(_ORDERS.search(text, max(0, m.start() - 30), m.start()))
            if score >= ENOUGH:
                yield Span(m.start(), m.end(), "id_number")

    def _phones(self, text: str) -> Iterator[Span]:
        for m in _PHONE.finditer(text):
            number = m["number"].strip()
            digits = re.sub(r"\D", "", number)
            if not 8 <= len(digits) <= 15 or re.match(r"(?:19|20)\d\d[-./]\d", number) or number.count("(") != number.count(")"):
                continue
            plain = re.sub(r"[\u2010-\u2013]", "-", re.sub(r"[\t\u00a0]", " ", number))
            score = 3 if _PHONE_SHAPES.fullmatch(plain) else 1
            start = text.rfind("\n", 0, m.start()) + 1
            score += 2 * bool(_CALLS.search(text, max(start, m.start() - 30), m.start())) + bool(m["ext"])
            score -= 3 * bool(_ORDERS.search(text, max(start, m.start() - 20), m.start()))
            if score >= ENOUGH:
                yield Span(m.start(), m.end(), "phone")

    def _addresses(self, text: str) -> Iterator[Span]:
        for words, pattern in _ADDRESSES:
            if any(w in text for w in words):
                for m in pattern.finditer(text):
                    yield Span(m.start(), m.end(), "address")

    def _part(self, word: str, known: set[str]) -> bool:
        return any(p.lower() in known for p in word.split("-"))

    def _names(self, text: str) -> Iterator[Span]:
        linked = -1
        for m in _NAME.finditer(text):
            kind = "t" if m["title"] else "g" if m["f"] else "f"
            first, last, end = {"t": ("", m["tf"], m.end("tf")), "g": (m["g"], m["f"], m.end("f")), "f": (m["g2"], m["f2"], m.end("g2"))}[kind]
            score = 3 * self._part(last, self.family) or 1 * (last[-3:].lower() in self.endings and len(last) > 4)
            score += 2 * self._part(first, self.given) if first else 2 + bool(_FIRM.match(m["title"]) and not _BODIES.match(last) and not last.isupper())
            score += bool(first) and bool(_FAMILY_SHAPE.match(last))
            if first and score < ENOUGH and not _BODIES.match(last) and not _BODIES.match(first) and _LABEL.search(text, max(0, m.start() - 40), m.start()):
                score += 2 + (len(first) > 2 and first[1:].islower() and last[1:].islower())
            if not score:
                continue
            if score < ENOUGH:
                start = text.rfind("\n", 0, m.start()) + 1
                score += 2 * (bool(_BEFORE.search(text, max(start, m.start() - 28), m.start())) or linked == m.start() or bool(_AFTER.match(text, end)))
                if first and not self._part(first, self.given) and not (len(first) > 2 and first[0].isupper()):
                    score -= 1
            if score >= ENOUGH and (len(last) > 2 or kind == "t" or self._part(last, self.family)):
                yield Span(m.start(), end, "name")
                if more := re.compile(rf",?{_B}(?:and|und|y|et|&|и){_B}").match(text, end):
                    linked = more.end()

    def _han_names(self, text: str) -> Iterator[Span]:
        for pattern, signs in ((_HAN_NAME, ("人", "由", "作者", "用户", "姓名", "客户", "患者", "员工", "谢", "请找")), (_HAN_TAKER, ("收", "先生", "女士", "老师"))):
            for m in pattern.finditer(text) if any(s in text for s in signs) else ():
                word = m["name"]
                called = pattern is _HAN_TAKER or m["label"] or m["does"]
                if not _HAN_OTHER.match(word) and (word[0] in self.han or called and len(word) <= 3):
                    yield Span(m.start("name"), m.end("name"), "name")

    def spans(self, text: str | None) -> list[Span]:
        """All spans in order without overlaps; of two that overlap, the kind that is more certain stays."""
        if not text or text.isspace():
            return []
        taken: list[Span] = []
        free = bytearray(len(text))
        finders = [self._emails, self._ids, self._addresses, self._phones, self._names]
        if re.search(r"[\u4e00-\u9fff]", text):
            finders.append(self._han_names)
        for find in finders:
            for s in find(text):
                if not any(free[s.start : s.end]):
                    free[s.start : s.end] = b"\1" * (s.end - s.start)
                    taken.append(s)
        return sorted(taken)


def replaced(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span as ``[KIND]``, all else unchanged."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


# --- over tables --------------------------------------------------------------------------------------------------


def known_names(name_ref: DataFrame) -> list[tuple[str, str]]:
    """The table of known name parts, which is fixed and does not grow with the data, for every worker."""
    return [(r[0], r[1]) for r in name_ref.select("name", "kind").where("name IS NOT NULL AND name <> ''").distinct().collect()]


def personal_lines(documents: DataFrame, names: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, kind)`` of the lines on which a piece of personal information begins, once per kind.

    Lines count from 1 and end at a line feed. Null, empty and blank texts and rows without a key have none; repeated
    rows count once; other columns are ignored. Texts aren't shuffled, only what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(names)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                rows: tuple[list, list, list] = ([], [], [])
                for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    n, last, seen = 1, 0, set()
                    for s in detector.spans(t):
                        n += t.count("\n", last, s.start)
                        last = s.start
                        if (n, s.kind) not in seen:
                            seen.add((n, s.kind))
                            for column, value in zip(rows, (i, n, s.kind)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], ["doc_id", "line_no", "kind"])

    rows = documents.select(documents[key].cast("long").alias("id"), documents[text].alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, line_no long, kind string").distinct()


def anonymised(documents: DataFrame, names: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """All rows and columns of the input, each piece of personal information in ``text`` as a placeholder of its kind."""

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(names)
        for texts in batches:
            yield texts.map(lambda t: replaced(t, detector.spans(t)), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.withColumn(text, F.pandas_udf(run, "string")(documents[text]))
