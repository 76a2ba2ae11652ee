import pytest
from conftest import rows

from sparkweft.llm import pii

NAMES = [("Ada", "given"), ("Rose", "given"), ("Grace", "given"), ("Will", "given"), ("Ashabek", "family"), ("Coridt", "family"), ("墨", "family"), (None, "given")]
D = pii.Detector(NAMES)

FOUND = [
    ("cc: ada.x@example.org, b＠mail.example", [("ada.x@example.org", "email"), ("b＠mail.example", "email")]),
    ("write to ada+kb at example [dot] com now", [("ada+kb at example [dot] com", "email")]),
    ("f [at] dev [dot] team [dot] example", [("f [at] dev [dot] team [dot] example", "email")]),
    ("Call +49 30 23125 741 before", [("+49 30 23125 741", "phone")]),
    ("Tel: (760) 555-0119", [("(760) 555-0119", "phone")]),
    ("来电 01632 960 414", [("01632 960 414", "phone")]),
    ("SSN 956-80-0035，请勿外传", [("956-80-0035", "id_number")]),
    ("listed passport no. X5875 2780 by mistake", [("X5875 2780", "id_number")]),
    ("身份证号 997770195102073557", [("997770195102073557", "id_number")]),
    ("lives at 234B Flainthon Drive, Apt 03", [("234B Flainthon Drive", "address")]),
    ("寄至Klaillairtgasse 22, 13581 K", [("Klaillairtgasse 22", "address")]),
    ("at 92 bis, rue du Grensom, 45136 Q", [("92 bis, rue du Grensom", "address")]),
    ("Visit 云澜市青岚区霞街195号22室。", [("云澜市青岚区霞街195号22室", "address")]),
    ("I met Ada Coridt at the hall", [("Ada Coridt", "name")]),
    ("Reviewer: Ashabek, Noor", [("Ashabek, Noor", "name")]),
    ("Reported by Dr. Coridt.", [("Dr. Coridt", "name")]),
    ("联系人：墨舟，电话", [("墨舟", "name")]),
    ("由霁野屿提交", [("霁野屿", "name")]),
]
CLEAN = ["retry at 10.0.20.03:771", "@clesberk/adapter@24.4.1 replaces metric@11.0.0", "order 2025-2924-3, sku 7300c28b", "ISBN 979-0-1455-170-1 is only an order code", "@label decorators and @param tags", "Will the cache fail after the Grace Period?", "Mark each service; the Rose theme stays.",
    "Route 312 in the Thick router, Court of digests", "2025-01-28 11:23 digest[96] x", "span 3-2096, line 25", "自版本 3.499 起，镜像改为 03:40 解析，由 Flark 负责。路由改为", "loaded at src/index.ts", "", " \n", None]


@pytest.mark.parametrize("text,want", FOUND)
def test_found_and_replaced(text, want):
    spans = D.spans(text)
    assert [(text[s.start : s.end], s.kind) for s in spans] == want
    out = text
    for piece, kind in want:
        out = out.replace(piece, f"[{kind.upper()}]")
    assert pii.replaced(text, spans) == out


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert D.spans(text) == []


@pytest.mark.parametrize("text,name", [("I met Anna Wu at the hall", "Anna Wu"), ("Signed by Mr. Ng", "Mr. Ng"), ("Wei Li wrote", "Wei Li"), ("Автор: Иван Иванов", "Иван Иванов"), ("Пишет Г-н Иванов.", "Г-н Иванов"), ("Иван П. Иванов", "Иван П. Иванов")])
def test_short_and_cyrillic_names(text, name):
    detector = pii.Detector([("Anna", "given"), ("Wei", "given"), ("Wu", "family"), ("Li", "family"), ("Иван", "given"), ("Иванов", "family")])
    assert [(text[s.start : s.end], s.kind) for s in detector.spans(text)] == [(name, "name")]
    assert detector.spans("Anna Qx is a label") == []


def test_validators():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    assert pii.letter23("12345678Z") and not pii.letter23("12345678A")
    assert pii.resident_id("11010519491231002X") and not pii.resident_id("110105194912310021")


def test_tables(spark):
    text = "a\nTel: (760) 555-0119 or (761) 555-0119, a@b.example\r\nb@c.example"
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (None, text, 0), (4, "x " * 300_000 + "\na@b.example", 0)], "doc_id long, text string, kind int")
    assert rows(pii.personal_lines(df, NAMES)) == [(1, 2, "email"), (1, 2, "phone"), (1, 3, "email"), (4, 2, "email")]
    assert pii.personal_lines(df.limit(0), NAMES).count() == 0
    got = {r.doc_id: r.text for r in pii.anonymised(df, NAMES).where("doc_id < 4").collect()}
    assert got == {1: "a\nTel: [PHONE] or [PHONE], [EMAIL]\r\n[EMAIL]", 2: None, 3: ""}
    assert pii.known_names(spark.createDataFrame([("A", "given"), ("A", "given"), (None, "x"), ("", "given")], "name string, kind string")) == [("A", "given")]


def test_names_beyond_the_list_check_digits_and_long_mailboxes():
    d = pii.Detector([("Anna", "given"), ("Keller", "family")])
    found = lambda t: [(s.kind, t[s.start : s.end]) for s in d.spans(t)]
    assert found("Siobhan O'Rourke wrote the doc") == [("name", "Siobhan O'Rourke")]
    assert found("Contact: Priya Raghunathan") == [("name", "Priya Raghunathan")] and found("Contact: Platform Team") == []
    assert found("Dr. Nguyen is here") == [("name", "Dr. Nguyen")] and found("the Miss Rate grows") == []
    assert found("my number is 2125550134") == [("phone", "2125550134")]
    assert found("insured 046 454 286 since")[0][0] == "id_number" and found("insured 046 454 287 since") != found("insured 046 454 286 since")
    assert found("x" * 500 + "@host.example.org") == [("email", "x" * 500 + "@host.example.org")]
