"""Personal information: detection on hand-made cases, surrogates, placeholders and edge cases."""

import re

import pytest

from loomrecall.llm import personal as P
from loomrecall.llm import surrogates as S


def kinds(text):
    return sorted((k, text[a:b]) for k, a, b in P.find_entities(text))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to anna.b+x@mail.example now", [("email", "anna.b+x@mail.example")]),
        ("cc petra [at] post [dot] example please", [("email", "petra [at] post [dot] example")]),
        ("mail jo at mail dot example", [("email", "jo at mail dot example")]),
        ("<mailto:jo%40mail.example>", [("email", "mailto:jo%40mail.example")]),
        ("git clone git@code.host.test:team/repo.git", []),
        ("installed @scope/pkg@2.14.3 today", []),
        ("call +49 (0)30 23125173 or (796) 555-0111", [("phone", "(796) 555-0111"), ("phone", "+49 (0)30 23125173")]),
        ("Nobody picks up at +1 759 555 0197 before nine.", [("phone", "+1 759 555 0197")]),
        ("Text me at 735-555-0117 ext. 82 or at 07700 900508", [("phone", "735-555-0117 ext. 82"), ("phone", "07700 900508")]),
        ("offset 4915 3012 5880 in the byte map", []),
        ("IP 192.0.2.867 and 00:14:55.012, key=306-372-243-579", []),
        ("his file says 929-36-2029", [("id_number", "929-36-2029")]),
        ("ID card T7KK64G04, wants a copy", [("id_number", "T7KK64G04")]),
        ("build 20250114-0312 passed", []),
        ("ticket QQ-360 is open", []),
        ("lives at 106 Millpond Avenue, Quillstadt 00671.", [("address", "106 Millpond Avenue, Quillstadt 00671")]),
        ("Moved 12 Quarry Lane caches into one", []),
        ("send it to PO Box 860, Puerto Gris", [("address", "PO Box 860, Puerto Gris")]),
        ("Reviewed by Parity Check at 12:45", []),
        ("Reviewed by Hugo Garsadze.", [("name", "Hugo Garsadze")]),
        ("according to N. Tarnquist the queue", [("name", "N. Tarnquist")]),
        ("Haladze, Noor said so", [("name", "Haladze, Noor")]),
        ("It was Frau Ulmellano who", [("name", "Frau Ulmellano")]),
        ("Waiting for Мирослав Дравинов", [("name", "Мирослав Дравинов")]),
        ("привет мир", []),
        ("the half of nadia eckkamp", [("name", "nadia eckkamp")]),
        ("", []),
    ],
)
def test_entities(text, want):
    assert kinds(text) == sorted(want)


def test_long_text_and_json():
    text = "word " * 60000 + "jo@mail.example" + " 1" * 50000
    assert kinds(text) == [("email", "jo@mail.example")]
    body = '{"note": "see Darius Baskstr\\u00f6m", "n": 1}'
    assert [s for _, _, s in P.field_strings(body, True)][:1] == ["see Darius Baskström"]
    assert P.field_strings('{"a": "b', True)[0][2] is not None


SCHEMA_M = "id string, content struct<text:string,structured:string>, table_name string, body string"
SCHEMA_T = "id string, user_text string, assistant_text string, kind string, value string"


def frames(spark):
    m = spark.createDataFrame(
        [("m1", ("Hugo Garsadze, 07700 900325, hugo@mail.example", '{"owner": "Anna Berg", "k": [1, "Call Anna Berg"]}'), "x", "y"), ("m1", ("Hugo Garsadze, 07700 900325, hugo@mail.example", '{"owner": "Anna Berg", "k": [1, "Call Anna Berg"]}'), "x", "y"), ("m2", None, None, None), ("m3", (None, "{broken jo@mail.example"), None, None), (None, ("jo@mail.example", None), None, None)],
        SCHEMA_M,
    )
    t = spark.createDataFrame([("t1", "Ms Garsadze asked Hugo Garsadze", "", "a", "b"), ("t2", None, "   ", None, None)], SCHEMA_T)
    return m, t


def test_found_and_edges(spark):
    m, t = frames(spark)
    got = {tuple(r) for r in P.find_personal(m, t, "k").collect()}
    assert got == {
        ("memory_records", "m1", "content.text", "name"), ("memory_records", "m1", "content.text", "phone"), ("memory_records", "m1", "content.text", "email"),
        ("memory_records", "m1", "content.structured", "name"), ("memory_records", "m3", "content.structured", "email"), ("session_turns", "t1", "user_text", "name"),
    }
    assert P.find_personal(m.limit(0), t.limit(0), "k").count() == 0


def test_surrogates_are_distinct_and_coreferent(spark):
    m, t = frames(spark)
    got = {(r.row_key, r.field_name): r.body for r in P.redact_personal(m, t, "k").collect()}
    one, two = got[("m1", "content.text")], got[("t1", "user_text")]
    first, last = one.split(",")[0].split()
    assert two == f"Ms {last} asked {first} {last}" and "Hugo" not in one and "hugo@" not in one and "900325" not in one
    assert [c for c in one.split(",")[1] if c.isspace()] == [" ", " "]
    assert got[("m1", "content.structured")].startswith('{"owner": "') and '"k": [1, "Call ' in got[("m1", "content.structured")]
    marks = {(r.row_key, r.field_name): r.body for r in P.redact_personal(m, t, "k", placeholders=True).collect()}
    assert marks[("m1", "content.text")].count("[") == 3 and marks[("m3", "content.structured")].startswith("{broken [EMAIL_")


def test_collision_check(spark, monkeypatch):
    ent = spark.createDataFrame([([f"name:x{i}" for i in range(300)],)], "parts array<string>")
    real = P.draw
    monkeypatch.setattr(P, "draw", lambda part, key, n: real(part, key, n)[:2 + n])
    got = P.surrogates(ent, "k", rounds=20).collect()
    assert len(got) == 300 and len({r.surrogate for r in got}) == 300


def changed(kind, value, key="k"):
    return S.rewrite(kind, value, key, lambda p: S.draw(p, key, 0))


def test_surrogates_keep_the_form():
    assert re.fullmatch(r"[A-Z]\. [A-Z][a-z]{3,}", changed("name", "J. Smith")) and changed("name", "J. Smith")[0] == changed("name", "John Smith")[0] != "J"
    assert changed("name", "Frau Dr. Anna van den Berg").startswith("Frau Dr. ") and " van den " in changed("name", "Frau Dr. Anna van den Berg") and changed("name", "Anna Berg").split()[0].endswith("a")
    assert changed("name", "O'Brien-Lee").count("'") == changed("name", "O'Brien-Lee").count("-") == 1
    assert re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", changed("name", "Мирослав Дравинов")) and re.fullmatch(r"\w{3}", changed("name", "王小明"))
    assert re.fullmatch(r"[a-z]{4} \(at\) [a-z]{4} \(dot\) de", changed("email", "jane (at) corp (dot) de"))
    assert re.fullmatch(r"mailto:[a-z]{2}%40[a-z]{4}\.example", changed("email", "mailto:jo%40mail.example")) and changed("email", "Jo.B+x1@mail.co.uk").count(".") == 3
    one, two = changed("phone", "+49 (0)30 23125173 ext. 12"), changed("phone", "0049 30 23125173")
    assert re.fullmatch(r"\+49 \(0\)\d\d \d{8} ext\. \d\d", one) and re.fullmatch(r"0049 \d\d \d{8}", two) and re.sub(r"\D", "", one)[3:13] == two[5:].replace(" ", "")
    iban = changed("id_number", "DE89 3704 0044 0532 0130 00")
    assert iban.startswith("DE") and S._mod97(iban.replace(" ", "")) == 1 and [len(x) for x in iban.split()] == [4, 4, 4, 4, 4, 2]
    assert S.luhn(changed("id_number", "4111-1111-1111-1111").replace("-", "")) and re.fullmatch(r"\d{3}-\d\d-\d{4}", changed("id_number", "929-36-2029"))
    assert re.fullmatch(r"Calle [A-Z][a-z]+ \d\d, \d{5} [A-Z][a-z]+", changed("address", "Calle Mayor 12, 28013 Madrid"))
    assert re.fullmatch(r"[A-Z][a-z]+straße \d", changed("address", "Hauptstraße 7")) and re.fullmatch(r"PO Box \d{3}, [A-Z][a-z]+ [A-Z][a-z]+", changed("address", "PO Box 860, Puerto Gris"))
    assert changed("name", "Anna Berg", "k") != changed("name", "Anna Berg", "l")


def test_every_kind_changes():
    for kind, value in (("name", "Li Wu"), ("email", "a@b.de"), ("phone", "07700 900508"), ("id_number", "T7KK64G04"), ("address", "12 Via Roma")):
        assert changed(kind, value) != value


@pytest.mark.parametrize("name", ["Priyanka Chopra", "Barack Obama", "Angela Merkel", "Xi Jinping", "Keisha Johnson", "Tolkien Zubrowka"])
def test_names_outside_the_list(name):
    for text in (f"Yesterday {name} said the index was stale.", f"We met {name} at the gate.", f"The note was emailed to {name}, who agreed."):
        assert kinds(text) == [("name", name)]


def test_names_of_components_are_none():
    for text in ("Yesterday Vector Blender reported a fault.", "The Quiet Lantern said nothing", "We asked Claude Code Review", "Visual Studio will open", "Monday Morning said", "We met Project Phoenix"):
        assert kinds(text) == []


def test_chinese():
    assert kinds("联系人：王小明，手机13812345678，北京市海淀区中关村路12号。") == sorted([("name", "王小明"), ("phone", "13812345678"), ("address", "北京市海淀区中关村路12号")])
    assert kinds("run 13812345678 in 12 ms") == [] and kinds("向量索引已更新") == []


def test_surrogates_avoid_entities_that_occur(spark, monkeypatch):
    ent = spark.createDataFrame([([f"name:x{i}" for i in range(40)] + [f"name:y{i}" for i in range(40)],)], "parts array<string>")
    monkeypatch.setattr(P, "draw", lambda part, key, n: part.split(":")[1].replace("x", "y") if n == 0 else f"{part}z{n}")
    got = {r.part: r.surrogate for r in P.surrogates(ent, "k").collect()}
    assert len(got) == len(set(got.values())) == 80 and not {f"name:{s}" for s in got.values()} & set(got)


def test_key_is_needed(spark):
    with pytest.raises(ValueError):
        P.replace_personal(*frames(spark), key="")


def test_parts_that_were_drawn_again_reach_their_texts(spark, monkeypatch):
    m, t = frames(spark)
    real = P.draw
    monkeypatch.setattr(P, "draw", lambda part, key, n: "garsadze" if n == 0 and part.startswith("name:") else real(part, key, n))
    got = {(r.row_key, r.field_name): r.body for r in P.redact_personal(m, t, "k").collect()}
    first, last = got[("m1", "content.text")].split(",")[0].split()
    assert got[("t1", "user_text")] == f"Ms {last} asked {first} {last}" and first != last and "garsadze" not in " ".join(got.values()).lower()
    assert {tuple(r) for r in P.find_personal(m, t, "k").collect()} >= {("memory_records", "m1", "content.text", "name"), ("session_turns", "t1", "user_text", "name")}
