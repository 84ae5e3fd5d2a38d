import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii as P

KEY = b"k"
I = P.Inventory([("Mara", "Quill"), ("Orlin", "Harrowgate")], frozenset("简阮"), frozenset("榆汀岚"), frozenset({"霧坂", "露木原"}), frozenset({"灯里", "碧人"}))

CASES = [
    ("Mail mara+jobs [at] post [dot] ellerby [dot] invalid now", [("email", "mara+jobs [at] post [dot] ellerby [dot] invalid")]),
    ("发到q.x at halden dot example即可，3.5@20，@halden_docs", [("email", "q.x at halden dot example")]),
    ("メールはa_b @ orrin-pumps.exampleへ", [("email", "a_b @ orrin-pumps.example")]),
    ("Phone: 07700 900 840\nFax: 1-800-555-0179 ext. 89", [("phone", "07700 900 840"), ("phone", "1-800-555-0179 ext. 89")]),
    ("Tel.: +49 (0)69 90009068. Order no. 238425269226836109", [("phone", "+49 (0)69 90009068")]),
    ("微信同号 ００８６１９９００００８３６１，电话（0990）55508616", [("phone", "００８６１９９００００８３６１"), ("phone", "（0990）55508616")]),
    ("Passport no. QQ 76 18 65 C was checked. Part HX-555-4217", [("id_number", "QQ 76 18 65 C")]),
    ("证件号码：99669619620330589x\n运单415675576433", [("id_number", "99669619620330589x")]),
    ("ISBN 978-0-8268-3742-2, Job 20250312-852043, 2022-08-22", []),
    ("Send it to Flat 4B, 219 Bellwether Street, Callowford. Street names stay.", [("address", "Flat 4B, 219 Bellwether Street, Callowford")]),
    ("of 253 Tallow Lane\nStonemere 80946. P.O. Box 2, Norrhaven 03081, the", [("address", "253 Tallow Lane\nStonemere 80946"), ("address", "P.O. Box 2, Norrhaven 03081")]),
    ("wohnt jetzt Alte Fährstraße 304b, D-91750 Norrhafen.", [("address", "Alte Fährstraße 304b, D-91750 Norrhafen")]),
    ("本人简榆，现居青岚市云岭县石榴巷310号9栋721室。", [("person", "简榆"), ("address", "青岚市云岭县石榴巷310号9栋721室")]),
    ("住所：〒400-0934 汐見市灯台町4丁目26-20 楡荘391号室\nです", [("address", "〒400-0934 汐見市灯台町4丁目26-20 楡荘391号室")]),
    ("Ms. Mara K. Quill-Harrowgate agreed; Quill, Mara; M. Quill; ORLIN QUILL", [("person", "Mara K. Quill-Harrowgate"), ("person", "Quill, Mara"), ("person", "M. Quill"), ("person", "ORLIN QUILL")]),
    ("霧坂さんから電話。担当の露木原　灯里が伺います", [("person", "霧坂"), ("person", "露木原　灯里")]),
    ("客服: hi\n阮汀岚：好", [("person", "阮汀岚")]),
    ("Quarrystone Cement moved to Tallow Yard.", []),
]


def test_finds():
    for text, wanted in CASES:
        assert [(k, text[a:b]) for k, a, b in P.find(text, I)] == wanted, text


def test_feistel_is_a_permutation_with_an_inverse():
    for size in (1, 2, 10, 97, 1000):
        image = [P.feistel(v, size, KEY) for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [P.unfeistel(v, size, KEY) for v in image] == list(range(size))
    rng = random.Random(1)
    for _ in range(50):
        v = rng.randrange(10**15)
        assert P.unfeistel(P.feistel(v, 10**15, KEY, b"t"), 10**15, KEY, b"t") == v


def test_pseudonyms_keep_the_format_and_link():
    a = P.pseudonym("phone", "+1 312 555 0153", KEY)
    assert len(a) == 15 and a[:3] == "+1 " and a[6] == " " and a != "+1 312 555 0153"
    assert "".join(c for c in P.pseudonym("phone", "+1-312-555-0153", KEY) if c.isdigit()) == "".join(c for c in a if c.isdigit())
    assert P.pseudonym("phone", "+1 312 555 0153 ext. 89", KEY).startswith(a + " ext. ")
    assert P.pseudonym("phone", "+49 (0)69 90009068", KEY)[:7] == "+49 (0)" and P.pseudonym("phone", "０７７００９００８４０", KEY)[:2] == "０７"
    assert P.pseudonym("person", "Quill, Mara", KEY) == P.pseudonym("person", "mara QUILL", KEY) != P.pseudonym("person", "mara QUILL", b"other")


def test_check_digits_stay_right_or_wrong():
    right, wrong = "11010519491231002X", "110105194912310021"
    new, other = P.pseudonym("id_number", right, KEY), P.pseudonym("id_number", wrong, KEY)
    assert P.check_character(new[:17]) == new[17] and P.check_character(other[:17]) != other[17] and new != other
    assert 1800 <= int(new[6:10]) < 2100 and 1 <= int(new[10:12]) <= 12 and 1 <= int(new[12:14]) <= 31
    assert P.check_of_10("8609574271") == "9" and P.check_of_11("12345678901") == "8"
    tax = P.pseudonym("id_number", "86 095 742 719", KEY)
    digits = tax.replace(" ", "")
    assert [len(x) for x in tax.split()] == [2, 3, 3, 3] and P.check_of_10(digits[:10]) == digits[10]
    letters = P.pseudonym("id_number", "C01X00T47", KEY)
    assert [c.isdigit() for c in letters] == [c.isdigit() for c in "C01X00T47"] and letters[0] + letters[3] + letters[6] != "CXT"


_D = st.text("0123456789", min_size=1, max_size=1)
_FORMS = [
    ("phone", "+49 (0)dd dddddddd"), ("phone", "+86 1ddddddddddd"), ("phone", "00dddddddddddd"), ("phone", "1-ddd-ddd-dddd"), ("phone", "(0ddd) dddddddd"), ("phone", "ddd-ddd-dddd ext. dd"), ("phone", "07ddd ddd ddd"), ("phone", "139dddddddd"),
    ("phone", "0d-dddd-dddd"), ("id_number", "AA dd dd dd B"), ("id_number", "dddddd19ddddddddddX"), ("id_number", "dddddd19900101dddd"), ("id_number", "dddddd189912319dddx"), ("id_number", "dd dddddd A ddd"), ("id_number", "ddd-dd-dddd"),
    ("id_number", "dddd dddd dddd"), ("id_number", "dd ddd ddd ddd"), ("id_number", "Addddddd"), ("id_number", "AdddAAd9dd"), ("id_number", "dddddddddX"),
]


@given(st.sampled_from(_FORMS), st.lists(_D, min_size=20, max_size=20), st.lists(st.sampled_from("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), min_size=4, max_size=4), st.sampled_from("ABCD"))
@settings(max_examples=600, deadline=None)
def test_formats_hold_and_only_the_key_reads_back(form, digits, letters, last):
    kind, pattern = form
    d, a = iter(digits), iter(letters)
    value = "".join(next(d) if c == "d" else next(a) if c == "A" else last if c == "B" else c for c in pattern)
    new = P.pseudonym(kind, value, KEY)
    assert P.reveal(kind, new, KEY) == value
    assert len(new) == len(value)
    for x, y in zip(new, value, strict=True):  # only a check character may be a digit or X
        assert (x.isdigit(), x.isalpha()) == (y.isdigit(), y.isalpha()) or {x, y} & set("xX")
        assert x == y or x.isalnum()
    for forms in (P._PHONE_FORMS if kind == "phone" else P._ID_FORMS,):
        if any(f.fullmatch(value) for f in forms):
            assert any(f.fullmatch(new) for f in forms), (value, new)


def test_different_values_have_different_pseudonyms():
    for kind, values in (("phone", [f"020 79{n:02d} 0000" for n in range(100)]), ("id_number", [f"11010519491231{n:03d}{c}" for n in range(40) for c in "0123456789X"]), ("id_number", [f"110105194913{n:02d}0021" for n in range(10, 99)])):
        assert len({P.pseudonym(kind, v, KEY) for v in values}) == len(values)


def test_words_before_numbers_are_shorter_than_what_is_read():
    from re import _parser

    for p in (P._ID_CUE, P._PHONE_CUE, P._NOT_CUE):
        assert _parser.parse(p.pattern, p.flags).getwidth()[1] < P.CUE_REACH


def test_a_part_with_something_before_it_is_not_learned(spark):
    rows = [("霧坂　灯里さんが",)] * 6 + [("第二条霧坂　灯里さんが",), ("雲母谷　碧人様の",), ("椋田　凪沙さん",)]
    roster = spark.createDataFrame([("Mara", "Quill")], "given_name string, family_name string")
    known = P.learn_inventory(spark.createDataFrame(rows, "text string"), "text", roster)
    assert known.ja_family == {"霧坂", "雲母谷", "椋田"} and known.ja_given == {"灯里", "碧人", "凪沙"}


def test_redaction_changes_nothing_else():
    text = "Phone: 07700 900 840 now"
    finds = P.find(text, I)
    clean = P.redact(text, finds, [P.pseudonym(k, text[a:b], KEY) for k, a, b in finds])
    assert clean.startswith("Phone: <PHONE:07") and clean.endswith("> now") and P.redact("", [], []) == "" and P.redact(None, [], []) is None


def test_table(spark):
    text = "简榆女士同意该价格。阮汀先生的手机是155-0000-8440。"
    rows = [(i, text if i < 8 else None, "c") for i in range(9)] + [(9, "", None), (10, "Please ask Dr. Quill first. " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, finds string")
    roster = spark.createDataFrame([("Mara", "Quill")], "given_name string, family_name string")
    got = {r["doc_id"]: r for r in P.find_pii(docs, "doc_id", "text", roster, "key").collect()}
    assert [(f["kind"], text[f["start"] : f["end"]]) for f in got[0]["finds"]] == [("person", "简榆"), ("person", "阮汀"), ("phone", "155-0000-8440")]
    assert got[8]["finds"] == [] and got[8]["clean"] is None and got[9]["clean"] == "" and len(got[10]["finds"]) == 20_000
    assert P.find_pii(docs.limit(0), "doc_id", "text", roster, "key").count() == 0
