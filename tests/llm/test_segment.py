import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import segment as S

CASES = [
    ("en", ["Cf. Vol. IV, Sec. 3.2 of the lease.", "Never fold it!", "Stop!!"]),
    ("en", ["The plant opens at 7 a.m.", "The U.S. office keeps it.", "It moved to Kessary Inc. last spring."]),
    ("en", ['He said, “Stop. Check it. Then call me.”', "“Really?!” she said.", "The note ends with “no copies.”", "J. R. Umberton (approx. 24 pages) agreed!"]),
    ("en", ["The speaker paused … and then went on.", "Version 2.8 is final…", "Keep it."]),
    ("de", ["Am 9. August kamen ca. 3 Zeilen hinzu.", "Die Nummerierung beginnt bei 140.", "„Ist das echt?“, fragte sie.", "Sie sagte: „Warten Sie. Ich komme.“", "Gilt z. B. Art. 3."]),
    ("zh", ["“印章不清。请重扫。”这是批注的全文。", "审校员问：“有效吗？”然后签了字。", "他停顿了一下……然后继续说：“好。”", "“真的吗？”她问，“谁签的字？”", "第3.2条适用．", "No.3 号文件缺第 5 页。", "还没有找到……", "重量为1.5 kg。"]),
    ("ja", ["「はい。すぐ直します。」と返事が来た。", "（別送します。）", "資料No.4（129頁）を見てください！", "えっ…本当ですか？", "詳しくはこちらへ｡"]),
    ("hi", ["डॉ. मेहरीन ने हस्ताक्षर किए।", "क्या मुहर साफ़ है?", "कुल 14.5 प्रतिशत।"]),
    ("ar", ["وقّع د. سامر الصفحة.", "هل الختم واضح؟", "الرسوم 8.5 بالمئة، وتدفع."]),
]


@pytest.mark.parametrize(("lang", "sentences"), CASES)
@pytest.mark.parametrize("given_lang", [True, False])
def test_sentences(lang, sentences, given_lang):
    joint = "" if lang in ("zh", "ja") else " "
    assert list(S.iterate(joint.join(sentences), lang if given_lang else None)) == sentences


def test_lists_headings_and_wrapped_lines():
    text = "2.1 Delivery\r\n\r\n1. Fold it\nnever.\n2. Section 9.\n3.) Done.\n\nThe weight is\n2.5 kg here.The next joins."
    assert list(S.iterate(text, "en")) == ["2.1 Delivery", "1. Fold it\nnever.", "2. Section 9.", "3.) Done.", "The weight is\n2.5 kg here.", "The next joins."]


def test_joins_without_a_blank():
    assert list(S.iterate("It is fine.Mr. Quill left.Dr. Ostrand signed p. 3.J. R. Umberton agreed. See www.halden.example/docs.html now.", "en")) == ["It is fine.", "Mr. Quill left.", "Dr. Ostrand signed p. 3.", "J. R. Umberton agreed.", "See www.halden.example/docs.html now."]


def test_thai():
    assert list(S.iterate("ไฟล์แนบอ่านไม่ได้ สัญญามีทั้งหมด 5 หน้า ต้องการสำเนาเพิ่มหรือไม่", "th")) == ["ไฟล์แนบอ่านไม่ได้", "สัญญามีทั้งหมด 5 หน้า", "ต้องการสำเนาเพิ่มหรือไม่"]


def test_invisible_characters_stay_inside():
    text = "One th​ing. Two."
    assert S.spans(text, "en") == [(0, 11), (12, 16)]
    assert S.spans(None) == S.spans("") == S.spans(" \n　") == []


@settings(max_examples=300, deadline=None)
@given(st.text("aB1 .!?。“”「」\n(（)）…​A.", max_size=80), st.sampled_from([None, "en", "de", "zh", "ja", "th"]))
def test_spans_cover_all_but_space(text, lang):
    spans = S.spans(text, lang)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    kept = {i for a, b in spans for i in range(a, b)}
    if text.replace("​", "").strip():
        assert all(i in kept or text[i].isspace() or text[i] == "​" for i in range(len(text)))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_long_texts_take_linear_time():
    import time

    t = time.time()
    assert len(S.spans("A sentence here. " * 40_000, "en")) == 40_000
    assert len(S.spans("x" * 3_000_000)) == 1
    S.spans("“(" * 50_000)
    assert time.time() - t < 60


def test_table(spark):
    rows = [(1, "One. Two.", "en", "x"), (1, "One. Two.", "en", "x"), (2, None, None, None), (3, " ", "zh", None), (None, "好。", None, None)]
    df = spark.createDataFrame(rows, "block_id bigint, source_text string, lang string, spans string")
    got = sorted((r["block_id"] or 0, r["span_start"], r["span_end"]) for r in S.segment(df, "block_id", "source_text", "lang").collect())
    assert got == [(0, 0, 2), (1, 0, 4), (1, 5, 9)]
    assert sorted(r["unit_text"] for r in S.units(df, "block_id", "source_text", "lang").collect()) == ["One.", "Two.", "好。"]
    assert S.segment(df.limit(0), "block_id", "source_text", "lang").count() == 0


def test_long_list_entries_without_end_marks_are_told_apart():
    for n in (50, 80, 500):
        entry = ("word " * n)[:n].strip()
        text = f"1. {entry}\n2. {entry}\n3. {entry}"
        assert [text[a:b] for a, b in S.spans(text, "en")] == text.split("\n")
    plain = "word " * 40
    assert len(S.spans(f"{plain}\n2. {plain}", "en")) == 1


@pytest.mark.parametrize("lang", ["en", "de", "zh", "ja", "th", "hi", "ar", None])
def test_long_numbered_line_takes_no_time(lang):
    began = time.perf_counter()
    text = "1. " + "a " * 5000 + "\u3002 Next\n2. " + "b " * 5000
    assert "".join(text[a:b] for a, b in S.spans(text, lang)).replace(" ", "") == "".join(text.split())
    assert time.perf_counter() - began < 2


def test_runs_longer_than_the_reach_are_seen_whole():
    assert S.spans("a" * 80 + "." + ")" * 100 + " then it goes on.", "en") == [(0, 80 + 1 + 100 + 17)]
    assert len(S.spans("One line" + " " * 200 + "\n" + " " * 200 + "\nanother line", "en")) == 2
    assert len(S.spans("See " + "part-of-a-name" * 10 + "." + "example.com/x for more.", "en")) == 1
