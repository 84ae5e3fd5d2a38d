import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import language_parts as L
from quire.functions import measure as M
from quire.functions import names as N

RANGES = {"han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)], "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xD7B0, 0xD7FF)]}


def cjk(c):
    return any(a <= ord(c) <= b for r in RANGES.values() for a, b in r) if c else False


def brute_words(text):
    """The count by one scan, character for character."""
    n = i = 0
    while i < len(text):
        c = text[i]
        if cjk(c):
            n, i = n + 1, i + 1
        elif unicodedata.category(c)[0] in "LN":
            n += 1
            while i < len(text) and (text[i] in "'’_./-" or (unicodedata.category(text[i])[0] in "LN" and not cjk(text[i]))):
                i += 1
        else:
            o = ord(c)
            mark = unicodedata.category(c)[0] in "PS"
            block = 0x3000 <= o <= 0x303F or 0xFE10 <= o <= 0xFE1F or 0xFE30 <= o <= 0xFE4F or 0xFF00 <= o <= 0xFFEF
            beside = c in "“”‘’—–…·" and (cjk(text[i - 1 : i]) or cjk(text[i + 1 : i + 2]))
            n += bool(mark and (block or beside))
            i += 1
    return n


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_goldens(spark):
    cases = {"你好 world 123，テスト 한국어": 11, "“中文”": 4, "中文…": 3, "Привет world مرحبا 123": 4, "日本語テスト English 42": 8, "한국어 테스트 English": 7, "": 0, "  ": 0}
    rows = spark.createDataFrame(list(cases.items()), "text string, n int").select("n", M.word_count(F.col("text")).alias("w")).collect()
    assert all(r["n"] == r["w"] for r in rows)


def test_words_against_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 中日かタ한“”’…·，。.-_/'\n©Ａ１　é") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", M.word_count(F.col("text")).alias("w")).collect()
    assert [r["w"] for r in rows] == [brute_words(r["text"]) for r in rows]



def test_segment_characters(spark):
    assert one(spark, lambda c: M.dominant_chars(c, "cjk")["no_spaces"], "中文 HEPA 30cm\tEnglish text 42") == 10
    assert one(spark, lambda c: M.dominant_chars(c, "latin")["with_spaces"], "中文 HEPA 30cm\tEnglish text 42") == 15
    assert one(spark, lambda c: M.dominant_chars(c, "cjk")["no_spaces"], "English only 42") == 0
    assert one(spark, lambda c: M.dominant_chars(c, "latin")["no_spaces"], "English only 42") == 13


def test_lines_and_paragraphs(spark):
    text = "a\r\nb\r\rc\n\n \nd"
    assert one(spark, M.line_count, text) == 4
    assert one(spark, M.paragraph_count, "a\nb\n\nc") == 2
    assert one(spark, M.paragraph_count, "a\nb") == 2


def test_language_parts():
    got = L.language_parts("中文 123 / English 45، مرحبا بالعالم")
    assert got["chinese"] == "中文 123 / " and got["latin"] == "English 45، " and got["arabic"] == "مرحبا بالعالم"
    assert L.language_parts("日本語テスト English") == {"japanese": "日本語テスト ", "latin": "English"}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_language_parts_keep_every_character(text):
    assert sorted("".join(L.language_parts(text).values())) == sorted(text)


def test_pages(spark):
    rows = spark.createDataFrame([("1-3,5,3", 6), ("1-9", 3), ("", 3), ("x", 3), (" 2 - 3 ； 1", 3)], "spec string, n int").select(N.pages(F.col("spec"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in rows] == [[0, 1, 2, 4], None, None, None, [1, 2, 0]]


def test_names_times_and_guards(spark):
    assert one(spark, lambda c: N.srt_time(c.cast("double")), "3661.5004") == "01:01:01,500"
    assert one(spark, lambda c: N.renamed(c, r"^\d{4}\.\d{1,2}\.\d{1,2}_(.*?)_translated$", r"\1"), "2024.1.2_xxxx_translated") == "xxxx"
    assert one(spark, lambda c: N.renamed(c, r"^z", "q"), "abc") is None
    assert one(spark, N.csv_safe, "=1+1") == "'=1+1"
    assert one(spark, N.name_problem, "con.txt") == "reserved name" and one(spark, N.name_problem, "a.txt") is None
    assert one(spark, N.repaired_date, "1982年1月8日") == "1982-01-08" and one(spark, N.repaired_date, "1982-13-08") is None
    assert one(spark, N.redacted, "token=abc, Bearer abcdefghij") == "token=***, Bearer ***"
