import pytest

from quire.functions import names as N
from quire.functions import sentences as S


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Dr. No came at 3.5 p.m. He left.", ["Dr. No came at 3.5 p.m.", "He left."]),
        ("See Fig. 2 in Vol. IV. Then stop.", ["See Fig. 2 in Vol. IV. Then stop."]),
        ("He said “Stop.” Then he went.", ["He said “Stop.”", "Then he went."]),
        ("第一句。第二句！”第三句", ["第一句。", "第二句！”", "第三句"]),
        ("Heading\n\nBody goes\non here.", ["Heading", "Body goes\non here."]),
        ("Really?! Yes", ["Really?!", "Yes"]),
        ("it ends. but goes on", ["it ends. but goes on"]),
        ("visit example.com now", ["visit example.com now"]),
        ("  ​ ", []),
        ("", []),
        (None, []),
    ],
)
def test_sentences(text, wanted):
    assert [text[a:b] for a, b in S.sentence_spans(text)] == wanted if text else S.sentence_spans(text) == []


def test_pairs():
    text = "```\nHello ||| 你好\n\nshort lead\nrest ||| 其余 ||| more\n" + "x" * 60 + "\n ||| \n||| only\n```"
    assert S.parse_pairs(text) == [("Hello", "你好"), ("short lead rest", "其余 ||| more"), ("", "only")]
    assert S.parse_pairs(None) == [] and S.parse_pairs("```") == []


def test_line_parts():
    text = "\n".join(["a" * 10] * 9)
    assert [len(p.splitlines()) for p in S.split_by_lines(text, 3)] == [3, 3, 3]
    assert S.split_by_lines("one\ntwo\nthree", 3) == ["one", "two", "three"] and S.split_by_lines(None, 3) == [""] and S.split_by_lines("x", 1) == ["x"]
    assert S.split_by_lines("a" * 100 + "\nb\nc", 3) == ["a" * 100, "b", "c"]


def test_stems():
    assert N.plain_stem("Überprüfung 2024 (final).docx") == "uberprufung_2024_final" and N.plain_stem("合同.pdf") == "file" and N.plain_stem(None) == "file"
    assert N.shown_stem("a<b>:c__d  e .txt") == "a_b_c_d e" and N.shown_stem("CON.txt") == "CON_file" and N.shown_stem("x" * 100 + ".md") == "x" * 80 and N.shown_stem("ＡＢ.txt") == "AB"


def test_columns(spark):
    rows = [("[config] a b",), ("route=x model=y",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "line string").select(N.redacted(__import__("pyspark").sql.functions.col("line"))).collect()]
    assert got == ["[config] ***", "route=*** model=***", None]


def test_archive_names_are_free_of_made_ones(spark):
    from quire.operators import relational as R

    rows = [(1, "b", "a.txt"), (2, "b", "A.txt"), (3, "b", "a_2.txt"), (4, "b", "a.txt"), (5, "c", "a.txt"), (6, "b", "plain"), (7, "b", "plain"), (8, None, "a.txt"), (9, None, "a.txt")]
    got = {r["id"]: r["name"] for r in R.free_names(spark.createDataFrame(rows, "id int, batch string, name string"), "batch", "name", "id").collect()}
    assert got == {1: "a.txt", 2: "A_2.txt", 3: "a_2_2.txt", 4: "a_3.txt", 5: "a.txt", 6: "plain", 7: "plain_2", 8: "a.txt", 9: "a_2.txt"}


def test_transcripts(spark):
    from quire.plans.document_queries import transcript_words

    doc = '{"transcripts":[{"channel_id":1,"sentences":[{"sentence_id":1,"words":[{"begin_time":120,"end_time":560,"text":"好","punctuation":"，"},{"begin_time":600,"end_time":null,"text":"x"}]}]},{"sentences":null}]}'
    got = transcript_words(spark.createDataFrame([("t", doc), ("u", "{"), ("v", None)], "task_id string, doc string"), "doc").collect()
    assert [(r["task_id"], r["channel_id"], r["word"], r["start"], r["stop"]) for r in got] == [("t", 1, "好，", 0.12, 0.56), ("t", 1, "x", 0.6, None)]


def test_edits_keep_the_runs():
    from quire.functions import rewriting as W

    runs = ["The col", "our of ", "the sky"]
    assert W.write_back(runs, [(4, 10, "color")]) == ["The color", " of ", "the sky"]
    assert W.write_back(runs, [(0, 3, "A"), (14, 21, "a sea")]) == ["A col", "our of ", "a sea"]
    assert W.write_back(runs, []) == runs and W.write_back([], []) == []
    with pytest.raises(ValueError):
        W.write_back(runs, [(0, 5, "x"), (4, 6, "y")])


def test_digests_and_columns():
    from quire.functions import rewriting as W

    assert W.digest("t", '{"a": 1, "b": " x "}') == W.digest("t", '{"b": "x", "a": 1}') != W.digest("t", '{"b": "x", "a": 2}')
    assert W.digest(None, None, "{broken") != W.digest(None, None, "{") and W.canonical({"b": {2, 1}, 1: [" a "]}) == {"1": ["a"], "b": [1, 2]}
    assert W.column_named(["id", "Source Text", "target"], ["source", "原文"]) == "Source Text" and W.column_named([], ["x"]) is None


def test_providers(spark):
    from pyspark.sql import functions as F

    from quire.functions import providers as P

    df = spark.createDataFrame([(i, f"text {i}" if i % 3 else None) for i in range(200)], "id int, t string").coalesce(1)
    rows = df.select("id", "t", P.embedded(F.col("t")).alias("v"), P.translated(F.col("t"), "en", "de", lambda texts, a, b: [f"{b}:{t}" for t in texts]).alias("x")).collect()
    assert all((r["v"] is None) == (r["t"] is None) and r["x"] == (None if r["t"] is None else f"de:{r['t']}") for r in rows)
    assert all(abs(sum(x * x for x in r["v"]) - 1) < 1e-4 for r in rows if r["v"])


def test_cells_and_pdf_listing(spark, tmp_path):
    from quire.sources import files
    from tests.test_operators import docx

    (tmp_path / "a.docx").write_bytes(docx(["one"], [["c1", "c2"], ["c3"]]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "10.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page x /Type/Page y")
    (tmp_path / "2.PDF").write_bytes(b"no pdf")
    assert [tuple(r)[1:] for r in files.read_cells(spark, str(tmp_path)).collect()] == [(0, 0, 0, "c1"), (0, 0, 1, "c2"), (0, 1, 0, "c3")]
    assert [(r["path"].rsplit("/", 1)[1], r["page_count"]) for r in files.pdf_listing(spark, str(tmp_path)).orderBy("order_key").collect()] == [("2.PDF", None), ("10.pdf", 2)]
