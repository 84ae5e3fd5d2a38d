import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from quire.operators import relational as R
from quire.operators import sequential as S
from quire.sources import files, sinks


def test_numbered_equals_row_number(spark):
    rows = [(i, n) for i, n in enumerate(["b", "a", "a", "zz", "", None, "ab", "abc", "abcd"])]
    got = R.numbered(spark.createDataFrame(rows, "id int, name string"), "name", "id").collect()
    wanted = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert {r["id"]: r["n"] for r in got} == {r[0]: i + 1 for i, r in enumerate(wanted)}


def test_islands(spark):
    rows = [(1, "t", "2024-01-01 00:00:00", 1), (2, "t", "2024-01-01 00:00:02", 2), (3, "t", "2024-01-01 00:00:04.1", 3), (4, "t", "2024-01-01 00:00:05", 5)]
    df = spark.createDataFrame(rows, "id int, k string, at string, no int").withColumn("at", F.to_timestamp_ntz("at"))
    assert [r["island"] for r in R.islands(df, ["k"], "at", "no", 2).orderBy("id").collect()] == [1, 1, 2, 3]


def test_natural_key(spark):
    names = ["10.pdf", "2.pdf", "a/3.pdf", "A/12.pdf", "02.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(R.natural_key(F.col("n")), "n").collect()
    assert [r["n"] for r in rows] == ["02.pdf", "2.pdf", "10.pdf", "a/3.pdf", "A/12.pdf"]


def test_full_outer_drops_blank_positions(spark):
    a = spark.createDataFrame([("s", 1, " x "), ("s", 2, None)], "sheet string, r int, v string")
    b = spark.createDataFrame([("s", 1, ""), ("s", 3, "y"), ("s", 2, " ")], "sheet string, r int, v string")
    assert sorted(tuple(r) for r in R.full_outer_cells(a, b, ["sheet", "r"], "v").collect()) == [("s", 1, "x", ""), ("s", 3, "", "y")]


def test_compile_variants(spark):
    rows = [("Colour", "color"), ("colour", "color"), ("overpass", "flyover"), ("overpass", "bridge"), (None, "x"), ("same", "Same")]
    got = {r["key"]: (r["target"], r["ambiguous"]) for r in R.compile_variants(spark.createDataFrame(rows, "b string, a string"), "b", "a").collect()}
    assert got == {"colour": ("color", False), "overpass": ("bridge", True)}


def test_convert_variants():
    rules = {"aeroplane": "airplane", "accessorised": "accessorized", "colourfully": "colorfully", "organised": "organized"}
    text = "The AEROPLANE was accessorised and colourfully organised. An aeroplanet and an overpass."
    assert S.convert_variants(text, rules, set()) == ("The AIRPLANE was accessorized and colorfully organized. An aeroplanet and an overpass.", 4, 0)
    assert S.convert_variants("an overpass", {}, {"overpass"}) == ("an overpass", 0, 1)


def test_consume():
    assert S.consume([(1, "Hello world", "Hallo Welt")], "Hello\nworld", "Hallo Welt") == [(1, "accepted")]
    assert S.consume([(1, "Hello brave world", "x")], "Hello world", "x") == [(1, "not_found")]
    assert S.consume([(1, "A", "A"), (2, "A", "A")], "A\nA", "A\nA") == [(1, "accepted"), (2, "accepted")]
    assert S.consume([(1, "A", "B"), (2, "A", "B")], "A", "B") == [(1, "accepted"), (2, "already_consumed")]


def test_chunks_keep_page_marks_and_paragraphs():
    text = "para one\n\n" + "x" * 95 + "\n\npara three<page_break/>page two<page_break/> <page_break/>p3"
    assert S.chunk_spans(text, 40) == ["para one", "x" * 95, "para three\n\n<page_break/>\n\npage two", "p3"]
    assert S.chunk_spans("a" * 30 + "<page_break/>" + "b" * 30, 80) == ["a" * 30 + "\n\n<page_break/>\n\n" + "b" * 30]
    assert S.chunk_spans("a" * 30 + "<page_break/>" + "b" * 30, 79) == ["a" * 30, "b" * 30]
    assert S.chunk_spans("", 10) == [""] and S.chunk_spans(" ", 10) == [" "]


def test_pack_sentences(spark):
    rows = [("d", "src", i, 1000 if i != 3 else 5000) for i in range(6)]
    got = S.pack_sentences(spark.createDataFrame(rows, "doc_key string, side string, idx int, n int")).orderBy("idx").collect()
    assert [r["group_no"] for r in got] == [0, 0, 0, 1, 2, 2]


def test_segments():
    w = lambda *rows: [(a, b, t, 0) for a, b, t in rows]
    assert [x[:3] for x in S.segments(w((0.12, 0.5, "你好，"), (0.6, 1.56, "世界。"), (2.0, 2.2, "x")))] == [[0.12, 1.56, "你好，世界。"], [2.0, 2.2, "x"]]
    long_ = S.segments([(i * 0.3, i * 0.3 + 0.3, "字", 0) for i in range(60)])
    assert len(long_) >= 2 and all(b - a <= 6.3 for a, b, *_ in long_) and sum(x[3] for x in long_) == 60
    # full without an end mark: back to the last soft mark that leaves 1.2 seconds
    soft = S.segments([(i * 0.5, i * 0.5 + 0.5, "ab," if i == 4 else "ab", 0) for i in range(12)])
    assert soft[0][2].endswith("ab,") and soft[0][1] == 2.5
    # a pause of 0.35 s ends a segment of 1.4 s and 10 units, not a shorter one
    paused = w((0, 0.8, "abcdef"), (0.8, 1.5, "ghijkl"), (1.9, 3.2, "mnopqr stuvw"))
    assert [x[2] for x in S.segments(paused)] == ["abcdef ghijkl", "mnopqr stuvw"]
    assert len(S.segments(w((0, 0.5, "abcdef"), (0.5, 1.0, "ghijkl"), (1.4, 2.7, "mnopqr stuvw")))) == 1
    # a short one joins the one before it, none begins before that has ended, another channel ends one
    assert [x[2] for x in S.segments([(0, 1.5, "one two three", 0), (1.6, 1.9, "b", 1)])] == ["one two three b"]
    assert [x[:2] for x in S.segments([(0, 2.0, "Yes.", 0), (1.5, 3.5, "no", 1)])] == [[0, 2.0], [2.0, 3.5]]
    assert S.segments([]) == []


def test_subtitles(spark):
    words = [("t", 0, i, i * 0.3, i * 0.3 + 0.25, w) for i, w in enumerate("你 好 ， we met today . And then we went on and on and on until the very end of the day".split())]
    words += [("t", 0, 99, 30.0, 20.0, "late"), (None, 0, 100, 1.0, 2.0, "nowhere"), ("t", None, 101, 31.0, None, " ")]
    got = S.subtitles(spark.createDataFrame(words, "task_id string, channel_id int, word_id int, word_start double, word_end double, word string")).orderBy("start").collect()
    assert all(r["stop"] > r["start"] and r["stop"] - r["start"] <= 6.3 for r in got)
    assert all(a["stop"] <= b["start"] for a, b in zip(got, got[1:], strict=False))
    assert sum(r["words"] for r in got) == len(words) - 2 and {r["block"] for r in got} == {0, 30000}
    frame = spark.createDataFrame(got)
    assert "00:00:00,000 --> " in sinks.srt_blocks(frame).orderBy("block", "segment_no").first()["value"]
    line = sinks.transcript_lines(frame).orderBy("block", "segment_no").first()
    assert line["vtt"].startswith("00:00:00.000 --> ") and line["tsv"].split("\t")[0] == "0" and line["srt"].startswith("1\n")


def test_silence_islands_equal_one_pass(spark):
    import random

    rng = random.Random(3)
    rows, no = [], 0
    for key in ("a", "b"):
        at = 0.0
        for _ in range(300):
            at += rng.choice([0.5, 3.0, 5.9, 6.0, 40.0, 900.0] if rng.random() < 0.2 else [0.5, 3.0])
            rows.append((no := no + 1, key, round(at, 1)))
    wanted = {}
    for key in ("a", "b"):
        start = last = None
        for i, _, at in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            start = at if last is None or not at - last < 6.0 else start
            last = at
            wanted[i] = round(start * 1000)
    df = spark.createDataFrame(rows, "id int, k string, at double")
    for bucket in (10.0, 100.0, 600.0):
        assert {r["id"]: r["island"] for r in R.silence_islands(df, "k", "at", 6.0, bucket).collect()} == wanted


def test_weak_windows_are_cut_after_the_link_that_fills_them(spark):
    schema = "doc_key string, link_id int, src_start int, src_end int, tgt_start int, tgt_end int, score double, low_confidence boolean"
    links = [("d", i, i, i + (i != 2), i, i + 1, 0.1 if i != 9 else 0.9, i != 9) for i in range(12)] + [("d", 50, 50, 60, 50, 60, 0.1, True)]
    got = S.weak_windows(spark.createDataFrame(links, schema)).orderBy("src_start").collect()
    assert [(r["src_start"], r["links"], r["units"]) for r in got] == [(0, 6, 12), (6, 3, 6), (10, 3, 24)]


def test_vector_alignment_scores_and_ends():
    v = np.stack([S.hashed_vector(t) for t in ("one 1 alpha", "two 2 beta", "three 3 gamma")])
    assert S.vector_alignment(v, v[:0]) == [(i, i + 1, 0, 0, 0.0, True) for i in range(3)]
    assert S.vector_alignment(v[:0], v) == [(0, 0, j, j + 1, 0.0, True) for j in range(3)]
    assert S.vector_alignment(v[:0], v[:0]) == []
    found = S.vector_alignment(v, np.delete(v, 1, axis=0))
    assert [x[:4] for x in found] == [(0, 1, 0, 1), (1, 2, 1, 1), (2, 3, 1, 2)] and found[1][4] == 0.0 and abs(found[0][4] - 1.02) < 1e-6
    two = np.stack([v[0], (v[1] + v[2]) / np.linalg.norm(v[1] + v[2])])
    merged = S.vector_alignment(v, two)
    assert merged[1][:4] == (1, 3, 1, 2) and abs(merged[1][4] - 1.0) < 1e-6
    # one row against many: the band can't reach the end, the rest is skipped row by row
    far = S.vector_alignment(v[:1], np.stack([S.hashed_vector(f"row {i}") for i in range(100)]))
    assert far[-1] == (1, 1, 99, 100, 0.0, True) and sorted(j for _, _, j, e, *_ in far for j in range(j, e)) == list(range(100))


def full_alignment(a, b):
    """The same steps over all cells, one by one."""
    m, n = len(a), len(b)
    band = max(8, int(0.12 * max(m, n)))
    best, how = {(0, 0): 0.0}, {}
    for i in range(m + 1):
        for j in range(max(0, round(i * n / m) - band), min(n, round(i * n / m) + band) + 1):
            if i == j == 0:
                continue
            top, way = -np.inf, None
            for di, dj, factor in ((1, 1, 1.0), (1, 2, 0.98), (2, 1, 0.98), (1, 0, None), (0, 1, None)):
                if (p := best.get((i - di, j - dj))) is None:
                    continue
                like = 0.0
                if factor:
                    x, y = a[i - di : i].mean(axis=0), b[j - dj : j].mean(axis=0)
                    like = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) + (0.02 if di == dj else 0.0)
                value = p + (like * factor if factor else -0.12)
                if value > top + 1e-12:
                    top, way = value, (di, dj)
            if way:
                best[(i, j)], how[(i, j)] = top, way
    out, i, j = [], m, n
    while i or j:
        di, dj = how[(i, j)]
        out.append((i - di, i, j - dj, j))
        i, j = i - di, j - dj
    return out[::-1]


def test_vector_alignment_equals_all_cells():
    rng = np.random.default_rng(4)
    for m, n in ((5, 6), (12, 9), (30, 33)):
        a = rng.normal(size=(m, 16))
        b = np.concatenate([a, rng.normal(size=(max(0, n - m), 16))])[:n] + 0.3 * rng.normal(size=(n, 16))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        assert [x[:4] for x in S.vector_alignment(a, b)] == full_alignment(a, b)


def test_vector_alignment_prefers_the_diagonal():
    texts = ["one 1", "two 2", "three 3", "four 4", "five 5"]
    v = np.stack([S.hashed_vector(t) for t in texts])
    assert [(a, c) for a, _, c, _, _, low in S.vector_alignment(v, v) if not low] == [(i, i) for i in range(5)]
    assert [x[:4] for x in S.vector_alignment(v, np.delete(v, 2, axis=0)) if x[5]] == [(2, 3, 2, 2)]


def test_nms(spark):
    boxes = [(9.0, 0.0, 0.0, 10.0, 10.0), (8.0, 1.0, 1.0, 11.0, 11.0), (7.0, 20.0, 20.0, 30.0, 30.0)]
    df = spark.createDataFrame([(boxes,), ([],)], "b array<struct<score:double,x1:double,y1:double,x2:double,y2:double>>")
    assert [[b["score"] for b in r[0]] for r in df.select(S.nms(F.col("b"))).collect()] == [[9.0, 7.0], []]
    beside = [(9.0, 0.0, 0.0, 10.0, 10.0), (8.0, 0.0, 10.0, 30.0, 14.0), (7.0, 6.0, 12.0, 9.0, 15.0)]  # the second's centre is near by its length
    df = spark.createDataFrame([(beside,)], "b array<struct<score:double,x1:double,y1:double,x2:double,y2:double>>")
    assert [[b["score"] for b in r[0]] for r in df.select(S.nms(F.col("b"))).collect()] == [[9.0, 7.0]]


def docx(paragraphs, rows=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(para, paragraphs))}{table}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{para('head')}</w:hdr>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {w}><w:footnote w:type="separator">{para("-")}</w:footnote><w:footnote>{para("note")}</w:footnote></w:footnotes>')
    return out.getvalue()


def xlsx():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>inline</t></is></c><c r="C1"><v>3.5</v></c><c r="D1" t="b"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_sheets_follow_the_relations_of_the_workbook():
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda t: f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{t}</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="First" sheetId="2" r:id="rId9"/><sheet name="Second" sheetId="1" r:id="rId4"/><sheet name="Gone" r:id="rId5"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId4" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="rId5" Target="worksheets/sheet7.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", cell("one"))
        z.writestr("xl/worksheets/sheet2.xml", cell("two"))
    assert [(label, text) for _, label, text, *_ in files.xlsx_cells(out.getvalue())] == [("First!A1", "two"), ("Second!A1", "one")]


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(docx(["one", " ", "two"], [["c1", "c2"]]))
    (tmp_path / "sub" / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "d.eml").write_bytes(b"From: a@b.example\nSubject: S\nContent-Type: text/html\n\n<p>hi<br>you</p>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / ".hidden.txt").write_bytes(b"x")
    rows = files.read_items(spark, str(tmp_path)).collect()
    by = lambda end: [(r["kind"], r["text"]) for r in rows if r["path"].endswith(end)]
    assert by("/a.docx") == [("body", "one"), ("body", "two"), ("table", "c1\tc2"), ("header", "head"), ("footnote", "note")]
    assert [t for _, t in by("b.xlsx")] == ["shared", "inline", "3.5", "TRUE"]
    assert by("c.txt") == [("body", "中文")]
    assert ("body", "hi\nyou") in by("d.eml")
    assert [r["error"] is not None for r in rows if r["path"].endswith("broken.docx")] == [True]
    listed = files.listing(spark, str(tmp_path))
    assert sorted(r["name"] for r in listed.collect()) == ["a.docx", "b.xlsx", "broken.docx", "c.txt", "d.eml"]
    here, missing = files.selected(listed, spark.createDataFrame([("a.docx",), ("a.docx",), ("no.txt",), ("../x",)], "name string"))
    assert here.count() == 1 and sorted(r[0] for r in missing.collect()) == ["../x", "no.txt"]


def test_markup():
    assert files.html_to_text("<head><title>x</title></head><h1>T</h1><p>a &amp; b</p><table><tr><td>1</td><td>2</td></tr></table><script>no</script>") == "T\n\na & b\n\n\t1\t2"
    assert files.sanitized('<p onclick="x" class="c">a<script>bad()</script><a href="java\nscript:x">l</a><img src="https://e.example/i.png"></p>') == '<p class="c">a<a>l</a><a href="https://e.example/i.png">https://e.example/i.png</a></p>'
    assert files.html_to_text("<head><title>t</title><body><p>rest</p>") == "rest" and files.html_to_text("a<style>p {x}<p>b</p>") == "a\nb"
    assert files.html_to_text("<template/><p>x</p>") == "x" and files.html_to_text("<style>a</style>b<script>c</script>d") == "bd"
    assert files.sanitized('<img src="cid:1" alt="p"><img src="//e.example/t.gif" alt="q"><img src="x.png">') == '<img src="cid:1" alt="p">q'
    assert files.sanitized('<a href="tel:+1">t</a><a href="//e.example">u</a><a href="/v">v</a><a href="vbscript:x">w</a>') == '<a href="tel:+1">t</a><a>u</a><a href="/v">v</a><a>w</a>'
    assert files.sanitized("<iframe>a</iframe><form>b<input value=1><button>c</button></form><svg><p>d</p></svg>e<base href=x>") == "e"
    assert files.sanitized("""<p style="color:red;background:url('http://e.example/x');@import 'a';width:expression(1)">x</p>""") == '<p style="color:red;background:none;width:blocked(1)">x</p>'


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=x", 1, "zh"), ("b", 2, None)], "s string, n int, lang string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(r["s"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["'=x", "b"]
    sinks.write_by_language(rows, str(tmp_path / "by"))
    assert {r["lang"] for r in spark.read.parquet(str(tmp_path / "by")).collect()} == {"zh", "none"}
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_folds_of_a_long_document_are_not_cut(spark):
    texts = [(side, i, f"{i * 7919 % 10007} {i * 104729 % 99991} row {i * 31 % 997}") for side, n in (("src", range(520)), ("tgt", [*range(490), *range(500, 520)])) for i in n]
    numbered = {}
    rows = [("d", side, numbered.setdefault(side, []).append(i) or len(numbered[side]) - 1, text) for side, i, text in texts]
    got = {(r["src_start"], r["tgt_start"]) for r in S.align_vectors(spark.createDataFrame(rows, "doc_key string, side string, idx int, text string")).collect() if r["src_end"] - r["src_start"] == r["tgt_end"] - r["tgt_start"] == 1}
    assert {(i, i - 10) for i in range(500, 520)} <= got  # tgt 490-499 stood in another block than src 500-509
    packed = S.pack_sentences(spark.createDataFrame([("d", "src", i, 10) for i in range(1990, 2010)], "doc_key string, side string, idx int, n int")).collect()
    assert {r["idx"]: r["group_no"] for r in packed} == {i: (i - 1990) // 15 for i in range(1990, 2010)}
    links = [("d", i, i, i + 1, i, i + 1, 0.1, True) for i in range(1998, 2002)]
    weak = S.weak_windows(spark.createDataFrame(links, "doc_key string, link_id int, src_start int, src_end int, tgt_start int, tgt_end int, score double, low_confidence boolean")).collect()
    assert [(r["src_start"], r["src_end"], r["links"]) for r in weak] == [(1998, 2002, 4)]
