"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import decimal
import os

import duckdb
import pytest

from quire.plans.catalog import CORE

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_same_as_sql(spark, duck, name):
    df = CORE.queries[name](spark, FOLDER)
    got = df.collect()
    answer = duck.execute(CORE.sql[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in got)
    wanted = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in answer.fetchall())
    assert rows == wanted


def texts(duck, name, key, column):
    return dict(duck.execute(f"SELECT DISTINCT {key}, {column} FROM {name}").fetchall())


def squeezed(text):
    return "".join((text or "").replace("<page_break/>", "").split())


def check_chunks(rows, duck):
    whole = texts(duck, "documents", "doc_id", "text")
    parts = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_no"])):
        parts.setdefault(r["doc_id"], []).append(r["chunk"])
    assert {k: squeezed("".join(v)) for k, v in parts.items()} == {k: squeezed(t) for k, t in whole.items() if t is not None}
    assert all(len(c) <= 3000 or "\n\n" not in c for v in parts.values() for c in v)


def check_line_parts(rows, duck):
    whole = texts(duck, "documents", "doc_id", "text")
    parts = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["part"])):
        parts.setdefault(r["doc_id"], []).append(r["text"])
    assert {k: squeezed("".join(v)) for k, v in parts.items()} == {k: squeezed(t) for k, t in whole.items()} and max(map(len, parts.values())) == 3


def check_subtitles(rows, duck):
    words = duck.execute("SELECT count(DISTINCT word_id) FROM asr_words WHERE task_id IS NOT NULL AND trim(coalesce(word, '')) <> ''").fetchall()[0][0]
    assert sum(r["words"] for r in rows) == words and all(r["stop"] > r["start"] and r["text"].strip() for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["task_id"], r["block"]), []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r["segment_no"])
        assert [r["segment_no"] for r in part] == list(range(1, len(part) + 1)) and all(a["stop"] <= b["start"] for a, b in zip(part, part[1:], strict=False))


def check_vectors(rows, duck):
    for side, a, b in (("src", "src_start", "src_end"), ("tgt", "tgt_start", "tgt_end")):
        sizes = dict(duck.execute(f"SELECT doc_key, count(DISTINCT sent_id) FROM docx_sentences WHERE side = '{side}' AND doc_key IS NOT NULL GROUP BY 1").fetchall())
        used = {}
        for r in rows:
            used.setdefault(r["doc_key"], []).extend(range(r[a], r[b]))
        assert all(sorted(used.get(k, [])) == list(range(n)) for k, n in sizes.items() if k is not None)


def check_coverage(rows, duck):
    kinds = {r["outcome"] for r in rows}
    assert "accepted" in kinds and "not_found" in kinds and kinds <= {"accepted", "not_found", "already_consumed"}


def check_boxes(rows, duck):
    by = {}
    for r in rows:
        by.setdefault((r["result_id"], r["page_idx"]), []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    for boxes in by.values():
        for i, a in enumerate(boxes):
            for b in boxes[:i]:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                common = max(w, 0) * max(h, 0)
                area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
                assert common / (area(a) + area(b) - common) <= 0.18


def check_languages(rows, duck):
    whole = texts(duck, "text_items", "item_id", "text")
    size = {}
    for r in rows:
        size[r["item_id"]] = size.get(r["item_id"], 0) + len(r["text"])
    assert size == {k: len(t) for k, t in whole.items() if t}


def check_sentences(rows, duck):
    whole = texts(duck, "docx_blocks", "block_id", "source_text")
    used = {}
    for r in rows:
        used.setdefault(r["block_id"], []).append((r["start"], r["stop"]))
    for k, t in whole.items():
        spans = sorted(used.get(k, []))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        left = "".join(c for i, c in enumerate(t or "") if not any(a <= i < b for a, b in spans))
        assert not [c for c in left if c.isalnum()], (k, left)


def check_variants(rows, duck):
    assert all(r["text"] is not None and r["replaced"] >= 0 for r in rows)
    whole = texts(duck, "documents", "doc_id", "text")
    assert all((r["replaced"] == 0) == (r["text"] == whole[r["doc_id"]]) for r in rows)


def check_names(rows, duck):
    batches = dict(duck.execute("SELECT DISTINCT id, coalesce(batch_id, task_id) FROM tasks").fetchall())
    seen = [(batches[r["id"]], r["name"].lower()) for r in rows]
    assert len(seen) == len(set(seen))


def check_markup(rows, duck):
    import re

    whole = texts(duck, "documents", "doc_id", "text")
    assert {r["doc_id"] for r in rows} == set(whole)
    for r in rows:
        out = r["text"] if "text" in r else r["markup"]
        assert (out is None) == (whole[r["doc_id"]] is None)
        assert out is None or not re.search(r"(?i)<(?:script|iframe|form)\b|\bon\w+=", out)


CHECKS = {
    "chunk_text": check_chunks, "line_parts": check_line_parts, "subtitle_segments": check_subtitles, "vector_alignment": check_vectors, "coverage_check": check_coverage, "box_nms": check_boxes, "language_split": check_languages,
    "document_sentences": check_sentences, "variant_convert": check_variants, "archive_names": check_names, "html_to_text": check_markup, "html_sanitize": check_markup,
}


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_holds(spark, duck, name):
    """Queries without SQL: what must be true of their rows; all others have some, and one name per column."""
    df = CORE.queries[name](spark, FOLDER)
    rows = [r.asDict() for r in df.collect()]
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in CHECKS:
        CHECKS[name](rows, duck)
