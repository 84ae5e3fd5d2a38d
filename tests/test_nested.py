import json

from pyspark.sql import functions as F

from quire.operators import nested as N
from quire.session import scratch

CHAT = {"pages": [{"page_no": 1, "layout": {"messages": [{"sender": "a", "text": "x", "visuals": [{"type": "image"}, None, 3]}, 7, [], {"sender": None}]}}, "blank", {"layout": json.dumps({"messages": {"text": "one"}})}]}


def flat(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, doc string")
    tables = N.flatten(df, "id", "doc", N.LAYOUT, scratch(spark, "layouts"))
    return {tag: tables.table(tag, schema) for tag, schema in N.SCHEMAS.items()}


def items(spark, texts):
    return sorted(tuple(r) for r in N.layout_items(flat(spark, list(enumerate(texts)))).collect())


def test_positions_count_every_element(spark):
    assert items(spark, [json.dumps(CHAT)]) == [(0, 0, "message", 0, -1), (0, 0, "message", 0, 0), (0, 0, "message", 3, -1), (0, 2, "message", 0, -1)]


def test_strings_single_objects_and_missing_pages(spark):
    texts = [json.dumps(json.dumps(CHAT)), json.dumps({"blocks": {"text": "b"}}), json.dumps({"pages": {"layout": {"blocks": [None, {"text": "b"}]}}})]
    got = items(spark, texts)
    assert [r for r in got if r[0] == 0] == items(spark, [json.dumps(CHAT)])
    assert [r for r in got if r[0] > 0] == [(1, 0, "block", 0, -1), (2, 0, "block", 1, -1)]


def test_unreadable_gives_no_items_but_its_root(spark):
    bad = [None, "", "null", "[]", "{", "3", '{"pages": "x"}', '{"pages": [3, null]}', '{"pages": [{"layout": {"messages": 3}}]}']
    assert items(spark, bad) == []
    df = spark.createDataFrame(list(enumerate(bad)), "id bigint, doc string")
    assert N.emit_tagged(df, "id", "doc", N.LAYOUT).filter("tag = 'root'").count() == len(bad)


def test_empty_table_clashing_names_and_null_ids(spark):
    empty = spark.createDataFrame([], "id bigint, doc string")
    assert N.emit_tagged(empty, "id", "doc", N.LAYOUT).count() == 0
    clash = spark.createDataFrame([(2**60 + 1, json.dumps(CHAT), "x", 1, 2), (None, json.dumps(CHAT), "y", 3, 4)], "id bigint, doc string, tag string, root_id int, payload int")
    rows = N.emit_tagged(clash, "id", "doc", N.LAYOUT).collect()
    assert {r["root_id"] for r in rows} == {2**60 + 1, None} and len(rows) == 14


def test_links_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([(5, json.dumps(CHAT))], "id bigint, doc string")
    tagged = N.emit_tagged(df, "id", "doc", N.LAYOUT)
    N.write_tagged(tagged, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    messages = N.table_of(back, "message", N.MESSAGE_SCHEMA)
    pages = N.table_of(back, "page", N.PAGE_SCHEMA)
    assert messages.select("parent_key").join(pages.select(F.col("key").alias("parent_key")), "parent_key").count() == 3
    assert {r["text"] for r in messages.collect()} == {"x", None, "one"}


def test_deep_and_long_records(spark):
    deep = "[" * 3000 + "]" * 3000
    long = json.dumps({"pages": [{"layout": {"messages": [{"text": "w" * 2_000_000}] * 3}}]})
    assert items(spark, [deep, long]) == [(1, 0, "message", i, -1) for i in range(3)]


def test_encoded_any_number_of_times(spark):
    text = json.dumps(CHAT)
    for _ in range(7):
        text = json.dumps(text)
    assert items(spark, [text]) == items(spark, [json.dumps(CHAT)])


def test_repeated_records_count_once_in_every_table(spark, monkeypatch):
    rows = [(1, json.dumps(CHAT)), (2, json.dumps(CHAT)), (1, json.dumps(CHAT)), (1, json.dumps(CHAT)), (None, json.dumps(CHAT)), (None, json.dumps(CHAT))]
    for most in (N.MOST_SENT, 0):  # ids sent to all tasks, and joined by shuffle
        monkeypatch.setattr(N, "MOST_SENT", most)
        tables = flat(spark, rows)
        assert {t: x.count() for t, x in tables.items()} == {"page": 6, "message": 9, "block": 0, "visual": 3}
        assert N.layout_items(tables).count() == 12
