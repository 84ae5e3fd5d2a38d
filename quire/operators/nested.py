"""Flattening deeply nested semi-structured records into related flat tables.

Method: single-pass tagged emission. A depth-first visitor walks each record once and emits
``(root_id, tag, key, parent_key, path, payload)``; the stream is written partitioned by tag and each
tag's payload gets its schema when it is read back. No record is parsed twice; of the rows only those of records that were
delivered more than once are shuffled, to merge them.

Defined results: a null, unreadable or non-object record gives only its root row (payload null); elements
that are no objects give no row but count as positions; an object in place of an array is its element 0;
JSON in a string counts as its content, at any depth; a record that lacks the top array is its own element 0.
Extra input columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut_lineage

EMIT_ROWS = 5000

TAGGED = T.StructType(
    [
        T.StructField("root_id", T.LongType()),
        T.StructField("tag", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("parent_key", T.StringType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("payload", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Node:
    """One output table: ``tag``, the key path of its array below the parent object, and its own children.

    ``self_if_missing``: a parent without the array is itself the only element.
    """

    tag: str
    path: tuple[str, ...]
    children: tuple["Node", ...] = field(default=())
    self_if_missing: bool = False


def _content(value):
    """A string that holds JSON counts as what it holds, however often it was encoded; each step is shorter."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"'):
            return None
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _descend(obj: dict, path: tuple[str, ...]):
    """The value under ``path``; a step that is absent may be skipped when the next key is right here."""
    here = obj
    for i, key in enumerate(path):
        if not isinstance(here, dict):
            return None
        if key in here:
            here = _content(here[key])
        elif i + 1 < len(path) and path[i + 1] in here:
            continue
        else:
            return None
    return here


def visit(root_id, text, nodes: tuple[Node, ...], root_tag: str = "root") -> Iterator[tuple]:
    """Depth-first over one record, as rows of ``TAGGED``."""
    record = _content(text)
    root_key = str(root_id)
    if not isinstance(record, dict):
        yield root_id, root_tag, root_key, None, [], None
        return
    claimed = {n.path[0] for n in nodes}
    yield root_id, root_tag, root_key, None, [], json.dumps({k: v for k, v in record.items() if k not in claimed}, ensure_ascii=False)
    stack = [(record, root_key, [], n) for n in reversed(nodes)]
    while stack:
        parent, parent_key, where, node = stack.pop()
        found = _descend(parent, node.path)
        if found is None and node.self_if_missing:
            found = parent
        elements = [found] if isinstance(found, dict) else found if isinstance(found, list) else []
        todo = []
        for i, raw in enumerate(elements):
            item = _content(raw)
            if not isinstance(item, dict):
                continue
            key, at = f"{parent_key}/{node.tag}:{i}", [*where, i]
            nested = {c.path[0] for c in node.children} | {c.path[-1] for c in node.children}
            yield root_id, node.tag, key, parent_key, at, json.dumps({k: v for k, v in item.items() if k not in nested}, ensure_ascii=False)
            todo += [(item, key, at, c) for c in node.children]
        stack += reversed(todo)


def emit_tagged(df: DataFrame, id_col: str, json_col: str, nodes: tuple[Node, ...], root_tag: str = "root") -> DataFrame:
    """Tagged rows of all records; a narrow operation over the scan of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("root_id", pa.int64()), ("tag", pa.string()), ("key", pa.string()), ("parent_key", pa.string()), ("path", pa.list_(pa.int32())), ("payload", pa.string())])
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for root_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in visit(root_id, text, nodes, root_tag):
                    rows.append(row)
                    if len(rows) >= EMIT_ROWS:
                        yield flush()
                        rows.clear()
        if rows:
            yield flush()

    return df.select(F.col(id_col).cast("bigint").alias("root_id"), F.col(json_col).cast("string").alias("doc")).mapInArrow(run, TAGGED)


def table_of(tagged: DataFrame, tag: str, schema: str) -> DataFrame:
    """The flat table of one tag: keys, positions and the payload under ``schema`` (unreadable values null)."""
    return tagged.filter(F.col("tag") == tag).select("root_id", "key", "parent_key", "path", F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("p")).select("root_id", "key", "parent_key", "path", "p.*")


def write_tagged(tagged: DataFrame, folder: str) -> None:
    """All tables in one pass, one sub-folder per tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(folder)


#: Ids of repeated records are sent to all tasks up to this many; beyond it they are joined by shuffle.
MOST_SENT = 1_000_000


class Flat:
    """The tables of a tagged folder, each read under its schema and with every record once."""

    def __init__(self, spark: SparkSession, folder: str, root_tag: str = "root"):
        self.tagged = spark.read.schema(TAGGED).parquet(folder)
        roots = self.tagged.filter(F.col("tag") == root_tag).select("root_id")
        self.repeats = cut_lineage(roots.groupBy(F.col("root_id").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again"))
        self.few = self.repeats.count() <= MOST_SENT

    def table(self, tag: str, schema: str) -> DataFrame:
        rows = table_of(self.tagged, tag, schema)
        repeats = F.broadcast(self.repeats) if self.few else self.repeats
        same = F.col("root_id").eqNullSafe(F.col("again"))
        return rows.join(repeats, same, "left_anti").unionByName(rows.join(repeats, same, "left_semi").dropDuplicates(["key"]))


def flatten(df: DataFrame, id_col: str, json_col: str, nodes: tuple[Node, ...], folder: str) -> Flat:
    """Walk all records once, write their rows by tag, and give the tables."""
    write_tagged(emit_tagged(df, id_col, json_col, nodes), folder)
    return Flat(df.sparkSession, folder)


#: Layouts of preserved chats and web pages.
LAYOUT = (
    Node(
        "page",
        ("pages",),
        (
            Node("message", ("layout", "messages"), (Node("visual", ("visuals",)),)),
            Node("block", ("layout", "blocks")),
        ),
        self_if_missing=True,
    ),
)

PAGE_SCHEMA = "page_no string, image_width int, image_height int"
MESSAGE_SCHEMA = "sender string, time string, text string, message_bbox array<int>, avatar_bbox array<int>"
BLOCK_SCHEMA = "type string, text string, role string, asset_type string, importance string, caption string, bbox array<int>"
VISUAL_SCHEMA = "type string, alt string, bbox array<int>, bbox_refined array<int>"


SCHEMAS = {"page": PAGE_SCHEMA, "message": MESSAGE_SCHEMA, "block": BLOCK_SCHEMA, "visual": VISUAL_SCHEMA}


def layout_items(tables: dict[str, DataFrame]) -> DataFrame:
    """Message, block and visual positions of the flat tables of layouts."""
    path = F.col("path")
    found = None
    for tag in ("message", "block", "visual"):
        rows = tables[tag].select(
            F.col("root_id").alias("result_id"),
            path[0].alias("page_idx"),
            F.lit("block" if tag == "block" else "message").alias("item_kind"),
            path[1].alias("item_idx"),
            (path[2] if tag == "visual" else F.lit(-1)).alias("visual_idx"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found
