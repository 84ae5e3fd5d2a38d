"""Queries of problem 2: nested layouts as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import nested as N
from quire.plans.registry import CORE
from quire.session import scratch
from quire.sources.tables import spread, table

#: The same walk in SQL: unwrap strings, one page when there are none, one element for a single object.
_WALK = """
WITH r AS (SELECT result_id, any_value(layout) AS layout FROM preserve_results GROUP BY result_id),
j0 AS (SELECT result_id, CASE WHEN json_valid(layout) THEN layout::JSON END AS j FROM r),
j1 AS (SELECT result_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM j0),
j2 AS (SELECT result_id, j FROM j1 WHERE json_type(j) = 'OBJECT'),
p0 AS (SELECT result_id, CASE json_type(j->'pages') WHEN 'ARRAY' THEN json_extract(j, '$.pages[*]') WHEN 'OBJECT' THEN [j->'pages'] ELSE CASE WHEN coalesce(json_type(j->'pages'), 'NULL') = 'NULL' THEN [j] ELSE [] END END AS l FROM j2),
p1 AS (SELECT result_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS page_idx FROM p0),
p2 AS (SELECT result_id, page_idx, p, CASE WHEN json_type(p->'layout') = 'VARCHAR' THEN CASE WHEN json_valid(p->>'layout') THEN (p->>'layout')::JSON END WHEN json_type(p->'layout') IS NULL THEN p ELSE p->'layout' END AS lay FROM p1 WHERE json_type(p) = 'OBJECT'),
i0 AS (
  SELECT result_id, page_idx, 'message' AS item_kind, CASE json_type(lay->'messages') WHEN 'ARRAY' THEN json_extract(lay, '$.messages[*]') WHEN 'OBJECT' THEN [lay->'messages'] ELSE [] END AS l FROM p2
  UNION ALL
  SELECT result_id, page_idx, 'block', CASE json_type(lay->'blocks') WHEN 'ARRAY' THEN json_extract(lay, '$.blocks[*]') WHEN 'OBJECT' THEN [lay->'blocks'] ELSE [] END FROM p2),
i1 AS (SELECT result_id, page_idx, item_kind, unnest(l) AS i, generate_subscripts(l, 1) - 1 AS item_idx FROM i0),
i2 AS (SELECT * FROM i1 WHERE json_type(i) = 'OBJECT'),
v0 AS (SELECT result_id, page_idx, item_idx, CASE json_type(i->'visuals') WHEN 'ARRAY' THEN json_extract(i, '$.visuals[*]') WHEN 'OBJECT' THEN [i->'visuals'] ELSE [] END AS l FROM i2 WHERE item_kind = 'message'),
v1 AS (SELECT result_id, page_idx, item_idx, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS visual_idx FROM v0),
v2 AS (SELECT * FROM v1 WHERE json_type(v) = 'OBJECT')
"""


#: Tables of layouts by session and state of the input files, so that several queries share one walk and one write.
_WRITTEN: dict[tuple, N.Flat] = {}


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The four flat tables, from one pass over the layouts that is written by tag."""
    rows = table(spark, d, "preserve_results")
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().orderBy("file_path").collect()
    state = (spark.sparkContext.applicationId, d, tuple(tuple(f) for f in files))
    if state not in _WRITTEN:
        _WRITTEN[state] = N.flatten(spread(rows.select("result_id", "layout")), "result_id", "layout", N.LAYOUT, scratch(spark, "layouts"))
    return {tag: _WRITTEN[state].table(tag, schema) for tag, schema in N.SCHEMAS.items()}


@CORE.add(
    "p2_found",
    _WALK
    + """SELECT result_id, page_idx::INT AS page_idx, item_kind, item_idx::INT AS item_idx, -1 AS visual_idx FROM i2
UNION ALL SELECT result_id, page_idx::INT, 'message', item_idx::INT, visual_idx::INT FROM v2""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Positions of all items of the flat tables."""
    return N.layout_items(_tables(spark, d))


@CORE.add(
    "p2_pages",
    _WALK
    + """SELECT result_id, page_idx::INT AS page_idx, result_id || '/page:' || page_idx AS page_key, CAST(result_id AS VARCHAR) AS parent_key,
try_cast(p->>'page_no' AS INT) AS page_no, try_cast(p->>'image_width' AS INT) AS image_width, try_cast(p->>'image_height' AS INT) AS image_height FROM p2""",
)
def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d)["page"]
    return rows.select(F.col("root_id").alias("result_id"), F.col("path")[0].alias("page_idx"), F.col("key").alias("page_key"), "parent_key", F.col("page_no").try_cast("int").alias("page_no"), "image_width", "image_height")


@CORE.add(
    "p2_messages",
    _WALK
    + """SELECT result_id, page_idx::INT AS page_idx, item_idx::INT AS item_idx, result_id || '/page:' || page_idx || '/message:' || item_idx AS message_key, result_id || '/page:' || page_idx AS parent_key,
i->>'sender' AS sender, i->>'text' AS text FROM i2 WHERE item_kind = 'message'""",
)
def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d)["message"]
    return rows.select(F.col("root_id").alias("result_id"), F.col("path")[0].alias("page_idx"), F.col("path")[1].alias("item_idx"), F.col("key").alias("message_key"), "parent_key", "sender", "text")


@CORE.add(
    "p2_blocks",
    _WALK
    + """SELECT result_id, page_idx::INT AS page_idx, item_idx::INT AS item_idx, result_id || '/page:' || page_idx || '/block:' || item_idx AS block_key, result_id || '/page:' || page_idx AS parent_key,
i->>'type' AS type, i->>'text' AS text, i->>'role' AS role, i->>'asset_type' AS asset_type, i->>'caption' AS caption FROM i2 WHERE item_kind = 'block'""",
)
def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d)["block"]
    return rows.select(F.col("root_id").alias("result_id"), F.col("path")[0].alias("page_idx"), F.col("path")[1].alias("item_idx"), F.col("key").alias("block_key"), "parent_key", "type", "text", "role", "asset_type", "caption")


@CORE.add(
    "p2_visuals",
    _WALK
    + """SELECT result_id, page_idx::INT AS page_idx, item_idx::INT AS item_idx, visual_idx::INT AS visual_idx, result_id || '/page:' || page_idx || '/message:' || item_idx || '/visual:' || visual_idx AS visual_key,
result_id || '/page:' || page_idx || '/message:' || item_idx AS parent_key, v->>'type' AS type, v->>'alt' AS alt FROM v2""",
)
def p2_visuals(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d)["visual"]
    path = F.col("path")
    return rows.select(F.col("root_id").alias("result_id"), path[0].alias("page_idx"), path[1].alias("item_idx"), path[2].alias("visual_idx"), F.col("key").alias("visual_key"), "parent_key", "type", "alt")
