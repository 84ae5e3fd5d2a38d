"""Queries of operators that fold, read markup or split by language; tested against brute force on fixtures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import language_parts as L
from quire.functions import measure as M
from quire.operators import sequential as S
from quire.plans.nested_queries import _tables
from quire.plans.registry import CORE
from quire.sources import files
from quire.sources.sinks import srt_blocks as blocks
from quire.sources.tables import once, spread, table


@CORE.add("pack_sentences", """WITH RECURSIVE s AS (SELECT doc_key, side, idx, n, row_number() OVER (PARTITION BY doc_key, side ORDER BY idx) AS k FROM (SELECT sent_id, any_value(doc_key) AS doc_key, any_value(side) AS side, any_value(idx) AS idx, coalesce(any_value(length(source_text)), 0)::BIGINT AS n FROM docx_sentences GROUP BY sent_id)),
p AS (SELECT doc_key, side, idx, k, 0 AS group_no, 1 AS held, n AS size FROM s WHERE k = 1
UNION ALL SELECT s.doc_key, s.side, s.idx, s.k, p.group_no + CASE WHEN p.held >= 15 OR p.size + s.n > 3000 THEN 1 ELSE 0 END, CASE WHEN p.held >= 15 OR p.size + s.n > 3000 THEN 1 ELSE p.held + 1 END, CASE WHEN p.held >= 15 OR p.size + s.n > 3000 THEN s.n ELSE p.size + s.n END
FROM p JOIN s ON s.k = p.k + 1 AND s.doc_key IS NOT DISTINCT FROM p.doc_key AND s.side IS NOT DISTINCT FROM p.side)
SELECT doc_key, side, (idx // 2000)::INT AS block, idx, group_no::INT AS group_no FROM p""")
def pack_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docx_sentences").select("sent_id", "doc_key", "side", "idx", F.coalesce(F.length("source_text"), F.lit(0)).alias("n")).dropDuplicates(["sent_id"]).drop("sent_id")
    return S.pack_sentences(rows)


@CORE.add("chunk_text")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", S.chunk_text(F.col("text"), 3000).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("chunk_no", "chunk"))


@CORE.add("weak_windows", """WITH RECURSIVE l AS (SELECT *, coalesce(low_confidence, false) OR coalesce(score < 0.55, true) AS weak, row_number() OVER (PARTITION BY doc_key ORDER BY src_start, tgt_start, link_id) AS k, greatest(src_end - src_start, 1) + greatest(tgt_end - tgt_start, 0) AS size FROM alignment_links),
w AS (SELECT doc_key, k, weak, src_start, src_end, tgt_start, tgt_end, size, CASE WHEN weak THEN size ELSE 0 END AS units, CASE WHEN weak THEN k END AS first FROM l WHERE k = 1
UNION ALL SELECT l.doc_key, l.k, l.weak, l.src_start, l.src_end, l.tgt_start, l.tgt_end, l.size, CASE WHEN NOT l.weak THEN 0 WHEN w.weak AND w.units < 12 THEN w.units + l.size ELSE l.size END, CASE WHEN NOT l.weak THEN NULL WHEN w.weak AND w.units < 12 THEN w.first ELSE l.k END
FROM w JOIN l ON l.k = w.k + 1 AND l.doc_key IS NOT DISTINCT FROM w.doc_key)
SELECT doc_key, arg_min(src_start, k) AS src_start, max(src_end) AS src_end, arg_min(tgt_start, k) AS tgt_start, max(tgt_end) AS tgt_end, count(*)::INT AS links, sum(size)::INT AS units FROM w WHERE weak GROUP BY doc_key, first""")
def weak_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.weak_windows(table(spark, d, "alignment_links"))


@CORE.add("weak_runs", """WITH l AS (SELECT doc_key, src_start, link_id, coalesce(low_confidence, false) AS weak FROM alignment_links),
n AS (SELECT *, src_start // 2000 AS block, row_number() OVER (PARTITION BY doc_key, src_start // 2000 ORDER BY src_start, link_id) - row_number() OVER (PARTITION BY doc_key, src_start // 2000, weak ORDER BY src_start, link_id) AS run FROM l)
SELECT doc_key, min(src_start) AS src_start, count(*) AS links FROM n WHERE weak GROUP BY doc_key, block, run""")
def weak_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of weak links, before they are cut by size; they end with blocks of 2,000 rows."""
    from pyspark.sql import Window

    rows = table(spark, d, "alignment_links").select("doc_key", "src_start", "link_id", F.coalesce("low_confidence", F.lit(False)).alias("weak"), F.floor(F.col("src_start") / 2000).alias("block"))
    order = ["src_start", "link_id"]
    run = F.row_number().over(Window.partitionBy("doc_key", "block").orderBy(*order)) - F.row_number().over(Window.partitionBy("doc_key", "block", "weak").orderBy(*order))
    return rows.withColumn("run", run).filter("weak").groupBy("doc_key", "block", "run").agg(F.min("src_start").alias("src_start"), F.count("*").alias("links")).drop("block", "run")


@CORE.add("weak_stretches", """WITH l AS (SELECT doc_key, src_start, link_id, coalesce(low_confidence, false) AS weak FROM alignment_links),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY src_start, link_id) - row_number() OVER (PARTITION BY doc_key, weak ORDER BY src_start, link_id) AS run FROM l)
SELECT doc_key, min(src_start) AS src_start, count(*) AS links FROM n WHERE weak GROUP BY doc_key, run""")
def weak_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Runs of weak links over whole documents.

    Runs are found inside blocks of 2,000 places; a run that reaches a block's end goes on with the one that begins the next, so no
    task holds a long document.
    """
    from pyspark.sql import Window

    rows = table(spark, d, "alignment_links").select("doc_key", "src_start", "link_id", F.coalesce("low_confidence", F.lit(False)).alias("weak"), F.floor(F.col("src_start") / 2000).alias("block"))
    order = Window.partitionBy("doc_key", "block").orderBy("src_start", "link_id")
    changes = F.when(F.col("weak") == F.lag("weak").over(order), 0).otherwise(1)
    runs = rows.withColumn("run", F.sum(changes).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_key", "block", "run").agg(F.first("weak").alias("weak"), F.min("src_start").alias("src_start"), F.count("*").alias("links"))
    last = F.max("run").over(Window.partitionBy("doc_key", "block"))
    edge = runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == last))
    by_block = Window.partitionBy("doc_key").orderBy("block", "run")
    new = F.when((F.lag("weak").over(by_block) == F.col("weak")) & (F.lag("block").over(by_block) < F.col("block")), 0).otherwise(1)
    joined = edge.filter("edge").withColumn("g", new).withColumn("g", F.sum("g").over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("doc_key", "g").agg(F.first("weak").alias("weak"), F.min("src_start").alias("src_start"), F.sum("links").alias("links"))
    return joined.filter("weak").select("doc_key", "src_start", "links").unionByName(edge.filter("NOT edge AND weak").select("doc_key", "src_start", "links"))


def _subtitles(spark: SparkSession, d: str) -> DataFrame:
    return S.subtitles(once(table(spark, d, "asr_words"), "word_id").select("task_id", "channel_id", "word_id", "word_start", "word_end", "word"))


@CORE.add("subtitle_segments")
def subtitle_segments(spark: SparkSession, d: str) -> DataFrame:
    return _subtitles(spark, d)


@CORE.add("srt_blocks")
def srt_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks(_subtitles(spark, d))


@CORE.add("vector_alignment")
def vector_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "docx_sentences"), "sent_id").select("doc_key", "side", "idx", F.col("source_text").alias("text"))
    return S.align_vectors(rows)


@CORE.add("coverage_check")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows at one position against the texts of their document, from which every seventh row has been lost; the key also tells
    the 200 rows they stand in."""
    rows = once(table(spark, d, "docx_sentences"), "sent_id").filter(F.length("source_text") > 0).withColumn("key", F.col("doc_key"))
    kept = rows.filter(F.col("idx") % 7 != 3)
    joined = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("idx", "source_text")))), lambda x: x["source_text"]), "\n")
    texts = kept.groupBy(F.col("key").alias("doc_key")).agg(joined("src").alias("src_text"), joined("tgt").alias("tgt_text"))
    src = rows.filter("side = 'src'").select("key", "idx", F.col("source_text").alias("src"))
    tgt = rows.filter("side = 'tgt'").select("key", "idx", F.col("source_text").alias("tgt"))
    pairs = src.join(tgt, ["key", "idx"]).select(F.col("key").alias("doc_key"), F.col("idx").alias("row_no"), "src", "tgt")
    return S.coverage(pairs, texts).withColumn("doc_key", F.concat_ws("/", "doc_key", F.floor(F.col("row_no") / 200).cast("string")))


@CORE.add("box_nms")
def box_nms(spark: SparkSession, d: str) -> DataFrame:
    """Message boxes of a page that no larger one overlaps; boxes without area can't stand."""
    rows = _tables(spark, d)["message"].filter(F.size("message_bbox") == 4)
    b = F.col("message_bbox")
    box = F.struct(((b[2] - b[0]) * (b[3] - b[1])).cast("double").alias("score"), b[0].alias("x1"), b[1].alias("y1"), b[2].alias("x2"), b[3].alias("y2"))
    pages = rows.withColumn("box", box).filter("box.x2 > box.x1 AND box.y2 > box.y1").groupBy("root_id", F.col("path")[0].alias("page_idx")).agg(F.collect_list("box").alias("boxes"))
    return pages.select(F.col("root_id").alias("result_id"), "page_idx", F.explode(S.nms(F.col("boxes"))).alias("k")).select("result_id", "page_idx", "k.x1", "k.y1", "k.x2", "k.y2")


@CORE.add("html_to_text")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", files.as_udf(files.html_to_text)(F.col("text")).alias("text"))


@CORE.add("html_sanitize")
def html_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", files.as_udf(files.sanitized)(F.col("text")).alias("markup"))


@CORE.add("decode_text", "SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL ELSE 'utf-8-sig' END AS encoding FROM documents")
def decode_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts through bytes and back by the decoding chain."""
    rows = table(spark, d, "documents").select("doc_id", files.decoded(F.encode("text", "UTF-8")).alias("x"))
    return rows.select("doc_id", "x.text", "x.encoding")


@CORE.add("scan_files")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """The listing of a folder of tables, without content."""
    return files.listing(spark, d, [".parquet"]).select("name", "extension", "length")


@CORE.add("language_split")
def language_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_items").select("item_id", "text").filter(F.col("text").isNotNull()).dropDuplicates(["item_id"])
    return rows.select("item_id", F.explode(L.parts(F.col("text"))).alias("p")).select("item_id", "p.language", "p.text")


@CORE.add("language_fragments")
def language_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments and characters per language over all items."""
    return language_split(spark, d).groupBy("language").agg(F.count("*").alias("fragments"), F.sum(M.chars(F.col("text"))).alias("chars"))


@CORE.add("variant_convert")
def variant_convert(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a bounded dictionary of variants applied; counts of replacements and open cases."""
    rules, ambiguous = dict(VARIANTS), {"license", "practice"}
    pattern = S.variant_pattern(rules, ambiguous)

    @F.pandas_udf("struct<text:string,replaced:int,ambiguous:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0, 0) if t is None else S.convert_variants(t, rules, ambiguous, pattern) for t in texts], columns=["text", "replaced", "ambiguous"])

    # texts without Latin letters can't hold a variant; declared languages may be wrong or null, so they don't decide
    rows = spread(table(spark, d, "documents").filter(F.col("text").rlike("[A-Za-z]")).select("doc_id", "text")).select("doc_id", run.asNondeterministic()("text").alias("c"))
    return rows.select("doc_id", "c.text", "c.replaced", "c.ambiguous")


#: An own small dictionary, British to American.
VARIANTS = (("aeroplane", "airplane"), ("colour", "color"), ("colourfully", "colorfully"), ("organised", "organized"), ("accessorised", "accessorized"), ("amortisable", "amortizable"), ("metre", "meter"), ("metres", "meters"), ("offence", "offense"), ("cheque", "check"), ("catalogue", "catalog"), ("centre", "center"), ("grey", "gray"), ("labelled", "labeled"), ("travelled", "traveled"))


@CORE.add("unique_names", "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM tasks) WHERE rn = 1 AND filename IS NOT NULL), n AS (SELECT id, filename, row_number() OVER (PARTITION BY coalesce(batch_id, task_id), lower(filename) ORDER BY id) AS k FROM t) SELECT id, CASE WHEN k = 1 THEN filename ELSE regexp_replace(filename, '(\\.[A-Za-z0-9]{1,8})?$', '_' || k || '\\1') END AS name FROM n")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Names made unique within their batch by a number before the extension."""
    from pyspark.sql import Window

    rows = table(spark, d, "tasks").dropDuplicates(["id"]).filter(F.col("filename").isNotNull())
    k = F.row_number().over(Window.partitionBy(F.coalesce("batch_id", "task_id"), F.lower("filename")).orderBy("id"))
    ext = F.regexp_extract("filename", r"(\.[A-Za-z0-9]{1,8})$", 1)
    stem = F.expr("substring(filename, 1, length(filename) - length(ext))")
    rows = rows.withColumn("k", k).withColumn("ext", ext).withColumn("stem", stem)
    return rows.select("id", F.when(F.col("k") == 1, F.col("filename")).otherwise(F.concat("stem", F.lit("_"), F.col("k").cast("string"), "ext")).alias("name"))


@CORE.add("unpivot_labels", "SELECT label_id, 'zh' AS lang, label_zh AS label FROM field_labels UNION ALL SELECT label_id, 'en', label_en FROM field_labels")
def unpivot_labels(spark: SparkSession, d: str) -> DataFrame:
    """A wide reference list as one row per form."""
    return table(spark, d, "field_labels").select("label_id", F.expr("stack(2, 'zh', label_zh, 'en', label_en) AS (lang, label)"))


@CORE.add("page_spec", "WITH s AS (SELECT doc_key, min(src_start) + 1 AS a, max(src_end) AS b FROM alignment_links GROUP BY doc_key) SELECT doc_key, (b - a + 1)::BIGINT AS pages, (a - 1)::INT AS first_page FROM s")
def page_spec(spark: SparkSession, d: str) -> DataFrame:
    """Specifications like ``1-9,3`` read as positions, each once."""
    from quire.functions.names import pages

    s = table(spark, d, "alignment_links").groupBy("doc_key").agg((F.min("src_start") + 1).alias("a"), F.max("src_end").alias("b"))
    spec = F.concat_ws(",", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")), F.col("a").cast("string"))
    got = s.select("doc_key", pages(spec, F.col("b")).alias("p"))
    return got.select("doc_key", F.size("p").cast("bigint").alias("pages"), F.col("p")[0].alias("first_page"))
