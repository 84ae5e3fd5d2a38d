"""Queries over sentences of documents, parts with overlap, blocks of layouts and transcripts as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import sentences as S
from quire.plans.nested_queries import _WALK, _tables
from quire.plans.registry import CORE
from quire.plans.sequential_queries import _subtitles
from quire.sources import sinks
from quire.sources.tables import once, spread, table


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "docx_blocks"), "block_id")


# --- sentences -------------------------------------------------------------------------------------------


@CORE.add("document_sentences")
def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Parts → blocks → sentences with ids made of their places and a digest of their text."""
    rows = spread(_blocks(spark, d).filter(F.col("source_text").isNotNull()).select("block_id", "part_name", "block_index", "source_text"))
    cut = rows.select("block_id", "part_name", "block_index", "source_text", F.posexplode(S.spans(F.col("source_text"))).alias("sentence_index", "s"))
    text = F.substring("source_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    key = F.concat_ws(":", "part_name", F.col("block_index").cast("string"), F.col("sentence_index").cast("string"))
    return cut.select("block_id", "sentence_index", key.alias("sentence_key"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.sha2(text, 256).alias("digest"))


@CORE.add("has_numbering", "SELECT block_id, (" + " OR ".join(f"regexp_matches(source_text, '{p}')" for p in S.NUMBERING) + ") AS numbered FROM (SELECT DISTINCT block_id, source_text FROM docx_blocks WHERE source_text IS NOT NULL)")
def has_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Whether a block holds numbering that asks for a split."""
    return table(spark, d, "docx_blocks").filter(F.col("source_text").isNotNull()).select("block_id", "source_text").dropDuplicates(["block_id"]).select("block_id", S.has_numbering(F.col("source_text")).alias("numbered"))


@CORE.add("real_sentences")
def real_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences a block holds."""
    rows = spread(_blocks(spark, d).select("block_id", "source_text"))
    return rows.select("block_id", F.size(S.spans(F.col("source_text"))).alias("sentences"))


@CORE.add("parse_pairs", """WITH s AS (SELECT DISTINCT doc_key, idx, trim(source_text) AS v FROM docx_sentences WHERE side = 'src' AND regexp_full_match(source_text, '[ -~]+') AND trim(source_text) <> '' AND NOT contains(source_text, '|||')),
t AS (SELECT DISTINCT doc_key, idx, trim(source_text) AS v FROM docx_sentences WHERE side = 'tgt' AND regexp_full_match(source_text, '[ -~]+') AND trim(source_text) <> '')
SELECT doc_key, idx, s.v AS src, t.v AS tgt FROM s JOIN t USING (doc_key, idx)""")
def parse_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an aligner, one per row of ASCII texts, read back as pairs."""
    rows = table(spark, d, "docx_sentences").filter(F.col("source_text").rlike("^[ -~]+$") & (F.trim("source_text") != "")).select("doc_key", "side", "idx", F.trim("source_text").alias("v")).distinct()
    src = rows.filter((F.col("side") == "src") & ~F.col("v").contains("|||")).select("doc_key", "idx", F.col("v").alias("a"))
    answer = src.join(rows.filter("side = 'tgt'").select("doc_key", "idx", F.col("v").alias("b")), ["doc_key", "idx"]).select("doc_key", "idx", F.concat(F.lit("```\n"), "a", F.lit(" ||| "), "b", F.lit("\n\n```")).alias("answer"))
    return answer.select("doc_key", "idx", F.explode(S.pairs(F.col("answer"))).alias("p")).select("doc_key", "idx", "p.src", "p.tgt")


@CORE.add("line_parts")
def line_parts(spark: SparkSession, d: str) -> DataFrame:
    """Documents in three parts of whole lines."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(S.line_parts(F.col("text"), 3)).alias("part", "text"))


# --- parts with overlap ----------------------------------------------------------------------------------

_SPLIT = """WITH s AS (SELECT doc_key, side, row_number() OVER (PARTITION BY doc_key, side ORDER BY idx) - 1 AS e, n FROM (SELECT DISTINCT doc_key, side, idx, coalesce(length(source_text), 0) AS n FROM docx_sentences WHERE doc_key IS NOT NULL AND side IS NOT NULL AND idx IS NOT NULL)),
c AS (SELECT doc_key, side, e, sum(n) OVER (PARTITION BY doc_key, side ORDER BY e) AS cum, sum(n) OVER (PARTITION BY doc_key, side) AS total, count(*) OVER (PARTITION BY doc_key, side) AS rows FROM s),
p AS (SELECT doc_key, side, any_value(rows) AS rows, arg_min(e, abs(cum - total // 3) * 1000000 + e) AS a0, arg_min(e, abs(cum - 2 * (total // 3)) * 1000000 + e) AS b0 FROM c WHERE total > 0 GROUP BY doc_key, side),
q AS (SELECT doc_key, side, rows, least(a0, rows - 1) AS a, least(CASE WHEN b0 <= a0 THEN a0 + 1 ELSE b0 END, rows - 1) AS b FROM p),
v AS (SELECT q.*, max(CASE WHEN e = a THEN cum END) AS ca, max(CASE WHEN e = b THEN cum END) AS cb FROM q JOIN c USING (doc_key, side) GROUP BY ALL),
r AS (SELECT v.doc_key, v.side, v.rows, coalesce(min(CASE WHEN e > a AND cum >= ca + 200 THEN e + 1 END), v.rows) AS a_right, CASE WHEN cb - 200 <= 0 THEN 0 ELSE coalesce(max(CASE WHEN e < b AND cum <= cb - 200 THEN e END), 0) END AS b_left, coalesce(min(CASE WHEN e > b AND cum >= cb + 200 THEN e + 1 END), v.rows) AS b_right, CASE WHEN ca - 200 <= 0 THEN 0 ELSE coalesce(max(CASE WHEN e < a AND cum <= ca - 200 THEN e END), 0) END AS a_left FROM v JOIN c USING (doc_key, side) GROUP BY v.doc_key, v.side, v.rows, a, b, ca, cb)
SELECT doc_key, side, 0 AS part, 0::BIGINT AS first, greatest(1, least(a_right, rows))::BIGINT AS stop FROM r
UNION ALL SELECT doc_key, side, 1, least(a_left, rows - 1)::BIGINT, greatest(least(a_left, rows - 1) + 1, least(b_right, rows))::BIGINT FROM r
UNION ALL SELECT doc_key, side, 2, least(b_left, rows - 1)::BIGINT, rows::BIGINT FROM r"""


@CORE.add("split_ranges", _SPLIT)
def split_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Sides of documents in three parts of like length with 200 characters of overlap; cuts strictly increase.

    Row numbers and running lengths come from sums per block of 256 places and windows inside a block, so that a long document is
    no single task; the ends of the overlap are minimums and maximums over rows.
    """
    rows = table(spark, d, "docx_sentences").filter(F.col("doc_key").isNotNull() & F.col("side").isNotNull() & F.col("idx").isNotNull())
    rows = rows.select("doc_key", "side", "idx", F.coalesce(F.length("source_text"), F.lit(0)).cast("bigint").alias("n")).distinct().withColumn("block", F.floor(F.col("idx") / 256))
    keys = ["doc_key", "side"]
    sums = rows.groupBy(*keys, "block").agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    side = Window.partitionBy(*keys)
    before = side.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.sum("s").over(side).alias("total"), F.sum("c").over(side).alias("rows"))
    inside = Window.partitionBy(*keys, "block").orderBy("idx")
    c = rows.join(sums, [*keys, "block"]).filter("total > 0").select(*keys, (F.col("c0") + F.row_number().over(inside) - 1).alias("e"), (F.col("s0") + F.sum("n").over(inside.rangeBetween(Window.unboundedPreceding, 0))).alias("cum"), "total", "rows")
    near = lambda i: F.min_by("e", F.struct(F.abs(F.col("cum") - i * F.floor(F.col("total") / 3)).alias("d"), "e"))
    p = c.groupBy(*keys).agg(F.max("rows").alias("n"), near(1).alias("a0"), near(2).alias("b0"))
    p = p.select(*keys, "n", F.least("a0", F.col("n") - 1).alias("a"), F.least(F.when(F.col("b0") <= F.col("a0"), F.col("a0") + 1).otherwise(F.col("b0")), F.col("n") - 1).alias("b"))
    both = c.join(p, keys)
    v = both.groupBy(*keys, "n", "a", "b").agg(F.max(F.when(F.col("e") == F.col("a"), F.col("cum"))).alias("ca"), F.max(F.when(F.col("e") == F.col("b"), F.col("cum"))).alias("cb"))
    both = c.join(v, keys)
    right = lambda x: F.coalesce(F.min(F.when((F.col("e") > F.col(x)) & (F.col("cum") >= F.col(f"c{x}") + 200), F.col("e") + 1)), F.first("n"))
    left = lambda x: F.when(F.first(f"c{x}") <= 200, 0).otherwise(F.coalesce(F.max(F.when((F.col("e") < F.col(x)) & (F.col("cum") <= F.col(f"c{x}") - 200), F.col("e"))), F.lit(0)))
    r = both.groupBy(*keys).agg(F.max("n").alias("n"), right("a").alias("ar"), left("a").alias("al"), right("b").alias("br"), left("b").alias("bl"))
    clip = lambda x: F.least(F.col(x), F.col("n") - 1)
    part = lambda no, first, stop: F.struct(F.lit(no).alias("part"), first.cast("bigint").alias("first"), stop.cast("bigint").alias("stop"))
    parts = F.array(part(0, F.lit(0), F.greatest(F.lit(1), F.least("ar", "n"))), part(1, clip("al"), F.greatest(clip("al") + 1, F.least("br", "n"))), part(2, clip("bl"), F.col("n")))
    return r.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.part", "p.first", "p.stop")


# --- blocks of layouts -----------------------------------------------------------------------------------


@CORE.add("render_blocks", _WALK + """SELECT result_id, page_idx::INT AS page_idx, item_idx::INT AS item_idx FROM i2 WHERE item_kind = 'block' AND CASE WHEN lower(trim(coalesce(i->>'type', ''))) = 'image'
THEN coalesce(nullif(lower(trim(coalesce(i->>'importance', ''))), ''), 'medium') IN ('high', 'medium') AND json_array_length(CASE WHEN json_type(i->'bbox') = 'ARRAY' THEN i->'bbox' END) = 4 AND (i->'bbox'->>2)::INT > (i->'bbox'->>0)::INT AND (i->'bbox'->>3)::INT > (i->'bbox'->>1)::INT ELSE trim(coalesce(i->>'text', '')) <> '' END""")
def render_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that are shown: texts that aren't blank, and images of some importance whose box has an area."""
    rows = _tables(spark, d)["block"]
    blank = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    b = F.col("bbox")
    box = (F.size(b) == 4) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1)))
    image = F.coalesce(F.nullif(blank(F.col("importance")), F.lit("")), F.lit("medium")).isin("high", "medium") & box
    shown = F.when(blank(F.col("type")) == "image", image).otherwise(blank(F.col("text")) != "")
    return rows.filter(F.coalesce(shown, F.lit(False))).select(F.col("root_id").alias("result_id"), F.col("path")[0].alias("page_idx"), F.col("path")[1].alias("item_idx"))


# --- transcripts -----------------------------------------------------------------------------------------

_W = "WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id) AS rn FROM asr_words) WHERE rn = 1)"

#: What a recogniser delivers, in milliseconds.
ASR = "transcripts array<struct<channel_id:int, sentences:array<struct<sentence_id:int, words:array<struct<begin_time:bigint, end_time:bigint, text:string, punctuation:string, id:bigint>>>>>>"


def transcript_words(json: DataFrame, doc: str) -> DataFrame:
    """Timed words of nested transcripts: channels → sentences → words, seconds for milliseconds, punctuation at its word.

    Unreadable documents give no word; missing levels are empty.
    """
    parsed = json.select("*", F.from_json(doc, ASR).alias("_d")).drop(doc)
    keep = parsed.columns[:-1]
    words = parsed.select(*keep, F.explode("_d.transcripts").alias("t")).select(*keep, F.coalesce("t.channel_id", F.lit(0)).alias("channel_id"), F.explode("t.sentences").alias("s"))
    words = words.select(*keep, "channel_id", "s.sentence_id", F.explode("s.words").alias("w"))
    seconds = lambda c: F.bround(F.col(c) / 1000, 3)
    return words.select(*keep, "channel_id", "sentence_id", F.col("w.id").alias("word_id"), F.concat(F.coalesce("w.text", F.lit("")), F.coalesce("w.punctuation", F.lit(""))).alias("word"), seconds("w.begin_time").alias("start"), seconds("w.end_time").alias("stop"))


@CORE.add("transcript_words", _W + " SELECT task_id, coalesce(channel_id, 0) AS channel_id, sentence_id, word_id, coalesce(word, '') || '。' AS word, round_even(round_even(word_start * 1000, 0)::BIGINT / 1000, 3) AS start, round_even(round_even(word_end * 1000, 0)::BIGINT / 1000, 3) AS stop FROM w WHERE sentence_id IS NOT NULL")
def transcript_words_query(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as the nested JSON of a recogniser, read back as timed words."""
    rows = once(table(spark, d, "asr_words"), "word_id").filter(F.col("sentence_id").isNotNull())
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("bigint")
    word = F.struct(ms("word_start").alias("begin_time"), ms("word_end").alias("end_time"), F.coalesce("word", F.lit("")).alias("text"), F.lit("。").alias("punctuation"), F.col("word_id").alias("id"))
    sentences = rows.groupBy("task_id", "channel_id", "sentence_id").agg(F.collect_list(word).alias("words"))  # one sentence
    doc = F.to_json(F.struct(F.array(F.struct("channel_id", F.array(F.struct("sentence_id", "words")).alias("sentences"))).alias("transcripts")))
    return transcript_words(sentences.select("task_id", doc.alias("doc")), "doc")


@CORE.add("sentence_meta", _W + ", m AS (SELECT task_id, sentence_id, arg_min(word, (word_start, word_id)) AS lead FROM w WHERE sentence_id IS NOT NULL AND word IS NOT NULL AND word_id % 3 <> 0 GROUP BY ALL), g AS (SELECT task_id, sentence_id // 3 AS segment, sentence_id FROM w WHERE sentence_id IS NOT NULL GROUP BY ALL) SELECT g.task_id, segment, arg_min(lead, g.sentence_id) AS lead FROM g LEFT JOIN m ON g.sentence_id = m.sentence_id AND g.task_id IS NOT DISTINCT FROM m.task_id GROUP BY g.task_id, segment")
def sentence_meta(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a segment: the first of its sentences that has something. Three sentences make a segment here."""
    rows = once(table(spark, d, "asr_words"), "word_id").filter(F.col("sentence_id").isNotNull())
    known = rows.filter(F.col("word").isNotNull() & (F.col("word_id") % 3 != 0)).groupBy("task_id", "sentence_id").agg(F.min_by("word", F.struct("word_start", "word_id")).alias("lead"))
    parts = rows.select("task_id", F.floor(F.col("sentence_id") / 3).cast("int").alias("segment"), "sentence_id").distinct()
    m = known.select(F.col("task_id").alias("t"), F.col("sentence_id").alias("s"), "lead")
    joined = parts.join(m, F.col("task_id").eqNullSafe(F.col("t")) & (F.col("sentence_id") == F.col("s")), "left")
    return joined.groupBy("task_id", "segment").agg(F.min_by("lead", F.when(F.col("lead").isNotNull(), F.col("sentence_id"))).alias("lead"))


@CORE.add("transcript_exports")
def transcript_exports(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle segments as blocks of SRT and VTT and as lines of plain and tab-separated text."""
    return sinks.transcript_lines(_subtitles(spark, d))


@CORE.add("vtt_time", _W + ", m AS (SELECT word_id, greatest(round_even(word_start * 1000, 0), 0)::BIGINT AS ms FROM w) SELECT word_id, format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt FROM m")
def vtt_time(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "asr_words").select("word_id", "word_start", "loaded_at"), "word_id").select("word_id", N.srt_time(F.col("word_start"), ".").alias("vtt"))
