"""The word-count report: billable units, totals of files and of a run, status of files, and its sheets; rename and variant summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import measure as M
from quire.functions import names as N
from quire.operators import relational as R
from quire.plans.registry import CORE
from quire.plans.relational_queries import _T, _tasks
from quire.plans.text_queries import _A, _B, _KINDS, _MEASURED, _kind_sql, _marked, _n, _segment_sql, _tokens_sql, _words_sql
from quire.sources.tables import spread, table

#: What one item is measured by, in the order of the report.
SCRIPTS = ("han", "kana", "hangul", *_KINDS, "cjk_punct")
MEASURES = ("words", "chars_no_space", "chars", "cjk_no_spaces", "cjk_with_spaces", "latin_no_spaces", "latin_with_spaces", *SCRIPTS)


def measures(text: Column) -> list[Column]:
    """All measures of a text; tokens are taken and classified once."""
    kinds = M.token_kinds(text)
    cjk, latin = M.dominant_chars(text, "cjk"), M.dominant_chars(text, "latin")
    return [M.word_count(text).alias("words"), M.chars_no_space(text).alias("chars_no_space"), M.chars(text).alias("chars"), cjk.alias("_cjk"), latin.alias("_latin"), M.han_count(text).alias("han"), M.kana_count(text).alias("kana"), M.hangul_count(text).alias("hangul"), kinds.alias("_kinds")]


def measured(rows: DataFrame, keys: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    wide = rows.select(*keys, *measures(text))
    kinds = {k: M.of_kind(F.col("_kinds"), k) for k in _KINDS}
    punct = F.col("words") - F.col("han") - F.col("kana") - F.col("hangul") - F.size("_kinds")
    parts = {"cjk_no_spaces": F.col("_cjk.no_spaces"), "cjk_with_spaces": F.col("_cjk.with_spaces"), "latin_no_spaces": F.col("_latin.no_spaces"), "latin_with_spaces": F.col("_latin.with_spaces"), "cjk_punct": punct, **kinds}
    return wide.select(*keys, *(parts.get(m, F.col(m)).cast("bigint").alias(m) for m in MEASURES))


#: Billable units as sums of measures.
BILLABLE = {"chinese": ("han", "cjk_punct"), "japanese": ("han", "kana", "cjk_punct"), "korean": ("hangul", "cjk_punct"), "latin": ("latin", "mixed"), "cyrillic": ("cyrillic",), "arabic": ("arabic",), "greek": ("greek",), "hebrew": ("hebrew",), "thai": ("thai",)}


def billable(prefix: str = "") -> list[Column]:
    out = []
    for name, parts in BILLABLE.items():
        total = F.col(prefix + parts[0])
        for p in parts[1:]:
            total = total + F.col(prefix + p)
        out.append(total.alias(f"{prefix}billable_{name}"))
    return out


def _item_sql(t: str) -> str:
    """The measures of a text column but for dominant segments."""
    m = _marked(t)
    kinds = f"list_transform({_tokens_sql(t)}, lambda w: {_kind_sql('w')})"
    return (
        f"{_words_sql(t)} AS words, length(regexp_replace({t}, '[{M.SPACE}]', '', 'g'))::BIGINT AS chars_no_space, length({t})::BIGINT AS chars, {_n(t, '[' + M.HAN + ']')}::BIGINT AS han, {_n(t, '[' + M.KANA + ']')}::BIGINT AS kana, {_n(t, '[' + M.HANGUL + ']')}::BIGINT AS hangul, "
        f"({_words_sql(t)} - {_n(m, _A)} / 2 - {_n(m, _B)})::BIGINT AS cjk_punct, {kinds} AS kinds"
    )


def _dominant_sql(which: str) -> str:
    """Dominant segments of the items, from the SQL over documents."""
    return _segment_sql(which).replace("doc_id", "item_id").replace("FROM documents WHERE text IS NOT NULL", "FROM t")


_ITEMS = (
    _MEASURED.replace("any_value(text) AS text", "coalesce(any_value(text), '') AS text")
    + f", i AS (SELECT item_id, file_id, source_type, coalesce(is_extra, false) AS extra, {_item_sql('text')} FROM t), c AS ({_dominant_sql('cjk')}), l AS ({_dominant_sql('latin')}),"
    + " m AS (SELECT i.*, c.no_spaces AS cjk_no_spaces, c.with_spaces AS cjk_with_spaces, l.no_spaces AS latin_no_spaces, l.with_spaces AS latin_with_spaces, "
    + ", ".join(f"len(list_filter(kinds, lambda k: k = '{k}'))::BIGINT AS \"{k}\"" for k in _KINDS)
    + " FROM i JOIN c USING (item_id) JOIN l USING (item_id))"
)


def _billable_sql(prefix: str = "") -> str:
    return ", ".join("(" + " + ".join(f'"{prefix}{p}"' for p in parts) + f")::BIGINT AS {prefix}billable_{name}" for name, parts in BILLABLE.items())


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items, each once, with all measures. Texts are measured where they are read; repeats are merged on the narrow result."""
    rows = spread(table(spark, d, "text_items").select("item_id", "file_id", "source_type", "is_extra", "text"))
    rows = rows.select("item_id", "file_id", F.lower(M.strip(F.col("source_type"))).alias("source_type"), F.coalesce("is_extra", F.lit(False)).alias("extra"), "text")
    return measured(rows, ["item_id", "file_id", "source_type", "extra"]).dropDuplicates(["item_id"])


@CORE.add("billable_counts", _ITEMS + f" SELECT item_id, {_billable_sql()} FROM m")
def billable_counts(spark: SparkSession, d: str) -> DataFrame:
    """The nine billable units of every item."""
    return _items(spark, d).select("item_id", *billable())


def _sums(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    main = [F.coalesce(F.sum(F.when(~F.col("extra"), F.col(m))), F.lit(0)).alias(f"main_{m}") for m in MEASURES]
    extra = [F.coalesce(F.sum(F.when(F.col("extra"), F.col(m))), F.lit(0)).alias(f"extra_{m}") for m in MEASURES]
    return rows.groupBy(*keys).agg(*more, *main, *extra)


_SUMS = ", ".join(f"coalesce(sum(CASE WHEN {'' if e == 'extra' else 'NOT '}extra THEN \"{m}\" END), 0)::BIGINT AS {e}_{m}" for e in ("main", "extra") for m in MEASURES)


@CORE.add("file_totals", _ITEMS + f" SELECT file_id, {_SUMS} FROM m GROUP BY file_id")
def file_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of a file's main text and of its extras; items are summed before the shuffle."""
    return _sums(_items(spark, d), ["file_id"])


# States of a file, and what a file must be for them.
MOST_BYTES = 200 * 1024 * 1024
STATES = ("counted", "failed", "skipped", "needs_ocr", "needs_cad_parser")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".gif")
DRAWINGS = (".dwg", ".dxf")


def file_state(extension: Column, size: Column, has_text: Column, failed: Column, ocr: bool = False, cad: bool = False, most: int = MOST_BYTES) -> Column:
    """The state of a file in the order in which it is decided."""
    return (
        F.when(size > most, "skipped")
        .when(extension.isin(*IMAGES) & F.lit(not ocr), "needs_ocr")
        .when(extension.isin(*DRAWINGS) & F.lit(not cad), "needs_cad_parser")
        .when(failed, "failed")
        .when((extension == ".pdf") & ~has_text & F.lit(not ocr), "needs_ocr")
        .otherwise("counted")
    )


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Uploaded files of the job log with the size of their parameters standing in for bytes, in units of a limit of 60."""
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", N.extension(F.col("filename")).alias("extension"), F.length(F.coalesce("params_json", F.lit(""))).alias("size"), (R.status_name(F.col("status")) == "failed").alias("failed"), (F.length(F.coalesce("message", F.lit(""))) > 0).alias("has_text"))
    state = file_state(F.col("extension"), F.col("size"), F.col("has_text"), F.coalesce("failed", F.lit(False)), most=60)
    return rows.select("id", "extension", "size", state.alias("state"))


_FILES = _T + f""", e AS (SELECT id, lower(regexp_extract(filename, '(\\.[A-Za-z0-9]{{1,8}})$', 1)) AS extension, length(coalesce(params_json, '')) AS size, coalesce(st = 'failed', false) AS failed, length(coalesce(message, '')) > 0 AS has_text FROM t WHERE filename IS NOT NULL),
s AS (SELECT id, extension, size, CASE WHEN size > 60 THEN 'skipped' WHEN extension IN ({', '.join(repr(x) for x in IMAGES)}) THEN 'needs_ocr' WHEN extension IN ('.dwg', '.dxf') THEN 'needs_cad_parser' WHEN failed THEN 'failed' WHEN extension = '.pdf' AND NOT has_text THEN 'needs_ocr' ELSE 'counted' END AS state FROM e)"""


@CORE.add("file_status", _FILES + " SELECT id, extension, state FROM s")
def file_status(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", "extension", "state")


@CORE.add("status_totals", _FILES + " SELECT count(*) AS files, " + ", ".join(f"count_if(state = '{s}') AS {s}_files" for s in STATES) + ", count(*) > 5000 AS truncated FROM s")
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files of a run by state."""
    return _files(spark, d).agg(F.count("*").alias("files"), *(F.count_if(F.col("state") == s).alias(f"{s}_files") for s in STATES), (F.count("*") > 5000).alias("truncated"))


_RUN = _ITEMS + f", r AS (SELECT count(DISTINCT file_id) AS files, count(*) AS items, {_SUMS} FROM m)"
_SCRIPT_SUM = lambda e: "(" + " + ".join(f"{e}_{s}" for s in SCRIPTS) + f")::BIGINT AS {e}_script_total"


@CORE.add("run_summary", _RUN + f" SELECT *, {_SCRIPT_SUM('main')}, {_SCRIPT_SUM('extra')}, {_billable_sql('main_')}, {_billable_sql('extra_')} FROM r")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """All sums of a run in one row: measures, scripts and billable units of main texts and extras."""
    sums = _sums(_items(spark, d), [], F.countDistinct("file_id").alias("files"), F.count("*").alias("items"))
    total = lambda e: sum((F.col(f"{e}_{s}") for s in SCRIPTS[1:]), F.col(f"{e}_{SCRIPTS[0]}")).alias(f"{e}_script_total")
    return sums.select("*", total("main"), total("extra"), *billable("main_"), *billable("extra_"))


def report_sheets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The sheets of the report, for :func:`quire.sources.sinks.write_sheets`."""
    return {"summary": run_summary(spark, d), "files": file_totals(spark, d), "sources": _items(spark, d), "failures": _files(spark, d).filter("state <> 'counted'"), "rules": rules(spark)}


def rules(spark: SparkSession) -> DataFrame:
    """How billable units are made up."""
    return spark.createDataFrame([(f"billable_{k}", " + ".join(v)) for k, v in BILLABLE.items()], "name string, made_of string")


@CORE.add("report_failures", _FILES + " SELECT id, extension, size, state FROM s WHERE state <> 'counted'")
def report_failures(spark: SparkSession, d: str) -> DataFrame:
    """The report's sheet of files that were not counted."""
    return _files(spark, d).filter("state <> 'counted'").select("id", "extension", "size", "state")


@CORE.add("report_rules", "SELECT * FROM (VALUES " + ", ".join(f"('billable_{k}', '{' + '.join(v)}')" for k, v in BILLABLE.items()) + ") v(name, made_of)")
def report_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules(spark)


# --- issues, renames and variants ----------------------------------------------------------------------


@CORE.add("issue_totals", """WITH l AS (SELECT doc_key, src_start % 3 AS part, coalesce(low_confidence, false) AS weak, score IS NULL AS bare FROM alignment_links),
s AS (SELECT doc_key, count_if(bare) AS flat, count_if(part = 0 AND weak) AS body, count_if(part = 1 AND weak) AS header, count_if(part = 2 AND weak) AS footer FROM l GROUP BY doc_key)
SELECT doc_key, CASE WHEN flat = 0 THEN body ELSE flat END AS body_issues, header AS header_issues, footer AS footer_issues, CASE WHEN flat = 0 THEN body ELSE flat END + header + footer AS total_issues FROM s""")
def issue_totals(spark: SparkSession, d: str) -> DataFrame:
    """Issues of body, header and footer; the flat count stands for the body's unless it is 0. Thirds of the rows stand in for the parts."""
    rows = table(spark, d, "alignment_links").select("doc_key", (F.col("src_start") % 3).alias("part"), F.coalesce("low_confidence", F.lit(False)).alias("weak"), F.col("score").isNull().alias("bare"))
    part = lambda i: F.count_if((F.col("part") == i) & F.col("weak"))
    s = rows.groupBy("doc_key").agg(F.count_if("bare").alias("flat"), part(0).alias("body"), part(1).alias("header"), part(2).alias("footer"))
    body = F.when(F.col("flat") == 0, F.col("body")).otherwise(F.col("flat"))
    return s.select("doc_key", body.alias("body_issues"), F.col("header").alias("header_issues"), F.col("footer").alias("footer_issues"), (body + F.col("header") + F.col("footer")).alias("total_issues"))


@CORE.add("top_issues", "SELECT doc_key, link_id, score FROM alignment_links WHERE score IS NOT NULL ORDER BY score, link_id LIMIT 10")
def top_issues(spark: SparkSession, d: str) -> DataFrame:
    """The ten weakest links, as a top-k."""
    return table(spark, d, "alignment_links").filter(F.col("score").isNotNull()).select("doc_key", "link_id", "score").orderBy("score", "link_id").limit(10)


_RENAME = _T + """, n AS (SELECT id, filename, length(coalesce(params_json, ''))::BIGINT AS size, CASE WHEN regexp_matches(filename, '^(.*?)_(final|v\\d+)(\\.[a-z]+)$') THEN regexp_replace(filename, '^(.*?)_(final|v\\d+)(\\.[a-z]+)$', '\\1\\3') END AS target FROM t WHERE filename IS NOT NULL),
s AS (SELECT *, CASE WHEN target IS NULL THEN 'unmatched' WHEN target = filename THEN 'unchanged' WHEN trim(regexp_replace(target, '\\.[a-z]+$', '')) = '' THEN 'invalid' ELSE 'ready' END AS st0 FROM n),
c AS (SELECT lower(target) AS k, count(*) > 1 AS many FROM s WHERE st0 = 'ready' GROUP BY 1), p AS (SELECT s.*, CASE WHEN st0 = 'ready' AND coalesce(many, false) THEN 'conflict' ELSE st0 END AS st FROM s LEFT JOIN c ON lower(target) = k)"""


def _rename_plan(spark: SparkSession, d: str) -> DataFrame:
    """Planned names with their state; several ready rows for one target are conflicts, all of them."""
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", "filename", F.length(F.coalesce("params_json", F.lit(""))).cast("bigint").alias("size"))
    rows = rows.withColumn("target", N.renamed(F.col("filename"), r"^(.*?)_(final|v\d+)(\.[a-z]+)$", r"\1\3"))
    state = F.when(F.col("target").isNull(), "unmatched").when(F.col("target") == F.col("filename"), "unchanged").when(F.trim(F.regexp_replace("target", r"\.[a-z]+$", "")) == "", "invalid").otherwise("ready")
    rows = rows.withColumn("state", state)
    many = rows.filter("state = 'ready'").groupBy(F.lower("target").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").select("k")
    return rows.join(many, F.lower("target") == F.col("k"), "left").withColumn("state", F.when((F.col("state") == "ready") & F.col("k").isNotNull(), "conflict").otherwise(F.col("state"))).drop("k")


@CORE.add("rename_plan", _RENAME + " SELECT id, target, st AS state FROM p")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return _rename_plan(spark, d).select("id", "target", "state")


@CORE.add("rename_summary", _RENAME + " SELECT count(*) AS selected, count_if(st = 'ready') AS processed, count_if(st IN ('unmatched', 'unchanged')) AS skipped, count_if(st = 'invalid') AS invalid, count_if(st = 'conflict') AS conflicts, coalesce(sum(CASE WHEN st = 'ready' THEN size END), 0)::BIGINT AS bytes FROM p")
def rename_summary(spark: SparkSession, d: str) -> DataFrame:
    st = F.col("state")
    return _rename_plan(spark, d).agg(F.count("*").alias("selected"), F.count_if(st == "ready").alias("processed"), F.count_if(st.isin("unmatched", "unchanged")).alias("skipped"), F.count_if(st == "invalid").alias("invalid"), F.count_if(st == "conflict").alias("conflicts"), F.coalesce(F.sum(F.when(st == "ready", F.col("size"))), F.lit(0)).alias("bytes"))


@CORE.add("variant_summary", """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents), h AS (SELECT lower(w) AS term, count(*) AS n FROM w WHERE lower(w) IN ('colour', 'metre', 'metres', 'centre', 'cheque', 'catalogue', 'the', 'copy', 'draft', 'invoice') GROUP BY 1)
SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS place FROM h""")
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a few terms, the most frequent first and equal ones by term; counts are combined before they are ranked."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    terms = ("colour", "metre", "metres", "centre", "cheque", "catalogue", "the", "copy", "draft", "invoice")
    hits = words.select(F.lower("w").alias("term")).filter(F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("n"))
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "term")))  # one row per term of the list


@CORE.add("variant_rules", "WITH p AS (SELECT lower(trim(term_en)) AS key, trim(term_en) AS spelling, trim(term_de) AS target, term_id FROM glossary WHERE term_en IS NOT NULL AND term_de IS NOT NULL) SELECT key, arg_min(spelling, term_id) AS spelling, count(*) AS listed, count(DISTINCT target) AS targets, CASE WHEN count(DISTINCT target) > 1 THEN 'ambiguous' ELSE 'rule' END AS kind FROM p GROUP BY key")
def variant_rules(spark: SparkSession, d: str) -> DataFrame:
    """Compiled dictionary: a key's first spelling, how often it is listed, its targets, and what it is by them."""
    rows = table(spark, d, "glossary").filter(F.col("term_en").isNotNull() & F.col("term_de").isNotNull()).select(F.lower(F.trim("term_en")).alias("key"), F.trim("term_en").alias("spelling"), F.trim("term_de").alias("target"), "term_id")
    targets = F.countDistinct("target")
    return rows.groupBy("key").agg(F.min_by("spelling", "term_id").alias("spelling"), F.count("*").alias("listed"), targets.alias("targets"), F.when(targets > 1, "ambiguous").otherwise("rule").alias("kind"))


@CORE.add("language_texts", "WITH b AS (SELECT DISTINCT block_id, task_id, coalesce(lang, 'none') AS lang, part_name, block_index, source_text FROM docx_blocks WHERE source_text IS NOT NULL) SELECT task_id, lang, count(*) AS fragments, string_agg(source_text, chr(10) ORDER BY part_name, block_index, block_id) AS text FROM b WHERE task_id IS NOT NULL GROUP BY task_id, lang")
def language_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a file per language, in order, as one text each, which a file of that language holds."""
    rows = table(spark, d, "docx_blocks").filter(F.col("source_text").isNotNull() & F.col("task_id").isNotNull()).select("block_id", "task_id", F.coalesce("lang", F.lit("none")).alias("lang"), "part_name", "block_index", "source_text").dropDuplicates(["block_id"])
    parts = F.array_sort(F.collect_list(F.struct("part_name", "block_index", "block_id", "source_text")))
    return rows.groupBy("task_id", "lang").agg(F.count("*").alias("fragments"), parts.alias("p")).select("task_id", "lang", "fragments", F.array_join(F.transform("p", lambda p: p["source_text"]), "\n").alias("text"))


@CORE.add("warning_counts", _T + " SELECT coalesce(error_message, 'none') AS warning, count(*) AS n FROM t GROUP BY 1")
def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).groupBy(F.coalesce("error_message", F.lit("none")).alias("warning")).agg(F.count("*").alias("n"))
