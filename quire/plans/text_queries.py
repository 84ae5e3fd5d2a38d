"""Measures of documents and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import measure as M
from quire.plans.registry import CORE
from quire.sources.tables import spread, table

_D = "SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL"
_A, _B = "", ""  # private-use marks: a CJK character (twice), a token


def _quoted(cls: str) -> str:
    return cls.replace("'", "''")


def _marked(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '[{M.CJK}]', '{_A}{_A}', 'g'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}{_quoted(M.INNER)}]*', '{_B}', 'g')"


def _tokens_sql(t: str) -> str:
    """Tokens with CJK characters out of the way."""
    return f"regexp_extract_all(regexp_replace({t}, '[{M.CJK}]', ' ', 'g'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}{_quoted(M.INNER)}]*')"


def _n(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def _words_sql(t: str) -> str:
    m = _marked(t)
    context = f"coalesce(list_sum(list_transform(regexp_extract_all({m}, '{_A}?[{M.CONTEXT_PUNCT}]+{_A}?'), lambda r: CASE WHEN length(replace(r, '{_A}', '')) = 1 THEN CASE WHEN contains(r, '{_A}') THEN 1 ELSE 0 END ELSE length(r) - length(replace(r, '{_A}', '')) END)), 0)"
    blocks = f"coalesce(list_sum(list_transform(regexp_extract_all({m}, '[{M.PUNCT_BLOCKS}]'), lambda c: CASE WHEN regexp_matches(c, '[\\p{{P}}\\p{{S}}]') THEN 1 ELSE 0 END)), 0)"
    return f"({_n(m, _A)} / 2 + {_n(m, _B)} + {blocks} + {context})::BIGINT"


_RE2_SCRIPT = {"latin": r"[\p{Latin}]", "cyrillic": r"\p{Cyrillic}", "arabic": r"[\p{Arabic}\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}]", "greek": r"\p{Greek}", "hebrew": r"\p{Hebrew}", "thai": r"[\x{E01}-\x{E7F}]"}


def _kind_sql(w: str) -> str:
    cases = "".join(
        f" WHEN regexp_full_match({w}, '(?:{c}|[^\\p{{L}}])+') THEN {'CASE WHEN regexp_matches(' + w + ', ' + chr(39) + chr(92) + 'p{N}' + chr(39) + ') THEN ' + chr(39) + 'mixed' + chr(39) + ' ELSE ' + chr(39) + 'latin' + chr(39) + ' END' if s == 'latin' else chr(39) + s + chr(39)}"
        for s, c in _RE2_SCRIPT.items()
    )
    return f"CASE WHEN NOT regexp_matches({w}, '\\p{{L}}') THEN 'number'{cases} ELSE 'other' END"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source").filter(F.col("text").isNotNull()))


def _t() -> Column:
    return F.col("text")


@CORE.add("word_count", f"SELECT doc_id, {_words_sql('text')} AS words FROM documents WHERE text IS NOT NULL")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.word_count(_t()).alias("words"))


@CORE.add("script_counts", f"SELECT doc_id, {_n('text', '[' + M.HAN + ']')}::BIGINT AS han, {_n('text', '[' + M.KANA + ']')}::BIGINT AS kana, {_n('text', '[' + M.HANGUL + ']')}::BIGINT AS hangul FROM documents WHERE text IS NOT NULL")
def script_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.han_count(_t()).alias("han"), M.kana_count(_t()).alias("kana"), M.hangul_count(_t()).alias("hangul"))


_KINDS = ("latin", "mixed", "number", "cyrillic", "arabic", "greek", "hebrew", "thai", "other")


@CORE.add(
    "token_buckets",
    f"WITH k AS (SELECT doc_id, list_transform({_tokens_sql('text')}, lambda w: {_kind_sql('w')}) AS kinds FROM documents WHERE text IS NOT NULL) SELECT doc_id, "
    + ", ".join(f"len(list_filter(kinds, lambda k: k = '{k}'))::BIGINT AS {k}" for k in _KINDS)
    + " FROM k",
)
def token_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", M.token_kinds(_t()).alias("kinds"))
    return rows.select("doc_id", *(M.of_kind(F.col("kinds"), k).alias(k) for k in _KINDS))


@CORE.add(
    "script_totals",
    f"""WITH m AS (SELECT lang, {_words_sql('text')} AS words, {_n('text', '[' + M.HAN + ']')} AS han, {_n('text', '[' + M.KANA + ']')} AS kana, {_n('text', '[' + M.HANGUL + ']')} AS hangul, len({_tokens_sql('text')}) AS tokens FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS docs, sum(words)::BIGINT AS words, sum(han + words - han - kana - hangul - tokens)::BIGINT AS zh_units, sum(words - hangul - tokens)::BIGINT AS ja_units, sum(words - han - kana - tokens)::BIGINT AS ko_units, sum(tokens)::BIGINT AS tokens FROM m GROUP BY lang""",
)
def script_totals(spark: SparkSession, d: str) -> DataFrame:
    """Combined measures of each script with its punctuation, per declared language."""
    han, kana, hangul = M.han_count(_t()), M.kana_count(_t()), M.hangul_count(_t())
    rows = _docs(spark, d).select("lang", M.word_count(_t()).alias("words"), han.alias("han"), kana.alias("kana"), hangul.alias("hangul"), F.size(M.tokens(_t())).alias("tokens"))
    punct = F.col("words") - F.col("han") - F.col("kana") - F.col("hangul") - F.col("tokens")
    return rows.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum(F.col("han") + punct).alias("zh_units"), F.sum(F.col("han") + F.col("kana") + punct).alias("ja_units"), F.sum(F.col("hangul") + punct).alias("ko_units"), F.sum("tokens").alias("tokens")
    )


@CORE.add("char_counts", f"SELECT doc_id, length(text)::BIGINT AS chars, length(regexp_replace(text, '[{M.SPACE}]', '', 'g'))::BIGINT AS chars_no_space, length(regexp_replace(text, '[{M.SPACE}\\p{{Cf}}]', '', 'g'))::BIGINT AS meaningful FROM documents WHERE text IS NOT NULL")
def char_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.chars(_t()).alias("chars"), M.chars_no_space(_t()).alias("chars_no_space"), M.meaningful_chars(_t()).alias("meaningful"))


def _strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^[{M.SPACE}]+|[{M.SPACE}]+$', '', 'g')"


def _lines_sql(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[^{M.SPACE}]')))"


@CORE.add("line_count", f"SELECT doc_id, {_lines_sql('text')}::BIGINT AS lines FROM documents WHERE text IS NOT NULL")
def line_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.line_count(_t()).alias("lines"))


@CORE.add(
    "paragraph_count",
    f"""WITH s AS (SELECT doc_id, {_strip_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, t, len(list_filter(regexp_split_to_array(t, '(?:\\r?\\n[{M.SPACE}]*){{2,}}'), lambda x: regexp_matches(x, '[^{M.SPACE}]'))) AS n FROM s)
SELECT doc_id, (CASE WHEN length(t) = 0 THEN 0 WHEN n > 1 THEN n ELSE {_lines_sql('t')} END)::BIGINT AS paragraphs FROM b""",
)
def paragraph_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.paragraph_count(_t()).alias("paragraphs"))


@CORE.add("preview", f"SELECT doc_id, left({_strip_sql(f'''regexp_replace(text, '[{M.SPACE}]+', ' ', 'g')''')}, 40) AS preview FROM documents WHERE text IS NOT NULL")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.preview(_t(), 40).alias("preview"))


@CORE.add("timeline_units", f"SELECT word_id, (length(regexp_replace(word, '[{M.SPACE}]', '', 'g')) + {_n(f'''regexp_replace(word, '[{M.SPACE}]', '', 'g')''', '[' + M.CJK + ']')})::BIGINT AS units FROM asr_words WHERE word IS NOT NULL GROUP BY ALL")
def timeline_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asr_words").select("word_id", "word").filter(F.col("word").isNotNull()).distinct().select("word_id", M.timeline_units(F.col("word")).alias("units"))


def _segment_sql(which: str) -> str:
    kinds = f"list_transform({_tokens_sql('s')}, lambda w: {_kind_sql('w')})"
    cjk = _n("s", "[" + M.CJK + "]")
    if which == "cjk":
        pick = f"{cjk} > 0 AND {cjk} >= len(list_filter({kinds}, lambda k: k <> 'number'))"
    else:
        pick = f"len(list_filter({kinds}, lambda k: k IN ('latin', 'mixed'))) > {cjk} + len(list_filter({kinds}, lambda k: k NOT IN ('latin', 'mixed', 'number')))"
    return f"""WITH g AS (SELECT doc_id, regexp_split_to_array(text, '[\\t\\r\\n]+') AS segs, list_transform(regexp_extract_all(text, '[\\t\\r\\n]+'), lambda x: length(x)) AS seps FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, list_transform(segs, lambda s: {pick}) AS sel FROM g)
SELECT doc_id, coalesce(list_sum(list_transform(segs, lambda s, i: CASE WHEN sel[i] THEN length(regexp_replace(s, '[{M.SPACE}]', '', 'g')) ELSE 0 END)), 0)::BIGINT AS no_spaces,
(coalesce(list_sum(list_transform(segs, lambda s, i: CASE WHEN sel[i] THEN length(s) ELSE 0 END)), 0) + coalesce(list_sum(list_transform(seps, lambda n, i: CASE WHEN sel[i] AND sel[i + 1] THEN n ELSE 0 END)), 0))::BIGINT AS with_spaces FROM p"""


@CORE.add("cjk_segment_chars", _segment_sql("cjk"))
def cjk_segment_chars(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.dominant_chars(_t(), "cjk").alias("c")).select("doc_id", "c.no_spaces", "c.with_spaces")


@CORE.add("latin_segment_chars", _segment_sql("latin"))
def latin_segment_chars(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", M.dominant_chars(_t(), "latin").alias("c")).select("doc_id", "c.no_spaces", "c.with_spaces")


def _units_sql(lang: str) -> str:
    unit = M.LANGUAGE_UNITS[lang]
    return _n("text", unit) if unit.startswith("[") else f"len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{Mn}}_]+'), lambda w: regexp_full_match(w, '[{unit}]+')))"


@CORE.add("lang_count", "SELECT doc_id, " + ", ".join(f"{_units_sql(x)}::BIGINT AS {x}_units" for x in ("zh", "ja", "en", "de", "fr")) + " FROM documents WHERE text IS NOT NULL")
def lang_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", *(M.language_units(_t(), x).alias(f"{x}_units") for x in ("zh", "ja", "en", "de", "fr")))


@CORE.add(
    "corpus_summary",
    f"""WITH m AS (SELECT coalesce(lang, '') AS lang, {_words_sql('text')} AS words, length(text) AS chars, {_lines_sql('text')} AS lines FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS docs, sum(words)::BIGINT AS words, sum(chars)::BIGINT AS chars, sum(lines)::BIGINT AS lines FROM m GROUP BY lang""",
)
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.coalesce("lang", F.lit("")).alias("lang"), M.word_count(_t()).alias("words"), M.chars(_t()).alias("chars"), M.line_count(_t()).alias("lines"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines"))


_MEASURED = f"""WITH t AS (SELECT item_id, any_value(file_id) AS file_id, any_value(lower({_strip_sql('source_type')})) AS source_type, bool_or(is_extra) AS is_extra, any_value(text) AS text FROM text_items GROUP BY item_id)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_items").select("item_id", "file_id", F.lower(M.strip(F.col("source_type"))).alias("source_type"), "is_extra", "text").dropDuplicates(["item_id"])


@CORE.add(
    "main_extra_totals",
    _MEASURED
    + f""" SELECT file_id, count_if(NOT coalesce(is_extra, false)) AS main_items, count_if(coalesce(is_extra, false)) AS extra_items,
coalesce(sum(CASE WHEN NOT coalesce(is_extra, false) THEN {_words_sql("coalesce(text, '')")} END), 0)::BIGINT AS main_words, coalesce(sum(CASE WHEN coalesce(is_extra, false) THEN {_words_sql("coalesce(text, '')")} END), 0)::BIGINT AS extra_words FROM t GROUP BY file_id""",
)
def main_extra_totals(spark: SparkSession, d: str) -> DataFrame:
    extra = F.coalesce("is_extra", F.lit(False))
    words = M.word_count(F.coalesce("text", F.lit("")))
    rows = _items(spark, d).select("file_id", extra.alias("extra"), words.alias("words"))
    return rows.groupBy("file_id").agg(
        F.count_if(~F.col("extra")).alias("main_items"), F.count_if("extra").alias("extra_items"), F.coalesce(F.sum(F.when(~F.col("extra"), F.col("words"))), F.lit(0)).alias("main_words"), F.coalesce(F.sum(F.when(F.col("extra"), F.col("words"))), F.lit(0)).alias("extra_words")
    )


@CORE.add("source_counts", _MEASURED + " SELECT file_id, source_type, count(*) AS items FROM t GROUP BY ALL")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy("file_id", "source_type").agg(F.count("*").alias("items"))


@CORE.add(
    "normalize_text",
    f"""SELECT block_id, {_strip_sql(f'''regexp_replace(regexp_replace(regexp_replace(source_text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', ' ', 'g'), '[{M.SPACE}]+', ' ', 'g'), '[{M.SPACE}]+([。！？!?.,，、；;：:）)\\]}}])', '\\1', 'g')''')} AS text FROM (SELECT DISTINCT block_id, source_text FROM docx_blocks WHERE source_text IS NOT NULL)""",
)
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docx_blocks").select("block_id", "source_text").filter(F.col("source_text").isNotNull()).dropDuplicates(["block_id"])
    return rows.select("block_id", M.normalize_text(F.col("source_text")).alias("text"))


@CORE.add("split_parts", "SELECT doc_id, CASE WHEN length(text) <= 25000 THEN 1 WHEN length(text) <= 50000 THEN 2 WHEN length(text) <= 75000 THEN 3 WHEN length(text) <= 100000 THEN 4 WHEN length(text) <= 125000 THEN 5 WHEN length(text) <= 150000 THEN 6 WHEN length(text) <= 175000 THEN 7 ELSE 8 END AS parts FROM documents WHERE text IS NOT NULL")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts by seven thresholds 25,000 apart."""
    parts = F.coalesce(*(F.when(F.length("text") <= 25_000 * i, i) for i in range(1, 8)), F.lit(8))
    return _docs(spark, d).select("doc_id", parts.alias("parts"))


@CORE.add("keep_first_text", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def keep_first_text(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every text. A minimum per digest: texts aren't shuffled and copies are pre-aggregated."""
    return _docs(spark, d).groupBy(F.sha2("text", 256).alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@CORE.add("flag_duplicates", "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents WHERE text IS NOT NULL")
def flag_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text occurs again. Counts per digest are joined back; only digests move."""
    rows = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("again"))
    return rows.join(often, "h", "left").select("doc_id", F.coalesce("again", F.lit(False)).alias("repeated"))


@CORE.add("discover_totals", "SELECT count(*) AS docs, count_if(text IS NOT NULL AND length(text) > 0) AS selectable, sum(n_chars)::BIGINT AS chars, count(*) > 5000 AS truncated FROM documents")
def discover_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.agg(F.count("*").alias("docs"), F.count_if(F.length("text") > 0).alias("selectable"), F.sum("n_chars").alias("chars"), (F.count("*") > 5000).alias("truncated"))


@CORE.add("split_points", """WITH s AS (SELECT DISTINCT doc_key, side, idx, coalesce(length(source_text), 0) AS n FROM docx_sentences), c AS (SELECT doc_key, side, idx, sum(n) OVER (PARTITION BY doc_key, side ORDER BY idx) AS cum, sum(n) OVER (PARTITION BY doc_key, side) AS total FROM s),
t AS (SELECT *, unnest([1, 2]) AS part FROM c), d AS (SELECT *, abs(cum - part * (total // 3)) AS diff FROM t)
SELECT doc_key, side, part, arg_min(idx, diff * 1000000 + idx)::INT AS split_idx FROM d GROUP BY doc_key, side, part""")
def split_points(spark: SparkSession, d: str) -> DataFrame:
    """Where a document side would be cut in three nearly equal parts: the row nearest to each third of its length.

    Running lengths come from sums per block of 256 rows plus a window inside the block, so that a long
    document is no single task.
    """
    rows = table(spark, d, "docx_sentences").select("doc_key", "side", "idx", F.coalesce(F.length("source_text"), F.lit(0)).cast("bigint").alias("n")).distinct().withColumn("block", F.floor(F.col("idx") / 256))
    sums = rows.groupBy("doc_key", "side", "block").agg(F.sum("n").alias("s"))
    side = Window.partitionBy("doc_key", "side")
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(side.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("s").over(side)).drop("s")
    inside = Window.partitionBy("doc_key", "side", "block").orderBy("idx")
    cum = rows.join(sums, ["doc_key", "side", "block"]).withColumn("cum", F.col("before") + F.sum("n").over(inside))
    each = cum.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    diff = F.abs(F.col("cum") - F.col("part") * F.floor(F.col("total") / 3))
    return each.groupBy("doc_key", "side", "part").agg(F.min_by("idx", F.struct(diff, "idx")).alias("split_idx"))


_PAIRS = "WITH s AS (SELECT doc_key, idx, source_text AS src FROM docx_sentences WHERE side = 'src' GROUP BY ALL), t AS (SELECT doc_key, idx, source_text AS tgt FROM docx_sentences WHERE side = 'tgt' GROUP BY ALL), p AS (SELECT doc_key, idx, src, tgt FROM s JOIN t USING (doc_key, idx) WHERE length(src) > 0 AND length(tgt) > 0)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docx_sentences").select("doc_key", "side", "idx", "source_text")
    src = rows.filter("side = 'src'").select("doc_key", "idx", F.col("source_text").alias("src")).distinct()
    tgt = rows.filter("side = 'tgt'").select("doc_key", "idx", F.col("source_text").alias("tgt")).distinct()
    return src.join(tgt, ["doc_key", "idx"]).filter((F.length("src") > 0) & (F.length("tgt") > 0))


@CORE.add("length_anomaly", _PAIRS + " SELECT doc_key, idx, greatest(length(src), length(tgt))::BIGINT AS longer, least(length(src), length(tgt))::BIGINT AS shorter FROM p WHERE greatest(length(src), length(tgt)) > 5 * least(length(src), length(tgt))")
def length_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at one position whose lengths differ more than five times."""
    a, b = F.length("src").cast("bigint"), F.length("tgt").cast("bigint")
    return _pairs(spark, d).select("doc_key", "idx", F.greatest(a, b).alias("longer"), F.least(a, b).alias("shorter")).filter("longer > 5 * shorter")


def _share_sql(col: str, lang: str) -> str:
    return f"(({_units_sql(lang).replace('text', col)})::DOUBLE / length({col}))"


@CORE.add(
    "lang_mismatch",
    _PAIRS + f" SELECT doc_key, idx FROM p WHERE ({_share_sql('src', 'zh')} < 0.2 AND {_share_sql('tgt', 'zh')} > 0.4) OR ({_share_sql('src', 'en')} > 0.4 AND {_share_sql('tgt', 'en')} < 0.2)",
)
def lang_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose sides seem exchanged, taken as Chinese to English."""
    share = lambda c, lang: M.language_units(F.col(c), lang).cast("double") / F.length(c)
    return _pairs(spark, d).filter(((share("src", "zh") < 0.2) & (share("tgt", "zh") > 0.4)) | ((share("src", "en") > 0.4) & (share("tgt", "en") < 0.2))).select("doc_key", "idx")


_ENDERS = "[。！？!?]"


@CORE.add("needs_cell_split", f"SELECT block_id, (len(regexp_extract_all(source_text, '{_ENDERS}')) > 1 OR contains(source_text, chr(10)) OR contains(source_text, '  ') OR regexp_matches(source_text, '(^|\\n)\\s*(\\d+[.)、]|[(（]\\d+[)）]|[-•])')) AS split FROM (SELECT DISTINCT block_id, source_text FROM docx_blocks WHERE source_text IS NOT NULL)")
def needs_cell_split(spark: SparkSession, d: str) -> DataFrame:
    """Whether a block holds more than one sentence or item."""
    text = F.col("source_text")
    rows = table(spark, d, "docx_blocks").select("block_id", "source_text").filter(text.isNotNull()).dropDuplicates(["block_id"])
    return rows.select("block_id", ((F.regexp_count(text, F.lit(_ENDERS)) > 1) | text.contains("\n") | text.contains("  ") | text.rlike(r"(^|\n)\s*(\d+[.)、]|[(（]\d+[)）]|[-•])")).alias("split"))


@CORE.add("symbol_preserved", _PAIRS + " SELECT doc_key, idx, regexp_extract_all(src, '[□☐☑☒✓✔✗✘•○●◦▪▫■◆◇→←↑↓]') = regexp_extract_all(tgt, '[□☐☑☒✓✔✗✘•○●◦▪▫■◆◇→←↑↓]') AND len(regexp_extract_all(src, chr(10))) = len(regexp_extract_all(tgt, chr(10))) AS preserved FROM p")
def symbol_preserved(spark: SparkSession, d: str) -> DataFrame:
    """Whether special symbols, in order, and the number of line ends are the same on both sides."""
    marks = F.lit("([□☐☑☒✓✔✗✘•○●◦▪▫■◆◇→←↑↓])")
    same = F.regexp_extract_all("src", marks, 1) == F.regexp_extract_all("tgt", marks, 1)
    return _pairs(spark, d).select("doc_key", "idx", (same & (F.regexp_count("src", F.lit("\n")) == F.regexp_count("tgt", F.lit("\n")))).alias("preserved"))
