"""Queries of the text problems, with SQL where SQL can say the same."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bitext, field_match, mix, pack, pii, segment, split, tokens, turns
from quire.plans.registry import Registry
from quire.sources.tables import once, spread, table

LLM = Registry()

_BLANK = r"(?U)^\s*$"


# --- 1: field names -------------------------------------------------------------------------------------


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """Filled-in field names, each record once, with the entry they mean."""
    rows = spread(table(spark, d, "license_fields").select("field_id", "field_name").filter(F.col("field_name").isNotNull() & ~F.col("field_name").rlike(_BLANK)))
    return once(rows.withColumn("label_id", field_match.match_values(rows, "field_name", table(spark, d, "field_labels"))), "field_id")


@LLM.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "field_labels")
    exact = labels.select(F.explode(F.array("label_zh", "label_en")).alias("field_name")).filter(F.col("field_name").isNotNull()).distinct()
    return _mapped(spark, d).join(exact, "field_name", "left_anti").select("field_id", "label_id")


@LLM.add("p1_mapped")
def p1_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Rows per entry; 0 counts the unmatched."""
    return _mapped(spark, d).groupBy("label_id").agg(F.count("*").alias("fields"), F.countDistinct("field_name").alias("spellings"))


@LLM.add("p1_unmatched")
def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Names that mean no entry, with how often they occur."""
    return _mapped(spark, d).filter(F.col("label_id") == 0).groupBy("field_name").agg(F.count("*").alias("fields"))


# --- 4: sentences ---------------------------------------------------------------------------------------


@LLM.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(spread(table(spark, d, "docx_blocks").select("block_id", "source_text", "lang")), "block_id", "source_text", "lang").select("block_id", "span_start", "span_end")


@LLM.add("p4_units")
def p4_units(spark: SparkSession, d: str) -> DataFrame:
    return segment.units(table(spark, d, "docx_blocks"), "block_id", "source_text", "lang")


# --- 5: turns -------------------------------------------------------------------------------------------


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return turns.tag_words(table(spark, d, "asr_words"), table(spark, d, "speaker_roster"))


@LLM.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(_tagged(spark, d)).select("word_id", "turn_word_id", "speaker_no")


@LLM.add("p5_tags")
def p5_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).groupBy("tag").agg(F.count("*").alias("rows"))


@LLM.add("p5_turns")
def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.clean_turns(table(spark, d, "asr_words").select("word_id", "word_end"), turns.turns(_tagged(spark, d)))


# --- 6: pieces ------------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "text_items").select(F.lit("text_item").alias("item_kind"), "item_id", "source_type", "text")
    blocks = table(spark, d, "docx_blocks").select(F.lit("docx_block").alias("item_kind"), F.col("block_id").alias("item_id"), F.lit(None).cast("string").alias("source_type"), F.col("source_text").alias("text"))
    return spread(items.unionByName(blocks))


_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@LLM.add(
    "p6_found",
    rf"""WITH i AS (
  SELECT DISTINCT 'text_item' AS item_kind, item_id, lower(regexp_replace(source_type, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')) AS st, text FROM text_items
  UNION ALL SELECT DISTINCT 'docx_block', block_id, NULL, source_text FROM docx_blocks),
l AS (SELECT i.*, max_chars FROM i JOIN size_limits s ON i.item_kind = s.item_kind AND i.st IS NOT DISTINCT FROM lower(trim(s.source_type)) WHERE length(text) > max_chars)
SELECT item_kind, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[{_SPACES}.!?。！？;；,，、]'), lambda x: length(x))) > max_chars THEN 1 ELSE 0 END AS has_unbroken FROM l""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_items(_items(spark, d), table(spark, d, "size_limits")).select("item_kind", "item_id", "has_unbroken")


@LLM.add("p6_pieces")
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.piece_rows(split.split_items(_items(spark, d), table(spark, d, "size_limits")))


# --- 3: bilingual documents -----------------------------------------------------------------------------


def _links(spark: SparkSession, d: str) -> DataFrame:
    return bitext.align_documents(table(spark, d, "docx_sentences"), table(spark, d, "glossary"))


@LLM.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select(F.least("src_id", "tgt_id").alias("sent_id_a"), F.greatest("src_id", "tgt_id").alias("sent_id_b")).distinct()


@LLM.add("p3_links")
def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Links with their score and whether they are weak."""
    return _links(spark, d).withColumn("low_confidence", F.col("score") < 0.55)


# --- 7: containers --------------------------------------------------------------------------------------


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))


@LLM.add("p7_contents")
def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(_sizes(spark, d), table(spark, d, "pack_targets"))


@LLM.add("p7_containers")
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "pack_targets")
    return pack.containers(pack.pack(_sizes(spark, d), targets), targets)


@LLM.add("p7_summary")
def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers per target beside the least number that the total size allows."""
    full = F.sum("used") / F.sum("capacity_tokens")
    least = F.ceil(F.sum("used") / F.first("capacity_tokens"))
    return p7_containers(spark, d).groupBy("target_name").agg(F.count("*").alias("containers"), least.alias("least_possible"), F.sum("unused").alias("unused"), F.round(full, 6).alias("filled"))


# --- 8: mixtures ----------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.sha2("text", 256).alias("text_key"), tokens.token_count(F.col("text")).alias("tokens"))
    return mix.mix(rows, table(spark, d, "mix_targets"))


@LLM.add("p8_drawn")
def p8_drawn(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


@LLM.add("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(*_mixed(spark, d))


# --- 9: personal information ----------------------------------------------------------------------------

#: Setting that holds the secret of the pseudonyms. Without it a session draws its own, so pseudonyms link within it only.
PII_KEY = "spark.quire.pii.key"


def _pii(spark: SparkSession, d: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(PII_KEY, key)
    return pii.find_pii(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "speaker_roster"), key)


@LLM.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Finds of the run that makes the pseudonyms."""
    return _pii(spark, d).select("doc_id", F.explode("finds").alias("f")).select("doc_id", F.col("f.kind").alias("pii_kind"), F.col("f.start").alias("span_start"), F.col("f.end").alias("span_end"))


@LLM.add("p9_redacted")
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d).select("doc_id", F.col("clean").alias("text"))


@LLM.add("p9_linked")
def p9_linked(spark: SparkSession, d: str) -> DataFrame:
    """Pseudonyms that stand in several documents, with their documents and places; counts are combined before the shuffle."""
    finds = _pii(spark, d).select("doc_id", F.explode("finds").alias("f"))
    per_doc = finds.groupBy(F.col("f.kind").alias("pii_kind"), F.col("f.pseudonym").alias("pseudonym"), "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("pii_kind", "pseudonym").agg(F.count("*").alias("documents"), F.sum("n").alias("places")).filter("documents > 1")
