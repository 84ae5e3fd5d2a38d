"""Queries over names, pages, extensions, images, log lines and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions.rewriting import request_digest as request_digest_of
from quire.operators import relational as R
from quire.plans.registry import CORE
from quire.plans.relational_queries import _T, _tasks
from quire.sources.tables import table

# --- extensions ------------------------------------------------------------------------------------------

#: Extensions that are read.
KNOWN = tuple(sorted(x for v in N.CATEGORIES.values() for x in v))


@CORE.add("norm_ext", _T + f""", e AS (SELECT id, [' ' || upper(regexp_extract(filename, '\\.([A-Za-z0-9]{{1,8}})$', 1)) || ' ', 'PDF', '.zzz', CASE WHEN id % 3 = 0 THEN '.docx' ELSE '' END] AS asked FROM t WHERE filename IS NOT NULL),
n AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(list_filter(list_transform(asked, lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '.') THEN x ELSE '.' || x END), lambda x: x IN ({', '.join(repr(x) for x in KNOWN)})))) AS l FROM e)
SELECT id, array_to_string(CASE WHEN id % 5 = 0 THEN [{', '.join(repr(x) for x in KNOWN)}] ELSE l END, ' ') AS extensions FROM n""")
def norm_ext(spark: SparkSession, d: str) -> DataFrame:
    """Wanted extensions in one spelling, known ones only; nothing wanted means all."""
    end = F.regexp_extract("filename", r"\.([A-Za-z0-9]{1,8})$", 1)
    asked = F.array(F.concat(F.lit(" "), F.upper(end), F.lit(" ")), F.lit("PDF"), F.lit(".zzz"), F.when(F.col("id") % 3 == 0, ".docx").otherwise(""))
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(asked).alias("asked"))
    return rows.select("id", F.array_join(N.wanted_extensions(F.col("asked"), KNOWN), " ").alias("extensions"))


# --- pages -----------------------------------------------------------------------------------------------

_PAGES = "WITH s AS (SELECT doc_key, max(src_end) AS n FROM alignment_links GROUP BY doc_key)"


@CORE.add("page_ops", _PAGES + """, o AS (SELECT doc_key, n, unnest(['odd', 'even', 'extract', 'delete']) AS op FROM s), p AS (SELECT doc_key, n, op, unnest(range(0, n)) AS page FROM o)
SELECT doc_key, op, page::INT AS page FROM p WHERE CASE op WHEN 'odd' THEN page % 2 = 0 WHEN 'even' THEN page % 2 = 1 WHEN 'extract' THEN page < 2 ELSE page >= 2 END""")
def page_ops(spark: SparkSession, d: str) -> DataFrame:
    """Pages, from 0, that stay when odd or even ones are taken, the first two are extracted, or deleted."""
    rows = table(spark, d, "alignment_links").groupBy("doc_key").agg(F.max("src_end").alias("n"))
    spec = F.when(F.col("n") > 1, "2,1-2").otherwise("1")
    ops = F.array(*(F.struct(F.lit(op).alias("op"), N.page_choice(op, spec, F.col("n")).alias("pages")) for op in ("odd", "even", "extract", "delete")))
    return rows.select("doc_key", F.explode(ops).alias("o")).select("doc_key", "o.op", F.explode("o.pages").alias("page"))


_SPECS = ("", "all", "1", "3-1", "1-2，1", "x", "0", "1-99999", "2、1", "1—2")


@CORE.add("page_problem", _PAGES + f""", x AS (SELECT doc_key, n, unnest([{', '.join(repr(x) for x in _SPECS)}]) AS spec FROM s),
k AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(trim(spec)), '[，、]', ',', 'g'), '[—–]', '-', 'g'), '[,\\s]+'), lambda p: p <> '') AS parts FROM x),
b AS (SELECT *, list_transform(parts, lambda p: CASE WHEN NOT regexp_full_match(p, '[0-9]+(-[0-9]+)?') THEN 1 WHEN regexp_extract(p, '^([0-9]+)', 1)::BIGINT < 1 OR coalesce(try_cast(regexp_extract(p, '-([0-9]+)$', 1) AS BIGINT), regexp_extract(p, '^([0-9]+)', 1)::BIGINT) < regexp_extract(p, '^([0-9]+)', 1)::BIGINT OR coalesce(try_cast(regexp_extract(p, '-([0-9]+)$', 1) AS BIGINT), regexp_extract(p, '^([0-9]+)', 1)::BIGINT) > n THEN 2 ELSE 0 END) AS bad FROM k)
SELECT doc_key, spec, CASE WHEN n <= 0 THEN 'no pages' WHEN lower(trim(spec)) IN ('', 'all') THEN NULL WHEN list_contains(bad, 1) AND (NOT list_contains(bad, 2) OR list_position(bad, 1) < list_position(bad, 2)) THEN 'unreadable' WHEN list_contains(bad, 2) THEN 'out of bounds' WHEN len(parts) = 0 THEN 'nothing selected' END AS problem FROM b""")
def page_problem(spark: SparkSession, d: str) -> DataFrame:
    """Why a page specification is refused: the reason of its first bad part, or null."""
    rows = table(spark, d, "alignment_links").groupBy("doc_key").agg(F.max("src_end").alias("n"))
    specs = rows.select("doc_key", "n", F.explode(F.array(*(F.lit(s) for s in _SPECS))).alias("spec"))
    return specs.select("doc_key", "spec", N.page_problem(F.col("spec"), F.col("n")).alias("problem"))


@CORE.add("compress_saving", "SELECT o_orderkey, round_even(greatest(s - o, 0) / s::DOUBLE * 100, 2) AS saved FROM (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS s, (o_totalprice * (50 + o_orderkey % 70))::BIGINT AS o FROM orders) WHERE s > 0")
def compress_saving(spark: SparkSession, d: str) -> DataFrame:
    """Saved share of a size in per cent; sizes that grow save nothing."""
    rows = table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") * 100, 0).cast("bigint").alias("s"), F.bround(F.col("o_totalprice") * (50 + F.col("o_orderkey") % 70), 0).cast("bigint").alias("o"))
    return rows.filter("s > 0").select("o_orderkey", N.saved_share(F.col("s"), F.col("o")).alias("saved"))


# --- images and logs -------------------------------------------------------------------------------------

_HEADS = ("89504E470D0A1A0A00", "FFD8FFE0", "474946383761", "47494638396101", "424D00", "49492A00", "4D4D002A", "00000100", "524946460000000057454250", "5249464600000000574156", "3C7376673E", "")


@CORE.add("image_kind", f"""WITH h AS (SELECT item_id, [{', '.join(repr(x) for x in _HEADS)}][item_id % {len(_HEADS)} + 1] AS h FROM (SELECT DISTINCT item_id FROM text_items))
SELECT item_id, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN '.png' WHEN starts_with(h, 'FFD8FF') THEN '.jpg' WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN '.gif' WHEN starts_with(h, '424D') THEN '.bmp' WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN '.tiff' WHEN starts_with(h, '00000100') THEN '.ico' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN '.webp' END AS kind FROM h""")
def image_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of images by their first bytes."""
    head = F.unhex(F.element_at(F.array(*(F.lit(h) for h in _HEADS)), (F.col("item_id") % len(_HEADS) + 1).cast("int")))
    return table(spark, d, "text_items").select("item_id").distinct().select("item_id", N.image_kind(head).alias("kind"))


@CORE.add("redact_log", r"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[config] key=' || user_id WHEN 1 THEN 'route=' || event_type || ' Model=m' || user_id || ' ok' WHEN 2 THEN 'token: abc' || user_id || ', done' ELSE 'Bearer abcdefgh' || user_id || ' end' END AS line FROM events)
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\[config\]\s+.*', '[config] ***', 'g'), '(route=|model=)\S+', '\1***', 'gi'), '(bearer\s+)[A-Za-z0-9._-]{8,}', '\1***', 'gi'), '((?:api[_-]?key|token|password|secret)\s*[=:]\s*)[^\s,;&"'']+', '\1***', 'gi') AS line FROM e""")
def redact_log(spark: SparkSession, d: str) -> DataFrame:
    """Log lines without settings, routes, models and secrets."""
    user = F.col("user_id").cast("string")
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("[config] key="), user)).when(k == 1, F.concat(F.lit("route="), "event_type", F.lit(" Model=m"), user, F.lit(" ok"))).when(k == 2, F.concat(F.lit("token: abc"), user, F.lit(", done"))).otherwise(F.concat(F.lit("Bearer abcdefgh"), user, F.lit(" end")))
    return table(spark, d, "events").select("event_id", N.redacted(line).alias("line"))


# --- names -----------------------------------------------------------------------------------------------


@CORE.add("ascii_stem")
def ascii_stem(spark: SparkSession, d: str) -> DataFrame:
    """Stems in ASCII letters and digits, for storage."""
    return _tasks(spark, d).select("id", N.ascii_stem(F.col("filename")).alias("stem"))


@CORE.add("visible_stem")
def visible_stem(spark: SparkSession, d: str) -> DataFrame:
    """Stems as shown to people, without what file systems refuse."""
    return _tasks(spark, d).select("id", N.visible_stem(F.col("filename")).alias("stem"))


@CORE.add("numbered_names", _T + ", n AS (SELECT id, filename, row_number() OVER (ORDER BY lower(filename), id) AS n, count(*) OVER () AS total FROM t WHERE filename IS NOT NULL) SELECT id, lpad(n::VARCHAR, length(total::VARCHAR)::INTEGER, '0') || '_' || filename AS name FROM n")
def numbered_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with their number in front, padded to the width of the last one."""
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", "filename", F.lower("filename").alias("name"))
    width = len(str(rows.count()))
    return R.numbered(rows, "name", "id").select("id", F.concat(F.lpad(F.col("n").cast("string"), width, "0"), F.lit("_"), "filename").alias("name"))


@CORE.add("archive_names")
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in the archive of a batch: without the job's own prefix, each free of all others, also of made ones."""
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull())
    lean = N.without_prefix(F.col("filename"), F.col("display_no"), F.col("task_id"))
    return R.free_names(rows.select("id", F.coalesce("batch_id", "task_id").alias("batch"), lean.alias("name")), "batch", "name", "id").select("id", "name")


# --- projections of the job log --------------------------------------------------------------------------

_INPUT_KEYS = ("original_filename", "single_filename", "target_filename", "translated_filename", "source_filename", "alignment_filename", "file")


@CORE.add("primary_input_name", _T + ", j AS (SELECT id, filename, CASE WHEN json_valid(input_files_json) AND json_type(input_files_json) = 'OBJECT' THEN input_files_json END AS j FROM t) SELECT id, coalesce(" + ", ".join(f"nullif(regexp_extract(j->>'{k}', '([^/\\\\]*)$', 1), '')" for k in _INPUT_KEYS) + ", nullif(filename, '')) AS input FROM j")
def primary_input_name(spark: SparkSession, d: str) -> DataFrame:
    """The first named input of a job, without its folders, else its file name."""
    doc = F.try_parse_json("input_files_json")
    named = [F.nullif(F.regexp_extract(F.try_variant_get(doc, f"$.{k}", "string"), r"([^/\\]*)$", 1), F.lit("")) for k in _INPUT_KEYS]
    return _tasks(spark, d).select("id", F.coalesce(*named, F.nullif("filename", F.lit(""))).alias("input"))


@CORE.add("task_output", _T + """ SELECT id, task_id, coalesce(display_no, task_id) AS display_no, task_type, coalesce(task_label, task_type) AS task_label, st AS status, coalesce(progress, 0) AS progress, batch_id AS batch_key, coalesce(batch_index, 0) AS batch_index, coalesce(batch_total, 0) AS batch_total,
coalesce(feedback_marked, false) AS feedback_marked, CASE WHEN feedback_marked THEN coalesce(feedback_category, 'exception') END AS feedback_category, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM t""")
def task_output(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as they are given out: defaults filled, batch and feedback as nested records, times in ISO form; read back flat."""
    marked = F.coalesce("feedback_marked", F.lit(False))
    batch = F.struct(F.col("batch_id").alias("key"), F.coalesce("batch_index", F.lit(0)).alias("index"), F.coalesce("batch_total", F.lit(0)).alias("total"))
    feedback = F.struct(marked.alias("marked"), F.when(marked, F.coalesce("feedback_category", F.lit("exception"))).alias("category"))
    rows = _tasks(spark, d).select("id", "task_id", F.coalesce("display_no", "task_id").alias("display_no"), "task_type", F.coalesce("task_label", "task_type").alias("task_label"), R.status_name(F.col("status")).alias("status"), F.coalesce("progress", F.lit(0)).alias("progress"), batch.alias("batch"), feedback.alias("feedback"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))
    return rows.select("id", "task_id", "display_no", "task_type", "task_label", "status", "progress", F.col("batch.key").alias("batch_key"), F.col("batch.index").alias("batch_index"), F.col("batch.total").alias("batch_total"), F.col("feedback.marked").alias("feedback_marked"), F.col("feedback.category").alias("feedback_category"), "created")


@CORE.add("request_digest")
def request_digest(spark: SparkSession, d: str) -> DataFrame:
    """Requests by a digest that neither the order of keys nor outer blanks change."""
    return _tasks(spark, d).select("id", request_digest_of(F.col("task_type"), F.col("params_json"), F.col("input_files_json")).alias("digest"))


#: An own small table of names that mean one model.
ALIASES = {"fast": "vendor/fast-1", "vendor fast 1": "vendor/fast-1", "precise": "vendor/precise-2", "en": "lang/english", "zh": "lang/chinese", "de": "lang/german"}


@CORE.add("model_alias", _T + ", p AS (SELECT id, CASE WHEN json_valid(params_json) AND json_type(params_json) = 'OBJECT' THEN params_json END AS p, CASE WHEN json_valid(result_json) AND json_type(result_json) = 'OBJECT' THEN result_json END AS r FROM t), m AS (SELECT id, coalesce(" + ", ".join(f"nullif(trim({s}->>'{k}'), '')" for k in ("model", "mode", "target") for s in ("p", "r")) + ") AS raw FROM p) SELECT id, raw, CASE lower(raw) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE raw END AS code FROM m WHERE raw IS NOT NULL")
def model_alias(spark: SparkSession, d: str) -> DataFrame:
    """The first named model among fields of parameters and result, under its one name."""
    docs = [F.try_parse_json(c) for c in ("params_json", "result_json")]
    named = [F.nullif(F.trim(F.try_variant_get(doc, f"$.{k}", "string")), F.lit("")) for k in ("model", "mode", "target") for doc in docs]
    rows = _tasks(spark, d).select("id", F.coalesce(*named).alias("raw")).filter(F.col("raw").isNotNull())
    return rows.select("id", "raw", N.one_name(F.col("raw"), ALIASES).alias("code"))


# --- sheets, attachments ---------------------------------------------------------------------------------


@CORE.add("sheet_pairs", """WITH s AS (SELECT doc_key, side, part_name, min(sent_id) AS first FROM docx_sentences WHERE part_name IS NOT NULL AND side IN ('src', 'tgt') GROUP BY ALL),
o AS (SELECT *, CASE WHEN side = 'tgt' AND hash(doc_key) IS NOT NULL AND length(doc_key) % 2 = 0 THEN 'x-' || part_name ELSE part_name END AS name FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_key, side ORDER BY first) AS k FROM o),
c AS (SELECT a.doc_key, a.name AS src_sheet, b.name AS tgt_sheet FROM n a JOIN n b ON a.doc_key = b.doc_key AND a.name = b.name AND a.side = 'src' AND b.side = 'tgt'),
z AS (SELECT a.doc_key, a.name AS src_sheet, b.name AS tgt_sheet FROM n a JOIN n b ON a.doc_key = b.doc_key AND a.k = b.k AND a.side = 'src' AND b.side = 'tgt' WHERE a.doc_key NOT IN (SELECT doc_key FROM c))
SELECT doc_key, src_sheet, tgt_sheet, true AS by_name FROM c UNION ALL SELECT doc_key, src_sheet, tgt_sheet, false FROM z""")
def sheet_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of two workbooks by name, or one after the other where no name is on both sides."""
    rows = table(spark, d, "docx_sentences").filter(F.col("part_name").isNotNull() & F.col("side").isin("src", "tgt")).groupBy("doc_key", "side", "part_name").agg(F.min("sent_id").alias("first"))
    other = (F.col("side") == "tgt") & (F.length("doc_key") % 2 == 0)
    return R.paired_sheets(rows.select("doc_key", "side", F.when(other, F.concat(F.lit("x-"), "part_name")).otherwise(F.col("part_name")).alias("name"), "first"), "doc_key")


@CORE.add("attachment_links", """WITH a AS (SELECT DISTINCT task_id, item_id, 'Image%20' || (item_id % 7)::VARCHAR || '.PNG' AS name, '<part' || (item_id % 5)::VARCHAR || '@x>' AS cid FROM text_items WHERE task_id IS NOT NULL),
r AS (SELECT task_id, item_id AS ref_id, CASE item_id % 3 WHEN 0 THEN 'cid:PART' || (item_id % 5)::VARCHAR || '@x' WHEN 1 THEN './pics/image ' || (item_id % 7)::VARCHAR || '.png' ELSE 'none.gif' END AS ref FROM a),
ak AS (SELECT task_id, item_id, unnest([lower(name), lower(replace(name, '%20', ' ')), lower(trim(cid, '<>'))]) AS k FROM a),
rk AS (SELECT task_id, ref_id, unnest([lower(ref), lower(regexp_replace(ref, '^cid:', '', 'i')), lower(regexp_extract(ref, '([^/]*)$', 1)), lower(ltrim(ref, './'))]) AS k FROM r)
SELECT task_id, ref_id, min(item_id) AS item_id FROM rk JOIN ak USING (task_id, k) GROUP BY task_id, ref_id""")
def attachment_links(spark: SparkSession, d: str) -> DataFrame:
    """References of a message to its attachments by any usual form of their id, name or path; the first attachment wins."""
    rows = table(spark, d, "text_items").filter(F.col("task_id").isNotNull()).select("task_id", "item_id").distinct()
    seven, five = ((F.col("item_id") % n).cast("string") for n in (7, 5))
    parts = rows.select("task_id", "item_id", F.explode(F.array_union(N.reference_keys(F.concat(F.lit("Image%20"), seven, F.lit(".PNG"))), N.reference_keys(F.concat(F.lit("<part"), five, F.lit("@x>"))))).alias("k"))
    ref = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("cid:PART"), five, F.lit("@x"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("./pics/image "), seven, F.lit(".png"))).otherwise("none.gif")
    refs = rows.select("task_id", F.col("item_id").alias("ref_id"), F.explode(N.reference_keys(ref)).alias("k"))
    first = parts.groupBy("task_id", "k").agg(F.min("item_id").alias("item_id"))
    return refs.join(first, ["task_id", "k"]).groupBy("task_id", "ref_id").agg(F.min("item_id").alias("item_id"))
