"""Queries over the job log, listings, certificates' fields, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import relational as R
from quire.plans.registry import CORE
from quire.sources.tables import once, table

_T = "WITH t AS (SELECT *, lower(trim(status)) AS st FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM tasks) WHERE rn = 1)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").dropDuplicates(["id"])


@CORE.add("count_by_status", _T + " SELECT st AS status, count(*) AS n, count_if(feedback_marked) AS marked FROM t GROUP BY st")
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tasks").select("id", R.status_name(F.col("status")).alias("status"), "feedback_marked").dropDuplicates(["id"])
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if("feedback_marked").alias("marked"))


@CORE.add("count_by_type", _T + " SELECT task_type, count(*) AS n FROM t GROUP BY task_type")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("id", "task_type").dropDuplicates(["id"]).groupBy("task_type").agg(F.count("*").alias("n"))


@CORE.add("task_list", _T + " SELECT id, task_type, filename FROM t WHERE st IN ('completed', 'failed') AND filename ILIKE '%final%' AND NOT coalesce(feedback_marked, false)")
def task_list(spark: SparkSession, d: str) -> DataFrame:
    return R.filtered(_tasks(spark, d), statuses="completed, failed,,", filename="FINAL", marked=False).select("id", "task_type", "filename")


@CORE.add("task_page", _T + " SELECT id FROM t ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20")
def task_page(spark: SparkSession, d: str) -> DataFrame:
    """Page two of the job list, newest first."""
    return R.page(_tasks(spark, d).select("id", "created_at"), [F.desc_nulls_last("created_at"), F.desc("id")], 2, 20).select("id")


@CORE.add("dispatchable", _T + " SELECT id FROM t WHERE st = 'queued' AND cancel_requested IS NOT TRUE AND coalesce(trim(input_files_json), '') NOT IN ('', '{}')")
def dispatchable(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d).filter((R.status_name(F.col("status")) == "queued") & ~F.coalesce("cancel_requested", F.lit(False)))
    return rows.filter(~F.coalesce(F.trim("input_files_json"), F.lit("")).isin("", "{}")).select("id")


@CORE.add("fifo_head", _T + " SELECT id FROM t WHERE st = 'queued' ORDER BY created_at, id LIMIT 20")
def fifo_head(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).filter(R.status_name(F.col("status")) == "queued").orderBy(F.asc_nulls_last("created_at"), "id").limit(20).select("id")


@CORE.add("active_dup", _T + " SELECT request_fingerprint, arg_min(id, (created_at, id)) AS id, count(*) AS n FROM t WHERE st IN ('queued', 'running') AND cancel_requested IS NOT TRUE AND request_fingerprint IS NOT NULL GROUP BY 1")
def active_dup(spark: SparkSession, d: str) -> DataFrame:
    """The first active job per fingerprint."""
    rows = _tasks(spark, d).filter(R.status_name(F.col("status")).isin("queued", "running") & ~F.coalesce("cancel_requested", F.lit(False)) & F.col("request_fingerprint").isNotNull())
    return rows.groupBy("request_fingerprint").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("n"))


@CORE.add("queue_position", _T + " SELECT id, (rank() OVER (ORDER BY created_at) - 1)::BIGINT AS ahead FROM t WHERE created_at IS NOT NULL")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    return R.running_rank(_tasks(spark, d).filter(F.col("created_at").isNotNull()).select("id", "created_at"), "created_at", "ahead").select("id", F.col("ahead").cast("bigint").alias("ahead"))


_BATCH = """, b AS (SELECT id, task_type, created_at, date_trunc('minute', created_at) AS minute, try_cast(regexp_extract(display_no, '-(\\d+)$', 1) AS BIGINT) AS no FROM t WHERE batch_id IS NULL AND created_at IS NOT NULL AND display_no IS NOT NULL),
l AS (SELECT *, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER w) <= 2000000 AND no - lag(no) OVER w = 1 THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY task_type, minute ORDER BY created_at, no)),
i AS (SELECT *, sum(s) OVER (PARTITION BY task_type, minute ORDER BY created_at, no) AS island FROM l)"""


@CORE.add("inferred_batches", _T + _BATCH + " SELECT min(id) AS first_id, task_type, count(*) AS jobs FROM i GROUP BY task_type, minute, island HAVING count(*) > 1")
def inferred_batches(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of a type that came within two seconds of each other under consecutive numbers."""
    rows = _tasks(spark, d).filter(F.col("batch_id").isNull() & F.col("created_at").isNotNull() & F.col("display_no").isNotNull())
    rows = rows.select("id", "task_type", "created_at", F.date_trunc("minute", F.col("created_at").cast("timestamp")).alias("minute"), F.regexp_extract("display_no", r"-(\d+)$", 1).try_cast("bigint").alias("no"))
    found = R.islands(rows, ["task_type", "minute"], "created_at", "no", 2)
    return found.groupBy("task_type", "minute", "island").agg(F.min("id").alias("first_id"), F.count("*").alias("jobs")).filter("jobs > 1").select("first_id", "task_type", "jobs")


@CORE.add("batch_rollup", _T + " SELECT batch_id, count(*) AS jobs, count_if(st = 'completed') AS done, count_if(st IN ('queued', 'running')) AS active, count_if(st = 'failed') AS failed, count_if(st = 'cancelled') AS cancelled, round_even(avg(progress), 0)::BIGINT AS progress FROM t WHERE batch_id IS NOT NULL GROUP BY batch_id")
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    st = R.status_name(F.col("status"))
    rows = _tasks(spark, d).filter(F.col("batch_id").isNotNull()).select("batch_id", st.alias("st"), "progress")
    has = lambda *s: F.count_if(F.col("st").isin(*s))
    return rows.groupBy("batch_id").agg(F.count("*").alias("jobs"), has("completed").alias("done"), has("queued", "running").alias("active"), has("failed").alias("failed"), has("cancelled").alias("cancelled"), F.bround(F.avg("progress"), 0).cast("bigint").alias("progress"))


@CORE.add("task_model", _T + " SELECT id, coalesce(nullif(trim(CASE WHEN json_valid(params_json) THEN params_json->>'mode' END), ''), nullif(trim(CASE WHEN json_valid(params_json) THEN params_json->>'target' END), ''), task_label, 'none') AS model FROM t")
def task_model(spark: SparkSession, d: str) -> DataFrame:
    """The first non-blank of several JSON fields; unreadable JSON counts as empty."""
    doc = F.try_parse_json("params_json")
    field = lambda p: F.nullif(F.trim(F.try_variant_get(doc, f"$.{p}", "string")), F.lit(""))
    return _tasks(spark, d).select("id", F.coalesce(field("mode"), field("target"), "task_label", F.lit("none")).alias("model"))


@CORE.add("json_readable", _T + " SELECT id, coalesce(json_valid(params_json), false) AS params_ok, coalesce(json_valid(result_json), false) AS result_ok FROM t")
def json_readable(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("id", F.try_parse_json("params_json").isNotNull().alias("params_ok"), F.try_parse_json("result_json").isNotNull().alias("result_ok"))


@CORE.add("primary_input", _T + " SELECT id, coalesce(nullif(CASE WHEN json_valid(input_files_json) AND json_type(input_files_json) = 'OBJECT' THEN input_files_json->>'file' END, ''), filename) AS input FROM t")
def primary_input(spark: SparkSession, d: str) -> DataFrame:
    doc = F.try_parse_json("input_files_json")
    return _tasks(spark, d).select("id", F.coalesce(F.nullif(F.try_variant_get(doc, "$.file", "string"), F.lit("")), "filename").alias("input"))


@CORE.add("output_files", _T + ", o AS (SELECT id, output_files_json AS j FROM t WHERE json_valid(output_files_json) AND json_type(output_files_json) = 'OBJECT') SELECT id, unnest(json_keys(j)) AS kind FROM o")
def output_files(spark: SparkSession, d: str) -> DataFrame:
    files = F.from_json("output_files_json", "map<string,string>")
    return _tasks(spark, d).select("id", F.explode(F.map_keys(files)).alias("kind"))


@CORE.add("fingerprint", _T + " SELECT id, sha256(concat_ws('|', coalesce(task_type, ''), coalesce(filename, ''), coalesce(params_json, ''))) AS digest FROM t")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return _tasks(spark, d).select("id", F.sha2(F.concat_ws("|", blank("task_type"), blank("filename"), blank("params_json")), 256).alias("digest"))


@CORE.add("file_category", _T + ", e AS (SELECT id, lower(regexp_extract(filename, '(\\.[A-Za-z0-9]{1,8})$', 1)) AS ext FROM t) SELECT id, ext, CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in N.CATEGORIES.items()) + " ELSE 'other' END AS category FROM e")
def file_category(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d).select("id", N.extension(F.col("filename")).alias("ext"))
    return rows.select("id", "ext", N.category(F.col("ext")).alias("category"))


_STEM = "regexp_replace(filename, '\\.[A-Za-z0-9]{1,8}$', '')"


@CORE.add("rename_cleanup", _T + f" SELECT id, regexp_replace(regexp_replace(regexp_replace({_STEM}, '^\\d+[_.、\\s-]+(\\D)', '\\1'), '^\\d{{4}}[.-]\\d{{1,2}}[.-]\\d{{1,2}}[_\\s]+', ''), '(?:[_\\s-]+(?:final|translated|v\\d+)|\\s*\\(\\d+\\))+$', '') AS stem FROM t WHERE filename IS NOT NULL")
def rename_cleanup(spark: SparkSession, d: str) -> DataFrame:
    stem = F.regexp_replace("filename", r"\.[A-Za-z0-9]{1,8}$", "")
    return _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", N.cleaned(stem).alias("stem"))


@CORE.add("rename_regex", _T + " SELECT id, CASE WHEN regexp_matches(filename, '^(.*?)_(final|v\\d+)(\\.[a-z]+)$') THEN regexp_replace(filename, '^(.*?)_(final|v\\d+)(\\.[a-z]+)$', '\\2-\\1\\3') END AS renamed FROM t")
def rename_regex(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("id", N.renamed(F.col("filename"), r"^(.*?)_(final|v\d+)(\.[a-z]+)$", r"\2-\1\3").alias("renamed"))


_CLEAN = _T + f", n AS (SELECT id, lower(regexp_replace({_STEM}, '(?:[_\\s-]+(?:final|translated|v\\d+)|\\s*\\(\\d+\\))+$', '')) AS target FROM t WHERE filename IS NOT NULL)"


@CORE.add("rename_conflicts", _CLEAN + " SELECT id, count(*) OVER (PARTITION BY target) > 1 AS conflict FROM n")
def rename_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Names that would meet at one target. Counts per target are joined back; a hot target is pre-aggregated."""
    stem = F.regexp_replace("filename", r"\.[A-Za-z0-9]{1,8}$", "")
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", F.lower(F.regexp_replace(stem, r"(?:[_\s-]+(?:final|translated|v\d+)|\s*\(\d+\))+$", "")).alias("target"))
    many = rows.groupBy("target").agg(F.count("*").alias("n")).filter("n > 1").select("target", F.lit(True).alias("c"))
    return rows.join(many, "target", "left").select("id", F.coalesce("c", F.lit(False)).alias("conflict"))


@CORE.add("filename_valid", _T + """ SELECT id, CASE WHEN filename IS NULL OR trim(filename) = '' THEN 'empty' WHEN length(filename) > 240 THEN 'too long' WHEN regexp_matches(filename, '[\\\\/:*?"<>|\\x00-\\x1f]') THEN 'illegal character' WHEN regexp_matches(filename, '[. ]$') THEN 'trailing dot or blank' WHEN regexp_full_match(regexp_replace(upper(filename), '\\..*$', ''), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN 'reserved name' END AS problem FROM t""")
def filename_valid(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("id", N.name_problem(F.col("filename")).alias("problem"))


@CORE.add("number_files", _T + " SELECT id, (row_number() OVER (ORDER BY lower(filename), id))::BIGINT AS n FROM t WHERE filename IS NOT NULL")
def number_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", F.lower("filename").alias("name"))
    return R.numbered(rows, "name", "id").select("id", F.col("n").cast("bigint").alias("n"))


@CORE.add("natural_sort", _T + " SELECT id, list_aggregate(list_transform(regexp_extract_all(lower(filename), '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END, 20, '0') ELSE r END), 'string_agg', '') AS key FROM t WHERE filename IS NOT NULL")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).filter(F.col("filename").isNotNull()).select("id", R.natural_key(F.col("filename")).alias("key"))


@CORE.add("display_no", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 6, '0') AS display_no FROM orders")
def display_no(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    padded = F.when(F.length(key) >= 6, F.substring(key, 1, 6)).otherwise(F.lpad(key, 6, "0"))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), padded).alias("display_no"))


@CORE.add("date_long", "SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS long_date FROM orders")
def date_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.long_date(F.col("o_orderdate")).alias("long_date"))


@CORE.add("paginate_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def paginate_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return R.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 50).select("o_orderkey", "o_totalprice")


@CORE.add("union_all", "SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance")))


@CORE.add("union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return union_all(spark, d).select("nationkey").distinct()


@CORE.add("intersect_keys", "SELECT task_id FROM asr_words INTERSECT SELECT task_id FROM tasks")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asr_words").select("task_id").intersect(table(spark, d, "tasks").select("task_id"))


@CORE.add("except_keys", "SELECT task_id FROM tasks EXCEPT SELECT task_id FROM asr_words")
def except_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("task_id").subtract(table(spark, d, "asr_words").select("task_id"))


@CORE.add("anti_probe", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_probe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@CORE.add("keyword_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'blue')")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("blue"))).select("p_partkey", "p_name")


@CORE.add("latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@CORE.add("json_scan", "SELECT event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@CORE.add(
    "session_islands",
    """WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, island""",
)
def session_islands(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user with gaps of an hour at most."""
    return R.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 3600).select("user_id", F.col("start").alias("start_us"), "n")


@CORE.add("page_groups", "SELECT l_orderkey, (l_linenumber - 1) // 3 AS page, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("page")).agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


@CORE.add(
    "prefix_rollup",
    """WITH p AS (SELECT DISTINCT block_id, part_name || '/' || coalesce(lang, 'none') AS path, length(source_text) AS n FROM docx_blocks), e AS (SELECT string_split(path, '/') AS a, n FROM p),
x AS (SELECT array_to_string(a[1:i], '/') AS prefix, n FROM (SELECT a, n, unnest(range(1, len(a) + 1)) AS i FROM e)) SELECT prefix, count(*) AS rows, sum(n)::BIGINT AS size FROM x GROUP BY prefix""",
)
def prefix_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docx_blocks").select("block_id", F.concat_ws("/", "part_name", F.coalesce("lang", F.lit("none"))).alias("path"), F.length("source_text").cast("bigint").alias("n")).distinct()
    return R.prefix_rollup(rows, "path", "n")


_F = "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_id) AS rn FROM license_fields) WHERE rn = 1)"


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "license_fields"), "field_id")


@CORE.add("field_merge", _F + " SELECT doc_key, field_name, arg_min(field_value, (y, x, field_id)) AS field_value FROM f WHERE trim(field_value) <> '' AND field_name IS NOT NULL GROUP BY doc_key, field_name")
def field_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first filled value of a field in reading order."""
    rows = _fields(spark, d).filter(F.col("field_name").isNotNull()).select("doc_key", "field_name", "field_value", "y", "x", "field_id")
    return R.merge_fields(rows, ["doc_key", "field_name"], "field_value", ["y", "x", "field_id"])


@CORE.add("field_dedup", _F + " SELECT field_id FROM (SELECT field_id, row_number() OVER (PARTITION BY doc_key, field_name ORDER BY coalesce(trim(field_value), '') <> '' DESC, x, field_id) AS r FROM f) WHERE r = 1")
def field_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per field: filled before empty, then leftmost. ``min_by`` combines before the shuffle."""
    empty = F.coalesce(F.trim("field_value"), F.lit("")) == ""
    first = F.min_by("field_id", F.struct(empty.alias("e"), F.coalesce("x", F.lit(2147483647)).alias("x"), "field_id"))
    return _fields(spark, d).groupBy("doc_key", "field_name").agg(first.alias("field_id")).select("field_id")


@CORE.add("best_reading", _F + " SELECT doc_key, field_name, max(confidence) AS confidence, arg_min(field_id, (-confidence, field_id)) AS field_id FROM f WHERE confidence IS NOT NULL GROUP BY doc_key, field_name")
def best_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = _fields(spark, d).filter(F.col("confidence").isNotNull())
    return rows.groupBy("doc_key", "field_name").agg(F.max("confidence").alias("confidence"), F.min_by("field_id", F.struct(-F.col("confidence"), "field_id")).alias("field_id"))


@CORE.add("fix_date", _F + " SELECT field_id, strftime(try_strptime(CASE WHEN regexp_full_match(field_value, '\\s*\\d{4}\\s*[年./-]\\s*\\d{1,2}\\s*[月./-]\\s*\\d{1,2}\\s*日?\\s*') THEN regexp_extract(field_value, '(\\d{4})', 1) || '-' || lpad(regexp_extract(field_value, '^\\s*\\d{4}\\D+(\\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(field_value, '(\\d{1,2})\\s*日?\\s*$', 1), 2, '0') END, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM f WHERE field_value IS NOT NULL")
def fix_date(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).filter(F.col("field_value").isNotNull()).select("field_id", N.repaired_date(F.col("field_value")).alias("day"))


@CORE.add("reading_order", _F + " SELECT field_id, row_number() OVER (PARTITION BY doc_key ORDER BY coalesce(y, 999999), coalesce(x, 999999), field_id) AS place FROM f")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    y = F.coalesce("y", F.lit(999999))
    rows = _fields(spark, d).select("doc_key", "field_id", "x", "y")
    placed = R.numbered_within(rows, ["doc_key"], F.floor(y / 50), [y, F.coalesce("x", F.lit(999999)), F.col("field_id")], "place")
    return placed.select("field_id", F.col("place").cast("bigint").alias("place"))


@CORE.add("spatial_relation", _F + ", p AS (SELECT doc_key, field_id, field_name, x, y FROM f WHERE x IS NOT NULL AND y IS NOT NULL), a AS (SELECT doc_key, min(field_id) AS field_id, arg_min(x, field_id) AS x, arg_min(y, field_id) AS y FROM p GROUP BY doc_key) SELECT a.field_id AS field_a, b.field_id AS field_b, CASE WHEN abs(a.y - b.y) <= 10 THEN CASE WHEN b.x > a.x THEN 'right' ELSE 'left' END WHEN b.y > a.y THEN 'below' ELSE 'above' END AS relation FROM a JOIN p b ON a.doc_key = b.doc_key AND a.field_id < b.field_id")
def spatial_relation(spark: SparkSession, d: str) -> DataFrame:
    """How the readings of a certificate lie to its first one; one row per reading, no pairs among them."""
    rows = _fields(spark, d).filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("doc_key", "field_id", "x", "y")
    first = rows.groupBy("doc_key").agg(F.min("field_id").alias("field_id"), F.min_by("x", "field_id").alias("x"), F.min_by("y", "field_id").alias("y"))
    a, b = first.alias("a"), rows.alias("b")
    joined = a.join(b, (F.col("a.doc_key") == F.col("b.doc_key")) & (F.col("a.field_id") < F.col("b.field_id")))
    level = F.abs(F.col("a.y") - F.col("b.y")) <= 10
    relation = F.when(level, F.when(F.col("b.x") > F.col("a.x"), "right").otherwise("left")).otherwise(F.when(F.col("b.y") > F.col("a.y"), "below").otherwise("above"))
    return joined.select(F.col("a.field_id").alias("field_a"), F.col("b.field_id").alias("field_b"), relation.alias("relation"))


_SIDES = "WITH s AS (SELECT DISTINCT doc_key, idx, source_text AS v FROM docx_sentences WHERE side = 'src'), t AS (SELECT DISTINCT doc_key, idx, source_text AS v FROM docx_sentences WHERE side = 'tgt')"


def _side(spark: SparkSession, d: str, side: str) -> DataFrame:
    return table(spark, d, "docx_sentences").filter(F.col("side") == side).select("doc_key", "idx", F.col("source_text").alias("v")).distinct()


@CORE.add("cell_full_outer", _SIDES + ", j AS (SELECT coalesce(s.doc_key, t.doc_key) AS doc_key, coalesce(s.idx, t.idx) AS idx, coalesce(trim(s.v), '') AS src, coalesce(trim(t.v), '') AS tgt FROM s FULL JOIN t ON s.doc_key = t.doc_key AND s.idx = t.idx) SELECT * FROM j WHERE src <> '' OR tgt <> ''")
def cell_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return R.full_outer_cells(_side(spark, d, "src"), _side(spark, d, "tgt"), ["doc_key", "idx"], "v")


@CORE.add("cell_left", _SIDES + " SELECT s.doc_key, s.idx, s.v AS src, t.v AS tgt FROM s LEFT JOIN t ON s.doc_key = t.doc_key AND s.idx = t.idx")
def cell_left(spark: SparkSession, d: str) -> DataFrame:
    return _side(spark, d, "src").withColumnRenamed("v", "src").join(_side(spark, d, "tgt").withColumnRenamed("v", "tgt"), ["doc_key", "idx"], "left")


@CORE.add("link_coverage", "SELECT doc_key, count(*) AS links, count_if(coalesce(low_confidence, false)) AS weak, sum(src_end - src_start)::BIGINT AS src_rows, round_even(avg(score), 4) AS score FROM alignment_links GROUP BY doc_key")
def link_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "alignment_links")
    return rows.groupBy("doc_key").agg(F.count("*").alias("links"), F.count_if(F.coalesce("low_confidence", F.lit(False))).alias("weak"), F.sum(F.col("src_end") - F.col("src_start")).alias("src_rows"), F.bround(F.avg("score"), 4).alias("score"))


_W = "WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id) AS rn FROM asr_words) WHERE rn = 1)"


@CORE.add("srt_time", _W + ", m AS (SELECT word_id, greatest(round_even(word_start * 1000, 0), 0)::BIGINT AS ms FROM w) SELECT word_id, format('{:02d}:{:02d}:{:02d},{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt FROM m")
def srt_time(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "asr_words").select("word_id", "word_start", "loaded_at"), "word_id").select("word_id", N.srt_time(F.col("word_start")).alias("srt"))


@CORE.add("sentence_spans", _W + " SELECT task_id, channel_id, sentence_id, min(word_start) AS start, max(greatest(coalesce(word_end, word_start), word_start)) AS stop, count(*) AS words FROM w WHERE sentence_id IS NOT NULL AND trim(coalesce(word, '')) <> '' GROUP BY ALL")
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Recognised sentences with start, end and words; impossible ends count as starts."""
    rows = once(table(spark, d, "asr_words"), "word_id").filter(F.col("sentence_id").isNotNull() & (F.trim(F.coalesce("word", F.lit(""))) != ""))
    stop = F.greatest(F.coalesce("word_end", "word_start"), "word_start")
    return rows.groupBy("task_id", "channel_id", "sentence_id").agg(F.min("word_start").alias("start"), F.max(stop).alias("stop"), F.count("*").alias("words"))


@CORE.add("csv_guard", _F + " SELECT field_id, CASE WHEN regexp_matches(field_value, '^[=+\\-@]') THEN '''' || field_value ELSE field_value END AS safe FROM f")
def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("field_id", N.csv_safe(F.col("field_value")).alias("safe"))


@CORE.add("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(N.l2(F.col("embedding")), 4).alias("norm"))


@CORE.add("cosine_pairs", "WITH e AS (SELECT vec_id, embedding, label FROM embeddings), c AS (SELECT label, min(vec_id) AS first_id FROM e GROUP BY label), f AS (SELECT c.label, first_id, embedding AS lead FROM c JOIN e ON vec_id = first_id) SELECT e.vec_id, f.first_id, round(list_dot_product(e.embedding::DOUBLE[], f.lead::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(f.lead::DOUBLE[], f.lead::DOUBLE[]))), 4) AS cosine FROM e JOIN f ON e.label = f.label")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of every vector to the first of its label; one representative per label, no pairs within it."""
    rows = table(spark, d, "embeddings")
    lead = rows.groupBy("label").agg(F.min("vec_id").alias("first_id"), F.min_by("embedding", "vec_id").alias("lead"))
    return rows.join(lead, "label").select("vec_id", "first_id", F.round(N.cosine(F.col("embedding"), F.col("lead")), 4).alias("cosine"))


@CORE.add("batch_cancel", _T + ", a AS (SELECT DISTINCT task_id FROM asr_words WHERE task_id IS NOT NULL) SELECT CASE WHEN t.task_id IS NULL THEN 'missing' WHEN st IN ('queued', 'running') THEN 'cancelled' ELSE 'skipped' END AS outcome, count(*) AS n FROM a LEFT JOIN t ON a.task_id = t.task_id GROUP BY 1")
def batch_cancel(spark: SparkSession, d: str) -> DataFrame:
    """Requested ids against the log: found and open, found and closed, or missing."""
    asked = table(spark, d, "asr_words").select("task_id").filter(F.col("task_id").isNotNull()).distinct()
    known = _tasks(spark, d).select("task_id", R.status_name(F.col("status")).alias("st"), F.lit(True).alias("here"))
    outcome = F.when(F.col("here").isNull(), "missing").when(F.col("st").isin("queued", "running"), "cancelled").otherwise("skipped")
    return asked.join(known, "task_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@CORE.add("image_pages", "SELECT item_id, image_count, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) = 0 THEN true WHEN len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) < 20 AND image_count > 0 THEN true ELSE false END AS wants_ocr FROM (SELECT DISTINCT item_id, image_count, text FROM text_items)")
def image_pages(spark: SparkSession, d: str) -> DataFrame:
    """Items whose text layer is so thin that a recogniser should read them."""
    words = F.coalesce(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+")), F.lit(0))
    rows = table(spark, d, "text_items").select("item_id", "image_count", "text").dropDuplicates(["item_id"])
    return rows.select("item_id", "image_count", F.coalesce((words == 0) | ((words < 20) & (F.col("image_count") > 0)), F.lit(False)).alias("wants_ocr"))


_VP = "WITH p AS (SELECT DISTINCT lower(trim(term_en)) AS key, trim(term_de) AS target FROM glossary WHERE term_en IS NOT NULL AND term_de IS NOT NULL)"


@CORE.add("variant_compile", _VP + " SELECT key, min(target) AS target, count(DISTINCT target) > 1 AS ambiguous, string_agg(DISTINCT target, '|' ORDER BY target) AS candidates FROM p WHERE key <> lower(target) GROUP BY key")
def variant_compile(spark: SparkSession, d: str) -> DataFrame:
    return R.compile_variants(table(spark, d, "glossary"), "term_en", "term_de")


@CORE.add("variant_hits", "WITH g AS (SELECT lower(term_en) AS term FROM glossary), n AS (SELECT doc_id, term, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS hits FROM documents, g WHERE text IS NOT NULL AND contains(lower(text), term)) SELECT term, count(*) AS docs, sum(hits)::BIGINT AS hits FROM n GROUP BY term")
def variant_hits(spark: SparkSession, d: str) -> DataFrame:
    """How often the terms of a small dictionary occur; one pattern per text, not one pass per term."""
    import re

    listed = table(spark, d, "glossary").select("term_en").filter("term_en is not null").limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("the dictionary has more than 10,000 terms; one pattern can't hold them")
    terms = sorted({r[0].lower() for r in listed}, key=lambda t: (-len(t), t))
    pattern = "(" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + ")"
    found = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1)).alias("term"))
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("h")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("h").alias("hits"))
