"""Queries over readings of certificates: form checks, repairs, pages, seals, bar codes and label matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fields as C
from quire.functions import names as N
from quire.plans.registry import CORE
from quire.plans.text_queries import _strip_sql
from quire.sources.tables import once, table

_F = "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_id) AS rn FROM license_fields) WHERE rn = 1)"


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "license_fields"), "field_id")


def _han(v: str) -> str:
    return f"len(regexp_extract_all({v}, '{C.HAN}'))"


_CHECKS_SQL = {
    "name": f"(regexp_matches(v, '^[一-龥]{{2,6}}$') OR (length(v) BETWEEN 2 AND 6 AND {_han('v')} >= 2))",
    "sex": "regexp_matches(v, '^[男女]$')",
    "nationality": f"(NOT regexp_matches(v, '[{C.PLACE_WORDS}{C.ROOM_WORDS}]') AND (regexp_matches(v, '^[一-龥]{{2,10}}$') OR (length(v) BETWEEN 2 AND 20 AND {_han('v')} >= 2)))",
    "day": f"regexp_matches(v, '{C.DATE}')",
    "address": f"(regexp_matches(v, '[{C.PLACE_WORDS}]') OR (length(v) >= 5 AND {_han('v')} >= 3))",
    "licence_no": r"regexp_matches(v, '^\p{Nd}{17}[\p{Nd}Xx]$')",
    "vehicle_class": rf"(NOT regexp_matches(lower(v), '{C.NO_CLASS_WORDS}') AND length(v) <= 20 AND NOT regexp_matches(v, '\p{{Nd}}{{4}}[-/年]\p{{Nd}}{{1,2}}[-/月]\p{{Nd}}{{1,2}}') AND NOT regexp_matches(v, '至|长期|到') AND (regexp_matches(v, '{C.CLASSES}') OR regexp_matches(v, '{C.TWO_SIGN_CLASSES}') OR regexp_matches(v, '(?:^|[^A-Za-z])[DEFMNP](?:$|[^a-z])')))",
    "valid_period": r"(regexp_matches(v, '^\p{Nd}{1,2}年$') OR v = '长期' OR regexp_matches(v, '[至到]') OR len(regexp_extract_all(v, '\p{Nd}{4}[-/年.]\p{Nd}{1,2}[-/月.]\p{Nd}{1,2}')) >= 2)",
    "authority": f"(regexp_matches(v, '{C.AUTHORITY}') AND length(v) >= 5 AND {_han('v')} >= 3)",
    "file_no": rf"(regexp_matches(v, '^\p{{Nd}}{{6,20}}$') OR (length(v) BETWEEN 6 AND 20 AND len(regexp_extract_all(v, '\p{{Nd}}')) >= 6 AND len(regexp_extract_all(v, '\p{{Nd}}')) / length(v) >= 0.7 AND NOT regexp_matches(v, '{C.NO_FILE_WORDS}')))",
    "record": "true",
}


@CORE.add("field_valid", _F + f", s AS (SELECT field_id, {_strip_sql('field_value')} AS v FROM f) SELECT field_id, " + ", ".join(f"coalesce(length(v) > 0 AND {c}, false) AS {k}_ok" for k, c in _CHECKS_SQL.items()) + " FROM s")
def field_valid(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of field a value has the form of."""
    return _fields(spark, d).select("field_id", *(c.alias(f"{k}_ok") for k, c in C.checks(F.col("field_value")).items()))


@CORE.add("format_predicates", _F + rf" SELECT field_id, coalesce(regexp_matches({_strip_sql('field_value')}, '^\p{{Nd}}{{17}}[\p{{Nd}}Xx]$'), false) AS is_id, coalesce(regexp_matches({_strip_sql('field_value')}, '^[A-Z0-9]{{1,10}}$'), false) AS is_code FROM f")
def format_predicates(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).select("field_id", C.is_id_number(F.col("field_value")).alias("is_id"), C.is_code(F.col("field_value")).alias("is_code"))


@CORE.add("room_repair", _F + ", r AS (SELECT field_id, coalesce(field_value, '') || '号' || (860 + field_id % 13)::VARCHAR || '房' AS t FROM f) SELECT field_id, regexp_replace(t, '([^\\p{Nd}])86(\\p{Nd})房', '\\180\\2房', 'g') AS repaired FROM r")
def room_repair(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with room numbers 860 to 872 behind them, repaired."""
    room = F.concat(F.coalesce("field_value", F.lit("")), F.lit("号"), (860 + F.col("field_id") % 13).cast("string"), F.lit("房"))
    return _fields(spark, d).select("field_id", C.repaired_room(room).alias("repaired"))


@CORE.add("date_repair", """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 5 < 3 THEN month(o_orderdate) ELSE month(o_orderdate) + 60 END AS m, CASE WHEN o_orderkey % 7 = 0 THEN day(o_orderdate) + 40 ELSE day(o_orderdate) END AS dd FROM orders),
x AS (SELECT *, CASE WHEN m BETWEEN 60 AND 79 THEN m - 60 WHEN m >= 20 AND m % 10 > 0 THEN m % 10 ELSE m END AS fm, CASE WHEN dd > 31 AND dd % 10 > 0 THEN dd % 10 ELSE dd END AS fd FROM o)
SELECT o_orderkey, y || '-' || lpad(fm::VARCHAR, 2, '0') || '-' || lpad(fd::VARCHAR, 2, '0') AS repaired FROM x""")
def date_repair(spark: SparkSession, d: str) -> DataFrame:
    """Order dates with months read as 6x or 7x and days beyond a month, repaired."""
    day = F.col("o_orderdate")
    m = F.when(F.col("o_orderkey") % 5 < 3, F.month(day)).otherwise(F.month(day) + 60)
    dd = F.when(F.col("o_orderkey") % 7 == 0, F.dayofmonth(day) + 40).otherwise(F.dayofmonth(day))
    text = F.concat_ws("-", F.year(day).cast("string"), m.cast("string"), dd.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", C.repaired_numbers(text).alias("repaired"))


_READ = ("CIF", "cof", "BID", "b1d", "AI", "c1", "ci", "C|", "C1FD", "A1B2", "B2Al", "Driving", "准驾", "c*1", "E", "C3M", "BOX", "lO", "1C", "D")
_CLASS_SQL = f"""WITH f AS (SELECT DISTINCT field_id, [{', '.join(repr(x) for x in _READ)}][field_id % {len(_READ)} + 1] AS t FROM license_fields),
g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'C[IO]F', 'C1F', 'gi'), 'C[IO]', 'C1', 'gi'), 'B[IO]D', 'B1D', 'gi'), 'B[IO]', 'B1', 'gi'), 'A[IO]', 'A1', 'gi') AS x FROM f),
p AS (SELECT *, string_split(regexp_replace(x, '(\\p{{Nd}})(\\p{{L}})', '\\1 \\2', 'g'), ' ') AS parts FROM g)
SELECT field_id, CASE WHEN length(t) > 10 OR regexp_matches(t, '{C.HAN}') THEN t WHEN length(t) <= 3 AND (lower(t) IN ({', '.join(repr(x) for x in C.C1_READINGS)}) OR (regexp_matches(t, '[^\\p{{L}}\\p{{N}} \\-]') AND contains(lower(t), 'c'))) THEN 'C1'
ELSE array_to_string(list_transform(list_transform(parts, lambda q: translate(q, 'IOl', '101')), lambda q: CASE WHEN regexp_full_match(upper(q), 'A[1-3]|B[12]|C[1-5]|[DEFMNP]') THEN upper(q) ELSE q END), '') END AS repaired FROM p"""


@CORE.add("vehicle_class", _CLASS_SQL)
def vehicle_class(spark: SparkSession, d: str) -> DataFrame:
    """Readings of vehicle classes, repaired."""
    read = F.element_at(F.array(*(F.lit(x) for x in _READ)), (F.col("field_id") % len(_READ) + 1).cast("int"))
    return table(spark, d, "license_fields").select("field_id").distinct().select("field_id", C.repaired_class(read).alias("repaired"))


@CORE.add("date_phrases", """WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 400 DAY AS b FROM orders),
w AS (SELECT o_orderkey, strftime(a, '%B ') || day(a) || ', ' || year(a) AS x, strftime(b, '%B ') || day(b) || ', ' || year(b) AS y FROM o)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN x WHEN 1 THEN x || ' to ' || y WHEN 2 THEN x || ' to ' || y WHEN 3 THEN x || ' to long-term' ELSE 'no date' END AS phrase FROM w""")
def date_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Dates, ranges and open ranges in words."""
    a, b = (F.date_format(c, "yyyy-MM-dd") for c in (F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")))
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, a).when(kind == 1, F.concat(a, F.lit(" to "), b)).when(kind == 2, F.concat(a, F.lit("至"), b)).when(kind == 3, F.concat(a, F.lit("至长期"))).otherwise("no date")
    return table(spark, d, "orders").select("o_orderkey", C.long_phrase(text).alias("phrase"))


_MARK = "CASE field_id % 50 WHEN 7 THEN 'Duplicate of Driving License' WHEN 11 THEN 'Driving License of the People''s Republic of China' WHEN 23 THEN '准驾车型代号规定' ELSE field_value END"


def _marked():
    k = F.col("field_id") % 50
    return F.when(k == 7, "Duplicate of Driving License").when(k == 11, "Driving License of the People's Republic of China").when(k == 23, "准驾车型代号规定").otherwise(F.col("field_value"))


@CORE.add("page_types", _F + f""", t AS (SELECT doc_key, field_id, x, {_MARK} AS v FROM f), k AS (SELECT doc_key, field_id, CASE WHEN x < 300 THEN 'left' ELSE 'right' END AS side, CASE WHEN contains(v, 'Driving License of the People''s Republic of China') AND NOT contains(v, 'Duplicate') THEN 'main' WHEN contains(v, 'Duplicate of Driving License') OR contains(v, '副页') THEN 'duplicate' WHEN contains(v, 'Legend for Class of Vehicles') OR contains(v, '准驾车型代号规定') OR (contains(v, '准驾车型') AND contains(v, '代号') AND contains(v, '规定')) THEN 'legend' END AS kind FROM t WHERE x IS NOT NULL)
SELECT doc_key, side, arg_max(kind, field_id) AS kind FROM k WHERE kind IS NOT NULL GROUP BY doc_key, side""")
def page_types(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each half of a certificate; the last reading that tells wins."""
    rows = _fields(spark, d).filter(F.col("x").isNotNull()).select("doc_key", "field_id", F.when(F.col("x") < 300, "left").otherwise("right").alias("side"), C.page_kind(_marked()).alias("kind"))
    return rows.filter(F.col("kind").isNotNull()).groupBy("doc_key", "side").agg(F.max_by("kind", "field_id").alias("kind"))


@CORE.add("seal_text", _F + f" SELECT doc_key, string_agg(field_value, '' ORDER BY y, field_id) AS seal FROM f WHERE x < 150 AND y > 250 AND y < 380 AND regexp_matches(field_value, '{C.HAN}') GROUP BY doc_key")
def seal_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts in the place of the seal, from top to bottom. A seal's place bounds what is put together."""
    rows = _fields(spark, d).filter((F.col("x") < 150) & (F.col("y") > 250) & (F.col("y") < 380) & F.col("field_value").rlike(C.HAN))
    parts = F.array_sort(F.collect_list(F.struct("y", "field_id", "field_value")))
    return rows.groupBy("doc_key").agg(parts.alias("p")).select("doc_key", F.array_join(F.transform("p", lambda p: p["field_value"]), "").alias("seal"))


@CORE.add("barcode_pick", _F + r""", c AS (SELECT doc_key, field_id, x, y, regexp_replace(trim(field_value), '[ \-*\[\]+_]', '', 'g') AS code FROM f WHERE x IS NOT NULL AND y IS NOT NULL), b AS (SELECT * FROM c WHERE regexp_full_match(code, '\p{Nd}{6,}'))
SELECT doc_key, arg_min(code, (-(y - x / 10.0 + 10 * length(code)), field_id)) AS low_left, arg_min(code, (-(y + x / 10.0 + 10 * length(code)), field_id)) AS low_right FROM b GROUP BY doc_key""")
def barcode_pick(spark: SparkSession, d: str) -> DataFrame:
    """The long number nearest to the lower left, and to the lower right, of a certificate; the first of equals."""
    code = F.regexp_replace(F.trim("field_value"), r"[ \-*\[\]+_]", "")
    rows = _fields(spark, d).filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("doc_key", "field_id", "x", "y", code.alias("code")).filter(F.col("code").rlike(r"^\p{Nd}{6,}$"))
    best = lambda s: F.min_by("code", F.struct((-(F.col("y") + s * (F.col("x") / 10.0) + 10 * F.length("code"))).alias("s"), "field_id"))
    return rows.groupBy("doc_key").agg(best(-1).alias("low_left"), best(1).alias("low_right"))


_BOXES = _F + ", b AS (SELECT doc_key, field_id, x, y, x + 40 + 8 * length(coalesce(field_value, '')) AS x2, y + 30 AS y2 FROM f WHERE x IS NOT NULL AND y IS NOT NULL), a AS (SELECT doc_key, min(field_id) AS first_id, arg_min(x, field_id) AS ax, arg_min(y, field_id) AS ay, arg_min(x2, field_id) AS ax2, arg_min(y2, field_id) AS ay2 FROM b GROUP BY doc_key)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Readings as boxes beside the box of the first reading of their certificate."""
    rows = _fields(spark, d).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    b = rows.select("doc_key", "field_id", "x", "y", (F.col("x") + 40 + 8 * F.length(F.coalesce("field_value", F.lit("")))).alias("x2"), (F.col("y") + 30).alias("y2"))
    first = b.groupBy("doc_key").agg(F.min("field_id").alias("first_id"), *(F.min_by(c, "field_id").alias(f"a{c}") for c in ("x", "y", "x2", "y2")))
    return b.join(first, "doc_key")


@CORE.add("box_geometry", _BOXES + """, g AS (SELECT field_id, first_id, greatest(least(x2, ax2) - greatest(x, ax), 0) * greatest(least(y2, ay2) - greatest(y, ay), 0) AS common, (x2 - x) * (y2 - y) AS area, (ax2 - ax) * (ay2 - ay) AS first_area, sqrt(pow((x + x2) / 2.0 - (ax + ax2) / 2.0, 2) + pow((y + y2) / 2.0 - (ay + ay2) / 2.0, 2)) AS apart FROM b JOIN a USING (doc_key))
SELECT field_id, first_id, common, area, round(common / (area + first_area - common), 6) AS iou, round(apart, 4) AS apart FROM g""")
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, area, IoU and distance of centres of readings and the first one of their certificate."""
    c = {n: F.col(n) for n in ("x", "y", "x2", "y2", "ax", "ay", "ax2", "ay2")}
    common = F.greatest(F.least(c["x2"], c["ax2"]) - F.greatest(c["x"], c["ax"]), F.lit(0)) * F.greatest(F.least(c["y2"], c["ay2"]) - F.greatest(c["y"], c["ay"]), F.lit(0))
    iou = N.overlap(*(c[n] for n in ("x", "y", "x2", "y2", "ax", "ay", "ax2", "ay2")))
    apart = F.sqrt(F.pow((c["x"] + c["x2"]) / 2 - (c["ax"] + c["ax2"]) / 2, F.lit(2)) + F.pow((c["y"] + c["y2"]) / 2 - (c["ay"] + c["ay2"]) / 2, F.lit(2)))
    return _boxes(spark, d).select("field_id", "first_id", common.alias("common"), ((c["x2"] - c["x"]) * (c["y2"] - c["y"])).alias("area"), F.round(iou, 6).alias("iou"), F.round(apart, 4).alias("apart"))


_RELATION_SQL = """CASE WHEN ox > cx THEN CASE WHEN abs(oy - cy) < ah * 0.5 THEN 'right_same_line' WHEN oy < cy AND abs(oy - cy) < ah * 3 THEN 'right_above' WHEN abs(oy - cy) < ah * 1.5 THEN 'right_near_line' END END"""


@CORE.add("label_relation", _BOXES + f""", g AS (SELECT field_id, first_id, (x + x2) / 2.0 AS ox, (y + y2) / 2.0 AS oy, (ax + ax2) / 2.0 AS cx, (ay + ay2) / 2.0 AS cy, x2 - x AS w, ax2 - ax AS aw, ay2 - ay AS ah, y - ay AS down FROM b JOIN a USING (doc_key) WHERE field_id <> first_id),
r AS (SELECT field_id, first_id, coalesce({_RELATION_SQL}, CASE WHEN oy > cy THEN CASE WHEN abs(ox - cx) < aw AND down < ah * 3 THEN 'below_same_column' WHEN abs(ox - cx) < (aw + w) * 1.5 AND down < ah * 3 THEN 'below_near_column' END END) AS relation FROM g)
SELECT field_id, first_id, relation, list_position(['right_same_line', 'right_above', 'right_near_line', 'below_same_column', 'below_near_column'], relation) AS priority FROM r WHERE relation IS NOT NULL""")
def label_relation(spark: SparkSession, d: str) -> DataFrame:
    """Readings in a place where the value of the first reading's label may stand, with the preference of the place."""
    label = {"x": F.col("ax"), "y": F.col("ay"), "w": F.col("ax2") - F.col("ax"), "h": F.col("ay2") - F.col("ay")}
    other = {"x": F.col("x"), "y": F.col("y"), "w": F.col("x2") - F.col("x"), "h": F.col("y2") - F.col("y")}
    rows = _boxes(spark, d).filter("field_id <> first_id").select("field_id", "first_id", C.relation(label, other).alias("relation")).filter(F.col("relation").isNotNull())
    return rows.select("field_id", "first_id", "relation", C.relation_priority(F.col("relation")).cast("int").alias("priority"))


@CORE.add("label_best", _BOXES + f""", g AS (SELECT field_id, first_id, (x + x2) / 2.0 AS ox, (y + y2) / 2.0 AS oy, (ax + ax2) / 2.0 AS cx, (ay + ay2) / 2.0 AS cy, x2 - x AS w, ax2 - ax AS aw, ay2 - ay AS ah, y - ay AS down FROM b JOIN a USING (doc_key) WHERE field_id <> first_id),
r AS (SELECT *, coalesce({_RELATION_SQL}, CASE WHEN oy > cy THEN CASE WHEN abs(ox - cx) < aw AND down < ah * 3 THEN 'below_same_column' WHEN abs(ox - cx) < (aw + w) * 1.5 AND down < ah * 3 THEN 'below_near_column' END END) AS relation FROM g)
SELECT first_id, arg_min(field_id, (list_position(['right_same_line', 'right_above', 'right_near_line', 'below_same_column', 'below_near_column'], relation), pow(ox - cx, 2) + pow(oy - cy, 2), field_id)) AS best_id FROM r WHERE relation IS NOT NULL GROUP BY first_id""")
def label_best(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate per label by place, then by distance; ``min_by`` combines before the shuffle."""
    label = {"x": F.col("ax"), "y": F.col("ay"), "w": F.col("ax2") - F.col("ax"), "h": F.col("ay2") - F.col("ay")}
    other = {"x": F.col("x"), "y": F.col("y"), "w": F.col("x2") - F.col("x"), "h": F.col("y2") - F.col("y")}
    apart = F.pow((F.col("x") + F.col("x2")) / 2 - (F.col("ax") + F.col("ax2")) / 2, F.lit(2)) + F.pow((F.col("y") + F.col("y2")) / 2 - (F.col("ay") + F.col("ay2")) / 2, F.lit(2))
    rows = _boxes(spark, d).filter("field_id <> first_id").select("field_id", "first_id", C.relation(label, other).alias("relation"), apart.alias("apart")).filter(F.col("relation").isNotNull())
    return rows.groupBy("first_id").agg(F.min_by("field_id", F.struct(C.relation_priority(F.col("relation")).alias("p"), "apart", "field_id")).alias("best_id"))


@CORE.add("field_record", _F + ", r AS (SELECT doc_key, trim(field_value) AS v, min((coalesce(y, 999999), coalesce(x, 999999), field_id)) AS place FROM f WHERE field_name IS NOT NULL AND trim(field_value) <> '' AND length(field_name) <= 4 GROUP BY ALL) SELECT doc_key, string_agg(v, '；' ORDER BY place) AS record FROM r GROUP BY doc_key")
def field_record(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of a certificate's short fields in reading order, as one record; values are merged before they meet."""
    at = F.struct(F.coalesce("y", F.lit(999999)).alias("y"), F.coalesce("x", F.lit(999999)).alias("x"), "field_id")
    rows = _fields(spark, d).filter(F.col("field_name").isNotNull() & (F.trim("field_value") != "") & (F.length("field_name") <= 4))
    firsts = rows.groupBy("doc_key", F.trim("field_value").alias("v")).agg(F.min(at).alias("at"))
    ordered = firsts.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("p"))
    return ordered.select("doc_key", F.array_join(F.transform("p", lambda p: p["v"]), "；").alias("record"))


@CORE.add("early_reading", _F + " SELECT doc_key, field_name, coalesce(arg_min(field_id, field_id) FILTER (confidence >= 0.9), arg_min(field_id, (-confidence, field_id))) AS field_id FROM f WHERE confidence IS NOT NULL GROUP BY doc_key, field_name")
def early_reading(spark: SparkSession, d: str) -> DataFrame:
    """The first reading that is sure enough; where none is, the surest, the first of equals."""
    rows = _fields(spark, d).filter(F.col("confidence").isNotNull())
    sure = F.min(F.when(F.col("confidence") >= 0.9, F.col("field_id")))
    return rows.groupBy("doc_key", "field_name").agg(F.coalesce(sure, F.min_by("field_id", F.struct(-F.col("confidence"), "field_id"))).alias("field_id"))
