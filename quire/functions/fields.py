"""Checks and repairs of certificate fields as native expressions: no value leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.measure import strip

# What a field of a certificate must look like.
DATE = r"\p{Nd}{4}年\p{Nd}{1,2}月\p{Nd}{1,2}|\p{Nd}{4}[/.\-]\p{Nd}{2}[/.\-]\p{Nd}{2}"
PLACE_WORDS = "省市区县镇村路号街道"
ROOM_WORDS = "楼室房"
AUTHORITY = "公安|交警|车管|局|支队|大队"
CLASSES = r"^([A-E][1-3]){1,3}[DEFMNP]?$|^[DEFMNP]$"
TWO_SIGN_CLASSES = "A1|A2|A3|B1|B2|C1|C2|C3|C4|C5"
NO_CLASS_WORDS = "date|issue|find|lssue|dute|ther|lice"
NO_FILE_WORDS = "年|月|日|请|提交|身体|条件|证明|之后|每年"
HAN = "[一-鿿]"


def _han(value: Column) -> Column:
    return F.coalesce(F.regexp_count(value, F.lit(HAN)), F.lit(0))


def checks(value: Column) -> dict[str, Column]:
    """Whether a value has the form of each kind of field; null and blank values have none."""
    v, n = strip(value), F.length(strip(value))
    names = v.rlike("^[一-龥]{2,6}$") | (n.between(2, 6) & (_han(v) >= 2))
    nation = ~v.rlike(f"[{PLACE_WORDS}{ROOM_WORDS}]") & (v.rlike("^[一-龥]{2,10}$") | (n.between(2, 20) & (_han(v) >= 2)))
    address = v.rlike(f"[{PLACE_WORDS}]") | ((n >= 5) & (_han(v) >= 3))
    vehicle = ~F.lower(v).rlike(NO_CLASS_WORDS) & (n <= 20) & ~v.rlike(r"\p{Nd}{4}[-/年]\p{Nd}{1,2}[-/月]\p{Nd}{1,2}") & ~v.rlike("至|长期|到")
    vehicle = vehicle & (v.rlike(CLASSES) | v.rlike(TWO_SIGN_CLASSES) | v.rlike(r"(?:^|[^A-Za-z])[DEFMNP](?:$|[^a-z])"))
    period = v.rlike(r"^\p{Nd}{1,2}年$") | (v == "长期") | v.rlike("[至到]") | (F.regexp_count(v, F.lit(r"\p{Nd}{4}[-/年.]\p{Nd}{1,2}[-/月.]\p{Nd}{1,2}")) >= 2)
    digits = F.regexp_count(v, F.lit(r"\p{Nd}"))
    file_no = v.rlike(r"^\p{Nd}{6,20}$") | (n.between(6, 20) & (digits >= 6) & (digits / n >= 0.7) & ~v.rlike(NO_FILE_WORDS))
    found = {
        "name": names, "sex": v.rlike("^[男女]$"), "nationality": nation, "day": v.rlike(DATE), "address": address, "licence_no": v.rlike(r"^\p{Nd}{17}[\p{Nd}Xx]$"), "vehicle_class": vehicle,
        "valid_period": period, "authority": v.rlike(AUTHORITY) & (n >= 5) & (_han(v) >= 3), "file_no": file_no, "record": F.lit(True),
    }
    return {k: F.coalesce((n > 0) & c, F.lit(False)) for k, c in found.items()}


def is_id_number(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(r"^\p{Nd}{17}[\p{Nd}Xx]$"), F.lit(False))


def is_code(text: Column) -> Column:
    return F.coalesce(strip(text).rlike("^[A-Z0-9]{1,10}$"), F.lit(False))


def repaired_room(text: Column) -> Column:
    """Room numbers of addresses, in which 0 between 8 and a digit was read as 6."""
    return F.when(text.rlike("[号房路街区省市村镇]"), F.regexp_replace(text, r"(?<!\p{Nd})86(\p{Nd})房", "80$1房")).otherwise(text)


def repaired_numbers(text: Column) -> Column:
    """``y-m-d`` with impossible months and days put right: 6x was 0x, 7x was 1x, else the last digit counts."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{1,3})-(\d{1,2})$", i)
    month, day = part(2).try_cast("int"), part(3).try_cast("int")
    last = lambda c: c % 10
    fixed = F.when(month.between(60, 79), month - 60).when((month >= 20) & (last(month) > 0), last(month)).otherwise(month)
    fixed_day = F.when((day > 31) & (last(day) > 0), last(day)).otherwise(day)
    whole = F.concat_ws("-", part(1), F.lpad(fixed.cast("string"), F.greatest(F.lit(2), F.length(fixed.cast("string"))), F.lit("0")), F.lpad(fixed_day.cast("string"), 2, "0"))
    return F.when(part(1) != "", whole).otherwise(text)


#: Readings that stand for C1, and letters read for the digit of a class.
C1_READINGS = ("ci", "cí", "c1", "cl", "c|", "cî", "cì")


def repaired_class(text: Column) -> Column:
    """Vehicle classes whose digit was read as a letter; texts that can't be a class stay."""
    lean = F.lower(text)
    sign = text.rlike(r"[^\p{L}\p{N} \-]")
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)C[IO]F", "C1F"), "(?i)C[IO]", "C1"), "(?i)B[IO]D", "B1D"), "(?i)B[IO]", "B1"), "(?i)A[IO]", "A1")
    parts = F.split(fixed, r"(?<=\p{Nd})(?=\p{L})")
    swapped = F.transform(parts, lambda p: F.translate(p, "IOl", "101"))
    known = F.transform(swapped, lambda p: F.when(F.upper(p).rlike("^(?:A[1-3]|B[12]|C[1-5]|[DEFMNP])$"), F.upper(p)).otherwise(p))
    return (
        F.when((F.length(text) > 10) | text.rlike(HAN), text)
        .when((F.length(text) <= 3) & (lean.isin(*C1_READINGS) | (sign & lean.contains("c"))), "C1")
        .otherwise(F.array_join(known, ""))
    )


def long_phrase(text: Column) -> Column:
    """Dates and ranges in words: ``May 3, 2020 to long-term``; other texts stay."""
    day = lambda y, m, d: F.date_format(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")), "MMMM d, yyyy")
    span = r"^(\d{4})-(\d{2})-(\d{2})\s*(?:to|至)\s*(\d{4})-(\d{2})-(\d{2})"
    at = lambda p, i: F.regexp_extract(text, p, i)
    long_, one = r"^(\d{4})-(\d{2})-(\d{2})至长期", r"^(\d{4})-(\d{2})-(\d{2})$"
    return (
        F.when(text.rlike(span), F.concat(day(*(at(span, i) for i in (1, 2, 3))), F.lit(" to "), day(*(at(span, i) for i in (4, 5, 6)))))
        .when(text.rlike(long_), F.concat(day(*(at(long_, i) for i in (1, 2, 3))), F.lit(" to long-term")))
        .when(text.rlike(one), day(*(at(one, i) for i in (1, 2, 3))))
        .otherwise(text)
    )


def page_kind(text: Column) -> Column:
    """The kind of page a text gives away, or null."""
    return (
        F.when(text.contains("Driving License of the People's Republic of China") & ~text.contains("Duplicate"), "main")
        .when(text.contains("Duplicate of Driving License") | text.contains("副页"), "duplicate")
        .when(text.contains("Legend for Class of Vehicles") | text.contains("准驾车型代号规定") | (text.contains("准驾车型") & text.contains("代号") & text.contains("规定")), "legend")
    )


#: The order in which positions of a value to its label are preferred.
RELATIONS = ("right_same_line", "right_above", "right_near_line", "below_same_column", "below_near_column")


def relation(label: dict[str, Column], other: dict[str, Column]) -> Column:
    """How a box (``x, y, w, h``) lies to a label's box, as one of ``RELATIONS``, or null."""
    cx, cy = label["x"] + label["w"] / 2, label["y"] + label["h"] / 2
    ox, oy = other["x"] + other["w"] / 2, other["y"] + other["h"] / 2
    apart, below = F.abs(oy - cy), other["y"] - label["y"] < label["h"] * 3
    right = F.when(apart < label["h"] * 0.5, "right_same_line").when((oy < cy) & (apart < label["h"] * 3), "right_above").when(apart < label["h"] * 1.5, "right_near_line")
    under = F.when((F.abs(ox - cx) < label["w"]) & below, "below_same_column").when((F.abs(ox - cx) < (label["w"] + other["w"]) * 1.5) & below, "below_near_column")
    return F.coalesce(F.when(ox > cx, right), F.when(oy > cy, under))


def relation_priority(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in RELATIONS)), kind)
