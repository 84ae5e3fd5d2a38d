"""File names, page specifications, times, dates and geometry as native expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.measure import let, strip


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})$", 1))


# What files of an extension are.
CATEGORIES = {
    "document": (".doc", ".docx", ".rtf", ".odt", ".txt", ".md"),
    "sheet": (".xls", ".xlsx", ".csv", ".ods"),
    "slides": (".ppt", ".pptx", ".odp"),
    "pdf": (".pdf",),
    "image": (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".gif"),
    "audio": (".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg"),
    "mail": (".msg", ".eml"),
    "drawing": (".dwg", ".dxf"),
}


def category(ext: Column) -> Column:
    out = None
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out.otherwise("other")


def cleaned(stem: Column) -> Column:
    """A stem without a leading number or date and without version suffixes."""
    lean = F.regexp_replace(stem, r"^\d+[_.、\s-]+(?=\D)", "")
    lean = F.regexp_replace(lean, r"^\d{4}[.-]\d{1,2}[.-]\d{1,2}[_\s]+", "")
    return strip(F.regexp_replace(lean, r"(?:[_\s-]+(?:final|translated|v\d+)|\s*\(\d+\))+$", ""))


def renamed(name: Column, pattern: str, replacement: str) -> Column:
    """A user's pattern with back references written as in Python; null where it doesn't match."""
    java = re.sub(r"\\(\d+)|\\g<(\w+)>", lambda m: "${" + m.group(2) + "}" if m.group(2) else "$" + m.group(1), replacement.replace("$", r"\$"))
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, java))


def name_problem(name: Column) -> Column:
    """The first reason why a file name is refused, or null."""
    stem = F.regexp_replace(F.upper(name), r"\..*$", "")
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "empty")
        .when(F.length(name) > 240, "too long")
        .when(name.rlike(r'[\\/:*?"<>|\x00-\x1f]'), "illegal character")
        .when(name.rlike(r"[. ]$"), "trailing dot or blank")
        .when(stem.rlike(r"^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "reserved name")
    )


def pages(spec: Column, total: Column) -> Column:
    """``1-3,5,3`` as positions from 0, each once in order; null where a page is out of bounds or unreadable."""
    parts = F.filter(F.transform(F.split(spec, "[,，;；]"), lambda p: F.trim(p)), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    last = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-\s*(\d+)$", 1), F.lit("")).try_cast("int"), first(p))
    bounds = F.forall(parts, lambda p: (first(p) >= 1) & (last(p) >= first(p)) & (last(p) <= total))
    found = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(first(p) - 1, last(p) - 1))))
    return F.when(good & (F.size(parts) > 0), F.when(bounds, found))


def srt_time(seconds: Column, mark: str = ",") -> Column:
    ms = F.greatest(F.bround(seconds * 1000, 0).cast("bigint"), F.lit(0))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def csv_safe(value: Column) -> Column:
    """A value no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def repaired_date(text: Column) -> Column:
    """``yyyy-MM-dd`` of a date with any separators, or null."""
    y, m, d = (F.regexp_extract(text, r"^\s*(\d{4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?\s*$", i) for i in (1, 2, 3))
    return let(F.try_to_timestamp(F.concat_ws("-", F.nullif(y, F.lit("")), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")), lambda t: F.date_format(t, "yyyy-MM-dd"))


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def redacted(line: Column) -> Column:
    """A log line without settings, routes, models and secrets: keys, bearer tokens and passwords."""
    lean = F.regexp_replace(line, r"\[config\]\s+.*", "[config] ***")
    lean = F.regexp_replace(lean, r"(?i)(route=|model=)\S+", "$1***")
    lean = F.regexp_replace(lean, r"(?i)(bearer\s+)[A-Za-z0-9._-]{8,}", "$1***")
    lean = F.regexp_replace(lean, r"(?i)((?:api[_-]?key|token|password|secret)\s*[=:]\s*)[^\s,;&\"']+", "$1***")
    return F.regexp_replace(lean, r"\bsk-[A-Za-z0-9]{8,}", "sk-***")


def overlap(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Intersection over union of two boxes; 0 for boxes without area."""
    w = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0))
    h = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0))
    area = lambda x1, y1, x2, y2: F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))
    union = area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - w * h
    return F.when(union > 0, (w * h).cast("double") / union).otherwise(0.0)


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    norm = l2(a) * l2(b)
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def wanted_extensions(asked: Column, known: tuple[str, ...]) -> Column:
    """Extensions in lower case with a dot, known ones, each once and sorted; none asked for means all."""
    lean = F.filter(F.transform(asked, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    dotted = F.transform(lean, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))
    every = F.array(*(F.lit(x) for x in known))
    return F.when(F.size(lean) == 0, every).otherwise(F.array_sort(F.array_intersect(dotted, every)))


def _page_parts(spec: Column) -> Column:
    lean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(spec)), "[，、]", ","), "[—–]", "-")
    return F.filter(F.split(lean, r"[,\s]+"), lambda p: p != "")


def page_problem(spec: Column, total: Column) -> Column:
    """The reason of the first part of a page specification that is refused, or null; blank and ``all`` mean all pages."""
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("bigint")
    last = lambda p: F.coalesce(F.regexp_extract(p, r"-(\d+)$", 1).try_cast("bigint"), first(p))
    why = F.filter(F.transform(_page_parts(spec), lambda p: F.when(~p.rlike(r"^\d+(-\d+)?$"), "unreadable").when((first(p) < 1) | (last(p) < first(p)) | (last(p) > total), "out of bounds")), lambda x: x.isNotNull())
    return F.when(total <= 0, "no pages").when(F.lower(F.trim(spec)).isin("", "all"), F.lit(None).cast("string")).otherwise(F.coalesce(F.get(why, F.lit(0)), F.when(F.size(_page_parts(spec)) == 0, "nothing selected")))


def page_choice(op: str, spec: Column, total: Column) -> Column:
    """Pages, from 0, that an operation leaves: ``odd`` and ``even`` ones, those of ``spec`` (extract) or all others (delete)."""
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    if op in ("odd", "even"):
        return F.filter(every, lambda p: p % 2 == (0 if op == "odd" else 1))
    return pages(spec, total) if op == "extract" else F.array_except(every, pages(spec, total))


def saved_share(before: Column, after: Column) -> Column:
    """What is saved of a size, in per cent with two digits, ties to even; 0 where nothing is."""
    return F.when(before > 0, F.bround(F.greatest(before - after, F.lit(0)).cast("double") / before * 100, 2)).otherwise(0.0)


# How files of a kind begin, in hexadecimal.
HEADS = ((".png", "89504E470D0A1A0A"), (".jpg", "FFD8FF"), (".gif", "474946383761"), (".gif", "474946383961"), (".bmp", "424D"), (".tiff", "49492A00"), (".tiff", "4D4D002A"), (".ico", "00000100"))


def image_kind(content: Column) -> Column:
    """The extension that the first bytes of a file tell, or null."""
    head = F.hex(F.substring(content, 1, 12))
    out = None
    for kind, start in HEADS:
        out = F.when(head.startswith(start), kind) if out is None else out.when(head.startswith(start), kind)
    return out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")


def one_name(name: Column, aliases: dict[str, str]) -> Column:
    """A name under the spelling that stands for all of its aliases."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.trim(name))


def reference_keys(ref: Column) -> Column:
    """Forms under which an attachment may be named: decoded, without brackets, ``cid:``, folders or a leading dot."""
    raw = F.trim(F.regexp_replace(F.trim(ref), "^['\"]+|['\"]+$", ""))
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    bare = lambda c: F.trim(F.regexp_replace(c, "^[<\\s]+|[>\\s]+$", ""))
    forms = [f for c in (raw, decoded) for f in (c, bare(c), bare(F.regexp_replace(bare(c), "(?i)^cid:", "")), F.regexp_extract(F.regexp_replace(bare(c), r"[?#].*$", ""), r"([^/\\]*)$", 1), F.regexp_replace(bare(c), r"^[./]+", ""))]
    return F.array_distinct(F.filter(F.transform(F.array(*forms), lambda k: F.lower(k)), lambda k: k != ""))


def without_prefix(name: Column, *prefixes: Column) -> Column:
    """A name without the first prefix and mark that stand before it, unless nothing is left."""
    for p in prefixes:
        cut = F.regexp_replace(F.substr(name, F.length(p) + 2), r"^[ _-]+", "")
        name = F.when(p.isNotNull() & (p != "") & name.startswith(F.concat(p, F.lit("_"))) & (cut != ""), cut).otherwise(name)
    return name


# Names that some systems keep for devices.
_DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10))}


def _stem(name: str | None) -> str:
    base = (name or "file").replace("\\", "/").rsplit("/", 1)[-1]
    dot = base.rfind(".")
    return (base[:dot] if 0 < dot < len(base) - 1 else base).strip()


def plain_stem(name: str | None, most: int = 40) -> str:
    """ASCII letters and digits of a stem with ``_`` between them; ``file`` where there are none."""
    stem = _stem(name)
    lean = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode("ascii")
    return (re.sub("[^A-Za-z0-9]+", "_", lean).strip("_").lower() or "file")[:most]


def shown_stem(name: str | None, most: int = 80) -> str:
    """A stem that every file system takes: compatible forms, no illegal signs, blanks and ``_`` squeezed, no device name."""
    lean = unicodedata.normalize("NFKC", _stem(name) or "file")
    for pattern, by in ((r'[\x00-\x1f<>:"/\\|?*]+', "_"), (r"\s+", " "), ("_+", "_")):
        lean = re.sub(pattern, by, lean)
    lean = lean.strip(" ._") or "file"
    if lean.upper() in _DEVICES:
        lean += "_file"
    return (lean[:most].rstrip(" ._") if len(lean) > most else lean) or "file"


def _as_udf(how):
    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: how(None if n is None or n != n else n))

    return run.asNondeterministic()


def ascii_stem(name: Column) -> Column:
    return _as_udf(plain_stem)(name)


def visible_stem(name: Column) -> Column:
    return _as_udf(shown_stem)(name)
