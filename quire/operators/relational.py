"""Relational operators over job logs and listings, written so that no task meets a whole hot group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage


def status_name(status: Column) -> Column:
    return F.lower(F.trim(status))


def filtered(tasks: DataFrame, statuses: str | None = None, task_type: str | None = None, filename: str | None = None, marked: bool | None = None) -> DataFrame:
    """The job list's filter: status in a comma list (blanks dropped), type, substring of the name, mark."""
    wanted = [s.strip().lower() for s in (statuses or "").split(",") if s.strip()]
    if wanted:
        tasks = tasks.filter(status_name(F.col("status")).isin(wanted))
    if task_type:
        tasks = tasks.filter(F.col("task_type") == task_type)
    if filename:
        tasks = tasks.filter(F.contains(F.lower("filename"), F.lit(filename.lower())))
    if marked is not None:
        tasks = tasks.filter(F.coalesce("feedback_marked", F.lit(False)) == marked)
    return tasks


def page(tasks: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list, as a top-k, not as a sort of all rows."""
    return tasks.orderBy(*order).limit(number * size).offset((number - 1) * size)


def numbered(rows: DataFrame, order: str, key: str, out: str = "n") -> DataFrame:
    """Global row numbers without a single task: ranges of equal size over (order, key), counted and offset.

    The range a row fell in is kept in a checkpoint, as sampled ranges may differ when a lost part is computed
    again. Equal values are spread by their keys, so a frequent one is no hot range.
    """
    ranged = cut_lineage(rows.repartitionByRange(F.col(order), F.col(key)).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(order, key)
    return ranged.join(offsets, "_part").withColumn(out, F.row_number().over(inside) + F.col("_before")).drop("_part", "_before")


def numbered_within(rows: DataFrame, keys: list[str], block: Column, order: list[Column], out: str = "n") -> DataFrame:
    """Row numbers within keys whose rows may be many: numbers inside blocks of the order, offset by the blocks before.

    ``block`` must grow with the order.
    """
    placed = rows.withColumn("_block", block)
    counts = placed.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return placed.join(offsets, [*keys, "_block"]).withColumn(out, F.row_number().over(inside) + F.col("_before")).drop("_block", "_before")


def sessions(rows: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Sessions of a key: rows whose neighbours are ``seconds`` apart at most, with start, stop and count.

    Rows are joined to runs inside days; only the first and last run of a day can go on in another, so a key with
    many rows meets in one task with two rows a day.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    timed = rows.select(key, t.alias("t"), F.floor(t / 86_400_000_000).alias("day"))
    order = Window.partitionBy(key, "day").orderBy("t")
    starts = F.when(F.col("t") - F.lag("t").over(order) <= seconds * 1_000_000, 0).otherwise(1)
    runs = timed.withColumn("run", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "day", "run").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"))
    last = F.max("run").over(Window.partitionBy(key, "day"))
    runs = runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == last))
    by_start = Window.partitionBy(key).orderBy("start")
    edges = runs.filter("edge")
    goes_on = F.when((F.col("start") - F.lag("stop").over(by_start) <= seconds * 1_000_000) & (F.col("day") > F.lag("day").over(by_start)), 0).otherwise(1)
    joined = edges.withColumn("s", goes_on).withColumn("s", F.sum("s").over(by_start.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "s").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))
    return joined.select(key, "start", "stop", "n").unionByName(runs.filter("NOT edge").select(key, "start", "stop", "n"))


def silence_islands(rows: DataFrame, key: str, at: str, seconds: float, bucket: float = 600.0) -> DataFrame:
    """Rows with their ``island``: the start, in milliseconds, of the stretch without a gap of ``seconds`` that they lie in.

    Stretches are found inside buckets of time; the first one of a bucket goes on from the bucket before it, so a key meets
    in one task with a row or two a bucket only.
    """
    placed = rows.withColumn("_b", F.floor(F.col(at) / bucket))
    order = Window.partitionBy(key, "_b").orderBy(at)
    begins = F.when(F.coalesce(F.col(at) - F.lag(at).over(order) < seconds, F.lit(False)), F.lit(None)).otherwise(F.col(at))
    inside = placed.withColumn("_s", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inside.groupBy(key, "_b").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("_s").alias("open"))
    by_bucket = Window.partitionBy(key).orderBy("_b")
    goes_on = F.coalesce(F.col("first") - F.lag("last").over(by_bucket) < seconds, F.lit(False))
    # a bucket's open stretch begins in it, unless all of the bucket is one stretch that goes on from before
    anchor = F.when(~F.col("goes_on") | (F.col("open") != F.col("first")), F.col("open"))
    ends = ends.withColumn("goes_on", goes_on).withColumn("_a", anchor)
    ends = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), "first", "goes_on", F.last("_a", ignorenulls=True).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    joined = inside.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    start = F.when(F.col("goes_on") & (F.col("_s") == F.col("first")), F.col("_from")).otherwise(F.col("_s"))
    return joined.withColumn("island", F.bround(start * 1000, 0).cast("bigint")).drop("_b", "_s", "_k", "_c", "_from", "first", "goes_on")


def running_rank(rows: DataFrame, at: str, out: str) -> DataFrame:
    """How many rows have an earlier time, ties sharing: counts per day, then ranks inside the day."""
    day = F.date_trunc("day", F.col(at).cast("timestamp"))
    spread = rows.withColumn("_day", day)
    counts = spread.groupBy("_day").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_day").orderBy(at)
    return spread.join(offsets, F.col("_day") == F.col("_d")).withColumn(out, F.rank().over(inside) - 1 + F.col("_before")).drop("_day", "_d", "_before")


def islands(rows: DataFrame, keys: list[str], at: str, number: str, seconds: float) -> DataFrame:
    """Rows that follow each other within ``seconds`` and by consecutive numbers share an island.

    Keys should bound their groups, for example by a time bucket.
    """
    order = Window.partitionBy(*keys).orderBy(at, number)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    near = (micros(F.col(at)) - micros(F.lag(at).over(order)) <= seconds * 1e6) & (F.col(number) - F.lag(number).over(order) == 1)
    starts = F.when(near, 0).otherwise(1)
    return rows.withColumn("island", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def prefix_rollup(rows: DataFrame, path: str, measure: str) -> DataFrame:
    """Rows and size under every ancestor of a path. Counts are combined per full path first."""
    per_path = rows.groupBy(path).agg(F.count("*").alias("n"), F.sum(measure).alias("s"))
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return per_path.select(F.explode(ancestors).alias("prefix"), "n", "s").groupBy("prefix").agg(F.sum("n").alias("rows"), F.sum("s").alias("size"))


def natural_key(name: Column) -> Column:
    """A string that sorts as people sort names: digits as numbers, the rest without case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r)), "")


def full_outer_cells(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells of two grids by position; positions that are blank on both sides are dropped."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    a = left.select(*keys, blank(F.col(value)).alias("src"))
    b = right.select(*keys, blank(F.col(value)).alias("tgt"))
    both = a.join(b, keys, "full_outer").select(*keys, blank(F.col("src")).alias("src"), blank(F.col("tgt")).alias("tgt"))
    return both.filter((F.col("src") != "") | (F.col("tgt") != ""))


def merge_fields(fields: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The first non-blank value per key. ``min_by`` combines before the shuffle."""
    filled = fields.filter(F.trim(value) != "")
    return filled.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def compile_variants(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Rules of one direction: a key with one target is a rule, with several it is ambiguous."""
    rows = pairs.select(F.lower(F.trim(source)).alias("key"), F.trim(target).alias("target")).filter((F.col("key") != "") & (F.col("target") != "") & (F.col("key") != F.lower("target")))
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("target")).alias("targets")).select("key", F.element_at("targets", 1).alias("target"), (F.size("targets") > 1).alias("ambiguous"), F.array_join("targets", "|").alias("candidates"))


def paired_sheets(sheets: DataFrame, key: str) -> DataFrame:
    """Pairs of sheets of two sides: by name where any name is on both, else by their order (``first``)."""
    src, tgt = (sheets.filter(F.col("side") == s).select(key, F.col("name").alias(f"{s}_sheet"), F.col("first").alias(f"{s}_first")) for s in ("src", "tgt"))
    common = src.join(tgt.withColumn("src_sheet", F.col("tgt_sheet")), [key, "src_sheet"])
    placed = lambda rows, s: rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(f"{s}_first")))
    zipped = placed(src, "src").join(placed(tgt, "tgt"), [key, "k"]).join(common.select(key).distinct(), key, "left_anti")
    columns = [key, "src_sheet", "tgt_sheet"]
    return common.select(*columns, F.lit(True).alias("by_name")).unionByName(zipped.select(*columns, F.lit(False).alias("by_name")))


def free_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Names that differ from all others of their group: a repeat gets the next free ``_2``, ``_3`` … before its extension.

    Whether a made name is free hangs on what came before, so the names that may meet are folded together: those whose
    stem without its number and whose extension are the same. Other names can't clash, so a group is cut by them.
    """
    low = F.lower(F.col(name))
    root = F.regexp_replace(low, r"(?:_\d+)+(?=(?:\.[a-z0-9]{1,8})?$)", "")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        last: dict[str, int] = {}
        out = []
        for n in (g := g.sort_values(order))[name]:
            stem, dot, ext = n.rpartition(".")
            if not stem or not 0 < len(ext) <= 8 or not ext.isalnum():
                stem, dot, ext = n, "", ""
            made, i = n, last.get(n.lower(), 2)
            while made.lower() in used:
                made = f"{stem}_{i}{dot}{ext}"
                i += 1
            last[n.lower()] = i
            used.add(made.lower())
            out.append(made)
        g[name] = out
        return g[[order, group, name]]

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (order, group, name))
    return rows.select(order, group, name, root.alias("root")).groupBy(group, "root").applyInPandas(fold, schema)
