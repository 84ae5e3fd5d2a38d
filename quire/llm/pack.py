"""Filling containers of fixed capacity with items of varying length.

Method: the configuration linear program over the histogram of lengths. Its columns are the ways to fill one
container; multiplicative weights on the lengths price them, and a knapsack by dynamic programming finds the
column of greatest weight, round by round until every length is covered. The fractional solution is rounded in
the order of its columns, what remains is packed by knapsack columns over the remaining counts, and the very last
items by first fit in decreasing length.

All this sees only the histogram, whose size is bounded by the capacity (beyond ``MOST_CLASSES`` lengths,
by classes of nearly equal length, each treated as its longest). Items are then matched to containers by
their rank within their class: ranks come from counts of hashed buckets, so no task orders a whole class.

Defined results: an item longer than the capacity fills whole containers with its own parts and only its
rest is packed; items of length 0 or null need no container; ties in length are ordered by bucket and id;
an empty table gives no container.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

log = logging.getLogger(__name__)

#: Lengths told apart exactly; beyond it, classes grow by this factor.
MOST_CLASSES, CLASS_GROWTH = 500, 1.01
#: Step of the multiplicative weights, and the part of a length's need that one round covers at most.
STEP, SHARE = 0.005, 0.5
#: What a length as long as the container is worth more a token, so that long ones aren't left for the end.
LONGER = 0.01
#: Lengths offered to a column; the longest are always among them.
OFFERED = 110
#: The program is solved again for the items that its rounding left while a round places this part of them.
RESIDUAL = 0.3
#: Capacities up to which the table of the knapsack is kept a byte a place; beyond it, a bit.
PLAIN_BITS = 65_536
#: Items per bucket that a rank is counted in.
BUCKET_ITEMS = 100_000
#: Capacity targets are a bounded list.
MOST_TARGETS = 1_000


def knapsack(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length fill a container to the greatest worth; counts are split into powers of two."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, int, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        s, left, batch = int(sizes[i]), int(min(most[i], capacity // sizes[i])), 1
        while left > 0:
            k = min(batch, left)
            w = s * k
            if w > capacity:
                break
            with_it = best[: capacity + 1 - w] + worth[i] * k
            better = with_it > best[w:] + 1e-12
            if better.any():
                taken.append((int(i), k, w, better if capacity <= PLAIN_BITS else np.packbits(better)))
                np.copyto(best[w:], with_it, where=better)
            left -= k
            batch *= 2
    counts = np.zeros(len(sizes), dtype=np.int64)
    at = int(np.argmax(best))
    for i, k, w, bits in reversed(taken):
        if at >= w and (bits[at - w] if capacity <= PLAIN_BITS else (bits[(at - w) >> 3] >> (7 - ((at - w) & 7))) & 1):
            counts[i] += k
            at -= w
    return counts


def offered(active: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the classes still open, the longest and the first in ``order``, as many as a column is priced over."""
    if len(active) <= OFFERED:
        return active
    longest = active[-(OFFERED // 4) :]
    rest = active[: -(OFFERED // 4)]
    return np.sort(np.concatenate([rest[np.argsort(order[rest], kind="stable")[: OFFERED - OFFERED // 4]], longest]))


def fractional(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Columns with fractional amounts that cover every length exactly, and their excess over size / capacity.

    A weight falls with the part of its length that is covered and is 0 once all is. A round advances each length of
    its column by ``SHARE`` of its need at most, so rounds grow with the number of lengths, and none is left uncovered.
    Total size / capacity bounds the program from below, so the excess bounds the distance from its optimum.
    """
    open_, weight = need.astype(float), np.ones(len(sizes))
    columns: dict[bytes, list] = {}
    while True:
        active = np.flatnonzero(open_ > 1e-9 * need)
        if not len(active):
            break
        at = offered(active, -weight)
        column = np.zeros(len(sizes), dtype=np.int64)
        column[at] = knapsack(sizes[at], sizes[at] * weight[at] * (1.0 + LONGER * sizes[at] / capacity), np.ceil(open_[at] - 1e-9).astype(np.int64), capacity)
        used = column > 0
        amount = float(np.min(np.minimum(open_[used], np.maximum(SHARE * need[used], 1.0)) / column[used]))
        columns.setdefault(column.tobytes(), [column, 0.0])[1] += amount
        open_ -= amount * column
        weight *= np.exp(-STEP * amount * column / need)
    found = [(c, x) for c, x in columns.values()]
    return found, sum(x for _, x in found) * capacity / float(sizes @ need) - 1


def rounded(columns: list[tuple[np.ndarray, float]], sizes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole containers as they fall due, of a column its own amount rounded up at most; one that doesn't fit leaves
    its share to the next. Columns emptier than the average are left out; their items are packed with the rest."""
    left, due, out = counts.copy(), 0.0, []
    usual = float(sizes @ counts) / max(sum(x for _, x in columns), 1e-9)
    for column, amount in columns:
        if column @ sizes < 0.99 * usual:
            continue
        due += amount
        used = column > 0
        times = int(min(due + 1e-9, np.ceil(amount - 1e-9), np.min(left[used] // column[used])))
        if times > 0:
            out.append((column, times))
            left -= column * times
            due -= times
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used; together they hold exactly ``counts`` items."""
    sizes, left = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64).copy()
    total = left.copy()
    chosen: list[tuple[np.ndarray, int]] = []
    if not len(sizes) or not left.sum():
        return chosen
    gap, before = None, float("inf")
    while left.sum() and before - left.sum() >= RESIDUAL * before:  # the program again for what its rounding left
        before, open_ = left.sum(), left > 0
        columns, excess = fractional(sizes[open_], left[open_], capacity)
        gap = excess if gap is None else gap
        for part, times in rounded(columns, sizes[open_], left[open_]):
            column = np.zeros_like(left)
            column[open_] = part
            chosen.append((column, times))
            left = left - column * times
    log.info("capacity %d: program %.2f %% above total size / capacity, its rounding places %d of %d items", capacity, 100 * gap, int((total - left).sum()), int(total.sum()))
    while left.sum():
        active = np.flatnonzero(left)
        if len(active) > OFFERED:
            active = np.concatenate([active[np.linspace(0, len(active) - OFFERED // 4 - 1, OFFERED - OFFERED // 4).astype(int)], active[-(OFFERED // 4) :]])
        part = left[active]
        # the more a length lags, the sooner it is used
        column = np.zeros_like(left)
        column[active] = knapsack(sizes[active], sizes[active] * (1.0 + 1e-3 * sizes[active] / capacity), part, capacity)
        used = column > 0
        times = int(np.min(left[used] // column[used]))
        if times < 1 or left.sum() <= 4 * len(active) and len(chosen) > 20_000:
            break
        chosen.append((column, times))
        left -= column * times
    if left.sum():
        chosen += first_fit(sizes, left, capacity)
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]:
    """Upper lengths of the classes, their items, and the patterns that hold them."""
    bounds = classes(list(histogram), capacity)
    counts = np.zeros(len(bounds), dtype=np.int64)
    for size, n in histogram.items():
        counts[np.searchsorted(bounds, size)] += n
    bounds, counts = bounds[counts > 0], counts[counts > 0]
    return bounds, counts, configurations(bounds, counts, capacity)


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    bins: list[list] = []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            for b in bins:
                if b[1] >= sizes[i]:
                    break
            else:
                b = [np.zeros(len(sizes), dtype=np.int64), capacity]
                bins.append(b)
            b[0][i] += 1
            b[1] -= int(sizes[i])
    return [(b[0], 1) for b in bins]


def classes(sizes: list[int], capacity: int) -> np.ndarray:
    """Upper bounds of the length classes: every length itself, or growing steps."""
    if len(sizes) <= MOST_CLASSES:
        return np.array(sorted(sizes), dtype=np.int64)
    bounds, at = [], 1.0
    while at < capacity:
        bounds.append(int(at))
        at = max(at + 1, at * CLASS_GROWTH)
    return np.array(sorted({*bounds, capacity}), dtype=np.int64)


def pack(items: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per item or part of an item: its container and the tokens it puts there.

    ``items``: ``doc_id, tokens`` (narrow; cut from its lineage here, as it is read for the histogram and for
    the placing). ``targets``: ``target_name, capacity_tokens``. Result: ``target_name, container, doc_id,
    part, token_start, token_end``. Containers are named; those of rounded patterns are numbered.
    """
    goals = [(r[0], int(r[1])) for r in targets.select("target_name", "capacity_tokens").filter(F.col("capacity_tokens") > 0).limit(MOST_TARGETS + 1).collect()]
    if len(goals) > MOST_TARGETS:
        raise ValueError(f"there are more than {MOST_TARGETS} targets")
    spark = items.sparkSession
    if not goals:
        return spark.createDataFrame([], "target_name string, container string, doc_id bigint, part int, token_start int, token_end int")
    items = cut_lineage(items.select("doc_id", "tokens").filter(F.col("tokens") > 0))
    per_goal = F.explode(F.array(*(F.struct(F.lit(n).alias("target_name"), F.lit(c).alias("capacity")) for n, c in goals)))
    all_rows = items.select("doc_id", "tokens", per_goal.alias("g")).select("doc_id", "tokens", "g.target_name", "g.capacity")
    rest = F.col("tokens") % F.col("capacity")
    sized = all_rows.withColumn("rest", rest).withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")).cast("int"))

    def solve(key, lengths: pd.DataFrame) -> pd.DataFrame:
        """The plan of one target: per class its upper length and, in order of ranks, how many items which container takes."""
        name = key[0]
        bounds, counts, columns = plan(dict(zip(lengths["rest"].tolist(), lengths["n"].tolist(), strict=True)), capacities[name])
        next_rank, container, out = np.zeros(len(bounds), dtype=np.int64), 0, []
        for column, times in columns:
            for i in np.flatnonzero(column):
                out.append((name, int(i), int(bounds[i]), int(next_rank[i]), int(column[i]), container))
                next_rank[i] += int(column[i]) * times
            container += times
        return pd.DataFrame(out, columns=["target_name", "cls", "bound", "start", "each", "first"])

    # one task per target; what comes back is bounded by the capacities, as is the histogram
    capacities = dict(goals)
    histogram = sized.filter("rest > 0").groupBy("target_name", "rest").agg(F.count("*").alias("n")).repartition(16 * len(goals), "target_name")
    solved: dict[str, dict[int, list]] = {n: {} for n, _ in goals}
    bounds_of: dict[str, dict[int, int]] = {n: {} for n, _ in goals}
    for r in histogram.groupBy("target_name").applyInPandas(solve, "target_name string, cls int, bound bigint, start bigint, each bigint, first bigint").collect():
        bounds_of[r["target_name"]][r["cls"]] = r["bound"]
        solved[r["target_name"]].setdefault(r["cls"], []).append((r["start"], r["each"], r["first"]))
    plans = {n: ([bounds_of[n][i] for i in sorted(bounds_of[n])], {i: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(runs), strict=True)) for i, runs in solved[n].items()}) for n, _ in goals}
    sent = spark.sparkContext.broadcast(plans)

    @F.pandas_udf("int")
    def class_of(name: pd.Series, size: pd.Series) -> pd.Series:
        out = np.zeros(len(size), dtype=np.int32)
        for n in name.unique():
            at = (name == n).to_numpy()
            out[at] = np.searchsorted(sent.value[n][0], size.to_numpy()[at])
        return pd.Series(out)

    @F.pandas_udf("bigint")
    def container_of(name: pd.Series, cls: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), dtype=np.int64)
        for (n, c), at in pd.DataFrame({"n": name, "c": cls}).groupby(["n", "c"]).indices.items():
            starts, each, first = sent.value[n][1][int(c)]
            r = rank.to_numpy()[at]
            k = np.searchsorted(starts, r, side="right") - 1
            out[at] = first[k] + (r - starts[k]) // each[k]
        return pd.Series(out)

    total = items.count()
    buckets = max(8, -(-total // BUCKET_ITEMS) * 2)
    rests = sized.filter("rest > 0").select("target_name", "doc_id", "tokens", "rest", class_of("target_name", "rest").alias("cls")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = Window.partitionBy("target_name", "cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rests.groupBy("target_name", "cls", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("target_name", "cls", "bucket").orderBy("doc_id")
    ranked = rests.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["target_name", "cls", "bucket"]).withColumn("rank", F.col("r") + F.col("offset"))
    placed = ranked.select(
        "target_name",
        F.concat(F.lit("p"), container_of("target_name", "cls", "rank")).alias("container"),
        "doc_id",
        (F.col("tokens") - F.col("rest")).alias("token_start"),
        F.col("tokens").alias("token_end"),
    )
    whole = sized.filter("whole > 0").select("target_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    whole = whole.select("target_name", F.concat(F.lit("w"), "doc_id", F.lit("-"), "part").alias("container"), "doc_id", "part", (F.col("part") * F.col("capacity")).alias("token_start"), ((F.col("part") + 1) * F.col("capacity")).alias("token_end"))
    goal_capacity = F.create_map(*(x for n, c in goals for x in (F.lit(n), F.lit(c))))
    placed = placed.withColumn("part", F.floor(F.col("token_start") / goal_capacity[F.col("target_name")]).cast("int")).select("target_name", "container", "doc_id", "part", "token_start", "token_end")
    return placed.unionByName(whole)


def containers(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers with what they hold and their unused space."""
    rows = packed.groupBy("target_name", "container").agg(F.count("*").alias("items"), F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    return rows.join(targets.select("target_name", "capacity_tokens"), "target_name").withColumn("unused", F.col("capacity_tokens") - F.col("used"))
