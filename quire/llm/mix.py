"""Mixing sources to target weights of the total size, with a cap on repeats.

Method: capped water-filling. A source whose share asks for more than its texts repeated ``max_repeats``
times is clamped there, and its excess goes to the others in proportion to their weights, until all fit.
Every text of a source is then taken the whole number of times, and a seeded part of its texts once more.

A text that stands under several ids counts as one text: its first id of a planned source stands for it. The part is found by a
seeded hash: its threshold comes from the tokens per source and hash bin, a table of bounded size, so no
source is ever ordered or collected.

Defined results: null sources, and sources no plan names, are drawn in no plan; spelling of sources counts
without case, outer blanks and the kind of separator; texts without tokens are not drawn; where all sources
are clamped, the total falls short and the report shows it; repeated plan rows add up.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: Hash bins per source: the precision of a part, 1/16384 of a source or one text, whichever is more. No text is left out
#: by it; tokens per bin are summed exactly.
BINS = 1 << 14
#: Rows of plans; they are a bounded list.
MOST_PLAN_ROWS = 100_000


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")


def water_fill(shares: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens per source: shares of the budget, clamped at caps, the excess spread in proportion."""
    given = {s: 0.0 for s in shares}
    open_ = {s for s, w in shares.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(shares[s] for s in open_)
        over = {s for s in open_ if left * shares[s] / total >= caps.get(s, 0.0)}
        if not over:
            for s in open_:
                given[s] = left * shares[s] / total
            break
        for s in over:
            given[s] = caps.get(s, 0.0)
            left -= given[s]
        open_ -= over
    return given


def threshold(tokens: list[int], part: float) -> tuple[int, list[int]]:
    """Bins below the first number, and those listed, hold nearly ``part`` tokens.

    The bin that would overshoot is passed over, and later ones that fit fill what is missing.
    """
    below, at = 0, 0
    while at < len(tokens) and below + tokens[at] <= part:
        below += tokens[at]
        at += 1
    more = []
    for k in range(at + 1, len(tokens)):
        if part - below < 1e-4 * part:
            break
        if tokens[k] and below + tokens[k] <= part:
            below += tokens[k]
            more.append(k)
    return at, more


def mix(items: DataFrame, plans: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(drawn rows with their repeats, the plan's wanted tokens per source).

    ``items``: ``doc_id, source, text_key, tokens``. Drawn: ``plan_name, source, doc_id, repeats, tokens``.
    """
    spark = items.sparkSession
    named = cut_lineage(items.select("doc_id", source_name(F.col("source")).alias("source"), "text_key", "tokens"))
    corpus = named.agg(F.sum("tokens")).first()[0] or 0
    wanted: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    caps: dict[str, dict[str, int]] = defaultdict(dict)
    budgets: dict[str, float] = {}
    listed = plans.select("plan_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_share").dropna().limit(MOST_PLAN_ROWS + 1).collect()
    if len(listed) > MOST_PLAN_ROWS:
        raise ValueError(f"the plans have more than {MOST_PLAN_ROWS} rows")
    for r in listed:
        wanted[r[0]][r[1]] += r[2]
        caps[r[0]][r[1]] = max(int(r[3]), caps[r[0]].get(r[1], 0))
        budgets[r[0]] = float(r[4]) * corpus
    names = sorted({s for p in wanted.values() for s in p})
    planned = spark.createDataFrame([(n,) for n in names], "source string")
    texts = named.filter(F.col("tokens") > 0).join(F.broadcast(planned), "source", "left_semi")
    texts = texts.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("f")).select("f.*")
    texts = cut_lineage(texts.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BINS)).cast("int")))
    bins: dict[str, list[int]] = {s: [0] * BINS for s in names}
    for r in texts.groupBy("source", "bin").agg(F.sum("tokens").alias("n")).toLocalIterator():
        bins[r["source"]][r["bin"]] = r["n"]
    have = {s: sum(b) for s, b in bins.items()}

    rows = []
    for plan in sorted(wanted):
        limits = {s: float(caps[plan][s] * have[s]) for s in wanted[plan]}
        for s, tokens in water_fill(wanted[plan], limits, budgets[plan]).items():
            whole = int(tokens // have[s]) if have[s] else 0
            part = tokens - whole * have[s] if have[s] else 0.0
            at, more = threshold(bins[s], part)
            if whole >= caps[plan][s]:
                whole, at, more = caps[plan][s], 0, []
            rows.append((plan, s, wanted[plan][s], tokens, budgets[plan], whole, at, more))
    report = spark.createDataFrame(rows, "plan_name string, source string, target_share double, wanted_tokens double, budget_tokens double, whole int, threshold int, more array<int>")
    part = F.when((F.col("bin") < F.col("threshold")) | F.array_contains("more", F.col("bin")), 1).otherwise(0)
    drawn = texts.join(F.broadcast(report), "source").withColumn("repeats", F.col("whole") + part).filter(F.col("repeats") > 0)
    return drawn.select("plan_name", "source", "doc_id", "repeats", "tokens"), report


def shares(drawn: DataFrame, report: DataFrame) -> DataFrame:
    """Actual tokens and shares per plan and source beside the wanted ones."""
    got = drawn.groupBy("plan_name", "source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("drawn_tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    rows = report.join(got, ["plan_name", "source"], "left").na.fill(0, ["drawn_tokens", "texts", "most_repeats"])
    total = rows.groupBy("plan_name").agg(F.sum("drawn_tokens").alias("plan_tokens"))
    return rows.join(total, "plan_name").select(
        "plan_name", "source", "target_share", F.round("wanted_tokens", 3).alias("wanted_tokens"), F.round("budget_tokens", 3).alias("budget_tokens"), "drawn_tokens", "texts", "most_repeats", F.round(F.col("drawn_tokens") / F.when(F.col("plan_tokens") > 0, F.col("plan_tokens")), 6).alias("actual_share")
    )
