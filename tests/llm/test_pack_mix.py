import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import mix as X
from quire.llm import pack as P


def test_knapsack_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        sizes = np.array(rng.sample(range(1, 15), 4))
        worth, most = np.array([rng.random() for _ in sizes]), np.array([rng.randrange(4) for _ in sizes])
        best = 0.0
        for a in range(most[0] + 1):
            for b in range(most[1] + 1):
                for c in range(most[2] + 1):
                    for e in range(most[3] + 1):
                        n = np.array([a, b, c, e])
                        if n @ sizes <= 30:
                            best = max(best, float(n @ worth))
        got = P.knapsack(sizes, worth, most, 30)
        assert (got <= most).all() and got @ sizes <= 30 and float(got @ worth) == pytest.approx(best)


def test_patterns_hold_exactly_the_items():
    rng = random.Random(5)
    hist = Counter(rng.randrange(1, 100) for _ in range(3000))
    sizes = np.array(sorted(hist))
    counts = np.array([hist[s] for s in sizes])
    found = P.configurations(sizes, counts, 100)
    assert (sum(c * t for c, t in found) == counts).all() and all(c @ sizes <= 100 for c, _ in found)
    used = sum(t for _, t in found)
    assert used <= 1.02 * (sizes @ counts / 100) + 2


def test_the_program_covers_every_length_and_its_rounding_packs_most_items():
    rng = random.Random(8)
    hist = Counter(min(511, 1 + int(rng.expovariate(1 / 90))) for _ in range(10_000))
    sizes = np.array(sorted(hist))
    counts = np.array([hist[s] for s in sizes])
    columns, gap = P.fractional(sizes, counts, 512)
    assert np.allclose(sum(c * x for c, x in columns), counts) and all(c @ sizes <= 512 for c, _ in columns)
    assert 0 <= gap < 0.01
    placed = sum(c * n for c, n in P.rounded(columns, sizes, counts))
    assert (placed <= counts).all() and placed.sum() > 0.5 * counts.sum()


def test_the_program_places_nine_tenths_of_the_size():
    rng = random.Random(9)
    for capacity, mean in ((512, 90), (2048, 300), (8192, 300)):
        hist = Counter(min(capacity - 1, 1 + int(rng.expovariate(1 / mean))) for _ in range(6000))
        sizes = np.array(sorted(hist))
        counts = np.array([hist[s] for s in sizes])
        left, before = counts.copy(), float("inf")
        while left.sum() and before - left.sum() >= P.RESIDUAL * before:
            before, some = left.sum(), left > 0
            columns, _ = P.fractional(sizes[some], left[some], capacity)
            left[some] -= sum((c * n for c, n in P.rounded(columns, sizes[some], left[some])), np.zeros(some.sum(), dtype=np.int64))
        assert (left >= 0).all() and left @ sizes <= 0.1 * (counts @ sizes)
        found = P.configurations(sizes, counts, capacity)
        assert (sum(c * t for c, t in found) == counts).all() and sum(t for _, t in found) <= 1.01 * (sizes @ counts / capacity) + 2


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 7, 9, 33, 50, 64, 99, 100, 101, 250, 300])) for i in range(400)] + [(1000 + i, 7) for i in range(200)]
    items = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    targets = spark.createDataFrame([("a", 100), ("b", 64), ("none", 0), ("null", None)], "target_name string, capacity_tokens int")
    got = P.pack(items, targets).collect()
    by_doc, room = defaultdict(list), Counter()
    for r in got:
        by_doc[(r["target_name"], r["doc_id"])].append((r["token_start"], r["token_end"]))
        room[(r["target_name"], r["container"])] += r["token_end"] - r["token_start"]
    capacity = {"a": 100, "b": 64}
    assert all(n <= capacity[t] for (t, _), n in room.items())
    for name, c in capacity.items():
        for doc, tokens in rows:
            parts = sorted(by_doc[(name, doc)])
            if not tokens:
                assert parts == []
                continue
            assert parts[0][0] == 0 and parts[-1][1] == tokens and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
            assert tokens > c or len(parts) == 1
    assert P.pack(items.limit(0), targets).count() == 0 and P.pack(items, targets.limit(0)).count() == 0
    full = P.containers(P.pack(items, targets), targets)
    assert full.filter("unused < 0").count() == 0


def test_water_fill():
    assert X.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}, 100) == {"a": 10, "b": 90}
    assert X.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 40, "c": 1000}, 100) == {"a": 10, "b": 40, "c": 50}
    assert X.water_fill({"a": 1.0}, {"a": 5}, 100) == {"a": 5}
    assert X.water_fill({"a": 0.5, "b": 0.5}, {}, 10) == {"a": 0, "b": 0}


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["Big ", "big", "mid-size", "MID_SIZE"]), f"t{i}", rng.randrange(1, 50)) for i in range(3000)]
    rows += [(5000 + i, "small", f"s{i % 40}", 10) for i in range(80)] + [(6000, None, "n", 5), (6001, "big", None, 0), (6002, "unplanned", "u", 9)]
    items = spark.createDataFrame(rows, "doc_id bigint, source string, text_key string, tokens int")
    plans = spark.createDataFrame([("p", "big", 0.5, 1, 0.5), ("p", "mid_size", 0.3, 2, 0.5), ("p", "small", 0.2, 3, 0.5)], "plan_name string, source string, target_share double, max_repeats int, budget_share double")
    drawn, report = X.mix(items, plans)
    out = drawn.collect()
    total = sum(r[3] for r in rows)
    used = Counter()
    for r in out:
        used[r["source"]] += r["repeats"] * r["tokens"]
    assert used["small"] == 40 * 10 * 3  # clamped; its texts stand under two ids each
    left = 0.5 * total - used["small"]
    assert used["big"] == pytest.approx(left * 5 / 8, rel=0.01) and used["mid_size"] == pytest.approx(left * 3 / 8, rel=0.01)
    assert max(r["repeats"] for r in out if r["source"] == "big") == 1 and len({(r["source"], r["doc_id"]) for r in out}) == len(out)
    assert sorted(tuple(r) for r in X.mix(items, plans)[0].collect()) == sorted(tuple(r) for r in out)
    assert sum(r["actual_share"] for r in X.shares(drawn, report).collect()) == pytest.approx(1, abs=1e-4)
    assert X.mix(items.limit(0), plans)[0].count() == 0


def test_a_text_is_drawn_when_any_copy_has_a_planned_source(spark):
    rows = [(1, None, "a", 10), (2, "big", "a", 10), (3, "unplanned", "b", 10), (4, "big", "b", 10), (5, "big", "c", 10)]
    items = spark.createDataFrame(rows, "doc_id bigint, source string, text_key string, tokens int")
    plans = spark.createDataFrame([("p", "big", 1.0, 1, 1.0)], "plan_name string, source string, target_share double, max_repeats int, budget_share double")
    assert sorted(r["doc_id"] for r in X.mix(items, plans)[0].collect()) == [2, 4, 5]


def test_the_knapsack_is_the_same_with_its_table_in_bits(monkeypatch):
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 60), 12)))
        worth, most = np.array([rng.random() for _ in sizes]), np.array([rng.randrange(6) for _ in sizes])
        plain = P.knapsack(sizes, worth, most, 200)
        with monkeypatch.context() as m:
            m.setattr(P, "PLAIN_BITS", 0)
            assert (P.knapsack(sizes, worth, most, 200) == plain).all()
