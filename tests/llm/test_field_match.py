import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import field_match as M

LABELS = [(1, "姓名", "Full Name"), (2, "性别", "Gender"), (4, "出生日期", "Date of Birth"), (5, "出生地点", "Place of Birth"), (10, "有效期截止日", "Valid Until"), (16, "法定代表人", "Legal Representative")]
MATCHER = M.Matcher(LABELS, M.ALIASES)


def osa(a, b):
    """Edits with swaps of neighbours, by the full table."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


WORDS = st.text("abc", min_size=1, max_size=7)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6, unique=True), WORDS, st.integers(0, 3))
def test_automaton_equals_brute_force(forms, query, most):
    found = M.Trie((f, i, 9) for i, f in enumerate(forms)).search(query, most)
    assert found == {i: osa(f, query) for i, f in enumerate(forms) if osa(f, query) <= most}


@pytest.mark.parametrize(
    ("value", "label"),
    [("Full Nane", 1), ("Ful1 Nane​", 1), ("*姓 名：", 1), ("12. Gedner", 2), ("9、性别/Gender", 2), ("Ｄａｔｅ ｏｆ Ｂｉｒｔｈ", 4), ("D.O.B.*", 4), ("Dat of Borth", 4), ("出生曰期", 4), ("出 生 地 点_2", 5), ("有郊期截止日", 10), ("valid_until", 10), ("Lega. Representative", 16), ("Legal\nRepresentative", 16), ("法定代表人 :", 16), ("Shoe Size", 0), ("血型", 0), ("###", 0), ("x1", 0), ("n/a", 0)],
)
def test_spellings(value, label):
    assert MATCHER.find(value)[0] == label


def test_ties_and_long_values():
    tie = M.Matcher([(1, "", "abcdef"), (2, "", "abcdeg")], {})
    assert tie.find("abcdez")[0] == 0 and tie.find("abcdef")[0] == 1
    assert MATCHER.find("x" * 500_000)[0] == 0


def test_column(spark):
    rows = [(1, "Full Nane", "k"), (2, None, "k"), (3, "  ", "k"), (4, "Locker", None), (1, "Full Nane", "k")]
    df = spark.createDataFrame(rows, "field_id bigint, field_name string, label_id string")
    labels = spark.createDataFrame(LABELS, "label_id int, label_zh string, label_en string")
    got = df.select("field_id", M.match_values(df, "field_name", labels).alias("m")).collect()
    assert sorted((r[0], r[1]) for r in got if r[1] is not None) == [(1, 1), (1, 1), (4, 0)]
    assert df.limit(0).select(M.match_values(df, "field_name", labels).alias("m")).count() == 0
    assert {r[0] for r in df.select(M.match_values(df, "field_name", labels.limit(0)).alias("m")).collect()} == {0, None}


def test_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ENTRIES", 2)
    df = spark.createDataFrame([("Gedner",), ("Lgal Representative",), ("Locker",)], "v string")
    labels = spark.createDataFrame(LABELS, "label_id int, label_zh string, label_en string")
    assert [r[0] for r in df.select(M.match_values(df, "v", labels)).collect()] == [2, 16, 0]


def test_random_typos_come_back():
    rng = random.Random(1)
    hits = 0
    for _ in range(300):
        no, _, en = rng.choice(LABELS)
        i = rng.randrange(len(en))
        wrong = en[:i] + rng.choice("abcdefgh") + en[i + 1 :]
        hits += MATCHER.find(wrong)[0] == no
    assert hits >= 295
