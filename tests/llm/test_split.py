import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import split as S


def check(text, most, overlap):
    got = S.pieces(text, most, overlap)
    if len(text) <= most or not text.strip():
        assert got == []
        return
    back = min(overlap, most - 1)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= most for a, b in got)
    for (_, end), (start, stop) in zip(got, got[1:], strict=False):
        assert start == max(0, end - back) and stop > end


@settings(max_examples=400, deadline=None)
@given(st.text("ab .。，\n👍🏽é", max_size=200), st.integers(1, 50), st.integers(0, 60))
def test_pieces_fit_overlap_and_cover(text, most, overlap):
    check(text, most, overlap)


def test_cuts_at_sentences_where_there_are_any():
    text = " ".join(f"Sentence number {i} speaks of things." for i in range(60))
    got = S.pieces(text, 200, 20)
    assert all(text[end - 2 : end].strip() in (".", "s.") for _, end in got[:-1])


def test_topic_change_is_the_deepest_valley():
    text = "cats purr softly. " * 8 + "trains run fast. " * 8
    ends = [e for _, e in S.pieces(text, 200, 0)]
    assert len("cats purr softly. " * 8) in ends


def test_falls_back_to_clauses_blanks_and_whole_characters():
    assert S.pieces("a" * 10 + "，" + "b" * 15, 20, 0)[0] == (0, 11)
    assert S.pieces("a" * 10 + " " + "b" * 15, 20, 0)[0] == (0, 11)
    assert S.pieces("a" * 9 + "e\u0301" + "b" * 10, 10, 0)[0] == (0, 9)
    assert S.pieces("total 12,345.67 euros and more", 12, 0)[0] == (0, 6)
    assert S.pieces("a" * 10 + "," + "b" * 15, 20, 0)[0] == (0, 11)
    assert S.longest_stretch("ab.cde 12345") == 5


def test_valleys_equal_brute_force():
    import random
    from collections import Counter
    from math import sqrt

    rng = random.Random(2)
    parts = [" ".join(rng.choice(["tea", "cup", "rail", "train", "fast"]) for _ in range(4)) + ". " for _ in range(30)]
    text = "".join(parts)
    gaps = [len("".join(parts[: i + 1])) for i in range(29)]
    bags = [S._terms(p) for p in parts]

    def cosine(i):
        a, b = sum(bags[max(0, i - S.BLOCK + 1) : i + 1], Counter()), sum(bags[i + 1 : i + 1 + S.BLOCK], Counter())
        return sum(n * b[t] for t, n in a.items()) / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    sims = [cosine(i) for i in range(29)]
    wanted = []
    for i, s in enumerate(sims):
        left = right = s
        k = i
        while k > 0 and sims[k - 1] >= sims[k]:
            k -= 1
            left = max(left, sims[k])
        k = i
        while k < 28 and sims[k + 1] >= sims[k]:
            k += 1
            right = max(right, sims[k])
        wanted.append(left - s + right - s)
    assert S.valley_depths(text, gaps) == pytest.approx(wanted, abs=1e-9)


def test_table(spark):
    limits = spark.createDataFrame([("text_item", "body", 10, 2), ("text_item", "cell", None, 2), ("docx_block", None, 12, None)], "item_kind string, source_type string, max_chars int, overlap_chars int")
    rows = [("text_item", 1, " BODY ", "one two three four", "x"), ("text_item", 1, " BODY ", "one two three four", "x"), ("text_item", 2, "body", None, None), ("text_item", 3, "cell", "a" * 50, None), ("text_item", 4, "other", "a" * 50, None), ("docx_block", 1, None, "z" * 30, None), ("text_item", 5, "body", "short", None)]
    items = spark.createDataFrame(rows, "item_kind string, item_id bigint, source_type string, text string, pieces string")
    got = S.split_items(items, limits)
    assert sorted((r["item_kind"], r["item_id"], r["has_unbroken"]) for r in got.collect()) == [("docx_block", 1, 1), ("text_item", 1, 0)]
    assert S.piece_rows(got).filter("item_kind = 'docx_block'").count() == 3
    assert S.split_items(items.limit(0), limits).count() == 0
