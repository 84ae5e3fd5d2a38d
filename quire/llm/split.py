"""Splitting oversized texts at natural boundaries, with a stated overlap.

Method: lexical-cohesion segmentation. Similarity of the blocks of sentences on either side of every
sentence gap is taken with two sliding bags of terms; valleys of that curve mark topic boundaries. In each
window of permitted sizes the piece ends at the deepest valley; where the window has no sentence gap, at
the last clause mark, then white space, then a mark inside a run of characters, and only in an unbroken stretch between two characters (never
inside a cluster of combining marks or joined emoji).

Defined results: null texts, blank texts and those within the limit give no piece; a limit of null gives
none; repeated rows give the same pieces. Pieces are ``[start, end)`` code points, at most ``max_chars``
long; each after the first begins ``overlap_chars`` before the end of the one before it, so the pieces
without their overlaps are the whole text. An overlap of ``max_chars`` or more counts as ``max_chars - 1``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences in the block on either side of a gap.
BLOCK = 5

#: Limit tables beyond this are joined without a broadcast.
BROADCAST_ROWS = 100_000

_SENTENCE = re.compile(r"[.!?](?=[\"'”’)\]]*\s)[\"'”’)\]]*|[。！？｡]+[”’」』）】》]*|(?:\r\n|[\n\r\f\v\x85  ])+")
_PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}|<page_break\s*/>\s*|\f")
_CLAUSE = re.compile(r"[；，、：。！？]|[;,:.!?](?=\s)")
_MARK = re.compile(r"[;,:.!?]")
_SPACE = re.compile(r"\s+")
_TERM = re.compile(r"[A-Za-zÀ-ɏ]{3,}|[฀-๿ऀ-ॿ؀-ۿ]{3,}|[㐀-鿿]|[゠-ヿ]{2,}")
#: The marks that, beside white space, break a stretch.
_STRETCH = re.compile(r"[^\s.!?。！？;；,，、]+")


def longest_stretch(text: str) -> int:
    return max((m.end() - m.start() for m in _STRETCH.finditer(text)), default=0)


def _terms(text: str) -> Counter:
    found = [t.lower() for t in _TERM.findall(text)]
    return Counter(found) + Counter(a + b for a, b in zip(found, found[1:], strict=False) if len(a) == len(b) == 1)


def _cosine(dot: float, a: float, b: float) -> float:
    return dot / sqrt(a * b) if a > 0 and b > 0 else 0.0


def valley_depths(text: str, gaps: list[int]) -> list[float]:
    """Depth of the cohesion valley at each gap; the bags slide, so the cost is linear in the text."""
    if not gaps:
        return []
    bags = [_terms(text[a:b]) for a, b in zip([0, *gaps], [*gaps, len(text)], strict=True)]
    left, right = Counter(), Counter()
    dot = a2 = b2 = 0.0

    def shift(bag: Counter, other: Counter, terms: Counter, sign: int) -> tuple[float, float]:
        """Change of the bag's square sum and of the dot product."""
        square = change = 0.0
        for t, n in terms.items():
            before = bag[t]
            bag[t] = before + sign * n
            square += bag[t] ** 2 - before**2
            change += sign * n * other[t]
            if not bag[t]:
                del bag[t]
        return square, change

    similar = []
    for bag in bags[1 : BLOCK + 1]:
        s, c = shift(right, left, bag, 1)
        b2, dot = b2 + s, dot + c
    for i in range(len(gaps)):
        s, c = shift(left, right, bags[i], 1)
        a2, dot = a2 + s, dot + c
        if i >= BLOCK:
            s, c = shift(left, right, bags[i - BLOCK], -1)
            a2, dot = a2 + s, dot + c
        if i:
            s, c = shift(right, left, bags[i], -1)
            b2, dot = b2 + s, dot + c
            if i + BLOCK < len(bags):
                s, c = shift(right, left, bags[i + BLOCK], 1)
                b2, dot = b2 + s, dot + c
        similar.append(_cosine(dot, a2, b2))
    peaks_left, peaks_right = similar[:], similar[:]
    for i in range(1, len(similar)):  # climb while the curve rises
        if similar[i - 1] >= similar[i]:
            peaks_left[i] = max(similar[i], peaks_left[i - 1])
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            peaks_right[i] = max(similar[i], peaks_right[i + 1])
    return [max(0.0, p - s) + max(0.0, q - s) for p, q, s in zip(peaks_left, peaks_right, similar, strict=True)]


def _whole_character(text: str, at: int, least: int) -> int:
    """The last position up to ``at`` that doesn't part a cluster; ``at`` itself if there is none after ``least``."""
    pos = at
    while pos > least:
        c, before = text[pos] if pos < len(text) else "", text[pos - 1]
        joined = c and (unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "‍️︎" or "\U0001f3fb" <= c <= "\U0001f3ff")
        pair = c and before == "\r" and c == "\n"
        flags = c and "\U0001f1e6" <= c <= "\U0001f1ff" and "\U0001f1e6" <= before <= "\U0001f1ff"
        if not (joined or pair or flags or before == "‍"):
            return pos
        pos -= 1
    return at


def cuts(text: str, most: int, overlap: int) -> list[int]:
    """End positions of the pieces."""
    most = max(1, most)
    overlap = min(max(0, overlap), most - 1)
    paragraphs = {m.end() for m in _PARAGRAPH.finditer(text)}
    gaps = sorted({m.end() + len(_SPACE.match(text, m.end()).group() if _SPACE.match(text, m.end()) else "") for m in _SENTENCE.finditer(text)} | paragraphs)
    gaps = [g for g in gaps if 0 < g < len(text)]
    depths = valley_depths(text, gaps)
    ends, done, g = [], 0, 0
    while True:
        room = most if not ends else most - overlap
        if len(text) - done <= room:
            return [*ends, len(text)]
        top = done + room
        while g < len(gaps) and gaps[g] <= done:
            g += 1
        window = []
        k = g
        while k < len(gaps) and gaps[k] <= top:
            window.append(k)
            k += 1
        late = [k for k in window if gaps[k] >= done + room // 2] or window
        if late:
            cut = gaps[max(late, key=lambda k: (depths[k] + (0.1 if gaps[k] in paragraphs else 0.0), gaps[k]))]
        else:
            cut = 0
            for pattern in (_CLAUSE, _SPACE, _MARK):
                for m in pattern.finditer(text, done + 1, top):
                    cut = m.end()
                if cut:
                    break
            cut = cut or _whole_character(text, top, done + 1)
        ends.append(cut)
        done = cut


def pieces(text: str | None, most: int | None, overlap: int | None) -> list[tuple[int, int]]:
    if text is None or most is None or len(text) <= most or not text.strip():
        return []
    back = min(max(0, overlap or 0), max(1, most) - 1)
    ends = cuts(text, most, back)
    return [(max(0, start - back) if i else 0, end) for i, (start, end) in enumerate(zip([0, *ends], ends, strict=False))]


def with_limits(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items with ``max_chars`` and ``overlap_chars`` of their kind and, without case and outer blanks, source type."""
    kind = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
    small = limits.select(F.col("item_kind").alias("lk"), kind(F.col("source_type")).alias("ls"), "max_chars", "overlap_chars")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return items.join(small, (F.col("item_kind") == F.col("lk")) & kind(F.col("source_type")).eqNullSafe(F.col("ls"))).drop("lk", "ls")


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Per oversized item, once: its pieces as ``array<struct<start,end>>`` and ``has_unbroken``.

    ``items``: ``item_kind, item_id, source_type, text``. Items within their limit never reach Python; the
    texts aren't shuffled, only keys and positions are, to merge repeats.
    """

    @F.pandas_udf("struct<pieces:array<struct<start:int,end:int>>,has_unbroken:int>")
    def cut(texts: pd.Series, most: pd.Series, overlap: pd.Series) -> pd.DataFrame:
        rows = [([{"start": a, "end": b} for a, b in pieces(t, int(m), int(o))], int(longest_stretch(t) > m)) for t, m, o in zip(texts, most, overlap, strict=True)]
        return pd.DataFrame(rows, columns=["pieces", "has_unbroken"])

    large = with_limits(items, limits).filter(F.length("text") > F.col("max_chars"))
    found = large.select("item_kind", "item_id", cut.asNondeterministic()("text", "max_chars", F.coalesce("overlap_chars", F.lit(0))).alias("c"))
    return found.select("item_kind", "item_id", "c.pieces", "c.has_unbroken").dropDuplicates(["item_kind", "item_id"])


def piece_rows(split: DataFrame) -> DataFrame:
    rows = split.select("item_kind", "item_id", F.posexplode("pieces").alias("piece_no", "p"))
    return rows.select("item_kind", "item_id", "piece_no", F.col("p.start").alias("piece_start"), F.col("p.end").alias("piece_end"))
