"""Alignment of the sentences of bilingual documents.

Method: numbers, dates, names, glossary terms and cognates shared by one sentence of either side only are
anchors; the longest increasing chain of anchors is kept; the gaps between them are aligned by dynamic
programming over 1-1, 1-2, 2-1, 1-3 and 3-1 steps and skips. Sentences left over (moved ones, and parts of
joined or divided ones) are then matched by their features wherever they stand.

The likeness of two groups of sentences is the share of their weighted features that have a partner on the
other side. Words have partners by a lexicon that is learned from the whole table first: sentences tied by a
number or a set of terms that is unique in their document are counted as translations, and words that occur
in such pairs together far more often than alone are partners.

Defined results: blank and null rows, rows without a document or place or on neither side give no link; equal
sentences are told apart by order; repeats under one ``sent_id`` count once. A long document is cut into
blocks of about ``BLOCK_ROWS`` rows a side between chained global anchors; rows that no block links are matched with
all others of the document. A stretch without anchors is one block, and the rows left over meet in one task.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.segment import told
from quire.session import cut_lineage
from quire.sources.tables import by_keys, spread

#: Rows a side that blocks of long documents aim at, and rows of their neighbours that they see.
BLOCK_ROWS, MARGIN = 400, 10
#: Glossaries travel as a closure up to this many terms.
MOST_TERMS = 200_000
#: Word pairs of the lexicon: least joint count and least Dice value.
LEAST_COUNT, LEAST_DICE = 2, 0.2
#: Entries of the lexicon that are sent to all tasks; a larger one is joined to the documents' words, with the same result.
MOST_SENT = 1_000_000
#: Rows of a gap beyond which the dynamic programming visits only the steps that can gain.
DENSE_ROWS = 40

NUMBER_WEIGHT, TERM_WEIGHT, UNKNOWN_WEIGHT, HAN_WEIGHT = 3.0, 2.0, 0.25, 0.5
NEED = 0.33
#: A sentence joins a group when this share of its weight has partners; pairs that alone fill a gap need WEAK.
PART_SHARE, WEAK = 0.45, 0.12

_MONTHS = {m.lower(): i % 12 + 1 for i, m in enumerate("January February March April May June July August September October November December Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())}
_MONTH = "|".join(_MONTHS)
_DATES = (
    (re.compile(r"(\d{4})\s*[年-]\s*(\d{1,2})\s*[月-]\s*(\d{1,2})\s*日?"), (1, 2, 3)),
    (re.compile(rf"(?i)\b(\d{{1,2}})\.?\s+({_MONTH})\s+(\d{{4}})"), (3, 2, 1)),
    (re.compile(rf"(?i)\b({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})"), (3, 1, 2)),
    (re.compile(r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"), (3, 2, 1)),
)
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_YEAR = re.compile(r"\d{4}")
_LATIN = re.compile(r"[a-zà-ɏ]{2,}")
_RUN = re.compile(r"[㐀-鿿぀-ヿー]+")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")


def number(text: str) -> str:
    """One form for 1,028.50, 1.028,50 and 1028.5."""
    parts = re.split(r"[.,]", text)
    if len(parts) > 1 and (len(parts[-1]) != 3 or (len(parts) > 2 and text.count(",") and text.count(".") and len(set(re.findall("[.,]", text))) > 1)):
        return "".join(parts[:-1]).lstrip("0").rjust(1, "0") + ("." + d if (d := parts[-1].rstrip("0")) else "")
    return "".join(parts).lstrip("0") or "0"


def _trie(words: list[str]) -> str:
    """A pattern of any of the words, the longest first, that reads every character once."""
    heads: dict[str, list[str]] = defaultdict(list)
    for w in words:
        heads[w[:1]].append(w[1:])
    ends = heads.pop("", None) is not None
    ways = [re.escape(c) + (_trie(rest) if rest != [""] else "") for c, rest in sorted(heads.items())]
    if not ways:
        return ""
    both = ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})"
    return both + ("?" if ends else "")


class Terms:
    """Glossary terms of all languages, found by one pattern."""

    def __init__(self, rows: list[tuple]):
        self.ids: dict[str, int] = {}
        for term_id, *forms in rows:
            for form in forms:
                if form and form.strip():
                    self.ids[form.strip().lower()] = int(term_id)
        whole, parts = ([f for f in self.ids if f[0].isascii() == ascii_] for ascii_ in (True, False))
        found = [rf"\b(?:{_trie(whole)})\b"] * bool(whole) + [_trie(parts)] * bool(parts)
        self.pattern = re.compile("|".join(found)) if found else None

    def take(self, text: str) -> tuple[list[str], str]:
        if self.pattern is None:
            return [], text
        found: list[str] = []

        def note(m: re.Match) -> str:
            found.append(f"t{self.ids[m.group()]}")
            return " | "

        return found, self.pattern.sub(note, text)


def _plain(text: str) -> str:
    return text.lower() if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()


def features(text: str, terms: Terms) -> tuple[list[str], list[str], list[str]]:
    """Numbers and dates, terms, and words (Latin words; pairs of Han and kana characters) of a sentence."""
    text = _plain(text)
    hard: list[str] = []
    for pattern, order in _DATES if _YEAR.search(text) else ():

        def note(m: re.Match, order=order) -> str:
            y, mo, d = (m.group(g) for g in order)
            hard.append(f"d{int(y)}-{_MONTHS.get(mo) or int(mo)}-{int(d)}")
            return " | "

        text = pattern.sub(note, text)
    found, text = terms.take(text)
    hard += ["n" + number(m) for m in _NUMBER.findall(text)]
    words = [w for w in _LATIN.findall(text)]
    for run in _RUN.findall(text):
        words += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
    return hard, found, words


class Sentence:
    __slots__ = ("row", "copy", "weight", "total")

    def __init__(self, row: int, text: str, terms: Terms, lexicon: "Lexicon", single: bool = False):
        hard, found, words = features(text, terms)
        self.row = row
        self.copy = "".join(_plain(text).split())
        self.weight: dict[str, float] = {}
        for f in hard:
            self.weight[f] = NUMBER_WEIGHT
        for f in found:
            self.weight[f] = TERM_WEIGHT
        for w in words:
            self.weight[w] = lexicon.weight(w)
        if single:  # both sides write Han: characters are cognates
            for w in {c for w in words for c in w if "㐀" <= c <= "鿿"}:
                self.weight["c" + w] = HAN_WEIGHT
        self.total = sum(self.weight.values())


class Lexicon:
    """Partners of words with their strength, and the weight of a word by its rarity."""

    def __init__(self, pairs: Iterable[tuple[str, str, float]], shares: dict[str, float]):
        self.partners: dict[str, dict[str, float]] = defaultdict(dict)
        same = {w: w for w in shares}  # a word is one object, however many partners it has
        for x, y, dice in pairs:
            x, y = same.setdefault(x, x), same.setdefault(y, y)
            self.partners[x][y] = max(dice, self.partners[x].get(y, 0.0))
            self.partners[y][x] = max(dice, self.partners[y].get(x, 0.0))
        self.shares = shares

    def weight(self, word: str) -> float:
        share = self.shares.get(word)
        return UNKNOWN_WEIGHT if share is None else min(2.0, 0.3 * -math.log(share + 1e-4))

    def best(self, word: str, others: dict[str, float]) -> float:
        if word in others:
            return 1.0
        known = self.partners.get(word)
        if not known:
            return 0.0
        few, many = (known, others) if len(known) < len(others) else (others, known)
        return min(1.0, 1.5 * max((known[y] for y in few if y in many), default=0.0))


def covered(a: dict[str, float], b: dict[str, float], lexicon: Lexicon) -> float:
    """Weight of the features of a that have a partner among those of b."""
    return sum(w * lexicon.best(f, b) for f, w in a.items())


class Pairs:
    """What the sentences of two texts share, counted once for the whole document and kept per pair that shares anything."""

    def __init__(self, src: list[Sentence], tgt: list[Sentence], lexicon: Lexicon):
        self.src, self.tgt, self.lexicon = src, tgt, lexicon
        self.of_src, self.of_tgt = covers(src, tgt, lexicon), covers(tgt, src, lexicon)
        self.copies: dict[str, list[int]] = defaultdict(list)
        for j, t in enumerate(tgt):
            self.copies[t.copy].append(j)

    def like(self, i: int, j: int) -> float:
        """Likeness of one sentence of either side."""
        a, b = self.src[i], self.tgt[j]
        if a.copy == b.copy:
            return 1.0
        total = a.total + b.total
        return (self.of_src[i].get(j, 0.0) + self.of_tgt[j].get(i, 0.0)) / total if total else 0.0

    def group(self, rows: list[int], columns: list[int]) -> float:
        """Likeness of groups, one of which is one sentence; every member of the other must have its part in it."""
        if len(rows) == len(columns) == 1:
            return self.like(rows[0], columns[0])
        one, many = (self.src[rows[0]], [self.tgt[j] for j in columns]) if len(rows) == 1 else (self.tgt[columns[0]], [self.src[i] for i in rows])
        if one.copy == "".join(s.copy for s in many):
            return 1.0
        if len(rows) == 1:
            poor = any(self.of_tgt[j].get(rows[0], 0.0) < PART_SHARE * self.tgt[j].total for j in columns)
        else:
            poor = any(self.of_src[i].get(columns[0], 0.0) < PART_SHARE * self.src[i].total for i in rows)
        if poor:
            return 0.0
        all_: dict[str, float] = {}
        for s in many:
            all_ |= s.weight
        total = one.total + sum(all_.values())
        return (covered(one.weight, all_, self.lexicon) + covered(all_, one.weight, self.lexicon)) / total if total else 0.0


def chain(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The longest strictly increasing chain of anchors, the heavier point first among equals."""
    points = sorted(points, key=lambda p: (p[0], -p[1], -p[2]))
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(points)
    for k, (_, j, _) in enumerate(points):
        pos = bisect_left(tails, j)
        if pos == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[pos], at[pos] = j, k
        back[k] = at[pos - 1] if pos else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(points[k])
        k = back[k]
    return out[::-1]


def anchors(p: Pairs) -> list[tuple[int, int, float]]:
    """Pairs that share a feature, or a whole text, which either side has once."""
    sides: list[dict[str, list[int]]] = [{}, {}]
    for side, sentences in zip(sides, (p.src, p.tgt), strict=True):
        for i, s in enumerate(sentences):
            for f, w in s.weight.items():
                if w >= 1.0:
                    side.setdefault(f, []).append(i)
            side.setdefault("=" + s.copy, []).append(i)
    votes = {(where[0], there[0]) for f, where in sides[0].items() if len(where) == 1 and (there := sides[1].get(f)) and len(there) == 1}
    found = [(i, j, like) for i, j in sorted(votes) if (like := p.like(i, j)) >= 0.4]
    best_i: dict[int, float] = {}
    best_j: dict[int, float] = {}
    for i, j, s in found:
        best_i[i], best_j[j] = max(s, best_i.get(i, 0)), max(s, best_j.get(j, 0))
    return [x for x in found if x[2] >= best_i[x[0]] and x[2] >= best_j[x[1]]]


STEPS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1))


def align_gap(p: Pairs, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int, int, int, float]]:
    """Dynamic programming over a gap; steps must be worth more than skipping their sentences."""
    m, n = i1 - i0, j1 - j0
    if not m or not n:
        return []
    if max(m, n) > DENSE_ROWS:
        return align_wide(p, i0, i1, j0, j1)
    best = [[0.0] * (n + 1) for _ in range(m + 1)]
    how: list[list[tuple | None]] = [[None] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if not i and not j:
                continue
            top, way = -1.0, None
            if i:
                top, way = best[i - 1][j], (1, 0, 0.0)
            if j and best[i][j - 1] > top:
                top, way = best[i][j - 1], (0, 1, 0.0)
            if i and j:
                for di, dj in STEPS:
                    if i >= di and j >= dj:
                        like = p.like(i0 + i - 1, j0 + j - 1) if di == dj else p.group(list(range(i0 + i - di, i0 + i)), list(range(j0 + j - dj, j0 + j)))
                        gain = (like - NEED) * (di + dj)
                        if gain > 0 and best[i - di][j - dj] + gain > top:
                            top, way = best[i - di][j - dj] + gain, (di, dj, like)
            best[i][j], how[i][j] = top, way
    out, i, j = [], m, n
    while i or j:
        di, dj, like = how[i][j]
        if like:
            out.append((i0 + i - di, i0 + i, j0 + j - dj, j0 + j, like))
        i, j = i - di, j - dj
    return out[::-1]


def align_wide(p: Pairs, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int, int, int, float]]:
    """The same optimum over a whole large gap, from the steps that gain alone; skipping is free.

    A sentence of a group needs PART_SHARE of its weight in the other side, which is one sentence, so pairs tell
    which groups can be. The best chain of steps comes from prefix maximums over the target's positions.
    """
    src, tgt, of_src, of_tgt = p.src, p.tgt, p.of_src, p.of_tgt
    m, n = i1 - i0, j1 - j0
    shared = [sorted(j for j in {*of_src[i], *p.copies.get(src[i].copy, ())} if j0 <= j < j1) for i in range(i0, i1)]
    steps: list[set[tuple[int, int, int]]] = [set() for _ in range(m + 1)]  # by their end in src: end in tgt and size
    for x, found_here in enumerate(shared):
        i = i0 + x
        for j in found_here:
            steps[x + 1].add((j - j0 + 1, 1, 1))
            for k in (2, 3):  # every group holds a pair that shares features, at any of its places
                for d in range(k):
                    if j0 <= (first := j - d) and first + k <= j1:
                        if all(of_tgt[y].get(i, 0.0) >= PART_SHARE * tgt[y].total for y in range(first, first + k)):
                            steps[x + 1].add((first + k - j0, 1, k))
                    if i0 <= (first := i - d) and first + k <= i1:
                        if all(of_src[y].get(j, 0.0) >= PART_SHARE * src[y].total for y in range(first, first + k)):
                            steps[first + k - i0].add((j - j0 + 1, k, 1))
    for one, many, turned in ((src[i0:i1], tgt[j0:j1], False), (tgt[j0:j1], src[i0:i1], True)):  # a text that is exactly two or three others
        whole: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(one):
            whole[s.copy].append(i)
        for k in (2, 3):
            for j in range(len(many) - k + 1):
                for i in whole.get("".join(t.copy for t in many[j : j + k]), ()):
                    if turned:
                        steps[j + k].add((i + 1, k, 1))
                    else:
                        steps[i + 1].add((j + k, 1, k))
    # tree of prefix maximums over positions in tgt; entries are (score, number of the last step of the chain)
    trees: list[tuple[float, int]] = [(0.0, -1)] * (n + 2)
    taken: list[tuple[int, int, int, int, float, int]] = []
    waiting: dict[int, list[tuple[int, float, int]]] = defaultdict(list)

    def before(j: int) -> tuple[float, int]:
        top, at = (0.0, -1), j + 1
        while at > 0:
            if trees[at][0] > top[0]:
                top = trees[at]
            at -= at & -at
        return top

    found: list[tuple[int, int, int, int, float]] = []
    for i in range(1, m + 1):
        for j, di, dj in steps[i]:
            like = p.group(list(range(i0 + i - di, i0 + i)), list(range(j0 + j - dj, j0 + j)))
            if like > NEED:
                found.append((i - di, i, j - dj, j, like))
    # in order of their start; chains that end at or before it are in the tree by then
    ends = sorted({f[1] for f in found})
    done = 0
    for a0, a1, b0, b1, like in sorted(found):
        upto = bisect_right(ends, a0)
        for end in ends[done:upto]:
            for at, score, no in waiting.pop(end, ()):
                at += 1
                while at <= n + 1:
                    if score > trees[at][0]:
                        trees[at] = (score, no)
                    at += at & -at
        done = max(done, upto)
        score, last = before(b0)
        taken.append((a0, a1, b0, b1, like, last))
        waiting[a1].append((b1, score + (like - NEED) * (a1 - a0 + b1 - b0), len(taken) - 1))
    for held in waiting.values():
        for at, score, no in held:
            at += 1
            while at <= n + 1:
                if score > trees[at][0]:
                    trees[at] = (score, no)
                at += at & -at
    out, no = [], before(n)[1]
    while no >= 0:
        a0, a1, b0, b1, like, no = taken[no]
        out.append((i0 + a0, i0 + a1, j0 + b0, j0 + b1, like))
    return out[::-1]


def align(src: list[Sentence], tgt: list[Sentence], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """Linked positions with their likeness."""
    p = Pairs(src, tgt, lexicon)
    fixed = chain(anchors(p))
    links: dict[tuple[int, int], float] = {}
    a = b = 0
    for i, j, sure in [*(x for x in fixed if x[2] >= 0.75), (len(src), len(tgt), 0.0)]:
        for i0, i1, j0, j1, like in align_gap(p, a, i, b, j):
            for x in range(i0, i1):
                for y in range(j0, j1):
                    links[(x, y)] = like
        if i < len(src) and j < len(tgt):
            links[(i, j)] = sure
        a, b = i + 1, j + 1
    leftovers(p, links)
    fill(p, links)
    return [(i, j, s) for (i, j), s in links.items()]


def fill(p: Pairs, links: dict[tuple[int, int], float]) -> None:
    """A sentence of either side that alone stands between two linked neighbours is a weak pair, if no number speaks against it."""
    of_i = {i: j for i, j in sorted(links)}
    linked_j = {j for _, j in links}
    for i, s in enumerate(p.src):
        if i in of_i:
            continue
        before = of_i.get(i - 1, -1 if i == 0 else None)
        after = of_i.get(i + 1, len(p.tgt) if i == len(p.src) - 1 else None)
        if before is None or after is None or after - before != 2 or before + 1 in linked_j:
            continue
        t = p.tgt[before + 1]
        hard = {f for f in s.weight.keys() ^ t.weight.keys() if f[0] in "nd" and f[1:2].isdigit()}
        like = p.like(i, before + 1)
        if not hard and like >= WEAK:
            links[(i, before + 1)] = like
            linked_j.add(before + 1)


def covers(a: list[Sentence], b: list[Sentence], lexicon: Lexicon) -> list[dict[int, float]]:
    """What ``covered`` gives for each of a with each of b that shares a feature, from an index over b."""
    index: dict[str, list[int]] = defaultdict(list)
    for j, t in enumerate(b):
        for f in t.weight:
            index[f].append(j)
    known: dict[str, list[tuple[int, float]]] = {}

    def partners(f: str) -> list[tuple[int, float]]:
        found: dict[int, float] = {}
        for g, dice in lexicon.partners.get(f, {}).items():
            v = min(1.0, 1.5 * dice)
            for j in index.get(g, ()):
                if v > found.get(j, 0.0):
                    found[j] = v
        for j in index.get(f, ()):
            found[j] = 1.0
        known[f] = here = list(found.items())
        return here

    out = []
    for s in a:
        sums: dict[int, float] = defaultdict(float)
        for f, w in s.weight.items():
            for j, v in known[f] if f in known else partners(f):
                sums[j] += w * v
        out.append(sums)
    return out


def leftovers(p: Pairs, links: dict[tuple[int, int], float]) -> None:
    """Moved sentences, then parts of joined or divided ones, found through the features they share."""
    src, tgt, of_src, of_tgt = p.src, p.tgt, p.of_src, p.of_tgt
    free_i = {i for i in range(len(src))} - {i for i, _ in links}
    free_j = {j for j in range(len(tgt))} - {j for _, j in links}
    if not free_i and not free_j:
        return
    pairs = [(1.0, i, j) for i in sorted(free_i) for j in p.copies.get(src[i].copy, ()) if j in free_j]
    pairs += [(like, i, j) for i in sorted(free_i) for j in of_src[i] if j in free_j and src[i].copy != tgt[j].copy and (like := p.like(i, j)) >= 0.5]
    for like, i, j in sorted(pairs, reverse=True):
        if i in free_i and j in free_j:
            links[(i, j)] = like
            free_i.discard(i)
            free_j.discard(j)
    of_i, of_j = defaultdict(set), defaultdict(set)
    for i, j in links:
        of_i[i].add(j)
        of_j[j].add(i)
    parts = [(share, i, j) for i in free_i for j, c in of_src[i].items() if j not in free_j and (share := c / src[i].total) >= 0.6]
    parts += [(share, i, j) for j in free_j for i, c in of_tgt[j].items() if i not in free_i and (share := c / tgt[j].total) >= 0.6]
    for share, i, j in sorted(parts, reverse=True):
        if i not in free_i and j not in free_j:
            continue
        if i in free_i:
            before, after = (p.group(sorted(rows), [j]) for rows in (of_j[j], of_j[j] | {i}))
        else:
            before, after = (p.group([i], sorted(columns)) for columns in (of_i[i], of_i[i] | {j}))
        if after > before + 0.03:
            links[(i, j)] = share
            of_i[i].add(j)
            of_j[j].add(i)
            free_i.discard(i)
            free_j.discard(j)


def match_rest(src: list[Sentence], tgt: list[Sentence], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    links: dict[tuple[int, int], float] = {}
    leftovers(Pairs(src, tgt, lexicon), links)
    return [(i, j, s) for (i, j), s in links.items()]


def clean_rows(sentences: DataFrame) -> DataFrame:
    """Rows that can take part; repeats are merged where they are grouped anyway."""
    text = F.col("source_text")
    return sentences.select("doc_key", F.lower(F.trim("side")).alias("side"), "lang", "idx", "sent_id", text.alias("text")).filter(
        F.col("doc_key").isNotNull() & F.col("sent_id").isNotNull() & F.col("idx").isNotNull() & F.col("side").isin("src", "tgt") & text.isNotNull() & text.rlike(r"(?U)[^\s​﻿]")
    )


def _glossary(glossary: DataFrame) -> list[tuple]:
    rows = glossary.select("term_id", "term_en", "term_zh", "term_de", "term_ja").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the glossary has more than {MOST_TERMS} terms")
    return [tuple(r) for r in rows]


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join in which no side may be broadcast. Spark takes a list for one entry, so a side made by ``explode``
    is many times its estimate, and would be sent through the driver."""
    return df.hint("merge")


def learn(rows: DataFrame, terms: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The lexicon of the whole table: pairs ``x, y, dice`` and words ``w, share``.

    Every key (a number, date or set of terms of a sentence) that either side of a document has once ties two
    sentences. Keys are grouped by document and key, so no document meets in one task; counts are combined
    before the shuffle. Words are counted first, and only those are paired whose counts allow the least Dice value.
    """
    made: list[Terms] = []

    @F.pandas_udf("struct<keys:array<string>,words:array<string>,class:string>")
    def read(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Terms(terms))
        out = []
        for t, lang in zip(texts, langs, strict=True):
            hard, found, words = features(t, made[0])
            keys = sorted(set(hard)) + (["s" + ",".join(sorted(set(found)))] if found else [])
            out.append((keys, sorted(set(words)), told(t, lang)))
        return pd.DataFrame(out, columns=["keys", "words", "class"])

    # a text that only repeats under its id gives each of its keys once; max keeps that
    read_rows = rows.select("doc_key", "side", "sent_id", read("text", "lang").alias("r")).select("doc_key", "side", "sent_id", F.explode("r.keys").alias("key"), "r.words", "r.class")
    src, tgt = F.col("side") == "src", F.col("side") == "tgt"
    one = lambda c: (F.min(F.when(c, F.col("sent_id"))), F.max(F.when(c, F.col("sent_id"))))
    tied = (
        read_rows.groupBy("doc_key", "key")
        .agg(
            *(x.alias(n) for x, n in zip([*one(src), *one(tgt)], ["s0", "s1", "t0", "t1"], strict=True)),
            F.max(F.when(src, F.struct("words", "class"))).alias("a"),
            F.max(F.when(tgt, F.struct("words", "class"))).alias("b"),
        )
        .filter((F.col("s0") == F.col("s1")) & (F.col("t0") == F.col("t1")) & (F.col("a.class") != F.col("b.class")))
    )
    links = tied.groupBy("s0", "t0").agg(F.max("a").alias("a"), F.max("b").alias("b")).select("s0", "t0", F.concat_ws("-", F.array_sort(F.array("a.class", "b.class"))).alias("kind"), F.col("a.words").alias("x"), F.col("b.words").alias("y"))
    links = cut_lineage(links)
    total = links.groupBy("kind").agg(F.count("*").alias("n"))
    single = links.select("kind", F.explode(F.array_distinct(F.concat("x", "y"))).alias("w")).groupBy("kind", "w").agg(F.count("*").alias("c")).filter(F.col("c") >= LEAST_COUNT)
    single = cut_lineage(single)
    sided = links.select("s0", "t0", "kind", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("x").alias("ws")), F.struct(F.lit(False).alias("left"), F.col("y").alias("ws")))).alias("s")).select("s0", "t0", "kind", "s.left", F.explode("s.ws").alias("w"))
    word = F.struct("w", "c")
    counted = sided.join(shuffled(single), ["kind", "w"]).groupBy("s0", "t0", "kind").agg(F.collect_list(F.when(F.col("left"), word)).alias("x"), F.collect_list(F.when(~F.col("left"), word)).alias("y"))
    pairs = counted.select("kind", F.explode("x").alias("x"), "y").select("kind", "x", F.explode("y").alias("y"))
    # no pair is together more often than the rarer of its words is seen
    may = (F.col("x.w") != F.col("y.w")) & (2 * F.least("x.c", "y.c") >= LEAST_DICE * (F.col("x.c") + F.col("y.c")))
    pairs = pairs.filter(may).select("kind", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).groupBy("kind", "x", "y").agg(F.count("*").alias("c"))
    dice = 2 * F.col("c") / (F.col("x.c") + F.col("y.c"))
    found = pairs.filter((F.col("c") >= LEAST_COUNT) & (dice >= LEAST_DICE)).groupBy(F.col("x.w").alias("x"), F.col("y.w").alias("y")).agg(F.max(dice).alias("dice"))
    share = single.join(F.broadcast(total), "kind").groupBy("w").agg(F.max(F.col("c") / F.col("n")).alias("share"))  # a row per pair of languages is sent
    return cut_lineage(found), cut_lineage(share)


def packed(df: DataFrame) -> list[bytes]:
    """Rows as compressed Arrow streams, which the tasks make: the driver holds these bytes, never the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"part": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return [bytes(r["part"]) for r in df.mapInArrow(pack, "part binary").collect()]


def unpacked(parts: list[bytes]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(c.to_pylist() for c in pa.ipc.open_stream(part).read_all().columns), strict=True)


def sent_lexicon(found: DataFrame, share: DataFrame) -> tuple[list[bytes], list[bytes]] | None:
    """The lexicon where it is small enough to be sent, packed by the tasks and unpacked by those that align."""
    if found.count() > MOST_SENT or share.count() > MOST_SENT:
        return None
    return packed(found.select("x", "y", "dice")), packed(share.select("w", "share"))


def entries(placed: DataFrame, found: DataFrame, share: DataFrame, terms: list[tuple]) -> DataFrame:
    """What the lexicon says about the words of every block: ``d, b`` (document, block), ``w, share, partners``."""
    made: list[Terms] = []

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Terms(terms))
        return pd.Series([sorted(set(features(t, made[0])[2])) for t in texts])

    both = found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"), "dice"))
    partners = both.groupBy(F.col("x").alias("w")).agg(F.collect_list(F.struct("y", "dice")).alias("partners"))
    known = share.join(partners, "w", "full_outer")
    here = placed.select(F.col("doc_key").alias("d"), F.col("block").alias("b"), F.explode(words.asNondeterministic()("text")).alias("w")).distinct()
    return here.join(shuffled(known), "w")


LINKS = "doc_key string, src_id bigint, tgt_id bigint, src_idx int, tgt_idx int, score double"


def align_documents(sentences: DataFrame, glossary: DataFrame) -> DataFrame:
    """One row per pair of rows that carry the same statement, with a score from 0 to 1."""
    rows = spread(clean_rows(sentences))
    terms = _glossary(glossary)
    found, share = learn(rows, terms)
    small = sent_lexicon(found, share)
    sent = rows.sparkSession.sparkContext.broadcast(small)
    made: list[tuple[Terms, Lexicon]] = []

    def matched(group: pd.DataFrame, how, about: pd.DataFrame | None = None) -> pd.DataFrame:
        if not made:
            pairs, words = sent.value or ([], [])
            made.append((Terms(terms), Lexicon(unpacked(pairs), dict(unpacked(words)))))
        known, lexicon = made[0]
        if about is not None:
            pairs = [(w, p["y"], p["dice"]) for w, ps in zip(about["w"], about["partners"], strict=True) if ps is not None for p in ps]
            lexicon = Lexicon(pairs, {w: x for w, x in zip(about["w"], about["share"], strict=True) if x == x and x is not None})
        group = group.drop_duplicates("sent_id").sort_values(["idx", "sent_id"], kind="mergesort").reset_index(drop=True)
        sides: dict[str, list[int]] = {"src": [], "tgt": []}
        columns = {c: group[c].tolist() for c in ("side", "text", "sent_id", "idx", "core", "doc_key")}
        for r, side in enumerate(columns["side"]):
            sides[side].append(r)
        texts, ids, places = columns["text"], columns["sent_id"], columns["idx"]
        han = all(any(_RUN.search(texts[r]) for r in rows) for rows in sides.values())
        src, tgt = ([Sentence(r, texts[r], known, lexicon, han) for r in sides[side]] for side in ("src", "tgt"))
        out = []
        for i, j, score in how(src, tgt, lexicon):
            a, b = src[i].row, tgt[j].row
            if columns["core"][a]:
                out.append((columns["doc_key"][a], int(ids[a]), int(ids[b]), int(places[a]), int(places[b]), float(round(score, 4))))
        return pd.DataFrame(out, columns=["doc_key", "src_id", "tgt_id", "src_idx", "tgt_idx", "score"])

    def each(placed: DataFrame, how) -> DataFrame:
        """``how`` over every block, with the lexicon that was sent or with what it says about the block's words."""
        keys = ["doc_key", "block"]
        if small is not None:

            def run(group: pd.DataFrame) -> pd.DataFrame:
                return matched(group, how)

            return by_keys(placed, *keys).groupBy(*keys).applyInPandas(run, LINKS)

        def run_with(group: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
            return matched(group, how, about) if len(group) else pd.DataFrame(columns=["doc_key", "src_id", "tgt_id", "src_idx", "tgt_idx", "score"])

        return placed.groupBy(*keys).cogroup(entries(placed, found, share, terms).groupBy("d", "b")).applyInPandas(run_with, LINKS)

    sizes = rows.groupBy("doc_key", "side").agg(F.min("idx").alias("a"), (F.max("idx") + 1).alias("b"))
    side = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    sizes = sizes.groupBy("doc_key").agg(side("src", "a").alias("s_from"), side("src", "b").alias("s_to"), side("tgt", "a").alias("t_from"), side("tgt", "b").alias("t_to"))
    long = cut_lineage(sizes.filter(F.greatest(F.col("s_to") - F.col("s_from"), F.col("t_to") - F.col("t_from")) > BLOCK_ROWS).dropna())
    whole = rows.join(F.broadcast(long.select("doc_key")), "doc_key", "left_anti") if (any_long := not long.isEmpty()) else rows
    whole = whole.withColumn("block", F.lit(0)).withColumn("core", F.lit(True))
    if not any_long:
        return each(whole, align)
    parts = cut_lineage(rows.join(F.broadcast(long.select("doc_key")), "doc_key"))
    placed = whole.unionByName(in_blocks(parts, blocks(parts, long, terms)))
    links = cut_lineage(each(placed, align))
    # what no block linked meets all other such rows of its document
    linked = links.select("doc_key", F.explode(F.array("src_id", "tgt_id")).alias("sent_id")).distinct()
    free = parts.join(shuffled(linked), ["doc_key", "sent_id"], "left_anti").withColumn("core", F.lit(True)).withColumn("block", F.lit(-1))
    return links.unionByName(each(free, match_rest))


def blocks(rows: DataFrame, long: DataFrame, terms: list[tuple]) -> DataFrame:
    """Matching stretches of both sides of long documents, cut at chained global anchors.

    Anchors are the keys that either side of the document has once; only their places meet in one task. Where a
    stretch has none, it stays whole, whatever its length.
    """
    made: list[Terms] = []

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Terms(terms))
        out = []
        for t in texts:
            hard, found, _ = features(t, made[0])
            out.append(sorted(set(hard)) + (["s" + ",".join(sorted(set(found)))] if found else []))
        return pd.Series(out)

    of = lambda f, name, c: f(F.when(F.col("side") == name, F.col(c)))
    tied = rows.select("doc_key", "side", "sent_id", "idx", F.explode(keys.asNondeterministic()("text")).alias("key")).groupBy("doc_key", "key")
    tied = tied.agg(*(of(f, name, "sent_id").alias(n) for n, f, name in (("s0", F.min, "src"), ("s1", F.max, "src"), ("t0", F.min, "tgt"), ("t1", F.max, "tgt"))), of(F.min, "src", "idx").alias("i"), of(F.min, "tgt", "idx").alias("j"))
    points = tied.filter((F.col("s0") == F.col("s1")) & (F.col("t0") == F.col("t1"))).select("doc_key", "i", "j").distinct()

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        _, _, _, *ends = g.iloc[0][["doc_key", "i", "j", "s_from", "s_to", "t_from", "t_to"]]
        s_from, s_to, t_from, t_to = (int(x) for x in ends)
        known = g.dropna(subset=["i", "j"])
        fixed = [(i, j) for i, j, _ in chain([(int(i), int(j), 1.0) for i, j in zip(known["i"], known["j"], strict=True)])]
        cuts, last = [(s_from, t_from)], None
        for i, j in [*fixed, (s_to, t_to)]:
            if max(i - cuts[-1][0], j - cuts[-1][1]) > BLOCK_ROWS and last:
                cuts.append(last)
            last = (i, j) if (i, j) > cuts[-1] else None
        cuts.append((s_to, t_to))
        out = []
        for no, ((i0, j0), (i1, j1)) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out += [(g["doc_key"].iloc[0], side, no, lo, hi) for side, lo, hi in (("src", i0, i1), ("tgt", j0, j1))]
        return pd.DataFrame(out, columns=["doc_key", "side", "block", "lo", "hi"])

    return long.join(shuffled(points), "doc_key", "left").groupBy("doc_key").applyInPandas(cut, "doc_key string, side string, block int, lo int, hi int")


def in_blocks(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with their block and, not as its core, a margin of its neighbours; joined by bins of places."""
    bins = F.sequence(F.floor((F.col("lo") - MARGIN) / BLOCK_ROWS), F.floor((F.col("hi") + MARGIN) / BLOCK_ROWS))
    binned = cuts.withColumn("bin", F.explode(bins))
    found = rows.withColumn("bin", F.floor(F.col("idx") / BLOCK_ROWS)).join(shuffled(binned), ["doc_key", "side", "bin"])
    found = found.filter((F.col("idx") >= F.col("lo") - MARGIN) & (F.col("idx") < F.col("hi") + MARGIN))
    core = (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))
    return found.select(*rows.columns, "block", core.alias("core"))
