"""Operators whose state depends on what they emitted before: folds over bounded groups.

Documents are folded whole, one in a task, as what a fold holds goes on to the end of the document. Recordings are
folded by islands between silences that no subtitle crosses.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.measure import let
from quire.operators.relational import silence_islands
from quire.sources.tables import by_keys

#: Positions of one block.
BLOCK_ROWS = 2000

# Sentences per request and their characters.
GROUP_ITEMS, GROUP_CHARS = 15, 3000


def pack_sentences(rows: DataFrame, items: int = GROUP_ITEMS, chars: int = GROUP_CHARS) -> DataFrame:
    """Greedy groups of consecutive sentences, closed before they pass a number of items or characters.

    ``rows``: ``doc_key, side, idx, n`` (characters). A sentence larger than the limit is a group alone. Groups are
    numbered over a side of the document, and run on over ``block``, which only tells where a row stands.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx").reset_index(drop=True)
        no, count, size, out = 0, 0, 0, []
        for n in g["n"]:
            if count and (count >= items or size + n > chars):
                no, count, size = no + 1, 0, 0
            count, size = count + 1, size + n
            out.append(no)
        g["group_no"] = pd.Series(out, dtype="int32")
        return g[["doc_key", "side", "block", "idx", "group_no"]]

    placed = rows.withColumn("block", F.floor(F.col("idx") / BLOCK_ROWS).cast("int"))
    return by_keys(placed, "doc_key", "side").groupBy("doc_key", "side").applyInPandas(run, "doc_key string, side string, block int, idx int, group_no int")


# What a page mark and a paragraph mark are counted as.
PAGE_COST, PARAGRAPH_COST, PAGE_MARK = 20, 2, "<page_break/>"


def chunk_spans(text: str, budget: int) -> list[str]:
    """Chunks of whole pages with their marks between them; pages beyond the budget by paragraphs, which are never cut."""

    def packed(parts: list[str], cost: int, mark: str, held: str) -> tuple[list[str], str]:
        done = []
        for part in parts:
            if len(held) + len(part) + cost <= budget:
                held = f"{held}{mark}{part}" if held else part
            else:
                done += [held] if held else []
                held = part
        return done, held

    out, held = [], ""
    for page in filter(None, map(str.strip, text.split(PAGE_MARK))):
        done, held = packed([page], PAGE_COST, f"\n\n{PAGE_MARK}\n\n", held)
        out += done
        if held == page and len(page) > budget:
            done, held = packed(page.split("\n\n"), PARAGRAPH_COST, "\n\n", "")
            out += done
    return ([*out, held] if held else out) or [text]


def chunk_text(text: Column, budget: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunk_spans(t, budget) for t in texts])

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return run.asNondeterministic()(text)


def weak_windows(links: DataFrame, budget: int = 12, most_score: float = 0.55) -> DataFrame:
    """Runs of weak links that follow each other, cut after the link that fills ``budget`` units; a link has one source unit at least.

    ``links``: ``doc_key, link_id, src_start, src_end, tgt_start, tgt_end, score, low_confidence``.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["src_start", "tgt_start", "link_id"])
        out, current = [], None
        for weak, a, b, x, y in zip(g["weak"], g["src_start"], g["src_end"], g["tgt_start"], g["tgt_end"], strict=True):
            if not weak:
                current = None
                continue
            if current is None:
                current = [g["doc_key"].iloc[0], a, b, x, y, 0, 0]
                out.append(current)
            current[2], current[4] = max(current[2], b), max(current[4], y)
            current[5] += 1
            current[6] += max(b - a, 1) + max(y - x, 0)
            if current[6] >= budget:
                current = None
        return pd.DataFrame(out, columns=["doc_key", "src_start", "src_end", "tgt_start", "tgt_end", "links", "units"])

    weak = F.coalesce("low_confidence", F.lit(False)) | F.coalesce(F.col("score") < most_score, F.lit(True))
    placed = links.select("doc_key", "link_id", "src_start", "src_end", "tgt_start", "tgt_end", weak.alias("weak"))
    return by_keys(placed, "doc_key").groupBy("doc_key").applyInPandas(run, "doc_key string, src_start int, src_end int, tgt_start int, tgt_end int, links int, units int")


# Limits of a subtitle in seconds and units, and the marks that end it or may.
MOST_S, MOST_UNITS, SOFT_UNITS = 6.0, 42, 28
#: A pause ends a segment if it is that long and the segment has that duration and those units.
PAUSES = ((0.35, 1.4, 10), (0.7, 0.8, 8))
STOP_S, SOFT_S, BACK_S, SHORT_S = 0.8, 2.5, 1.2, 1.2
STOPS, SOFTS = "。！？!?．.", "，,；;：:、"
#: Words without a word for so long before them begin a new island; subtitles never run over such a silence.
SILENCE_S = MOST_S
_WIDE = re.compile("[ᄀ-ᇿ⺀-鿿가-힯豈-﫿＀-￯]")


def join_words(words: list[str]) -> str:
    """Words with blanks between them, but none beside CJK characters or before punctuation."""
    out = ""
    for w in words:
        if out and not (_WIDE.match(out[-1]) or _WIDE.match(w[:1]) or re.match(r"[,.;:!?，。；：！？、)）\]]", w)):
            out += " "
        out += w
    return out


def units(text: str) -> int:
    return sum(2 if _WIDE.match(c) else 1 for c in text if not c.isspace())


def segments(words: list[tuple[float, float, str, int]]) -> list[list]:
    """``[start, stop, text, words, channel]`` of timed words ``(start, stop, word, channel)`` in order of their times.

    A segment ends before a long pause or another channel, after a word with an end mark, after a soft mark once it is long
    enough, and when it is full: then behind its last soft mark, if that leaves enough, else as a whole. Short ones join the
    one before them where both fit; no segment begins before the one before it has ended.
    """
    out: list[list] = []
    held: list[tuple[float, float, str, int]] = []

    def span(part) -> float:
        return max(w[1] for w in part) - part[0][0]

    def close(n: int) -> None:
        part = held[:n]
        del held[:n]
        if text := join_words([w[2] for w in part]):
            start, stop = max(0.0, part[0][0]), max(w[1] for w in part)
            out.append([round(start, 3), round(stop if stop > start else start + 0.2, 3), text, len(part), part[0][3]])

    for word in words:
        if held:
            pause, long_, full = max(0.0, word[0] - max(w[1] for w in held)), span(held), units(join_words([w[2] for w in held]))
            if word[3] != held[0][3] or any(pause >= p and long_ >= s and full >= u for p, s, u in PAUSES):
                close(len(held))
        held.append(word)
        long_, full, mark = span(held), units(join_words([w[2] for w in held])), word[2].rstrip()[-1:]
        if mark and (mark in STOPS and long_ >= STOP_S or mark in SOFTS and long_ >= SOFT_S and full >= SOFT_UNITS):
            close(len(held))
        elif long_ >= MOST_S or full >= MOST_UNITS:
            backs = [k + 1 for k, w in enumerate(held[:-1]) if w[2].rstrip()[-1:] in SOFTS and w[2].strip() and span(held[: k + 1]) >= BACK_S]
            close(backs[-1] if backs else len(held))
    close(len(held))
    joined: list[list] = []
    for s in out:
        if joined:
            last = joined[-1]
            text = join_words([last[2], s[2]])
            if s[1] - s[0] < SHORT_S and last[2][-1] not in STOPS and s[0] - last[1] <= SHORT_S and s[1] - last[0] <= MOST_S and units(text) <= MOST_UNITS:
                joined[-1] = [last[0], s[1], text, last[3] + s[3], last[4]]
                continue
        joined.append(s)
    for i, s in enumerate(joined):
        s[0] = max(s[0], joined[i - 1][1]) if i else s[0]
        if s[1] <= s[0]:
            s[1] = round(max(s[0] + 0.05, joined[i + 1][0] if i + 1 < len(joined) else s[0] + 0.2), 3)
    return joined


def subtitles(words: DataFrame) -> DataFrame:
    """Subtitle segments of timed words, by :func:`segments`.

    ``words``: ``task_id, channel_id, word_id, word_start, word_end, word``, each once. A recording is folded by islands
    between silences of ``SILENCE_S`` seconds, the longest a segment can be; ``block`` is the island's start in
    milliseconds. Rows without a recording belong to none and give no segment.
    """
    schema = "task_id string, channel_id int, block bigint, segment_no int, start double, stop double, text string, words int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["word_start", "stop", "word_id"])
        found = segments(list(zip(g["word_start"], g["stop"], g["word"], g["channel_id"], strict=True)))
        task, block = g["task_id"].iloc[0], int(g["island"].iloc[0])
        rows = [(task, int(c), block, i, float(a), float(b), text, n) for i, (a, b, text, n, c) in enumerate(found, 1)]
        return pd.DataFrame(rows, columns=["task_id", "channel_id", "block", "segment_no", "start", "stop", "text", "words"])

    stop = F.when(F.col("word_end") >= F.col("word_start"), F.col("word_end")).otherwise(F.col("word_start"))
    clean = words.filter(F.col("task_id").isNotNull() & (F.trim(F.coalesce("word", F.lit(""))) != ""))
    clean = clean.select("task_id", F.coalesce("channel_id", F.lit(0)).alias("channel_id"), "word_id", "word_start", stop.alias("stop"), "word")
    placed = silence_islands(clean, "task_id", "word_start", SILENCE_S)
    return by_keys(placed, "task_id", "island").groupBy("task_id", "island").applyInPandas(run, schema)


def consume(rows: list[tuple[int, str, str]], src: str, tgt: str) -> list[tuple[int, str]]:
    """Whether each pair of texts is found in what is left of both full texts; found ones are used up.

    Exact first, then without blanks and format characters. Only pairs found on both sides are used.
    """
    import unicodedata

    def lean(text: str) -> tuple[str, list[int]]:
        kept = [(c, i) for i, c in enumerate(text) if not (c.isspace() or unicodedata.category(c) == "Cf")]
        return "".join(c for c, _ in kept), [i for _, i in kept]

    whole = {"src": src, "tgt": tgt}
    left = dict(whole)
    small = {side: lean(text) for side, text in whole.items()}  # once per text, kept up to date as parts are used up
    open_ = {side: text for side, (text, _) in small.items()}
    place = {side: {at: k for k, at in enumerate(where)} for side, (_, where) in small.items()}

    def find(side: str, text: str) -> tuple[int, int] | None:
        text = text.strip()
        at = left[side].find(text)
        if at >= 0:
            return at, at + len(text)
        needle = lean(text)[0]
        at = open_[side].find(needle) if needle else -1
        where = small[side][1]
        return (where[at], where[at + len(needle) - 1] + 1) if at >= 0 else None

    def use(side: str, a: int, b: int) -> None:
        left[side] = left[side][:a] + "\0" * (b - a) + left[side][b:]
        inside = [place[side][i] for i in range(a, b) if i in place[side]]
        if inside:
            k, n = inside[0], len(inside)
            open_[side] = open_[side][:k] + "\0" * n + open_[side][k + n :]

    out = []
    for no, a, b in rows:
        x, y = find("src", a), find("tgt", b)
        if x and y:
            use("src", *x)
            use("tgt", *y)
            out.append((no, "accepted"))
        else:
            there = all(lean(t.strip())[0] in small[side][0] for t, side in ((a, "src"), (b, "tgt")))
            out.append((no, "already_consumed" if there else "not_found"))
    return out


def coverage(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Coverage of full texts by pairs. ``pairs``: ``doc_key, row_no, src, tgt``; ``texts``: ``doc_key, src_text, tgt_text``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_no")
        full_src, full_tgt = g["src_text"].iloc[0] or "", g["tgt_text"].iloc[0] or ""
        found = consume([(int(n), a or "", b or "") for n, a, b in zip(g["row_no"], g["src"], g["tgt"], strict=True)], full_src, full_tgt)
        return pd.DataFrame([(g["doc_key"].iloc[0], n, o) for n, o in found], columns=["doc_key", "row_no", "outcome"])

    return pairs.join(texts, "doc_key").groupBy("doc_key").applyInPandas(run, "doc_key string, row_no int, outcome string")


def nms(boxes: Column, overlap: float = 0.18, near: float = 0.55) -> Column:
    """Boxes ``array<struct<score, x1, y1, x2, y2>>`` without those that overlap a better one, or whose centre is nearer to
    its centre than ``near`` of their longer side; a native fold."""
    ordered = F.reverse(F.array_sort(boxes))

    def iou(a: Column, b: Column) -> Column:
        w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
        h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
        area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
        union = area(a) + area(b) - w * h
        return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))

    def close(a: Column, b: Column) -> Column:
        middle = lambda c, p: (c[f"{p}1"] + c[f"{p}2"]) / 2
        apart = F.sqrt(F.pow(middle(a, "x") - middle(b, "x"), F.lit(2)) + F.pow(middle(a, "y") - middle(b, "y"), F.lit(2)))
        return apart < F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"]) * near

    return let(ordered, lambda o: F.aggregate(o, F.slice(o, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: (iou(k, b) > overlap) | close(k, b)), kept).otherwise(F.array_append(kept, b))))


# --- alignment by vectors ------------------------------------------------------------------------------


def hashed_vector(text: str, size: int = 256) -> np.ndarray:
    """A deterministic offline stand-in for an embedding: hashed numbers, words and character pairs."""
    import zlib

    v = np.zeros(size, dtype=np.float32)
    lean = re.sub(r"\s+", " ", text.lower())
    for f in re.findall(r"\d+", lean) * 3 + re.findall(r"[^\W\d_]+", lean) + [lean[i : i + 2] for i in range(len(lean) - 1)]:
        h = zlib.crc32(f.encode())
        v[h % size] += 1.0 if h & 0x10000 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


SKIP, MERGED, BONUS, LEAST_LIKE = -0.12, 0.98, 0.02, 0.25


def vector_alignment(a: np.ndarray, b: np.ndarray, threshold: float = 0.55) -> list[tuple[int, int, int, int, float, bool]]:
    """Monotone alignment of two sequences of unit vectors over a band: 1-1, 1-2, 2-1 and skips.

    A link's score is the cosine of the means of its sides, for 1-1 with a small bonus; 1-2 and 2-1 count a little less on
    the way, and a skip costs, but has the score 0. Equal ways keep the step tried first. Only the band is held. If the end
    can't be reached, the best cell that can is the end, and what is left on either side is skipped row by row.
    """
    m, n = len(a), len(b)
    band = max(8, int(0.12 * max(m, n)))
    a, b = (x if len(x) else np.zeros((0, 1)) for x in (a, b))

    def pairs(x: np.ndarray) -> np.ndarray:
        two = x[:-1] + x[1:] if len(x) > 1 else x[:0]
        return two / np.maximum(np.linalg.norm(two, axis=1, keepdims=True), 1e-12)

    a2, b2 = pairs(a), pairs(b)
    low = [max(0, (round(i * n / m) if m else 0) - band) for i in range(m + 1)]
    high = [min(n, (round(i * n / m) if m else n) + band) for i in range(m + 1)]
    score: list[np.ndarray] = []
    steps: list[list[tuple[int, int, float] | None]] = []
    ways = ((1, 1), (1, 2), (2, 1), (1, 0))
    for i in range(m + 1):
        lo, hi = low[i], high[i]
        row, how = np.full(hi - lo + 1, -np.inf), [None] * (hi - lo + 1)
        if not i:
            row[0 - lo] = 0.0
        likes = {}
        if i:
            likes[(1, 1)] = b[max(lo - 1, 0) : hi] @ a[i - 1] + BONUS if n else None
            likes[(1, 2)] = b2[max(lo - 2, 0) : max(hi - 1, 0)] @ a[i - 1] if n > 1 else None
            likes[(2, 1)] = b[max(lo - 1, 0) : hi] @ a2[i - 2] if i > 1 and n else None
        for j in range(lo, hi + 1):
            top, way = (0.0, None) if i == j == 0 else (-np.inf, None)
            for di, dj in ways:
                if i < di or j < dj or not low[i - di] <= j - dj <= high[i - di]:
                    continue
                before = score[i - di][j - dj - low[i - di]]
                if before == -np.inf:
                    continue
                like = float(likes[(di, dj)][j - dj - max(lo - dj, 0)]) if dj else 0.0
                value = before + (like if di == dj else like * MERGED if dj else SKIP)
                if value > top:
                    top, way = value, (di, dj, like)
            if j > lo and row[j - 1 - lo] + SKIP > top:
                top, way = row[j - 1 - lo] + SKIP, (0, 1, 0.0)
            row[j - lo], how[j - lo] = top, way
        score.append(row)
        steps.append(how)
    i, j = m, n
    if not low[m] <= n <= high[m] or score[m][n - low[m]] == -np.inf:
        _, i, j = max((x + y + low[x], x, y + low[x]) for x in range(m + 1) for y in range(len(score[x])) if score[x][y] > -np.inf)
    out = [(m, m, k, k + 1, 0.0, True) for k in range(n - 1, j - 1, -1)] + [(k, k + 1, n, n, 0.0, True) for k in range(m - 1, i - 1, -1)]
    while i or j:
        di, dj, like = steps[i][j - low[i]]
        out.append((i - di, i, j - dj, j, like, not (di and dj) or like < max(threshold, LEAST_LIKE)))
        i, j = i - di, j - dj
    return out[::-1]


def align_vectors(rows: DataFrame) -> DataFrame:
    """Alignment of whole documents by the offline vectors. ``rows``: ``doc_key, side, idx, text``, each once.

    Positions are those within a side of the document; a document with one side has a skip per row.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        v = [np.stack([hashed_vector(t or "") for t in texts]) if len(texts := g["text"][g["side"] == s]) else np.zeros((0, 256), dtype=np.float32) for s in ("src", "tgt")]
        out = [(g["doc_key"].iloc[0], i0, i1, j0, j1, float(round(s, 4)), bool(low)) for i0, i1, j0, j1, s, low in vector_alignment(*v)]
        return pd.DataFrame(out, columns=["doc_key", "src_start", "src_end", "tgt_start", "tgt_end", "score", "low_confidence"])

    return by_keys(rows, "doc_key").groupBy("doc_key").applyInPandas(run, "doc_key string, src_start int, src_end int, tgt_start int, tgt_end int, score double, low_confidence boolean")


# --- variants ------------------------------------------------------------------------------------------


def in_case_of(model: str, word: str) -> str:
    if model.isupper() and len(model) > 1:
        return word.upper()
    if model.istitle():
        return word.title()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def variant_pattern(rules: dict[str, str], ambiguous: set[str]) -> re.Pattern:
    """Longest first; targets are in it, too, so that a longer target stays as it is."""
    keys = sorted({*rules, *ambiguous, *(t.lower() for t in rules.values())}, key=lambda k: (-len(k), k))
    return re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(re.escape(k) for k in keys) + r")(?![A-Za-z0-9])", re.I)


def convert_variants(text: str, rules: dict[str, str], ambiguous: set[str], pattern: re.Pattern | None = None) -> tuple[str, int, int]:
    """(text with variants replaced in their case, replacements, ambiguous hits left alone); ``pattern`` is theirs, made once."""
    if not rules and not ambiguous:
        return text, 0, 0
    done = [0, 0]

    def one(m: re.Match) -> str:
        key = m.group().lower()
        if key in ambiguous:
            done[1] += 1
            return m.group()
        if key in rules:
            done[0] += 1
            return in_case_of(m.group(), rules[key])
        return m.group()

    return (pattern or variant_pattern(rules, ambiguous)).sub(one, text), done[0], done[1]
