"""Sentences, numbering and rows of plain text for office documents: small rules over one text at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.measure import _CONTROL

# Marks that end a sentence, marks that may close it, and abbreviations whose dot does not end one.
ENDS, CLOSERS = "。？！?!.", "\"'”’】》〉』）)]}"
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr vs etc inc ltd co corp st ave blvd rd dept gov gen col lt sgt rev hon pres pp vol no fig ed eds trans approx e.g i.e cf al et".split())
# Numbering that asks for a split.
NUMBERING = (r"\d+\.\s", r"(?:^|[^A-Za-z.])[A-Za-z]\.\s", r"\([0-9]+\)\s", r"\([A-Za-z]\)\s", r"(?:^|[^A-Za-z])[IVXivx]+\.\s")
CARRIED = 50

_INVISIBLE = re.compile(_CONTROL.replace(r"\x{", r"\u").replace("}", ""))
_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n){2,}")
_MARK = re.compile(rf"[{re.escape(ENDS)}]")
_RUN = re.compile(rf"[{re.escape(ENDS)}]*[{re.escape(CLOSERS)}]*")
_ROMAN = re.compile(r"(?i)[ivxlcdm]+")


def dot_ends(text: str, at: int) -> bool:
    """Whether the dot at a place ends a sentence: not behind digits, abbreviations, initials or roman numbers, not inside
    a word, and before a lower-case word only where nothing else stands."""
    begin = at
    while begin and (text[begin - 1].isalnum() or text[begin - 1] == "."):
        begin -= 1
    word = text[begin:at]
    if word[-1:].isdecimal() or word.lower().rstrip(".") in ABBREVIATIONS or re.fullmatch("[A-Z]", word) or _ROMAN.fullmatch(word):
        return False
    rest = text[at + 1 :]
    if rest[:1].isascii() and rest[:1].isalnum():
        return False
    follows = rest.lstrip()[:1] if rest[:1].isspace() else ""
    return not follows.islower()


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """``[start, end)`` of sentences: up to an end mark with all marks and closers behind it, or up to a blank line."""
    plain = _INVISIBLE.sub(" ", text or "")
    stops = sorted([(m.start(), m.end(), True) for m in _BLANK_LINE.finditer(plain)] + [(m.start(), m.end(), False) for m in _MARK.finditer(plain)])
    out, start = [], 0
    for a, b, blank in [*stops, (len(plain), len(plain), True)]:
        if a < start:
            continue
        if not blank:
            lead = len(plain[start:a]) - len(plain[start:a].lstrip())
            if plain[a] == "." and not dot_ends(plain, a):
                continue
            end = _RUN.match(plain, a + 1).end()
            out.append((start + lead, end))
            start = end
            continue
        piece = plain[start:a]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            out.append((start + lead, start + len(piece.rstrip())))
        start = b
    return out


def parse_pairs(text: str | None) -> list[tuple[str, str]]:
    """Rows ``a ||| b``; fences and blank lines are passed over, a short line without marks goes before the next one."""
    out, held = [], ""
    for line in re.split(r"\r\n|\r|\n", text or ""):
        line = line.strip()
        if not line or line.startswith("```"):
            continue
        line, held = (f"{held} {line}" if held else line), ""
        left, mark, right = line.partition("|||")
        if mark:
            if left.strip() or right.strip():
                out.append((left.strip(), right.strip()))
        elif len(line) < CARRIED:
            held = line
    return out


def split_by_lines(text: str | None, parts: int) -> list[str]:
    """Chunks of whole lines, cut at the line end nearest to each equal share of the characters; none is empty of lines."""
    lines = (text or "").splitlines()
    if parts <= 1 or not lines:
        return [text or ""]
    sums, total = [], 0
    for line in lines:
        total += len(line) + 1
        sums.append(total)
    ends = []
    for i in range(1, parts):
        goal = total * i // parts
        near = min(range(len(sums)), key=lambda k: (abs(sums[k] - goal), k)) + 1
        least = (ends[-1] if ends else 0) + 1
        ends.append(max(least, min(near, len(lines) - (parts - i))))
    cuts = [0, *ends, len(lines)]
    return ["\n".join(lines[a:b]).strip() for a, b in zip(cuts, cuts[1:], strict=False)]


def has_numbering(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(NUMBERING)), F.lit(False))


def _array(kind: str, how):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: how(None if t is None or t != t else t))

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return run.asNondeterministic()


def spans(text: Column) -> Column:
    return _array("array<struct<start:int,end:int>>", lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t)])(text)


def pairs(text: Column) -> Column:
    return _array("array<struct<src:string,tgt:string>>", lambda t: [{"src": a, "tgt": b} for a, b in parse_pairs(t)])(text)


def line_parts(text: Column, parts: int) -> Column:
    return _array("array<string>", lambda t: split_by_lines(t, parts))(text)
