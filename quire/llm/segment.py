"""Sentence boundaries for documents in any language and script.

Method: cascading tables of ordered break / no-break rules. A rule is a pair of patterns, one for the text
before a position and one for the text after it; at every candidate position the tables of the language and
then the common one are tried in order, and the first rule that fits decides. Ahead of all tables stand the
holds: quoted and bracketed stretches, inside which nothing breaks.

Defined results: null and blank texts give no span; a text without any end mark is one span; repeated rows
give the same spans; a null or unknown language is told from the script and, for Latin, frequent words. Rules see
the text after a position to its end and, before it, the number that opens the sentence and all that the longest pattern
can reach: at least ``REACH`` characters and the whole run of blanks, marks or letters that stands there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest pattern before a position without its repeated parts; runs of one kind are seen whole, whatever their length.
REACH = 64

ENDS = ".!?。！？．｡…؟।॥۔"
CLOSERS = "\"'”’»）)】〕］\\]』」》〉｣"
_EDGES = frozenset(ENDS + CLOSERS + "“")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")

#: Quotes and brackets whose inside is never broken; a blank line ends what was never closed.
_HOLD = re.compile(
    r"„(?:[^„“”\n]|\n(?!\s*\n))*[“”]"
    r"|“(?:[^“”\n]|\n(?!\s*\n))*”"
    r"|‘(?:[^‘’\n]|\n(?!\s*\n)|(?<=\w)’(?=\w))*’"
    r"|«(?:[^«»\n]|\n(?!\s*\n))*»"
    r"|»(?:[^«»\n]|\n(?!\s*\n))*«"
    r"|「(?:[^「」\n]|「[^「」\n]*」|\n(?!\s*\n))*」"
    r"|『(?:[^『』\n]|\n(?!\s*\n))*』"
    r"|《[^《》\n]*》"
    r"|（(?:[^（）\n]|（[^（）\n]*）|\n(?!\s*\n))*）"
    r"|\((?:[^()\n]|\([^()\n]*\)|\n(?!\s*\n))*\)"
    r'|(?<![\w"])"(?:[^"\n]|\n(?!\s*\n))*"(?!\w)'
)

def _candidates(closers: str) -> re.Pattern:
    return re.compile(
        rf"(?<=[{ENDS}])(?:[ \t\u00a0]+(?=[…]))?(?<=[{ENDS}])[{closers}]*(?![{ENDS}{closers}])"
        r"|(?<=\n)(?!\n)|(?<=\r)(?![\r\n])"
        r"|(?<=[\u0e00-\u0e7f0-9])(?=[ \u3000\u00a0]+[\u0e00-\u0e7f])"
    )


#: In German, what opens elsewhere closes.
_CANDIDATE = {"de": _candidates(CLOSERS + "“"), "": _candidates(CLOSERS)}


@dataclass(frozen=True)
class Rule:
    """``breaks`` at positions where ``before`` fits up to them and ``after`` fits from them.

    ``opening``: the rule holds only where a quote that opened the sentence has just closed.
    """

    breaks: bool
    before: str
    after: str
    opening: bool = False


def words(*abbreviations: str) -> str:
    return r"(?<![\w])(?:" + "|".join(re.escape(a).replace(r"\ ", r"\s?") for a in abbreviations) + r")\."


_START = r"\s*[\"'“‘„«「『（(\[]?(?:[a-z]?[A-ZÄÖÜ]|\d|[㐀-鿿぀-ヿ])"

#: Abbreviations after which a sentence goes on, whatever follows.
EN_INNER = ("No", "Nos", "no", "Fig", "Figs", "Vol", "Sec", "Secs", "Col", "l", "p", "pp", "cf", "Cf", "Dr", "Mr", "Mrs", "Ms", "Prof", "Fr", "St", "Art", "approx", "incl", "i.e", "e.g", "vs", "v", "ver", "Ver", "Dept", "Temp", "viz", "Ch", "ch", "Eq", "Ed", "eds", "Rev", "Hon", "Gen", "Capt", "Lt", "Sgt", "Messrs", "Mt", "ca", "al", "Op", "op", "cit", "art", "para", "Gov", "Sen", "Rep", "Mme", "Mlle", "Jan", "Feb", "Mar", "Apr", "Aug", "Sept", "Oct", "Nov", "Dec")
DE_INNER = ("Nr", "Nrn", "S", "Abs", "Art", "Kap", "Abb", "Fig", "Dr", "Prof", "Dipl", "Ing", "Hr", "Hrn", "Fr", "Fa", "Vgl", "vgl", "ca", "inkl", "exkl", "bzw", "z", "B", "d", "h", "u", "a", "i", "R", "v", "H", "U", "T", "o", "Ä", "evtl", "ggf", "sog", "Str", "St", "Tel", "Bd", "Ziff", "lfd", "max", "min", "Mio", "Mrd", "Jh", "geb", "gem", "lt", "Aufl", "Hrsg", "bes", "insb", "einschl", "zzgl", "abzgl", "Best", "Stk", "Std", "Ver", "No")
_MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

TABLES: dict[str, tuple[Rule, ...]] = {
    # the number that opens a list entry or a heading belongs to it
    "first": (Rule(False, r"(?:^|[\r\n])\s*\d{1,3}(?:\.\d{1,3})*(?:\.\)?|\))", r"[ \t]*\S"),),
    "common": (
        Rule(True, r"\n\s*\n\s*", r""),
        # a list entry or a heading with a number begins a line
        Rule(True, rf"(?:[{ENDS}:：;；][{CLOSERS}“]*\s*|^\s*\d{{1,3}}[.)、．](?!\d)[\s\S]*)[\r\n]", r"[ \t]*(?:\d{1,3}(?:[.、．](?!\d)|[)）])|[-*•·–]|[(（]\d{1,3}[)）]|[a-z]\)|[①-⑳])[ \t]*\S"),
        Rule(False, r"[\r\n]", r""),
        Rule(False, r"\w", r"[ \u3000\u00a0]*\d"),
    ),
    "en": (
        Rule(False, words(*EN_INNER), r"\s*\S"),
        Rule(False, r"(?<![A-Za-z])[A-Z]\.", r"\s*(?:[A-Z]\.|[A-Z][a-z]+\b)(?<!\bThe)(?<!\bA)(?<!\bIt)(?<!\bHe)(?<!\bShe)(?<!\bWe)(?<!\bIn)(?<!\bOn)(?<!\bIf)"),
        Rule(False, r"(?<![A-Za-z])[IVXLC]{1,5}\.", r"\s[A-Z]\."),
        Rule(False, r"[.…][\"”’')\]]*", r"[ \t\r\n\u00a0\u3000]*(?:[a-z](?![A-Z])|[,;:%)])"),
        Rule(False, r"[!?…][\"”’')\]]*", r"[ \t\r\n\u00a0\u3000]*(?:[a-z](?![A-Z])|[,;:])"),
        Rule(False, r"\.", r"(?![a-z][A-Z][a-z])[\w/@](?<![A-Z])"),
        Rule(True, r"[ap]\.m\.", r"[A-Z][a-z]"),
        Rule(False, r"\d\.", r"[a-z0-9]|[A-Z](?![a-z]|\.\s)"),
        Rule(False, r"(?<![A-Za-z])[A-Za-z]\.", r"[A-Za-z0-9]"),
        Rule(False, r"(?:[\w-]+\.)+", r"[a-z0-9][A-Za-z0-9]*[./]"),
        Rule(True, r"[!?…][\"”’')\]]*", r""),
        Rule(True, r"\.[\"”’')\]]*", r"\s*$|" + _START),
        Rule(True, r"\.[\"”’')\]]*", r"\s"),
    ),
    "de": (
        Rule(False, r"\d\.", rf"\s*(?:{_MONTHS_DE})\b"),
        Rule(False, r"(?i:\b(?:am|vom|zum|im|der|die|das|dem|den|des|seit|ab|bis|beim|jede[nrs]?|diese[nrs]?))\s\d{1,3}\.", r"\s*[A-ZÄÖÜa-zäöü]"),
        Rule(True, r"u\.\s?a\.\s?m\.|(?<!\w)(?:usw|etc)\.", r"\s+[A-ZÄÖÜ„]"),
        Rule(False, words(*DE_INNER), r"\s*\S"),
        Rule(False, r"-Ing\.|(?<![\w])[A-Za-zÄÖÜ]\.", r"\s*\S"),
        Rule(False, r"[.…!?][\"“”’')\]]*", r"[ \t\r\n\u00a0\u3000]*(?:[a-zäöüß](?![A-Z])|[,;:%)])"),
        Rule(False, r"\.", r"(?![a-z][A-Z][a-z])[\w/@](?<![A-ZÄÖÜ])"),
        Rule(True, r"[ap]\.m\.", r"[A-Z][a-z]"),
        Rule(False, r"\d\.", r"[a-z0-9]|[A-Z](?![a-z]|\.\s)"),
        Rule(False, r"(?<![A-Za-z])[A-Za-z]\.", r"[A-Za-z0-9]"),
        Rule(False, r"(?:[\w-]+\.)+", r"[a-z0-9][A-Za-z0-9]*[./]"),
        Rule(True, r"[!?…][\"“”’')\]]*", r""),
        Rule(True, r"\.[\"“”’')\]]*", r"\s*$|\s|" + _START),
    ),
    "zh": (
        Rule(False, r"[。！？!?….．][”’」』\"]+", r"[ \u3000]*(?:[㐀-鿿぀-ヿ]|[，、；,])", opening=True),
        Rule(False, r"[”’」』\"]", r"[，、；：,]|(?:然后|随后|接着|并|就|又|再|才|后来|而后|便|说|问|道|答|写)"),
        Rule(False, r"…", r"[，、；：]|(?:然后|随后|接着|但|可是|不过|而|就|又|再|才|所以|因为|还是|也|和|与)"),
        Rule(False, r"[。！？!?．……][）)]", r"[，、；：]"),
        Rule(False, r"(?<!…)…", r"[㐀-鿿]"),
        Rule(True, r"[。！？!?｡…][”’」』）)】》\"]*", r""),
        Rule(True, r"．[”’」』）)】》\"]*", r"(?!\d)"),
        Rule(True, r"[㐀-鿿]\.[”’\"」』）)]*", r"(?![A-Za-z0-9])"),
        Rule(False, r"\.", r""),
    ),
    "ja": (
        Rule(False, r"[。！？!?｡….．][”’」』\"]+", r"[ \u3000]*(?:[㐀-鿿぀-ヿ]|[，、；,])", opening=True),
        Rule(False, r"[”’」』\"]", r"[ \u3000]*(?:[、，,]|と|って|など|という|の|を|は|が|に|で|も|へ|や|か)"),
        Rule(False, r"[。！？!?．｡…]+[）)]", r"[、，]|(?:と|の|を|は|が|に|で|も|へ|や)"),
        Rule(False, r"(?<!…)…", r"[㐀-鿿぀-ヿ]"),
        Rule(False, r"……", r"[、，]"),
        Rule(True, r"[。！？!?｡…][”’」』）)】》\"]*", r""),
        Rule(True, r"．[”’」』）)】》\"]*", r"(?!\d)"),
        Rule(True, r"[㐀-鿿぀-ヿ]\.[”’\"」』）)]*", r"(?![A-Za-z0-9])"),
        Rule(False, r"\.", r""),
    ),
    "hi": (
        Rule(True, r"[।॥?!…][\"”’')\]]*", r""),
        Rule(False, r"\.", r""),
    ),
    "ar": (
        Rule(False, r"(?<![\w])\w\u0651?\.", r""),
        Rule(False, r"\.", r"[\w]"),
        Rule(True, r"[.؟!?۔…][\"”»’')\]]*", r""),
    ),
    "th": (
        Rule(True, r"[!?…][\"”’')\]]*", r""),
        Rule(False, r"\.", r""),
        Rule(False, r"(?:^|\s)(?:ดร\.?|นาย|นาง|นางสาว|คุณ|และ|หรือ)", r""),
        Rule(False, r"[\d\u0e00-\u0e7f]", r"[ \u3000\u00a0]+(?:บาท|หน้า|แผ่น|ฉบับ(?!แปล)|วัน|เดือน|ปี|เปอร์เซ็นต์|ต่อ|และ|หรือ|ๆ|น\.)"),
        Rule(True, r"[\d\u0e00-\u0e7f]", r"[ \u3000\u00a0]+[\u0e00-\u0e7f]"),
    ),
}

_COMPILED = {
    name: tuple((r.breaks, re.compile(rf"(?:{r.before})\Z"), re.compile(r.after), r.opening) for r in rules)
    for name, rules in TABLES.items()
}

#: What opens a list entry; rules that ask for it at the start of a sentence see it at any length.
_ENTRY = re.compile(r"\s*\d{1,3}[.)、．](?!\d)")

_DE_WORDS = re.compile(r"\b(?:der|die|das|und|ist|von|wird|wurde|nicht|mit|ein|eine|für|auf|Sie|im|am|den|dem|des|zu|bis|sind|noch)\b")
_EN_WORDS = re.compile(r"\b(?:the|of|and|is|was|to|in|for|with|by|on|at|not|The|which|must|from|has|have|are|be)\b")


_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_SCRIPTS = {n: re.compile(p) for n, p in (("kana", "[぀-ヿ]"), ("han", "[㐀-鿿]"), ("th", "[\u0e00-\u0e7f]"), ("hi", "[\u0900-\u097f]"), ("ar", "[\u0600-\u06ff]"))}


def told(text: str, lang: str | None) -> str:
    """The rule table of a text: its language, corrected by the script where they can't go together."""
    count = {name: len(p.findall(text)) for name, p in _SCRIPTS.items() if p.search(text)} if not text.isascii() else {}
    kana = count.get("kana", 0)
    counts = {n: count.get(n, 0) for n in ("th", "hi", "ar")} | {"ja" if kana else "zh": 2 * (kana + count.get("han", 0))}
    top = max(counts, key=counts.get)
    script = "latin" if _LATIN.search(text) and (not counts[top] or len(_LATIN.findall(text)) > counts[top]) else top
    if script == "latin":
        if lang in ("en", "de"):
            return lang
        return "de" if len(_DE_WORDS.findall(text)) + len(re.findall("[äöüßÄÖÜ„]", text)) > len(_EN_WORDS.findall(text)) else "en"
    if lang in ("zh", "ja") and script in ("zh", "ja"):
        return "ja" if kana else lang
    return script


def spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """``[start, end)`` of every sentence, in code points of the text as given."""
    if text is None or not text.strip():
        return []
    if _INVISIBLE.search(text):
        kept = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
        clean = "".join(text[i] for i in kept)
        found = _spans(clean, lang)
        out = [[kept[a], kept[b - 1] + 1] for a, b in found]
        for i, pair in enumerate(out):  # what can't be seen goes with the sentence before it
            stop = out[i + 1][0] if i + 1 < len(out) else len(text)
            while pair[1] < stop and _INVISIBLE.match(text[pair[1]]):
                pair[1] += 1
        return [(a, b) for a, b in out]
    return _spans(text, lang)


def _kind(c: str) -> int:
    """What repeated parts of the patterns are made of: blanks and marks, or parts of Latin words and addresses."""
    if c.isspace() or c in _EDGES:
        return 1
    return 2 if c in "_-" or (c < "ɐ" and c.isalnum()) else 0


def _reach(text: str, start: int, pos: int) -> int:
    """Where the text that rules see before ``pos`` begins: never inside a run that a pattern may repeat."""
    at = pos - REACH
    while at > start and (kind := _kind(text[at])) and (kind == _kind(text[at - 1]) or "." in text[at - 1 : at + 1]):
        at -= 1
    return max(at, start)


def _spans(text: str, lang: str | None) -> list[tuple[int, int]]:
    if not text.strip():
        return []
    table = told(text, lang)
    cascade = _COMPILED["first"] + _COMPILED[table] + _COMPILED["common"]
    common = _COMPILED["common"]
    holds = [(m.start(), m.end()) for m in _HOLD.finditer(text)]
    h, start, cuts = 0, 0, []
    for m in _CANDIDATE.get(table, _CANDIDATE[""]).finditer(text):
        pos = m.end()
        if pos <= start or pos >= len(text):
            continue
        while h < len(holds) and holds[h][1] < pos:
            h += 1
        if h < len(holds) and holds[h][0] < pos < holds[h][1]:
            continue
        opening = h < len(holds) and holds[h][1] == pos and not text[start : holds[h][0]].strip()
        if pos - start <= REACH:
            before = text[start:pos]
        else:  # the number that opens the sentence stays in sight
            entry = _ENTRY.match(text, start)
            before = (entry.group() if entry else "") + "\0" + text[_reach(text, start, pos) : pos]
        line = before[-1:] in "\r\n"
        for breaks, b, a, only_opening in common if line else cascade:
            if (opening or not only_opening) and a.match(text, pos) and b.search(before):
                if breaks:
                    cuts.append(pos)
                    start = pos
                break
    out, at = [], 0
    for cut in [*cuts, len(text)]:
        piece = text[at:cut]
        if lean := piece.strip():
            a = at + len(piece) - len(piece.lstrip())
            out.append((a, a + len(lean)))
        at = cut
    return out


def span_array(text: Column, lang: Column) -> Column:
    """``array<struct<start,end>>`` of the sentences of a text; a narrow Arrow UDF."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in spans(t, x)] for t, x in zip(texts, langs, strict=True)])

    # not deterministic for the optimizer only: else a generator over the result makes it run the function again in filters
    return found.asNondeterministic()(text, lang)


def segment(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """One row per sentence: key, position, ``span_start``, ``span_end``, ``unit``, each key once.

    Spans are found in the scan's stage; the texts aren't shuffled, only their keys and span arrays are,
    to merge repeats. ``unit`` is cut from the text before that only where asked for by ``units``.
    """
    rows = df.select(F.col(key).alias("k"), span_array(F.col(text), F.col(lang)).alias("spans")).dropDuplicates(["k"])
    return rows.select(F.col("k").alias(key), F.posexplode("spans").alias("span_no", "s")).select(key, "span_no", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def units(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Sentences with their text; the text travels once per record."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).dropDuplicates(["k"])
    cut = rows.select("k", "t", F.posexplode(span_array(F.col("t"), F.col("l"))).alias("span_no", "s"))
    start, end = F.col("s.start"), F.col("s.end")
    return cut.select(F.col("k").alias(key), "span_no", start.alias("span_start"), end.alias("span_end"), F.substring("t", start + 1, end - start).alias("unit_text"))


def iterate(text: str | None, lang: str | None = None) -> Iterator[str]:
    for a, b in spans(text, lang):
        yield text[a:b]
