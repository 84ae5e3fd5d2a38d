"""Speech transcripts into clean speaker turns.

Method: every timed word is tagged as speaker label, printed time, sound annotation, hesitation or speech by a
sequence model whose states know the first, inner and last row of labels and annotations; the best state
sequence is found by Viterbi, and turns are put together from its labels. Emissions and transitions are counts over
rows whose form is sure (a printed time, a whole bracket, a label that names somebody). Whether a plain word is a
hesitation is learned, too: from words that are sure by form, by letters, by how often a word is sure and by whether
the text reads on without it, in a few rounds of expectation and maximisation over the words of the sample.

All closed states share one row of transitions and an open one closes within ``SPAN_ROWS`` rows, so Viterbi runs over
segments, and what is far apart does not depend on each other. Rows are sorted into ranges of (task, channel, time, word),
which no frequent key makes large. What an open bracket or label ties to the next range is decoded with the rows there; the
speaker in force and the open turn are carried by one summary row per range, so no task ever holds a recording.

Defined results: rows without words are blank; repeats under one ``word_id`` count once; equal starts are
ordered by ``word_id``; rows before the first label of a channel and rows under a label of nobody on the
roster have no speaker and belong to no turn; a bracket that no row closes within ``SPAN_ROWS`` rows is speech; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: Rows of a label or an annotation at most, blank ones not counted.
SPAN_ROWS = 64
#: Rows that one task sorts and decodes.
TASK_ROWS = 250_000
#: The model is fitted on a sample of about this many rows, in whole stretches of SAMPLE_S seconds of a channel.
TRAIN_ROWS, SAMPLE_S = 50_000, 300.0
#: Rows that tell at most whether the text reads on without a word; more are no further evidence about the word.
GAP_ROWS = 6
#: Rows whose sureness tells at most about a word.
SURE_ROWS = 3
#: Letters and pairs of letters tell the same twice.
LETTER_SHARE = 0.8
#: The roster is a bounded reference list; it travels to the workers as a closure.
MOST_ROSTER = 100_000

NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
_NUMBER = r"(?:\d{1,6}|" + "|".join(NUMBER_WORDS) + ")"
_CALLED = re.compile(rf"(?i)^[\[(<>]*\s*(?:(?:speaker|spk|sprecher(?:in)?|spkr)[\s_#.-]*({_NUMBER})|s[_-]?(\d{{1,6}})(?=\s*[:：])|(?:说话人|发言人|讲话人|話者|发言者)\s*[_#-]?({_NUMBER}))\s*[\])>]*\s*[:：-]?$")
_TIME = re.compile(r"^(?:[\[(<【（]\s*\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?\s*[\])>】）]|\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?|\d{1,2}:\d{2}[.,]\d{3}|[\[(<]\s*(?:\d+h)?\d{1,2}m\d{1,2}s\s*[\])>]|(?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3}\s*-+>\s*\S+)$")
_FILLER = re.compile(r"(?i)^(?:u+h*m+|u+h+|e+r+m*|e+h+m*|ä+h*m*|a+h+m*|h+m+|m{2,}|m+-?h+m+|mm-hmm|uh-?huh|嗯+|呃+|额+|唔+|哦+|诶+|えーと|えっと|あのー?|うーん)[\s.,…!?，。、~-]*$")
_WHOLE = re.compile(r"^(?:\[.*\]|\(.*\)|\{.*\}|<.*>|【.*】|（.*）|〔.*〕|\*[^*\s].*\*|[♪♫]+.*)$", re.S)
_OPENS = re.compile(r"^[\[({<【（*](?!(?i:(?:see|cf|vgl|siehe)\b|[见参]))")
_SHUTS = re.compile(r"[\])}>】）*]$")
_MARKED = re.compile(r"(?i)(?:(?:[:：]|\s[-–]|^>>.+|^<v\s.+>)$)|^spk[_-]?\d+")
_FIRST = re.compile(r"(?i)(?:>>|<v|\[?(?:speaker|spk|说话人|发言人|mr\.|ms\.|mrs\.|dr\.))$")
_LAST, _TAIL = re.compile(r"[:：>\]]$|^[-–]$"), re.compile(r"[\s:：>\]–-]+$")

SPEECH, FILLER, TIME = "speech", "filler", "time"
S1, SB, SI, SE = "speaker", "speaker-first", "speaker-inner", "speaker-last"
A1, AB, AI, AE = "sound", "sound-first", "sound-inner", "sound-last"
#: What the form of a row allows beside speech.
_MAY = {TIME: "time", S1: "named", A1: "whole", SB: "first", SE: "last", AB: "open", AE: "shut"}


class Roster:
    """Who a label means, by number or by any usual form of the name."""

    def __init__(self, rows: list[tuple]):
        self.numbers = {int(r[0]) for r in rows}
        self.full: dict[str, int | None] = {}
        self.first: set[str] = set()
        for no, given, family, zh in rows:
            given, family = (given or "").strip().lower(), (family or "").strip().lower()
            forms = {f"{given} {family}", family, given, f"{given[:1]}. {family}", f"{given[:1]} {family}", f"{family}, {given[:1]}.", f"{family}, {given}", f"{family} {given[:1]}.", (zh or "").strip()}
            for form in forms:
                if form.strip(" .,"):
                    self.full[form] = int(no) if self.full.get(form, int(no)) == int(no) else None
            self.first |= {given, family, f"{family},", f"{given[:1]}."}
        self.first -= {"", ".", ","}
        self.who = lru_cache(100_000)(self._who)
        self.form = lru_cache(100_000)(self._form)

    def _who(self, label: str) -> int | None:
        """The number on the roster; None for nobody."""
        label = " ".join(label.split())
        if m := _CALLED.match(label):
            said = next(g for g in m.groups() if g).lower()
            no = NUMBER_WORDS.get(said) if said in NUMBER_WORDS else int(said)
            return no if no in self.numbers else None
        name = re.sub(r"^(?:>+|<v(?:\.\S+)?\s|[\[(<（【])\s*", "", label)
        name = re.sub(r"\s*(?:[:：>\])）】]|\s-+|\s–)+$", "", name).strip()
        name = re.sub(r"(?i)^(?:mr|mrs|ms|dr|prof|herr|frau|miss)\.?\s+", "", name)
        name = re.sub(r"(?:先生|女士|小姐|老师|さん|様)$", "", name)
        return self.full.get(name.lower())

    def _form(self, word: str) -> str:
        """What the form of a row tells, as the symbol that the states emit; nothing for a plain word."""
        if _TIME.match(word):
            return "time"
        found = []
        whole = bool(_WHOLE.match(word))
        if (whole or _MARKED.search(word)) and (self.who(word) is not None or _CALLED.match(word)):
            found.append("named")
        if whole:
            found.append("whole")
        elif _OPENS.match(word):
            found.append("open")
        elif _SHUTS.search(word):
            found.append("shut")
        if word.lower().lstrip("<>").strip() in self.first or _FIRST.match(word):
            found.append("first")
        if _LAST.search(word):
            core = _TAIL.sub("", word).lower()
            if core in self.first or core + "." in self.first or re.fullmatch(_NUMBER, core) or not core:
                found.append("last")
        return "+".join(found)


def folded(word: str) -> str:
    """A plain word without case, marks around it and drawn-out letters."""
    lean = re.sub(r"[^\w'-]+", "", unicodedata.normalize("NFKC", word).casefold())
    return re.sub(r"(.)\1+", r"\1", lean)


#: Sure by form to be a hesitation: letters drawn out, nothing but a hum, or a syllable that trails off.
_DRAWN = re.compile(r"(?i)^(?:[a-zäöü]*([a-zäöü])\1{2,}[a-zäöü]*|h?m+(?:-?h?m+)*)[\s.,…!?~-]*$|^[a-zäöü㐀-鿿ぁ-ん]{1,2}[ー]?\s*(?:…+|\.{3,})$")


def sure_states(words: list[str], roster: Roster, known: re.Pattern | None) -> list[str | None]:
    """States of rows that their form alone decides; None for plain words that may be a hesitation."""
    forms = [roster.form(w) for w in words]
    states: list[str | None] = [None] * len(words)
    at = 0
    while at < len(words):
        flags = forms[at].split("+")
        end = at
        if "time" in flags:
            states[at] = TIME
        elif "named" in flags and (roster.who(words[at]) is not None or "whole" not in flags):
            states[at] = S1
        elif "whole" in flags:
            states[at] = A1
        else:
            for first, last, kind in (("first", "last", (SB, SI, SE)), ("open", "shut", (AB, AI, AE))):
                if first not in flags:
                    continue
                for k in range(at + 1, min(at + 5, len(words))):
                    here = forms[k].split("+")
                    if last in here and (kind[0] == AB or roster.who(" ".join(words[at : k + 1])) is not None):
                        states[at : k + 1] = [kind[0], *[kind[1]] * (k - at - 1), kind[2]]
                        end = k
                        break
                    if here != [""] and not (first == "first" and "first" in here):
                        break
                if end > at:
                    break
            if end == at:
                hums = forms[at] == "" and (known is not None and known.match(words[at]) or _DRAWN.match(words[at]))
                states[at] = FILLER if hums else SPEECH if forms[at] else None
        at = end + 1
    return states


class Model:
    """Log scores of states, from counts over rows that are sure by form."""

    SINGLE = (SPEECH, FILLER, TIME, S1, A1)
    NEXT = {SB: (SI, SE), SI: (SI, SE), AB: (AI, AE), AI: (AI, AE)}

    def __init__(self, emitted: dict[tuple[str, str], int], moved: dict[tuple[str, str], int], filler: dict[str, float], letters: dict[str, float]):
        self.emit_counts, self.moved = emitted, moved
        totals, forms = Counter(), {f for _, f in emitted} | {""}
        for (state, _), n in emitted.items():
            totals[state] += n
        self.emit = lambda state, form: math.log((emitted.get((state, form), 0) + 0.1) / (totals[state] + 0.1 * (len(forms) + 1)))
        self.emit = lru_cache(10_000)(self.emit)
        closed = Counter()
        for (a, b), n in moved.items():
            if a not in self.NEXT:
                closed[b] += n
        all_closed = sum(closed.values()) + 0.1 * 7
        self.enter = {s: math.log((closed[s] + 0.1) / all_closed) for s in (*self.SINGLE, SB, AB)}
        self.inside = {}
        for a, ways in self.NEXT.items():
            total = sum(moved.get((a, b), 0) for b in ways) + 0.2
            self.inside |= {(a, b): math.log((moved.get((a, b), 0) + 0.1) / total) for b in ways}
        self.filler, self.letters = filler, letters
        self.hum = lru_cache(100_000)(self._hum)
        self.single = lru_cache(100_000)(self._single)

    def _hum(self, word: str) -> float:
        """Log odds that a plain word is a hesitation and no speech, by the word itself, else by its letters."""
        lean = folded(word)
        known = self.filler.get(lean)
        return known if known is not None else odds_of_letters(lean, self.letters) + self.letters.get("!" if _DRAWN.match(word) else "/", 0.0)

    def _single(self, form: str, word: str) -> tuple[float, str]:
        flags = form.split("+")
        best = (self.enter[SPEECH] + self.emit(SPEECH, form), SPEECH)
        if not form:
            best = max(best, (self.enter[SPEECH] + self.emit(SPEECH, form) + self.hum(word), FILLER))
        for state in (TIME, S1, A1):
            if _MAY[state] in flags:
                best = max(best, (self.enter[state] + self.emit(state, form), state))
        return best


def letter_kinds(word: str) -> list[str]:
    """Letters alone and with their neighbour, and for the signs of Han script the part of the table they stand in."""
    out = [f"{a}{b}" for a, b in zip("^" + word, word + "$", strict=True)] + list(word)
    return out + [f"#{ord(c) // 768}" for c in word if "㐀" <= c <= "鿿"]


def odds_of_letters(word: str, letters: dict[str, float]) -> float:
    """Log odds of a word by its letters; what hesitations never hold counts against them."""
    kinds = letter_kinds(word)
    return letters.get("", 0.0) + LETTER_SHARE * sum(letters.get(k, letters.get("?", -2.0)) for k in kinds)


def fit_words(sure: Counter, plain: Counter, gaps: dict[str, tuple[int, int]], rounds: int = 4) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds of every word of the sample, and of letters for other words.

    ``sure``: rows of a word whose form tells that it is a hesitation; ``plain``: all others; ``gaps``: in how many places a
    word stands between words that follow each other elsewhere, and how many rows there are.
    """
    words = sorted({*sure, *plain})
    share = {w: sure[w] / (sure[w] + plain[w]) for w in words}
    post = {w: 1.0 if share[w] > 0.2 else share[w] for w in words}
    odds, letters = dict.fromkeys(words, -10.0), {}
    fits = {w: gaps[w][0] / gaps[w][1] if w in gaps and gaps[w][1] else None for w in words}
    if not sure:
        return odds, {"": -10.0}
    for _ in range(rounds):
        count = {True: Counter(), False: Counter()}
        n = {True: 0.0, False: 0.0}
        read_on = {True: [1.0, 2.0], False: [1.0, 2.0]}
        for w in words:
            for hum, p in ((True, post[w]), (False, 1.0 - post[w])):
                for k in letter_kinds(w):
                    count[hum][k] += p
                n[hum] += p
                if fits[w] is not None:
                    read_on[hum][0] += p * fits[w]
                    read_on[hum][1] += p
        total = {h: sum(c.values()) for h, c in count.items()}
        # what one side lacks counts by how common it is on both
        usual = {k: (count[True][k] + count[False][k]) / (total[True] + total[False]) for k in {*count[True], *count[False]}}
        of = lambda hum, k, q: math.log((count[hum][k] + 2.0 * q) / (total[hum] + 2.0))
        letters = {k: of(True, k, q) - of(False, k, q) for k, q in usual.items() if q > 0}
        letters[""] = math.log((n[True] + 0.5) / (n[False] + 0.5))
        letters["?"] = min(-1.0, min(letters.values()) / 2)  # of letters nowhere seen
        # how many rows of a hesitation are sure by form
        sure_of = {h: min(0.98, max(0.02, sum(share[w] * p for w, p in side) / (sum(p for _, p in side) or 1.0))) for h, side in ((True, list(post.items())), (False, [(w, 1 - p) for w, p in post.items()]))}
        letters |= {"!": math.log(sure_of[True] / sure_of[False]), "/": math.log((1 - sure_of[True]) / (1 - sure_of[False]))}
        yes, no = (read_on[h][0] / read_on[h][1] for h in (True, False))
        for w in words:
            x = odds_of_letters(w, letters)
            if fits[w] is not None:
                x += min(gaps[w][1], GAP_ROWS) * (fits[w] * math.log(yes / no) + (1 - fits[w]) * math.log((1 - yes) / (1 - no)))
            x += min(sure[w] + plain[w], SURE_ROWS) * (share[w] * math.log(sure_of[True] / sure_of[False]) + (1 - share[w]) * math.log((1 - sure_of[True]) / (1 - sure_of[False])))
            odds[w] = max(-20.0, min(20.0, x))
            post[w] = 1.0 / (1.0 + math.exp(-odds[w]))
    return odds, letters


def viterbi(words: list[str], roster: Roster, model: Model) -> list[str]:
    """The best state of every row; a path that leaves a label or annotation open is no path."""
    forms = [roster.form(w) for w in words]
    best, how = [0.0], []
    pairs = ((SB, SI, SE), (AB, AI, AE))
    opens: dict[str, list[int]] = {SB: [], AB: []}
    for j, (form, word) in enumerate(zip(forms, words, strict=True)):
        score, state = model.single(form, word)
        top, way = best[j] + score, (j, state)
        if form:
            flags = form.split("+")
            for first, inner, last in pairs:
                if _MAY[last] in flags:
                    run = 0.0
                    at = j - 1
                    for i in reversed(opens[first]):
                        if j - i >= SPAN_ROWS:
                            break
                        while at > i:  # rows between, as inner ones
                            may = first == AB or "first" in forms[at]
                            run += model.emit(inner, forms[at]) + model.inside[(inner, inner)] if may else -math.inf
                            at -= 1
                        between = run if j - i == 1 else run - model.inside[(inner, inner)] + model.inside[(first, inner)]
                        close = model.inside[(first, last)] if j - i == 1 else model.inside[(inner, last)]
                        value = best[i] + model.enter[first] + model.emit(first, forms[i]) + between + close + model.emit(last, form)
                        if value > top:
                            top, way = value, (i, first)
            for first in opens:
                if _MAY[first] in flags:
                    opens[first].append(j)
        best.append(top)
        how.append(way)
    out: list[str] = []
    j = len(words) - 1
    while j >= 0:
        i, state = how[j]
        out += [state] if state in Model.SINGLE else [{SB: SE, AB: AE}[state], *[{SB: SI, AB: AI}[state]] * (j - i - 1), state]
        j = i - 1
    return out[::-1]


_NO_WIDTH = re.compile(r"[​-‏⁠﻿]")


def tag(words: list[str | None], roster: Roster, model: Model) -> tuple[list[str], list[int | None]]:
    """Tags of rows in order, and at the first row of a label its speaker (0: nobody on the roster)."""
    tags = ["blank"] * len(words)
    at, rows = [], []
    for i, w in enumerate(words):
        if w is not None and (lean := _NO_WIDTH.sub("", w).strip()):
            at.append(i)
            rows.append(lean)
    states = viterbi(rows, roster, model)
    label: list[int | None] = [None] * len(words)
    k = 0
    while k < len(at):
        s = states[k]
        if s in (SB, S1):
            end = k
            while states[end] not in (S1, SE):
                end += 1
            for first in range(k, end + 1):  # rows before the longest end that names somebody are speech
                text = " ".join(rows[first : end + 1])
                who = roster.who(text)
                if who is not None or _CALLED.match(text):
                    for i in at[first : end + 1]:
                        tags[i] = "speaker"
                    label[at[first]] = who or 0
                    break
                tags[at[first]] = SPEECH
            k = end + 1
            continue
        tags[at[k]] = s.split("-")[0]
        k += 1
    return tags, label


def loose_ends(words: list[str | None], roster: Roster) -> tuple[int, int]:
    """How many rows at the head may belong to a label or annotation that began before, and from which row on the tail
    may go on in what follows. Between them nothing depends on rows outside."""
    rows = [(i, roster.form(lean).split("+")) for i, w in enumerate(words) if w is not None and (lean := _NO_WIDTH.sub("", w).strip())]
    spans = []  # what may be one label or annotation, within
    for first, last in (("first", "last"), ("open", "shut")):
        begin = [k for k, (_, f) in enumerate(rows) if first in f]
        shuts = [k for k, (_, f) in enumerate(rows) if last in f]
        spans += [(k, s) for k in begin for s in shuts if 0 < s - k < SPAN_ROWS]
        spans += [(-1, s) for s in shuts if s < SPAN_ROWS] + [(k, len(rows)) for k in begin if len(rows) - k < SPAN_ROWS]
    head, tail = 0, len(rows)
    for a, b in sorted(spans):
        if a < head or a < 0:
            head = max(head, b + 1)
    for a, b in sorted(spans, key=lambda x: -x[1]):
        if b >= tail:
            tail = min(tail, max(a, 0))
    if head >= tail or head > len(rows):
        return len(words), len(words)
    return (rows[head - 1][0] + 1 if head else 0), (rows[tail][0] if tail < len(rows) else len(words))


def fit(words: DataFrame, people: list[tuple], known: re.Pattern | None = _FILLER, total: int | None = None) -> Model:
    """The model of a sample of whole stretches, chosen by hash: about ``TRAIN_ROWS`` rows, twice as many at most, all
    where there are fewer. The sample alone comes to the driver."""
    total = words.count() if total is None else total
    part = min(1.0, TRAIN_ROWS / total) if total else 1.0
    stretch = F.floor(F.col("word_start") / SAMPLE_S)
    chosen = F.pmod(F.xxhash64("task_id", "channel_id", stretch), F.lit(1 << 20)) < int(part * (1 << 20))
    order = ["task_id", "channel_id", "word_start", "word_id"]
    sample = words.filter(chosen).select(*order, "word").orderBy(*order).limit(2 * TRAIN_ROWS).toPandas().drop_duplicates("word_id")
    roster = Roster(people)
    emitted, moved, pairs, skipped, sure, plain = (Counter() for _ in range(6))
    new = ~(_same(sample["task_id"]) & _same(sample["channel_id"]) & _same(sample["word_start"] // SAMPLE_S))
    for _, rows in sample.groupby(new.cumsum(), sort=False):
        texts = [lean for w in rows["word"] if isinstance(w, str) and (lean := _NO_WIDTH.sub("", w).strip())]
        states = sure_states(texts, roster, known)
        lean = [w.casefold() for w in texts]
        pairs.update(zip(lean, lean[1:], strict=False))
        named = [s or SPEECH for s in states]
        moved.update(zip(named, named[1:], strict=False))
        for i, (w, s) in enumerate(zip(texts, states, strict=True)):
            if s in (None, FILLER):
                emitted[(s or SPEECH, "")] += 1
                (sure if s else plain)[folded(w)] += 1
                if 0 < i < len(lean) - 1:
                    skipped[(folded(w), lean[i - 1], lean[i + 1])] += 1
            else:
                emitted[(s, roster.form(w))] += 1
    gaps: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for (w, before, after), n in skipped.items():
        gaps[w][0] += (before, after) in pairs  # a place that repeats tells as much as one
        gaps[w][1] += n
    return Model(dict(emitted), dict(moved), *fit_words(sure, plain, {w: tuple(g) for w, g in gaps.items()}))


TAGGED = "word_id bigint, task_id string, channel_id int, block bigint, word_start double, tag string, label int, speaker int"


def listed(roster: DataFrame) -> list[tuple]:
    rows = roster.select("speaker_no", "given_name", "family_name", "family_name_zh").limit(MOST_ROSTER + 1).collect()
    if len(rows) > MOST_ROSTER:
        raise ValueError(f"the roster has more than {MOST_ROSTER} rows")
    return [tuple(r) for r in rows if r[0] is not None]


def _decoded(rows: pd.DataFrame, roster: Roster, model: Model, block: int) -> pd.DataFrame:
    tags, label = tag(rows["word"].tolist(), roster, model)
    out = rows[["word_id", "task_id", "channel_id", "word_start"]].copy()
    out["block"], out["tag"], out["label"] = block, tags, pd.array(label, dtype="Int32")
    out["speaker"] = out["label"].ffill()
    return out


def tag_words(words: DataFrame, roster: DataFrame, known: re.Pattern | None = _FILLER) -> DataFrame:
    """Every row once, with its tag, the speaker its label names (label) and the one in force in its block.

    ``words``: ``word_id, task_id, channel_id, word_start, word``. One shuffle, into sorted ranges; ``block`` grows with
    the order of a channel's rows. ``known``: hesitation sounds known beforehand, as examples for the model.
    """
    words = words.select("word_id", "task_id", "channel_id", "word_start", "word")
    people = listed(roster)
    total = words.count()
    model = fit(words, people, known, total)
    facts = (model.emit_counts, model.moved, model.filler, model.letters)
    sent = words.sparkSession.sparkContext.broadcast(facts)
    made: list[tuple[Roster, Model]] = []

    def tools() -> tuple[Roster, Model]:
        if not made:
            made.append((Roster(people), Model(*sent.value)))
        return made[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a range: decoded ones with their block, and loose ends of channels that may go on, as they are."""
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        known_roster, known_model = tools()
        part = int(rows["part"].iloc[0])
        rows = rows[~(rows["word_id"].eq(rows["word_id"].shift()) & rows["task_id"].fillna("").eq(rows["task_id"].fillna("").shift()))]
        rows["word"] = rows["word"].where(rows["word"].notna(), None)
        new = ~(_same(rows["task_id"]) & _same(rows["channel_id"]))
        number = new.cumsum().to_numpy()
        last = number[-1]
        edges = [0, *(i for i in range(1, len(rows)) if number[i] != number[i - 1]), len(rows)]
        for no, (a, b) in enumerate(zip(edges, edges[1:], strict=False), 1):
            piece = rows.iloc[a:b]
            head, tail = 0, len(piece)
            if no in (1, last):
                head, tail = loose_ends(piece["word"].tolist(), known_roster)
                head, tail = (head if no == 1 else 0), (tail if no == last else len(piece))
                if no not in (1, last) or head >= tail:
                    head, tail = len(piece), len(piece)
            for lo, hi, place in ((0, head, 0), (head, tail, 1), (tail, len(piece), 2)):
                if lo < hi:
                    cut = piece.iloc[lo:hi]
                    if place == 1:
                        out = _decoded(cut, known_roster, known_model, part * 3 + 1)
                        out["word"] = None
                    else:
                        out = cut[["word_id", "task_id", "channel_id", "word_start", "word"]].copy()
                        out["block"], out["tag"], out["label"], out["speaker"] = part * 3 + place, None, pd.array([None] * len(cut), dtype="Int32"), pd.array([None] * len(cut), dtype="Int32")
                    yield out[["word_id", "task_id", "channel_id", "block", "word_start", "tag", "label", "speaker", "word"]]

    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    order = ["task_id", "channel_id", "word_start", "word_id"]
    ranged = words.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    read = cut_lineage(ranged.mapInPandas(run, TAGGED + ", word string"))
    done = read.filter(F.col("tag").isNotNull()).drop("word")
    loose = read.filter(F.col("tag").isNull())

    # a seam runs from the tail of one range over ranges that are loose as a whole to the head of the next
    blocks = read.groupBy("task_id", "channel_id", "block").agg(F.first("tag").isNotNull().alias("firm"))
    before = Window.partitionBy("task_id", "channel_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    seams = blocks.withColumn("seam", F.count_if("firm").over(before)).filter(~F.col("firm")).select(F.col("task_id").alias("t"), F.col("channel_id").alias("c"), F.col("block").alias("b"), "seam")
    same = F.col("task_id").eqNullSafe(F.col("t")) & F.col("channel_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))

    def mend(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["word_start", "word_id"], kind="mergesort")
        rows["word"] = rows["word"].where(rows["word"].notna(), None)
        return _decoded(rows, *tools(), 0).assign(block=rows["block"].min())[["word_id", "task_id", "channel_id", "block", "word_start", "tag", "label", "speaker"]]

    mended = loose.drop("tag", "label", "speaker").join(seams, same).drop("t", "c", "b").groupBy("task_id", "channel_id", "seam").applyInPandas(mend, TAGGED)
    return done.unionByName(mended)


def _same(column: pd.Series) -> pd.Series:
    """Whether a value equals the one before, nulls being equal."""
    before = column.shift()
    return (column == before) | (column.isna() & before.isna())


def turns(tagged: DataFrame) -> DataFrame:
    """Speech rows with their speaker and the first word of their turn.

    ``tagged`` comes from :func:`tag_words`. Turns run over all channels of a task: rows are sorted into ranges of
    (task, time, word), runs are found inside a range, and what goes on over its ends is carried by one row per task and range.
    """
    tagged = cut_lineage(tagged)
    channel = Window.partitionBy("task_id", "channel_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = tagged.groupBy("task_id", "channel_id", "block").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("word_start", "word_id"))).alias("last"))
    carried = last.select(F.col("task_id").alias("t"), F.col("channel_id").alias("c"), F.col("block").alias("b"), F.last("last", ignorenulls=True).over(channel).alias("carried")).filter("carried IS NOT NULL")
    same = F.col("task_id").eqNullSafe(F.col("t")) & F.col("channel_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    rows = tagged.filter(F.col("tag") == SPEECH)
    sure = rows.filter(F.col("speaker").isNotNull()).select("task_id", "channel_id", "word_id", "word_start", F.col("speaker").alias("speaker_no"))
    open_ = rows.filter(F.col("speaker").isNull()).join(carried, same).select("task_id", "channel_id", "word_id", "word_start", F.col("carried").alias("speaker_no"))
    speech = sure.unionByName(open_).filter(F.col("speaker_no") > 0)

    spark = tagged.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    when = ["word_start", "word_id"]
    ranged = cut_lineage(speech.repartitionByRange(parts, "task_id", *when).withColumn("block", F.spark_partition_id()))
    order = Window.partitionBy("block", "task_id").orderBy(*when)
    changed = F.lag("speaker_no").over(order).eqNullSafe(F.col("speaker_no"))
    runs = ranged.withColumn("begins", F.when(~changed, F.col("word_id"))).withColumn("run", F.last("begins", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
    at = F.struct(*when)
    ends = runs.groupBy("block", "task_id").agg(F.min_by("word_id", at).alias("first_id"), F.min_by("speaker_no", at).alias("first_speaker"), F.max_by("speaker_no", at).alias("last_speaker"), F.max_by("run", at).alias("last_run"))
    blocks = Window.partitionBy("task_id").orderBy("block")
    ends = ends.withColumn("goes_on", F.coalesce(F.lag("last_speaker").over(blocks) == F.col("first_speaker"), F.lit(False)))
    ends = ends.withColumn("anchor", F.when(~F.col("goes_on") | (F.col("last_run") != F.col("first_id")), F.col("last_run")))
    ends = ends.select(F.col("task_id").alias("t"), F.col("block").alias("b"), "first_id", "goes_on", F.last("anchor", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("open_run")).filter("goes_on")
    joined = runs.join(ends, F.col("task_id").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")) & (F.col("run") == F.col("first_id")), "left")
    return joined.select("task_id", "channel_id", "word_id", "word_start", "speaker_no", F.coalesce("open_run", "run").alias("turn_word_id"))


def clean_turns(words: DataFrame, turned: DataFrame) -> DataFrame:
    """One row per turn: speaker, start, end, number of words. A third of all rows in one turn is pre-aggregated."""
    ends = words.groupBy("word_id").agg(F.max("word_end").alias("word_end"))
    rows = turned.join(ends, "word_id", "left")
    end = F.when(F.col("word_end") >= F.col("word_start"), F.col("word_end")).otherwise(F.col("word_start"))
    return rows.groupBy("task_id", "turn_word_id", "speaker_no").agg(F.min("word_start").alias("turn_start"), F.max(end).alias("turn_end"), F.count("*").alias("words"))
