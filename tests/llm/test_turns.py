import random

import pytest

from quire.llm import turns as T

PEOPLE = [(1, "Mara", "Quill", "奎尔"), (2, "Orlin", "Harrowgate", "哈罗"), (3, "Tessaly", "Vanterpool", "范特")]
ROSTER = T.Roster(PEOPLE)
WORDS = "Speaker|2:|I|agree|with|Quill|on|[phone|rings]|uh|that.|(00:35)|(coughs)|Mara|Quill:|Did| |Orlin|send|it?|VANTERPOOL,|T.:|♪|Yes|[inaudible 00:12:04]|00:00:08.120".split("|")


def model_of(spark, lists, known=T._FILLER):
    rows = [(i, f"t{k}", 0, 0, i * 0.3, None, w) for k, words in enumerate(lists) for i, w in enumerate(words)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    return T.fit(spark.createDataFrame(rows, SCHEMA), PEOPLE, known)
SCHEMA = "word_id bigint, task_id string, channel_id int, sentence_id int, word_start double, word_end double, word string"


@pytest.mark.parametrize(
    ("label", "who"),
    [("Speaker 3:", 3), ("speaker2 :", 2), ("[Speaker 1]", 1), ("Speaker two:", 2), ("SPK_03", 3), ("S1:", 1), ("说话人2：", 2), ("发言人 3:", 3), (">> QUILL:", 1), ("<v Mara Quill>", 1), ("(Harrowgate)", 2), ("Vanterpool -", 3), ("VANTERPOOL, T.:", 3), ("Ms. Quill:", 1), ("O. Harrowgate:", 2), ("mara:", 1), ("范特：", 3), ("Speaker 99:", None), ("Nobody:", None)],
)
def test_labels(label, who):
    assert ROSTER.who(label) == who


def test_tags(spark):
    tags, label = T.tag([*WORDS, None], ROSTER, model_of(spark, [WORDS] * 3))
    assert "".join({"speaker": "S", "speech": "w", "sound": "a", "filler": "f", "time": "t", "blank": "-"}[t] for t in tags) == "SSwwwwwaafwtaSSw-wwwSSawat-"
    assert [x for x in label if x is not None] == [2, 1, 3]


def test_a_bracket_that_nothing_closes_is_speech(spark):
    model = model_of(spark, [WORDS] * 3)
    long = ["[then", *["word"] * 70, "end]"]
    assert set(T.tag(long, ROSTER, model)[0]) == {"speech"}
    assert set(T.tag(["[then", "word", "end]"], ROSTER, model)[0]) == {"sound"}


def test_hesitations_are_learned_without_a_list(spark):
    folder = "/root/testdata/sf0.01"
    words, roster = spark.read.parquet(f"{folder}/asr_words.parquet"), spark.read.parquet(f"{folder}/speaker_roster.parquet")
    tags = [{(r["word_id"]) for r in T.tag_words(words, roster, known).filter("tag = 'filler'").select("word_id").collect()} for known in (T._FILLER, None)]
    both = len(tags[0] & tags[1])
    assert both >= 0.9 * len(tags[0]) and both >= 0.9 * len(tags[1]) and both > 300


def test_words_without_examples_give_no_hesitation():
    odds, letters = T.fit_words(T.Counter(), T.Counter({"the": 5, "um": 1}), {})
    assert all(x < 0 for x in odds.values()) and letters[""] < 0


def brute(rows, model):
    """The whole of every recording at once."""
    seen, speech = {}, []
    for r in rows:
        seen.setdefault(r[0], r)
    for key in sorted({(r[1] or "", r[2] or 0) for r in seen.values()}):
        part = sorted((r for r in seen.values() if (r[1] or "", r[2] or 0) == key), key=lambda r: (r[4], r[0]))
        tags, label = T.tag([r[6] for r in part], ROSTER, model)
        who = None
        for r, t, x in zip(part, tags, label, strict=True):
            who = x if x is not None else who
            if t == "speech" and who:
                speech.append((r[1], r[4], r[0], who))
    out, last = [], None
    for task, _, word, who in sorted(speech, key=lambda x: (x[0] or "", x[1], x[2])):
        if last is None or last[:2] != (task, who):
            last = (task, who, word)
        out.append((word, last[2], who))
    return sorted(out)


@pytest.mark.parametrize("task_rows", [20, 120, 250_000])
def test_ranges_equal_the_whole(spark, monkeypatch, task_rows):
    monkeypatch.setattr(T, "TASK_ROWS", task_rows)
    rng = random.Random(5)
    rows, no = [], 0
    for task, size in (("t1", 120), ("t2", 600), (None, 120)):
        for channel in (0, 1):
            at = rng.random()
            words = ["Speaker 1:"]
            while len(words) < size:
                words += rng.choice([["hello", "there."], ["uh"], ["Mara", "Quill:"], ["[phone", "rings]"], ["[a", "very", "long", "noise", "in", "the", "room]"], ["S3:"], ["(00:12)"], [None], ["Did", "Mara", "go?"], [" "], ["Speaker", "2:"]] + [["plain", "words", "go", "on"]] * 12)
            for w in words:
                at += rng.choice([0.0, 0.3, 0.5])
                no += 1
                rows.append((no, task, channel, None, round(at, 2), None, w))
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    roster = spark.createDataFrame(PEOPLE, "speaker_no int, given_name string, family_name string, family_name_zh string")
    tagged = T.tag_words(df, roster)
    assert tagged.count() == no
    got = T.turns(tagged).select("word_id", "turn_word_id", "speaker_no").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, T.fit(df, PEOPLE))
    if task_rows == 120:
        ends = T.clean_turns(df, T.turns(tagged)).collect()
        assert sum(r["words"] for r in ends) == len(got) and all(r["turn_end"] >= r["turn_start"] for r in ends)


def test_loose_ends():
    plain = ["plain"] * 200
    assert T.loose_ends(plain, ROSTER) == (0, 200)
    assert T.loose_ends(["plain", "rings]", *plain, "[phone", "x"], ROSTER) == (2, 202)
    assert T.loose_ends(["[a", "b]", "c]", *plain, "Speaker"], ROSTER) == (3, 203)


def test_empty_and_clashing(spark):
    roster = spark.createDataFrame(PEOPLE, "speaker_no int, given_name string, family_name string, family_name_zh string")
    df = spark.createDataFrame([(1, "t", 0, 1, 0.0, 1.0, "S1:", "x", 1), (2, "t", None, 1, 0.5, 0.1, "no label", "y", 2), (3, "t", 0, 1, 1.0, None, "hi", "z", 3)], SCHEMA + ", tag string, block int")
    assert [tuple(r) for r in T.turns(T.tag_words(df, roster)).select("word_id", "turn_word_id", "speaker_no").collect()] == [(3, 3, 1)]
    assert T.turns(T.tag_words(df.limit(0), roster)).count() == 0
