import random
import re
import tracemalloc

from quire.llm import bitext as B

TERMS = [(1, "invoice copy", "发票副本", "Rechnungskopie", "請求書写し"), (2, "site plan", "总平面图", "Lageplan", "配置図"), (3, "fuel filter", "燃油滤清器", "Kraftstofffilter", "燃料フィルター"), (4, "safety manual", "安全手册", None, None)]
SCHEMA = "sent_id bigint, doc_key string, side string, lang string, idx int, source_text string"


def test_numbers_and_dates_have_one_form():
    assert {B.number(x) for x in ("1,028", "1.028", "1028")} == {"1028"}
    assert {B.number(x) for x in ("71,597.76", "71.597,76", "71597.76")} == {"71597.76"}
    assert B.number("12.10") == B.number("12,1") and B.number("0.5") == B.number("0,50")
    hard = [B.features(t, B.Terms([]))[0] for t in ("On 24 October 2022", "October 24, 2022", "2022-10-24", "2022年10月24日", "am 24. Oktober 2022", "24.10.2022")]
    assert all(h == ["d2022-10-24"] for h in hard)


def test_chain_is_the_longest():
    rng = random.Random(1)
    for _ in range(100):
        points = [(i, rng.randrange(8), 1.0) for i in range(8)]
        best = 0
        for bits in range(256):
            js = [points[i][1] for i in range(8) if bits >> i & 1]
            best = max(best, len(js) if all(a < b for a, b in zip(js, js[1:], strict=False)) else 0)
        got = B.chain(points)
        assert len(got) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


EN = ["Section {n} describes the {t}.", "Never fold the {t}!", "The {t} costs {n} euros.", "Replace the {t} after {n} hours.", "Who approved the {t}?"]
ZH = ["第{n}节说明{t}。", "切勿折叠{t}！", "{t}价格为{n}欧元。", "运行{n}小时后更换{t}。", "是谁批准了{t}？"]


def corpus(docs, seed=3):
    """Documents with omissions, joins, moves and copies, and the pairs that are right."""
    rng = random.Random(seed)
    rows, truth, no = [], set(), 0
    for d in range(docs):
        units = [(rng.randrange(5), rng.randrange(4), rng.randrange(10, 9999)) for _ in range(10)]
        src = [EN[k].format(t=TERMS[t][1], n=n) for k, t, n in units]
        tgt = [[i, ZH[k].format(t=TERMS[t][2], n=n)] for i, (k, t, n) in enumerate(units)]
        tgt[2][1] = src[2]
        gone = rng.randrange(3, 6)
        order = [i for i in range(10) if i != gone and i != 8]
        if units[1] != units[6]:
            order.remove(1)
            order.insert(order.index(6) + 1, 1)
        ids = {}
        for i, s in enumerate(src):
            no += 1
            ids[i] = no
            rows.append((no, f"d{d}", "src", "en", i, s))
        for j, i in enumerate(order):
            no += 1
            text = tgt[i][1]
            if i == 7:
                text = text.rstrip("。！？") + "，" + tgt[8][1]
                truth.add((ids[8], no))
            truth.add((ids[i], no))
            rows.append((no, f"d{d}", "tgt", "zh", j, text))
    return rows, truth


def run(spark, rows):
    glossary = spark.createDataFrame(TERMS, "term_id int, term_en string, term_zh string, term_de string, term_ja string")
    return B.align_documents(spark.createDataFrame(rows, SCHEMA), glossary).collect()


def test_accuracy_on_held_out_documents(spark):
    rows, truth = corpus(60)
    got = {(r["src_id"], r["tgt_id"]) for r in run(spark, rows + rows[:30])}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95


def test_a_large_lexicon_is_joined_with_the_same_result(spark, monkeypatch):
    rows, _ = corpus(25)
    rows += [(10_000 + 2 * i + k, "long", ("src", "tgt")[k], ("en", "zh")[k], i, (f"Section {i + 1000} describes the site plan.", f"第{i + 1000}节说明总平面图。")[k]) for i in range(60) for k in (0, 1)]
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    sent = sorted(map(tuple, run(spark, rows)))
    monkeypatch.setattr(B, "MOST_SENT", 0)
    assert sorted(map(tuple, run(spark, rows))) == sent


def test_the_driver_never_holds_the_rows_of_a_lexicon_it_sends(spark):
    found = spark.range(60_000).selectExpr("concat('left', id % 9000) as x", "concat('right', id) as y", "1 / (1 + id % 5) as dice")
    share = spark.range(9_000).selectExpr("concat('left', id) as w", "id / 9000 as share")
    tracemalloc.start()
    pairs, words = B.sent_lexicon(found, share)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000 * 60
    lexicon = B.Lexicon(B.unpacked(pairs), dict(B.unpacked(words)))
    assert {(x, y, d) for x, ys in lexicon.partners.items() if x.startswith("left") for y, d in ys.items()} == {tuple(r) for r in found.collect()}
    assert lexicon.shares == {r["w"]: r["share"] for r in share.collect()}


def test_no_side_is_broadcast_by_an_estimate(spark, monkeypatch, tmp_path):
    rows, _ = corpus(5)
    rows += [(10_000 + 2 * i + k, "long", ("src", "tgt")[k], ("en", "zh")[k], i, (f"Section {i + 1000} describes the site plan.", f"第{i + 1000}节说明总平面图。")[k]) for i in range(60) for k in (0, 1)]
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    monkeypatch.setattr(B, "MOST_SENT", 0)
    plans, cut = [], B.cut_lineage

    def noted(df):
        plans.append(df)
        return cut(df)

    monkeypatch.setattr(B, "cut_lineage", noted)
    glossary = spark.createDataFrame(TERMS, "term_id int, term_en string, term_zh string, term_de string, term_ja string")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path := str(tmp_path / "sentences"))  # files have an estimate
    plans.append(B.align_documents(spark.read.parquet(path), glossary))
    assert len(plans) > 6
    for df in plans:
        q = df._jdf.queryExecution()
        assert q.sparkPlan().toString().count("BroadcastHashJoin") == q.optimizedPlan().toString().count("strategy=broadcast"), df.columns


def test_long_sentences_teach_words_too(spark):
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = []
    for d in range(4):
        rows += [(4 * d, f"d{d}", "src", "en", 0, f"{d + 500} zebra " + " ".join(filler)), (4 * d + 1, f"d{d}", "tgt", "de", 0, f"{d + 500} lampe " + " ".join("v" + f[1:] for f in filler))]
    df = B.clean_rows(spark.createDataFrame(rows, SCHEMA))
    found, _ = B.learn(df, [])
    assert ("lampe", "zebra") in {(r["x"], r["y"]) for r in found.collect()}


def test_trie_finds_what_an_alternation_finds():
    rng = random.Random(2)
    for _ in range(50):
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        text = "".join(rng.choice("abc ") for _ in range(60))
        plain = re.compile("|".join(sorted(words, key=len, reverse=True)))
        assert re.findall(B._trie(sorted(words)), text) == plain.findall(text)


def test_blocks_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    rows = []
    for i in range(300):
        rows += [(2 * i, "long", "src", "en", i, f"Section {i + 1000} describes the site plan."), (2 * i + 1, "long", "tgt", "zh", i, f"第{i + 1000}节说明总平面图。")]
    assert {(r["src_id"], r["tgt_id"]) for r in run(spark, rows)} == {(2 * i, 2 * i + 1) for i in range(300)}


def test_dirty_rows(spark):
    rows = [(1, "d", "src", None, 0, "Never fold the site plan!"), (2, "d", "tgt", None, 0, None), (3, "d", "tgt", "zh", 1, " ​"), (4, "d", "tgt", "zh", 2, "切勿折叠总平面图！"), (5, None, "src", "en", 0, "x"), (6, "d", "other", "en", 0, "x"), (7, "d", "src", "en", None, "no place"), (8, "e", "src", "en", 0, "alone"), (None, "d", "tgt", "zh", 3, "x")]
    assert [(r["src_id"], r["tgt_id"]) for r in run(spark, rows)] == [(1, 4)]
    assert run(spark, rows[:0]) == []


def sentences(texts, lexicon):
    return [B.Sentence(i, t, B.Terms([]), lexicon) for i, t in enumerate(texts)]


def test_a_moved_row_is_found_behind_many_longer_ones():
    lexicon = B.Lexicon([], {})
    letters = "abcdefghijklmnopqrst"
    longer, others = (["zebra quartz marble note remark " + " ".join(f"{x}{y}{end}" for y in letters) for x in letters] for end in ("word", "form"))
    numbered = [f"Section {n} of part {n + 500}" for n in range(1000, 1010)]
    src = sentences([*others, *numbered, "zebra quartz marble note"], lexicon)
    tgt = sentences(["zebra quartz marble remark", *numbered, *longer], lexicon)
    assert (30, 0) in {(i, j) for i, j, _ in B.align(src, tgt, lexicon)}


def test_a_large_gap_is_aligned_as_a_whole():
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "17", "23", "99"]
    lexicon = B.Lexicon([("alpha", "beta", 0.4), ("gamma", "omega", 0.6)], {"alpha": 0.1, "gamma": 0.01})
    gain = lambda found: sum((like - B.NEED) * (i1 - i0 + j1 - j0) for i0, i1, j0, j1, like in found)
    for _ in range(60):
        src, tgt = (sentences([" ".join(rng.sample(words, rng.randrange(4))) or "-" for _ in range(rng.randrange(1, 12))], lexicon) for _ in range(2))
        assert abs(gain(B.align_gap(p := B.Pairs(src, tgt, lexicon), 0, len(src), 0, len(tgt))) - gain(B.align_wide(p, 0, len(src), 0, len(tgt)))) < 1e-9


def test_a_large_gap_with_a_missing_part_keeps_its_pairs():
    lexicon = B.Lexicon([], {})
    alpha = "abcdefghij"
    name = lambda n: "".join(alpha[int(c)] for c in f"{n:04d}")
    src = sentences([f"only {name(9000 + n)}" for n in range(100)] + [f"{name(n)}x{name(n)} moss" for n in range(100)], lexicon)
    tgt = sentences([f"{name(n)}x{name(n)} fern" for n in range(100)], lexicon)
    assert {(100 + n, n) for n in range(100)} == {(i0, j0) for i0, _, j0, _, _ in B.align_gap(B.Pairs(src, tgt, lexicon), 0, 200, 0, 100)}
    one = B.align_gap(B.Pairs(src[100:101], tgt[:1] + src[:100] + tgt[:1] * 99, lexicon), 0, 1, 0, 200)
    assert len(one) == 1


def test_blocks_follow_omissions_and_moves(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    src = [(i, "long", "src", "en", i, f"Section {i + 1000} describes the site plan.") for i in range(400)]
    kept = [5, *range(100, 390), *range(390, 400)]  # the target lacks 100 rows, and one has moved far
    kept = [*kept[1:], 5]
    tgt = [(1000 + i, "long", "tgt", "zh", j, f"第{i + 1000}节说明总平面图。") for j, i in enumerate(kept)]
    assert {(r["src_id"], r["tgt_id"]) for r in run(spark, src + tgt)} == {(i, 1000 + i) for i in kept}


def test_a_long_document_without_anchors_stays_whole(spark, monkeypatch):
    rows = [(i, "long", "src", "en", i, "The site plan.") for i in range(30)] + [(100 + i, "long", "tgt", "zh", i, "总平面图。") for i in range(30)]
    whole = sorted(map(tuple, run(spark, rows)))
    monkeypatch.setattr(B, "BLOCK_ROWS", 10)
    assert sorted(map(tuple, run(spark, rows))) == whole
