"""The llm operators on small cases: nulls, blanks, ties, repeats, empty tables, clashing names, and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.llm import boilerplate, bpe, fusion, mixing, neighbours, repeats, segments, sentences

VOCAB = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"


def merged(ranks, raw):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if r == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text("aeth ing0中ก'.\n", max_size=60))
def test_bpe_equals_merging(text):
    e = bpe.encoder(VOCAB)
    want = [i for p in e.find(text) for i in merged(e.ranks, p.encode("utf-8", "surrogatepass"))]
    assert e.encode(text) == want
    assert b"".join(e.bytes[i] for i in e.encode(text)).decode("utf-8", "surrogatepass") == text


def test_bpe_equals_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ["", " ", "Hello  world!\n\n x", "<|endoftext|>", "é中文ไทย 🚀🧪", "a" * 3000, "don't 12345 ١٢٣"]:
        assert bpe.encoder(VOCAB).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_encoded_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "ab " * 20000), (4, "x")], "doc_id bigint, text string")
    rows = bpe.encoded(df).collect()
    assert [len(r.ids) for r in rows[:3]] == [0, 0, 1] and len(rows) == 5
    assert sorted(r.n_tokens for r in bpe.counted(df).collect()) == sorted(len(r.ids) for r in rows)
    with pytest.raises(ValueError):
        bpe.encoded(df.withColumn("ids", F.lit(1)))
    assert bpe.encoded(df.where("false")).collect() == []


def test_repeated_lines(spark):
    pages = [(f"p{i}", "A", f"Menu  {i}\nBody {'x' * i}\nmenü" if i % 2 else f"MENU {i}\nown {'y' * i}") for i in range(10)]
    pages += [("q", "A", None), ("r", None, "Menu 1"), *[(f"s{i}", "B", "Menu 1") for i in range(4)]]
    df = spark.createDataFrame(pages, "id string, source string, text string").withColumn("lines", repeats.parsed(F.col("text")))
    got = {tuple(r) for r in repeats.repeated_lines(df).collect()}
    assert got == {(f"p{i}", 0) for i in range(10)} | {(f"p{i}", 2) for i in range(10) if i % 2}
    texts = {r.id: r.text for r in repeats.without_repeats(df).collect()}
    assert texts["p1"] == "Body x" and texts["r"] == "Menu 1" and texts["q"] is None and len(texts) == 16
    assert {r.template for r in repeats.templates(df).collect()} == {"menu 0", "menü"}
    assert repeats.repeated_lines(df.where("false")).collect() == []


def test_templates_with_slots(spark):
    """Wordings that are each too rare make a template by what they share; its cover counts a document once."""
    rows = [(f"p{i}", "A", f"Last edited by user{'x' * i}\nLast edited by other\nSee also the {'x' * i}\nown {'y' * i} text") for i in range(6)]
    rows += [(f"e{i}", "A", "") for i in range(4)] + [(f"f{i}", "B", f"Last edited by {'x' * i}") for i in range(4)]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    got = {tuple(r) for r in repeats.templates(df).select("source", "template", "wordings", "docs").collect()}
    assert got == {("A", "last edited by <*>", 7, 6), ("A", "see also the <*>", 5, 5)}  # "See also the " of p0 has three tokens
    lines = df.withColumn("lines", repeats.parsed(F.col("text")))
    assert {tuple(r) for r in repeats.repeated_lines(lines).collect()} == {(f"p{i}", 1) for i in range(6)}


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n中。x!", max_size=400), st.integers(40, 90))
def test_pieces_cover_the_text(text, size):
    parts = segments.split(text, size, 10)
    assert all(e - a <= size for a, e in parts)
    if text:
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
        assert all(a < b and b <= e and f >= e for (a, e), (b, f) in zip(parts, parts[1:]))


def test_pieces_keep_the_rules():
    rng = random.Random(5)
    for _ in range(20):
        text = "".join(rng.choice(["lorem ", "ipsum. ", "word\n", "x" * 60, "数据", "。"]) for _ in range(900))
        parts = segments.split(text)
        for (a, e), (b, f) in zip(parts, parts[1:]):
            assert not segments.faulty(text[b:f], text[a:e], text)
    assert segments.split(None) == segments.split("") == []
    with pytest.raises(ValueError):
        segments.split("x", 10, 9)


def test_pieces_end_before_a_long_line():
    text = "A short line stands here\n" * 20 + "word " * 300
    first = segments.split(text)[0]
    assert text[first[1] - 1] == "\n" and 150 < first[1] <= 500
    short = "Here is one. " * 30 + "word " * 300
    assert short[: segments.split(short)[0][1]].endswith("one.")


def test_valleys_lie_between_topics():
    cats, dogs = "The cat purrs at the cat bowl. ", "A dog barks near that dog house. "
    text = cats * 12 + dogs * 12
    gaps = [m.end() for m in segments._SENTENCE.finditer(text)][:-1]
    depth = segments.valleys(text, gaps)
    assert abs(gaps[depth.index(max(depth))] - len(cats) * 12) <= 2 and min(depth) >= 0
    assert segments.valleys("", []) == []


def test_audit(spark):
    text = " ".join(f"word{i}" for i in range(400))
    good = [(text[a:e]) for a, e in segments.split(text)]
    rows = [("p", i, t) for i, t in enumerate(good)] + [("p", 0, good[0]), ("q", 0, "ord1 word2"), ("q", 1, None), ("q", 2, "no part"), ("z", 0, "lost"), (None, 0, "x")]
    stored = spark.createDataFrame(rows, "page_id string, seq int, text string").withColumn("whole", F.lit("clash"))
    pages = spark.createDataFrame([("p", text), ("q", text), ("n", None)], "page_id string, text string")
    assert {tuple(r) for r in segments.audit(stored, pages).collect()} == {("q", 0), ("q", 1), ("q", 2)}
    assert segments.pieces(pages).where("page_id = 'p'").count() == len(good)


def test_fusion(spark):
    rows = [(1, "a", 0.9, "x"), (1, "b", 0.5, " X "), (1, "b", 0.5, "x"), (1, "a", 100.0, "low"), (1, "b", 5.0, "LOW"), (1, "c", float("nan"), "x"), (1, "d", None, "x"), (1, "a", 1.0, "unknown"), (2, "a", 0.1, "x"), (3, "a", 0.1, "x")]
    res = spark.createDataFrame(rows, "query_id bigint, chunk_id string, score double, method string")
    methods = spark.createDataFrame([("x", "high"), ("low", "low")], "method string, better string")
    got = {(r.query_id, r.chunk_id): r.total for r in fusion.fused(fusion.scores(res, methods)).collect()}
    assert got == {(1, "a"): pytest.approx(1 / 61 + 1 / 62), (1, "b"): pytest.approx(1 / 61 + 1 / 62), (2, "a"): pytest.approx(1 / 61), (3, "a"): pytest.approx(1 / 61)}
    queries = spark.createDataFrame([(1, 1), (2, None), (9, 3)], "query_id bigint, top_k int")
    assert [tuple(r)[:2] for r in fusion.best(fusion.fused(fusion.scores(res, methods)), queries).collect()] == [(1, "a")]
    assert fusion.best(fusion.fused(fusion.scores(res.where("false"), methods)), queries.where("false")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 4)), min_size=1, max_size=5), st.integers(0, 60))
def test_subset_sum_is_exact(hist, budget):
    hist = list(dict(hist).items())
    sums = {0}
    for n, c in hist:
        sums = {s + n * i for s in sums for i in range(c + 1)}
    got = mixing.subset_sum([n for n, _ in hist], [c for _, c in hist], budget)
    assert all(0 <= g <= c for g, (_, c) in zip(got, hist, strict=True))
    assert sum(g * n for g, (n, _) in zip(got, hist, strict=True)) == max(s for s in sums if s <= budget)


def test_fit_keeps_lengths_even_where_each_is_rare():
    rng = random.Random(1)
    lengths = sorted(rng.sample(range(50, 60_000), 9_000))
    total = sum(lengths)
    whole, extra = mixing.fit(lengths, [1] * len(lengths), total // 3, 2)
    assert whole == 0 and sum(n * x for n, x in zip(lengths, extra)) == total // 3
    tens = [sum(extra[i : i + 900]) / 900 for i in range(0, 9000, 900)]
    assert all(abs(t - 1 / 3) < 0.04 for t in tens)
    assert mixing.fit([1_000_000], [10], 2_500_000, 1) == (0, [2])


def test_mix(spark):
    docs = spark.createDataFrame([(i, [" Web", "web", "WEB "][i % 3] if i < 60 else "tiny" if i < 65 else None, 5 + i % 7) for i in range(100)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("Web", 0.5, 2), ("tiny", 0.4, 3), ("none", 0.1, 1), ("zero", 0.0, 1), ("null", None, 1)], "source string, weight double, max_repeats int")
    plan = mixing.plan(docs, targets)
    assert {r.source for r in plan.where("short").collect()} == {"tiny", "none"}
    rows = {r.source: r for r in plan.collect()}
    mix = mixing.select(docs, plan)
    got = {r.source: r.t for r in mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert got["web"] == rows["Web"].budget == round(0.5 * rows["Web"].total) and got["tiny"] == 3 * rows["tiny"].tokens
    assert mix.agg(F.max("copies")).first()[0] <= 3
    shares = {r.source: r.share for r in mixing.shares(plan).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["none"] == 0
    assert mixing.plan(docs.where("false"), targets).where("short").count() == 3


def test_pairs_against_all(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 64))
    x[300:330] = x[:30] + 0.02 * rng.standard_normal((30, 64))
    x[400:410] = 3 * x[30:40]
    x[500:503] = x[50]
    rows = [(f"{i:04d}", [float(v) for v in y]) for i, y in enumerate(x)]
    rows += [rows[7], ("n", None), ("e", []), ("z", [0.0] * 64), ("x", [float("nan")] * 64), ("s", rows[0][1][:48]), ("two", rows[20][1]), ("two", rows[60][1]), *[(f"copy{i:02d}", [1.0] * 64) for i in range(15)]]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("v", F.lit(0))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(f"{i:04d}", f"{j:04d}") for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j} | {("copy00", f"copy{i:02d}") for i in range(1, 15)} | {("0020", "two"), ("0060", "two"), ("0320", "two")}
    for cells, block in ((None, neighbours.CELL), (8, 20)):
        got = [tuple(r) for r in neighbours.pairs(df, cells=cells, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    assert neighbours.pairs(df.where("false")).collect() == []
    members = {(r.id, r.class_id, r.copies) for r in neighbours.classes(df).collect()}
    assert ("copy07", "copy00", 15) in members and ("0501", "0050", 4) in members and ("s", "s", 1) in members and ("z", "z", 1) not in members and len(members) == 600 + 1 + 2 + 15


@pytest.mark.parametrize("cells,n", [(16, 200_000), (256, 8_000_000), (4096, 130_000_000)])
def test_reach_holds_as_cells_grow(cells, n):
    """Partners at the cosine itself are met however many cells there are, and the cells visited stay a small part of all."""
    x = neighbours._units(np.random.default_rng(5).standard_normal((6000, 64)).astype(np.float32))
    s = neighbours.fitted(x, n, 0.9, cells)
    new = neighbours._units(np.random.default_rng(6).standard_normal((4000, 64)).astype(np.float32))
    far = neighbours.directions(64, neighbours.MORE)
    for cosine in (0.9, 0.92):
        other, met = neighbours.partners(new, cosine, seed=8), np.zeros(len(new), bool)
        for a, b in ((new, other), (other, new)):
            inner = neighbours._leaf_cost(a @ far, b @ far, s.splits, s.levels) <= s.radius
            for t in range(s.tables):
                p, q = s.cell_coordinates(a, t), s.cell_coordinates(b, t)
                met |= inner & (p.max(1) - p[np.arange(len(p)), q.argmax(1)] <= s.reach)
        assert met.mean() >= 0.99
    visited = sum(len(row) for row, _, _ in neighbours.placed(s, new, np.arange(len(new)))) / len(new)
    assert visited <= 3 * cells**0.35


@pytest.mark.parametrize("cells", [None, 16])
def test_nearest_recall(spark, cells):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(f"{i}", y.tolist()) for i, y in enumerate(x)] + [("odd", [1.0, 2.0]), ("none", None)], "id string, embedding array<float>")
    got = neighbours.nearest(df, df.where("try_cast(id as int) < 60 or id = 'odd'"), 5, cells=cells).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, g in got.groupby("id"):
        s = u @ u[int(q)]
        s[int(q)] = -2
        hit += (g["cosine"] >= np.sort(s)[-5] - 1e-5).sum()
        assert len(g) <= 5
    assert hit >= 0.95 * 300
    assert neighbours.nearest(df.where("false"), df).collect() == [] and neighbours.nearest(df, df.where("false")).collect() == []


def test_template_lines():
    lines = ["Home | Docs", "A / B", "B", "By X editors", "Valid from 3.", "On this page", "One", "Two", "text one.", "One", "body.", "Cookies used.", "Two", "more body.", "Related", "Other page", "Share", "Imprint"]
    shares = [0.9, 0, 0, 0.9, 0.6, 0.7, 0, 0, 0, 0, 0, 0.9, 0, 0, 0.8, 0, 0.9, 0.9]
    want = [1, 1, 0, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1]
    assert boilerplate.template_lines(lines, shares, "B") == [bool(x) for x in want]
    assert boilerplate.template_lines(lines, shares, None) == [bool(x) for x in want]
    assert boilerplate.template_lines(["x"], [0.0], "B") == [False]


def test_breadcrumb_after_a_long_menu_and_contents():
    lines = [f"Menu {'abc'[i % 3]} {'x' * i}" for i in range(80)] + ["A / Heading", "Heading", "Text."]
    assert boilerplate.template_lines(lines, [0.0] * 83, None) == [True] * 81 + [False] * 2
    contents = lambda x: boilerplate._contents(x, 0, {v: [i for i, w in enumerate(x) if w == v] for v in x})

    def plain(x):
        m = 0
        while m + 1 < len(x) and all(y in it for it in [iter(x[m + 1 :])] for y in x[: m + 1]):
            m += 1
        return m

    rng = random.Random(3)
    for _ in range(400):
        x = [rng.choice("abc") for _ in range(rng.randrange(12))]
        assert contents(x) >= plain(x) and (contents(x) > 0) == (plain(x) > 0), x
    assert contents(["a", "changed", "c", "text.", "a", "b", "c"]) == 3 and contents(["a", "lost", "a", "text."]) == 2 and contents(["a", "text.", "a"]) == 1


def test_hot_source_is_spread(spark, monkeypatch):
    """Sources of many documents are salted, with the same result."""
    monkeypatch.setattr(repeats, "HOT", 7)
    pages = [(f"p{i}", "A" if i % 3 else "B" if i % 2 else None, f"Menu {i}\nown {'y' * i}") for i in range(60)]
    df = spark.createDataFrame(pages, "id string, source string, text string").withColumn("lines", repeats.parsed(F.col("text")))
    assert {(r.source, r.salts) for r in repeats.large(df.where("source is not null")).collect()} == {("A", 6), ("B", 2)}
    assert {tuple(r) for r in repeats.repeated_lines(df).collect()} == {(i, 0) for i, s, _ in pages if s}
    assert repeats.without_repeats(df).count() == 60


def test_boilerplate_table(spark):
    pages = [(f"p{i}", "s", f"Title {'abcdefghij'[i]}", f"Menu\nTitle {'abcdefghij'[i]}\nText {'q' * i}.\n© {2000 + i}") for i in range(10)]
    pages += [("n", "s", None, None), ("o", None, "T", "Menu\nT\nx"), ("e", "t", "", "one")]
    df = spark.createDataFrame(pages, "id string, source string, title string, text string").select("*", boilerplate.subtrees(F.col("text")).alias("lines"), boilerplate.subtrees(F.col("title")).alias("heading"))
    assert {tuple(r) for r in boilerplate.boilerplate_lines(df).collect()} == {(f"p{i}", k) for i in range(10) for k in (0, 3)} | {("o", 0)}
    assert {r.id: r.text for r in boilerplate.main_bodies(df).collect()}["p2"] == "Title c\nText qq."
    assert boilerplate.boilerplate_lines(df.where("false")).collect() == []


def test_sentences(spark):
    base = ["See if Fig. 3 is full. The disk is full. Dr. Brown left.", "The disk is full.\n\nThe log said, “It is full.” Then Dr. Brown left.\n\nThe log said, “It is full.”", "It asked \"Ready?\" and left. Dr. Brown left.", "完了です。記録には「空です。」とありました。本当に？！", "記録には「空です。」とありました。", "ห้ามปิดคิว ให้ปิดแคช", "1. The disk is full.\n \n2) Dr. Brown left.", "Heading\r\n\r\nThe disk\r\nis full."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base * 30)] + [(-1, None), (-2, ""), (-3, " \n ")], "doc_id bigint, text string")
    got = {}
    for r in sentences.split(docs).collect():
        if 0 <= r.doc_id < len(base):
            got.setdefault(r.doc_id, []).append(base[r.doc_id][r.start_char : r.end_char])
        assert r.doc_id >= 0
    assert [got[i] for i in range(len(base))] == [
        ["See if Fig. 3 is full.", "The disk is full.", "Dr. Brown left."],
        ["The disk is full.", "The log said, “It is full.”", "Then Dr. Brown left.", "The log said, “It is full.”"],
        ["It asked \"Ready?\" and left.", "Dr. Brown left."],
        ["完了です。", "記録には「空です。」とありました。", "本当に？！"],
        ["記録には「空です。」とありました。"],
        ["ห้ามปิดคิว", "ให้ปิดแคช"],
        ["1. The disk is full.", "2) Dr. Brown left."],
        ["Heading", "The disk\r\nis full."],
    ]


def test_sentences_without_marks(spark):
    """Running text without any mark is cut by the words alone, in scripts with blanks and without; headings are not."""
    base = ["The disk is full. Restart the server. Then check the log. The server is slow.", "Check the disk. The log is empty. Restart the disk. Then restart the server.", "Restarting the server\n\nThe log is full. Check the server.\n\nThe disk is full.", "台帳を停止します。鍵を確認します。複製は空です。", "複製を停止します。台帳は空です。鍵を圧縮します。"]
    plain = ["the disk is full restart the server then check the log", "Restarting the server", "鍵を停止します複製を確認します台帳は空です"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base * 40)] + [(1000 + i, t) for i, t in enumerate(plain)], "doc_id bigint, text string")
    got = {}
    for r in sentences.split(docs).where("doc_id >= 1000").orderBy("start_char").collect():
        got.setdefault(r.doc_id - 1000, []).append(plain[r.doc_id - 1000][r.start_char : r.end_char])
    assert got == {0: ["the disk is full", "restart the server", "then check the log"], 1: ["Restarting the server"], 2: ["鍵を停止します", "複製を確認します", "台帳は空です"]}


def test_pairs_of_words_of_every_document(spark):
    """The words of a few documents decide, however large the others are."""
    base = ["The disk is full. Restart the server. Then check the log. The server is slow.", "Check the disk. The log is empty. Restart the disk. Then restart the server.", "Restarting the server\n\nThe log is full. Check the server.\n\nThe disk is full."]
    plain = "the disk is full restart the server then check the log"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base * 40)] + [(1000, plain)], "doc_id bigint, text string")
    large = spark.range(5000, 5040).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" "), 4_000_000).alias("text"))
    both = docs.unionByName(large)
    got = sentences.split(both).where("doc_id >= 1000").orderBy("start_char").collect()
    cut = ["the disk is full", "restart the server", "then check the log"]
    assert [(r.doc_id, plain[r.start_char : r.end_char]) for r in got] == [(1000, t) for t in cut]
    model = sentences.train(both)
    of = {(r.before, r.word): r.n for r in model.pairs.collect()}
    code = sentences._token
    assert (of[code("disk"), code("is")], of[code("the"), code("disk")], of[code("is"), code("slow")]) == (80, 160, 39)
    assert [plain[a:b] for a, b in sentences.sentences(plain, model)] == cut


def test_sentences_of_wide_stops_and_long_words(spark):
    long = "x" * 5000 + "."
    text = f"鍵は空です．台帳を確認します．鍵は空です．\n\n{long} Next one is here. It is last.\n\n{long}\n\nIt is here."
    docs = spark.createDataFrame([(1, text)] * 20, "doc_id int, text string")
    got = {text[r.start_char : r.end_char] for r in sentences.split(docs).collect()}
    assert got == {"鍵は空です．", "台帳を確認します．", long, "Next one is here.", "It is last.", "It is here."}
    assert sentences.split(docs.where("false")).collect() == []
