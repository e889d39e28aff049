"""Hierarchies, change capture, ranks, schedules and text functions against brute force, with nulls, repeats, ties and empty tables."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam import session as S
from lodeseam.config import Settings, from_env
from lodeseam.functions import embed
from lodeseam.functions import text as T
from lodeseam.functions import urls as U
from lodeseam.operators import changes as C
from lodeseam.operators import hierarchy as H
from lodeseam.operators import ranking as R
from lodeseam.operators import search
from lodeseam.sources import html, robots, throttle
from lodeseam.tables import BLANKS, current_rows, folded, strip


def place(parent):
    """Place of every node by walking."""
    out = {}
    for n in parent:
        path, at = [n], parent[n]
        while at is not None and at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out[n] = ("root", path[-1], len(path) - 1, path[::-1])
        elif at not in parent:
            out[n] = ("orphan", None, None, None)
        else:
            out[n] = ("cycle" if at == n else "below_cycle", None, None, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy(spark, seed):
    rng, n = random.Random(seed), 70
    parent = {f"n{i}": rng.choice([None, f"n{rng.randrange(n)}", f"n{max(0, i - 1)}", "lost"]) if i % 9 else (None if i else None) for i in range(n)}
    parent |= {f"deep{i}": f"deep{i - 1}" if i else None for i in range(70)} | {"self": "self", "under": "self", "a": "b", "b": "c", "c": "a", "far": "under", "hub": None} | {f"h{i}": "hub" for i in range(60)}
    want = place(parent)
    df = spark.createDataFrame([*parent.items()], "id string, parent string").withColumn("up", F.lit("clash"))
    placed = H.resolve(df, paths=True)
    assert {r.id: (r.state, r.root, r.depth, r.path) for r in placed.collect()} == want
    below = {(r.id, r.below, r.distance) for r in H.descendants(placed).collect()}
    assert below == {(a, n, len(w[3]) - 1 - i) for n, w in want.items() if w[3] for i, a in enumerate(w[3][:-1])}
    sizes = {r.id: r.n_below for r in H.subtree_sizes(placed).collect()}
    assert sizes["hub"] == 60 and sizes["deep0"] == 69 and sizes["deep69"] == 0
    assert H.resolve(df.where("false")).collect() == []


def stamp(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def test_changes_against_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        at = rng.randrange(400)
        rows.append((f"p{rng.randrange(12)}", rng.randrange(1, 9), stamp(at), rng.choice([None, "", 'W/"e1"', '"e1"', " e2 ", "e2"]), rng.choice([None, "", "Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "1994-11-06T09:49:37+01:00", "1994-11-07T08:49:37Z"]), rng.choice([None, "x", "y"])))
    rows = list({(r[0], r[2]): r for r in rows}.values())
    rows += [(r[0], min(9, r[1] + 1), *r[2:]) for r in rows[::7]] + [(None, 1, stamp(1), None, None, None), ("q", None, stamp(1), None, None, None)] + rows[:5]
    pages = spark.createDataFrame(rows, "id string, run_no int, crawled_at timestamp_ntz, etag string, last_modified string, text string").withColumn("row", F.lit(1))
    state = {1: "done", 2: "failed", 3: "done", 4: "failed", 5: "failed", 6: "done", 7: "Done", 8: "failed", 9: "done"}
    runs = spark.createDataFrame([*state.items()], "run_no int, state string")

    day = {"Sun, 06 Nov 1994 08:49:37 GMT": 1, "Sunday, 06-Nov-94 08:49:37 GMT": 1, "Sun Nov  6 08:49:37 1994": 1, "1994-11-06T09:49:37+01:00": 1, "1994-11-07T08:49:37Z": 2}
    tag = lambda e: (e or "").strip().removeprefix("W/").strip('"') or None

    def same(a, b):
        if tag(a[3]) and tag(b[3]):
            return tag(a[3]) == tag(b[3])
        if day.get(a[4]) and day.get(b[4]):
            return day[a[4]] == day[b[4]]
        return a[5] == b[5]

    want, before = set(), {}
    for run in [r for r, s in sorted(state.items()) if s.lower() == "done"]:
        now = {}
        for r in rows:
            if r[0] and r[1] and r[1] <= run and (r[0] not in now or r[2] > now[r[0]][2]):
                now[r[0]] = r
        want |= {(run, i) for i, r in now.items() if i not in before or not same(r, before[i])}
        before = now

    whole = C.ChangeCapture(spark, f"{tmp_path}/whole")
    assert whole.run(pages, runs) == 1 and whole.run(pages, runs) == 0
    assert {tuple(r) for r in whole.sink().collect()} == want

    # run by run, with failures after the plan and after a half-done execution; the source grows before the replay
    step = C.ChangeCapture(spark, f"{tmp_path}/step", partitions=3, compact=2)
    for upto in (1, 3, 6, 7, 9):
        seen, known = pages.where(F.col("run_no") <= upto), runs.where(F.col("run_no") <= upto)
        plan = step.plan(seen, known)
        if upto in (3, 7):
            step.execute(plan)
            S.remove(spark, f"{tmp_path}/step/sink/{plan['batch']}")  # lost: no commit
            assert step.plan(pages, known) == plan
        assert step.run(pages if upto == 7 else seen, known) == 1
    rows_out = [tuple(r) for r in step.sink().collect()]
    assert set(rows_out) == want and len(rows_out) == len(want)
    assert sum(step.offsets().values()) == len({r for r in rows if r[0] and r[1]})
    empty = C.ChangeCapture(spark, f"{tmp_path}/empty")
    assert empty.run(pages, runs.where("false")) == 0 and empty.sink().collect() == []


def test_late_rows_and_late_runs(spark, tmp_path):
    """A row after its run was reported, and a run found finished after a later one, are reported once; from files and from tables."""
    schema = "id string, run_no int, crawled_at timestamp_ntz, etag string, last_modified string, text string"
    row = lambda i, run, at, tag: (i, run, stamp(at), tag, None, None)
    steps = [
        ([row("a", 1, 1, "1"), row("b", 1, 1, "1"), row("b", 3, 3, "3"), row("f", 5, 5, "1")], {1: "done", 2: "failed", 3: "done"}, {(1, "a"), (1, "b"), (3, "b")}),
        ([row("a", 2, 9, "2"), row("c", 2, 2, "1"), row("b", 2, 2, "old"), row("a", 1, 1, "1")], {1: "done", 2: "failed", 3: "done"}, set()),
        ([row("d", 4, 4, "1")], {1: "done", 2: "done", 3: "done", 4: "done"}, {(2, "a"), (2, "c"), (4, "d")}),
        ([], {1: "done", 2: "done", 3: "done", 4: "done", 5: "done", 6: "done"}, {(5, "f")}),
        ([row("e", 1, 1, "1")], {r: "done" for r in range(1, 8)}, {(7, "e")}),
    ]
    by_files, by_table = C.ChangeCapture(spark, f"{tmp_path}/f", compact=3), C.ChangeCapture(spark, f"{tmp_path}/t")
    table, want = spark.createDataFrame([], schema), []
    for k, (new, states, reported) in enumerate(steps):
        arrived = spark.createDataFrame(new, schema)
        arrived.write.parquet(f"{tmp_path}/in/{k}")
        table, runs, want = table.unionByName(arrived), spark.createDataFrame([*states.items()], "run_no int, state string"), [*want, *reported]
        for capture, source in ((by_files, f"{tmp_path}/in"), (by_table, table)):
            assert capture.run(source, runs) == (len(reported) > 0)
            assert sorted(tuple(r) for r in capture.sink().collect()) == sorted(want)


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.5, None, 7.0])) for _ in range(200)] + [("hot", 1.0)] * 100
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(0))
    got = sorted(((r.g or "", -1 if r.v is None else r.v, r.rank) for r in R.with_rank(df, ["g"], F.col("v")).collect()))
    less = lambda a, b: (a is not None, a or 0) < (b is not None, b or 0)
    want = sorted((g or "", -1 if v is None else v, 1 + sum(h == g and less(w, v) for h, w in rows)) for g, v in rows)
    assert got == want
    assert R.with_rank(df.where("false"), ["g"], F.col("v")).collect() == []


def test_schedule(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "b", None]), stamp(0) + dt.timedelta(seconds=rng.randrange(60)) if i % 13 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, host string, at timestamp_ntz")
    got = {r.id: r.start for r in throttle.schedule(df, "host", F.col("at"), "id", 2.0).collect()}
    base = stamp(0).replace(tzinfo=dt.timezone.utc).timestamp()
    for host in ("a", "b"):
        free = 0.0
        for i, _, at in sorted((r for r in rows if r[1] == host and r[2]), key=lambda r: (r[2], r[0])):
            free = max(free, (at - stamp(0)).total_seconds())
            assert got[i] - base == pytest.approx(free)
            free += 2.0
    assert all(got[r[0]] is None for r in rows if not r[1] or not r[2]) and len(got) == 120


def test_throttle_waits():
    now, slept = [100.0], []
    wait = throttle.Throttle(2.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert wait("http://a/x") == 0 and wait("http://A/y") == 2.0 and wait("http://b/") == 0 and slept == [2.0]
    assert throttle.Throttle(0)("http://a") == 0


def fold(text, size=1200, overlap=150):
    """The chunk rules, step by step."""
    out, buf = [], ""
    for p in [p.strip() for p in text.split("\n") if p.strip()]:
        if len(p) > size or len(buf) + len(p) + 1 > size:
            tail = buf[-overlap:] if overlap and len(buf) > overlap else ""
            out += [buf.strip()] if buf.strip() else []
            if len(p) > size:
                out += [p[i : i + size].strip() for i in range(0, len(p), size - overlap)]
                buf = ""
            else:
                buf = (tail + " " + p).strip() if tail else p
        else:
            buf = (buf + "\n" + p).strip()
    return out + ([buf.strip()] if buf.strip() else [])


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["", " \n \n", "a", "x" * 95, "　é\n" * 30, None] + ["\n".join(rng.choice(["word " * rng.randrange(1, 12), "y" * rng.randrange(1, 90), "数" * 35, "\t"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.chunks(F.col("t"), 40, 10).alias("c")).collect()}
    assert got == {i: None if t is None else fold(t, 40, 10) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        T.chunks(F.col("t"), 10, 10)


def test_text_columns(spark):
    df = spark.createDataFrame([("für_x A1", BLANKS + "q" + BLANKS, "a<b>&\"'"), (None, None, None)], "a string, b string, c string")
    r = df.select(T.tokens(F.col("a")).alias("t"), strip(F.col("b")).alias("s"), T.escaped(F.col("c")).alias("e"), folded(F.lit("Straße ΣΑΣ")).alias("f")).collect()
    assert r[0].t == ["f", "r", "x", "a1"] and r[0].s == "q" and r[0].e == "a&lt;b&gt;&amp;&quot;&#x27;" and r[0].f == "strasse σας"
    assert r[1].t is None and r[1].s is None
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(T.normalized(F.col("v")).alias("v")).collect()
    assert v[0].v == pytest.approx([0.6, 0.8]) and v[1].v == [0, 0]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "ab cd ab"), (2, ""), (3, None)], "i int, text string")
    e = {r.i: r.e for r in df.select("i", embed.embedder("hashing", 16).column(F.col("text")).alias("e")).collect()}
    cells_ = {(r.i, r.bucket): r.value for r in search.hash_embedding(df, "i", 16).collect()}
    assert all(e[1][b] == pytest.approx(cells_.get((1, b), 0.0)) for b in range(16)) and e[2] == [0.0] * 16 and e[3] is None

    class Length:
        dimensions = 1

        def column(self, text):
            return F.array(F.length(text).cast("float"))

    embed.register("length", lambda dimensions: Length())
    assert embed.embedder("length").dimensions == 1 and isinstance(embed.embedder("what"), embed.HashingEmbedder)
    with pytest.raises(ValueError):
        embed.HashingEmbedder(0)


def test_current_rows(spark):
    df = spark.createDataFrame([("a", stamp(1), 1, "x"), ("a", stamp(2), 1, "y"), ("a", stamp(2), 2, "y"), ("a", None, 9, "z"), (None, stamp(5), 1, "n"), ("b", None, None, None)], "id string, crawled_at timestamp_ntz, run_no int, t string")
    assert {tuple(r) for r in current_rows(df, t=F.col("t")).collect()} == {("a", "y"), ("b", None)}


@settings(max_examples=200, deadline=None)
@given(st.text("ab/:?#.[]@ \n", max_size=20))
def test_links_never_fail(href):
    got = U.resolve_link("http://h.example/d/p", href)
    assert got is None or got.startswith("http")


def test_links():
    r = lambda h: U.resolve_link("http://h.example/d/p", h)
    assert [r("q"), r("/x/"), r("#a"), r("mailto:a@b"), r(" ../y#f "), r("//other/z//"), r("ftp://h/"), r(""), r("http://[bad")] == ["http://h.example/d/q", "http://h.example/x", None, None, "http://h.example/y", "http://other/z", None, None, None]


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>x</style></head><body><h1>H</h1><p>one<p>two <b>bold</b><script>'</p>'</script><table><td>c</td><td>d</td></table><a href='/x'>l</a><noscript><a href='/y'>n</a></noscript><a>none</a>"
    assert html.read(page) == ("A & B", "H\none\ntwo boldcdlnone", ["/x", "/y"])
    assert html.read("<h1>Only <i>this</i></h1>") == ("Only this", "Only this", []) and html.read("") == ("", "", []) and html.read(None) is None
    df = spark.createDataFrame([(page,), (None,)], "h string").select(html.extracted(F.col("h")).alias("x")).collect()
    assert df[0].x.links == ["/x", "/y"] and df[1].x.title is None


def test_robots(spark):
    body = "User-agent: *\nAllow: /open/a\nDisallow: /open\nCrawl-delay: 3\n\nUser-agent: lode\nUser-agent: other\nDisallow: /mine # x\nCrawl-delay: 0.5\nCrawl-delay: bad\n"
    table = robots.rule_table(spark.createDataFrame([("h", body), ("e", ""), ("n", None)], "host string, body string"))
    urls = spark.createDataFrame([(f"http://{u}",) for u in ("h/open/a/1", "h/open/b", "h/mine", "h/", "e/open", "x/open")] + [(None,)], "url string")
    closed = lambda agent: {r.url for r in robots.allowed(urls, table, agent).where("not allowed").collect()}
    assert closed("bot/1") == {"http://h/open/b"} and closed("LodeSeam/1.0") == {"http://h/mine"}
    assert robots.allowed(urls, table, "bot").count() == 7
    assert [tuple(r) for r in robots.delays(table, "bot", 1.0).collect()] == [("h", 3.0)] and [tuple(r) for r in robots.delays(table, "lodeseam", 1.0).collect()] == [("h", 1.0)]
    assert closed_none(robots, urls, table.where("false"))


def closed_none(robots, urls, table):
    return robots.allowed(urls, table, "bot").where("not allowed").count() == 0


def test_settings():
    s = from_env({"LODESEAM_MAX_PAGES": "7", "LODESEAM_CRAWL_DELAY": "bad", "LODESEAM_RESPECT_ROBOTS": "maybe", "LODESEAM_PRUNE_MISSING": " YES ", "LODESEAM_STORE": "x"})
    assert s == Settings(max_pages=7, respect_robots=False, prune_missing=True, store="x")


def test_search(spark):
    chunks = spark.createDataFrame([("c1", "p1", 0, "alpha beta beta"), ("c2", "p1", 1, "gamma"), ("c3", "px", 0, "alpha"), ("c3", "px", 0, "alpha"), ("c4", "p2", 0, None), ("c5", "p2", 1, "")], "id string, page_id string, seq int, text string")
    chunks = chunks.withColumn("embedding", embed.embedder().column(F.col("text")))
    pages = spark.createDataFrame([("p1", "u1", "t1"), ("p2", "u2", None)], "id string, url string, title string")
    queries = spark.createDataFrame([(1, "alpha", 2), (2, "", 1), (3, "beta", 99), (4, None, 1), (5, "zzz", 3)], "query_id bigint, query_text string, top_k int")
    got = search.hybrid(chunks, queries, pages).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id, r.method, r.page_url) for r in got if r.query_id == 1] == [(1, "c3", "hybrid", ""), (1, "c1", "hybrid", "u1")]
    assert [(r.query_id, r.score, r.method) for r in got if r.query_id in (2, 4)] == [(2, 0.0, "semantic"), (4, 0.0, "semantic")]
    assert {r.query_id for r in got} == {1, 2, 4, 5}
    assert search.hybrid(chunks.where("false"), queries, pages).collect() == []
    # stored vectors decide, whatever the text; those of another length count 0
    own = spark.createDataFrame([("a", "p1", 0, "x", [0.0, 1.0]), ("b", "p1", 1, "x", [1.0, 0.0]), ("c", "p1", 2, "x", [1.0]), ("d", "p1", 3, "x", [float("nan"), 1.0])], "id string, page_id string, seq int, text string, embedding array<float>")

    class Fixed:
        dimensions = 2

        def column(self, text):
            return F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")

    assert [(r.chunk_id, r.score, r.method) for r in search.hybrid(own, queries.where("query_id = 5"), pages, by=Fixed()).orderBy("place").collect()] == [("b", 0.6, "semantic"), ("a", 0.0, "semantic"), ("c", 0.0, "semantic")]
    many = spark.createDataFrame([(i, f"alpha q{i}", 2) for i in range(300)], "query_id bigint, query_text string, top_k int")
    assert sum(len(b) for b in search.blocks(many, 1000)) == 300 and len(list(search.blocks(many, 1000))) > 3
    k = search.bm25_topk(chunks.dropDuplicates(), "id", queries, 1).collect()
    assert {(r.query_id, r.id) for r in k} == {(1, "c3"), (3, "c1")}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0])], "id bigint, embedding array<float>")
    top = search.cosine_topk(v, "id", v.where("id = 1").withColumnRenamed("id", "query_id"), 2).orderBy("place").collect()
    assert [(r.id, r.score) for r in top] == [(6, 1.0), (2, 0.9988)]
