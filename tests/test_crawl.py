"""Crawls of small sites into a store: levels, outcomes, incremental runs, pruning, serving and streams."""

import datetime as dt
import json
import time
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from lodeseam.config import Settings
from lodeseam.operators import crawl as C
from lodeseam.operators import sites
from lodeseam.operators import store as ST
from lodeseam.serving import service as SV
from lodeseam.sources.pages import FunctionSource, TableSource
from lodeseam.streaming import ingest

ROOT = "http://site.example"


def doc(title, *links, text="words here"):
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{text}</p>{''.join(f'<a href={chr(34)}{x}{chr(34)}>x</a>' for x in links)}</body></html>"


SITE = {"": doc("Root", "/install", "/api", "http://else.example/q", "mailto:a@b"), "/install": doc("Install", "/install/docker", "/"), "/install/docker": doc("Docker", text="needle"), "/api": doc("Api", "/install/docker", text="other")}


def source(spark, site, tags=None):
    rows = [(ROOT + k, v, (tags or {}).get(k)) for k, v in site.items()]
    return TableSource(spark.createDataFrame(rows, "url string, html string, etag string"))


NOW = dt.datetime(2024, 1, 1)


def run(spark, store, src, **given):
    s = Settings(**({"respect_robots": False, "crawl_delay": 0.0} | given))
    result = C.crawl(spark, src, ROOT + "/", store.pages, store.links, s, NOW)
    return result, C.indexed(result, store, s, NOW)


def test_first_crawl(spark, tmp_path):
    store = ST.Store(spark, f"{tmp_path}/s")
    result, n = run(spark, store, source(spark, SITE))
    assert n == {"pages_crawled": 4, "pages_unchanged": 0, "pages_failed": 0, "chunks_indexed": 4, "pages_pruned": 0} and not result.truncated
    pages = {r.url.removeprefix(ROOT): r for r in store.pages.collect()}
    assert {k: v.depth for k, v in pages.items()} == {"": 0, "/install": 1, "/api": 1, "/install/docker": 2}
    assert pages["/install/docker"].parent_id == pages["/install"].id and pages[""].parent_id is None and pages["/api"].root_id == pages[""].id
    assert {(r.depth, r.url.removeprefix(ROOT)) for r in sites.subtree(store.pages).join(store.pages.select("id", "url"), "id").collect()} == {(0, ""), (1, "/install"), (1, "/api"), (2, "/install/docker")}
    assert {len(r.embedding) for r in store.chunks.collect()} == {256}
    met = []
    shown = []
    C.crawl(spark, source(spark, SITE), ROOT, store.pages, store.links, Settings(respect_robots=False, crawl_delay=0.0), NOW, lambda level: met.append(level.count()), lambda pages: shown.extend(r.title for r in pages.collect()))
    assert met == [1, 2, 1] and sorted(shown) == ["Api", "Docker", "Install", "Root"]
    again, m = run(spark, store, source(spark, SITE))
    assert m["pages_crawled"] == 4 and store.counts().first() == (4, 4)


def test_limits_and_failures(spark, tmp_path):
    store = ST.Store(spark, f"{tmp_path}/s")
    result, n = run(spark, store, source(spark, SITE), max_pages=2)
    assert result.truncated and [r.url.removeprefix(ROOT) for r in result.pages.orderBy("depth", "url").collect()] == ["", "/install"]
    result, _ = run(spark, store, source(spark, SITE), max_depth=1)
    assert result.truncated and result.pages.count() == 3
    site = {k: v for k, v in SITE.items() if k != "/install"}
    result, n = run(spark, store, source(spark, site))
    assert {(r.url.removeprefix(ROOT), r.status) for r in result.outcomes.collect()} == {("", "indexed"), ("/install", "failed"), ("/api", "indexed"), ("/install/docker", "indexed")}
    assert n["pages_pruned"] == 0
    with pytest.raises(ValueError):
        run(spark, store, source(spark, SITE), max_pages=0)


def test_incremental_and_pruning(spark, tmp_path):
    store, tags = ST.Store(spark, f"{tmp_path}/s"), {k: "1" for k in SITE}
    run(spark, store, source(spark, SITE, tags))
    _, n = run(spark, store, source(spark, SITE, tags))
    assert (n["pages_crawled"], n["pages_unchanged"]) == (0, 4)
    _, n = run(spark, store, source(spark, SITE, tags | {"/install": "2"}))
    assert (n["pages_crawled"], n["pages_unchanged"]) == (1, 3)
    # the tree parent drops the page, yet another unchanged page still links to it
    site = SITE | {"/install": doc("Install", "/")}
    _, n = run(spark, store, source(spark, site, tags | {"/install": "3"}))
    assert n["pages_pruned"] == 0 and store.pages.count() == 4
    docker = store.pages.where("title = 'Docker'").first()
    assert docker.parent_id == store.pages.where("title = 'Api'").first().id
    # a failed page keeps what is stored under it; a page that nobody links to goes with its chunks
    _, n = run(spark, store, source(spark, {k: v for k, v in site.items() if k != "/api"}, tags | {"": "9"}))
    assert n["pages_pruned"] == 0
    shrunk = {"": doc("Root", "/install"), "/install": doc("Install")}
    _, n = run(spark, store, source(spark, shrunk, {"": "10", "/install": "10"}), prune_missing=False)
    assert n["pages_pruned"] == 0 and store.pages.count() == 4
    _, n = run(spark, store, source(spark, shrunk, {"": "10", "/install": "10"}))
    assert n["pages_pruned"] == 2 and store.counts().first() == (2, 2) and store.links.count() == 1


def test_robots_and_functions(spark, tmp_path):
    site = {ROOT + k: v for k, v in SITE.items()} | {ROOT + "/robots.txt": "User-agent: *\nDisallow: /api\n"}
    store = ST.Store(spark, f"{tmp_path}/s")
    result, n = run(spark, store, FunctionSource(lambda url, site=site: site[url]), respect_robots=True)
    assert {(r.url.removeprefix(ROOT), r.status) for r in result.outcomes.collect()} == {("", "indexed"), ("/install", "indexed"), ("/api", "disallowed"), ("/install/docker", "indexed")}
    result, _ = run(spark, store, FunctionSource(lambda url: 1 / 0), respect_robots=True)
    assert [r.status for r in result.outcomes.collect()] == ["failed"] and store.pages.count() == 3


def test_migration_and_empty_store(spark, tmp_path):
    store = ST.Store.open(spark, f"{tmp_path}/s")
    assert store.counts().first() == (0, 0)
    old = ST.migrated(spark.createDataFrame([("a", "u", 1)], "id string, url string, extra int"), ST.PAGES)
    assert old.columns[-2:] == ["etag", "last_modified"] and old.first().etag is None
    new = ST.migrated(spark.createDataFrame([("a", "new", NOW), ("a", "newer", NOW + dt.timedelta(1)), ("b", "x", NOW)], "id string, url string, crawled_at timestamp_ntz"), ST.PAGES)
    assert {(r.id, r.url) for r in ST.upserted(old, new).collect()} == {("a", "newer"), ("b", "x")}
    store.commit(new, store.chunks)
    base = store.version()
    store.commit(links=spark.createDataFrame([("r", "a", "u", 0)], ST.LINKS))
    assert store.pages.count() == 3 and store.links.count() == 1  # a table that is not given keeps its rows
    with pytest.raises(RuntimeError):
        store.commit(new, base=base)  # another commit came first
    with pytest.raises(ValueError):
        store.commit(new, buckets=[])
    assert ST.Store.open(spark, "/proc/none/here").version() == 0


def test_stream(spark, tmp_path):
    store = ST.Store(spark, f"{tmp_path}/s")
    rows = [("a", "u", "one", NOW), ("b", "v", "two", NOW), ("a", "u", "newer", NOW + dt.timedelta(1))]
    schema = "id string, url string, text string, crawled_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/1")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    ingest.ingest(stream(), store, f"{tmp_path}/ck").awaitTermination()
    assert {(r.id, r.text) for r in store.pages.collect()} == {("a", "newer"), ("b", "two")}
    spark.createDataFrame([("a", "u", "late", NOW), ("c", "w", "", NOW)], schema).write.parquet(f"{tmp_path}/in/2")
    ingest.ingest(stream(), store, f"{tmp_path}/ck").awaitTermination()
    assert {(r.id, r.text) for r in store.pages.collect()} == {("a", "newer"), ("b", "two"), ("c", "")}
    assert {(r.page_id, r.text) for r in store.chunks.collect()} == {("a", "newer"), ("b", "two")}
    v = store.version()
    ingest.ingest(stream(), store, f"{tmp_path}/ck").awaitTermination()
    assert store.version() == v


def test_ingest_keeps_links_and_pages(spark, tmp_path):
    """A batch of another site leaves links alone; a crawl without changes after it prunes nothing. A replaced page is read again."""
    store, tags = ST.Store(spark, f"{tmp_path}/s"), {k: "1" for k in SITE}
    run(spark, store, source(spark, SITE, tags))
    run(spark, store, source(spark, SITE, tags))
    before = store.links.count()
    schema = "id string, url string, text string, root_id string, crawled_at timestamp_ntz, etag string"
    spark.createDataFrame([("x", "http://else.example", "one", "x", NOW, "7")], schema).write.parquet(f"{tmp_path}/in/1")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    ingest.ingest(stream(), store, f"{tmp_path}/ck").awaitTermination()
    assert store.links.count() == before > 0 and store.pages.count() == 5
    _, n = run(spark, store, source(spark, SITE, tags))
    assert (n["pages_unchanged"], n["pages_pruned"]) == (4, 0) and store.counts().first() == (5, 5)
    top = store.pages.where(F.col("url") == ROOT).first()
    spark.createDataFrame([(top.id, ROOT, "new words", top.id, NOW + dt.timedelta(1), "1")], schema).write.parquet(f"{tmp_path}/in/2")
    ingest.ingest(stream(), store, f"{tmp_path}/ck", settings=Settings(embedding_dimensions=8)).awaitTermination()
    assert store.pages.where(F.col("url") == ROOT).first().etag is None and store.links.where(F.col("source_id") == top.id).count() == 0
    assert {len(r.embedding) for r in store.chunks.where(F.col("page_id") == top.id).collect()} == {8}
    _, n = run(spark, store, source(spark, SITE, tags))
    assert (n["pages_crawled"], n["pages_unchanged"], n["pages_pruned"]) == (1, 3, 0) and store.links.count() == before


def test_old_versions_go(spark, tmp_path):
    store = ST.Store(spark, f"{tmp_path}/s", buckets=4)
    rows = lambda n: ST.migrated(spark.createDataFrame([(f"p{i}", f"u{n}") for i in range(40)], "id string, url string"), ST.PAGES)
    for n in range(5):
        store.commit(rows(n))
    one = store.buckets_of(rows(0).where("id = 'p1'"))
    store.commit(store.read("pages", one).withColumn("url", F.lit("own")), buckets=one)
    assert len(store.versions()) == ST.KEEP and len(list((tmp_path / "s" / "pages").iterdir())) == 2
    assert {r.url for r in store.pages.collect()} == {"own", "u4"} and store.pages.count() == 40


def test_delay_of_robots(spark):
    """The site's delay counts if it is more than the configured one; waits hold between batches too."""
    for asked, given, want in ((0.3, 0.1, 0.3), (0.1, 0.4, 0.4)):
        site = {ROOT + k: v for k, v in SITE.items()} | {ROOT + "/robots.txt": f"User-agent: *\nCrawl-delay: {asked}\n"}
        began = time.time()
        pages = C.pages_of(spark, FunctionSource(lambda url, site=site: (time.time(), site[url])[1]), ROOT, Settings(crawl_delay=given), NOW)
        assert pages.count() == 4 and time.time() - began >= 3 * want
    paced = FunctionSource(lambda url: url, sleep=time.sleep).paced(0.2)
    asked = spark.createDataFrame([(ROOT + "/a", None, None), (ROOT + "/b", None, None)], "url string, etag string, last_modified string")
    began = time.time()
    assert paced.fetch(asked).count() == 2 and time.time() - began >= 0.2


def test_service(spark, tmp_path):
    sv = SV.Service(spark, ST.Store(spark, f"{tmp_path}/s"), source(spark, SITE), Settings(respect_robots=False, crawl_delay=0.0))
    assert sv.get("/search_docs?query=x")[2] == "[]"
    status, _, body = sv.post("/fetch_url?sync=true", {"url": ROOT})
    job = json.loads(sv.get("/job_progress?job_id=" + json.loads(body)["job_id"])[2])
    assert status == 200 and job["status"] == "completed" and job["pages_crawled"] == 4 and job["error"] is None
    assert sv.get("/job_progress?job_id=none")[0] == 404 and len(json.loads(sv.get("/job_progress")[2])) == 1
    hits = json.loads(sv.get("/search_docs?query=needle&top_k=2")[2])
    assert hits[0]["url"] == ROOT + "/install/docker" and len(hits) == 2 and set(hits[0]) == {"url", "title", "score", "method", "text"}
    assert sv.get("/search_docs?query=x&top_k=0")[0] == 422 and sv.post("/fetch_url", {"url": ROOT, "max_pages": 501})[0] == 422
    pages = json.loads(sv.get("/list_doc_pages")[2])
    ids = {p["url"].removeprefix(ROOT): p["page_id"] for p in pages}
    assert json.loads(sv.get("/get_doc_page?page_id=" + ids["/api"])[2])["title"] == "Api" and sv.get("/get_doc_page?page_id=x")[0] == 404
    assert "Root" in sv.get("/map")[2] and sv.get("/map/site/" + ids[""])[2].count("<li>") == 4 and sv.get("/map/site/x")[0] == 404
    view = sv.get("/map/page/" + ids["/install"])[2]
    assert "Api" in view and "Docker" in view and "<script" not in view and sv.get(f"/map/page/{ids['/api']}/raw")[2] == "Api\nother\nx"
    assert json.loads(sv.get("/health")[2]) == {"status": "ok", "service": "lodeseam", "pages": 4, "chunks": 4}
    call = lambda m, **p: {"jsonrpc": "2.0", "id": 1, "method": m, "params": p}
    assert sv.rpc(call("initialize"))["result"]["protocolVersion"] == SV.PROTOCOL and sv.rpc(call("ping"))["result"] == {}
    assert len(sv.rpc(call("tools/list"))["result"]["tools"]) == 3 and sv.rpc(call("what"))["error"]["code"] == -32601
    assert sv.rpc(call("tools/call", name="search_docs", arguments={}))["error"]["code"] == -32602
    assert sv.rpc(call("tools/call", name="none"))["result"]["isError"] and sv.rpc(call("tools/call", name="get_doc_page", arguments={"page_id": "x"}))["result"]["isError"]
    listed = sv.rpc(call("tools/call", name="list_doc_pages"))["result"]
    assert listed["isError"] is False and len(json.loads(listed["content"][0]["text"])) == 4
    assert sv.rpc(call("tools/call", name="get_doc_page", arguments={"page_id": ids["/api"]}))["result"] == {"content": [{"type": "text", "text": "Api\nother\nx"}], "isError": False}
    sv.source = source(spark, {"": doc("Root")})
    assert json.loads(sv.post("/fetch_url?sync=true", {"url": ROOT, "prune": False})[2])["pages_pruned"] == 0
    assert json.loads(sv.post("/fetch_url?sync=true", {"url": ROOT})[2])["pages_pruned"] == 3
    sv.source = source(spark, SITE)
    sv.post("/fetch_url?sync=true", {"url": ROOT})
    assert sv.post("/mcp", {"method": "ping", "id": None})[0] == 202 and sv.rpc([{"method": "ping"}, call("ping")]) == [{"jsonrpc": "2.0", "id": 1, "result": {}}]
    server = SV.serve(sv, port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=60) as r:
        assert json.load(r)["pages"] == 4
    server.shutdown()


def test_levels(spark):
    edges = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("a", "c", 0), ("b", "c", 0), ("c", "r", 0), ("c", "d", 1), (None, "e", 0)], "source string, target string, position int")
    got = {(r.url, r.depth, r.parent) for r in C.levels(edges, spark.createDataFrame([("r",)], "url string"), 2).collect()}
    assert got == {("r", 0, None), ("a", 1, "r"), ("b", 1, "r"), ("c", 2, "a")}


def test_levels_of_any_depth(spark):
    rows = [("n0", None), *[(f"n{i}", f"n{i - 1}") for i in range(1, 131)], ("side", "n3"), ("lost", "gone"), ("x", "y"), ("y", "x")]
    got = {tuple(r) for r in sites.levels(spark.createDataFrame(rows, "id string, parent_id string")).select("id", "depth", "parent").collect()}
    assert got == {(f"n{i}", i, f"n{i - 1}" if i else None) for i in range(131)} | {("side", 4, "n3")}


def test_outcome_counts(spark):
    log = spark.createDataFrame([(1, 1, "indexed", 5), (1, 1, "indexed", 5), (2, 1, "failed", None), (3, 1, "indexed", 2)], "log_id bigint, run_no int, status string, n_bytes bigint")
    assert {tuple(r) for r in C.outcome_counts(log).collect()} == {(1, "indexed", 2, 7), (1, "failed", 1, None)}
    assert C.outcome_counts(log.where("false")).where(F.lit(True)).collect() == []
