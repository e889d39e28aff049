"""Queries of the crawl, index, search and site operators over the tables of a data folder, with their SQL for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.config import Settings
from lodeseam.functions import text as T
from lodeseam.functions import urls as U
from lodeseam.functions.embed import embedder
from lodeseam.operators import crawl as C
from lodeseam.operators import search as S
from lodeseam.operators import sites
from lodeseam.operators import store as ST
from lodeseam.session import folder, scratch, stored
from lodeseam.sources import html as HT
from lodeseam.sources import robots as R
from lodeseam.sources import throttle as TH
from lodeseam.sources.pages import TableSource
from lodeseam.streaming import ingest as SI
from lodeseam.tables import BLANKS, current_rows, load, strip

_COLUMNS = ["url", "title", "text", "domain", "depth", "parent_id", "root_id", "crawled_at", "etag", "last_modified"]
AGENT, NOW = "lodeseam/1.0", datetime(2024, 6, 1)


def _key(c: str) -> Column:
    k = F.lower(strip(F.col(c)))
    return F.when(k != "", k)


def pages_of(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Current pages with the named columns, parent and root ids without letter case and blanks."""
    return current_rows(load(spark, d, "pages"), **{c: _key(c) if c in ("parent_id", "root_id") else F.col(c) for c in names or _COLUMNS})


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text")


def _one_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, repeated rows once."""
    return load(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.max(F.struct("page_id", "seq", "text")).alias("c")).select("id", "c.*")


# text and search


def tokenize_documents(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens")).where("tokens is not null")


def doc_term_freq(spark, d):
    return S.term_frequencies(_docs(spark, d), "doc_id")


def doc_freq(spark, d):
    return S.document_frequencies(_docs(spark, d), "doc_id")


def hash_embed(spark, d):
    return S.hash_embedding(_docs(spark, d), "doc_id").select("doc_id", "bucket", F.round("value", 6).alias("value"))


def bm25_topk(spark, d):
    return S.bm25_topk(_one_chunk(spark, d).select("id", "text"), "id", load(spark, d, "search_query"))


def bm25_documents(spark, d):
    return S.bm25_topk(_docs(spark, d).where("text is not null"), "doc_id", load(spark, d, "search_query"))


def cosine_topk(spark, d):
    v = load(spark, d, "embeddings")
    return S.cosine_topk(v, "vec_id", v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


def hybrid_search(spark, d):
    """The chunks' own vectors have 64 dimensions; queries are embedded to as many."""
    return S.hybrid(load(spark, d, "chunks"), load(spark, d, "search_query"), pages_of(spark, d, "url", "title"), by=embedder("hashing", 64)).select("query_id", "chunk_id", "page_url", "page_title", "score", "method", "place")


def chunk_documents(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("seq", "text"))


def chunk_pages(spark, d):
    return pages_of(spark, d, "text").select(F.col("id").alias("page_id"), F.posexplode(T.chunks(F.col("text"))).alias("seq", "text")).select(T.chunk_id(F.col("page_id"), F.col("seq")).alias("id"), "page_id", "seq", "text")


def result_metadata(spark, d):
    """Results with the address and title of their page, '' where it is missing; scores to 4 digits."""
    meta = pages_of(spark, d, "url", "title").select(F.col("id").alias("_id"), "url", "title")
    r = load(spark, d, "search_result").select("query_id", "chunk_id", "page_id", "method", F.round("score", 4).alias("score")).distinct()
    return r.join(meta, F.col("page_id") == F.col("_id"), "left").select("query_id", "chunk_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "method", F.when(~F.isnan("score"), F.col("score") + 0.0).alias("score"))


# pages, addresses and HTML


def page_ids(spark, d):
    p = pages_of(spark, d, "url", "root_id")
    roots = p.select(F.col("id").alias("_r"), F.col("url").alias("_root"))
    return p.join(roots, F.col("root_id") == F.col("_r")).select("id", T.page_id(F.col("_root"), F.col("url")).alias("made"))


def url_parts(spark, d):
    u = F.col("url")
    return load(spark, d, "crawl_log").select("url").distinct().select("url", U.netloc(u).alias("netloc"), U.without_slash(u).alias("bare"), U.robots_url(u).alias("robots"), R.path_of(u).alias("path"))


def _html(p: DataFrame) -> DataFrame:
    """Pages written as HTML: a head, a script, a heading, a paragraph for each line, and links to their children."""
    kids = p.where("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.sort_array(F.collect_list("url")).alias("kids"))
    body = F.array_join(F.transform(F.split(T.escaped(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    links = F.array_join(F.transform(F.coalesce("kids", F.array().cast("array<string>")), lambda u: F.concat(F.lit('<a href="'), T.escaped(u), F.lit('#top"></a>'))), "")
    whole = F.concat(F.lit("<html><head><title>"), T.escaped(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><script>var a = '</p>';</script>"), body, links, F.lit("</body></html>"))
    return p.join(kids, F.col("id") == F.col("_p"), "left").select("id", "url", whole.alias("html"))


def page_text(spark, d):
    x = _html(pages_of(spark, d, "url", "title", "text", "parent_id")).select("id", HT.extracted(F.col("html")).alias("x"))
    return x.select("id", F.col("x.title").alias("title"), F.col("x.text").alias("text"))


def page_links(spark, d):
    x = _html(pages_of(spark, d, "url", "title", "text", "parent_id")).select("id", "url", F.posexplode(HT.extracted(F.col("html")).getField("links")).alias("position", "href"))
    return x.select("id", "position", U.resolved(F.col("url"), F.col("href")).alias("target"))


# trees


def site_roots(spark, d):
    return sites.roots(pages_of(spark, d, "url", "domain", "parent_id")).select("id", "url", "domain")


def site_children(spark, d):
    return sites.children(pages_of(spark, d, "url", "title", "parent_id")).select("parent_id", "id", "url", "place")


def site_siblings(spark, d):
    return sites.siblings(pages_of(spark, d, "parent_id"))


def page_siblings(spark, d):
    """The siblings, in order, of the page of the smallest id that has any."""
    p = stored(pages_of(spark, d, "url", "title", "parent_id"), "pages")
    first = sites.siblings(p).where("sibling_count > 0").agg(F.min("id")).first()[0]
    own = sites.siblings_of(p, first or "")
    return own.select("id", "url", F.row_number().over(W.orderBy("url", "id")).alias("place"))  # the children of one page


def breadcrumbs(spark, d):
    return sites.breadcrumbs(pages_of(spark, d, "url", "parent_id"))


def subtree(spark, d):
    return sites.subtree(pages_of(spark, d, "parent_id"))


def bfs_levels(spark, d):
    """Pages to depth 3 from the roots, over the links from parents to children."""
    p = stored(pages_of(spark, d, "url", "parent_id"), "pages")
    edges = p.where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.xxhash64("url").alias("position"))
    return C.levels(edges, p.where("parent_id is null").select(F.col("id").alias("url")), 3).select(F.col("url").alias("id"), "depth", "parent")


def bfs_all_levels(spark, d):
    """The levels of all pages that lead to a root, to any depth."""
    return sites.levels(pages_of(spark, d, "parent_id"))


# store


def list_pages(spark, d):
    return pages_of(spark, d, "url", "title", "domain", "depth", "parent_id", "root_id", "crawled_at")


def upsert_pages(spark, d):
    """The pages of the first five runs, then those of the others put in their place."""
    own = lambda p: ST.migrated(p.select("id", *[(_key(c) if c in ("parent_id", "root_id") else F.col(c)).alias(c) for c in _COLUMNS]), ST.PAGES)
    p = load(spark, d, "pages").where("id is not null")
    first = p.where("run_no <= 5").groupBy("id").agg(F.max_by(F.struct(*_COLUMNS), F.struct("crawled_at", "run_no")).alias("r")).select("id", "r.*")
    return ST.upserted(own(first), own(p.where("run_no > 5"))).select("id", "url", "crawled_at", "etag")


def touch_pages(spark, d):
    """crawled_at after the pages that the last run found unchanged were touched."""
    p = pages_of(spark, d, "url", "root_id", "crawled_at")
    log = load(spark, d, "crawl_log").where("run_no = 10 and status = 'unchanged'").select("url").distinct()
    return ST.touched(p, p.select("root_id", "url").join(log, "url"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).select("id", "crawled_at")


def prune_candidates(spark, d):
    """Pages that the last run met in no way."""
    p = pages_of(spark, d, "url", "root_id")
    met = load(spark, d, "crawl_log").where("run_no = 10").select("url").distinct()
    return ST.stale(p, p.join(met, "url").select("root_id", "url")).select("id", "url")


def chunks_without_page(spark, d):
    p = load(spark, d, "pages").where("id is not null").select(F.col("id").alias("page_id")).distinct()
    return load(spark, d, "chunks").join(p, "page_id", "left_anti").select("id", "page_id").distinct()


def validators(spark, d):
    return ST.validators(pages_of(spark, d, "url", "root_id", "crawled_at", "etag", "last_modified"))


def known_links(spark, d):
    k = ST.known_links(pages_of(spark, d, "url", "parent_id"))
    return k.select("parent_url", F.array_join("children", " ").alias("children"))


def table_counts(spark, d):
    return ST.counts(load(spark, d, "pages"), load(spark, d, "chunks"))


# crawls


def _site(spark, d) -> tuple[str, DataFrame]:
    """The address of the root of a tree of at least 10 pages, 2 or 3 links deep and all of one host, and its tree as (url, html, etag, top): top is the page right
    below the root that a page lies under."""
    p = stored(pages_of(spark, d, "url", "title", "text", "parent_id"), "pages")
    tree = sites.subtree(p.select("id", "parent_id")).join(p.select("id", "url"), "id")
    fit = (F.count("*") >= 10) & F.max("depth").between(2, 3) & (F.count_distinct(U.netloc(F.col("url"))) == 1) & (F.count_distinct(U.without_slash(F.col("url"))) == F.count("*")) & F.min(F.col("url").startswith("http"))
    root = tree.groupBy("root_id").agg(fit.alias("fit")).where("fit").agg(F.min("root_id")).first()[0]
    own = stored(tree.where(F.col("root_id") == root).select("id", F.element_at(F.concat(F.split("path", "/"), F.array(F.lit(""))), 2).alias("top")), "tree")
    html = _html(p.join(own.select("id"), "id", "left_semi")).join(own, "id")
    first = p.where(F.col("id") == root).select("url").first()
    return first and first[0], stored(html.select("id", U.without_slash(F.col("url")).alias("url"), "html", F.md5("html").alias("etag"), "top"), "site")


def crawl_outcomes(spark, d):
    """(url, depth, status): a crawl, two links deep, of a site made from pages; no rows where no tree fits."""
    root, site = _site(spark, d)
    if root is None:
        return spark.createDataFrame([], "url string, depth int, status string")
    settings = Settings(max_pages=10**6, max_depth=2, respect_robots=False)
    none = spark.createDataFrame([], ST.PAGES), spark.createDataFrame([], ST.LINKS)
    return C.crawl(spark, TableSource(site.select("url", "html")), root, *none, settings, NOW).outcomes.select("url", "depth", "status")


def crawl_runs(spark, d):
    """(step, pages_crawled, pages_unchanged, pages_failed, pages_pruned): a first crawl of the site, one of the same, and
    one after the root has lost its link to the first of its pages; with robots.txt that forbids nothing there. No rows where no tree fits."""
    root, site = _site(spark, d)
    schema = "step int, pages_crawled bigint, pages_unchanged bigint, pages_failed bigint, pages_pruned bigint"
    if root is None:
        return spark.createDataFrame([], schema)
    settings, store = Settings(max_pages=10**6, max_depth=10**3), ST.Store(spark, scratch(spark, "store"), 4)
    rules = spark.createDataFrame([(root,)], "u string").select(U.robots_url(F.col("u")).alias("url"), F.lit("User-agent: *\nDisallow: /none-of-these\n").alias("html"), F.lit("r").alias("etag"))
    whole = site.select("url", "html", "etag").unionByName(rules)
    lost = site.where("top <> ''").agg(F.min("top")).first()[0]
    gone = site.where(F.col("id") == lost).select("url").first()[0]
    link = F.concat(F.lit('<a href="'), T.escaped(F.lit(gone)), F.lit('#top"></a>'))
    less = whole.withColumn("html", F.when(F.col("url") == U.without_slash(F.lit(root)), F.replace("html", link, F.lit(""))).otherwise(F.col("html"))).withColumn("etag", F.md5("html"))
    rows = []
    for step, table in enumerate((whole, whole, less)):
        result = C.crawl(spark, TableSource(stored(table, "site")), root, store.pages, store.links, settings, NOW)
        n = C.indexed(result, store, settings, NOW)
        rows.append((step, *(n[k] for k in ("pages_crawled", "pages_unchanged", "pages_failed", "pages_pruned"))))
    return spark.createDataFrame(rows, schema)


# crawl logs and rules


def crawl_outcome_counts(spark, d):
    return C.outcome_counts(load(spark, d, "crawl_log"))


def stream_outcomes(spark, d):
    """The same rows as a stream, by hour of logging; exactly once, in one run over all that is there."""
    path = f"{d}/crawl_log.parquet"
    # a table is a folder of files or one file, which a stream can only read through its folder
    single = not folder(spark, path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    s = stream.option("pathGlobFilter", "crawl_log.parquet").parquet(d) if single else stream.parquet(path)
    name = f"outcomes_{scratch(spark, 'x')[-12:]}"
    got = SI.run_now(SI.outcomes(s, "3650 days"), name, scratch(spark, "stream"))
    return got.groupBy("status").agg(F.sum("urls").alias("urls"))


def throttle_schedule(spark, d):
    """Start times of the logged requests at one in 5 seconds for a domain, in microseconds."""
    log = load(spark, d, "crawl_log").groupBy("log_id").agg(F.max(F.struct("domain", "fetched_at")).alias("r")).select("log_id", "r.*")
    return TH.schedule(log, "domain", F.col("fetched_at"), "log_id", 5.0).select("log_id", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"))


def _robots(spark, d) -> DataFrame:
    """Rules for every host of the log, which differ by the length of its name: one part of a site is closed, with one page of it open, and
    every second host closes another part; hosts of one kind name the agent, which then does not heed the rules for all."""
    hosts = load(spark, d, "crawl_log").select(U.netloc(F.col("url")).alias("host")).distinct()
    n = F.length("host")
    common = F.concat(F.lit("User-agent: *\nAllow: /manual/a\nDisallow: /manual # closed\n"), F.when(n % 2 == 0, "Disallow: /kb\n").otherwise(""), F.lit("Crawl-delay: "), (n % 4).cast("string"), F.lit(".5\n"))
    named = F.when(n % 5 == 0, "\nUser-agent: lodeseam\nDisallow: /guide\nCrawl-delay: 7\n").otherwise("")
    return R.rule_table(hosts.withColumn("body", F.concat(F.lit("User-agent: other\nDisallow: /\n\n"), common, named)))


def robots_allowed(spark, d):
    return R.allowed(load(spark, d, "crawl_log").select("url").distinct(), _robots(spark, d), AGENT)


def robots_delays(spark, d):
    return R.delays(_robots(spark, d), AGENT, 1.0)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_documents, doc_term_freq, doc_freq, hash_embed, bm25_topk, bm25_documents, cosine_topk, hybrid_search, chunk_documents, chunk_pages, result_metadata, page_ids, url_parts, page_text, page_links,
        site_roots, site_children, site_siblings, page_siblings, breadcrumbs, subtree, bfs_levels, bfs_all_levels, list_pages, upsert_pages, touch_pages, prune_candidates, chunks_without_page, validators, known_links, table_counts,
        crawl_outcomes, crawl_runs, crawl_outcome_counts, stream_outcomes, throttle_schedule, robots_allowed, robots_delays,
    )
}

_B = "'" + BLANKS + "'"
_CUR = f"""cur AS (SELECT id, url, title, text, domain, depth, nullif(lower(trim(parent_id, {_B})), '') AS parent_id, nullif(lower(trim(root_id, {_B})), '') AS root_id, crawled_at, etag, last_modified
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, run_no DESC NULLS LAST) AS _rn FROM pages WHERE id IS NOT NULL) WHERE _rn = 1)"""
_DOWN = f"""RECURSIVE {_CUR}, down AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM cur WHERE parent_id IS NULL
    UNION ALL SELECT c.id, d.root_id, d.depth + 1, d.path || '/' || c.id FROM down d JOIN cur c ON c.parent_id = d.id)"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_CH = "ch AS (SELECT id, max({'p': page_id, 's': seq, 't': text}) AS c FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_CH_E = "ch AS (SELECT id, max({'p': page_id, 's': seq, 't': text, 'e': embedding}) AS c FROM chunks WHERE id IS NOT NULL GROUP BY id)"


def _bm25(source: str, key: str) -> str:
    return f"""d AS ({source}), t AS (SELECT {key}, {_TOKENS} AS t FROM d),
    shape AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS mean FROM t),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term FROM search_query) GROUP BY ALL),
    tf AS (SELECT {key}, size, term, count(*) AS tf FROM (SELECT {key}, len(t) AS size, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean)) * qtf), 4) AS score
          FROM tf JOIN q USING (term) JOIN df USING (term), shape GROUP BY ALL)"""


def _topk(key: str) -> str:
    return f"SELECT * FROM (SELECT query_id, {key}, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS place FROM s) WHERE place <= 10"


def _chunk_sql(source: str, key: str) -> str:
    flush = f"CASE WHEN trim(a.b, {_B}) <> '' THEN list_append(a.o, trim(a.b, {_B})) ELSE a.o END"
    tail = "CASE WHEN length(a.b) > 150 THEN substring(a.b, length(a.b) - 149, 150) ELSE '' END"
    step = f"""CASE WHEN length(p.b) > 1200 THEN {{'b': '', 'o': list_concat({flush}, list_transform(range(0, length(p.b), 1050), lambda i: trim(substring(p.b, i + 1, 1200), {_B})))}}
        WHEN length(a.b) + length(p.b) + 1 > 1200 THEN {{'b': CASE WHEN {tail} <> '' THEN trim({tail} || ' ' || p.b, {_B}) ELSE p.b END, 'o': {flush}}}
        ELSE {{'b': trim(a.b || chr(10) || p.b, {_B}), 'o': a.o}} END"""
    return f"""d AS ({source}), par AS (SELECT {key}, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_B})), lambda x: x <> ''), lambda x: {{'b': x, 'o': CAST([] AS VARCHAR[])}}) AS ps FROM d WHERE text IS NOT NULL),
    f AS (SELECT {key}, list_reduce(ps, lambda a, p: {step}, {{'b': '', 'o': CAST([] AS VARCHAR[])}}) AS a FROM par),
    out AS (SELECT {key}, {flush} AS o FROM f), each AS (SELECT {key}, unnest(range(len(o))) AS seq, unnest(o) AS text FROM out)"""


_HYBRID = f"""WITH {_CUR}, {_CH_E}, c AS (SELECT id, c.p AS page_id, c.s AS seq, coalesce(regexp_extract_all(lower(c.t), '[a-z0-9]+'), []) AS t, CAST(c.e AS DOUBLE[]) AS e FROM ch),
    q AS (SELECT query_id, top_k, coalesce(regexp_extract_all(lower(query_text), '[a-z0-9]+'), []) AS t FROM search_query WHERE top_k BETWEEN 1 AND 25),
    shape AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM c),
    h AS (SELECT query_id, sha1(term) AS x FROM (SELECT query_id, unnest(t) AS term FROM q)),
    cells AS (SELECT query_id, CAST('0x' || substring(x, 1, 8) AS BIGINT) % 64 AS b, sum(CASE WHEN CAST('0x' || substring(x, 10, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY ALL),
    qv AS (SELECT query_id, list_transform(range(64), lambda i: coalesce(m[i], 0)) AS v FROM (SELECT query_id, map(list(b), list(CAST(s AS DOUBLE))) AS m FROM cells GROUP BY query_id)),
    cv AS (SELECT id, e FROM c WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    sem AS (SELECT query_id, id, list_cosine_similarity(v, e) AS s FROM qv, cv WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY ALL),
    tf AS (SELECT id, len(any_value(t)) AS size, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM c) WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    kw AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean)) * qtf) AS k FROM tf JOIN qt USING (term) JOIN df USING (term), shape GROUP BY ALL),
    al AS (SELECT q.query_id, q.top_k, c.id, c.page_id, c.seq, coalesce(s, 0) AS s, coalesce(k, 0) AS k FROM q CROSS JOIN c LEFT JOIN sem ON sem.query_id = q.query_id AND sem.id = c.id LEFT JOIN kw ON kw.query_id = q.query_id AND kw.id = c.id),
    mm AS (SELECT query_id, min(s) AS s0, max(s) - min(s) AS s1, min(k) AS k0, max(k) - min(k) AS k1 FROM al GROUP BY query_id),
    r AS (SELECT al.*, round(0.6 * CASE WHEN s1 <= 1e-9 THEN 0 ELSE (s - s0) / s1 END + 0.4 * CASE WHEN k1 <= 1e-9 THEN 0 ELSE (k - k0) / k1 END, 4) AS score FROM al JOIN mm USING (query_id)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id, seq, id) AS place FROM r)
    SELECT query_id, top.id AS chunk_id, coalesce(url, '') AS page_url, coalesce(title, '') AS page_title, score, CASE WHEN k <= 1e-9 THEN 'semantic' WHEN s <= 1e-9 THEN 'keyword' ELSE 'hybrid' END AS method, CAST(place AS INTEGER) AS place
    FROM top LEFT JOIN cur ON cur.id = top.page_id WHERE place <= top_k"""

_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) END"

_SITE = f"""{_DOWN}, t AS (SELECT d.id, d.root_id, d.depth, coalesce(string_split(d.path, '/')[2], '') AS top, c.url FROM down d JOIN cur c ON c.id = d.id),
    one AS (SELECT min(root_id) AS r FROM (SELECT root_id FROM t GROUP BY root_id HAVING count(*) >= 10 AND max(depth) BETWEEN 2 AND 3 AND count(DISTINCT lower({_HOST})) = 1
        AND count(DISTINCT regexp_replace(url, '/+$', '')) = count(*) AND bool_and(starts_with(url, 'http')))),
    tree AS (SELECT t.* FROM t JOIN one ON root_id = r)"""

SQL = {
    "tokenize_documents": f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens, array_to_string({_TOKENS}, ' ') AS tokens FROM documents WHERE text IS NOT NULL",
    "doc_term_freq": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY ALL",
    "hash_embed": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), h AS (SELECT t, sha1(t) AS x FROM (SELECT DISTINCT t FROM t)),
        c AS (SELECT doc_id, CAST(CAST('0x' || substring(x, 1, 8) AS BIGINT) % 256 AS INTEGER) AS bucket, sum(CASE WHEN CAST('0x' || substring(x, 10, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM t JOIN h USING (t) GROUP BY ALL HAVING s <> 0)
        SELECT doc_id, bucket, CAST(round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS DOUBLE) AS value FROM c""",
    "bm25_topk": f"WITH {_CH}, {_bm25('SELECT id, c.t AS text FROM ch', 'id')} {_topk('id')}",
    "bm25_documents": f"WITH {_bm25('SELECT doc_id, text FROM documents WHERE text IS NOT NULL', 'doc_id')} {_topk('doc_id')}",
    "cosine_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND len(q.embedding) = len(v.embedding) WHERE q.vec_id % 20 = 0)
        SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s) WHERE place <= 10""",
    "hybrid_search": _HYBRID,
    "chunk_documents": f"WITH {_chunk_sql('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, CAST(seq AS INTEGER) AS seq, text FROM each",
    "chunk_pages": f"WITH {_CUR}, {_chunk_sql('SELECT id, text FROM cur', 'id')} SELECT substring(sha256(id || chr(10) || seq), 1, 32) AS id, id AS page_id, CAST(seq AS INTEGER) AS seq, text FROM each",
    "result_metadata": f"""WITH {_CUR} SELECT query_id, chunk_id, coalesce(url, '') AS url, coalesce(cur.title, '') AS title, method, CASE WHEN NOT isnan(score) THEN score + 0.0 END AS score
        FROM (SELECT DISTINCT query_id, chunk_id, page_id, method, round(score, 4) AS score FROM search_result) r LEFT JOIN cur ON cur.id = r.page_id""",
    "page_ids": f"WITH {_CUR} SELECT c.id, substring(sha256(r.url || chr(10) || c.url), 1, 32) AS made FROM cur c JOIN cur r ON r.id = c.root_id",
    "url_parts": f"""SELECT url, lower({_HOST}) AS netloc, regexp_replace(url, '/+$', '') AS bare, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') || '/robots.txt' AS robots, {_PATH} AS path FROM (SELECT DISTINCT url FROM crawl_log)""",
    "page_text": f"""WITH {_CUR} SELECT id, trim(coalesce(title, ''), {_B}) AS title,
        array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, {_B})), lambda x: x <> ''), chr(10)) AS text FROM cur""",
    "page_links": f"WITH {_CUR} SELECT p.id, CAST(row_number() OVER (PARTITION BY p.id ORDER BY c.url) - 1 AS INTEGER) AS position, regexp_replace(c.url, '/+$', '') AS target FROM cur p JOIN cur c ON c.parent_id = p.id",
    "site_roots": f"WITH {_CUR} SELECT id, url, domain FROM cur WHERE parent_id IS NULL",
    "site_children": f"WITH {_CUR} SELECT parent_id, id, url, row_number() OVER (PARTITION BY parent_id ORDER BY url NULLS FIRST, id) AS place FROM cur WHERE parent_id IS NOT NULL",
    "page_siblings": f"""WITH {_CUR}, s AS (SELECT id, url, parent_id, count(*) OVER (PARTITION BY parent_id) AS n FROM cur WHERE parent_id IS NOT NULL), one AS (SELECT id AS o, parent_id AS p FROM s WHERE n > 1 ORDER BY id LIMIT 1)
        SELECT id, url, CAST(row_number() OVER (ORDER BY url NULLS FIRST, id) AS INTEGER) AS place FROM s JOIN one ON parent_id = p WHERE id <> o""",
    "crawl_outcomes": f"WITH {_SITE} SELECT regexp_replace(url, '/+$', '') AS url, CAST(depth AS INTEGER) AS depth, 'indexed' AS status FROM tree WHERE depth <= 2",
    "crawl_runs": f"""WITH {_SITE}, n AS (SELECT count(*) AS n, count(*) FILTER (top = (SELECT min(top) FROM tree WHERE top <> '')) AS lost FROM tree HAVING count(*) > 0)
        SELECT CAST(0 AS INTEGER) AS step, n AS pages_crawled, CAST(0 AS BIGINT) AS pages_unchanged, CAST(0 AS BIGINT) AS pages_failed, CAST(0 AS BIGINT) AS pages_pruned FROM n
        UNION ALL SELECT 1, 0, n, 0, 0 FROM n UNION ALL SELECT 2, 1, n - 1 - lost, 0, lost FROM n""",
    "site_siblings": f"WITH {_CUR} SELECT id, count(*) OVER (PARTITION BY parent_id) - 1 AS sibling_count FROM cur WHERE parent_id IS NOT NULL",
    "breadcrumbs": f"""WITH {_DOWN}, s AS (SELECT id, string_split(path, '/') AS p FROM down), n AS (SELECT id, p[greatest(1, len(p) - 49):] AS p FROM s),
        e AS (SELECT id, unnest(range(len(p))) AS step, unnest(p) AS spot FROM n) SELECT e.id, CAST(step AS INTEGER) AS step, url FROM e JOIN cur ON cur.id = e.spot""",
    "subtree": f"WITH {_DOWN} SELECT root_id, id, depth, path FROM down",
    "bfs_levels": f"WITH {_DOWN} SELECT d.id, CAST(d.depth AS INTEGER) AS depth, c.parent_id AS parent FROM down d JOIN cur c ON c.id = d.id WHERE d.depth <= 3",
    "bfs_all_levels": f"WITH {_DOWN} SELECT d.id, CAST(d.depth AS INTEGER) AS depth, c.parent_id AS parent FROM down d JOIN cur c ON c.id = d.id",
    "list_pages": f"WITH {_CUR} SELECT id, url, title, domain, depth, parent_id, root_id, crawled_at FROM cur",
    "upsert_pages": """SELECT id, url, crawled_at, etag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run_no > 5 DESC, crawled_at DESC NULLS LAST, run_no DESC) AS n FROM pages WHERE id IS NOT NULL) WHERE n = 1""",
    "touch_pages": f"WITH {_CUR} SELECT id, CASE WHEN url IN (SELECT url FROM crawl_log WHERE run_no = 10 AND status = 'unchanged') AND root_id IS NOT NULL THEN TIMESTAMP '2024-06-01' ELSE crawled_at END AS crawled_at FROM cur",
    "prune_candidates": f"""WITH {_CUR}, met AS (SELECT DISTINCT root_id, url FROM cur WHERE url IN (SELECT url FROM crawl_log WHERE run_no = 10) AND root_id IS NOT NULL)
        SELECT id, url FROM cur WHERE root_id IN (SELECT root_id FROM met) AND (root_id, url) NOT IN (SELECT (root_id, url) FROM met)""",
    "chunks_without_page": "SELECT DISTINCT id, page_id FROM chunks WHERE page_id IS NULL OR page_id NOT IN (SELECT id FROM pages WHERE id IS NOT NULL)",
    "validators": f"""WITH {_CUR} SELECT root_id, url, etag, last_modified FROM (SELECT *, row_number() OVER (PARTITION BY root_id, url ORDER BY crawled_at DESC, id DESC) AS n FROM cur WHERE etag IS NOT NULL OR last_modified IS NOT NULL) WHERE n = 1""",
    "known_links": f"WITH {_CUR} SELECT p.url AS parent_url, string_agg(DISTINCT c.url, ' ' ORDER BY c.url) AS children FROM cur c JOIN cur p ON c.parent_id = p.id GROUP BY p.url",
    "table_counts": "SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM chunks) AS chunks",
    "crawl_outcome_counts": "SELECT run_no, status, count(*) AS urls, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM (SELECT log_id, any_value(run_no) AS run_no, any_value(status) AS status, any_value(n_bytes) AS n_bytes FROM crawl_log GROUP BY log_id) GROUP BY ALL",
    "stream_outcomes": "SELECT status, count(DISTINCT log_id) AS urls FROM crawl_log GROUP BY status",
    "throttle_schedule": """WITH o AS (SELECT log_id, any_value(domain) AS domain, epoch_us(any_value(fetched_at)) / 1e6 AS t FROM crawl_log GROUP BY log_id),
        i AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY t, log_id) - 1 AS i FROM o)
        SELECT log_id, CASE WHEN domain IS NOT NULL AND t IS NOT NULL THEN CAST(round((i * 5.0 + max(t - i * 5.0) OVER (PARTITION BY domain ORDER BY i)) * 1000) AS BIGINT) END AS start_ms FROM i""",
    "robots_allowed": f"""SELECT url, CASE WHEN length({_HOST}) % 5 = 0 THEN ({_PATH}) NOT LIKE '/guide%'
        ELSE NOT ((({_PATH}) LIKE '/kb%' AND length({_HOST}) % 2 = 0) OR (({_PATH}) LIKE '/manual%' AND ({_PATH}) NOT LIKE '/manual/a%')) END AS allowed FROM (SELECT DISTINCT url FROM crawl_log)""",
    "robots_delays": f"""SELECT DISTINCT lower({_HOST}) AS host, CASE WHEN length({_HOST}) % 5 = 0 THEN CAST(7 AS DOUBLE) ELSE greatest(CAST(1 AS DOUBLE), length({_HOST}) % 4 + CAST(0.5 AS DOUBLE)) END AS delay FROM crawl_log""",
}
