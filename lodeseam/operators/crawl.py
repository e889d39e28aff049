"""Breadth-first crawls as one DataFrame job per level.

A level is processed as a whole, in the order in which its pages were found: the order of a page is the array of its
ancestors' link positions, so comparing arrays gives first-in-first-out order without numbering anything. Frontier,
outcomes and links of a level are written to the shared folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.config import Settings
from lodeseam.functions.embed import embedder
from lodeseam.functions.text import page_id
from lodeseam.functions.urls import netloc, resolved, robots_url, without_slash
from lodeseam.operators import store as ST
from lodeseam.operators.sites import subtree
from lodeseam.session import stored
from lodeseam.sources import robots as R
from lodeseam.sources.html import extracted
from lodeseam.sources.pages import PageSource

OUTCOME = "url string, status string, depth int, parent_id string"


@dataclass
class Crawl:
    """pages: rows to index; outcomes(url, status, depth, parent_id), status indexed, unchanged, failed or disallowed;
    links(root_id, source_id, target_url, position) of the pages read; truncated: whether something was left out."""

    pages: DataFrame
    outcomes: DataFrame
    links: DataFrame
    truncated: bool
    root_id: str


def crawl(spark: SparkSession, source: PageSource, root: str, old_pages: DataFrame, old_links: DataFrame, settings: Settings, now: datetime,
          on_level: Callable[[DataFrame], None] | None = None, on_pages: Callable[[DataFrame], None] | None = None, on_unchanged: Callable[[DataFrame], None] | None = None) -> Crawl:
    """Reads the site under root. old_pages, old_links: what is stored of it, for conditional requests and unread pages.

    max_pages, which must be above 0, counts pages that were read; unchanged ones are free. Links found at max_depth
    that were not seen before make the crawl truncated, as do pages left when max_pages is reached. As soon as a level is
    read, on_level is called with its outcomes (url, status, depth, parent_id), on_pages with its pages and on_unchanged
    with the addresses (url) of those that are unchanged. Requests are as far apart as the settings and robots.txt ask,
    whichever is more, if the source can be paced.
    """
    if settings.max_pages < 1 or settings.max_depth < 0:
        raise ValueError("max_pages must be above 0 and max_depth not below")
    top = spark.createDataFrame([(root,)], "url string").select(without_slash(F.col("url")).alias("url"))
    root_url, domain, root_id = top.select("url", netloc(F.col("url")), page_id(F.col("url"), F.col("url"))).first()
    rules = None
    if settings.respect_robots:
        asked = top.select(robots_url(F.col("url")).alias("url"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
        rules = stored(R.rule_table(source.fetch(asked).select(F.lit(domain).alias("host"), "body")), "rules")
    delay = settings.crawl_delay
    if rules is not None and (asks := R.delays(rules, settings.user_agent, settings.crawl_delay).first()):  # one host
        delay = max(delay, asks["delay"])
    source = source.paced(delay) if hasattr(source, "paced") else source
    known = ST.validators(old_pages.where(F.col("root_id") == root_id)).select(F.col("url").alias("_url"), "etag", "last_modified")
    frontier = top.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.array(F.lit(0)).alias("ord"))
    seen, outcomes, pages, links, left, truncated = [frontier.select("url")], [], [], [], settings.max_pages, False
    for depth in range(settings.max_depth + 1):
        flagged = stored(R.allowed(frontier, rules, settings.user_agent) if rules is not None else frontier.withColumn("allowed", F.lit(True)), "frontier")
        outcomes.append(flagged.where("not allowed").select("url", F.lit("disallowed").alias("status"), "depth", "parent_id"))
        rest, level = flagged.where("allowed").drop("allowed"), []
        while left > 0:  # no batch can read more pages than may still be read
            batch = stored(rest.orderBy("ord").limit(left), "batch")
            taken = batch.count()
            if not taken:
                break
            answers = source.fetch(batch.select("url").join(known, F.col("url") == F.col("_url"), "left").select("url", "etag", "last_modified"))
            read = answers.select(F.col("url").alias("_url"), "new_etag", "new_modified", "status", extracted(F.when(F.col("status") == "fetched", F.col("body"))).alias("x"))
            got = stored(batch.join(read, F.col("url") == F.col("_url"), "left").select("url", "depth", "parent_id", "ord", F.coalesce("status", F.lit("failed")).alias("status"), "new_etag", "new_modified", "x"), "level")
            level.append(got)
            last, left = taken < left, left - got.where("status = 'fetched'").count()
            rest = rest.limit(0) if last else rest.join(batch.select("url"), "url", "left_anti").select(*batch.columns)
            if last:
                break
        truncated = truncated or (left <= 0 and not rest.isEmpty())
        if not level:
            break
        done = reduce(DataFrame.unionByName, level).withColumn("id", page_id(F.lit(root_url), F.col("url")))
        label = F.when(F.col("status") == "fetched", "indexed").when(F.col("status") == "not_modified", "unchanged").otherwise("failed")
        outcomes.append(done.select("url", label.alias("status"), "depth", "parent_id"))
        if on_level:
            on_level(outcomes[-2].unionByName(outcomes[-1]))
        fetched = done.where("status = 'fetched'")
        if on_unchanged:
            on_unchanged(done.where("status = 'not_modified'").select("url"))
        name = F.when(F.col("x.title") != "", F.col("x.title")).otherwise(F.col("url"))
        pages.append(fetched.select("id", "url", name.alias("title"), F.col("x.text").alias("text"), F.lit(domain).alias("domain"), "depth", "parent_id", F.lit(root_id).alias("root_id"), F.lit(now).cast("timestamp_ntz").alias("crawled_at"), F.col("new_etag").alias("etag"), F.col("new_modified").alias("last_modified")))
        if on_pages:
            on_pages(pages[-1])
        new = fetched.select("id", "ord", F.col("url").alias("base"), F.posexplode("x.links").alias("position", "href")).select("id", "ord", "position", resolved(F.col("base"), F.col("href")).alias("target"))
        new = stored(new.where("target is not null").where(netloc(F.col("target")) == domain), "links")
        links.append(new.select(F.lit(root_id).alias("root_id"), F.col("id").alias("source_id"), F.col("target").alias("target_url"), "position"))
        kept = done.where("status = 'not_modified'").select("id", "ord").join(old_links.where(F.col("root_id") == root_id).select(F.col("source_id").alias("id"), "position", F.col("target_url").alias("target")), "id")
        both = new.select("id", "ord", "position", "target").unionByName(kept.select("id", "ord", "position", "target"))
        first = both.groupBy("target").agg(F.min(F.struct(F.concat("ord", F.array("position")).alias("ord"), "id")).alias("f"))
        unseen = first.join(reduce(DataFrame.unionByName, seen), F.col("target") == F.col("url"), "left_anti")
        frontier = stored(unseen.select(F.col("target").alias("url"), F.lit(depth + 1).alias("depth"), F.col("f.id").alias("parent_id"), F.col("f.ord").alias("ord")), "found")
        if frontier.isEmpty():
            break
        if depth == settings.max_depth or left <= 0:
            truncated = True
            break
        seen.append(frontier.select("url"))
    empty = lambda schema: spark.createDataFrame([], schema)
    union = lambda parts, schema: reduce(DataFrame.unionByName, parts) if parts else empty(schema)
    return Crawl(union(pages, ST.PAGES), union(outcomes, OUTCOME), union(links, ST.LINKS), truncated, root_id)


def pages_of(spark: SparkSession, source: PageSource, root: str, settings: Settings, now: datetime) -> DataFrame:
    """The pages of a site alone, from a crawl that knows nothing of it."""
    none = spark.createDataFrame([], ST.PAGES), spark.createDataFrame([], ST.LINKS)
    return crawl(spark, source, root, *none, settings, now).pages


def kept(result: Crawl, old_pages: DataFrame) -> DataFrame:
    """(root_id, url) that pruning must leave: what the crawl met in any way, and all stored pages under one that failed."""
    met = result.outcomes.select(F.lit(result.root_id).alias("root_id"), "url")
    failed = result.outcomes.where("status = 'failed'").select("url")
    ours = old_pages.where(F.col("root_id") == result.root_id)
    lost = ours.join(failed, "url", "left_semi").select(F.col("id").alias("_lost"))
    under = subtree(ours).select("id", F.explode(F.split("path", "/")).alias("_at")).join(lost, F.col("_at") == F.col("_lost"), "left_semi").select("id").distinct()
    return met.unionByName(ours.join(under, "id").select("root_id", "url")).distinct()


def indexed(result: Crawl, old: ST.Store, settings: Settings, now: datetime, prune: bool | None = None, on_pruned: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """Takes a crawl into the store in one commit: new pages with their chunks, unchanged ones touched, missing ones pruned.

    Nothing is pruned after a truncated crawl or where the root failed. prune, if given, takes the place of the setting.
    on_pruned is called with the pruned pages (id, url). Only buckets with a page that was met or goes are written. Counts of what was done.
    """
    base = old.version()
    ours = stored(old.read("pages", version=base).where(F.col("root_id") == result.root_id), "ours")
    new = stored(result.pages, "new")
    met = result.outcomes.where("status = 'unchanged'").select(F.lit(result.root_id).alias("root_id"), "url", F.col("depth").alias("_depth"), F.col("parent_id").alias("_parent"))
    gone = new.select("id", "url").where("false")
    if (settings.prune_missing if prune is None else prune) and not result.truncated:
        gone = stored(ST.stale(ours, kept(result, ours)).join(new.select("id"), "id", "left_anti").select("id", "url"), "stale")
    same = ours.join(met, ["root_id", "url"], "left_semi").select("id")
    hit = old.buckets_of(new.select("id").unionByName(same).unionByName(gone.select("id")))
    pages, chunks, links = (old.read(kind, hit, base) for kind in ("pages", "chunks", "links"))
    after = ST.touched(pages, met, F.lit(now).cast("timestamp_ntz")).join(met, ["root_id", "url"], "left")
    after = after.withColumn("depth", F.coalesce("_depth", "depth")).withColumn("parent_id", F.when(F.col("_depth").isNotNull(), F.col("_parent")).otherwise(F.col("parent_id"))).select(*pages.columns)
    fresh = stored(ST.made(new, settings.chunk_size, settings.chunk_overlap, embedder(settings.embedder, settings.embedding_dimensions)), "chunks")
    left = new.select("id").unionByName(gone.select("id")).select(F.col("id").alias("_id"))
    rest = lambda df, key: df.join(left, F.col(key) == F.col("_id"), "left_anti").select(*df.columns)
    if hit:
        old.commit(rest(after, "id").unionByName(ST.upserted(new.where("false"), new)), rest(chunks, "page_id").unionByName(fresh), rest(links, "source_id").unionByName(result.links), hit, base)
    if on_pruned:
        on_pruned(gone)
    n = {r["status"]: r["count"] for r in result.outcomes.groupBy("status").count().collect()}
    return {"pages_crawled": n.get("indexed", 0), "pages_unchanged": n.get("unchanged", 0), "pages_failed": n.get("failed", 0), "chunks_indexed": fresh.count(), "pages_pruned": gone.count()}


def levels(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth, parent): first discovery of every node from the roots over edges(source, target, position), as deep as max_depth."""
    found = stored(roots.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct(), "level")
    out = [found]
    for depth in range(1, max_depth + 1):
        near = found.join(edges, F.col("url") == F.col("source")).groupBy("target").agg(F.min(F.struct("source", "position")).alias("f"))
        seen = reduce(DataFrame.unionByName, out).select("url")
        found = stored(near.join(seen, F.col("target") == F.col("url"), "left_anti").select(F.col("target").alias("url"), F.lit(depth).alias("depth"), F.col("f.source").alias("parent")), "level")
        if found.isEmpty():
            break
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def outcome_counts(log: DataFrame) -> DataFrame:
    """(run_no, status, urls, bytes) of a crawl log; repeated log_id count once."""
    one = log.groupBy("log_id").agg(F.max(F.struct("run_no", "status", "n_bytes")).alias("r")).select("r.*")
    return one.groupBy("run_no", "status").agg(F.count("*").alias("urls"), F.sum("n_bytes").alias("bytes"))
