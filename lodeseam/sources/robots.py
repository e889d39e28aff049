"""Crawl rules of robots.txt as a table, and their lookup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions.urls import netloc

_LINE = re.compile(r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$")
_DELAY = re.compile(r"^\d+(?:\.\d+)?$")


def rules(body: str | None) -> list[tuple[int, str, str, str | None, float | None]]:
    """(ordinal, agent, kind, prefix, delay); kind is allow, disallow or delay.

    User-agent lines in a row share a group; rule, sitemap and delay lines keep it open, anything else closes it. An empty Disallow
    allows everything.
    """
    out: list = []
    agents: list[str] = []
    for raw in (body or "").splitlines():
        m = _LINE.match(raw.split("#", 1)[0])
        key = m.group(1).lower() if m else ""
        if key == "user-agent":
            agents.append(m.group(2).lower())
        elif key in ("allow", "disallow"):
            prefix = quote(unquote(m.group(2)), safe="/%?=&;:,@+$!*'()~-._")
            kind = "allow" if key == "allow" or not prefix else "disallow"
            out += [(len(out) + i, a, kind, prefix, None) for i, a in enumerate(agents)]
        elif key == "crawl-delay":
            if _DELAY.match(m.group(2)):
                out += [(len(out) + i, a, "delay", None, float(m.group(2))) for i, a in enumerate(agents)]
        elif key != "sitemap":
            agents = []
    return out


def rule_table(bodies: DataFrame) -> DataFrame:
    """(host, rule_ord, agent, kind, prefix, crawl_delay) of bodies(host, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, *r) for h, t in zip(b["host"], b["body"], strict=True) for r in rules(t if isinstance(t, str) else None)]
            yield pd.DataFrame(rows, columns=["host", "rule_ord", "agent", "kind", "prefix", "crawl_delay"])

    return bodies.select("host", "body").mapInPandas(run, "host string, rule_ord int, agent string, kind string, prefix string, crawl_delay double")


def for_agent(table: DataFrame, user_agent: str) -> DataFrame:
    """The rules of each host that hold for the agent: those that name it, else those for all."""
    own = user_agent.lower()
    named = (F.col("agent") != "*") & (F.col("agent") != "") & F.lit(own).startswith(F.col("agent"))
    return table.withColumn("_named", named.cast("int")).where(named | (F.col("agent") == "*")).withColumn("_most", F.max("_named").over(W.partitionBy("host"))).where("_named = _most").drop("_named", "_most")


def path_of(url: Column) -> Column:
    """Path with query of a URL, '/' if empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def allowed(urls: DataFrame, table: DataFrame, user_agent: str, url: str = "url") -> DataFrame:
    """urls with the column allowed: the first rule whose prefix begins the path decides; no rule, no robots.txt and no URL allow.

    All but the first matching rule are dropped by one aggregation per URL, so repeated URLs are looked up once.
    """
    mine = for_agent(table, user_agent).where("kind <> 'delay'").select(F.col("host").alias("_host"), "rule_ord", "kind", "prefix")
    asked = urls.select(F.col(url).alias("_url")).where("_url is not null").distinct().withColumn("_h", netloc(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    hit = asked.join(mine, (F.col("_h") == F.col("_host")) & F.col("_path").startswith(F.col("prefix")))
    first = hit.groupBy("_url").agg(F.min_by("kind", "rule_ord").alias("_kind")).where("_kind = 'disallow'").select("_url", F.lit(False).alias("_no"))
    return urls.join(first, F.col(url).eqNullSafe(F.col("_url")), "left").withColumn("allowed", F.coalesce("_no", F.lit(True))).drop("_url", "_no")


def delays(table: DataFrame, user_agent: str, configured: float) -> DataFrame:
    """(host, delay): the greatest delay that holds for the agent, and the configured one at least."""
    return for_agent(table, user_agent).groupBy("host").agg(F.greatest(F.lit(float(configured)), F.max("crawl_delay")).alias("delay")).withColumn("delay", F.coalesce("delay", F.lit(float(configured))))
