"""Page sources: where a crawl gets bodies and validators from.

A source answers a table of requests (url, etag, last_modified) with (url, body, new_etag, new_modified, status):
status is fetched, not_modified or failed. A table source is a join; the HTTP source fetches in Arrow batches on the
executors, conditionally by default. A plain function of one URL becomes a source through FunctionSource.
"""

from __future__ import annotations

import copy
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.config import Settings
from lodeseam.functions.urls import netloc
from lodeseam.sources.throttle import Throttle

ANSWER = "url string, body string, new_etag string, new_modified string, status string"


class PageSource(Protocol):
    supports_conditional: bool

    def fetch(self, requests: DataFrame) -> DataFrame: ...


class TableSource:
    """Pages of a table (url, html[, etag, last_modified]); a missing or null page fails."""

    def __init__(self, table: DataFrame):
        self.supports_conditional = "etag" in table.columns
        none = F.lit(None).cast("string")
        self.table = table.select(
            F.col("url").alias("_url"), F.col("html").alias("body"), *[(F.col(c) if c in table.columns else none).alias(n) for c, n in (("etag", "new_etag"), ("last_modified", "new_modified"))]
        ).dropDuplicates(["_url"])

    def fetch(self, requests: DataFrame) -> DataFrame:
        got = requests.join(self.table, F.col("url") == F.col("_url"), "left")
        by_tag = F.col("etag").isNotNull() & F.col("new_etag").isNotNull()
        same = F.coalesce(F.when(by_tag, F.col("etag") == F.col("new_etag")).otherwise(F.col("last_modified") == F.col("new_modified")), F.lit(False))
        status = F.when(F.col("body").isNull(), "failed").when(same, "not_modified").otherwise("fetched")
        return got.select("url", F.when(status == "fetched", F.col("body")).alias("body"), "new_etag", "new_modified", status.alias("status"))


def http_get(url: str, etag: str | None, modified: str | None, agent: str, timeout: float) -> tuple:
    head = {"User-Agent": agent} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=timeout) as r:  # noqa: S310
            return url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.headers.get("ETag"), r.headers.get("Last-Modified"), "fetched"
    except urllib.error.HTTPError as e:
        return (url, None, etag, modified, "not_modified") if e.code == 304 else (url, None, None, None, "failed")
    except (OSError, ValueError):
        return url, None, None, None, "failed"


def _one_by_one(requests: DataFrame, get: Callable[[str, str | None, str | None], tuple], delay: float, free: float, sleep: Callable[[float], None]) -> DataFrame:
    """Answers of get, delay seconds apart for a host and none before free; requests of a host share a task, so that they can wait for each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wait, first = Throttle(delay, sleep=sleep), True
        for b in batches:
            rows = []
            for url, etag, modified in zip(b["url"], b["etag"], b["last_modified"], strict=True):
                if first and free > time.time():
                    sleep(free - time.time())
                first = False
                wait(url)
                rows.append(get(url, etag, modified))
            yield pd.DataFrame(rows, columns=["url", "body", "new_etag", "new_modified", "status"])

    asked = requests.select("url", "etag", "last_modified")
    return (asked.repartition(netloc(F.col("url"))) if delay > 0 else asked).mapInPandas(run, ANSWER)


class _Paced:
    """A source that asks the pages one by one. The pages of a crawl come in batches: one begins delay after the last has ended."""

    delay: float
    sleep: Callable[[float], None]

    def paced(self, delay: float):
        """The same source with this delay."""
        other = copy.copy(self)
        other.delay = delay
        return other

    def _get(self) -> Callable[[str, str | None, str | None], tuple]:
        raise NotImplementedError

    def fetch(self, requests: DataFrame) -> DataFrame:
        free, self._asked = (time.time() + self.delay if getattr(self, "_asked", False) else 0.0), True
        return _one_by_one(requests, self._get(), self.delay, free, self.sleep)


class FunctionSource(_Paced):
    """A function url -> text, which fails by raising; validators are not used. sleep: how it waits."""

    supports_conditional = False

    def __init__(self, get: Callable[[str], str], delay: float = 0.0, sleep: Callable[[float], None] = time.sleep):
        self.get, self.delay, self.sleep = get, delay, sleep

    def _get(self) -> Callable[[str, str | None, str | None], tuple]:
        get = self.get

        def one(url: str, etag: str | None, modified: str | None) -> tuple:
            try:
                return url, get(url), None, None, "fetched"
            except Exception:  # noqa: BLE001 - whatever it raises, the page failed
                return url, None, None, None, "failed"

        return one


class HttpSource(_Paced):
    """Conditional GET."""

    supports_conditional = True

    def __init__(self, agent: str, timeout: float = 15.0, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.agent, self.timeout, self.delay, self.sleep = agent, timeout, delay, sleep

    @classmethod
    def of(cls, settings: Settings) -> HttpSource:
        return cls(settings.user_agent, settings.request_timeout, settings.crawl_delay)

    def _get(self) -> Callable[[str, str | None, str | None], tuple]:
        agent, timeout = self.agent, self.timeout
        return lambda url, etag, modified: http_get(url, etag, modified, agent, timeout)
