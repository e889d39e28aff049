"""URL functions; only resolving a link needs Python, in Arrow batches."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodeseam.tables import strip


def without_slash(url: Column) -> Column:
    """Without slashes at the end, unless nothing else is there."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.when(bare == "", url).otherwise(bare)


def netloc(url: Column) -> Column:
    """Lower-cased host with port; '' where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit(""))


def same_domain(a: Column, b: Column) -> Column:
    return netloc(a) == netloc(b)


def origin(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def crawlable(href: Column) -> Column:
    """Whether a link can lead to a page at all."""
    bare = strip(href)
    return F.coalesce((bare != "") & ~F.lower(bare).rlike("^(mailto:|javascript:|tel:|#)"), F.lit(False))


def resolve_link(base: str | None, href: str | None) -> str | None:
    """Absolute http(s) address of a link, without fragment and slashes at the end; None if it is none or malformed."""
    href = (href or "").strip()
    if not href or href.lower().startswith(("mailto:", "javascript:", "tel:", "#")):
        return None
    try:
        url = urldefrag(urljoin(base or "", href)).url
        parts = urlsplit(url)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    return url.rstrip("/") or url


@F.pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve_link(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
