"""Site maps and page views as HTML. Only what one answer shows is collected."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators import sites

EXCERPT = 1500


def _link(kind: str, row) -> str:
    return f'<a href="/map/{kind}/{escape(row["id"])}">{escape(row["title"] or row["url"])}</a>'


def index(pages: DataFrame) -> str:
    """All sites, oldest first."""
    rows = sites.roots(pages).select("id", "url", "title", "domain").orderBy("crawled_at", "id").collect()
    return "<h1>Sites</h1><ul>" + "".join(f"<li>{_link('site', r)} {escape(r['domain'] or '')}</li>" for r in rows) + "</ul>"


def site(pages: DataFrame, root: str) -> str | None:
    """The tree of a site, ordered by address within each page; None if there is no such root."""
    pages = pages.where(F.col("root_id") == root)
    rows = sites.subtree(pages, root).join(pages.select("id", "url", "title", "parent_id"), "id").select("id", "url", "title", "parent_id", "depth").collect()
    under: dict = {}
    for r in sorted(rows, key=lambda r: (r["url"] or "", r["id"])):
        under.setdefault(r["parent_id"], []).append(r)
    top = [r for r in rows if r["id"] == root]
    if not top:
        return None
    out: list[str] = []
    todo: list = ["</ul>", top[0], "<ul>"]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(f"<li>{_link('page', x)}")
        below = under.get(x["id"], [])
        todo += ["</li>"] + (["</ul>", *reversed(below), "<ul>"] if below else [])
    return "".join(out)


def page(pages: DataFrame, page_id: str) -> str | None:
    """Breadcrumbs, beginning of the text, siblings and children of a page; None if it is missing."""
    row = pages.where(F.col("id") == page_id).select("id", "url", "title", "root_id", F.substring("text", 1, EXCERPT + 1).alias("text")).first()
    if row is None:
        return None
    pages = pages.where(F.col("root_id").eqNullSafe(F.lit(row["root_id"])))  # the page's own tree
    names = {r["id"]: r for r in pages.where(F.col("url").isin(urls)).select("id", "url", "title").collect()} if (urls := [r["url"] for r in sites.breadcrumbs(pages).where(F.col("id") == page_id).orderBy("step").collect()]) else {}
    by_url = {r["url"]: r for r in names.values()}
    crumbs = " / ".join(_link("page", by_url[u]) for u in urls if u in by_url)
    text = row["text"] or ""
    text = text[:EXCERPT] + "…" if len(text) > EXCERPT else text
    listed = lambda rows: "<ul>" + "".join(f"<li>{_link('page', r)}</li>" for r in rows) + "</ul>"
    return f"<nav>{crumbs}</nav><h1>{escape(row['title'] or row['url'])}</h1><pre>{escape(text)}</pre><h2>Siblings</h2>{listed(sites.siblings_of(pages, page_id).collect())}<h2>Children</h2>{listed(sites.children(pages, page_id).orderBy('url', 'id').collect())}"
