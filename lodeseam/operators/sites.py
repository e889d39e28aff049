"""Questions about page trees: roots, children, siblings, breadcrumbs, subtrees. pages(id, url, title, parent_id, ...) of unique ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.hierarchy import resolve
from lodeseam.operators.ranking import with_rank

#: Most links a breadcrumb follows.
HOPS = 50


def roots(pages: DataFrame) -> DataFrame:
    return pages.where("parent_id is null")


def children(pages: DataFrame, parent: str | None = None) -> DataFrame:
    """(parent_id, id, url, title, place): place in order of url among the children of a page, from 1; of one parent if given."""
    own = pages.where("parent_id is not null") if parent is None else pages.where(F.col("parent_id") == parent)
    own = own.select("parent_id", "id", "url", "title")
    return with_rank(own, ["parent_id"], F.struct("url", "id"), "place")


def siblings(pages: DataFrame) -> DataFrame:
    """(id, sibling_count): how many other pages have the same parent. Counted, as a parent of n pages has n x n pairs."""
    n = pages.where("parent_id is not null").groupBy("parent_id").agg((F.count("*") - 1).alias("sibling_count"))
    return pages.join(n, "parent_id").select("id", "sibling_count")


def siblings_of(pages: DataFrame, page: str) -> DataFrame:
    """(id, url, title) of the other children of a page's parent, in order of url."""
    own = pages.where(F.col("id") == page).where("parent_id is not null").select(F.col("parent_id").alias("_p"))
    return pages.join(own, F.col("parent_id") == F.col("_p"), "left_semi").where(F.col("id") != page).select("id", "url", "title").orderBy("url", "id")


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """(id, step, url): the pages from the root, at step 0, to each page; of deep pages the last HOPS. Pages in no tree have none."""
    placed = resolve(pages.select("id", F.col("parent_id").alias("parent")), paths=True).where("state = 'root'")
    near = F.slice("path", F.greatest(F.lit(1), F.size("path") - HOPS + 1), F.lit(HOPS))
    steps = placed.select("id", F.posexplode(near).alias("step", "_at"))
    return steps.join(pages.select(F.col("id").alias("_id"), "url"), F.col("_at") == F.col("_id")).select("id", "step", "url")


def levels(pages: DataFrame) -> DataFrame:
    """(id, depth, parent): the breadth-first level of every page that leads to a root, however deep. A page has one parent, so pointer doubling gives it in log2(depth) rounds."""
    placed = resolve(pages.select("id", F.col("parent_id").alias("parent"))).where("state = 'root'")
    return placed.select("id", F.col("depth").cast("int").alias("depth"), "parent")


def subtree(pages: DataFrame, top: str | None = None) -> DataFrame:
    """(root_id, id, depth, path): the pages of all trees, or those under one page, with the path of ids that orders them."""
    placed = resolve(pages.select("id", F.col("parent_id").alias("parent")), paths=True).where("state = 'root'")
    if top is not None:
        placed = placed.where(F.array_contains("path", top))
    return placed.select(F.col("root").alias("root_id"), "id", "depth", F.array_join("path", "/").alias("path"))
