"""Queries of the general problems: page hierarchy (1) and incremental processing (6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators import changes as C
from lodeseam.operators import hierarchy as H
from lodeseam.session import scratch, stored
from lodeseam.tables import BLANKS, current_rows, load, strip


def _key(c: str) -> Column:
    return F.lower(strip(F.col(c)))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Current rows: id, parent (null for roots), and what the row says of root and depth."""
    key = _key("parent_id")
    return current_rows(load(spark, d, "pages"), parent=F.when(key != "", key), said_root=_key("root_id"), said_depth=F.col("depth"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, fault): pages whose links lead to no root, or whose depth or root is not that of their place."""
    nodes = _nodes(spark, d)
    placed = H.resolve(nodes).drop("parent").join(nodes.select("id", "said_root", "said_depth"), "id")
    in_tree = F.col("state") == "root"
    faults = F.array_compact(
        F.array(
            F.when(~in_tree, F.col("state")),
            F.when(in_tree & ~F.col("said_depth").cast("long").eqNullSafe(F.col("depth")), "wrong_depth"),
            F.when(in_tree & ~F.col("said_root").eqNullSafe(F.col("root")), "wrong_root"),
        )
    )
    return placed.select("id", F.explode(faults).alias("fault"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """(id, root, depth, state, path, n_below) of every page."""
    placed = H.resolve(_nodes(spark, d), paths=True)
    return placed.join(H.subtree_sizes(placed), "id", "left").select("id", "root", "depth", "state", F.array_join("path", "/").alias("path"), "n_below")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(id, below, distance): all pages under each page."""
    return H.descendants(H.resolve(_nodes(spark, d), paths=True))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(run_no, id): pages that are new or changed at each done run, through the change log from its beginning."""
    capture = C.ChangeCapture(spark, scratch(spark, "capture"))
    capture.run(f"{d}/pages.parquet", load(spark, d, "crawl_run"))
    return capture.sink()


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same, taken in run by run: every done run is a batch of what had been delivered by then, and each first try ends before its commit."""
    folder, runs = scratch(spark, "capture"), load(spark, d, "crawl_run")
    rows = stored(C.versioned(load(spark, d, "pages")), "rows")
    for r in sorted(x[0] for x in runs.where("state = 'done'").select("run_no").distinct().collect()):  # one row per run
        seen, known = rows.where(F.col("run_no") <= r), runs.where(F.col("run_no") <= r)
        died = C.ChangeCapture(spark, folder)
        died.execute(died.plan(seen, known))
        C.ChangeCapture(spark, folder).run(rows, known)  # replays the plan: what arrived since is for the next batch
    return C.ChangeCapture(spark, folder).sink()


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p6_found": p6_found, "p6_batches": p6_batches}

_CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, run_no DESC NULLS LAST) AS _rn FROM pages WHERE id IS NOT NULL) WHERE _rn = 1)"""
_B = f"'{BLANKS}'"
_TREE = f"""WITH RECURSIVE {_CURRENT},
n AS (SELECT id, nullif(lower(trim(parent_id, {_B})), '') AS parent, lower(trim(root_id, {_B})) AS said_root, depth AS said_depth FROM cur),
down AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, id AS path FROM n WHERE parent IS NULL
         UNION ALL SELECT n.id, d.root, d.depth + 1, d.path || '/' || n.id FROM down d JOIN n ON n.parent = d.id),
lost AS (SELECT id, parent FROM n WHERE id NOT IN (SELECT id FROM down)),
orphan AS (SELECT id FROM lost WHERE parent NOT IN (SELECT id FROM n)
           UNION ALL SELECT l.id FROM orphan o JOIN lost l ON l.parent = o.id),
ring AS (SELECT id, parent FROM lost WHERE id NOT IN (SELECT id FROM orphan)),
walk AS (SELECT id AS start, parent AS spot FROM ring UNION SELECT w.start, r.parent FROM walk w JOIN ring r ON r.id = w.spot),
state AS (SELECT id, 'orphan' AS state FROM orphan UNION ALL
          SELECT id, CASE WHEN id IN (SELECT start FROM walk WHERE start = spot) THEN 'cycle' ELSE 'below_cycle' END FROM ring)"""

_CHANGED = r"""WITH v AS (SELECT id, run_no, crawled_at, nullif(trim(regexp_replace(trim(regexp_replace(trim(etag), '^[Ww]/', '')), '^"+|"+$', '', 'g')), '') AS etag,
            coalesce(try_strptime(trim(last_modified), '%a, %d %b %Y %H:%M:%S GMT'), try_strptime(trim(last_modified), '%A, %d-%b-%y %H:%M:%S GMT'),
                     try_strptime(trim(last_modified), '%a %b %d %H:%M:%S %Y'), CAST(try_cast(trim(last_modified) AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)) AS modified,
            sha256(text) AS content FROM pages WHERE id IS NOT NULL AND run_no IS NOT NULL),
        done AS (SELECT run_no, lag(run_no) OVER (ORDER BY run_no) AS before FROM (SELECT DISTINCT run_no FROM crawl_run WHERE state = 'done')),
        st AS (SELECT d.run_no, v.id, max_by({'e': v.etag, 'm': v.modified, 'c': v.content}, v.crawled_at) AS s FROM done d JOIN v ON v.run_no <= d.run_no GROUP BY ALL)
        SELECT a.run_no, a.id FROM st a JOIN done d ON d.run_no = a.run_no LEFT JOIN st b ON b.run_no = d.before AND b.id = a.id
        WHERE b.id IS NULL OR NOT CASE WHEN a.s.e IS NOT NULL AND b.s.e IS NOT NULL THEN a.s.e = b.s.e
            WHEN a.s.m IS NOT NULL AND b.s.m IS NOT NULL THEN a.s.m = b.s.m ELSE a.s.c IS NOT DISTINCT FROM b.s.c END"""

SQL = {
    "p1_found": f"""{_TREE} SELECT id, state AS fault FROM state
        UNION ALL SELECT n.id, 'wrong_depth' FROM n JOIN down d ON d.id = n.id WHERE n.said_depth IS DISTINCT FROM d.depth
        UNION ALL SELECT n.id, 'wrong_root' FROM n JOIN down d ON d.id = n.id WHERE n.said_root IS DISTINCT FROM d.root""",
    "p1_paths": f"""{_TREE} SELECT n.id, d.root, d.depth, coalesce(s.state, 'root') AS state, d.path,
        CASE WHEN d.id IS NOT NULL THEN (SELECT count(*) FROM down x WHERE starts_with(x.path, d.path || '/')) END AS n_below
        FROM n LEFT JOIN down d ON d.id = n.id LEFT JOIN state s ON s.id = n.id""",
    "p1_descendants": f"""{_TREE} SELECT a.id, b.id AS below, b.depth - a.depth AS distance FROM down a JOIN down b ON starts_with(b.path, a.path || '/')""",
    "p6_found": _CHANGED,
    "p6_batches": _CHANGED,
}
