"""Parent-child links to whole hierarchies, by pointer doubling.

Every node holds a pointer to an ancestor and the number of links up to it. A round replaces the pointer by the pointer
of the node it leads to, so distances double and a tree of depth d is done after log2(d) rounds. Nodes that reached a
root or a missing parent leave the loop. When a round finishes no further node, what is left leads into cycles:
distances to an end are contiguous along a chain, so a round without progress proves that no open node has one.

Each round is one equi-join on node ids, written to the shared folder. No group is ever gathered: a root of a third of all
nodes is one row of the lookup side, and its many followers are split by adaptive skew handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.session import stored


def resolve(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """The place of every node in its tree.

    nodes(id, parent): ids are unique and not null; a null parent marks a root.
    Result (id, parent, root, depth, state[, path]): state is 'root' (leads to a root), 'orphan' (ends at an id that is
    missing), 'cycle' (following parents leads back to it) or 'below_cycle'. root and depth are null unless the state is
    'root'; path holds the ids from the root to the node itself. An empty table gives an empty result.
    """
    nodes = nodes.select("id", F.col("parent"))
    known = nodes.select(F.col("id").alias("_known"))
    whole = (lambda seg: [seg.alias("path")]) if paths else (lambda seg: [])
    # roots need no lookup; as null keys they would all meet in one task
    tops = nodes.where("parent is null").select("id", "parent", F.col("id").alias("up"), F.lit(0).cast("long").alias("hops"), F.lit("root").alias("state"), *whole(F.array("id")))
    others = nodes.where("parent is not null").join(known, F.col("parent") == F.col("_known"), "left")
    others = others.select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("hops"), F.when(F.col("_known").isNull(), "orphan").alias("state"), *whole(F.array("id")))
    # only nodes that are somebody's parent are ever looked up; leaves, most of a tree and with the longest paths, are not read again
    pointed = nodes.where("parent is not null").select(F.col("parent").alias("_pointed")).distinct()
    first = tops.unionByName(others).join(pointed, F.col("id") == F.col("_pointed"), "left").withColumn("inner", F.col("_pointed").isNotNull()).drop("_pointed")
    table = stored(first, "links")
    done, open_ = [table.where("state is not null")], table.where("state is null")
    left, before, loops = open_.count(), None, False
    while left:
        if loops:  # open nodes only: their pointers stay among themselves
            images = open_.select("up").distinct()
            n = images.count()
            if n == before:
                on = images.select(F.col("up").alias("_on"))
                open_ = open_.join(on, F.col("id") == F.col("_on"), "left").withColumn(
                    "state", F.when(F.col("_on").isNotNull(), "cycle").otherwise("below_cycle")
                )
                done.append(open_.drop("_on"))
                break
            before = n
        there = open_ if loops else reduce(DataFrame.unionByName, [*done, open_])
        there = there.where("inner").select(
            F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("state").alias("_state"), *[F.col("path").alias("_path")] * paths
        )
        longer = F.col("path") if loops else F.concat("_path", "path")
        table = stored(
            open_.join(there, F.col("up") == F.col("_id")).select(
                "id", "parent", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_state").alias("state"), *whole(longer), "inner"
            ),
            "links",
        )
        done.append(table.where("state is not null"))
        open_ = table.where("state is null")
        now = open_.count()
        loops, left = loops or now == left, now
    is_root = F.col("state") == "root"
    return reduce(DataFrame.unionByName, done).select(
        "id", "parent", F.when(is_root, F.col("up")).alias("root"), F.when(is_root, F.col("hops")).alias("depth"), "state", *[F.when(is_root, F.col("path")).alias("path")] * paths
    )


def descendants(placed: DataFrame) -> DataFrame:
    """(id, below, distance): every node with every node under it. placed: resolve(..., paths=True). Nodes in no tree have no row."""
    at = F.posexplode("path").alias("_pos", "id")
    return placed.where("state = 'root'").select(F.col("id").alias("below"), "depth", at).where("id <> below").select("id", "below", (F.col("depth") - F.col("_pos")).alias("distance"))


def subtree_sizes(placed: DataFrame) -> DataFrame:
    """(id, n_below) of every node of a tree, 0 for leaves; counted before the shuffle."""
    every = placed.where("state = 'root'").select(F.explode("path").alias("id"))
    return every.groupBy("id").agg((F.count("*") - 1).alias("n_below"))
