"""Most similar vectors by low-dimensional stable projections, kd-trees over them and a chi-square stopping test.

Unit vectors are projected onto Gaussian directions. The projected difference of two vectors follows a normal law whose
variance is their squared distance, whatever the data; over m directions its square, divided by the squared distance,
follows a chi-square law with m degrees of freedom. So what lies far in projection can be given up at a known risk.

pairs() finds all pairs above a cosine. To bring near vectors together on the cluster, a vector lives in the cell of the
direction on which it is projected furthest, of as many as keep CELL vectors in one, and visits the cells of directions
on which it is projected not much less. In a cell a kd-tree over projections is searched in order of projected distance; what is met
there is a candidate if its projected distance over MORE directions passes the chi-square test at risk RISK, and
candidates are verified with the vectors themselves. How far a vector must look, in cells and in the tree, to miss no more
than MISS of the partners at exactly the given cosine, is found for the number of cells at hand: partners are drawn for
sampled vectors by the law above, and the least distances at which enough of them are met are taken. So recall does not
fall as the collection grows. Equal vectors are one class first; crowded cells are cut into blocks.

nearest() finds the k most similar of all vectors for given queries by the same cells: a query visits those where its
neighbours may be, as neighbours in the sample show, and in each searches a kd-tree, whose leaves come in order of
projected distance until no better one is to be expected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.session import stored

MISS, RISK = 0.001, 1e-4
#: Vectors of a cell; cells at least, where there are more than FEW vectors of a length; vectors of a leaf of the kd-tree in a cell.
CELL, CELLS, FEW, LEAF = 32_768, 16, 2_048, 256
#: Directions of the chi-square test; the first of them are those of the kd-tree.
MORE = 40
#: Vectors that are sampled to fit the search, and pairs that are drawn. Every vector is indexed.
SAMPLE, DRAWN = 16_384, 40_000
#: Share of the nearest vectors that may lie in cells a query does not visit, and queries that meet a block of a cell.
LOST, ASKED = 0.03, 60_000
#: Projected coordinates are sent as bytes: from -4 to 4.
STEP = 127 / 4
#: Classes of equal vectors up to this size are given out as all their pairs, larger ones as links to their first id.
CLASS = 11
#: Bytes up to which a table is broadcast.
BYTES = 4 << 20


def chi2_at(p: float, m: int) -> float:
    """Quantile of the chi-square law (Wilson and Hilferty)."""
    lo, hi = -8.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return m * max(0.0, 1 - 2 / (9 * m) + lo * math.sqrt(2 / (9 * m))) ** 3


def directions(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim, m]).standard_normal((dim, m)).astype(np.float32)


def usable(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of vectors that have a direction: not null, empty or all zero, without nulls, NaN and infinities."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0").where(fine)


def _units(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length in a column of lists."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, _units(flat[offsets[rows][:, None] + np.arange(dim)])


def split_points(points: np.ndarray, levels: int) -> np.ndarray:
    """Medians of a complete kd-tree over the first coordinates in turn, in heap order; nodes without points take the column's."""
    out = np.zeros(1 << levels, np.float32)
    node = np.ones(len(points), np.int64)
    for level in range(levels):
        column, whole = points[:, level], float(np.median(points[:, level])) if len(points) else 0.0
        order = np.lexsort((column, node))
        sorted_nodes = node[order]
        first = np.searchsorted(sorted_nodes, np.arange(1 << level, 2 << level))
        last = np.searchsorted(sorted_nodes, np.arange(1 << level, 2 << level), side="right")
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            out[(1 << level) + i] = column[order[(a + b) // 2]] if b - a >= 8 else whole
        node = 2 * node + (column > out[node])
    return out


def visits(points: np.ndarray, splits: np.ndarray, levels: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of all leaves within the squared projected distance, home for a row's own."""
    row, node, cost = np.arange(len(points)), np.ones(len(points), np.int64), np.zeros(len(points), np.float32)
    for level in range(levels):
        gap = points[row, level] - splits[node]
        right = (gap > 0).astype(np.int64)
        far = cost + gap * gap
        also = far <= radius
        row = np.concatenate([row, row[also]])
        node = np.concatenate([2 * node + right, 2 * node[also] + 1 - right[also]])
        cost = np.concatenate([cost, far[also]])
    return row, node - (1 << levels), cost == 0


def _leaf_cost(points: np.ndarray, others: np.ndarray, splits: np.ndarray, levels: int) -> np.ndarray:
    """Squared projected distance from each point to the leaf of the other."""
    node, cost = np.ones(len(points), np.int64), np.zeros(len(points))
    for level in range(levels):
        here, there = points[:, level] > splits[node], others[:, level] > splits[node]
        cost += np.where(here != there, (points[:, level] - splits[node]) ** 2, 0)
        node = 2 * node + there
    return cost


@lru_cache(64)
def _cell_directions(dim: int, cells: int, table: int) -> np.ndarray:
    g = directions(dim, cells, 100 + table)
    return g / np.linalg.norm(g, axis=0)


@dataclass
class Search:
    """How vectors of one length look for partners.

    mean, spread: of the projections onto the directions of the cells, so that no cell is large for the place of all data alone.
    reach: how much less a vector may be projected onto a direction than onto its own to visit the cell. blocks: into how many
    blocks of homes and of visitors each cell is cut.
    """

    cells: int
    tables: int
    mean: np.ndarray
    spread: np.ndarray
    reach: float
    levels: int
    splits: np.ndarray
    radius: float
    blocks: np.ndarray

    def cell_coordinates(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ _cell_directions(x.shape[1], self.cells, table) - self.mean[table]) / self.spread[table]


#: For lengths of vectors that the sample has not met: one cell without tree, so nothing is missed. They are few.
WHOLE = Search(1, 1, np.zeros((1, 1)), np.ones((1, 1)), 0.0, 0, np.zeros(1, np.float32), 0.0, np.ones((1, 1, 2), np.int64))


def partners(x: np.ndarray, cosine: float, seed: int = 3) -> np.ndarray:
    """For each unit vector one at exactly this cosine, in a random direction."""
    if x.shape[1] < 2:
        return x
    w = np.random.default_rng(seed).standard_normal(x.shape).astype(np.float32)
    w -= (w * x).sum(1, keepdims=True) * x
    return cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * w / np.linalg.norm(w, axis=1, keepdims=True)


def fitted(x: np.ndarray, n: int, cosine: float, cells: int | None = None, block: int = 2 * CELL) -> Search:
    """The search for n vectors, of which x (unit length) is a sample. Of one and two tables of cells the one with fewer visits is taken."""
    dim = x.shape[1]
    cells = cells or (1 if n <= FEW else max(CELLS, 1 << math.ceil(math.log2(max(1, n / CELL)))))
    levels = max(0, min(12, MORE, math.ceil(math.log2(max(1, n / cells) / LEAF))))
    a = x[np.arange(max(len(x), DRAWN)) % len(x)]
    b = partners(a, cosine)
    g = directions(dim, MORE)
    splits = split_points(x @ g, levels)
    least = None
    for tables in (1, 2) if cells > 1 else (1,):
        mean, square = np.zeros((tables, cells)), np.zeros((tables, cells))
        for t in range(tables):
            for at in range(0, len(x), 1024):
                p = x[at : at + 1024] @ _cell_directions(dim, cells, t)
                mean[t] += p.sum(0) / len(x)
                square[t] += (p * p).sum(0) / len(x)
        spread = np.sqrt(np.maximum(0, square - mean * mean)) + 1e-6
        s = Search(cells, tables, mean.astype(np.float32), spread.astype(np.float32), 0.0, levels, splits, 0.0, np.ones((tables, cells, 2), np.int64))
        there, back = np.empty((tables, len(a))), np.empty((tables, len(a)))
        for t in range(tables):
            for at in range(0, len(a), 1024):
                p, q, i = s.cell_coordinates(a[at : at + 1024], t), s.cell_coordinates(b[at : at + 1024], t), np.arange(len(a[at : at + 1024]))
                there[t, at : at + 1024] = p.max(1) - p[i, q.argmax(1)]
                back[t, at : at + 1024] = q.max(1) - q[i, p.argmax(1)]
        s.reach = float(np.quantile(np.minimum(there, back).min(0), 1 - MISS / 2)) + 1e-5
        pa_, pb = a @ g, b @ g
        one, two = _leaf_cost(pa_, pb, splits, levels), _leaf_cost(pb, pa_, splits, levels)
        met = np.minimum(np.where((there <= s.reach).any(0), one, np.inf), np.where((back <= s.reach).any(0), two, np.inf))
        s.radius = float(np.quantile(met, 1 - MISS, method="lower")) + 1e-4
        all_ = np.zeros((tables, cells, 2))
        for t in range(tables):
            for at in range(0, len(x), 1024):
                p = s.cell_coordinates(x[at : at + 1024], t)
                all_[t, :, 0] += np.bincount(p.argmax(1), minlength=cells)
                all_[t, :, 1] += (p.max(1)[:, None] - p <= s.reach).sum(0)
        s.blocks = np.maximum(1, np.ceil(all_ * (n / len(x)) / [block, 16 * block])).astype(np.int64)
        if least is None or all_[:, :, 1].sum() < least[0]:
            least = all_[:, :, 1].sum(), s
    return least[1]


def placed(s: Search, x: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, home) of unit vectors x with keys k, where cell numbers tables, cells and blocks. A row that is home in a cut cell comes as
    home to one block of homes, in each block of visitors, and as visitor to each block of homes."""
    mixed = (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    for t in range(s.tables):
        p = s.cell_coordinates(x, t)
        row, cell = np.nonzero(p.max(1)[:, None] - p <= s.reach)
        home = cell == p.argmax(1)[row]
        nx, ny = s.blocks[t, cell, 0], s.blocks[t, cell, 1]
        whole = nx * ny == 1
        number = (t * s.cells + cell).astype(np.int64) << 24
        yield row[whole], number[whole], home[whole]
        for i in np.flatnonzero(~whole):
            h, m = int(mixed[row[i]]), int(nx[i])
            if home[i]:
                at = np.arange(ny[i]) * m + h % m
                yield np.full(len(at), row[i]), number[i] + at, np.ones(len(at), bool)
            at = h % int(ny[i]) * m + np.arange(m)
            yield np.full(m, row[i]), number[i] + at, np.zeros(m, bool)


def _candidates(s: Search, cell: pa.Table, limit: float) -> pa.Table:
    home, k = cell["home"].to_numpy(), cell["k"].to_numpy()
    x = np.frombuffer(b"".join(cell["p"].to_pylist()), np.int8).reshape(len(k), -1).astype(np.float32) / np.float32(STEP)
    norm, found = (x * x).sum(1), []
    row, leaf, own = visits(x, s.splits, s.levels, s.radius)
    order = np.argsort(leaf, kind="stable")
    row, own = row[order], (own & home[row])[order]
    edge = np.searchsorted(leaf[order], np.arange((1 << s.levels) + 1))
    for lo, hi in zip(edge, edge[1:], strict=False):
        here, mine = row[lo:hi], row[lo:hi][own[lo:hi]]
        for at in range(0, len(mine), 1024):
            a = mine[at : at + 1024]
            for to in range(0, len(here), 4096):
                b = here[to : to + 4096]
                i, j = np.nonzero(norm[a][:, None] + norm[b][None, :] - 2 * (x[a] @ x[b].T) <= limit)
                ka, kb = k[a[i]], k[b[j]]
                keep = ka != kb
                found.append(np.stack([np.minimum(ka, kb)[keep], np.maximum(ka, kb)[keep]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"ka": pairs[:, 0], "kb": pairs[:, 1]})


def _members(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, k, h) of each vector of an id, k and h naming its class of equal vectors, and (k, h, v) of the classes."""
    rows = usable(vectors).select("id", "v", F.xxhash64("v").alias("k"), F.xxhash64(F.lit(1), "v").alias("h"))
    return stored(rows.select("id", "k", "h").distinct(), "members"), stored(rows.groupBy("k", "h").agg(F.max("v").alias("v")), "classes")


def classes(vectors: DataFrame) -> DataFrame:
    """(id, class_id, copies) of vectors(id, embedding) that have a direction: the smallest id with an equal vector, and how many ids have it.

    With it the links that pairs() gives for large classes can be spread over all their members. An id with several
    vectors has a row for each.
    """
    rows = usable(vectors).select("id", F.xxhash64("v").alias("k"), F.xxhash64(F.lit(1), "v").alias("h")).distinct()
    per = rows.groupBy("k", "h").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return rows.join(per, ["k", "h"]).select("id", "class_id", "copies")


def pairs(vectors: DataFrame, cosine: float = 0.9, cells: int | None = None, block: int = 2 * CELL) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of different ids that have vectors of the same length with at least this cosine.

    vectors(id, embedding). Repeated rows count once; an id with several vectors takes part with each. Vectors without
    direction are in no pair. A class of over CLASS equal vectors gives links to its smallest id instead of all its pairs,
    and only that id is paired with others: classes() has the members. An empty table gives an empty result. cells: their number, if it is not to follow the
    number of vectors.
    """
    members, reps = _members(vectors)
    n = reps.count()
    share = math.ceil(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))  # hashes are uniform, so about SAMPLE rows reach the driver at any size
    sample: dict[int, list] = {}
    for (v,) in reps.where(F.pmod("h", F.lit(1 << 30)) < share).select("v").collect():
        sample.setdefault(len(v), []).append(v)
    drawn = max(1, sum(map(len, sample.values())))
    ways = {dim: fitted(_units(np.array(v, np.float32)), max(1, n * len(v) // drawn), cosine, cells, block) for dim, v in sample.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k").to_numpy()
            for at, x in _matrices(b.column("v")):
                dim = x.shape[1]
                small = np.clip(np.rint(x @ directions(dim, MORE) * STEP), -127, 127).astype(np.int8)
                got = list(placed(ways.get(dim, WHOLE), x, k[at]))
                row, cell, home = (np.concatenate(c) for c in zip(*got, strict=True))
                sent = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MORE), len(row), [None, pa.py_buffer(np.ascontiguousarray(small[row]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim, np.int32)), pa.array(cell), pa.array(home), pa.array(k[at][row]), sent], ["dim", "cell", "home", "k", "p"])

    limit = 2 - 2 * cosine
    test = limit * chi2_at(1 - RISK, MORE)
    cut = reps.select("k", "v").mapInArrow(place, "dim int, cell bigint, home boolean, k bigint, p binary")
    found = cut.groupBy("dim", "cell").applyInArrow(lambda key, t: _candidates(ways.get(key[0].as_py(), WHOLE), t, test), "ka bigint, kb bigint")
    found = stored(found.distinct(), "candidates")
    few = found.count() * 16 <= BYTES
    a = reps.select(F.col("k").alias("ka"), F.col("h").alias("ha"), F.col("v").alias("va"))
    b = reps.select(F.col("k").alias("kb"), F.col("h").alias("hb"), F.col("v").alias("vb"))
    half = stored(a.join(F.broadcast(found) if few else found, "ka"), "half")
    size = half.agg(F.sum(F.size("va") * 4 + 48)).first()[0] or 0
    both = b.join(F.broadcast(half) if size <= BYTES else half, "kb")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    near = both.where((F.size("va") == F.size("vb")) & (dot("va", "vb") >= F.lit(cosine) * F.sqrt(dot("va", "va") * dot("vb", "vb")))).select("ka", "ha", "kb", "hb")
    per = members.groupBy("k", "h").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shown = members.join(per, ["k", "h"]).where((F.col("n") <= CLASS) | (F.col("id") == F.col("first")))
    left, right = shown.select(F.col("k").alias("ka"), F.col("h").alias("ha"), F.col("id").alias("i")), shown.select(F.col("k").alias("kb"), F.col("h").alias("hb"), F.col("id").alias("j"))
    across = near.join(left, ["ka", "ha"]).join(right, ["kb", "hb"]).select("i", "j")
    many = members.join(per.where("n > 1"), ["k", "h"])
    inner = many.where(F.col("n") <= CLASS).select("k", "h", "id")
    copies = inner.select("k", "h", F.col("id").alias("i")).join(inner.select("k", "h", F.col("id").alias("j")), ["k", "h"]).where("i < j").select("i", "j")
    links = many.where((F.col("n") > CLASS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("i"), F.col("id").alias("j"))
    every = across.unionByName(copies).unionByName(links).where("i <> j")
    return every.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


class Tree:
    """A kd-tree over projections of unit vectors, for searches that stop by the chi-square test."""

    def __init__(self, x: np.ndarray, m: int = 8, leaf: int = 2048):
        self.x, self.g = x, directions(x.shape[1], m)
        p, todo, self.leaves = x @ self.g, [np.arange(len(x))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            q = p[rows]
            order = np.argsort(q[:, int(np.argmax(q.max(0) - q.min(0)))], kind="stable")
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.low = np.array([p[r].min(0) for r in self.leaves])
        self.high = np.array([p[r].max(0) for r in self.leaves])

    def search(self, q: np.ndarray, k: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, rows) of the k best for each query, padded with -2 and -1."""
        p = q @ self.g
        gap = np.maximum(np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]), 0)
        bound = (gap * gap).sum(2)
        order, stop = np.argsort(bound, axis=1), chi2_at(sure, self.g.shape[1])
        best, at = np.full((len(q), k), -2.0, np.float32), np.full((len(q), k), -1)
        active = np.arange(len(q))
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            worst = 2 - 2 * best[active, -1]
            go = bound[active, leaf] < stop * worst  # else a nearer vector would, that surely, have been projected nearer
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for who in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                rows = self.leaves[order[who[0], step]]
                score = q[who] @ self.x[rows].T
                won = np.flatnonzero((score > best[who, -1:]).any(1))  # few, once the first leaves are seen
                if not len(won):
                    continue
                who, score = who[won], score[won]
                if score.shape[1] > k:
                    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, index = np.take_along_axis(score, near, 1), rows[near]
                else:
                    index = np.broadcast_to(rows, score.shape)
                score, index = np.concatenate([best[who], score], 1), np.concatenate([at[who], index], 1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best[who], at[who] = np.take_along_axis(score, top, 1), np.take_along_axis(index, top, 1)
        return best, at


def reaching(x: np.ndarray, n: int, k: int, cells: int | None = None, queries: int = 0) -> Search:
    """The search for the k most similar of n vectors, of which x (unit length) is a sample: how far a query must look to meet all
    but LOST of its neighbours. Neighbours in the sample are farther than those in the whole, so that they ask for more rather than less."""
    cells = cells or (1 if n <= FEW else max(CELLS, 1 << math.ceil(math.log2(max(1, n / CELL)))))
    near = x[: min(len(x), 1000)] @ x.T
    np.put_along_axis(near, np.arange(len(near))[:, None], -2.0, 1)
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    s = Search(cells, 1, np.zeros((1, cells), np.float32), np.ones((1, cells), np.float32), 0.0, 0, np.zeros(1, np.float32), 0.0, np.ones((1, cells, 2), np.int64))
    p = s.cell_coordinates(x, 0)
    s.mean, s.spread = p.mean(0)[None], p.std(0)[None] + 1e-6
    p = s.cell_coordinates(x, 0)
    own = p.argmax(1)
    gaps = p[: len(near)].max(1)[:, None] - np.take_along_axis(p[: len(near)], own[best], 1)
    s.reach = float(np.quantile(gaps, 1 - LOST)) + 1e-5 if gaps.size else np.inf
    homes, asked = np.bincount(own, minlength=cells) * (n / len(x)), (p.max(1)[:, None] - p <= s.reach).sum(0) * (queries / len(x))
    s.blocks[0] = np.maximum(1, np.ceil(np.stack([homes / (2 * CELL), asked / ASKED], 1)))
    return s


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sure: float = 0.9, cells: int | None = None) -> DataFrame:
    """(id, neighbour, cosine, place): for each query the k most similar vectors of the same length with another id.

    vectors, queries(id, embedding). A vector lives in one cell, a query visits cells in order of its projections as far as reaching() says, and in
    each the leaves of its kd-tree until no better one is to be expected. Fewer than k if there are not so many. Equal
    cosines go by id; which of those that are equal at the last place are given is open.
    """
    base, asked = stored(usable(vectors).groupBy("id").agg(F.max("v").alias("v")), "vectors"), stored(usable(queries).groupBy("id").agg(F.max("v").alias("v")), "queries")
    n, m = base.count(), asked.count()
    share = math.ceil(min(1.0, SAMPLE / 2 / max(n, 1)) * (1 << 30))
    sample: dict[int, list] = {}
    for (v,) in base.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share).select("v").collect():  # about SAMPLE / 2 rows at any size
        sample.setdefault(len(v), []).append(v)
    drawn = max(1, sum(map(len, sample.values())))
    ways = {dim: reaching(_units(np.array(v, np.float32)), max(1, n * len(v) // drawn), k, cells, m * len(v) // drawn) for dim, v in sample.items() if len(v) > k}

    def placing(homes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column("h").to_numpy().view(np.uint64) >> np.uint64(1)
                for at, x in _matrices(b.column("v")):
                    s = ways.get(x.shape[1], WHOLE)
                    p = s.cell_coordinates(x, 0)
                    row, cell = (np.arange(len(x)), p.argmax(1)) if homes else np.nonzero(p.max(1)[:, None] - p <= s.reach)
                    own, other = s.blocks[0, cell, 0 if homes else 1], s.blocks[0, cell, 1 if homes else 0]
                    block = (h[at][row] % own.astype(np.uint64)).astype(np.int64)
                    copies = np.repeat(np.arange(len(row)), other)
                    each = np.arange(len(copies)) - np.repeat(np.cumsum(other) - other, other)
                    x_, y_ = (block[copies], each) if homes else (each, block[copies])
                    at_ = pa.array(at[row[copies]])
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at_), b.column("v").take(at_), pa.array(np.full(len(copies), x.shape[1], np.int32)), pa.array(cell[copies].astype(np.int64)), pa.array(x_), pa.array(y_)], ["id", "v", "dim", "cell", "x", "y"])

        return run

    kind = dict(base.dtypes)["id"]
    laid = lambda df, homes: df.select("id", "v", F.xxhash64("id").alias("h")).mapInArrow(placing(homes), f"id {kind}, v array<float>, dim int, cell bigint, x bigint, y bigint").groupBy("dim", "cell", "x", "y")

    def meet(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []}).astype({"id": str, "neighbour": str, "cosine": float})
        ids, q_ids = vs["id"].to_numpy(), qs["id"].to_numpy()
        tree, out = Tree(_units(np.stack(vs["v"]))), []
        q = _units(np.stack(qs["v"]))
        for a in range(0, len(q), 4096):
            best, at = tree.search(q[a : a + 4096], k + 1, sure)
            row, col = np.nonzero(at >= 0)
            out.append(pd.DataFrame({"id": q_ids[a + row], "neighbour": ids[at[row, col]], "cosine": best[row, col].astype(float)}))
        all_ = pd.concat(out)
        return all_[all_["id"] != all_["neighbour"]]

    met = laid(base, True).cogroup(laid(asked, False)).applyInPandas(meet, f"id {kind}, neighbour {kind}, cosine double")
    row = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return met.withColumn("place", row).where(F.col("place") <= k)
