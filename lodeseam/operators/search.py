"""Keyword, semantic and hybrid ranking of chunks for tables of queries.

Queries are sent to the chunks: a block of them, of measured size, is broadcast with the statistics of its terms, every
task scores the chunks it holds, and only its best rows per query travel. More queries make more blocks, each a pass over
the chunks. Terms that no query asks for do not leave the task that reads them. Semantic scores are those of the stored embeddings.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.functions.embed import TOKEN, Embedder, embedder
from lodeseam.functions.text import bucket, sign, tokens
from lodeseam.operators.ranking import first_k
from lodeseam.session import stored

#: Constants of the ranking function and its blend (fixed values).
K1, B, WEIGHT, NONE = 1.5, 0.75, 0.6, 1e-9
#: Bytes of a block of queries, and queries of it that are scored at once.
BLOCK, AT_ONCE = 8 << 20, 128


def term_frequencies(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of docs(key, text)."""
    return docs.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, key: str) -> DataFrame:
    """(term, df): the number of rows of docs with each term, counted in each task first."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def hash_embedding(docs: DataFrame, key: str, dimensions: int = 256) -> DataFrame:
    """(key, bucket, value): the cells other than 0 of the hashed embeddings at unit length. Texts without tokens have none."""
    each = docs.select(key, F.explode(tokens(F.col("text"))).alias("t"))
    cells = each.select(key, bucket(F.col("t"), dimensions).alias("bucket"), sign(F.col("t")).alias("s")).groupBy(key, "bucket").agg(F.sum("s").alias("s")).where("s <> 0")
    norm = cells.groupBy(key).agg(F.sqrt(F.sum((F.col("s") * F.col("s")).cast("double"))).alias("norm"))
    return cells.join(norm, key).select(key, "bucket", (F.col("s") / F.col("norm")).alias("value"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a word asked for twice counts twice."""
    return queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of all rows of docs(key, text) that have a term of the query. Empty queries have none.

    A row for every match; for the best of each query bm25_topk() needs far fewer.
    """
    own = docs.select(key, tokens(F.col("text")).alias("t"))
    shape = own.agg(F.count("*").alias("_docs"), F.avg(F.coalesce(F.size("t"), F.lit(0))).alias("_mean"))
    asked = query_terms(queries)
    words = asked.select("term").distinct()
    hits = own.select(key, F.size("t").alias("_len"), F.explode("t").alias("term")).join(words, "term").groupBy(key, "_len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log1p((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.col("_mean"))) * F.col("qtf")
    return hits.join(asked.join(df, "term"), "term").join(F.broadcast(shape)).groupBy("query_id", key).agg(F.sum(part).alias("score"))  # shape: one row


@dataclass
class Asked:
    """A block of queries, as it is sent to the tasks. words: all their terms in order; for each query its terms (places in words) and
    their counts; rarity: of each word over all documents; vectors: at unit length."""

    ids: np.ndarray
    top: np.ndarray
    words: dict[str, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vectors: np.ndarray
    rarity: np.ndarray
    mean: float = 1.0
    spans: np.ndarray | None = None


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[pd.DataFrame]:
    """The queries in blocks of about that many bytes, each of which may be broadcast. A block is one pass over the documents."""
    queries = stored(queries, "queries")
    each = [F.coalesce(F.length(c) if t == "string" else F.size(c) * 4 if t.startswith("array") else F.lit(8), F.lit(0)) for c, t in queries.dtypes]
    total = queries.agg(F.sum(reduce(lambda x, y: x + y, each))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toPandas()
        if len(rows) or n == 1:
            yield rows.sort_values("query_id")


def _asked(rows: pd.DataFrame) -> Asked:
    counted = [Counter(TOKEN.findall(t.lower()) if isinstance(t, str) else []) for t in rows["query_text"]]
    words = {w: i for i, w in enumerate(sorted({w for c in counted for w in c}))}
    terms = [np.array(sorted(words[w] for w in c), np.int64) for c in counted]
    names = list(words)
    times = [np.array([c[names[i]] for i in t], float) for c, t in zip(counted, terms, strict=True)]
    top = rows["top_k"].to_numpy(np.int64) if "top_k" in rows else np.zeros(len(rows), np.int64)
    return Asked(rows["query_id"].to_numpy(), top, words, terms, times, np.zeros((len(rows), 0)), np.zeros(len(words)))


def _counted(docs: DataFrame, asked: Asked) -> tuple[DataFrame, Asked]:
    """docs without text and with n (tokens), w and f (places and counts of the asked words that it has), written once; asked with what they say of all documents."""
    words, keep = docs.sparkSession.sparkContext.broadcast(asked.words), [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, w, f = [], [], []
            for t in b["text"]:
                own = TOKEN.findall(t.lower()) if isinstance(t, str) else []
                some = Counter(i for x in own if (i := words.value.get(x)) is not None)
                n.append(len(own))
                w.append(list(some))
                f.append(list(some.values()))
            yield pd.DataFrame({c.name: b[c.name] for c in keep} | {"n": n, "w": w, "f": f})

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), "n int, w array<int>, f array<int>"])
    base = stored(docs.mapInPandas(run, schema), "counted")
    count, mean = base.agg(F.count("*"), F.avg("n")).first()
    df = np.zeros(len(asked.words))
    for w, c in base.select(F.explode("w").alias("w")).groupBy("w").count().collect():  # as many rows as the block has words
        df[w] = c
    return base, replace(asked, rarity=np.log1p((count - df + 0.5) / (df + 0.5)), mean=float(mean or 1))


def _keyword(rows: pd.DataFrame, asked: Asked, which: range) -> np.ndarray:
    """Keyword scores of some of the queries (rows) for documents (columns)."""
    out = np.zeros((len(which), len(rows)))
    size = rows["n"].to_numpy(float)
    count = rows["w"].map(len).to_numpy()
    if not count.sum():
        return out
    w, f, row = np.concatenate(list(rows["w"])), np.concatenate(list(rows["f"])), np.repeat(np.arange(len(rows)), count)
    order = np.argsort(w, kind="stable")
    w, f, row = w[order], f[order], row[order]
    edge = np.searchsorted(w, np.arange(len(asked.words) + 1))
    part = asked.rarity[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[row] / asked.mean))
    for k, q in enumerate(which):
        for t, times in zip(asked.terms[q], asked.times[q], strict=True):
            at = slice(edge[t], edge[t + 1])
            out[k, row[at]] += times * part[at]
    return out


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors of a column of lists; all zero where one is missing, of another length or not finite."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        if v is not None and len(v) == dim:
            out[i] = v
    out[~np.isfinite(out).all(1)] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _parts(asked: Asked) -> list[range]:
    return [range(i, min(i + AT_ONCE, len(asked.ids))) for i in range(0, len(asked.ids), AT_ONCE)]


def _in_blocks(queries: DataFrame, one: Callable[[pd.DataFrame], DataFrame]) -> DataFrame:
    """The results of all blocks of queries; all but a single one are written before the next begins."""
    made: list[DataFrame] = []
    for rows in blocks(queries):
        if len(made) == 1:
            made = [stored(made[0], "block")]
        made.append(stored(one(rows), "block") if made else one(rows))
    return reduce(DataFrame.unionByName, made)


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, equal ones in order of place."""
    if not len(score):
        return np.zeros(0, np.int64)
    at = max(0, len(score) - k)
    near = np.flatnonzero(score >= np.partition(score, at)[at])
    return near[np.argsort(-score[near], kind="stable")[:k]]


def bm25_topk(docs: DataFrame, key: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, score, place) of the k best rows of docs(key, text), unique keys, that have a term of the query.

    Scores to 4 digits, equal ones by key. The same scores as bm25() gives, without a row for every match: each task
    returns its best, so documents are not shuffled.
    """
    kind = dict(docs.dtypes)[key]
    asked = queries.where("query_id is not null").groupBy("query_id").agg(F.max("query_text").alias("query_text"))

    def block(rows: pd.DataFrame) -> DataFrame:
        base, some = _counted(docs.select(key, "text"), _asked(rows))
        sent = base.sparkSession.sparkContext.broadcast(replace(some, words=dict.fromkeys(some.words)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b, out = b.sort_values(key, kind="stable"), []
                keys = b[key].to_numpy()
                for which in _parts(sent.value):
                    for q, raw in zip(sent.value.ids[which], _keyword(b, sent.value, which), strict=True):
                        top = _first(np.where(raw > 0, np.round(raw, 4), -1.0), k)
                        top = top[raw[top] > 0]
                        out.append(pd.DataFrame({"query_id": q, key: keys[top], "score": np.round(raw[top], 4)}))
                if out:
                    yield pd.concat(out)

        return base.mapInPandas(run, f"query_id bigint, {key} {kind}, score double")

    met = _in_blocks(asked, block).withColumn("_k", F.lit(k))
    return first_k(met, ["query_id"], [F.desc("score"), F.asc(key)], "_k", k).drop("_k")


def cosine_topk(vectors: DataFrame, key: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, score, place): the k most similar of vectors(key, embedding) for queries(query_id, embedding), another key each.

    Scores to 4 digits, equal ones by key. Vectors of another length, null and empty ones take no part; all-zero ones score 0.
    Every vector is held against every query, in blocks; each task returns its best, so vectors are not shuffled.
    """
    kind = dict(vectors.dtypes)[key]
    base = vectors.where("embedding is not null and size(embedding) > 0").select(key, "embedding")

    def block(rows: pd.DataFrame) -> DataFrame:
        sizes = rows["embedding"].map(len) if len(rows) else pd.Series([], dtype=int)
        by_size = {d: (rows["query_id"].to_numpy()[sizes == d], _vectors(rows["embedding"][sizes == d], d)) for d in sorted(set(sizes))}
        sent = base.sparkSession.sparkContext.broadcast(by_size)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b, out = b.sort_values(key, kind="stable"), []
                of = b["embedding"].map(len)
                for dim in sorted(set(of) & set(sent.value)):
                    own, (ids, y) = b[of == dim], sent.value[dim]
                    keys, x = own[key].to_numpy(), _vectors(own["embedding"], dim)
                    for at in range(0, len(ids), AT_ONCE):
                        score = np.round(y[at : at + AT_ONCE] @ x.T, 4)
                        for q, row in zip(ids[at : at + AT_ONCE], score, strict=True):
                            top = _first(row, k + 1)
                            out.append(pd.DataFrame({"query_id": q, key: keys[top], "score": row[top]}))
                if out:
                    yield pd.concat(out)

        return base.mapInPandas(run, f"query_id bigint, {key} {kind}, score double")

    asked = queries.where("embedding is not null and size(embedding) > 0").select("query_id", "embedding")
    met = _in_blocks(asked, block).where(F.col("query_id").cast("string") != F.col(key).cast("string")).withColumn("_k", F.lit(k))
    return first_k(met, ["query_id"], [F.desc("score"), F.asc(key)], "_k", k).drop("_k")


def hybrid(chunks: DataFrame, queries: DataFrame, pages: DataFrame, weight: float = WEIGHT, by: Embedder | None = None) -> DataFrame:
    """(query_id, chunk_id, page_id, page_url, page_title, text, score, method, place): the best top_k chunks of each query.

    chunks(id, page_id, seq, text, embedding), queries(query_id, query_text, top_k), pages(id, url, title). by embeds
    the queries as the chunks were; stored embeddings are used as they are, at unit length, and count 0 if they are
    missing, of another length or not finite. Cosine and keyword score are each brought to 0..1 over all chunks of the
    query (0 throughout if they are all the same) and blended. Scores to 4 digits; equal ones by page and seq. Repeated chunks count
    once. top_k must be in 1..25; queries with another one, or none, have no rows. The label says which side had any
    signal. A page that is missing leaves ''. Each task returns its best, so chunks are not shuffled once they are unique.
    """
    by = by or embedder()
    base = chunks.where("id is not null").groupBy("id").agg(F.max(F.struct("page_id", "seq", "text", "embedding")).alias("c")).select("id", "c.*")
    base = stored(base, "chunks")
    asked = queries.where("query_id is not null and top_k between 1 and 25")
    asked = asked.groupBy("query_id").agg(F.max(F.struct("query_text", "top_k")).alias("q")).select("query_id", "q.*")
    asked = asked.withColumn("vector", by.column(F.coalesce("query_text", F.lit(""))))

    def scores(b: pd.DataFrame, some: Asked, which: range) -> tuple[np.ndarray, np.ndarray]:
        return some.vectors[which] @ _vectors(b["embedding"], by_dim).T, _keyword(b, some, which)

    by_dim = by.dimensions

    def block(rows: pd.DataFrame) -> DataFrame:
        own = replace(_asked(rows), vectors=_vectors(rows["vector"], by_dim))
        ready, own = _counted(base.select("id", "page_id", "seq", "text", "embedding"), own)
        own = replace(own, words=dict.fromkeys(own.words))
        context = base.sparkSession.sparkContext
        first = context.broadcast(own)

        def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for which in _parts(first.value) if len(b) else []:
                    s, k = scores(b, first.value, which)
                    yield pd.DataFrame({"query": list(which), "s0": s.min(1), "s1": s.max(1), "k0": k.min(1), "k1": k.max(1)})

        span = ready.select("n", "w", "f", "embedding").mapInPandas(spans, "query int, s0 double, s1 double, k0 double, k1 double")
        ends = np.zeros((len(own.ids), 4))
        for r in span.groupBy("query").agg(F.min("s0"), F.max("s1"), F.min("k0"), F.max("k1")).collect():  # a row for each query of the block
            ends[r[0]] = r[1:]
        sent = context.broadcast(replace(own, spans=ends))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b, some, out = b.sort_values(["page_id", "seq", "id"], kind="stable"), sent.value, []
                for which in _parts(some):
                    for q, s, k in zip(which, *scores(b, some, which), strict=True):
                        norm = lambda x, lo, hi: (x - lo) / (hi - lo) if hi - lo > NONE else np.zeros_like(x)
                        e = some.spans[q]
                        score = np.round(weight * norm(s, e[0], e[1]) + (1 - weight) * norm(k, e[2], e[3]), 4)
                        top = _first(score, some.top[q])
                        method = np.where(k[top] <= NONE, "semantic", np.where(s[top] <= NONE, "keyword", "hybrid"))
                        out.append(pd.DataFrame({"query_id": some.ids[q], **{c: b[c if c != "chunk_id" else "id"].to_numpy()[top] for c in ("chunk_id", "page_id", "seq")}, "score": score[top], "method": method, "top_k": some.top[q]}))
                if out:
                    yield pd.concat(out)

        return ready.mapInPandas(best, "query_id bigint, chunk_id string, page_id string, seq int, score double, method string, top_k int")

    met = _in_blocks(asked, block)
    row = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "page_id", "seq", "chunk_id"))
    top = met.withColumn("place", row).where("place <= 25").where(F.col("place") <= F.col("top_k"))
    meta = pages.select(F.col("id").alias("_p"), F.col("url").alias("_url"), F.col("title").alias("_title"))
    text = base.select(F.col("id").alias("_c"), "text")
    full = top.join(text, F.col("chunk_id") == F.col("_c")).join(meta, F.col("page_id") == F.col("_p"), "left")
    return full.select("query_id", "chunk_id", "page_id", F.coalesce("_url", F.lit("")).alias("page_url"), F.coalesce("_title", F.lit("")).alias("page_title"), "text", "score", "method", "place")
