"""Mixing sources to target weights by fitting token budgets.

Documents are counted by source and exact token length, which is all the fit needs: at most as many numbers per source
as there are different lengths. A source gets whole copies while they fit its budget, then the same fraction of every
length, where what a length cannot give in whole documents passes on to the next shorter one (so the mix keeps its
distribution of lengths, however rare each is), all but LAST tokens, which are filled by bounded-knapsack dynamic
programming over subset sums. What is missing in the end is reported by shares(): no more than the shortest document left where
documents are longer than LAST, and as a rule nothing. Which documents of a length
are taken is decided by a seeded order; ranks come from ranges, so no source or length is gathered in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.ranking import with_rank
from lodeseam.tables import folded, strip

#: Tokens of a budget that are left to the dynamic programming; it can fill twice as many.
LAST = 65_536


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length (at most counts) reach the greatest sum not over budget. Sums are bits of one integer."""
    mask, sums, steps = (1 << (budget + 1)) - 1, 1, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, size = min(counts[i], budget // lengths[i]) if lengths[i] > 0 else 0, 1
        while left > 0:  # 1, 2, 4, ... copies at once
            take = min(size, left)
            steps.append((i, take, sums))
            sums |= (sums << (take * lengths[i])) & mask
            left, size = left - take, size * 2
        if sums >> budget & 1:
            break
    out, at = [0] * len(lengths), sums.bit_length() - 1
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            out[i] += take
            at -= take * lengths[i]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, repeats: int) -> tuple[int, list[int]]:
    """Whole copies of a source, and of each length how many documents come once more."""
    tokens = sum(n * c for n, c in zip(lengths, counts, strict=True))
    extra = [0] * len(lengths)
    if tokens <= 0 or budget <= 0 or repeats <= 0:
        return 0, extra
    whole = min(budget // tokens, repeats)
    rest = budget - whole * tokens
    if whole == repeats or rest == 0:
        return whole, extra
    even, carry = max(0, rest - LAST), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] > 0:
            want = counts[i] * lengths[i] * even + carry  # in parts of a token, of which `tokens` make one
            extra[i] = min(counts[i], want // (lengths[i] * tokens))
            carry = want - extra[i] * lengths[i] * tokens
    rest -= sum(n * x for n, x in zip(lengths, extra, strict=True))
    more = subset_sum(lengths, [c - x for c, x in zip(counts, extra, strict=True)], min(rest, 2 * LAST))
    return whole, [x + m for x, m in zip(extra, more, strict=True)]


def key(c: str) -> Column:
    """Sources are compared without letter case and surrounding blanks; nothing else is a source."""
    k = folded(strip(F.col(c)))
    return F.when(k != "", k)


def plan(docs: DataFrame, targets: DataFrame, size: float = 1.0) -> DataFrame:
    """One row per target: (source, weight, max_repeats, tokens, total, budget, short, copies, lengths, extra).

    docs(source, n_tokens), targets(source, weight, max_repeats). size: of the mix, as a multiple of the corpus.
    Documents without source count in the total only. short: the source cannot give its share even if repeated as
    often as it may be. Targets with a null weight or cap, or a weight not above 0, get no documents and are not short;
    a source without documents is short if its weight is above 0, and so is every such source of an empty corpus.
    """
    hist = docs.select(key("source").alias("key"), "n_tokens").groupBy("key", "n_tokens").agg(F.count("*").alias("n"))
    total = hist.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n")), F.lit(0)).alias("total"))
    per = hist.where("key is not null").groupBy("key").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.sort_array(F.collect_list(F.struct("n_tokens", "n"))).alias("hist"))
    rows = targets.select("source", "weight", "max_repeats", key("source").alias("key")).join(per, "key", "left").join(F.broadcast(total))  # one row

    def run(batches):
        for b in batches:
            made = []
            for r in b.itertuples(index=False):
                hist = [] if r.hist is None else [(int(x["n_tokens"]), int(x["n"])) for x in r.hist]
                tokens, known = sum(n * c for n, c in hist), pd.notna(r.weight) and pd.notna(r.max_repeats)
                share = float(r.max_repeats) * tokens / float(r.total) if known and r.total else 0.0
                budget = int(round(size * r.weight * r.total)) if known else 0
                lengths, counts = [x[0] for x in hist], [x[1] for x in hist]
                copies, extra = fit(lengths, counts, budget, int(r.max_repeats)) if known else (0, [0] * len(hist))
                made.append((r.source, r.weight, r.max_repeats, tokens, int(r.total), budget, bool(known and share < size * r.weight), copies, lengths, extra))
            yield pd.DataFrame(made, columns=["source", "weight", "max_repeats", "tokens", "total", "budget", "short", "copies", "lengths", "extra"])

    return rows.select("source", "weight", F.col("max_repeats").cast("double"), "total", "hist").mapInPandas(
        run, "source string, weight double, max_repeats double, tokens bigint, total bigint, budget bigint, short boolean, copies bigint, lengths array<bigint>, extra array<bigint>"
    )


def shares(planned: DataFrame) -> DataFrame:
    """(source, weight, mix_tokens, share): what each target reaches of the planned mix."""
    got = F.col("copies") * F.col("tokens") + F.aggregate(F.zip_with("lengths", "extra", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    own = planned.select("source", "weight", got.alias("mix_tokens"))
    whole = own.agg(F.sum("mix_tokens").alias("_all"))
    return own.join(F.broadcast(whole)).select("source", "weight", "mix_tokens", F.when(F.col("_all") > 0, F.col("mix_tokens") / F.col("_all")).otherwise(F.lit(0.0)).alias("share"))


def select(docs: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mix; documents that are not in it are left out. docs as for plan(), with doc_id."""
    cuts = planned.select(key("source").alias("_key"), F.col("copies"), F.explode(F.arrays_zip("lengths", "extra")).alias("x")).select("_key", "copies", F.col("x.lengths").alias("_n"), F.col("x.extra").alias("extra"))
    own = docs.select("doc_id", key("source").alias("source"), "n_tokens")
    own = own.join(cuts, (own.source == cuts._key) & (own.n_tokens == cuts._n)).drop("_key", "_n")
    order = F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.col("doc_id").alias("d"))
    some = with_rank(own.where("extra > 0").withColumn("_o", order), ["source", "n_tokens"], F.col("_o"), "_rank")
    chosen = some.select("doc_id", "source", "n_tokens", (F.col("copies") + (F.col("_rank") <= F.col("extra")).cast("bigint")).alias("copies"))
    return chosen.unionByName(own.where("extra = 0").select("doc_id", "source", "n_tokens", "copies")).where("copies > 0")
