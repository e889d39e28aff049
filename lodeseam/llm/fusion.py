"""One ranking from scores of different scale, by reciprocal rank fusion.

Per query and method the candidates are ranked from good to bad; a candidate's total is the sum of 1 / (K + rank) over
the methods that scored it. Only order enters, so no scale, spread or direction counts more than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.ranking import first_k, with_rank
from lodeseam.tables import folded, strip

#: The usual constant of the method.
K = 60


def scores(results: DataFrame, methods: DataFrame) -> DataFrame:
    """(query_id, chunk_id, method, value): one value for each, the smaller the better.

    Null and NaN scores are none. Repeats of a candidate count once, with the best of its scores. Methods are compared
    without letter case and blanks; those that methods(method, better) does not name take no part.
    """
    side = methods.select(folded(strip(F.col("method"))).alias("method"), F.when(folded(strip(F.col("better"))) == "low", 1.0).otherwise(-1.0).alias("_sign")).dropDuplicates(["method"])
    found = results.where("score is not null and not isnan(score) and query_id is not null and chunk_id is not null").select("query_id", "chunk_id", folded(strip(F.col("method"))).alias("method"), "score")
    return found.join(side, "method").groupBy("query_id", "chunk_id", "method").agg(F.min(F.col("score") * F.col("_sign")).alias("value"))


def fused(scored: DataFrame, k: int = K) -> DataFrame:
    """(query_id, chunk_id, total, n_methods), ties of a method sharing the better rank."""
    ranked = with_rank(scored, ["query_id", "method"], F.col("value"))
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("total"), F.count("*").alias("n_methods"))


def best(fused_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, total, place): the first top_k of each query, equal totals in order of chunk_id.

    Queries without top_k, or with none above 0, have no rows. The largest top_k is one number.
    """
    most = queries.agg(F.max("top_k")).first()[0] or 0
    asked = queries.where("query_id is not null").groupBy("query_id").agg(F.max("top_k").alias("top_k"))
    return first_k(fused_rows.join(asked, "query_id"), ["query_id"], [F.desc("total"), F.asc("chunk_id")], "top_k", most).select("query_id", "chunk_id", "total", "place")
