"""Ranks within groups of any size.

A window ordered by score puts each group into one task. Here distinct values are counted first (ties and repeats
collapse before the shuffle), laid out by range over all tasks, and ranked by local running sums plus the sum of the
ranges before. A group of a third of all rows is spread over as many tasks as its distinct values need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.session import scratch


def value_ranks(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """(groups, value, n, above): each distinct value of each group, how often it occurs and how many rows have a smaller one.

    Null values and null groups are values like others (null sorts first). An empty table gives an empty result.
    The competition rank of a row, smallest value first, is above + 1.
    """
    spark = df.sparkSession
    counts = df.select(*groups, value.alias("value")).groupBy(*groups, "value").agg(F.count("*").alias("n"))
    path = scratch(spark, "ranges")
    # written once: a range partitioning that were computed again after a loss could cut elsewhere
    counts.repartitionByRange(*groups, "value").withColumn("part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.parquet(path)
    sums = laid.groupBy("part", *groups).agg(F.sum("n").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.coalesce(F.sum("n").over(W.partitionBy("part", *groups).orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own, other = laid.withColumn("_local", local).alias("l"), before.alias("b")
    same = F.col("l.part") == F.col("b.part")
    for g in groups:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"b.{g}"))
    return own.join(other, same).select(*[F.col(f"l.{g}") for g in groups], "value", "n", (F.col("_local") + F.col("_before")).alias("above"))


def with_rank(df: DataFrame, groups: list[str], value: Column, name: str = "rank") -> DataFrame:
    """df with the competition rank of each row within its group, smallest value first; ties share the smaller rank."""
    ranks = value_ranks(df, groups, value).select(*[F.col(g).alias(f"_r_{g}") for g in groups], F.col("value").alias("_r_value"), F.col("above").alias("_above"))
    same = value.eqNullSafe(F.col("_r_value"))
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    return df.join(ranks, same).select(*df.columns, (F.col("_above") + 1).alias(name))


def first_k(df: DataFrame, groups: list[str], order: list[Column], k: str, most: int) -> DataFrame:
    """The first df[k] rows of each group. most bounds k; with it Spark cuts each task's rows before the shuffle."""
    row = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("place", row).where(F.col("place") <= most).where(F.col("place") <= F.col(k))
