"""Time between requests to a host: waiting, and the schedule of a whole request log."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam.session import scratch


class Throttle:
    """Waits until the host of a URL may be asked again; the first request is free. Returns the seconds waited."""

    def __init__(self, delay: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep = delay, clock, sleep
        self.free: dict[str, float] = {}

    def __call__(self, url: str) -> float:
        if self.delay <= 0:
            return 0.0
        host, now = urlsplit(url).netloc.lower(), self.clock()
        waited = max(0.0, self.free.get(host, now) - now)
        if waited:
            self.sleep(waited)
        self.free[host] = now + waited + self.delay
        return waited


def schedule(requests: DataFrame, group: str, at: Column, tie: str, delay: float) -> DataFrame:
    """requests with start (seconds): the earliest time a request can begin, delay after the one before of its group.

    The i-th request starts at i x delay + max over j <= i of (arrival j - j x delay): a running count and a running
    maximum. Both are made per range of (group, arrival) and completed by the ranges before, so that no group has to
    fit one task. Rows of null group or arrival have a null start.
    """
    spark, path = requests.sparkSession, scratch(requests.sparkSession, "requests")
    timed = requests.withColumn("_at", F.unix_micros(at.cast("timestamp")) / 1e6)
    fine = F.col(group).isNotNull() & F.col("_at").isNotNull()
    timed.where(fine).repartitionByRange(group, "_at", tie).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.parquet(path)
    local = W.partitionBy("_part", group).orderBy("_at", tie)
    step = laid.withColumn("_i", F.row_number().over(local) - 1).withColumn("_slack", F.col("_at") - F.col("_i") * delay)
    step = step.withColumn("_run", F.max("_slack").over(local.rowsBetween(W.unboundedPreceding, 0)))
    ends = step.groupBy("_part", group).agg(F.count("*").alias("_n"), F.max("_slack").alias("_top"))
    order = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    ends = ends.withColumn("_most", F.max(F.col("_top") - F.col("_before") * delay).over(order)).select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_before", "_most")
    both = step.join(ends, (F.col("_part") == F.col("_p")) & (F.col(group) == F.col("_g")))
    start = (F.col("_i") + F.col("_before")) * delay + F.greatest(F.col("_run") - F.col("_before") * delay, F.coalesce("_most", F.lit(float("-inf"))))
    return both.select(*requests.columns, start.alias("start")).unionByName(timed.where(~fine).select(*requests.columns, F.lit(None).cast("double").alias("start")))
