"""Deliveries of pages and crawl logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseam.config import Settings
from lodeseam.functions.embed import embedder
from lodeseam.operators import store as ST
from lodeseam.session import stored


def ingest(pages: DataFrame, store: ST.Store, checkpoint: str, on_batch: Callable[[int, int], None] | None = None, settings: Settings = Settings()) -> StreamingQuery:
    """Upserts a stream of page rows into the store, chunks included, one commit per micro-batch; ends when all is read.

    A batch that is delivered again after a failure changes nothing: a row must be newer than the stored one of its id to
    replace it, and chunk ids are made from their place. Late rows do not win. Links of pages that are not replaced stay.
    A replaced page loses its links, as a row does not say them, and with them its validators: else the next crawl would
    be told that it is unchanged and could not go on to what it links to. Only the buckets of the batch's ids are written.
    """
    by = embedder(settings.embedder, settings.embedding_dimensions)

    def take(batch: DataFrame, number: int) -> None:
        rows = ST.migrated(batch, ST.PAGES).where("id is not null")
        batch.persist()
        try:
            base, hit = store.version(), store.buckets_of(rows.select("id"))
            if hit:
                old, parts, links = (store.read(kind, hit, base) for kind in ("pages", "chunks", "links"))
                both = old.withColumn("_old", F.lit(1)).unionByName(rows.withColumn("_old", F.lit(0)))
                best = both.groupBy("id").agg(F.max_by(F.struct(*[c for c in both.columns if c != "id"]), F.struct("crawled_at", "_old", "url")).alias("r")).select("id", "r.*")
                best = stored(best, "best")
                changed = best.where("_old = 0").select(*[F.lit(None).cast("string").alias(c) if c in ("etag", "last_modified") else F.col(c) for c in old.columns])
                ids = changed.select(F.col("id").alias("_id"))
                after = best.where("_old = 1").select(*old.columns).unionByName(changed)
                edges = links.join(ids, F.col("source_id") == F.col("_id"), "left_anti").select(*links.columns)
                store.commit(after, ST.replaced(parts, changed, settings.chunk_size, settings.chunk_overlap, by), edges, hit, base)
            if on_batch:
                on_batch(number, batch.count())
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(log: DataFrame, late: str = "30 days") -> DataFrame:
    """Counts of a stream of log rows by hour and status; repeated log_id count once, rows later than the watermark are dropped."""
    timed = log.withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["log_id"])
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "status").agg(F.count("*").alias("urls"))


def run_now(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """The state of an aggregation after all that is there was read, as a table in memory (for progress reports)."""
    spark: SparkSession = counts.sparkSession
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
