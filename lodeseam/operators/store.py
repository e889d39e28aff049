"""Pages, chunks and links in a folder, changed by one commit per crawl or batch.

Each table is cut into buckets by a hash of the page's id, so a page, its chunks and its links lie in buckets of one
number. A commit writes the buckets it touches and then a manifest that names, for every bucket of every table, the
folder that holds it; readers follow the newest manifest. A failed commit is never seen, a table that is not given stays
as it is, and a manifest is put in place without replacing another, so of two commits at once one is refused. Folders
that only manifests older than the last KEEP name are removed. Buckets should hold about a gigabyte: their number is
set when a store is made.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam import session as S
from lodeseam.functions.embed import Embedder, embedder
from lodeseam.functions.text import chunk_id, chunks

PAGES = "id string, url string, title string, text string, domain string, depth int, parent_id string, root_id string, crawled_at timestamp_ntz, etag string, last_modified string"
CHUNKS = "id string, page_id string, seq int, text string, embedding array<float>"
LINKS = "root_id string, source_id string, target_url string, position int"
#: Schema of each table, and the column with the id of the page.
TABLES = {"pages": (PAGES, "id"), "chunks": (CHUNKS, "page_id"), "links": (LINKS, "source_id")}
BUCKETS, KEEP = 16, 2


def migrated(df: DataFrame, schema: str) -> DataFrame:
    """df in the columns of the schema: missing ones null, others left out."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those with the same id; of several new ones the latest crawled_at."""
    new = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in old.columns if c != "id"]), F.struct("crawled_at", "url")).alias("r")).select("id", "r.*").select(*old.columns)
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def touched(pages: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """pages with crawled_at = now where (root_id, url) is in urls. Other trees that hold the same address are not touched."""
    seen = urls.select(F.col("root_id").alias("_r"), F.col("url").alias("_u"), F.lit(True).alias("_t")).distinct()
    hit = pages.join(seen, (F.col("root_id") == F.col("_r")) & (F.col("url") == F.col("_u")), "left")
    return hit.select(*[F.when(F.col("_t"), now).otherwise(F.col(c)).alias(c) if c == "crawled_at" else F.col(c) for c in pages.columns])


def made(pages: DataFrame, size: int = 1200, overlap: int = 150, by: Embedder | None = None) -> DataFrame:
    """Chunks of pages(id, text), embedded."""
    by = by or embedder()
    new = pages.select("id", F.posexplode(chunks(F.col("text"), size, overlap)).alias("seq", "text"))
    return new.select(chunk_id(F.col("id"), F.col("seq")).alias("id"), F.col("id").alias("page_id"), "seq", "text", by.column(F.col("text")).alias("embedding"))


def replaced(old_chunks: DataFrame, pages: DataFrame, size: int = 1200, overlap: int = 150, by: Embedder | None = None) -> DataFrame:
    """Chunks with those of the given pages made anew and embedded; a page that has become empty loses its old ones."""
    new = made(pages, size, overlap, by)
    return old_chunks.join(pages.select(F.col("id").alias("page_id")).distinct(), "page_id", "left_anti").select(*new.columns).unionByName(new)


def stale(pages: DataFrame, keep: DataFrame) -> DataFrame:
    """Pages of the roots in keep(root_id, url) whose url is not kept there. Other roots are left alone."""
    ours = pages.join(keep.select("root_id").distinct(), "root_id", "left_semi")
    return ours.join(keep.select("root_id", "url").distinct(), ["root_id", "url"], "left_anti").select(*pages.columns)


def without(pages: DataFrame, chunks_: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and chunks after gone(id) is removed."""
    ids = gone.select("id").distinct()
    return pages.join(ids, "id", "left_anti").select(*pages.columns), chunks_.join(ids.select(F.col("id").alias("page_id")), "page_id", "left_anti").select(*chunks_.columns)


def validators(pages: DataFrame) -> DataFrame:
    """(root_id, url, etag, last_modified) of pages that have any; of several rows of an address the latest."""
    some = pages.where("etag is not null or last_modified is not null")
    return some.groupBy("root_id", "url").agg(F.max_by(F.struct("etag", "last_modified"), F.struct("crawled_at", "id")).alias("v")).select("root_id", "url", "v.*")


def known_links(pages: DataFrame) -> DataFrame:
    """(parent_url, children): the addresses found under each page, sorted."""
    parent = pages.select(F.col("id").alias("_p"), F.col("url").alias("parent_url"))
    return pages.join(parent, F.col("parent_id") == F.col("_p")).groupBy("parent_url").agg(F.array_sort(F.collect_set("url")).alias("children"))


class Store:
    """Versions of pages, chunks and links in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self._buckets = spark, folder.rstrip("/"), buckets

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        """The store in the folder, or one in a scratch folder where that cannot be used."""
        try:
            S.put_text(spark, f"{folder.rstrip('/')}/opened", "")
            return cls(spark, folder)
        except Exception:  # noqa: BLE001 - any refusal of the file system
            return cls(spark, S.scratch(spark, "store"))

    def versions(self) -> list[int]:
        return sorted(int(n) for n in S.names(self.spark, f"{self.folder}/commits") if n.isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"buckets": self._buckets, "tables": {}}
        return json.loads(S.get_text(self.spark, f"{self.folder}/commits/{version}"))

    def bucket(self, page: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(page), F.lit(buckets or self._manifest(self.version())["buckets"])).cast("int")

    def buckets_of(self, ids: DataFrame) -> list[int]:
        """Buckets of the pages ids(id); no more than there are buckets."""
        return sorted(r[0] for r in ids.select(self.bucket(F.col("id")).alias("b")).distinct().collect())

    def read(self, kind: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table of that kind, or its rows in the given buckets."""
        there = self._manifest(self.version() if version is None else version)["tables"].get(kind, {})
        paths = [f"{self.folder}/{kind}/{at}/_b={b}" for b, at in there.items() if buckets is None or int(b) in buckets]
        schema = TABLES[kind][0]
        return migrated(self.spark.read.parquet(*paths), schema) if paths else self.spark.createDataFrame([], schema)

    @property
    def pages(self) -> DataFrame:
        return self.read("pages")

    @property
    def chunks(self) -> DataFrame:
        return self.read("chunks")

    @property
    def links(self) -> DataFrame:
        return self.read("links")

    def commit(self, pages: DataFrame | None = None, chunks_: DataFrame | None = None, links: DataFrame | None = None, buckets: list[int] | None = None, base: int | None = None) -> int:
        """Writes the next version; refuses if another commit came first.

        Each table given replaces the touched buckets (all, if none are named) and holds rows of these only; one that is not given
        keeps all its rows. base: the version that was read, if not the present one.
        """
        base = self.version() if base is None else base
        manifest = self._manifest(base)
        tables = {k: dict(v) for k, v in manifest["tables"].items()}
        for kind, df in (("pages", pages), ("chunks", chunks_), ("links", links)):
            if df is None:
                continue
            at = f"{base + 1}-{uuid.uuid4().hex[:8]}"
            df.withColumn("_b", self.bucket(F.col(TABLES[kind][1]), manifest["buckets"])).repartition("_b").write.partitionBy("_b").parquet(f"{self.folder}/{kind}/{at}")
            written = {n.removeprefix("_b=") for n in S.names(self.spark, f"{self.folder}/{kind}/{at}") if n.startswith("_b=")}
            if buckets is not None and not written <= {*map(str, buckets)}:
                raise ValueError(f"{kind} has rows of buckets that are not named")
            kept = {} if buckets is None else {b: x for b, x in tables.get(kind, {}).items() if int(b) not in buckets}
            tables[kind] = kept | {b: at for b in written}
        if not S.put_new(self.spark, f"{self.folder}/commits/{base + 1}", json.dumps({"buckets": manifest["buckets"], "tables": tables})):
            raise RuntimeError("another commit came first")
        self._forget()
        return base + 1

    def _forget(self) -> None:
        """Removes what only manifests before the last KEEP name."""
        versions = self.versions()
        named = lambda vs: {(kind, at) for v in vs for kind, t in self._manifest(v)["tables"].items() for at in t.values()}
        for kind, at in named(versions[:-KEEP]) - named(versions[-KEEP:]):
            S.remove(self.spark, f"{self.folder}/{kind}/{at}")
        for v in versions[:-KEEP]:
            S.remove(self.spark, f"{self.folder}/commits/{v}")

    def counts(self) -> DataFrame:
        """(pages, chunks)."""
        return counts(self.pages, self.chunks)


def counts(pages: DataFrame, chunks_: DataFrame) -> DataFrame:
    one = [pages.agg(F.count("*").alias("n"), F.lit(0).alias("m")), chunks_.agg(F.lit(0).alias("n"), F.count("*").alias("m"))]
    return reduce(DataFrame.unionByName, one).agg(F.sum("n").alias("pages"), F.sum("m").alias("chunks"))
