"""New and changed records of a delivery log, run by run, with exactly-once results.

Rows arrive with the number of the run that delivered them, yet not in the order of runs: a row may come after its run
was reported, and a run may be found finished after a later one. So the position of a row is the order of its arrival,
not its run. What arrives is appended to a log of fingerprints in segments, one per batch; the offset of a log partition
(a hash of the record id) is the number of its rows that were taken in. A batch is

1. planned: its segment is written to ``log/``, then the offsets from and to of every partition and the runs to report
   go to ``plans/``; a try that ends before has no plan and is made again;
2. executed from that plan alone, however the source has changed since: the segment, rows that still waited for their
   run (``pending/``) and the state of the same records give the changes of each reported run (``sink/``) and the new
   state of the records met (``state/``, brought together every few batches), each written over what a failed try left;
3. committed: an empty marker in ``commits/``. A plan without its marker is executed again, unchanged.

A row counts from the first run that is reported in its batch or later and is not before its own. A row that comes late
is reported once, with the next run to be reported; a run that is found finished late is reported with the rows that
arrived since. Readers of the sink see committed batches only and keep one row per record and run.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseam import session as S
from lodeseam.tables import strip

#: English month abbreviations of HTTP dates (fixed values).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def etag_key(c: Column) -> Column:
    """An entity tag without weak mark, quotes and blanks; null if nothing is left."""
    bare = strip(F.regexp_replace(strip(c), r"^[Ww]/", ""))
    bare = strip(F.regexp_replace(bare, r'^"+|"+$', ""))
    return F.when(bare != "", bare)


def instant(c: Column) -> Column:
    """Seconds since 1970 of an HTTP date (RFC 1123, RFC 850, asctime) or ISO 8601 time; null if it is neither."""
    t = strip(c)
    at = lambda rx, g: F.regexp_extract(t, rx, g)
    clock = r"(\d{1,2}:\d{2}:\d{2})"
    http, ctime = rf"(?i)^[a-z]+,?\s+(\d{{1,2}})[ -]([a-z]{{3}})[a-z]*[ -](\d{{2}}|\d{{4}})\s+{clock}\s*(?:gmt|utc|z)?$", rf"(?i)^[a-z]+\s+([a-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{clock}\s+(\d{{4}})$"
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(m)).cast("string")
    year = F.when(F.length(at(http, 3)) == 4, at(http, 3)).when(at(http, 3) < "70", F.concat(F.lit("20"), at(http, 3))).otherwise(F.concat(F.lit("19"), at(http, 3)))
    text = (
        F.when(t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d"), F.when(t.rlike(r"([Zz]|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z"))))
        .when(t.rlike(http), F.concat(year, F.lit("-"), F.lpad(month(at(http, 2)), 2, "0"), F.lit("-"), F.lpad(at(http, 1), 2, "0"), F.lit("T"), F.lpad(at(http, 4), 8, "0"), F.lit("Z")))
        .when(t.rlike(ctime), F.concat(at(ctime, 4), F.lit("-"), F.lpad(month(at(ctime, 1)), 2, "0"), F.lit("-"), F.lpad(at(ctime, 2), 2, "0"), F.lit("T"), F.lpad(at(ctime, 3), 8, "0"), F.lit("Z")))
    )
    return F.unix_micros(F.try_to_timestamp(F.upper(text)))


def versioned(pages: DataFrame) -> DataFrame:
    """(id, run_no, row): row = (crawled_at, run_no, etag, modified, content), what decides whether two rows are the same version."""
    return pages.where("id is not null and run_no is not null").select(
        "id",
        "run_no",
        F.struct("crawled_at", "run_no", etag_key(F.col("etag")).alias("etag"), instant(F.col("last_modified")).alias("modified"), F.sha2("text", 256).alias("content")).alias("row"),
    )


def same_version(a: Column, b: Column) -> Column:
    """By etag; where either has none by the instant of modification; where either lacks that too by the text (null equals null)."""
    return (
        F.when(a["etag"].isNotNull() & b["etag"].isNotNull(), a["etag"] == b["etag"])
        .when(a["modified"].isNotNull() & b["modified"].isNotNull(), a["modified"] == b["modified"])
        .otherwise(a["content"].eqNullSafe(b["content"]))
    )


def changes(rows: DataFrame, state: DataFrame | None, done: list[int]) -> tuple[DataFrame, DataFrame]:
    """Changes (run_no, id) of the done runs and the state (id, row) after the last of them.

    rows(id, run_no, row) as of versioned(); state: the same without run_no, before the first of these runs.
    Rows count from the first done run that is not before their own. Repeats collapse before the shuffle.
    """
    runs = F.array(*[F.lit(r).cast("int") for r in sorted(done)])
    until = F.array_min(F.filter(runs, lambda r: r >= F.col("run_no")))
    rows = rows.withColumn("run", until).where("run is not null").select("id", "run", "row")
    if state is not None:
        rows = rows.unionByName(state.select("id", F.lit(None).cast("int").alias("run"), "row"))
    best = rows.groupBy("id", "run").agg(F.max("row").alias("row"))  # a group holds as many rows as there are runs at most
    w = W.partitionBy("id").orderBy(F.col("run").asc_nulls_first())
    seen = best.select("id", "run", F.max("row").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("now"), F.max("row").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("was"))
    new = seen.where("run is not null").where(F.col("was").isNull() | ~same_version(F.col("now"), F.col("was"))).select(F.col("run").alias("run_no"), "id")
    return new, rows.groupBy("id").agg(F.max("row").alias("row"))


def fingerprint() -> Column:
    """Of a row of versioned(): the same for rows that are the same in all that matters here."""
    parts = [F.col("id"), F.col("run_no"), *[F.col("row")[c] for c in ("crawled_at", "etag", "modified", "content")]]
    return F.unhex(F.md5(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts]).cast("binary")))


def partition(n: int) -> Column:
    """Log partition of a record."""
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


class ChangeCapture:
    """Reports, in a folder that survives failures, the records that each finished run added or changed.

    source, wherever it is asked for, is a folder or file of parquet (only files that no earlier batch took in are read),
    or a table: of pages, or of rows as versioned() gives them (every row is held against the log by its fingerprint).
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = 16, compact: int = 8):
        self.spark, self.folder, self.partitions, self.compact = spark, folder.rstrip("/"), partitions, compact

    def _ids(self, kind: str) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in S.names(self.spark, f"{self.folder}/{kind}") if n.split(".")[0].isdigit() and not n.endswith(".part"))

    def _plan(self, k: int) -> dict:
        return json.loads(S.get_text(self.spark, f"{self.folder}/plans/{k}.json"))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        paths = [p for k in numbers if S.exists(self.spark, p := f"{self.folder}/{kind}/{k}")]
        return self.spark.read.parquet(*paths) if paths else None

    def offsets(self) -> dict[str, int]:
        """How many rows of each log partition committed batches took in."""
        done = self._ids("commits")
        return self._plan(done[-1])["to"] if done else {str(p): 0 for p in range(self.partitions)}

    def _new_files(self, path: str) -> tuple[list[str], DataFrame]:
        """Files that no committed batch read; the same as a table. Spark lists them; a file written over counts as new."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
        taken = self._read("files", self._ids("commits"))
        new = S.stored(found if taken is None else found.join(taken, found.columns, "left_anti"), "files")
        return [r[0] for r in new.select("path").orderBy("path").collect()], new

    def _arrived(self, source: DataFrame | str, k: int) -> DataFrame | None:
        """The segment of batch k: rows that no committed batch took in, each once."""
        if isinstance(source, str):
            names, files = self._new_files(source)
            if not names:
                return None
            files.write.mode("overwrite").parquet(f"{self.folder}/files/{k}")
            reader = self.spark.read.option("basePath", source) if S.folder(self.spark, source) else self.spark.read
            return versioned(reader.parquet(*names)).withColumn("print", fingerprint()).dropDuplicates(["print"])
        rows = source if {"id", "run_no", "row"} <= {*source.columns} and "etag" not in source.columns else versioned(source)
        rows = rows.select("id", "run_no", "row").withColumn("print", fingerprint()).dropDuplicates(["print"])
        log = self._read("log", self._ids("commits"))
        return rows if log is None else rows.join(log.select("print"), "print", "left_anti")

    def plan(self, source: DataFrame | str, runs: DataFrame) -> dict | None:
        """The batch to execute: one that a failure left open, else a new one if a finished run is not reported yet; else None."""
        commits = self._ids("commits")
        if open_ := set(self._ids("plans")) - set(commits):
            return self._plan(min(open_))
        last = self._plan(commits[-1]) if commits else {"batch": 0, "reported": [], "base": 0, "whole": False}
        finished = [r[0] for r in runs.where(F.lower("state") == "done").select("run_no").where("run_no is not null").distinct().collect()]  # one row per run
        todo = sorted(set(finished) - set(last["reported"]))
        if not todo:
            return None
        k, start = last["batch"] + 1, self.offsets()
        segment, counts = self._arrived(source, k), {}
        if segment is not None:
            segment.write.mode("overwrite").parquet(f"{self.folder}/log/{k}")
            counts = {str(r["p"]): r["n"] for r in self._read("log", [k]).groupBy(partition(self.partitions).alias("p")).agg(F.count("*").alias("n")).collect()}
        else:
            S.remove(self.spark, f"{self.folder}/log/{k}")  # of a try that ended before its plan
        base = last["batch"] if last["whole"] and S.exists(self.spark, f"{self.folder}/state/{last['batch']}") else last["base"]  # the batch from which states are read
        reported, end = sorted({*last["reported"], *todo}), {p: n + counts.get(p, 0) for p, n in start.items()}
        batch = {"batch": k, "runs": todo, "reported": reported, "from": start, "to": end, "base": base, "whole": k - base >= self.compact}
        S.put_text(self.spark, f"{self.folder}/plans/{k}.json", json.dumps(batch))
        return batch

    def execute(self, batch: dict) -> None:
        """Writes what the plan says, over what a failed try left. Reads the folder only, so every try does the same."""
        k, f = batch["batch"], self.folder
        parts = [x for x in (self._read("log", [k]), self._read("pending", [k - 1])) if x is not None]
        if not parts:  # runs without rows
            return
        rows = reduce(DataFrame.unionByName, [x.select("id", "run_no", "row") for x in parts])
        known = self._read("state", list(range(batch["base"], k)))
        ready = F.col("run_no") <= max(batch["runs"])
        rows.where(~ready).write.mode("overwrite").parquet(f"{f}/pending/{k}")
        own = rows.where(ready)
        state = None if known is None else known.join(own.select("id").distinct(), "id", "left_semi")
        new, after = changes(own, state, batch["runs"])
        new.write.mode("overwrite").parquet(f"{f}/sink/{k}")
        if batch["whole"] and known is not None:
            after = known.unionByName(after).groupBy("id").agg(F.max("row").alias("row"))
        after.write.mode("overwrite").parquet(f"{f}/state/{k}")

    def commit(self, batch: dict) -> None:
        S.put_text(self.spark, f"{self.folder}/commits/{batch['batch']}", "")

    def run(self, source: DataFrame | str, runs: DataFrame) -> int:
        """Executes what is open and what is new; the number of batches."""
        n = 0
        while batch := self.plan(source, runs):
            self.execute(batch)
            self.commit(batch)
            n += 1
        return n

    def sink(self) -> DataFrame:
        """(run_no, id) of all committed batches, each pair once."""
        paths = [p for k in self._ids("commits") if S.exists(self.spark, p := f"{self.folder}/sink/{k}")]
        if not paths:
            return self.spark.createDataFrame([], "run_no int, id string")
        return self.spark.read.schema("run_no int, id string").parquet(*paths).dropDuplicates(["run_no", "id"])
