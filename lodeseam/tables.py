"""Tables of a data folder, and the current rows of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that str.strip() of Python removes (fixed values of Unicode).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column) -> Column:
    """Python's str.strip() without a Python worker."""
    return F.trim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Letter case removed as by full case folding: upper first, so that 'ß' and 'SS' or 'ς' and 'Σ' agree."""
    return F.lower(F.upper(c))


def current_rows(pages: DataFrame, **values: Column) -> DataFrame:
    """One row per page id with the values of its row of the greatest crawled_at.

    Rows of null id are no pages. A null crawled_at is older than any other. Equal times: the greater run_no, then the
    greater values, so the result never depends on the order of rows. ``values`` are computed before the shuffle, so only what a query needs travels.
    """
    picked = pages.where("id is not null").select(
        "id", F.struct("crawled_at", "run_no").alias("_at"), F.struct(*[c.alias(k) for k, c in values.items()]).alias("_v")
    )
    return picked.groupBy("id").agg(F.max_by("_v", F.struct("_at", "_v")).alias("_v")).select("id", "_v.*")
