"""Lines repeated over the documents of one source, found as templates of token trees.

A line is parsed into a token tree of fixed depth: below the source the first level is the number of tokens, the next
levels are the first DEPTH tokens with runs of digits as wildcard slots, and a leaf holds all wordings below it. Each task
builds its part of the trees (Spark's partial aggregation keyed by source and leaf); the shuffle merges the parts into
the cover of every leaf, its number of distinct documents. Leaves of too small a cover are pruned with all their
wordings. A leaf that is left is a template: the tokens that all its wordings share and a wildcard where they differ.

A repeated line is a single wording of enough documents. The cover of its leaf is at least as large, so the exact cover of
the wordings below the leaves that are left decides, and nothing is lost by pruning.

Every document brings each of its leaves and wordings once, as hashes; texts are shuffled for templates only, and there
only those below leaves that are left. These are few for a source (each covers at least min_share of its documents) and
are joined to its documents by source and, for sources of many documents, salt: a task gets about HOT documents of one
source, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.session import stored
from lodeseam.tables import folded

DEPTH = 3
#: Documents of a source that one task takes, as long as that makes no more than HOTTEST sources large.
HOT, HOTTEST = 10_000, 10_000
#: All blanks but the line feed.
_BLANK = r"[\p{Zs}\t\x0B\f\r\x1c-\x1f\x85\u2028\u2029]+"


def wordings(text: Column) -> Column:
    """Array of the lines' wordings: without letter case, blanks as one space, runs of digits as the wildcard 0."""
    plain = F.regexp_replace(F.regexp_replace(folded(text), "[0-9]+", "0"), _BLANK, " ")
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def _parsed(words: Column) -> Column:
    def one(w: Column) -> Column:
        tokens = F.split(w, " ", DEPTH + 1)
        leaf = F.xxhash64(F.length(w) - F.length(F.translate(w, " ", "")), F.slice(tokens, 1, DEPTH))
        return F.when(w != "", F.struct(leaf.alias("leaf"), F.xxhash64(w).alias("word")))

    return F.transform(words, one)


def parsed(text: Column) -> Column:
    """Array of (leaf, word) of the lines: hashes of the tree path and of the wording; null for blank lines."""
    return _parsed(wordings(text))


def _covering(docs: DataFrame, keys: Column, min_docs: int, min_share: float) -> DataFrame:
    """(source, key, docs): what stands in enough documents of its source, with their number. keys: array, those of a document."""
    each = docs.select("source", F.explode(F.array_distinct(keys)).alias("key")).where("key is not null")
    tree = each.groupBy("source", "key").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    sizes = docs.groupBy("source").agg(F.count("*").alias("_all"))
    return tree.join(sizes, "source").where(F.col("docs") / F.col("_all") >= min_share).drop("_all")


def leaves(docs: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(source, key, docs): the leaves that are left and their cover, over all wordings below them. docs(source, lines), no null lines."""
    return _covering(docs, F.col("lines.leaf"), min_docs, min_share)


def repeated(docs: DataFrame, min_docs: int = 5, min_share: float = 0.2, hot: DataFrame | None = None) -> DataFrame:
    """(source, frequent): for each source with any, the array of (leaf, word) of its repeated wordings.

    docs(id, source, lines): lines as of parsed(), null where a document has no text; such documents do not count.
    """
    docs = docs.where("lines is not null").select("id", "source", "lines")
    hot = large(docs) if hot is None else hot
    left = leaves(docs, min_docs, min_share).groupBy("source").agg(F.collect_list("key").alias("left"))
    below = F.filter("lines", lambda l: F.array_contains("left", l["leaf"]))  # no line where there is no leaf
    tree = _covering(marked(docs, left, hot), below, min_docs, min_share)
    return tree.groupBy("source").agg(F.sort_array(F.collect_list("key")).alias("frequent"))


def large(docs: DataFrame) -> DataFrame:
    """(source, salts): the sources that need several tasks, HOTTEST at most, and how many."""
    least = max(HOT, docs.count() // HOTTEST)
    return stored(docs.groupBy("source").agg(F.ceil(F.count("*") / least).cast("int").alias("salts")).where("salts > 1"), "large")


def marked(docs: DataFrame, of_source: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """docs with what of_source has of their source (null where it has nothing), joined by source and salt. docs(id, source, ...), of_source(source, ...)."""
    hot = F.broadcast((large(docs) if hot is None else hot).select(F.col("source").alias("_large"), "salts"))  # HOTTEST rows at most
    salted = lambda df, salt: df.join(hot, F.col("source") == F.col("_large"), "left").withColumn("_salt", salt).drop("_large", "salts")
    salts = F.coalesce(F.col("salts"), F.when(F.col("source").isNull(), 64), F.lit(1))  # rows without source meet nothing, yet must not be one task
    own = salted(docs, F.pmod(F.xxhash64("id"), salts.cast("bigint")).cast("int"))
    spread = salted(of_source, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    return own.join(spread, ["source", "_salt"], "left").drop("_salt")


def repeated_lines(docs: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(id, line_no) of every repeated line. docs(id, source, lines), ids unique; a null source has no repeated lines."""
    docs = stored(docs.where("source is not null").select("id", "source", "lines"), "lines").where("lines is not null")  # asked of what is stored, else lines are parsed twice
    hot = large(docs)
    hit = marked(docs, repeated(docs, min_docs, min_share, hot), hot).where("frequent is not null")
    return hit.select("id", F.posexplode("lines").alias("line_no", "l"), "frequent").where(F.array_contains("frequent", F.col("l"))).select("id", "line_no")


def without_repeats(docs: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(id, text): texts without their source's repeated lines. docs(id, source, text, lines); null texts stay null."""
    docs = stored(docs, "lines")
    hot = large(docs)
    hit = marked(docs, repeated(docs.where("source is not null"), min_docs, min_share, hot), hot)
    kept = F.filter(F.split("text", "\n"), lambda t, i: ~F.coalesce(F.array_contains("frequent", F.element_at("lines", i + 1)), F.lit(False)))
    return hit.select("id", F.when(F.col("frequent").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def templates(docs: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(source, template, wordings, docs): the leaves that are left, <*> where their wordings differ. docs(id, source, text).

    wordings are the different ones below the leaf, docs the documents with any of them. Slots are merged token by token,
    so a leaf of many wordings is gathered nowhere.
    """
    texts = docs.where("source is not null and text is not null").select("id", "source", wordings(F.col("text")).alias("w"))
    texts = stored(texts.select("*", _parsed(F.col("w")).alias("lines")), "lines")
    kept = stored(leaves(texts, min_docs, min_share).withColumnRenamed("key", "leaf"), "leaves")
    left = kept.groupBy("source").agg(F.collect_list("leaf").alias("left"))
    lines = F.transform(F.arrays_zip("lines", "w"), lambda x: F.struct(x["lines"]["leaf"].alias("leaf"), x["w"].alias("w")))
    below = F.filter(lines, lambda x: F.array_contains("left", x["leaf"]))
    words = marked(texts, left).select("source", F.inline(F.array_distinct(below))).distinct()
    tokens = words.select("source", "leaf", F.posexplode(F.split("w", " ")).alias("at", "t"))
    slots = tokens.groupBy("source", "leaf", "at").agg(F.when(F.min("t") == F.max("t"), F.min("t")).otherwise("<*>").alias("slot"), F.count("*").alias("n"))
    merged = slots.groupBy("source", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "slot"))).alias("slots"), F.max("n").alias("wordings"))
    return merged.join(kept, ["source", "leaf"]).select("source", F.array_join(F.col("slots.slot"), " ").alias("template"), "wordings", "docs")
