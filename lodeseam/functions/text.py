"""Text functions as column expressions: tokens, chunks, ids, hashed embeddings, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.tables import strip


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def page_id(root: Column, url: Column) -> Column:
    """The first 32 hex digits of sha256(root, line feed, url)."""
    return F.substring(F.sha2(F.concat(root, F.lit("\n"), url), 256), 1, 32)


def chunk_id(page: Column, seq: Column) -> Column:
    """Ids of chunks are made from their place, so that indexing again gives the same."""
    return F.substring(F.sha2(F.concat(page, F.lit("\n"), seq.cast("string")), 256), 1, 32)


def bucket(token: Column, dimensions: int) -> Column:
    """Cell of a token in a hashed embedding: the first four bytes of its sha1, modulo the dimensions."""
    return (F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")


def sign(token: Column) -> Column:
    """1 if the fifth byte of the token's sha1 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha1(token), 10, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def normalized(vector: Column) -> Column:
    """The vector at unit length; all-zero vectors stay as they are."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def chunks(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Array of chunks: paragraphs are gathered up to size; an overfull chunk hands its last characters to the next.

    Paragraphs over size become overlapping windows of their own. Null texts give null, blank ones an empty array.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be under the size")
    paragraphs = F.filter(F.transform(F.split(text, "\n"), lambda p: strip(p)), lambda p: p != "")

    def flushed(acc: Column) -> Column:
        whole = strip(acc["buffer"])
        return F.when(whole != "", F.concat(acc["out"], F.array(whole))).otherwise(acc["out"])

    def windows(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size - overlap)), lambda i: strip(F.substring(p, i + 1, F.lit(size))))

    def add(acc: Column, p: Column) -> Column:
        buffer = acc["buffer"]
        tail = F.when((F.lit(overlap) > 0) & (F.length(buffer) > overlap), F.substring(buffer, F.length(buffer) - overlap + 1, F.lit(overlap))).otherwise("")
        long, full = F.length(p) > size, F.length(buffer) + F.length(p) + 1 > size
        carried = F.when(tail != "", strip(F.concat(tail, F.lit(" "), p))).otherwise(p)
        return F.struct(
            F.when(long, F.lit("")).when(full, carried).otherwise(strip(F.concat(buffer, F.lit("\n"), p))).alias("buffer"),
            F.when(long, F.concat(flushed(acc), windows(p))).when(full, flushed(acc)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(paragraphs, start, add, flushed)


def escaped(text: Column) -> Column:
    """HTML-escaped text."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
