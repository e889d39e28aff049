"""Main content of pages, by removal of the template of their site.

A page is read as a tree: the page, its zones, and in them lines and lists under a heading. Every line subtree is hashed
without letter case, with blanks collapsed and with runs of digits and dates as wildcards, and counted per host over all
pages; so are the page titles. Subtrees that recur over a large part of a host's pages are its template and go, together
with what they hold:

- before the title: everything (menus, breadcrumbs, consent notices);
- from the title on, as long as lines recur: bylines and dates; a heading whose next lines come again, in this order,
  as headings further down, with those lines (table of contents). A recurring sentence here that a part of the pages
  lacks is a note on validity, which belongs to the text;
- from the end upwards, as long as lines recur: footers, prompts, technical notes;
- between: lines of at least half of the pages, and a recurring heading with the run of titles under it up to the next
  recurring line (related pages).

Wordings that are themselves titles of pages of the host are headings, however often they recur.

Only hashes are counted: each page brings each of its lines once, summed in each task first. The recurring subtrees of a host
are few (each stands in at least FLOOR of its pages) and are joined to its pages by host and, for hosts of many pages, salt.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.llm.repeats import marked, wordings
from lodeseam.session import stored

#: Least share of a host's pages for a subtree to recur, for one to go from amid the text, and for a sentence after the title not to be a note.
FLOOR, BODY, NOTE = 0.3, 0.5, 0.8
#: A recurring wording is a title if there is at least one page so titled for so many pages with the line.
TITLED = 20
LEAST_PAGES = 3
_BLANKS = re.compile(r"\s+")
_MARK = re.compile(r"^(?:[-*•–·▪◦‣]|\(?[0-9]{1,3}[.)])\s+")
_STOP = re.compile(r"[.!。！…؟।]['\"”’»)\]」』）]*$")
_END = re.compile(r"[.!?。！？…؟।;]['\"’”»)\]」』）]*$")
_CRUMB = re.compile(r"\s*[/>›»|→]\s*")


def subtrees(text: Column) -> Column:
    """Array of hashes of the lines: digits and dates are wildcards."""

    def one(w: Column) -> Column:
        dated = F.regexp_replace(F.regexp_replace(w, r"\b0 \p{L}+\.? 0\b", "0 m 0"), r"\b\p{L}+ 0, 0\b", "m 0, 0")
        return F.xxhash64(dated)

    return F.transform(wordings(text), one)


def template(pages: DataFrame) -> DataFrame:
    """(source, shares): for each host the map from subtree hash to the share of its pages, for all that recur and are no titles.

    pages(source, lines, heading): lines as of subtrees(), heading the same of the title.
    """
    body = pages.select("source", F.explode(F.array_distinct("lines")).alias("h"), F.lit(0).alias("t"))
    heads = pages.where("heading is not null").select("source", F.explode("heading").alias("h"), F.lit(1).alias("t"))
    counts = body.unionByName(heads).groupBy("source", "h").agg(F.sum(1 - F.col("t")).alias("n"), F.sum("t").alias("titles")).where(F.col("n") >= LEAST_PAGES)
    sizes = pages.groupBy("source").agg(F.count("*").alias("pages"))
    recurring = counts.join(sizes, "source").withColumn("share", F.col("n") / F.col("pages")).where((F.col("share") >= FLOOR) & (F.col("titles") * TITLED < F.col("n")))
    return recurring.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("h", "share"))).alias("shares"))


def _flat(line: str) -> str:
    return _BLANKS.sub(" ", line).strip().casefold()


def _bare(line: str) -> str:
    return _MARK.sub("", line)


def _contents(bare: list[str], at: int, places: dict[str, list[int]]) -> int:
    """How many lines from at on are the entries of a table of contents: they come again, in this order, after all of them.

    An entry may differ from its heading. It counts if entries that come again stand on both sides, or if it is the last and
    the first heading follows it at once; it must not be a sentence.
    """
    chain: list[int] = []  # where each entry comes again, the first place possible

    def again(line: int, after: int) -> int:
        there = places[bare[line]]
        k = bisect_right(there, after)
        return there[k] if k < len(there) else -1

    def matched(last: int, entries: list[int]) -> bool:
        chain.clear()
        for i in entries:
            if (k := again(i, chain[-1] if chain else last)) < 0:
                return False
            chain.append(k)
        return True

    entries: list[int] = []
    m = 0
    while at + m < len(bare):
        line = at + m
        if chain and chain[0] <= line:  # the first entry stands among the entries again
            if not matched(line, [*entries, line]):
                matched(line - 1, entries)
                break
            entries.append(line)
        elif (k := again(line, chain[-1] if chain else line)) >= 0:
            chain.append(k)
            entries.append(line)
        elif m and line + 1 < len(bare) and not _STOP.search(bare[line]) and again(line + 1, max(chain[-1], line + 1)) >= 0 and chain[0] > line + 1:
            pass  # an entry that differs, before one that does not
        else:
            break
        m += 1
    if m and at + m + 1 < len(bare) and not _END.search(bare[at + m]) and chain and chain[0] == at + m + 1:
        m += 1
    return m


def template_lines(lines: list[str], shares: list[float], title: str | None) -> list[bool]:
    """Which lines belong to the template. shares: of the host's pages that have the line, 0 if it does not recur."""
    n = len(lines)
    flat = [_flat(x) for x in lines]
    bare = [_bare(x) for x in flat]
    places: dict[str, list[int]] = {}
    for i, x in enumerate(bare):
        places.setdefault(x, []).append(i)
    out = [False] * n
    head = _flat(title) if title and title.strip() else None
    start = flat.index(head) if head in flat else None
    if start is None:  # no title, or one that is not in the text: the breadcrumb names it
        last_at = {x: i for i, x in enumerate(flat)}
        for i in range(n):
            last = _CRUMB.split(flat[i])[-1] if _CRUMB.search(flat[i]) else None
            if last and last_at.get(last, -1) > i:
                start = flat.index(last, i + 1)
                break
    if start is None:
        start = -1
    for i in range(start):
        out[i] = True
    i = start + 1
    while i < n and shares[i] >= FLOOR:
        m = _contents(bare, i + 1, places)
        if m:
            out[i : i + m + 1] = [True] * (m + 1)
        elif start < 0 or not _STOP.search(flat[i]) or shares[i] >= NOTE:
            out[i] = True
        i += m + 1
    end = n
    while end > i and shares[end - 1] >= FLOOR:
        end -= 1
        out[end] = True
    while i < end:
        if shares[i] >= FLOOR and not _STOP.search(flat[i]) and not any(c.isdigit() for c in flat[i]):
            j = i + 1
            while j < n and shares[j] < FLOOR and not _STOP.search(flat[j]):
                j += 1
            if j > i + 1 and (j == n or shares[j] >= FLOOR):
                out[i:j] = [True] * (j - i)
                i = j
                continue
        if shares[i] >= BODY:
            out[i] = True
        i += 1
    return out


def _run(pages: DataFrame, schema: str, make) -> DataFrame:
    pages = stored(pages.where("text is not null"), "pages")
    known = template(pages.where("source is not null"))
    share = F.transform("lines", lambda h: F.coalesce(F.element_at("shares", h), F.lit(0.0)).cast("float"))
    joined = marked(pages, known).select("id", "title", "text", share.alias("shares"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, title, text, shares in zip(b["id"], b["title"], b["text"], b["shares"], strict=True):
                lines = text.split("\n")
                own = [0.0] * len(lines) if shares is None else list(shares)
                rows.extend(make(i, lines, template_lines(lines, own, title if isinstance(title, str) else None)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return joined.mapInPandas(run, schema)


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the lines that are not main body.

    pages(id, source, title, text, lines, heading), ids unique. Null texts have no lines. Pages of null source have no
    template: only what stands before their title goes. Hosts of fewer than LEAST_PAGES pages have none either.
    """
    return _run(pages, "id string, line_no int", lambda i, lines, out: [(i, k) for k, x in enumerate(out) if x])


def main_bodies(pages: DataFrame) -> DataFrame:
    """(id, text): the main body of each page that has a text."""
    return _run(pages, "id string, text string", lambda i, lines, out: [(i, "\n".join(t for t, x in zip(lines, out, strict=True) if not x))])
