"""Sentence boundaries in any language, by a hidden-event n-gram model.

Units end at lines of white space only. Between the words of a unit stand hidden events, and forward-backward sums over
them give the posterior of each, which decides. Two models tell how likely an event is:

- where there are marks (and, as Thai has none, at its blanks) an event may stand after a mark with its closing quotes
  and brackets. The model has, for the word with its mark on the left, how often an event follows, and for the word on the
  right, how it looks after an event and after none. It is estimated from the texts themselves: ends of units are certain
  events after their last word and before their first, the rest is filled in by expectation maximisation. Marks inside
  quotes or brackets are words of their own here, as what they end mostly goes on. A list mark is no sentence of its own,
  so events before and after it depend on each other;
- where a unit has no mark at all, an event may stand between any two words (letters, in scripts without blanks). A
  bigram model with boundary tokens, counted in the sentences that the first model found in all documents, compares each
  word following the other with the one ending and the other beginning a sentence. Such a unit is a heading,
  which has no event, or running text; the share RUNNING of the latter is set beforehand, the words decide.

Pass one finds the places of a text's events and keeps them as numbers, from which counts and decisions are made in blocks of
numbers; pass two counts the pairs of words. Words are hashed to 32 bits, and for the model of marks to as many cells as there
are words, MOST at most. Counted pairs stay a table, which is joined to the pairs of words that stand in units without marks;
units of the same words are decided once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseam.session import stored

LEAST, MOST = 1 << 12, 1 << 20
#: Looks of the word on the right: 12 kinds and 20 cells of first letters of scripts without letter case.
KINDS, CELLS = 12, 20
CLASSES = KINDS + CELLS
ROUNDS = 12
#: What is expected of a word not seen before, and how many sightings that is worth.
PRIOR, WEIGHT = 0.8, 3.0
#: How much rarer than in the whole corpus unit ends may be, in a language, among the events of a word that always has one.
SLACK = 1.6
#: Sightings that the rate of a word alone is worth.
SMOOTH = 2.0
RUNNING = 0.01
#: Words that are gathered before their pairs are counted, and bytes up to which a table is broadcast.
BLOCK, BYTES = 1 << 20, 4 << 20

_UNIT = re.compile(r"\S(?:[^\n]+|\n(?![^\S\n]*(?:\n|$)))*")
_CLOSE = "\"'”’“»«›)\\]」』）》】"
_MARKS = re.compile(rf"(?:[.!?…]+|[。．｡！？।॥؟۔;]+[!?.…！？]*|;(?<=[Ͱ-Ͽἀ-῿];))(?:[   ]?»|[{_CLOSE}])*")
_WIDE = re.compile(r"[。．｡！？…]")
_THAI = re.compile(r"(?<=\S)[^\S\n]+(?=\S)")
_DIGITS = re.compile(r"[0-9]+")
_IS_THAI = re.compile("[฀-๿]")
_SPACE = re.compile(r"\s")
_HERE = re.compile(r"\S")
_OPEN = "\"'“”„‘«‹([「『（《【¿¡"
_PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "„": "“", "《": "》", '"': '"'}
_QUOTES = re.compile("[" + re.escape("".join({*_PAIRS, *_PAIRS.values()})) + "]")
_LIST = re.compile(r"(?:[-*•–]\s*)?(?:\(?(?:[0-9]{1,3}|[^\W\d_])[.)]|[-*•–])$")
_MIXED = re.compile(r"[^\W_][._/][^\W_]|_|\d")
#: A word; letters of scripts without blanks stand alone.
_ALONE = "\u0e01-\u0e3a\u0e40-\u0e4e\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3005\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+(?:[.'’_-][^\W{_ALONE}]+)*")
_BOUNDARY = zlib.crc32(b"\n")
_LOW = (1 << 32) - 1


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the text between lines of white space only, without white space around."""
    for m in _UNIT.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1].isspace():
            b -= 1
        yield a, b


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _look(text: str, at: int, end: int) -> int:
    """Class of the word on the right, which begins at that place."""
    c, opened = text[at], 0
    while c in _OPEN and at + 1 < end and not text[at + 1].isspace():
        at, opened = at + 1, 1
        c = text[at]
    if c.isdigit():
        return 4 + opened
    if c.isupper() or c.istitle():
        return 2 + opened
    if c.islower():
        if opened:
            return 1
        blank = _SPACE.search(text, at, end)
        return 6 if _MIXED.search(text[at : blank.start() if blank else end].rstrip(".,;:!?)\"'”»…")) else 0
    if c.isalpha():
        return _letter(c)
    return 7 if c in "-*•–" else 8 + opened


@lru_cache(1 << 15)
def _letter(c: str) -> int:
    return KINDS + zlib.crc32(c.encode("utf-8", "surrogatepass")) % CELLS


@lru_cache(1 << 16)
def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


_PART = re.compile(r"^.*(?:[-_](?=[^\W\d_]{4})|[^\W\d_]{2}[.!?](?=[^\W\d_]{2}))")
#: A sentence that begins right after the one before.
_GLUED = re.compile(r"(?<=[^\W\d_]{2})[.!?]+[”»)]*(?=[“«(¿¡]?[^\W\d_])")


def _words_before(text: str, start: int, at: int, n: int) -> list[str]:
    """The last n words of text[start:at], however long; the window is doubled until it holds them."""
    width = 32
    while True:
        low = max(start, at - width)
        parts = text[low:at].rsplit(None, n)
        if low == start or len(parts) > n:
            return parts[-n:]
        width *= 4


@lru_cache(1 << 16)
def _plain(last: str) -> str:
    """A word as it counts: without letter case, digits and opening quotes; compounds go by their last part."""
    return _PART.sub("", _DIGITS.sub("0", last.casefold()).lstrip(_OPEN))


def _left(text: str, start: int, at: int, end: int) -> str:
    """The word before a mark at [at, end), with the mark; a number takes the word before it along."""
    marks = text[at:end].strip()
    if marks[0] not in ".…" and not (marks[0] in "。।" and marks[1:]):
        return marks
    if _WIDE.match(marks):
        return (text[at - 1] if at > start else "") + marks
    word, previous = "", ""
    if at > start and not text[at - 1].isspace():
        last = _words_before(text, start, at, 1)[-1]
        word = _plain(last)
        if word.strip(".,-–v0") == "":
            previous = (_words_before(text, start, at, 2)[:-1] or [""])[0]
    else:
        previous = (_words_before(text, start, at, 1) or [""])[-1]
    if word.strip(".,-–v0") == "":
        word = f"{_PART.sub('', previous.casefold())} {word}"
    return word + marks


def _inside(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans within matching quotes and brackets of a unit, outermost ones."""
    out, want, opened = [], None, 0
    for m in _QUOTES.finditer(text, start, end):
        i, c = m.start(), m.group()
        if want is None:
            if c in _PAIRS and (c != '"' or i == start or text[i - 1].isspace() or text[i - 1] in _OPEN):
                want, opened = _PAIRS[c], i
        elif c == want:
            out.append((opened, i))
            want = None
    return out


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int, str, int]], str | None]:
    """Places of a unit where an event may stand, and what stands on the left of its end if that is a mark.

    A place is (end of the sentence, start of the next, left, right class).
    """
    out, tail, spans, at, inner = [], None, None, 0, 0
    thai = None
    for m in _MARKS.finditer(text, start, end):
        a, b = m.span()
        if b >= end:
            tail = _left(text, start, a, b)
            break
        nxt = text[b]
        if nxt.isspace():
            j = _HERE.search(text, b, end).start()
        else:
            j = b
            if _WIDE.search(text, a, b):
                if not (nxt.isalnum() or nxt in _OPEN) or (nxt.isdigit() and a > start and text[a - 1].isdigit()):
                    continue
            elif not (_GLUED.match(text, a) and text[a - 1].islower() and (nxt.isupper() or (nxt in _OPEN and text[b + 1 : b + 2].isupper()))):
                continue
        if spans is None:
            spans = _inside(text, start, end)
        while at < len(spans) and spans[at][1] < b:
            at += 1
        left = "«" + text[a:b].strip() if at < len(spans) and spans[at][0] < a else _left(text, start, a, b)
        out.append((b, j, left, _look(text, j, end)))
    if _IS_THAI.search(text, start, end):
        thai = _inside(text, start, end) if spans is None else spans
        seen = {x[0] for x in out}
        for m in _THAI.finditer(text, start, end):
            a, b = m.span()
            if a not in seen and (_thai(text[a - 1]) or _thai(text[b])) and not _LIST.match(text[start:a] if a - start < 8 else ""):
                while inner < len(thai) and thai[inner][1] < a:
                    inner += 1
                inside = inner < len(thai) and thai[inner][0] < a
                out.append((a, b, "«ไทย" if inside else "ไทย", _look(text, b, end)))
        out.sort()
        if tail is None and _thai(text[end - 1]):
            tail = "ไทย"
    return out, tail


@lru_cache(1 << 16)
def _token(word: str) -> int:
    return _code(_DIGITS.sub("0", word.casefold()))


def places(texts: Iterator[str | None]) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """For each text its units, places and words as 32-bit numbers.

    A unit is (start, end, number of places, of words, class of its first word, hash of its end or 0), a place (end, next start,
    hash of the left, class, 32 added if what it closes is a list mark alone), a word (start, end, hash, 1 if only blanks are before it).
    Only units without marks have words.
    """
    all_units, all_places, all_words = [], [], []
    for text in texts:
        us, ps, ws = [], [], []
        if text:
            for a, b in units(text):
                found, tail = candidates(text, a, b)
                at, words = a, 0
                for end, nxt, left, right in found:
                    ps += (end, nxt, _code(left), right + 32 * (end - at <= 6 and bool(_LIST.match(text[at:end]))))
                    at = nxt
                if not found and tail is None:
                    before, last = len(ws), a
                    for m in _WORD.finditer(text, a, b):
                        ws += (m.start(), m.end(), _token(m.group()), text[last : m.start()].strip() == "")
                        last = m.end()
                    words = (len(ws) - before) // 4
                us += (a, b, len(found), words, _look(text, a, b), _code(tail) if tail else 0)
        all_units.append(np.array(us, np.uint32).tobytes())
        all_places.append(np.array(ps, np.uint32).tobytes())
        all_words.append(np.array(ws, np.uint32).tobytes())
    return all_units, all_places, all_words


def _table(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column of places(), and the row of the column each is from."""
    raw = [b or b"" for b in column]
    x = np.frombuffer(b"".join(raw), np.uint32).reshape(-1, width)
    return x, np.repeat(np.arange(len(raw)), [len(b) // (4 * width) for b in raw])


def counts(us: np.ndarray, ps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, class, n) of units and places: class CLASSES for ends of units, CLASSES + 1 + class for the first words of units."""
    ends = us[us[:, 5] > 0, 5]
    word = np.concatenate([ps[:, 2], ends, np.zeros(len(us), np.uint32)]).astype(np.uint64)
    kind = np.concatenate([ps[:, 3] & 31, np.full(len(ends), CLASSES, np.uint32), CLASSES + 1 + us[:, 4]]).astype(np.uint64)
    both, n = np.unique(word << np.uint64(8) | kind, return_counts=True)
    return (both >> np.uint64(8)).astype(np.int64), (both & np.uint64(255)).astype(np.int64), n.astype(np.int64)


def fit(cells: np.ndarray, classes: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of an event after the word of each cell, and what the class of the next word adds."""
    inner, last, heads = classes < CLASSES, classes == CLASSES, classes > CLASSES
    c, k, m = cells[inner], classes[inner], n[inner].astype(float)
    ends = np.bincount(cells[last], n[last], size)
    first = 1 + np.bincount(classes[heads] - CLASSES - 1, n[heads], CLASSES)
    total = np.bincount(c, m, size)
    gamma, all_ends, rho = np.full(len(c), 0.5), ends.sum() + 1, 0.5
    right = np.log(first / first.sum()) - np.log((np.bincount(k, m, CLASSES) + 1) / (m.sum() + CLASSES))
    left = np.zeros(size)
    for _ in range(ROUNDS):
        # a word that ends sentences ends units too, in the share rho of its events; unit ends are certain, so they alone say how often it has one
        p = np.clip((SLACK * ends / rho + WEIGHT * PRIOR) / (ends + total + WEIGHT), 1e-4, 0.9995)
        left = np.log(p / (1 - p))
        gamma = 1 / (1 + np.exp(-np.clip(left[c] + right[k], -30, 30)))
        start, rest = first + np.bincount(k, m * gamma, CLASSES), np.bincount(k, m * (1 - gamma), CLASSES) + 1
        right = np.log(start / start.sum()) - np.log(rest / rest.sum())
        rho = min(0.9, max(0.02, all_ends / (all_ends + (m * gamma).sum())))
    return left.astype(np.float32), right.astype(np.float32)


class Marks:
    """The model of marks. left, right: of fit()."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right

    def odds(self, ps: np.ndarray) -> np.ndarray:
        return self.left[ps[:, 2] % len(self.left)] + self.right[ps[:, 3] & 31]


class Model(NamedTuple):
    """pairs: (before, word, n), hashes of a word and the next, and how often they stand so, once left out; ends of sentences are words."""

    marks: Marks
    pairs: DataFrame


def _joint(e: np.ndarray, lone: np.ndarray) -> np.ndarray:
    """Events of a unit in which a list mark stands alone between two places: forward-backward sums, where no event may follow another across it."""
    n, never = len(e), -14.0
    fwd = np.empty((n + 1, 2))
    fwd[0] = -1e9, 0.0  # the unit starts after an event
    for k in range(n):
        fwd[k + 1] = np.logaddexp(*fwd[k]), np.logaddexp(fwd[k, 0], fwd[k, 1] + never * lone[k]) + e[k]
    back, out = np.zeros(2), np.zeros(n, bool)
    for k in range(n - 1, -1, -1):
        out[k] = fwd[k + 1, 1] + back[1] > fwd[k + 1, 0] + back[0]
        back = np.array([np.logaddexp(back[0], e[k] + back[1]), np.logaddexp(back[0], e[k] + back[1] + never * lone[k])])
    return out


def decide(us: np.ndarray, ps: np.ndarray, model: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, end) of every sentence, in order, by the marks; a unit without any is one."""
    e = model.odds(ps)
    event, lone = e > 0, ps[:, 3] >= 32
    first = np.concatenate([[0], np.cumsum(us[:, 2], dtype=np.int64)])
    unit = np.repeat(np.arange(len(us)), us[:, 2].astype(np.int64))
    for u in np.unique(unit[lone]):
        a, b = first[u], first[u + 1]
        event[a:b] = _joint(e[a:b], lone[a:b])
    every = np.arange(len(us))
    of = np.concatenate([every, unit[event]]) << 32
    starts, ends = np.sort(of | np.concatenate([us[:, 0], ps[event, 1]])), np.sort(of | np.concatenate([us[:, 1], ps[event, 0]]))
    return starts >> 32, starts & _LOW, ends & _LOW


def _gapped(us: np.ndarray, ws: np.ndarray) -> np.ndarray:
    """Which units have two words with only blanks between, and no mark."""
    unit = np.repeat(np.arange(len(us)), us[:, 3].astype(np.int64))
    return np.bincount(unit[1:][(unit[1:] == unit[:-1]) & (ws[1:, 3] > 0)], minlength=len(us)) > 0


def sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    one = model.pairs.sparkSession.createDataFrame([(0, text)], "doc_id int, text string")
    return sorted((r.start_char, r.end_char) for r in split(one, model=model).collect())


def prepared(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, units, places, words) of docs(key, text): see places()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, ps, ws = places(t if isinstance(t, str) else None for t in b["text"])
            yield pd.DataFrame({key: b[key], "text": b["text"], "units": us, "places": ps, "words": ws})

    return docs.select(key, "text").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, text string, units binary, places binary, words binary")


def marks(ready: DataFrame) -> Marks:
    """The model of marks of prepared documents. Counts over all of them; at most 64 for each of MOST cells are summed on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            word, kind, n = counts(_table(b["units"], 6)[0], _table(b["places"], 4)[0])
            yield pd.DataFrame({"word": word, "class": kind.astype(np.int32), "n": n})

    sums = stored(ready.select("units", "places").mapInPandas(run, "word bigint, class int, n bigint").groupBy("word", "class").agg(F.sum("n").alias("n")), "counts")
    known = sums.agg(F.approx_count_distinct("word")).first()[0]
    size = min(MOST, max(LEAST, 1 << (4 * known).bit_length()))
    got = sums.groupBy((F.col("word") % size).cast("int").alias("cell"), "class").agg(F.sum("n").alias("n")).toPandas()
    return Marks(*fit(got["cell"].to_numpy(np.int64), got["class"].to_numpy(np.int64), got["n"].to_numpy(np.int64), size))


class _Codes(dict):
    """Of what stands between blanks, the numbers of its words; what is short is kept, and all given up at BLOCK / 8 entries."""

    def __missing__(self, part: str) -> tuple[int, ...]:
        codes = tuple(map(_token, _WORD.findall(part)))
        if len(self) >= BLOCK // 8:
            self.clear()
        if len(part) <= 32:
            self[part] = codes
        return codes


_CODES = _Codes()


def _paired(words: list[int]) -> pd.DataFrame:
    """(pair, n) of words that follow each other, both in one number."""
    w = np.array(words, np.uint64)
    pair, n = np.unique(w[:-1] << np.uint64(32) | w[1:], return_counts=True)
    return pd.DataFrame({"pair": pair.astype(np.int64), "n": n})


def pairs(ready: DataFrame, model: Marks) -> DataFrame:
    """Of Model, counted in all prepared documents."""
    known = ready.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each of MOST cells, at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, row = _table(b["units"], 6)
            unit, start, end = decide(us, _table(b["places"], 4)[0], known.value)
            texts, every = b["text"].tolist(), [_BOUNDARY]
            for i, a, z in zip(row[unit].tolist(), start.tolist(), end.tolist(), strict=True):
                every += chain.from_iterable(map(_CODES.__getitem__, texts[i][a:z].split()))
                every.append(_BOUNDARY)
                if len(every) > BLOCK:
                    yield _paired(every)
                    every = [_BOUNDARY]
            yield _paired(every)

    sums = ready.select("text", "units", "places").mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    once = sums.where("n > 1").select(F.shiftrightunsigned("pair", 32).alias("before"), F.col("pair").bitwiseAND(_LOW).alias("word"), (F.col("n") - 1).alias("n"))
    return stored(once, "pairs")  # a unit in question must not vouch for itself


def train(docs: DataFrame, ready: DataFrame | None = None, key: str = "doc_id") -> Model:
    """The model of docs(key, text), prepared beforehand or here."""
    ready = stored(prepared(docs, key), "places") if ready is None else ready
    model = marks(ready)
    return Model(model, pairs(ready, model))


def _unmarked(ready: DataFrame, key: str) -> DataFrame:
    """(key, start, end, starts, ends, seq) of units without marks in which an event may stand, with their words' places; seq has each word's
    hash, doubled, and 1 added where only blanks are before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, row = _table(b["units"], 6)
            ws = _table(b["words"], 4)[0].astype(np.int64)
            at = np.flatnonzero(_gapped(us, ws))
            if not len(at):
                continue
            first = np.concatenate([[0], np.cumsum(us[:, 3], dtype=np.int64)])
            seq = ws[:, 2] * 2 + ws[:, 3]
            seq[first[:-1][us[:, 3] > 0]] &= -2
            cut = lambda x: [x[a:z] for a, z in zip(first[at].tolist(), first[at + 1].tolist(), strict=True)]  # noqa: B023, E731
            yield pd.DataFrame({key: b[key].to_numpy()[row[at]], "start": us[at, 0].astype(np.int32), "end": us[at, 1].astype(np.int32), "starts": cut(ws[:, 0].astype(np.int32)), "ends": cut(ws[:, 1].astype(np.int32)), "seq": cut(seq)})

    schema = f"{key} {dict(ready.dtypes)[key]}, start int, end int, starts array<int>, ends array<int>, seq array<bigint>"
    return ready.select(key, "units", "words").mapInPandas(run, schema)


def _odds(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(before, word, e) of asked(before, word): log odds of an event between the two, from how often either stands so."""
    edge, n, none = F.lit(_BOUNDARY), F.col("n"), F.lit(0)
    after = pairs.select(F.col("before").alias("w"), n.alias("seen"), F.when(F.col("word") == edge, n).otherwise(none).alias("last"), none.alias("first"))
    heads = pairs.where(F.col("before") == edge).select(F.col("word").alias("w"), none.alias("seen"), none.alias("last"), n.alias("first"))
    facts = stored(after.unionByName(heads).groupBy("w").agg(*[F.sum(c).alias(c) for c in ("seen", "last", "first")]), "words")
    seen, edges, words = facts.agg(F.sum("seen"), F.sum(F.when(F.col("w") == edge, F.col("seen"))), F.count_if(F.col("seen") > 0)).first()
    alone = lambda x: (x + 1) / F.lit(float((seen or 0) + words + 1))
    given = lambda c: F.coalesce(F.col(c), none).cast("double")
    rate = lambda x, word, of: F.log((x + SMOOTH * alone(word)) / (of + SMOOTH))
    left = facts.select(F.col("w").alias("before"), F.col("seen").alias("before_seen"), "last")
    right = facts.select(F.col("w").alias("word"), F.col("seen").alias("word_seen"), "first")
    both = asked.join(left, "before", "left").join(right, "word", "left").join(pairs, ["before", "word"], "left")
    total = F.lit(float(edges or 0))
    e = rate(given("last"), total, given("before_seen")) + rate(given("first"), given("word_seen"), total) - rate(given("n"), given("word_seen"), given("before_seen"))
    return both.select("before", "word", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e)).alias("e"))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A stored table, broadcast if it is small as measured."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BYTES else df


def _cuts(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, cuts) of units with events: the places of the words after which they stand."""
    seqs = stored(units.select("seq").distinct().withColumn("id", F.monotonically_increasing_id()), "units")
    near = F.transform("seq", lambda x, i: F.struct(i.alias("k"), F.shiftright(x, 1).alias("before"), F.get("seq", i + 1).alias("next")))
    gaps = seqs.select("id", F.inline(near)).where(F.col("next").bitwiseAND(1) == 1).select("id", "k", "before", F.shiftright("next", 1).alias("word"))
    odds = stored(_odds(gaps.select("before", "word").distinct(), pairs), "odds")
    of = gaps.join(_small(odds, F.lit(24)), ["before", "word"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("events"))
    sure = lambda e: 1 / (1 + F.exp(-e))
    # against a heading; events of running text are independent, given the words
    running = F.aggregate("events", F.lit(float(np.log(RUNNING / (1 - RUNNING)))), lambda s, x: s + F.greatest(F.lit(0.0), x["e"]) + F.log1p(F.exp(-F.abs(x["e"]))))
    told = of.select("id", "events", F.greatest(F.lit(-50.0), F.least(F.lit(50.0), running)).alias("running"))
    cuts = F.transform(F.filter("events", lambda x: (x["e"] > 0) & (sure(x["e"]) * sure(F.col("running")) > 0.5)), lambda x: x["k"])
    return stored(told.select("id", cuts.alias("cuts")).where(F.size("cuts") > 0).join(seqs, "id").select("seq", "cuts"), "cuts")


def split(docs: DataFrame, key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """(key, start_char, end_char) of every sentence of docs(key, text), in code points, the end just past the last.

    Null, empty and blank texts have no sentences; repeated rows have theirs each. The model is trained on docs if none is given.
    """
    ready = stored(prepared(docs, key), "places")
    model = train(docs, ready, key) if model is None else model
    known = docs.sparkSession.sparkContext.broadcast(model.marks)  # 4 bytes for each of MOST cells, at most
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, row = _table(b["units"], 6)
            rest = ~_gapped(us, _table(b["words"], 4)[0])
            unit, start, end = decide(us[rest], _table(b["places"], 4)[0], known.value)
            yield pd.DataFrame({key: b[key].to_numpy()[row[rest][unit]], "start_char": start.astype(np.int32), "end_char": end.astype(np.int32)})

    by_marks = ready.select(key, "units", "places", "words").mapInPandas(run, f"{key} {kind}, start_char int, end_char int")
    units = stored(_unmarked(ready, key), "unmarked")
    cuts = _cuts(units, model.pairs)
    all_units = units.join(_small(cuts, 8 * F.size("seq") + 4 * F.size("cuts") + 48), "seq", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    begin = F.concat(F.array("start"), F.transform("cuts", lambda k: F.get("starts", k + 1)))
    finish = F.concat(F.transform("cuts", lambda k: F.get("ends", k)), F.array("end"))
    return by_marks.unionByName(all_units.select(key, F.inline(F.arrays_zip(begin.alias("start_char"), finish.alias("end_char")))))
