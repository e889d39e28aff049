"""Splitting oversized texts at natural boundaries, by lexical cohesion, and auditing stored pieces.

Around every gap between sentences or lines two blocks of words are compared by the cosine of their word counts. Where
the similarity falls into a valley the topic changes; the depth of the valley is how far the similarity rises again on
both sides. A piece ends in the deepest valley among the gaps of its size window's second half, so that pieces are not
needlessly small; if that half has no gap, in the deepest of the first half after the overlap; only if there is none either,
between words. The next piece begins about OVERLAP characters before, at a word. Only an unbroken run of RUN letters or
digits may be cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST, MOST, RUN = 1200, 150, 80, 160, 40
#: Words in a block beside a gap, and what the end of a line counts besides its depth.
BLOCK, LINE = 30, 0.05
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？…।؟]+[”’」』）)]*")


def inside_word(text: str, at: int) -> bool:
    """Whether a cut at this place splits a run of fewer than RUN letters or digits."""
    if not 0 < at < len(text) or not (text[at - 1].isalnum() and text[at].isalnum()):
        return False
    left, right = at, at
    while left > 0 and at - left < RUN and text[left - 1].isalnum():
        left -= 1
    while right < len(text) and right - left < RUN and text[right].isalnum():
        right += 1
    return right - left < RUN


def _units(text: str) -> list[tuple[int, int]]:
    """Words as (start, end); scripts without blanks count by letter."""
    out = []
    for m in _WORD.finditer(text):
        a, b = m.span()
        if b - a > 1 and ord(text[a]) >= 0x2E80:
            out.extend((i, i + 1) for i in range(a, b))
        else:
            out.append((a, b))
    return out


def valleys(text: str, gaps: list[int]) -> list[float]:
    """Depth of the similarity valley at each gap, from 0 up."""
    units = _units(text)
    starts = [a for a, _ in units]
    words = [text[a:b].casefold() for a, b in units]
    sims = []
    for g in gaps:
        i = bisect_left(starts, g)
        left, right = Counter(words[max(0, i - BLOCK) : i]), Counter(words[i : i + BLOCK])
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        norm = sum(n * n for n in left.values()) * sum(n * n for n in right.values())
        sims.append(dot / norm**0.5 if norm else 0.0)
    depth = [0.0] * len(gaps)
    for order in (range(len(gaps)), range(len(gaps) - 1, -1, -1)):
        peak = last = -1.0
        for k in order:
            peak = peak if last >= sims[k] else sims[k]  # the height reached by climbing from here, as long as it goes up
            depth[k] += peak - sims[k]
            last = sims[k]
    return depth


def split(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces, in order; none for null and empty texts, one for texts within the limit."""
    if not text:
        return []
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be under half the size")
    if len(text) <= size:
        return [(0, len(text))]
    lines = {i + 1 for i, c in enumerate(text) if c == "\n"}
    gaps = sorted(lines | {m.end() for m in _SENTENCE.finditer(text)})
    depth = [d + LINE * (g in lines) for g, d in zip(gaps, valleys(text, gaps), strict=True)]
    out, start = [], 0
    while len(text) - start > size:
        low, high, cut = start + size // 2, start + size, None
        for first, last in ((low, high), (start + overlap + 1, low - 1)):
            i, j = bisect_left(gaps, first), bisect_left(gaps, last + 1)
            if i < j:
                cut = gaps[max(range(i, j), key=lambda k: (depth[k], k))]
                break
        if cut is None:
            cut = next((i for i in range(high, low, -1) if text[i].isspace() or text[i - 1].isspace()), None) or next((i for i in range(high, low, -1) if not inside_word(text, i)), high)
        out.append((start, cut))
        near = sorted(range(cut - MOST * overlap // OVERLAP, cut - LEAST * overlap // OVERLAP), key=lambda i: abs(cut - overlap - i))
        start = next((i for i in near if i > start and text[i - 1].isspace()), None) or next((i for i in near if i > start and not inside_word(text, i)), max(start + 1, cut - overlap))
    out.append((start, len(text)))
    return out


def pieces(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(page_id, seq, text) of texts(page_id, text). Rows are independent: no shuffle, and a text of any length is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, t[a:e]) for i, t in zip(b["page_id"], b["text"], strict=True) for n, (a, e) in enumerate(split(t if isinstance(t, str) else None, size, overlap))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "text"])

    return texts.select("page_id", "text").mapInPandas(run, "page_id string, seq int, text string")


def shared(before: str, piece: str) -> int:
    """Length of the longest end of before that is the beginning of piece; 0 for anything under LEAST."""
    head, at = piece[:LEAST], -1
    while len(head) == LEAST and (at := before.find(head, at + 1)) >= 0:
        n = len(before) - at
        if n <= len(piece) and piece.startswith(before[at:]):
            return n
    return 0


def _fine(text: str, at: int, piece: str) -> bool:
    return not inside_word(text, at) and not inside_word(text, at + len(piece))


def place(piece: str, text: str, near: int = 0) -> int:
    """Where the piece stands in the text and is well cut, first sought from near on; -1 if there is no such place."""
    for first in (near, 0)[: 1 + (near > 0)]:
        at = text.find(piece, first)
        while at >= 0:
            if _fine(text, at, piece):
                return at
            at = text.find(piece, at + 1) if piece else -1
    return -1


def faults(seqs: list[int], pieces_: list[str | None], text: str) -> set[int]:
    """seqs of faulty pieces of a text: over size, no verbatim part, cut inside a word, or not LEAST to MOST characters shared with the piece before.

    Pieces come in order. One that stands in the text more than once is well cut if it is at one of its places.
    """
    out, near, before, now, last = set(), 0, None, None, None
    for seq, piece in zip(seqs, pieces_, strict=True):
        if seq != now:
            before, now = last, seq
        at = place(piece, text, near) if piece is not None and len(piece) <= SIZE else -1
        if at < 0 or (before is not None and not LEAST <= shared(before, piece) <= MOST):
            out.add(seq)
        near, last = max(at, 0), piece or ""
    return out


def faulty(piece: str, before: str | None, text: str) -> bool:
    """Whether a piece that follows another, if it does, breaks a rule."""
    return bool(faults([0, 1], [before, piece], text) & {1} if before is not None else faults([1], [piece], text))


def _by_page(rows: DataFrame) -> DataFrame:
    """(page_id, seqs, pieces): each different (seq, text) of a page, in order, null texts first."""
    rows = rows.where("page_id is not null and seq is not null").groupBy("page_id").agg(F.sort_array(F.collect_set(F.struct("seq", "text"))).alias("p"))
    return rows.select("page_id", F.col("p.seq").alias("seqs"), F.col("p.text").alias("pieces"))


def audit(stored: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, seq) of faulty stored pieces of pages that have a text.

    stored(page_id, seq, text), texts(page_id, text) with unique ids. Repeated rows count once. A null piece is no part
    of its page. Rows without page or seq are no pieces. If one seq has several texts, the pair is faulty if one of them
    is; the next piece is held against the greatest of them. A page is one row with its text and its different pieces,
    which are about as long together as the text.
    """
    own = texts.where("text is not null").select("page_id", F.col("text").alias("whole"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s) for i, seqs, parts, whole in zip(b["page_id"], b["seqs"], b["pieces"], b["whole"], strict=True) for s in sorted(faults(list(seqs), list(parts), whole))]
            yield pd.DataFrame(rows, columns=["page_id", "seq"])

    return _by_page(stored).join(own, "page_id").mapInPandas(run, "page_id string, seq int")


def soundness(made: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, pieces, chars, faults): for each page with a text, how many pieces it has, how many characters they
    hold without what they share, and how many of them are faulty. Sound pieces hold as many as the text."""
    own = texts.where("text is not null").select("page_id", F.col("text").alias("whole"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, seqs, parts, whole in zip(b["page_id"], b["seqs"], b["pieces"], b["whole"], strict=True):
                seqs, parts = ([], []) if seqs is None else (list(seqs), list(parts))
                twice = sum(shared(x, y) for x, y in zip(parts, parts[1:], strict=False))
                rows.append((i, len(parts), sum(map(len, parts)) - twice, len(faults(seqs, parts, whole))))
            yield pd.DataFrame(rows, columns=["page_id", "pieces", "chars", "faults"])

    return own.join(_by_page(made), "page_id", "left").mapInPandas(run, "page_id string, pieces bigint, chars bigint, faults bigint")
