"""Byte-level BPE of whole corpora in linear time.

A text is cut by the tokenizer's pattern; each different piece is encoded once and remembered. A piece of bytes, read as
Latin-1, runs through an Aho-Corasick automaton of all tokens, which gives the longest token starting at every place.
From the left the longest token is tried; it may stand if merging could have produced it beside the token before it,
else the next shorter token is tried, else the step before is undone. Whether two tokens can be neighbours is found by
undoing their merges along the seam and is remembered per pair. Places that led nowhere are never tried again, so the
work is linear in the piece, and the result is that of merging pair by pair.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Pieces of text of the tokenizer (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and neighbours remembered per Python worker.
REMEMBERED = 400_000


class Encoder:
    """Ranks as {bytes: id}, ids in the order of merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; the token itself twice if it is a single byte."""
        if (two := self._halves.get(token)) is None:
            whole = self.bytes[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:  # merging as always, short of the last step
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 30))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            two = self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return two

    def beside(self, left: int, right: int) -> bool:
        """Whether merging can leave these two tokens as neighbours.

        Their merges are undone from the latest to the earliest. At each moment the two pieces that touch at the seam
        must not have merged with each other before the next of the known merges happened.
        """
        key = (left, right)
        if (ok := self._beside.get(key)) is None:
            if len(self._beside) > REMEMBERED:
                self._beside.clear()
            ok = self._beside[key] = self._apart(left, right)
        return ok

    def _apart(self, left: int, right: int) -> bool:
        until, l_byte, r_byte = 1 << 30, False, False
        while True:
            joined = self.ranks.get(self.bytes[left] + self.bytes[right])
            if joined is not None and joined < until and self.halves(joined) == (left, right):
                return False
            l_byte, r_byte = len(self.bytes[left]) == 1, len(self.bytes[right]) == 1
            if l_byte and r_byte:
                return True
            if r_byte or (not l_byte and left > right):
                until, left = left, self.halves(left)[1]  # at equal rank the merge further left comes first
            else:
                until, right = right + 1, self.halves(right)[0]

    def shorter(self, token: int) -> int:
        """The longest token that is a true beginning of this one; -1 if there is none."""
        if (t := self._shorter.get(token)) is None:
            b = self.bytes[token]
            t = self._shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return t

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        n, longest = len(raw), [-1] * len(raw)
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size + 1] = token  # ends rise, so the longest stays
        out: list[int] = []
        at, dead, size = 0, bytearray(n + 1), {}
        token = longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.bytes[token])
                if not dead[end] and (not out or self.beside(out[-1], token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.bytes[token])
                token = self.shorter(token) if dead[at + len(self.bytes[token])] else token
        return tuple(out)

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        known, piece = self.known, self.piece
        for p in self.find(text):
            if (ids := known.get(p)) is None:
                if len(known) > REMEMBERED:
                    known.clear()
                ids = piece(p)
                if len(p) < 64:
                    known[p] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids] if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(read_ranks(path))
    return _loaded[path]


def _map(df: DataFrame, text: str, name: str, kind: pa.DataType, sql: str, make) -> DataFrame:
    """df with one more column made from its text column, batch by batch."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            made = pa.array([make(t) for t in b.column(at).to_pylist()], kind)
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), made], [*(b.schema.field(i).name for i in keep), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text), f"{name} {sql}"])
    return df.mapInArrow(run, schema)


def encoded(df: DataFrame, text: str = "text", name: str = "ids", tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """df without its text and with the list of token ids, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded like any other. Rows are independent: no shuffle.
    """
    path = f"{folder}/{tokenizer}"
    return _map(df, text, name, pa.list_(pa.int32()), "array<int>", lambda t: encoder(path).encode(t))


def counted(df: DataFrame, text: str = "text", name: str = "n_tokens", tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """df without its text and with its number of tokens (0 for null and empty texts)."""
    path = f"{folder}/{tokenizer}"
    return _map(df, text, name, pa.int64(), "bigint", lambda t: encoder(path).count(t))
