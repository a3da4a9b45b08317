"""Exact byte-pair encoding of whole texts: one last token for every prefix, found by automaton matches and pair tests."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from citegrove.plans.materialize import ship

#: The rank file of byte_bpe_50k; give another path where the tokenizers lie elsewhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern of the rank file that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text of ASCII only.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Encoded pieces and tested pairs that a worker keeps; it starts anew when they are full.
KEPT = 400_000
#: Longest piece that is kept, in characters.
KEPT_LENGTH = 48
#: Ids in a result batch.
BATCH = 2_000_000


class PrefixEncoder(dict):
    """Token ids of a text piece, by dynamic programming over the piece's prefixes.

    The last token of a prefix's encoding is unique: it is the one token that ends there and is compatible with the last token of the prefix
    before it. Tokens that end at a place come from an automaton of the vocabulary; two tokens are compatible if encoding their
    bytes together gives the two again. As a dict it keeps the pieces encoded lately.
    """

    def __init__(self, rank_lines: bytes) -> None:
        super().__init__()
        import ahocorasick

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.bytes = {b: a for a, b in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        import regex

        self.split_any = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token; None for a byte."""
        if token not in self.halves:
            pieces = [self.ranks[bytes([b])] for b in self.bytes[token]]
            while len(pieces) > 2:
                best, at = min((self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 60), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)))
                pieces[at : at + 2] = [best]
            self.halves[token] = (pieces[0], pieces[1]) if len(pieces) == 2 else None
        return self.halves[token]

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one edge (0 left, 1 right) of token while it is made, from the byte to token itself."""
        known = self.spines[side]
        if token not in known:
            two = self.parts(token)
            known[token] = [token] if two is None else [*self.spine(two[side], side), token]
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge reaches over the border between two tokens while both are made.

        The tokens at the border change in the order of their ranks. A merge across comes first if its rank is below that of
        the left edge's next merge and not above that of the right edge's next.
        """
        if (left, right) in self.pairs:
            return self.pairs[left, right]
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        ok = True
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else 1 << 60
            next_b = b[j + 1] if j + 1 < len(b) else 1 << 60
            across = self.ranks.get(self.bytes[a[i]] + self.bytes[b[j]])
            if across is not None and across < next_a and across <= next_b:
                ok = False
                break
            if next_a == next_b == 1 << 60:
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        last = [-1] * (len(raw) + 1)
        size = [0] * (len(raw) + 1)
        for end, (token, n) in self.automaton.iter(raw.decode("latin-1")):
            if last[end + 1] < 0 and (n == end + 1 or self.compatible(last[end + 1 - n], token)):
                last[end + 1], size[end + 1] = token, n
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[int]:
        split = self.split_ascii if text.isascii() else self.split_any
        return chain.from_iterable(map(self.__getitem__, split(text)))

    def count(self, text: str) -> int:
        split = self.split_ascii if text.isascii() else self.split_any
        return sum(map(len, map(self.__getitem__, split(text))))


_ENCODERS: dict[int, PrefixEncoder] = {}


def encoder(rank_lines: bytes) -> PrefixEncoder:
    """A worker's encoder, made once."""
    key = hash(rank_lines)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(rank_lines)
    return _ENCODERS[key]


def _rank_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size


def encode_texts(df: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(key, ids): the token ids of each text, an array of ints; a null and an empty text have the empty array.

    Special tokens' strings are ordinary text. Other columns of df are dropped; repeated keys stay rows of their own.
    """
    ship(df.sparkSession)
    lines = _rank_file(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(lines.value)
        for b in batches:
            flat, ends, start = array("i"), array("i", [0]), 0
            texts = b.column(1)
            for i in range(len(texts)):
                t = texts[i].as_py()
                if t:
                    flat.extend(e.encode(t))
                ends.append(len(flat))
                if len(flat) > BATCH or i == len(texts) - 1:
                    ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i + 1 - start), ids], names=[key, "ids"])
                    flat, ends, start = array("i"), array("i", [0]), i + 1

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens): the number of tokens of each text, 0 for a null or empty one."""
    ship(df.sparkSession)
    lines = _rank_file(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(lines.value)
        for b in batches:
            n = array("q", (e.count(t) if (t := x.as_py()) else 0 for x in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(memoryview(n), pa.int64()) if n else pa.array([], pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
