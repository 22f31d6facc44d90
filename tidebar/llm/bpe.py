"""Byte-level byte-pair encoding and decoding, equal to applying every merge in rank order.

A text is split by a pattern.  For each part, an Aho-Corasick automaton over the vocabulary (bytes as Latin-1
characters) lists the tokens that begin at each byte.  Starting from the longest, a token is taken if it is
compatible with the one before it: merging the bytes of both gives just these two.  A dead end drops its last token
and tries the next shorter one; a position that failed once is never tried again, so the work is linear.  Answers on
pairs are memoised; the encoding of a prefix is unique, so pairwise compatible tokens are the exact merges.

Defined cases: a null text is encoded like an empty one (no ids), decoding no ids gives no bytes, a null list decodes
to null, an id outside the vocabulary is an error.  Texts of any length are encoded whole; for a part of the pattern
without a break only a few blocks of token lists are held at a time.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession, functions as F

from tidebar.llm.tables import bounded_batches

BLOCK = 1 << 16           # bytes of a part whose token lists are held together
KEEP_PART = 48            # longest part whose ids are kept for its next occurrence
KEEP_PARTS = 200_000      # parts kept by a worker, and as many of the table before: some 80 MB
PAIR_SLOTS = 2_097_143    # answers on token pairs kept by a worker, 8 bytes each; a pair replaces another of its slot


def read_ranks(path: str) -> bytes:
    """The vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return f.read()


class Parts(dict):
    """Packed ids of parts met before; a new part is encoded, and kept if it is short.  When the table is full it
    becomes the old one, from which parts move over as they are met again, so frequent parts stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("i", self.encode(part.encode())).tobytes()
        if len(part) <= KEEP_PART:
            if len(self) >= KEEP_PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.parts = Parts(self.part)
        self.pairs = array("q", [-1]) * PAIR_SLOTS      # 2 * (left * span + right) + answer
        self.span = max(self.tokens) + 1
        self.shorter = {}                     # the next shorter token that begins with the same bytes
        for token, rank in self.ranks.items():
            ends = (e for e in range(len(token) - 1, 0, -1) if token[:e] in self.ranks)
            end = next(ends, 0)
            self.shorter[rank] = (end, self.ranks[token[:end]]) if end else None

    def merged(self, data: bytes) -> list[bytes]:
        """Merge by rank until nothing merges; only used on the bytes of two tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two; the answer is kept in `pairs`."""
        a, b = self.tokens[left], self.tokens[right]
        answer = self.merged(a + b) == [a, b]
        pair = left * self.span + right
        self.pairs[pair % PAIR_SLOTS] = 2 * pair + answer
        return answer

    def part(self, data: bytes) -> list[int]:
        """Token ids of one part."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        chars, n = data.decode("latin-1"), len(data)
        alive = bytearray(b"\1") * (n + 1)
        pairs, compatible, shorter, span = self.pairs, self.compatible, self.shorter, self.span
        out: list[int] = []
        before: list[tuple] = []              # for each token of out: itself with its length
        base, stop = 0, min(BLOCK, n)
        longest = self._longest(chars, 0, stop)
        at, option, last = 0, longest[0], None
        while True:
            while option is not None:
                length, token = option
                if alive[at + length]:
                    if last is None:
                        break
                    pair = last * span + token
                    kept = pairs[pair % PAIR_SLOTS]
                    if kept & 1 if kept >> 1 == pair else compatible(last, token):
                        break
                option = shorter[token]
            if option is not None:
                out.append(token)
                before.append(option)
                last = token
                at += length
                if at == n:
                    return out
                if at >= stop:
                    base, stop = at, min(at + BLOCK, n)
                    longest = self._longest(chars, base, stop)
                option = longest[at - base] if at >= base else self._longest(chars, at, at + 1)[0]
            elif out:
                alive[at] = 0
                length, token = before.pop()
                out.pop()
                at -= length
                last = out[-1] if out else None
                option = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def _longest(self, chars: str, base: int, stop: int) -> list[tuple[int, int] | None]:
        """(length, id) of the longest token that begins at each byte from base to stop."""
        n = stop - base
        found: list = [None] * (n + self.longest)
        for end, option in self.automaton.iter(chars, base, min(len(chars), stop + self.longest)):
            found[end + 1 - option[0] - base] = option      # ends only grow: the last one is the longest
        return found

    def packed(self, text: str) -> bytes:
        """Token ids as 32-bit integers."""
        return b"".join(map(self.parts.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _lists(values: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) // 4 for v in values], out=offsets[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """A column function: text -> array of token ids.  The vocabulary is broadcast; its file bounds its size."""
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks.value, pattern)
        return _lists([codec.packed(v) for v in texts.to_pylist()])

    udf = F.arrow_udf(encode, "array<int>").asNondeterministic()        # nothing may plan it twice
    return lambda text: udf(F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit("")))


def decoder(spark: SparkSession, ranks_path: str, pattern: str):
    """A column function: array of token ids -> bytes."""
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(ranks.value, pattern)
        # whole numpy rows: taking single values out of an Arrow array costs ten times as much
        return pa.array([codec.decode(v.values.to_numpy().tolist()) if v.is_valid else None for v in ids], pa.binary())

    udf = F.arrow_udf(decode, "binary").asNondeterministic()
    return lambda ids: udf(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(spark: SparkSession, ranks_path: str, pattern: str):
    """A column function: text -> struct of the token ids and the bytes decoded from them, in one pass over the text."""
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def both(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks.value, pattern)
        packed = [codec.packed(v) for v in texts.to_pylist()]
        decoded = [codec.decode(array("i", v)) for v in packed]
        return pa.StructArray.from_arrays([_lists(packed), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    udf = F.arrow_udf(both, "struct<ids:array<int>,decoded:binary>").asNondeterministic()
    return lambda text: udf(F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit("")))
