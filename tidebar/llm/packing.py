"""Packing by power-of-two decomposition: every sequence is a piece of one document and needs no padding.

A document's ids, closed by an end id, are cut from the front into pieces of the longest sequence, and the rest into the
powers of two of its binary form, longest first.  Pieces of equal length share a bucket; a bucket is read in batches of
as many tokens each (`batches`), so no sequence crosses documents and none is padded.

A tokenizer that drops white space and looks at no context across it gives a text the ids of its white-space-free words
one after another.  So each task encodes every distinct word of a batch once, by the tokenizer itself, and gathers
the ids by word; a worker keeps up to `KEEP_WORDS` words for the next
batch.  One scan, no shuffle.

Sequences are numbered without gaps, bucket by bucket: pieces carry their place among those of their task and length,
and the counts per task and length, one row each, say where a task's places begin.

Defined cases: a null text is empty and gives the end id alone; repeated rows, and rows with null ids, are packed each;
texts may have any length (their ids are held, 4 bytes each, not their words); an empty table has no pieces; extra
columns are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidebar.llm.spans import byte_table, ragged, word_array, word_slices
from tidebar.llm.tables import bounded_batches, small_or_shuffled, written
from tidebar.llm.words import sequence_hash, word_hashes

LONGEST = 4096
KEEP_WORDS = 800_000         # words a worker keeps, some 32 bytes and their ids each
SLICE = 1 << 22              # bytes of text whose distinct words are looked up together
BATCH_PIECES = 10_000
WHITE = byte_table(b" \t\n\r")
PIECE = ("length long, start long, ids_crc32 long, doc_tokens long, part long, place long")


class WordEncoder:
    """Ids of white-space-free words; words met before come from sorted arrays of two hashes, some 32 bytes each."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def lists(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids kept, and where in them each of the distinct `words` begins and how many it has."""
        if len(self.keys) >= KEEP_WORDS:
            self.clear()
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
        key = word_hashes(data, bounds[:-1], bounds[1:])
        check = sequence_hash(data.astype(np.uint64) + np.uint64(7), bounds[:-1], bounds[1:])
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == key) & (self.checks[at] == check) if len(self.keys) else np.zeros(len(key), bool)
        starts, sizes = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            texts = words.take(pa.array(new)).cast(pa.large_string()).to_pylist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes[new] = [len(ids) for ids in found]
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            starts[new] = self.used + np.cumsum(sizes[new]) - sizes[new]
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[:self.used], np.zeros(self.used + len(ids), np.int32)])
            self.flat[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            place = np.argsort(np.concatenate([self.keys, key[new]]), kind="stable")
            self.keys, self.checks, self.starts, self.sizes = (
                np.concatenate([a, b[new]])[place]
                for a, b in ((self.keys, key), (self.checks, check), (self.starts, starts), (self.sizes, sizes)))
        return self.flat, starts, sizes


@lru_cache(maxsize=1)
def _encoder(file: bytes) -> WordEncoder:
    return WordEncoder(file)


def text_ids(texts: pa.Array, encoder: WordEncoder) -> Iterator[np.ndarray]:
    """The ids of each text."""
    held: list[np.ndarray] = []          # ids of the fragments of the text that goes on
    for words in word_slices(texts, WHITE, SLICE):
        coded = word_array(words.data, words.starts, words.ends).dictionary_encode()
        ids, sizes = ragged(*encoder.lists(coded.dictionary), coded.indices.to_numpy())
        ends = np.r_[0, np.cumsum(sizes)]
        edges = ends[np.searchsorted(words.rows, np.arange(words.first, words.last + 2))]
        for k in range(words.last - words.first + 1):
            held.append(ids[edges[k]:edges[k + 1]])
            if words.ended or words.first + k < words.last:
                yield np.concatenate(held) if len(held) > 1 else held[0]
                held = []


def piece_lengths(n: int, longest: int) -> list[int]:
    """`longest` as often as it fits, then the binary form of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = LONGEST, doc_id: str = "doc_id",
           text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, length, start, ids_crc32, doc_tokens, part and place (the task and the number there among equal lengths)
    and, with `keep_ids`, ids of every piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def cut(batches):
        encoder, part = _encoder(file.value), TaskContext.get().partitionId()
        seen = dict.fromkeys(piece_lengths(2 * longest - 1, longest), 0)
        for batch in batches:
            out: list[tuple] = []
            for row, ids in enumerate(text_ids(batch.column(1), encoder)):
                ids = np.append(ids, end_id).astype("<i4")
                start = 0
                for length in piece_lengths(len(ids), longest):
                    piece = ids[start:start + length]
                    out.append((row, length, start, zlib.crc32(piece), len(ids), seen[length], piece if keep_ids else None))
                    start += length
                    seen[length] += 1
                if len(out) >= BATCH_PIECES:
                    yield _batch(batch, out, part)
                    out = []
            if out:
                yield _batch(batch, out, part)

    def _batch(batch, out, part):
        at, length, start, crc, total, place, ids = zip(*out)
        arrays = [batch.column(0).take(pa.array(at)), *(pa.array(x, pa.int64()) for x in (length, start, crc, total)),
                  pa.array([part] * len(out), pa.int64()), pa.array(place, pa.int64())]
        names = ["doc_id", "length", "start", "ids_crc32", "doc_tokens", "part", "place"]
        if keep_ids:
            offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECE}" + (", ids array<int>" if keep_ids else ""))


def numbered(cut: DataFrame) -> DataFrame:
    """Written pieces with sequence_id (no gaps, longest bucket first), place within the bucket, and offset 0."""
    counts = cut.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task and length: the only rows that are ever numbered in one place
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("first", F.col("base") - F.min("base").over(Window.partitionBy("length"))).drop("n")
    counts = small_or_shuffled(written(counts, "pieces-per-task"), F.lit(32))
    out = cut.join(counts, ["length", "part"])
    return out.withColumn("sequence_id", F.col("base") + F.col("place")).withColumn(
        "place", F.col("first") + F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("base", "first", "part")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = LONGEST, doc_id: str = "doc_id",
         text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, length, start, ids_crc32, doc_tokens, place, sequence_id, offset (and ids): one row per sequence.

    The pieces are a written table, so texts are encoded once, whatever is asked of the result."""
    return numbered(written(pieces(docs, tokenizer_path, end_id, longest, doc_id, text, keep_ids), "pieces"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, each task writing to all: no shuffle."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def batches(packed: DataFrame, tokens: int) -> DataFrame:
    """`packed` with `batch`, the number of a group of sequences of one bucket that together hold `tokens` ids."""
    return packed.withColumn("batch", F.floor(F.col("place") * F.col("length") / F.lit(max(1, tokens))).cast("long"))
