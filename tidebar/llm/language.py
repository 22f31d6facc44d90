"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to `ORDER` bytes, learned from labelled texts and then frozen.  A byte
costs -log2 of its probability in the longest context seen; where the context lacks the byte, it pays an escape
(method C: distinct bytes / (bytes + distinct bytes)) and asks the next shorter context, down to 8 bits without any.
The language with the shortest code of the whole text wins (ties: alphabetically first).

Training reads a bounded sample: of each language the texts with the smallest hashes, until about `TRAIN_CHARS`
characters are expected (all of a smaller language).  That and the number of languages bound the tables, which are
counted by a grouped sum, and broadcast.  Scoring reads every byte of every text, in one pass without a shuffle.

Defined cases: a text that is null or has no letter gets `und` and score 0; without any training text all get `und`;
rows with a null language are not learned from; repeated rows are each learned and each scored; extra columns pass, but
those named like a result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.tables import bounded_batches, carried, small_or_shuffled, written
from tidebar.llm.words import text_slices

ORDER = 3
TRAIN_CHARS = 4_000_000
UNKNOWN = "und"


def held_out(doc_id) -> Column:
    """One document in five is never learned from (null ids count as held out)."""
    key = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")
    return F.coalesce(F.crc32(key) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, chars: int = TRAIN_CHARS) -> DataFrame:
    """lang, text of the bounded training sample."""
    rows = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.col(lang).cast("string").alias("lang"),
                       F.col(text).cast("string").alias("text"), held_out(doc_id).alias("out"))
    rows = rows.where("not out and lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min("h").alias("least"))
    # one row per language: broadcast under a measured bound, so that no text is shuffled to the tasks of a few languages
    sizes = small_or_shuffled(written(sizes, "languages"), F.octet_length("lang") + 32)
    share = F.pmod("h", F.lit(1 << 20)) < F.lit(float(chars)) / F.greatest("n", F.lit(1)) * (1 << 20)
    return rows.join(sizes, "lang").where(share | (F.col("h") == F.col("least"))).select("lang", "text")


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([(v or "").lower() for v in texts.to_pylist()], pa.large_string())


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ORDER zero bytes before each text; where the real bytes stand; row offsets among the real bytes."""
    sizes = np.diff(offsets)
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out = np.zeros(len(data) + ORDER * len(sizes), np.uint8)
    out[at] = data
    return out, at, offsets


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, gram (ORDER bytes of context and the byte, as a number), n."""
    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, end, data, offsets in text_slices(_folded(batch.column(1))):
                raw, at, _ = _padded(data, offsets)
                grams = np.zeros(len(at), np.int64)
                for back in range(ORDER, -1, -1):
                    grams = (grams << 8) | raw[at - back]
                owner = np.repeat(langs[first:end], np.diff(offsets))
                for lang in set(langs[first:end]):
                    gram, n = np.unique(grams[owner == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])

    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Frozen contexts of one language: `row[c]` is the cost table of the longest known suffix of context c."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        present = np.unique(np.concatenate([(grams >> (8 * k)) & 255 for k in range(ORDER + 1)]))
        self.size = size = len(present) + 1                    # the last symbol: any byte not learned
        self.symbol = np.full(256, size - 1, np.int32)
        self.symbol[present] = np.arange(len(present))
        parts = [self.symbol[(grams >> (8 * k)) & 255].astype(np.int64) for k in range(ORDER + 1)]   # byte, 1st before, ...
        cost = np.full((1, size), 8.0)
        row = np.zeros(1, np.int64)                            # context number -> row, for the order below
        for order in range(ORDER + 1):
            context = np.zeros(len(grams), np.int64)
            for k in range(order, 0, -1):
                context = context * size + parts[k]
            keys, where = np.unique(context * size + parts[0], return_inverse=True)
            seen = np.bincount(where, n).astype(float)
            owner, symbol = keys // size, keys % size
            contexts, place = np.unique(owner, return_inverse=True)
            total, kinds = np.bincount(place, seen), np.bincount(place)
            shorter = row[contexts % max(1, size ** (order - 1))] if order else np.zeros(len(contexts), np.int64)
            table = cost[shorter] - np.log2(kinds / (total + kinds))[:, None]
            table[place, symbol] = -np.log2(seen / (total + kinds)[place])
            below = row if order == 0 else np.tile(row, size) if order > 1 else np.full(size, row[0])
            row = below.copy() if order else row.copy()
            row[contexts] = len(cost) + np.arange(len(contexts))
            cost = np.vstack([cost, table])
        self.row, self.cost = row.astype(np.int32), cost.astype(np.float32).ravel()

    def bits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each real byte."""
        symbols = self.symbol[raw].astype(np.int64)
        context = symbols[at - ORDER]
        for back in range(ORDER - 1, 0, -1):
            context = context * self.size + symbols[at - back]
        return self.cost[self.row[context].astype(np.int64) * self.size + symbols[at]]


@lru_cache(maxsize=2)
def _trees(packed: bytes) -> tuple[list[str], list[Tree]]:
    table = pa.ipc.open_stream(packed).read_all()
    langs = np.array(table["lang"].to_pylist(), object)
    names = sorted(set(langs))
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy()
    return names, [Tree(gram[langs == x], n[langs == x]) for x in names]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", chars: int = TRAIN_CHARS) -> bytes:
    """The frozen counts of all languages, as Arrow bytes."""
    bounded_batches(docs.sparkSession)
    table = gram_counts(sample(docs, doc_id, text, lang, chars)).toArrow().combine_chunks()
    table = table.sort_by([("lang", "ascending"), ("gram", "ascending")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def predict(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, the share of the best language among all at equal priors."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        names, trees = _trees(shared.value)
        values = texts.to_pylist()
        pred = [UNKNOWN] * len(values)
        share = np.zeros(len(values))
        if names:
            for first, end, data, offsets in text_slices(_folded(texts)):
                raw, at, offsets = _padded(data, offsets)
                if not len(at):
                    continue
                total = np.zeros((len(trees), end - first))
                for k, tree in enumerate(trees):
                    run = np.r_[0.0, np.cumsum(tree.bits(raw, at), dtype=np.float64)]
                    total[k] = run[offsets[1:]] - run[offsets[:-1]]
                best = total.argmin(0)
                part = 1 / np.exp2(np.maximum(total.min(0) - total, -1000)).sum(0)
                for i in range(end - first):
                    if any(map(str.isalpha, values[first + i] or "")):
                        pred[first + i], share[first + i] = names[best[i]], part[i]
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(share)], names=["lang_pred", "score"])

    # marked so that a filter on the result is not pushed below it, which would score every text twice
    udf = F.arrow_udf(score, "struct<lang_pred:string,score:double>").asNondeterministic()
    scored = udf(F.col(text).cast("string"))
    rows = docs.select(carried(docs, "lang_pred", "score").alias("row"), scored.alias("scored"))
    return rows.select("row.*", "scored.*")
