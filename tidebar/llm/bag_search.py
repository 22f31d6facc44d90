"""Ranked search by bag deduplication: documents that look alike to all items are scored once.

Only words of the items' vocabulary can score, so a document is its vector of vocabulary word counts and its length
norm m.  One scan reduces every document to that.  Documents with equal vectors and equal m form a class: grouped by a
hash of both first, and by the vectors themselves, so equal hashes alone never join two classes.  Each class is
scored once against every item.  A class of rank below k by (score, smallest id) has k better documents ahead of all
its members, so only the k best classes of an item are expanded into their members, by ascending id.

Words are maximal runs of ASCII digits, ASCII letters (A-Z folded) and all other characters beyond ASCII.  With N
documents that have a word, L words in all, n words in a document, a word's weight is
floor(1000 ln((2N+2)/(2df+1))), m = 25 + (75 n N div L), and a score sums weight * (10^9 tf div (1000 tf + 8 m)).

Items are read in blocks whose vocabulary is under `BLOCK_BYTES`, which bounds what is broadcast at a time (one item
makes a block of its own if it is larger); each block is one pass over the documents.

Defined cases: null texts and texts without words match nothing and count in neither N nor L; of rows that repeat an id
each is a document; null ids rank last; rows of `items` with one id (null is one) are one item; an item without words, or
whose words nobody has, has no rows; empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidebar.llm.spans import Words, byte_table, word_array, word_slices
from tidebar.llm.tables import bounded_batches, removed, small_or_shuffled, written
from tidebar.llm.words import LOWER
from tidebar.session import scratch_path

NORM, SHARE, SCALE = 100, 75, 8
BLOCK_BYTES = 8 << 20
SCORE_CELLS = 1 << 21
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def _ids(words: Words, vocabulary: pa.Array) -> np.ndarray:
    """The vocabulary number of each word, -1 for others; Arrow compares the bytes themselves."""
    found = pc.index_in(word_array(LOWER[words.data], words.starts, words.ends), value_set=vocabulary)
    return found.fill_null(-1).to_numpy()


def bags(texts: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text: number of words, vocabulary numbers it has in ascending order, how often."""
    size = max(1, len(vocabulary))
    total, open_ids, open_tf = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for words in word_slices(texts, BREAKS):
        ids = _ids(words, vocabulary)
        rows = words.last - words.first + 1
        n_words = np.bincount(words.rows - words.first, minlength=rows)
        keys, tf = np.unique(((words.rows - words.first) * size + ids)[ids >= 0], return_counts=True)
        edges = np.searchsorted(keys, np.arange(rows + 1) * size)
        for k in range(rows):
            total += int(n_words[k])
            mine, often = keys[edges[k]:edges[k + 1]] - k * size, tf[edges[k]:edges[k + 1]]
            if len(open_ids):
                both, where = np.unique(np.concatenate([open_ids, mine]), return_inverse=True)
                mine, often = both, np.bincount(where, np.concatenate([open_tf, often])).astype(np.int64)
            if words.ended or k < rows - 1:
                yield total, mine, often
                total, open_ids, open_tf = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                open_ids, open_tf = mine, often


def vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (words), ids, tf of every row that has a word; one scan, no shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        for batch in batches:
            found = list(bags(batch.column(1), shared.value))
            n = np.array([x[0] for x in found], np.int64)
            offsets = np.r_[0, np.cumsum([len(x[1]) for x in found])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[k] for x in found]).astype(np.int32)))
                     for k in (1, 2)] if found else [pa.array([], pa.list_(pa.int32()))] * 2
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "ids", "tf"])
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n long, ids array<int>, tf array<int>")


class Items:
    """Weighted words of a block of items, as one flat list cut into items."""

    def __init__(self, numbers: np.ndarray, words: np.ndarray, weights: np.ndarray):
        order = np.lexsort([words, numbers])
        self.words, self.weights = words[order], weights[order]
        self.numbers, self.first = np.unique(numbers[order], return_index=True)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Scores of classes (rows: value of each vocabulary word) for every item, in whole numbers."""
        return np.add.reduceat(values[:, self.words] * self.weights, self.first, axis=1)


@lru_cache(maxsize=1)
def _items(packed: bytes) -> Items:
    table = pa.ipc.open_stream(packed).read_all()
    return Items(*(table[c].to_numpy() for c in ("item", "word", "weight")))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def best_classes(classes: DataFrame, weighted: pa.Table, vocabulary_size: int, k: int) -> DataFrame:
    """item, score, class_id and hash of the k best classes of every item within each task."""
    shared = classes.sparkSession.sparkContext.broadcast(_packed(weighted))

    def score(batches):
        items = _items(shared.value)
        step = max(1, SCORE_CELLS // max(vocabulary_size, len(items.words)))
        least = np.ones(len(items.numbers), np.int64)            # a score under this is no longer among the k best
        held = None
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).to_numpy()
            ids, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("ids", "tf"))
            value = 1_000_000_000 * tf // (1000 * tf + SCALE * np.repeat(batch.column("m").to_numpy(), sizes))
            row, edges = np.repeat(np.arange(len(sizes)), sizes), np.r_[0, np.cumsum(sizes)]
            for a in range(0, len(sizes), step):
                b = min(len(sizes), a + step)
                mine = slice(edges[a], edges[b])
                values = np.zeros((b - a, vocabulary_size), np.int64)
                values[row[mine] - a, ids[mine]] = value[mine]
                scores = items.scores(values)
                if b - a > k:
                    least = np.maximum(least, np.partition(scores, b - a - k, axis=0)[b - a - k])
                r, c = np.nonzero(scores >= least)
                at = pa.array(r + a)
                fresh = pa.table({"item": items.numbers[c], "score": scores[r, c],
                                  "class_id": batch.column("class_id").take(at), "hash": batch.column("hash").take(at)})
                held = _top(fresh if held is None else pa.concat_tables([held, fresh]), k)
                item, points = held["item"].to_numpy(), held["score"].to_numpy()
                full = np.flatnonzero(np.bincount(np.searchsorted(items.numbers, item), minlength=len(least)) == k)
                last = np.searchsorted(item, items.numbers[full], "right") - 1
                least[full] = np.maximum(least[full], points[last])
        if held is not None:
            yield from held.combine_chunks().to_batches()

    kind = classes.schema["class_id"].dataType.simpleString()
    rows = classes.select("class_id", "hash", "m", "ids", "tf").where(F.size("ids") > 0)
    return rows.mapInArrow(score, f"item long, score long, class_id {kind}, hash long")


def _top(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each item: score descending, then id ascending with nulls last."""
    rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("class_id", "ascending")]))
    item = rows["item"].to_numpy()
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return rows.filter(pa.array(place < k))


def _first(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key.  Equal keys are spread by a hash of the id first, so a key with a third of all
    rows is cut down in many tasks, and only their k each meet."""
    spread = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(64))
    place = F.row_number().over(Window.partitionBy(*by, spread).orderBy(*order))
    rows = rows.withColumn("place", place).where(F.col("place") <= k)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, word, often: the words of every item."""
    upper = "".join(map(chr, range(65, 91)))
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), upper, upper.lower()), F.lit(WORD), F.lit(0))
    return items.select(F.col(item_id).alias("item_id"), F.explode(found).alias("word")).groupBy("item_id", "word").agg(
        F.count("*").alias("often"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item with a score above 0."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "bags")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    wanted = written(item_words(items, item_id, item_text), "items", folder)
    size = wanted.select(F.sum(F.octet_length("word") + 24).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64(F.col("item_id")), F.lit(max(blocks, 1)))
    found = [_block(docs, wanted.where(block == b), k, folder) for b in range(blocks)]
    schema = T.StructType([wanted.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"],
                           T.StructField("score", T.LongType())])
    out = written(reduce(DataFrame.unionByName, [x for x in found if x], spark.createDataFrame([], schema)), "ranked")
    removed(spark, folder)
    return out


def _block(docs: DataFrame, wanted: DataFrame, k: int, folder: str) -> DataFrame | None:
    """item_id, rank, doc_id, score for the items of one block; None where no document has a word."""
    spark = docs.sparkSession
    items = wanted.toArrow().combine_chunks()                       # one block: about BLOCK_BYTES
    if not len(items):
        return None
    words = items["word"].combine_chunks().cast(pa.large_binary()).dictionary_encode()
    vocabulary, ids = words.dictionary, items["item_id"].combine_chunks().dictionary_encode("encode")
    rows = written(vectors(docs, vocabulary), "vectors", folder)
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    if not total["docs"]:
        return None
    counted = rows.select(F.explode("ids").alias("word")).groupBy("word").count().toArrow()      # one row per word
    df = np.zeros(len(vocabulary), np.int64)
    df[counted["word"].to_numpy()] = counted["count"].to_numpy()
    weight = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64)
    word = words.indices.to_numpy().astype(np.int64)
    weighted = pa.table({"item": ids.indices.to_numpy().astype(np.int64), "word": word,
                         "weight": weight[word] * items["often"].to_numpy()})
    m = F.expr(f"{NORM - SHARE} + ({SHARE} * n * {total['docs']}L) div {total['words']}L")
    rows = rows.withColumn("m", m).withColumn("hash", F.xxhash64("m", "ids", "tf"))
    classes = rows.where(F.size("ids") > 0).groupBy("hash", "m", "ids", "tf").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, "classes", folder)
    best = best_classes(classes, weighted, len(vocabulary), k)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("class_id")))
    best = written(best.withColumn("place", place).where(F.col("place") <= k).drop("place"), "best", folder)
    # at most k classes an item: their vectors, then their members by hash and whole vector, then the first k of each
    chosen = best.select("hash", "class_id").distinct()
    same = classes["class_id"].eqNullSafe(chosen["class_id"]) & (classes["hash"] == chosen["hash"])
    chosen = written(classes.join(chosen, same, "left_semi"), "chosen", folder)
    members = rows.select("doc_id", "hash", "m", "ids", "tf").join(
        small_or_shuffled(chosen, 8 * F.size("ids") + 64), ["hash", "m", "ids", "tf"])
    members = _first(members.select("hash", "class_id", "doc_id"), ["hash", "class_id"], [F.asc_nulls_last("doc_id")], k)
    members = members.select(F.col("hash").alias("of"), F.col("class_id").alias("of_id"), "doc_id")
    ranked = best.join(members, (F.col("hash") == F.col("of")) & F.col("class_id").eqNullSafe(F.col("of_id")))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = ranked.withColumn("rank", place).where(F.col("rank") <= k)
    names = pa.table({"item": np.arange(len(ids.dictionary)), "item_id": ids.dictionary})
    names = spark.createDataFrame(names).select("item", F.col("item_id").cast(wanted.schema["item_id"].dataType))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
