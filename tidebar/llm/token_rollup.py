"""Token totals kept up to date by signed deltas, committed batch by batch.

A batch is a table of signed counts: an insert adds a document's tokens, a delete takes them away, a revised count
takes the old one away and adds the new one.  Batches are summed by source, language and tokenizer version before
they are stored; totals are additive, so the rollup is the sum over committed batches and no document is read again.

A commit writes the summed deltas under a generation of its own, then one commit record that names it.  A batch id
that has a record is skipped; a writer that died before its record left rows nobody reads, and can simply run
again; of two racing writers the record with the smaller generation counts.  `compact` folds all batches into one.

Defined cases: null sources and languages are groups of their own, null texts count no tokens but do count as
documents, an empty batch commits nothing but its record, repeated rows count each, extra columns are left out.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm.bpe import read_ranks
from tidebar.llm.tables import bounded_batches

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    import base64
    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs},
                             special_tokens={})


BITMAP_LEAST, BITMAP_MOST = 1 << 20, 1 << 26


def likely(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows whose key is among `ids`, and a few others: a filter that shuffles no row.

    Hashes of the ids make a bitmap of some 16 bits an id, 8 MB at most (beyond 4 million ids more others pass); its 4 KB
    pages are broadcast, and a row looks at the bit of its key.  Null keys pass nothing.
    """
    n = ids.count()
    bits = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bits))
    pages = ids.where(F.col(id_column).isNotNull()).select(place(id_column).alias("at")).groupBy(
        F.shiftright("at", 15).alias("bitmap_page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bitmap"))
    rows = rows.withColumn("bitmap_at", F.when(F.col(key).isNotNull(), place(key))).withColumn(
        "bitmap_page", F.shiftright("bitmap_at", 15))
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(F.col("bitmap_at").bitwiseAND(F.lit(32767)), 3).cast("int") + 1,
                                    F.lit(1))), 16, 10).cast("int")
    inside = rows.join(F.broadcast(pages), "bitmap_page").where(
        F.getbit(byte, F.col("bitmap_at").bitwiseAND(F.lit(7)).cast("int")) == 1)
    return inside.drop("bitmap_page", "bitmap_at", "bitmap")


def counter(spark: SparkSession, ranks_path: str, pattern: str):
    """A column function: text -> number of tokens under a vocabulary file."""
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def count(texts: pa.Array) -> pa.Array:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        return pa.array([len(encode(v)) if v else 0 for v in texts.to_pylist()], pa.int64())

    udf = F.arrow_udf(count, "long").asNondeterministic()
    return lambda text: udf(F.col(text).cast("string"))


def counted(docs: DataFrame, count, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            lang: str = "lang") -> DataFrame:
    """doc, source, lang, tokenizer, n_tokens of each document."""
    return docs.select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("source"),
                       F.col(lang).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
                       count(text).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose counts are replaced, under the same or another tokenizer version."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def commits(self) -> DataFrame:
        """batch, generation of every committed batch."""
        found = self._read("commits", "batch string, generation string")
        if found is None:
            return self.spark.createDataFrame([], "batch string, generation string")
        return found.groupBy("batch").agg(F.min("generation").alias("generation"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Store a batch once; False where it is committed already."""
        if self.commits().where(F.col("batch") == batch).take(1):
            return False
        generation = uuid.uuid4().hex
        sums = deltas.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(
            f"{self.path}/deltas")
        self.spark.createDataFrame([(batch, generation)], "batch string, generation string").coalesce(1).write.mode(
            "append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups that came to nothing go."""
        rows = self._read("deltas", DELTA + ", generation string")
        if rows is None:
            return self.spark.createDataFrame([], DELTA)
        rows = rows.join(self.commits(), "generation", "left_semi")
        sums = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, target: str) -> TokenRollup:
        """The same totals as one generation in a new folder; every batch id stays committed there."""
        out, generation = TokenRollup(self.spark, target), uuid.uuid4().hex
        self.totals().withColumn("generation", F.lit(generation)).write.partitionBy("generation").parquet(f"{target}/deltas")
        self.commits().select("batch", F.lit(generation).alias("generation")).write.parquet(f"{target}/commits")
        return out
