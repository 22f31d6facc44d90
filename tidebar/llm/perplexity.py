"""Quality by the perplexity of an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

The model counts grams of `ORDER` bytes in all trusted documents (no sample: its counts grow with the input), and
below them how many different bytes precede each shorter gram.  Discounts come from the counts of counts of each
order.  A gram is one bigint, its context a shift and its suffix a mask, so the probabilities of an order are joins of
its counts with its contexts and with the probabilities of the order below, spread by gram.

All grams of all documents get a probability; the table is cut into shards under `SHARD_GRAMS` grams, each broadcast
by itself.  One scan of the texts adds up the code length of a text over all shards; no text is shuffled.  One trusted
document in `FOLDS` is not learned from: a language's threshold is the `QUANTILE` of the bits per byte of these,
counted in bins of 1/1000 bit, plus `SLACK` bits for what a few of them don't show; languages without any take that of
all.  A document above its threshold is not kept.

Defined cases: null and empty texts have no perplexity and are not kept; a null language is a group of its own; without
trusted documents everything with text is kept and has 256 as perplexity; labels of unknown documents and repeated
labels change nothing; repeated documents each count and are each returned; columns but the text
pass through, those named like a result are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.llm.tables import bounded_batches, carried, small_or_shuffled, written
from tidebar.llm.words import byte_grams, text_slices

ORDER = 4
QUANTILE = 0.995
FOLDS = 5
SLACK = 0.2
LEAST_DISCOUNT = 0.05
SHARD_GRAMS = 2_000_000
_COUNT_SLICE = 4 << 20


def gram_table(docs: DataFrame) -> DataFrame:
    """gram and how often it stands in trusted text, for every gram of any text (columns text, trusted)."""
    def count(batches):
        for batch in batches:
            trusted = np.array(batch.column(1).to_pylist(), bool)
            for first, end, data, offsets in text_slices(batch.column(0), _COUNT_SLICE):
                grams = byte_grams(data, offsets, ORDER - 1)
                good = np.repeat(trusted[first:end], np.diff(offsets))
                gram, where = np.unique(grams, return_inverse=True)
                n = np.bincount(where, good, len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

    return docs.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    # where a count of counts is missing, absolute discounting by y stands in
    # and some mass always goes to unseen bytes
    return [min(max(k - (k + 1) * y * b / a, LEAST_DISCOUNT), k) if a and b else min(y, k) for k, a, b in pairs]


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, p for every gram of the table."""
    counts = {ORDER: grams.where("n > 0")}
    wanted = {ORDER: grams.select("gram")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = counts[order + 1].select(_suffix(order).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        wanted[order] = wanted[order + 1].select(_suffix(order).alias("gram")).distinct()
    lower = None
    for order in range(1, ORDER + 1):
        d = _discounts(counts[order])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", 8)
        seen = counts[order].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("free"))
        rows = (wanted[order].withColumn("context", context).join(counts[order], "gram", "left")
                .join(seen, "context", "left"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", _suffix(order - 1)).join(
                lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        own = F.coalesce((F.col("n") - cut) / F.col("total"), F.lit(0.0))
        lower = rows.select("gram", F.when(F.col("total").isNull(), F.col("below")).otherwise(
            own + F.col("free") / F.col("total") * F.col("below")).alias("p"))
    return lower


@lru_cache(maxsize=64)
def _shard(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(packed).read_all()
    return table["gram"].to_numpy(), table["bits"].to_numpy()


def code_length(docs: DataFrame, probs: DataFrame, text: str) -> Column:
    """The bits of a whole text: the sum over the model's shards, each broadcast under its bound."""
    spark = docs.sparkSession
    shards = 1 + probs.count() // SHARD_GRAMS
    bits = probs.select("gram", (-F.log2("p")).cast("float").alias("bits"),
                        F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"))
    total = None
    for k in range(shards):
        table = bits.where(F.col("shard") == k).select("gram", "bits").toArrow().combine_chunks().sort_by("gram")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        udf = _adder(spark.sparkContext.broadcast(sink.getvalue().to_pybytes()))
        part = udf(F.col(text).cast("string"))
        total = part if total is None else total + part
    return total


def _adder(shared):
    def add(texts: pa.Array) -> pa.Array:
        known, bits = _shard(shared.value)
        out = np.zeros(len(texts))
        for first, end, data, offsets in text_slices(texts):
            grams = byte_grams(data, offsets, ORDER - 1)
            if len(known) and len(grams):
                at = np.searchsorted(known, grams)
                at[at == len(known)] = 0
                run = np.r_[0.0, np.cumsum(np.where(known[at] == grams, bits[at], 0), dtype=np.float64)]
                out[first:end] = run[offsets[1:]] - run[offsets[:-1]]
        return pa.array(out)

    return F.arrow_udf(add, "double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             quantile: float = QUANTILE) -> DataFrame:
    """`docs` without its text, with n_bytes, perplexity (per byte), threshold and kept.  `labels` has the ids of
    trusted documents, in a column named like the documents' id."""
    bounded_batches(docs.sparkSession)
    trusted = labels.select(F.col(doc_id).alias("trusted_id")).where("trusted_id is not null").distinct()
    trusted = small_or_shuffled(trusted, F.lit(24))
    rows = docs.select(carried(docs, text.lower(), "n_bytes", "perplexity", "threshold", "kept").alias("row"), F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"),
                       F.col(text).cast("string").alias("text"))
    rows = rows.join(trusted, F.col("id") == F.col("trusted_id"), "left").select(
        "row", "lang", "text", F.col("trusted_id").isNotNull().alias("trusted"),
        (F.pmod(F.xxhash64("trusted_id"), F.lit(FOLDS)) == 0).alias("aside"))
    grams = written(gram_table(rows.select("text", (F.col("trusted") & ~F.col("aside")).alias("trusted"))), "grams")
    probs = written(probabilities(grams), "probabilities")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    scored = written(rows.select("row", "lang", (F.col("trusted") & F.col("aside")).alias("aside"), n.alias("n_bytes"), code_length(rows, probs, "text").alias("bits")),
                     "scored")
    scored = scored.withColumn("per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))
    good = scored.where("aside and per_byte is not null")
    bins = good.groupBy("lang", F.floor(F.col("per_byte") * 1000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("every", F.lit(False)).unionByName(
        bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n",
                                                              F.lit(True).alias("every")))
    group = Window.partitionBy("every", "lang")
    reached = (F.sum("n").over(group.orderBy("bin")) >= F.ceil(F.sum("n").over(group) * quantile)).alias("reached")
    limits = bins.select("every", "lang", "bin", reached).where("reached").groupBy("every", "lang").agg(
        ((F.min("bin") + 1) / 1000 + SLACK).alias("limit"))
    common = limits.where("every").first()
    common = common["limit"] if common else 8.0
    limits = limits.where("not every").select(F.col("lang").alias("limit_lang"), "limit")
    limits = small_or_shuffled(written(limits, "limits"), F.lit(64))            # one row per language
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    limit = F.coalesce("limit", F.lit(common))
    return out.select("row.*", "n_bytes", F.exp(F.col("per_byte") * np.log(2)).alias("perplexity"),
                      F.exp(limit * np.log(2)).alias("threshold"),
                      F.coalesce(F.col("per_byte") <= limit, F.lit(False)).alias("kept"))
