"""Frequent phrases and their collocation scores, by partitioning (SON).

The documents of a language are dealt into `SHARDS` shards.  A phrase found `support` times in all of them must reach, in
one shard at least, the share of `support` that this shard has of all words.  So every shard is mined completely at its
own, proportionally lower support; the union of what is frequent somewhere holds every frequent phrase; and one more
pass counts the union exactly.

* A shard is no task: it is mined level by level (phrases of one word, two, ...) as a grouped sum of counts by (shard,
  language, phrase), which tasks add up before they are shuffled.  So memory is bounded at every size and a very
  frequent phrase is one row per task.  A level counts only phrases whose two shorter parts are in the union.
* The union of a level is a bitmap of hashes, combined in Spark; its size follows the number of words up to 4 MB a level.
  A wrong hit only lets one more phrase be counted.
* Mining may use hashes of phrases, as a clash only adds up counts and so keeps more; they have some 8 bits more than it takes
  to number the words of the corpus.  The last pass counts the words themselves, so results are exact.
* Few shards keep the union close to what is frequent; as none has to fit a task, their number need not grow.

Scores need the counts of the parts of a phrase; these are at least as frequent, so they are in the result of the last pass.
Products are decimals of 38 digits.

Defined cases: a null text is empty, a null language is `und`; repeated rows and rows with null ids count each; extra
columns are left out; empty tables give no rows; a piece or a text may have any length, as words go on from one chunk of
`CHUNK_WORDS` to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebar.llm.spans import byte_table, word_array, word_slices
from tidebar.llm.tables import bounded_batches, removed, small_or_shuffled, written
from tidebar.llm.words import LOWER, mix, word_hashes
from tidebar.session import scratch_path

SHARDS = 4
CHUNK_WORDS = 1 << 18
BITS_LEAST, BITS_MOST = 1 << 20, 1 << 25
UNKNOWN = "und"
STOPS = byte_table(b".,;:!?\n\x0b\x0c\r")
BREAKS = STOPS | byte_table(b" \t")
_STEP = np.uint64(0x9E3779B97F4A7C15)
OUT_ROWS = 1 << 16


class Chunk:
    """Consecutive words of many texts: a hash, a piece number, a language number, and (if asked for) the words."""

    def __init__(self, keep_words: bool):
        self.keep_words = keep_words
        self.langs: dict[str, int] = {}
        self.hashes, self.pieces, self.lang, self.words = [], [], [], []
        self.n = self.piece = 0

    def add(self, words, langs: np.ndarray) -> None:
        """Words of a slice; `langs` of each.  A piece ends at a stop and with its text, not with a slice."""
        base = self.piece + int(words.begins)
        stops = np.cumsum(STOPS[words.data])
        if len(words.starts):
            self.pieces.append((base + stops[words.starts] + (words.rows - words.first)).astype(np.int32))
            self.hashes.append(word_hashes(words.data, words.starts, words.ends, lower=True))
            self.lang.append(langs)
            if self.keep_words:
                self.words.append(word_array(LOWER[words.data], words.starts, words.ends))
            self.n += len(words.starts)
        self.piece = base + (int(stops[-1]) if len(stops) else 0) + words.last - words.first

    def taken(self, hold: int):
        """Everything but the last `hold` words as places where a phrase may begin, followed by those; the chunk goes
        on with the held words."""
        hashes, pieces, lang = (np.concatenate(x) for x in (self.hashes, self.pieces, self.lang))
        words = pa.concat_arrays(self.words) if self.keep_words else None
        hold = min(hold, self.n)
        own = self.n - hold
        # small copies, so that what is held does not keep the chunk in memory; pieces are numbered anew from here
        floor = int(pieces[own]) if hold else 0
        self.hashes, self.pieces, self.lang = [hashes[own:].copy()], [pieces[own:] - floor], [lang[own:].copy()]
        self.words = [pa.array(words.slice(own).to_pylist(), pa.large_binary())] if self.keep_words else []
        self.piece -= floor
        self.n = hold
        return hashes, pieces, lang, words, own


def _chunks(batches, keep_words: bool, longest: int, size: int):
    """(languages, hashes, pieces, language numbers, words, places that may begin a phrase) of some `size` words."""
    chunk = Chunk(keep_words)
    for batch in batches:
        names = batch.column(0).to_pylist()
        codes = np.array([chunk.langs.setdefault(x, len(chunk.langs)) for x in names], np.int32)
        for words in word_slices(batch.column(1), BREAKS):
            chunk.add(words, codes[words.rows])
            if chunk.n >= size:
                yield list(chunk.langs), *chunk.taken(longest - 1)
    if chunk.n:
        yield list(chunk.langs), *chunk.taken(0)


def _seeds(langs: list[str]) -> np.ndarray:
    names = pa.array([x.encode() + b"\0" for x in langs], pa.large_binary())
    bounds = np.frombuffer(names.buffers()[1], np.int64)
    return word_hashes(np.frombuffer(names.buffers()[2], np.uint8), bounds[:-1], bounds[1:])


def _member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _levels(langs, hashes, pieces, lang, unions, level: int):
    """Places and hashes of the phrases of 1 to `level` words whose shorter parts are in the unions of their levels."""
    at = np.arange(len(hashes))
    key = mix(hashes ^ _seeds(langs)[lang])
    for k in range(1, level + 1):
        if k > 1:
            good = np.zeros(len(hashes) + 1, bool)
            good[at] = True
            last = at + k - 1
            keep = good[at + 1] & (last < len(hashes))
            at, key, last = at[keep], key[keep], last[keep]
            keep = pieces[last] == pieces[at]
            at, key, last = at[keep], key[keep], last[keep]
            key = mix(key * _STEP + hashes[last])
        if k <= len(unions):
            keep = _member(unions[k - 1], key)
            at, key = at[keep], key[keep]
        yield k, at, key


def shard_counts(texts: DataFrame, unions, level: int, width: int = 64) -> DataFrame:
    """shard, lang, gram (the first `width` bits of a hash), n: every phrase of `level` words that may be frequent, summed
    by shard."""
    size = CHUNK_WORDS

    def count(batches):
        for langs, hashes, pieces, lang, _, own in _chunks(batches, False, level, size):
            *_, (_, at, key) = _levels(langs, hashes, pieces, lang, unions.value if unions else [], level)
            key, first, n = np.unique(key[at < own] >> np.uint64(64 - width), return_index=True, return_counts=True)
            code = lang[at[at < own][first]]
            names = pa.array(langs, pa.string())
            for a in range(0, len(key), OUT_ROWS):
                b = slice(a, a + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(code[b])), pa.array(key[b].view(np.int64)),
                                                  pa.array(n[b])], names=["lang", "gram", "n"])

    found = texts.mapInArrow(count, "lang string, gram long, n long")
    shard = F.pmod(F.spark_partition_id(), F.lit(SHARDS))
    return found.withColumn("shard", shard).groupBy("shard", "lang", "gram").agg(F.sum("n").alias("n"))


def union_bits(counts: DataFrame, sizes: DataFrame, support: int, bits: int, width: int) -> np.ndarray:
    """Bitmap of the phrases that reach their shard's part of the support; at most BITS_MOST bits come to the driver."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    frequent = counts.join(sizes, ["shard", "lang"]).where(wide("n") * wide("all_words") >= F.lit(support) * wide("words"))
    place = F.shiftrightunsigned("gram", width - bits.bit_length() + 1)
    maps = frequent.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    maps = maps.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).toArrow()
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for bucket, found in zip(maps["bucket"].to_pylist(), maps["map"].to_pylist()):
        out[bucket] = np.frombuffer(found, np.uint8)
    return out.ravel()


def exact_counts(texts: DataFrame, unions, longest: int) -> DataFrame:
    """lang, phrase, k (words), f: every phrase of the unions, counted by its words."""
    size = CHUNK_WORDS

    def count(batches):
        for langs, hashes, pieces, lang, words, own in _chunks(batches, True, longest, size):
            coded = words.dictionary_encode()
            ids, names = coded.indices.to_numpy().astype(np.int64), pa.array(langs, pa.string())
            bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int64)
            sizes, raw = np.diff(bounds), np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
            number = ids * len(langs) + lang           # of the phrase that begins at each place: equal for equal phrases
            for k, at, _ in _levels(langs, hashes, pieces, lang, unions.value, longest):
                pair = number[at] if k == 1 else number[at] * len(sizes) + ids[at + k - 1]
                _, first, same = np.unique(pair, return_index=True, return_inverse=True)
                number = np.full(len(ids), -1, np.int64)
                number[at] = same
                n = np.bincount(same[at < own], minlength=len(first))
                first = at[first][n > 0]
                n = n[n > 0]
                for a in range(0, len(n), OUT_ROWS):
                    place = first[a:a + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(lang[place])), _phrases(raw, bounds, sizes, ids, place, k),
                         pa.array(np.full(len(place), k, np.int32)), pa.array(n[a:a + OUT_ROWS].astype(np.int64))],
                        names=["lang", "phrase", "k", "n"])

    found = texts.mapInArrow(count, "lang string, phrase string, k int, n long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f"))


def _phrases(raw, bounds, sizes, ids, places, k) -> pa.Array:
    """The phrases of k words that begin at `places`, as strings joined by one space."""
    word = ids[places[:, None] + np.arange(k)]                                  # places x k
    ends = np.cumsum((sizes[word] + 1).ravel())                                 # each word and a space after it
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 0x20, np.uint8)
    flat = sizes[word].ravel()
    inner = np.arange(int(flat.sum())) - np.repeat(np.cumsum(flat) - flat, flat)
    out[np.repeat(ends - flat - 1, flat) + inner] = raw[np.repeat(bounds[:-1][word].ravel(), flat) + inner]
    mask = np.ones(total, bool)
    last = ends[k - 1::k] - 1                                                   # the space after the last word goes
    mask[last] = False
    offsets = np.r_[0, ends[k - 1::k]] - np.arange(len(places) + 1)
    return pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(offsets.astype(np.int64)),
                                                                  pa.py_buffer(out[mask])]).cast(pa.string())


def frequent_phrases(docs: DataFrame, support: int, longest: int = 5, text: str = "text", lang: str = "lang",
                     folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to `longest` words found `support` times; (lang, n) words of all."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    single = written(shard_counts(texts, None, 1), "words", folder)
    words = single.groupBy("shard", "lang").agg(F.sum("n").alias("words"))
    sizes = words.withColumn("all_words", F.sum("words").over(Window.partitionBy("lang")))      # a row per shard and language
    sizes = small_or_shuffled(written(sizes, "sizes", folder), F.octet_length("lang") + 32)
    total = sizes.agg(F.sum("words").alias("n")).first()["n"] or 0
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << total.bit_length()))
    unions, shared, width = [], None, min(64, max(32, total.bit_length() + 8))
    for level in range(1, longest + 1):
        counts = single if level == 1 else shard_counts(texts, shared, level, width)
        unions.append(union_bits(counts, sizes, support, bits, 64 if level == 1 else width))
        if shared:
            shared.unpersist()
        shared = spark.sparkContext.broadcast(list(unions))
    found = exact_counts(texts, shared, longest).where(F.col("f") >= support)
    return written(found, "phrases", folder), sizes.select("lang", F.col("all_words").alias("n")).distinct()


def scored(found: DataFrame, words: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of phrases of two words and more that no longer one explains.

    A phrase goes if a longer one holds it and is found at least `percent` % as often; as a longer one is never found more
    often than what it holds, phrases one word longer decide."""
    long = found.where("k >= 2")
    part = lambda p: p.select("lang", F.col("phrase"), F.col("f").alias("part"))
    # cuts: every frequent phrase meets the counts of its parts; single words are few, so they are broadcast if they fit
    singles = small_or_shuffled(part(found.where("k = 1")), F.octet_length("phrase") + F.octet_length("lang") + 32)
    longer = part(found.where("k > 1"))
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn(
        "right", F.expr("substring_index(phrase, ' ', cut - k)"))

    def with_part(rows, side, one, name):
        at = lambda table: table.select(F.col("lang"), F.col("phrase").alias(side), F.col("part").alias(name))
        return rows.where(one).join(at(singles), ["lang", side]).unionByName(rows.where(~one).join(at(longer), ["lang", side]))

    cuts = with_part(cuts, "left", F.col("cut") == 1, "l")
    cuts = with_part(cuts, "right", F.col("cut") == F.col("k") - 1, "r")
    cuts = cuts.join(small_or_shuffled(words, F.octet_length("lang") + 32), "lang")
    score = F.expr("(cast(1000 as decimal(5,0)) * cast(f as decimal(16,0)) * cast(n as decimal(16,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "k", F.col("f").alias("a"), "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")
    supers = found.where("k >= 3").select("lang", "f", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    supers = supers.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    out = best.join(supers, ["lang", "phrase"], "left")
    explained = F.coalesce(F.lit(100) * wide("longest") >= F.lit(percent) * wide("a"), F.lit(False))
    return out.where(~explained).drop("longest")


def mine(docs: DataFrame, support: int = 100, longest: int = 5, first: int = 2000, percent: int = 100, text: str = "text",
         lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of each language by score, then count, then bytes."""
    spark: SparkSession = docs.sparkSession
    folder = scratch_path(spark, "phrases")
    found, words = frequent_phrases(docs, support, longest, text, lang, folder)
    rows = scored(found, words, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(64))          # a language with most phrases is cut down in many tasks first
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", spread).orderBy(*order)))
    rows = rows.where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = written(rows.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "mined")
    removed(spark, folder)
    return out
