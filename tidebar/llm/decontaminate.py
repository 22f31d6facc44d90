"""Benchmark passages in documents, by a prefix-filtered set join in DataFrame operations only.

Words are runs of digits, letters and non-ASCII characters; A-Z count as a-z.  An item's windows are its runs of
`WINDOW` words; an item of fewer words is one window.  A window stands in a document only if its rarest word does, so
that one word is a sufficient prefix of the window:

1. The items' words are counted over all documents, and each window is keyed by its rarest word and that word's place.
2. Every document word is looked up among the prefixes.  The place gives the one position the window can have; a
   position before the text or a window beyond its end is dropped (positional and length bounds).
3. The words there are compared with the window, all of them.

The item side is broadcast only where its measured size is under a bound, and joined by shuffle beyond it.  Hits are
one row each until they are grouped by document; a document's hits are bounded by its own words times the items.

Defined cases: null texts and texts without words have no words, no hits and are not contaminated; items without
words or without an id are left out; items with the same text are each counted; repeated documents are each
returned; an empty benchmark hits nothing; extra columns pass through, those named like a result
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.tables import carried, fits, small_or_shuffled, written

WINDOW = 13
SHARE = 20                       # contaminated where at least one word in SHARE is hit
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text) -> Column:
    """Words as written, in order; none for null."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return F.array_remove(F.split(text, _BETWEEN), "")


def folded(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """item, words of each distinct window of each item."""
    words = items.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), raw_words(F.translate(F.col(text).cast("string"), _UPPER, _LOWER)).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0)) + 1
    starts = words.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(1), last)).alias("s"))
    return starts.select("item", F.slice("w", F.col("s"), F.lit(window)).alias("window")).distinct()


def keyed(wins: DataFrame, words: DataFrame) -> DataFrame:
    """Each window with its rarest word over all documents (ties: the alphabetically first) and that word's place."""
    vocabulary = wins.select(F.explode("window").alias("word")).distinct()
    vocabulary = small_or_shuffled(vocabulary, F.octet_length("word") + 16)
    counts = (words.select(F.explode_outer("w").alias("raw")).select(F.lower("raw").alias("word"))
              .join(vocabulary.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").groupBy("word").count())
    one = wins.select("item", "window", F.posexplode("window").alias("place", "token"))
    ranked = one.join(counts, F.lower("token") == F.col("word"), "left").select(
        "item", "window", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "place").alias("rank"))
    return (ranked.groupBy("item", "window").agg(F.min("rank").alias("rank"))
            .select("item", F.array_join("window", " ").alias("window"), F.size("window").alias("n"),
                    F.lower("rank.token").alias("prefix"), F.col("rank.place").alias("place")))


def _document(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.struct(F.col(doc_id), F.xxhash64(text).alias("k")).alias("doc"), raw_words(text).alias("w"))


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc (id and text hash), item, start and stop (words) of every occurrence of an item's window."""
    words = _document(docs, doc_id, text)
    keys = written(keyed(windows(items, item_id, item_text, window), words), "windows")
    start = F.col("at") - F.col("place")
    if fits(keys, F.octet_length("window") + 100):
        # no lambda before the lookup is done: generator and join stay in one compiled stage, and the words of a
        # document are never copied per word (an outer generator, for an inner one is preceded by a second split)
        at = words.select("doc", "w", F.posexplode_outer("w").alias("at", "raw"))
        met = at.join(F.broadcast(keys), F.lower("raw") == F.col("prefix"))
        met = met.where((start >= 0) & (start + F.col("n") <= F.size("w")))
    else:
        at = words.select("doc", F.size("w").alias("size"), F.posexplode_outer("w").alias("at", "raw"))
        met = at.join(keys, F.lower("raw") == F.col("prefix"))
        met = met.where((start >= 0) & (start + F.col("n") <= F.col("size"))).join(words.dropDuplicates(["doc"]), "doc")
    met = met.where(folded(F.array_join(F.slice("w", start + 1, F.col("n")), " ")) == F.col("window"))
    return met.select("doc", "item", start.alias("start"), (start + F.col("n")).alias("stop"))


def summary(found: DataFrame) -> DataFrame:
    """Per document: the spans of hit words, merged, their number of words, and the items."""
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    grouped = found.groupBy("doc").agg(spans.alias("each"), F.array_sort(F.collect_set("item")).alias("items"))
    # a span adds the words after the end of those before it; ends are a running maximum because windows of one
    # document are sorted by start, and an earlier, longer one may end later
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    total = F.aggregate("each", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], s["stop"]).alias("end")))
    return grouped.select("doc", "items", total["n"].alias("n_hit"))


def annotate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_hit, items (ids as strings, sorted) and contaminated."""
    found = summary(hits(docs, items, doc_id, text, item_id, item_text, window))
    rows = docs.select(carried(docs, "n_words", "n_hit", "items", "contaminated").alias("row"), F.xxhash64(text).alias("k"),
                       F.size(raw_words(text)).cast("long").alias("n_words"))
    same = (F.col(f"row.{doc_id}").eqNullSafe(F.col(f"doc.{doc_id}"))) & (F.col("k") == F.col("doc.k"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return rows.join(found, same, "left").select(
        "row.*", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"))
