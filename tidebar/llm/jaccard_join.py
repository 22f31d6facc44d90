"""Components of documents whose sets of word n-grams are similar, by a token-group matrix.

Two sets link if their Jaccard similarity is at least `percent` / 100, exactly.  A component is what links reach, so
links inside what is connected already need not be tested.

1. Each text becomes a set of hashed n-grams.  Equal sets are one set from here on.
2. A global order of n-grams, rare ones first, comes from a table of counters over all n-grams of the corpus, one per
   `COUNTER_BYTES` of text between 2**18 and 2**22, which is a broadcast of 32 MB (any order is exact, this one is
   selective).  Similar sets share an n-gram in their prefixes of that order.
3. Sets that share a prefix n-gram with others are partitioned into groups of similar ones, by the smallest hash of
   their n-grams.  Large groups are cut into parts of about `PART` sets, and each part also gets the group's first set.
4. In a part, sets are taken one by one.  Each component found so far holds the union of its n-grams; a set that has
   too few n-grams in that union cannot link to any member, and the component stays closed.  Opened ones are compared
   exactly, up to the first link.
5. The matrix of prefix n-grams against parts of components then tells which parts could link to a set of a smaller
   component, by the sizes and by the places of the n-gram in both prefixes.  The set is sent there; the union bound and the comparison as above.  Sets that ask a part
   are cut into slices of about `PART`, each with a copy of the part.  At first only the largest component
   of each n-gram is asked, so that a crowd of copies is one component before all others are asked.

Frequent n-grams are spread by a salt before they are grouped, groups are bounded, and only minima are taken over
unbounded keys.  Nothing is capped: a frequent n-gram is checked like any other.

Defined cases: a text with fewer words than n is one n-gram, without words it has an empty set and stays alone; null
texts are without words; rows with equal ids and different texts are members of their own; a component is named by the
smallest non-null id; a text of rows without an id only links to nothing; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebar.llm import words as W
from tidebar.llm.components import connected
from tidebar.llm.tables import bounded_batches, removed, written
from tidebar.session import scratch_path

BUCKETS, MOST_BUCKETS = 1 << 18, 1 << 22
COUNTER_BYTES = 2048
SALTS = 64
HOT = 16              # an n-gram in a bucket with so many times the mean count is salted
PART = 256
ROWS = "token long, salt int, set_id long, size int, place int"


def text_sets(texts: pa.Array, n: int):
    """For each text, its sorted distinct n-gram hashes (A-Z as a-z)."""
    for first, end, data, offsets in W.text_slices(texts):
        starts, ends, index = W.word_bounds(data, offsets)
        hashes = W.word_hashes(data, starts, ends, lower=True)
        for i in range(end - first):
            own = hashes[index[i]:index[i + 1]]
            if len(own) >= n:
                yield np.unique(W.gram_hashes(own, n))
            elif len(own):
                yield W.sequence_hash(own, np.array([0]), np.array([len(own)]))
            else:
                yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """Digest of a set with its size."""
    return int(W.signed(W.sequence_hash(grams, np.array([0]), np.array([len(grams)])))[0])


def counters(docs: DataFrame) -> int:
    """How many counters of n-grams a corpus gets: a power of two, in proportion to its bytes."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(max(BUCKETS, 1 << (size // COUNTER_BYTES).bit_length()), MOST_BUCKETS)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def profile(docs: DataFrame, n: int, buckets: int = BUCKETS) -> DataFrame:
    """One row per document (doc, text_key, set_id, size, group: the smallest hash) and, per task, counts of n-grams by
    bucket (bucket, n).  `docs`: doc, text_key, text."""
    def scan(batches):
        counts = np.zeros(buckets, np.int64)
        names = ["doc", "text_key", "set_id", "size", "group", "bucket", "n"]
        for batch in batches:
            ids, sizes, groups = [], [], []
            for grams in text_sets(batch.column(2), n):
                sizes.append(len(grams))
                ids.append(set_id(grams) if len(grams) else None)
                groups.append(int(W.signed(W.mix(grams).min(keepdims=True))[0]) if len(grams) else None)
                np.add.at(counts, _bucket(grams, buckets), 1)
            empty = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()),
                                              pa.array(groups, pa.int64()), *empty], names=names)
        used = np.flatnonzero(counts)
        none = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array(counts[used])], names=names)

    return docs.mapInArrow(scan, "doc long, text_key long, set_id long, size int, group long, bucket int, n long")


def frequencies(spark: SparkSession, found: DataFrame, buckets: int = BUCKETS) -> bytes:
    """The counters of all buckets, a table of bounded size."""
    table = found.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts.tobytes()


def prefixes(docs: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """ROWS of every set: its prefix n-grams and their places in the order; a task gives equal sets once."""
    def scan(batches):
        frequency = np.frombuffer(counts.value, np.int64)
        hot, seen = HOT * (1 + frequency.sum() // len(frequency)), set()
        for batch in batches:
            out = []
            for grams in text_sets(batch.column(0), n):
                size, name = len(grams), set_id(grams) if len(grams) else None
                if not size or name in seen:
                    continue
                seen.add(name)
                keep = size + (-percent * size) // 100 + 1
                often = frequency[_bucket(grams, len(frequency))]
                order = np.lexsort((grams, often))[:keep]
                salt = np.where(often[order] > hot, 1 + name % SALTS, 0).astype(np.int32)
                out.append((grams[order], salt, np.full(keep, name), np.full(keep, size, np.int32), np.arange(keep, dtype=np.int32)))
            if out:
                token, salt, name, size, place = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(token)), pa.array(salt), pa.array(name), pa.array(size), pa.array(place)],
                    names=["token", "salt", "set_id", "size", "place"])

    return docs.select("text").mapInArrow(scan, ROWS)


class Groups:
    """Components of the sets seen so far, each with the union of its n-grams."""

    def __init__(self, percent: int):
        self.percent, self.parts = percent, []     # [members, union, names]

    def links(self, grams: np.ndarray, skip=None) -> list[int]:
        """Places of the components with a member that links to the set."""
        need, out = self.percent * len(grams), []
        for place, (members, union, _) in enumerate(self.parts):
            if skip is not None and skip(place):
                continue
            if 100 * _common(grams, union) < need:
                continue
            for other in members:
                if self.percent * max(len(other), len(grams)) > 100 * min(len(other), len(grams)):
                    continue
                both = _common(grams, other)
                if 100 * both >= self.percent * (len(grams) + len(other) - both):
                    out.append(place)
                    break
        return out

    def add(self, grams: np.ndarray, name: int) -> None:
        found = self.links(grams)
        members, names, unions = [grams], [name], [grams]
        for place in reversed(found):
            old = self.parts.pop(place)
            members, names = old[0] + members, old[2] + names
            unions.append(old[1])
        union = grams if len(unions) == 1 else np.unique(np.concatenate(unions))
        self.parts.append([members, union, names])


def _common(grams: np.ndarray, sorted_others: np.ndarray) -> int:
    at = np.searchsorted(sorted_others, grams)
    at[at == len(sorted_others)] = 0
    return int(np.count_nonzero(sorted_others[at] == grams))


def within_parts(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """set_id, other: each set with a member of its component in its part."""
    def work(table: pa.Table) -> pa.Table:
        names = table["set_id"].to_pylist()
        grams = list(text_sets(table["text"].combine_chunks(), n))
        groups, done = Groups(percent), set()
        for i in sorted(range(len(names)), key=lambda i: (len(grams[i]), names[i])):
            if names[i] not in done:
                done.add(names[i])
                groups.add(grams[i], names[i])
        pairs = [(x, min(part[2])) for part in groups.parts for x in part[2]]
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["set_id", "other"])

    return sets.groupBy("group", "part").applyInArrow(work, "set_id long, other long")


def across_parts(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """set_id, other: links of the sets that ask a part to members of other components in it.  `rows`: set_id,
    component, asks, text, group, part, slice."""
    def work(table: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        asking, grams = [], text_sets(table["text"].combine_chunks(), n)
        for name, component, asks, own in zip(*(table[c].to_pylist() for c in ("set_id", "component", "asks")), grams):
            if asks:
                asking.append((name, component, own))
            else:
                part = parts.setdefault(component, [[], None, []])
                part[0].append(own)
                part[2].append(name)
        groups, ids, out = Groups(percent), list(parts), []
        for part in parts.values():
            groups.parts.append([part[0], np.unique(np.concatenate(part[0])), part[2]])
        for name, component, own in asking:
            for place in groups.links(own, lambda p, c=component: ids[p] == c):
                out.append((name, groups.parts[place][2][0]))
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["set_id", "other"])

    return rows.groupBy("group", "part", "slice").applyInArrow(work, "set_id long, other long")


def sliced(sent: DataFrame, opened: DataFrame) -> DataFrame:
    """set_id, component, group, part, asks, slice: the sets that ask a part in slices of about PART, and the part's own
    sets in each slice."""
    part = ["group", "part"]
    slices = sent.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("slices"))
    asking = sent.join(slices, part).select("set_id", "component", *part, F.lit(True).alias("asks"),
                                            F.pmod(F.xxhash64("set_id", "part"), F.col("slices")).cast("int").alias("slice"))
    asked = opened.join(slices, part).select("set_id", "component", *part, F.lit(False).alias("asks"),
                                             F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return asking.unionByName(asked)


def _places(members: DataFrame) -> DataFrame:
    """set_id, group, part, members (of the group), own: parts of about PART sets; a group's first set is in each."""
    cuts = members.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("set_id").alias("first"))
    cuts = cuts.withColumn("cuts", F.ceil(F.col("members") / PART).cast("long"))
    own = members.join(cuts, "group").select("set_id", "group", F.pmod(F.xxhash64("set_id"), F.col("cuts")).alias("part"),
                                             "members", F.lit(True).alias("own"))
    first = cuts.where("cuts > 1").select(
        F.col("first").alias("set_id"), "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("part"),
        "members", F.lit(False).alias("own"))
    return own.unionByName(first)


def _matrix_links(shared: DataFrame, texts: DataFrame, known: DataFrame, n: int, percent: int, largest: bool,
                  folder: str) -> DataFrame:
    """Links between components, by the matrix of prefix n-grams against parts of components.  A set asks the parts of
    components larger than its own (ties: by number) that hold one of its prefix n-grams in a set of fitting size;
    with `largest`, only those of the largest component of the n-gram."""
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    places = (texts.select("set_id").join(known, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
              .join(sizes, "component", "left").withColumn("members", F.coalesce("members", F.lit(1))))
    cuts = F.ceil(F.col("members") / PART).cast("long")
    places = places.select("set_id", F.struct("members", "component").alias("rank"), F.col("component").alias("group"),
                           F.pmod(F.xxhash64("set_id"), cuts).alias("part"))
    rows = shared.join(places.select("set_id", "rank", "group", "part"), "set_id")
    torn = rows.groupBy("token").agg(F.min("rank").alias("a"), F.max("rank").alias("top")).where("a < top").drop("a")
    rows = written(rows.join(torn, "token"), "torn", folder)
    holders = rows.where(F.col("rank") == F.col("top")) if largest else rows
    # a link of sizes x and y needs percent * (x + y) / (100 + percent) common n-grams, so a first common one at place
    # i of x has (100 + percent) * i <= 100 * x - percent * y
    reach = 100 * F.col("size") - (100 + percent) * F.col("place")
    matrix = holders.groupBy("token", "group", "part", "rank").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max(reach).alias("reach"))
    q, m = rows.withColumn("own_reach", reach).alias("q"), matrix.alias("m")
    sent = q.join(m, (F.col("q.token") == F.col("m.token")) & (F.col("q.rank") < F.col("m.rank"))
                  & (100 * F.col("q.size") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("q.size"))
                  & (F.col("q.own_reach") >= percent * F.col("least")) & (F.col("m.reach") >= percent * F.col("q.size")))
    sent = written(sent.select("q.set_id", F.col("q.group").alias("component"), "m.group", "m.part").distinct(), "sent", folder)
    opened = places.select("set_id", F.col("group").alias("component"), "group", "part")
    return across_parts(sliced(sent, opened).join(texts.select("set_id", "text"), "set_id"), n, percent)


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "jaccard")
    bounded_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("text_key"),
                       F.col(text).cast("string").alias("text"))
    buckets = counters(docs)
    found = written(profile(docs, n, buckets), "sets", folder)
    counts = spark.sparkContext.broadcast(frequencies(spark, found, buckets))
    names = found.where("bucket is null").select("doc", "text_key", "set_id", "size", "group")

    # prefix n-grams that several sets share; a salted one is shared across salts
    met = Window.partitionBy("token", "salt")
    rows = prefixes(docs, n, percent, counts).repartition("token", "salt").dropDuplicates(["token", "salt", "set_id"])
    rows = rows.withColumn("first", F.min("set_id").over(met)).withColumn("last", F.max("set_id").over(met))
    shared = written(rows.where("first < last or salt > 0").select("token", "set_id", "size", "place"), "prefixes", folder)

    bearer = names.where("set_id is not null and doc is not null").groupBy("set_id").agg(
        F.min(F.struct("doc", "text_key")).alias("at"), F.min("group").alias("group"))
    wanted = bearer.join(shared.select("set_id").distinct(), "set_id").select("at.*", "set_id", "group")
    on = ["doc", "text_key"]                    # rows repeated as a whole give one
    texts = docs.join(wanted, on).groupBy(*on, "set_id", "group").agg(F.max("text").alias("text")).drop(*on)
    texts = written(texts, "texts", folder)

    members = _places(texts.select("set_id", "group")).where("members > 1")
    links = within_parts(members.join(texts.select("set_id", "text"), "set_id"), n, percent).where("set_id <> other")
    known = written(connected(links, "set_id", "other", folder).withColumnRenamed("node", "set_id"), "known", folder)

    # first only against the largest component of each n-gram, which takes in most; then against all
    for largest in (True, False):
        links = _matrix_links(shared, texts, known, n, percent, largest, folder)
        links = links.unionByName(known.select("set_id", F.col("component").alias("other")))
        known = written(connected(links, "set_id", "other", folder).withColumnRenamed("node", "set_id"), "known", folder)
    final = known

    rows = names.join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    found = written(rows.join(least, "component", "left").select(
        F.col("doc").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("least", "doc").alias("component_id")), "components")
    removed(spark, folder)
    return found
