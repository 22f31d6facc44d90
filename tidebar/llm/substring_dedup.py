"""Removal of word passages that also stand in an earlier document, by suffix automata of reference shards.

A window is `length` consecutive words.  A word goes if a window that covers it also starts in a document with a
smaller id.  How the work is spread:

1. Every window has a minimiser: the smallest hash of its `GRAM`-word grams.  Consecutive windows with the same one
   form a segment, so equal windows of two documents lie in segments with the same minimiser.  One short row per
   segment is shuffled, some 4 per 100 words.
2. A minimiser of one document only is dropped.  Of equal segments the smallest document owns all.  Where segments
   of a minimiser differ (a passage's edge, a near copy's edit), one segment of each kind is taken apart into its
   windows, and each window gets an owner.  Groups are only ever reduced to a minimum, never gathered.
3. Owners' passages are the reference.  They are dealt into shards of about `SHARD_WORDS` words; the passages of later
   documents are routed to their owner's shard.  The routed words are counted per shard; one with many queries is
   copied to several tasks (salted).
4. A task builds the suffix automaton of its shard, over whole words.  Each state knows the smallest document of
   its end positions.  Routed passages are streamed through it; where the matching statistic reaches `length` in an
   earlier document, the words go.  So hashes choose candidates only, the automaton decides on the words.

Defined cases: null and empty texts have no words and lose none; documents under `length` words lose none, windows
repeated within one document only are kept, a row with a null id loses nothing and is no reference, rows with one id
count as one document and are each returned, extra columns pass through (those named like a result are replaced), an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm import words as W
from tidebar.llm.tables import bounded_batches, carried, written

LENGTH = 50
GRAM = 8
SHARD_WORDS = 100_000
QUERY_WORDS = 400_000


def segments(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH) -> DataFrame:
    """One row per run of windows with the same minimiser: anchor, seg (hash of the words), doc, text_key, start, n windows.
    A row of the corpus is a document id and a text: two texts of one id are told apart everywhere."""
    def scan(batches):
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, end, data, offsets in W.text_slices(batch.column(2)):
                starts, ends, index = W.word_bounds(data, offsets)
                hashes = W.word_hashes(data, starts, ends)
                out = []
                for i in range(end - first):
                    own = hashes[index[i]:index[i + 1]]
                    if len(own) < length:
                        continue
                    low = W.sliding(W.gram_hashes(own, GRAM), length - GRAM + 1, np.minimum)
                    at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                    n = np.diff(np.r_[at, len(low)])
                    seg = W.sequence_hash(own, at, at + n + (length - 1))
                    out.append((low[at], seg, np.full(len(at), ids[first + i]), np.full(len(at), keys[first + i]), at, n))
                if out:
                    anchor, seg, doc, key, at, n = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.signed(anchor)), pa.array(W.signed(seg)), pa.array(doc.astype(np.int64)),
                         pa.array(key.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                        names=["anchor", "seg", "doc", "text_key", "start", "n"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("text_key"),
                         F.col(text).cast("string").alias("text"))
    return source.where("doc is not null and text is not null").mapInArrow(
        scan, "anchor long, seg long, doc long, text_key long, start int, n int")


def candidates(rows: DataFrame) -> DataFrame:
    """Segments whose minimiser stands in several documents: owner (null: to be taken apart), doc, start, n, split."""
    met = (rows.groupBy("anchor")
           .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("seg").alias("a"), F.max("seg").alias("b"))
           .where("lo < hi").select("anchor", "lo", (F.col("a") != F.col("b")).alias("mixed")))
    # written, so that the join is one of two plain tables, whose hot keys are split over tasks
    found = written(rows.join(written(met, "anchors-met"), "anchor"), "segments")
    plain = found.where("not mixed").select("doc", "text_key", "start", "n", F.col("lo").alias("owner"), F.lit(False).alias("split"))
    mixed = found.where("mixed").select("anchor", "seg", "doc", "text_key", "start", "n")
    kinds = mixed.groupBy("anchor", "seg").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    kinds = mixed.join(written(kinds, "kinds"), ["anchor", "seg"])
    alone = F.col("lo") == F.col("hi")
    kinds = kinds.select("doc", "text_key", "start", "n", F.when(~alone, F.col("lo")).alias("owner"),
                         (F.col("doc") == F.col("lo")).alias("split"))
    return plain.unionByName(kinds)


def pieces(docs: DataFrame, cands: DataFrame, doc_id: str, text: str, length: int = LENGTH) -> DataFrame:
    """The words of each document under candidate windows, one row per maximal passage, with its segments."""
    by_doc = cands.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "n", "owner", "split")))
                                      .alias("segs"))
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("text_key"),
                         F.col(text).cast("string").alias("text"))
    seg = "array<struct<start:int,n:int,owner:long,split:boolean>>"

    def cut(batches):
        for batch in batches:
            rows = {k: [] for k in ("doc", "text_key", "start", "words", "segs")}
            for doc, key, value, segs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = value.encode().split()
                segs = [s for s in segs if s["start"] + s["n"] + length - 1 <= len(own)]
                group, stop = [], -1
                for s in [*segs, None]:
                    if group and (s is None or s["start"] > stop):
                        base = group[0]["start"]
                        rows["doc"].append(doc)
                        rows["text_key"].append(key)
                        rows["start"].append(base)
                        rows["words"].append(b" ".join(own[base:stop]).decode())
                        rows["segs"].append([{**g, "start": g["start"] - base} for g in group])
                        group = []
                    if s is not None:
                        stop = max(stop, s["start"] + s["n"] + length - 1) if group else s["start"] + s["n"] + length - 1
                        group.append(s)
            if rows["doc"]:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("owner", pa.int64()),
                                           ("split", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc"], pa.int64()), pa.array(rows["text_key"], pa.int64()),
                     pa.array(rows["start"], pa.int32()), pa.array(rows["words"], pa.string()),
                     pa.array(rows["segs"], kind)], names=list(rows))

    return source.join(by_doc, ["doc", "text_key"]).select("doc", "text_key", "text", "segs").mapInArrow(
        cut, f"doc long, text_key long, start int, words string, segs {seg}")


def window_owners(passages: DataFrame, length: int = LENGTH) -> DataFrame:
    """For segments taken apart: doc, at (window start) and owner of each window that stands in several documents."""
    def windows(batches):
        for batch in batches:
            docs, keys, starts, segs = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            for first, end, data, offsets in W.text_slices(batch.column(3)):
                begin, stop, index = W.word_bounds(data, offsets)
                hashes = W.word_hashes(data, begin, stop)
                out = []
                for i in range(first, end):
                    own = W.gram_hashes(hashes[index[i - first]:index[i - first + 1]], length)
                    for s in segs[i]:
                        if s["split"]:
                            some = own[s["start"]:s["start"] + s["n"]]
                            at = np.arange(len(some)) + s["start"] + starts[i]
                            out.append((some, np.full(len(some), docs[i], np.int64), np.full(len(some), keys[i], np.int64), at))
                if out:
                    h, doc, key, at = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(W.signed(h)), pa.array(doc), pa.array(key),
                                                      pa.array(at.astype(np.int32))], names=["w", "doc", "text_key", "at"])

    rows = passages.where(F.exists("segs", lambda s: s["split"])).select("doc", "text_key", "start", "words", "segs").mapInArrow(
        windows, "w long, doc long, text_key long, at int")
    rows = written(rows, "windows")
    owners = rows.groupBy("w").agg(F.min("doc").alias("owner"), F.max("doc").alias("hi")).where("owner < hi").drop("hi")
    return rows.join(written(owners, "owners"), "w").select("doc", "text_key", "at", "owner")


def routed(passages: DataFrame, owned: DataFrame, length: int = LENGTH) -> DataFrame:
    """Reference passages (owner = doc) and query passages (owner < doc), as runs of windows with one owner."""
    by_doc = owned.groupBy("doc", "text_key").agg(F.collect_list(F.struct("at", "owner")).alias("single"))

    def runs(batches):
        for batch in batches:
            rows = {k: [] for k in ("owner", "doc", "text_key", "start", "words")}
            for doc, key, start, text, segs, single in zip(*(batch.column(k).to_pylist() for k in range(6))):
                own = text.split(" ")
                n = len(own) - length + 1
                owner = np.full((2, n), -1, np.int64)      # 0: owned by this document, 1: by an earlier one
                for s in segs:
                    if s["owner"] is not None:
                        owner[int(s["owner"] != doc), s["start"]:s["start"] + s["n"]] = s["owner"]
                for x in single or ():
                    at = x["at"] - start
                    if 0 <= at < n:
                        owner[int(x["owner"] != doc), at] = x["owner"]
                for line in owner:
                    cuts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                    for a, b in zip(cuts, np.r_[cuts[1:], n]):
                        if line[a] >= 0 or line[a] < -1:
                            rows["owner"].append(int(line[a]))
                            rows["doc"].append(doc)
                            rows["text_key"].append(key)
                            rows["start"].append(start + int(a))
                            rows["words"].append(" ".join(own[a:b + length - 1]))
            if rows["doc"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["owner"], pa.int64()), pa.array(rows["doc"], pa.int64()),
                     pa.array(rows["text_key"], pa.int64()), pa.array(rows["start"], pa.int32()),
                     pa.array(rows["words"], pa.string())], names=list(rows))

    return passages.join(by_doc, ["doc", "text_key"], "left").select("doc", "text_key", "start", "words", "segs", "single").mapInArrow(
        runs, "owner long, doc long, text_key long, start int, words string")


class Automaton:
    """Suffix automaton over word numbers; `least[s]` is the smallest document among the ends of state s."""

    def __init__(self):
        self.next, self.link, self.size, self.least, self.last = [{}], [-1], [0], [None], 0

    def add(self, word: int, doc: int) -> None:
        nxt, link, size, least = self.next, self.link, self.size, self.least
        new, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        least.append(doc)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                least.append(None)
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def settle(self) -> None:
        """Give every state the smallest document of the states that end in it."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and (least[up] is None or least[s] < least[up]):
                least[up] = least[s]

    def covered(self, numbers: list[int], doc: int, length: int) -> list[tuple[int, int]]:
        """Maximal spans of words under windows that stand in an earlier document."""
        nxt, link, size, least = self.next, self.link, self.size, self.least
        state = matched = 0
        spans: list[list[int]] = []
        for i, word in enumerate(numbers):
            while state and word not in nxt[state]:
                state = link[state]
                matched = size[state]
            if word in nxt[state]:
                state, matched = nxt[state][word], matched + 1
            if matched >= length:
                while size[link[state]] >= length:
                    state = link[state]
                matched = length
                if least[state] < doc:
                    if spans and spans[-1][1] >= i - length + 1:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([i - length + 1, i + 1])
        return [(a, b) for a, b in spans]


def dealt(routes: DataFrame, shards: int) -> DataFrame:
    """Routed passages with shard and salt.  A shard has one salt per QUERY_WORDS words of the query passages routed to
    it, whichever way they got their owner; a query goes to one salt, the shard's reference to each."""
    routes = routes.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    load = (routes.where("owner < doc").groupBy("shard")
            .agg((F.lit(1) + F.floor(F.sum(F.size(F.split("words", " "))) / QUERY_WORDS)).cast("int").alias("salts")))
    routes = routes.join(load, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    is_ref = F.col("owner") == F.col("doc")
    salt = F.when(is_ref, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc", "start"), F.col("salts")).cast("int")))
    return routes.select("shard", F.explode(salt).alias("salt"), "owner", "doc", "text_key", "start", "words")


def matched(routes: DataFrame, shards: int, length: int = LENGTH) -> DataFrame:
    """doc, text_key, start, stop of words to remove, decided by the automaton of each shard."""
    def match(table: pa.Table) -> pa.Table:
        owner, doc, key, start, text = (table.column(k).to_pylist() for k in ("owner", "doc", "text_key", "start", "words"))
        auto, numbers = Automaton(), {}
        for i in range(len(doc)):
            if owner[i] == doc[i]:
                for word in text[i].split(" "):
                    auto.add(numbers.setdefault(word, len(numbers)), doc[i])
                auto.add(-1 - i, doc[i])               # no match runs over two passages
        auto.settle()
        out = [[], [], [], []]
        for i in range(len(doc)):
            if owner[i] != doc[i]:
                for a, b in auto.covered([numbers.get(w, -1 - len(doc)) for w in text[i].split(" ")], doc[i], length):
                    for column, value in zip(out, (doc[i], key[i], start[i] + a, start[i] + b)):
                        column.append(value)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                        names=["doc", "text_key", "start", "stop"])

    return dealt(routes, shards).groupBy("shard", "salt").applyInArrow(match, "doc long, text_key long, start int, stop int")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Word spans (start, stop) to remove, by doc and text_key (xxhash64 of the text)."""
    bounded_batches(docs.sparkSession)
    cands = written(candidates(written(segments(docs, doc_id, text, length), "anchors")), "candidates")
    reference = cands.where("split or owner = doc").agg(F.sum("n")).first()[0] or 0
    shards = 1 + int(reference) // SHARD_WORDS
    passages = written(pieces(docs, cands, doc_id, text, length), "passages")
    routes = written(routed(passages, window_owners(passages, length), length), "routes")
    return matched(routes, shards, length)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with n_words, n_removed, kept_words (kept words joined by one space) and kept_text (the text without
    the removed words and the white space after them)."""
    made = ("n_words", "n_removed", "kept_words", "kept_text")
    spans = repeated_spans(docs, doc_id, text, length)
    spans = spans.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    left = docs.select(carried(docs, *made).alias("row"), F.col(text).cast("string").alias("value"), F.col(doc_id).cast("long").alias("doc"),
                       F.xxhash64(text).alias("text_key"))
    joined = left.join(spans, ["doc", "text_key"], "left")
    kept = F.arrow_udf(_without(), "struct<n_words:long,n_removed:long,kept_words:string,kept_text:string>").asNondeterministic()
    out = joined.select("row", kept(F.coalesce("value", F.lit("")), "spans").alias("cut"))
    return out.select("row.*", "cut.*")


def _without():
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = {"n_words": [], "n_removed": [], "kept_words": [], "kept_text": []}
        for value, gone in zip(texts.to_pylist(), spans.to_pylist()):
            data = value.encode()
            own = data.split()
            keep = np.ones(len(own), bool)
            for s in gone or ():
                keep[s["start"]:s["stop"]] = False
            n = int(keep.sum())
            out["n_words"].append(len(own))
            out["n_removed"].append(len(own) - n)
            if n == len(own):
                out["kept_words"].append(b" ".join(own).decode())
                out["kept_text"].append(value)
                continue
            out["kept_words"].append(b" ".join([w for w, k in zip(own, keep) if k]).decode())
            raw = np.frombuffer(data, np.uint8)
            begins, _, _ = W.word_bounds(raw, np.array([0, len(raw)]))
            stays = np.repeat(keep, np.diff(np.r_[begins, len(raw)]))
            head = data[:begins[0]]
            out["kept_text"].append((head + raw[begins[0]:][stays].tobytes()).decode())
        return pa.StructArray.from_arrays(
            [pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
             pa.array(out["kept_words"], pa.string()), pa.array(out["kept_text"], pa.string())], names=list(out))

    return remove
