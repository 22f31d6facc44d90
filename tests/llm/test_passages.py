"""Substring dedup, benchmark decontamination and Jaccard components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from llm.conftest_llm import awkward_texts, single, words
from pyspark.sql import functions as F
from tidebar.llm import components, decontaminate, jaccard_join, substring_dedup


def kept_words(rows, length):
    owner = {}
    for doc, text in rows:
        if doc is not None:
            own = (text or "").encode().split()
            for i in range(len(own) - length + 1):
                key = tuple(own[i:i + length])
                owner[key] = min(owner.get(key, doc), doc)
    out = {}
    for doc, text in rows:
        own = (text or "").encode().split()
        keep = [True] * len(own)
        for i in range(len(own) - length + 1):
            if doc is not None and owner[tuple(own[i:i + length])] < doc:
                keep[i:i + length] = [False] * length
        out[doc, text] = b" ".join(w for w, k in zip(own, keep) if k).decode()
    return out


@pytest.mark.parametrize("length", [50, 20])
def test_substring_dedup_equals_brute_force(awkward, length):
    got = substring_dedup.remove_repeats(awkward, length=length).collect()
    expected = kept_words([(i, t) for i, t, _ in awkward_texts()], length)
    assert len(got) == len(awkward_texts())
    for r in got:
        assert r["kept_words"] == expected[r["doc_id"], r["text"]]
        assert r["n_words"] - r["n_removed"] == len(r["kept_words"].encode().split())
        assert r["kept_text"].encode().split() == r["kept_words"].encode().split()
        assert r["doc"] == "d" and r["kept"] == "old"
    assert sum(r["n_removed"] for r in got) > 500


def test_substring_dedup_of_random_overlaps(spark):
    rng, pool, rows = random.Random(4), words(20, 600), []
    for doc in range(60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(500)
            own += pool[at:at + rng.randrange(5, 60)] if rng.random() < 0.7 else words(100 + doc, 20)
        rows.append((doc, " ".join(own)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=12)
    expected = kept_words(rows, 12)
    assert {(r["doc_id"], r["text"]): r["kept_words"] for r in got.collect()} == expected


def test_a_passage_in_new_surroundings_everywhere_is_salted(spark, monkeypatch):
    """Edge segments differ in every document, so all windows get their owner one by one; their load counts as well."""
    monkeypatch.setattr(substring_dedup, "QUERY_WORDS", 200)
    passage, seen, dealt = words(30, 24), [], substring_dedup.dealt
    rows = [(d, " ".join(words(1000 + d, 30, 4000) + passage + words(2000 + d, 30, 4000))) for d in range(60)]
    monkeypatch.setattr(substring_dedup, "dealt", lambda *a: seen.append(dealt(*a)) or seen[0])
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20).collect()
    assert {(r["doc_id"], r["text"]): r["kept_words"] for r in got} == kept_words(rows, 20)
    tasks = defaultdict(int)
    for r in seen[0].where("owner < doc").collect():
        tasks[r["shard"], r["salt"]] += len(r["words"].split(" "))
    assert sum(tasks.values()) >= 59 * 24 and max(tasks.values()) <= 2 * 200


def test_automaton_on_plain_sequences():
    auto = substring_dedup.Automaton()
    for doc, numbers in ((4, [1, 2, 3, 4, 5]), (2, [3, 4, 5, 6])):
        for n in numbers:
            auto.add(n, doc)
        auto.add(-doc, doc)
    auto.settle()
    assert auto.covered([9, 3, 4, 5, 6, 9], 3, 3) == [(1, 5)]
    assert auto.covered([1, 2, 3, 9], 5, 3) == [(0, 3)] and auto.covered([1, 2, 3], 4, 3) == []
    assert auto.covered([5, 3, 4], 9, 3) == []           # would run over two passages


def test_empty_tables(spark, no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert jaccard_join.components(no_docs).count() == 0
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.annotate(no_docs, items).count() == 0


def hit(docs, items, size=13):
    def split(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    wins = defaultdict(set)
    for item, text in items:
        own = split(text)
        if item is not None and own:
            for i in range(max(len(own) - size, 0) + 1):
                wins[tuple(own[i:i + size])].add(str(item))
    out = {}
    for doc, text in docs:
        own, covered, found = split(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(own) - n + 1):
                if tuple(own[i:i + n]) in wins:
                    covered |= set(range(i, i + n))
                    found |= wins[tuple(own[i:i + n])]
        out[doc, text] = (len(own), len(covered), sorted(found), bool(covered) and 20 * len(covered) >= len(own))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_equals_brute_force(spark, awkward, broadcast, monkeypatch):
    base = words(1, 300)
    items = [(1, " ".join(base[20:40])), (2, "three, WORDS"), (3, ""), (4, None), (None, " ".join(base[:20])), (5, "É ü"), (6, "é ü"),
             (7, " ".join(base[20:40])), (10, "la la"), (11, " ".join(words(2, 80))), (12, "not found anywhere")]
    if not broadcast:
        monkeypatch.setattr(decontaminate, "fits", lambda *_: False)
        monkeypatch.setattr(decontaminate, "small_or_shuffled", lambda df, _: df)
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = hit([(i, t) for i, t, _ in awkward_texts()], items)
    got = decontaminate.annotate(awkward, table).collect()
    assert len(got) == len(awkward_texts())
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == expected[r["doc_id"], r["text"]]


def test_decontamination_runs_no_python(spark, awkward):
    items = spark.createDataFrame([(1, "only three words")], "item_id long, text string")
    plan = decontaminate.annotate(awkward, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert decontaminate.annotate(awkward, items.limit(0)).where("n_hit > 0").count() == 0


def linked(rows, n, percent):
    sets = []
    for doc, text in rows:
        own = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets.append({tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)} if own else set())
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), doc) if x is not None), default=None)
    return [(doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(awkward, n, percent):
    got = [tuple(r) for r in jaccard_join.components(awkward, n=n, percent=percent).collect()]
    assert ordered(got) == ordered(linked([(i, t) for i, t, _ in awkward_texts()], n, percent))


def test_sets_that_ask_a_part_come_in_slices(spark, monkeypatch):
    """A crowd of near copies is asked by a family that shares rare n-grams with it but stays under the threshold; what
    differs is frequent elsewhere, so the rare ones stand in the prefixes."""
    monkeypatch.setattr(jaccard_join, "PART", 8)
    seen, across = [], jaccard_join.across_parts
    monkeypatch.setattr(jaccard_join, "across_parts", lambda rows, *a: seen.append(rows.drop("text").collect()) or across(rows, *a))
    head, tail, chunks = words(40, 20), words(41, 80), [words(50 + k, 40) for k in range(17)]
    pairs = [(a, b) for a in range(17) for b in range(a)]
    rows = [(d, " ".join(head + tail[:10 + 3 * d] + [f"own{d}"] + tail[11 + 3 * d:])) for d in range(20)]
    rows += [(100 + d, " ".join(head + chunks[a] + chunks[b])) for d, (a, b) in enumerate(pairs[:120])]
    rows += [(1000 + d, " ".join(sum(chunks, tail))) for d in range(150)]
    got = [tuple(r) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert ordered(got) == ordered(linked(rows, 4, 85))
    groups = defaultdict(lambda: [0, 0])
    for r in seen[0] + seen[1]:
        groups[tuple(r[k] for k in r.__fields__ if k in ("group", "part", "slice"))][not r["asks"]] += 1
    assert sum(n for n, _ in groups.values()) > 100 and max(n for n, _ in groups.values()) <= 4 * 8
    assert all(members for _, members in groups.values())


def test_counters_follow_the_corpus(spark):
    docs = spark.range(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert jaccard_join.counters(docs) == jaccard_join.BUCKETS
    docs = spark.range(1 << 10).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert jaccard_join.counters(docs) == 1 << 20
    assert jaccard_join.counters(docs.limit(0)) == jaccard_join.BUCKETS


@pytest.mark.parametrize("part", [3, 256])
def test_components_of_chains_and_crowds(spark, part, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "HOT", 0)
    rng, rows = random.Random(7), []
    for family in range(6):
        own = words(200 + family, 60)
        for k in range(25):
            for _ in range(rng.randrange(0, 3)):
                own = own.copy()
                own[rng.randrange(len(own))] = rng.choice("uvwxyz") * 3
            rows.append((1000 - len(rows), " ".join(own)))
    common = words(300, 50)                     # much in common, yet not enough to link
    rows += [(2000 + k, " ".join(common + words(400 + k, 14))) for k in range(30)]
    got = [tuple(r) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    expected = linked(rows, 4, 85)
    assert ordered(got) == ordered(expected)
    assert 6 < len({c for _, _, c in expected}) < len(rows)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, 4), (200, 201)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


@pytest.mark.parametrize("shard_words", [100_000, 200])
def test_two_texts_of_one_id_are_told_apart_over_many_shards(spark, monkeypatch, shard_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    rng, pool, rows = random.Random(6), words(40, 500), []
    for k in range(600):
        own = []
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(400)
            own += pool[at:at + rng.randrange(5, 60)] if rng.random() < 0.7 else words(5000 + k, 15, 4000)
        rows.append((k % 150, " ".join(own)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=12)
    expected = kept_words(rows, 12)
    assert {(r["doc_id"], r["text"]): r["kept_words"] for r in got.collect()} == expected
