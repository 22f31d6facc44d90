"""The search against a plain twin that scores every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from tidebar.llm import bag_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(w for b in bags for w in b[1])
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, bag, size in bags:
            m = 25 + 75 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m))
                        for w, q in words.items() if bag[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def rows(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "bdfgk" for b in ("ar", "el", "in", "öl", "漢", "7")]
    docs = [(k * 3 % 997, " ".join(rng.choice(vocabulary[:20]) for _ in range(rng.randrange(0, 12)))) for k in range(400)]
    crowd = [(5000 + k, "Bar-bel; BAR bin " + "\n" * (k % 3)) for k in range(300)]      # one class of many members
    odd = [(None, "bar bel"), (None, None), (7001, None), (7002, ""), (7003, " .,;"), (7, "bar"), (7, "bar"), (7, "bel bin")]
    items = [(1, "bar bel bar"), (2, "Bar BIN zzz"), (3, "zzz yyy"), (4, None), (5, ""), (None, "del"), (2, "bin"),
             (6, " ".join(vocabulary))]
    return docs + crowd + odd, items


@pytest.mark.parametrize("k, block", [(1, 1 << 20), (10, 1 << 20), (3, 200), (500, 1 << 20)])
def test_search_equals_scoring_everything(spark, corpus, monkeypatch, k, block):
    monkeypatch.setattr(bag_search, "BLOCK_BYTES", block)
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as hash", "0 as m").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'n' as word")
    assert rows(bag_search.search(d, i, k=k)) == plain(docs, items, k)


def test_awkward_documents_and_string_ids(spark, awkward):
    items = [("a", "corbean delan only three"), ("b", "12 34 漢字"), ("c", "la la"), ("d", "x" * 10)]
    docs = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    found = bag_search.search(awkward, spark.createDataFrame(items, "item_id string, text string"))
    assert rows(found) == plain(docs, items, 10)


def test_empty_tables(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, "la")], "item_id long, text string")
    assert bag_search.search(no_docs, items).collect() == []
    assert bag_search.search(awkward, items.limit(0)).collect() == []
    assert bag_search.search(awkward.where("text is null"), items).collect() == []


def test_a_text_longer_than_a_fragment(spark):
    text = "la " * 300_000 + "end"
    docs = [(1, text), (2, "la end"), (3, "end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "la end"), (2, "end")]
    assert rows(bag_search.search(frame, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items, 10)
