"""Mining by shards against counting everything."""

import random
import re
from collections import Counter

import pytest

from tidebar.llm import phrases


def plain(docs, support, longest, first, percent=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    often = {p: c for p, c in f.items() if c >= support}
    out = {}
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        within = lambda w: any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))
        if any(x == lang and len(w) > len(words) and 100 * c >= percent * a and within(w) for (x, w), c in often.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                             for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


def mined(frame, **kw):
    return sorted(tuple(r) for r in phrases.mine(frame, **kw).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Red", "blue", "of", "of", "of", "the", "the", "Öl", "漢字", "x-1", "\xa0nb", "ÉTÉ"]
    stops = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; ", "!?", "\x0b", " : "]
    docs = [(rng.choice(["en", "de", None, "en"]), "".join(rng.choice(vocabulary) + rng.choice(stops) for _ in range(rng.randrange(0, 60))))
            for _ in range(n)]
    copies = [("en", "same words in every copy of it, again and again.")] * 40
    return docs + copies + [("en", None), (None, None), ("en", ""), ("de", " \t., "), ("", "of the of the of the of the of the")]


@pytest.mark.parametrize("chunk, shards, support, longest", [(1 << 18, 4, 12, 5), (37, 8, 5, 5), (5, 3, 20, 4), (1 << 18, 1, 8, 2)])
def test_mining_equals_counting_everything(spark, monkeypatch, chunk, shards, support, longest):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(phrases, "SHARDS", shards)
    docs = corpus(chunk + shards, 150)
    frame = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as f", "'q' as phrase", "2 as n").repartition(6)
    assert mined(frame, support=support, longest=longest, first=30) == plain(docs, support, longest, 30)


def test_phrases_that_a_longer_one_explains_in_part(spark):
    docs = corpus(3, 120)
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert mined(frame, support=10, first=1000, percent=60) == plain(docs, 10, 5, 1000, 60)


def test_a_phrase_rare_in_every_shard_but_one_is_found(spark):
    docs = [("en", "rare pair")] * 12 + [("en", f"w{k} v{k} u{k}") for k in range(300)]
    frame = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    found = mined(frame, support=12)
    assert [r[2] for r in found] == ["rare pair"] and found == plain(docs, 12, 5, 2000)


def test_long_texts_and_pieces(spark):
    docs = [("en", "la le li " * 100_000), ("en", "la, le. " * 30_000), ("en", "z" * 700_000)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert mined(frame, support=100) == plain(docs, 100, 5, 2000)


def test_awkward_and_empty(spark, awkward, no_docs):
    assert mined(no_docs, support=2) == []
    docs = [(r["lang"], r["text"]) for r in awkward.select("lang", "text").collect() if len(r["text"] or "") < 5_000]
    short = awkward.where("text is null or length(text) < 5000")
    assert mined(short, support=2) == plain(docs, 2, 5, 2000)


def test_products_beyond_64_bits(spark):
    n = 3_000_000_000_000
    found = spark.createDataFrame([("en", "a", 1, n), ("en", "b", 1, n // 2), ("en", "a b", 2, n // 4)], "lang string, phrase string, k int, f long")
    words = spark.createDataFrame([("en", 5 * n)], "lang string, n long")
    row = phrases.scored(found, words).first()
    assert row["score"] == 1000 * (n // 4) * 5 * n // (n * (n // 2))
