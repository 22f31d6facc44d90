"""Encoding, line quality, perplexity, language, licences, chat and token totals against brute force."""

import math
import random
import textwrap
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from llm.conftest_llm import SF, awkward_texts, words
from pyspark.sql import functions as F
from tidebar.llm import bpe, chat, language, licences, perplexity, quality_lines, token_rollup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def encoding(codec):
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


# --- encoding -------------------------------------------------------------------------------------------------------

def test_encoding_equals_the_library(spark, awkward, encoding):
    encode, decode = bpe.encoder(spark, RANKS, PATTERN), bpe.decoder(spark, RANKS, PATTERN)
    out = awkward.select("text", encode("text").alias("ids")).select("*", decode("ids").alias("bytes")).collect()
    assert len(out) == len(awkward_texts())
    for r in out:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]) == (r["text"] or "").encode()


def test_encoding_of_random_bytes_and_long_parts(codec, encoding):
    rng = random.Random(3)
    for alphabet in ("ab -=\n\t'é漢s0_", "".join(map(chr, range(256))), "aA", "=-_ ", "   x"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert codec.encode(text) == encoding.encode_ordinary(text)
    for text in ("ab" * 80_000, "=-" * 70_000, "é" * 50_000, " " * 70_001, "".join(words(5, 30_000))):
        assert codec.encode(text) == encoding.encode_ordinary(text)


def test_encoding_with_small_blocks_and_caches(codec, encoding, monkeypatch):
    for name in ("BLOCK", "KEEP_PART", "KEEP_PARTS", "PAIR_SLOTS"):
        monkeypatch.setattr(bpe, name, 7)
    small = bpe.Codec(bpe.read_ranks(RANKS), PATTERN)
    for text in ("----====----" * 9, "ababaabbabab" * 20, " ".join(words(6, 200)), "antidisestablishmentarianism" * 5):
        assert small.encode(text) == encoding.encode_ordinary(text)


def test_missing_bytes_and_null_lists(spark):
    with pytest.raises(ValueError):
        bpe.Codec(b"YQ== 0\n", PATTERN).encode("b")
    decode = bpe.decoder(spark, RANKS, PATTERN)
    rows = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>").select(decode("ids").alias("b")).collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in rows] == [None, b"", b'!"']


# --- line quality ---------------------------------------------------------------------------------------------------

def figures(text):
    spaces = " \t\n\x0b\x0c\r"
    own, current = [], ""
    for c in text + " ":
        if c in spaces:
            own += [current] if current else []
            current = ""
        else:
            current += c
    lines = [x for x in text.split("\n") if any(c not in spaces for c in x)]
    grams = Counter(tuple(own[i:i + 5]) for i in range(len(own) - 4))
    repeated = {i + k for i in range(len(own) - 4) if grams[tuple(own[i:i + 5])] > 1 for k in range(5)}
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


def test_base_figures_equal_brute_force(awkward):
    out = quality_lines.clean_lines(awkward).collect()
    assert len(out) == len(awkward_texts())
    for r in out:
        expected = figures(r["text"] or "")
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["base_failed"] and r["kept"]) and r["doc"] == "d"


def test_figures_of_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", "  ", "\n", "\t", "#", "|", "\x0b", " "]) for _ in range(rng.randrange(80)))
        assert quality_lines.judge(text)[:5] == figures(text)


def test_line_rules():
    good = "A clean sentence with enough words stands here and ends well."
    lines = {"no end mark here": True, good: False, "Home | About | Contact | Help.": True, "BUY!! NOW!! OR!! NEVER!!": True,
             "a### b### c*** d&&&.": True, "Please accept cookies.": True, "(A note in brackets)": False}
    assert {x: quality_lines.line_fails(x, x.split()) for x in lines} == lines
    fields = dict(zip(quality_lines.NAMES, quality_lines.judge("\n".join([good, "menu", "", "Another one."]))))
    assert fields["kept"] and fields["cleaned"] == good + "\nAnother one."
    assert not quality_lines.judge("\n".join([good] + ["menu item without an end"] * 1 + ["x y z " * 5 + "q"] * 1))[6]


# --- perplexity -----------------------------------------------------------------------------------------------------

def kneser_ney(train, order):
    """Plain interpolated modified Kneser-Ney over bytes: a function (context, byte) -> probability."""
    raw = Counter()
    for text in train:
        data = b"\0" * (order - 1) + text.encode()
        raw.update(data[i:i + order] for i in range(len(data) - order + 1))
    counts = {order: raw}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    ctx, cuts = {}, {}
    for n, table in counts.items():
        n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cuts[n] = [min(max(k - (k + 1) * y * b / a, perplexity.LEAST_DISCOUNT), k) if a and b else min(y, k)
                   for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        ctx[n] = defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            ctx[n][g[:-1]][0] += c
            ctx[n][g[:-1]][1] += cuts[n][min(c, 3) - 1]

    def p(gram):
        n = len(gram)
        below = p(gram[1:]) if n > 1 else 1 / 256
        if gram[:-1] not in ctx[n]:
            return below
        total, free = ctx[n][gram[:-1]]
        c = counts[n].get(gram, 0)
        return (c - cuts[n][min(c, 3) - 1] if c else 0) / total + free / total * below
    return p


def test_perplexity_equals_a_plain_model(spark, awkward, monkeypatch):
    monkeypatch.setattr(perplexity, "SHARD_GRAMS", 500)
    texts = awkward_texts()
    trusted = spark.createDataFrame([(i,) for i in (3, 5, 12, 20, 20, 22, 60, 999, None)], "doc_id long")
    aside = {r["id"] for r in spark.createDataFrame([(i,) for i in (3, 5, 12, 20, 22, 60)], "id long").where(
        F.pmod(F.xxhash64("id"), F.lit(perplexity.FOLDS)) == 0).collect()}
    p = kneser_ney([t for i, t, _ in texts if i in {3, 5, 12, 20, 22, 60} - aside], perplexity.ORDER)
    out = perplexity.classify(awkward, trusted).collect()
    assert len(out) == len(texts)
    by_id = defaultdict(set)
    for i, t, _ in texts:
        by_id[i].add(t)
    for r in out:
        values = []
        for text in by_id[r["doc_id"]]:
            data = b"\0" * 3 + (text or "").encode()[:4000]
            if len(data) > 3:
                values.append(2 ** (sum(-math.log2(p(data[k:k + 4])) for k in range(len(data) - 3)) / (len(data) - 3)))
        if r["perplexity"] is None:
            assert not r["kept"] and None in by_id[r["doc_id"]] | {None if "" in by_id[r["doc_id"]] else 0}
        elif r["n_bytes"] <= 4000:
            assert any(abs(r["perplexity"] - v) < 1e-3 * v for v in values)
            assert r["kept"] == (r["perplexity"] <= r["threshold"] + 1e-9)
    assert sum(sum(p(c + bytes([b])) for b in range(256)) - 1 for c in (b"\0\0\0", b"zzz", b"bea")) < 1e-9


def test_perplexity_without_trusted_text(awkward, spark, no_docs):
    nobody = spark.createDataFrame([], "doc_id long")
    out = perplexity.classify(awkward, nobody).collect()
    assert all(r["kept"] == (r["n_bytes"] > 0) for r in out)
    assert all(abs(r["perplexity"] - 256) < 1e-6 for r in out if r["n_bytes"])
    assert perplexity.classify(no_docs, nobody).count() == 0


# --- language -------------------------------------------------------------------------------------------------------

def partial_matching(train, text):
    """Code length by escapes, written out byte by byte."""
    tables = [defaultdict(Counter) for _ in range(language.ORDER + 1)]
    for sample in train:
        data = b"\0" * language.ORDER + sample.lower().encode()
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER + 1):
                tables[k][data[i - k:i]][data[i]] += 1
    data, bits = b"\0" * language.ORDER + text.lower().encode(), 0.0
    for i in range(language.ORDER, len(data)):
        for k in range(language.ORDER, -1, -1):
            seen = tables[k].get(data[i - k:i])
            if seen:
                whole = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    bits -= math.log2(seen[data[i]] / whole)
                    break
                bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force(spark, awkward):
    rows = awkward.select("doc_id", "text", "lang", language.held_out("doc_id").alias("out")).collect()
    train = defaultdict(list)
    for r in rows:
        if not r["out"] and r["lang"] is not None and r["text"] is not None:
            train[r["lang"]].append(r["text"])
    model = language.train(awkward)
    out = language.predict(awkward, model).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(text) < 3000:
            bits = {x: partial_matching(train[x], text) for x in train}
            best = min(bits.values())
            assert bits[r["lang_pred"]] < best + 1e-3 * (1 + best)
            assert abs(r["score"] - 1 / sum(2 ** max(best - b, -1000) for b in bits.values())) < 0.05
            assert 0 <= r["score"] <= 1


def test_language_sample_is_bounded_and_learns_from_four_in_five(spark):
    rows = [(i, " ".join(words(i, 50)), "x" if i % 3 else "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = language.sample(docs, "doc_id", "text", "lang", chars=5000).collect()
    assert {r["lang"] for r in some} == {"x", "y"} and 10 < len(some) < 100
    held = {r["doc_id"] for r in docs.where(language.held_out("doc_id")).collect()}
    texts = {rows[i][1] for i in held}
    assert not texts & {r["text"] for r in language.sample(docs, "doc_id", "text", "lang").collect()}


def test_language_without_training(awkward, no_docs):
    out = language.predict(awkward, language.train(no_docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    assert language.predict(no_docs, language.train(awkward)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.predict(docs, language.train(docs)).where(language.held_out("doc_id"))
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count() > 0


# --- licences -------------------------------------------------------------------------------------------------------

def test_licences(spark, no_docs):
    mit = next(t for name, t in licences.KNOWN if name == "MIT" and len(t) > 500)
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "\n  ", 9).replace("sublicense", "sub-licence")),
            (2, "Text before.\n  * RELEASED under the MIT licence\nLicensed under CC BY-NC 4.0!\nReleased under the MIT License."),
            (3, None), (4, ""), (5, "Released under the MIT License, perhaps."), (6, "licensed under cc by 4.0"),
            (6, "licensed under cc by 4.0"), (None, "Licensed under CC BY 4.0."), (7, "© 2021 A. Nobody. All rights reserved.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit("old")).withColumn("unit", F.lit(1))
    out = licences.scan(docs).collect()
    assert sorted(((r["doc_id"], r["whole_licence"], ",".join(r["licences"]), r["n_notices"]) for r in out), key=repr) == sorted([
        (1, "MIT", "MIT", 0), (2, None, "CC-BY-NC-4.0,MIT", 3), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0),
        (6, "CC-BY-4.0", "CC-BY-4.0", 1), (6, "CC-BY-4.0", "CC-BY-4.0", 1), (None, "CC-BY-4.0", "CC-BY-4.0", 1),
        (7, None, "", 0)], key=repr)
    assert licences.scan(no_docs).count() == 0
    own = spark.createDataFrame([("house", "You may read this.")], "licence string, text string")
    docs = spark.createDataFrame([(1, "you may READ this")], "doc_id long, text string")
    assert licences.scan(docs, known=own).first()["whole_licence"] == "house"


def test_whole_licence_files(spark):
    mit = next(t for name, t in licences.KNOWN if name == "MIT" and len(t) > 500)
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + textwrap.fill(mit, 78)),
            ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + textwrap.fill(mit, 70))]
    for name in ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"):
        text = (Path(licences.__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8")
        rows.append((name, text.replace("\n", " \n  ").upper()))
        if licences.END in text:
            rows.append((name, text.split(licences.END)[0] + licences.END + "\n"))
    docs = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(rows)], "doc_id long, name string, text string")
    assert [r["whole_licence"] for r in licences.scan(docs).orderBy("doc_id").collect()] == [name for name, _ in rows]


# --- chat -----------------------------------------------------------------------------------------------------------

def test_chat_rotation_equals_brute_force(spark):
    rng, rows = random.Random(1), []
    for conv in (1, 2, 3, None):
        for turn in range(150 if conv == 2 else 7):
            rows.append((conv, turn if conv != 3 else 1, rng.choice(["ann", "bob", "system", None, "eve"]), rng.choice(["hi", "", None, "é" * 5])))
    rows += [rows[0], rows[0], (4, 0, "system", "alone"), (5, None, "ann", "x"), (5, -3, "bob", "y")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("z")))
    got = defaultdict(dict)
    for r in out.collect():
        got[r["conv_id"], r["perspective"]][r["segment"]] = r
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    expected = {}
    for conv, turns in talks.items():
        turns.sort()
        for me in {t[2] for t in turns} - {"system"}:
            expected[conv, me] = turns
    assert set(got) == set(expected)
    for (conv, me), turns in expected.items():
        segments = got[conv, me]
        assert sorted(segments) == list(range((len(turns) + chat.SEGMENT - 1) // chat.SEGMENT))
        for s, r in segments.items():
            text, mask = "", []
            for *_, role, said in turns[s * chat.SEGMENT:(s + 1) * chat.SEGMENT]:
                name = "assistant" if role == me else role if role == "system" else f"user name={role}"
                text += f"<|im_start|>{name}\n"
                if role == me:
                    mask.append((len(text), len(text) + len(said) + len("<|im_end|>\n")))
                text += said + "<|im_end|>\n"
            assert r["rendered"] == text and [tuple(m) for m in r["mask"]] == mask
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- token totals ---------------------------------------------------------------------------------------------------

def test_rollup_equals_a_full_count(spark, awkward, encoding, tmp_path):
    counts = token_rollup.counted(awkward, token_rollup.counter(spark, RANKS, PATTERN), "v1").cache()
    per_text = {(r["doc"], r["source"], r["lang"]): r["n_tokens"] for r in counts.collect()}
    assert sum(per_text.values()) > 0
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "a"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_rollup.inserts(counts)) and not rollup.commit("one", token_rollup.inserts(counts))
    gone, redone = counts.where("doc = 50"), counts.where("doc in (5, 60)")
    new = redone.withColumn("tokenizer", F.lit("v2")).withColumn("n_tokens", F.lit(7))
    rollup.commit("two", token_rollup.deletes(gone))
    rollup.commit("three", token_rollup.revisions(redone, new))
    rollup.commit("nothing", token_rollup.inserts(counts.limit(0)))
    # a writer that died before its record leaves rows that nobody reads
    token_rollup.inserts(counts).withColumn("generation", F.lit("dead")).write.mode("append").partitionBy("generation").parquet(
        str(tmp_path / "a" / "deltas"))
    expected = Counter()
    for r in awkward.collect():
        n = len(encoding.encode_ordinary(r["text"] or ""))
        if r["doc_id"] == 50:
            continue
        key = (r["source"], r["lang"], "v2" if r["doc_id"] in (5, 60) else "v1")
        expected[key + ("n",)] += 1
        expected[key + ("t",)] += 7 if r["doc_id"] in (5, 60) else n
    for table in (rollup, rollup.compact(str(tmp_path / "b"))):
        got = {}
        for r in table.totals().collect():
            got[r["source"], r["lang"], r["tokenizer"], "n"] = r["n_docs"]
            got[r["source"], r["lang"], r["tokenizer"], "t"] = r["n_tokens"]
        assert got == dict(expected)
        assert {r["batch"] for r in table.commits().collect()} == {"one", "two", "three", "nothing"}


@pytest.mark.parametrize("n, bits", [(0, 1 << 20), (500, 1 << 20), (70_000, 1 << 15)])
def test_the_bitmap_passes_every_wanted_row_and_few_others(spark, monkeypatch, n, bits):
    monkeypatch.setattr(token_rollup, "BITMAP_MOST", bits)
    monkeypatch.setattr(token_rollup, "BITMAP_LEAST", min(bits, 1 << 20))
    rows = spark.range(100_000).selectExpr("id as doc_id", "'x' as bitmap_at").unionByName(
        spark.createDataFrame([(None, "x")], "doc_id long, bitmap_at string"))
    ids = spark.range(n).selectExpr("id * 3 as doc")
    got = token_rollup.likely(rows.drop("bitmap_at"), "doc_id", ids, "doc")
    assert got.columns == ["doc_id"]
    passed = {r["doc_id"] for r in got.collect()}
    wanted = {k * 3 for k in range(n) if k * 3 < 100_000}
    assert wanted <= passed and None not in passed
    if bits == 1 << 20:
        assert len(passed) <= len(wanted) * 1.1 + 100
