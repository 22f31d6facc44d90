"""Pieces against a plain twin, and texts cut into fragments against whole ones."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidebar.llm import packing, spans

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, docs, tokenizer, longest):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    expected = {}
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.setdefault((doc_id, len(ids)), []).append(ids)
    assert by_doc.keys() == expected.keys()
    for key, many in expected.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[key])
        wanted = []
        for ids in many:
            at = 0
            while at < len(ids):                           # the largest power of two that is left and allowed
                length = min(longest, 1 << (len(ids) - at).bit_length() - 1)
                wanted.append((at, length, zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes())))
                at += length
        assert got == sorted(wanted)
    numbers = sorted(r["sequence_id"] for r in rows)
    assert numbers == list(range(len(rows))) and {r["offset"] for r in rows} <= {0}
    for length in {r["length"] for r in rows}:             # numbered without gaps within a bucket as well
        mine = [r for r in rows if r["length"] == length]
        assert sorted(r["place"] for r in mine) == list(range(len(mine)))
        assert max(r["sequence_id"] for r in mine) - min(r["sequence_id"] for r in mine) == len(mine) - 1


@pytest.mark.parametrize("longest", [64, 4096])
def test_pieces_equal_a_plain_twin(awkward, tokenizer, longest):
    rows = packing.pack(awkward, PATH, 2, longest).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()], tokenizer, longest)
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_empty_table_and_bad_length(no_docs):
    assert packing.pack(no_docs, PATH, 2).collect() == []
    with pytest.raises(ValueError):
        packing.pack(no_docs, PATH, 2, 1000)


def test_words_one_by_one_equal_the_whole_text(tokenizer):
    rng = np.random.default_rng(5)
    parts = ["a", "Σ", "ς", "İ", "'s", "<|endoftext|>", "́", " ", "\n", "\x0b", "\x1c", "　", " ", " ", "漢",
             "é", "½", "\r", "\t", "ﬁ", "'ll", "​", "\x00", "\U0001f600", "Hello", "World's"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(4000)]
    encoder = packing.WordEncoder(open(PATH, "rb").read())
    got = [ids.tolist() for ids in packing.text_ids(pa.array(texts), encoder)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_long_text_in_fragments(tokenizer):
    text = " ".join(f"word{k % 977} {'x' * (k % 50)}," for k in range(120_000))      # some 4 MB
    assert len(text) > packing.SLICE // 2
    encoder = packing.WordEncoder(open(PATH, "rb").read())
    texts = pa.array(["one", text * 2, None, "two"])
    got = list(packing.text_ids(texts, encoder))
    assert [len(x) for x in got][::3] == [1, 1] and len(got[2]) == 0
    assert got[1].tolist() == tokenizer.encode(text * 2, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1, 7, 64, 10_000])
def test_slices_hold_every_word_once(most):
    texts = ["a bb  ccc", "", None, "x" * 100 + " y", " ", "end "] * 3
    table = spans.byte_table(b" ")
    found, ended = [], []
    for words in spans.word_slices(pa.array(texts), table, most):
        for row, a, b in zip(words.rows, words.starts, words.ends):
            found.append((int(row), words.data[a:b].tobytes().decode()))
        ended += range(words.first, words.last + words.ended)
        array = spans.word_array(words.data, words.starts, words.ends).to_pylist()
        assert [w.decode() for w in array] == [w for _, w in found[len(found) - len(array):]]
    assert found == [(k, w) for k, t in enumerate(texts) for w in (t or "").split()]
    assert ended == list(range(len(texts)))


def test_a_word_table_that_is_full_starts_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEEP_WORDS", 10)
    encoder = packing.WordEncoder(open(PATH, "rb").read())
    texts = [f"w{k} v{k // 3} the" for k in range(300)]
    for a in range(0, 300, 20):
        got = [x.tolist() for x in packing.text_ids(pa.array(texts[a:a + 20]), encoder)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts[a:a + 20], add_special_tokens=False)]


def test_buckets_and_batches(spark, awkward, tmp_path):
    packed = packing.pack(awkward, PATH, 2, 64)
    packing.write_buckets(packed, str(tmp_path / "buckets"))
    read = spark.read.parquet(str(tmp_path / "buckets"))
    assert read.where("bucket <> length").count() == 0 and read.count() == packed.count()
    groups = packing.batches(packed, 128).groupBy("length", "batch").count().collect()
    assert all(r["count"] * r["length"] <= 128 for r in groups)
