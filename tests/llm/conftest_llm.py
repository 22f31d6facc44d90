"""Documents with every awkward case, and brute-force twins' helpers."""

import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SYLLABLES = ["an", "be", "cor", "del", "en", "fi", "gra", "hu", "is", "jo"]
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside or return
    T.StructField("doc", T.StringType()), T.StructField("row", T.StringType()), T.StructField("k", T.LongType()),
    T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("lang_pred", T.StringType())])


def words(seed, n, size=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(SYLLABLES) for _ in range(2 + (k * 7) % 3)) for k in (rng.randrange(size) for _ in range(n))]


def awkward_texts():
    """(doc_id, text, lang): nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    base, passage = words(1, 300), words(2, 80)
    edit = base.copy()
    edit[150] = "changed"
    half = base[:150] + words(3, 150)
    rows = [
        (5, " ".join(base) + ".", "en"), (3, " ".join(base) + ".", "en"), (9, " ".join(edit) + ".", "en"),
        (12, " ".join(half) + ".", "de"), (20, " ".join(words(4, 40) + passage + words(5, 40)), "de"),
        (21, " ".join(words(6, 90) + passage + words(7, 10)), None), (22, "\n".join(passage), "fr"),
        (30, None, "en"), (31, "", "en"), (32, " \t\n ", None), (33, "only three words", "en"), (34, "only three words", "en"),
        (35, "ONLY  three\twords", "en"), (40, "x", None), (41, "12 34 -- !!", "en"), (42, "é ü ñ ß 漢字 \U0001f600 ok", "de"),
        (50, " ".join(words(8, 30_000)), "en"), (51, "a" * 70_000, None), (52, "la " * 3000, "fr"),
        (None, " ".join(base) + ".", "en"), (None, None, None), (60, " ".join(words(9, 60)), "en"),
        (60, " ".join(words(9, 60)), "en"), (61, " ".join(words(10, 60)), "en"), (61, " ".join(words(11, 70) + passage), "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, lang, f"s{k % 3}" if k % 4 else None, None, "d", "r", 1, "old", "old", "old")
            for k, (i, t, lang) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def single(frame):
    """Rows by id and text, as the awkward table repeats ids."""
    return {(r["doc_id"], r["text"]): r for r in frame.collect()}
