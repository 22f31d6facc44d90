"""The pipeline's stages on the awkward table and the small test table, and every query's shape."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from llm.conftest_llm import SF, awkward_texts
from tidebar.llm import bpe, queries
from tidebar.llm.tables import written
from llm.test_passages import hit, kept_words, linked

import corpus_pipeline


def test_stages_decide_as_brute_force(spark, awkward):
    columns, docs, sizes = awkward.columns, awkward, []
    rows = [(i, t) for i, t, _ in awkward_texts()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
        got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
        if name == "language_id":
            rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
        elif name == "ngram_jaccard_join":
            rows = list({(i, t) for (i, t), (_, _, least) in zip(rows, linked(rows, 5, 80)) if least == i})
        elif name == "substring_dedup":
            kept = kept_words(rows, 50)
            rows = [x for x in rows if kept[x] or not x[1].encode().split()]
            assert sorted((repr(i), t.encode().split()) for i, t in got) == sorted((repr(i), kept[i, t].encode().split()) for i, t in rows)
            rows = got
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            rows = [x for x in rows if not hit(rows, items)[x][3]]
        assert got == sorted(rows, key=repr)
    codec = bpe.Codec(bpe.read_ranks(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert all(r["token_ids"] == plain.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["token_ids"]) for r in docs.collect())
    assert sizes[0] > sizes[1] > 0


def test_pipeline_runs_whole(spark, no_docs):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.7 * n < out.count() <= n
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_encoding_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    codec = bpe.Codec(bpe.read_ranks(queries.BPE_RANKS), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rows = queries.QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_passage_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = kept_words(texts, 50)
    rows = queries.QUERIES["op6_substring_dedup"](spark, SF).collect()
    text = dict(texts)
    assert {r["doc_id"]: r["kept_sha256"] for r in rows} == {
        d: hashlib.sha256(expected[d, text[d]].encode()).hexdigest() for d in text}


@pytest.mark.parametrize("name", ["op2_line_quality", "op3_perplexity_quality", "op5_token_rollup", "op9_language_id"])
def test_queries_without_sql_run_on_whole_tables(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == n if name != "op5_token_rollup" else sum(r["n_docs"] for r in rows) <= n


def python_nodes(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython [")


def test_no_python_function_is_planned_twice(spark, awkward):
    found = corpus_pipeline.language_id(spark, awkward, SF)
    assert python_nodes(found) == 1
    assert python_nodes(corpus_pipeline.encoded(spark, awkward, SF)) == 1
    assert python_nodes(corpus_pipeline.repeated_passages(spark, awkward, SF)) == 1
    assert python_nodes(queries.QUERIES["op1_byte_bpe"](spark, SF)) == 1
