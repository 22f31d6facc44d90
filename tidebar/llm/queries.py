"""Named queries of the operators over the test tables, each with an SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm import (bag_search, bpe, chat, decontaminate, jaccard_join, language, licences, packing, perplexity,
                         phrases, quality_lines, substring_dedup, token_rollup)
from tidebar.llm.tables import read, written
from tidebar.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def hex256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and their decoding."""
    both = bpe.round_trip(spark, BPE_RANKS, public_tokenizers.PATTERN)
    out = read(spark, sf_dir, "documents").select("doc_id", both("text").alias("both")).select("doc_id", "both.*")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents that lie in a 50-word passage of an earlier document."""
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", hex256("kept_words").alias("kept_sha256"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents inside 13-word windows of benchmark items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.annotate(docs, read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op7_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s+12], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
h AS (SELECT doc_id, s, x.n, item_id
      FROM (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)) x
      JOIN v ON v.n = x.n AND v.win = x.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of whole documents, and whether line-first cleaning keeps them."""
    out = quality_lines.clean_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "n_kept_words")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole document, learned from four documents in five."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.predict(docs.drop("lang"), language.train(docs))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant."""
    out = chat.rotate(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
    return out.select("conv_id", "perspective", "segment", F.col("n_turns").cast("long").alias("n_turns"), "rendered",
                      spans.alias("mask"))


ORACLES["op4_chat_rotation"] = f"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                                     coalesce(text, '')) - 1 AS "at" FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
x AS (SELECT t.conv_id, perspective, "at" // {chat.SEGMENT} AS segment, "at", role = perspective AS mine,
             '{chat.OPEN}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role
                                   ELSE 'user name=' || role END || chr(10) AS head,
             text || '<|im_end|>' || chr(10) AS body
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY "at") AS stop FROM x)
SELECT conv_id, perspective, segment, count(*) AS n_turns, string_agg(head || body, '' ORDER BY "at") AS rendered,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY "at") FILTER (WHERE mine), '') AS mask
FROM y GROUP BY 1, 2, 3
"""


@query
def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents, toxic ones deleted, poor ones counted anew by another tokenizer."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    first = token_rollup.counter(spark, BPE_RANKS, public_tokenizers.PATTERN)
    second = token_rollup.counter(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    counts = written(token_rollup.counted(docs, first, "byte_bpe_50k"), "counts")
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("load", token_rollup.inserts(counts))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("doc")).distinct()
    gone = token_rollup.deletes(counts.join(toxic, "doc", "left_semi"))
    rollup.commit("toxic", gone)
    rollup.commit("toxic", gone)                           # a batch sent twice counts once
    poor = labels.where("quality = 0 and toxic = 0").select(F.col("doc_id").alias("doc")).distinct()
    old = counts.join(poor, "doc", "left_semi")
    # texts are only scanned: a bitmap keeps most others from being counted anew, the exact join is on counts
    new = token_rollup.counted(token_rollup.likely(docs, "doc_id", poor, "doc"), second, "byte_bpe_multi_50k")
    new = written(new.join(poor, "doc", "left_semi"), "recounts")
    rollup.commit("recount", token_rollup.revisions(old, new))
    return rollup.totals()


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and lines that are a known licence or notice."""
    out = licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "whole_licence", F.array_join("licences", ",").alias("licences"), "n_notices")


def _canonical_sql(text: str) -> str:
    line = "lower(l)"
    for pattern in (licences.COPYRIGHT_LINE, licences.ALL_RIGHTS):
        line = f"regexp_replace({line}, '{pattern}', '')"
    for spelling, one in licences.SPELLINGS:
        line = f"replace({line}, '{spelling}', '{one}')"
    line = rf"trim(regexp_replace({line}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))"
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda l: {line}), lambda l: l <> '')"


_known = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.KNOWN)
ORACLES["op10_licence_scan"] = f"""
WITH k AS (SELECT array_to_string({_canonical_sql('text')}, ' ') AS unit, min(licence) AS licence
           FROM (VALUES {_known}) AS v(licence, text) GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql('text')} AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS unit, false AS whole FROM d
      UNION ALL SELECT doc_id, array_to_string(lines, ' '), true FROM d),
m AS (SELECT doc_id, min(licence) FILTER (WHERE whole) AS whole_licence,
             string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) FILTER (WHERE NOT whole) AS n_notices
      FROM u JOIN k USING (unit) GROUP BY 1)
SELECT doc_id, whole_licence, coalesce(licences, '') AS licences, coalesce(n_notices, 0) AS n_notices
FROM documents LEFT JOIN m USING (doc_id)
"""


@query
def op3_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of whole documents under a model of all documents labelled good, and whether it is low enough."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.classify(docs, read(spark, sf_dir, "labels").where("quality = 1"))


@query
def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole documents linked by 0.85 of their 4-word n-grams."""
    return jaccard_join.components(read(spark, sf_dir, "documents"), n=4, percent=85)


ORACLES["op8_jaccard_components"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM w),
t AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id
                    GROUP BY 1, 2) p
  JOIN s u ON u.doc_id = a JOIN s v ON v.doc_id = b WHERE 100 * n_both >= 85 * (len(u.g) + len(v.g) - n_both)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY 1, 2
"""


_WORD = r"[^\x20\x09-\x0D]+"
_quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_ends = "".join("\\" + c if c in "]" else c for c in quality_lines.ENDS).replace("'", "''")
ORACLES["op2_line_quality"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS MATERIALIZED (SELECT doc_id, line, regexp_extract_all(line, '{_WORD}') AS w
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
f AS (SELECT doc_id, line, len(w) AS n, NOT regexp_matches(w[-1], '[{_ends}]$')
        OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) > len(w)
        OR 2 * length(regexp_replace(line, '[^{quality_lines.SYMBOLS}]', '', 'g')) > len(w)
        OR 3 * len(list_filter(w, lambda x: x IN ({_quoted(sorted(quality_lines.SEPARATORS))}))) >= len(w)
        OR regexp_matches(lower(line), '{"|".join(quality_lines.BOILERPLATE)}') AS fails FROM l),
k AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS stay FROM f GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
        SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY 1),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^{quality_lines.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words, coalesce(stay, 0)::BIGINT AS n_kept_words
      FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND 2 * n_kept_words >= n_words AS kept FROM y
"""

ORACLES["op6_substring_dedup"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
h AS (SELECT doc_id, i FROM g JOIN (SELECT g, min(doc_id) AS owner FROM g GROUP BY 1) o USING (g) WHERE owner < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op11_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document cut into sequences of a power of two ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return bag_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op12_bag_search"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_FOLDED}, '{_TERM}') AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
t AS MATERIALIZED (SELECT r, w AS term, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY 1, 2),
i AS (SELECT item_id, term, count(*) AS often
      FROM (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term FROM benchmark) GROUP BY 1, 2),
v AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM t, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, r, CAST(sum(often * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM i JOIN v USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language among phrases found a hundred times in all documents."""
    return phrases.mine(read(spark, sf_dir, "documents"), support=100, longest=5, first=2000)


ORACLES["op13_phrase_mining"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d) WHERE len(w) > 0),
c AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
x AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT x.lang, x.phrase, a, p.f AS l, q.f AS r, n, cut, (1000 * a * n) // (p.f * q.f) AS score
      FROM x JOIN c ON c.lang = x.lang
      JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(w[1:cut], ' ')
      JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(w[cut+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN f ON f.lang = b.lang AND f.f >= b.a AND length(f.phrase) > length(b.phrase)
      AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM t WHERE rank <= 2000
"""
