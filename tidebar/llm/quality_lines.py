"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much goes as a whole.

Base figures are taken over the whole text: words (runs without ASCII white space), their code points, symbols
`#*$%&|<>`, lines with a word that equal an earlier line, and words in 5-word windows found twice or more.

Rules for a line with a word; it fails if any holds:
* punctuation: it does not end in a sentence mark, a colon, a quote or a bracket, or most of its words end in two
  or more exclamation or question marks;
* symbols: it has more than one symbol per two words;
* navigation: a third of its words or more are separators such as `|` or `>`;
* boilerplate: it holds a phrase of `BOILERPLATE`.

A text is kept if the base figures pass and at least `KEEP_SHARE` of its words stand in lines that stay.  Defined
cases: a null text is like an empty one (no words, base fails, not kept); lines without a word are no lines; repeated
documents are each returned; extra columns pass through, and one
named like a result is replaced by it.  Each text is judged whole, on its own, in one pass.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebar.llm.tables import bounded_batches, carried

KEEP_SHARE = 0.5
MIN_WORDS = 10
REPEAT_SHARE = 20          # per cent of words in repeated windows
WINDOW = 5
#: Fixed values.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SEPARATORS = {"|", ">", ">>", "<", "<<", "/", "-", "»", "«", "·", "•", "›"}
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot password",
    "lorem ipsum", "page not found", "privacy policy", "share on facebook", "share this", "sign up for", "skip to content",
    "subscribe to", "terms of service", "terms of use", "use cookies",
)
ENDS = ".!?…:;\"')]}”’»。！？"

_ends = re.compile("[" + re.escape(ENDS) + "]$")
_shout = re.compile(r"[!?]{2,}$")
_boiler = re.compile("|".join(map(re.escape, BOILERPLATE)))
FIELDS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean," \
         "kept:boolean,n_kept_words:long,cleaned:string>"
NAMES = [field.split(":")[0] for field in FIELDS[7:-1].split(",")]


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows found twice or more, the first finding included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times, covered, last = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered += i + window - max(i, last)
            last = i + window
    return covered


def line_fails(line: str, words: list[str]) -> bool:
    n = len(words)
    if not _ends.search(words[-1]) or 2 * sum(1 for w in words if _shout.search(w)) > n:
        return True
    if 2 * sum(map(line.count, SYMBOLS)) > n:
        return True
    if 3 * sum(1 for w in words if w in SEPARATORS) >= n:
        return True
    return bool(_boiler.search(line.lower()))


def judge(text: str) -> tuple:
    """The FIELDS of one text."""
    words = text.encode().split()
    n, lines, staying, kept_words = len(words), [], [], 0
    for line in text.split("\n"):
        own = _split(line)
        if own:
            lines.append(line)
            if not line_fails(line, own):
                staying.append(line)
                kept_words += len(own)
    repeated = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > REPEAT_SHARE * n
    kept = not base_failed and kept_words >= KEEP_SHARE * n
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, base_failed, kept, kept_words, "\n".join(staying))


def _judge_all(texts: pa.Array) -> pa.Array:
    rows = [judge(v) for v in texts.to_pylist()]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base figures, base_failed, kept, n_kept_words and cleaned (the lines that stay)."""
    bounded_batches(docs.sparkSession)
    judged = F.arrow_udf(_judge_all, FIELDS)(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(carried(docs, *NAMES).alias("row"), judged.alias("judged"))
    return rows.select("row.*", "judged.*")
