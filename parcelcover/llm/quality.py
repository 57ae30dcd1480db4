"""Quality rules: how much of a text repeats.

Hashes of word n-grams of several lengths, rolled over each text in numpy, show which n-grams have occurred
before; the rules bound the share of characters inside them and inside repeated lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcover.llm.text import covered, encode, repeated, word_hashes

#: Most of a text's word characters inside n-grams seen before, by n. Twice the published repetition rules,
#: which are made for longer texts: in one of 60 words, a repeated sentence is a quarter of it.
MOST_IN_NGRAMS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: A text goes if more of its lines, and of the characters in them, repeat an earlier line.
MOST_LINES, MOST_IN_LINES = 0.30, 0.20
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
ROLL = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, worst_ngram_share double"


def _points(ws: list[bytes]) -> np.ndarray:
    """Code points of each word: bytes that don't continue one."""
    data = np.frombuffer(b"".join(ws), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)))
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.diff(total[ends], prepend=0)


def judge(text: str | bytes | None) -> tuple:
    """The values of COLUMNS of one text, or of its UTF-8 bytes. A null text is empty: no words, so base_failed."""
    raw = text if isinstance(text, bytes) else encode(text)
    ws = raw.split()
    n = len(ws)
    if not n:
        return 0, 0, 0, 0, 0, True, False, 0, 0.0
    points = _points(ws)
    chars = int(points.sum())
    lines = raw.split(b"\n")
    dup_lines = dup_chars = 0
    n_lines, line_chars = len(lines), sum(map(len, ws))
    if len(set(lines)) < n_lines:
        seen: set[bytes] = set()
        n_lines = 0
        for line in lines:
            if body := line.split():
                n_lines += 1
                if line in seen:
                    dup_lines += 1
                    dup_chars += sum(map(len, body))
                seen.add(line)
    h = word_hashes(ws)
    # A repeated n-gram begins with a repeated one of n - 1 words, so each length looks at those left by the last.
    at, roll, repeat_words, worst = np.arange(n), h, 0, 0.0
    for k in range(1, max(MOST_IN_NGRAMS) + 1):
        if k > 1:
            at = at[at + k <= n]
            with np.errstate(over="ignore"):
                roll = roll[: len(at)] * ROLL + h[at + k - 1]
        twice, later = repeated(roll)
        if k == 3:
            repeat_words = int(covered(at[twice], 3, n).sum())
        if k in MOST_IN_NGRAMS:
            worst = max(worst, float(points[covered(at[later], k, n)].sum()) / chars / MOST_IN_NGRAMS[k])
        at, roll = at[twice], roll[twice]
        if not len(at):
            break
    failed = n < 50 or 100 * repeat_words > 50 * n
    good = worst <= 1 and (dup_lines <= MOST_LINES * n_lines or dup_chars <= MOST_IN_LINES * line_chars)
    return n, chars, sum(map(raw.count, SYMBOLS)), dup_lines, repeat_words, failed, bool(not failed and good), dup_chars, worst


def assess(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS of every row of docs (doc_id, text), from the whole text.

    kept: not base_failed, at most the stated shares of characters in repeated n-grams, of repeated lines and
    of characters in these. worst_ngram_share is the largest share over its limit. A null or empty text has
    no words and fails. Repeated rows come back as often; other columns are left aside; an empty table gives
    an empty one.
    """

    def run(batches):
        for x in batches:
            out = pd.DataFrame([judge(t if isinstance(t, str) else None) for t in x.text], columns=[c.split()[0] for c in COLUMNS.split(", ")])
            out.insert(0, "doc_id", x.doc_id.to_numpy())
            yield out

    source = docs.selectExpr("cast(cast(doc_id as long) as string) doc_id", "cast(text as string) text")  # as text: a null among numbers makes them floats
    return source.mapInPandas(run, f"doc_id string, {COLUMNS}").withColumn("doc_id", F.col("doc_id").cast("long"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns, in one pass over the table.

    Null, empty and blank texts have too few words and go; rows without doc_id and repeated rows are judged like
    others, each by itself; columns of any name pass through. An empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches):
        for x in batches:
            texts = x.column(at).cast(pa.binary())  # no copy; one text at a time becomes an object
            yield x.filter(pa.array([judge(texts[i].as_py())[6] for i in range(len(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
