"""Language proportions by expectation-maximisation over character n-gram likelihoods.

Training counts hashed n-grams per language over all labelled training texts. A document is taken as a
mixture: each of its n-grams was drawn from one of the languages. Expectation-maximisation estimates the
proportions; the language set grows by the language that raises the likelihood most, as long as that is worth
more than the penalty for one more parameter. The largest proportion names the language.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets: the model has so many rows for each language, whatever the data.
BUCKETS = 1 << 15
#: Languages that a model holds at most: 32 MB in all, from 8 million counts. More is an error, never a cut.
LANGUAGES = 256
LETTER = re.compile(r"[^\W\d_]")
#: Added to each count; weight of a new language in half log n (the Bayesian information criterion).
SMOOTH, PENALTY = 0.5, 1.0
STEPS = 25


def grams(text: str) -> np.ndarray:
    """Buckets of all character trigrams of the lower-cased letters, other runs being one blank."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code < 65) | ((code > 90) & (code < 97)) | ((code > 122) & (code < 170)), np.uint32(32), code)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1]) * np.uint64(0x85EBCA77) + code[2:]
        h = (h ^ (h >> np.uint64(15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def has_letter(text) -> bool:
    return isinstance(text, str) and LETTER.search(text) is not None


def count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of docs (text, lang) with both."""

    def run(batches):
        for x in batches:
            for lang, texts in x.groupby("lang").text:
                total = np.zeros(BUCKETS, np.int64)
                for t in texts:
                    total += np.bincount(grams(t), minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    rows = docs.selectExpr("cast(text as string) text", "cast(lang as string) lang").where("text is not null and lang is not null")
    return rows.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods [bucket, language]). The counts that reach the driver are bounded by
    BUCKETS times LANGUAGES; more languages raise an error."""
    counts = count(docs)
    if counts.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    c = counts.toPandas()
    langs = sorted(c.lang.unique())
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    for k, lang in enumerate(langs):
        own = c[c.lang == lang]
        table[own.bucket.to_numpy(), k] += own.n.to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table


def _em(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture; like[i, k] is n-gram i's probability in language k."""
    p = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(STEPS):
        each = like @ p
        new = p * (like.T @ (n / each)) / n.sum()
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return p, float(n @ np.log(like @ p))


def mixture(buckets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Each language's proportion in a text; 0 for those that the penalty leaves out."""
    at, n = np.unique(buckets, return_counts=True)
    logs = model[at]
    top = logs.max(1, keepdims=True)
    like, n = np.exp(logs - top).astype(float), n.astype(float)
    single = n @ np.log(np.maximum(like, 1e-30))
    chosen, out = [int(single.argmax())], np.zeros(model.shape[1])
    p, best = np.ones(1), float(single.max())
    price = PENALTY * 0.5 * np.log(n.sum())
    every, _ = _em(like, n) if model.shape[1] > 1 else (p, best)
    for k in np.argsort(-every, kind="stable"):
        if int(k) in chosen or every[k] < 0.01:
            continue
        q, value = _em(like[:, [*chosen, int(k)]], n)
        if value - best <= price:
            break
        chosen, p, best = [*chosen, int(k)], q, value
    out[chosen] = p
    return out


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages of every row of docs (doc_id, text), from the whole text alone.

    score is the share of the predicted language among the text's n-grams; languages holds all that were
    chosen, as "lang:share". A text without a letter, or null, is "und" with score 0, as is every text if
    nothing was learned. Ties go to the language first in order. Repeated rows come back as often; other
    columns are left aside; an empty table gives an empty one.
    """
    langs, _ = model
    # BUCKETS x LANGUAGES floats at most.
    table = docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches):
        m = table.value
        for x in batches:
            rows = []
            for t in x.text:
                if not langs or not has_letter(t):
                    rows.append(("und", 0.0, []))
                    continue
                p = mixture(grams(t), m)
                k = int(p.argmax())
                rows.append((langs[k], float(min(1.0, p[k])), [f"{langs[i]}:{p[i]:.4f}" for i in np.argsort(-p, kind="stable") if p[i] > 0]))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])
            out.insert(0, "doc_id", x.doc_id.to_numpy())
            yield out

    source = docs.selectExpr("cast(cast(doc_id as long) as string) doc_id", "cast(text as string) text")  # as text: a null among numbers makes them floats
    out = source.mapInPandas(run, "doc_id string, lang_pred string, score double, languages array<string>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def identify(docs: DataFrame) -> DataFrame:
    """predict() for all rows of docs (doc_id, text, lang) with held_out; the model learns from the others."""
    out = predict(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
