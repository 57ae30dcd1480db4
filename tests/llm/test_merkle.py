"""The manifest against trees built in memory."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelcover.llm import merkle
from parcelcover.llm.sql import ORACLES

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, path string, at long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(digests):
    """Root, and for each leaf its siblings before and after, level by level."""
    paths, own = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for j, i in enumerate(own):
            run = i // 3 * 3
            paths[j].append((digests[run:i], digests[i + 1 : run + 3]))
            own[j] = i // 3
        digests = [sha("".join(digests[b : b + 3])) for b in range(0, len(digests), 3)]
    return digests[0] if digests else None, paths


def brute(rows):
    groups, subroots, paths, out = {}, {}, {}, []
    for k, r in enumerate(rows):
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), k))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        members = sorted(groups[s])
        subroots[s], found = tree([m[2] for m in members])
        paths |= {m[3]: p for m, p in zip(members, found, strict=True)}
    root, found = tree([subroots[s] for s in order])
    above = dict(zip(order, found, strict=True))
    for k, r in enumerate(rows):
        path, text = paths[k] + above[r["source"]], r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        digest = leaf_of(r, text)
        for before, after in path:
            digest = sha("".join(before) + digest + "".join(after))
        out.append((r["doc_id"], leaf_of(r, r["text"]), subroots[r["source"]], root, sha("".join("".join(a) + "".join(b) for a, b in path)), digest, digest == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_documents_and_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(rows_of(docs))
    assert got(merkle.manifest(docs)) == want and 0 < sum(r[-1] for r in want) < len(want)
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    sql = con.execute(ORACLES["op12_merkle_manifest"])
    assert [c[0] for c in sql.description] == COLUMNS and sorted(sql.fetchall(), key=str) == want


@pytest.mark.parametrize("rows", [[], [(1, "a\nb", "en", "s", 3)], [(1, "a\nb", "en", "s", 3), (2, None, None, None, None)], [(None, None, None, None, None)] * 4])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert got(merkle.manifest(df)) == brute(rows_of(df))


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_odd_rows(spark, sent, monkeypatch):
    """Nulls, repeats, many sources and a hot one; far ends sent to all and shuffled."""
    monkeypatch.setattr(merkle, "SENT", sent)
    pick = random.Random(8).choice
    rows = [(pick([None, *range(60)]), pick([None, "", "a\nb", "x\n\ny é" * 500]), pick([None, "en"]), pick([None, "", "a", "é", "hot", "hot", "hot", *"bcdefghij"]), pick([None, 5])) for _ in range(150)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert got(merkle.manifest(df)) == brute(rows_of(df))


def test_numbers_are_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 13).alias("a"))
    out = merkle.numbered(df, ["a"], "number").orderBy("number").collect()
    assert [r.number for r in out] == list(range(1000)) and [r.a for r in out] == sorted(r.a for r in out)
