"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are k-mers of words, chosen by winnowing: of any window of consecutive k-mers the one with the smallest
hash is taken, so that two texts that share a run of window + k - 1 words share a seed, wherever the run
stands. Each seed's first place (smallest document, then position) stands for all of its places, so a passage
in n documents gives n - 1 matches and not n squared. Where neighbouring seeds of a document were first seen in
different documents, the two together are a seed of their own, with its own first place: so a passage whose
words all occur earlier, but scattered, still meets the document that has it whole. A document's matches with
one other document are chained: the best chain of matches in order in both, with a cost for the gaps between
them, comes from a Fenwick tree of prefix maxima. The words of each chain, with some around it, are then
aligned, which finds where the passage begins and ends and how much of it agrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcover.llm.text import WORD, free, ngram_hashes, repeated, word_hashes, words
from parcelcover.plans.materialize import materialize, release, sweep

WORDS = re.compile(WORD)
#: Words in a seed; k-mers in a window.
K, WINDOW = 4, 4
#: Words that a passage has at least, and its share of agreeing words.
LEAST, SIMILAR = 50, 0.8
#: Words between two seeds of a chain at most, in either text, and words looked at beyond its ends.
GAP, BEYOND = 64, 48
#: Value of a seed, and cost of each word from one seed of a chain to the next, in either text. Two seeds in order
#: within GAP words are always worth more together than apart.
VALUE, COST = float(K), 0.03
#: Words between two seeds that form a pair at most.
NEXT = 16
#: Words on each side of a chain of one seed that are compared before its texts are fetched, and how many of them
#: must be common on one side. A passage of LEAST words holds all SIDE words of one side at least.
SIDE, COMMON = 16, 8
#: Parts in which the seeds are shuffled, one after the other: the disk holds one part's shuffles at a time.
SLICES = 2


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest (the last of equals) of every window of hashes; of all, if they are fewer."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())])
    # The upper bits of a hash, with the place below, make ties go to the last.
    n = len(h)
    low, width = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - np.arange(n).astype(np.uint64) % np.uint64(1 << 24)), 1
    while width * 2 <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: n - window + 1], low[window - width : window - width + n - window + 1])
    place = (np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))).astype(np.int64)
    first = np.arange(len(place))
    place += (first - place + (1 << 24) - 1 >> 24) << 24  # places are known modulo 2 to the power 24
    new = np.ones(len(place), bool)  # places rise from window to window
    new[1:] = place[1:] != place[:-1]
    return place[new]


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(h, doc_id, pos, lead): the seeds of every text, words lower-cased; pos is the first word's number, lead the
    text's first seed of its hash."""

    def run(batches):
        for x in batches:
            ids, places, hashes, leads = [], [], [], []
            for doc, text in zip(x.doc_id.to_numpy(), x.text, strict=True):
                h = ngram_hashes(word_hashes(words(text, lower=True)), k)
                at = winnow(h, window)
                ids.append(np.full(len(at), doc, np.int64))
                places.append(at)
                hashes.append(h[at])
                leads.append(~repeated(h[at])[1])
            if ids:
                yield pd.DataFrame({"h": np.concatenate(hashes).view(np.int64), "doc_id": np.concatenate(ids), "pos": np.concatenate(places).astype(np.int32), "lead": np.concatenate(leads)})

    return docs.mapInPandas(run, "h long, doc_id long, pos int, lead boolean")


class PrefixMax:
    """Fenwick tree: the largest (value, tag) among places up to one."""

    def __init__(self, n: int):
        self.tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, entry: tuple[float, int]) -> None:
        place += 1
        while place < len(self.tree):
            if entry > self.tree[place]:
                self.tree[place] = entry
            place += place & -place

    def get(self, place: int) -> tuple[float, int]:
        best = (float("-inf"), -1)
        place += 1
        while place > 0:
            if self.tree[place] > best:
                best = self.tree[place]
            place -= place & -place
        return best


def scores(pos: list[int], ref: list[int]) -> tuple[list[float], list[int]]:
    """(score, predecessor or -1) of the best chain that ends in each seed (pos, ref); seeds are sorted by pos.

    A chain rises in both texts. Its score is VALUE a seed less COST for each word from one seed to the next, in
    both texts together, which is a difference of two sums of places: so the best predecessor of a seed is the
    largest score plus COST times its places among the seeds before it in both texts. The seeds come in the order
    of pos, those of the same pos together; the tree holds those before, in the order of ref.
    """
    rank = {r: i for i, r in enumerate(sorted(set(ref)))}
    tree, n = PrefixMax(len(rank)), len(pos)
    score, back, i = [VALUE] * n, [-1] * n, 0
    while i < n:
        stop = i
        while stop < n and pos[stop] == pos[i]:
            held, j = tree.get(rank[ref[stop]] - 1)
            if j >= 0 and (total := held + VALUE - COST * (pos[stop] + ref[stop])) > VALUE:
                score[stop], back[stop] = total, j
            stop += 1
        for k in range(i, stop):
            tree.put(rank[ref[k]], (score[k] + COST * (pos[k] + ref[k]), k))
        i = stop
    return score, back


def chains(pos: list[int], ref: list[int], gap: int = GAP) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, ref start, ref end, seeds) of the chains of seeds (pos, ref), sorted by pos; ends are seeds' places.

    Best chains are taken first; a seed is in one chain. A chain is parted where two of its seeds are more than
    gap words from each other in either text.
    """
    n = len(pos)
    # Most matches lie on one diagonal without a large step: these are one chain as they stand.
    if all(0 < pos[i + 1] - pos[i] <= gap and ref[i + 1] - ref[i] == pos[i + 1] - pos[i] for i in range(n - 1)):
        yield pos[0], pos[-1], ref[0], ref[-1], n
        return
    score, back = scores(pos, ref)
    used = [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        own, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            own.append(at)
            at = back[at]
        end = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or max(pos[own[k - 1]] - pos[own[k]], ref[own[k - 1]] - ref[own[k]]) > gap:
                yield pos[own[k - 1]], pos[own[end]], ref[own[k - 1]], ref[own[end]], k - end
                end = k


def apart(rows: list[tuple], least: int) -> list[tuple]:
    """Of rows that begin with (start, stop), the longest first, those with least words that no longer one has.

    In a text that repeats itself, every turn of the repetition matches the same place of the other text.
    """
    if len(rows) < 2:
        return rows
    kept, taken = [], np.zeros(max(r[1] for r in rows), bool)
    for r in sorted(rows, key=lambda r: (r[0] - r[1], r)):
        if np.count_nonzero(~taken[r[0] : r[1]]) >= least:
            taken[r[0] : r[1]] = True
            kept.append(r)
    return kept


def document_chains(refs: dict[int, tuple[list[int], list[int]]], k: int = K, gap: int = GAP) -> list[tuple]:
    """(ref_id, start, stop, ref_start, ref_stop) of one document's chains; one of a single seed, too, is judged by its
    alignment only, as edits may leave a passage one seed."""
    return sorted((ref, *row[:2], *row[3:5]) for ref, (pos, at) in refs.items() for row in apart([(a, b + k, ref, c, d + k) for a, b, c, d, _ in chains(pos, at, gap)], k))


def by_document(batches, columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """(doc_id, rows) of batches sorted by doc_id; a document has no more rows than words."""
    key, rows = None, []
    for x in batches:
        for row in zip(*(x.iloc[:, i].tolist() for i in range(columns)), strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def in_frames(rows: Iterator[tuple], names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def matches(seen: DataFrame, key: str, lead: str = "true", slices: int = SLICES) -> DataFrame:
    """(doc_id, pos, ref_id, ref_pos, h) of the places of keys that stand first in another document.

    seen has (key, doc_id, pos); rows with lead hold each key once a document. The keys are taken in slices of their
    values, one after the other, so that only a slice is shuffled at a time; each is written.
    """
    parts = []
    for k in range(slices):
        own = seen.where(F.pmod(F.col(key), F.lit(slices)) == k)
        first = own.where(lead).groupBy(F.col(key).alias("fh")).agg(F.min("doc_id").alias("ref_id"), F.min_by("pos", "doc_id").alias("ref_pos"), F.max("doc_id").alias("last"))
        # Written, so that both sides of the join are plain shuffles and a very common seed's partition can be split.
        first = materialize(first.where("last > ref_id").drop("last"), "firsts")
        # Hashed, so that the many keys that match nothing needn't be sorted.
        found = own.join(first.hint("shuffle_hash"), F.col(key) == F.col("fh")).where("doc_id <> ref_id")
        parts.append(materialize(found.select("doc_id", "pos", "ref_id", "ref_pos", F.col(key).alias("h")), "matches"))
        release(first)
        sweep(seen.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def by_place(found: DataFrame) -> DataFrame:
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "ref_id", "ref_pos")


def breaks(matched: list[tuple], reach: int = NEXT) -> dict[int, int]:
    """Place of each pair of neighbouring matches (doc_id, pos, ref_id, ref_pos, h) with different documents, by the pair's hash."""
    found: dict[int, int] = {}
    for a, b in zip(matched, matched[1:], strict=False):
        if a[2] != b[2] and 0 < b[1] - a[1] <= reach:
            found.setdefault((a[4] * 0x9E3779B97F4A7C15 + b[4] * 0xC2B2AE3D27D4EB4F + b[1] - a[1]) & 0x7FFFFFFFFFFFFFFF, a[1])
    return found


def candidates(docs: DataFrame, k: int = K, window: int = WINDOW, gap: int = GAP) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, ref_id, start, stop, ref_start, ref_stop, sure) of chains, in words, where ref_id has the passage first;
    and the tables that it reads. sure: of more than one seed."""
    s = materialize(seeds(docs, k, window), "seeds")
    found = matches(s, "h", "lead")
    release(s)
    names = ["doc_id", "ref_id", "start", "stop", "ref_start", "ref_stop", "sure", "pair"]
    schema = "doc_id long, ref_id long, start int, stop int, ref_start int, ref_stop int, sure boolean, pair long"

    def chained(pairs: bool):
        def run(batches):
            def rows():
                for doc, matched in by_document(batches, 5):
                    refs: dict[int, tuple[list[int], list[int]]] = {}
                    for _, p, ref, q, _ in matched:
                        own = refs.setdefault(ref, ([], []))
                        own[0].append(p)
                        own[1].append(q)
                    for row in document_chains(refs, k, gap):
                        yield doc, *row, not pairs or row[2] - row[1] > k, -1
                    if pairs:
                        for pair, p in breaks(matched).items():
                            yield doc, -1, p, p, p, p, True, pair

            yield from in_frames(rows(), names)

        return run

    # Chains, and pairs of seeds (whose number is in pair, of chains -1), in one pass over the matches.
    both = materialize(by_place(found).mapInPandas(chained(True), schema), "chains")
    release(found)
    sweep(docs.sparkSession)
    pairs = both.where("pair >= 0").select("doc_id", F.col("start").alias("pos"), "pair")
    more = matches(pairs, "pair", slices=1)
    return both.where("pair < 0").unionByName(by_place(more).mapInPandas(chained(False), schema)).drop("pair"), [both, more]


def nearest_run(x: list[bytes], y: list[bytes], inside: bool) -> tuple[int, int] | None:
    """Where in x and y the first of their matching blocks begins that has three words and, unless inside, more than it skips.

    The blocks are difflib's. The longest is found first; behind it none fits if it doesn't, so only what lies before it
    is searched on.
    """
    blocks, found, a, b = SequenceMatcher(None, x, y, autojunk=False), None, len(x), len(y)
    while (m := blocks.find_longest_match(0, a, 0, b)).size >= 3:
        a, b = m.a, m.b
        if inside or m.size > max(a, b):
            found = a, b
    return found


def walk(a: list[bytes], b: list[bytes], inside: int) -> tuple[int, int, int]:
    """Aligns a and b from their beginnings; (words of a, words of b, agreeing words) up to the last agreeing one.

    Where words differ, the next window of both is compared, and the walk goes on at the nearest run that
    agrees. Beyond the first inside words of a, it goes on only if that run is longer than what it skips.
    """
    i = j = agree = 0
    end = (0, 0, 0)
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, agree = i + 1, j + 1, agree + 1
        end = (i, j, agree) if agree > end[2] else end
        if i >= len(a) or j >= len(b):
            return end
        x, y = a[i : i + GAP], b[j : j + GAP]
        # Only runs of three words or more count below; mostly there are none.
        if set(zip(x, x[1:], x[2:], strict=False)).isdisjoint(zip(y, y[1:], y[2:], strict=False)):
            return end
        step = nearest_run(x, y, i < inside)
        if step is None:
            return end
        i, j = i + step[0], j + step[1]


def align(a: list[bytes], b: list[bytes], a_at: tuple[int, int], b_at: tuple[int, int]) -> tuple[int, int, int, int, int]:
    """(start, stop, ref start, ref stop, agreeing words) of the passage around a chain at a_at and b_at."""
    x, y, agree = walk(a[a_at[0] :], b[b_at[0] :], a_at[1] - a_at[0])
    u, v, more = walk(a[: a_at[0]][::-1], b[: b_at[0]][::-1], 0)
    return a_at[0] - u, a_at[0] + x, b_at[0] - v, b_at[0] + y, agree + more


def _block(start: str, stop: str) -> tuple:
    """The words to fetch for a chain: BEYOND more on both sides, in whole steps of 32, so that requests repeat."""
    return (F.floor(F.greatest(F.lit(0), F.col(start) - BEYOND) / 32) * 32).cast("int"), (F.ceil((F.col(stop) + BEYOND) / 32) * 32).cast("int")


def _per_document(docs: DataFrame, wanted: DataFrame, schema: str, ready, cut) -> DataFrame:
    """cut(ready(words), ask) rows, with doc_id in front, of every document that wanted (doc_id, ask long) asks for; each ask once."""
    asked = wanted.distinct().groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("ask").alias("asks"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        def rows():
            for x in batches:
                for doc, text, asks in zip(x.doc_id.tolist(), x.text, x.asks, strict=True):
                    own = ready(words(text, lower=True))
                    for ask in asks.tolist():
                        yield doc, *cut(own, ask)

        yield from in_frames(rows(), names, 2000)

    return docs.join(asked, docs.doc_id == asked.id).select("doc_id", "text", "asks").mapInPandas(run, schema)


def marks(ws: list[bytes]) -> np.ndarray:
    """16-bit hashes of the words, never 0, between SIDE and more zeros at both ends."""
    out = np.zeros(len(ws) + 3 * SIDE, np.uint16)
    out[SIDE : SIDE + len(ws)] = (word_hashes(ws) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def around(marked: np.ndarray, at: int, k: int) -> bytes:
    """The marks of the SIDE words before and after k words at a place; 0 where there are none."""
    return marked[at : at + SIDE].tobytes() + marked[at + SIDE + k : at + 2 * SIDE + k].tobytes()


def promising(found: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """found without those chains of one seed that have too few words in common on both sides of it."""
    single, names = found.where("not sure"), found.columns
    ask = lambda at: F.col(at).cast("long").alias("ask")
    wanted = single.select("doc_id", ask("start")).unionByName(single.select(F.col("ref_id").alias("doc_id"), ask("ref_start")))
    near = materialize(_per_document(docs, wanted, "doc_id long, at int, near binary", marks, lambda m, at: (at, around(m, at, k))), "near")
    sweep(docs.sparkSession)
    both = single.join(near.select("doc_id", F.col("at").alias("start"), F.col("near").alias("mine")), ["doc_id", "start"])
    both = both.join(near.select(F.col("doc_id").alias("ref_id"), F.col("at").alias("ref_start"), F.col("near").alias("theirs")), ["ref_id", "ref_start"])

    def choose(batches):
        for x in batches:
            for n in range(0, len(x), 4096):
                part = x.iloc[n : n + 4096]
                a, b = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(-1, 2, SIDE) for c in ("mine", "theirs"))
                common = ((a[..., :, None] == b[..., None, :]).any(3) & (a > 0)).sum(2).max(1)
                yield part.loc[common >= COMMON, names]

    kept = both.select(*names, "mine", "theirs").mapInPandas(choose, found.schema)
    out = materialize(found.where("sure").unionByName(kept), "promising")
    release(near)
    sweep(docs.sparkSession)
    return out


def passages(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, ref_id, start, stop, ref_start, ref_stop, agree, similarity, span_start, span_stop.

    A row is a passage that doc_id's text shares with ref_id's, the document of smallest doc_id that has it (or
    most of its seeds) first. start and stop count words of the rules' kind, lower-cased. similar of its words
    agree. Passages of a document that touch or overlap form a span, which has at least least words; a span of
    several passages has them from several documents. What a text repeats of itself alone is no row. Texts are
    whole. Rows without doc_id or text take no part; of rows with the same doc_id the seeds are those of all, and
    words are taken from one. Ties of seeds go to the smallest id and place. An empty table gives an empty one;
    other columns are left aside.
    """
    d = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null")
    chained, read = candidates(d, k, window)
    found = materialize(chained.distinct(), "candidates")
    for table in read:
        release(table)
    sweep(docs.sparkSession)
    one = d.groupBy("doc_id").agg(F.min("text").alias("text")) if d.groupBy("doc_id").count().where("count > 1").limit(1).count() else d
    kept = promising(found, one, k)
    release(found)
    s, e = _block("start", "stop")
    t, f = _block("ref_start", "ref_stop")
    found = kept.drop("sure").withColumns({"s": s, "e": e, "t": t, "f": f})
    # Distinct ranges, so what thousands of documents ask of one is asked once.
    ask = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long")).alias("ask")
    wanted = found.select("doc_id", ask("s", "e")).unionByName(found.select(F.col("ref_id").alias("doc_id"), ask("t", "f")))
    cut = lambda ws, r: ((s := r >> 32), (e := r & 0xFFFFFFFF), b" ".join(ws[s:e]).decode("utf-8", "surrogatepass"))
    pieces = materialize(_per_document(one, wanted, "doc_id long, s int, e int, piece string", list, cut), "pieces")
    sweep(docs.sparkSession)
    both = found.join(pieces.withColumnRenamed("piece", "mine"), ["doc_id", "s", "e"])
    both = both.join(pieces.select(F.col("doc_id").alias("ref_id"), F.col("s").alias("t"), F.col("e").alias("f"), F.col("piece").alias("theirs")), ["ref_id", "t", "f"])
    both = both.select("doc_id", "ref_id", "start", "stop", "ref_start", "ref_stop", "s", "t", "mine", "theirs")

    def compare(batches):
        def rows():
            for x in batches:
                for doc, ref, a, b, c, g, s0, t0, mine, theirs in x.itertuples(index=False, name=None):
                    u, v, w, z, agree = align(words(mine), words(theirs), (a - s0, b - s0), (c - t0, g - t0))
                    if agree >= similar * max(v - u, z - w) and agree >= 3 * k:
                        yield doc, ref, u + s0, v + s0, w + t0, z + t0, agree, agree / max(v - u, z - w)

        yield from in_frames(rows(), names[:8])

    def merge(batches):
        def rows():
            for _, every in by_document(batches, 8):
                refs: dict[int, list[tuple]] = {}
                for row in every:
                    refs.setdefault(row[1], []).append((row[2], row[3], row))
                own = sorted((r[2] for rows in refs.values() for r in apart(rows, k)), key=lambda r: (r[2], r[3], r[1]))
                group, end = [], -1
                for row in [*own, None]:
                    if row is None or group and row[2] > end:
                        if end - group[0][2] >= least:
                            yield from ((*g, group[0][2], end) for g in group)
                        group, end = [], -1
                    if row:
                        group.append(row)
                        end = max(end, row[3])

        yield from in_frames(rows(), names)

    names = ["doc_id", "ref_id", "start", "stop", "ref_start", "ref_stop", "agree", "similarity", "span_start", "span_stop"]
    schema = "doc_id long, ref_id long, start int, stop int, ref_start int, ref_stop int, agree int, similarity double"
    aligned = both.mapInPandas(compare, schema).repartition("doc_id").sortWithinPartitions("doc_id", "start", "stop", "ref_id")
    return aligned.mapInPandas(merge, f"{schema}, span_start int, span_stop int")


def remove(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """docs with the spans of passages() taken out of the texts, which keep each passage's first place.

    The words left are as they were, with their white space; a text that loses all its words goes. Texts
    without passages, and rows without doc_id or text, stay as they are. Rows with the same doc_id lose the same
    spans. Columns of any other name pass through; an empty table gives an empty one.
    """
    own, spans_of = free(docs, "span_doc"), free(docs, "spans")
    spans = passages(docs, least, similar).select("doc_id", "span_start", "span_stop").distinct()
    spans = spans.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_stop"))).alias(spans_of))
    at = docs.columns.index("text")

    def run(batches):
        for x in batches:
            cuts = x.column(x.num_columns - 1)
            touched = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if not len(touched):
                yield pa.RecordBatch.from_arrays(x.columns[:-1], names=x.schema.names[:-1])
                continue
            # Only texts that lose something become objects, one at a time; the others stay in their buffers.
            texts, keep = [without(x.column(at)[int(i)].as_py(), [(q["span_start"], q["span_stop"]) for q in cuts[int(i)].as_py()]) for i in touched], np.ones(x.num_rows, bool)
            keep[touched] = [bool(words(t)) for t in texts]
            mask = np.zeros(x.num_rows, bool)
            mask[touched] = True
            column = pc.replace_with_mask(x.column(at), pa.array(mask), pa.array(texts, x.schema.field(at).type))
            columns = [column if i == at else x.column(i) for i in range(x.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=x.schema.names[:-1]).filter(pa.array(keep))

    joined = docs.join(spans, docs.doc_id.cast("long") == F.col(own), "left").drop(own)
    return joined.mapInArrow(run, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and the white space behind them."""
    places = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        if s >= len(places):  # another text of the same doc_id has the span
            break
        out.append(text[last : places[s][0]])
        last = places[e][0] if e < len(places) else len(text)
    return "".join([*out, text[last:]])
