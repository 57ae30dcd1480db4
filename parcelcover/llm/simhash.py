"""SimHash near-dedup: vantage-point trees over fingerprints.

Two 64-bit fingerprints that differ in at most k bits agree, in at least one of four quarters of 16 bits,
within floor(k / 4) bits. Each quarter is a metric space with Hamming distance. For each, a vantage-point
tree, fitted on a bounded sample, cuts the space into shards; every fingerprint has one home shard, and
visits those further shards that the triangle inequality can't exclude (a branch "distance to the vantage
at most r" is closed to a point farther than r + tolerance, its complement to one nearer than r + 1 -
tolerance). Inside a shard the same rule goes on splitting, and what is left is compared in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from parcelcover.llm.components import components
from parcelcover.llm.text import free, words
from parcelcover.plans.materialize import materialize, release

QUARTERS = 4
#: Fingerprints on which the trees are fitted; every fingerprint is indexed. A quarter has 65536 values, so more
#: leaves than that can't be told apart; what a full leaf holds is dealt out as a grid of blocks.
SAMPLE = 65536
#: Members that a shard should have, and the most that one task takes of one side.
SHARD, BLOCK = 8192, 65536
#: Words in a shingle of the near-dedup stage, and the similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Bits within which the stage looks for candidates; near copies differ in 8 on average at similarity 0.8.
WITHIN = 15
#: Texts of the sample at least that says which shingles are common; the most of them kept, and the texts that make one.
FIT, COMMON, RARE = 16384, 1 << 17, 4
#: Points of one shared shingle among which nearest() looks, and the most that meet in one cell.
WINDOW, CELL = 256, 2048
#: Texts of one group of candidates that are compared in one task, and their shingles; texts of it that all its tasks see.
TEXTS, HELD, HUBS = 1024, 1 << 21, 32
#: Bits of a leaf's number, and of a block's row and column in its grid: 2 ** 20 blocks a side of 65536 members each.
LEAF, SIDE = 17, 20
PARITY = ["p0", "p1", "p2", "p3"]


def _spans(ws: list[bytes], n: int) -> list[tuple[int, int]]:
    """Where the runs of n words begin and end among ws joined by one byte."""
    ends = (np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1).tolist()
    return list(zip([0, *(e + 1 for e in ends[:-1])], ends[min(n, len(ws)) - 1 :], strict=False))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of n lower-cased words; fewer words are one run, no words none."""
    ws = words(text, lower=True)
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[s:e]) for s, e in _spans(ws, n)], np.uint64))


def parities(found: np.ndarray) -> np.ndarray:
    """256 bits: which classes of hashes have an odd number of shingles. Two sets differ in at least as many shingles
    as their parities differ in bits, so a pair with too many differing bits is not similar."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is 1 in over half of the XXH64 of all runs of n lower-cased words; no words: 0.

    Fewer than n words are one run. The hashes are summed in blocks, so a long text takes bounded memory.
    """
    ws = words(text, lower=True)
    if not ws:
        return 0
    joined = b" ".join(ws)
    runs, spans, digest = max(1, len(ws) - n + 1), _spans(ws, n), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, runs, 16384):
        h = np.array([digest(joined[s:e], seed) for s, e in spans[at : at + 16384]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > runs, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _quarter(fp: np.ndarray, q: int) -> np.ndarray:
    return ((fp >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.uint16)


def _vantage(values: np.ndarray, tolerance: int) -> tuple[np.uint16, int] | None:
    """A point and a radius that part values evenly with few near the border; None if all are equal."""
    best = None
    for v in np.unique(values[np.linspace(0, len(values) - 1, 5).astype(int)]):
        count = np.bincount(_distance(values, v), minlength=18)
        below = np.cumsum(count)
        for r in range(17):
            if 0 < below[r] < len(values):
                inner = below[min(17, r + tolerance)]
                outer = len(values) - (below[r - tolerance] if r >= tolerance else 0)
                cost = inner * below[r] + outer * (len(values) - below[r])
                if best is None or cost < best[0]:
                    best = (cost, v, r)
    return best and best[1:]


def plant(values: np.ndarray, levels: int, tolerance: int) -> list:
    """A tree as nested lists [vantage, radius, near, far]; a leaf is its number."""
    leaves = iter(range(1 << (levels + 1)))

    def grow(v: np.ndarray, level: int):
        cut = _vantage(v, tolerance) if level and len(v) > 1 else None
        if cut is None:
            return next(leaves)
        near = _distance(v, cut[0]) <= cut[1]
        return [cut[0], cut[1], grow(v[near], level - 1), grow(v[~near], level - 1)]

    return grow(values, levels)


def visits(tree, values: np.ndarray, tolerance: int):
    """Yields (leaf, indices of the values that may have a partner there, which of them live there)."""
    todo = [(tree, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, list):
            yield node, at, home
            continue
        d = _distance(values[at], node[0]).astype(np.int16)
        near, far = d - tolerance <= node[1], d + tolerance > node[1]
        todo.append((node[2], at[near], home[near] & (d[near] <= node[1])))
        todo.append((node[3], at[far], home[far] & (d[far] > node[1])))


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def shard_links(fp: np.ndarray, member: np.ndarray, query: np.ndarray, q: int, bits: int) -> np.ndarray:
    """For each point of a shard the first point that links reach; links have a member and a query within bits."""
    root, band = np.arange(len(fp)), _quarter(fp, q)
    tolerance = bits // QUARTERS
    todo = [(np.flatnonzero(member), np.flatnonzero(query))]
    while todo:
        m, s = todo.pop()
        if not len(m) or not len(s):
            continue
        cut = _vantage(band[m], tolerance) if len(m) > 64 and len(m) * len(s) > 1 << 16 else None
        if cut is None:
            rows = max(1, (1 << 20) // len(m))
            for k in range(0, len(s), rows):
                i, j = np.nonzero(_distance(fp[s[k : k + rows], None], fp[None, m]) <= bits)
                _union(root, s[k + i], m[j])
            continue
        dm, ds = _distance(band[m], cut[0]).astype(np.int16), _distance(band[s], cut[0]).astype(np.int16)
        todo.append((m[dm <= cut[1]], s[ds - tolerance <= cut[1]]))
        todo.append((m[dm > cut[1]], s[ds + tolerance > cut[1]]))
    return root


def links(points: DataFrame, bits: int = 4, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links that join just those of points (fp long, distinct; id long) within bits, over chains.

    From each shard comes a spanning forest, at most one row a point, so a group of copies never gives all
    its pairs.
    """

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        q = int(x.cell.iloc[0]) >> LEAF + 2 * SIDE
        root = shard_links(x.fp.to_numpy(np.int64).view(np.uint64), x.member.to_numpy(), x["query"].to_numpy(), q, bits)
        ids, moved = x.id.to_numpy(), root != np.arange(len(root))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return routed(points, bits, shard, block, sample).groupBy("cell").applyInPandas(compare, "a long, b long").distinct()


def routed(points: DataFrame, bits: int, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """points (fp long, id long, others) with cell, member and query: a member and a query within bits share a cell.

    A shard with over block members is dealt out as a grid of blocks of members and of queries.
    """
    more = [f for f in points.schema.fields if f.name not in ("fp", "id")]
    if not 0 <= bits < 16:
        raise ValueError("bits must be from 0 to 15")
    tolerance = bits // QUARTERS
    fps = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    levels = max(0, int(np.ceil(np.log2(max(1, points.count()) / shard)))) if len(fps) else 0
    trees = [plant(_quarter(fps, q), min(levels, 16), tolerance) for q in range(QUARTERS)]

    def homes(batches):
        for x in batches:
            fp = x.fp.to_numpy(np.int64).view(np.uint64)
            for q, tree in enumerate(trees):
                for leaf, _, home in visits(tree, _quarter(fp, q), 0):
                    if home.any():
                        yield pd.DataFrame({"cell": [q << LEAF | leaf], "n": [int(home.sum())]})

    # At most four times the leaves of a tree: bounded by the depth. Only crowded ones come.
    crowd = points.select("fp").mapInPandas(homes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block).collect()
    grid = {r.cell: -(-r.n // block) for r in crowd}

    def route(batches):
        for x in batches:
            fp, ids = x.fp.to_numpy(np.int64).view(np.uint64), x.id.to_numpy(np.int64)
            for q, tree in enumerate(trees):
                values, own = _quarter(fp, q), np.zeros(len(fp), np.int64)
                found = list(visits(tree, values, tolerance))
                for leaf, at, home in found:
                    own[at[home]] = leaf
                for leaf, at, home in found:
                    use = home | (leaf > own[at])  # of two home shards the later one gets the other's point
                    at, home, g = at[use], home[use], grid.get(q << LEAF | leaf, 1)
                    row, column = (fp[at] % np.uint64(g)).astype(np.int64), (fp[at] // np.uint64(g) % np.uint64(g)).astype(np.int64)
                    for i in range(g):
                        for j in range(g):
                            m, s = home & (row == i), column == j
                            if (k := m | s).any():
                                yield pd.DataFrame({"cell": (q << LEAF | leaf) << 2 * SIDE | i << SIDE | j, "fp": fp[at[k]].view(np.int64), "id": ids[at[k]], "member": m[k], "query": s[k]} | {f.name: x[f.name].to_numpy()[at[k]] for f in more})

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return points.mapInPandas(route, f"cell long, fp long, id long, member boolean, query boolean{extra}")


def near_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text).

    Fingerprints link at bits or fewer differing bits; component_id is the smallest doc_id over links.
    Null and empty texts have fingerprint zero and link like others. Repeated rows come back as often. A
    row without doc_id keeps its fingerprint; it takes its group's component_id, null if no row of the
    group has an id. Other columns are left aside. An empty table gives an empty one.
    """
    marked = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(F.col("text").cast("string")).alias("fp")), "fingerprints")
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "points")
    label = components(links(points.where("id is not null"), bits))
    groups = points.join(label, points.id == label.node, "left").select("fp", F.coalesce("label", "id").alias("component_id"))
    return marked.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rare_first(texts: DataFrame, fit: int = FIT, most: int = COMMON, least: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; their ranks, the rarer the less) of common shingles: those in least texts or more of a sample of
    texts (__doc, text), at most so many. The sample holds fit texts or up to twice as many, however many there are."""

    def run(batches):
        for x in batches:
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *map(shingles, x.text)]).view(np.int64)})

    some = texts.where(F.pmod(F.xxhash64("__doc"), F.lit(max(1, texts.count() // fit))) == 0).select("text")
    counts = some.mapInPandas(run, "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).toPandas()
    known = counts.h.to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(known)
    return known[by_hash], len(known) - 1 - by_hash


def prefix(found: np.ndarray, known: np.ndarray, rank: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The first of a sorted set of shingles, in one order for all sets: by hash, common ones last, the rarest of them first.

    Two sets of the similarity share so many shingles that the first n - similar * n + 1 of each have one in common.
    """
    if not len(found):
        return found
    p = len(found) - int(np.ceil(similar * len(found) - 1e-9)) + 1
    if not len(known):
        return found[:p]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    common = known[at] == found
    first = found[~common][:p]
    return first if len(first) == p else np.concatenate([first, found[common][np.argsort(rank[at[common]])][: p - len(first)]])


def key_pairs(start: np.ndarray, fp: np.ndarray, size: np.ndarray, bits: int, similar: float, window: int | None = None):
    """Yields (i, j, differing bits) of rows of one run within bits, whose numbers of shingles allow the similarity.

    start has the place where each row's run begins. window: pairs at most so many rows apart, and those with the run's
    first row.
    """

    def near(i, j):
        use = np.minimum(size[i], size[j]) >= similar * np.maximum(size[i], size[j])
        i, j = i[use], j[use]
        d = _distance(fp[i], fp[j]).astype(np.int64)
        use = d <= bits
        return i[use], j[use], d[use]

    i, step = np.arange(len(start)), 1
    while len(i) and (window is None or step <= window):
        i = i[: np.searchsorted(i, len(start) - step)]
        i = i[start[i + step] == start[i]]
        yield near(i, i + step)
        step += 1
    if window is not None:
        far = np.flatnonzero(np.arange(len(start)) - start > window)
        yield near(start[far], far)


def _runs(batches, by: list[str], least: int = 1 << 16):
    """(frame, where each row's run begins) of batches sorted by columns; a frame holds whole runs."""
    held: list[pd.DataFrame] = []

    def ready(x):
        new = np.ones(len(x), bool)
        new[1:] = (x[by].to_numpy()[1:] != x[by].to_numpy()[:-1]).any(1)
        return np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))

    for x in batches:
        held.append(x)
        if sum(map(len, held)) >= least:
            x = pd.concat(held, ignore_index=True)
            start = ready(x)
            # A run that has no end yet waits; the longer it is, the more is gathered before the next look.
            cut = int(start[-1])
            if cut:
                yield x.iloc[:cut], start[:cut]
            held, least = [x.iloc[cut:]], max(1 << 16, 2 * (len(x) - cut))
    if held and len(x := pd.concat(held, ignore_index=True)):
        yield x, ready(x)


def shared_keys(points: DataFrame, cell: int = CELL) -> DataFrame:
    """(key, id, grid) of the prefixes of points (id, prefix) whose key more than one has; grid: its points / cell."""

    def run(batches):
        for x, start in _runs(batches, ["key"]):
            n = np.bincount(start, minlength=len(x))[start]
            yield x.assign(grid=-(-n // cell).astype(np.int32))[n > 1]

    rows = points.select(F.explode("prefix").alias("key"), "id").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(run, "key long, id long, grid int")


def nearest(points: DataFrame, shared: DataFrame, bits: int = WITHIN, similar: float = SIMILAR, window: int = WINDOW) -> DataFrame:
    """(a, b, a < b): for each of points (fp, id, size) its nearest candidate and that of smallest id, as far as the points
    of a key stand within window of each other. dedupe() has no use for it."""

    def run(batches):
        for x, start in _runs(batches, ["key"]):
            ids, none = x.id.to_numpy(np.int64), len(x)
            close, least = np.full(none, 64 << 40), np.full(none, none)
            for i, j, d in key_pairs(start, x.fp.to_numpy(np.int64).view(np.uint64), x["size"].to_numpy(), bits, similar, window):
                for u, v in ((i, j), (j, i)):
                    np.minimum.at(close, u, d << 40 | v)
                    np.minimum.at(least, u, v)
            at = np.flatnonzero(least < none)
            yield pd.DataFrame({"id": ids[at], "d": (close[at] >> 40).astype(np.int32), "near": ids[close[at] & ((1 << 40) - 1)], "least": ids[least[at]]})

    rows = shared.join(points.select("id", "fp", "size"), "id").select("key", "id", "fp", "size").repartition("key").sortWithinPartitions("key", "id")
    best = rows.mapInPandas(run, "id long, d int, near long, least long").groupBy("id").agg(F.min(F.struct("d", "near")).alias("n"), F.min("least").alias("least"))
    both = best.select("id", F.explode(F.array("n.near", "least")).alias("other"))
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _alike(i: np.ndarray, j: np.ndarray, parity: np.ndarray, size: np.ndarray, similar: float) -> np.ndarray:
    """Which pairs' parities allow the similarity."""
    return np.bitwise_count(parity[i] ^ parity[j]).sum(-1) * (1 + similar) <= (size[i] + size[j]) * (1 - similar) + 1e-6


def _meeting(points: DataFrame, shared: DataFrame) -> DataFrame:
    """points where they share a key, sorted by key and cell; a crowded key is dealt out as a grid of cells, each for a
    pair of blocks."""
    own, g = F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"), F.col("grid")
    cells = F.transform(F.sequence(F.lit(0), g - 1), lambda k: F.least(own, k) * g + F.greatest(own, k))
    rows = shared.withColumn("cell", F.explode(cells)).join(points, "id").drop("grid")
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "id")


def candidates(points: DataFrame, shared: DataFrame, bits: int = WITHIN, similar: float = SIMILAR) -> DataFrame:
    """(a, b, a < b): all candidate pairs of points (fp, id, size, parities, part) of different parts.

    A candidate pair has a shingle of both prefixes in common, fingerprints within bits, and numbers of shingles and
    parities that allow the similarity. Their number grows with the square of a group; forest() joins the same points.
    """

    def run(batches):
        for x, start in _runs(batches, ["key", "cell"]):
            part = x.part.to_numpy()
            several = np.zeros(len(x), bool)
            several[start[part != part[start]]] = True
            x, start = x[several[start]], start[several[start]]
            if not len(x):
                continue
            start = np.searchsorted(start, start)
            ids, part, size, parity = x.id.to_numpy(np.int64), x.part.to_numpy(), x["size"].to_numpy(), x[PARITY].to_numpy(np.int64).astype(np.uint64)
            for i, j, _ in key_pairs(start, x.fp.to_numpy(np.int64).view(np.uint64), size, bits, similar):
                use = part[i] != part[j]
                i, j = i[use], j[use]
                use = _alike(i, j, parity, size, similar)
                if use.any():
                    yield pd.DataFrame({"a": np.minimum(ids[i], ids[j])[use], "b": np.maximum(ids[i], ids[j])[use]})

    return _meeting(points.select("id", "fp", "size", *PARITY, "part"), shared).mapInPandas(run, "a long, b long").distinct()


def forest(points: DataFrame, shared: DataFrame, bits: int = WITHIN, similar: float = SIMILAR) -> DataFrame:
    """(a, b, a < b): links that join just those of points (fp, id, size, parities) that candidate pairs join, over chains.

    Each key gives a spanning forest, less than one row a point, so a group of near copies never gives all its pairs.
    """

    def run(batches):
        for x, start in _runs(batches, ["key", "cell"]):
            ids, size, parity = x.id.to_numpy(np.int64), x["size"].to_numpy(), x[PARITY].to_numpy(np.int64).astype(np.uint64)
            root, held, n = np.arange(len(x)), [], 0
            for i, j, _ in key_pairs(start, x.fp.to_numpy(np.int64).view(np.uint64), size, bits, similar):
                use = _alike(i, j, parity, size, similar)
                held.append((i[use], j[use]))
                n += np.count_nonzero(use)
                if n > 1 << 18:
                    _union(root, *map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if n:
                _union(root, *map(np.concatenate, zip(*held, strict=True)))
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]})

    return _meeting(points.select("id", "fp", "size", *PARITY), shared).mapInPandas(run, "a long, b long").distinct()


def similar_links(part: np.ndarray, fp: np.ndarray, size: np.ndarray, parity: np.ndarray, sets: list[np.ndarray], bits: int, similar: float) -> list[tuple[int, int]]:
    """Links that join what the pairs of sets within bits and of at least the similarity join, over chains; sets of one
    part are joined already."""
    root = np.unique(part, return_inverse=True)[1]
    if not root.any():
        return []
    code = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(list(map(len, sets)))[:-1])
    has, out = np.zeros(sum(map(len, sets)), bool), []
    for i in range(len(sets) - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        j = j[(_distance(fp[j], fp[i]) <= bits) & (np.minimum(size[j], size[i]) >= similar * np.maximum(size[j], size[i]))]
        j = j[_alike(j, i, parity, size, similar)]
        if not len(j):
            continue
        has[code[i]] = True
        for k in j.tolist():
            if root[k] != root[i]:
                both = np.count_nonzero(has[code[k]])
                if both / (len(code[i]) + len(code[k]) - both) >= similar:
                    out.append((i, k))
                    root[root == root[k]] = root[i]
        has[code[i]] = False
    return out


def linked(dealt: DataFrame, shown: DataFrame, bits: int = WITHIN, similar: float = SIMILAR) -> DataFrame:
    """(a, b): links that join just the similar ones of each cell of dealt (cluster, cell, id, fp, size, parities, part),
    over chains, less than one row for each id and cell. shown (id, text) has their texts."""

    def run(batches):
        key, ids, numbers, sets = None, [], [], []

        def done():
            if len(ids) > 1:
                n = np.array(numbers, np.int64)
                for i, k in similar_links(n[:, 0], n[:, 1].copy().view(np.uint64), n[:, 2], n[:, 3:].astype(np.uint64), sets, bits, similar):
                    yield ids[i], ids[k]

        for x in batches:
            found = []
            for at, i, row, text in zip(zip(x.cluster.tolist(), x.cell.tolist(), strict=True), x.id.tolist(), x[["part", "fp", "size", *PARITY]].to_numpy(), x.text, strict=True):
                if at != key:
                    found += done()
                    key, ids, numbers, sets = at, [], [], []
                if not ids or ids[-1] != i:  # rows equal in doc_id and text come twice
                    ids.append(i)
                    numbers.append(row)
                    sets.append(shingles(text))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
        if found := list(done()):
            yield pd.DataFrame(found, columns=["a", "b"])

    rows = dealt.select("cluster", "cell", "id", "fp", "size", *PARITY, "part").join(shown, "id")
    return rows.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "id").mapInPandas(run, "a long, b long")


def _blocks(n: str, held: str, most: int):
    """Blocks for n texts with held shingles in all."""
    return F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(held) / HELD)).cast("int")


def sketch(known: np.ndarray, rank: np.ndarray):
    """A function of a text's fingerprint, hash of the shingle set, number of its shingles, their parities and prefix."""

    @F.pandas_udf(StructType([*(StructField(c, LongType()) for c in ("fp", "id", "size", *PARITY)), StructField("prefix", ArrayType(LongType()))]))
    def run(text: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in text]
        parity = np.array([parities(s) for s in sets], np.int64).reshape(-1, 4)
        return pd.DataFrame({
            "fp": np.array([fingerprint(t, SHINGLE) for t in text], np.uint64).view(np.int64),
            "id": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
            "size": np.array([len(s) for s in sets], np.int64),
            **{p: parity[:, i] for i, p in enumerate(PARITY)},
            "prefix": [prefix(s, known, rank).view(np.int64) for s in sets],
        })

    return run


def similar_groups(sets: DataFrame, texts: DataFrame, cell: int = CELL, most: int = TEXTS) -> DataFrame:
    """(node, label): the components of sets (fp, id, size, parities, prefix, d, t) under similar candidates; sets alone have no row.

    Chains of candidates part the sets into clusters, which no similar pair leaves. The texts of a cluster meet in one
    cell, where links that join its similar ones are found. A cluster of more than most texts is dealt out in blocks
    that have some texts in common, which joins nearly all that is similar; then what its largest part has not taken
    in meets all blocks.
    """
    shared = materialize(shared_keys(sets, cell), "shared")
    label = components(forest(sets, shared))
    release(shared)
    members = materialize(sets.join(label, sets.id == label.node).select("id", "fp", "size", *PARITY, "d", "t", F.col("label").alias("cluster")), "members")
    shown = texts.join(members.select("id", "d", "t"), (F.col("__doc") == F.col("d")) & (F.col("__text") == F.col("t"))).select("id", "text")
    shown = materialize(shown, "compared")
    full = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    full = full.select("cluster", "n", _blocks("n", "held", most).alias("grid"))
    own, hub = F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")) < HUBS
    cells = F.when(hub, F.sequence(F.lit(0), F.col("grid") - 1)).otherwise(F.array(own))
    found = materialize(linked(members.join(full, "cluster").withColumns({"cell": F.explode(cells), "part": F.col("id")}), shown), "similar")
    crowded = full.where("grid > 1")
    if crowded.limit(1).count():
        label, inside = components(found), members.join(crowded.select("cluster"), "cluster")
        inside = materialize(inside.join(label, inside.id == label.node, "left").withColumn("part", F.coalesce("label", "id")).drop("node", "label"), "inside")
        sizes = inside.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
        sizes = sizes.groupBy("cluster").agg(F.max(F.struct("n", "held", "part")).alias("main"), F.sum("n").alias("n"), F.sum("held").alias("held"))
        sizes = sizes.select("cluster", F.col("main.part").alias("main"), F.col("main.n").alias("a"), F.col("main.held").alias("b"), (F.col("n") - F.col("main.n")).alias("c"), (F.col("held") - F.col("main.held")).alias("e")).where("c > 0")
        sizes = sizes.select("cluster", "main", _blocks("a", "b", most).alias("left"), _blocks("c", "e", most).alias("right"))
        left, right, h = F.col("left"), F.col("right"), F.xxhash64("id")
        grid, at = left + right, F.when(F.col("part") == F.col("main"), F.pmod(h, left)).otherwise(left + F.pmod(h, right)).cast("int")
        # Two blocks of the largest part have nothing to join.
        others = F.sequence(F.when(F.col("part") == F.col("main"), left).otherwise(0), grid - 1)
        cells = F.transform(others, lambda k: F.least(at, k) * grid + F.greatest(at, k))
        more = linked(inside.join(sizes, "cluster").withColumn("cell", F.explode(cells)), shown)
        first, found = found, materialize(found.unionByName(more), "similar")
        release(first)
        release(inside)
    release(members)
    release(shown)
    return components(found)


def dedupe(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id.

    Near duplicates have sets of five-word shingles with a Jaccard similarity of at least SIMILAR; groups are
    joined over chains of them. Candidates share one of their rarest shingles, which loses no pair, and lie within
    WITHIN bits of each other's fingerprints. Texts without
    words are alike. Rows without doc_id can't be told from others by it; they stay, one for each distinct text.
    Of rows equal in doc_id and text one stays. Columns of any other name pass through; an empty table gives an
    empty one.
    """
    doc, mark, of, at = (free(docs, c) for c in ("near_doc", "near_text", "near_of", "near_at"))
    text = F.col("text").cast("string")
    named = docs.where("doc_id is not null").withColumns({doc: F.col("doc_id").cast("long"), mark: F.xxhash64(text)})
    texts = named.select(F.col(doc).alias("__doc"), F.col(mark).alias("__text"), text.alias("text"))
    sketch_udf = sketch(*rare_first(texts))
    marks = materialize(texts.select(F.struct("__doc", "__text").alias("row"), sketch_udf("text").alias("s")).select("row", "s.*"), "sketches")
    # Equal sets are one point, shown by the row of smallest id.
    sets = marks.groupBy("id").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), *[F.min(p).alias(p) for p in (*PARITY, "prefix")], F.min("row").alias("row"))
    sets = materialize(sets.select("fp", "id", "size", *PARITY, "prefix", F.col("row.__doc").alias("d"), F.col("row.__text").alias("t")), "sets")
    release(marks)
    label = similar_groups(sets, texts)
    kept = sets.join(label, sets.id == label.node, "left").groupBy(F.coalesce("label", "id")).agg(F.min(F.struct("d", "t")).alias("k")).select(F.col("k.d").alias(of), F.col("k.t").alias(at))
    one = named.join(kept, (F.col(doc) == F.col(of)) & (F.col(mark) == F.col(at)), "left_semi").dropDuplicates([doc, mark])
    bare = docs.where("doc_id is null").dropDuplicates(["text"])
    return one.select(docs.columns).unionByName(bare)
