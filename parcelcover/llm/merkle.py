"""A dataset manifest: a Merkle tree of every source's documents, a tree of the sources, and a proof for each document.

Trees grow level by level, each written once. A node then holds the siblings on its way to an ancestor: first its own
run's others and its parent, then, by joining the nodes with themselves, twice as many levels a round, segment after
segment, until every leaf's segments reach the root. No round looks at more than two segments of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.plans.materialize import materialize, release

#: Nodes whose parent is one run, and bytes of far ends that a join may send to every executor; more are shuffled.
ARITY, SENT = 3, 16 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one far end above the sources may be those of a hot source: they are dealt out in so many parts.
SALT = 16
STEP = "struct<before: binary, after: binary>"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a document's fields in their order: each its byte count, a colon and the value, or - if null."""
    return F.unhex(F.sha2(F.concat(*[_field(columns[c]) for c in FIELDS]), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _joined(parts: Column) -> Column:
    """Digests side by side."""
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def _over(n: Column) -> Column:
    return F.ceil(n / ARITY).cast("long")


def fold(leaf: Column, path: Column) -> Column:
    """The hex digest at the end of a path of sibling steps, from a leaf's digest."""
    return F.aggregate(path, _hex(leaf), lambda acc, s: F.sha2(F.concat(_hex(s["before"]), acc, _hex(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    """Hex digest of all siblings of a path, as hex text, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


def _sorted(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df written in the order of by over ranges of rows, with at: the range's number in the upper bits, the place in
    it below. Equal rows may fall into several ranges."""
    tie = df.withColumn("tie", F.monotonically_increasing_id())
    return materialize(tie.repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()), name)


def _range(at: str = "at") -> Column:
    return F.shiftright(at, 33)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, ... in the order of by. One small row a range meets in one place, never the rows."""
    table = _sorted(df, by, name)
    first = table.groupBy(_range().alias("range")).agg(F.count("*").alias("rows")).withColumn("first", F.sum("rows").over(Window.orderBy("range")) - F.col("rows"))
    return table.join(first.select("range", "first"), _range() == F.col("range")).withColumn(name, F.col("first") + F.col("at") - F.shiftleft("range", 33)).drop("range", "first", "at")


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves (key, doc_id, leaf, ...) with tree (the source's number), i (its place in the source), n (the source's
    leaves) and span; spans (span, tree), of which a source has one a range; the table behind the leaves.

    A span is what one range has of one source, so a hot source's rows never meet in one task.
    """
    table = _sorted(leaves, ["key", "doc_id", "leaf"], "leaves")
    spans = table.groupBy(_range().alias("range"), F.col("key").alias("of")).agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    every = Window.partitionBy("of")
    spans = spans.withColumns({"start": F.sum("rows").over(every.orderBy("range")) - F.col("rows"), "n": F.sum("rows").over(every)})
    spans = materialize(spans, "spans")
    trees = numbered(spans.where("start = 0").select(F.col("of").alias("tree_key")), ["tree_key"], "tree")
    spans = materialize(spans.join(trees, F.col("of") == F.col("tree_key")).drop("tree_key").withColumn("span", F.monotonically_increasing_id()), "spans")
    found = table.join(spans, (_range() == F.col("range")) & (F.col("key") == F.col("of")))
    found = found.withColumn("i", F.col("at") - F.col("low") + F.col("start")).drop("at", "key", "range", "of", "low", "rows", "start")
    return found, spans.select("span", "tree", "n"), table


def _stepped(nodes: DataFrame, level: int, last: Column, name: str) -> DataFrame:
    """nodes (tree, i, n, digest), written, with path (one step, none for a tree's only node), the parent's up_tree,
    up_level and up_i, and over: the parent's digest, in the first row of each run.

    last gives the parent's place where the parent ends its tree, or null where nothing lies above it.
    """
    run = Window.partitionBy("tree", F.floor(F.col("i") / ARITY)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, kids = (F.col("i") % ARITY).cast("int"), F.col("kids")
    df = nodes.withColumn("kids", F.collect_list("digest").over(run))
    step = F.struct(_joined(F.slice(kids, F.lit(1), at)).alias("before"), _joined(F.slice(kids, at + 2, F.lit(ARITY))).alias("after"))
    one, ends = F.col("n") == 1, _over(F.col("n")) == 1
    df = df.withColumns({
        "path": F.when(one, F.array().cast(f"array<{STEP}>")).otherwise(F.array(step)),
        "up_tree": F.when(~ends, F.col("tree")).otherwise(F.when(last.isNotNull(), F.lit(-1))).cast("long"),
        "up_level": F.when(~ends, F.lit(level + 1)).otherwise(F.when(last.isNotNull(), F.lit(0))),
        "up_i": F.when(~ends, F.floor(F.col("i") / ARITY)).otherwise(last).cast("long"),
        "over": F.when(~one & (at == 0), F.unhex(F.sha2(_hex(_joined(kids)), 256))),
    })
    return materialize(df.drop("kids"), name)


def _grown(nodes: DataFrame, most: int, last: Column, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of trees whose largest has most leaves, and the trees' ends (tree, digest)."""
    levels, ends = [], []
    while True:
        level = _stepped(nodes, len(levels), last, f"{name}{len(levels)}")
        levels.append(level)
        ends.append(level.where("n = 1").select("tree", "digest"))
        if most <= 1:
            break
        nodes = level.where("over is not null").select("tree", F.floor(F.col("i") / ARITY).alias("i"), _over(F.col("n")).alias("n"), F.col("over").alias("digest"))
        most = -(-most // ARITY)
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return levels, out


def _jump(nodes: DataFrame, far: DataFrame, reach: int, sent: int) -> DataFrame:
    """nodes with the segment of the node that they point to behind their own, pointing to where that one points.

    far: nodes that may be pointed to, each with up to reach steps. Few of them are sent to all executors; many are
    shuffled, and those above the sources in SALT copies, since all leaves of a hot source may point to one of them.
    A node at the root stays as it is; such rows are spread by their own place.
    """
    to = far.select(*[F.col(c).alias(f"to_{c}") for c in ("tree", "level", "i", "path", "up_tree", "up_level", "up_i")])
    away = F.col("up_i").isNotNull()
    keys = [(F.coalesce("up_tree", F.lit(-2)), "to_tree"), (F.coalesce("up_level", F.lit(0)), "to_level"), (F.coalesce("up_i", F.col("i")), "to_i")]
    if to.count() * (reach * (32 * (ARITY - 1) + 64) + 64) <= sent:
        to = F.broadcast(to)
    else:
        to = to.withColumn("to_part", F.explode(F.when(F.col("to_tree") == -1, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
        keys.append((F.when(F.coalesce("up_tree", F.lit(-2)) == -1, (F.col("i") % SALT).cast("int")).otherwise(0), "to_part"))
    test = keys[0][0] == F.col(keys[0][1])
    for a, b in keys[1:]:
        test = test & (a == F.col(b))
    out = nodes.join(to, test, "left")
    out = out.withColumn("path", F.when(away & F.col("to_i").isNotNull(), F.concat("path", "to_path")).otherwise(F.col("path")))
    return out.withColumns({c: F.col(f"to_{c}") for c in ("up_tree", "up_level", "up_i")}).drop(*[c for c in out.columns if c.startswith("to_")])


def proofs(leaves: DataFrame, sent: int | None = None) -> DataFrame:
    """leaves (key string, doc_id, leaf binary and payload) with path, subroot and root (hex).

    key: the source, so encoded that it is never null and sorts as sources do. Rows of a source go by doc_id, nulls
    first, then by leaf digest. An empty table gives an empty one.
    """
    sent = SENT if sent is None else sent
    placed, spans, table = _placed(leaves)
    trees, most = spans.agg(F.count_distinct("tree"), F.max("n")).first()
    levels, subroots = _grown(placed.withColumn("digest", F.col("leaf")), most or 0, F.when(F.lit(trees > 1), F.col("tree")), "level")
    heads = materialize(subroots, "subroots").select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(trees).cast("long").alias("n"), "digest")
    above, roots = _grown(heads, trees, F.lit(None).cast("long"), "above")
    key = ["tree", "level", "i", "path", "up_tree", "up_level", "up_i"]
    nodes = above[0].withColumn("level", F.lit(0)).select(*key)
    for k, t in [*enumerate(levels[1:], 1), *enumerate(above[1:], 1)]:
        nodes = nodes.unionByName(t.where("n > 1").withColumn("level", F.lit(k)).select(*key))
    nodes, roots = materialize(nodes, "nodes"), materialize(roots, "root")
    for t in [table, *levels[1:], *above[1:]]:
        release(t)

    steps, reach, found = len(levels) + len(above), 1, levels[0].drop("over", "digest")
    rounds = steps.bit_length()
    for k in range(rounds):
        # A leaf's first jump of this length ends reach levels up, or among the sources.
        found = _jump(found, nodes.where((F.col("level") >= reach) | (F.col("tree") == -1)), reach, sent)
        if k < rounds - 1:
            nodes = materialize(_jump(nodes, nodes.where((F.col("level") > reach) | (F.col("tree") == -1)), reach, sent), "nodes")
        reach *= 2
    ends = spans.join(heads.select(F.col("i").alias("tree"), _hex(F.col("digest")).alias("subroot")), "tree").select("span", "subroot")
    root = roots.select(_hex(F.col("digest")).alias("root")).limit(1)
    return found.join(ends, "span").crossJoin(F.broadcast(root)).drop("tree", "i", "n", "span", "up_tree", "up_level", "up_i")


def source_key(source: Column) -> Column:
    """Null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256 of every row, and the check of a tampered copy of the table:
    folded_root from the row's leaf there and its own proof, verified if that is the root.

    Every second document by hash of its doc_id loses its line breaks in the copy. Nulls in any column are values of
    their own; rows of a source with the same doc_id go by leaf digest, equal rows are leaves of their own; a row
    without doc_id isn't tampered with. Other columns are left aside; an empty table gives an empty one.
    """
    c = {f: F.col(f) for f in FIELDS}
    bare = c | {"text": F.translate(c["text"].cast("string"), "\n", "")}
    forged = F.when(tampered(c["doc_id"]) & (F.instr(c["text"].cast("string"), "\n") > 0), leaf_digest(bare))
    leaves = docs.select(c["doc_id"].cast("long").alias("doc_id"), c["source"].cast("string").alias("source"), source_key(c["source"]).alias("key"), leaf_digest(c).alias("leaf"), forged.alias("forged"))
    found = proofs(materialize(leaves, "digests"))
    out = found.select("doc_id", "source", _hex(F.col("leaf")).alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("forged", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
