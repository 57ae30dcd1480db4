"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule stands at the fractional part of i times the golden ratio. Cumulative slot weights
turn that point into a source, and the slot's rank within its source says which of the source's blocks it
takes: the source's documents, shuffled by a hash and laid end to end, are cut into blocks of equally many
words, taken in order, and over again once all are used. Slots, documents and blocks meet in joins; no
source, however large, passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.llm.text import BLANK, WORD, free
from parcelcover.plans.materialize import materialize

#: Fixed weights of the sources in code-point order, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block at most; blocks of a source at least (while it has as many words).
BLOCK, BLOCKS = 2048, 256
#: The golden ratio's fraction, in units of 2 to the power -62, and the grid of the source lookup.
PHI, ONE, GRID = 0x9E3779B97F4A7C15 >> 2, 1 << 62, 1 << 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Targets add up to share of all sizes, in proportion to the weights, but none is above most times its
    size: what is over goes to the others by weight, until none is above. That is one level L with target =
    least(most * size, L * weight); sources in the order of size / weight reach their limit one by one, and
    L follows from what the limited ones hold and the weights that are left. One row a source is ranked here,
    never a document. share must not exceed most. Without words, all targets are 0.
    """
    if not 0 <= share <= most:
        raise ValueError("share must be from 0 to most")
    # One row a source: these windows stay in one task, which a list of sources fits in, however many documents they hold.
    every, named = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*map(F.lit, weights))
    t = sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) * share - held) / F.sum("weight").over(rest)
    t = t.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    final = F.max(F.when(F.col("free"), F.col("level"))).over(every)
    target = F.least(F.col("source_size") * most, F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def plan(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """targets() with key (its hash), words a block, blocks, and the slot interval [lo, hi) out of ONE."""
    t = targets(sizes, share, most).where("source_size > 0")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.ceil(F.col("source_size") / BLOCKS))).cast("long")
    t = t.withColumn("block", block).withColumn("slots", F.col("target") / F.col("block"))
    up = Window.orderBy(F.col("source").asc_nulls_last())
    end = F.sum("slots").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("slots").over(Window.partitionBy())
    t = t.withColumn("hi", F.least(F.lit(ONE), (end * ONE).cast("long"))).withColumn("all_slots", F.round(F.sum("slots").over(Window.partitionBy())).cast("long"))
    t = t.withColumn("hi", F.when(F.lead("hi").over(up).isNull(), F.lit(ONE)).otherwise(F.col("hi")))
    return t.withColumn("lo", F.coalesce(F.lag("hi").over(up), F.lit(0)))


def schedule(t: DataFrame) -> DataFrame:
    """(slot, source, rank): rank counts the earlier slots of the same source.

    A slot finds its source by the grid cell of its point: sources lie in the cells that they overlap, so
    the lookup is an equi-join for any number of sources. Ranks come from counts by chunk of slots, summed
    up over the chunks, and a count inside the chunk.
    """
    spark = t.sparkSession
    n = t.agg(F.max("all_slots")).first()[0] or 0
    # frac(i * PHI) in 62 bits; the parts keep each product within a long.
    low, high = F.col("id") % (1 << 31), F.shiftright("id", 31)
    word = F.lit((1 << 31) - 1)
    a, b = F.lit(PHI >> 31), F.lit(PHI & ((1 << 31) - 1))
    middle = (low * a + high * b).bitwiseAND(word)
    point = (low * b + F.shiftleft(middle, 31)).bitwiseAND(F.lit(ONE - 1))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    size = ONE // GRID
    cells = t.where("lo < hi").select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size).cast("long"), F.floor((F.col("hi") - 1) / size).cast("long"))).alias("cell"))
    at = slots.withColumn("cell", F.floor(F.col("point") / size).cast("long")).join(cells, "cell").where("point >= lo and point < hi")
    at = at.select("slot", "source", F.shiftright("slot", 16).alias("chunk"))
    counts = at.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    up = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    at = at.withColumn("within", within).join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return at.select("slot", "source", (F.col("base") + F.col("within")).alias("rank"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row of docs (doc_id, source, text).

    taken is how many of the row's words the mix takes, repeats counted, at most most (a whole number) times its
    size. The order within a source depends on doc_id and seed alone, so that reruns agree. A null text has size
    0; a null source is a source of its own, the last; an empty text takes 0. Repeated rows count each. Rows
    without doc_id come in a fixed order too. An empty table gives an empty one. Other columns are left aside.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), _tie(F.col("text").cast("string")).alias("tie"))
    return _mix(d, share, most, seed).select("doc_id", "size", "source_size", "target", "taken", "source")


def _tie(text: Column) -> Column:
    """What tells rows without doc_id apart, so that they don't all come to one place; null for others."""
    return F.when(F.isnull("doc_id"), F.xxhash64(text))


def _mix(d: DataFrame, share: float, most: float, seed: int = 7) -> DataFrame:
    """mix() of rows (doc_id, source, size, tie, others), which keep their other columns."""
    if most != int(most):
        raise ValueError("most must be a whole number")
    more = [c for c in d.columns if c not in ("doc_id", "source", "size")]
    d = d.withColumn("mark", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.lit(1 << 40)))
    d = materialize(d, "sizes")
    sizes = materialize(d.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    every = targets(sizes, share, most)
    t = materialize(plan(sizes, share, most), "plan")
    # Documents end to end: sums by bucket of the hash, then inside the bucket.
    buckets = max(1, d.count() // 4096)
    d = d.withColumn("bucket", F.col("mark") % buckets)
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("inner"))
    own = every.join(t.select(F.col("source").alias("ts"), "block"), F.col("source").eqNullSafe(F.col("ts")), "left").select(F.col("source").alias("s2"), "source_size", "target", "block")
    d = d.select("doc_id", "source", "size", *more, "start").join(own, F.col("source").eqNullSafe(F.col("s2")))
    piece = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("block")).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")).cast("long"))))
    pieces = d.withColumn("piece", piece)
    overlap = F.least(F.col("start") + F.col("size"), (F.col("piece") + 1) * F.col("block")) - F.greatest("start", F.col("piece") * F.col("block"))
    # How often the schedule takes each block; a rank beyond most rounds would be over the limit.
    blocks = t.select(F.col("source").alias("s3"), F.ceil(F.col("source_size") / F.col("block")).alias("blocks"))
    taken = schedule(t).join(blocks, F.col("source").eqNullSafe(F.col("s3"))).where(F.col("rank") < F.col("blocks") * int(most))
    taken = taken.groupBy(F.col("source").alias("s4"), (F.col("rank") % F.col("blocks")).alias("taken_block")).agg(F.count("*").alias("times"))
    got = pieces.join(taken, F.col("source").eqNullSafe(F.col("s4")) & (F.col("piece") == F.col("taken_block")), "left")
    words = F.sum(F.coalesce(overlap * F.col("times"), F.lit(0))).cast("long")
    # Rows of size 0 share a start with others: they are told apart by their number.
    out = got.where("size > 0").groupBy("doc_id", "source", "size", *more, "start", "source_size", "target").agg(words.alias("taken"))
    none = d.where("size = 0").select("doc_id", "source", "size", *more, "start", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none)


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix as rows of docs: each as many whole times as it was taken, and once more with its leading words,
    white space and all, that lie in the blocks which the schedule's last, unfinished round took. Rows that the mix
    doesn't take go.

    Every row follows its own plan, also where rows share a doc_id or have none: rows are told apart by doc_id,
    source and text. Of rows equal in all three, one stands for all and comes as often as they were taken together.
    Null and empty texts have no words and go; a null source is a source of its own. Columns of any other name pass
    through. An empty table gives an empty one.
    """
    key, size, taken, time, of = (free(docs, c) for c in ("mix_key", "mix_size", "mix_taken", "mix_time", "mix_of"))
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    # A null is no value of its own in a hash; its place in the list is hashed with it.
    mark = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.isnull("doc_id"), F.isnull(source), source, text).alias("h"))
    keyed = docs.withColumn(key, mark)
    sizes = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), n_words(text).alias("size"), _tie(text).alias("tie"), F.col(key).alias("key"))
    plan_of = _mix(sizes, share, most).groupBy(F.col("key").alias(of)).agg(F.sum("taken").alias(taken), F.min("size").alias(size)).where(F.col(taken) > 0)
    at = keyed.dropDuplicates([key]).join(plan_of, F.col(key) == F.col(of))
    whole, rest = F.floor(F.col(taken) / F.col(size)), F.col(taken) % F.col(size)
    at = at.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), whole + F.when(rest > 0, 1).otherwise(0))))
    # Each word with the white space before it, so that the words left stand as they did.
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({BLANK}{WORD})"), 1), F.lit(1), rest.cast("int")), "")
    return at.withColumn("text", F.when(F.col(time) > whole, part).otherwise(F.col("text"))).select(docs.columns)
