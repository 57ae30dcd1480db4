"""Ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.plans.materialize import materialize

#: Rows in a range partition, about.
PART = 500_000


def running_counts(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """counts (by, n; by distinct) with before: the sum of n over the rows that sort before by.

    Rows are cut into ranges; sums of the ranges are added up (one row a range), then rows inside a range.
    """
    parts = max(1, counts.count() // PART)
    ranged = materialize(counts.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__part").agg(F.sum(n).alias("__n"))
    base = sums.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__inner", inner).join(base, "__part").withColumn("before", F.col("__base") + F.col("__inner")).drop("__part", "__inner", "__base")


def pct_ranks_mid(df: DataFrame, key: str, signals: dict[str, str]) -> DataFrame:
    """(key, one column for each of signals): mid-rank percentiles in [0, 1] of the signals' columns.

    Nulls, NaN and infinities stand aside with 0.5, as does a lone value. All signals go through one pass as (key, signal,
    value); equal values are counted first, so the ranking sees each value once, and ranks come back by a join.
    """
    items = F.array(*[F.struct(F.lit(out).alias("signal"), F.col(c).cast("double").alias("value")) for out, c in signals.items()])
    long = materialize(df.select(F.col(key).alias("__key"), F.explode(items).alias("i")).select("__key", "i.*"), "signals")
    known = long.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    counts = known.groupBy("signal", "value").agg(F.count("*").alias("n"))
    run = running_counts(counts, ["signal", "value"], "n")
    own = run.groupBy(F.col("signal").alias("s")).agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    run = run.join(F.broadcast(own), F.col("signal") == F.col("s"))  # a row for each signal
    rank = F.when(F.col("total") > 1, (F.col("before") - F.col("first") + (F.col("n") - 1) / 2) / (F.col("total") - 1)).otherwise(0.5)
    ranks = run.select("signal", "value", rank.alias("rank"))
    each = long.join(ranks, ["signal", "value"], "left").groupBy(F.col("__key").alias(key))
    return each.agg(*[F.coalesce(F.max(F.when(F.col("signal") == out, F.col("rank"))), F.lit(0.5)).alias(out) for out in signals])


def pct_rank_mid(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with out, the mid-rank percentile of value; key is unique."""
    return df.join(pct_ranks_mid(df, key, {out: value}), key)
