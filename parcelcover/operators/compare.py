"""Comparison of two exports of the same parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcover.functions.scalars import close, norm_number

RTOL, ATOL = 1e-4, 0.02


def _long(df: DataFrame, columns: list[str], key: str, order: str) -> DataFrame:
    """(key, name, value as text); of repeated keys the last row in order."""
    last = df.groupBy(F.col(key).alias("__key")).agg(*[F.max_by(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(order)).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
    return last.select("__key", F.explode(items).alias("i")).select(F.col("__key").alias(key), "i.*")


def differs(a: Column, b: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Two texts: by tolerance if both are numbers, else as normalised text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), close(x, y, rtol, atol)).otherwise(norm_number(F.trim(a)) == norm_number(F.trim(b)))
    return ~same


def compare_parcels(a: DataFrame, b: DataFrame, columns: list[str], key: str = "egrid", order: str = "pos", rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """(key, name, left, right): values that differ; a key in one export only has one row, name "*"."""
    left, right = (_long(d, columns, key, order) for d in (a, b))
    l, r = left.withColumnRenamed("value", "left"), right.withColumnRenamed("value", "right")
    d = l.join(r, [key, "name"], "full_outer")
    one = d.where("left is null or right is null").select(key, F.lit("*").alias("name"), F.when(F.col("left").isNotNull(), "present").alias("left"), F.when(F.col("right").isNotNull(), "present").alias("right")).distinct()
    return d.where("left is not null and right is not null").where(differs(F.col("left"), F.col("right"), rtol, atol)).unionByName(one)


def compare_sides(rows: DataFrame, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """compare_detail() of rows (egrid, art, right: is it the right side's, area), in one pass over both sides."""
    mine = {"left": ~F.col("right"), "right": F.col("right")}
    d = rows.groupBy("egrid", "art").agg(*[f for k, c in mine.items() for f in (F.count_if(c).alias(f"{k}_n"), F.coalesce(F.sum(F.when(c, F.col("area"))), F.lit(0.0)).alias(f"{k}_sum"))])
    d = d.select("egrid", "art", "left_n", "right_n", F.col("left_sum").alias("left"), F.col("right_sum").alias("right"))
    areas = F.when(~close(F.col("left"), F.col("right"), rtol, atol), F.struct("art", "left", "right"))
    g = d.groupBy("egrid").agg(F.collect_list(areas).alias("areas"), F.sum("left_n").cast("double").alias("left"), F.sum("right_n").cast("double").alias("right"))
    count = F.when(F.col("left") != F.col("right"), F.array(F.struct(F.lit("*").alias("art"), "left", "right"))).otherwise(F.array())
    return g.select("egrid", F.explode(F.concat("areas", count)).alias("i")).select("egrid", "i.*")


def compare_detail(a: DataFrame, b: DataFrame, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """(egrid, art, left, right) where the number of features (art "*") or a type's summed area differs."""
    side = lambda d, right: d.select("egrid", "art", F.lit(right).alias("right"), "area")
    return compare_sides(side(a, False).unionByName(side(b, True)), rtol, atol)
