"""Layers stored as Parquet along a space-filling curve, and their readers.

Features are written in Z-order of their box's centre, so that a row group covers a small area and its minimum and
maximum of minx, miny, maxx and maxy rule it out for most windows. The reference system is part of the schema.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcover.operators.survey import valid_egrid

#: Bytes of a row group, and the reference system of planar runs.
ROW_GROUP, PLANAR = 8 << 20, 2056
#: Keys that go to the scan as a filter; more are joined.
LISTED = 500
_MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def z_order(x: Column, y: Column, unit: float = 1.0) -> Column:
    """Place of a point on the curve: the bits of x and y by turns, in steps of unit, for values within 2^30 units of 0."""

    def spread(c: Column) -> Column:
        v = F.greatest(F.lit(0), F.least(F.floor(c / unit) + 2**30, F.lit(2**31 - 1))).cast("long")
        for shift, mask in _MASKS:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def write_layer(df: DataFrame, path: str, crs: int = PLANAR, unit: float = 1.0, row_group: int = ROW_GROUP) -> None:
    """df (minx, miny, maxx, maxy and more) as a stored layer. Features without a box come first; equal places are
    spread over ranges by the box's corners."""
    z = z_order((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, unit)
    spread = df.withMetadata("minx", {"crs": crs}).withColumn("__z", z)
    by = ["__z", "minx", "miny", "maxx", "maxy"]
    spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("__z").write.option("parquet.block.size", row_group).parquet(path)


def read_layer(spark: SparkSession, path: str, crs: int = PLANAR) -> DataFrame:
    """A stored layer; another reference system than crs is an error."""
    df = spark.read.parquet(path)
    found = df.schema["minx"].metadata.get("crs")
    if found != crs:
        raise ValueError(f"{path} is in reference system {found}, not {crs}")
    return df


def read_parcels(spark: SparkSession, path: str, egrids: DataFrame | list[str] | None = None, bfsnr: int | None = None, crs: int = PLANAR) -> DataFrame:
    """Parcels of a municipality and of a list of EGRIDs, as asked for. EGRIDs that can't be one are dropped from the
    list first, so a list without any valid one gives no parcels. A short list and the municipality go to the scan; a
    long list, or one given as a table (egrid), is joined."""
    df = read_layer(spark, path, crs)
    if bfsnr is not None:
        df = df.where(F.col("bfsnr") == bfsnr)
    if isinstance(egrids, list):
        good = sorted({e for e in egrids if e is not None and re.search("^CH[0-9A-Za-z]+$", e)})
        if len(good) <= LISTED:
            return df.where(F.col("egrid").isin(good))
        egrids = spark.createDataFrame([(e,) for e in good], "egrid string")
    if egrids is not None:
        keys = egrids.where(valid_egrid(F.col("egrid"))).select("egrid").distinct()
        df = df.join(keys, "egrid", "left_semi")
    return df


def read_landcover(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, crs: int = PLANAR) -> DataFrame:
    """Features whose box meets (minx, miny, maxx, maxy), borders included."""
    df = read_layer(spark, path, crs)
    if box is None:
        return df
    x0, y0, x1, y1 = map(float, box)
    return df.where((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("bfsnr").distinct().dropna().orderBy("bfsnr")
