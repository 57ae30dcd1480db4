"""Reading and writing files: parcel lists, feature layers, delimited exports."""

from __future__ import annotations

import csv
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcover.functions.geometry import from_coordinates, to_geojson
from parcelcover.functions.scalars import norm_number, num
from parcelcover.plans.materialize import materialize, remove
from parcelcover.sources.ranges import array_members

#: Column orders of the detail layers; columns that a table lacks are left out.
DETAIL_COLUMNS = {
    "landcover": "id egrid fid art bfsnr gwr_egid check_greenspace vbs_kategorie vbs_produktiv vbs_typ area_m2 lc_source prob".split(),
    "bauzonen": "id egrid fid art bauzone_code area_m2 lc_source".split(),
    "habitat": "id egrid fid art typoch_l1 typoch_l2 typoch_l3 check_greenspace vbs_kategorie vbs_produktiv vbs_typ area_m2 prob lc_source".split(),
}
# Fixed value: parts of a column's name, between underscores, that tell of personal data.
PRIVATE = r"(?i)(^|_)(name|mieter|tenant|e?mail|telefon|phone|adresse|kontakt|person|eigent[uü]mer|owner)(_|$)"


def delimiter(header: str) -> tuple[str, bool]:
    """(delimiter, whether the first line only says so): sep=x wins; else ; only if strictly most, tab if more than commas."""
    if header.lower().startswith("sep=") and len(header) >= 5:
        return header[4], True
    semis, tabs, commas = (header.count(c) for c in ";\t,")
    return (";" if semis > max(tabs, commas) else "\t" if tabs > commas else ","), False


def read_parcel_list(spark: SparkSession, path: str) -> DataFrame:
    """A delimited list of parcels as trimmed strings with lowercased headers; blank cells are "".

    Headers equal after lowercasing keep the last column. id and egrid must be there. The header line alone
    reaches the driver.
    """
    lines = [r.value.lstrip("﻿") for r in spark.read.text(path).limit(2).collect()]
    if not lines:
        raise ValueError("the list is empty")
    sep, extra = delimiter(lines[0])
    header_line = lines[1 if extra else 0]
    names = [c.strip().lower() for c in next(csv.reader([header_line], delimiter=sep), [])]
    missing = [c for c in ("id", "egrid") if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(names)}")
    keep = {n: f"c{i}" for i, n in enumerate(names)}
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    # Each file's first row goes: its header, or the line that names the delimiter, behind which the header stands.
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = lambda c: F.trim(F.coalesce(F.regexp_replace(c, "^﻿", ""), F.lit("")))
    if extra:
        head = next(csv.reader([header_line], delimiter=sep))
        df = df.where(~reduce(lambda x, y: x & y, [F.trim(F.coalesce(F.col(c), F.lit(""))) == h.strip() for c, h in zip(df.columns, head, strict=True)]))
    return df.select(*[clean(F.col(c)).alias(n) for n, c in keep.items()])


def allowlist_columns(df: DataFrame, kept: list[str]) -> tuple[DataFrame, list[str]]:
    """df without input_ columns outside kept and without columns whose name looks private; and the dropped names."""
    drop = [c for c in df.columns if (c.startswith("input_") and c[6:] not in kept) or (not c.startswith("input_") and re.search(PRIVATE, c))]
    return df.drop(*drop), drop


def json_value(c: Column, kind: str) -> Column:
    """A value as JSON: whole doubles as integers, null as null."""
    inner = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    text = F.substring(inner, F.lit(6), F.length(inner) - 6)
    return F.when(c.isNotNull() & (c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(text) if kind in ("double", "float") else text


def feature(df: DataFrame, layer: str | None, geometry: str | None = None) -> DataFrame:
    """(json): each row as a GeoJSON feature, tagged with its layer if there is one; names that begin with _ are left out."""
    shown = [(c, t) for c, t in df.dtypes if not c.startswith("_") and c != geometry]
    parts = [F.lit(json.dumps("layer") + ":" + json.dumps(layer, ensure_ascii=False))] if layer is not None else []
    parts += [F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), json_value(F.col(f"`{c}`"), t)) for c, t in shown]
    geo = F.coalesce(to_geojson(F.col(geometry)), F.lit("null")) if geometry else F.lit("null")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), geo, F.lit(',"properties":{'), F.concat_ws(",", *parts), F.lit("}}")).alias("json"))


def export_selection(df: DataFrame, columns: dict[str, bool] | None = None, geometry: str = "_geom") -> DataFrame:
    """The rows of a selection (all, filtered or ranked) for an export: as features (json) with their geometry, if there is
    one, and all columns but those that begin with _; or, if columns are chosen (name: is it a number), these alone, as
    numbers, 0 without a leading number, or as texts, "" for null."""
    if columns is None:
        return feature(df, None, geometry if geometry in df.columns else None)
    return df.select(*[(num(F.col(c)) if number else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c, number in columns.items()])


def write_feature_layers(layers: dict[str, DataFrame], path: str, geometry: str = "geom") -> None:
    """All layers as one file set of one feature a line, in the order of layers within each part."""
    out = None
    for name, df in layers.items():
        f = feature(df, name, geometry if geometry in df.columns else None)
        out = f if out is None else out.unionByName(f)
    out.write.text(path)


def read_features(lines: DataFrame) -> DataFrame:
    """(layer, id, art, area_m2, geom, properties) of lines of GeoJSON features (value)."""
    part = lambda k: F.get_json_object("value", f"$.{k}")
    parts = lines.where(part("type") == "Feature").select(part("properties").alias("properties"), part("geometry").alias("__geometry"))
    # Each part is gone through once for all that is asked of it.
    d = parts.select("*", F.json_tuple("properties", "layer", "id", "art", "bauzone_code", "area_m2").alias("layer", "id", "__art", "__code", "__area"))
    d = d.select("*", F.json_tuple("__geometry", "type", "coordinates").alias("__kind", "__body"))
    return d.select("layer", "id", F.coalesce("__art", "__code").alias("art"), F.col("__area").try_cast("double").alias("area_m2"), from_coordinates(F.col("__kind"), F.col("__body")).alias("geom"), "properties")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for the features of FeatureCollection files of any size, on one line or many. The members are
    written once found: whoever looks at the features twice doesn't search the files again."""
    return read_features(materialize(array_members(spark, path).select("value"), "members"))


def split_layers(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parcels, overlays): without any layer tag all are parcels; overlay rows need a geometry."""
    tagged = features.where("layer is not null").limit(1).count() > 0
    parcel = F.coalesce(F.col("layer") == "parcel", F.lit(False)) if tagged else F.lit(True)
    return features.where(parcel), features.where(~parcel & F.col("geom").isNotNull()).select("layer", "id", "art", "area_m2", "geom")


def csv_cells(df: DataFrame) -> DataFrame:
    """df's public columns as texts: lists joined by "; ", whole doubles as integers, null as empty."""

    def cell(c: Column, kind: str) -> Column:
        return F.coalesce(F.array_join(c, "; ") if kind.startswith("array") else norm_number(c) if kind in ("double", "float") else c.cast("string"), F.lit(""))

    return df.select(*[cell(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes if not c.startswith("_")])


#: How cells are written: quoted only where they must be, empty ones as nothing.
CELLS = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def csv_lines(df: DataFrame, style: str = "web") -> DataFrame:
    """(value): write_csv()'s rows as lines, for sinks of other kinds."""
    cells = csv_cells(df)
    return cells.select(F.to_csv(F.struct(*[f"`{c}`" for c in cells.columns]), {**CELLS, "sep": ";" if style == "web" else ","}).alias("value"))


def write_csv(df: DataFrame, path: str, style: str = "web") -> None:
    """Delimited parts, each a complete file: the header, then its rows; cells are quoted only where they must be.

    Style web: semicolons, and a byte order mark at the beginning of each part; style plain: commas. An empty table
    gives one part with the header.
    """
    cells = csv_cells(df)
    if style == "web":
        cells = cells.toDF("\ufeff" + cells.columns[0], *cells.columns[1:])
    cells = cells if cells.limit(1).count() else cells.repartition(1)
    cells.write.options(**CELLS).csv(path, sep=";" if style == "web" else ",", header=True)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """One table a layer with its fixed columns first; an empty layer gives none, which shows once it is written."""
    for name, df in layers.items():
        order = [c for c in DETAIL_COLUMNS.get(name, []) if c in df.columns]
        df.select(*order, *[c for c in df.columns if c not in order]).write.parquet(f"{path}/{name}")
        if not df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}").limit(1).count():
            remove(df.sparkSession, f"{path}/{name}")
