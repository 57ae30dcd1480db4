"""List reports: pipe tables, measurements joined to parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcover.functions.scalars import parse_area
from parcelcover.sources.ranges import numbered_lines


def route_rows(df: DataFrame, country: str, key: str) -> DataFrame:
    """df with port: blank, no_key, keep (Swiss) or foreign; the first that fits."""
    land = F.trim(F.coalesce(F.col(country), F.lit("")))
    return df.withColumn("port", F.when(land == "", "blank").when(F.col(key) == "//", "no_key").when(land == "CH", "keep").otherwise("foreign"))


def record_status(name: Column) -> Column:
    up = F.upper(F.coalesce(name, F.lit("")))
    return F.when(up.contains("ABGA"), "Abgang").when(up.contains("LÖVM"), "Löschvermerk").otherwise("Gültig")


def split_cells(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with a pipe, with their trimmed cells; the outer empty cells, blank rows and rules go."""
    cells = F.transform(F.split(F.trim(line), r"\|"), lambda c: F.trim(c))
    first = F.when(F.element_at(cells, 1) == "", 2).otherwise(1)
    last = F.when(F.element_at(cells, -1) == "", F.size(cells) - 1).otherwise(F.size(cells))
    d = lines.where(F.col(line).contains("|")).withColumn("cells", F.slice(cells, first, F.greatest(last - first + 1, F.lit(0))))
    return d.where(~F.forall("cells", lambda c: c.rlike("^-*$")))


def list_report(lines: DataFrame, order: str = "pos") -> DataFrame:
    """A pipe report (line, and order) as a table: its first row names the columns, repeats of it go, every row is
    padded or cut to their number. One header row reaches the driver."""
    d = split_cells(lines)
    head = d.orderBy(order).select("cells").first()
    if head is None:
        return lines.select(order).limit(0)
    names = list(head["cells"])
    fit = F.slice(F.concat("cells", F.array_repeat(F.lit(""), len(names))), 1, len(names))
    d = d.where(F.col("cells") != F.array(*map(F.lit, names))).withColumn("fit", fit)
    return d.select(order, *[F.element_at("fit", i + 1).alias(n) for i, n in enumerate(names)])


def upload_report(lines: DataFrame, order: str = "pos") -> DataFrame:
    """The upload's variant: header begins with BuKr, data rows with a digit; shorter rows go; id is BuKr/WE/Grundstk."""
    d = lines.where(F.col("line").rlike(r"^\|\s*(BuKr|\d)"))
    head = d.where(F.col("line").rlike(r"^\|\s*BuKr")).orderBy(order).select("line").first()
    if head is None:
        return lines.select(order).limit(0)
    names = [c.strip() for c in head["line"].strip().strip("|").split("|")]
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    d = d.where(F.col("line").rlike(r"^\|\s*\d")).withColumn("cells", cells).where(F.size("cells") >= len(names))
    d = d.select(order, *[F.element_at("cells", i + 1).alias(n) for i, n in enumerate(names)])
    rest = [c for c in names if c not in ("BuKr", "WE", "Grundstk", "E-GRID")]
    return d.select(order, F.concat_ws("/", "BuKr", "WE", "Grundstk").alias("id"), F.col("`E-GRID`").alias("egrid"), *[F.col(f"`{c}`") for c in rest])


def _by_name(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(file, pos, a column for each name of any file's header): rows (file, pos, cells) under their own file's header
    (of, names). The names, a few for each file, come to the driver."""
    names = [r.name for r in heads.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    d = rows.join(heads, F.col("file") == F.col("of"))
    cell = lambda n: F.when(F.array_contains("names", n), F.coalesce(F.get("cells", F.array_position("names", n) - 1), F.lit("")))
    return d.select("file", "pos", *[cell(n).alias(n) for n in names if n])


def _heads(rows: DataFrame) -> DataFrame:
    """(of, names): the first row of each file."""
    return rows.groupBy(F.col("file").alias("of")).agg(F.min_by("cells", "pos").alias("names"))


def read_list_report(spark: SparkSession, path: str) -> DataFrame:
    """list_report() of text files: file, pos (the line in it) and the columns of all files' headers, null where a file has
    no such column. Files without a table give no rows."""
    d = split_cells(numbered_lines(spark, path))
    heads = _heads(d)
    return _by_name(d.join(heads, F.col("file") == F.col("of")).where(F.col("cells") != F.col("names")).drop("of", "names"), heads)


def read_upload_report(spark: SparkSession, path: str) -> DataFrame:
    """upload_report() of text files, with file and pos; a file's columns are named by its own header."""
    d = numbered_lines(spark, path).where(F.col("line").rlike(r"^\|\s*(BuKr|\d)"))
    d = d.withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    heads = _heads(d.where(F.col("line").rlike(r"^\|\s*BuKr")))
    data = d.where(F.col("line").rlike(r"^\|\s*\d")).join(heads, F.col("file") == F.col("of")).where(F.size("cells") >= F.size("names")).drop("of", "names")
    out = _by_name(data, heads)
    keys = ["BuKr", "WE", "Grundstk"]
    have = [F.coalesce(F.col(k), F.lit("")) if k in out.columns else F.lit("") for k in keys]
    rest = [c for c in out.columns if c not in (*keys, "E-GRID", "file", "pos")]
    return out.select("file", "pos", F.concat_ws("/", *have).alias("id"), (F.col("`E-GRID`") if "E-GRID" in out.columns else F.lit(None).cast("string")).alias("egrid"), *[F.col(f"`{c}`") for c in rest])


def parcel_measurements(measures: DataFrame) -> DataFrame:
    """The parcel areas among measurements: ident, GSF_m2; the first of each ident in order."""
    m = measures.where((F.col("kind") == "Grundstück") & (F.col("measure") == "GSF Grundstückfläche"))
    return m.select("ident", "pos", parse_area(F.col("size")).alias("GSF_m2")).groupBy("ident").agg(F.min_by("GSF_m2", "pos").alias("GSF_m2"))


def join_measurements(parcels: DataFrame, measures: DataFrame, only_matched: bool = False) -> DataFrame:
    """parcels (bukr, we, grundstk, egrid) with GSF_m2 by the key WE.Grundstk; only_matched: those with a readable area."""
    m = parcel_measurements(measures)
    p = parcels.withColumn("id", F.concat_ws("/", "bukr", "we", "grundstk"))
    out = p.join(m, F.concat_ws(".", "we", "grundstk") == F.col("ident"), "left").drop("ident")
    return out.where("GSF_m2 is not null") if only_matched else out


def orphan_measurements(parcels: DataFrame, measures: DataFrame) -> DataFrame:
    keys = parcels.select(F.concat_ws(".", "we", "grundstk").alias("ident")).distinct()
    return parcel_measurements(measures).join(keys, "ident", "left_anti").select("ident")
