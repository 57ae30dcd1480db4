"""Queries on list reports and measurements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcover.functions.scalars import format_area, parse_area
from parcelcover.operators import reports as R
from parcelcover.operators.survey import dedupe_first
from parcelcover.plans.materialize import shared_dir
from parcelcover.registry import query

_AREA = "cast(o_custkey % 9 as string) || ',' || lpad(cast(o_orderkey % 1000 as string), 3, '0') || '.' || cast(o_orderkey % 10 as string)"
PARCELS = "select c_custkey pos, cast(1000 + c_nationkey as string) bukr, cast(c_custkey % 300 as string) we, cast(c_nationkey as string) grundstk, 'CH' || cast(c_custkey as string) egrid from customer"
MEASURES = f"select o_orderkey pos, cast(o_custkey % 400 as string) || '.' || cast(o_custkey % 25 as string) ident, case when o_orderkey % 5 = 0 then 'Gebäude' else 'Grundstück' end kind, case when o_orderkey % 7 = 0 then 'NF' else 'GSF Grundstückfläche' end measure, case when o_orderkey % 11 = 0 then '' else {_AREA} end size from orders"
_PARSED = "try_cast(nullif(regexp_replace(size, '[\\s'',]', '', 'g'), '') as double)"
_CHOSEN = f"select ident, {_PARSED} as \"GSF_m2\" from (select *, row_number() over (partition by ident order by pos) n from m where kind = 'Grundstück' and measure = 'GSF Grundstückfläche') where n = 1"


def parcels(spark, sf) -> DataFrame:
    return spark.sql(PARCELS.replace("from customer", "from {t}"), t=spark.read.parquet(f"{sf}/customer.parquet"))


def measures(spark, sf) -> DataFrame:
    return spark.sql(MEASURES.replace("from orders", "from {t}"), t=spark.read.parquet(f"{sf}/orders.parquet"))


def report_lines(spark, sf) -> DataFrame:
    """The measurements as a printed report: rules, page noise, the header again on every page."""
    m = measures(spark, sf)
    row = m.select((F.col("pos") * 10 + 5).alias("pos"), F.concat_ws("|", F.lit(""), "ident", "kind", F.concat(F.lit(" "), F.col("measure"), F.lit(" ")), "size", F.lit("")).alias("line"))
    pages = m.where("pos % 50 = 0")
    noise = [(0, "Seite"), (1, "|-----|-----|-----|-----|"), (2, "| Ident. AO | BezAOTyp | Bem.Art Mitt | Größe |"), (3, "|-----|-----|-----|-----|"), (4, "| | | | |")]
    head = pages.select("pos", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in noise])).alias("n")).select((F.col("pos") * 10 + F.col("n.i")).alias("pos"), F.col("n.t").alias("line"))
    return row.unionByName(head)


@query("s2_read_list_report", f"select pos * 10 + 5 pos, ident \"Ident. AO\", kind \"BezAOTyp\", measure \"Bem.Art Mitt\", size \"Größe\" from ({MEASURES})")
def _(spark, sf):
    return R.list_report(report_lines(spark, sf))


@query("s3_read_upload_report", f"select pos, bukr || '/' || we || '/' || grundstk id, egrid, 'Ort ' || we \"Ort\" from ({PARCELS})")
def _(spark, sf):
    p = parcels(spark, sf)
    lines = p.select("pos", F.concat(F.lit("| "), F.concat_ws(" | ", "bukr", "we", "grundstk", F.concat(F.lit("Ort "), "we"), "egrid"), F.lit(" |")).alias("line"))
    head = p.where("pos = 0").select(F.lit(-1).cast("long").alias("pos"), F.lit("|BuKr|WE|Grundstk|Ort|E-GRID|").alias("line"))
    return R.upload_report(lines.unionByName(head).unionByName(p.where("pos % 40 = 0").select("pos", F.lit("|-----|").alias("line"))))


def _printed(lines: DataFrame, path: str) -> str:
    """Writes lines (file, pos, line) as text files in their order."""
    lines.repartition("file").sortWithinPartitions("file", "pos").select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    return path


@query("s2_read_report_files", f"select ident \"Ident. AO\", kind \"BezAOTyp\", measure \"Bem.Art Mitt\", size \"Größe\" from ({MEASURES})")
def _(spark, sf):
    lines = report_lines(spark, sf).withColumn("file", F.floor(F.col("pos") / 50_000))
    return R.read_list_report(spark, _printed(lines, f"{shared_dir(spark)}/report-{uuid.uuid4().hex}")).drop("file", "pos")


@query("s3_read_upload_files", f"select bukr || '/' || we || '/' || grundstk id, egrid, 'Ort ' || we \"Ort\" from ({PARCELS})")
def _(spark, sf):
    p = parcels(spark, sf).withColumn("file", F.floor(F.col("pos") / 5_000))
    lines = p.select("file", "pos", F.concat(F.lit("| "), F.concat_ws(" | ", "bukr", "we", "grundstk", F.concat(F.lit("Ort "), "we"), "egrid"), F.lit(" |")).alias("line"))
    heads = p.select("file", F.lit(-1).cast("long").alias("pos"), F.lit("|BuKr|WE|Grundstk|Ort|E-GRID|").alias("line")).distinct()
    return R.read_upload_report(spark, _printed(lines.unionByName(heads), f"{shared_dir(spark)}/report-{uuid.uuid4().hex}")).drop("file", "pos")


@query("j9_join_measurements", f"with m as ({MEASURES}), p as ({PARCELS}) select pos, bukr || '/' || we || '/' || grundstk id, egrid, \"GSF_m2\" from p left join ({_CHOSEN}) c on c.ident = we || '.' || grundstk")
def _(spark, sf):
    return R.join_measurements(parcels(spark, sf), measures(spark, sf)).select("pos", "id", "egrid", "GSF_m2")


@query("j9_join_measurements_matched", f"with m as ({MEASURES}), p as ({PARCELS}) select pos, egrid, \"GSF_m2\" from p join ({_CHOSEN}) c on c.ident = we || '.' || grundstk where \"GSF_m2\" is not null")
def _(spark, sf):
    return R.join_measurements(parcels(spark, sf), measures(spark, sf), only_matched=True).select("pos", "egrid", "GSF_m2")


@query("j10_orphan_measurements", f"with m as ({MEASURES}), p as ({PARCELS}) select ident from ({_CHOSEN}) where ident not in (select we || '.' || grundstk from p)")
def _(spark, sf):
    return R.orphan_measurements(parcels(spark, sf), measures(spark, sf)).orderBy("ident")


@query("a26_dedupe_first", f"select pos, we, grundstk, egrid from (select *, row_number() over (partition by we, grundstk order by pos) n from ({PARCELS})) where n = 1")
def _(spark, sf):
    return dedupe_first(parcels(spark, sf), ["we", "grundstk"], "pos").select("pos", "we", "grundstk", "egrid")


@query("f8_parse_area", f"select pos, {_PARSED} area, coalesce(regexp_replace(regexp_replace(format('{{:.4f}}', {_PARSED}), '0+$', ''), '\\.$', ''), '') shown from ({MEASURES})")
def _(spark, sf):
    m = measures(spark, sf).withColumn("area", parse_area(F.col("size")))
    return m.select("pos", "area", format_area(F.col("area")).alias("shown"))
