"""Queries on pixels, tiles and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelcover.operators import pixels as X
from parcelcover.registry import query
from parcelcover.sources.bridge import bridge

GLI = "case when 2 * g + r + b = 0 then 0e0 else cast(2 * g - r - b as double) / (2 * g + r + b) end"
ROOFS_SQL = "select p_partkey fid, (p_partkey % 10) * 10 minx, cast(floor(p_partkey / 10) as bigint) * 9 miny, (p_partkey % 10) * 10 + 4 + p_size * 0.25e0 maxx, cast(floor(p_partkey / 10) as bigint) * 9 + 6 maxy from part"
LABELLED = f"select p.px, p.py, p.gli, max(f.fid) building from (select px, py, {GLI} gli from b_pixels) p join ({ROOFS_SQL}) f on p.px + 0.5 >= f.minx and p.px + 0.5 < f.maxx and p.py + 0.5 >= f.miny and p.py + 0.5 < f.maxy and not (p.px + 0.5 >= (f.minx + f.maxx) / 2 and p.py + 0.5 >= f.miny + 3) group by 1, 2, 3"
MASK = f"select px, py, building, gli > 0.1 as \"on\" from ({LABELLED})"


def roofs(spark, sf):
    """L-shaped roofs: boxes without their last quarter."""
    d = spark.sql(ROOFS_SQL.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf}/part.parquet"))
    x, y = (F.col("minx") + F.col("maxx")) / 2, F.col("miny") + 3
    corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", y), (x, y), (x, "maxy"), ("minx", "maxy"), ("minx", "miny")]
    column = lambda c: F.col(c) if isinstance(c, str) else c
    ring = F.array(*[F.struct(column(a).cast("double").alias("x"), column(b).cast("double").alias("y")) for a, b in corners])
    return d.withColumn("geom", F.array(F.array(ring)))


def labelled(spark, sf):
    p = bridge(spark, sf, "b_pixels")
    p = p.select("px", "py", X.vegetation_index("gli", F.col("r"), F.col("g"), F.col("b"), F.col("nir")).alias("gli"))
    return X.label_pixels(p, roofs(spark, sf))


def mask(spark, sf):
    return labelled(spark, sf).select("px", "py", "building", (F.col("gli") > X.THRESHOLD["gli"]).alias("on"))


@query("x1_vegetation_index", f"select event_id, case when nir is null then null when nir + r = 0 then 0e0 else cast(nir - r as double) / (nir + r) end ndvi, {GLI} gli, case when g + r - b = 0 then 0e0 else greatest(-1e0, least(1e0, cast(g - r as double) / (g + r - b))) end vari from b_pixels")
def _(spark, sf):
    bands = [F.col(c) for c in ("r", "g", "b", "nir")]
    return bridge(spark, sf, "b_pixels").select("event_id", *[X.vegetation_index(k, *bands).alias(k) for k in ("ndvi", "gli", "vari")])


@query("x3_label_pixels", LABELLED)
def _(spark, sf):
    return labelled(spark, sf)


@query("x4_threshold_mask", MASK)
def _(spark, sf):
    return mask(spark, sf)


@query("x5_despeckle", f"with m as ({MASK}) select a.px, a.py, a.building, 2 * sum(cast(b.\"on\" as int)) > count(*) as \"on\" from m a join m b on abs(a.px - b.px) <= 1 and abs(a.py - b.py) <= 1 group by 1, 2, 3")
def _(spark, sf):
    return X.despeckle(mask(spark, sf))


@query("x6_roof_stats", f"select building, count(*) roof_px, sum(cast(\"on\" as int)) * 0.25e0 green_m2, sum(cast(\"on\" as int)) * 100e0 / count(*) green_pct from ({MASK}) group by 1")
def _(spark, sf):
    return X.roof_stats(mask(spark, sf), 0.5)


_TILES = "select user_id % 4 tile, case when user_id % 4 = 3 then 0.5e0 else 0.1e0 end resolution, event_id % 60 px, cast(floor(event_id / 60) as int) % 60 py, max(cast(floor(value) as int)) r, max(event_id) g from events group by 1, 2, 3, 4"


@query("x7_mosaic_pixels", f"with t as ({_TILES}), k as (select * from t where resolution = (select arg_min(resolution, tile) from t)) select px, py, arg_max(r, tile) r, arg_max(g, tile) g, max(tile) tile from k group by 1, 2")
def _(spark, sf):
    return X.mosaic(spark.sql(_TILES.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf}/events.parquet")))


_ITEMS = "select 'ortho_' || cast(2018 + o_custkey % 6 as string) || '_' || cast(2600 + o_orderkey % 40 as string) || '-' || cast(1200 + o_orderkey % 7 as string) || '_' || case when o_orderkey % 3 = 0 then '0.1' else '2' end || '_2056.tif' asset from orders"


@query("w8_latest_tile_assets", f"with i as (select regexp_extract(asset, '_(\\d{{4}})_(\\d+-\\d+)_', 2) tile, cast(regexp_extract(asset, '_(\\d{{4}})_', 1) as int) y, cast(regexp_extract(asset, '_([\\d.]+)_2056', 1) as double) res from ({_ITEMS})) select tile, y as year, min(res) resolution from i where (tile, y) in (select tile, max(y) from i group by 1) group by 1, 2")
def _(spark, sf):
    return X.latest_tiles(spark.sql(_ITEMS.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf}/orders.parquet")))


def _vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


_INSIDE = f"""select v.vec_id, f.fid, f.cls, v.label from (select vec_id, label, vec_id % 100 + 0.5e0 x, cast(floor(vec_id / 100) as bigint) + 0.5e0 y from embeddings) v
    join (select r.*, fid % 3 cls from ({ROOFS_SQL}) r) f on x >= f.minx and x < f.maxx and y >= f.miny and y < f.maxy and not (x >= (f.minx + f.maxx) / 2 and y >= f.miny + 3)"""


@query("m1_sample_training", f"with s as ({_INSIDE}) select vec_id, fid, cls, label, (select count(*) from s) / ((select count(distinct cls) from s) * n) weight from s join (select cls c, count(*) n from s group by 1) on c = cls")
def _(spark, sf):
    """Vectors inside L-shaped areas of three classes, weighted for balance."""
    v = _vectors(spark, sf).select("vec_id", "label", ((F.col("vec_id") % 100) + 0.5).alias("x"), (F.floor(F.col("vec_id") / 100) + 0.5).alias("y"))
    areas = roofs(spark, sf).withColumn("cls", F.col("fid") % 3)
    areas = areas.withColumns({c: F.col(c).cast("double") for c in ("minx", "miny", "maxx", "maxy")})
    return X.class_weights(X.sample_training(v, areas)).select("vec_id", "fid", "cls", "label", "weight")


@query("m2_classify_vectors")
def _(spark, sf):
    v = _vectors(spark, sf)
    model = X.train_forest(v.where("vec_id % 4 <> 0"))
    return model.transform(X.to_features(v)).select("vec_id", "label", F.col("prediction").cast("int").alias("predicted"))


@query("m3_dominant_class", "select parcel, label, n from (select *, row_number() over (partition by parcel order by n desc, label) k from (select vec_id % 37 parcel, label, count(*) n from embeddings group by 1, 2)) where k = 1")
def _(spark, sf):
    return X.dominant_class(_vectors(spark, sf).withColumn("parcel", F.col("vec_id") % 37), "parcel", "label")


@query("m4_cluster_vectors")
def _(spark, sf):
    return X.cluster_vectors(_vectors(spark, sf), 10).select("vec_id", "cluster")
