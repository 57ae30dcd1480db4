"""Vegetation on pixel tables (tile, px, py, bands), and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.functions.geometry import contains
from parcelcover.operators.spatial import candidate_pairs

THRESHOLD = {"ndvi": 0.2, "gli": 0.1, "vari": 0.1}


def vegetation_index(kind: str, r: Column, g: Column, b: Column, nir: Column) -> Column:
    """NDVI, GLI or VARI within [-1, 1]; 0 where the denominator is 0, null without data."""
    top, below = {"ndvi": (nir - r, nir + r), "gli": (2 * g - r - b, 2 * g + r + b), "vari": (g - r, g + r - b)}[kind]
    value = F.when(below == 0, 0.0).otherwise(F.try_divide(top.cast("double"), below.cast("double")))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) if kind == "vari" else value


def label_pixels(px: DataFrame, buildings: DataFrame, order: str = "fid", cell: int = 32) -> DataFrame:
    """px with building: the last (by order) that holds the pixel's centre, by even-odd test where the buildings have a
    geom, else by their boxes. Boxes are dealt out to cells. Both sides are shuffled: planned by the size of the files
    they come from, outlines would be sent whole to the driver and all executors."""
    b = buildings.withColumn("cx", F.explode(F.sequence(F.floor(F.col("minx") / cell), F.floor(F.col("maxx") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("miny") / cell), F.floor(F.col("maxy") / cell))))
    p = px.withColumn("x", F.col("px") + 0.5).withColumn("y", F.col("py") + 0.5)
    p = p.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    hit = p.join(b.hint("merge"), ["cx", "cy"]).where("x >= minx and x < maxx and y >= miny and y < maxy")
    hit = hit.where(contains(F.col("geom"), F.col("x"), F.col("y"))) if "geom" in buildings.columns else hit
    return hit.groupBy(*px.columns).agg(F.max(order).alias("building"))


def despeckle(mask: DataFrame) -> DataFrame:
    """mask (px, py, on) with the majority among the labelled 3 x 3 neighbours and itself: 2 * sum > count."""
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = mask.withColumn("s", F.explode(steps)).select((F.col("px") + F.col("s.dx")).alias("px"), (F.col("py") + F.col("s.dy")).alias("py"), "on")
    votes = spread.groupBy("px", "py").agg(F.sum(F.col("on").cast("int")).alias("yes"), F.count("*").alias("n"))
    return mask.drop("on").join(votes, ["px", "py"]).withColumn("on", 2 * F.col("yes") > F.col("n")).drop("yes", "n")


def roof_stats(labelled: DataFrame, resolution: float) -> DataFrame:
    """(building, roof_px, green_m2, green_pct) of labelled pixels (building, on)."""
    g = labelled.groupBy("building").agg(F.count("*").alias("roof_px"), F.sum(F.col("on").cast("int")).alias("green_px"))
    return g.select("building", "roof_px", (F.col("green_px") * resolution * resolution).alias("green_m2"), (F.col("green_px") * 100.0 / F.col("roof_px")).alias("green_pct"))


def mosaic(px: DataFrame) -> DataFrame:
    """One value a pixel: tiles of another resolution than the first one's go, a later tile overwrites."""
    first = px.agg(F.min_by("resolution", "tile")).first()[0]  # one number
    d = px.where(F.col("resolution") == F.lit(first))
    return d.groupBy("px", "py").agg(F.max_by("r", "tile").alias("r"), F.max_by("g", "tile").alias("g"), F.max("tile").alias("tile"))


def latest_tiles(items: DataFrame, year: int | None = None) -> DataFrame:
    """(tile, year, resolution): of each tile the newest (or the given) year, in it the finest asset."""
    d = items.select(F.regexp_extract("asset", r"_(\d{4})_(\d+-\d+)_", 2).alias("tile"), F.regexp_extract("asset", r"_(\d{4})_(\d+-\d+)_", 1).try_cast("int").alias("year"), F.regexp_extract("asset", r"_([\d.]+)_2056\.tif$", 1).try_cast("double").alias("resolution"))
    if year:
        d = d.where(F.col("year") == year)
    w = Window.partitionBy("tile").orderBy(F.col("year").desc(), "resolution")
    return d.where("year is not null and resolution is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def to_features(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def sample_training(vectors: DataFrame, areas: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Vectors (x, y and more) inside labelled areas (cls, fid, geom and its box), once for each area that holds them, with
    fid and cls. Points and areas meet in the cells of the spatial join, then the area's outline decides: its left and
    lower borders belong to it. Points or areas without a place are in none."""
    points = vectors.withColumns({"minx": F.col(x), "miny": F.col(y), "maxx": F.col(x), "maxy": F.col(y)})
    pairs = candidate_pairs(areas.select("fid", "cls", "geom", "minx", "miny", "maxx", "maxy"), points)
    inside = pairs.where(contains(F.col("a_geom"), F.col(f"b_{x}"), F.col(f"b_{y}")))
    return inside.select(*[F.col(f"b_{c}").alias(c) for c in vectors.columns], F.col("a_fid").alias("fid"), F.col("a_cls").alias("cls"))


def class_weights(samples: DataFrame, label: str = "cls") -> DataFrame:
    """samples with weight: all classes weigh the same in sum, and all samples together as much as their number."""
    counts = samples.groupBy(F.col(label).alias("__class")).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__classes"))  # one row
    weights = counts.crossJoin(F.broadcast(whole)).select("__class", (F.col("__all") / (F.col("__classes") * F.col("__n"))).alias("weight"))
    return samples.join(weights, F.col(label) == F.col("__class")).drop("__class")


def train_forest(samples: DataFrame, label: str = "label", trees: int = 50, seed: int = 42, weight: str | None = None):
    from pyspark.ml.classification import RandomForestClassifier

    more = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(numTrees=trees, seed=seed, labelCol=label, featuresCol="features", **more).fit(to_features(samples))


def cluster_vectors(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    f = to_features(vectors)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(f).transform(f).drop("features")


def dominant_class(predicted: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label of each key; of equals the smallest."""
    c = predicted.groupBy(key, label).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(label).alias("label"))).alias("best")).select(key, F.col("best.label").alias(label), (-F.col("best.less")).alias("n"))
