import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcover.operators import pixels as X
from tests.test_spatial import shape

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_sampling_equals_a_point_test(spark):
    r = np.random.default_rng(3)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(-2, 12, (300, 2)))] + [(900, None, 1.0), (901, 0.0, 0.0), (902, 10.0, 0.0)]
    ring = shape((0, 0), (10, 0), (10, 10), (0, 10), holes=[[(2, 2), (8, 2), (8, 8), (2, 8)]])
    areas = [(1, 5, ring, 0.0, 0.0, 10.0, 10.0), (2, 6, shape((0, 0), (6, 0), (0, 6)), 0.0, 0.0, 6.0, 6.0), (3, 7, None, None, None, None, None)]
    kind = "fid long, cls int, geom array<array<array<struct<x: double, y: double>>>>, minx double, miny double, maxx double, maxy double"
    got = {(x.i, x.fid, x.cls) for x in X.sample_training(spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(areas, kind)).collect()}
    frame = lambda a, b: 0 <= a < 10 and 0 <= b < 10 and not (2 <= a < 8 and 2 <= b < 8)
    corner = lambda a, b: a >= 0 and b >= 0 and a + b < 6
    assert got == {(i, f, c) for i, a, b in points if a is not None for f, c, test in ((1, 5, frame), (2, 6, corner)) if test(a, b)}


def test_class_weights(spark):
    df = spark.createDataFrame([(c,) for c in "aaaaaab"], "cls string")
    weights = {r.cls: r.weight for r in X.class_weights(df).collect()}
    assert weights == {"a": pytest.approx(7 / 12), "b": pytest.approx(3.5)}
    assert X.class_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(7)


def test_forest_on_held_out_vectors(vectors):
    """The given labels are random, so the class is one that the vectors tell: better by far than the most frequent one;
    the same seed gives the same trees."""
    told = vectors.withColumn("cls", F.when(F.col("embedding")[0] > 0.03, 2).when(F.col("embedding")[1] > 0, 1).otherwise(0))
    train, held = told.where("vec_id % 4 <> 0"), told.where("vec_id % 4 = 0")
    counts = [r["count"] for r in held.groupBy("cls").count().collect()]
    found = [[r.prediction == r.cls for r in X.train_forest(X.class_weights(train), "cls", weight="weight").transform(X.to_features(held)).orderBy("vec_id").collect()] for _ in range(2)]
    assert found[0] == found[1]
    assert np.mean(found[0]) > max(0.7, 1.4 * max(counts) / sum(counts))


def test_clusters_are_found(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(5, 64)) * 3
    rows = [(i, int(i % 5), [float(x) for x in centres[i % 5] + r.normal(size=64)]) for i in range(400)]
    got = X.cluster_vectors(spark.createDataFrame(rows, "vec_id long, centre int, embedding array<double>"), 5).groupBy("centre", "cluster").count().collect()
    assert sum(max(g["count"] for g in got if g.centre == k) for k in range(5)) >= 0.95 * 400
    assert len({g.cluster for g in got}) == 5


def test_clusters_of_the_table(vectors):
    """Any number of clusters explains some of the spread, and more than one cluster does."""
    rows = X.cluster_vectors(vectors, 10).select("embedding", "cluster").collect()
    v, c = np.array([r.embedding for r in rows]), np.array([r.cluster for r in rows])
    within = sum(((v[c == k] - v[c == k].mean(0)) ** 2).sum() for k in set(c.tolist()))
    assert len(set(c.tolist())) == 10 and within < 0.95 * ((v - v.mean(0)) ** 2).sum()
