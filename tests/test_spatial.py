import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcover.functions.geometry import GEOMETRY
from parcelcover.operators import spatial
from parcelcover.operators.spatial import candidate_pairs, clip, intersections, union_parts
from parcelcover.sources.bridge import rectangle

BOX = "fid long, minx double, miny double, maxx double, maxy double"


def layer(spark, rows):
    return spark.createDataFrame(rows, BOX).withColumn("geom", rectangle(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])).withColumn("rect", F.lit(True))


def boxes(seed, n, wide=0):
    r = np.random.default_rng(seed)
    x, y, w, h = r.integers(0, 4000, n), r.integers(0, 4000, n), r.integers(1, 80, n), r.integers(1, 80, n)
    w[:wide] = r.integers(3000, 90_000, wide)
    return [(i, float(a), float(b), float(a + c), float(b + d)) for i, (a, b, c, d) in enumerate(zip(x, y, w, h, strict=True))]


def touching(a, b):
    return {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}


def test_pairs_equal_nested_loops(spark):
    for wide_a, wide_b in ((0, 0), (3, 0), (0, 5), (2, 2)):
        a, b = boxes(1, 150, wide_a), boxes(2, 200, wide_b)
        for cell in (16.0, 128.0):
            got = [(r.a_fid, r.b_fid) for r in candidate_pairs(layer(spark, a).drop("geom"), layer(spark, b).drop("geom"), cell).collect()]
            assert len(got) == len(set(got)) and set(got) == touching(a, b)


def test_null_boxes_pair_with_nothing(spark):
    a = spark.createDataFrame([(1, None, None, None, None), (2, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert [(r.a_fid, r.b_fid) for r in candidate_pairs(a, a).collect()] == [(2, 2)]


def test_helper_agrees_with_closed_form(spark):
    a, b = layer(spark, boxes(3, 60)), layer(spark, boxes(4, 60))
    fast = {(r.a_fid, r.b_fid): r.area for r in clip(a, b, boxes=True).collect()}
    slow = {(r.a_fid, r.b_fid): r.area for r in intersections(candidate_pairs(a.withColumn("rect", F.lit(False)), b)).collect()}
    assert fast.keys() == slow.keys() and all(abs(fast[k] - slow[k]) < 1e-6 for k in fast)


def test_clip_with_geometry_and_sliver(spark):
    a, b = layer(spark, [(1, 0.0, 0.0, 4.0, 4.0)]), layer(spark, [(1, 3.0, 3.0, 9.0, 9.0), (2, 3.99, 3.99, 9.0, 9.0), (3, 4.0, 0.0, 5.0, 5.0), (4, 3.0, 3.9985, 4.0, 8.0)])
    rows = {r.b_fid: r for r in clip(a, b, geometry=True).collect()}
    assert set(rows) == {1, 4} and rows[1].area == 1.0 and rows[1].geometry[0][0][2].x == 4.0


def test_union_of_parts(spark):
    d = layer(spark, [(1, 0.0, 0.0, 4.0, 4.0), (1, 3.0, 0.0, 7.0, 4.0), (2, 0.0, 0.0, 1.0, 1.0)])
    assert {r.fid: round(r.area, 6) for r in union_parts(d, "fid").collect()} == {1: 28.0, 2: 1.0}


def crowd(seed, n, wide):
    """Half the boxes in one cell, tiny; some wide ones over it; the rest far apart."""
    r = np.random.default_rng(seed)
    out = boxes(seed + 1, n // 2, 2)
    x, y = r.random(n) * 60, r.random(n) * 60
    out += [(n + i, 1030.0 + float(a), 1030.0 + float(b), 1030.2 + float(a), 1030.2 + float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return out + [(9 * n + i, 900.0 + i, 900.0, 900.0 + 40 * (i + 1), 1300.0) for i in range(wide)] + [(99 * n, -1e6, -1e6, 1e6, 1e6)]


@pytest.mark.parametrize("limit", [20, 10**9])
def test_crowded_cells_give_the_same_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(spatial, "LIMIT", limit)
    a, b = crowd(11, 120, 4), crowd(12, 150, 3)
    got = [(r.a_fid, r.b_fid) for r in candidate_pairs(layer(spark, a).drop("geom"), layer(spark, b).drop("geom")).collect()]
    assert len(got) == len(set(got)) and set(got) == touching(a, b)


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    """Half of all boxes in one cell: no key of the join keeps more than a small share of the rows."""
    monkeypatch.setattr(spatial, "LIMIT", 200)
    df = layer(spark, crowd(5, 3000, 3)).drop("geom", "rect")
    a = df.select([F.col(c).alias(f"a_{c}") for c in df.columns])
    used, split = spatial.tree(a, df.select([F.col(c).alias(f"b_{c}") for c in df.columns]), 128.0)
    keys = spatial._dealt(a, used, split, 128.0, "a_").groupBy("level", "cx", "cy", "turn").count().agg(F.max("count"), F.sum("count")).first()
    assert split.count() == 1 and keys[0] < 0.03 * keys[1]


def test_nothing_runs_while_the_join_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    df = layer(spark, boxes(1, 50)).drop("geom")
    spark.sparkContext.setJobGroup("build", "build")
    try:
        pairs = candidate_pairs(df, df)
        assert not tracker.getJobIdsForGroup("build")
        pairs.count()
        assert tracker.getJobIdsForGroup("build")
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def shape(*points, holes=()):
    return [[[{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]] for ring in (points, *holes)]]


SHAPES = "fid long, minx double, miny double, maxx double, maxy double, rect boolean, geom " + GEOMETRY
TRIANGLE = shape((0, 0), (8, 0), (0, 8))


def test_broken_features_are_counted(spark):
    box = (0.0, 0.0, 8.0, 8.0, False)
    parcels = spark.createDataFrame([(1, *box, TRIANGLE)], SHAPES)
    gap = [[[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": None}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]]
    far = [[[{"x": 0.0, "y": 0.0}, {"x": float("inf"), "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]]
    features = spark.createDataFrame([(1, *box, TRIANGLE), (2, *box, gap), (3, *box, far), (4, *box, [None]), (5, *box, [[None]]), (6, *box, []), (7, *box, None)], SHAPES)
    rows = {r.b_fid: (r.area, r.failed) for r in clip(parcels, features, failures=True).collect()}
    assert rows == {1: (32.0, False), **{k: (None, True) for k in (2, 3, 4, 5)}}
    assert {r.b_fid for r in clip(parcels, features).collect()} == {1}
    assert [(r.a_fid, r.skipped) for r in spatial.skipped(clip(parcels, features, failures=True), "a_fid").collect()] == [(1, 4)]
    assert clip(parcels, features.limit(0), failures=True).count() == 0


def test_union_and_repair(spark):
    ell = [shape((0, 0), (4, 0), (4, 4), (0, 4)), shape((4, 0), (8, 0), (8, 2), (4, 2))]
    ring = [shape((0, 0), (9, 0), (9, 3), (0, 3)), shape((0, 6), (9, 6), (9, 9), (0, 9)), shape((0, 3), (3, 3), (3, 6), (0, 6)), shape((6, 3), (9, 3), (9, 6), (6, 6))]
    bow = [shape((0, 0), (4, 4), (4, 0), (0, 4))]
    df = spark.createDataFrame([*[("ell", g) for g in ell], *[("ring", g) for g in ring], *[("bow", g) for g in bow], ("none", None), ("empty", []), ("flat", shape((0, 0), (4, 0), (2, 0)))], f"key string, geom {GEOMETRY}")
    out = {r.key: r for r in spatial.union_parts(df, "key").collect()}
    points = lambda ring: [(p.x, p.y) for p in ring]
    assert out["ell"].area == 24 and [[points(x) for x in p] for p in out["ell"].geom] == [[[(0, 0), (8, 0), (8, 2), (4, 2), (4, 4), (0, 4), (0, 0)]]]
    assert out["ring"].area == 72 and [[points(x) for x in p] for p in out["ring"].geom] == [[[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (3, 6), (6, 6), (6, 3), (3, 3)]]]
    assert out["bow"].area == 8 and len(out["bow"].geom) == 2
    assert all(out[k].geom is None and out[k].area is None for k in ("none", "empty", "flat"))
    assert {r.key: r.parcel_area_m2 for r in spatial.clean(df, "key").collect()} == {"ell": 24, "ring": 72, "bow": 8}
