"""Faults that showed on larger tables only."""

import pytest
from pyspark.sql import functions as F

from parcelcover import queries as library
from parcelcover.functions import geometry as G

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["x3_label_pixels", "x5_despeckle", "x6_roof_stats"])
def test_outlines_are_not_sent_to_all(spark, name):
    assert "BroadcastHashJoin" not in plan(library.QUERIES[name](spark, SF))


def test_round_trip_far_from_home(spark):
    d = spark.createDataFrame([(2600000.0 + 400.0 * i, 1200000.0 + 1000.0 * i) for i in range(0, 8400, 40)] + [(2485000.0, 1075000.0), (2834000.0, 1300000.0)], "e double, n double").where("e < 2900000")
    d = d.unionByName(spark.range(0, 8400, 40).selectExpr("2600000e0 + id % 50 * 64 as e", "1200000e0 + 1000 * id as n"))
    x, y = G.wgs84_to_lv95(*G.lv95_to_wgs84(F.col("e"), F.col("n")))
    assert d.where((F.abs(x - F.col("e")) > 0.001) | (F.abs(y - F.col("n")) > 0.001)).count() == 0
    assert [tuple(r) for r in spark.createDataFrame([(None, 1.0)], "a double, b double").select(*G.wgs84_to_lv95(F.col("a"), F.col("b"))).collect()] == [(None, None)]


@pytest.mark.parametrize("name", ["g5_polygon_overlay", "j4_skipped_shapes", "j4_clip_shapes", "j15_overlap_shapes", "j7_intersect_green_shapes"])
def test_shapes_are_not_sent_to_all(spark, name):
    joins = [line for line in plan(library.QUERIES[name](spark, SF)).splitlines() if "HashJoin" in line]
    # Left are the split cells, the 26 types and no layer.
    assert not [line for line in joins if "s_cx" not in line and "__art" not in line]


def test_polygons_are_made_only_where_they_are_asked_for(spark, monkeypatch):
    """Areas of all three operations and of three layers' common part are those of polygons made one after the other."""
    import numpy as np

    from parcelcover.operators import overlay as O
    from tests.test_overlay import star

    rng = np.random.default_rng(8)
    a, b, c = ([star(rng, 2600000.0 + i % 2, 1200000.0) for i in range(20)] for _ in range(3))
    flat = [O.Flat(O.to_arrow(g)) for g in (a, b, c)]
    want = [[O.overlay(x, y, op) for x, y in zip(a, b, strict=True)] for op in ("and", "or", "minus")]
    three = [O.overlay(g, z, "and")[0] for (_, g), z in zip(want[0], c, strict=True)]
    monkeypatch.setattr(O, "_assemble", None)
    for got, w in zip(O.areas_flat(flat[:2], ("and", "or", "minus")), want, strict=True):
        assert got == pytest.approx([x for x, _ in w], abs=1e-5)
    assert O.areas_flat(flat, ("and",))[0] == pytest.approx(three, abs=1e-5)


def test_detail_is_read_once(spark):
    """Both sides of the comparison come from one pass over the pieces."""
    scans = [plan(library.QUERIES[name](spark, SF)).count("FileScan parquet") for name in ("j12_compare_detail", "j4_clip_landcover")]
    assert scans[0] == scans[1]


def test_rings_at_one_go_are_those_walked_one_by_one(monkeypatch):
    """Polygons of plain pairs aren't walked, and come out as walk() and polygons() give them, corner by corner."""
    import numpy as np

    from parcelcover.operators import overlay as O
    from tests.test_overlay import SQUARE, poly, star

    rng = np.random.default_rng(3)
    frame = poly((0, 0), (8, 0), (8, 8), (0, 8), holes=[[(2, 2), (6, 2), (6, 6), (2, 6)]])
    plain = [star(rng, 2600000.0, 1200000.0) for _ in range(30)] + [frame, SQUARE + poly((5, 0), (9, 0), (9, 4)), poly((0, 0), (1, 0), (2, 0), (2, 2), (0, 2)), []]
    mixed = plain + [frame + poly((20, 0), (24, 0), (24, 4)), poly((0, 0), (4, 4), (4, 0), (0, 4)), poly((0, 0), (1e-9, 1), (2e-9, 0))]
    flat = O.Flat(O.to_arrow(mixed))
    got = O.overlay_flat(flat, None, "or", True)
    with monkeypatch.context() as m:
        m.setattr(O, "_plain", lambda edges, *steps: (np.zeros(edges.n, bool), O.to_arrow([])))
        want = O.overlay_flat(flat, None, "or", True)
    assert got[1] == want[1] and got[0].tolist() == want[0].tolist()
    monkeypatch.setattr(O, "_walked", None)
    assert [len(g) for g in O.overlay_flat(O.Flat(O.to_arrow(plain[30:])), None, "or", True)[1]] == [1, 2, 1, 0]


@pytest.mark.parametrize("few", [0, 10])
def test_clean_gathers_only_keys_with_several_geometries(spark, few):
    from parcelcover.operators.spatial import clean

    box = lambda x: [[[(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0), (x, 0.0)]]]
    rows = [("a", box(0.0)), ("b", box(0.0)), ("b", box(1.0)), ("c", None), ("d", None), ("d", box(0.0)), (None, box(0.0)), (None, box(5.0)), ("e", [])]
    df = spark.createDataFrame(rows, f"fid string, geom {G.GEOMETRY}")
    assert sorted(((r.fid or "", r.parcel_area_m2, len(r.geom)) for r in clean(df, "fid", few=few).collect())) == [("", 8.0, 2), ("a", 4.0, 1), ("b", 6.0, 1), ("d", 4.0, 1)]
    assert "Exchange" not in plan(clean(df.where("fid = 'a'"), "fid"))


def exchanged(df):
    """Columns of each exchange of a plan's rows, by the names that its rows are dealt out or grouped by."""
    return [line.strip() for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


def test_pieces_carry_what_is_asked_for(spark):
    """Sums by class shuffle no pieces, extras join parcels and not pieces, and columns nobody asks for stay behind."""
    assert not [e for e in exchanged(library.QUERIES["a17_class_breakdown"](spark, SF)) if "egrid" in e]
    assert sum("egrid" in e and "fid" in e for e in exchanged(library.QUERIES["j2_attach_user_extras"](spark, SF))) == 1
    for name in ("u2_merge_batches", "r6_feature_cap_flag", "s10_write_layers", "a3_landcover_kpis_rounded", "j2_attach_user_extras"):
        assert "gwr_egid" not in plan(library.QUERIES[name](spark, SF)), name


def test_layers_are_computed_once(spark, tmp_path):
    """Whether a layer is empty shows once it is written; it isn't computed for that before."""
    from parcelcover.sources import files

    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    full = spark.range(10).mapInPandas(count, "id long")
    files.write_layers({"full": full, "none": spark.range(10).where("id < 0")}, str(tmp_path))
    assert rows.value == 10 and spark.read.parquet(f"{tmp_path}/full").count() == 10 and not (tmp_path / "none").exists()
