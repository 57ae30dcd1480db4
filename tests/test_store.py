import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcover.sources import store

SCHEMA = "fid long, egrid string, bfsnr int, minx double, miny double, maxx double, maxy double"


def rows(n=20_000):
    r = np.random.default_rng(4)
    x, y, w = r.uniform(2_600_000, 2_640_000, n), r.uniform(1_200_000, 1_240_000, n), r.uniform(1, 60, n)
    return [(i, f"CH{i // 2}", int(i % 25) if i % 50 else None, float(a), float(b), float(a + c), float(b + c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))] + [(n, "BAD", 1, None, None, None, None)]


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "layer")
    store.write_layer(spark.createDataFrame(rows(), SCHEMA), path, row_group=16 << 10)
    return path


def scanned(df):
    """Rows that the scan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def explained(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_window_reads_few_row_groups(spark, layer):
    box = (2_610_000.0, 1_210_000.0, 2_611_000.0, 1_211_000.0)
    df = store.read_landcover(spark, layer, box)
    want = {r[0] for r in rows() if r[3] is not None and r[3] <= box[2] and r[5] >= box[0] and r[4] <= box[3] and r[6] >= box[1]}
    assert {r.fid for r in df.collect()} == want and want
    assert "PushedFilters: [IsNotNull(minx)" in explained(spark, df) and "LessThanOrEqual(minx,2611000.0)" in explained(spark, df)
    assert scanned(df) < 3_000
    assert store.read_landcover(spark, layer).count() == 20_001


def test_borders_count(spark, tmp_path):
    store.write_layer(spark.createDataFrame([(1, "CH1", 1, 0.0, 0.0, 4.0, 4.0)], SCHEMA), f"{tmp_path}/l")
    assert store.read_landcover(spark, f"{tmp_path}/l", (4, 4, 9, 9)).count() == 1
    assert store.read_landcover(spark, f"{tmp_path}/l", (4.01, 4, 9, 9)).count() == 0


@pytest.mark.parametrize("listed", [500, 1])
def test_keys_and_municipality(spark, layer, monkeypatch, listed):
    monkeypatch.setattr(store, "LISTED", listed)
    ids = lambda df: {r.fid for r in df.collect()}
    assert ids(store.read_parcels(spark, layer, ["CH3", "CH4", "BAD", "x'", None, "CH3"])) == {6, 7, 8, 9}
    assert ids(store.read_parcels(spark, layer, ["CH3", "CH4"], 7)) == {7}
    assert ids(store.read_parcels(spark, layer, ["BAD"])) == set() == ids(store.read_parcels(spark, layer, []))
    assert ids(store.read_parcels(spark, layer, spark.createDataFrame([("CH5",), ("BAD",), (None,)], "egrid string"))) == {10, 11}
    assert "EqualTo(bfsnr,7)" in explained(spark, store.read_parcels(spark, layer, bfsnr=7))
    assert [r.bfsnr for r in store.municipalities(spark, layer).collect()] == list(range(25))


def test_reference_system(spark, tmp_path):
    store.write_layer(spark.createDataFrame(rows(5), SCHEMA), f"{tmp_path}/l", crs=4326, unit=1e-5)
    with pytest.raises(ValueError, match="reference system 4326, not 2056"):
        store.read_parcels(spark, f"{tmp_path}/l")
    assert store.read_layer(spark, f"{tmp_path}/l", 4326).count() == 6
    spark.createDataFrame(rows(5), SCHEMA).write.parquet(f"{tmp_path}/plain")
    with pytest.raises(ValueError, match="None"):
        store.read_layer(spark, f"{tmp_path}/plain")


def test_curve(spark):
    points = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (5, 9)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    got = [r.z for r in df.select((store.z_order(F.col("x"), F.col("y")) - store.z_order(F.lit(0.0), F.lit(0.0))).alias("z")).collect()]
    assert got == [sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(8)) for x, y in points]
