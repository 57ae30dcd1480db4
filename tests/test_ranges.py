import json

import pytest
from pyspark.sql import functions as F

from parcelcover.operators.reports import read_list_report, read_upload_report
from parcelcover.operators.spatial import boxed, clip
from parcelcover.sources import files, ranges

FEATURES = [
    {"type": "Feature", "properties": {"id": "1", "layer": "parcel", "note": 'a "quoted" } brace { \\'}, "geometry": None},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]}, "properties": {"id": "2", "layer": "landcover", "art": "Wä}lder", "area_m2": 12.5}},
    {"properties": {"id": "3", "layer": "bauzonen", "bauzone_code": "{C1", "nested": {"a": [{"b": {}}]}}, "type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [5, 6], [5, 5]]]}},
]
TOP = {"type": "FeatureCollection", "name": 'x{"', "crs": {"type": "name", "properties": {"name": "EPSG:2056"}}, "features": FEATURES, "end": "}"}
SMALL = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def cut(spark):
    """Sets the size of blocks in bytes."""
    names = ["spark.sql.files.maxPartitionBytes", *SMALL]
    old = {n: spark.conf.get(n, None) for n in names}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_members_for_any_cut(spark, tmp_path, cut, indent):
    text = json.dumps(TOP, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"features": FEATURES[:1]}), encoding="utf-8")
    size = len(text.encode())
    for n in (size + 1, size // 2, size // 3, 301, 97, 41):
        cut(n)
        rows = sorted(ranges.array_members(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.pos))
        got = [(r.file[-6:], r.pos, json.loads(r.value)) for r in rows]
        assert got == [("a.json", 0, TOP["crs"]), *[("a.json", k + 1, f) for k, f in enumerate(FEATURES)], ("b.json", 0, FEATURES[0])]


def test_collection_as_layers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TOP, indent=1), encoding="utf-8")
    parcels, overlays = files.split_layers(files.read_collection(spark, str(tmp_path)))
    assert [(r.layer, r.id) for r in parcels.collect()] == [("parcel", "1")]
    assert sorted((r.id, r.layer, r.art, r.area_m2, len(r.geom[0][0])) for r in overlays.collect()) == [("2", "landcover", "Wä}lder", 12.5, 4), ("3", "bauzonen", "{C1", None, 4)]
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert files.read_collection(spark, str(tmp_path)).count() == 0


def test_from_a_collection_to_clipped_pieces(spark, tmp_path):
    """Parcels and features from one file, boxed, clipped, one broken feature counted."""
    square = lambda x, y, w: {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]}
    feature = lambda i, layer, g: {"type": "Feature", "properties": {"id": i, "layer": layer}, "geometry": g}
    triangle = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [0, 4], [0, 0]]]]}
    broken = {"type": "Polygon", "coordinates": [[[0, 0], [4, None], [4, 4], [0, 0]]]}
    top = {"type": "FeatureCollection", "features": [feature("p", "parcel", square(0, 0, 2)), feature("s", "landcover", square(1, 1, 5)), feature("t", "landcover", triangle), feature("b", "landcover", broken)]}
    (tmp_path / "a.json").write_text(json.dumps(top, indent=1))
    parcels, overlays = files.split_layers(files.read_collection(spark, str(tmp_path)))
    pieces = clip(boxed(parcels.select("id", "geom")), boxed(overlays.select("id", "geom")), failures=True)
    assert {r.b_id: (r.area, r.failed) for r in pieces.collect()} == {"s": (1.0, False), "t": (4.0, False), "b": (None, True)}


def test_line_numbers(spark, tmp_path, cut):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(300)))
    (tmp_path / "b.txt").write_text("x\n\ny")
    cut(100)
    assert ranges.blocks(spark, str(tmp_path)).select("file", "block").distinct().count() > 20
    got = sorted((r.file[-5:], r.pos, r.line) for r in ranges.numbered_lines(spark, str(tmp_path)).collect())
    assert got == [("a.txt", k, f"line {k}") for k in range(300)] + [("b.txt", 0, "x"), ("b.txt", 1, ""), ("b.txt", 2, "y")]


REPORT = "Report of today\n\n| BuKr | WE | Area |\n|------|----|------|\n| 1 | 10 | 5,000.5 |\n| 2 | 20\n|  |  |  |\n| BuKr | WE | Area |\n| 3 | 30 | 7 | extra |\nend\n"


def test_list_reports_of_a_folder(spark, tmp_path, cut):
    (tmp_path / "a.txt").write_text(REPORT)
    (tmp_path / "b.txt").write_text("| WE | Other |\n| 40 | z |\n")
    (tmp_path / "c.txt").write_text("no table\n")
    for n in (10_000, 25):
        cut(n)
        rows = read_list_report(spark, str(tmp_path)).orderBy("file", "pos").collect()
        assert [(r.file[-5:], r.BuKr, r.WE, r.Area, r.Other) for r in rows] == [("a.txt", "1", "10", "5,000.5", None), ("a.txt", "2", "20", "", None), ("a.txt", "3", "30", "7", None), ("b.txt", None, "40", None, "z")]
    (tmp_path / "c.txt").write_text("")
    assert read_list_report(spark, str(tmp_path / "c.txt")).collect() == []


def test_upload_reports_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("title\n|BuKr|WE|Grundstk|E-GRID|Ort|\n|-----|\n|1|2|3|CH1|Bern|\n|1|2|4|\n| 5|6|7|CH2|Chur|\n")
    (tmp_path / "b.txt").write_text("|BuKr|E-GRID|WE|Grundstk|Land|\n|8|CH3|9|1|CH|\n")
    rows = read_upload_report(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.egrid, r.Ort, r.Land) for r in rows] == [("1/2/3", "CH1", "Bern", None), ("5/6/7", "CH2", "Chur", None), ("8/9/1", "CH3", None, "CH")]
    assert rows[0].pos == 3


def test_blocks_are_summed(spark):
    df = spark.range(40).select(F.lit("f").alias("file"), (F.col("id") / 7).cast("long").alias("block"), F.col("id").alias("place"))
    assert [r.n for r in ranges.before(df, F.lit(2), "n").orderBy("place").collect()] == [2 * k for k in range(40)]


def test_collections_are_searched_once(spark, tmp_path):
    """Features are read from the members found, whatever looks at them, and each part of one is parsed once."""
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {"layer": "bauzonen", "id": "x{\\"}", "art": null, "bauzone_code": "C1", "area_m2": 0.5}}]}')
    found = files.read_collection(spark, str(tmp_path))
    assert [tuple(r)[:4] for r in found.drop("geom", "properties").collect()] == [("bauzonen", 'x{"}', "C1", 0.5)]
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shown and shown.count("$.geometry") == 1
