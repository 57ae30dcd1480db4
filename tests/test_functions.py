from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from parcelcover.functions import geometry as G
from parcelcover.functions import scalars as S
from parcelcover.operators.portfolio import excluded
from parcelcover.operators.reports import list_report
from parcelcover.sources import files


def values(spark, rows, column, kind="string"):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in d.orderBy("i").select(column(F.col("v"))).collect()]


def test_to_fixed_rounds_the_exact_double(spark):
    x = [0.25, 0.75, 12.35, 0.05, 1234567.85, 2.5, 0.0, 99.95, 0.15, 1e6 + 0.25]
    assert values(spark, x, S.to_fixed_1, "double") == [str(Decimal(v).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)) for v in x]


def test_numbers_and_labels(spark):
    assert values(spark, ["12.5 m2", "-3", "x", None, "", ".5e1", "1e400"], S.num) == [12.5, -3.0, 0.0, 0.0, 0.0, 5.0, pytest.approx(float("inf"))]
    assert values(spark, ["1'234,5 6", "", "abc", None], S.parse_area) == [123456.0, None, None, None]
    assert values(spark, [1.5, 2.0, None], S.format_area, "double") == ["1.5", "2", ""]
    assert values(spark, ["Zonen für öffentliche Nutzungen", "  Ä--b "], S.slugify) == ["zonen_fuer_oeffentliche_nutzungen", "ae_b"]
    assert values(spark, ["01", "3", "x", "", None], lambda c: S.code_label(c, {"1": "eins", "3": "drei"})) == ["eins", "drei", "x", "—", "—"]
    assert values(spark, [50.0, -32.0, 0.4], lambda c: S.delta_text(c, F.lit(1000.0)), "double") == ["+50 (+5 %)", "-32 (-3.2 %)", "0 (0 %)"]


def test_habitat_codes(spark):
    labels = ["6.3.1 Buchenwald", "9.3.2 Strasse", "4.0 Rasen", "6", "", None, "7.9 x"]
    assert values(spark, labels, lambda c: S.code_at_level(c, 2)) == ["6.3", "9.3", "4.0", "", "", "", "7.9"]
    assert values(spark, labels, S.typoch_to_art) == ["geschlossener_Wald", "Strasse_Weg", "Acker_Wiese_Weide", "geschlossener_Wald", None, None, "uebrige_vegetationslose"]
    assert values(spark, labels, lambda c: S.classify_habitat(c)["vbs_kat"]) == ["kat_c", "kat_a", "kat_a", "kat_c", "kat_d", "kat_d", "kat_d"]
    assert values(spark, ["6.3.1 Buchenwald", "8 Äcker", "5.9.9 x"], lambda c: S.label_at_level(c, 1, {"6": "Wälder"})) == ["6 Wälder", "8 Äcker", "5"]


def test_excluded_names(spark):
    names = ["ABGA x", " abga", "x ABGA", "LÖVM", "Bern, PP Miete", "Rapperswil", "PP", "Appenzell", None, "ÄPP"]
    assert values(spark, names, excluded) == [True, True, False, True, True, False, True, False, False, False]


def test_geometry(spark):
    shape = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,2],[2,2],[2,1],[1,1]]]}'
    d = spark.createDataFrame([(shape,), ('{"type":"Point","coordinates":[1,2]}',), (None,)], "v string").withColumn("g", G.from_geojson(F.col("v")))
    rows = d.select(G.planar_area(F.col("g")).alias("a"), G.contains(F.col("g"), F.lit(1.5), F.lit(1.5)).alias("hole"), G.contains(F.col("g"), F.lit(3.0), F.lit(3.0)).alias("inside"), G.bbox(F.col("g")).alias("b"), G.to_geojson(F.col("g")).alias("j"), G.is_rectangle(F.col("g")).alias("r")).collect()
    assert (rows[0].a, rows[0].hole, rows[0].inside, rows[0].b.maxx, rows[0].r) == (15.0, False, True, 4.0, False) and rows[2].j is None
    unit = spark.range(1).select(G.spherical_area(F.array(F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])))).alias("a")).first().a
    assert unit == pytest.approx(12_363_718_145, rel=1e-3)


def test_parcel_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿sep=;\nID;EGRID;Note;NOTE\n1; CH1 ;\"a;b\";x\n2;;;\n", encoding="utf-8")
    rows = files.read_parcel_list(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [(r.id, r.egrid, r.note) for r in rows] == [("1", "CH1", "x"), ("2", "", "")]
    (tmp_path / "b.csv").write_text("id\tegrid\n1\tCH1\n")
    assert files.read_parcel_list(spark, str(tmp_path / "b.csv")).count() == 1
    (tmp_path / "c.csv").write_text("id,other\n1,2\n")
    with pytest.raises(ValueError, match="egrid"):
        files.read_parcel_list(spark, str(tmp_path / "c.csv"))
    assert files.delimiter("a;b,c") == (",", False) and files.delimiter("a;b;c,d") == (";", False) and files.delimiter("sep=|") == ("|", True)


def test_list_report(spark):
    lines = ["Seite 1", "|------|----|", "| A | B | C |", "|------|", "| 1 | x |", "|  |  |", "| A | B | C |", "| 2 | y | z | w |"]
    rows = list_report(spark.createDataFrame(list(enumerate(lines)), "pos long, line string")).orderBy("pos").collect()
    assert [(r.A, r.B, r.C) for r in rows] == [("1", "x", ""), ("2", "y", "z")]


def test_export_lines(spark):
    d = spark.createDataFrame([(1, 2.0, 2.5, ["a", "b"], 'x;"y"', None)], "i int, w double, f double, l array<string>, s string, n string").withColumn("_hidden", F.lit(1))
    assert files.csv_lines(d).first().value == '1;2;2.5;a; b;"x;""y""";'.replace("a; b", '"a; b"')
    assert files.feature(d, "parcel").first().json == '{"type":"Feature","geometry":null,"properties":{"layer":"parcel","i":1,"w":2,"f":2.5,"l":["a","b"],"s":"x;\\"y\\"","n":null}}'
    kept, dropped = files.allowlist_columns(spark.createDataFrame([(1, 2, 3)], "input_ort int, input_chef int, email int"), ["ort"])
    assert kept.columns == ["input_ort"] and dropped == ["input_chef", "email"]


def test_private_columns_and_texts(spark, tmp_path):
    """Personal names go and their like stay; numbers in texts stay as written; lists keep ids that begin like a directive."""
    names = ["mieter", "owner", "kontakt", "last_name", "e_mail", "Eigentuemer", "filename", "av_strasse_weg_m2", "personal", "besitzer"]
    kept, dropped = files.allowlist_columns(spark.createDataFrame([tuple(range(10))], names), [])
    assert dropped == names[:5] and kept.columns == names[5:]
    d = spark.createDataFrame([("x:5.0,y", 1e10, None, 2.5), ("a;\"b\"", -0.0, "n", 1e-7)], "s string, big double, empty string, f double")
    rows = [r.json for r in files.feature(d, "l").collect()]
    assert rows[0] == '{"type":"Feature","geometry":null,"properties":{"layer":"l","s":"x:5.0,y","big":10000000000,"empty":null,"f":2.5}}'
    files.write_csv(d, str(tmp_path / "c"))
    parts = [p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("part-*.csv")]
    assert all(p.startswith("\ufeffs;big;empty;f\n") for p in parts) and sorted(x for p in parts for x in p.splitlines()[1:]) == ['"a;""b""";0;n;1.0E-7', "x:5.0,y;10000000000;;2.5"]
    files.write_csv(d.limit(0), str(tmp_path / "e"), "plain")
    assert [p.read_text() for p in (tmp_path / "e").glob("part-*.csv")] == ["s,big,empty,f\n"]
    (tmp_path / "s.csv").write_text("sep=;\nid;egrid\nsep=1;CH1\n")
    assert [tuple(r) for r in files.read_parcel_list(spark, str(tmp_path / "s.csv")).collect()] == [("sep=1", "CH1")]
    assert values(spark, [1e10, 5.0, 0.5, None], S.norm_number, "double") == ["10000000000", "5", "0.5", None]


def test_a_row_like_the_header_stays(spark, tmp_path):
    """The header goes by its place in each file."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("id;egrid;x\nID;EGRID;1\n2;CH2;2\n")
    (tmp_path / "d" / "b.csv").write_text("id;egrid;x\n3;CH3;3\n")
    rows = files.read_parcel_list(spark, str(tmp_path / "d")).orderBy("x").collect()
    assert [(r.id, r.egrid) for r in rows] == [("ID", "EGRID"), ("2", "CH2"), ("3", "CH3")]
    (tmp_path / "s.csv").write_text("sep=|\nID|EGRID\nid|egrid|\n1|CH1\n")
    assert [r.id for r in files.read_parcel_list(spark, str(tmp_path / "s.csv")).collect()] == ["id", "1"]
