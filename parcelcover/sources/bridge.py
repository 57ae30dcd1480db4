"""Layer tables derived from the star-schema tables, by SQL that both engines read.

Parcels, land cover, zones and habitats are axis-aligned rectangles on a half-metre grid, so that areas are
exact in doubles. The portfolio is a wide table of one row a parcel, as a dashboard reads it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcover.functions import dims

X, Y = "2600000e0 + 64 * ({k} % 50)", "1200000e0 + 64 * cast(floor({k} / 50) as bigint)"
UNKNOWN_ART = "Unbekannt"
HABITATS = ["9.2 Gebäude", "9.3.2 Strassen", "9.3.3 Plätze", "9.0.2 Anlagen", "1.3 Quellen", "4.0 Kunstrasen", "6.0 Forst", "6 Wälder", "", "4.5.1 Wiesen", "6.3.1 Buchenwald", "8.1 Baumschulen"]
ZONE_NAMES = ["Wohnzonen", "Arbeitszonen", "Mischzonen", "Zentrumszonen", "Zonen für öffentliche Nutzungen"]


def _pick(index: str, values: list[str]) -> str:
    return f"case {index} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def _at(text: str, k: str) -> str:
    return text.format(k=k)


ART = _pick("l_suppkey % 27", [*dims.ARTS, UNKNOWN_ART])

BRIDGES: dict[str, str] = {
    "b_parcels": f"""
        select 2 * p_partkey fid, 'CH' || lpad(cast(p_partkey as string), 12, '0') egrid, cast(p_partkey as string) nummer, p_partkey % 25 bfsnr, cast(floor(p_retailprice) as int) flaeche,
               {_at(X, 'p_partkey')} minx, {_at(Y, 'p_partkey')} miny, {_at(X, 'p_partkey')} + 24 + p_size * 0.5e0 maxx, {_at(Y, 'p_partkey')} + 48 maxy from part
        union all
        select 2 * p_partkey + 1, 'CH' || lpad(cast(p_partkey as string), 12, '0'), null, p_partkey % 25, cast(floor(p_retailprice) as int),
               {_at(X, 'p_partkey')} + 24 + p_size * 0.5e0, {_at(Y, 'p_partkey')}, {_at(X, 'p_partkey')} + 28 + p_size * 0.5e0, {_at(Y, 'p_partkey')} + 48 from part where p_partkey % 40 = 0""",
    "b_landcover": f"""
        select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) fid, {ART} art, l_partkey % 25 bfsnr, case when l_suppkey % 27 = 0 then cast(l_orderkey as string) end gwr_egid,
               {_at(X, 'l_partkey')} + (l_orderkey % 24) * 2 - 4 minx, {_at(Y, 'l_partkey')} + l_linenumber * 6 - 8 miny,
               {_at(X, 'l_partkey')} + (l_orderkey % 24) * 2 - 4 + l_quantity * 0.5e0 maxx, {_at(Y, 'l_partkey')} + l_linenumber * 6 - 4 + l_suppkey % 5 maxy from lineitem""",
    "b_zones": f"""
        select o_orderkey fid, {_pick("cast(substr(o_orderpriority, 1, 1) as int) - 1", ZONE_NAMES)} bauzone, 'C' || substr(o_orderpriority, 1, 1) bauzone_code,
               {_at(X, 'k')} + (o_orderkey % 7) * 3 minx, {_at(Y, 'k')} + (o_orderkey % 5) * 4 miny, {_at(X, 'k')} + (o_orderkey % 7) * 3 + 10 + o_custkey % 16 maxx, {_at(Y, 'k')} + (o_orderkey % 5) * 4 + 6 + (o_custkey % 9) * 2 maxy
        from (select *, o_orderkey % (select count(*) from part) k from orders)""",
    "b_habitat": f"""
        select o_orderkey fid, {_pick("o_orderkey % 12", HABITATS)} typoch, '0.' || cast(o_custkey % 10 as string) prob, case when o_orderkey % 97 = 0 then null else {_at(X, 'k')} + (o_orderkey % 9) * 2 end minx,
               {_at(Y, 'k')} + (o_orderkey % 6) * 5 miny, {_at(X, 'k')} + (o_orderkey % 9) * 2 + 8 + o_custkey % 20 maxx, {_at(Y, 'k')} + (o_orderkey % 6) * 5 + 8 + o_custkey % 12 maxy, k
        from (select *, (o_orderkey * 7) % (select count(*) from part) k from orders)""",
    "b_users": """
        select 'TEST-' || cast(c_custkey as string) id, case when c_custkey % 41 = 0 then '' when c_custkey % 37 = 0 then 'BAD_' || cast(c_custkey as string) else 'CH' || lpad(cast((c_custkey - case when c_custkey % 20 = 3 then 1 else 0 end) % (p + 50) as string), 12, '0') end egrid, c_custkey pos,
               n_name rg, c_mktsegment tpf, cast(1 + 2 * (c_custkey % 3) as string) eigent, c_name ort,
               case when c_custkey % 17 = 0 then 'ABGA alt ' when c_custkey % 19 = 0 then 'LÖVM ' when c_custkey % 23 = 0 then 'Bern, PP Miete ' when c_custkey % 29 = 0 then 'Rapperswil ' else '' end || c_name bez
        from (select *, (select count(*) from part) p from customer) join nation on n_nationkey = c_nationkey""",
    "b_pixels": """
        select event_id, cast(event_id % 100 as int) px, cast(floor(event_id / 100) as int) py, cast(floor(value) as int) % 256 r, cast(user_id % 256 as int) g, cast((event_id * 7) % 256 as int) b,
               case when event_id % 53 = 0 then null else cast((event_id * 31 + user_id) % 256 as int) end nir from events""",
}

#: Layers of other shapes than boxes. kind: 0 the box, 1 an L (the box without its upper right quarter), 2 a frame (with a
#: hole of half its width and height), 3 two parts (its outer quarters), 4 a right triangle, 5 broken (a null coordinate).
BRIDGES["b_shapes"] = f"""
        select fid, art, kind, minx, miny, case when kind = 4 then minx + least(w, h) else minx + w end maxx, case when kind = 4 then miny + least(w, h) else miny + h end maxy
        from (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) fid, {ART} art, case when l_orderkey % 89 = 0 then 5 else l_orderkey % 5 end kind, {_at(X, 'l_partkey')} + (l_orderkey % 24) * 2 - 4 minx,
              {_at(Y, 'l_partkey')} + l_linenumber * 6 - 8 miny, 4 + floor(l_quantity / 2) * 4e0 w, 4 + (l_suppkey % 3) * 4e0 h from lineitem) s"""
BRIDGES["b_zone_shapes"] = f"""
        select fid, bauzone, kind, minx, miny, minx + w maxx, miny + h maxy
        from (select o_orderkey fid, {_pick("cast(substr(o_orderpriority, 1, 1) as int) - 1", ZONE_NAMES)} bauzone, o_orderkey % 4 kind, {_at(X, 'k')} + (o_orderkey % 7) * 3 minx, {_at(Y, 'k')} + (o_orderkey % 5) * 4 miny,
              8 + (o_custkey % 4) * 4e0 w, 4 + (o_custkey % 6) * 4e0 h from (select *, o_orderkey % (select count(*) from part) k from orders) o) s"""


def _parts() -> str:
    """Boxes of a parcel in several parts, from its corner: they touch, enclose a hole, lie apart or overlap."""
    boxes = {0: [(0, 0, 16, 8), (0, 8, 8, 16)], 1: [(0, 0, 24, 8), (0, 16, 24, 24), (0, 8, 8, 16), (16, 8, 24, 16)], 2: [(0, 0, 8, 8), (12, 0, 20, 8)], 3: [(0, 0, 16, 12), (8, 4, 24, 20)]}
    return " union all ".join(f"select {k} kind, {i} i, {a} x0, {b} y0, {c} x1, {d} y1" for k, all_ in boxes.items() for i, (a, b, c, d) in enumerate(all_))


BRIDGES["b_parts"] = f"""
        select 'CH' || lpad(cast(p_partkey as string), 12, '0') egrid, 8 * p_partkey + i fid, case when i > 0 then cast(p_partkey as string) end nummer, kind, p_partkey % 25 bfsnr, cast(p_size as int) flaeche,
               {_at(X, 'p_partkey')} + x0 minx, {_at(Y, 'p_partkey')} + y0 miny, {_at(X, 'p_partkey')} + x1 + case when kind = 3 then p_size % 2 else 0 end maxx, {_at(Y, 'p_partkey')} + y1 maxy
        from part join ({_parts()}) b on b.kind = p_partkey % 4"""


def _facts() -> str:
    """A portfolio's long facts: parcel, type, area."""
    return f"select l_partkey k, {ART} art, sum(l_quantity) area from lineitem group by 1, 2"


def _class_sum(test) -> str:
    arts = [a for a in dims.ARTS if test(dims.art_row(a))]
    listed = ", ".join(f"'{a}'" for a in arts)
    return f"coalesce(sum(case when art in ({listed}) then area end), 0e0)"


def _portfolio() -> str:
    u = f"coalesce(sum(case when art = '{UNKNOWN_ART}' then area end), 0e0)"
    sums = {
        "sia416_ggf_m2": _class_sum(lambda r: r[2] == "GGF"), "sia416_buf_m2": _class_sum(lambda r: r[2] == "BUF"), "sia416_uuf_m2": _class_sum(lambda r: r[2] == "UUF") + f" + {u}",
        "din277_bf_m2": _class_sum(lambda r: r[3] == "BF"), "din277_uf_m2": _class_sum(lambda r: r[3] == "UF") + f" + {u}", "sealed_m2": _class_sum(lambda r: r[5]), "greenspace_m2": _class_sum(lambda r: r[4] != dims.NOT_GREEN),
        "vbs_produktiv_m2": _class_sum(lambda r: r[7] == "produktiv"), "vbs_unproduktiv_m2": _class_sum(lambda r: r[7] != "produktiv") + f" + {u}",
        **{f"vbs_{x}_m2": _class_sum(lambda r, x=x: r[6] == x) + (f" + {u}" if x == "kat_d" else "") for x in ("kat_a", "kat_b", "kat_c", "kat_d")},
        **{f"vbs_{x}_m2": _class_sum(lambda r, x=x: r[8] == x) for x in ("typ1", "typ2")},
    }
    arts = {f"av_{a.lower()}_m2": f"coalesce(sum(case when art = '{a}' then area end), 0e0)" for a in dims.ARTS}
    wide = ", ".join(f"{v} {k}" for k, v in {**sums, **arts}.items())
    zones = ", ".join(f"case when k % 5 = {i} or k % 7 = {i} then cover * {0.25 * (i + 1)}e0 else 0e0 end bauzonen_{z}_m2" for i, z in enumerate(["wohnzonen", "arbeitszonen", "mischzonen", "zentrumszonen"]))
    habitats = ", ".join(f"case when k % 4 = {i % 4} then cover * {0.25 * (1 + i % 3)}e0 else 0e0 end habitat_l2_{h}_m2" for i, h in enumerate(dims.HABITAT_SLUGS))
    return f"""
        select p.*, case when status_key in ('found', 'merged') then cover + case when k % 5 = 0 then 40 else 0 end end parcel_area_m2, {zones}, case when k % 8 = 0 then cover * 0.5e0 else 0e0 end bauzonen_ohne_bauzone_m2, {habitats}
        from (
            select p_partkey k, 'TEST-' || cast(p_partkey as string) id, cast(p_partkey as string) nummer,
                   case when p_partkey % 43 = 0 then '' when p_partkey % 41 = 0 then 'CH' || lpad(cast(p_partkey - 1 as string), 12, '0') else 'CH' || lpad(cast(p_partkey as string), 12, '0') end egrid,
                   case when p_partkey % 29 = 0 then 'not_found' when p_partkey % 31 = 0 then 'invalid' when p_partkey % 37 = 0 then 'error: x' when p_partkey % 59 = 0 then '' when p_partkey % 10 = 0 then 'merged' else 'found' end check_egrid,
                   case when p_partkey % 29 = 0 then 'not_found' when p_partkey % 31 = 0 then 'invalid' when p_partkey % 37 = 0 then 'error' when p_partkey % 59 = 0 then '—' when p_partkey % 10 = 0 then 'merged' else 'found' end status_key,
                   case when p_partkey % 47 = 0 then 'truncated' else 'ok' end check_wfs, case when p_partkey % 44 = 0 then '2_skipped' else 'ok' end check_geom,
                   case when p_partkey % 3 = 0 then 'ok' when p_partkey % 3 = 1 then 'error' else '' end check_bauzonen, case when p_partkey % 6 = 0 then 'error' else 'ok' end check_habitat,
                   case when p_partkey % 9 = 0 then 'BAFU' else 'AV' end lc_source, case when p_partkey % 9 = 0 then 'yes' else '' end lc_synthetic, p_partkey % 61 <> 0 has_geom,
                   coalesce(n_name, '') input_rg, case when p_partkey % 13 = 0 then 'DE' else 'CH' end input_country, cast(1 + 2 * (p_partkey % 3) as string) input_eigent,
                   case when p_partkey % 11 = 0 then '' else cast(1 + p_partkey % 10 as string) end input_tpf, p_brand input_ort,
                   case when p_partkey % 17 = 0 then ' abga ' when p_partkey % 19 = 0 then 'LÖVM ' when p_partkey % 23 = 0 then 'Bern, PP Miete ' when p_partkey % 21 = 0 then 'Appenzell ' else '' end || p_name input_bez,
                   coalesce(sia416_ggf_m2 + sia416_buf_m2 + sia416_uuf_m2, 0e0) cover, {", ".join(f"coalesce({c}, 0e0) {c}" for c in [*sums, *arts])}
            from part left join nation on n_nationkey = p_partkey % 27 left join (select k lk, {wide} from ({_facts()}) f where k % 50 <> 0 group by 1) l on lk = p_partkey
        ) p"""


BRIDGES["b_facts"] = _facts()
BRIDGES["b_portfolio"] = _portfolio()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ART_COLUMNS = [f"av_{a.lower()}_m2" for a in dims.ARTS]
ZONE_COLUMNS = [f"bauzonen_{z}_m2" for z in ("wohnzonen", "arbeitszonen", "mischzonen", "zentrumszonen", "ohne_bauzone")]
HABITAT_COLUMNS = [f"habitat_l2_{h}_m2" for h in dims.HABITAT_SLUGS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge table; layers also get their geometry, and rect to say that it is its bounding box."""
    sql = BRIDGES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    df = spark.sql(re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", sql), **used)
    if "kind" in df.columns and name != "b_parts":
        return df.withColumn("geom", _shape()).withColumn("rect", F.col("kind") == 0)
    if "minx" in df.columns:
        box = F.when(F.col("minx").isNotNull(), rectangle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))
        df = df.withColumn("geom", box).withColumn("rect", F.lit(True))
    return df


def rectangle(x0, y0, x1, y1):
    """A multipolygon of one box."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])))


def _ring(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in [*points, points[0]]])


def _shape():
    """The geometry of a row of b_shapes or b_zone_shapes."""
    x0, y0, x1, y1 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    w, h = x1 - x0, y1 - y0
    box = lambda a, b, c, d: _ring((a, b), (c, b), (c, d), (a, d))
    none = F.lit(None).cast("double")
    kinds = {
        1: F.array(F.array(_ring((x0, y0), (x1, y0), (x1, y0 + h / 2), (x0 + w / 2, y0 + h / 2), (x0 + w / 2, y1), (x0, y1)))),
        2: F.array(F.array(box(x0, y0, x1, y1), box(x0 + w / 4, y0 + h / 4, x1 - w / 4, y1 - h / 4))),
        3: F.array(F.array(box(x0, y0, x0 + w / 4, y1)), F.array(box(x1 - w / 4, y0, x1, y1))),
        4: F.array(F.array(_ring((x0, y0), (x1, y0), (x0, y1)))),
        5: F.array(F.array(_ring((x0, y0), (x1, none), (x1, y1)))),
    }
    out = F.array(F.array(box(x0, y0, x1, y1)))
    for k, g in kinds.items():
        out = F.when(F.col("kind") == k, g).otherwise(out)
    return out


def _values(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else f"'{v}'"
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


COMMON = "greatest(0e0, least(p.maxx, f.maxx) - greatest(p.minx, f.minx)) * greatest(0e0, least(p.maxy, f.maxy) - greatest(p.miny, f.miny))"
TOUCH = "p.minx <= f.maxx and f.minx <= p.maxx and p.miny <= f.maxy and f.miny <= p.maxy"
#: For the SQL side only: what several queries share.
SHARED: dict[str, str] = {
    "o_art": f"select * from (values {_values([dims.art_row(a) for a in dims.ARTS])}) t(art, maingroup, sia416, din277, greenspace, sealed, vbs_kat, vbs_produktiv, vbs_typ)",
    "o_parcels": """select egrid, arg_min(nummer, fid) filter (nummer is not null) nummer, arg_min(bfsnr, fid) bfsnr, arg_min(flaeche, fid) flaeche, count(*) parts, case when count(*) > 1 then 'merged' else 'found' end check_egrid,
        min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy, sum((maxx - minx) * (maxy - miny)) parcel_area_m2 from b_parcels group by 1""",
    "o_pieces": f"select * from (select p.egrid, f.fid, f.art, f.bfsnr, f.gwr_egid, sum({COMMON}) area from b_parcels p join b_landcover f on {TOUCH} where {COMMON} >= 0.001 group by 1, 2, 3, 4, 5)",
    "o_zones": f"select p.egrid, f.fid, f.bauzone, f.bauzone_code, sum(floor({COMMON} * 100 + 0.5) / 100) area from b_parcels p join b_zones f on {TOUCH} where {COMMON} >= 0.001 group by 1, 2, 3, 4",
    "o_habitat": f"select p.egrid, f.fid, f.typoch, sum(floor({COMMON} * 100 + 0.5) / 100) area from b_parcels p join b_habitat f on {TOUCH} where f.minx is not null and {COMMON} >= 0.001 group by 1, 2, 3",
}
_COMPONENTS = """select fid, {extra}1 sign, minx, miny, maxx, maxy from {t} where kind in (0, 1, 2) union all select fid, {extra}-1, minx + (maxx - minx) / 2, miny + (maxy - miny) / 2, maxx, maxy from {t} where kind = 1
        union all select fid, {extra}-1, minx + (maxx - minx) / 4, miny + (maxy - miny) / 4, maxx - (maxx - minx) / 4, maxy - (maxy - miny) / 4 from {t} where kind = 2
        union all select fid, {extra}1, minx, miny, minx + (maxx - minx) / 4, maxy from {t} where kind = 3 union all select fid, {extra}1, maxx - (maxx - minx) / 4, miny, maxx, maxy from {t} where kind = 3"""
#: Shapes of right angles as boxes to add and to take away; a triangle's share of a box is a sum over its corners.
SHARED["o_shape_boxes"] = _COMPONENTS.format(t="b_shapes", extra="art, ")
SHARED["o_zone_boxes"] = _COMPONENTS.format(t="b_zone_shapes", extra="bauzone, ")
_CORNER = lambda u, v: f"pow(greatest(0e0, f.maxx - f.minx - greatest(0e0, {u} - f.minx) - greatest(0e0, {v} - f.miny)), 2) / 2"
SHARED["o_shape_pieces"] = f"""select * from (select egrid, fid, art, sum(area) area from (
        select p.egrid, p.fid part, f.fid, f.art, sum(sign * {COMMON}) area from b_parcels p join o_shape_boxes f on {TOUCH} group by 1, 2, 3, 4
        union all select p.egrid, p.fid, f.fid, f.art, {_CORNER('p.minx', 'p.miny')} - {_CORNER('p.maxx', 'p.miny')} - {_CORNER('p.minx', 'p.maxy')} + {_CORNER('p.maxx', 'p.maxy')} from b_parcels p join b_shapes f on f.kind = 4 and {TOUCH})
        where area >= 0.001 group by 1, 2, 3)"""
SHARED["o_classed"] = """select egrid, fid, p.art, area, coalesce(sia416, 'UUF') sia416, coalesce(din277, 'UF') din277, coalesce(greenspace, 'Not green space') greenspace, coalesce(sealed, false) sealed,
    coalesce(vbs_kat, 'kat_d') vbs_kat, coalesce(vbs_produktiv, 'unproduktiv') vbs_produktiv, vbs_typ from o_pieces p left join o_art a on a.art = p.art"""


def oracle(sql: str) -> str:
    """sql for DuckDB with the tables that it names in front."""
    every = BRIDGES | SHARED
    used, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for b in every:
            if b not in used and re.search(rf"\b{b}\b", text):
                used.add(b)
                todo.append(every[b])
    head = ", ".join(f"{b} as materialized ({every[b]})" for b in every if b in used)
    body = sql.strip()
    if not used:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {head}, {body[14:]}"
    return f"with {head}, {body[4:]}" if body.lower().startswith("with") else f"with {head} {body}"
