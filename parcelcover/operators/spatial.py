"""Spatial joins on a quadtree of grid cells, clipping, union and repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcover.functions.geometry import GEOMETRY, bbox, is_rectangle
from parcelcover.operators.overlay import Flat, areas_flat, box_column, overlay_column
from parcelcover.plans.materialize import materialize

#: Cells of level 0; a level's cells are STEP times as wide as those below it. Levels above are for wide boxes, those
#: below for crowded cells. Above, a box spans SPAN cells of its level at most; below, it fits into one.
CELL, STEP, UP, DOWN, SPAN = 128.0, 4, 6, 3, 8
#: A cell splits at more boxes than LIMIT, and than this share of all; so there are at most DOWN / SHARE split cells.
LIMIT, SHARE = 2048, 1 / 65536
#: Copies of a wide box, among which the many small boxes that meet it are dealt out.
SALT = 16
SLIVER = 0.001
#: Keys sent to all at most.
FEW = 100_000
_BOX = ("minx", "miny", "maxx", "maxy")


def _size(cell: float, level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(cell * float(STEP) ** k) for k in range(-DOWN, UP + 1)]), (level + DOWN + 1).cast("int"))


def _own(cell: float, p: str) -> Column:
    """The lowest level that a box may sink to."""
    width = F.greatest(F.col(f"{p}maxx") - F.col(f"{p}minx"), F.col(f"{p}maxy") - F.col(f"{p}miny"))
    step = lambda base: F.ceil(F.log(float(STEP), width / base))
    return F.when(width <= cell / STEP, F.greatest(F.lit(-DOWN), step(cell))).otherwise(F.greatest(F.lit(0), F.least(F.lit(UP), step(cell * (SPAN - 1))))).cast("int")


def tree(a: DataFrame, b: DataFrame, cell: float) -> tuple[Column, DataFrame]:
    """(used, split) for boxes a_minx ... and b_minx ...: the levels that boxes may sink to, 0 among them, and the
    crowded cells of level 0 (s_cx, s_cy), by a count of both sides' boxes that could sink further. Both are parts of
    the plan, computed when the join is, from one pass over the boxes that sends a row a cell through the shuffle."""
    boxes = a.select(*[F.col(f"a_{c}").alias(c) for c in _BOX]).unionByName(b.select(*[F.col(f"b_{c}").alias(c) for c in _BOX])).withColumn("own", _own(cell, ""))
    counted = boxes.groupBy(F.floor(F.col("minx") / cell).alias("s_cx"), F.floor(F.col("miny") / cell).alias("s_cy")).agg(F.count_if(F.col("own") < 0).alias("small"), F.count("*").alias("n"), F.bit_or(F.expr(f"shiftleft(1, own + {DOWN})")).alias("owns"))
    some = F.filter(F.sequence(F.lit(-DOWN), F.lit(UP)), lambda k: (k == 0) | (F.call_function("shiftright", F.col("owns"), k + DOWN).bitwiseAND(1) == 1))
    facts = counted.agg(F.bit_or("owns").alias("owns"), F.sum("n").alias("rows")).select(F.struct(some.alias("used"), "rows")).scalar()
    return facts["used"], counted.where(F.col("small") > F.greatest(F.lit(float(LIMIT)), facts["rows"] * SHARE)).select("s_cx", "s_cy", F.lit(True).alias("split"))


def _dealt(df: DataFrame, used: Column, split: DataFrame, cell: float, p: str) -> DataFrame:
    """df, once for each cell where it is met, with level, cx, cy and turn.

    A box is resident in the cells of its own level if that is above 0, else in those of level 0 or, where these split,
    of its own level below. In higher levels that some box stays in, up to the widest, it is a
    visitor, who meets residents only. Turn 0 is for residents of both sides. Residents that may have visitors come once
    more for each of SALT turns, of which a visitor has one: above 0 if a's are the residents.
    """
    sign, columns = (1 if p == "a_" else -1), df.columns
    df = df.withColumns({"own": _own(cell, p), "used": used})
    start = F.greatest(F.col("own"), F.lit(0))
    df = df.withColumn("level", F.explode(F.slice("used", F.array_position("used", start).cast("int"), F.lit(UP + 1))))
    for c in "xy":
        df = df.withColumn(f"c{c}", F.explode(F.sequence(*[F.floor(F.col(f"{p}{m}{c}") / _size(cell, F.col("level"))) for m in ("min", "max")])))
    here = (F.col("level") == 0) & (F.col("own") <= 0)
    df = df.join(F.broadcast(split), here & (F.col("cx") == F.col("s_cx")) & (F.col("cy") == F.col("s_cy")), "left")
    lowest = F.when(F.col("split"), F.col("own")).otherwise(F.col("level"))
    df = df.withColumn("lowest", lowest).withColumn("sub", F.explode(F.sequence("lowest", "level"))).where("sub = lowest or array_contains(used, sub)")
    for c in "xy":
        low, high = (F.floor(F.col(f"{p}{m}{c}") / _size(cell, F.col("sub"))) for m in ("min", "max"))
        within = F.element_at(F.array(*[F.lit(STEP**k).cast("long") for k in range(DOWN + 1)]), F.col("level") - F.col("sub") + 1)
        df = df.withColumn(f"c{c}", F.explode(F.sequence(F.greatest(low, F.col(f"c{c}") * within), F.least(high, (F.col(f"c{c}") + 1) * within - 1))))
    visits = (F.col("sub") > F.col("lowest")) | (F.col("level") > start)
    visited = ~visits & ((F.col("sub") > 0) | F.col("split"))
    one = -sign * (F.pmod(F.xxhash64(f"{p}minx", f"{p}miny", f"{p}maxx"), F.lit(SALT)).cast("int") + 1)
    turns = F.sequence(F.when(visits, one).otherwise(0), F.when(visits, one).when(visited, sign * SALT).otherwise(0))
    return df.withColumn("turn", F.explode(turns)).select(*columns, F.col("sub").alias("level"), "cx", "cy", "turn")


def candidate_pairs(a: DataFrame, b: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of rows whose boxes touch or overlap; a's columns as a_<name>, b's as b_<name>.

    Both sides are dealt out to the cells of a grid, whose crowded cells are split as in a quadtree and whose wide
    boxes stay in wider cells. A pair meets in the one cell that holds the corner (largest minimum x, largest minimum
    y), at the level of the one that stays higher, so no pair comes twice. Nothing is computed before the join itself
    is: the counts that split cells are a part of its plan, and only these few cells, bounded by SHARE, are sent to
    all. Both sides are shuffled: planned by the size of the files they come from, layers with geometry would be sent
    whole to all. Rows without a box pair with nothing.
    """
    boxed = " and ".join(f"{{p}}{c} is not null" for c in _BOX)
    a = a.select([F.col(f"`{c}`").alias(f"a_{c}") for c in a.columns]).where(boxed.format(p="a_"))
    b = b.select([F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns]).where(boxed.format(p="b_"))
    used, split = tree(a, b, cell)
    pairs = _dealt(a, used, split, cell, "a_").join(_dealt(b, used, split, cell, "b_").hint("merge"), ["level", "cx", "cy", "turn"])
    size = _size(cell, F.col("level"))
    low = lambda c: F.greatest(F.col(f"a_min{c}"), F.col(f"b_min{c}"))
    touch = (F.col("a_minx") <= F.col("b_maxx")) & (F.col("b_minx") <= F.col("a_maxx")) & (F.col("a_miny") <= F.col("b_maxy")) & (F.col("b_miny") <= F.col("a_maxy"))
    here = (F.floor(low("x") / size) == F.col("cx")) & (F.floor(low("y") / size) == F.col("cy"))
    return pairs.where(touch & here).drop("level", "cx", "cy", "turn")


def boxed(df: DataFrame, geom: str = "geom") -> DataFrame:
    """df with the box of its geometries and rect, whether they fill it, as the joins ask for; nulls where there is none."""
    b = bbox(F.col(geom))
    return df.withColumns({c: b[c] for c in _BOX} | {"rect": is_rectangle(F.col(geom))})


def overlap() -> dict[str, Column]:
    """Corners of a pair's common box."""
    return {f: (F.greatest if f.startswith("min") else F.least)(f"a_{f}", f"b_{f}") for f in ("minx", "miny", "maxx", "maxy")}


def _schema(df: DataFrame, columns: list[str], *more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in columns] + list(more))


def _with(batch: pa.RecordBatch, columns: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *more.values()], names=[*columns, *more])


def _side(x: pa.RecordBatch, p: str, rows: np.ndarray) -> Flat:
    """Rows of a side's geometry; those that are their box are made from it."""
    rect = x.column(f"{p}rect").to_numpy(zero_copy_only=False)[rows].astype(bool)
    box = np.flatnonzero(rect)
    shapes = x.column(f"{p}geom").take(pa.array(rows, pa.int64(), mask=rect))
    return Flat(shapes, (box, *[x.column(f"{p}{c}").to_numpy(zero_copy_only=False)[rows][box] for c in _BOX]))


def lighter(df: DataFrame) -> DataFrame:
    """df without the geometry of rectangles, which their boxes tell, so that it isn't carried through a join."""
    return df.withColumn("geom", F.when(~F.col("rect"), F.col("geom")))


def common(rows: DataFrame, sides: tuple[str, ...]) -> DataFrame:
    """rows with area (m²) of what all sides (prefixes of box, geom and rect) share, by one sweep over all of them, without
    a polygon made on the way; rows without it, or with bad coordinates, go."""
    low = lambda c: F.greatest(*[F.col(f"{p}min{c}") for p in sides]) < F.least(*[F.col(f"{p}max{c}") for p in sides])
    rows = rows.where(low("x") & low("y"))
    keep = [c for c in rows.columns if c not in [f"{p}geom" for p in sides]]

    def run(batches):
        for x in batches:
            ends = [f(np.stack([x.column(f"{p}{c}").to_numpy(zero_copy_only=False) for p in sides]), axis=0) for f, c in zip((np.max, np.max, np.min, np.min), _BOX, strict=True)]
            area = (ends[2] - ends[0]) * (ends[3] - ends[1])
            plain = np.logical_and.reduce([x.column(f"{p}rect").to_numpy(zero_copy_only=False).astype(bool) for p in sides])
            rest = np.flatnonzero(~plain)
            area[rest] = areas_flat([_side(x, p, rest) for p in sides], ("and",))[0]
            yield _with(x, keep, {"area": pa.array(area, mask=np.isnan(area))})

    return rows.mapInArrow(run, _schema(rows, keep, "area double")).where("area > 0")


def intersections(pairs: DataFrame, geometry: bool = False, failures: bool = False) -> DataFrame:
    """pairs with area (m²) and, if asked for, geometry of the common part; pairs without one go.

    Pairs of rectangles (a_rect, b_rect) take the closed form, the others the sweep, many at one go. A pair of which a
    geometry has null or infinite coordinates is no error: it is left out, or, with failures, stays with failed = true
    and null area.
    """
    if not failures:
        apart = (F.col("a_minx") >= F.col("b_maxx")) | (F.col("b_minx") >= F.col("a_maxx")) | (F.col("a_miny") >= F.col("b_maxy")) | (F.col("b_miny") >= F.col("a_maxy"))
        pairs = pairs.where(~F.coalesce(apart, F.lit(False)))
    keep = [c for c in pairs.columns if c not in ("a_geom", "b_geom")]

    def run(batches):
        for x in batches:
            box = {k: x.column(k).to_numpy(zero_copy_only=False) for k in (f"{s}_{c}" for s in "ab" for c in _BOX)}
            x0, y0, x1, y1 = np.maximum(box["a_minx"], box["b_minx"]), np.maximum(box["a_miny"], box["b_miny"]), np.minimum(box["a_maxx"], box["b_maxx"]), np.minimum(box["a_maxy"], box["b_maxy"])
            area = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
            plain = x.column("a_rect").to_numpy(zero_copy_only=False).astype(bool) & x.column("b_rect").to_numpy(zero_copy_only=False).astype(bool)
            rest = np.flatnonzero(~plain)
            a, b = (_side(x, f"{s}_", rest) for s in "ab")
            area[rest], found = overlay_column(a, b, "and") if geometry else (areas_flat([a, b], ("and",))[0], None)
            more = {"area": pa.array(area, mask=np.isnan(area)), "failed": pa.array(np.isnan(area))}
            if geometry:
                at = np.arange(len(area))
                at[rest] = len(area) + np.arange(len(rest))
                more["geometry"] = pa.concat_arrays([box_column(x0, y0, x1, y1), found]).take(pa.array(at))
            yield _with(x, keep, more)

    out = pairs.mapInArrow(run, _schema(pairs, keep, "area double", "failed boolean", *[f"geometry {GEOMETRY}"] * geometry))
    return out.where("area > 0 or failed") if failures else out.where("area > 0").drop("failed")


def clip(parcels: DataFrame, features: DataFrame, cell: float = CELL, sliver: float = SLIVER, geometry: bool = False, boxes: bool = False, failures: bool = False) -> DataFrame:
    """One row for each parcel and feature that overlap in sliver m² or more: a_ and b_ columns, area.

    boxes: both layers hold rectangles only, so no geometry is carried through the join. failures as in intersections.
    """
    if not boxes or geometry:
        out = intersections(candidate_pairs(lighter(parcels), lighter(features), cell), geometry, failures)
        return out.where((F.col("area") >= sliver) | F.col("failed")) if failures else out.where(F.col("area") >= sliver)
    o = overlap()
    area = F.greatest(o["maxx"] - o["minx"], F.lit(0.0)) * F.greatest(o["maxy"] - o["miny"], F.lit(0.0))
    return candidate_pairs(parcels.drop("geom", "rect"), features.drop("geom", "rect"), cell).withColumn("area", area).where(F.col("area") >= sliver)


def skipped(pieces: DataFrame, key: str = "a_egrid") -> DataFrame:
    """(key, skipped): how many features of each parcel couldn't be clipped, from a clip with failures."""
    return pieces.groupBy(key).agg(F.count_if("failed").alias("skipped"))


def shapes(df: DataFrame, geom: str, op: str = "or", other: str | None = None, out: str = "geom", area: str | None = "area") -> DataFrame:
    """df with out, the result of "or" (repair: rings that neither cross nor touch themselves, parts united), "and" or
    "minus" with the geometry in other, and its area; both null where a geometry is null or has bad coordinates."""
    keep = [c for c in df.columns if c not in (out, area)]

    def run(batches):
        for x in batches:
            sides = [x.column(c) for c in (geom, other) if c]
            none = np.any([s.is_null().to_numpy(zero_copy_only=False) for s in sides], axis=0)
            areas, found = overlay_column(*[Flat(s) for s in sides], *[None] * (2 - len(sides)), op)
            none |= np.isnan(areas)
            more = {out: found.take(pa.array(np.arange(len(none)), mask=none))}
            yield _with(x, keep, more | ({area: pa.array(areas, mask=none)} if area else {}))

    return df.mapInArrow(run, _schema(df, keep, f"`{out}` {GEOMETRY}", *[f"`{area}` double"] * bool(area)))


def measures(df: DataFrame, geom: str, other: str, ops: dict[str, str]) -> DataFrame:
    """df without geom and other, with areas (name: "and", "or" or "minus" of the two), all by one sweep and without their
    polygons; null where a geometry is null or has bad coordinates."""
    keep = [c for c in df.columns if c not in (geom, other, *ops)]

    def run(batches):
        for x in batches:
            sides = [x.column(c) for c in (geom, other)]
            none = np.any([s.is_null().to_numpy(zero_copy_only=False) for s in sides], axis=0)
            areas = areas_flat([Flat(s) for s in sides], tuple(ops.values()))
            yield _with(x, keep, {k: pa.array(a, mask=none | np.isnan(a)) for k, a in zip(ops, areas, strict=True)})

    return df.mapInArrow(run, _schema(df, keep, *[f"`{k}` double" for k in ops]))


def _united(parts: DataFrame) -> DataFrame:
    empty = F.size("geom") == 0
    return shapes(parts, "geom").withColumns({"geom": F.when(~empty, F.col("geom")), "area": F.when(~empty, F.col("area"))})


def union_parts(df: DataFrame, key: str) -> DataFrame:
    """(key, geom, area): the union of all geometries of a key as polygons with holes, overlaps counted once, common
    borders gone. A key's geometries are those of one parcel, few by nature; their parts are gathered, then united in
    one sweep. Null geometries add nothing; an empty union is null."""
    return _united(df.groupBy(key).agg(F.flatten(F.collect_list("geom")).alias("geom")))


def clean(df: DataFrame, key: str, sliver: float = SLIVER, few: int = FEW) -> DataFrame:
    """(key, geom, parcel_area_m2): geometries of a key united and repaired; keys whose union is empty, broken or under
    sliver m² go.

    Keys are counted first: geometries that are alone with their key are repaired where they are read, and only those
    of keys with several are gathered. Up to few such keys are sent to all; if there are more, all are gathered.
    """
    several = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("__key"))
    n = several.limit(few + 1).count()
    if n > few:
        out = union_parts(df, key)
    else:
        out = df.select(key, "geom")
        if n:
            several = F.broadcast(materialize(several, "several"))
            same = F.col(key).eqNullSafe(F.col("__key"))
            out = _united(out.join(several, same, "left_anti")).unionByName(union_parts(out.join(several, same, "left_semi"), key))
        else:
            out = _united(out)
    return out.withColumnRenamed("area", "parcel_area_m2").where(F.col("parcel_area_m2") >= sliver)


def difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with out: the part of geometry a outside geometry b."""
    return shapes(df, a, "minus", b, out, None)
