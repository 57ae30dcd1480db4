"""From parcels and land-cover pieces to one row a parcel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.functions import dims
from parcelcover.functions.scalars import code_at_level, label_at_level, lookup, round2, to_fixed_1, typoch_to_art



def kpi_tests() -> dict[str, Column]:
    """The 15 class sums: column name to the test that a piece counts."""
    c = F.col
    return {
        "sia416_ggf_m2": c("sia416") == "GGF", "sia416_buf_m2": c("sia416") == "BUF", "sia416_uuf_m2": c("sia416") == "UUF", "din277_bf_m2": c("din277") == "BF", "din277_uf_m2": c("din277") == "UF",
        "sealed_m2": c("sealed"), "greenspace_m2": c("greenspace") != dims.NOT_GREEN, "vbs_produktiv_m2": c("vbs_produktiv") == "produktiv", "vbs_unproduktiv_m2": c("vbs_produktiv") == "unproduktiv",
        **{f"vbs_{k}_m2": c("vbs_kat") == k for k in ("kat_a", "kat_b", "kat_c", "kat_d")}, **{f"vbs_{k}_m2": c("vbs_typ") == k for k in ("typ1", "typ2")},
    }


def prefix_input_columns(df: DataFrame, keys: tuple[str, ...] = ("id", "egrid")) -> DataFrame:
    return df.withColumnsRenamed({c: f"input_{c}" for c in df.columns if c not in keys})


def lowercase_schema(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.lower() for c in df.columns if not c.lower().startswith("input_")})


def valid_egrid(egrid: Column, rule: str = "planar") -> Column:
    return egrid.rlike("^CH[0-9A-Za-z]+$") if rule == "planar" else F.coalesce(egrid.startswith("CH"), F.lit(False))


def classify(pieces: DataFrame) -> DataFrame:
    """pieces (art) with the six classes; types outside the list get the defaults. The type table has 26 rows."""
    table = F.broadcast(dims.dim_art(pieces.sparkSession).withColumnRenamed("art", "__art"))
    found = pieces.join(table, F.col("art") == F.col("__art"), "left").drop("__art", "maingroup")
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in dims.UNKNOWN.items()})


def dissolve(parcels: DataFrame) -> DataFrame:
    """One row an EGRID: first non-null attributes by fid, number of parts, found or merged, box."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("fid"))).alias(c)
    g = parcels.groupBy("egrid").agg(*[first(c) for c in ("nummer", "bfsnr", "flaeche")], F.count("*").alias("parts"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return g.withColumn("check_egrid", F.when(F.col("parts") > 1, "merged").otherwise("found"))


def landcover_kpis(pieces: DataFrame, keys: tuple[str, ...] = ("egrid",), rounded: bool = False) -> DataFrame:
    """All class sums of classified pieces (area) in one pass."""
    sums = {k: F.coalesce(F.sum(F.when(t, F.col("area"))), F.lit(0.0)) for k, t in kpi_tests().items()}
    return pieces.groupBy(*keys).agg(*[(round2(v) if rounded else v).alias(k) for k, v in sums.items()])


def area_by_art(pieces: DataFrame, arts: list[str], keys: tuple[str, ...] = ("egrid",), rounded: bool = False) -> DataFrame:
    """av_<type>_m2 for the listed types, 0 where absent."""
    sums = {f"av_{a.lower()}_m2": F.coalesce(F.sum(F.when(F.col("art") == a, F.col("area"))), F.lit(0.0)) for a in arts}
    return pieces.groupBy(*keys).agg(*[(round2(v) if rounded else v).alias(k) for k, v in sums.items()])


def overlay_summary(pieces: DataFrame, key: str, name: Column, label: str) -> DataFrame:
    """Names and areas of a parcel's overlay, joined by "; ", the largest first, then by name."""
    g = pieces.groupBy(key, name.alias("name")).agg(F.sum("area").alias("total"))
    g = g.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("less"), "name"))).alias("all"))
    areas = F.transform("all", lambda x: to_fixed_1(-x["less"]))
    return g.select(key, F.array_join("all.name", "; ").alias(label), F.array_join(areas, "; ").alias(f"{label}_m2"))


def overlay_pertype(pieces: DataFrame, key: str, type_key: Column, names: list[str]) -> DataFrame:
    """A column for each of names (as type_key gives them), 0 where absent."""
    p = pieces.withColumn("__key", type_key)
    return p.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("__key") == n, F.col("area"))), F.lit(0.0)).alias(n) for n in names])


def habitat_rollup(pieces: DataFrame, key: str = "egrid") -> DataFrame:
    """(key, level, code, area): sums by first- and second-level code; without a second level the first counts there too."""
    one = code_at_level(F.col("typoch"), 1)
    two = F.when(code_at_level(F.col("typoch"), 2) == "", one).otherwise(code_at_level(F.col("typoch"), 2))
    both = pieces.select(key, "area", F.explode(F.array(F.struct(F.lit("l1").alias("level"), one.alias("code")), F.struct(F.lit("l2").alias("level"), two.alias("code")))).alias("c"))
    return both.where("c.code <> ''").groupBy(key, F.col("c.level").alias("level"), F.col("c.code").alias("code")).agg(F.sum("area").alias("area"))


def habitat_columns(pieces: DataFrame, codes: list[str] | None = None, names: dict[str, str] = dims.HABITAT_NAMES, key: str = "egrid") -> DataFrame:
    """One row a key: habitat and habitat_m2, the second-level labels and their areas joined by "; ", the largest first
    (then by code), and habitat_l1_<code>_m2 and habitat_l2_<code>_m2 of two decimals, 0 where absent.

    A label without a second level counts there by its first. codes are the second-level codes that get columns, by
    default those that occur, which a job looks up: some fifty by nature. Labels without a code give nothing; a code
    without a name shows as the raw label that is its own, else as itself. names: code to name, finer ones are welcome.
    """
    one = code_at_level(F.col("typoch"), 1)
    two = F.when(code_at_level(F.col("typoch"), 2) == "", one).otherwise(code_at_level(F.col("typoch"), 2))
    label = F.coalesce(F.nullif(label_at_level(F.col("typoch"), 2, names), F.lit("")), label_at_level(F.col("typoch"), 1, names))
    coded = pieces.select(key, "area", two.alias("code"), label.alias("label")).where("code <> ''")
    if codes is None:
        codes = [r.code for r in coded.select("code").distinct().collect()]
    codes = sorted(codes)
    g = coded.groupBy(key, "code").agg(F.sum("area").alias("total"), F.min("label").alias("label"))
    of = lambda test: round2(F.coalesce(F.sum(F.when(test, F.col("total"))), F.lit(0.0)))
    first = lambda c: c.split(".")[0]
    columns = {f"habitat_l1_{c}_m2": of(F.split_part("code", F.lit("."), F.lit(1)) == c) for c in sorted({first(c) for c in codes})}
    columns |= {f"habitat_l2_{c.replace('.', '_')}_m2": of(F.col("code") == c) for c in codes}
    g = g.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("less"), "code", "label"))).alias("all"), *[v.alias(k) for k, v in columns.items()])
    return g.select(key, F.array_join("all.label", "; ").alias("habitat"), F.array_join(F.transform("all", lambda x: to_fixed_1(-x["less"])), "; ").alias("habitat_m2"), *columns)


def label_levels(df: DataFrame, names: DataFrame, label: str = "typoch", levels: int = 4) -> DataFrame:
    """df with typoch_l1 to typoch_l<levels>: "code name" by a table of names (code, name) of some hundred rows; the raw
    label where its own level has no name, the bare code where a level above has none, blank beyond its own level."""
    raw = F.trim(F.coalesce(F.col(label), F.lit("")))
    for n in range(1, levels + 1):
        known = F.broadcast(names.select(F.col("code").alias("__code"), F.col("name").alias("__name")))
        code = code_at_level(F.col(label), n)
        own = code_at_level(F.col(label), n + 1) == ""
        df = df.join(known, code == F.col("__code"), "left")
        df = df.withColumn(f"typoch_l{n}", F.when(code == "", "").when(F.col("__name").isNotNull(), F.concat_ws(" ", code, "__name")).otherwise(F.when(own, raw).otherwise(code))).drop("__code", "__name")
    return df


def survey_rows(users: DataFrame, parcels: DataFrame, summaries: list[DataFrame], key: str = "egrid") -> DataFrame:
    """Every user row with its parcel and the columns of all summaries (one row a key each): parcels without a part in a
    summary, unknown and invalid ones too, get 0 in its areas and "" in its texts, so that all rows have all columns."""
    out = attach_parcels(users, parcels).withColumn("check_egrid", F.when(~valid_egrid(F.col(key), "spherical"), "invalid").otherwise(F.col("check_egrid")))
    areas, texts = [], []
    for s in summaries:
        out = out.join(s.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
        areas += [c for c, t in s.dtypes if t == "double"]
        texts += [c for c, t in s.dtypes if t == "string" and c != key]
    return rectangularise(out, areas, texts)


def rectangularise(parcels: DataFrame, area_columns: list[str], text_columns: list[str]) -> DataFrame:
    return parcels.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in area_columns} | {c: F.coalesce(F.col(c), F.lit("")) for c in text_columns})


def attach_parcels(users: DataFrame, parcels: DataFrame) -> DataFrame:
    """Every user row, repeats too, with its parcel; not_found and null area without one."""
    p = parcels.withColumnRenamed("egrid", "__egrid")
    out = users.join(p, F.col("egrid") == F.col("__egrid"), "left").drop("__egrid")
    return out.withColumn("check_egrid", F.coalesce("check_egrid", F.lit("not_found")))


def first_extras(users: DataFrame, order: str = "pos") -> DataFrame:
    """The first row of each EGRID, and how many of its other rows say something else."""
    extras = [c for c in users.columns if c not in ("id", "egrid", order)]
    w = Window.partitionBy("egrid").orderBy(order)
    return users.where("egrid <> ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("egrid", *extras)


def conflicts(users: DataFrame) -> DataFrame:
    extras = [c for c in users.columns if c not in ("id", "egrid", "pos")]
    return users.where("egrid <> ''").groupBy("egrid").agg((F.count("*") - F.count_distinct(F.struct(*extras))).alias("same"), F.count("*").alias("rows"), (F.count_distinct(F.struct(*extras)) - 1).alias("conflicting")).where("rows > 1")


def attach_aggregates(parcels: DataFrame, aggs: DataFrame, key: str = "egrid") -> DataFrame:
    """LEFT join; 0 for absent areas, but not for the parcel's own area or the user's columns."""
    zero = [c for c in aggs.columns if c.endswith("_m2") and c != "parcel_area_m2" and not c.startswith("input_")]
    return parcels.join(aggs, key, "left").fillna(0.0, subset=zero)


def dedupe_features(features: DataFrame, order: str) -> DataFrame:
    """First row of each fid, with dropped = its geometry is null."""
    w = Window.partitionBy("fid").orderBy(order)
    return features.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("dropped", F.col("minx").isNull())


def dedupe_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """First row of each key in order; rows with a blank part go."""
    blank = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in key]
    w = Window.partitionBy(*key).orderBy(order)
    for b in blank:
        df = df.where(b)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_batches(batches: list[DataFrame], key: list[str]) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.dropDuplicates(key)


def synthetic_landcover(areas: DataFrame, landcover: DataFrame, habitat: DataFrame, least: float = 0.05) -> DataFrame:
    """Land cover (egrid, art, area, lc_source, lc_synthetic): a parcel's own, or its habitats relabelled.

    Habitats replace land cover where this covers less than least of the parcel's area and they cover more.
    areas: (egrid, parcel_area_m2).
    """
    synth = habitat.withColumn("art", typoch_to_art(F.col("typoch"))).where("art is not null")
    have = landcover.groupBy("egrid").agg(F.sum("area").alias("av"))
    could = synth.groupBy("egrid").agg(F.sum("area").alias("other"))
    d = areas.join(have, "egrid", "left").join(could, "egrid", "left").fillna(0.0, ["av", "other"])
    use = d.where((F.col("parcel_area_m2") > 0) & (F.col("av") < F.col("parcel_area_m2") * least) & (F.col("other") > F.col("av"))).select("egrid")
    own = landcover.join(use, "egrid", "left_anti").select("egrid", "art", "area", F.lit("AV").alias("lc_source"), F.lit("").alias("lc_synthetic"))
    new = synth.join(use, "egrid", "left_semi").select("egrid", "art", "area", F.lit("BAFU").alias("lc_source"), F.lit("yes").alias("lc_synthetic"))
    return own.unionByName(new)


def zone_remainder(areas: DataFrame, zones: DataFrame, least: float = 1.0) -> DataFrame:
    """zones (egrid, bauzone, area) and a row "Ohne Bauzone" of what their sum leaves of the parcel, if over least m²."""
    covered = zones.groupBy("egrid").agg(F.sum("area").alias("covered"))
    gap = areas.join(covered, "egrid", "left").withColumn("area", F.col("parcel_area_m2") - F.coalesce("covered", F.lit(0.0))).where(F.col("area") > least)
    return zones.select("egrid", "bauzone", "area").unionByName(gap.select("egrid", F.lit("Ohne Bauzone").alias("bauzone"), "area"))


def habitat_gap_fill(areas: DataFrame, pieces: DataFrame, dropped: DataFrame, untrusted: DataFrame, least: float = 0.01) -> DataFrame:
    """pieces (egrid, typoch, area, estimated): where exactly one feature had no geometry and over least of the
    parcel is uncovered, a row of that feature's type, if it has one, with the uncovered area. dropped: (egrid, typoch).
    untrusted: (egrid) of parcels whose features were cut off at the cap or partly failed; their gap says nothing."""
    covered = pieces.groupBy("egrid").agg(F.sum("area").alias("covered"))
    one = dropped.groupBy("egrid").agg(F.count("*").alias("n"), F.max("typoch").alias("typoch")).where("n = 1 and typoch <> ''")
    gap = areas.join(one, "egrid").join(untrusted.select("egrid").distinct(), "egrid", "left_anti").join(covered, "egrid", "left").withColumn("area", F.col("parcel_area_m2") - F.coalesce("covered", F.lit(0.0)))
    gap = gap.where(F.col("area") > F.col("parcel_area_m2") * least)
    return pieces.select("egrid", "typoch", "area", F.lit(False).alias("estimated")).unionByName(gap.select("egrid", "typoch", "area", F.lit(True).alias("estimated")))


def check_flags(n_features: Column, cap: int, skipped: Column, dropped: Column, gap: Column, estimated: Column, failed: Column) -> dict[str, Column]:
    truncated = n_features >= cap
    return {
        "check_wfs": F.when(failed, "wfs_error").when(truncated, "truncated").otherwise("ok"),
        "check_geom": F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit("_skipped"))).otherwise("ok"),
        "check_bauzonen": F.when(failed, "error").when(truncated, "truncated").when((dropped > 0) | (skipped > 0), "partial").otherwise("ok"),
        "check_habitat": F.when(failed, "error").when(truncated, "truncated").when(estimated, "estimated").when((dropped > 0) & gap, "partial").otherwise("ok"),
    }


def balance(parcels: DataFrame, pieces: DataFrame, rounded: set[str], kinds: tuple[str, ...] = ("landcover", "zones", "habitat")) -> DataFrame:
    """egrid, parcel_area_m2 and <kind>_m2 of every parcel: its own area and that of each layer's pieces, 0 without any,
    in one aggregate. pieces: a clip (a_egrid, b_kind, area) with all layers as one; rounded: layers of two decimals."""
    own = parcels.select("egrid", F.lit("parcel").alias("kind"), ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area"))
    part = F.when(F.col("b_kind").isin(*rounded), round2(F.col("area"))).otherwise(F.col("area"))
    every = own.unionByName(pieces.select(F.col("a_egrid").alias("egrid"), F.col("b_kind").alias("kind"), part.alias("area")))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("area"))), F.lit(0.0))
    return every.groupBy("egrid").agg(of("parcel").alias("parcel_area_m2"), *[of(k).alias(f"{k}_m2") for k in kinds])


def error_parcels(users: DataFrame, known: DataFrame) -> DataFrame:
    """id, egrid, check_egrid, errors of user rows whose EGRID is invalid or unknown."""
    messages = {"invalid": "invalid EGRID", "not_found": "parcel not found"}
    bad = users.withColumn("check_egrid", F.when(~valid_egrid(F.col("egrid"), "spherical"), "invalid"))
    known = known.select(F.col("egrid").alias("__known")).distinct()
    bad = bad.join(known, F.col("egrid") == F.col("__known"), "left").withColumn("check_egrid", F.coalesce("check_egrid", F.when(F.col("__known").isNull(), "not_found")))
    return bad.where("check_egrid is not null").select("id", "egrid", "check_egrid", F.array(lookup(messages, F.col("check_egrid"))).alias("errors"))


def overlap_check(features: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame], least: float = 1.0) -> DataFrame:
    """fid, overlap_count, overlap_with_fids, overlap_total_area_m2, has_overlap of features that overlap others in least m² or more."""
    p = pairs(features, features).where((F.col("a_fid") < F.col("b_fid")) & (F.col("area") >= least)).select("a_fid", "b_fid", "area")
    both = p.select(F.col("a_fid").alias("f"), F.col("b_fid").alias("other"), "area").unionByName(p.select(F.col("b_fid").alias("f"), F.col("a_fid").alias("other"), "area"))
    g = both.groupBy("f").agg(F.count("*").alias("overlap_count"), F.array_join(F.array_sort(F.collect_list(F.col("other").cast("string"))), ",").alias("overlap_with_fids"), F.round(F.sum("area"), 4).alias("overlap_total_area_m2"))
    out = features.select("fid").join(g, F.col("fid") == F.col("f"), "left").drop("f").fillna(0, ["overlap_count"]).fillna(0.0, ["overlap_total_area_m2"]).fillna("", ["overlap_with_fids"])
    return out.withColumn("has_overlap", F.when(F.col("overlap_count") > 0, "yes").otherwise("no"))


