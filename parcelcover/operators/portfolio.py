"""A dashboard's questions to a wide table of parcels: filters, sums, tables, quality, ranking.

Columns are those of sources.bridge's portfolio: ids, check columns, input_ columns, *_m2 areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.functions import dims
from parcelcover.functions.scalars import code_label, delta_text, half_up, hab_code, hab_digit, lookup, pct, pct_label
from parcelcover.operators.ranking import pct_ranks_mid
from parcelcover.plans.materialize import materialize, release
from parcelcover.sources.bridge import ART_COLUMNS, HABITAT_COLUMNS, ZONE_COLUMNS

NO_ZONE = "bauzonen_ohne_bauzone_m2"
TOTALS = ["parcel_area_m2", "sia416_ggf_m2", "sia416_buf_m2", "sia416_uuf_m2", "sealed_m2", "greenspace_m2", "vbs_produktiv_m2", "vbs_unproduktiv_m2", "vbs_kat_a_m2", "vbs_kat_b_m2", "vbs_kat_c_m2", "vbs_kat_d_m2", "vbs_typ1_m2", "vbs_typ2_m2"]
HAS = {"GGF": "sia416_ggf_m2", "BUF": "sia416_buf_m2", "UUF": "sia416_uuf_m2", "Green": "greenspace_m2", "Sealed": "sealed_m2"}
VBS = {"vbsprod": ["vbs_produktiv_m2", "vbs_unproduktiv_m2"], "vbstyp": ["vbs_typ1_m2", "vbs_typ2_m2"]}
RULES = ["egrid", "geom", "area", "egridUnique", "bbCover", "bzCover", "hbCover"]
SEARCHED = ["id", "egrid", "nummer", "input_ort", "input_rg", "input_bez"]
# Weights and limits of the ranking.
WEIGHTS = {"green": 25, "scale": 15, "urban": 15, "habitat": 10, "diversity": 5, "quality": 10}


def area(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def classified() -> Column:
    return area("sia416_ggf_m2") + area("sia416_buf_m2") + area("sia416_uuf_m2")


def is_covered() -> Column:
    return classified() > 0


def status_key(check: Column) -> Column:
    text = F.coalesce(check, F.lit(""))
    return F.when(text.startswith("error:"), "error").when(text == "", "—").otherwise(text)


def is_found(check: Column) -> Column:
    return F.coalesce(check.isin("found", "merged"), F.lit(False))


def excluded(name: Column, rules=None) -> Column:
    """Whether a name starts with a rule's code or has it as a word."""
    up = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    tests = [up.startswith(k) if mode == "prefix" else up.rlike(f"(^|[^A-Z0-9ÄÖÜ]){k}([^A-Z0-9ÄÖÜ]|$)") for k, mode in (rules or dims.EXCLUDE)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def blank(c: Column, dash: str = "—") -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text == "", dash).otherwise(text)


def any_positive(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (area(c) > 0)
    return out


def facet_filter(df: DataFrame, exclude=None, status=(), countries=(), cantons=(), coverage=(), arts=(), zones=(), has=(), vbsprod=(), vbstyp=(), ownership=(), portfolio=()) -> DataFrame:
    """Rows that pass every facet; a facet passes if one of its values does, or if it has none."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tests = [~excluded(F.col("input_bez"), exclude if exclude is not None else dims.EXCLUDE)] if exclude != [] else []
    if status:
        tests.append(status_key(F.col("check_egrid")).isin(*status))
    for values, column in ((countries, text("input_country")), (cantons, text("input_rg")), (ownership, text("input_eigent")), (portfolio, blank(F.col("input_tpf")))):
        if values:
            tests.append(column.isin(*values))
    if len(coverage) == 1:
        tests.append(is_covered() if coverage[0] == "with" else ~is_covered())
    for columns in ([f"av_{a.lower()}_m2" for a in arts], [f"bauzonen_{z}_m2" for z in zones], [HAS[h] for h in has], [f"vbs_{v}_m2" for v in vbsprod], [f"vbs_{v}_m2" for v in vbstyp]):
        if columns:
            tests.append(any_positive(columns))
    for t in tests:
        df = df.where(t)
    return df


def search_filter(df: DataFrame, q: str, keys: list[str] = SEARCHED) -> DataFrame:
    q = q.strip().lower()
    if not q:
        return df
    found = F.lit(False)
    for k in keys:
        found = found | F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))).contains(q)
    return df.where(found)


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep, name, value) of the columns where the value is above 0."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), area(c).alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.name", "p.value").where("value > 0")


def portfolio_totals(df: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in TOTALS]
    issue = lambda c: F.sum(F.when(F.coalesce(F.col(c), F.lit("")).isin("", "ok"), 0).otherwise(1))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_covered().cast("int")), F.lit(0)).alias("n_covered"), *sums, F.coalesce(issue("check_wfs"), F.lit(0)).alias("wfs_issues"), F.coalesce(issue("check_geom"), F.lit(0)).alias("geom_issues"))


def kpi_cards(df: DataFrame) -> DataFrame:
    """(card, value, of_area, of_cover)."""
    t = portfolio_totals(df).withColumn("cover", F.col("sia416_ggf_m2") + F.col("sia416_buf_m2") + F.col("sia416_uuf_m2"))
    cards = [("parcels", F.col("n").cast("double")), ("area", F.col("parcel_area_m2")), ("green", F.col("greenspace_m2")), ("sealed", F.col("sealed_m2")), ("ggf", F.col("sia416_ggf_m2"))]
    rows = F.array(*[F.struct(F.lit(n).alias("card"), v.alias("value")) for n, v in cards])
    t = t.select("parcel_area_m2", "cover", F.explode(rows).alias("c"))
    return t.select("c.card", "c.value", pct(F.col("c.value"), F.col("parcel_area_m2")).alias("of_area"), pct(F.col("c.value"), F.col("cover")).alias("of_cover"))


def facet_counts(df: DataFrame) -> DataFrame:
    """(facet, value, n, area): parcels for each value of each facet, area for the "contains" facets."""
    one = lambda f, v, on=None: F.when(F.lit(True) if on is None else on, F.struct(F.lit(f).alias("facet"), v.alias("value"), F.lit(0.0).alias("area")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    items = [one("canton", text("input_rg"), text("input_rg") != ""), one("country", text("input_country"), text("input_country") != ""), one("ownership", text("input_eigent"), text("input_eigent") != "")]
    items += [one("portfolio", blank(F.col("input_tpf"))), one("status", status_key(F.col("check_egrid"))), one("coverage", F.when(is_covered(), "with").otherwise("without"))]
    items += [one("exclude", F.lit(k), excluded(F.col("input_bez"), [(k, m)])) for k, m in dims.EXCLUDE]
    items += [one("has", F.lit(k), area(c) > 0) for k, c in HAS.items()] + [one(f, F.lit(c), area(c) > 0) for f, cs in VBS.items() for c in cs]
    for f, cs in (("art", ART_COLUMNS), ("zone", ZONE_COLUMNS), ("habitat", HABITAT_COLUMNS)):
        items += [F.when(area(c) > 0, F.struct(F.lit(f).alias("facet"), F.lit(c).alias("value"), area(c).alias("area"))) for c in cs]
    d = df.select(F.explode(F.array_compact(F.array(*items))).alias("i"))
    return d.groupBy("i.facet", "i.value").agg(F.count("*").alias("n"), F.sum("i.area").alias("area"))


def top_n(groups: DataFrame, n: int, name: str = "name", value: str = "value", apart: str | None = None) -> DataFrame:
    """The n largest groups (name, value, rn) and one row "Übrige (k)" of the rest, from one look at groups: one row a
    group is ranked. apart: a flag of rows that stand by themselves, with rn n + 2."""
    flag = F.col(apart) if apart else F.lit(False)
    d = groups.withColumn("__apart", flag).withColumn("rn", F.row_number().over(Window.partitionBy("__apart").orderBy(F.col(value).desc(), F.col(name))))
    place = F.when(F.col("__apart"), n + 2).otherwise(F.least("rn", F.lit(n + 1)))
    g = d.groupBy(place.alias("rn")).agg(F.min(name).alias("first"), F.count("*").cast("string").alias("k"), F.sum(value).alias(value))
    return g.select(F.when(F.col("rn") == n + 1, F.concat(F.lit("Übrige ("), "k", F.lit(")"))).otherwise(F.col("first")).alias(name), value, "rn")


def area_by_field(df: DataFrame, field: str, n: int) -> DataFrame:
    return top_n(df.groupBy(blank(F.col(field)).alias("name")).agg(F.sum(area("parcel_area_m2")).alias("value")).where("value > 0"), n)


def _sums(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """(one row of df's sums of columns, values above 0, and of the parcel area, what the columns leave of the area)."""
    row = df.agg(*[F.coalesce(F.sum(F.when(area(c) > 0, area(c))), F.lit(0.0)).alias(c) for c in columns], F.coalesce(F.sum("parcel_area_m2"), F.lit(0.0)).alias("__total"))
    return row, F.col("__total") - sum((F.col(c) for c in columns), F.lit(0.0))


def hierarchy(df: DataFrame, columns: list[str], main_of: dict[str, str], label: str) -> DataFrame:
    """(main, name, value): sums of columns, of their groups (name null) and of all (both null); and the remainder of the
    parcel area. One aggregate gives all sums, of which the rest is made."""
    row, left = _sums(df, columns)
    item = lambda main, name, value: F.struct(main.cast("string").alias("main"), name.cast("string").alias("name"), value.alias("value"))
    null, groups = F.lit(None), {}
    for c in columns:
        groups.setdefault(main_of[c], []).append(c)
    total = lambda cs: sum((F.col(c) for c in cs), F.lit(0.0))
    rows = [F.when(F.col(c) > 0, item(F.lit(main_of[c]), F.lit(c), F.col(c))) for c in columns]
    rows += [F.when(total(cs) > 0, item(F.lit(m), null, total(cs))) for m, cs in groups.items()]
    rows += [F.when(total(columns) > 0, item(null, null, total(columns))), F.when(left > 0, item(F.lit(label), null, left))]
    return row.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def class_tables(df: DataFrame) -> DataFrame:
    """(tab, item, value) for the SIA, sealing, category and productivity tables, each with its remainder."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in TOTALS])
    c = F.col
    cover = c("sia416_ggf_m2") + c("sia416_buf_m2") + c("sia416_uuf_m2")
    tables = {
        "sia": {"GGF": c("sia416_ggf_m2"), "BUF": c("sia416_buf_m2"), "UUF": c("sia416_uuf_m2")},
        "sealing": {"Versiegelt": c("sealed_m2"), "Unversiegelt": F.greatest(F.lit(0.0), cover - c("sealed_m2"))},
        "vbs_kat": {k.upper(): c(f"vbs_kat_{k}_m2") for k in "abcd"},
        "vbs_prod": {"produktiv": c("vbs_produktiv_m2"), "unproduktiv": c("vbs_unproduktiv_m2")},
    }
    rows = []
    for t, items in tables.items():
        rows += [F.struct(F.lit(t).alias("tab"), F.lit(k).alias("item"), v.alias("value")) for k, v in items.items()]
        rest = c("parcel_area_m2") - sum(items.values(), F.lit(0.0))
        rows.append(F.when(rest > 0, F.struct(F.lit(t).alias("tab"), F.lit("Ohne Bodenbedeckung").alias("item"), rest.alias("value"))))
    rows += [F.struct(F.lit("vbs_prod/produktiv").alias("tab"), F.lit(k).alias("item"), c(f"vbs_{k}_m2").alias("value")) for k in ("typ1", "typ2")]
    return sums.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def zone_table(df: DataFrame, n: int = 10) -> DataFrame:
    """(name, value, rn): the n largest zones, the others as one row, and what lies outside of zones."""
    own = [c for c in ZONE_COLUMNS if c != NO_ZONE]
    row, left = _sums(df, own)
    item = lambda name, value, rest: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(rest).alias("rest"))
    rows = [F.when(F.col(c) > 0, item(c, F.col(c), False)) for c in own] + [F.when(left > 0, item("Ohne Bauzone", left, True))]
    return top_n(row.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*"), n, apart="rest")


def parcel_stats(df: DataFrame) -> DataFrame:
    """Per-row sums over zone, habitat and type columns, without a shuffle; zone_dom: the first largest zone's slug."""
    def total(cs):
        return sum((area(c) for c in cs), F.lit(0.0))

    count = lambda cs: sum(((area(c) > 0).cast("int") for c in cs), F.lit(0))
    own = [c for c in ZONE_COLUMNS if c != NO_ZONE]
    natural = [c for c in HABITAT_COLUMNS if c[len("habitat_l2_")] in dims.NATURAL_DIGITS]
    best = F.array_max(F.array(*[F.struct(area(c).alias("v"), F.lit(-i).alias("order"), F.lit(c[9:-3]).alias("slug")) for i, c in enumerate(own)]))
    return df.withColumns({"bz_sum": total(own), "bz_sum_all": total(ZONE_COLUMNS), "hb_sum": total(HABITAT_COLUMNS), "hb_nat": total(natural), "n_lc": count(ART_COLUMNS), "n_hb": count(HABITAT_COLUMNS), "zone_dom": F.when(best["v"] > 0, best["slug"]).otherwise("")})


def rule_results(df: DataFrame) -> DataFrame:
    """df with parcel stats, n_same (rows of the same E-GRID) and rules: array of (rule, ok) that apply to the row.

    E-GRIDs are counted by an aggregate and joined back, so that one that thousands of rows have isn't gathered;
    rows without E-GRID take no part.
    """
    eg = F.trim(F.coalesce(F.col("egrid"), F.lit("")))
    s = parcel_stats(df).withColumn("__eg", F.nullif(eg, F.lit("")))
    counts = s.where("__eg is not null").groupBy(F.col("__eg").alias("__key")).agg(F.count("*").alias("n_same"))
    s = s.join(counts, F.col("__eg") == F.col("__key"), "left").drop("__key")
    a = area("parcel_area_m2")
    near = lambda v: F.abs(v - a) <= F.greatest(F.lit(1.0), a * 0.01)
    given = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", "error")
    rule = lambda k, ok, on=None: F.when(F.lit(True) if on is None else on, F.struct(F.lit(k).alias("rule"), ok.alias("ok")))
    rules = [
        rule("egrid", is_found(F.col("check_egrid"))), rule("geom", F.coalesce(F.col("has_geom"), F.lit(False))), rule("area", a > 0), rule("egridUnique", F.col("n_same") == 1, F.col("__eg").isNotNull()),
        rule("bbCover", near(classified()), is_covered()), rule("bzCover", near(F.col("bz_sum_all")), (F.col("bz_sum_all") > 0) | given("check_bauzonen")), rule("hbCover", near(F.col("hb_sum")), (F.col("hb_sum") > 0) | given("check_habitat")),
    ]
    return s.withColumn("rules", F.array_compact(F.array(*rules)))


def quality_rules(df: DataFrame) -> DataFrame:
    r = rule_results(df).select(F.explode("rules").alias("r"))
    return r.groupBy("r.rule").agg(F.sum(F.col("r.ok").cast("int")).alias("n_pass"), F.sum((~F.col("r.ok")).cast("int")).alias("n_fail"))


def problem_parcels(df: DataFrame) -> DataFrame:
    failed = F.transform(F.filter("rules", lambda r: ~r["ok"]), lambda r: r["rule"])
    return rule_results(df).select("id", "egrid", F.array_join(failed, ", ").alias("hint")).where("hint <> ''")


def status_distribution(df: DataFrame) -> DataFrame:
    s = status_key(F.col("check_egrid"))
    group = F.when(s.isin("found", "merged"), "found").when(s.isin("not_found", "error"), "not_found").when(s == "invalid", "invalid").otherwise("other")
    return df.groupBy(group.alias("grp")).agg(F.count("*").alias("n"))


def deviation_rows(df: DataFrame) -> DataFrame:
    """(rule, id, ist, soll, abweichung, einheit) for each failed rule of each row."""
    d = rule_results(df).withColumn("r", F.explode("rules")).where("not r.ok")
    a, rule = area("parcel_area_m2"), F.col("r.rule")
    whole = lambda v: half_up(v).cast("string")
    sums = {"bbCover": classified(), "bzCover": F.col("bz_sum_all"), "hbCover": F.col("hb_sum")}
    status = status_key(F.col("check_egrid"))
    ist = F.when(rule == "egrid", F.coalesce(lookup(dims.STATUS, status), status)).when(rule == "geom", "nein").when(rule == "area", whole(a)).when(rule == "egridUnique", F.col("n_same").cast("string"))
    abw = F.lit("")
    for k, v in sums.items():
        ist = ist.when(rule == k, whole(v))
        abw = F.when(rule == k, delta_text(v - a, a)).otherwise(abw)
    soll = F.when(rule == "egrid", "gefunden").when(rule == "geom", "ja").when(rule == "area", "> 0").when(rule == "egridUnique", "1").otherwise(whole(a))
    unit = F.when(rule.isin("egrid", "geom"), "").when(rule == "egridUnique", "Vorkommen").otherwise("m²")
    return d.select(rule.alias("rule"), "id", ist.alias("ist"), soll.alias("soll"), abw.alias("abweichung"), unit.alias("einheit"))


def column_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.sum(area(c)).alias(c) for c in columns])


def parcel_profile(df: DataFrame) -> DataFrame:
    """(id, tab, name, value, share, rn): each row's positive areas by table, largest first."""
    groups = {"art": ART_COLUMNS, "zone": ZONE_COLUMNS, "habitat": HABITAT_COLUMNS, "sia": ["sia416_ggf_m2", "sia416_buf_m2", "sia416_uuf_m2"], "din": ["din277_bf_m2", "din277_uf_m2"], "vbs": VBS["vbsprod"] + VBS["vbstyp"]}
    items = F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(c).alias("name"), area(c).alias("value")) for t, cs in groups.items() for c in cs])
    d = df.select("id", area("parcel_area_m2").alias("total"), F.explode(items).alias("i")).select("id", "total", "i.*").where("value > 0")
    w = Window.partitionBy("id", "tab").orderBy(F.col("value").desc(), "name")
    return d.select("id", "tab", "name", "value", F.when(F.col("total") > 0, pct_label(F.col("value"), F.col("total"))).otherwise("").alias("share"), F.row_number().over(w).alias("rn"))


def habitat_names(name: Column) -> dict[str, Column]:
    slug = F.regexp_extract(name, "^habitat_l2_(.+)_m2$", 1)
    return {"code": hab_code(slug), "digit": hab_digit(slug)}


def priority_gate(df: DataFrame, federal: bool = True, sap: bool = True, uf_min: float = 1000, bauzone: bool = True, bz_min: float = 50) -> DataFrame:
    d = parcel_stats(df)
    if federal:
        d = d.where(F.col("input_eigent") == "1")
    if sap:
        d = d.where(~excluded(F.col("input_bez")))
    d = d.where(area("sia416_buf_m2") + area("sia416_uuf_m2") >= uf_min)
    return d.where((area("parcel_area_m2") > 0) & (F.col("bz_sum") / F.col("parcel_area_m2") >= bz_min / 100)) if bauzone else d


def priority_metrics(df: DataFrame) -> DataFrame:
    """df (with parcel stats) and the six signals."""
    uf = area("sia416_buf_m2") + area("sia416_uuf_m2")
    bad = lambda c: F.when(F.coalesce(F.col(c), F.lit("")).isin("", "ok"), 0.0).otherwise(0.2)
    q = F.when(F.coalesce(F.col("lc_source"), F.lit("")) == "AV", 1.0).otherwise(0.6) - F.when(is_covered(), 0.0).otherwise(0.3) - bad("check_geom") - bad("check_wfs")
    return df.withColumns({
        "uf": uf, "green": area("greenspace_m2"), "green_share": F.when(uf != 0, F.least(F.lit(1.0), F.try_divide(area("greenspace_m2"), uf))).otherwise(0.0), "urban": F.coalesce(lookup({k: v[1] for k, v in dims.ZONES.items()}, F.col("zone_dom")), F.lit(0.0)),
        "nat_share": F.when(F.col("hb_sum") > 0, F.try_divide(F.col("hb_nat"), F.col("hb_sum"))), "diversity": F.greatest("n_lc", "n_hb").cast("double"), "quality": F.round(F.greatest(F.lit(0.0), q), 6),
    })


def priority_score(df: DataFrame, key: str = "k", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """df (with metrics and a unique key) and score; larger areas rank the same with or without the logarithm."""
    df = materialize(df, "pool")
    signals = {"r_share": "green_share", "r_green": "green", "r_scale": "uf", "r_urban": "urban", "r_habitat": "nat_share", "r_diversity": "diversity", "r_quality": "quality"}
    df = df.join(pct_ranks_mid(df, key, signals), key)
    parts = {"green": 0.6 * F.col("r_share") + 0.4 * F.col("r_green"), "scale": F.col("r_scale"), "urban": F.col("r_urban"), "habitat": F.col("r_habitat"), "diversity": F.col("r_diversity"), "quality": F.col("r_quality")}
    total = sum(weights.values()) or 1
    return df.withColumn("score", sum((F.lit(float(weights[k])) * v for k, v in parts.items()), F.lit(0.0)) / total)


def segment_label(share: Column) -> Column:
    return F.when(share >= 0.30, "Grün-reich").when(share >= 0.15, "Gemischt").otherwise("Versiegelt")


def _decided(few: DataFrame, caps: dict[str, int], order: str) -> DataFrame:
    """few (order, score, __c, __t, __state) after a round: 1 for rows that the greedy pass takes whatever it does with the
    undecided ones before them, 2 for rows of a quota that taken rows before them fill, 0 for the rest. The best
    undecided row is always decided."""
    sure, full = F.lit(True), F.lit(False)
    for c, cap in caps.items():
        before = Window.partitionBy(c).orderBy(F.col("score").desc(), order).rowsBetween(Window.unboundedPreceding, -1)
        taken = F.coalesce(F.sum(F.when(F.col("__state") == 1, 1).otherwise(0)).over(before), F.lit(0))
        maybe = F.coalesce(F.sum(F.when(F.col("__state") == 0, 1).otherwise(0)).over(before), F.lit(0))
        sure, full = sure & (taken + maybe < cap), full | (taken >= cap)
    return few.withColumn("__state", F.when(F.col("__state") > 0, F.col("__state")).when(full, 2).when(sure, 1).otherwise(0))


def select_capped(scored: DataFrame, n: int = 100, canton_cap: int = 20, portfolio_cap: int = 30, order: str = "k") -> DataFrame:
    """The greedy choice by score (then order) under quotas; 0 switches a quota off. survey_rank counts the chosen.

    What the greedy pass takes from one (canton, portfolio) is a leading part of it, as a full quota stays full; so the
    least of the limits is kept of each by a window. Over those few, at most the limit times the number of cantons and
    portfolios, rounds decide rows of all quotas at once, until none is undecided before the n-th row taken: the score
    bound that all share.
    """
    d = scored.withColumn("__c", blank(F.col("input_rg"), "?")).withColumn("__t", blank(F.col("input_tpf"), "?"))
    caps = {c: cap for c, cap in (("__c", canton_cap), ("__t", portfolio_cap)) if cap}
    best = [F.col("score").desc(), F.col(order)]
    limit = min([n, *caps.values()])
    few = d.withColumn("__rn", F.row_number().over(Window.partitionBy("__c", "__t").orderBy(*best))).where(F.col("__rn") <= limit)
    few = few.select(order, "score", "__c", "__t", F.lit(0 if caps else 1).alias("__state"))
    written = None
    while caps:
        few = materialize(_decided(_decided(few, caps, order), caps, order), "choice")
        if written:
            release(written)
        written = few
        # The n-th row taken, if there are so many, bounds what matters.
        bound = few.where("__state = 1").orderBy(*best).limit(n).agg(F.count("*").alias("n"), F.max_by(F.struct("score", order), F.struct(-F.col("score"), order)).alias("last")).first()
        open_ = few.where("__state = 0")
        if bound["n"] == n and n:
            s, k = bound["last"]["score"], bound["last"][order]
            open_ = open_.where((F.col("score") > F.lit(s)) | (F.col("score") == F.lit(s)) & (F.col(order) <= F.lit(k)))
        if not open_.limit(1).count():
            break
    chosen = few.where("__state = 1").orderBy(*best).limit(n).select(F.col(order).alias("__k"), "score")
    ranks = chosen.select("__k", F.row_number().over(Window.orderBy(F.col("score").desc(), "__k")).alias("survey_rank"))  # n rows at most
    ranks = F.broadcast(ranks) if n <= 100_000 else ranks
    return d.join(ranks, F.col(order) == F.col("__k")).drop("__k", "__c", "__t")


def selection_summary(sel: DataFrame) -> DataFrame:
    """(part, name, value): segments, sums, and parcels by canton and portfolio (12 largest and the rest)."""
    seg = sel.groupBy(segment_label(F.col("green_share")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("segment").alias("part"), "name", "value")
    sums = sel.agg(F.sum(area("parcel_area_m2")).alias("area"), F.sum("green").alias("green")).select(F.explode(F.array(F.struct(F.lit("area").alias("name"), F.col("area").alias("value")), F.struct(F.lit("green").alias("name"), F.col("green").alias("value")))).alias("s")).select(F.lit("sum").alias("part"), "s.*")
    out = seg.unionByName(sums)
    for part, c in (("canton", "input_rg"), ("portfolio", "input_tpf")):
        out = out.unionByName(top_n(sel.groupBy(blank(F.col(c)).alias("name")).agg(F.count("*").cast("double").alias("value")), 12).select(F.lit(part).alias("part"), "name", "value"))
    return out


def labelled(df: DataFrame) -> DataFrame:
    return df.select("id", code_label(F.col("input_tpf"), dims.PORTFOLIO).alias("portfolio_label"), code_label(F.col("input_eigent"), dims.OWNERSHIP).alias("ownership_label"))
