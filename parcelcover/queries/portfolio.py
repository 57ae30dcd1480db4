"""Queries of the dashboard: filters, sums, tables, quality, ranking, sorting, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelcover.functions import dims
from parcelcover.operators import portfolio as P
from parcelcover.operators.ranking import pct_rank_mid
from parcelcover.registry import query
from parcelcover.sources import files
from parcelcover.sources.bridge import ART_COLUMNS, HABITAT_COLUMNS, ZONE_COLUMNS, bridge

A = "coalesce(parcel_area_m2, 0e0)"
COVER = "(sia416_ggf_m2 + sia416_buf_m2 + sia416_uuf_m2)"
UP = "upper(trim(input_bez))"
EXCLUDED = f"(starts_with({UP}, 'ABGA') or starts_with({UP}, 'LÖVM') or regexp_matches({UP}, '(^|[^A-Z0-9ÄÖÜ])PP([^A-Z0-9ÄÖÜ]|$)'))"
OWN_ZONES = [c for c in ZONE_COLUMNS if c != P.NO_ZONE]


def wide(spark, sf):
    return bridge(spark, sf, "b_portfolio")


def _sum(cols: list[str]) -> str:
    return "(" + " + ".join(cols) + ")"


def _count(cols: list[str]) -> str:
    return "(" + " + ".join(f"cast({c} > 0 as int)" for c in cols) + ")"


def _pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then cast(floor({part} / {whole} * 100 + 0.5) as bigint) else 0 end"


def _unpivot(cols: list[str], keep: str = "") -> str:
    return " union all ".join(f"select {keep}{',' if keep else ''} '{c}' as name, {c} as value from b_portfolio where {c} > 0" for c in cols)


@query("p5_exclude_by_name", f"select id, input_bez, {EXCLUDED} excluded from b_portfolio")
def _(spark, sf):
    return wide(spark, sf).select("id", "input_bez", P.excluded(F.col("input_bez")).alias("excluded"))


@query("p6_facet_filter", f"select id from b_portfolio where not {EXCLUDED} and input_country = 'CH' and input_eigent = '1'")
def _(spark, sf):
    return P.facet_filter(wide(spark, sf), countries=["CH"], ownership=["1"]).select("id")


@query("p6_facet_filter_all", f"select id from b_portfolio where status_key in ('found', 'merged') and {COVER} > 0 and (av_gebaeude_m2 > 0 or av_reben_m2 > 0) and (bauzonen_wohnzonen_m2 > 0 or bauzonen_mischzonen_m2 > 0) and (sealed_m2 > 0 or greenspace_m2 > 0) and vbs_produktiv_m2 > 0 and vbs_typ1_m2 > 0 and case when input_tpf = '' then '—' else input_tpf end in ('—', '2', '3', '4') and input_rg in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5')")
def _(spark, sf):
    return P.facet_filter(wide(spark, sf), exclude=[], status=["found", "merged"], cantons=[f"NATION_{i}" for i in range(1, 6)], coverage=["with"], arts=["Gebaeude", "Reben"], zones=["wohnzonen", "mischzonen"], has=["Sealed", "Green"], vbsprod=["produktiv"], vbstyp=["typ1"], portfolio=["—", "2", "3", "4"]).select("id")


@query("p7_search_filter", "select id from b_portfolio where contains(lower(id), 'ion_1') or contains(lower(egrid), 'ion_1') or contains(lower(nummer), 'ion_1') or contains(lower(input_ort), 'ion_1') or contains(lower(input_rg), 'ion_1') or contains(lower(input_bez), 'ion_1')")
def _(spark, sf):
    return P.search_filter(wide(spark, sf), " ION_1 ").select("id")


@query("p8_status_and_cover", f"select id, {COVER} > 0 covered, status_key status, check_egrid in ('found', 'merged') found from b_portfolio")
def _(spark, sf):
    return wide(spark, sf).select("id", P.is_covered().alias("covered"), P.status_key(F.col("check_egrid")).alias("status"), P.is_found(F.col("check_egrid")).alias("found"))


GATE = f"input_eigent = '1' and not {EXCLUDED} and sia416_buf_m2 + sia416_uuf_m2 >= 400 and {A} > 0 and {_sum(OWN_ZONES)} / parcel_area_m2 >= 0.25"


@query("p9_priority_gate", f"select id from b_portfolio where {GATE}")
def _(spark, sf):
    return P.priority_gate(wide(spark, sf), uf_min=400, bz_min=25).select("id")


@query("a9_portfolio_totals", "select count(*) n, cast(coalesce(sum(cast({} > 0 as int)), 0) as bigint) n_covered, {}, cast(coalesce(sum(case when check_wfs in ('', 'ok') then 0 else 1 end), 0) as bigint) wfs_issues, cast(coalesce(sum(case when check_geom in ('', 'ok') then 0 else 1 end), 0) as bigint) geom_issues from b_portfolio".format(COVER, ", ".join(f"coalesce(sum({c}), 0e0) {c}" for c in P.TOTALS)))
def _(spark, sf):
    return P.portfolio_totals(wide(spark, sf))


@query("a9_sums_by_column", f"select name, sum(value) as value from ({_unpivot(ART_COLUMNS + ZONE_COLUMNS + HABITAT_COLUMNS)}) group by 1")
def _(spark, sf):
    return P.unpivot(wide(spark, sf), ART_COLUMNS + ZONE_COLUMNS + HABITAT_COLUMNS).groupBy("name").agg(F.sum("value").alias("value"))


@query("a10_kpi_cards", f"with t as (select count(*) n, sum({A}) a, sum(greenspace_m2) g, sum(sealed_m2) s, sum(sia416_ggf_m2) f, sum({COVER}) c from b_portfolio) " + " union all ".join(f"select '{k}' card, cast({v} as double) as value, {_pct(f'cast({v} as double)', 'a')} of_area, {_pct(f'cast({v} as double)', 'c')} of_cover from t" for k, v in (("parcels", "n"), ("area", "a"), ("green", "g"), ("sealed", "s"), ("ggf", "f"))))
def _(spark, sf):
    return P.kpi_cards(wide(spark, sf))


def _facets() -> str:
    one = lambda f, v, w="true", a="0e0": f"select '{f}' facet, {v} as value, {a} area from b_portfolio where {w}"
    items = [one("canton", "input_rg", "input_rg <> ''"), one("country", "input_country", "input_country <> ''"), one("ownership", "input_eigent", "input_eigent <> ''"), one("portfolio", "case when input_tpf = '' then '—' else input_tpf end"), one("status", "status_key"), one("coverage", f"case when {COVER} > 0 then 'with' else 'without' end")]
    items += [one("exclude", "'ABGA'", f"starts_with({UP}, 'ABGA')"), one("exclude", "'LÖVM'", f"starts_with({UP}, 'LÖVM')"), one("exclude", "'PP'", f"regexp_matches({UP}, '(^|[^A-Z0-9ÄÖÜ])PP([^A-Z0-9ÄÖÜ]|$)')")]
    items += [one("has", f"'{k}'", f"{c} > 0") for k, c in P.HAS.items()] + [one(f, f"'{c}'", f"{c} > 0") for f, cs in P.VBS.items() for c in cs]
    items += [one(f, f"'{c}'", f"{c} > 0", c) for f, cs in (("art", ART_COLUMNS), ("zone", ZONE_COLUMNS), ("habitat", HABITAT_COLUMNS)) for c in cs]
    return "select facet, value, count(*) n, sum(area) area from (" + " union all ".join(items) + ") group by 1, 2"


@query("a11_facet_counts", _facets())
def _(spark, sf):
    return P.facet_counts(wide(spark, sf))


def _top(groups: str, n: int) -> str:
    """name, value, rn of the n largest groups and the rest."""
    return f"""with g as (select name, value, row_number() over (order by value desc, name) rn from ({groups}))
        select name, value, rn from g where rn <= {n} union all select 'Übrige (' || count(*) || ')', sum(value), {n + 1} from g where rn > {n} having count(*) > 0"""


@query("a12_area_by_field", _top(f"select case when input_rg = '' then '—' else input_rg end as name, sum({A}) as value from b_portfolio group by 1 having sum({A}) > 0", 12))
def _(spark, sf):
    return P.area_by_field(wide(spark, sf), "input_rg", 12)


def _hierarchy(cols: list[str], main: str, label: str) -> str:
    return f"""with u as ({_unpivot(cols)}), m as (select *, {main} main from u) select main, name, sum(value) as value from m group by rollup (main, name)
        union all select '{label}', null, t - s from (select (select sum({A}) from b_portfolio) t, (select coalesce(sum(value), 0) from u) s) where t - s > 0"""


ART_OF = {f"av_{a.lower()}_m2": m for a, m in dims.MAIN_OF.items()}
DIGIT_OF = {c: c[len("habitat_l2_")] for c in HABITAT_COLUMNS}


def _case(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


@query("a13_art_hierarchy", _hierarchy(ART_COLUMNS, _case("name", ART_OF), "Ohne Bodenbedeckung"))
def _(spark, sf):
    return P.hierarchy(wide(spark, sf), ART_COLUMNS, ART_OF, "Ohne Bodenbedeckung")


@query("a14_habitat_hierarchy", _hierarchy(HABITAT_COLUMNS, _case("name", DIGIT_OF), "Ohne Lebensraum-Daten"))
def _(spark, sf):
    return P.hierarchy(wide(spark, sf), HABITAT_COLUMNS, DIGIT_OF, "Ohne Lebensraum-Daten")


_CLASS_TABLES = {
    "sia": {"GGF": "sia416_ggf_m2", "BUF": "sia416_buf_m2", "UUF": "sia416_uuf_m2"}, "sealing": {"Versiegelt": "sealed_m2", "Unversiegelt": f"greatest(0, {COVER} - sealed_m2)"},
    "vbs_kat": {k.upper(): f"vbs_kat_{k}_m2" for k in "abcd"}, "vbs_prod": {"produktiv": "vbs_produktiv_m2", "unproduktiv": "vbs_unproduktiv_m2"},
}


@query("a15_class_tables", "with t as (select {} from b_portfolio) ".format(", ".join(f"sum(coalesce({c}, 0e0)) {c}" for c in P.TOTALS)) + " union all ".join([f"select '{t}' tab, '{k}' item, {v} as value from t" for t, items in _CLASS_TABLES.items() for k, v in items.items()] + [f"select '{t}', 'Ohne Bodenbedeckung', parcel_area_m2 - ({' + '.join(items.values())}) from t where parcel_area_m2 - ({' + '.join(items.values())}) > 0" for t, items in _CLASS_TABLES.items()] + [f"select 'vbs_prod/produktiv', '{k}', vbs_{k}_m2 from t" for k in ("typ1", "typ2")]))
def _(spark, sf):
    return P.class_tables(wide(spark, sf))


@query("a16_zone_table", f"with z as ({_top(f'select name, sum(value) as value from ({_unpivot(OWN_ZONES)}) group by 1', 3)}) select name, value, rn from z union all select 'Ohne Bauzone', t - s, 5 from (select (select sum({A}) from b_portfolio) t, (select sum(value) from z) s) where t - s > 0")
def _(spark, sf):
    return P.zone_table(wide(spark, sf), 3)


@query("a18_run_summary", "select count(*) total, cast(sum(cast(check_egrid in ('found', 'merged') as int)) as bigint) found, cast(sum(cast(check_egrid not in ('found', 'merged') as int)) as bigint) not_found, sum(sealed_m2) sealed_m2, sum(greenspace_m2) greenspace_m2 from b_portfolio")
def _(spark, sf):
    ok = P.is_found(F.col("check_egrid"))
    return wide(spark, sf).agg(F.count("*").alias("total"), F.sum(ok.cast("int")).alias("found"), F.sum((~ok).cast("int")).alias("not_found"), F.sum("sealed_m2").alias("sealed_m2"), F.sum("greenspace_m2").alias("greenspace_m2"))


NATURAL = [c for c in HABITAT_COLUMNS if c[len("habitat_l2_")] in dims.NATURAL_DIGITS]
DOM = "case greatest({0}) ".format(", ".join(OWN_ZONES)) + "when 0 then '' " + " ".join(f"when {c} then '{c[9:-3]}'" for c in OWN_ZONES) + " end"


@query("a19_parcel_stats", f"select id, {_sum(OWN_ZONES)} bz_sum, {_sum(ZONE_COLUMNS)} bz_sum_all, {_sum(HABITAT_COLUMNS)} hb_sum, {_sum(NATURAL)} hb_nat, {_count(ART_COLUMNS)} n_lc, {_count(HABITAT_COLUMNS)} n_hb, {DOM} zone_dom from b_portfolio")
def _(spark, sf):
    return P.parcel_stats(wide(spark, sf)).select("id", "bz_sum", "bz_sum_all", "hb_sum", "hb_nat", "n_lc", "n_hb", "zone_dom")


def _rules() -> str:
    near = lambda v: f"abs({v} - {A}) <= greatest(1, {A} * 0.01)"
    z, h = _sum(ZONE_COLUMNS), _sum(HABITAT_COLUMNS)
    head = "q as (select *, count(*) over (partition by nullif(trim(egrid), '')) n_same from b_portfolio)"
    rows = [
        ("egrid", "check_egrid in ('found', 'merged')", "true"), ("geom", "has_geom", "true"), ("area", f"{A} > 0", "true"), ("egridUnique", "n_same = 1", "trim(egrid) <> ''"), ("bbCover", near(COVER), f"{COVER} > 0"),
        ("bzCover", near(z), f"({z} > 0 or check_bauzonen not in ('', 'error'))"), ("hbCover", near(h), f"({h} > 0 or check_habitat not in ('', 'error'))"),
    ]
    body = " union all ".join(f"select k, id, egrid, status_key, n_same, {A} a, {COVER} c, {z} z, {h} h, {i} i, '{r}' rule, {ok} ok from q where {on}" for i, (r, ok, on) in enumerate(rows))
    return f"with {head}, r as ({body})"


@query("a20_quality_rules", _rules() + " select rule, cast(sum(cast(ok as int)) as bigint) n_pass, cast(sum(cast(not ok as int)) as bigint) n_fail from r group by 1")
def _(spark, sf):
    return P.quality_rules(wide(spark, sf))


@query("a21_problem_parcels", _rules() + " select id, egrid, string_agg(rule, ', ' order by i) hint from r where not ok group by id, egrid")
def _(spark, sf):
    return P.problem_parcels(wide(spark, sf))


@query("a22_status_distribution", "select case when status_key in ('found', 'merged') then 'found' when status_key in ('not_found', 'error') then 'not_found' when status_key = 'invalid' then 'invalid' else 'other' end grp, count(*) n from b_portfolio group by 1")
def _(spark, sf):
    return P.status_distribution(wide(spark, sf))


_DELTA = "case when {d} > 0 then '+' else '' end || cast(cast(floor({d} + 0.5) as bigint) as varchar) || case when {b} > 0 then ' (' || case when floor({d} / {b} * 1000 + 0.5) / 10 > 0 then '+' else '' end || regexp_replace(cast(floor({d} / {b} * 1000 + 0.5) / 10 as varchar), '\\.0$', '') || ' %)' else '' end"
_WHOLE = "cast(cast(floor({} + 0.5) as bigint) as varchar)"


def _by_sum(f) -> str:
    return " ".join(f"when '{r}' then {f(v)}" for r, v in (("bbCover", "c"), ("bzCover", "z"), ("hbCover", "h")))


@query("a23_deviation_rows", _rules() + f""" select rule, id, case rule when 'egrid' then {_case('status_key', dims.STATUS)[:-4]} else status_key end when 'geom' then 'nein' when 'area' then {_WHOLE.format('a')} when 'egridUnique' then cast(n_same as varchar) {_by_sum(lambda v: _WHOLE.format(v))} end ist,
    case rule when 'egrid' then 'gefunden' when 'geom' then 'ja' when 'area' then '> 0' when 'egridUnique' then '1' else {_WHOLE.format('a')} end soll, case rule {_by_sum(lambda v: _DELTA.format(d=f'({v} - a)', b='a'))} else '' end abweichung,
    case when rule in ('egrid', 'geom') then '' when rule = 'egridUnique' then 'Vorkommen' else 'm²' end einheit from r where not ok""")
def _(spark, sf):
    return P.deviation_rows(wide(spark, sf))


@query("a24_column_totals", "select count(*) n, " + ", ".join(f"sum(coalesce({c}, 0e0)) {c}" for c in dims.KPIS) + " from b_portfolio")
def _(spark, sf):
    return P.column_totals(wide(spark, sf), dims.KPIS)


_PROFILE = {"art": ART_COLUMNS, "zone": ZONE_COLUMNS, "habitat": HABITAT_COLUMNS, "sia": ["sia416_ggf_m2", "sia416_buf_m2", "sia416_uuf_m2"], "din": ["din277_bf_m2", "din277_uf_m2"], "vbs": P.VBS["vbsprod"] + P.VBS["vbstyp"]}
_SHARE = "case when total > 0 then case when value / total * 100 < 0.5 then '< 1 %' else cast(cast(floor(value / total * 100 + 0.5) as bigint) as varchar) || ' %' end else '' end"


@query("a27_parcel_profile", "with u as (" + " union all ".join(f"select id, {A} total, '{t}' tab, '{c}' as name, {c} as value from b_portfolio where {c} > 0" for t, cs in _PROFILE.items() for c in cs) + f") select id, tab, name, value, {_SHARE} share, row_number() over (partition by id, tab order by value desc, name) rn from u")
def _(spark, sf):
    return P.parcel_profile(wide(spark, sf))


@query("f10_pct_and_ha", f"select id, {_pct('sealed_m2', COVER)} pct, case when not sealed_m2 > 0 then '0 %' when {COVER} = 0 then null when sealed_m2 / {COVER} * 100 < 0.5 then '< 1 %' else cast(cast(floor(sealed_m2 / {COVER} * 100 + 0.5) as bigint) as varchar) || ' %' end label, case when cover > 0 and cover / 1e4 < 0.01 then '< 0.01' else regexp_replace(cast(case when cover / 1e4 >= 1 then floor(cover / 1e4 * 10 + 0.5) / 10 else floor(cover / 1e4 * 100 + 0.5) / 100 end as varchar), '\\.0$', '') end ha from b_portfolio")
def _(spark, sf):
    from parcelcover.functions.scalars import fmt_ha, pct, pct_label

    return wide(spark, sf).select("id", pct(F.col("sealed_m2"), P.classified()).alias("pct"), pct_label(F.col("sealed_m2"), P.classified()).alias("label"), fmt_ha(F.col("cover")).alias("ha"))


@query("f12_code_label", f"select id, case when input_tpf = '' then '—' else coalesce({_case('input_tpf', dims.PORTFOLIO)}, input_tpf) end portfolio_label, coalesce({_case('input_eigent', dims.OWNERSHIP)}, input_eigent) ownership_label from b_portfolio")
def _(spark, sf):
    return P.labelled(wide(spark, sf))


METRICS = f"""select *, sia416_buf_m2 + sia416_uuf_m2 uf, greenspace_m2 green, case when sia416_buf_m2 + sia416_uuf_m2 <> 0 then least(1, greenspace_m2 / (sia416_buf_m2 + sia416_uuf_m2)) else 0e0 end green_share,
    coalesce({'case ' + DOM + ' ' + ' '.join(f"when '{k}' then {v[1]}e0" for k, v in dims.ZONES.items()) + ' end'}, 0e0) urban,
    case when {_sum(HABITAT_COLUMNS)} > 0 then {_sum(NATURAL)} / {_sum(HABITAT_COLUMNS)} end nat_share, cast(greatest({_count(ART_COLUMNS)}, {_count(HABITAT_COLUMNS)}) as double) diversity,
    round(greatest(0e0, case when lc_source = 'AV' then 1e0 else 0.6e0 end - case when {COVER} > 0 then 0 else 0.3e0 end - case when check_geom in ('', 'ok') then 0 else 0.2e0 end - case when check_wfs in ('', 'ok') then 0 else 0.2e0 end), 6) quality from b_portfolio"""
_M = ["uf", "green", "green_share", "urban", "nat_share", "diversity", "quality"]


@query("w3_priority_metrics", f"select id, {', '.join(_M)} from ({METRICS})")
def _(spark, sf):
    return P.priority_metrics(P.parcel_stats(wide(spark, sf))).select("id", *_M)


def _rank(v: str, source: str = "pool") -> str:
    return f"case when {v} is null or count({v}) over () <= 1 then 0.5e0 else (rank() over (order by {v}) - 1 + (count(*) over (partition by {v}) - 1) / 2e0) / (count({v}) over () - 1) end"


_GATE = f"input_eigent = '1' and not {EXCLUDED} and uf >= 100 and {A} > 0 and {_sum(OWN_ZONES)} / parcel_area_m2 >= 0.1"
# Null shares sort last in this engine, so they don't shift the other ranks.
SCORED = f"""pool as (select * from ({METRICS}) where {_GATE}), ranked as (select *, {', '.join(f'{_rank(v)} r_{v}' for v in _M)} from pool),
    scored as (select *, (25e0 * (0.6e0 * r_green_share + 0.4e0 * r_green) + 15e0 * r_uf + 15e0 * r_urban + 10e0 * r_nat_share + 5e0 * r_diversity + 10e0 * r_quality) / 80e0 score from ranked)"""


def scored(spark, sf):
    pool = P.priority_gate(wide(spark, sf), uf_min=100, bz_min=10)
    return P.priority_score(P.priority_metrics(pool))


@query("w1_pct_rank_mid", "select c_custkey, case when count(*) over () <= 1 then 0.5e0 else (rank() over (order by v) - 1 + (count(*) over (partition by v) - 1) / 2e0) / (count(*) over () - 1) end pr from (select c_custkey, floor(c_acctbal / 100) v from customer)")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("v"))
    return pct_rank_mid(c, "c_custkey", "v", "pr").select("c_custkey", "pr")


@query("w2_pct_rank_defined", "select o_orderkey, case when v is null then 0.5e0 else (rank() over (order by v nulls last) - 1 + (count(*) over (partition by v) - 1) / 2e0) / (count(v) over () - 1) end pr from (select o_orderkey, case when o_orderkey % 7 = 0 then null else floor(o_totalprice / 1000) end v from orders)")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("v"))
    return pct_rank_mid(o, "o_orderkey", "v", "pr").select("o_orderkey", "pr")


@query("w4_priority_score", f"with {SCORED} select id, round(score, 9) score from scored")
def _(spark, sf):
    return scored(spark, sf).select("id", F.round("score", 9).alias("score"))


@query("w5_select_capped", f"""with recursive {SCORED}, s as (select k, row_number() over (order by round(score, 9) desc, k) n, case when input_rg = '' then '?' else input_rg end c, case when input_tpf = '' then '?' else input_tpf end t from scored),
    w as (select 0::bigint n, 0::bigint k, false took, map([''], [0]) kc, 0 total, '' c, '' t
      union all select s.n, s.k, coalesce(map_extract(kc, 'c' || s.c)[1], 0) < 3 and coalesce(map_extract(kc, 't' || s.t)[1], 0) < 5 and total < 20,
        case when coalesce(map_extract(kc, 'c' || s.c)[1], 0) < 3 and coalesce(map_extract(kc, 't' || s.t)[1], 0) < 5 and total < 20 then map_concat(kc, map(['c' || s.c, 't' || s.t], [coalesce(map_extract(kc, 'c' || s.c)[1], 0) + 1, coalesce(map_extract(kc, 't' || s.t)[1], 0) + 1])) else kc end,
        total + case when coalesce(map_extract(kc, 'c' || s.c)[1], 0) < 3 and coalesce(map_extract(kc, 't' || s.t)[1], 0) < 5 and total < 20 then 1 else 0 end, s.c, s.t from w join s on s.n = w.n + 1)
    select k, total survey_rank from w where took""")
def _(spark, sf):
    d = scored(spark, sf).withColumn("score", F.round("score", 9))
    return P.select_capped(d, 20, 3, 5).select("k", "survey_rank")


@query("w6_priority_rows", f"with {SCORED} select k, round(score, 4) survey_score, case when green_share >= 0.3 then 'Grün-reich' when green_share >= 0.15 then 'Gemischt' else 'Versiegelt' end survey_segment, row_number() over (order by round(score, 9) desc, k) survey_rank from scored qualify row_number() over (order by round(score, 9) desc, k) <= 25")
def _(spark, sf):
    d = scored(spark, sf).withColumn("score", F.round("score", 9))
    return P.select_capped(d, 25, 0, 0).select("k", F.round("score", 4).alias("survey_score"), P.segment_label(F.col("green_share")).alias("survey_segment"), "survey_rank")


@query("w7_dominant_zone", f"select id, {DOM} zone_dom from b_portfolio")
def _(spark, sf):
    return P.parcel_stats(wide(spark, sf)).select("id", "zone_dom")


_SEL = f"sel as (select * from ({METRICS}) where input_eigent = '1')"


def _blank(c: str) -> str:
    return f"case when {c} = '' then '—' else {c} end"


_RG, _TPF = _blank("input_rg"), _blank("input_tpf")


@query("a25_selection_summary", f"with {_SEL}, c as (select name, value from ({_top(f'select {_RG} as name, count(*) * 1e0 as value from sel group by 1', 12)})), t as (select name, value from ({_top(f'select {_TPF} as name, count(*) * 1e0 as value from sel group by 1', 12)})) select 'segment' part, case when green_share >= 0.3 then 'Grün-reich' when green_share >= 0.15 then 'Gemischt' else 'Versiegelt' end as name, count(*) * 1e0 as value from sel group by 2 union all select 'sum', 'area', sum({A}) from sel union all select 'sum', 'green', sum(green) from sel union all select 'canton', name, value from c union all select 'portfolio', name, value from t")
def _(spark, sf):
    return P.selection_summary(P.priority_metrics(P.parcel_stats(wide(spark, sf))).where("input_eigent = '1'"))


@query("t1_sort_rows", "select id, input_bez, parcel_area_m2 from b_portfolio")
def _(spark, sf):
    """The rows are the SQL's; their order, which it can't express, is tested."""
    from parcelcover.operators.sorting import sort_rows

    return sort_rows(wide(spark, sf).select("id", "input_bez", "parcel_area_m2"), "input_bez", ties=("id",))


@query("t1_sort_numbers", "select id, parcel_area_m2, dense_rank() over (order by coalesce(parcel_area_m2, 0) desc) place from b_portfolio")
def _(spark, sf):
    from parcelcover.operators.ranking import running_counts
    from parcelcover.operators.sorting import sort_rows

    df = wide(spark, sf).select("id", "parcel_area_m2")
    values = df.select((-F.coalesce("parcel_area_m2", F.lit(0.0))).alias("value")).distinct().withColumn("n", F.lit(1))
    places = running_counts(values, ["value"], "n").select("value", (F.col("before") + 1).alias("place"))
    out = df.withColumn("value", -F.coalesce("parcel_area_m2", F.lit(0.0))).join(places, "value").drop("value")
    return sort_rows(out, "parcel_area_m2", True, True, ("id",))


@query("t2_natural_sort", "select id, regexp_replace(lower(id), '\\d+$', '') || lpad(regexp_extract(id, '(\\d+)$', 1), 20, '0') sort_key from b_portfolio order by 2")
def _(spark, sf):
    from parcelcover.operators.sorting import natural_key, natural_sort

    return natural_sort(wide(spark, sf).select("id", natural_key(F.col("id")).alias("sort_key")), "id")


@query("t3_object_key_sort", "select we, grundstk, try_cast(we as bigint) is null we_text, try_cast(we as bigint) we_number, try_cast(grundstk as bigint) is null grundstk_text, try_cast(grundstk as bigint) grundstk_number from (select distinct case when c_custkey % 9 = 0 then 'A' || c_custkey % 50 else cast(c_custkey % 100 as varchar) end we, cast(c_nationkey as varchar) grundstk from customer)")
def _(spark, sf):
    from parcelcover.operators.sorting import object_key

    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("case when c_custkey % 9 = 0 then concat('A', c_custkey % 50) else cast(c_custkey % 100 as string) end we", "cast(c_nationkey as string) grundstk").distinct()
    keys = [k for part in ("we", "grundstk") for k in object_key(F.col(part))]
    names = ["we_text", "we_number", "we", "grundstk_text", "grundstk_number", "grundstk"]
    return c.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).orderBy(*names)


@query("t4_page", "select id, nummer from b_portfolio order by k limit 25 offset 50")
def _(spark, sf):
    from parcelcover.operators.sorting import page

    return page(wide(spark, sf).select("k", "id", "nummer"), ["k"], 3, 25).select("id", "nummer")


@query("j14_details_for_selection", f"select l_partkey k, art, area from (select k l_partkey, art, area from b_facts) where l_partkey in (select k from b_portfolio where not {EXCLUDED} and input_country = 'CH' and input_eigent = '1')")
def _(spark, sf):
    chosen = P.facet_filter(wide(spark, sf), countries=["CH"], ownership=["1"]).select("k")
    return bridge(spark, sf, "b_facts").join(chosen, "k", "left_semi").select("k", "art", "area")


@query("s13_export_selection", f"select id, egrid, cast(sealed_m2 as varchar) sealed_text, {_blank('input_tpf')} tpf_text from b_portfolio where not {EXCLUDED} and input_country = 'CH' and input_eigent = '1'")
def _(spark, sf):
    d = P.facet_filter(wide(spark, sf), countries=["CH"], ownership=["1"])
    return d.select("id", "egrid", F.col("sealed_m2").cast("string").alias("sealed_text"), P.blank(F.col("input_tpf")).alias("tpf_text"))


_JSON_NUMBER = "case when {c} is null then 'null' when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else cast({c} as varchar) end"


@query("s13_export_features", f"""select '{{"type":"Feature","geometry":null,"properties":{{"id":"' || id || '","egrid":"' || egrid || '","sealed_m2":' || {_JSON_NUMBER.format(c='sealed_m2')} || ',"parcel_area_m2":' || {_JSON_NUMBER.format(c='parcel_area_m2')} || '}}}}' as json
    from b_portfolio where not {EXCLUDED} and input_country = 'CH' and input_eigent = '1'""")
def _(spark, sf):
    d = P.facet_filter(wide(spark, sf), countries=["CH"], ownership=["1"])
    return files.export_selection(d.select("id", "egrid", "sealed_m2", "parcel_area_m2", F.col("input_bez").alias("_name")))


@query("s13_export_columns", f"select id, coalesce(parcel_area_m2, 0) parcel_area_m2, coalesce(input_ort, '') input_ort, coalesce(try_cast(input_tpf as double), 0) input_tpf from b_portfolio where not {EXCLUDED} and input_country = 'CH' and input_eigent = '1'")
def _(spark, sf):
    d = P.facet_filter(wide(spark, sf), countries=["CH"], ownership=["1"])
    return files.export_selection(d, {"id": False, "parcel_area_m2": True, "input_ort": False, "input_tpf": True})


@query("s13_export_ranked", f"with {SCORED} select k, id, round(score, 4) survey_score from scored qualify row_number() over (order by round(score, 9) desc, k) <= 10")
def _(spark, sf):
    return P.select_capped(scored(spark, sf).withColumn("score", F.round("score", 9)), 10, 0, 0).select("k", "id", F.round("score", 4).alias("survey_score"))
