"""Every query with SQL against DuckDB, plans without cross products, and the greedy choice against the plain pass."""

import collections
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parcelcover import queries as library
from parcelcover.operators.portfolio import select_capped
from parcelcover.operators.ranking import pct_rank_mid
from parcelcover.sources.bridge import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return str(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    cursor = duck.execute(library.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_runs(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clip_plan_is_an_equi_join(spark):
    plan = library.QUERIES["j3_candidate_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def nodes(plan):
    """How often each kind of node is in a plan, without subqueries."""
    found, todo = collections.Counter(), [plan]
    while todo:
        p = todo.pop()
        found[p.nodeName()] += 1
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


@pytest.mark.parametrize("name,exchanges,scans", [("a13_art_hierarchy", 5, 3), ("a14_habitat_hierarchy", 5, 3), ("a16_zone_table", 8, 3), ("r7_balance_check", 7, 18)])
def test_plans_of_one_pass(spark, name, exchanges, scans):
    """What is summed up is read once: few shuffles, and each table once for each place where its SQL names it."""
    found = nodes(library.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().initialPlan())
    assert found["Exchange"] <= exchanges
    assert found["Scan parquet "] <= scans


def test_fixed_decimal_query(spark):
    from decimal import ROUND_HALF_UP, Decimal

    price = {r.o_orderkey: r.o_totalprice for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for r in library.QUERIES["f2_to_fixed_1"](spark, SF).collect():
        assert r.shown == str(Decimal(price[r.o_orderkey]).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def greedy(rows, n, c_cap, t_cap):
    out, c, t = [], {}, {}
    for k, _, canton, portfolio in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(out) == n:
            break
        if (c_cap and c.get(canton, 0) >= c_cap) or (t_cap and t.get(portfolio, 0) >= t_cap):
            continue
        c[canton], t[portfolio] = c.get(canton, 0) + 1, t.get(portfolio, 0) + 1
        out.append(k)
    return out


@pytest.mark.parametrize("n,c_cap,t_cap", [(20, 3, 5), (10, 0, 0), (50, 2, 0), (50, 0, 4), (5, 9, 9)])
def test_capped_choice(spark, n, c_cap, t_cap):
    r = np.random.default_rng(n)
    rows = [(i, float(r.integers(0, 30)), f"c{r.integers(0, 6)}", f"t{r.integers(0, 5)}") for i in range(300)]
    got = select_capped(spark.createDataFrame(rows, "k long, score double, input_rg string, input_tpf string"), n, c_cap, t_cap)
    assert [x.k for x in got.orderBy("survey_rank").collect()] == greedy(rows, n, c_cap, t_cap)


def test_mid_ranks(spark):
    rows = [(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, float("nan"), 2.0])]
    got = {r.k: r.pr for r in pct_rank_mid(spark.createDataFrame(rows, "k int, v double"), "k", "v", "pr").collect()}
    assert got == {0: pytest.approx(2.5 / 3), 1: 0.0, 2: pytest.approx(2.5 / 3), 3: 0.5, 4: 0.5, 5: pytest.approx(1 / 3)}
    assert pct_rank_mid(spark.createDataFrame([(1, 7.0)], "k int, v double"), "k", "v", "pr").first().pr == 0.5


def test_result_does_not_depend_on_partitions(spark):
    one = sorted(map(str, library.QUERIES["a7_habitat_rollup"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, library.QUERIES["a7_habitat_rollup"](spark, SF).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
