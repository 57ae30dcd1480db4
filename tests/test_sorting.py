import numpy as np
import pytest

from parcelcover.operators.portfolio import select_capped
from parcelcover.operators.sorting import natural_sort, sort_rows
from tests.test_queries import greedy


def order(df, key="t"):
    return [r[key] for r in df.collect()]


def test_natural_sort(spark):
    rows = ["TEST-10", "test-2", "TEST-2b", "Äpfel 3", "apfel 12", "Zug", "zug 1", "", None, "a" + "9" * 25, "a1", "É1", "e2", "E 07", "e 7a"]
    got = order(natural_sort(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(3), "t", ties=("i",)))
    assert got == ["", None, "a1", "a" + "9" * 25, "Äpfel 3", "apfel 12", "E 07", "e 7a", "É1", "e2", "test-2", "TEST-2b", "TEST-10", "Zug", "zug 1"]
    assert order(natural_sort(spark.createDataFrame([("x2",), ("X10",), ("x1",)], "t string"), "t", True)) == ["X10", "x2", "x1"]


def test_german_order(spark):
    df = spark.createDataFrame([(t,) for t in ["Zürich", "zug", "Ärger", "arg", "Arg", "Öl", "Ofen", None, "ß", "st"]], "t string")
    assert order(sort_rows(df, "t", ties=("t",))) == [None, "arg", "Arg", "Ärger", "Ofen", "Öl", "ß", "st", "zug", "Zürich"]
    assert order(sort_rows(df, "t", True, ties=("t",)))[-2:] == ["arg", None]


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ["10 m", "9", "x", "-3", "2.5", None]], "t string")
    assert order(sort_rows(df, "t", numeric=True, ties=("t",))) == ["-3", None, "x", "2.5", "9", "10 m"]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("n,c_cap,t_cap", [(40, 1, 1), (60, 3, 2), (1000, 7, 11), (30, 0, 1), (1, 1, 1)])
def test_choice_under_tight_quotas(spark, seed, n, c_cap, t_cap):
    """Few values, many ties, quotas that cross: equal to the pass over all rows."""
    r = np.random.default_rng(seed)
    rows = [(i, float(r.integers(0, 6)), f"c{r.integers(0, 9)}", f"t{int(r.integers(0, 8) * r.random())}") for i in range(400)]
    got = select_capped(spark.createDataFrame(rows, "k long, score double, input_rg string, input_tpf string"), n, c_cap, t_cap)
    assert [x.k for x in got.orderBy("survey_rank").collect()] == greedy(rows, n, c_cap, t_cap)


def test_choice_has_no_python(spark):
    df = spark.createDataFrame([(1, 2.0, "a", "b")], "k long, score double, input_rg string, input_tpf string")
    assert "Python" not in select_capped(df, 5, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert select_capped(df.limit(0), 5, 1, 1).count() == 0
