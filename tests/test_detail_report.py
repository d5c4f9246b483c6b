"""order-detail reports are written, classified and cut into cells once per line."""

import pytest
from pyspark.sql import functions as F

from tillwork.operators import tables as T
from tillwork.plans import catalog
from tillwork.sources import lines as L, reports as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_quoted_cells(spark):
    """A choice per character in the pattern ran out of stack here."""
    long = "x" * 100_000
    got = L.split_cells(spark.createDataFrame([(f'a,"{long}",,"b ""c"", d"',), ('"p, q",r',), (None,)], "line string")).collect()
    assert [r["cells"] for r in got] == [["a", long, None, 'b "c", d'], ["p, q", "r"], None]
    assert [(r["c0"], r["c3"], r["n_cells"]) for r in got] == [("a", 'b "c", d', 4), ("p, q", None, 2), (None, None, None)]


def test_cells_are_taken_once(spark):
    text = ["Branch :Hill,,,,", "Person_1,,,,", ',2,tea,"1,200.50",', ",-1,tea,3.00,", ",x,jam,1.00,", "Total :,,,,"]
    lines = spark.createDataFrame([("p", "p", 0, i, x) for i, x in enumerate(text)], "path string, file string, block long, pos long, line string")
    got = R.transaction_baskets(lines)
    assert sorted(tuple(r) for r in got.select("pos", "basket_id", "branch", "customer", "item", "qty", "price").collect()) == [
        (2, 1, "Hill", "Person_1", "tea", 2.0, 1200.5), (3, 1, "Hill", "Person_1", "tea", -1.0, 3.0)]
    assert plan(got).count("regexp_extract_all(") == 1


def test_baskets_are_grouped_once(spark):
    rows = [("f", 1, "b", "c", item, q, 2.0, i, False, False) for i, (item, q) in enumerate([("tea", 1.0), ("jam", 1.0), ("tea", 2.0), (None, 1.0)])]
    audit = spark.createDataFrame(rows, "file string, basket_id long, branch string, customer string, item string, qty double, price double, line_no long, is_void boolean, is_modifier boolean")
    core = T.basket_core(audit)
    assert [tuple(r) for r in core.select("items_list", "unique_items", "net_qty", "net_total").collect()] == [(["tea", "jam", "tea", None], 2, 5.0, 8.0)]
    assert dict(core.dtypes)["unique_items"] == "bigint"
    physical = core._jdf.queryExecution().sparkPlan().toString()
    assert sum("Aggregate(" in x for x in physical.splitlines()) == 2  # partial and final; a distinct count made four


@pytest.mark.parametrize("text, pattern", [(catalog._whole_text, "%.0f"), (catalog._money_text, "%,.2f")])
def test_numbers_print_as_the_formatter_does(spark, text, pattern):
    odd = [None, 0.0, -0.0, 0.005, 0.01, 0.5, -0.5, -0.4, 1.5, 2.5, -2.5, 50.0, -7.0, 998.995, 999.0, 999.994, 999.995, 999.999, 1000.0, 1000.005, 1234.5, 10000.07, 104949.99,
           999999.0, 999999.99, 999999.995, 1e6, 1234567.891, 1e15, 2.5e16, -1234.5, float("nan"), float("inf"), float("-inf"), 2.675, 1.005]
    df = spark.createDataFrame([(x,) for x in odd], "x double").select("x", text(F.col("x")).alias("fast"), F.format_string(pattern, "x").alias("slow"))
    got = df.collect()
    assert [r["fast"] for r in got] == [r["slow"] for r in got]
