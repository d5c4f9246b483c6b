import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tillwork.functions.rules import RegionRule
from tillwork.operators import scoring as SC, staffing as ST


def shifts(spark, rows):
    full = [(b, e, dt.date.fromisoformat(d), i, o, True) for b, e, d, i, o in rows]
    return spark.createDataFrame(full, "branch string, emp_id string, date date, punch_in string, punch_out string, is_valid_shift boolean")


def test_hours_touched_by_a_shift(spark):
    df = shifts(spark, [("Hill", "1", "2025-12-06", "22:30:00", "01:00:00"), ("Hill", "2", "2025-12-06", "22:00:00", "23:00:00"),
                        ("Moon", "3", "2025-12-06", "10:15:00", "10:15:10"), ("Moon", "4", "2025-12-06", "10:00:00", "10:00:00")])
    got = {(r.branch, str(r.date), r.day_of_week, r.hour): r.active_employees for r in ST.hourly_supply(df).collect()}
    # Past midnight hour 0 belongs to the next day; an end exactly on the hour leaves that hour out.
    assert got == {("Hill", "2025-12-06", "Saturday", 22): 2, ("Hill", "2025-12-06", "Saturday", 23): 1,
                   ("Hill", "2025-12-07", "Sunday", 0): 1, ("Moon", "2025-12-06", "Saturday", 10): 1}


def test_shape_sums_to_one_and_branch_without_orders_gets_zero(spark):
    slots = spark.createDataFrame([("Hill", "Monday", h) for h in range(10, 14)] + [("Moon", "Monday", 9)], "branch string, day_of_week string, hour int")
    orders = spark.createDataFrame([("Hill", "c", dt.datetime(2025, 12, 1, 10, 5), 2), ("Hill", "d", dt.datetime(2025, 12, 1, 20, 0), 1),
                                    ("Else", "e", dt.datetime(2025, 12, 1, 10, 0), 1), ("Hill", "f", dt.datetime(2026, 1, 5), 9)],
                                   "branch string, customer string, last_order timestamp, num_orders int")
    days = shifts(spark, [("Hill", "1", "2025-12-01", "08:00:00", "09:00:00"), ("Hill", "1", "2025-12-02", "08:00:00", "09:00:00")])
    got = {(r.branch, r.hour): r for r in ST.demand_shape(orders, slots, ST.observation_window(days)).collect()}
    hill = [got[("Hill", h)].shape_weight_rows for h in range(10, 14)]
    # Two rows in the window, one outside the staffed slots: strength 2/12, share 1/2.
    raw = [1 / 6 * 0.5 + 5 / 6 * 0.25] + [5 / 6 * 0.25] * 3
    assert hill == pytest.approx([x / sum(raw) for x in raw]) and sum(hill) == pytest.approx(1)
    assert got[("Hill", 10)].branch_total_customer_rows_in_overlap == 2 and got[("Moon", 9)].shape_weight_rows == 0


def test_multiplier_sources(spark):
    menu = spark.createDataFrame([("A", "DELIVERY", 10.0, 0.1), ("A", "TABLE", 90.0, 0.9), ("B", "TABLE", 100.0, 1.0)],
                                 "branch string, channel string, customers double, customer_share_within_branch double")
    at = dt.datetime(2025, 12, 1, 12)
    orders = spark.createDataFrame([("A", f"a{i}", at, 1) for i in range(9)] + [("B", f"b{i}", at, 1) for i in range(5)],
                                   "branch string, customer string, last_order timestamp, num_orders int")
    monthly = spark.createDataFrame([(b, dt.date(2025, 12, 1), v) for b, v in (("A", 100.0), ("B", 800.0), ("C", 100.0))], "branch string, date date, revenue double")
    branches = spark.createDataFrame([("A",), ("B",), ("C",)], "branch string")
    window = ST.observation_window(shifts(spark, [("A", "1", "2025-12-01", "08:00:00", "09:00:00")]))
    got = {r.branch: r for r in ST.demand_multipliers(menu, orders, monthly, branches, window).collect()}
    assert (got["A"].share_source, got["A"].confidence, got["A"].delivery_share_low, got["A"].multiplier_base_demand) == ("avg_sales_menu_delivery_share", "high", 0.08, 10.0)
    assert got["B"].share_source == "customer_orders_profile_share" and got["B"].delivery_share_base == 0.05
    assert got["B"].sales_calibration_multiplier == round((0.8 / (5 / 14)) ** 0.5, 4)
    assert got["C"].share_source == "global_delivery_share_fallback" and got["C"].sales_calibration_multiplier == 3.5
    assert got["C"].note.endswith("proxy demand is missing") and got["C"].delivery_share_base == 0.1


def test_robust_targets(spark):
    hours = list(range(6, 12))
    values = [1.0, 2.0, 3.0, 4.0, 100.0, 0.0]  # 100 lies beyond the fence, 0 does not count
    profile = spark.createDataFrame([("Hill", "Monday", h, 1.0) for h in hours] + [("Moon", "Monday", 7, 2.0)],
                                    "branch string, day_of_week string, hour int, avg_active_employees double")
    demand = spark.createDataFrame([("Hill", "Monday", h, v, "high") for h, v in zip(hours, values)] + [("Moon", "Monday", 7, 0.0, "low")],
                                   "branch string, day_of_week string, hour int, total_orders_est_base double, confidence string")
    got = {(r.branch, r.shift_bucket): (r.slot_count, r.target_orders_per_employee) for r in ST.productivity_targets(profile, demand).collect()}
    assert got == {("Hill", "morning"): (5, 2.5), ("Hill", "all_day"): (5, 2.5), ("Moon", "morning"): (0, None),
                   ("Moon", "all_day"): (0, None), ("__global__", "all_day"): (5, 2.5)}


def test_min_max_and_median(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 3.0, 5.0, None), ("c", None, 5.0, None)], "branch string, x double, k double, z double")
    got = {r.branch: (r.nx, r.nk, r.nz) for r in SC.min_max(df, {"x": "nx", "k": "nk", "z": "nz"}).collect()}
    assert got == {"a": (0.0, 0.5, 0.5), "b": (1.0, 0.5, 0.5), "c": (0.5, 0.5, 0.5)}
    filled = {r.branch: (r.x, r.z) for r in SC.impute_median(df, ["x", "z"]).collect()}
    assert filled["c"] == (2.0, 0.5)


def test_slope_factor(spark):
    df = spark.createDataFrame([("a", dt.date(2025, m, 1), v) for m, v in ((1, 1.0), (2, 2.0), (3, 4.0))] + [("b", dt.date(2025, 1, 1), 7.0)],
                               "branch string, date date, revenue double")
    got = {r.branch: r for r in SC.revenue_kpis(df).collect()}
    x, y = np.linspace(0, 1, 3), np.array([1.0, 2.0, 4.0])
    assert got["a"].recent_growth_rate == pytest.approx(np.cov(x, y)[0, 1] / np.var(x) / y.mean())
    assert got["a"].recent_growth_rate * y.mean() == pytest.approx(3 / 2 * np.polyfit(x, y, 1)[0])
    assert got["a"].pct_change_first_last == 3.0 and got["a"].is_partial_history
    assert (got["b"].recent_growth_rate, got["b"].revenue_volatility, got["b"].pct_change_first_last) == (0.0, 0.0, 0.0)


def test_missing_sources_give_nulls_and_scores_lie_in_range(spark):
    df = spark.createDataFrame([(b, dt.date(2025, m, 1), float(v)) for b, vs in {"a": [1, 2], "b": [5, 4], "c": [3, 3]}.items() for m, v in enumerate(vs, 1)],
                               "branch string, date date, revenue double")
    kpis = SC.branch_kpis({"monthly_sales": df})
    assert {r.tax_burden for r in kpis.collect()} == {None}
    scores = SC.feasibility_scores(kpis).toPandas()
    assert scores["feasibility_score"].between(0, 1).all() and set(scores["norm_delivery"]) == {0.5}
    with pytest.raises(ValueError):
        SC.branch_kpis({})
    with pytest.raises(ValueError):
        SC.feasibility_scores(kpis, {"growth": 0.5})
    zones = {"a": "north", "b": "south", "c": "east"}
    rules = (RegionRule("north", "North", "a", ("N1",)), RegionRule("south", "South", "b", ("S1",)), RegionRule("east", "East", None, ("E1",), "near"))
    row = SC.region_decision(SC.feasibility_scores(kpis), kpis, zones, rules).first()
    # Branch a grows fastest, so its region is chosen although another scores higher.
    assert row.strongest_growth_branch == "a" and row.recommended_region == "North" and row.warning is None
    # The branch to replicate comes from the region with the best score; b and c tie, the region's name decides.
    assert scores.set_index("branch")["feasibility_score"].idxmax() in "bc" and row.best_branch_to_replicate == "c"
    assert list(pd.Series([r.rank for r in SC.branch_ranking(SC.feasibility_scores(kpis), zones).collect()])) == [1, 2, 3]


def test_unique_key_check(spark):
    once = spark.createDataFrame([("a", 1), ("b", 2)], "branch string, n int")
    assert ST.require_unique(once, "branch").count() == 2
    assert ST.require_unique(once.limit(0), "branch").count() == 0
    twice = ST.require_unique(once.unionByName(once.where("n = 2")), "branch")  # no job runs, so nothing fails yet
    with pytest.raises(Exception, match="not unique"):
        twice.collect()
    with pytest.raises(Exception, match="not unique"):
        once.withColumnRenamed("n", "m").join(twice, "branch").collect()
    assert ST.require_unique(once.unionByName(once.selectExpr("branch", "n + 5 AS n")), "branch", "n").count() == 4
