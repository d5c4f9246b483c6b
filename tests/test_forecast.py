import datetime as dt

import numpy as np
import pytest

from tillwork.functions.rules import AnomalyRule
from tillwork.operators import forecast as FC


def monthly(spark, series):
    rows = [(b, dt.date(y + (m - 1) // 12, (m - 1) % 12 + 1, 1), float(v)) for b, (y, first, values) in series.items() for m, v in enumerate(values, first)]
    return spark.createDataFrame(rows, "branch string, date date, revenue double")


RULES = (AnomalyRule("likely_partial_month", -0.8, "down", 0.0, "Harbour", 12), AnomalyRule("potential_surge", 1.5, "up", 0.5, None, 12),
         AnomalyRule("potential_spike", 1.5, "up", 0.5, "Hill", 10))


def test_anomalies_and_scenarios(spark):
    df = monthly(spark, {"Harbour": (2025, 10, [100, 110, 5]), "Hill": (2025, 9, [100, 300, 200, 600]), "Moon": (2025, 10, [0, 50, 10])})
    flagged = FC.anomalies(df, RULES)
    got = {(r.branch, r.date.month): (r.anomaly, r.weight) for r in flagged.collect() if r.anomaly}
    assert got == {("Harbour", 12): ("likely_partial_month", 0.0), ("Hill", 10): ("potential_spike", 0.5), ("Hill", 12): ("potential_surge", 0.5)}
    assert {(r.branch, r.date.month): r.growth for r in flagged.collect()}[("Moon", 11)] is None  # zero base
    rows = FC.scenarios(flagged).collect()
    months = lambda b, s: sorted((r.date.month, r.w) for r in rows if r.branch == b and r.scenario == s)
    assert months("Harbour", "base") == months("Harbour", "surge_sensitive") == [(10, 1.0), (11, 1.0)]
    assert months("Hill", "base") == [(9, 1.0), (11, 1.0)]
    assert months("Hill", "surge_sensitive") == [(9, 1.0), (10, 0.5), (11, 1.0), (12, 0.5)]


def test_estimators_by_hand(spark):
    df = monthly(spark, {"two": (2025, 1, [10, 20]), "three": (2025, 1, [10, 20, 60]), "five": (2025, 10, [1, 4, 2, 8, 5])})
    base = FC.scenarios(FC.anomalies(df, ()))
    got = {r.branch: r for r in FC.estimators(base).where("scenario = 'base'").collect()}
    # Weights .5 .3 .2 go to the oldest month first; two months use .5 and .3, renormalised.
    assert got["three"].wma3 == pytest.approx(10 * 0.5 + 20 * 0.3 + 60 * 0.2)
    assert got["two"].wma3 == pytest.approx((10 * 0.5 + 20 * 0.3) / 0.8)
    assert got["five"].wma3 == pytest.approx(2 * 0.5 + 8 * 0.3 + 5 * 0.2)
    assert got["two"].slope is None and got["two"].naive == 20
    assert got["five"].slope == pytest.approx(np.polyfit(range(5), [1, 4, 2, 8, 5], 1)[0])
    newest = {r.branch: r for r in FC.estimators(base, newest_first=True).where("scenario = 'base'").collect()}
    assert newest["three"].wma3 == pytest.approx(60 * 0.5 + 20 * 0.3 + 10 * 0.2)


def test_weighted_line(spark):
    df = monthly(spark, {"Hill": (2025, 9, [100, 300, 200, 600])})
    fit = FC.estimators(FC.scenarios(FC.anomalies(df, RULES))).where("scenario = 'surge_sensitive'").first()
    w = np.array([1, 0.5, 1, 0.5])
    slope = np.polyfit(range(4), [100, 300, 200, 600], 1, w=np.sqrt(w))[0]
    assert fit.slope == pytest.approx(slope)


def test_ensemble_by_hand(spark):
    df = monthly(spark, {"Hill": (2025, 10, [100, 110, 121]), "Harbour": (2025, 8, [100, 120, 100, 120, 150])})
    rows = {(r.branch, r.scenario, r.forecast_period): r for r in FC.ensemble(df, (), {"Hill": "Harbour"}).collect()}
    assert len(rows) == 2 * 2 * 3
    r = rows[("Hill", "base", 1)]
    # naive 121, moving average 107.2, line 131.33..; the reference grew by 25 %: 151.25 at weight 0.5.
    assert (r.naive_estimate, r.wma3_estimate, r.linear_estimate, r.similarity_estimate) == (121.0, 107.2, 131.33, 151.25)
    assert r.demand_index_forecast == 121.0 and r.forecast_month == "January 2026" and r.is_primary
    low, high = np.percentile([121, 107.2, 131 + 1 / 3, 151.25], [25, 75])
    assert r.relative_band_low == pytest.approx(low, abs=0.01) and r.relative_band_high == pytest.approx(high, abs=0.01)  # growth does not vary
    assert r.stability_data_qty == 8 and r.stability_volatility == 25 and r.stability_anomaly == 25
    assert r.stability_agreement == int(25 * (1 - (131 + 1 / 3 - 107.2) / 121))
    assert r.confidence_level == "low" and "is_partial_history=True" in r.notes
    assert rows[("Hill", "base", 3)].similarity_estimate == round(121 * 1.25 ** 3, 2)
    assert rows[("Harbour", "base", 1)].similarity_estimate is None
    assert r.explanation.startswith("Based on 3 clean monthly data points") and "primary 1-month-ahead" in r.explanation


def test_backtest_and_metadata(spark):
    df = monthly(spark, {"Hill": (2025, 1, [100, 100, 100, 100, 200])})
    got = FC.backtest(df, 1).first()
    assert (got.n_holdout, got.mape_naive, got.mape_ensemble) == (1, 0.5, 0.5)
    meta = FC.run_metadata(FC.ensemble(df, ())).first()
    assert meta.total_rows == 6 and meta.scenarios == ["base", "surge_sensitive"] and meta.periods_per_scenario == 3


def test_rolling_backtest_runs_every_origin_anew(spark):
    values = [100.0, 110.0, 120.0, 130.0, 140.0, 150.0, 160.0, 200.0]
    monthly = spark.createDataFrame([("a", dt.date(2025, m + 1, 1), v) for m, v in enumerate(values)] + [("b", dt.date(2025, 1, 1), 5.0)], "branch string, date date, revenue double")
    got = {(r.branch, r.forecast_period): r for r in FC.rolling_backtest(monthly, 2, 3).collect()}
    assert set(got) == {("a", 1), ("a", 2)}
    # Origins 3, 2 and 1 months before the end know 5, 6 and 7 months; the naive value is the last one they know.
    one = [(140.0, 150.0), (150.0, 160.0), (160.0, 200.0)]
    two = [(140.0, 160.0), (150.0, 200.0)]
    for period, pairs in ((1, one), (2, two)):
        assert got["a", period].n_origins == len(pairs)
        assert abs(got["a", period].mape_naive - sum(abs(f - y) / y for f, y in pairs) / len(pairs)) < 1e-6
    assert got["a", 1].mape_ensemble <= got["a", 1].mape_naive


def test_short_series_have_no_line(spark):
    monthly = spark.createDataFrame([("a", dt.date(2025, 1, 1), 40.0), ("a", dt.date(2025, 2, 1), 50.0)], "branch string, date date, revenue double")
    for r in FC.ensemble(monthly).collect():
        assert r.linear_estimate == r.naive_estimate == 50.0 and r.relative_band_low > 0
