"""Forecasts for many independent monthly series: two scenarios, four estimators, ensemble, band and stability.

Series are rows (branch, t, y) with t a running month number; one plan handles all series. A series has a few rows per
year, so the windows and the ordered arrays of a series stay small however many series there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays, rules, scalar as S

BASE, SENSITIVE = "base", "surge_sensitive"


def month_index(date: Column) -> Column:
    """12 * year + month - 1: consecutive months differ by one across years."""
    return F.year(date) * 12 + F.month(date) - 1


def month_label(index: Column) -> Column:
    date = F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_format(date, "MMMM yyyy")


def anomalies(monthly: DataFrame, anomaly_rules: Sequence[rules.AnomalyRule] = rules.ANOMALY_RULES) -> DataFrame:
    """Growth of each month and the first anomaly rule it meets, with the weight of such a month."""
    by_time = W.partitionBy("branch").orderBy("date")
    before = F.lag("revenue").over(by_time)
    df = monthly.select("branch", "date", F.col("revenue").alias("y"), month_index(F.col("date")).alias("t"),
                        F.try_divide(F.col("revenue") - before, before).alias("growth"))
    label, weight = F.lit(None).cast("string"), F.lit(1.0)
    for rule in reversed(list(anomaly_rules)):
        meets = F.col("growth") >= rule.threshold if rule.direction == "up" else F.col("growth") <= rule.threshold
        if rule.entity is not None:
            meets = meets & (F.col("branch") == rule.entity)
        if rule.month is not None:
            meets = meets & (F.month("date") == rule.month)
        label = F.when(meets, F.lit(rule.label)).otherwise(label)
        weight = F.when(meets, F.lit(rule.weight)).otherwise(weight)
    return df.withColumn("anomaly", label).withColumn("weight", weight)


def scenarios(flagged: DataFrame, sensitive: str = SENSITIVE) -> DataFrame:
    """Both scenario series: base without flagged months, sensitive with reduced weights; weight 0 is dropped."""
    both = F.array(
        F.struct(F.lit(BASE).alias("scenario"), F.when(F.col("anomaly").isNull(), 1.0).otherwise(0.0).alias("w")),
        F.struct(F.lit(sensitive).alias("scenario"), F.col("weight").alias("w")))
    return flagged.select("branch", "date", "t", "y", "anomaly", F.inline(both)).where(F.col("w") > 0)


def _facts(flagged: DataFrame) -> DataFrame:
    """Per branch: last month of all data, last clean point, clean range, flags, volatility of the full series."""
    clean = F.col("anomaly").isNull()
    latest_clean = F.max_by(F.when(clean, F.struct("t", "y")), F.when(clean, F.col("t")))
    latest = F.max_by(F.struct("t", "y"), "t")
    point = F.struct("t", "anomaly")
    return flagged.groupBy("branch").agg(
        F.max("t").alias("last_t"), F.coalesce(latest_clean, latest).alias("last_clean"),
        F.min(F.when(clean, F.col("y"))).alias("clean_min"), F.max(F.when(clean, F.col("y"))).alias("clean_max"),
        F.array_sort(F.collect_list(F.when(~clean, point))).alias("flags"), F.count(F.lit(1)).alias("n_all"),
        F.stddev_samp("growth").alias("vol_full"))


def estimators(series: DataFrame, weights: Sequence[float] = rules.WMA_WEIGHTS, newest_first: bool = False) -> DataFrame:
    """Naive value, weighted moving average, least-squares line, points and growth volatility per (branch, scenario).

    The moving-average weights are applied oldest month first (``newest_first`` turns that round); a short series uses
    the first weights, renormalised. Lines with fewer than three points fall back to the naive value.
    """
    k = len(weights)
    by_time = W.partitionBy("branch", "scenario").orderBy("t")
    # The newest point in front: tail[0] is the last value.
    tail = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("t", "y")))), 1, k)
    before = F.lag("y").over(by_time)
    x, y, w = F.col("t").cast("double"), F.col("y"), F.col("w")
    sums = (series.withColumn("g", F.try_divide(F.col("y") - before, before))
            # Positions are counted from the first month of the branch, which keeps the sums of squares small.
            .withColumn("t0", F.min("t").over(W.partitionBy("branch")))
            .groupBy("branch", "scenario").agg(
                tail.alias("tail"), F.count(F.lit(1)).alias("n"), F.stddev_samp("g").alias("vol"), F.max("t").alias("series_t"),
                F.max("t0").alias("t0"), F.sum(w).alias("sw"), F.sum(w * (x - F.col("t0"))).alias("sx"), F.sum(w * y).alias("sy"),
                F.sum(w * (x - F.col("t0")) * y).alias("sxy"), F.sum(w * (x - F.col("t0")) * (x - F.col("t0"))).alias("sxx")))
    size = F.size("tail")
    # The value at place i of the tail (0 = newest) has age rank size-1-i counted from the oldest.
    used = F.array(*[F.lit(float(v)) for v in weights])
    place = (lambda i: i) if newest_first else (lambda i: size - 1 - i)
    pairs = F.transform("tail", lambda p, i: F.struct((p["y"] * F.get(used, place(i))).alias("v"), F.get(used, place(i)).alias("w")))
    total = F.aggregate(pairs, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")),
                        lambda acc, p: F.struct((acc["v"] + p["v"]).alias("v"), (acc["w"] + p["w"]).alias("w")))
    mx, my = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
    slope = F.when(F.col("n") >= 3, F.try_divide(F.col("sxy") - F.col("sw") * mx * my, F.col("sxx") - F.col("sw") * mx * mx))
    return (sums.withColumn("_wma", total)
            .select("branch", "scenario", "n", "series_t", F.get("tail", F.lit(0))["y"].alias("naive"),
                    (F.col("_wma.v") / F.col("_wma.w")).alias("wma3"), slope.alias("slope"),
                    (my - slope * (mx + F.col("t0"))).alias("intercept"), F.coalesce("vol", F.lit(0.0)).alias("vol_series"),
                    F.get("tail", F.lit(0))["y"].alias("last_y"), F.get("tail", F.lit(1))["y"].alias("prev_y")))


def references(mapping: Mapping[str, str] | DataFrame | None, fits: DataFrame) -> DataFrame:
    """Latest growth of the reference series of each branch: (branch, reference, ref_growth)."""
    base = fits.where(F.col("scenario") == BASE)
    growth = base.select(F.col("branch").alias("reference"), (F.col("last_y") - F.col("prev_y")).alias("_d"), F.col("prev_y").alias("_p"))
    growth = growth.select("reference", F.try_divide("_d", "_p").alias("ref_growth"))
    if isinstance(mapping, DataFrame):
        linked = mapping.select("branch", "reference")
    else:
        from ..functions.scalar import lookup

        linked = base.select("branch", lookup(F.col("branch"), mapping or {}).alias("reference")).where(F.col("reference").isNotNull())
    return linked.join(growth, "reference").select("branch", "reference", "ref_growth")


def ensemble(monthly: DataFrame, anomaly_rules: Sequence[rules.AnomalyRule] = rules.ANOMALY_RULES,
             similar: Mapping[str, str] | DataFrame | None = None, horizon: int = rules.HORIZON, sensitive: str = SENSITIVE,
             align_horizon: bool = False, explain: bool = True) -> DataFrame:
    """Forecast rows: one per branch, scenario and future month.

    The line is extrapolated from the last month of the scenario's series while the calendar label counts from the last
    month of all data; ``align_horizon`` counts both from the latter. ``monthly``: branch, date, revenue and, if known,
    is_partial_history.
    """
    flagged = anomalies(monthly, anomaly_rules)
    facts = _facts(flagged)
    fits = estimators(scenarios(flagged, sensitive))
    refs = references(similar, fits)
    if "is_partial_history" in monthly.columns:
        facts = facts.join(monthly.groupBy("branch").agg(F.bool_or("is_partial_history").alias("is_partial")), "branch")
    else:
        most = facts.agg(F.max("n_all")).scalar()
        facts = facts.withColumn("is_partial", F.col("n_all") < most)
    df = fits.join(facts, "branch").join(refs, "branch", "left")
    full = S.round_to("vol_full", 4)
    clean_vol = F.max(F.when(F.col("scenario") == BASE, F.col("vol_series"))).over(W.partitionBy("branch"))
    df = df.withColumn("vol", F.when((F.col("scenario") != BASE) & (full > 0), full).otherwise(clean_vol))
    df = df.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(horizon))))

    last_y = F.col("last_clean.y")
    start = F.col("last_t") if align_horizon else F.col("series_t")
    line = F.when(F.col("slope").isNotNull(), F.greatest(F.lit(0.0), F.col("slope") * (start + F.col("p")) + F.col("intercept")))
    growing = F.when(F.col("ref_growth").isNull(), last_y).otherwise(last_y * F.pow(1 + F.greatest(F.col("ref_growth"), F.lit(-1.0)), F.col("p")))
    active = (F.col("n") < rules.SIMILARITY_BELOW) & F.col("reference").isNotNull() & (last_y > 0)
    df = df.withColumn("linear", F.coalesce(line, F.col("naive"))).withColumn("similar", F.when(active, growing))

    def weighted(name: str, weight: float) -> Column:
        return F.struct(F.col(name).alias("v"), F.lit(weight).alias("w"))

    core = F.array(weighted("naive", 1.0), weighted("wma3", 1.0), weighted("linear", 1.0))
    extra = F.when(F.col("similar").isNotNull(), F.array(weighted("similar", rules.SIMILARITY_WEIGHT))).otherwise(
        F.array().cast("array<struct<v:double,w:double>>"))
    df = df.withColumn("_pairs", F.concat(core, extra)).withColumn("_vals", F.transform("_pairs", lambda x: x["v"]))
    capped = F.least(F.col("vol"), F.lit(rules.VOLATILITY_CAP))
    trio = F.array("naive", "wma3", "linear")
    df = (df.withColumn("value", arrays.weighted_median(F.col("_pairs"))).withColumn("capped", capped)
          .withColumn("low", F.greatest(F.lit(0.0), arrays.array_percentile(F.col("_vals"), 0.25) * (1 - F.col("capped"))))
          .withColumn("high", arrays.array_percentile(F.col("_vals"), 0.75) * (1 + F.col("capped")))
          .withColumn("width", F.when(F.col("value") > 0, (F.col("high") - F.col("low")) / F.col("value")).otherwise(0.0))
          .withColumn("change", F.when(last_y > 0, (F.col("value") - last_y) / last_y).otherwise(0.0))
          .withColumn("_mid", F.get(F.array_sort(trio), F.lit(1)))
          .withColumn("disagreement", F.when(F.col("_mid") > 0, (F.array_max(trio) - F.array_min(trio)) / F.col("_mid")).otherwise(0.0)))

    def points(c: Column) -> Column:
        return F.greatest(F.lit(0), c.cast("int"))

    df = (df.withColumn("s_qty", F.least(F.lit(25), points((F.col("n") - 2) * 25 / F.lit(3.0))))
          .withColumn("s_vol", points(25 * (1 - F.col("vol") / 1.5)))
          .withColumn("s_agree", points(25 * (1 - F.least(F.col("disagreement"), F.lit(1.0)))))
          .withColumn("s_anom", F.when(F.size("flags") > 0, 10).otherwise(25))
          .withColumn("score", F.least(F.lit(100), F.col("s_qty") + F.col("s_vol") + F.col("s_agree") + F.col("s_anom")))
          .withColumn("label", F.when(F.col("score") >= 60, "stable").when(F.col("score") >= 30, "cautious").otherwise("unstable"))
          .withColumn("confidence", F.when((F.col("n") >= 5) & (F.col("vol") < 0.5), "medium")
                      .when((F.col("n") >= 4) & (F.col("vol") < 1.0), "low-medium").otherwise("low")))
    december = F.get(F.filter("flags", lambda f: F.pmod(f["t"], F.lit(12)) == 11), F.lit(0))["anomaly"]
    notes = F.array_compact(F.array(
        F.when(F.col("is_partial"), "is_partial_history=True — fewer months than other branches"),
        F.when(F.col("value") < 0.5 * F.col("clean_min"), F.format_string("WARN: forecast below 0.5× historical min (%,.0f)", "clean_min")),
        F.when(F.col("value") > 2.0 * F.col("clean_max"), F.format_string("WARN: forecast above 2.0× historical max (%,.0f)", "clean_max"))))
    out = [
        F.col("branch"), F.col("scenario"), F.col("p").alias("forecast_period"), (F.col("p") == 1).alias("is_primary"),
        month_label(F.col("last_t") + F.col("p")).alias("forecast_month"), S.round_to("value", 2).alias("demand_index_forecast"),
        S.round_to("change", 4).alias("expected_change_vs_last_clean_month"), S.round_to("low", 2).alias("relative_band_low"),
        S.round_to("high", 2).alias("relative_band_high"), S.round_to("width", 4).alias("band_width_pct"),
        S.round_to("naive", 2).alias("naive_estimate"), S.round_to("wma3", 2).alias("wma3_estimate"),
        S.round_to("linear", 2).alias("linear_estimate"), S.round_to("similar", 2).alias("similarity_estimate"),
        F.lit("ensemble_median").alias("method"), F.col("confidence").alias("confidence_level"),
        F.col("score").alias("forecast_stability_score"), F.col("label").alias("forecast_stability_label"),
        F.col("s_qty").alias("stability_data_qty"), F.col("s_vol").alias("stability_volatility"),
        F.col("s_agree").alias("stability_agreement"), F.col("s_anom").alias("stability_anomaly"), F.col("n").alias("n_months_used"),
        F.date_format(F.make_date((F.floor(F.col("last_clean.t") / 12)).cast("int"), (F.pmod(F.col("last_clean.t"), F.lit(12)) + 1).cast("int"),
                                  F.lit(1)), "MMMM").alias("last_clean_month"),
        F.coalesce(december, F.lit("none")).alias("december_anomaly_flag"), F.array_join(notes, "; ").alias("notes"),
    ]
    if explain:
        from ..functions.text import forecast_explanation

        out.append(forecast_explanation().alias("explanation"))
    return df.select(*out)


def backtest(monthly: DataFrame, holdout: int = 1, similar: Mapping[str, str] | None = None) -> DataFrame:
    """Hold out the last months of each branch, forecast them from the rest, and report the error of every estimator."""
    newest = F.row_number().over(W.partitionBy("branch").orderBy(F.desc("date")))
    placed = monthly.withColumn("_age", newest)
    past = placed.where(F.col("_age") > holdout).drop("_age")
    actual = placed.where(F.col("_age") <= holdout).select(
        "branch", F.col("revenue").alias("actual"), (F.lit(holdout + 1) - F.col("_age")).alias("forecast_period"))
    made = ensemble(past, (), similar, holdout, explain=False).where(F.col("scenario") == BASE)
    joined = made.join(actual, ["branch", "forecast_period"])

    def error(column: str) -> Column:
        return S.round_to(F.avg(F.try_divide(F.abs(F.col(column) - F.col("actual")), F.col("actual"))), 6)

    return joined.groupBy("branch").agg(
        F.count(F.lit(1)).alias("n_holdout"), error("demand_index_forecast").alias("mape_ensemble"),
        error("naive_estimate").alias("mape_naive"), error("wma3_estimate").alias("mape_wma3"), error("linear_estimate").alias("mape_linear"),
        S.round_to(F.avg(F.col("actual").between(F.col("relative_band_low"), F.col("relative_band_high")).cast("double")), 6).alias("band_coverage"))


_AT = "\u0001"


def rolling_backtest(monthly: DataFrame, horizon: int = rules.HORIZON, origins: int = 6, similar: Mapping[str, str] | None = None) -> DataFrame:
    """Errors by branch and months ahead, over forecasts made at each of the last ``origins`` months of every branch.

    A month's rank from the newest decides for which origins it is known; each (branch, origin) is a series of its own, so one plan
    runs every estimator anew for all origins. Months after the last one have no actual value and are not counted.
    """
    placed = monthly.withColumn("_age", F.row_number().over(W.partitionBy("branch").orderBy(F.desc("date"))))
    series = lambda name: F.concat(name, F.lit(_AT), F.col("_o").cast("string"))
    known = placed.withColumn("_o", F.explode(F.sequence(F.lit(1), F.lit(origins)))).where(F.col("_age") > F.col("_o"))
    linked = None
    if similar:
        other = S.lookup(F.col("branch"), similar)
        linked = known.select("branch", "_o").distinct().where(other.isNotNull()).select(series(F.col("branch")).alias("branch"), series(other).alias("reference"))
    made = ensemble(known.withColumn("branch", series(F.col("branch"))).drop("_age", "_o"), (), linked, horizon, explain=False).where(F.col("scenario") == BASE)
    made = made.withColumn("origin", F.substring_index("branch", _AT, -1).cast("int")).withColumn("branch", F.substring_index("branch", _AT, 1))
    made = made.withColumn("_age", F.col("origin") - F.col("forecast_period") + 1)
    joined = made.join(placed.select("branch", "_age", F.col("revenue").alias("actual")), ["branch", "_age"])

    def error(column: str) -> Column:
        return S.round_to(F.avg(F.try_divide(F.abs(F.col(column) - F.col("actual")), F.col("actual"))), 6)

    return joined.groupBy("branch", "forecast_period").agg(
        F.count(F.lit(1)).alias("n_origins"), error("demand_index_forecast").alias("mape_ensemble"),
        error("naive_estimate").alias("mape_naive"), error("wma3_estimate").alias("mape_wma3"), error("linear_estimate").alias("mape_linear"),
        S.round_to(F.avg(F.col("actual").between(F.col("relative_band_low"), F.col("relative_band_high")).cast("double")), 6).alias("band_coverage"))


def run_metadata(forecast: DataFrame) -> DataFrame:
    """One row describing a forecast run: rows, branches, scenarios and parameters."""
    return forecast.agg(
        F.count(F.lit(1)).alias("total_rows"), F.array_sort(F.collect_set("branch")).alias("branches"),
        F.array_sort(F.collect_set("scenario")).alias("scenarios"), F.max("forecast_period").alias("periods_per_scenario"),
    ).withColumn("parameters", F.create_map(*[x for k, v in {
        "WMA_WEIGHTS": str(list(rules.WMA_WEIGHTS)), "VOLATILITY_CAP": str(rules.VOLATILITY_CAP),
        "SIMILARITY_BELOW": str(rules.SIMILARITY_BELOW), "SIMILARITY_WEIGHT": str(rules.SIMILARITY_WEIGHT)}.items()
        for x in (F.lit(k), F.lit(v))])).withColumn("run_timestamp", F.current_timestamp())
