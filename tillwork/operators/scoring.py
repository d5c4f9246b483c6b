"""Branch KPIs, normalisation, the composite feasibility score and the regional decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrays, rules, scalar as S, text
from ..session import stage
from .grouped import group_percentiles, with_global_rank_desc


def _literal_struct(df: DataFrame, columns: Mapping[str, Column]) -> Column:
    """One-row aggregate as a scalar subquery: the values reach every task as constants, without a join."""
    return df.agg(F.struct(*[c.alias(name) for name, c in columns.items()]).alias("v")).scalar()


def min_max(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Scale columns to [0, 1]; a constant or empty column and NULL values give 0.5. Keys: input, values: output."""
    bounds = _literal_struct(df, {f"{side}_{c}": f(c) for c in columns for side, f in (("lo", F.min), ("hi", F.max))})
    df = df.withColumn("_bounds", bounds)
    for c, out in columns.items():
        low, high = F.col(f"_bounds.lo_{c}"), F.col(f"_bounds.hi_{c}")
        df = df.withColumn(out, F.coalesce(F.when(high > low, (F.col(c) - low) / (high - low)), F.lit(0.5)))
    return df.drop("_bounds")


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULL by the column's median, or by 0.5 if the whole column is NULL."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])))
    middle = group_percentiles(rows, ["c"], "v", {"m": 0.5}).agg(F.map_from_entries(F.collect_list(F.struct("c", "m")))).scalar()
    df = df.withColumn("_middle", middle)
    for c in columns:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.try_element_at("_middle", F.lit(c)), F.lit(0.5)))
    return df.drop("_middle")


# ---------------------------------------------------------------- KPIs

def revenue_kpis(monthly: DataFrame) -> DataFrame:
    """Mean, trend, volatility and first-to-last change of each branch's monthly revenue.

    The trend is the slope over positions scaled to [0, 1] as sample covariance over population variance, which is
    n / (n - 1) times the least-squares slope, divided by the mean.
    """
    by_time = W.partitionBy("branch").orderBy("date")
    x = ((F.row_number().over(by_time) - 1) / F.greatest(F.count(F.lit(1)).over(W.partitionBy("branch")) - 1, F.lit(1))).cast("double")
    y = F.col("revenue")
    base = monthly.withColumn("x", x).groupBy("branch").agg(
        F.avg(S.money(y)).cast("double").alias("avg_monthly_revenue"), F.covar_samp("x", y).alias("_cov"), F.var_pop("x").alias("_var"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("_std"), F.min_by(y, "date").alias("_first"),
        F.max_by(y, "date").alias("_last"), F.count(F.lit(1)).alias("n_months"))
    mean = F.col("avg_monthly_revenue")
    slope = F.coalesce(F.try_divide("_cov", "_var"), F.lit(0.0))
    change = F.try_divide(F.col("_last") - F.col("_first"), F.abs("_first"))
    return base.select(
        "branch", mean, F.coalesce(F.try_divide(slope, mean), F.lit(0.0)).alias("recent_growth_rate"),
        F.coalesce(F.try_divide("_std", mean), F.lit(0.0)).alias("revenue_volatility"),
        F.when(F.col("n_months") >= 2, F.coalesce(change, F.lit(0.0))).otherwise(0.0).alias("pct_change_first_last"),
        "n_months", (F.col("n_months") < 12).alias("is_partial_history"))


def order_kpis(customers: DataFrame) -> DataFrame:
    sums = customers.groupBy("branch").agg(F.sum("num_orders").alias("orders_count"),
                                           F.sum(S.money(F.col("total"))).cast("double").alias("total_customer_revenue"))
    return sums.withColumn("avg_order_value", S.ratio(F.col("total_customer_revenue"), F.col("orders_count")))


def delivery_kpis(detail: DataFrame) -> DataFrame:
    line = S.money(F.col("qty")) * S.money(F.col("price"))
    return detail.groupBy("branch").agg(F.sum(line).cast("double").alias("delivery_revenue"),
                                        F.count_distinct("customer").alias("delivery_order_count"))


def _period_revenue() -> Column:
    """Average month times number of months, five months where unknown: the revenue of the observed period."""
    return F.col("avg_monthly_revenue") * F.coalesce(F.col("n_months"), F.lit(5))


def staff_kpis(attendance: DataFrame, revenue: DataFrame) -> DataFrame:
    hours = attendance.groupBy("branch").agg(F.sum(F.col("duration_hours").cast("decimal(18,4)")).cast("double").alias("total_hours"))
    return (hours.join(revenue.select("branch", "avg_monthly_revenue", "n_months"), "branch", "left")
            .select("branch", "total_hours", S.ratio(_period_revenue(), F.col("total_hours")).alias("revenue_per_hour")))


def tax_kpis(tax: DataFrame, revenue: DataFrame) -> DataFrame:
    sums = tax.groupBy("branch").agg(F.sum(S.money(F.col("total_tax"))).cast("double").alias("total_tax"))
    return (sums.join(revenue.select("branch", "avg_monthly_revenue", "n_months"), "branch", "left")
            .select("branch", "total_tax", S.ratio(F.col("total_tax"), _period_revenue()).alias("tax_burden")))


KPI_COLUMNS = {
    "avg_monthly_revenue": "double", "recent_growth_rate": "double", "revenue_volatility": "double",
    "pct_change_first_last": "double", "n_months": "long", "is_partial_history": "boolean", "orders_count": "long",
    "avg_order_value": "double", "total_customer_revenue": "double", "delivery_revenue": "double",
    "delivery_order_count": "long", "delivery_share": "double", "total_hours": "double", "revenue_per_hour": "double",
    "total_tax": "double", "tax_burden": "double",
}


def branch_kpis(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All KPIs of the branches with monthly sales; columns of absent sources are NULL."""
    if "monthly_sales" not in sources:
        raise ValueError("monthly_sales is required: feasibility cannot be computed without revenue")
    revenue = revenue_kpis(sources["monthly_sales"])
    df = revenue
    if "customer_orders" in sources:
        df = df.join(order_kpis(sources["customer_orders"]), "branch", "left")
    if "delivery_detail" in sources:
        df = df.join(delivery_kpis(sources["delivery_detail"]), "branch", "left")
        share = S.ratio(F.col("delivery_revenue"), _period_revenue())
        df = df.withColumn("delivery_share", F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))))
    if "attendance" in sources:
        df = df.join(staff_kpis(sources["attendance"], revenue), "branch", "left")
    if "tax_summary" in sources:
        df = df.join(tax_kpis(sources["tax_summary"], revenue), "branch", "left")
    return df.select("branch", *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in KPI_COLUMNS.items()])


# ---------------------------------------------------------------- composite score

def feasibility_scores(kpis: DataFrame, weights: Mapping[str, float] = rules.FEASIBILITY_WEIGHTS) -> DataFrame:
    """Six normalised parts, weighted score, tier and the two strongest drivers."""
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    df = impute_median(kpis, ["avg_order_value", "delivery_share", "revenue_per_hour"])
    df = min_max(df, {"recent_growth_rate": "norm_growth", "avg_monthly_revenue": "norm_revenue",
                      "revenue_volatility": "norm_volatility", "avg_order_value": "norm_avg_order",
                      "delivery_share": "norm_delivery", "revenue_per_hour": "norm_ops_eff"})
    df = df.withColumn("stability", 1 - F.col("norm_volatility"))
    part = {"growth": "norm_growth", "revenue": "norm_revenue", "stability": "stability", "avg_order": "norm_avg_order",
            "delivery": "norm_delivery", "ops_eff": "norm_ops_eff"}
    contributions = {name: F.col(part[name]) * F.lit(w) for name, w in weights.items()}
    score = sum(list(contributions.values())[1:], list(contributions.values())[0])
    df = (df.withColumn("feasibility_score", S.round_to(score, 4)).withColumn("score_tier", S.tier(F.col("feasibility_score")))
          .withColumn("top_drivers", arrays.top_names(contributions, 2)))
    return df.select("branch", "avg_monthly_revenue", "recent_growth_rate", "revenue_volatility", "avg_order_value",
                     "delivery_share", "revenue_per_hour", "norm_growth", "norm_revenue", "norm_volatility",
                     "norm_avg_order", "norm_delivery", "norm_ops_eff", "stability", "feasibility_score", "score_tier", "top_drivers")


def region_scores(scores: DataFrame, zones: Mapping[str, str] | DataFrame) -> DataFrame:
    """Mean score per region; branches without a region count as 'unknown'."""
    return (with_region(scores, zones).groupBy("region")
            .agg(S.round_to(F.avg(F.col("feasibility_score").cast("decimal(10,4)")).cast("double"), 4).alias("region_score")))


def with_region(df: DataFrame, zones: Mapping[str, str] | DataFrame) -> DataFrame:
    """Add the region of each branch from a constant mapping or a table (branch, region)."""
    if isinstance(zones, DataFrame):
        return df.join(zones, "branch", "left").withColumn("region", F.coalesce("region", F.lit("unknown")))
    return df.withColumn("region", S.lookup(F.col("branch"), zones, "unknown"))


def region_decision(scores: DataFrame, kpis: DataFrame, zones: Mapping[str, str], region_rules: Sequence[rules.RegionRule]) -> DataFrame:
    """One row: where to expand, which branch to replicate, and why.

    The first rule whose region has the best mean score, or whose own branch grows fastest, decides; the last rule is the
    fallback and carries its warning. Ties go to the smaller name. ``growth_summary`` maps every branch of ``kpis`` to its growth, as wide as
    the table of branches; the reasons end with the growth of the chosen region's branch where it rises.
    """
    def best(df: DataFrame, name: str, metric: str, *more: str) -> DataFrame:
        return df.agg(F.min_by(F.struct(name, metric, *more), F.struct(-F.col(metric), F.col(name))).alias("v"))

    regions = region_scores(scores, zones)
    growth = kpis.select("branch", S.round_to(F.col("recent_growth_rate"), 6).alias("growth_rate"), (F.col("recent_growth_rate") > 0).alias("is_growing"),
                         S.round_to("pct_change_first_last", 4).alias("pct_change"))
    grown = F.struct("branch", F.struct("growth_rate", "is_growing", "pct_change"))
    zoned = with_region(scores, zones).select("branch", "region", "feasibility_score", "score_tier")
    top_region = best(regions, "region", "region_score")
    in_region = zoned.where(F.col("region") == top_region.select("v.region").scalar())
    table = {
        "top": best(zoned, "branch", "feasibility_score", "score_tier").scalar(),
        "area": top_region.scalar(),
        "fast": best(growth, "branch", "growth_rate").scalar(),
        "replicate": best(in_region, "branch", "feasibility_score").scalar(),
        "home": best(zoned.where(F.col("region") == region_rules[-1].region), "branch", "feasibility_score").scalar(),
        "growth": growth.agg(F.map_from_entries(F.array_sort(F.collect_list(grown)))).scalar(),
        "scores": regions.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "region_score"))))).scalar(),
    }
    spark = scores.sparkSession
    row = spark.range(1).select(*[c.alias(name) for name, c in table.items()])
    pick = F.lit(len(region_rules) - 1)
    for i, rule in reversed(list(enumerate(region_rules[:-1]))):
        pick = F.when((F.col("area.region") == rule.region) | (F.col("fast.branch") == F.lit(rule.entity)), i).otherwise(pick)

    def choose(values) -> Column:
        chosen = values[-1]
        for i, v in reversed(list(enumerate(values[:-1]))):
            chosen = F.when(F.col("_rule") == i, v).otherwise(chosen)
        return chosen

    def reasons(rule: rules.RegionRule) -> Column:
        branch = F.lit(rule.entity) if rule.entity else F.col("home.branch")
        rate = F.try_element_at("growth", branch)["growth_rate"]
        score = F.try_element_at("scores", F.lit(rule.region))
        return F.array_compact(F.array(text.region_reason(rule.title, F.col("area.region") == rule.region, score, rule.warning),
                                       text.growth_reason(rule.title, branch, rate, bool(rule.entity))))

    return (row.withColumn("_rule", pick).select(
        choose([F.lit(r.title) for r in region_rules]).alias("recommended_region"),
        choose([F.array(*[F.lit(c) for c in r.candidates]) for r in region_rules]).alias("candidate_locations"),
        F.col("replicate.branch").alias("best_branch_to_replicate"), F.col("top.score_tier").alias("feasibility_tier"),
        F.col("top.feasibility_score").alias("overall_feasibility"), F.col("scores").alias("region_scores"),
        F.col("fast.branch").alias("strongest_growth_branch"),
        F.col("growth").alias("growth_summary"),
        F.concat(choose([reasons(r) for r in region_rules]), F.array(text.best_reason(F.col("top.branch"), F.col("top.feasibility_score"), F.col("top.score_tier")),
                                                                     text.strongest_reason(F.col("fast.branch"), F.col("fast.growth_rate")))).alias("reasoning"),
        choose([F.lit(r.warning).cast("string") for r in region_rules]).alias("warning")))


# ---------------------------------------------------------------- views on the scores

def branch_ranking(scores: DataFrame, zones: Mapping[str, str]) -> DataFrame:
    """Branches in order of score, position as a column; equal scores by name. The scores are written, as ranking reads them twice."""
    kept = stage(with_region(scores, zones).select("branch", "region", "feasibility_score", "score_tier", "top_drivers"), "scores")
    return with_global_rank_desc(kept, "feasibility_score", "rank", [F.asc("branch")]).orderBy("rank").select(
        "rank", "branch", "region", "feasibility_score", "score_tier", "top_drivers")


def growth_summary(kpis: DataFrame, zones: Mapping[str, str]) -> DataFrame:
    rate, change = S.round_to("recent_growth_rate", 6), S.round_to("pct_change_first_last", 4)
    return with_region(kpis, zones).select("branch", "region", rate.alias("growth_rate"), change.alias("pct_change"),
                                           (F.col("recent_growth_rate") > 0).alias("is_growing"), text.sales_statement(rate, change).alias("statement"))


def risk_summary(scores: DataFrame, zones: Mapping[str, str]) -> DataFrame:
    """Risk tier of each branch from its normalised volatility (0.65 / 0.35)."""
    v = F.col("norm_volatility")
    level = S.tier(v, 0.65, 0.35)
    return with_region(scores, zones).select(
        "branch", "region", S.round_to("revenue_volatility", 4).alias("revenue_volatility"), S.round_to(v, 4).alias("norm_volatility"),
        level.alias("risk_tier"), S.round_to(1 - v, 4).alias("stability_score"), text.risk_statement(level, 1 - v).alias("statement"))


def feasibility_explanation(scores: DataFrame, weights: Mapping[str, float] = rules.FEASIBILITY_WEIGHTS) -> DataFrame:
    """Normalised parts of the score, one row per branch and component with its weight."""
    part = {"growth": "norm_growth", "revenue": "norm_revenue", "stability": "stability", "avg_order": "norm_avg_order",
            "delivery": "norm_delivery", "ops_eff": "norm_ops_eff"}
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.lit(w).alias("weight"), S.round_to(part[n], 4).alias("value"))
                     for n, w in weights.items()])
    return scores.select("branch", "feasibility_score", "score_tier", "top_drivers", F.inline(rows))
