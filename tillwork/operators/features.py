"""Feature tables per branch and month, item, customer and shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import rules, scalar as S
from .grouped import group_percentiles, with_dense_rank_desc


def branch_month(monthly: DataFrame, menu: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """3-month average, growth, expanding volatility of growth, and the branch's static delivery and beverage shares.

    The windows run over one branch's months, a handful of rows per year.
    """
    by_time = W.partitionBy("branch").orderBy("date")
    before = F.lag("revenue").over(by_time)
    growth = F.try_divide(F.col("revenue") - before, before)
    df = (monthly.withColumn("_g", growth)
          .withColumn("revenue_ma3", S.round_to(F.avg("revenue").over(by_time.rowsBetween(-2, 0)), 2))
          .withColumn("mom_growth", S.round_to("_g", 4))
          .withColumn("volatility", S.round_to(F.stddev_samp("_g").over(by_time.rowsBetween(W.unboundedPreceding, 0)), 4))
          .drop("_g"))
    missing = F.lit(None).cast("double")
    if menu is None:
        df = df.withColumn("channel_delivery_share", missing)
    else:
        df = df.join(delivery_share(menu), "branch", "left")
    if items is None:
        return df.withColumn("beverage_share", missing)
    return df.join(beverage_share(items), "branch", "left")


def delivery_share(menu: DataFrame) -> DataFrame:
    """Delivery sales over all sales of the branch; NULL for a branch without delivery."""
    delivered = F.sum(F.when(F.col("channel") == "DELIVERY", S.money(F.col("sales"))))
    return menu.groupBy("branch").agg(
        S.round_to(S.ratio_or_value(delivered, F.sum(S.money(F.col("sales")))), 4).alias("channel_delivery_share"))


def beverage_share(items: DataFrame) -> DataFrame:
    """Beverage amount over all paid amount of the branch; NULL for a branch without beverages."""
    drinks = F.sum(F.when(F.col("category").isin(*rules.BEVERAGE_CATEGORIES), S.money(F.col("amount"))))
    return items.where(~F.col("is_modifier")).groupBy("branch").agg(
        S.round_to(S.ratio_or_value(drinks, F.sum(S.money(F.col("amount")))), 4).alias("beverage_share"))


def branch_item(items: DataFrame) -> DataFrame:
    """Share, rank and quantity share of paid items, and whether the item could be sold with a beverage."""
    paid = items.where(~F.col("is_modifier"))
    totals = paid.groupBy("branch").agg(F.sum(S.money(F.col("amount"))).alias("_a"), F.sum(S.money(F.col("qty"))).alias("_q"))
    df = (paid.join(totals, "branch")
          .withColumn("item_share", S.round_to(S.ratio_or_value(F.col("amount"), F.col("_a")), 6))
          .withColumn("attach_tendency", S.round_to(S.ratio_or_value(F.col("qty"), F.col("_q")), 6))
          .withColumn("beverage_opportunity_flag", ~F.col("category").isin(*rules.BEVERAGE_CATEGORIES)))
    return with_dense_rank_desc(df, ["branch"], "amount", "item_rank").select(
        "branch", "item", "division", "group", "category", "qty", "amount", "item_share", "item_rank",
        "attach_tendency", "beverage_opportunity_flag")


def customer_delivery(customers: DataFrame) -> DataFrame:
    """Value segment within the branch: low up to the 33rd percentile, high above the 66th; zero-value rows are low."""
    cuts = group_percentiles(customers.where(~F.col("is_zero_value_customer")), ["branch"], "total",
                             {"_q33": 0.33, "_q66": 0.66})
    segment = (F.when(F.col("is_zero_value_customer") | F.col("total").isNull() | F.col("_q33").isNull(), "low")
               .when(F.col("total") <= F.col("_q33"), F.when(F.col("total") > F.col("_q66"), "high").otherwise("low"))
               .when(F.col("total") > F.col("_q66"), "high").otherwise("medium"))
    return customers.join(cuts, "branch", "left").withColumn("value_segment", segment).drop("_q33", "_q66")


def branch_shift(shifts: DataFrame) -> DataFrame:
    """Labour features of the branch: hours, counts and shift mix of valid shifts, and the anomaly rate of all."""
    valid = F.col("is_valid_shift")
    n = F.count_if(valid)

    def part(test):
        return S.round_to(F.try_divide(F.count_if(valid & test).cast("double"), n.cast("double")), 4)

    mix = shifts.groupBy("branch").agg(
        S.round_to(F.avg(F.when(valid, F.col("duration_hours").cast("decimal(18,4)"))).cast("double"), 2).alias("mean_hours"),
        n.alias("valid_shifts"), F.count_distinct(F.when(valid, F.col("emp_id"))).alias("unique_employees"),
        *[part(F.col("shift_type") == s).alias(f"{s}_pct") for s in ("morning", "afternoon", "evening")],
        part(F.col("weekend_flag")).alias("weekend_shift_pct"), F.count("emp_id").alias("total_shifts"),
        S.round_to(F.avg(F.col("is_anomalous").cast("double")), 4).alias("anomaly_rate"))
    middle = group_percentiles(shifts.where(valid), ["branch"], "duration_hours", {"_m": 0.5})
    return (mix.where("valid_shifts > 0").join(middle, "branch").withColumn("median_hours", S.round_to("_m", 2))
            .select("branch", "median_hours", "mean_hours", "valid_shifts", "unique_employees", "morning_pct",
                    "afternoon_pct", "evening_pct", "weekend_shift_pct", "total_shifts", "anomaly_rate"))
