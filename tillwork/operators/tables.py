"""Derived columns of the cleaned tables: shares, ranks, flags, dates. One row in, one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import rules, scalar as S
from .grouped import with_dense_rank_desc, with_group_total


def flag_partial_history(monthly: DataFrame) -> DataFrame:
    """is_partial_history: the branch has fewer months than the branch with the most."""
    counts = monthly.groupBy("branch").agg(F.count(F.lit(1)).alias("_months"))
    most = counts.agg(F.max("_months"))
    return (monthly.join(counts, "branch").withColumn("is_partial_history", F.col("_months") < most.scalar())
            .drop("_months"))


def channel_shares(menu: DataFrame) -> DataFrame:
    """Average with fallback, and the channel's shares of its branch's sales and customers."""
    totals = menu.groupBy("branch").agg(F.sum("sales").alias("_s"), F.sum("customers").alias("_c"))
    return (menu.join(totals, "branch")
            .withColumn("sales_share_within_branch", S.round_to(S.ratio_or_value(F.col("sales"), F.col("_s")), 6))
            .withColumn("customer_share_within_branch", S.round_to(S.ratio_or_value(F.col("customers"), F.col("_c")), 6))
            .drop("_s", "_c"))


def tag_items(items: DataFrame) -> DataFrame:
    """is_modifier (free but sold) and category."""
    return (items.withColumn("is_modifier", (F.col("amount") == 0) & (F.col("qty") > 0))
            .withColumn("category", S.item_category(F.col("division"), F.col("is_modifier"))))


def rank_items(items: DataFrame) -> DataFrame:
    """Share of the branch's paid sales and dense ranks within branch and within division; NULL for modifiers."""
    paid = F.when(~F.col("is_modifier"), F.col("amount"))
    df = with_group_total(items, ["branch"], F.when(~F.col("is_modifier"), S.money(F.col("amount"))), "_total")
    df = df.withColumn("_paid", paid)
    df = df.withColumn("item_sales_share_within_branch", S.round_to(S.ratio_or_value(F.col("_paid"), F.col("_total")), 6))
    df = with_dense_rank_desc(df, ["branch"], "_paid", "item_rank_within_branch")
    df = with_dense_rank_desc(df, ["branch", "division"], "_paid", "item_rank_within_division")
    return df.drop("_paid", "_total")


def derive_customers(customers: DataFrame) -> DataFrame:
    """Zero-value and repeat flags, recency against the latest order of all, lifespan and average order value."""
    latest = customers.agg(F.max("last_order")).scalar()
    return (customers.withColumn("is_zero_value_customer", F.col("total") == 0)
            .withColumn("recency_days", S.elapsed_days(latest, F.col("last_order")))
            .withColumn("customer_lifespan_days", S.elapsed_days(F.col("last_order"), F.col("first_order")))
            .withColumn("avg_order_value", S.round_to(S.ratio_or_value(F.col("total"), F.col("num_orders")), 2))
            .withColumn("is_repeat_customer", F.col("num_orders") > 1))


def flag_shifts(punches: DataFrame, short: float = rules.SHIFT_TOO_SHORT, long: float = rules.SHIFT_TOO_LONG) -> DataFrame:
    """Shift type, anomaly and validity flags, weekday. Anomalous shifts are flagged, never dropped."""
    hour = F.substring("punch_in", 1, 2).try_cast("int")
    anomalous = S.is_anomalous_shift(F.col("duration_hours"), short, long)
    return (punches.withColumn("shift_start_hour", hour).withColumn("shift_type", S.punch_shift(hour))
            .withColumn("is_anomalous", anomalous)
            .withColumn("is_valid_shift", ~anomalous & F.col("duration_hours").isNotNull())
            .withColumn("duration_hours", S.round_to("duration_hours", 2))
            .withColumn("day_of_week", S.day_name(F.col("date")))
            .withColumn("weekend_flag", F.coalesce(S.is_weekend(F.col("day_of_week")), F.lit(False))))


def flag_lines(lines: DataFrame) -> DataFrame:
    """Void and modifier flags of order-detail lines."""
    void = F.col("qty") < 0
    return lines.withColumn("is_void", void).withColumn("is_modifier", (F.col("price") == 0) & ~void)


def basket_core(audit: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Baskets of paid lines: items in line order, distinct items, net quantity and sum of line prices; net_qty > 0.

    A basket is one customer block of a report. Amounts are summed as decimals, prices without the quantity.
    """
    keys = [c for c in ("file", "basket_id", "branch", "customer") if c in audit.columns]
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), "item")))
    # Distinct items are counted in the list: a distinct aggregate beside it would group every line twice.
    distinct = F.array_distinct(F.array_compact("items_list"))
    return (audit.where(~F.col("is_void") & ~F.col("is_modifier")).groupBy(*keys)
            .agg(F.transform(listed, lambda x: x["item"]).alias("items_list"),
                 F.sum(F.col("qty").cast("decimal(18,4)")).cast("double").alias("net_qty"),
                 F.sum(F.col("price").cast("decimal(18,4)")).cast("double").alias("net_total"))
            .where(F.col("net_qty") > 0)
            .select(*keys, "items_list", F.size(distinct).cast("long").alias("unique_items"), "net_qty", "net_total"))


def carry_last(df: DataFrame, keys: list[str], order: list[str], is_header, value, out: str) -> DataFrame:
    """Value of the latest header row at or before each row of a bounded group such as a conversation."""
    seen = F.last(F.when(is_header, value), ignorenulls=True)
    return df.withColumn(out, seen.over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
