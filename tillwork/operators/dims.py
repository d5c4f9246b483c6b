"""Dimension tables and cross-source reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import rules, scalar as S


def dim_branch(menu: DataFrame, monthly: DataFrame, attendance: DataFrame) -> DataFrame:
    """Every branch named by a source, its channels, months of data and attendance coverage."""
    parts = [
        menu.select("branch", F.upper("channel").alias("channel"), F.lit(0).alias("month"), F.lit(0).alias("shift")),
        monthly.select("branch", F.lit(None).cast("string").alias("channel"), F.lit(1).alias("month"), F.lit(0).alias("shift")),
        attendance.select("branch", F.lit(None).cast("string").alias("channel"), F.lit(0).alias("month"), F.lit(1).alias("shift")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("branch").isNotNull())

    def has(name: str):
        return F.coalesce(F.bool_or(F.col("channel") == name), F.lit(False))

    return rows.groupBy(F.col("branch").alias("canonical_branch_name")).agg(
        has("DELIVERY").alias("has_delivery"), has("TABLE").alias("has_table"), has("TAKE AWAY").alias("has_takeaway"),
        (F.sum("month") > 0).alias("has_monthly_sales"), F.sum("month").alias("months_of_data"),
        (F.sum("shift") > 0).alias("has_attendance_data"))


def dim_item(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per item: hierarchy of its first row in ``order``, whether it ever is a modifier, beverage flag."""
    first = F.min_by(F.struct("division", "group", "category"), F.struct(*order)).alias("f")
    return (items.groupBy("item").agg(first, F.bool_or("is_modifier").alias("modifier_flag"))
            .select(F.col("item").alias("canonical_item_name"), "f.division", "f.group", "f.category", "modifier_flag",
                    F.col("f.category").isin(*rules.BEVERAGE_CATEGORIES).alias("beverage_flag")))


# Notes of the three source pairs, in the order in which the sources are trusted.
RECONCILE_NOTES = {
    ("monthly_sales", "avg_sales_menu"): "monthly_sales is revenue truth; avg_sales is channel aggregate",
    ("monthly_sales", "items_by_group"): "items_by_group is mix truth, not revenue truth",
    ("avg_sales_menu", "items_by_group"): "cross-check channel aggregate vs product aggregate",
}


def reconcile(totals: DataFrame, notes: Mapping[tuple[str, str], str] = RECONCILE_NOTES,
              tolerance: float = rules.RECONCILE_TOLERANCE) -> DataFrame:
    """Compare per-branch totals ``(source, branch, value)`` between the source pairs of ``notes``.

    The totals are pivoted to one row per branch, so the comparison needs no join.
    """
    sources = sorted({s for pair in notes for s in pair})
    wide = totals.groupBy("branch").agg(*[F.max(F.when(F.col("source") == s, F.col("value"))).alias(s) for s in sources])
    rows = F.array(*[
        F.struct(F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), F.col(a).alias("a"), F.col(b).alias("b"),
                 F.lit(note).alias("note"))
        for (a, b), note in notes.items()
    ])
    variance = F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("a"), F.lit(1.0))
    return (wide.select("branch", F.inline(rows)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
            .select("branch", "source_a", "source_b", F.lit("total_revenue").alias("metric"),
                    S.round_to("a", 2).alias("value_a"), S.round_to("b", 2).alias("value_b"),
                    S.round_to(variance, 4).alias("variance_pct"), (variance <= tolerance).alias("is_within_tolerance"), "note"))


def source_totals(monthly: DataFrame, menu: DataFrame, items: DataFrame) -> DataFrame:
    """Revenue per branch as each source states it; modifiers do not count."""
    def total(df: DataFrame, source: str, column: str) -> DataFrame:
        return df.groupBy("branch").agg(F.sum(S.money(F.col(column))).cast("double").alias("value")).select(
            F.lit(source).alias("source"), "branch", "value")

    return (total(monthly, "monthly_sales", "revenue").unionByName(total(menu, "avg_sales_menu", "sales"))
            .unionByName(total(items.where(~F.col("is_modifier")), "items_by_group", "amount")))
