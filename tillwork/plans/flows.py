"""Whole flows: report files to cleaned tables and features, and the five analytics over the cleaned tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules, scalar as S, text
from ..operators import baskets as B, dims, features, forecast as FC, growth as G, scoring as SC, staffing as ST
from ..session import checkpoint_dir, stage
from ..sources import lines as L, reports as R
from . import store


def etl(spark: SparkSession, folder: str, seen: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cleaned tables, dimensions, checks, features and the file audit of a folder of report files.

    The text is read once, then stored with its report type; each parser reads only the lines of its own type.
    """
    lines = stage(L.read_lines(spark, folder), "lines")
    return tables_of_lines(lines, seen, L.list_files(spark, folder))


def tables_of_lines(lines: DataFrame, seen: DataFrame | None = None, listed: DataFrame | None = None) -> dict[str, DataFrame]:
    audit = stage(R.audit_files(lines, seen=seen, listed=listed), "file_audit")
    clean = {name: stage(df, name) for name, df in R.clean_tables(typed_tables(lines, audit)).items()}
    return {**clean, **layers(clean), "file_audit": audit}


def typed_tables(lines: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """Parsed rows per report type. The lines are stored by type first, so that each parser reads only its own."""
    spark = lines.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"typed-lines-{uuid.uuid4().hex}")
    typed = lines.drop("bytes").join(audit.where("status = 'parsed'").select("path", "report_type"), "path")
    typed.write.partitionBy("report_type").parquet(path)
    return R.parse_all(spark.read.schema(typed.schema).parquet(path), audit)


def layers(clean: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Dimensions, reconciliation and features of the cleaned tables."""
    monthly, menu, items = clean["monthly_sales"], clean["avg_sales_menu"], clean["items_by_group"]
    return {
        "dim_branch": dims.dim_branch(menu, monthly, clean["attendance"]),
        "dim_item": dims.dim_item(items, [c for c in ("path", "block", "pos") if c in items.columns] or ["branch", "division", "group"]),
        "fact_reconciliation_checks": dims.reconcile(dims.source_totals(monthly, menu, items)),
        "feat_branch_month": features.branch_month(monthly, menu, items),
        "feat_branch_item": features.branch_item(items),
        "feat_customer_delivery": features.customer_delivery(clean["customer_orders"]),
        "feat_branch_shift": features.branch_shift(clean["attendance"]),
    }


def combos(lines: DataFrame, min_support: float = 0.01, min_count_ab: int = 2, validate: bool = True) -> dict[str, DataFrame]:
    """Order baskets and pair statistics with sentences; raises if a check of the statistics fails."""
    baskets = stage(B.order_baskets(lines), "order_baskets")
    pairs = stage(B.combo_pairs(baskets, min_support, min_count_ab), "combo_pairs")
    if validate:
        B.require_valid(B.pair_checks(pairs, baskets))
    return {"order_baskets": baskets, "combo_pairs": pairs.withColumn("explanation", text.pair_explanation())}


def combo_metadata(pairs: DataFrame, min_support: float, min_count_ab: int) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("total_pairs"), F.array_sort(F.collect_set("scope_type")).alias("scope_types"),
                     F.array_sort(F.collect_set("branch")).alias("branches")).select(
        "*", F.lit(min_support).alias("min_support"), F.lit(min_count_ab).alias("min_count_ab"))


def staffing(shifts: DataFrame, menu: DataFrame, orders: DataFrame, monthly: DataFrame) -> dict[str, DataFrame]:
    """The staffing tables with sentences; raises if there are no valid shifts to anchor the observation window."""
    if shifts.where("is_valid_shift").isEmpty():
        raise ValueError("attendance has no valid shifts to anchor the analysis window")
    out = dict(ST.staffing_tables(shifts, menu, orders, monthly, stage))
    out["staffing_gap_hourly"] = out["staffing_gap_hourly"].withColumn("explanation", text.gap_explanation())
    out["branch_staffing_findings"] = out["branch_staffing_findings"].withColumn("explanation", text.findings_explanation())
    return out


def growth(baskets: DataFrame, items: DataFrame, target=S.is_target, method: str = "pairs") -> dict[str, DataFrame]:
    """Attach KPIs, rules, potential and recommendation. ``baskets``: branch, items_list; ``items``: paid item features."""
    named = baskets
    if dict(baskets.dtypes)["items_list"] == "string":
        named = named.withColumn("items_list", S.parse_items(F.col("items_list")))
    else:
        tidy = F.transform("items_list", lambda i: F.regexp_replace(S.strip(F.lower(i)), r"\s+", " "))
        named = named.withColumn("items_list", F.filter(tidy, lambda i: i != ""))
    named = stage(named.select("branch", "items_list"), "growth_baskets")
    kpis = stage(G.merge_kpis(G.attach_kpis(named, target), G.revenue_share(items)), "growth_kpis")
    found = stage(G.association_rules(named, target, method), "growth_rules")
    potential = stage(G.growth_potential(kpis, found), "growth_potential")
    return {"branch_beverage_kpis": kpis.withColumn("explanation", text.attach_explanation()),
            "assoc_rules_by_branch": found.withColumn("explanation", text.rule_explanation()),
            "branch_growth_potential": potential.withColumn("explanation", text.potential_explanation()),
            "growth_recommendation": G.growth_recommendation(potential)}


def expansion(sources: Mapping[str, DataFrame], zones: Mapping[str, str], region_rules: Sequence[rules.RegionRule]) -> dict[str, DataFrame]:
    kpis = stage(SC.branch_kpis(sources), "branch_kpis")
    scores = stage(SC.feasibility_scores(kpis), "feasibility_scores")
    return {"branch_kpis": kpis.withColumn("explanation", text.kpi_explanation()),
            "feasibility_scores": scores.withColumn("explanation", text.feasibility_sentence()),
            "expansion_recommendation": SC.region_decision(scores, kpis, zones, region_rules)}


def forecast(monthly: DataFrame, anomaly_rules: Sequence[rules.AnomalyRule] = rules.ANOMALY_RULES,
             similar: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    rows = stage(FC.ensemble(monthly, anomaly_rules, similar), "demand_forecast_all")
    return {"demand_forecast_all": rows, "forecast_metadata": FC.run_metadata(rows)}


def save(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> str:
    """Store the results of one or more flows as one complete run; recommendations and metadata as JSON documents."""
    documents = {k: v for k, v in tables.items() if k.endswith(("_recommendation", "_metadata"))}
    return store.write_run(spark, root, {k: v for k, v in tables.items() if k not in documents}, documents)
