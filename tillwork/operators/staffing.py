"""Hourly staffing: supply from shifts, demand from delivery orders, targets, gaps and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, scalar as S
from .grouped import group_percentiles, top_per_group

SLOT = ["branch", "day_of_week", "hour"]


def shift_bounds(shifts: DataFrame) -> DataFrame:
    """Start and end of each shift; an end before the start lies on the next day."""
    start = F.try_to_timestamp(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "punch_in"))
    end = F.try_to_timestamp(F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), "punch_out"))
    return (shifts.withColumn("start_ts", start).withColumn("_end", end)
            .withColumn("end_ts", F.when(F.col("_end") < F.col("start_ts"), F.col("_end") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("_end")))
            .drop("_end"))


def hourly_supply(shifts: DataFrame) -> DataFrame:
    """Active employees per branch, date and clock hour touched by a valid shift; an end on the hour excludes that hour."""
    spans = shift_bounds(shifts.where("is_valid_shift"))
    first = F.date_trunc("hour", F.col("start_ts"))
    last = F.col("end_ts") - F.expr("INTERVAL 1 MICROSECOND")
    hours = F.when(F.col("end_ts") > first, F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
    slots = (spans.select("branch", "emp_id", F.col("date").alias("shift_date"), F.explode(hours).alias("at"))
             .select("branch", F.to_date("at").alias("date"), F.hour("at").alias("hour"), "emp_id", "shift_date").distinct())
    return (slots.groupBy("branch", "date", "hour")
            .agg(F.count_distinct("emp_id").alias("active_employees"), F.count(F.lit(1)).alias("active_shift_rows"))
            .select("branch", "date", S.day_name(F.col("date")).alias("day_of_week"), "hour", "active_employees", "active_shift_rows"))


def supply_profile(hourly: DataFrame) -> DataFrame:
    """Staffing of each observed (branch, weekday, hour) slot over its dates."""
    n = F.col("active_employees")
    return hourly.groupBy(*SLOT).agg(
        S.round_to(F.avg(n), 2).alias("avg_active_employees"), F.median(n).alias("median_active_employees"),
        F.min(n).alias("min_active_employees"), F.max(n).alias("max_active_employees"),
        F.count(F.lit(1)).alias("slot_observations"), F.count_distinct("date").alias("observed_days"))


def observation_window(shifts: DataFrame) -> Column:
    """Struct (start, end) of the dates of valid shifts as a scalar subquery."""
    return shifts.where("is_valid_shift").agg(F.struct(F.min("date").alias("start"), F.max("date").alias("end")).alias("v")).scalar()


def _in_window(window: Column) -> Column:
    ts = F.col("last_order")
    return (ts >= window.getField("start")) & (ts < F.date_add(window.getField("end"), 1))


def demand_shape(orders: DataFrame, slots: DataFrame, window: Column) -> DataFrame:
    """Weight of each staffed slot in its branch's delivery demand.

    The slot's share of all order rows of the branch, staffed slot or not, is blended with a uniform weight when the
    branch has few rows, capped in that case, and scaled to sum to one. A branch without rows gets weight 0.
    """
    base = slots.select(*SLOT).distinct()
    near = orders.where(_in_window(window)).join(base.select("branch").distinct(), "branch", "left_semi")
    per_slot = (near.select("branch", S.day_name(F.col("last_order")).alias("day_of_week"), F.hour("last_order").alias("hour"), "num_orders")
                .groupBy(*SLOT).agg(F.count(F.lit(1)).alias("support_rows"), F.sum("num_orders").cast("double").alias("slot_num_orders")))
    per_branch = per_slot.groupBy("branch").agg(
        F.sum("support_rows").alias("branch_total_customer_rows_in_overlap"),
        F.sum("slot_num_orders").alias("branch_total_num_orders_in_overlap"))
    counts = base.groupBy("branch").agg(F.count(F.lit(1)).alias("branch_staffed_slot_count"))
    zero = {"support_rows": 0, "slot_num_orders": 0.0, "branch_total_customer_rows_in_overlap": 0, "branch_total_num_orders_in_overlap": 0.0}
    df = base.join(per_slot, SLOT, "left").join(per_branch, "branch", "left").join(counts, "branch").na.fill(zero)
    rows = F.col("branch_total_customer_rows_in_overlap")
    strength = F.least(F.lit(1.0), rows / F.lit(float(rules.SHAPE_SUPPORT_ROWS)))
    uniform = F.lit(1.0) / F.col("branch_staffed_slot_count")
    share = F.try_divide(F.col("support_rows").cast("double"), rows.cast("double"))
    blended = strength * share + (1 - strength) * uniform
    capped = F.when(strength < 1, F.least(blended, uniform * rules.SHAPE_SPARSE_RATIO)).otherwise(blended)
    df = (df.withColumn("shape_support_strength", F.when(rows > 0, strength).otherwise(0.0))
          .withColumn("_w", F.when(rows > 0, capped).otherwise(0.0)))
    # Weights are summed as decimals: the sum does not depend on the order of rows.
    sums = df.groupBy("branch").agg(F.sum(F.col("_w").cast("decimal(20,15)")).cast("double").alias("_sum"))
    orders_share = F.try_divide(F.col("slot_num_orders"), F.col("branch_total_num_orders_in_overlap"))
    return (df.join(sums, "branch")
            .withColumn("shape_weight_rows", F.when(F.col("_sum") > 0, F.col("_w") / F.col("_sum")).otherwise(F.col("_w")))
            .withColumn("shape_weight_num_orders", F.coalesce(orders_share, F.lit(0.0)))
            .select(*SLOT, "support_rows", "slot_num_orders", "branch_total_customer_rows_in_overlap",
                    "branch_total_num_orders_in_overlap", "branch_staffed_slot_count", "shape_weight_rows",
                    "shape_support_strength", "shape_weight_num_orders"))


# Notes of the multipliers.
NOTE_DISAGREE = "avg_sales_menu and customer_orders profile counts disagree"
NOTE_PROFILE = "delivery share inferred because avg_sales_menu has no delivery row"
NOTE_GLOBAL = "delivery share inferred from global fallback"
NOTE_UPLIFT = "sales uplift applied for underrepresented proxy demand"
NOTE_MAX_UPLIFT = "max sales uplift applied because proxy demand is missing"


def demand_multipliers(menu: DataFrame, orders: DataFrame, monthly: DataFrame, branches: DataFrame, window: Column) -> DataFrame:
    """From delivery orders to all orders: delivery share by the best source, its spread, and the sales uplift.

    Share sources in order: the menu's delivery row, delivery customers over menu customers, the median of known shares.
    """
    delivery = F.col("channel") == "DELIVERY"
    per_menu = menu.groupBy("branch").agg(
        F.sum("customers").alias("avg_sales_total_customers"), F.max(F.when(delivery, F.col("customers"))).alias("avg_sales_delivery_customers"),
        F.max(F.when(delivery, F.col("customer_share_within_branch"))).alias("avg_sales_delivery_share"))
    per_order = orders.withColumn("_w", _in_window(window)).groupBy("branch").agg(
        F.count(F.lit(1)).alias("delivery_customer_profiles"), F.sum("num_orders").cast("double").alias("delivery_num_orders"),
        F.sum(F.when(F.col("_w"), F.col("num_orders"))).cast("double").alias("overlap_num_orders"))
    recent = monthly.groupBy("branch").agg(F.max("date").alias("recent_revenue_month"), F.max_by("revenue", "date").alias("recent_revenue"))
    df = (branches.select("branch").join(per_menu, "branch", "left").join(per_order, "branch", "left").join(recent, "branch", "left")
          .na.fill({"avg_sales_total_customers": 0.0, "avg_sales_delivery_customers": 0.0, "avg_sales_delivery_share": 0.0,
                    "delivery_customer_profiles": 0, "delivery_num_orders": 0.0, "overlap_num_orders": 0.0, "recent_revenue": 0.0}))
    df = df.withColumn("observed_profile_share", S.clamp_share(
        S.ratio(F.col("delivery_customer_profiles"), F.col("avg_sales_total_customers"))))
    totals = df.agg(F.struct(F.sum(S.money(F.col("recent_revenue"))).cast("double").alias("revenue"), F.sum("overlap_num_orders").alias("orders")).alias("v")).scalar()
    usual = group_percentiles(df.where("avg_sales_delivery_share > 0"), [], "avg_sales_delivery_share", {"share": 0.5}).scalar()
    df = df.withColumn("_t", totals)
    fallback = S.clamp_share(F.coalesce(usual, F.lit(rules.SHARE_MIN)))

    menu_share, seen = F.col("avg_sales_delivery_share"), F.col("observed_profile_share")
    clamped = S.clamp_share(menu_share)
    far = (seen > 0) & (F.abs(seen - clamped) / clamped > 1.0)

    def choice(base: Column, spread: float, source: str, confidence: str, note: str) -> Column:
        return F.struct(base.alias("base"), F.lit(spread).alias("spread"), F.lit(source).alias("source"),
                        F.lit(confidence).alias("confidence"), F.lit(note).alias("note"))

    pick = (F.when((menu_share > 0) & F.coalesce(far, F.lit(False)),
                   choice(clamped, rules.SPREAD_MEDIUM, "avg_sales_menu_delivery_share", "medium", NOTE_DISAGREE))
            .when(menu_share > 0, choice(clamped, rules.SPREAD_HIGH, "avg_sales_menu_delivery_share", "high", ""))
            .when(seen > 0, choice(S.clamp_share(seen), rules.SPREAD_LOW, "customer_orders_profile_share", "low", NOTE_PROFILE))
            .otherwise(choice(fallback, rules.SPREAD_LOW, "global_delivery_share_fallback", "low", NOTE_GLOBAL)))
    df = (df.withColumn("_p", pick)
          .withColumn("_low", S.clamp_share(F.col("_p.base") * (1 - F.col("_p.spread"))))
          .withColumn("_high", S.clamp_share(F.col("_p.base") * (1 + F.col("_p.spread"))))
          .withColumn("_rev", F.when(F.col("_t.revenue") > 0, F.col("recent_revenue") / F.col("_t.revenue")).otherwise(0.0))
          .withColumn("_proxy", F.when(F.col("_t.orders") > 0, F.col("overlap_num_orders") / F.col("_t.orders")).otherwise(0.0))
          .withColumn("_gap", F.coalesce(F.try_divide("_rev", "_proxy"), F.lit(1.0))))
    low = (F.col("_p.confidence") == "low") & (F.col("_rev") > 0)
    uplift = (F.when(low & (F.col("_proxy") > 0), F.least(F.lit(rules.UPLIFT_CAP), F.greatest(F.lit(1.0), F.sqrt("_gap"))))
              .when(low, F.lit(rules.UPLIFT_CAP)).otherwise(1.0))
    df = df.withColumn("_up", uplift)
    more = F.when(low & (F.col("_proxy") == 0), NOTE_MAX_UPLIFT).when(low & (F.col("_up") > 1), NOTE_UPLIFT)
    return df.select(
        "branch", "avg_sales_total_customers", "avg_sales_delivery_customers", "avg_sales_delivery_share", "delivery_customer_profiles",
        "delivery_num_orders", "observed_profile_share", F.col("_p.source").alias("share_source"), F.col("_p.confidence").alias("confidence"),
        F.concat_ws("; ", F.when(F.col("_p.note") != "", F.col("_p.note")), more).alias("note"), "recent_revenue_month", "recent_revenue",
        S.round_to("_rev", 6).alias("recent_revenue_share_staffed_branches"), S.round_to("_proxy", 6).alias("overlap_proxy_order_share"),
        S.round_to("_gap", 4).alias("sales_to_proxy_gap_ratio"), S.round_to("_up", 4).alias("sales_calibration_multiplier"),
        S.round_to("_low", 6).alias("delivery_share_low"), S.round_to("_p.base", 6).alias("delivery_share_base"),
        S.round_to("_high", 6).alias("delivery_share_high"), S.round_to(1 / F.col("_high") * F.col("_up"), 4).alias("multiplier_low_demand"),
        S.round_to(1 / F.col("_p.base") * F.col("_up"), 4).alias("multiplier_base_demand"),
        S.round_to(1 / F.col("_low") * F.col("_up"), 4).alias("multiplier_high_demand"))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The table unchanged; a query that reads it fails if a key occurs more than once.

    The check is part of the plan: a scalar subquery counts repeated keys, and a row only passes if there are none.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1))).scalar()
    fail = F.raise_error(F.lit(f"key ({', '.join(keys)}) is not unique")).cast("boolean")
    return df.where(F.when(repeated == 0, F.lit(True)).otherwise(fail))


def total_demand(shape: DataFrame, multipliers: DataFrame, check: bool = True) -> DataFrame:
    """Estimated delivery and total orders of each slot in the low, base and high case; ``check`` asks for one multiplier row per branch."""
    if check:
        multipliers = require_unique(multipliers, "branch")
    df = shape.join(multipliers, "branch", "left")
    delivered = F.col("branch_total_num_orders_in_overlap") * F.col("shape_weight_rows")
    df = df.withColumn("_d", delivered).withColumn("delivery_orders_est", S.round_to("_d", 4))
    for case in ("low", "base", "high"):
        df = df.withColumn(f"total_orders_est_{case}", S.round_to(F.col("_d") * F.col(f"multiplier_{case}_demand"), 4))
    return df.drop("_d")


GLOBAL = "__global__"
ALL_DAY = "all_day"


def productivity_targets(profile: DataFrame, demand: DataFrame) -> DataFrame:
    """Orders per employee to aim at, per (branch, shift), per branch and overall.

    The target of a level is the median of its positive slots inside the 1.5 IQR fence, at least the floor. Levels of a
    branch without positive slots, or with few at low confidence, have none; low confidence caps the target by the
    overall one. Percentiles of all levels come from counts of values in buckets, so no task holds the slots of all branches.
    """
    joined = profile.select(*SLOT, "avg_active_employees").join(demand.select(*SLOT, "total_orders_est_base", "confidence"), SLOT, "left")
    per_head = F.when(F.col("avg_active_employees") > 0,
                      F.coalesce("total_orders_est_base", F.lit(0.0)) / F.col("avg_active_employees")).otherwise(0.0)
    levels = F.array(
        F.struct(F.col("branch").alias("b"), S.hour_shift(F.col("hour")).alias("s"), F.lit("branch_shift").alias("l")),
        F.struct(F.col("branch").alias("b"), F.lit(ALL_DAY).alias("s"), F.lit("branch_all_day").alias("l")),
        F.struct(F.lit(GLOBAL).alias("b"), F.lit(ALL_DAY).alias("s"), F.lit("global").alias("l")))
    slots = joined.withColumn("v", per_head).select("v", F.inline(levels))
    key = ["b", "s", "l"]
    fence = (group_percentiles(slots, key, "v", {"med": 0.5, "_q1": 0.25, "_q3": 0.75}, {"_q1": 0.0, "_q3": 0.0}, "slot_count")
             .withColumn("_iqr", F.col("_q3") - F.col("_q1"))
             .withColumn("_from", F.greatest(F.lit(0.0), F.col("_q1") - 1.5 * F.col("_iqr")))
             .withColumn("_to", F.col("_q3") + 1.5 * F.col("_iqr")))
    inside = slots.where("v > 0").join(fence.select(*key, "_from", "_to"), key).where(F.col("v").between(F.col("_from"), F.col("_to")))
    middle = group_percentiles(inside, key, "v", {"m": 0.5})
    confidence = demand.groupBy("branch").agg(F.max("confidence").alias("confidence"))
    df = (fence.join(middle, key, "left").withColumn("target", F.greatest(F.coalesce("m", F.lit(rules.TARGET_FLOOR)), F.lit(rules.TARGET_FLOOR)))
          .join(confidence.withColumnRenamed("branch", "b"), "b", "left"))
    overall = df.where(F.col("l") == "global").agg(F.max("target")).scalar()
    low = (F.col("confidence") == "low") & (F.col("l") != "global")
    kept = (F.when((F.col("l") != "global") & (F.col("slot_count") == 0), None)
            .when(low & (F.col("slot_count") < rules.LOW_CONFIDENCE_MIN_SLOTS), None)
            .when(low, F.least(F.col("target"), overall * rules.LOW_CONFIDENCE_CAP)).otherwise(F.col("target")))
    return df.select(F.col("b").alias("branch"), F.col("s").alias("shift_bucket"), "slot_count",
                     S.round_to(F.coalesce("med", F.lit(0.0)), 4).alias("median_observed_orders_per_employee"),
                     S.round_to(kept, 4).alias("target_orders_per_employee"), F.col("l").alias("reference_level"), "confidence")


def required_staff(profile: DataFrame, demand: DataFrame, targets: DataFrame) -> DataFrame:
    """Required employees, gap to the average staffing and status of each slot.

    The target comes from the shift, else the branch, else all branches; a staffed slot needs at least one employee.
    """
    level = F.col("reference_level")
    shift = targets.where(level == "branch_shift").select("branch", "shift_bucket", F.col("target_orders_per_employee").alias("_ts"))
    branch = targets.where(level == "branch_all_day").select("branch", F.col("target_orders_per_employee").alias("_tb"))
    overall = targets.where(level == "global").agg(F.max("target_orders_per_employee")).scalar()
    measures = ["support_rows", "slot_num_orders", "branch_total_customer_rows_in_overlap", "branch_total_num_orders_in_overlap",
                "shape_weight_rows", "shape_weight_num_orders", "delivery_orders_est", "total_orders_est_low",
                "total_orders_est_base", "total_orders_est_high"]
    df = (profile.join(demand, SLOT, "left").na.fill(0, measures).withColumn("shift_bucket", S.hour_shift(F.col("hour")))
          .join(shift, ["branch", "shift_bucket"], "left").join(branch, "branch", "left")
          .withColumn("target_orders_per_employee", S.round_to(F.coalesce("_ts", "_tb", overall), 4)).drop("_ts", "_tb"))
    target = F.col("target_orders_per_employee")
    for case in ("low", "base", "high"):
        need = F.when((F.col(f"total_orders_est_{case}") > 0) & (target > 0), F.ceil(F.col(f"total_orders_est_{case}") / target)).otherwise(0)
        df = df.withColumn(f"required_employees_{case}", F.greatest(F.lit(1), need.cast("int")))
        df = df.withColumn(f"gap_{case}", S.round_to(F.col(f"required_employees_{case}") - F.col("avg_active_employees"), 2))
    status = F.when(F.col("gap_base") >= 1.0, "understaffed").when(F.col("gap_base") <= -1.0, "overstaffed").otherwise("balanced")
    return df.withColumn("status", status)


# Advice texts.
ADVICE_UNDER = "Increase staffing around the highest-gap slots before widening other shifts."
ADVICE_OVER = "Trim low-demand slots or reassign employees to busier periods."
ADVICE_BALANCED = "Current staffing looks balanced under the base-demand scenario."


def findings(gaps: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Counts, averages, worst slots each way and advice per branch. Ties go to the earlier weekday and hour."""
    def slots(status: str, sign: int) -> Column:
        row = F.struct((sign * F.col("gap_base")).alias("k"), S.weekday_number(F.col("day_of_week")).alias("d"), F.col("hour").alias("h"),
                       F.format_string("%s %02d:00", "day_of_week", "hour").alias("slot"), F.col("gap_base").alias("gap"))
        return F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == status, row))), 1, 3)

    def number(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    def listed(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.format_string("%s (gap %.2f)", x["slot"], x["gap"])), "; ")

    def worst(c: str, field: str, default) -> Column:
        return F.coalesce(F.get(c, F.lit(0))[field], F.lit(default))

    per_branch = gaps.groupBy("branch").agg(
        F.count(F.lit(1)).alias("analysis_slots"), number("understaffed").alias("understaffed_slots"), number("balanced").alias("balanced_slots"),
        number("overstaffed").alias("overstaffed_slots"),
        S.round_to(F.avg(F.col("avg_active_employees").cast("decimal(12,2)")).cast("double"), 2).alias("avg_active_employees_across_slots"),
        S.round_to(F.avg("required_employees_base"), 2).alias("avg_required_employees_base"),
        slots("understaffed", -1).alias("_u"), slots("overstaffed", 1).alias("_o"))
    advice = F.when(F.col("understaffed_slots") > 0, ADVICE_UNDER).when(F.col("overstaffed_slots") > 0, ADVICE_OVER).otherwise(ADVICE_BALANCED)
    trust = multipliers.select("branch", F.col("confidence").alias("demand_confidence"), "share_source")
    return per_branch.join(trust, "branch", "left").select(
        "branch", "demand_confidence", "share_source", "analysis_slots", "understaffed_slots", "balanced_slots", "overstaffed_slots",
        "avg_active_employees_across_slots", "avg_required_employees_base",
        worst("_u", "slot", "").alias("worst_understaffed_slot"), worst("_u", "gap", 0.0).alias("worst_understaffed_gap"),
        worst("_o", "slot", "").alias("worst_overstaffed_slot"), worst("_o", "gap", 0.0).alias("worst_overstaffed_gap"),
        listed("_u").alias("top_understaffed_slots"), listed("_o").alias("top_overstaffed_slots"), advice.alias("recommendation"))


def summary_view(gaps: DataFrame, found: DataFrame) -> DataFrame:
    def mean(c: str) -> Column:
        return S.round_to(F.avg(F.col(c).cast("decimal(12,2)")).cast("double"), 2)

    per_branch = gaps.groupBy("branch").agg(
        F.count(F.lit(1)).alias("staffed_slots"), mean("avg_active_employees").alias("avg_active_employees"),
        mean("required_employees_base").alias("avg_required_employees"), mean("gap_base").alias("avg_gap"),
        F.max("required_employees_base").alias("peak_required_employees"), S.round_to(F.max("gap_base"), 2).alias("peak_gap"))
    kept = found.select("branch", "demand_confidence", "understaffed_slots", "balanced_slots", "overstaffed_slots",
                        "worst_understaffed_slot", "worst_overstaffed_slot", "recommendation")
    return per_branch.join(kept, "branch", "left")


def top_gap_slots(gaps: DataFrame, n: int = 10) -> DataFrame:
    """The n slots of each branch with the largest gap in either direction."""
    order = [F.desc(F.abs("gap_base")), S.weekday_number(F.col("day_of_week")), F.col("hour")]
    return top_per_group(gaps, ["branch"], order, n, out=None).select(
        *SLOT, "avg_active_employees", "required_employees_base", "delivery_orders_est", "total_orders_est_base", "gap_base", "status")


def staffing_tables(shifts: DataFrame, menu: DataFrame, orders: DataFrame, monthly: DataFrame, stage=lambda df, name: df,
                    wanted: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The whole flow, or the ``wanted`` tables of it. ``stage`` may store the tables that several others read."""
    window = observation_window(shifts)
    made: dict[str, DataFrame] = {}

    def branches() -> DataFrame:
        return shifts.where("is_valid_shift AND branch IS NOT NULL").select("branch").distinct()

    build = {
        "staffing_supply_hourly": lambda: hourly_supply(shifts),
        "supply_profile": lambda: supply_profile(get("staffing_supply_hourly")),
        "delivery_demand_shape_hourly": lambda: demand_shape(orders, get("supply_profile"), window),
        "branch_demand_multipliers": lambda: demand_multipliers(menu, orders, monthly, branches(), window),
        "total_demand_est_hourly": lambda: total_demand(get("delivery_demand_shape_hourly"), get("branch_demand_multipliers")),
        "target_productivity_reference": lambda: productivity_targets(get("supply_profile"), get("total_demand_est_hourly")),
        "staffing_gap_hourly": lambda: required_staff(get("supply_profile"), get("total_demand_est_hourly"), get("target_productivity_reference")),
        "branch_staffing_findings": lambda: findings(get("staffing_gap_hourly"), get("branch_demand_multipliers")),
        "branch_summary_view": lambda: summary_view(get("staffing_gap_hourly"), get("branch_staffing_findings")),
        "top_gap_slots": lambda: top_gap_slots(get("staffing_gap_hourly")),
    }
    shared = {"supply_profile", "branch_demand_multipliers", "total_demand_est_hourly", "target_productivity_reference", "staffing_gap_hourly"}
    wanted = list(wanted or build)

    def get(name: str) -> DataFrame:
        if name not in made:
            df = build[name]()
            made[name] = stage(df, name) if name in shared and wanted != [name] else df
        return made[name]

    return {name: get(name) for name in wanted}
