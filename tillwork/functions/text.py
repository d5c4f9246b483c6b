"""Sentence columns for result rows, built with native format functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASE = "base"
CURRENCY = "LBP"  # fixed value: unit named in the KPI sentences, an argument of their builders


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c.cast("double") * 100)


def short_number(c: Column) -> Column:
    """1.23B, 45M or 12,345."""
    size = F.abs(c)
    return (F.when(size >= 1e9, F.format_string("%.2fB", c / 1e9)).when(size >= 1e6, F.format_string("%.0fM", c / 1e6))
            .otherwise(F.format_string("%,.0f", c)))


# The sentence formats, labels and label limits below are fixed values.

def pair_explanation() -> Column:
    """For rows of the pair table."""
    lift, ab, ba = F.col("lift"), F.col("confidence_ab"), F.col("confidence_ba")
    place = (F.when(F.col("scope_type") == "overall", "across all branches and channels")
             .when(F.col("scope_type") == "branch", F.concat(F.lit("at "), F.col("branch")))
             .when(F.col("scope_type") == "channel", F.concat(F.lit("via "), F.lower("channel"), F.lit(" orders")))
             .otherwise(F.concat(F.lit("at "), F.col("branch"), F.lit(" via "), F.lower("channel"), F.lit(" orders"))))
    strength = (F.when(lift >= 5.0, "very strong").when(lift >= 2.0, "strong").when(lift >= 1.2, "moderate").when(lift >= 1.0, "weak")
                .otherwise("negative (bought less together than expected)"))

    def direction(first: str, second: str, share: Column) -> Column:
        return F.format_string("When a customer buys %s, there is a %s chance they also buy %s.", F.col(first), percent(share, 0), F.col(second))

    n = F.col("count_ab")
    caveat = (F.when(n < 5, F.format_string(" Caution: only %d co-occurrences — treat as indicative only.", n))
              .when(n < 10, F.format_string(" Based on %d co-occurrences — moderate evidence.", n))
              .otherwise(F.format_string(" Based on %d co-occurrences out of %d orders — solid evidence.", n, F.col("n_orders"))))
    return F.concat(
        F.format_string("%s + %s show a %s association (lift=%.1f) %s. ", F.col("item_a"), F.col("item_b"), strength, lift, place),
        percent(F.col("support")), F.lit(" of orders in this scope contain both items. "),
        F.when(ab > ba, direction("item_a", "item_b", ab)).otherwise(direction("item_b", "item_a", ba)), caveat)


def kpi_explanation(currency: str = CURRENCY) -> Column:
    growth, vol, months = F.col("recent_growth_rate"), F.col("revenue_volatility"), F.col("n_months")
    trend = (F.when(growth > 2.0, "rapidly growing").when(growth > 0.5, "growing steadily").when(growth > 0, "growing slowly")
             .when(growth > -0.5, "roughly flat").otherwise("declining"))
    swing = F.when(vol > 0.8, "highly volatile").when(vol > 0.4, "moderately volatile").otherwise("stable")
    share = F.col("delivery_share")
    delivered = F.when(F.coalesce(share, F.lit(0.0)) != 0, percent(share)).otherwise("negligible")
    caveat = F.when(F.col("is_partial_history") | (months < 6),
                    F.format_string(" Note: only %d months of data — treat as indicative.", months)).otherwise("")
    return F.concat(
        F.format_string(f"%s averages %,.0f {currency}/month in revenue and is %s (growth rate %.2f). ", F.col("branch"),
                        F.col("avg_monthly_revenue"), trend, growth),
        F.format_string("Revenue is %s (volatility=%.2f). Delivery share is %s.", swing, vol, delivered), caveat)


def feasibility_sentence(currency: str = CURRENCY) -> Column:
    outlook = (F.when(F.col("score_tier") == "High", "highly feasible for expansion")
               .when(F.col("score_tier") == "Medium", "moderately feasible for expansion")
               .otherwise("not recommended for near-term expansion"))
    return F.format_string(
        f"%s region is %s (score=%.4f, tier=%s). Average monthly revenue is %,.0f {currency} with growth rate %.2f. Top drivers: %s.",
        F.col("branch"), outlook, F.col("feasibility_score"), F.col("score_tier"), F.col("avg_monthly_revenue"),
        F.col("recent_growth_rate"), F.col("top_drivers"))


def region_reason(title: str, highest: Column, score: Column, warning: str | None) -> Column:
    """Why the region of a rule was chosen: by its score, or by the growth of its own branch."""
    return F.concat_ws(" ", F.format_string("%s has the %s regional score (%s).", F.lit(title), F.when(highest, "highest").otherwise("strongest-growing"),
                                            F.coalesce(F.format_string("%.4f", score), F.lit("N/A"))), F.lit(warning))


def growth_reason(title: str, branch: Column, rate: Column, own_branch: bool) -> Column:
    """That sales of the region's branch rise; NULL where they do not. ``own_branch``: the rule names the branch to replicate."""
    supports = (F.format_string("Positive growth trend strongly supports opening a new branch in %s — replicating the %s branch profile.", F.lit(title), F.initcap(branch))
                if own_branch else F.format_string("Increasing demand in %s supports expansion.", F.lit(title)))
    sales = F.format_string("Sales in %s are INCREASING (growth rate: %+.4f).", F.initcap(branch), rate)
    return F.when(rate > 0, F.concat_ws(" ", sales, supports))


def best_reason(branch: Column, score: Column, tier: Column) -> Column:
    return F.format_string("Best-scored branch overall: %s (score=%.4f, tier=%s).", F.initcap(branch), score, tier)


def strongest_reason(branch: Column, rate: Column) -> Column:
    return F.format_string("Strongest growth branch: %s (growth_rate=%+.4f).", F.initcap(branch), rate)


def sales_statement(rate: Column, change: Column) -> Column:
    return F.format_string("Sales in %s are %s (growth rate: %+.4f, %+.1f%% first-to-last).", F.initcap("branch"),
                           F.when(rate > 0, "INCREASING").otherwise("DECLINING or FLAT"), rate, change * 100)


def risk_statement(level: Column, stability: Column) -> Column:
    return F.format_string("%s has %s revenue risk (volatility CV: %.4f, stability: %.4f).", F.initcap("branch"), F.lower(level), "revenue_volatility", stability)


def findings_explanation() -> Column:
    under, over = F.col("understaffed_slots"), F.col("overstaffed_slots")
    state = (F.when(under > over * 2, "significantly understaffed overall").when(under > over, "somewhat understaffed overall")
             .when(over > under * 2, "significantly overstaffed overall").when(over > under, "somewhat overstaffed overall")
             .otherwise("roughly balanced"))
    return F.format_string(
        "%s is %s. Across %d time slots: %d understaffed, %d balanced, %d overstaffed. Average active employees: %.1f, "
        "average required: %.1f. Worst understaffed slot: %s (gap=%s). Worst overstaffed slot: %s (gap=%s). Demand confidence: %s.",
        F.col("branch"), state, F.col("analysis_slots"), under, F.col("balanced_slots"), over,
        F.col("avg_active_employees_across_slots"), F.col("avg_required_employees_base"), F.col("worst_understaffed_slot"),
        F.col("worst_understaffed_gap").cast("string"), F.col("worst_overstaffed_slot"),
        F.col("worst_overstaffed_gap").cast("string"), F.col("demand_confidence"))


def gap_explanation() -> Column:
    gap, status = F.col("gap_base"), F.col("status")
    action = (F.when(status == "understaffed", F.format_string("Need %.1f more employees", F.abs(gap)))
              .when(status == "overstaffed", F.format_string("Could reduce by %.1f employees", F.abs(gap)))
              .otherwise("Staffing level is appropriate"))
    return F.format_string(
        "%s on %s at %02d:00 — %s. Active: %.1f, required: %.1f (gap=%+.1f). Estimated orders: %.1f total, %.1f delivery. %s.",
        F.col("branch"), F.col("day_of_week"), F.col("hour"), status, F.col("avg_active_employees").cast("double"),
        F.col("required_employees_base").cast("double"), gap, F.col("total_orders_est_base"), F.col("delivery_orders_est"), action)


def attach_explanation() -> Column:
    rate, best, gap = F.col("beverage_attachment_rate"), F.col("best_branch_rate"), F.col("beverage_gap_to_best")
    standing = (F.when(rate >= best, "the benchmark leader").when(gap < 0.05, "close to the best performer")
                .when(gap < 0.10, "moderately below the best performer").otherwise("significantly below the best performer"))
    return F.concat(
        F.format_string("%s has a beverage attachment rate of %s (%d/%d orders include beverages). ", F.col("branch"), percent(rate),
                        F.col("beverage_orders"), F.col("total_orders")),
        F.format_string("This is %s (%s), with a gap of %s. ", standing, percent(best), percent(gap)),
        F.format_string("Beverage revenue share: %s.", percent(F.col("bev_revenue_share"))))


def potential_explanation() -> Column:
    score = F.col("potential_score")
    priority = F.when(score >= 0.7, "high-priority").when(score >= 0.3, "medium-priority").otherwise("low-priority")
    return F.concat(
        F.format_string("%s is ranked #%d for beverage growth potential (score=%.3f, %s). ", F.col("branch"), F.col("potential_rank"), score, priority),
        F.format_string("Current attachment rate: %s, gap to best: %s. ", percent(F.col("beverage_attachment_rate")), percent(F.col("beverage_gap_to_best"))),
        F.format_string("Average association lift: %.1f. Top recommended bundle: %s.", F.col("avg_lift"), F.col("top_bundle_rule")))


def rule_explanation() -> Column:
    lift = F.col("lift")
    strength = F.when(lift >= 10, "very strong").when(lift >= 3, "strong").when(lift >= 1.5, "moderate").otherwise("weak")
    return F.concat(
        F.format_string("At %s, customers who buy %s are %.1fx more likely to also buy %s (%s association). ", F.col("branch"),
                        F.col("antecedents"), lift, F.col("consequents"), strength),
        F.format_string("This pair appears in %s of orders with %s confidence.", percent(F.col("support")), percent(F.col("confidence"), 0)))


def forecast_explanation() -> Column:
    """For the working columns of the ensemble: data basis, anomalies, estimators, choice, band, stability, caveat."""
    base = F.col("scenario") == BASE
    basis = F.when(base, F.format_string("Based on %d clean monthly data points (anomalous months excluded).", F.col("n"))).otherwise(
        F.format_string("Based on %d monthly data points (anomalous months included with reduced weight).", F.col("n")))

    def flag_text(f: Column) -> Column:
        name = F.date_format(F.make_date((F.floor(f["t"] / 12)).cast("int"), (F.pmod(f["t"], F.lit(12)) + 1).cast("int"), F.lit(1)), "MMMM")
        use = F.when(base, "excluded in this base scenario.").otherwise("included here with 50% weight.")
        return (F.when(f["anomaly"] == "likely_partial_month", F.concat(
                    name, F.lit(" was flagged as a likely partial month and is excluded from both scenarios.")))
                .when(f["anomaly"] == "potential_surge", F.concat(name, F.lit(" showed a potential surge and is "), use))
                .otherwise(F.concat(name, F.lit(" showed an unexplained spike and is "), use)))

    similar = F.when(F.col("similar").isNotNull(), F.concat(
        F.lit("; Similarity fallback (growth transferred from the reference branch, weighted at 0.5x) = "), short_number(F.col("similar"))))
    made = F.concat(
        F.lit("Estimators: Naive (last value repeated) = "), short_number(F.col("naive")),
        F.lit("; WMA-3 (weighted avg of last 3 months) = "), short_number(F.col("wma3")),
        F.lit("; Linear OLS (trend extrapolation) = "), short_number(F.col("linear")), F.coalesce(similar, F.lit("")), F.lit("."))
    choice = F.format_string("The forecast (%s) is the weighted median of these %d estimators.", short_number(F.col("value")), F.size("_vals"))
    band = F.concat(F.lit("Confidence band ["), short_number(F.col("low")), F.lit(", "), short_number(F.col("high")), F.lit("]"))
    width = F.when(F.col("value") > 0, F.format_string(
        " is built from the estimator spread (p25-p75) widened by capped volatility (%.2f capped to %.2f). Band width = %.0f%% of forecast.",
        F.col("vol"), F.col("capped"), (F.col("high") - F.col("low")) / F.col("value") * 100)).otherwise(".")
    stability = F.format_string(
        "Stability score %d/100 (%s): data quantity %d/25, volatility %d/25, estimator agreement %d/25 (disagreement=%s), anomaly %d/25.",
        F.col("score"), F.col("label"), F.col("s_qty"), F.col("s_vol"), F.col("s_agree"), percent(F.col("disagreement"), 0), F.col("s_anom"))
    caveat = F.when(F.col("p") == 1, "This is the primary 1-month-ahead forecast — the most credible output.").otherwise(F.format_string(
        "This is a period-%d extension (low confidence). Use for directional awareness only, not firm planning.", F.col("p")))
    return F.concat_ws(" ", basis, F.transform("flags", flag_text), made, choice, F.concat(band, width), stability, caveat)
