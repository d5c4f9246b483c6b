"""The sentence columns of result rows as queries, and the SQL that writes the same sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import growth as G, scoring as SC
from ..session import stage
from . import catalog, oracle, star


def kpi_sentences(spark, d):
    return catalog._kpis(spark, d).select("branch", text.kpi_explanation().alias("explanation"))


def feasibility_sentences(spark, d):
    return stage(SC.feasibility_scores(catalog._kpis(spark, d)), "scores").select("branch", text.feasibility_sentence().alias("explanation"))


def findings_sentences(spark, d):
    return catalog._staffing(spark, d, "branch_staffing_findings").select("branch", text.findings_explanation().alias("explanation"))


def gap_sentences(spark, d):
    return catalog._staffing(spark, d, "staffing_gap_hourly").select("branch", "day_of_week", "hour", text.gap_explanation().alias("explanation"))


def attach_sentences(spark, d):
    kpis = G.merge_kpis(G.attach_kpis(catalog._growth_baskets(spark, d), catalog.is_target), G.revenue_share(catalog._growth_items(spark, d)))
    return kpis.select("branch", text.attach_explanation().alias("explanation"))


def potential_sentences(spark, d):
    return stage(catalog._potential(spark, d), "potential").select("branch", text.potential_explanation().alias("explanation"))


def rule_sentences(spark, d):
    return catalog.assoc_rules_top(spark, d).select("branch", "is_total", "antecedents", "consequents", text.rule_explanation().alias("explanation"))


def forecast_sentences(spark, d):
    """Explanation and notes of every forecast row."""
    return catalog._ensemble(spark, d).select("branch", "scenario", "forecast_period", "notes", "explanation")


def region_reasons(spark, d):
    """The regional decision's reasons, regional scores and the growth of every branch, a row for each."""
    kpis = catalog._kpis(spark, d)
    row = stage(SC.region_decision(stage(SC.feasibility_scores(kpis), "scores"), kpis, star.ZONES, star.REGION_RULES), "decision")
    none = F.lit(None).cast("double")
    reasons = row.select(F.lit("reason").alias("kind"), F.posexplode("reasoning").alias("_i", "what")).select(
        "kind", F.concat(F.col("_i").cast("string"), F.lit(" "), F.col("what")).alias("what"), none.alias("value"))
    scores = row.select(F.lit("region").alias("kind"), F.explode("region_scores").alias("what", "value"))
    growth = row.select(F.explode("growth_summary").alias("what", "g")).select(
        F.when(F.col("g.is_growing"), "growing").otherwise("not growing").alias("kind"), "what", F.col("g.growth_rate").alias("value"))
    return reasons.unionByName(scores).unionByName(growth)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    kpi_sentences, feasibility_sentences, findings_sentences, gap_sentences, attach_sentences, potential_sentences, rule_sentences, forecast_sentences, region_reasons)}


# ---------------------------------------------------------------- SQL

def _fixed(x: str, digits: int, comma: bool = False, sign: bool = False) -> str:
    """A number with so many digits, a half in its decimal notation away from zero (upper-case ROUND is left as it is)."""
    rounded = f"ROUND(CAST(CAST(abs({x}) AS VARCHAR) AS DECIMAL(38,14)), {digits})"
    shown = f"format('{{:,}}', CAST({rounded} AS BIGINT))" if comma else f"CAST(CAST({rounded} AS DECIMAL(38,{digits})) AS VARCHAR)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '{'+' if sign else ''}' END || {shown})"


def _pct(x: str, digits: int = 1) -> str:
    return f"({_fixed(f'(({x}) * 100)', digits)} || '%')"


def _short(x: str) -> str:
    return (f"(CASE WHEN abs({x}) >= 1e9 THEN {_fixed(f'({x} / 1e9)', 2)} || 'B' WHEN abs({x}) >= 1e6 THEN {_fixed(f'({x} / 1e6)', 0)} || 'M' "
            f"ELSE {_fixed(x, 0, True)} END)")


_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


def _title(x: str) -> str:
    return _TITLE.format(x)


def _direction(first: str, second: str, share: str) -> str:
    return f"'When a customer buys ' || {first} || ', there is a ' || {_pct(share, 0)} || ' chance they also buy ' || {second} || '.'"


_EXCLUDED = "CASE WHEN e.scenario = 'base' THEN 'excluded in this base scenario.' ELSE 'included here with 50% weight.' END"
BODIES: dict[str, str] = {
    "pair_sentences": f"""SELECT scope, item_a, item_b, item_a || ' + ' || item_b || ' show a ' || CASE WHEN lift0 >= 5 THEN 'very strong' WHEN lift0 >= 2 THEN 'strong' WHEN lift0 >= 1.2 THEN 'moderate'
            WHEN lift0 >= 1 THEN 'weak' ELSE 'negative (bought less together than expected)' END || ' association (lift=' || {_fixed('lift0', 1)} || ') ' ||
        CASE scope_type WHEN 'overall' THEN 'across all branches and channels' WHEN 'branch' THEN 'at ' || branch WHEN 'channel' THEN 'via ' || lower(channel) || ' orders'
            ELSE 'at ' || branch || ' via ' || lower(channel) || ' orders' END || '. ' || {_pct('support0')} || ' of orders in this scope contain both items. ' ||
        CASE WHEN ab0 > ba0 THEN {_direction('item_a', 'item_b', 'ab0')} ELSE {_direction('item_b', 'item_a', 'ba0')} END ||
        ' Based on ' || count_ab || ' co-occurrences out of ' || n_orders || ' orders — solid evidence.' AS explanation FROM pairs""",
    "kpi_sentences": f"""SELECT branch, branch || ' averages ' || {_fixed('avg_monthly_revenue', 0, True)} || ' LBP/month in revenue and is ' ||
        CASE WHEN g > 2 THEN 'rapidly growing' WHEN g > 0.5 THEN 'growing steadily' WHEN g > 0 THEN 'growing slowly' WHEN g > -0.5 THEN 'roughly flat' ELSE 'declining' END ||
        ' (growth rate ' || {_fixed('g', 2)} || '). Revenue is ' || CASE WHEN v > 0.8 THEN 'highly volatile' WHEN v > 0.4 THEN 'moderately volatile' ELSE 'stable' END ||
        ' (volatility=' || {_fixed('v', 2)} || '). Delivery share is ' || CASE WHEN coalesce(delivery_share, 0) <> 0 THEN {_pct('delivery_share')} ELSE 'negligible' END || '.' ||
        CASE WHEN is_partial_history OR n_months < 6 THEN ' Note: only ' || n_months || ' months of data — treat as indicative.' ELSE '' END AS explanation
        FROM (SELECT *, recent_growth_rate AS g, revenue_volatility AS v FROM bk)""",
    "feasibility_sentences": f"""SELECT branch, branch || ' region is ' || CASE score_tier WHEN 'High' THEN 'highly feasible for expansion' WHEN 'Medium' THEN 'moderately feasible for expansion'
        ELSE 'not recommended for near-term expansion' END || ' (score=' || {_fixed('feasibility_score', 4)} || ', tier=' || score_tier || '). Average monthly revenue is ' ||
        {_fixed('avg_monthly_revenue', 0, True)} || ' LBP with growth rate ' || {_fixed('recent_growth_rate', 2)} || '. Top drivers: ' || top_drivers || '.' AS explanation FROM fs""",
    "findings_sentences": f"""SELECT branch, branch || ' is ' || CASE WHEN u > o * 2 THEN 'significantly understaffed overall' WHEN u > o THEN 'somewhat understaffed overall'
        WHEN o > u * 2 THEN 'significantly overstaffed overall' WHEN o > u THEN 'somewhat overstaffed overall' ELSE 'roughly balanced' END || '. Across ' || analysis_slots || ' time slots: ' ||
        u || ' understaffed, ' || balanced_slots || ' balanced, ' || o || ' overstaffed. Average active employees: ' || {_fixed('avg_active_employees_across_slots', 1)} ||
        ', average required: ' || {_fixed('avg_required_employees_base', 1)} || '. Worst understaffed slot: ' || worst_understaffed_slot || ' (gap=' || worst_understaffed_gap ||
        '). Worst overstaffed slot: ' || worst_overstaffed_slot || ' (gap=' || worst_overstaffed_gap || '). Demand confidence: ' || demand_confidence || '.' AS explanation
        FROM (SELECT *, understaffed_slots AS u, overstaffed_slots AS o FROM found)""",
    "gap_sentences": f"""SELECT branch, day_of_week, hour, branch || ' on ' || day_of_week || ' at ' || printf('%02d', hour) || ':00 — ' || status || '. Active: ' || {_fixed('avg_active_employees', 1)} ||
        ', required: ' || {_fixed('required_employees_base::DOUBLE', 1)} || ' (gap=' || {_fixed('gap_base', 1, sign=True)} || '). Estimated orders: ' || {_fixed('total_orders_est_base', 1)} || ' total, ' ||
        {_fixed('delivery_orders_est', 1)} || ' delivery. ' || CASE status WHEN 'understaffed' THEN 'Need ' || {_fixed('abs(gap_base)', 1)} || ' more employees'
            WHEN 'overstaffed' THEN 'Could reduce by ' || {_fixed('abs(gap_base)', 1)} || ' employees' ELSE 'Staffing level is appropriate' END || '.' AS explanation FROM gaps""",
    "attach_sentences": f"""SELECT branch, branch || ' has a beverage attachment rate of ' || {_pct('r')} || ' (' || beverage_orders || '/' || total_orders || ' orders include beverages). This is ' ||
        CASE WHEN r >= best_branch_rate THEN 'the benchmark leader' WHEN beverage_gap_to_best < 0.05 THEN 'close to the best performer'
            WHEN beverage_gap_to_best < 0.10 THEN 'moderately below the best performer' ELSE 'significantly below the best performer' END ||
        ' (' || {_pct('best_branch_rate')} || '), with a gap of ' || {_pct('beverage_gap_to_best')} || '. Beverage revenue share: ' || {_pct('bev_revenue_share')} || '.' AS explanation
        FROM (SELECT *, beverage_attachment_rate AS r FROM kpi) LEFT JOIN rev USING (branch)""",
    "potential_sentences": f"""SELECT branch, branch || ' is ranked #' || rank() OVER (ORDER BY potential_score DESC) || ' for beverage growth potential (score=' || {_fixed('potential_score', 3)} || ', ' ||
        CASE WHEN potential_score >= 0.7 THEN 'high-priority' WHEN potential_score >= 0.3 THEN 'medium-priority' ELSE 'low-priority' END || '). Current attachment rate: ' ||
        {_pct('beverage_attachment_rate')} || ', gap to best: ' || {_pct('beverage_gap_to_best')} || '. Average association lift: ' || {_fixed('avg_lift0', 1)} ||
        '. Top recommended bundle: ' || top_bundle_rule || '.' AS explanation FROM pot""",
    "rule_sentences": f"""SELECT branch, is_total, antecedents, consequents, 'At ' || branch || ', customers who buy ' || antecedents || ' are ' || {_fixed('lift', 1)} || 'x more likely to also buy ' ||
        consequents || ' (' || CASE WHEN lift >= 10 THEN 'very strong' WHEN lift >= 3 THEN 'strong' WHEN lift >= 1.5 THEN 'moderate' ELSE 'weak' END || ' association). This pair appears in ' ||
        {_pct('support')} || ' of orders with ' || {_pct('confidence', 0)} || ' confidence.' AS explanation FROM top_rules""",
    "forecast_sentences": f"""SELECT e.branch, e.scenario, p AS forecast_period, concat_ws('; ', CASE WHEN n_all < most THEN 'is_partial_history=True — fewer months than other branches' END,
            CASE WHEN val < 0.5::DOUBLE * cmin THEN 'WARN: forecast below 0.5× historical min (' || {_fixed('cmin', 0, True)} || ')' END,
            CASE WHEN val > 2.0::DOUBLE * cmax THEN 'WARN: forecast above 2.0× historical max (' || {_fixed('cmax', 0, True)} || ')' END) AS notes,
        concat_ws(' ', 'Based on ' || n || CASE e.scenario WHEN 'base' THEN ' clean monthly data points (anomalous months excluded).' ELSE ' monthly data points (anomalous months included with reduced weight).' END,
            (SELECT string_agg(monthname(a.date) || CASE a.anomaly WHEN 'likely_partial_month' THEN ' was flagged as a likely partial month and is excluded from both scenarios.'
                WHEN 'potential_surge' THEN ' showed a potential surge and is ' || {_EXCLUDED} ELSE ' showed an unexplained spike and is ' || {_EXCLUDED} END, ' ' ORDER BY a.t)
                FROM an a WHERE a.branch = e.branch AND a.anomaly IS NOT NULL),
            'Estimators: Naive (last value repeated) = ' || {_short('naive')} || '; WMA-3 (weighted avg of last 3 months) = ' || {_short('wma3')} || '; Linear OLS (trend extrapolation) = ' || {_short('linear')} || '.',
            'The forecast (' || {_short('val')} || ') is the weighted median of these 3 estimators.',
            'Confidence band [' || {_short('lo')} || ', ' || {_short('hi')} || '] is built from the estimator spread (p25-p75) widened by capped volatility (' || {_fixed('vol', 2)} || ' capped to ' || {_fixed('cap', 2)} ||
                '). Band width = ' || {_fixed('((hi - lo) / val * 100)', 0)} || '% of forecast.',
            'Stability score ' || least(100, sq + sv + sa + sn) || '/100 (' || CASE WHEN sq + sv + sa + sn >= 60 THEN 'stable' WHEN sq + sv + sa + sn >= 30 THEN 'cautious' ELSE 'unstable' END ||
                '): data quantity ' || sq || '/25, volatility ' || sv || '/25, estimator agreement ' || sa || '/25 (disagreement=' || {_pct('dis', 0)} || '), anomaly ' || sn || '/25.',
            CASE WHEN p = 1 THEN 'This is the primary 1-month-ahead forecast — the most credible output.'
                ELSE 'This is a period-' || p || ' extension (low confidence). Use for directional awareness only, not firm planning.' END) AS explanation
        FROM en3 e JOIN (SELECT branch, count(*) AS n_all, max(count(*)) OVER () AS most, min(y) FILTER (WHERE anomaly IS NULL) AS cmin, max(y) FILTER (WHERE anomaly IS NULL) AS cmax
            FROM an GROUP BY branch) f ON f.branch = e.branch""",
    "region_reasons": f"""WITH dec AS ({oracle.BODIES['region_decision']}), gr AS (SELECT branch, round(recent_growth_rate, 6) AS rate, recent_growth_rate > 0 AS up FROM rk),
        zone AS (SELECT CASE recommended_region WHEN 'North' THEN 'north' WHEN 'South' THEN 'south' ELSE 'east' END AS region,
            CASE recommended_region WHEN 'North' THEN 'EUROPE' WHEN 'South' THEN 'AFRICA' ELSE (SELECT branch FROM fs WHERE region = 'east' ORDER BY feasibility_score DESC, branch LIMIT 1) END AS own FROM dec),
        r0 AS (SELECT recommended_region || ' has the ' || CASE WHEN region = (SELECT region FROM rs ORDER BY region_score DESC, region LIMIT 1) THEN 'highest' ELSE 'strongest-growing' END ||
            ' regional score (' || (SELECT {_fixed('region_score', 4)} FROM rs WHERE rs.region = zone.region) || ').' || coalesce(' ' || warning, '') AS what FROM dec, zone),
        r1 AS (SELECT 'Sales in ' || {_title('own')} || ' are INCREASING (growth rate: ' || {_fixed('rate', 4, sign=True)} || '). ' || CASE WHEN recommended_region = 'East' THEN 'Increasing demand in East supports expansion.'
            ELSE 'Positive growth trend strongly supports opening a new branch in ' || recommended_region || ' — replicating the ' || {_title('own')} || ' branch profile.' END AS what
            FROM dec, zone JOIN gr ON gr.branch = own WHERE rate > 0),
        r2 AS (SELECT 'Best-scored branch overall: ' || {_title('branch')} || ' (score=' || {_fixed('feasibility_score', 4)} || ', tier=' || score_tier || ').' AS what FROM fs ORDER BY feasibility_score DESC, branch LIMIT 1),
        r3 AS (SELECT 'Strongest growth branch: ' || {_title('branch')} || ' (growth_rate=' || {_fixed('rate', 4, sign=True)} || ').' AS what FROM gr ORDER BY rate DESC, branch LIMIT 1)
        SELECT 'reason' AS kind, (row_number() OVER (ORDER BY i) - 1) || ' ' || what AS what, CAST(NULL AS DOUBLE) AS value FROM (
            SELECT 0 AS i, what FROM r0 UNION ALL SELECT 1, what FROM r1 UNION ALL SELECT 2, what FROM r2 UNION ALL SELECT 3, what FROM r3)
        UNION ALL SELECT 'region', region, region_score FROM rs
        UNION ALL SELECT CASE WHEN up THEN 'growing' ELSE 'not growing' END, branch, rate FROM gr""",
}


def _merged(body: str) -> str:
    """A statement that brings its own WITH joins its parts in front of it."""
    sql = oracle.with_parts(body)
    first, own = sql.rfind("\nWITH "), body.startswith("WITH ")
    return sql[:first] + ", " + sql[first + 6:] if own and first >= 0 else sql


SQL: dict[str, str] = {name: oracle.half_even(_merged(body)) for name, body in BODIES.items()}
