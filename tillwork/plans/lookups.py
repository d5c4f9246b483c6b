"""Named, parameterised queries over the stored results.

A lookup is a row of VIEWS: the stored table it reads, the arguments it filters by, its order, its limit and the columns it shows.
Topics put a ``query_type`` in front of a view's name; overviews and pages are lists of views.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalar import weekday_number
from ..operators import growth as G, scoring as SC
from . import store

GAP = ("branch", "day_of_week", "hour", "avg_active_employees", "required_employees_base", "gap_base", "status", "explanation")
DAYTIME = (lambda: weekday_number(F.col("day_of_week")), lambda: F.col("hour"))
Test = Callable[..., Column]


@dataclass(frozen=True)
class View:
    """One selection: ``where`` maps an argument to a test of its value (left out where the argument is None and not required)."""

    table: str
    where: Mapping[str, Test] | None = None
    fixed: str | None = None
    order: Sequence[str | Callable[[], Column]] = ()
    limit: bool = False
    columns: Sequence[str] = ()
    document: bool = False
    make: Callable[..., DataFrame] | None = None


def _is(column: str) -> Test:
    return lambda v: F.col(column) == v


def _same_name(v: str) -> Column:
    return F.lower("branch") == v.lower()


def _scope(v: str) -> Column:
    kind = "overall" if v == "overall" else "branch_channel" if "|channel:" in v else v.split(":", 1)[0]
    return (F.col("scope_type") == kind) & (F.col("scope") == v)


def _rule_branch(v: str) -> Column:
    total = F.col("is_total").cast("boolean")
    return total if v == "ALL" else (F.col("branch") == v) & ~total


def _at_least(column: str) -> Test:
    return lambda v: F.col(column) >= v


# Names of topics and query types, stored tables and default limits.
VIEWS: dict[str, View] = {
    "forecast.all": View("demand_forecast_all", {"branch": _is("branch")}, order=("branch", "scenario", "forecast_period")),
    "forecast.point": View("demand_forecast_all", {"branch": _is("branch"), "scenario": _is("scenario"), "period": _is("forecast_period")}),
    "forecast.primary": View("demand_forecast_all", fixed="scenario = 'base' AND forecast_period = 1", order=("branch",)),
    "combos.best": View("combo_pairs", {"scope": _scope, "min_lift": _at_least("lift")}, order=("-lift", "-count_ab", "item_a", "item_b"), limit=True),
    "combos.scopes": View("combo_pairs", make=lambda df: df.select("scope").distinct(), order=("scope",)),
    "expansion.kpi": View("branch_kpis", {"branch": _same_name}),
    "expansion.all_kpis": View("branch_kpis", order=("branch",)),
    "expansion.feasibility": View("feasibility_scores", {"branch": _same_name}),
    "expansion.ranking": View("feasibility_scores", order=("-feasibility_score", "branch")),
    "expansion.recommendation": View("expansion_recommendation", document=True),
    "expansion.growth_summary": View("branch_kpis", make=lambda df, zones: SC.growth_summary(df, zones), order=("branch",)),
    "expansion.risk_summary": View("feasibility_scores", make=lambda df, zones: SC.risk_summary(df, zones), order=("branch",)),
    "expansion.feasibility_explanation": View("feasibility_scores", make=lambda df: SC.feasibility_explanation(df), order=("branch", "component")),
    "staffing.findings": View("branch_staffing_findings", {"branch": _is("branch")}),
    "staffing.all_findings": View("branch_staffing_findings", order=("branch",)),
    "staffing.gaps": View("staffing_gap_hourly", {"branch": _is("branch"), "day": _is("day_of_week")}, "status <> 'balanced'", DAYTIME, columns=GAP),
    "staffing.worst_gaps": View("staffing_gap_hourly", {"branch": _is("branch")}, "status = 'understaffed'", ("-gap_base", *DAYTIME), True, GAP),
    "staffing.top_gaps": View("top_gap_slots"),
    "staffing.summary": View("branch_summary_view", order=("branch",)),
    "growth.kpi": View("branch_beverage_kpis", {"branch": _is("branch")}),
    "growth.all_kpis": View("branch_beverage_kpis", order=("branch",)),
    "growth.underperforming": View("branch_beverage_kpis", make=lambda df, top_n: G.underperforming(df, top_n)),
    "growth.gap": View("branch_beverage_kpis", make=lambda df: G.gap_to_best(df), order=("-beverage_gap_to_best", "branch")),
    "growth.potential": View("branch_growth_potential", {"branch": _is("branch")}),
    "growth.ranking": View("branch_growth_potential", order=("potential_rank", "branch")),
    "growth.highest_potential": View("branch_growth_potential", make=lambda df, top_n: G.highest_potential(df, top_n)),
    "growth.rules": View("assoc_rules_by_branch", {"branch": _rule_branch, "min_lift": _at_least("lift")},
                         order=("-lift", "-confidence", "antecedents", "consequents"), limit=True),
    "growth.recommendation": View("growth_recommendation", document=True),
}
DEFAULTS: dict[str, dict] = {
    "combos.best": {"scope": "overall", "min_lift": 1.0, "top_n": 10}, "staffing.worst_gaps": {"top_n": 5}, "growth.rules": {"min_lift": 1.0, "top_n": 10},
    "growth.underperforming": {"top_n": 10}, "growth.highest_potential": {"top_n": 10}, "forecast.point": {"scenario": "base", "period": 1},
}
NEEDS_BRANCH = {"forecast.point", "expansion.kpi", "expansion.feasibility", "staffing.findings", "staffing.gaps", "staffing.worst_gaps", "growth.kpi", "growth.potential", "growth.rules"}
OVERVIEW = {"forecast": ("forecast.primary", {}), "top_combos": ("combos.best", {"top_n": 5}), "expansion_ranking": ("expansion.ranking", {}),
            "staffing_summary": ("staffing.summary", {}), "growth_ranking": ("growth.ranking", {})}
RECOMMENDATIONS = {"expansion": ("expansion.recommendation", {}), "growth": ("growth.recommendation", {}), "staffing_top_gaps": ("staffing.top_gaps", {}),
                   "top_combos": ("combos.best", {"top_n": 5})}
# Sections of a page: for all branches, and for one.
PAGES: dict[str, tuple[dict, dict]] = {
    "forecast": ({"data": ("forecast.all", {})}, {"data": ("forecast.all", {})}),
    "combo": ({"data": ("combos.best", {"top_n": 20})}, {"data": ("combos.best", {"top_n": 20})}),
    "expansion": ({"ranking": ("expansion.ranking", {}), "recommendation": ("expansion.recommendation", {})},
                  {"kpis": ("expansion.kpi", {}), "feasibility": ("expansion.feasibility", {})}),
    "staffing": ({"summary": ("staffing.summary", {}), "top_gaps": ("staffing.top_gaps", {})},
                 {"findings": ("staffing.findings", {}), "worst_gaps": ("staffing.worst_gaps", {"top_n": 10})}),
    "growth": ({"ranking": ("growth.ranking", {}), "recommendation": ("growth.recommendation", {})},
               {"kpis": ("growth.kpi", {}), "potential": ("growth.potential", {}), "rules": ("growth.rules", {})}),
}


def _order(key: str | Callable[[], Column]) -> Column:
    return key() if callable(key) else F.desc(key[1:]) if key.startswith("-") else F.asc(key)


def view(spark: SparkSession, root: str, name: str, **given) -> DataFrame:
    """Rows of one view; arguments it does not know are ignored, those it has no value for do not filter."""
    if name not in VIEWS:
        raise ValueError(f"unknown view '{name}'; known: {sorted(VIEWS)}")
    spec = VIEWS[name]
    args = {**DEFAULTS.get(name, {}), **{k: v for k, v in given.items() if v is not None}}
    if name in NEEDS_BRANCH and args.get("branch") is None:
        raise ValueError(f"'{name}' needs a branch")
    if name == "combos.best" and given.get("scope") is None and args.get("branch"):
        args["scope"] = f"branch:{args['branch']}"
    if spec.document:
        run_id = store.newest_run(spark, root)
        if run_id is None:
            raise FileNotFoundError(f"no complete run under {root}")
        return spark.read.json(store.table_path(root, run_id, spec.table))
    rows = store.read_table(spark, root, spec.table)
    for key, test in (spec.where or {}).items():
        if args.get(key) is not None:
            rows = rows.where(test(args[key]))
    rows = rows.where(spec.fixed) if spec.fixed else rows
    if spec.make is not None:
        rows = spec.make(rows, **{k: args[k] for k in ("zones", "top_n") if k in args and k in spec.make.__code__.co_varnames})
    rows = rows.orderBy(*map(_order, spec.order)) if spec.order else rows
    rows = rows.limit(args["top_n"]) if spec.limit else rows
    return rows.select(*spec.columns) if spec.columns else rows


def forecast(spark, root, branch: str | None = None, scenario: str = "base", period: int = 1, compare: bool = False) -> DataFrame:
    """The point of a branch, scenario and period (all rows of the branch if there is none); with ``compare`` the primary
    forecasts of all branches; without a branch everything."""
    if compare or branch is None:
        return view(spark, root, "forecast.primary" if compare else "forecast.all")
    point = view(spark, root, "forecast.point", branch=branch, scenario=scenario, period=period)
    return view(spark, root, "forecast.all", branch=branch) if point.isEmpty() else point


def _topic(topic: str, default: str):
    def lookup(spark, root, query_type: str = default, **args) -> DataFrame:
        return view(spark, root, f"{topic}.{query_type}", **args)

    return lookup


def _sections(spark, root, parts: Mapping[str, tuple[str, dict]], **given) -> DataFrame:
    """Small results one below the other as (section, position, body): body is the row as JSON, position its place from 0 in the section."""
    rows = []
    for section, (name, args) in parts.items():
        df = view(spark, root, name, **{**args, **given})
        order = [_order(k) for k in VIEWS[name].order] or [F.col(c) for c in df.columns[:1]]
        place = F.row_number().over(W.partitionBy(F.lit(section)).orderBy(*order)) - 1
        rows.append(df.select(F.lit(section).alias("section"), place.alias("position"), F.to_json(F.struct("*")).alias("body")))
    return reduce(DataFrame.unionByName, rows)


def page(spark, root, feature: str, branch: str | None = None) -> DataFrame:
    """Default selection of one topic, for all branches or for one."""
    if feature not in PAGES:
        raise ValueError(f"unknown feature '{feature}'")
    return _sections(spark, root, PAGES[feature][branch is not None], branch=branch)


LOOKUPS: dict[str, Callable[..., DataFrame]] = {
    "query_forecast": forecast, "query_combos": lambda spark, root, **a: view(spark, root, "combos.best", **a), "query_expansion": _topic("expansion", "ranking"),
    "query_staffing": _topic("staffing", "all_findings"), "query_growth": _topic("growth", "ranking"),
    "get_overview": lambda spark, root: _sections(spark, root, OVERVIEW), "get_all_recommendations": lambda spark, root: _sections(spark, root, RECOMMENDATIONS),
    "list_scopes": lambda spark, root: view(spark, root, "combos.scopes"), "page": page,
}


def run(spark: SparkSession, root: str, name: str, as_json: bool = False, **params) -> DataFrame:
    """Run a lookup by name; unknown names raise KeyError. ``as_json`` gives one JSON text per row."""
    if name not in LOOKUPS:
        raise KeyError(f"unknown query '{name}'; known: {sorted(LOOKUPS)}")
    rows = LOOKUPS[name](spark, root, **params)
    return rows.select(F.to_json(F.struct("*")).alias("body")) if as_json else rows
