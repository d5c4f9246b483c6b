"""Named queries that run the operators over the star-schema tables in their retail roles (see :mod:`star`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules, scalar as S, text
from ..operators import baskets as B, dims, features, forecast as FC, growth as G, grouped, scoring as SC, staffing as ST, tables as T
from ..session import stage
from ..sources import lines as L, reports as R
from . import flows, star

Query = Callable[[SparkSession, str], DataFrame]
MIN_SUPPORT, MIN_COUNT = 0.001, 10


def is_target(item: Column) -> Column:
    return S.is_target(item, star.KEYWORDS, star.EXCLUSIONS)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: S.round_to(c, digits) for c in columns})


# ---------------------------------------------------------------- pairs

def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return stage(B.order_baskets(star.lines(spark, d)), "order_baskets")


def _pairs(spark: SparkSession, d: str, scopes: str = "all") -> DataFrame:
    return B.combo_pairs(_baskets(spark, d), MIN_SUPPORT, MIN_COUNT, scopes)


def _metrics(df: DataFrame) -> DataFrame:
    return _rounded(df, 6, "support", "confidence_ab", "confidence_ba", "lift")


def pairs_overall(spark, d):
    return _metrics(_pairs(spark, d, "overall")).drop("branch", "channel")


def pairs_four_scopes(spark, d):
    return _metrics(_pairs(spark, d))


def pairs_top_overall(spark, d):
    return _metrics(B.top_overall(_pairs(spark, d, "overall"), 20, "support", MIN_COUNT))


def pairs_top_per_branch(spark, d):
    return _metrics(B.top_per_scope(_pairs(spark, d), "branch", None, 10, "count_ab"))


def pairs_top_per_channel(spark, d):
    return _metrics(B.top_per_scope(_pairs(spark, d), "channel", None, 10, "count_ab"))


def pairs_with_item(spark, d):
    return _metrics(B.pairs_with_item(_pairs(spark, d, "overall"), "anvil", top=25, rank_by="count_ab", hint=False))


def pairs_similar_items(spark, d):
    return B.similar_items(_pairs(spark, d, "overall"), "larger gear")


def pair_checks(spark, d):
    baskets = _baskets(spark, d)
    return B.pair_checks(stage(B.combo_pairs(baskets, MIN_SUPPORT, MIN_COUNT), "pairs"), baskets)


def pair_sentences(spark, d):
    df = _pairs(spark, d)
    return df.select("scope", "item_a", "item_b", text.pair_explanation().alias("explanation"))


def order_baskets(spark, d):
    return B.order_baskets(star.lines(spark, d)).withColumn("items_set", F.array_join("items_set", "|"))


def channel_infer(spark, d):
    lines = star.lines(spark, d).drop("channel")
    return B.infer_channel(lines, "hot anvil").groupBy("branch", "channel").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("order_id").alias("n_orders"))


# ---------------------------------------------------------------- cleaned tables, dimensions, features

def _items(spark, d):
    return T.tag_items(star.items_by_group(spark, d))


def channel_kpis(spark, d):
    return _rounded(T.channel_shares(star.channel_sales(spark, d)), 4, "avg_per_customer")


def _beverage_items(spark, d):
    """Items whose division text is made of their own words, so that the category patterns apply."""
    return T.tag_items(star.items_by_group(spark, d).withColumn("division", F.replace(F.replace(
        F.concat_ws(" ", "division", "item"), F.lit("hot"), F.lit("hot coffee")), F.lit("cold"), F.lit("iced coffee"))))


def dim_item_beverages(spark, d):
    return dims.dim_item(_beverage_items(spark, d), ["branch", "division", "group"])


def beverage_features(spark, d):
    """The features that tell beverages from other items: each branch's share of sales, and its items by opportunity flag."""
    items = stage(_beverage_items(spark, d), "items")
    share = features.branch_month(star.monthly_sales(spark, d), None, items).select(F.lit("beverage_share").alias("feature"), "branch", F.col("beverage_share").alias("value")).distinct()
    flags = features.branch_item(items).groupBy("branch", "beverage_opportunity_flag").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return share.unionByName(flags.select(F.concat(F.lit("opportunity "), F.col("beverage_opportunity_flag").cast("string")).alias("feature"), "branch", "value"))


def pairs_output_order(spark, d):
    """The place of each row in the order the ranked answer comes in."""
    return _metrics(B.top_overall(_pairs(spark, d, "overall"), 20, "support", MIN_COUNT)).select(
        "item_a", "item_b", F.monotonically_increasing_id().alias("position"))


def item_category(spark, d):
    return _beverage_items(spark, d).groupBy("category", "is_modifier").agg(
        F.count(F.lit(1)).alias("n"), F.sum(S.money(F.col("amount"))).cast("double").alias("amount"))


def item_shares_ranks(spark, d):
    return T.rank_items(stage(_items(spark, d), "items"))


def dim_branch(spark, d):
    return dims.dim_branch(star.channel_sales(spark, d), star.monthly_sales(spark, d), star.shifts(spark, d))


def dim_item(spark, d):
    return dims.dim_item(_items(spark, d), ["branch", "division", "group"])


def reconcile_sources(spark, d):
    items = _items(spark, d)
    return dims.reconcile(dims.source_totals(star.monthly_sales(spark, d), star.channel_sales(spark, d), items))


def branch_month_features(spark, d):
    return features.branch_month(star.monthly_sales(spark, d), star.channel_sales(spark, d), _items(spark, d))


def partial_history(spark, d):
    return T.flag_partial_history(star.monthly_sales(spark, d))


def item_features(spark, d):
    return features.branch_item(stage(_items(spark, d), "items"))


def customer_rfm(spark, d):
    return T.derive_customers(star.customer_orders(spark, d))


def customer_segments(spark, d):
    customers = stage(T.derive_customers(star.customer_orders(spark, d)), "customers")
    return features.customer_delivery(customers).select("branch", "customer", "phone", "total", "num_orders", "value_segment")


def segment_limits(spark, d):
    customers = T.derive_customers(star.customer_orders(spark, d)).where(~F.col("is_zero_value_customer"))
    return _rounded(grouped.group_percentiles(customers, ["branch"], "total", {"q33": 0.33, "q66": 0.66, "median": 0.5}), 4,
                    "q33", "q66", "median")


def _shifts(spark, d):
    return T.flag_shifts(star.shifts(spark, d))


def shift_flags(spark, d):
    return _shifts(spark, d)


def shift_features(spark, d):
    return features.branch_shift(_shifts(spark, d))


def forward_fill(spark, d):
    turns = star.table(spark, d, "conversations")
    df = T.carry_last(turns, ["conv_id"], ["turn"], F.col("role") == "user", F.col("text"), "last_user_text")
    return df.select("conv_id", "turn", "role", F.md5("last_user_text").alias("last_user_md5"))


# ---------------------------------------------------------------- staffing

def _staffing(spark, d, name: str) -> DataFrame:
    shifts = _shifts(spark, d)
    menu = T.channel_shares(star.store_menu(spark, d))
    return ST.staffing_tables(shifts, menu, star.delivery_orders(spark, d), star.store_months(spark, d), stage, [name])[name]


def supply_hourly(spark, d):
    return ST.hourly_supply(_shifts(spark, d))


def supply_profile(spark, d):
    return ST.supply_profile(ST.hourly_supply(_shifts(spark, d)))


def demand_shape(spark, d):
    return _rounded(_staffing(spark, d, "delivery_demand_shape_hourly"), 8, "shape_weight_rows", "shape_support_strength",
                    "shape_weight_num_orders")


def demand_multipliers(spark, d):
    return _rounded(_staffing(spark, d, "branch_demand_multipliers"), 8, "observed_profile_share")


def demand_total(spark, d):
    return _staffing(spark, d, "total_demand_est_hourly").select(
        *ST.SLOT, "delivery_orders_est", "total_orders_est_low", "total_orders_est_base", "total_orders_est_high")


def productivity_targets(spark, d):
    return _staffing(spark, d, "target_productivity_reference")


GAP_COLUMNS = [*ST.SLOT, "shift_bucket", "avg_active_employees", "target_orders_per_employee", "required_employees_low",
               "required_employees_base", "required_employees_high", "gap_low", "gap_base", "gap_high", "status"]


def staffing_gap(spark, d):
    return _staffing(spark, d, "staffing_gap_hourly").select(*GAP_COLUMNS)


def staffing_findings(spark, d):
    return _staffing(spark, d, "branch_staffing_findings")


def staffing_summary(spark, d):
    return _staffing(spark, d, "branch_summary_view")


def top_gap_slots(spark, d):
    return _staffing(spark, d, "top_gap_slots")


# ---------------------------------------------------------------- growth

def _growth_baskets(spark, d):
    return stage(B.order_baskets(star.lines(spark, d)).select("branch", F.col("items_set").alias("items_list")), "growth_baskets")


def attach_kpis(spark, d, baskets=None):
    return G.attach_kpis(baskets or _growth_baskets(spark, d), is_target)


def attach_revenue_share(spark, d):
    return G.revenue_share(_growth_items(spark, d))


def _growth_items(spark, d):
    """Item rows whose category comes from the item classifier."""
    kind = S.keyword_class(F.col("item"), star.KEYWORDS, star.EXCLUSIONS)
    category = F.when(kind == "coffee", "coffee_hot").when(kind == "milkshake", "milkshake").otherwise("core_food")
    return star.items_by_group(spark, d).withColumn("category", category)


def assoc_rules_pairs(spark, d):
    return G.pair_rules(_growth_baskets(spark, d), is_target, None, least=3)


def assoc_rules_top(spark, d, baskets=None):
    return G.association_rules(baskets or _growth_baskets(spark, d), is_target, "pairs", top_k=10)


def assoc_rules_fpgrowth(spark, d):
    return _rounded(G.set_rules(_growth_baskets(spark, d), is_target, 0.003, 0.03, None), 6, "support", "confidence", "lift")


def _word_baskets(spark, d, by_customer: bool = False):
    """Baskets of the first words of part names, so that sets of several items are frequent; customers may stand in for branches."""
    lines = star.lines(spark, d).withColumn("item", F.substring_index("item", " ", 1))
    if by_customer:
        names = star.orders(spark, d).select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("c_name").alias("branch"))
        lines = lines.drop("branch").join(names, "order_id")
    return stage(B.order_baskets(lines).select("branch", F.col("items_set").alias("items_list")), "word_baskets")


def assoc_rules_sets(spark, d):
    """Rules from sets of up to as many words as are frequent together, both target words as a consequent too."""
    return _rounded(G.set_rules(_word_baskets(spark, d), is_target, 0.02, 0.05, None), 6, "support", "confidence", "lift")


def assoc_rules_choice(spark, d):
    """Set rules of the customers whose baskets give some, pair rules of the others (few baskets, or no frequent set with a target)."""
    rules_ = G.association_rules(_word_baskets(spark, d, True), is_target, "sets", 0.3, 0.5, 3)
    return _rounded(rules_, 6, "support", "confidence", "lift")


def _potential(spark, d, baskets=None):
    baskets = baskets or _growth_baskets(spark, d)
    kpis = G.merge_kpis(G.attach_kpis(baskets, is_target), G.revenue_share(_growth_items(spark, d)))
    return G.growth_potential(stage(kpis, "growth_kpis"), stage(G.pair_rules(baskets, is_target, 10), "growth_rules"))


def growth_potential(spark, d, baskets=None):
    return _rounded(_potential(spark, d, baskets), 6, "low_attachment_score", "order_volume_score", "avg_lift", "assoc_lift_score")


def growth_actions(spark, d):
    return G.growth_actions(_potential(spark, d))


def item_classes(spark, d):
    name = F.col("p_name")
    return star.table(spark, d, "part").groupBy(name.alias("item"), S.keyword_class(name, star.KEYWORDS, star.EXCLUSIONS).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- expansion

def _sources(spark, d):
    """Sources of the branch KPIs; the shifts of the stores stand in for those of the regions."""
    orders = star.orders(spark, d)
    names = dict(zip(sorted(star.ZONES), range(5)))
    region = F.lit(None).cast("string")
    for name, i in names.items():
        region = F.when(F.col("branch") == f"store_{i}", name).otherwise(region)
    detail = orders.where("channel = 'DELIVERY'").select(
        "branch", F.col("c_name").alias("customer"), F.lit(1.0).alias("qty"), F.col("o_totalprice").alias("price"))
    tax = orders.select("branch", (F.col("o_totalprice") * 0.11).alias("total_tax"))
    return {"monthly_sales": star.monthly_sales(spark, d), "customer_orders": star.customer_orders(spark, d),
            "delivery_detail": detail, "tax_summary": tax,
            "attendance": star.shifts(spark, d).withColumn("branch", region)}


def revenue_kpis(spark, d):
    return _rounded(SC.revenue_kpis(star.monthly_sales(spark, d)), 6, "avg_monthly_revenue", "recent_growth_rate", "revenue_volatility",
                    "pct_change_first_last")


def order_kpis(spark, d):
    return _rounded(SC.order_kpis(star.customer_orders(spark, d)), 4, "avg_order_value")


def branch_kpis(spark, d):
    return _rounded(SC.branch_kpis(_sources(spark, d)), 6, "avg_monthly_revenue", "recent_growth_rate", "revenue_volatility",
                    "pct_change_first_last", "avg_order_value", "delivery_share", "revenue_per_hour", "tax_burden").drop("total_tax", "total_hours")


def _kpis(spark, d):
    return stage(SC.branch_kpis(_sources(spark, d)), "branch_kpis")


SCORE_PARTS = ["avg_monthly_revenue", "recent_growth_rate", "revenue_volatility", "avg_order_value", "delivery_share", "revenue_per_hour",
               "norm_growth", "norm_revenue", "norm_volatility", "norm_avg_order", "norm_delivery", "norm_ops_eff", "stability"]


def feasibility_scores(spark, d):
    return _rounded(SC.feasibility_scores(_kpis(spark, d)), 6, *SCORE_PARTS)


def region_scores(spark, d):
    return SC.region_scores(SC.feasibility_scores(_kpis(spark, d)), star.ZONES)


def region_decision(spark, d):
    kpis = _kpis(spark, d)
    df = SC.region_decision(stage(SC.feasibility_scores(kpis), "scores"), kpis, star.ZONES, star.REGION_RULES)
    return df.select("recommended_region", "best_branch_to_replicate", "feasibility_tier", "overall_feasibility", "strongest_growth_branch",
                     F.array_join("candidate_locations", ", ").alias("candidate_locations"), "warning")


def branch_ranking(spark, d):
    return SC.branch_ranking(SC.feasibility_scores(_kpis(spark, d)), star.ZONES)


def growth_summary(spark, d):
    return SC.growth_summary(_kpis(spark, d), star.ZONES).drop("statement")


def risk_summary(spark, d):
    return SC.risk_summary(SC.feasibility_scores(_kpis(spark, d)), star.ZONES).drop("statement")


# ---------------------------------------------------------------- forecast

def forecast_anomalies(spark, d):
    df = FC.anomalies(star.monthly_sales(spark, d), star.ANOMALIES)
    return df.select("branch", "date", "t", "y", S.round_to("growth", 6).alias("growth"), "anomaly", "weight")


def forecast_scenarios(spark, d):
    df = FC.scenarios(FC.anomalies(star.monthly_sales(spark, d), star.ANOMALIES))
    return df.select("branch", "scenario", "date", "y", "w")


def forecast_estimators(spark, d):
    df = FC.estimators(FC.scenarios(FC.anomalies(star.monthly_sales(spark, d), star.ANOMALIES)))
    return _rounded(df.select("branch", "scenario", "n", "naive", "wma3", "slope", F.col("vol_series").alias("volatility")), 4,
                    "naive", "wma3", "slope", "volatility")


def _ensemble(spark, d):
    return FC.ensemble(stage(star.monthly_sales(spark, d), "monthly"), star.ANOMALIES, star.REFERENCES)


def forecast_ensemble(spark, d):
    return _ensemble(spark, d).drop("explanation", "notes")


def forecast_short_series(spark, d):
    """Each quarter of a branch as a series of its own: at most three months, too few for a trend, so the reference branch's quarter joins in."""
    quarter = lambda name: F.format_string("%s %dQ%d", name, F.year("date"), F.quarter("date"))
    months = stage(star.monthly_sales(spark, d).withColumn("region", F.col("branch")).withColumn("branch", quarter("region")), "monthly")
    other = S.lookup(F.col("region"), star.REFERENCES)
    linked = months.where(other.isNotNull()).select("branch", quarter(other).alias("reference")).distinct()
    return FC.ensemble(months.drop("region"), (), linked).select(
        "branch", "scenario", "forecast_period", "demand_index_forecast", "similarity_estimate", "relative_band_low", "relative_band_high", "n_months_used")


def forecast_backtest(spark, d):
    return FC.backtest(stage(star.monthly_sales(spark, d), "monthly"), 3)


def forecast_rolling_backtest(spark, d):
    return FC.rolling_backtest(stage(star.monthly_sales(spark, d), "monthly"), 3, 12, star.REFERENCES)


def forecast_metadata(spark, d):
    """Description of a forecast run without its time."""
    row = FC.run_metadata(_ensemble(spark, d))
    return row.select("total_rows", F.array_join("branches", "|").alias("branches"), F.array_join("scenarios", "|").alias("scenarios"),
                      "periods_per_scenario", F.explode("parameters").alias("parameter", "value"))


def pair_metadata(spark, d):
    """Description of a run of pair statistics."""
    row = flows.combo_metadata(_pairs(spark, d), MIN_SUPPORT, MIN_COUNT)
    return row.withColumns({c: F.array_join(c, "|") for c in ("scope_types", "branches")})


def item_lists(spark, d):
    """Items of orders written as JSON, as a Python list, as plain text with commas, or as nothing, and read back as arrays."""
    found = _baskets(spark, d).withColumn("kind", F.col("order_id").cast("long") % 5)
    loud = F.transform("items_set", lambda i: F.upper(F.replace(i, F.lit(" "), F.lit("  "))))
    text_ = (F.when(F.col("kind") == 0, F.to_json(loud)).when(F.col("kind") == 1, F.concat(F.lit("['"), F.array_join(loud, "', '"), F.lit("']")))
             .when(F.col("kind") == 2, F.array_join(loud, ",")).when(F.col("kind") == 3, F.lit(" NaN ")))
    return found.select("order_id", F.array_join(S.parse_items(text_), "|").alias("items"))


# ---------------------------------------------------------------- reports

REPORT_FILES = 64


def _report(rows: DataFrame, name: str, number: Column, block: Column, *order: Column) -> DataFrame:
    """Rows with a ``line`` column as the placed lines of report files (file ``number`` of a name), each cut into blocks."""
    pos = order[0] if len(order) == 1 else F.struct(*order)
    file = F.concat(F.lit(f"{name}-"), number.cast("string"), F.lit(".csv"))
    return rows.select(file.alias("path"), file.alias("file"), block.alias("block"), pos.alias("pos"), "line")


def _monthly_report(spark, d):
    """Monthly sales as report text: branch header, column header, one line per month, a total line per year, page marks."""
    months = star.monthly_sales(spark, d)
    amount = F.format_string('"%,.2f"', "revenue")
    body = months.select("branch", "year", F.col("month_num").alias("m"), F.lit(3).alias("kind"),
                         F.format_string("%s,,%d,%s,", "month", "year", amount).alias("line"))
    total = months.groupBy("branch", "year").agg(F.sum(S.money(F.col("revenue"))).cast("double").alias("revenue")).select(
        "branch", "year", F.lit(13).alias("m"), F.lit(4).alias("kind"), F.format_string(",,Total for    %d,%s", "year", amount).alias("line"))
    page = months.select("branch", "year").distinct().select(
        "branch", "year", F.lit(6).alias("m"), F.lit(5).alias("kind"), F.format_string(",Year: %d,,Page 1 of, 2", "year").alias("line"))
    head = months.groupBy("branch").agg(F.min("year").alias("year")).select("branch", "year", F.lit(0).alias("m"), F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit("17-Mar-27,,,,").alias("line")),
        F.struct(F.lit(1).alias("kind"), F.concat(F.lit("Branch Name: "), F.col("branch"), F.lit(",,,,")).alias("line")),
        F.struct(F.lit(2).alias("kind"), F.lit("Month,,Year,Total,").alias("line")))))
    rows = body.unionByName(total).unionByName(page).unionByName(head)
    branch_rank = F.array_position(F.array(*[F.lit(b) for b in sorted(star.ZONES)]), F.col("branch"))
    return _report(rows, "monthly", branch_rank, F.col("year"), F.col("m"), F.col("kind"))


def report_roundtrip(spark, d):
    return R.monthly_sales(stage(_monthly_report(spark, d), "monthly_report"))


def _whole_text(x: Column) -> Column:
    """As ``%.0f``; by the slow formatter only where a long does not print the same (null, not finite, huge, or a signed zero)."""
    return F.when(F.abs(x).between(0.5, 1e15), F.round(x, 0).cast("long").cast("string")).otherwise(F.format_string("%.0f", x))


def _money_text(x: Column) -> Column:
    """As ``%,.2f``; by the slow formatter only outside 0 to a million, or where null."""
    cents = (x.cast("decimal(18,2)") * 100).cast("long")
    whole = F.floor(cents / 100).cast("long")
    tail = F.concat(F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    small = F.concat(whole.cast("string"), tail)
    large = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), tail)
    return F.when(x.between(0.01, 999), small).when(x.between(1000, 999_999), large).otherwise(F.format_string("%,.2f", x))


def _detail_report(spark, d):
    """Order lines as an order-detail report: one person block per order, a branch header on every order."""
    items = star.table(spark, d, "part").select("p_partkey", "p_name")
    detail = star.table(spark, d, "lineitem").join(items, F.expr("l_partkey = p_partkey")).withColumnRenamed("l_orderkey", "o_orderkey")
    price = F.when(F.col("l_linenumber") == 7, F.lit("0.00")).otherwise(F.concat(F.lit('"'), _money_text(F.col("l_extendedprice")), F.lit('"')))
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    body = detail.select("o_orderkey", F.lit(3).alias("kind"), F.col("l_linenumber").alias("n"),
                         F.concat(F.lit(","), _whole_text(qty), F.lit(","), F.coalesce("p_name", F.lit("null")), F.lit(","), price, F.lit(",")).alias("line"))
    head = star.orders(spark, d).select("o_orderkey", F.inline(F.array(
        F.struct(F.lit(1).alias("kind"), F.concat(F.lit("Branch :"), F.col("branch"), F.lit(",,,,")).alias("line")),
        F.struct(F.lit(2).alias("kind"), F.concat(F.lit("Person_"), F.coalesce(F.col("o_orderkey").cast("string"), F.lit("null")), F.lit(",,,,")).alias("line")),
        F.struct(F.lit(4).alias("kind"), F.lit("Total :,,,,").alias("line"))))).select(
        "o_orderkey", "kind", F.lit(0).alias("n"), "line")
    rows = body.unionByName(head)
    key = F.col("o_orderkey")
    return _report(rows, "detail", key % REPORT_FILES, F.floor(key / (50 * REPORT_FILES)), key * 1000 + F.col("kind") * 100 + F.col("n"))


def report_order_detail(spark, d):
    flagged = T.flag_lines(R.transaction_baskets(stage(_detail_report(spark, d), "detail_report")))
    return flagged.groupBy("branch", "is_void", "is_modifier").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("file", "basket_id").alias("n_baskets"),
        F.sum(S.money(F.col("price"))).cast("double").alias("price"), F.sum(S.money(F.col("qty"))).cast("double").alias("qty"))


def report_basket_core(spark, d):
    audit = T.flag_lines(R.transaction_baskets(stage(_detail_report(spark, d), "detail_report")))
    core = T.basket_core(audit, ("block", "pos"))
    return core.select("branch", "customer", F.array_join(F.array_sort("items_list"), "|").alias("items"), "unique_items", "net_qty", "net_total")


def report_items(spark, d):
    """Item rows written under branch, division and group headers and parsed back."""
    items = stage(star.items_by_group(spark, d).withColumn("number", F.pmod(F.hash("branch", "division"), F.lit(REPORT_FILES))), "items")
    levels = [("branch", ["branch"]), ("division", ["branch", "division"]), ("group", ["branch", "division", "group"])]
    rows = items.select("number", "branch", "division", "group", F.lit(3).alias("level"), "item",
                        F.format_string('%s,,%.0f,"%,.2f"', "item", "qty", "amount").alias("line"))
    for i, (name, keys) in enumerate(levels):
        header = items.select("number", *keys).distinct()
        for c in ("branch", "division", "group"):
            if c not in keys:
                header = header.withColumn(c, F.lit(""))
        rows = rows.unionByName(header.select("number", "branch", "division", "group", F.lit(i).alias("level"), F.lit("").alias("item"),
                                              F.format_string(f"{name.title()}: %s,,,", name).alias("line")))
    rank = F.array_position(F.array(*[F.lit(b) for b in sorted(star.ZONES)]), F.col("branch"))
    placed = _report(rows, "items", F.col("number"), rank, F.col("division"), F.col("group"), F.col("level"), F.col("item"))
    return R.items_by_group(stage(placed, "items_report")).select("branch", "division", "group", "item", "qty", "amount")


def report_attendance(spark, d):
    """Punches written as an attendance report, one employee block per user, and parsed back."""
    events = star.table(spark, d, "events").where("event_type <> 'purchase'")
    hours = F.col("value") / 10
    clock = F.format_string("%02d.%02d.%02d", F.floor(hours).cast("int"), F.floor(hours * 60 % 60).cast("int"), F.floor(hours * 3600 % 60).cast("int"))
    day = F.date_format("ts", "dd-MMM-yy")
    body = events.select("user_id", F.lit(3).alias("kind"), F.col("event_id").alias("n"),
                         F.concat_ws(",", day, F.lit(""), F.date_format("ts", "HH.mm.ss"), day, F.date_format("ts", "HH.mm.ss"), clock).alias("line"))
    head = events.select("user_id").distinct().select("user_id", F.inline(F.array(
        F.struct(F.lit(1).alias("kind"), F.format_string(",EMP ID :%d.0,NAME :Person_%d,,,", "user_id", "user_id").alias("line")),
        F.struct(F.lit(2).alias("kind"), F.format_string(",store_%d,,,,", F.col("user_id") % 5).alias("line")),
        F.struct(F.lit(4).alias("kind"), F.lit(",,,,Total :,99:00:00").alias("line"))))).select(
        "user_id", "kind", F.lit(0).cast("long").alias("n"), "line")
    user = F.col("user_id")
    placed = _report(body.unionByName(head), "punches", user % REPORT_FILES, F.floor(user / (4 * REPORT_FILES)), user, F.col("kind"), F.col("n"))
    return R.attendance(stage(placed, "punch_report")).groupBy("emp_id", "branch", "date").agg(
        F.count(F.lit(1)).alias("n"), S.round_to(F.sum(F.col("duration_hours").cast("decimal(18,6)")).cast("double"), 3).alias("hours"))


def _document_lines(spark, d):
    docs = star.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_explode(spark, d):
    return _document_lines(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").alias("last_line"))


def line_classes(spark, d):
    df = L.classify(_document_lines(spark, d))
    flags = ["is_page_break", "is_footer", "is_blank", "is_noise", "is_date_line", "is_total"]
    return df.groupBy("doc_id").agg(*[F.count_if(F.col(c)).alias(c) for c in flags])


def number_parse(spark, d):
    """Amounts written in report style and parsed back; every tenth order writes a dash, every eleventh junk."""
    o = star.table(spark, d, "orders")
    shown = (F.when(F.col("o_orderkey") % 10 == 0, F.lit("-")).when(F.col("o_orderkey") % 11 == 0, F.lit("12.3.4"))
             .otherwise(F.format_string(' "%,.2f" ', "o_totalprice")))
    return o.select("o_orderkey", S.parse_number(shown).alias("parsed"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    pairs_overall, pairs_four_scopes, pairs_top_overall, pairs_top_per_branch, pairs_top_per_channel, pairs_with_item,
    pairs_similar_items, pair_checks, pair_sentences, order_baskets, channel_infer, channel_kpis, pairs_output_order, item_category, dim_item_beverages, beverage_features, item_shares_ranks,
    dim_branch, dim_item, reconcile_sources, branch_month_features, partial_history, item_features, customer_rfm, customer_segments,
    segment_limits, shift_flags, shift_features, forward_fill, supply_hourly, supply_profile, demand_shape, demand_multipliers,
    demand_total, productivity_targets, staffing_gap, staffing_findings, staffing_summary, top_gap_slots, attach_kpis,
    attach_revenue_share, assoc_rules_pairs, assoc_rules_top, assoc_rules_fpgrowth, assoc_rules_sets, assoc_rules_choice, growth_potential, growth_actions, item_classes,
    revenue_kpis, order_kpis, branch_kpis, feasibility_scores, region_scores, region_decision, branch_ranking, growth_summary,
    risk_summary, forecast_anomalies, forecast_scenarios, forecast_estimators, forecast_ensemble, forecast_short_series,
    forecast_backtest, forecast_rolling_backtest, forecast_metadata, pair_metadata, item_lists, report_roundtrip, report_order_detail, report_basket_core, report_items, report_attendance, line_explode,
    line_classes, number_parse)}
