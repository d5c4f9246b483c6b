"""The star-schema test tables in the roles of the retail tables, so that every operator runs over whole tables.

branch = region of the customer, channel = by order priority, item = part name, shifts and delivery orders = events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..functions.rules import AnomalyRule, RegionRule

# Rules that play the part of a retailer's own lists on these tables.
KEYWORDS = {"coffee": ["hot"], "milkshake": ["cold"]}
EXCLUSIONS = ["anvil"]
ANOMALIES = (
    AnomalyRule("likely_partial_month", -0.80, "down", 0.0),
    AnomalyRule("potential_surge", 0.15, "up", 0.5, month=3),
    AnomalyRule("potential_spike", 0.10, "up", 0.5, entity="ASIA"),
)
REFERENCES = {"EUROPE": "ASIA"}
ZONES = {"AFRICA": "south", "ASIA": "east", "AMERICA": "west", "EUROPE": "north", "MIDDLE EAST": "east"}
REGION_RULES = (
    RegionRule("north", "North", "EUROPE", ("Harbour", "Old Town")),
    RegionRule("south", "South", "AFRICA", ("Market", "Station")),
    RegionRule("east", "East", None, ("Hill", "River"), "existing branches are close to each other"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customer with its branch: both joins are on tables of fixed size, chosen by their statistics."""
    nations = (table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
               .select("n_nationkey", F.col("r_name").alias("branch")))
    return (table(spark, d, "customer").join(nations, F.expr("c_nationkey = n_nationkey"))
            .select("c_custkey", "c_name", "c_mktsegment", "branch"))


def channel(priority: Column) -> Column:
    return F.when(priority.isin("1-URGENT", "2-HIGH"), "DELIVERY").otherwise("IN_STORE")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "orders").join(customers(spark, d), F.expr("o_custkey = c_custkey"))
            .select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "branch", "o_totalprice", "o_orderdate",
                    channel(F.col("o_orderpriority")).alias("channel")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines: order_id, item, branch, channel, timestamp."""
    items = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("item"))
    heads = orders(spark, d).select("o_orderkey", "branch", "channel", F.col("o_orderdate").alias("timestamp"))
    return (table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
            .join(items, F.expr("l_partkey = p_partkey")).join(heads, F.expr("l_orderkey = o_orderkey"))
            .select(F.col("l_orderkey").cast("string").alias("order_id"), "item", "branch", "channel", "timestamp"))


def monthly_sales(spark: SparkSession, d: str) -> DataFrame:
    """branch, month, year, month_num, date, revenue: order value per branch and month."""
    date = F.to_date(F.date_trunc("month", F.col("o_orderdate")))
    sums = (orders(spark, d).groupBy("branch", date.alias("date"))
            .agg(F.sum(S.money(F.col("o_totalprice"))).cast("double").alias("revenue")))
    return sums.select("branch", F.date_format("date", "MMMM").alias("month"), F.year("date").alias("year"),
                       F.month("date").alias("month_num"), "date", "revenue")


def channel_sales(spark: SparkSession, d: str) -> DataFrame:
    """branch, channel, customers, sales, avg_per_customer: market segments as channels, HOUSEHOLD as DELIVERY."""
    name = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "DELIVERY").when(F.col("c_mktsegment") == "BUILDING", "TABLE")
    sums = (orders(spark, d).withColumn("channel", name.otherwise(F.col("c_mktsegment")))
            .groupBy("branch", "channel")
            .agg(F.count_distinct("o_custkey").cast("double").alias("customers"),
                 F.sum(S.money(F.col("o_totalprice"))).cast("double").alias("sales")))
    return sums.withColumn("avg_per_customer", S.ratio(F.col("sales"), F.col("customers")))


def items_by_group(spark: SparkSession, d: str) -> DataFrame:
    """branch, division, group, item, qty, amount. Quantities of size-1 parts stand for free modifiers."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    heads = orders(spark, d).select("o_orderkey", "branch")
    amount = F.when(F.col("p_size") == 1, F.lit(0)).otherwise(S.money(F.col("l_extendedprice")))
    return (table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
            .join(parts, F.expr("l_partkey = p_partkey")).join(heads, F.expr("l_orderkey = o_orderkey"))
            .groupBy("branch", F.col("p_type").alias("division"),
                     F.concat_ws("/", "p_brand", F.when(F.col("p_size") == 1, "free").otherwise("paid")).alias("group"),
                     F.col("p_name").alias("item"))
            .agg(F.sum(S.money(F.col("l_quantity"))).cast("double").alias("qty"),
                 F.sum(amount.cast("decimal(18,2)")).cast("double").alias("amount")))


def customer_orders(spark: SparkSession, d: str) -> DataFrame:
    """branch, customer, phone, first_order, last_order, total, num_orders."""
    total = F.sum(S.money(F.col("o_totalprice"))).cast("double")
    return (orders(spark, d).groupBy("branch", F.col("c_name").alias("customer"), F.col("o_custkey"))
            .agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"),
                 total.alias("total"), F.count(F.lit(1)).cast("int").alias("num_orders"))
            .select("branch", "customer", F.col("o_custkey").cast("string").alias("phone"), "first_order", "last_order", "total", "num_orders"))


def _branch_of_user() -> Column:
    return F.concat(F.lit("store_"), (F.col("user_id") % 5).cast("string"))


def shifts(spark: SparkSession, d: str) -> DataFrame:
    """Punches from the non-purchase events: start at ts, length value/10 hours."""
    hours = F.col("value") / F.lit(10.0)
    end = F.timestamp_add("SECOND", F.floor(hours * 3600).cast("int"), F.date_trunc("second", F.col("ts").cast("timestamp")))
    return (table(spark, d, "events").where(F.col("event_type") != "purchase")
            .select(F.col("user_id").cast("string").alias("emp_id"),
                    F.concat(F.lit("Person_"), F.col("user_id").cast("string")).alias("name"),
                    _branch_of_user().alias("branch"), F.to_date("ts").alias("date"),
                    F.date_format("ts", "HH:mm:ss").alias("punch_in"), F.date_format(end, "HH:mm:ss").alias("punch_out"),
                    hours.alias("duration_hours")))


def delivery_orders(spark: SparkSession, d: str) -> DataFrame:
    """Delivery customers from the purchase events: one row per user and day, ordered at its last event."""
    return (table(spark, d, "events").where(F.col("event_type") == "purchase")
            .groupBy(_branch_of_user().alias("branch"), F.col("user_id").cast("string").alias("customer"),
                     F.to_date("ts").alias("day"))
            .agg(F.max("ts").alias("last_order"), F.count(F.lit(1)).cast("int").alias("num_orders"))
            .select("branch", "customer", "last_order", "num_orders"))


def store_menu(spark: SparkSession, d: str) -> DataFrame:
    """Channel KPIs of the stores: event types as channels."""
    name = F.when(F.col("event_type") == "purchase", "DELIVERY").otherwise(F.upper("event_type"))
    return (table(spark, d, "events")
            .groupBy(_branch_of_user().alias("branch"), name.alias("channel"))
            .agg(F.count(F.lit(1)).cast("double").alias("customers"),
                 F.sum(S.money(F.col("value"))).cast("double").alias("sales")))


def store_months(spark: SparkSession, d: str) -> DataFrame:
    """Weekly revenue of the stores in the role of monthly sales."""
    date = F.to_date(F.date_trunc("week", F.col("ts")))
    return (table(spark, d, "events").groupBy(_branch_of_user().alias("branch"), date.alias("date"))
            .agg(F.sum(S.money(F.col("value"))).cast("double").alias("revenue")))
