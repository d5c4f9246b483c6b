"""Queries over what was written before they run: report files, stored results and their lookups, and the SQL of each.

A query writes the files or the run it reads into the shared folder, from whole tables, and answers through the public readers.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import scalar as S, text
from ..operators import growth as G, scoring as SC
from ..session import checkpoint_dir, stage
from ..sources import lines as L, reports as R, tables
from . import catalog, lookups, oracle, star, store


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- report files

BLOCK = 16 << 20  # most bytes of a file in one block, so that what a task holds of a file is bounded


@contextmanager
def _block_bytes(spark: SparkSession, most: int):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _written(spark: SparkSession, rows: DataFrame, name: str, files: int | None = None, least: int = BLOCK) -> DataFrame:
    """Write rows (file int, at struct, line) as one text file per file number and read them back as placed lines.

    Blocks hold ``BLOCK`` bytes. A smaller ``least`` cuts every longer file into several blocks of that many bytes or more.
    """
    path = _folder(spark, name)
    count = files or rows.select("file").distinct().count()
    (rows.repartition(count, "file").sortWithinPartitions("file", "at").select("file", "line")
     .write.partitionBy("file").text(path))
    size = BLOCK
    if least < BLOCK:
        files_of = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/*.txt")
        sizes = [s.getLen() for s in files_of.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files_of)]
        size = min(BLOCK, max(least, min([n for n in sizes if n > least], default=least) // 8))
    with _block_bytes(spark, size):
        return stage(L.read_lines(spark, f"{path}/*", glob="*.txt"), name)


def _lines(*pairs) -> F.Column:
    """Exploded array of (at, line) structs."""
    return F.inline(F.array(*[F.struct(at.alias("at"), line.alias("line")) for at, line in pairs]))


def _at(*parts) -> F.Column:
    return F.struct(*[(p if isinstance(p, F.Column) else F.lit(p)).cast("long").alias(f"k{i}") for i, p in enumerate(parts)])


def report_audit(spark, d):
    """Files of orders: 1 and 21 are equal, 41 differs behind the first 8 KB only, and every seventh file is of no known type."""
    orders = star.orders(spark, d)
    rows = orders.select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(20), F.lit(40))).alias("s"))
    rows = rows.select("o_orderkey", (F.col("s") + F.col("o_custkey") % 20).cast("int").alias("file"))
    body = rows.select("file", _at(2, F.col("o_orderkey")).alias("at"), F.format_string("May,,2025,\"%d.00\",", "o_orderkey").alias("line"))
    heads = rows.select("file").distinct()
    marks = heads.select("file", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("i")).select(
        "file", _at(1, F.col("i")).alias("at"), F.format_string(",Year: 2025,,Page %d of, 400", "i").alias("line"))
    title = F.when(F.col("file") % 7 == 6, F.lit("hello,world")).otherwise(F.lit("Monthly Sales,,,,"))
    rest = heads.select("file", _lines((_at(0, 0), title), (_at(1, 999), F.lit("Branch Name: Hill,,,,"))))
    tail = heads.where("file >= 40").select("file", _at(3, 0).alias("at"), F.lit(",,Total for 2025,\"1.00\",").alias("line"))
    made = body.unionByName(marks).unionByName(rest).unionByName(tail)
    audit = R.audit_files(_written(spark, made, "audit_report"))
    kind = F.when(F.col("reason").startswith("duplicate"), "duplicate").otherwise(F.col("reason"))
    return audit.groupBy("report_type", "status", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("hash").alias("n_contents"))


def report_customer_orders(spark, d):
    """Customers as wrapped rows of a customer-orders report; order counts times 100, so that many lie above 500."""
    c = star.customer_orders(spark, d).withColumn("id", F.col("phone").cast("long"))
    stamp = lambda col: F.date_format(col, "yyyy-MM-dd HH:mm")
    file, at = (F.col("id") % 8).cast("int"), lambda k: _at(1, F.hash("branch"), F.col("id"), k)
    body = c.select(file.alias("file"), _lines(
        (at(0), F.format_string("Person_%d,Street %d,%d", "id", "id", "id")), (at(1), F.lit(",c/o")), (at(2), F.concat(F.lit(","), stamp("first_order"))),
        (at(3), F.concat(F.lit(","), stamp("last_order"))), (at(4), F.format_string(',"%,.2f"', "total")), (at(5), F.format_string(",%d,", F.col("num_orders") * 100))))
    heads = c.select(file.alias("file"), "branch").distinct()
    label = F.initcap("branch")
    heads = heads.select("file", _at(1, F.hash("branch"), -1, 0).alias("at"), F.concat(label, F.lit(",,,")).alias("line"))
    title = c.select(file.alias("file")).distinct().select("file", _at(0, 0, 0, 0).alias("at"), F.lit("Customer Orders (Delivery),,,").alias("line"))
    got = R.customer_orders(_written(spark, body.unionByName(heads).unionByName(title), "orders_report"), wrapped=True)
    return got.select("branch", "customer", "phone", F.to_date("first_order").alias("first_order"), F.to_date("last_order").alias("last_order"), "total", "num_orders")


def tax_rows(spark, d):
    """Order value of each branch and month as the tax lines of a report: 20 numbers to a line, the total in the last; a file per year."""
    months = star.monthly_sales(spark, d)
    value = F.format_string('"%,.2f"', "revenue")
    line = F.concat_ws(",", F.lit("Total By Branch"), F.lit("1.00"), F.lit(",".join(["0.00"] * 18)), value)
    at = lambda k: _at(F.col("month_num"), F.hash("branch"), k)
    return months.select(F.col("year").alias("file"), _lines((at(0), F.concat(F.lit("Branch Name:  "), F.col("branch"), F.lit(",,,"))), (at(1), line)))


def report_tax(spark, d):
    """The tax lines of all years and branches, read back."""
    return R.tax_summary(_written(spark, tax_rows(spark, d), "tax_report"))


def menu_rows(spark, d):
    """Channel figures as an average-sales report, a file per branch."""
    menu = star.channel_sales(spark, d)
    channel = F.when(F.col("channel") == "AUTOMOBILE", "take away").when(F.col("channel") == "FURNITURE", "DELIVERY ").when(F.col("channel") == "MACHINERY", "unknown").otherwise(F.col("channel"))
    file = F.array_position(F.array(*[F.lit(b) for b in ("AFRICA", "EUROPE", "AMERICA", "MIDDLE EAST", "ASIA")]), F.col("branch")).cast("int")
    file = (file - 1).alias("file")
    body = menu.select(file, _at(2, F.hash("channel")).alias("at"), F.format_string('%s,%.2f,"%,.2f",,', channel, "customers", "sales").alias("line"))
    head = menu.select("branch").distinct().select(file, _lines(
        (_at(0, 0), F.lit("Average Sales By Menu,,,,")), (_at(0, 1), F.lit("Menu Name,# Cust,Sales,Avg Customer,")), (_at(1, 0), F.concat(F.initcap("branch"), F.lit(",,,,")))))
    return body.unionByName(head)


def report_menu(spark, d):
    """The menu report of every branch, read back."""
    got = R.avg_sales_menu(_written(spark, menu_rows(spark, d), "menu_report"))
    return got.withColumn("avg_per_customer", S.round_to("avg_per_customer", 2))


def delivery_rows(spark, d, files: int = 64):
    """Order lines as a delivery-detail report in ``files`` files, dealt by order; returns are written as negative quantities."""
    items = star.table(spark, d, "part").select("p_partkey", "p_name")
    heads = star.orders(spark, d).select("o_orderkey", "branch")
    key = F.col("o_orderkey")
    body = (star.table(spark, d, "lineitem").join(items, F.expr("l_partkey = p_partkey")).select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q"), "p_name", "l_extendedprice"))
    file = (key % files).cast("int").alias("file")
    body = body.select(file, _at(key, 2, F.col("l_linenumber")).alias("at"), F.format_string(',%.0f,%s,"%,.2f",', "q", "p_name", "l_extendedprice").alias("line"))
    head = heads.select(file, _lines((_at(key, 0, 0), F.concat(F.lit("Branch :"), F.col("branch"), F.lit(",,,"))), (_at(key, 1, 0), F.format_string("Person_%d,,,", key)),
                                     (_at(key, 3, 0), F.lit("Total :,,,"))))
    return body.unionByName(head)


def report_delivery_detail(spark, d):
    """Delivered lines of the report, per customer."""
    files = max(64, star.table(spark, d, "lineitem").count() // 250_000)  # a file is sorted by one task
    rows = R.delivery_detail(_written(spark, delivery_rows(spark, d, files), "delivery_report", files))
    return rows.groupBy("branch", "customer").agg(F.count(F.lit(1)).alias("n"), F.sum(S.money(F.col("price"))).cast("double").alias("price"), F.sum("qty").alias("qty"))


def hours_rows(spark, d):
    """Punches as an attendance report read by its other variant: branch named on the line after the employee, hours at the end of a line."""
    events = star.table(spark, d, "events").where("event_type <> 'purchase'")
    hours = F.col("value") / 10
    clock = F.format_string("%02d.%02d.%02d", F.floor(hours).cast("int"), F.floor(hours * 60 % 60).cast("int"), F.floor(hours * 3600 % 60).cast("int"))
    day, user, file = F.date_format("ts", "dd-MMM-yy"), F.col("user_id"), (F.col("user_id") % 16).cast("int").alias("file")
    body = events.select(file, _at(user, 2, F.col("event_id")).alias("at"), F.concat_ws(",", day, F.lit(""), F.date_format("ts", "HH.mm.ss"), day, F.date_format("ts", "HH.mm.ss"), clock).alias("line"))
    head = events.select("user_id").distinct().select(file, _lines(
        (_at(user, 0, 0), F.format_string(",EMP ID :%d.0,NAME :Person_%d,,,", user, user)), (_at(user, 1, 0), F.format_string(",Store %d,,,,", user % 5))))
    return body.unionByName(head)


def report_hours(spark, d):
    """Hours of each employee from the attendance report."""
    names = [(f"store {i}", f"store_{i}") for i in range(5)]
    got = R.attendance_hours(_written(spark, hours_rows(spark, d), "hours_report"), names, 0.5)
    return got.groupBy("branch", "emp_id").agg(F.count(F.lit(1)).alias("n"), S.round_to(F.sum(F.col("duration_hours").cast("decimal(18,6)")).cast("double"), 3).alias("hours"))


def file_lines(spark, d):
    """Documents as text files, odd ones in Latin-1 and even ones in UTF-8, each read in several blocks and with the encoding of the whole file.

    What Latin-1 lacks is written as a question mark. A Latin-1 file is no valid UTF-8, as its first line ends in one high byte.
    """
    docs = star.table(spark, d, "documents").where("text IS NOT NULL")
    file = (F.col("doc_id") % 32).cast("int").alias("file")
    rows = docs.select(file, F.posexplode(F.split("text", "\n")).alias("pos", "line"), "doc_id").select("file", _at(F.col("doc_id"), F.col("pos")).alias("at"), "line")
    first = docs.select(file).distinct().select("file", _at(-1, 0).alias("at"), F.lit("Café").alias("line"))
    rows = rows.unionByName(first)
    latin = F.encode(F.regexp_replace("line", "[^\\x00-\\xFF]", "?"), "ISO-8859-1").cast("string")
    rows = rows.withColumn("line", F.when(F.col("file") % 2 == 1, latin).otherwise(F.col("line")))
    got = L.number_lines(_written(spark, rows, "document_files", 32, least=16 << 10))
    return got.groupBy(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").alias("last_line"),
        F.sum(F.length(F.regexp_replace("line", "[\\x00-\\x7F]", ""))).alias("n_not_ascii"), (F.count_distinct("block") > 1).alias("several_blocks"))


# ---------------------------------------------------------------- typed sources

def csv_coercion(spark, d):
    """Parts as CSV text with some values that do not fit their type, read back typed."""
    part = star.table(spark, d, "part")
    odd = F.col("p_partkey") % 7 == 0
    shown = part.select(F.col("p_partkey").cast("string").alias("P Partkey"), F.concat(F.lit(" "), "p_name").alias(" P_NAME "),
                        F.when(odd, "many").otherwise(F.col("p_size").cast("string")).alias("p_size"), F.when(odd, "True").otherwise("nope").alias("flag"),
                        F.col("p_retailprice").cast("string").alias("price"), F.lit("2025-12-01").alias("day"))
    path = _folder(spark, "csv")
    shown.write.option("header", True).option("escape", '"').csv(path)
    schema = T._parse_datatype_string("p_partkey long, p_name string, p_size int, flag boolean, price double, day date, absent string")
    return tables.read_csv_table(spark, path, schema, {"price": 0.0})


def line_items_layouts(spark, d):
    """Order lines in all accepted layouts (lines, lines with ``basket_id``, baskets with a list of items), each as CSV and as Parquet."""
    lines = stage(star.lines(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), "lines")
    lists = lines.groupBy("order_id", "branch", "channel", F.col("timestamp").alias("date")).agg(F.collect_list("item").alias("items_list"))
    layouts = {"lines": lines, "baskets": lines.withColumnRenamed("order_id", " Basket_ID "), "lists": lists}
    out = []
    for layout, df in layouts.items():
        for fmt in ("csv", "parquet"):
            path = _folder(spark, "items") + f".{fmt}"
            if fmt == "csv":
                df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith("array")}).write.option("header", True).option("escape", '"').csv(path)
            else:
                df.write.parquet(path)
            got = tables.read_line_items(spark, path)
            out.append(got.groupBy("branch", "channel").agg(
                F.count(F.lit(1)).alias("n_lines"), F.count_distinct("order_id").alias("n_orders"), F.count_distinct("item").alias("n_items"),
                F.count("timestamp").alias("n_times")).withColumn("layout", F.lit(f"{layout} {fmt}")))
    return reduce(DataFrame.unionByName, out)


def pair_artifact(spark, d):
    """The pair table written and read back by its reader; an absent result is an empty table of its schema."""
    path = _folder(spark, "pairs")
    catalog.pairs_overall(spark, d).write.parquet(path)
    pairs = tables.read_pairs(spark, path)
    return pairs.unionByName(tables.read_result(spark, path + "-absent", pairs.schema))


# ---------------------------------------------------------------- store and lookups

def _run(spark: SparkSession, documents: dict | None = None, **made: DataFrame) -> str:
    root = _folder(spark, "results")
    store.write_run(spark, root, made, documents)
    return root


def lookup_forecast(spark, d):
    root = _run(spark, demand_forecast_all=catalog.forecast_ensemble(spark, d))
    one = lookups.run(spark, root, "query_forecast", branch="ASIA", scenario="base", period=2)
    return lookups.run(spark, root, "query_forecast", compare=True).unionByName(one)


def lookup_pairs(spark, d):
    root = _run(spark, combo_pairs=catalog.pairs_four_scopes(spark, d))
    return lookups.run(spark, root, "query_combos", branch="ASIA", top_n=1_000_000)


def lookup_scopes(spark, d):
    return lookups.run(spark, _run(spark, combo_pairs=catalog.pairs_four_scopes(spark, d)), "list_scopes")


def lookup_feasibility(spark, d):
    root = _run(spark, feasibility_scores=catalog.feasibility_scores(spark, d))
    return lookups.run(spark, root, "query_expansion").unionByName(lookups.run(spark, root, "query_expansion", query_type="feasibility", branch="asia"))


def _expansion_run(spark, d) -> str:
    kpis = catalog._kpis(spark, d)
    return _run(spark, branch_kpis=kpis, feasibility_scores=SC.feasibility_scores(kpis))


def lookup_growth_summary(spark, d):
    return lookups.run(spark, _expansion_run(spark, d), "query_expansion", query_type="growth_summary", zones=star.ZONES)


def lookup_risk_summary(spark, d):
    return lookups.run(spark, _expansion_run(spark, d), "query_expansion", query_type="risk_summary", zones=star.ZONES)


def lookup_feasibility_parts(spark, d):
    return lookups.run(spark, _expansion_run(spark, d), "query_expansion", query_type="feasibility_explanation").drop("top_drivers")


def lookup_staffing_gaps(spark, d):
    gaps = catalog._staffing(spark, d, "staffing_gap_hourly").withColumn("explanation", text.gap_explanation())
    root = _run(spark, staffing_gap_hourly=gaps)
    parts = [lookups.run(spark, root, "query_staffing", query_type=q, branch="store_1").drop("explanation").withColumn("query_type", F.lit(q)) for q in ("gaps", "worst_gaps")]
    return parts[0].unionByName(parts[1])


def lookup_staffing_summary(spark, d):
    return lookups.run(spark, _run(spark, branch_summary_view=catalog.staffing_summary(spark, d)), "query_staffing", query_type="summary")


def lookup_growth_rules(spark, d):
    root = _run(spark, assoc_rules_by_branch=catalog.assoc_rules_top(spark, d))
    return lookups.run(spark, root, "query_growth", query_type="rules", branch="ALL", min_lift=0.0, top_n=10).drop("is_total")


def lookup_growth_gap(spark, d):
    return lookups.run(spark, _run(spark, branch_beverage_kpis=catalog.attach_kpis(spark, d)), "query_growth", query_type="gap")


def lookup_overview(spark, d):
    """Sections, places and leading names of the overview over all five results."""
    kpis = catalog._kpis(spark, d)
    root = _run(spark, demand_forecast_all=catalog.forecast_ensemble(spark, d), combo_pairs=catalog.pairs_four_scopes(spark, d), branch_kpis=kpis,
                feasibility_scores=SC.feasibility_scores(kpis), branch_summary_view=catalog.staffing_summary(spark, d), branch_growth_potential=catalog.growth_potential(spark, d))
    rows = lookups.run(spark, root, "get_overview").where("section <> 'top_combos'")
    return rows.select("section", "position", F.get_json_object("body", "$.branch").alias("branch"))


def lookup_page(spark, d):
    baskets = catalog._growth_baskets(spark, d)
    root = _run(spark, branch_beverage_kpis=catalog.attach_kpis(spark, d, baskets), branch_growth_potential=catalog.growth_potential(spark, d, baskets),
                assoc_rules_by_branch=catalog.assoc_rules_top(spark, d, baskets))
    rows = lookups.run(spark, root, "page", feature="growth", branch="ASIA")
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"), F.max(F.get_json_object("body", "$.branch")).alias("branch"))


def lookup_page_combos(spark, d):
    """The page of the best pairs: every place with its pair and count, from the rows' JSON."""
    rows = lookups.run(spark, _run(spark, combo_pairs=catalog.pairs_four_scopes(spark, d)), "page", feature="combo")
    field = lambda name: F.get_json_object("body", f"$.{name}").alias(name)
    return rows.select("section", "position", field("item_a"), field("item_b"), field("scope"), field("count_ab").cast("long").alias("count_ab"))


def store_newest_run(spark, d):
    """Of two complete runs and a newer one that was never finished, the second is read."""
    profile, root = catalog.supply_profile(spark, d), _folder(spark, "results")
    store.write_run(spark, root, {"supply_profile": profile.limit(0)}, run_id="1")
    store.write_run(spark, root, {"supply_profile": profile}, run_id="2")
    store.write_table(profile.limit(0), root, "3", "supply_profile")
    return store.read_table(spark, root, "supply_profile")


def store_branch_folders(spark, d):
    root = _folder(spark, "results")
    store.write_table(catalog.supply_profile(spark, d), root, "1", "supply_profile", partition_by=["branch"])
    return spark.read.parquet(store.table_path(root, "1", "supply_profile") + "/branch=store_2")


def store_arrays(spark, d):
    root = _run(spark, order_baskets=catalog._baskets(spark, d))
    return store.read_table(spark, root, "order_baskets").select("order_id", "branch", F.explode("items_set").alias("item"))


def store_csv(spark, d):
    """A table with an array and numbers written as CSV by the store, a folder per branch, and read back typed."""
    root = _folder(spark, "results")
    store.write_table(catalog._baskets(spark, d), root, "1", "order_baskets", "csv", partition_by=["branch"], sort_by=["order_id"])
    schema = T._parse_datatype_string("order_id string, items_set array<string>, n_items int, branch string, channel string, hour int")
    got = tables.read_csv_table(spark, store.table_path(root, "1", "order_baskets"), schema)
    return got.withColumn("items_set", F.array_join("items_set", "|"))


def store_documents(spark, d):
    """The growth recommendation as a JSON document, read back and unfolded."""
    root = _run(spark, {"growth_recommendation": G.growth_recommendation(catalog._potential(spark, d))})
    doc = lookups.run(spark, root, "query_growth", query_type="recommendation")
    return doc.select("strategy", F.inline("branch_actions"))


def store_items(spark, d):
    items = store.key_value_items(catalog.supply_profile(spark, d), ["branch", "day_of_week"], ["hour"])
    return items.select("pk", "sk", F.get_json_object("attributes", "$.avg_active_employees").cast("double").alias("avg_active_employees"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    report_audit, report_customer_orders, report_tax, report_menu, report_delivery_detail, report_hours, file_lines, csv_coercion, line_items_layouts, pair_artifact,
    lookup_forecast, lookup_pairs, lookup_scopes, lookup_feasibility, lookup_growth_summary, lookup_risk_summary, lookup_feasibility_parts, lookup_staffing_gaps,
    lookup_staffing_summary, lookup_growth_rules, lookup_growth_gap, lookup_overview, lookup_page, lookup_page_combos, store_newest_run, store_branch_folders, store_arrays, store_csv,
    store_documents, store_items)}

_B = oracle.BODIES
_TITLE = "array_to_string(list_transform(string_split(lower(branch), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_PART = [("growth", 0.30, "norm_growth"), ("revenue", 0.25, "norm_revenue"), ("stability", 0.15, "stability"), ("avg_order", 0.15, "norm_avg_order"),
         ("delivery", 0.10, "norm_delivery"), ("ops_eff", 0.05, "norm_ops_eff")]
_GAPS = "SELECT branch, day_of_week, hour, avg_active_employees, required_employees_base, gap_base, status"
_H = "floor(h) + floor(h * 60 % 60) / 60.0::DOUBLE + floor(h * 3600 % 60) / 3600.0::DOUBLE"

BODIES: dict[str, str] = {
    "report_audit": """SELECT CASE WHEN k = 'parsed' THEN 'monthly_sales' END AS report_type, CASE WHEN k = 'parsed' THEN 'parsed' ELSE 'skipped' END AS status,
        CASE WHEN k = 'parsed' THEN NULL ELSE k END AS kind, count(*) AS n_files, count(DISTINCT c) AS n_contents FROM (
        SELECT f, c, CASE WHEN f > first THEN 'duplicate' WHEN f % 7 = 6 THEN 'unknown report type' ELSE 'parsed' END AS k FROM (
            SELECT f, c, min(f) OVER (PARTITION BY c) AS first FROM (
                SELECT DISTINCT o_custkey % 20 + s AS f, CASE WHEN s = 40 THEN 'late ' ELSE '' END || (o_custkey % 20) || ' ' || ((o_custkey % 20 + s) % 7 = 6) AS c
                FROM ord, (VALUES (0), (20), (40)) AS v(s)))) GROUP BY ALL""",
    "report_customer_orders": f"""SELECT {_TITLE} AS branch, 'Person_' || phone AS customer, phone, CAST(first_order AS DATE) AS first_order, CAST(last_order AS DATE) AS last_order,
        total, num_orders * 100 AS num_orders FROM buyers""",
    "report_tax": "SELECT branch AS branch_raw, branch, 1.0::DOUBLE AS vat, revenue AS total_tax FROM months",
    "report_menu": f"""SELECT {_TITLE} AS branch, CASE channel WHEN 'AUTOMOBILE' THEN 'TAKE AWAY' WHEN 'FURNITURE' THEN 'DELIVERY' ELSE channel END AS channel, customers, sales,
        round(sales / customers, 2) AS avg_per_customer FROM menu WHERE channel <> 'MACHINERY'""",
    "report_delivery_detail": """SELECT branch, 'Person_' || l_orderkey AS customer, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, sum(l_quantity) AS qty
        FROM lineitem JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY branch, l_orderkey""",
    "report_hours": f"""SELECT branch, emp_id || '.0' AS emp_id, count(*) AS n, round(CAST(sum(CAST(x AS DECIMAL(18,6))) AS DOUBLE), 3) AS hours FROM (SELECT branch, emp_id, {_H} AS x FROM shift0)
        WHERE x > 0.5 GROUP BY ALL""",
    "file_lines": """SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) - 1 AS last_line,
        CAST(sum(length(regexp_replace(line, '[\\x00-\\x7F]', '', 'g'))) AS BIGINT) AS n_not_ascii, sum(strlen(raw) + 1) > 20000 AS several_blocks FROM (
        SELECT file, raw, regexp_replace(CASE WHEN file % 2 = 1 THEN regexp_replace(raw, '[^\\x00-\\x{FF}]', '?', 'g') ELSE raw END, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS line
        FROM (SELECT CAST(doc_id % 32 AS INTEGER) AS file, line AS raw FROM doc_lines WHERE line IS NOT NULL
            UNION ALL SELECT DISTINCT CAST(doc_id % 32 AS INTEGER), 'Café' FROM documents WHERE text IS NOT NULL)) GROUP BY ALL""",
    "csv_coercion": """SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS INTEGER) END AS p_size, p_partkey % 7 = 0 AS flag, p_retailprice AS price,
        DATE '2025-12-01' AS day, CAST(NULL AS VARCHAR) AS absent FROM part""",
    "line_items_layouts": """SELECT branch, channel, count(*) AS n_lines, count(DISTINCT order_id) AS n_orders, count(DISTINCT upper(trim(item))) AS n_items, count(*) AS n_times,
        layout || ' ' || fmt AS layout FROM line, (VALUES ('lines'), ('baskets'), ('lists')) AS v(layout), (VALUES ('csv'), ('parquet')) AS f(fmt) GROUP BY ALL""",
    "pair_artifact": _B["pairs_overall"],
    "lookup_forecast": f"""SELECT * FROM ({_B['forecast_ensemble']}) WHERE scenario = 'base' AND forecast_period = 1
        UNION ALL SELECT * FROM ({_B['forecast_ensemble']}) WHERE branch = 'ASIA' AND scenario = 'base' AND forecast_period = 2""",
    "lookup_pairs": f"SELECT * FROM ({_B['pairs_four_scopes']}) WHERE scope = 'branch:ASIA' AND lift >= 1",
    "lookup_scopes": "SELECT DISTINCT scope FROM pairs",
    "lookup_feasibility": f"{_B['feasibility_scores']} UNION ALL SELECT * FROM ({_B['feasibility_scores']}) WHERE branch = 'ASIA'",
    "lookup_growth_summary": f"""SELECT *, printf('Sales in %s are %s (growth rate: %+.4f, %+.1f%% first-to-last).', {_TITLE},
        CASE WHEN is_growing THEN 'INCREASING' ELSE 'DECLINING or FLAT' END, growth_rate, pct_change * 100) AS statement FROM ({_B['growth_summary']})""",
    "lookup_risk_summary": f"""SELECT r.*, printf('%s has %s revenue risk (volatility CV: %.4f, stability: %.4f).', {_TITLE.replace('branch', 'r.branch')}, lower(risk_tier), f.revenue_volatility,
        1 - f.norm_volatility) AS statement FROM ({_B['risk_summary']}) r JOIN fs f ON f.branch = r.branch""",
    "lookup_feasibility_parts": " UNION ALL ".join(
        f"SELECT branch, feasibility_score, score_tier, '{n}' AS component, {w}::DOUBLE AS weight, round({c}, 4) AS value FROM fs" for n, w, c in _PART),
    "lookup_staffing_gaps": f"""{_GAPS}, 'gaps' AS query_type FROM gaps WHERE branch = 'store_1' AND status <> 'balanced'
        UNION ALL {_GAPS}, 'worst_gaps' FROM under_slots WHERE branch = 'store_1' AND rn <= 5""",
    "lookup_staffing_summary": _B["staffing_summary"],
    "lookup_growth_rules": f"SELECT * EXCLUDE (is_total) FROM ({_B['assoc_rules_top']}) WHERE is_total",
    "lookup_growth_gap": """SELECT (SELECT branch FROM kpi ORDER BY beverage_attachment_rate DESC, branch LIMIT 1) AS best_branch, best_branch_rate, branch, beverage_attachment_rate,
        beverage_gap_to_best, total_orders FROM kpi""",
    "lookup_overview": f"""SELECT 'forecast' AS section, CAST(row_number() OVER (ORDER BY branch) - 1 AS INTEGER) AS position, branch FROM (SELECT DISTINCT branch FROM months)
        UNION ALL SELECT 'expansion_ranking', CAST(row_number() OVER (ORDER BY feasibility_score DESC, branch) - 1 AS INTEGER), branch FROM fs
        UNION ALL SELECT 'staffing_summary', CAST(row_number() OVER (ORDER BY branch) - 1 AS INTEGER), branch FROM (SELECT DISTINCT branch FROM gaps)
        UNION ALL SELECT 'growth_ranking', CAST(row_number() OVER (ORDER BY potential_rank, branch) - 1 AS INTEGER), branch FROM ({_B['growth_potential']})""",
    "lookup_page": f"""SELECT 'kpis' AS section, 1 AS n, 0 AS last, 'ASIA' AS branch UNION ALL SELECT 'potential', 1, 0, 'ASIA'
        UNION ALL SELECT 'rules', count(*), CAST(count(*) - 1 AS INTEGER), max(branch) FROM ({_B['assoc_rules_top']}) WHERE NOT is_total AND branch = 'ASIA' AND lift >= 1""",
    "lookup_page_combos": """SELECT 'data' AS section, CAST(row_number() OVER (ORDER BY lift DESC, count_ab DESC, item_a, item_b) - 1 AS INTEGER) AS position, item_a, item_b, scope, count_ab
        FROM pairs WHERE scope_type = 'overall' AND lift >= 1 QUALIFY position < 20""",
    "store_newest_run": "SELECT * FROM profile",
    "store_branch_folders": "SELECT * EXCLUDE (branch) FROM profile WHERE branch = 'store_2'",
    "store_arrays": "SELECT order_id, branch, unnest(items) AS item FROM bask",
    "store_csv": """SELECT order_id, array_to_string(items, '|') AS items_set, CAST(len(items) AS INTEGER) AS n_items, branch, channel, CAST(hour(ts) AS INTEGER) AS hour FROM bask""",
    "store_documents": f"SELECT 'Coffee & Milkshake Combo Uplift' AS strategy, * FROM ({_B['growth_actions']})",
    "store_items": "SELECT branch || '#' || day_of_week AS pk, CAST(hour AS VARCHAR) AS sk, avg_active_employees FROM profile",
}
SQL: dict[str, str] = {name: oracle.half_even(oracle.with_parts(body)) for name, body in BODIES.items()}
