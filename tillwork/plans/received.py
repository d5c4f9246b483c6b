"""Queries over folders of report files of several kinds: incremental intake, routing by content, sources by name; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S

from ..session import stage
from ..sources import lines as L, reports as R
from ..streaming import intake
from . import filed, oracle, star


def _put(rows: DataFrame, folder: str) -> None:
    """Rows (file int, at, line) as one text file per file number below ``folder``."""
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.mode("append").partitionBy("file").text(folder)


def _months(spark: SparkSession, d: str) -> DataFrame:
    """Monthly sales with the number of the file that reports them: one for each branch and year."""
    branch = F.array_position(F.array(*[F.lit(b) for b in sorted(star.ZONES)]), F.col("branch"))
    return star.monthly_sales(spark, d).withColumn("file", (F.col("year") * 10 + branch).cast("int"))


def _month_rows(months: DataFrame, title: str = "Monthly Sales") -> DataFrame:
    """The months as report lines (file, at, line): title, branch, column header, months, yearly total."""
    amount = F.format_string('"%,.2f"', "revenue")
    body = months.select("file", filed._at(1, F.col("month_num")).alias("at"), F.format_string("%s,,%d,%s,", "month", "year", amount).alias("line"))
    total = months.groupBy("file", "year").agg(F.sum(S.money(F.col("revenue"))).cast("double").alias("revenue")).select(
        "file", filed._at(2, 0).alias("at"), F.format_string(",,Total for    %d,%s", "year", amount).alias("line"))
    head = months.select("file", "branch").distinct().select("file", filed._lines(
        (filed._at(0, 0), F.lit(f"{title},,,,")), (filed._at(0, 1), F.concat(F.lit("Branch Name: "), F.col("branch"), F.lit(",,,,"))),
        (filed._at(0, 2), F.lit("Month,,Year,Total,"))))
    return body.unionByName(total).unionByName(head)


def intake_incremental(spark, d):
    """Two micro-batches of report files: months up to 1997 and half the menu files, then the rest with a copy of the files of 1995 under new
    names; then a run that finds nothing new. The tables of all batches and what is derived from them."""
    inbox, out, mark = (filed._folder(spark, n) for n in ("inbox", "taken", "mark"))
    months, menu = stage(_months(spark, d), "months"), filed.menu_rows(spark, d)
    menu = stage(menu, "menu").withColumn("second", F.pmod("file", F.lit(2)) == 1)
    _put(_month_rows(months.where("year <= 1997")), f"{inbox}/monthly")
    _put(menu.where("not second"), f"{inbox}/menu")

    def run():
        intake.start(spark, f"{inbox}/*/*", out, mark, "*.txt").awaitTermination()

    run()
    _put(_month_rows(months.where("year > 1997")), f"{inbox}/monthly")
    _put(_month_rows(months.where("year = 1995").withColumn("file", F.col("file") + 1_000_000)), f"{inbox}/copies")
    _put(menu.where("second"), f"{inbox}/menu")
    run()
    run()
    clean, text = intake.cleaned(spark, out), lambda c: F.col(c).cast("string")
    number = lambda c: F.col(c).cast("double").alias("value")
    audit = spark.read.parquet(f"{out}/{intake.AUDIT}")
    kind = F.when(F.col("reason").startswith("duplicate"), "duplicate").otherwise(F.coalesce("report_type", F.lit("unknown")))
    audit = audit.groupBy(F.format_string("batch %d", F.col("batch") + 1).alias("a"), kind.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    month, shares = clean["monthly_sales"], clean["avg_sales_menu"]
    parts = {
        "monthly_sales": month.select(F.col("branch").alias("a"), text("date").alias("b"), number("revenue")),
        "is_partial_history": month.select(F.col("branch").alias("a"), text("date").alias("b"), number("is_partial_history")),
        "sales_share": shares.select(F.col("branch").alias("a"), F.col("channel").alias("b"), number("sales_share_within_branch")),
        "revenue_ma3": clean["feat_branch_month"].select(F.col("branch").alias("a"), text("date").alias("b"), number("revenue_ma3")),
        "months_of_data": clean["dim_branch"].select(F.col("canonical_branch_name").alias("a"), text("has_delivery").alias("b"), number("months_of_data")),
        "file_audit": audit.select("a", "b", number("n")),
    }
    rows = [df.select(F.lit(name).alias("layer"), "a", "b", S.round_to("value", 4).alias("value")) for name, df in parts.items()]
    out_df = rows[0]
    for df in rows[1:]:
        out_df = out_df.unionByName(df)
    return out_df


ROUTED = tuple(R.ReportSpec(s.name, s.detect, "monthly sales by branch" if s.name == "monthly_sales" else s.require, s.parse) for s in R.REGISTRY)


def report_routing(spark, d):
    """One folder with monthly, menu, item, punch and unknown files and an empty one; a monthly file must also say "by branch" to be parsed.

    Audit by type and reason, and the parsed rows of each type.
    """
    folder = filed._folder(spark, "mixed")
    months = stage(_months(spark, d), "months")
    _put(_month_rows(months.where("year % 2 = 0"), "Monthly Sales by Branch"), f"{folder}/a")
    _put(_month_rows(months.where("year % 2 = 1")), f"{folder}/b")
    _put(filed.menu_rows(spark, d), f"{folder}/c")
    _put(_titled(filed.hours_rows(spark, d), "Time & Attendance Report,,,,"), f"{folder}/d")
    _put(_titled(filed.delivery_rows(spark, d), "Sales by customer in details,,,"), f"{folder}/e")
    _put(_titled(filed.tax_rows(spark, d), "Tax Report,,,"), f"{folder}/f")  # of no type that is found by its content
    spark.range(0, 1, 1, 1).where("id < 0").select(F.lit("").alias("line")).write.text(f"{folder}/g/file=0")
    path = f"{folder}/*/*"
    lines = stage(L.read_lines(spark, path, "*.txt"), "mixed_lines")
    audit = stage(R.audit_files(lines, ROUTED, listed=L.list_files(spark, path, "*.txt")), "mixed_audit")
    parsed = R.parse_all(lines, audit, ROUTED)
    none = F.lit(None).cast("string")
    rows = audit.groupBy("report_type", "status", "reason").agg(F.count(F.lit(1)).alias("n"))
    for name, df in parsed.items():
        rows = rows.unionByName(df.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("report_type"), F.concat(F.lit("rows of "), F.col("branch")).alias("status"), none.alias("reason"), "n"))
    return rows


def _titled(rows: DataFrame, title: str) -> DataFrame:
    first = rows.select("file").distinct()
    smallest = F.struct(*[F.lit(-(1 << 62)).alias(f.name) for f in rows.schema["at"].dataType.fields])
    return rows.unionByName(first.select("file", smallest.alias("at"), F.lit(title).alias("line")))


def _named_file(rows: DataFrame, folder: str, name: str) -> None:
    """Rows (file, at, line), a few per month, as one file of that name, written by one task."""
    spark = rows.sparkSession
    rows.repartition(1).sortWithinPartitions("file", "at").select("line").write.text(f"{folder}/.{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = fs.globStatus(path(f"{folder}/.{name}/part-*"))[0].getPath()
    fs.rename(part, path(f"{folder}/{name}"))


def _named_parts(rows: DataFrame, folder: str, name: str) -> None:
    """Rows (file, at, line) as a folder of that name whose parts hold them in order; any number of tasks write it."""
    rows.repartitionByRange("file", "at").sortWithinPartitions("file", "at").select("line").write.text(f"{folder}/{name}")


NAMES = [(b.lower(), b) for b in sorted(star.ZONES)] + [(f"store {i}", f"store_{i}") for i in range(5)]


def named_sources(spark, d):
    """Sources recognised by file name in any case, the first of two files of a source, an unknown file, and sources that are absent."""
    folder = filed._folder(spark, "named")
    months = stage(_months(spark, d), "months")
    _named_file(_month_rows(months), folder, "REP_S_00334_1_SMRY.csv")  # before the next one by name
    _named_file(_month_rows(months.where("year = 1995")), folder, "monthly_sales_by_branch.csv")
    _named_file(filed.tax_rows(spark, d), folder, "tax_summary_by_branch.csv")
    _named_parts(filed.hours_rows(spark, d), folder, "Time_And_Attendance_Logs.csv")
    _named_parts(filed.delivery_rows(spark, d), folder, "sales_by_customer_detail_delivery.csv")
    _named_file(filed.menu_rows(spark, d), folder, "menu.csv")
    got = R.load_named_sources(spark, folder, NAMES)
    value = {"monthly_sales": "revenue", "tax_summary": "total_tax", "attendance": "duration_hours", "delivery_detail": "price", "customer_orders": "total"}
    rows = [df.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), S.round_to(F.sum(F.col(value[s]).cast("decimal(28,6)")).cast("double"), 2).alias("value")).select(
        F.lit(s).alias("source"), "branch", "n", "value") for s, df in got.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (intake_incremental, report_routing, named_sources)}

_MENU = filed.BODIES["report_menu"]
_YEARS = "SELECT DISTINCT branch, year(date) AS y FROM months"
BODIES: dict[str, str] = {
    "intake_incremental": f"""SELECT layer, a, b, round(value, 4) AS value FROM (
        SELECT 'monthly_sales' AS layer, branch AS a, CAST(date AS VARCHAR) AS b, revenue AS value FROM months
        UNION ALL SELECT 'is_partial_history', branch, CAST(date AS VARCHAR), CASE WHEN is_partial_history THEN 1.0 ELSE 0.0 END::DOUBLE FROM ({oracle.BODIES['partial_history']})
        UNION ALL SELECT 'sales_share', branch, channel, sales / sum(sales) OVER (PARTITION BY branch) FROM ({_MENU})
        UNION ALL SELECT 'revenue_ma3', branch, CAST(date AS VARCHAR), revenue_ma3 FROM (SELECT branch, date, round(avg(revenue) OVER (PARTITION BY branch ORDER BY date ROWS 2 PRECEDING), 2) AS revenue_ma3 FROM months)
        UNION ALL SELECT 'months_of_data', branch, CAST(count(*) FILTER (WHERE NOT d IS NULL AND d = 'DELIVERY') > 0 AS VARCHAR), CAST(count(*) FILTER (WHERE d IS NULL) AS DOUBLE) FROM (
            SELECT branch, CAST(NULL AS VARCHAR) AS d FROM months UNION ALL SELECT branch, channel FROM ({_MENU})) GROUP BY branch
        UNION ALL SELECT 'file_audit', 'batch 1', 'monthly_sales', CAST(count(*) AS DOUBLE) FROM ({_YEARS}) WHERE y <= 1997
        UNION ALL SELECT 'file_audit', 'batch 2', 'monthly_sales', CAST(count(*) AS DOUBLE) FROM ({_YEARS}) WHERE y > 1997
        UNION ALL SELECT 'file_audit', 'batch 2', 'duplicate', CAST(count(*) AS DOUBLE) FROM ({_YEARS}) WHERE y = 1995
        UNION ALL SELECT 'file_audit', CASE WHEN branch IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'batch 1' ELSE 'batch 2' END, 'avg_sales_menu', CAST(count(DISTINCT branch) AS DOUBLE)
            FROM menu GROUP BY 2)""",
    "report_routing": f"""SELECT 'monthly_sales' AS report_type, 'parsed' AS status, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM ({_YEARS}) WHERE y % 2 = 0
        UNION ALL SELECT 'monthly_sales', 'skipped', 'signature missing for monthly_sales', count(*) FROM ({_YEARS}) WHERE y % 2 = 1
        UNION ALL SELECT 'avg_sales_menu', 'parsed', NULL, count(DISTINCT branch) FROM menu
        UNION ALL SELECT 'attendance', 'parsed', NULL, count(DISTINCT CAST(emp_id AS BIGINT) % 16) FROM shift0
        UNION ALL SELECT 'transaction_baskets', 'parsed', NULL, count(DISTINCT o_orderkey % 64) FROM ord
        UNION ALL SELECT NULL, 'skipped', 'unknown report type', count(DISTINCT year(date)) FROM months
        UNION ALL SELECT NULL, 'skipped', 'empty', 1
        UNION ALL SELECT 'monthly_sales', 'rows of ' || branch, NULL, count(*) FROM months WHERE year(date) % 2 = 0 GROUP BY branch
        UNION ALL SELECT 'avg_sales_menu', 'rows of ' || branch, NULL, count(*) FROM ({_MENU}) GROUP BY branch
        UNION ALL SELECT 'attendance', 'rows of Store ' || right(branch, 1), NULL, count(*) FROM shift0 GROUP BY branch
        UNION ALL SELECT 'transaction_baskets', 'rows of ' || branch, NULL, count(*) FROM lineitem JOIN ord ON l_orderkey = o_orderkey GROUP BY branch""",
    "named_sources": f"""SELECT 'monthly_sales' AS source, branch, count(*) AS n, round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE), 2) AS value FROM months GROUP BY branch
        UNION ALL SELECT 'tax_summary', branch, count(*), round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE), 2) FROM months GROUP BY branch
        UNION ALL SELECT 'attendance', branch, count(*), round(CAST(sum(CAST(x AS DECIMAL(28,6))) AS DOUBLE), 2) FROM (SELECT branch, {filed._H} AS x FROM shift0) WHERE x > 0.1 GROUP BY branch
        UNION ALL SELECT 'delivery_detail', branch, count(*), round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2)
            FROM lineitem JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY branch""",
}
SQL: dict[str, str] = {name: oracle.half_even(oracle.with_parts(body)) for name, body in BODIES.items()}
