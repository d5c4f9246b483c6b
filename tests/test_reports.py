import datetime as dt

import pytest
from pyspark.sql import functions as F

import fixtures
from tillwork.operators import tables as T
from tillwork.plans import flows
from tillwork.sources import lines as L, reports as R

NAMES = [("harbour", "harbour"), ("hill", "hill")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("reports")
    fixtures.write(path)
    return path


@pytest.fixture(scope="module", params=["96", "134217728"])
def result(request, spark, folder):
    """All tables, once with files cut into tiny blocks and once with a block per file."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    out = flows.etl(spark, str(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_registry_has_six_types():
    assert len(R.REGISTRY) == 6


def test_detection(spark):
    heads = [(1, ["Monthly Sales Summary", "Branch,Jan", "A,1"], "monthly_sales"), (2, ["random", "x,y"], None),
             (3, ["Time & Attendance Report", "Employee,Hours"], "attendance"), (4, ["Sales by Items by Group", "Group,Amount"], "items_by_group"),
             (5, ["monthly", "sales"], None)]
    df = spark.createDataFrame([(i, h) for i, h, _ in heads], "i int, head array<string>")
    got = {r.i: r.t for r in df.select("i", R.detect_type(R.head_text()).alias("t")).collect()}
    assert got == {i: t for i, _, t in heads}


def test_audit(result):
    got = {r.file: (r.report_type, r.status, r.reason) for r in result["file_audit"].collect()}
    assert got["z_copy.csv"] == (None, "skipped", "duplicate of a_monthly.csv")
    assert got["y_unknown.csv"] == (None, "skipped", "unknown report type")
    assert {t for t, s, _ in got.values() if s == "parsed"} == set(R._PARSERS)


def test_hash_covers_the_whole_file_and_no_split(spark, tmp_path):
    body = "x,1\n" * 3000
    for name, tail in (("a.csv", "1\n"), ("b.csv", "2\n"), ("c.csv", "1\n"), ("d.csv", "1")):
        (tmp_path / name).write_text(body + tail)
    old, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in ("96", "1000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append({r.file: r.hash for r in L.fingerprints(L.place(L.scan(spark.read, str(tmp_path)))).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] == found[2]
    assert found[0]["a.csv"] == found[0]["c.csv"] and len(set(found[0].values())) == 3


def test_late_differences_and_empty_files_are_seen(spark, tmp_path):
    filler = "".join(f",Year: 2025,,Page {i} of, 900\n" for i in range(900))
    first = "Monthly Sales,,,,\n" + filler + "Branch Name: Hill,,,,\nMay,,2025,\"1.00\",\n"
    (tmp_path / "a.csv").write_text(first)
    (tmp_path / "b.csv").write_text(first.replace("May", "June"))
    (tmp_path / "c.csv").write_text("")
    got = flows.etl(spark, str(tmp_path))
    assert rows(got["monthly_sales"], "month") == [("June",), ("May",)]
    assert {r.file: (r.status, r.reason) for r in got["file_audit"].collect()} == {"a.csv": ("parsed", None), "b.csv": ("parsed", None), "c.csv": ("skipped", "empty")}


def test_all_cells_of_a_line(spark):
    line = "Total By Branch," + ",".join(f"{i}.00" for i in range(1, 17)) + ',"17.00"'
    odd = ' a ,"b ""q"", c",,"x'
    got = L.split_cells(spark.createDataFrame([(line,), (odd,), ("only,,,",), ("," * 17 + "late",), ("",)], "line string"))
    cells = [r.cells for r in got.collect()]
    assert cells[0][-1] == "17.00" and len(cells[0]) == 18
    assert cells[1] == ["a", 'b "q", c', None, '"x']
    assert [r[0] for r in got.select(L.is_label()).collect()] == [False, False, True, False, False]


def test_long_tax_lines_counts_and_wrapped_rows(spark, tmp_path, small_blocks):
    tax = "Branch Name: Harbour,\nTotal By Branch," + ",".join(f'"{i}.00"' for i in range(1, 18)) + ",\n"
    orders = ("Customer Orders (Delivery),,,\nHarbour,,,\nPerson_0001,Street 5,81111\n,c/o\n,2025-01-02 10:00\n,2025-01-05 09:00\n,\"1,200.00\"\n,650,\n"
              "Hill,,,\nPerson_0002,Lane,82222,2025-01-02 10:00,2025-01-02 10:00,\"7.00\",501,\nPerson_0003,Lane,8,,,\"3.00\",4,\nPerson_0004,Lane,8,,,\"3.00\"\n")
    (tmp_path / "tax.csv").write_text(tax)
    assert rows(R.tax_summary(L.read_lines(spark, str(tmp_path))), "vat", "total_tax") == [(1.0, 17.0)]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "orders.csv").write_text(orders)
    got = rows(R.customer_orders(L.read_lines(spark, str(tmp_path / "o")), wrapped=True).na.fill(-1), "customer", "branch", "total", "num_orders", "last_order")
    assert got == [("Person_0001", "Harbour", 1200.0, 650, dt.datetime(2025, 1, 5, 9)), ("Person_0002", "Hill", 7.0, 501, dt.datetime(2025, 1, 2, 10)),
                   ("Person_0003", "Hill", 3.0, 4, None), ("Person_0004", "Hill", 3.0, 8, None)]


def test_monthly(result):
    assert rows(result["monthly_sales"], "branch", "month", "year", "month_num", "date", "revenue", "is_partial_history") == [
        ("Harbour", "August", 2025, 8, dt.date(2025, 8, 1), 1000.5, False), ("Harbour", "October", 2025, 10, dt.date(2025, 10, 1), 3000.0, False),
        ("Harbour", "September", 2025, 9, dt.date(2025, 9, 1), 2000.0, False), ("Hill", "october", 2025, 10, dt.date(2025, 10, 1), 500.0, True)]


def test_menu(result):
    assert rows(result["avg_sales_menu"], "branch", "channel", "customers", "sales", "avg_per_customer", "sales_share_within_branch") == [
        ("Harbour", "DELIVERY", 10.0, 200.0, 20.0, 0.25), ("Harbour", "TAKE AWAY", 30.0, 600.0, 19.0, 0.75), ("Hill", "TABLE", 5.0, 100.0, 20.0, 1.0)]


def test_items(result):
    got = rows(result["items_by_group"].na.fill(0), "branch", "division", "group", "item", "amount", "is_modifier", "category",
               "item_rank_within_branch", "item_rank_within_division")
    assert got == [
        ("Harbour", "Hot Coffee", "Beans", "Dark Roast", 500.0, False, "coffee_hot", 2, 2),
        ("Harbour", "Hot Coffee", "Cups", "Espresso", 1500.0, False, "coffee_hot", 1, 1),
        ("Harbour", "Hot Coffee", "Cups", "Oat Milk", 0.0, True, "coffee_hot", 0, 0),
        ("Harbour", "Milkshakes", "Shakes", "Crème", 500.0, False, "milkshake", 2, 1),
        ("Hill", "", "Cakes", "Pie", 70.0, False, "core_food", 1, 1)]


def test_customer_orders(result):
    got = {r.customer: r for r in result["customer_orders"].collect()}
    one, two, three = (got[f"Person_000{i}"] for i in (1, 2, 3))
    assert (one.branch, one.phone, one.total, one.num_orders, one.avg_order_value, one.is_repeat_customer) == ("Harbour", "81 111", 1200.0, 3, 400.0, True)
    assert (one.recency_days, one.customer_lifespan_days) == (1, 2)
    assert two.last_order == two.first_order and two.is_zero_value_customer and two.num_orders == 1
    assert three.branch == "Hill" and three.recency_days == 0


def test_baskets(result):
    audit = result["transaction_baskets_audit_lines"]
    assert rows(audit, "basket_id", "branch", "customer", "item", "qty", "is_void", "is_modifier") == [
        (1, "Harbour", "Person_0001", "Cake", -1.0, True, False), (1, "Harbour", "Person_0001", "Cake", 2.0, False, False),
        (1, "Harbour", "Person_0001", "Latte", 1.0, False, False), (1, "Harbour", "Person_0001", "Syrup", 1.0, False, True),
        (2, "Harbour", "Person_0002", "Tea", 1.0, False, False), (2, "Hill", "Person_0002", "Pie", 1.0, False, False),
        (3, "Hill", "Person_0003", "Pie", -1.0, True, False)]
    core = result["transaction_baskets_basket_core"].where("basket_id = 1").first()
    assert core.items_list == ["Latte", "Cake"] and (core.unique_items, core.net_qty, core.net_total) == (2, 3.0, 5003.0)


def test_attendance(result):
    got = rows(result["attendance"].na.fill({"duration_hours": -1.0, "punch_out": ""}), "emp_id", "branch", "date", "punch_in", "punch_out",
               "duration_hours", "shift_type", "is_anomalous", "is_valid_shift", "weekend_flag")
    assert got == [
        ("1", "Harbour", dt.date(2025, 12, 1), "07:00:00", "15:30:00", 8.5, "morning", False, True, False),
        ("1", "Harbour", dt.date(2025, 12, 6), "22:30:00", "01:00:00", 2.5, "evening", False, True, True),
        ("1", "Harbour", dt.date(2025, 12, 7), "23:56:59", "23:57:04", 0.0, "evening", True, False, True),
        ("10", "Hill", dt.date(2025, 12, 2), "13:00:00", "16:00:00", 3.0, "afternoon", False, True, False),
        ("10", "Hill", dt.date(2025, 12, 3), "18:00:00", "", -1.0, "evening", False, False, False)]


def test_layers(result):
    dim = {r.canonical_branch_name: r for r in result["dim_branch"].collect()}
    assert dim["Harbour"].has_delivery and dim["Harbour"].has_takeaway and not dim["Harbour"].has_table and dim["Harbour"].months_of_data == 3
    checks = {(r.branch, r.source_a, r.source_b): (r.value_a, r.value_b, r.is_within_tolerance) for r in result["fact_reconciliation_checks"].collect()}
    assert checks[("Harbour", "monthly_sales", "avg_sales_menu")] == (6000.5, 800.0, False) and len(checks) == 6
    shift = {r.branch: r for r in result["feat_branch_shift"].collect()}
    assert (shift["Harbour"].valid_shifts, shift["Harbour"].median_hours, shift["Harbour"].total_shifts, shift["Harbour"].anomaly_rate) == (2, 5.5, 3, 0.3333)
    month = {(r.branch, r.month): r for r in result["feat_branch_month"].collect()}
    assert month[("Harbour", "October")].revenue_ma3 == 2000.17 and month[("Harbour", "October")].mom_growth == 0.5
    assert month[("Harbour", "August")].mom_growth is None and month[("Harbour", "August")].channel_delivery_share == 0.25


def test_wrapped_rows_and_named_sources(spark, tmp_path, small_blocks):
    text = ("Customer Orders (Delivery),,,\nHarbour,,,\nPerson_0001,Street,81111\n,2025-01-02 10:00,2025-01-05 09:00\n,\"1,200.00\",3,\n"
            "Person_0002,Lane,82222\n,,,\n,\"7.00\",1,\n")
    (tmp_path / "customer_orders_delivery.csv").write_text(text)
    (tmp_path / "tax_summary_by_branch.csv").write_text(fixtures.TAX)
    (tmp_path / "time_and_attendance_logs.csv").write_text(fixtures.PUNCHES)
    (tmp_path / "other.csv").write_text("nothing\n")
    got = R.load_named_sources(spark, str(tmp_path), NAMES)
    assert set(got) == {"customer_orders", "tax_summary", "attendance"}
    assert rows(got["customer_orders"], "branch", "customer", "total", "num_orders") == [("harbour", "Person_0001", 1200.0, 3)]
    assert rows(got["tax_summary"], "branch", "vat", "total_tax") == [("harbour", 427.5, 430.0)]
    # The line of an employee's total ends with a duration as well and counts, as in the rule this variant follows.
    hours = got["attendance"].withColumn("h", F.round("duration_hours", 4))
    assert rows(hours, "branch", "emp_id", "h") == [("harbour", "1.0", 2.5), ("harbour", "1.0", 8.5), ("harbour", "1.0", 11.0014), ("hill", "10.0", 3.0)]


def test_delivery_detail_clears_the_customer(spark, tmp_path, small_blocks):
    (tmp_path / "x.csv").write_text(fixtures.DETAIL)
    got = R.delivery_detail(L.read_lines(spark, str(tmp_path)), NAMES)
    assert rows(got, "branch", "customer", "item", "qty") == [
        ("harbour", "Person_0001", "Cake", 2.0), ("harbour", "Person_0001", "Latte", 1.0), ("harbour", "Person_0002", "Tea", 1.0)]


def test_carry_within_a_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b"), (1, 2, "user", "c"), (1, 3, "bot", "d"), (2, 0, "bot", "e")], "c int, t int, r string, x string")
    got = {(r.c, r.t): r.last for r in T.carry_last(df, ["c"], ["t"], F.col("r") == "user", F.col("x"), "last").collect()}
    assert got == {(1, 0): "a", (1, 1): "a", (1, 2): "c", (1, 3): "c", (2, 0): None}


def test_named_source_in_parts(spark, tmp_path, small_blocks):
    """a folder of parts is one file of its name: headers carry over parts, and the first source by name wins."""
    text = fixtures.DETAIL
    (tmp_path / "sales_by_customer_detail_delivery.csv").mkdir()
    cut = text.index("\n", len(text) // 2) + 1
    (tmp_path / "sales_by_customer_detail_delivery.csv" / "part-00000-x.txt").write_text(text[:cut])
    (tmp_path / "sales_by_customer_detail_delivery.csv" / "part-00010-x.txt").write_text(text[cut:])
    (tmp_path / "tax_summary_by_branch.csv").write_text(fixtures.TAX)
    (tmp_path / "other.csv").mkdir()
    (tmp_path / "other.csv" / "part-00000-x.txt").write_text("nothing\n")
    got = R.load_named_sources(spark, str(tmp_path), NAMES)
    assert set(got) == {"delivery_detail", "tax_summary"}
    assert rows(got["delivery_detail"], "branch", "customer", "item", "qty") == [
        ("harbour", "Person_0001", "Cake", 2.0), ("harbour", "Person_0001", "Latte", 1.0), ("harbour", "Person_0002", "Tea", 1.0)]
    assert rows(got["tax_summary"], "branch", "vat", "total_tax") == [("harbour", 427.5, 430.0)]


def test_named_parts_keep_the_order(spark, tmp_path):
    """several tasks write a named source, and its parts read back in order."""
    from tillwork.plans import filed, received

    made = spark.range(2000, numPartitions=4).select((F.col("id") % 3).cast("int").alias("file"), filed._at(F.col("id")).alias("at"), F.col("id").cast("string").alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        received._named_parts(made, str(tmp_path), "x.csv")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "x.csv").glob("part-*"))) > 1
    got = L.scan_parts(spark, str(tmp_path / "x.csv"), "x.csv").orderBy("block", "pos").select(F.decode("bytes", "UTF-8").cast("int")).collect()
    assert [r[0] for r in got] == sorted(range(2000), key=lambda i: (i % 3, i))


def test_blocks_grow_with_the_files(spark):
    """the number of blocks of a file has a bound that does not depend on its size, until blocks have their full size."""
    from tillwork.plans import filed

    made = spark.range(30_000).select((F.col("id") % 2).cast("int").alias("file"), filed._at(F.col("id")).alias("at"), F.lit("x" * 60).alias("line"))
    made = made.unionByName(spark.range(3).select(F.lit(2).alias("file"), filed._at(F.col("id")).alias("at"), F.lit("y").alias("line")))
    blocks = filed._written(spark, made, "blocks", 3, least=16 << 10).groupBy("path").agg(F.count_distinct("block").alias("n")).select("n").collect()
    assert sorted(r.n for r in blocks)[0] == 1 and all(1 < r.n <= 9 for r in blocks if r.n > 1) and len(blocks) == 3
    assert filed._written(spark, made, "blocks", 3).select("path", "block").distinct().count() == 3


def test_named_sources_hold_small_blocks_and_no_cells(spark, tmp_path, monkeypatch):
    """the lines of a block are held by one task, so a named source is read in small blocks and carried without cells."""
    staged, carried, stage = {}, [], R.stage

    def kept(df, name="stage"):
        staged[name] = stage(df, name)
        return staged[name]

    def told(f):
        return lambda lines, *args, **more: (carried.append(set(lines.columns)), f(lines, *args, **more))[1]

    monkeypatch.setattr(R, "stage", kept)
    monkeypatch.setattr(L, "carry", told(L.carry))
    monkeypatch.setattr(L, "previous", told(L.previous))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = "".join(f"Person_{i},,,\n" + ',2,"Cake, large","1,000.50",\n,-1,Tea,"2.00",\nTotal :,,,\n' for i in range(120_000))
    (tmp_path / "sales_by_customer_detail_delivery.csv").write_text("Branch :Harbour,,,\n" + orders)
    punches = "01-Dec-25,,08.00.00,01-Dec-25,16.30.00,08.30.00\n" * 100_000
    (tmp_path / "time_and_attendance_logs.csv").write_text(",EMP ID :1.0,NAME :Person_0001,,,\n,Harbour,,,,\n" + punches)
    got = R.load_named_sources(spark, str(tmp_path), NAMES)
    assert set(got) == {"delivery_detail", "attendance"} and spark.conf.get("spark.sql.files.maxPartitionBytes") == old
    for name in got:
        blocks = staged[name].groupBy("path", "block").agg(F.sum(F.length("line") + 1).alias("n")).select("n").collect()
        assert len(blocks) > 1 and max(r.n for r in blocks) <= L.BLOCK + 100
    assert not any(columns & {"cells", "c1", "c2", "c3"} for columns in carried)
    total = got["delivery_detail"].groupBy("branch", "item", "qty", "price").agg(F.count_distinct("customer").alias("n"))
    assert [tuple(r) for r in total.collect()] == [("harbour", "Cake, large", 2.0, 1000.5, 120_000)]
    assert [tuple(r) for r in got["attendance"].groupBy("branch", "emp_id", "duration_hours").count().collect()] == [("harbour", "1.0", 8.5, 100_000)]
