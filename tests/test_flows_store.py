import datetime as dt

import pytest
from pyspark.sql import functions as F

import fixtures
from tillwork.functions.rules import RegionRule
from tillwork.plans import flows, lookups, store
from tillwork.sources import tables
from tillwork.streaming import intake

ZONES = {"Harbour": "north", "Hill": "south", "Moon": "east"}
REGIONS = (RegionRule("north", "North", "Harbour", ("N",)), RegionRule("south", "South", "Hill", ("S",)), RegionRule("east", "East", None, ("E",), "near"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Results of all five analytics over small invented tables, stored as one run after an older, incomplete one."""
    root = str(tmp_path_factory.mktemp("store"))
    branches = ["Harbour", "Hill", "Moon"]
    lines = spark.createDataFrame([(str(o), i, branches[o % 3], "DELIVERY" if o % 2 else "IN_STORE", dt.datetime(2025, 12, 1 + o % 28, o % 24))
                                   for o in range(90) for i in {f"cake {o % 4}", f"pie {o % 3}", "latte" if o % 5 < 3 else "bun"}],
                                  "order_id string, item string, branch string, channel string, timestamp timestamp")
    monthly = spark.createDataFrame([(b, dt.date(2025, m, 1), 1000.0 * (k + 1) + 70 * m * k) for k, b in enumerate(branches) for m in range(5, 12)],
                                    "branch string, date date, revenue double")
    shifts = spark.createDataFrame([(b, str(e), dt.date(2025, 12, d), "09:00:00", "17:30:00", True) for b in branches for e in range(2) for d in range(1, 15)],
                                   "branch string, emp_id string, date date, punch_in string, punch_out string, is_valid_shift boolean")
    menu = spark.createDataFrame([(b, c, n, n / 100) for b in branches[:2] for c, n in (("DELIVERY", 10.0), ("TABLE", 90.0))],
                                 "branch string, channel string, customers double, customer_share_within_branch double")
    orders = spark.createDataFrame([(branches[i % 3], f"c{i}", dt.datetime(2025, 12, 1 + i % 14, 9 + i % 8), 1 + i % 3) for i in range(60)],
                                   "branch string, customer string, last_order timestamp, num_orders int")
    items = spark.createDataFrame([(b, "latte", "coffee_hot", 10.0) for b in branches] + [(b, "pie", "core_food", 30.0) for b in branches],
                                  "branch string, item string, category string, amount double")
    out = {}
    pairs = flows.combos(lines, 0.0, 2)
    out.update(pairs)
    out.update(flows.staffing(shifts, menu, orders, monthly))
    out.update(flows.growth(pairs["order_baskets"].select("branch", F.col("items_set").alias("items_list")), items))
    out.update(flows.expansion({"monthly_sales": monthly}, ZONES, REGIONS))
    out.update(flows.forecast(monthly))
    store.write_table(monthly, root, "99999999", "demand_forecast_all", partition_by=[], sort_by=[])  # newer, never marked complete
    return root, flows.save(spark, root, out)


def test_newest_complete_run_wins(spark, stored):
    root, run = stored
    assert store.newest_run(spark, root) == run
    assert store.newest_run(spark, root + "/nowhere") is None
    again = store.write_run(spark, root + "/two", {"t": spark.range(1)})
    later = store.write_run(spark, root + "/two", {"t": spark.range(5)})
    assert later > again and store.read_table(spark, root + "/two", "t").count() == 5
    assert store.read_table(spark, root + "/two", "t", run_id=again).count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, root + "/two", "missing")
    assert store.read_table(spark, root + "/two", "missing", "a int").count() == 0


def test_forecast_lookups(spark, stored):
    root, _ = stored
    assert lookups.run(spark, root, "query_forecast").count() == 18
    assert [r.branch for r in lookups.run(spark, root, "query_forecast", compare=True).collect()] == ["Harbour", "Hill", "Moon"]
    assert lookups.run(spark, root, "query_forecast", branch="Hill", period=2).first().forecast_period == 2
    assert lookups.run(spark, root, "query_forecast", branch="Hill", period=9).count() == 6


def test_pair_lookups(spark, stored):
    root, _ = stored
    top = lookups.run(spark, root, "query_combos", top_n=3).collect()
    assert len(top) == 3 and top[0].lift >= top[2].lift >= 1 and all(r.scope == "overall" for r in top)
    assert {r.scope for r in lookups.run(spark, root, "query_combos", branch="Hill").collect()} == {"branch:Hill"}
    assert "across all branches and channels" in top[0].explanation
    both = lookups.run(spark, root, "query_combos", scope="branch:Hill|channel:DELIVERY", min_lift=0.0)
    assert both.count() > 0 and "at Hill via delivery orders" in both.first().explanation
    assert lookups.run(spark, root, "list_scopes").count() == 12
    plan = lookups.run(spark, root, "query_combos", branch="Hill")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope_type" in plan


def test_expansion_staffing_growth_lookups(spark, stored):
    root, _ = stored
    ranking = lookups.run(spark, root, "query_expansion").collect()
    assert ranking[0].feasibility_score >= ranking[-1].feasibility_score and len(ranking) == 3
    assert lookups.run(spark, root, "query_expansion", query_type="kpi", branch="HILL").first().branch == "Hill"
    assert lookups.run(spark, root, "query_expansion", query_type="recommendation").count() == 1
    assert lookups.run(spark, root, "query_staffing").count() == 3
    gaps = lookups.run(spark, root, "query_staffing", query_type="gaps", branch="Hill").collect()
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    assert gaps == sorted(gaps, key=lambda r: (days.index(r.day_of_week), r.hour)) and all(r.status != "balanced" for r in gaps)
    assert lookups.run(spark, root, "query_staffing", query_type="top_gaps").count() == 30
    assert lookups.run(spark, root, "query_growth").first().potential_rank == 1
    rules = lookups.run(spark, root, "query_growth", query_type="rules", branch="ALL").collect()
    assert rules and all(r.consequents == "latte" and r.is_total for r in rules)
    assert len(lookups.run(spark, root, "query_growth", query_type="recommendation").first().branch_actions) == 3
    assert lookups.run(spark, root, "query_growth", query_type="gap").count() == 3
    for kind, n in (("growth_summary", 3), ("risk_summary", 3), ("feasibility_explanation", 18)):
        assert lookups.run(spark, root, "query_expansion", query_type=kind, zones=ZONES).count() == n
    for name in ("query_expansion", "query_staffing", "query_growth"):
        with pytest.raises(ValueError):
            lookups.run(spark, root, name, query_type="weather")
    with pytest.raises(KeyError):
        lookups.run(spark, root, "query_weather")


def test_overview_and_pages(spark, stored):
    root, _ = stored
    sections = {r.section for r in lookups.run(spark, root, "get_overview").collect()}
    assert sections == {"forecast", "top_combos", "expansion_ranking", "staffing_summary", "growth_ranking"}
    assert {r.section for r in lookups.run(spark, root, "get_all_recommendations").collect()} == {"expansion", "growth", "staffing_top_gaps", "top_combos"}
    assert {r.section for r in lookups.run(spark, root, "page", feature="growth", branch="Hill").collect()} >= {"kpis", "potential"}
    places = [(r.section, r.position) for r in lookups.run(spark, root, "get_overview").where("section = 'growth_ranking'").collect()]
    assert sorted(places) == [("growth_ranking", i) for i in range(3)]
    assert lookups.run(spark, root, "query_forecast", as_json=True, compare=True).first().body.startswith("{")


def test_items_and_csv(spark, stored, tmp_path):
    root, _ = stored
    rows = store.key_value_items(store.read_table(spark, root, "demand_forecast_all"), ["branch", "scenario"], ["forecast_period"]).collect()
    assert {r.pk for r in rows} >= {"Hill#base", "Moon#surge_sensitive"} and {r.sk for r in rows} == {"1", "2", "3"}
    assert "similarity_estimate" not in rows[0].attributes
    found = store.read_table(spark, root, "branch_staffing_findings")
    store.write_table(found, str(tmp_path), "r", "found", fmt="csv", partition_by=["branch"])
    schema = found.drop("branch").schema
    back = tables.read_csv_table(spark, str(tmp_path / "run_id=r" / "found" / "branch=Hill"), schema)
    assert back.first().analysis_slots == found.where("branch = 'Hill'").first().analysis_slots


def test_coercion(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Emp_ID,Is Valid Shift,duration_hours,date,items\n 1 ,True,8.5,2025-12-01,\"['a','b']\"\n2,nope,x,bad,\n")
    schema = "emp_id int, is_valid_shift boolean, duration_hours double, date date, items array<string>, extra string"
    from pyspark.sql.types import _parse_datatype_string

    got = tables.read_csv_table(spark, str(tmp_path / "t.csv"), _parse_datatype_string(schema), {"duration_hours": 0.0}).collect()
    assert tuple(got[0]) == (1, True, 8.5, dt.date(2025, 12, 1), ["a", "b"], None)
    assert tuple(got[1]) == (2, False, 0.0, None, None, None)
    with pytest.raises(FileNotFoundError):
        tables.read_pairs(spark, str(tmp_path / "none"))


def test_incremental_intake(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    fixtures.write(inbox, {"a_monthly.csv": fixtures.MONTHLY, "b_menu.csv": fixtures.MENU})
    intake.start(spark, str(inbox), out, mark).awaitTermination()
    assert spark.read.parquet(f"{out}/monthly_sales").count() == 4
    fixtures.write(inbox, {"c_copy.csv": fixtures.MONTHLY, "d_more.csv": fixtures.MONTHLY.replace("Harbour", "Moon")})
    intake.start(spark, str(inbox), out, mark).awaitTermination()
    got = spark.read.parquet(f"{out}/monthly_sales")
    assert got.count() == 8 and {r.branch for r in got.collect()} == {"Harbour", "Hill", "Moon"}
    audit = {r.file: r.reason for r in spark.read.parquet(f"{out}/file_audit").collect()}
    assert audit["c_copy.csv"] == "duplicate of a_monthly.csv" and audit["d_more.csv"] is None
    assert spark.read.parquet(f"{out}/avg_sales_menu").count() == 3
    clean = intake.cleaned(spark, out)
    assert {r.branch: r.is_partial_history for r in clean["monthly_sales"].collect()} == {"Harbour": False, "Hill": True, "Moon": False}
    assert {r.canonical_branch_name for r in clean["dim_branch"].collect()} >= {"Harbour", "Hill", "Moon"}


def test_csv_of_the_store_is_read_back(spark, tmp_path):
    rows = [("1", ['a "b"', "c, d"], 1.5), ("2", [], None), ("3", None, 2.0)]
    df = spark.createDataFrame(rows, "id string, items array<string>, x double")
    store.write_table(df, str(tmp_path), "1", "t", "csv")
    got = tables.read_csv_table(spark, store.table_path(str(tmp_path), "1", "t"), df.schema)
    assert sorted((r.id, r["items"], r.x) for r in got.collect()) == rows
