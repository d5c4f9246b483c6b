import datetime as dt

from pyspark.sql import functions as F

from tillwork.functions import arrays, scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    rows = spark.createDataFrame([(1, '"1,234.50"'), (2, "-"), (3, ""), (4, " -3 "), (5, "1.2.3"), (6, "7."), (7, None)], "i int, s string")
    got = {r.i: r.x for r in rows.select("i", S.parse_number(F.col("s")).alias("x")).collect()}
    assert got == {1: 1234.5, 2: None, 3: None, 4: -3.0, 5: None, 6: 7.0, 7: None}


def test_duration_and_buckets(spark):
    assert one(spark, S.duration_hours(F.lit("11.30.36"))) == 11.51
    assert one(spark, S.duration_hours(F.lit("01:15:00"))) == 1.25
    assert one(spark, S.duration_hours(F.lit("1.5"))) is None
    hours = spark.createDataFrame([(0,), (5,), (6,), (11,), (12,), (16,), (17,), (23,)], "h int")
    assert [r.x for r in hours.select(S.hour_shift(F.col("h")).alias("x")).collect()] == [
        "overnight", "overnight", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]
    assert [r.x for r in hours.select(S.punch_shift(F.col("h")).alias("x")).collect()] == [
        "morning", "morning", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]


def test_rounding_is_half_to_even_like_numpy(spark):
    assert one(spark, S.round_to(F.lit(0.125), 2)) == 0.12
    assert one(spark, S.round_to(F.lit(0.375), 2)) == 0.38
    assert one(spark, S.round_to(F.lit(2.675), 2)) == 2.68  # 267.49999999999994 scaled is 267.5


def test_elapsed_days_counts_whole_days(spark):
    a, b = dt.datetime(2025, 3, 2, 9, 0), dt.datetime(2025, 3, 1, 10, 0)
    df = spark.createDataFrame([(a, b)], "a timestamp, b timestamp")
    assert df.select(S.elapsed_days(F.col("a"), F.col("b")).alias("x")).first().x == 0


def test_classifier(spark):
    names = ["iced latte", "frappes", "lotus sauce", "mint-mocha bar", "strawberry shake", "orange juice", "chocolate cake", "teapot"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.c for r in df.select("n", S.keyword_class(F.col("n")).alias("c")).collect()}
    assert got == {"iced latte": "coffee", "frappes": None, "lotus sauce": None, "mint-mocha bar": "coffee",
                   "strawberry shake": "milkshake", "orange juice": "other_bev", "chocolate cake": None, "teapot": None}


def test_item_lists(spark):
    texts = ["['Iced  Latte', \"Cake\"]", '["a","b"]', "x, 'Y' ,", "nan", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.orderBy("i").select(S.parse_items(F.col("t")).alias("x")).collect()]
    assert got == [["iced latte", "cake"], ["a", "b"], ["x", "y"], [], [], []]


def test_category_precedence(spark):
    rows = [("Hot Coffee", False), ("Iced Coffee", False), ("Milkshakes", True), ("Tea & Hot Coffee", False), ("Juices", True), ("Pies", True), ("Pies", False)]
    df = spark.createDataFrame(rows, "d string, m boolean")
    assert [r.x for r in df.select(S.item_category(F.col("d"), F.col("m")).alias("x")).collect()] == [
        "coffee_hot", "coffee_cold", "milkshake", "coffee_hot", "other_beverage", "modifier", "core_food"]


def test_names_and_clamp(spark):
    names = [("harbour", "north"), ("market", "south")]
    df = spark.createDataFrame([("Branch Name: Harbour Cafe",), ("Old Market",), ("Hill",)], "b string")
    assert [r.x for r in df.select(S.canonical_name(F.col("b"), names).alias("x")).collect()] == ["north", "south", None]
    assert one(spark, S.clamp_share(F.lit(0.5))) == 0.2
    assert one(spark, S.clamp_share(F.lit(None).cast("double"))) is None
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.ratio_or_value(F.lit(3), F.lit(0))) == 3.0


def test_weighted_median_and_percentile(spark):
    def pairs(*vw):
        return F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(float(w)).alias("w")) for v, w in vw])

    assert one(spark, arrays.weighted_median(pairs((30, 1), (10, 1), (20, 1)))) == 20
    # Total 3.5, half 1.75: cumulative 1.0, 1.5, 2.5 -> third value.
    assert one(spark, arrays.weighted_median(pairs((10, 1), (15, 0.5), (20, 1), (30, 1)))) == 20
    assert one(spark, arrays.array_percentile(F.array(F.lit(1.0), F.lit(10.0), F.lit(3.0), F.lit(2.0)), 0.25)) == 1.75
    assert one(spark, arrays.top_names({"a": F.lit(0.1), "b": F.lit(0.3), "c": F.lit(0.3)})) == "b, c"
