import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tillwork.operators import grouped


def frame(seed=1, n=3000):
    rng = random.Random(seed)
    # One group holds most rows; values repeat, are negative, zero and NULL.
    rows = [(("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}"),
             rng.choice([None, 0.0, round(rng.uniform(-50, 50), 1), round(rng.lognormvariate(5, 3), 2)]), i) for i in range(n)]
    return rows


def test_bucket_keeps_order(spark):
    values = sorted([0.0, 1.0, 2.0, 4.0, 1023.99, 1024.0, 1e-9, 3.3e12, -1.0, -2.5, -1e6, 0.1, 7.999999, 8.0])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select("v", grouped.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_ranks_match_pandas(spark):
    rows = frame()
    pdf = pd.DataFrame(rows, columns=["g", "v", "i"])
    df = spark.createDataFrame(rows, "g string, v double, i int")
    for name, method, make in (("dense", "dense", grouped.with_dense_rank_desc), ("plain", "min", grouped.with_rank_desc)):
        got = make(df, ["g"], "v", "r").toPandas().sort_values("i")["r"].to_numpy(dtype=float)
        want = pdf.groupby("g")["v"].rank(method=method, ascending=False).to_numpy()
        np.testing.assert_array_equal(got, want)


def test_percentiles_match_pandas(spark):
    rows = frame(2)
    pdf = pd.DataFrame(rows, columns=["g", "v", "i"])
    df = spark.createDataFrame(rows, "g string, v double, i int")
    q = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.66, "e": 1.0}
    got = grouped.group_percentiles(df, ["g"], "v", q).toPandas().set_index("g").sort_index()
    for name, fraction in q.items():
        want = pdf.groupby("g")["v"].quantile(fraction).sort_index()
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(frame(3, 400), "g string, v double, i int")
    base = sorted(map(tuple, grouped.with_dense_rank_desc(df, ["g"], "v", "r").collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    other = sorted(map(tuple, grouped.with_dense_rank_desc(df.repartition(7), ["g"], "v", "r").collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert base == other


def test_global_rank_without_a_window_over_all_rows(spark):
    rng = random.Random(6)
    values = [rng.choice([0.0, -1.5, 0.25, 0.2500001, 3.0, 1e9, -2e-7, 0.5]) for _ in range(60)] + [rng.random() for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {r.id: r.r for r in grouped.with_global_rank_desc(df, "v", "r").collect()}
    assert got == {i: None if v is None else 1 + sum(x is not None and x > v for x in values) for i, v in enumerate(values)}
    order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: (-values[i], i))
    numbered = {r.id: r.r for r in grouped.with_global_rank_desc(df, "v", "r", [F.asc("id")]).collect() if r.v is not None}
    assert numbered == {i: k + 1 for k, i in enumerate(order)}
    plan = grouped.with_global_rank_desc(df, "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert all("SinglePartition" not in line or "HashAggregate" in line or "Exchange" in line for line in plan.split("\n")) and "Window" in plan


def test_percentiles_above_a_bound_and_without_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([0.0, 0.0, rng.random() * 9])) for _ in range(200)] + [("z", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in grouped.group_percentiles(df, ["g"], "v", {"m": 0.5, "q": 0.25}, {"q": 0.0}, "n").collect()}
    for g in "abcz":
        own = np.array([v for k, v in rows if k == g])
        above = own[own > 0]
        assert got[g].n == len(above) and abs(got[g].m - np.percentile(own, 50)) < 1e-12
        assert got[g].q is None if not len(above) else abs(got[g].q - np.percentile(above, 25)) < 1e-12
    total = grouped.group_percentiles(df, [], "v", {"m": 0.5}).collect()
    assert len(total) == 1 and abs(total[0].m - np.percentile([v for _, v in rows], 50)) < 1e-12
    assert grouped.group_percentiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []
