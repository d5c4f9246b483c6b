"""Order statistics over the few values inside one row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def weighted_median(pairs: Column) -> Column:
    """First value, in ascending order, at which the cumulative weight reaches half of the total.

    ``pairs`` is an array of ``struct<v: double, w: double>``.
    """
    ordered = F.array_sort(pairs)
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["w"])
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("pick"))

    def step(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + x["w"]
        return F.struct(cum.alias("cum"), F.coalesce(acc["pick"], F.when(cum >= total / 2, x["v"])).alias("pick"))

    return F.aggregate(ordered, start, step, lambda acc: acc["pick"])


def array_percentile(values: Column, fraction: float) -> Column:
    """Percentile with linear interpolation of a short array without NULLs."""
    ordered = F.array_sort(values)
    last = F.size(ordered) - 1
    k = last * F.lit(fraction)
    low = F.floor(k).cast("int")
    high = F.least(low + 1, last)
    return F.get(ordered, low) + (k - low) * (F.get(ordered, high) - F.get(ordered, low))


def top_names(contributions: Mapping[str, Column], n: int = 2) -> Column:
    """Names of the n largest contributions, ties in declaration order, joined by a comma."""
    ranked = F.array_sort(F.array(*[
        F.struct((-value).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("name"))
        for i, (name, value) in enumerate(contributions.items())
    ]))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda x: x["name"]), ", ")
