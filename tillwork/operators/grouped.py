"""Group statistics that stay spread over tasks when one group holds a large part of the rows.

A window partitioned by the group, or an exact percentile aggregate, brings a whole group into one task. The
operators here first reduce to (group, value, count), cut the values of a group into ordered buckets with a pure
expression, and let only the per-bucket counts of a group meet in one task. Results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS_PER_OCTAVE = 1024


def value_bucket(x: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Order-preserving bucket number of a number: equal or larger values never get a smaller bucket."""
    x = x.cast("double")
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    within = (size / F.pow(F.lit(2.0), octave) - 1) * per_octave
    rank = octave * per_octave + F.floor(within) + F.lit(1100 * per_octave)
    return F.when(x == 0, F.lit(0)).when(x > 0, rank).otherwise(-rank).cast("long")


def with_group_total(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over each group: partial aggregation and a join instead of a window."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(out))
    return df.join(totals, list(keys), "left")


def with_dense_rank_desc(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the dense rank of ``value``, largest first, within each group. NULL values get NULL."""
    return _with_rank(df, keys, value, out, F.lit(1))


def with_rank_desc(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the rank of ``value``, largest first, ties sharing the smallest rank. NULL values get NULL."""
    return _with_rank(df, keys, value, out, F.count(F.lit(1)))


def _with_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, weight: Column) -> DataFrame:
    keys = list(keys)
    values = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(weight.alias("_w"))
              .withColumn("_b", value_bucket(F.col(value))))
    higher_buckets = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    before = (values.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n"))
              .select(*keys, "_b", F.coalesce(F.sum("_n").over(higher_buckets), F.lit(0)).alias("_before")))
    higher_values = W.partitionBy(*keys, "_b").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_w").over(higher_values), F.lit(0))
    ranks = (values.withColumn("_inside", inside).join(before, [*keys, "_b"])
             .select(*keys, value, (F.col("_inside") + F.col("_before") + 1).cast("int").alias(out)))
    return df.join(ranks, [*keys, value], "left")


def with_global_rank_desc(df: DataFrame, value: str, out: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Add the rank of ``value`` over the whole table, largest first; ties share the smallest rank or, with ``ties``, follow that order.

    No window spans the table: values are counted in ordered buckets, a bucket's place inside its octave comes from a window over that
    octave, and the sums of whole octaves (the exponents a double can have) are one array that every task reads as a constant.
    """
    octave = F.floor(F.col("_b") / BUCKETS_PER_OCTAVE)
    values = (df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_w"))
              .withColumn("_b", value_bucket(F.col(value))).withColumn("_o", octave))
    sums = values.groupBy("_o", "_b").agg(F.sum("_w").alias("_n"))
    octaves = sums.groupBy("_o").agg(F.sum("_n").alias("n")).agg(F.collect_list(F.struct(F.col("_o").alias("o"), "n"))).scalar()
    higher = W.partitionBy("_o").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    above = F.aggregate(F.filter("_octaves", lambda x: x["o"] > F.col("_o")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    before = (sums.withColumn("_octaves", octaves)
              .select("_o", "_b", (above + F.coalesce(F.sum("_n").over(higher), F.lit(0))).alias("_before")))
    inside = W.partitionBy("_o", "_b").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    ranks = (values.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(before, ["_o", "_b"])
             .select(value, (F.col("_inside") + F.col("_before") + 1).cast("int").alias(out)))
    ranked = df.join(ranks, value, "left")
    if not ties:
        return ranked
    return ranked.withColumn(out, F.col(out) + F.row_number().over(W.partitionBy(value).orderBy(*ties)) - 1)


def group_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float], above: Mapping[str, float] | None = None,
                      count: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group and one column per entry of ``fractions``.

    Entries of ``above`` (all with the same bound) look at the values greater than it only; ``count`` adds the number of these. Without keys
    the whole table is one group.
    """
    if not keys:
        return group_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, fractions, above, count).drop("_all")
    keys, above = list(keys), above or {}
    bound = next(iter(above.values()), float("-inf"))
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", value_bucket(F.col("_v"))))
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = (counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.coalesce(F.sum(F.when(F.col("_v") <= bound, F.col("_n"))), F.lit(0)).alias("_bl"))
               .withColumn("_end", F.sum("_bn").over(running))
               .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys)))
               .withColumn("_low", F.sum("_bl").over(W.partitionBy(*keys)))
               .withColumn("_start", F.col("_end") - F.col("_bn")))

    def place(name: str) -> Column:
        """Position among all values of the group, from 0; the values up to the bound stand in front."""
        first = F.col("_low") if name in above else F.lit(0)
        return first + F.greatest(F.col("_total") - first - 1, F.lit(0)) * F.lit(float(fractions[name]))

    def positions(name: str) -> tuple[Column, Column]:
        return F.floor(place(name)), F.ceil(place(name))

    # A group without a value above the bound still keeps its row, by its first bucket.
    wanted = F.col("_start") == 0
    for name in fractions:
        for position in positions(name):
            wanted = wanted | ((position >= F.col("_start")) & (position < F.col("_end")))
    needed = buckets.where(wanted).select(*keys, "_b", "_start", "_total", "_low")
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (counted.join(needed, [*keys, "_b"])
              .withColumn("_to", F.col("_start") + F.sum("_n").over(inside))
              .withColumn("_from", F.col("_to") - F.col("_n")))

    picks = [F.max("_total").alias("_total"), F.max("_low").alias("_low")]
    for name in fractions:
        for side, position in zip(("lo", "hi"), positions(name)):
            hit = (position >= F.col("_from")) & (position < F.col("_to"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
    found = placed.groupBy(*keys).agg(*picks)
    columns = []
    for name in fractions:
        part = place(name) - F.floor(place(name))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * part).alias(name))
    if count:
        columns.append((F.col("_total") - F.col("_low")).alias(count))
    return found.select(*keys, *columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str | None = "rank") -> DataFrame:
    """First n rows of each group. Spark keeps only n rows per group and task before the shuffle."""
    ranked = df.withColumn(out or "_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(out or "_rank") <= n)
    return ranked if out else ranked.drop("_rank")
