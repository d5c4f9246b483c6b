"""Baskets and pair association statistics over four scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from .grouped import top_per_group

PAIR_COLUMNS = ["scope", "scope_type", "branch", "channel", "item_a", "item_b", "n_orders", "count_a", "count_b",
                "count_ab", "support", "confidence_ab", "confidence_ba", "lift"]
RANKS = ("lift", "support", "count_ab")
CHUNK_ITEMS = 100  # items per block when a basket is paired block by block


def order_lines(df: DataFrame, marker: str = rules.DELIVERY_MARKER) -> DataFrame:
    """Normalise line items of any accepted layout to order_id, item, branch, channel, timestamp.

    Layouts: order lines, pipeline lines with ``basket_id``, or baskets with an ``items_list`` array. Without a
    ``channel`` column an order is DELIVERY if it holds the marker item.
    """
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if "order_id" not in df.columns and "basket_id" in df.columns:
        df = df.withColumnRenamed("basket_id", "order_id")
    if "item" not in df.columns and "items_list" in df.columns:
        if dict(df.dtypes)["items_list"] == "string":
            df = df.withColumn("items_list", F.from_json("items_list", "array<string>"))
        df = df.withColumn("item", F.explode("items_list"))
    missing = {"order_id", "item", "branch"} - set(df.columns)
    if missing:
        raise ValueError(f"line items lack the columns {sorted(missing)}; found {df.columns}")
    time = next((c for c in df.columns if c in ("timestamp", "date", "order_date")), None)
    if time is None:
        stamp = F.lit(None).cast("timestamp")
    elif dict(df.dtypes)[time] == "string":
        stamp = F.try_to_timestamp(F.col(time))
    else:
        stamp = F.col(time)
    lines = df.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.trim(F.col("item").cast("string")).alias("item"),
        F.trim(F.col("branch").cast("string")).alias("branch"),
        *([F.upper(F.trim(F.col("channel").cast("string"))).alias("channel")] if "channel" in df.columns else []),
        stamp.alias("timestamp"),
    )
    return lines if "channel" in lines.columns else infer_channel(lines, marker)


def infer_channel(lines: DataFrame, marker: str = rules.DELIVERY_MARKER) -> DataFrame:
    """Channel of each line: DELIVERY if its order holds the marker item, else IN_STORE."""
    marked = (lines.where(F.upper("item") == marker.upper()).select("order_id").distinct()
              .withColumn("_marked", F.lit(True)))
    channel = F.when(F.col("_marked"), "DELIVERY").otherwise("IN_STORE")
    return lines.join(marked, "order_id", "left").withColumn("channel", channel).drop("_marked")


def order_baskets(lines: DataFrame, order: Sequence[str] = ("branch", "channel", "timestamp")) -> DataFrame:
    """One row per order: sorted distinct items, their number, and the context of the order's first line.

    ``order`` names the columns that decide which line is first; a source with line numbers passes them here. The item
    sets are merged map side first and hold at most every distinct item once, however many lines an order has.
    """
    first = F.min_by(F.struct("branch", "channel", "timestamp"), F.struct(*order))
    stamp = F.col("_c.timestamp")
    return (lines.where(F.col("item").isNotNull()).groupBy("order_id")
            .agg(F.array_sort(F.collect_set("item")).alias("items_set"), first.alias("_c"))
            .select("order_id", F.col("_c.branch").alias("branch"), F.col("_c.channel").alias("channel"), "items_set",
                    F.size("items_set").alias("n_items"), F.weekday(stamp).alias("day_of_week"),
                    F.hour(stamp).alias("hour"), F.month(stamp).alias("month")))


def frequent_pairs(baskets: DataFrame, min_count: int, chunk: int = CHUNK_ITEMS) -> DataFrame:
    """Pairs (branch, channel, item_a, item_b), one row per basket, of the items that reach ``min_count`` baskets.

    Rarer items cannot be part of a pair that often and are left out before pairing. The items of a basket are cut into
    chunks and every pair of chunks is its own join key, so that a task sees at most ``chunk`` x ``chunk`` pairs of one
    basket at a time whatever the basket's size.
    """
    frequent = (baskets.select(F.explode("items_set").alias("item")).groupBy("item").count()
                .where(F.col("count") >= min_count).select("item"))
    presence = baskets.select("order_id", "branch", "channel", "n_items", F.explode("items_set").alias("item")).join(frequent, "item", "left_semi")
    return pairs_of_baskets(presence, ["order_id"], ["branch", "channel"], chunk).drop("order_id")


def pairs_of_baskets(presence: DataFrame, basket: Sequence[str], keep: Sequence[str] = (), chunk: int = CHUNK_ITEMS) -> DataFrame:
    """Every pair item_a < item_b of each basket once: basket key, ``keep`` columns, item_a, item_b.

    ``presence`` has a row (basket key, ``keep``, n_items, item) per basket and distinct item; n_items is at least their number.
    The join is never a broadcast: stored baskets are far smaller than the rows they unfold to, so their size says nothing.
    """
    chunks = F.ceil(F.col("n_items") / chunk).cast("int")
    placed = presence.withColumn("_k", chunks).withColumn("_c", F.pmod(F.xxhash64("item"), F.col("_k")).cast("int"))
    left = placed.select(*basket, *keep, F.col("item").alias("_x"), F.col("_c").alias("_p"),
                         F.explode(F.sequence("_c", F.col("_k") - 1)).alias("_q"))
    right = placed.select(*basket, F.col("item").alias("_y"), F.col("_c").alias("_q"),
                          F.explode(F.sequence(F.lit(0), "_c")).alias("_p"))
    once = (F.col("_p") < F.col("_q")) | (F.col("_x") < F.col("_y"))
    return (left.join(right.hint("merge"), [*basket, "_p", "_q"]).where(once)
            .select(*basket, *keep, F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b")))


def combo_pairs(baskets: DataFrame, min_support: float = 0.01, min_count_ab: int = 10, scopes: str = "all",
                chunk: int = CHUNK_ITEMS) -> DataFrame:
    """Support, confidences and lift of item pairs overall, per branch, per channel and per branch and channel.

    Every basket emits one row for itself, one per item and one per pair. These are counted in one aggregation at the
    finest scope (map side first) and rolled up with GROUPING SETS, so the four-fold expansion touches aggregated rows
    only. Items below ``min_count_ab`` baskets are not paired. ``scopes="overall"`` gives that scope.
    ``baskets`` is read several times: pass a stored table of :func:`order_baskets`.
    """
    scope, nothing = ["branch", "channel"], F.lit("")
    head = baskets.select(*scope, nothing.alias("item_a"), nothing.alias("item_b"), F.lit(0).alias("kind"))
    single = baskets.select(*scope, F.explode("items_set").alias("item_a"), nothing.alias("item_b"), F.lit(1).alias("kind"))
    emitted = head.unionByName(single).unionByName(frequent_pairs(baskets, min_count_ab, chunk).withColumn("kind", F.lit(2)))
    # 'kind' (0 basket, 1 item, 2 pair) follows from the keys; as an aggregate it is not pushed below the shuffle,
    # so that the readers of all three kinds share that shuffle; so do keys that cannot be NULL.
    item_a, item_b = (F.coalesce(c, nothing).alias(c) for c in ("item_a", "item_b"))
    fine = (emitted.select(*scope, item_a, item_b, "kind").groupBy(*scope, "item_a", "item_b")
            .agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")))
    counts = _roll_up(fine, scopes)

    # '_b' and '_c' hold the scope with NULL written as '' so that plain equality joins (and skew handling) apply.
    key = ["scope_id", "_b", "_c"]
    one = counts.where("kind = 1")
    stats = (counts.where((F.col("kind") == 2) & (F.col("n") >= min_count_ab))
             .select(*key, "item_a", "item_b", F.col("n").alias("count_ab"))
             .join(counts.where("kind = 0").select(*key, F.col("n").alias("n_orders")), key))
    n = {c: F.col(c).cast("double") for c in ("count_ab", "count_a", "count_b", "n_orders")}
    stats = (stats.withColumn("support", n["count_ab"] / n["n_orders"]).where(F.col("support") >= min_support)
             .join(one.select(*key, "item_a", F.col("n").alias("count_a")), [*key, "item_a"])
             .join(one.select(*key, F.col("item_a").alias("item_b"), F.col("n").alias("count_b")), [*key, "item_b"]))
    return (stats.withColumn("confidence_ab", n["count_ab"] / n["count_a"])
            .withColumn("confidence_ba", n["count_ab"] / n["count_b"])
            .withColumn("lift", n["count_ab"] * n["n_orders"] / (n["count_a"] * n["count_b"]))
            .withColumn("branch", F.when(F.col("scope_id").isin(0, 1), F.col("_b")))
            .withColumn("channel", F.when(F.col("scope_id").isin(0, 2), F.col("_c")))
            .withColumn("scope_type", scope_type(F.col("scope_id")))
            .withColumn("scope", scope_label(F.col("branch"), F.col("channel")))
            .select(*PAIR_COLUMNS))


def _roll_up(fine: DataFrame, scopes: str) -> DataFrame:
    """Counts at the finest scope to all four scopes. scope_id: 0 branch+channel, 1 branch, 2 channel, 3 overall.

    Rows without a branch or channel count only in the scopes that do not ask for it.
    """
    items = ["item_a", "item_b"]
    measures = [F.sum("n").alias("n"), F.max("kind").alias("kind")]
    if scopes == "overall":
        total = fine.groupBy(*items).agg(*measures)
        return total.select(F.lit(3).alias("scope_id"), F.lit("").alias("_b"), F.lit("").alias("_c"), *items, "n", "kind")
    fine = fine.withColumnsRenamed({"branch": "_branch", "channel": "_channel"})
    sets = [["_branch", "_channel", *items], ["_branch", *items], ["_channel", *items], items]
    scope_id = (F.grouping("_branch") * 2 + F.grouping("_channel")).cast("int").alias("scope_id")
    rolled = fine.groupingSets(sets, "_branch", "_channel", *items).agg(*measures, scope_id)
    branch_known = F.col("_branch").isNotNull() | F.col("scope_id").isin(2, 3)
    channel_known = F.col("_channel").isNotNull() | F.col("scope_id").isin(1, 3)
    return (rolled.where(branch_known & channel_known)
            .select("scope_id", F.coalesce("_branch", F.lit("")).alias("_b"), F.coalesce("_channel", F.lit("")).alias("_c"),
                    *items, "n", "kind"))


def scope_type(scope_id: Column) -> Column:
    return (F.when(scope_id == 0, "branch_channel").when(scope_id == 1, "branch").when(scope_id == 2, "channel")
            .otherwise("overall"))


def scope_label(branch: Column, channel: Column) -> Column:
    """Text form of a scope: ``overall``, ``branch:x``, ``channel:y`` or ``branch:x|channel:y``."""
    label = F.concat_ws("|", F.concat(F.lit("branch:"), branch), F.concat(F.lit("channel:"), channel))
    return F.when(label == "", "overall").otherwise(label)


def pair_checks(pairs: DataFrame, baskets: DataFrame) -> DataFrame:
    """Number of violations per rule; all zero for sound statistics."""
    metric = pairs.agg(*[F.count_if(test).alias(name) for name, test in {
        "support_range": ~F.col("support").between(0, 1),
        "confidence_ab_range": ~F.col("confidence_ab").between(0, 1),
        "confidence_ba_range": ~F.col("confidence_ba").between(0, 1),
        "count_ab_above_a": F.col("count_ab") > F.col("count_a"),
        "count_ab_above_b": F.col("count_ab") > F.col("count_b"),
        "pair_order": F.col("item_a") >= F.col("item_b"),
    }.items()])
    names = ", ".join(f"'{c}', {c}" for c in metric.columns)
    checks = metric.selectExpr(f"stack({len(metric.columns)}, {names}) AS (check_name, violations)")
    mirrored = pairs.select("scope", F.col("item_a").alias("item_b"), F.col("item_b").alias("item_a"))
    mirror = (pairs.select("scope", "item_a", "item_b").join(mirrored, ["scope", "item_a", "item_b"])
              .agg(F.lit("mirrored_pairs").alias("check_name"), F.count(F.lit(1)).alias("violations")))
    n = F.col("n_items").cast("long")
    made = F.when(n >= 2, F.aggregate(F.sequence(F.lit(1).cast("long"), n - 1), F.lit(0).cast("long"), lambda acc, i: acc + n - i)).otherwise(0)
    size = baskets.agg(F.lit("pairs_per_basket").alias("check_name"),
                       F.count_if(made != n * (n - 1) / 2).alias("violations"))
    return checks.unionByName(mirror).unionByName(size)


def require_valid(checks: DataFrame) -> None:
    """Raise if any check of :func:`pair_checks` counts a violation."""
    failed = checks.where("violations > 0").collect()
    if failed:
        raise ValueError("; ".join(f"{r.check_name}: {r.violations}" for r in failed))


# ---------------------------------------------------------------- ranked answers over the pair table

def _rank_columns(rank_by: str) -> list[str]:
    """Result columns with the ranking metric right after the pair."""
    if rank_by not in RANKS:
        raise ValueError(f"rank_by must be one of {sorted(RANKS)}, got '{rank_by}'")
    rest = ["count_ab", "support", "confidence_ab", "confidence_ba", "lift", "n_orders"]
    return ["item_a", "item_b", rank_by, *[c for c in rest if c != rank_by]]


def _rank_order(rank_by: str) -> list[Column]:
    return [F.desc(rank_by), F.desc("count_ab"), F.asc("item_a"), F.asc("item_b")]


def top_overall(pairs: DataFrame, top: int = 10, rank_by: str = "lift", min_count: int = 5) -> DataFrame:
    columns = _rank_columns(rank_by)
    return (pairs.where((F.col("scope_type") == "overall") & (F.col("count_ab") >= min_count))
            .orderBy(*_rank_order(rank_by)).limit(top).select(*columns))


def top_per_scope(pairs: DataFrame, by: str, value: str | None = None, top: int = 10, rank_by: str = "lift",
                  min_count: int | None = None) -> DataFrame:
    """Best pairs per branch (``by="branch"``, default count 3) or per channel (``by="channel"``, default 5)."""
    columns = _rank_columns(rank_by)
    if min_count is None:
        min_count = {"branch": 3, "channel": 5}[by]
    scoped = pairs.where((F.col("scope_type") == by) & (F.col("count_ab") >= min_count))
    if value is not None:
        wanted = value.upper() if by == "channel" else value
        chosen = scoped.where(F.col(by) == wanted)
        if chosen.isEmpty():
            known = [r[0] for r in pairs.where(F.col("scope_type") == by).select(by).distinct().orderBy(by).limit(50).collect()]
            raise ValueError(f"{by} '{value}' has no pairs; available: {known}")
        scoped = chosen
    return top_per_group(scoped, [by], _rank_order(rank_by), top).select("rank", by, *columns)


def pairs_with_item(pairs: DataFrame, item: str, scope: str = "overall", top: int = 10, rank_by: str = "lift",
                    min_count: int = 3, hint: bool = True) -> DataFrame:
    """Pairs with an item whose name contains ``item`` in any case, and the partner of that item."""
    columns = _rank_columns(rank_by)
    text = item.upper()
    if scope != "all":
        pairs = pairs.where(F.col("scope") == scope)
    in_a, in_b = F.upper("item_a").contains(text), F.upper("item_b").contains(text)
    found = pairs.where((in_a | in_b) & (F.col("count_ab") >= min_count))
    if hint and found.isEmpty():
        similar = [r[0] for r in similar_items(pairs, item).collect()]
        raise ValueError(f"no pairs with an item containing '{item}' in scope '{scope}'; similar items: {similar}")
    partner = F.when(in_a, F.col("item_b")).otherwise(F.col("item_a"))
    return (found.withColumn("paired_with", partner).orderBy(*_rank_order(rank_by), F.asc("scope")).limit(top)
            .select("scope", "paired_with", *columns))


def similar_items(pairs: DataFrame, item: str, n: int = 5) -> DataFrame:
    """First n item names, in order, that contain the first four letters of ``item``."""
    names = pairs.select(F.upper("item_a").alias("item")).union(pairs.select(F.upper("item_b").alias("item"))).distinct()
    return names.where(F.col("item").contains(item.upper()[:4])).orderBy("item").limit(n)
