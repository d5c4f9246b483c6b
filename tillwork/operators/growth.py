"""Attach-rate KPIs, association rules and growth potential."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules, scalar as S
from ..session import stage
from .baskets import pairs_of_baskets
from .grouped import top_per_group, with_global_rank_desc
from .scoring import min_max


def attach_kpis(baskets: DataFrame, target) -> DataFrame:
    """Share of a branch's baskets holding a target item, the best branch's share and the gap to it.

    ``target`` maps an item column to a boolean column. The rate is rounded before the best rate and the gap are taken.
    """
    hit = F.coalesce(F.exists("items_list", lambda i: target(i)), F.lit(False))
    rates = (baskets.groupBy("branch").agg(F.count(F.lit(1)).alias("total_orders"), F.count_if(hit).alias("beverage_orders"))
             .withColumn("beverage_attachment_rate", S.round_to(S.ratio(F.col("beverage_orders"), F.col("total_orders")), 4)))
    best = rates.agg(F.max("beverage_attachment_rate")).scalar()
    return (rates.withColumn("best_branch_rate", S.round_to(best, 4))
            .withColumn("beverage_gap_to_best", S.round_to(F.col("best_branch_rate") - F.col("beverage_attachment_rate"), 4)))


def revenue_share(items: DataFrame) -> DataFrame:
    """Amount, beverage amount and beverage share of revenue per branch."""
    drink = F.col("category").isin(*rules.BEVERAGE_CATEGORIES)
    amount = S.money(F.col("amount"))
    return (items.groupBy("branch").agg(F.sum(amount).cast("double").alias("total_amount"),
                                        F.coalesce(F.sum(F.when(drink, amount)).cast("double"), F.lit(0.0)).alias("bev_amount"))
            .withColumn("bev_revenue_share", S.round_to(S.ratio(F.col("bev_amount"), F.col("total_amount")), 4)))


def merge_kpis(attach: DataFrame, revenue: DataFrame) -> DataFrame:
    """Revenue shares joined to the branches that have baskets."""
    return attach.join(revenue, "branch", "left")


def _target_pairs(baskets: DataFrame, target) -> DataFrame:
    """(branch, food, drink) once per basket: the two classes of a basket's distinct items, combined row by row.

    The rows of a basket are unfolded where the basket lies and counted map side, so no key moves before it is counted.
    """
    # Each item is classified once; the two lists are then cut from the tagged one.
    tag = F.transform(F.array_distinct("items_list"), lambda i: F.struct(i.alias("i"), target(i).alias("t")))
    split = baskets.select("branch", tag.alias("all")).select(
        "branch", F.filter("all", lambda x: ~x["t"])["i"].alias("food"), F.filter("all", lambda x: x["t"])["i"].alias("drink"))
    foods = split.where(F.size("drink") > 0).select("branch", "drink", F.explode("food").alias("item_a"))
    return foods.select("branch", "item_a", F.explode("drink").alias("item_b"))


def pair_rules(baskets: DataFrame, target, top_k: int | None = 10, least: int = 1, but: DataFrame | None = None) -> DataFrame:
    """Rules (other item -> target item) per branch and for all: support, confidence, lift, best ``top_k`` by lift.

    Counts are taken once per branch, written and rolled up; ``is_total`` marks the all-branch rules, so a branch may itself
    be called ALL. Pairs in fewer than ``least`` baskets give no rule, nor do the groups (branch, is_total) of ``but``.
    ``baskets``: branch, items_list of normalised names; read several times.
    """
    items = baskets.select("branch", F.explode(F.array_distinct("items_list")).alias("item"))
    facts = (baskets.select("branch", F.lit("").alias("item_a"), F.lit("").alias("item_b"), F.lit(0).alias("kind"))
             .unionByName(items.select("branch", F.coalesce("item", F.lit("")).alias("item_a"), F.lit("").alias("item_b"),
                                       F.lit(1).alias("kind")))
             .unionByName(_target_pairs(baskets, target).withColumn("kind", F.lit(2))))
    fine = stage(facts.groupBy("branch", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "rule_counts")
    total = fine.groupBy("item_a", "item_b").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"))
    names = ["branch", "is_total", "item_a", "item_b", "n", "kind"]
    counts = (fine.withColumns({"branch": F.coalesce("branch", F.lit("ALL")), "is_total": F.lit(False)}).select(*names)
              .unionByName(total.withColumns({"branch": F.lit("ALL"), "is_total": F.lit(True)}).select(*names)))
    key = ["branch", "is_total"]
    one = counts.where("kind = 1")
    pairs = counts.where((F.col("kind") == 2) & (F.col("n") >= least)).select(*key, "item_a", "item_b", F.col("n").alias("ab"))
    if but is not None:
        pairs = pairs.join(but.select(*key).distinct(), key, "left_anti")
    rows = (pairs.join(counts.where("kind = 0").select(*key, F.col("n").alias("baskets")), key)
            .join(one.select(*key, "item_a", F.col("n").alias("a")), [*key, "item_a"])
            .join(one.select(*key, F.col("item_a").alias("item_b"), F.col("n").alias("b")), [*key, "item_b"]))
    return _rule_metrics(rows, top_k)


def _rule_metrics(rows: DataFrame, top_k: int | None) -> DataFrame:
    n = {c: F.col(c).cast("double") for c in ("ab", "a", "b", "baskets")}
    result = rows.select("branch", "is_total", F.col("item_a").alias("antecedents"), F.col("item_b").alias("consequents"),
                         S.round_to(n["ab"] / n["baskets"], 5).alias("support"), S.round_to(n["ab"] / n["a"], 4).alias("confidence"),
                         S.round_to((n["ab"] / n["a"]) / (n["b"] / n["baskets"]), 4).alias("lift"))
    if top_k is None:
        return result
    order = [F.desc("lift"), F.desc("confidence"), F.asc("antecedents"), F.asc("consequents")]
    return top_per_group(result, ["branch", "is_total"], order, top_k, out=None)


def frequent_sets(baskets: DataFrame, min_support: float, least_baskets: int = 5, most: int = 16) -> DataFrame:
    """Item sets in at least ``min_support`` of the baskets, per branch and for all: branch, is_total, items (sorted), n, baskets.

    Levels of growing size: a set of k items joins two frequent sets that share its first k - 1 and k - 2 items, is pruned unless all its
    parts of k - 1 items are frequent, and is counted over the baskets that hold both. Occurrences are rows, once for their branch and for
    all, so neither item lists nor candidates sit on the driver; every level is written. An occurrence in a basket of up to ``most`` items
    carries the basket's later items, by which it grows where it lies; larger baskets are spread: their pairs by ``pairs_of_baskets``, longer
    sets by (basket, prefix). ``most`` changes no result. Branches with fewer than ``least_baskets`` baskets have none. ``baskets``: branch, items_list.
    """
    group = F.explode(F.array(F.struct("branch", F.lit(False).alias("is_total")), F.struct(F.lit("ALL").alias("branch"), F.lit(True).alias("is_total")))).alias("g")
    sized = stage(baskets.select(group).groupBy("g.branch", "g.is_total").agg(F.count(F.lit(1)).alias("baskets"))
                  .where(F.col("baskets") >= least_baskets), "set_sizes")
    key = ["branch", "is_total"]
    numbered = stage(baskets.select("branch", F.array_sort(F.array_compact(F.array_distinct("items_list"))).alias("items"))
                     .withColumn("basket", F.monotonically_increasing_id()), "set_baskets")

    def frequent(occurrences: DataFrame) -> DataFrame:
        own = occurrences.groupBy("branch", "items").agg(F.count(F.lit(1)).alias("n"))
        total = own.groupBy("items").agg(F.sum("n").alias("n"))
        counts = own.withColumn("is_total", F.lit(False)).unionByName(total.select(F.lit("ALL").alias("branch"), "items", "n", F.lit(True).alias("is_total")))
        return stage(counts.join(sized, key).where(F.col("n").cast("double") / F.col("baskets") >= min_support).select(*key, "items", "n", "baskets"), "frequent_sets")

    def of_either(occurrences: DataFrame, sets: DataFrame, of: Column | None = None) -> DataFrame:
        """Occurrences whose set is among ``sets`` for their branch or for all."""
        of = F.col("items") if of is None else of
        marks = [sets.where(~F.col("is_total")).select(F.col("branch").alias("_b"), F.col("items").alias("_s"), F.lit(True).alias("_own")),
                 sets.where("is_total").select(F.col("items").alias("_t"), F.lit(True).alias("_all"))]
        marked = (occurrences.join(marks[0], (F.col("branch") == F.col("_b")) & (of == F.col("_s")), "left")
                  .join(marks[1], of == F.col("_t"), "left"))
        return marked.where("_own OR _all").select(*occurrences.columns)

    def grown(rows: DataFrame) -> DataFrame:
        """Each occurrence (branch, items, tail) with each item of its tail; the tail of the new one is what follows."""
        after = F.slice("tail", F.col("_i") + 2, F.size("tail"))
        return (rows.select("branch", "items", "tail", F.posexplode("tail").alias("_i", "_x"))
                .select("branch", F.lit(None).cast("long").alias("basket"), F.concat("items", F.array("_x")).alias("items"), after.alias("tail")))

    none = F.lit(None).cast("array<string>").alias("tail")
    every = numbered.select("branch", "basket", F.size("items").alias("n_items"), F.explode("items").alias("item"))
    found = frequent(every.select("branch", F.array("item").alias("items")))
    small = grown(numbered.where(F.size("items") <= most).select("branch", none.alias("items"), F.col("items").alias("tail"))
                  .withColumn("items", F.array().cast("array<string>")))
    small = of_either(grown(of_either(small, found).where(F.size("tail") > 0)), found.select(*key, "items"), F.slice("items", 2, 1))
    large = of_either(every.where(F.col("n_items") > most), found, F.array("item"))
    large = pairs_of_baskets(large, ["basket"], ["branch"]).select("branch", "basket", F.array("item_a", "item_b").alias("items"), none)
    pairs = small.unionByName(large)
    levels, held, k = [found], stage(pairs, "set_occurrences"), 2
    while True:
        found = frequent(held)
        if found.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(found)
        kept = of_either(held, found)
        k += 1
        candidates = stage(_candidates(found.select(*key, "items"), key, k), "set_candidates")
        longer = grown(kept.where(F.size("tail") > 0)).unionByName(_longer(kept.where(F.col("tail").isNull()), k))
        held = stage(of_either(longer, candidates), "set_occurrences")


def _longer(kept: DataFrame, k: int) -> DataFrame:
    """Sets of k items from occurrences (branch, basket, items, tail) of k - 1 that share basket and prefix."""
    lists = kept.groupBy("branch", "basket", F.slice("items", 1, k - 2).alias("prefix")).agg(
        F.array_sort(F.collect_list(F.get("items", F.lit(k - 2)))).alias("last")).where(F.size("last") > 1)
    first = lists.select("branch", "basket", "prefix", "last", F.posexplode("last").alias("_i", "item"))
    pairs = first.select("branch", "basket", "prefix", "item", F.explode(F.slice("last", F.col("_i") + 2, F.size("last"))).alias("_next"))
    return pairs.select("branch", "basket", F.concat("prefix", F.array("item", "_next")).alias("items"), F.lit(None).cast("array<string>").alias("tail"))


def _candidates(found: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """Sets of k items all of whose parts of k - 1 items are in ``found``; two parts that share their first k - 2 items make one."""
    split = found.select(*key, F.slice("items", 1, k - 2).alias("prefix"), F.get("items", F.lit(k - 2)).alias("item"))
    made = (split.join(split.withColumnRenamed("item", "_next"), [*key, "prefix"]).where(F.col("item") < F.col("_next"))
            .select(*key, F.concat("prefix", F.array("item", "_next")).alias("items")))
    without = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter("items", lambda x, j: j != i)))
    parts = made.select(*key, F.col("items").alias("whole"), without.alias("items")).join(found, [*key, "items"], "left_semi")
    return parts.groupBy(*key, "whole").count().where(F.col("count") == k).select(*key, F.col("whole").alias("items"))


def set_rules(baskets: DataFrame, target, min_support: float = 0.01, min_confidence: float = 0.05,
              top_k: int | None = 10) -> DataFrame:
    """Rules from frequent item sets with one or more target items as consequent, per branch and for all.

    Branches with fewer than five baskets or two items give no rules. ``target`` maps an item column to a boolean column.
    """
    key = ["branch", "is_total"]
    sets = stage(frequent_sets(baskets, min_support), "rule_sets")
    # Consequents are the non-empty subsets of an item set's target members that leave an antecedent. Each of these
    # subsets is a frequent set itself, so their number never exceeds the number of sets found.
    drinks = F.filter("items", lambda i: target(i))
    picks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("_drinks")) - 1).cast("int"))
    split = (sets.where(F.size("items") >= 2).withColumn("_drinks", drinks).where(F.size("_drinks") > 0)
             .withColumn("_mask", F.explode(picks))
             .withColumn("_cons", F.filter("_drinks", lambda i, k: F.getbit(F.col("_mask"), k) == 1))
             .withColumn("_ante", F.array_except("items", "_cons")).where(F.size("_ante") > 0))

    def support_of(column: str, out: str) -> DataFrame:
        return sets.select(*key, F.col("items").alias(column), F.col("n").alias(out))

    rows = split.join(support_of("_ante", "a"), [*key, "_ante"]).join(support_of("_cons", "b"), [*key, "_cons"])
    n = {c: F.col(c).cast("double") for c in ("n", "a", "b", "baskets")}
    result = (rows.withColumn("confidence", n["n"] / n["a"]).where(F.col("confidence") >= min_confidence)
              .select(*key, F.array_join("_ante", ", ").alias("antecedents"), F.array_join("_cons", ", ").alias("consequents"),
                      (n["n"] / n["baskets"]).alias("support"), "confidence", (F.col("confidence") / (n["b"] / n["baskets"])).alias("lift")))
    if top_k is None:
        return result
    order = [F.desc("lift"), F.desc("confidence"), F.asc("antecedents"), F.asc("consequents")]
    return top_per_group(result, key, order, top_k, out=None)


def association_rules(baskets: DataFrame, target, method: str = "pairs", min_support: float = 0.005,
                      min_confidence: float = 0.03, top_k: int | None = 10) -> DataFrame:
    """Rules per branch and for all by the chosen method; ``sets`` falls back to ``pairs`` for branches it leaves empty."""
    if method == "pairs":
        return pair_rules(baskets, target, top_k)
    if method != "sets":
        raise ValueError(f"method must be 'pairs' or 'sets', got '{method}'")
    mined = stage(set_rules(baskets, target, min_support, min_confidence, top_k), "mined_rules")
    return mined.unionByName(pair_rules(baskets, target, top_k, but=mined))


def growth_potential(kpis: DataFrame, rule_table: DataFrame, weights: Mapping[str, float] | None = None,
                     top_n: int = 5) -> DataFrame:
    """Potential score of each branch from low attachment, order volume and the mean lift of its best rules, with rank."""
    w = {**rules.POTENTIAL_WEIGHTS, **(weights or {})}
    own = rule_table.where(~F.col("is_total"))
    order = [F.desc("lift"), F.desc("confidence"), F.asc("antecedents"), F.asc("consequents")]
    best = top_per_group(own, ["branch"], order, top_n)
    text = F.format_string("%s → %s (lift=%.2f)", "antecedents", "consequents", "lift")
    lifts = best.groupBy("branch").agg(F.avg("lift").alias("avg_lift"), F.max(F.when(F.col("rank") == 1, text)).alias("top_bundle_rule"))
    gap = kpis.agg(F.max(F.coalesce("beverage_attachment_rate", F.lit(0.0)))).scalar()
    df = (kpis.join(lifts, "branch", "left")
          .withColumn("beverage_attachment_rate", F.coalesce("beverage_attachment_rate", F.lit(0.0)))
          .withColumn("beverage_gap_to_best", F.coalesce("beverage_gap_to_best", gap))
          .withColumn("avg_lift", F.coalesce("avg_lift", F.lit(0.0)))
          .withColumn("top_bundle_rule", F.coalesce("top_bundle_rule", F.lit("")))
          .withColumn("_low", 1 - F.col("beverage_attachment_rate"))
          .withColumn("_volume", F.coalesce(F.col("total_orders").cast("double"), F.lit(0.0))))
    df = min_max(df, {"_low": "low_attachment_score", "_volume": "order_volume_score", "avg_lift": "assoc_lift_score"})
    score = (w["low_attachment"] * F.col("low_attachment_score") + w["order_volume"] * F.col("order_volume_score")
             + w["assoc_lift"] * F.col("assoc_lift_score"))
    df = df.withColumn("potential_score", S.round_to(score, 4)).drop("_low", "_volume")
    return with_global_rank_desc(df, "potential_score", "potential_rank").select(
        *kpis.columns, "low_attachment_score", "order_volume_score", "avg_lift", "assoc_lift_score", "potential_score",
        "potential_rank", "top_bundle_rule")


# Texts of the growth recommendation.
STRATEGY = "Coffee & Milkshake Combo Uplift"
OBJECTIVE = "Increase beverage attachment rate across branches via targeted cross-sell"
PROMOTE = "Priority cross-sell: promote beverage bundles at checkout"
MAINTAIN = "Maintain existing bundle promotions and monitor"


def growth_actions(potential: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Action per branch: promote at a score of ``at_least``, else maintain."""
    return potential.select(
        "branch", "potential_score", F.col("beverage_attachment_rate").alias("current_attachment_rate"), "beverage_gap_to_best",
        F.col("top_bundle_rule").alias("recommended_bundle"),
        F.when(F.col("potential_score") >= at_least, PROMOTE).otherwise(MAINTAIN).alias("action"))


def growth_recommendation(potential: DataFrame) -> DataFrame:
    """One row: strategy, objective, key findings and the branch actions in order of score (one entry per branch)."""
    act = growth_actions(potential)
    fields = F.struct("branch", "potential_score", "current_attachment_rate", "beverage_gap_to_best", "recommended_bundle", "action")
    actions = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("potential_score")).alias("k"), F.col("branch").alias("b"),
                                                               fields.alias("v")))), lambda x: x["v"])
    best = F.min_by(F.struct("branch", "current_attachment_rate"), F.struct(-F.col("current_attachment_rate"), F.col("branch")))
    return (act.agg(actions.alias("branch_actions"), best.alias("_b"))
            .select(F.lit(STRATEGY).alias("strategy"), F.lit(OBJECTIVE).alias("objective"), F.array(
                F.format_string("Highest growth potential: %s (potential_score=%.3f, current attachment=%s)",
                                F.col("branch_actions")[0]["branch"], F.col("branch_actions")[0]["potential_score"],
                                F.col("branch_actions")[0]["current_attachment_rate"].cast("string")),
                F.format_string("Best beverage branch benchmark: %s (attachment_rate=%.3f)", F.col("_b.branch"),
                                F.col("_b.current_attachment_rate"))).alias("key_findings"), "branch_actions"))


def underperforming(kpis: DataFrame, top_n: int = 10) -> DataFrame:
    return (kpis.orderBy(F.asc("beverage_attachment_rate"), F.asc("branch")).limit(top_n)
            .select("branch", "total_orders", "beverage_orders", "beverage_attachment_rate", "beverage_gap_to_best"))


def highest_potential(potential: DataFrame, top_n: int = 10) -> DataFrame:
    return (potential.orderBy(F.desc("potential_score"), F.asc("branch")).limit(top_n)
            .select("branch", "potential_score", "potential_rank", "beverage_attachment_rate", "total_orders",
                    "top_bundle_rule", "beverage_gap_to_best"))


def gap_to_best(kpis: DataFrame) -> DataFrame:
    """Gap of each branch and the name of the benchmark branch."""
    best = kpis.agg(F.min_by("branch", F.struct(-F.col("beverage_attachment_rate"), F.col("branch")))).scalar()
    return kpis.select(best.alias("best_branch"), "best_branch_rate", "branch", "beverage_attachment_rate",
                       "beverage_gap_to_best", "total_orders")
