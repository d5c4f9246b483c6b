import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillwork.operators import baskets as B, growth as G


def lines(spark, rows):
    return spark.createDataFrame(rows, "order_id string, item string, branch string, channel string, timestamp timestamp")


def brute(rows, min_count, min_support):
    orders = {}
    for o, i, b, c, _ in rows:
        orders.setdefault(o, ((b, c), set()))[1].add(i)
    out = {}
    for scope in ("overall", "branch", "channel", "branch_channel"):
        groups = {}
        for (b, c), items in orders.values():
            key = (scope, b if "branch" in scope else None, c if "channel" in scope else None)
            groups.setdefault(key, []).append(items)
        for key, sets in groups.items():
            single = Counter(i for s in sets for i in s)
            pair = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
            for (x, y), n in pair.items():
                if n >= min_count and n / len(sets) >= min_support:
                    out[key + (x, y)] = (len(sets), single[x], single[y], n)
    return out


def sample(seed=5):
    rng = random.Random(seed)
    rows = []
    for o in range(60):
        b, c = rng.choice(["Harbour", "Hill"]), rng.choice(["DELIVERY", "IN_STORE"])
        # Every tenth order is wide.
        for _ in range(40 if o % 10 == 0 else rng.randrange(1, 6)):
            rows.append((str(o), f"item{rng.randrange(25):02d}", b, c, None))
    return rows


@pytest.mark.parametrize("chunk", [100, 2, 4])
def test_pairs_equal_brute_force(spark, chunk):
    rows = sample()
    baskets = B.order_baskets(lines(spark, rows)).cache()
    pairs = B.combo_pairs(baskets, 0.05, 3, chunk=chunk)
    got = {(r.scope_type, r.branch, r.channel, r.item_a, r.item_b): (r.n_orders, r.count_a, r.count_b, r.count_ab) for r in pairs.collect()}
    assert got == brute(rows, 3, 0.05)
    checks = B.pair_checks(pairs, baskets)
    assert {r.violations for r in checks.collect()} == {0} and checks.count() == 8


def test_hand_worked_metrics(spark):
    # Three baskets over two branches, one item repeated within a basket, one basket of a single item.
    rows = [("1", "A", "x", "S", None), ("1", "B", "x", "S", None), ("1", "A", "x", "S", None), ("2", "A", "y", "S", None),
            ("2", "B", "y", "S", None), ("3", "A", "x", "S", None)]
    pairs = B.combo_pairs(B.order_baskets(lines(spark, rows)), 0.0, 1)
    overall = pairs.where("scope = 'overall'").first()
    assert (overall.n_orders, overall.count_a, overall.count_b, overall.count_ab) == (3, 3, 2, 2)
    assert overall.support == pytest.approx(2 / 3) and overall.confidence_ab == pytest.approx(2 / 3)
    assert overall.confidence_ba == 1.0 and overall.lift == pytest.approx(2 * 3 / (3 * 2))
    assert {r.scope for r in pairs.collect()} == {"overall", "branch:x", "branch:y", "channel:S", "branch:x|channel:S", "branch:y|channel:S"}


def test_layouts_and_channel(spark):
    raw = spark.createDataFrame([(1, "Harbour", " Latte "), (1, "Harbour", "Delivery Charge"), (2, "Hill", "Cake")], "basket_id int, branch string, item string")
    got = {(r.order_id, r.item): r.channel for r in B.order_lines(raw).collect()}
    assert got == {("1", "Latte"): "DELIVERY", ("1", "Delivery Charge"): "DELIVERY", ("2", "Cake"): "IN_STORE"}
    core = spark.createDataFrame([(1, "Hill", "['A', \"B's\"]")], "basket_id int, branch string, items_list string")
    assert [r.item for r in B.order_lines(core).orderBy("item").collect()] == ["A", "B's"]
    with pytest.raises(ValueError, match="item"):
        B.order_lines(raw.drop("item"))


def test_ranked_answers(spark):
    pairs = B.combo_pairs(B.order_baskets(lines(spark, sample())).cache(), 0.0, 2).cache()
    top = B.top_overall(pairs, 3, "count_ab", 2).collect()
    assert len(top) == 3 and top[0].count_ab >= top[1].count_ab >= top[2].count_ab
    assert B.top_overall(pairs, 3, "support").columns[2] == "support"
    per = B.top_per_scope(pairs, "branch", "Hill", 4).collect()
    assert [r["rank"] for r in per] == [1, 2, 3, 4] and {r.branch for r in per} == {"Hill"}
    with pytest.raises(ValueError, match="Harbour"):
        B.top_per_scope(pairs, "branch", "Moon")
    with pytest.raises(ValueError, match="rank_by"):
        B.top_overall(pairs, 3, "price")
    hit = B.pairs_with_item(pairs, "ITEM01", top=5).collect()
    assert all("item01" in (r.item_a, r.item_b) and r.paired_with != "item01" for r in hit)
    with pytest.raises(ValueError, match="ITEM0"):
        B.pairs_with_item(pairs, "itemXYZ")


def test_counting_rules_and_sets(spark):
    target = lambda i: i.startswith("t")
    data = [("x", ["a", "t1"]), ("x", ["a", "t1", "t2"]), ("x", ["b", "t1"]), ("x", ["a"]), ("x", ["b", "t2", "a"]), ("x", ["a", "t1", "t2", "b"])]
    baskets = spark.createDataFrame(data, "branch string, items_list array<string>").cache()
    for least in (1, 2):
        got = {(r.antecedents, r.consequents): (r.support, r.confidence, r.lift)
               for r in G.pair_rules(baskets, target, None, least).where("NOT is_total").collect()}
        # a in 5, t1 in 4, together 3 of 6 baskets: confidence 3/5, lift 0.6 / (4/6).
        assert got[("a", "t1")] == (0.5, 0.6, 0.9)
        assert set(got) == {("a", "t1"), ("a", "t2"), ("b", "t1"), ("b", "t2")}
    sets = {(r.antecedents, r.consequents): round(r.lift, 4) for r in G.set_rules(baskets, target, 0.3, 0.1, None).where("is_total").collect()}
    assert sets[("a", "t1")] == 0.9
    assert ("a", "t1, t2") in sets  # both targets together: 2 of 6 baskets
    # confidence 2/5 over support 2/6
    assert sets[("a", "t1, t2")] == 1.2
    few = baskets.limit(4)
    assert G.set_rules(few, target).count() == 0
    assert G.association_rules(few, target, "sets").count() == G.pair_rules(few, target).count() > 0


def test_growth_potential_ranks_ties_alike(spark):
    kpis = spark.createDataFrame([("p", 10, 5, 0.5, 0.6, 0.1), ("q", 10, 5, 0.5, 0.6, 0.1), ("r", 5, 3, 0.6, 0.6, 0.0)],
                                 "branch string, total_orders long, beverage_orders long, beverage_attachment_rate double, best_branch_rate double, beverage_gap_to_best double")
    rules = spark.createDataFrame([], "branch string, is_total boolean, antecedents string, consequents string, support double, confidence double, lift double")
    got = {r.branch: (r.potential_score, r.potential_rank, r.assoc_lift_score, r.top_bundle_rule) for r in G.growth_potential(kpis, rules).collect()}
    assert got["p"] == got["q"] == (0.85, 1, 0.5, "") and got["r"] == (0.15, 3, 0.5, "")
    assert G.growth_recommendation(G.growth_potential(kpis, rules)).first().branch_actions[0].branch == "p"


def test_frequent_sets_against_all_subsets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "y", "z"]), [i for i in "abcdefg" if rng.random() < 0.55] + ["a"] * (rng.random() < 0.2)) for _ in range(90)]
    rows += [("tiny", ["a", "b"])] * 3 + [("y", [])] * 4 + [("y", None)]
    baskets = spark.createDataFrame(rows, "branch string, items_list array<string>")
    want = {}
    for branch, total in [(b, False) for b in {r[0] for r in rows}] + [("ALL", True)]:
        own = [frozenset(items or ()) for b, items in rows if total or b == branch]
        if len(own) < 5:
            continue
        for k in range(1, 8):
            for items in itertools.combinations("abcdefg", k):
                n = sum(s >= set(items) for s in own)
                if n and n / len(own) >= 0.15:
                    want[branch, total, items] = (n, len(own))
    got = {(r.branch, r.is_total, tuple(r["items"])): (r.n, r.baskets) for r in G.frequent_sets(baskets, 0.15).collect()}
    assert got == want and max(len(k[2]) for k in want) >= 3
    rules = G.set_rules(baskets, lambda i: i.isin("f", "g"), 0.15, 0.2, None).collect()
    for r in rules:
        ante, cons = tuple(r.antecedents.split(", ")), tuple(r.consequents.split(", "))
        n, size = want[r.branch, r.is_total, tuple(sorted(ante + cons))]
        assert abs(r.confidence - n / want[r.branch, r.is_total, ante][0]) < 1e-12 and abs(r.support - n / size) < 1e-12
        assert abs(r.lift - r.confidence / (want[r.branch, r.is_total, cons][0] / size)) < 1e-9
    split = {(b, t, items, c) for b, t, items in want for k in (1, 2) for c in itertools.combinations([i for i in items if i in "fg"], k) if len(c) < len(items)}
    enough = {(b, t, i, c) for b, t, i, c in split if want[b, t, i][0] / want[b, t, tuple(x for x in i if x not in c)][0] >= 0.2}
    assert len(rules) == len(enough)


def test_set_mining_is_the_same_for_small_and_large_baskets(spark):
    """F2, F8, F9: sets grow in place or by basket and prefix, count once for branch and all, and no unfolded basket is broadcast."""
    from collections import Counter
    from itertools import combinations

    from tillwork.operators import growth as G

    data = [("a", list("xyzw")), ("a", list("xyz")), ("a", list("xy")), ("a", ["x", "x", None]), ("a", list("zw")),
            ("b", list("uvxyz")), ("b", list("uvx")), ("b", list("uv")), ("b", ["v"]), ("b", list("uvxyz")), ("c", list("xyzuv")), (None, list("uv"))]
    baskets = spark.createDataFrame(data, "branch string, items_list array<string>")
    counts, sizes = Counter(), Counter()
    for branch, items in data:
        own = sorted({i for i in items if i})
        for group in ((branch, False), ("ALL", True)):
            sizes[group] += 1
            counts.update((*group, s) for k in range(1, 6) for s in combinations(own, k))
    want = {(*k, n, sizes[k[:2]]) for k, n in counts.items() if k[0] and sizes[k[:2]] >= 5 and n / sizes[k[:2]] >= 0.3}
    for most in (16, 3, 0):
        got = [(r.branch, r.is_total, tuple(r["items"]), r.n, r.baskets) for r in G.frequent_sets(baskets, 0.3, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    presence = spark.createDataFrame([(1, 3, i) for i in "xyz"], "basket int, n_items int, item string")
    pairs = B.pairs_of_baskets(presence, ["basket"])
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    left_out, named = spark.createDataFrame([("b", False)], "branch string, is_total boolean"), baskets.where("branch <> 'a'")
    rules = [{(r.branch, r.is_total, r.antecedents, r.consequents, r.lift) for r in G.pair_rules(named, lambda i: i == "x", None, but=o).collect()} for o in (None, left_out)]
    assert set() < rules[1] == {r for r in rules[0] if r[:2] != ("b", False)} < rules[0]
