"""Operators 7 and 9 against brute force, on both sides of the size that splits a group."""

import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from tillwork.llm import fuzzy_lines as fl
from tillwork.llm import near_dup as nd

from conftest import SF


def expected(rows):
    sets = [brute.shingles(r[1]) for r in rows]
    first = brute.groups(sets, 85)
    ids = defaultdict(list)
    for r, g in zip(rows, first):
        if r[0] is not None:
            ids[g].append(r[0])
    return [(r[0], len(s), min(ids[g], default=None)) for r, s, g in zip(rows, sets, first)]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def chain(n=40):
    """Texts of which each is near the next one only, and a tight group around one text."""
    rng, out = random.Random(3), []
    w = brute.prose(11, 200).split()
    for i in range(n):
        w = list(w)
        w[(i * 7) % 200] = f"step{i}"
        out.append(" ".join(w))
    base = brute.prose(12, 200).split()
    for i in range(n):
        v = list(base)
        for _ in range(3):
            v[rng.randrange(200)] = f"new{i}"
        out.append(" ".join(v))
    return [(i, t, "en", "s", 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("most", [2000, 4])
def test_groups_match_brute_force(frame, most):
    rows = brute.edge_rows() + [(100 + r[0], *r[1:]) for r in chain()]
    got = nd.near_duplicates(frame(rows, more=True), 85, task_nodes=most).collect()
    same(got, expected(rows))


def test_every_link_counts_whatever_group_is_largest_on_the_way():
    rng, cases = random.Random(8), []
    for k in range(200):
        # A chain whose neighbours share 7 of 9, with bursts of near copies in every other case.
        sets = []
        for step in range(20):
            sets.append(np.arange(step, step + 8, dtype=np.uint64))
            sets += [np.append(sets[-1], np.uint64(10**6 + rng.randrange(10**9))) for _ in range(3 * (k % 2) * (rng.random() < 0.3))]
        rng.shuffle(sets)
        cases.append(sets)
    for sets in cases:
        found = nd.unite(sets, np.zeros(len(sets), int), np.arange(len(sets)), 75)
        root = list(range(len(sets)))
        for i, j, _ in found:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        assert set(root) == {0}


def test_signature_of_a_union_is_the_least_of_its_parts():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 2**63, 900).astype(np.uint64)
    whole = nd.signatures(elements, np.array([0, 900]))
    parts = nd.signatures(elements, np.array([0, 400, 900]))
    assert (whole[0] == parts.min(axis=0)).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sig = nd.signatures(np.concatenate([common, a, common, b]), np.array([0, 900, 1800]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08


def test_whole_query_and_kept(spark, table):
    got = nd.op7_near_dup(spark, SF).collect()
    same([r[:3] for r in got], expected(table))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_group_stays_with_all_its_columns(frame):
    rows = brute.edge_rows()
    df = frame(rows, more=True)
    out = nd.keep_one(df)
    assert out.columns == df.columns
    sets = [brute.shingles(r[1]) for r in rows]
    first = brute.groups(sets, 85)
    want = [min((r for r, h in zip(rows, first) if h == g), key=lambda r: (r[0] is None, r[0] or 0))[0] for g in sorted(set(first))]
    same([(r.doc_id,) for r in out.collect()], [(x,) for x in want])


def lines_expected(rows, percent=80, least=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    lines = [(i, k, fl.normalised(x)) for i in order for k, x in enumerate(rows[i][1].split("\n") if rows[i][1] is not None else ())]
    lines = [x for x in lines if x[2]]
    norms = sorted({x[2] for x in lines})
    h = fl.simhash(pa.array(norms, pa.string()))
    root = list(range(len(norms)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(norms)):
        for j in range(i):
            if min(len(norms[i]), len(norms[j])) >= least and np.bitwise_count(h[i] ^ h[j]).sum() <= 3 and fl.similar(norms[i], norms[j], percent):
                root[find(i)] = find(j)
    at, seen, gone = {s: i for i, s in enumerate(norms)}, set(), defaultdict(set)
    for i, k, s in lines:
        g = find(at[s])
        if g in seen:
            gone[i].add(k)
        seen.add(g)
    out = []
    for i, r in enumerate(rows):
        every = r[1].split("\n") if r[1] is not None else []
        out.append((r[0], len(every), len(gone[i]), "\n".join(x for k, x in enumerate(every) if k not in gone[i])))
    return out


@pytest.mark.parametrize("most", [2000, 3])
def test_fuzzy_lines_match_brute_force(frame, most):
    base = brute.prose(21, 40)
    rows = [(i, "\n".join([base.replace("stone", f"stone{i}", 1), brute.prose(30 + i, 15), f"page {i} of the long report on rivers"]), "en", "s", 0) for i in range(12)]
    rows += [(50, None, None, None, None), (51, "", None, None, None), (None, brute.prose(99, 12) + "\nshort", None, None, None), (52, brute.prose(98, 9000), "en", "s", 0)]
    rows += [(60 + i, "SHORT\n \n\n}\nitem %d\nand of" % i, "en", "s", 0) for i in range(4)]
    same(fl.fuzzy_lines(frame(rows, more=True), most=most).collect(), lines_expected(rows))


def test_lines_near_by_edit_similarity_alone_are_found(frame):
    rng, pairs = random.Random(12), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for n in (12, 20, 40):
        for changed in range(1, n // 8 + 1):
            for _ in range(60):
                a = [word() for _ in range(n)]
                b = list(a)
                for i in rng.sample(range(n), changed):
                    b[i] = word()
                pairs.append((" ".join(a), " ".join(b)))
    pairs = [p for p in pairs if fl.similar(*p, 80)]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(x for p in pairs for x in p)]
    found = sum(r.n_removed for r in fl.fuzzy_lines(frame(rows)).collect())
    assert len(pairs) > 400 and found >= 0.97 * len(pairs)


def test_repeated_rows_keep_one_line(frame):
    row = (1, brute.prose(5, 30), "en", "s", 0)
    assert sorted(r.n_removed for r in fl.fuzzy_lines(frame([row, row, row])).collect()) == [0, 1, 1]


def test_edit_similarity():
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    rng = random.Random(4)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abd") for c in a) + rng.choice(["", "a"])
        assert fl.similar(a, b, 80) == (distance(a, b) <= max(len(a), len(b)) * 20 // 100)


def test_pairs_side_by_side_are_judged_like_single_ones():
    rng, one, other = random.Random(8), [], []
    for _ in range(1500):
        a = "".join(rng.choice("abc\u00e9 \U0001F600") for _ in range(rng.choice([0, 1, 20, 63, 64, 65, 128, 129, 300, 1100])))
        rate = rng.choice([0.02, 0.15, 0.2, 0.5])
        one.append(a)
        other.append("".join(c if rng.random() > rate else rng.choice(["", "x", "ab"]) for c in a) or rng.choice(["", "q"]))
    assert fl.similar_pairs(one, other, 80).tolist() == [fl.similar(a, b, 80) for a, b in zip(one, other)]
    assert fl.similar_pairs([], [], 80).tolist() == []


def test_a_pair_is_verified_once_however_many_keys_it_shares(frame, monkeypatch):
    base, staged, stage = brute.prose(21, 40), {}, fl.tables.stage

    def kept(df, name="stage"):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(fl.tables, "stage", kept)
    rows = [(i, base.replace("stone", f"stone{'x' * i}", 1) + "x" * i, "en", "s", 0) for i in range(10)]
    doomed = fl.fuzzy_lines(frame(rows))
    pairs = [(r.a, r.b) for r in staged["pairs"].collect()]
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs}) == 45
    assert doomed.count() == 10


def test_pairs_of_unlike_length_are_not_listed(frame, monkeypatch):
    """lines of the same grams, one twice as long as the other, share keys but cannot be similar; their texts are not fetched."""
    base, staged, stage = brute.prose(21, 40), {}, fl.tables.stage

    def kept(df, name="stage"):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(fl.tables, "stage", kept)
    rows = [(0, base, "en", "s", 0), (1, f"{base} {base}", "en", "s", 0)]
    assert [r.n_removed for r in fl.fuzzy_lines(frame(rows)).collect()] == [0, 0]
    assert staged["shared"].count() and not staged["pairs"].count()


def test_texts_of_nodes_are_not_moved_by_joins(spark):
    """a table in buckets meets pairs by its column without an exchange of its own."""
    held = fl.tables.bucketed(spark.range(100).selectExpr("id AS node", "string(id) AS norm"), 3, "node", "held")
    pairs = fl.tables.stage(spark.range(100).selectExpr("id AS a", "99 - id AS b"), "ends")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = pairs.join(held.withColumnRenamed("node", "a"), "a")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in joined.collect()) == [(i, 99 - i, str(i)) for i in range(100)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_connected_pairs_are_not_verified_again(frame, monkeypatch):
    """in a group of like lines a pair for each node connects all; a line that is like one of them only is still found."""
    base, staged, stage = brute.prose(21, 40), {}, fl.tables.stage

    def kept(df, name="stage"):
        staged.setdefault(name, []).append(stage(df, name))
        return staged[name][-1]

    monkeypatch.setattr(fl.tables, "stage", kept)
    rows = [(i, base.replace("stone", f"stone{'x' * i}", 1) + "x" * i, "en", "s", 0) for i in range(10)]
    far = base
    for _ in range(4):  # a chain that leads away from the group
        far = far[: len(far) * 85 // 100] + "".join(chr(97 + (7 * i + len(rows)) % 26) for i in range(len(far) * 15 // 100))
        rows.append((len(rows), far, "en", "s", 0))
    got = fl.fuzzy_lines(frame(rows)).collect()
    n = len({r.node for r in staged["nodes"][0].collect()})
    assert n == 14 and staged["least"][0].count() < n and staged["rest"][0].count() < staged["pairs"][0].count() - 9 * 8 // 2
    lines, root = [fl.normalised(r[1]) for r in rows], list(range(n))
    for i in range(n):
        for j in range(i):
            if fl.similar(lines[i], lines[j], 80):
                root = [root[j] if x == root[i] else x for x in root]
    assert sum(r.n_removed for r in got) == n - len(set(root))


def test_large_tasks_of_few_near_pairs_list_them():
    """only where there are many near pairs for each node, leaders are compared."""
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 55, (200, 2)).astype(np.uint64)
    hashes[:, 1], hashes[150] = 0, hashes[20]
    side, size, most = np.zeros(200, np.int32), np.full(200, 100), 32 * 200
    one, other = fl.near_ones(hashes, side, size, 12, 80, most)
    assert (20, 150) in set(zip(one.tolist(), other.tolist()))
    assert all(np.bitwise_count(hashes[i, 0] ^ hashes[j, 0]) <= fl.SKETCH_DIFFER for i, j in zip(one, other))
    size[150] = 200
    one, other = fl.near_ones(hashes, side, size, 12, 80, most)
    assert 150 not in {*one.tolist(), *other.tolist()}
    assert fl.near_ones(hashes * 0, side, size, 12, 80, most).tolist() == [i for i in range(200) if i != 150]


def test_listed_pairs_are_those_of_each_task():
    """pairs of rows of one task, of both sides if it has two, whatever tasks lie beside it."""
    rng = random.Random(5)
    task = np.sort(np.array([rng.randrange(40) for _ in range(300)]))
    which, side = np.array([12 if t % 2 else 3 for t in task]), np.array([rng.randrange(2) if t % 3 else 0 for t in task])
    hashes, size = np.array([[rng.getrandbits(3), rng.getrandbits(2)] for _ in task], np.uint64), np.array([rng.choice([90, 100, 130]) for _ in task])
    want = set()
    for t in set(task.tolist()):
        rows = np.flatnonzero(task == t).tolist()
        for i in rows:
            for j in rows:
                differ = np.bitwise_count(hashes[i] ^ hashes[j])
                near = differ[0] <= fl.SKETCH_DIFFER if which[i] >= 10 else differ.sum() <= 3
                if i < j and near and abs(size[i] - size[j]) <= max(size[i], size[j]) // 5 and (len({side[k] for k in rows}) == 1 or side[i] != side[j]):
                    want.add((i, j))
    assert set(zip(*(x.tolist() for x in fl.near_pairs(task, which, hashes, side, size, 80)))) == want


def test_pairs_are_compared_in_a_band(monkeypatch):
    """a distance of at most a fifth needs a fifth of the diagonals; wide bands are tried narrow first."""
    rng, used, side_by_side = random.Random(7), [], fl._side_by_side

    def told(*args):
        used.append(args[-1])
        return side_by_side(*args)

    monkeypatch.setattr(fl, "_side_by_side", told)
    letters = "abcdefgh \u00e9\U0001F600"
    for length, most in ((300, 1), (600, 2), (1500, 5)):
        one = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(80)]
        other = ["".join(c if rng.random() > rng.choice([0.05, 0.25]) else rng.choice(["", "x", "ab"]) for c in a) for a in one]
        moved = [a[k % 90 :] + a[: k % 90] for k, a in enumerate(one)]
        used.clear()
        assert fl.similar_pairs(one + one, other + moved, 80).tolist() == [fl.similar(a, b, 80) for a, b in zip(one + one, other + moved)]
        assert used and max(used) <= most and (most < 3 or 1 in used)


def test_normalised_lines_have_single_spaces():
    for line in ("  A b 12\tC ", "a\u00a0b", "x  y", "\u2003", "", " one two ", "\x1ca 7\x85", "E\u0301 \u3000 9 99"):
        assert fl.normalised(line) == " ".join(fl.NUMBER.sub("0", line.lower()).split())


@pytest.mark.parametrize("paired", [0, 1 << 30])
def test_lines_of_pairs_and_of_leaders_are_the_same(frame, paired, monkeypatch):
    monkeypatch.setattr(fl, "PAIRED", paired)
    monkeypatch.setattr(fl, "PER_ROUND", 20)
    base = brute.prose(21, 40)
    rows = [(i, "\n".join([base.replace("stone", f"stone{i}", 1), brute.prose(30 + i, 15)]), "en", "s", 0) for i in range(12)]
    for most in (2000, 3):
        same(fl.fuzzy_lines(frame(rows), most=most).collect(), lines_expected(rows))


def test_every_line_link_counts_whatever_group_is_largest_on_the_way():
    # Links 0-1, 2-3, 2-4, 1-3: 1 is left out while {0, 1} is largest, 3 and 4 while {2, 3, 4} is.
    rng, same_hash = random.Random(6), lambda n: np.zeros((n, 2), np.uint64)
    letters = lambda k: "".join(chr(97 + (i * k) % 26) for i in range(20))
    def walk(steps, start):
        out = [start]
        for k in range(steps):
            now = list(out[-1])
            for i in range(4):
                now[(4 * k + i) % 20] = chr(ord("A") + (k + i) % 26)
            out.append("".join(now))
        return out

    chain = walk(4, letters(7))
    cases = [[chain[0], chain[1], chain[3], chain[2], chain[4]]]
    for _ in range(300):
        lines = [line for k in rng.sample((3, 5, 7, 9, 11), 3) for line in walk(rng.randrange(1, 7), letters(k))]
        rng.shuffle(lines)
        cases.append(lines)
    for lines in cases:
        n = len(lines)
        want, got = list(range(n)), list(range(n))
        links = [(i, j) for i in range(n) for j in range(i) if fl.similar(lines[i], lines[j], 80)]
        for root, pairs in ((want, links), (got, fl.unite(list(range(n)), same_hash(n), lines, np.zeros(n, int), 0, 80))):
            for i, j in pairs:
                a, b = root[i], root[j]
                root[:] = [min(a, b) if r in (a, b) else r for r in root]
        assert got == want


def test_hashes_within_three_bits_share_a_key_and_have_one_task():
    rng = random.Random(9)
    for _ in range(200):
        x = [rng.getrandbits(64), rng.getrandbits(16)]
        y = list(x)
        for bit in rng.sample(range(80), 3):
            y[bit // 64] ^= 1 << bit % 64
        both = np.array([x, y], np.uint64)
        found = fl.keys(both)
        shared = np.flatnonzero(found[0] == found[1])
        assert len(shared)
        assert [k for k in range(10) if fl.near(both, both[0], k)[1]] == [shared[0]]


def test_empty_tables(frame):
    assert nd.near_duplicates(frame([])).count() == 0
    assert nd.keep_one(frame([])).count() == 0
    assert fl.fuzzy_lines(frame([])).count() == 0
