"""Operators 2, 6 and 8 and the pipeline."""

import random
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import pytest
from tillwork.llm import catalog, decontamination as dc, kd_shards, mixing, quality_rules, tables

from conftest import SF


def check_shards(got, rows, shards):
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_of_whole_table(spark, table):
    out = kd_shards.op2_kd_shards(spark, SF)
    check_shards(out.collect(), table, 40)
    assert out.schema["grown_shard"].dataType.simpleString() == "int"


def test_shards_have_near_equal_bytes(frame):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(10, 400) + str(i), rng.choice(["en", "de"]), f"s{rng.randrange(9)}", 0) for i in range(3000)]
    rows += [(4000 + i, "copy " * 30, "en", "hot", 0) for i in range(1500)]  # more than a shard of equal texts
    got = kd_shards.shard(frame(rows, more=True), 7, per_range=100).collect()
    sizes = check_shards(got, rows, 7)
    mean = sum(sizes.values()) / 7
    assert len(sizes) == 7 and all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    shards = defaultdict(set)
    for r in got:
        if r.doc_id < 4000:
            shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_shards_of_awkward_rows(frame):
    rows = brute.edge_rows()
    check_shards(kd_shards.shard(frame(rows, more=True), 5).collect(), rows, 5)
    by_bytes = kd_shards.shard(frame(rows), target_bytes=20_000).collect()
    assert len({r.shard for r in by_bytes}) > 1
    assert kd_shards.shard(frame([]), 4).count() == 0


def test_sainte_lague_gives_the_highest_quotients():
    rng = random.Random(3)
    for _ in range(200):
        shares = [rng.choice([0, rng.random(), 5, 5]) for _ in range(rng.randint(1, 6))]
        if not sum(shares):
            continue
        seats, held = rng.randint(0, 40), [0] * len(shares)
        for _ in range(seats):
            held[max(range(len(shares)), key=lambda i: (shares[i] / (2 * held[i] + 1), -i))] += 1
        assert mixing.sainte_lague(shares, seats) == held


def plain_targets(sizes):
    weights, cap = [1 + i % 3 for i in range(len(sizes))], set()
    while True:
        left, w = sum(sizes) - sum(3 * sizes[i] for i in cap), sum(x for i, x in enumerate(weights) if i not in cap)
        out = [3 * s if i in cap else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in cap and out[i] > 3 * s}
        if not over:
            return out
        cap |= over


def check_mix(got, rows, slack):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, plain_targets([sizes[s] for s in names])))
    taken = defaultdict(int)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), len(brute.words(r[1]))) for r in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= slack for s in names)


def test_mix_of_awkward_rows_and_whole_table(spark, frame, table):
    rows = brute.edge_rows()
    check_mix(mixing.mixed(frame(rows, more=True).drop("size"), block=8).collect(), rows, 32)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_mix(mixing.mixed(docs).collect(), table, 96)
    again = [sorted((r.doc_id, r.taken) for r in mixing.op6_mixing(spark, SF).collect()) for _ in range(2)]
    assert again[0] == again[1]
    assert mixing.mixed(frame([])).count() == 0


def test_words_of_each_shard_are_its_quota_of_blocks(frame, table):
    got = mixing.mixed(frame(table), block=16, shards=5).collect()
    sizes, target, words = {}, {}, defaultdict(lambda: [0] * 5)
    for r in got:
        assert sum(r.shards) == r.taken and min(r.shards) >= 0
        sizes[r.source], target[r.source] = r.source_size, r.target
        words[r.source] = [a + b for a, b in zip(words[r.source], r.shards)]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    plan = mixing.quotas([target[s] for s in names], [sizes[s] for s in names], 16, 5)
    for s, quota in zip(names, plan):
        short = 16 - (sizes[s] % 16 or 16)  # the last block of a stream, which may come up once in each round
        assert all(16 * q - 3 * short <= w <= 16 * q for q, w in zip(quota, words[s]))


def test_written_copies_stay_near_the_words_taken(spark, frame, table):
    rows = [(i, brute.prose(i, 4000 if i % 50 == 0 else 20 + i % 90), "en", f"s{i % 3}", 1) for i in range(300)] + table
    docs = frame(rows, more=True)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in mixing.mixed(docs.drop("size")).collect():
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    written = defaultdict(int)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        written[r.source] += len(brute.words(r.text))
    assert all(abs(written[s] - taken[s]) <= 1.2 * longest[s] for s in taken)
    assert mixing.mix(frame([])).count() == 0
    assert {r.text for r in mixing.mix(frame([(1, None, "en", None, 0), (2, " ", "en", "a", 0), (None, "one word", None, None, None)]), block=1).collect()} == {"one word"}


def test_scopes_are_emptied(spark, frame):
    with tables.scope("test"):
        held = tables.stage(frame([(1, "a", "en", "s", 1)]), "scoped")
        texts, _ = tables.blocks(tables.as_documents(held))
        assert held.count() == texts.count() == 1
    kept = tables.stage(frame([(1, "a", "en", "s", 1)]), "kept")
    tables.release(spark, "test")
    tables.release(spark, "test")
    assert kept.count() == 1
    with pytest.raises(Exception):
        held.collect()


def test_quotas_by_shard_add_up():
    target, sizes = [100.0, 900.0, 500.0], [800, 400, 300]
    plan = mixing.quotas(target, sizes, 10, 4)
    assert all(q >= 0 for row in plan for q in row)
    assert [sum(row) for row in plan] == mixing.sainte_lague(target, 150)
    by_shard = [sum(row[k] for row in plan) for k in range(4)]
    assert max(by_shard) - min(by_shard) <= 1


def test_masks_lose_no_window():
    import itertools

    for missing in itertools.combinations(range(dc.WINDOW), dc.DIFFERING):
        left = set(range(dc.WINDOW)) - set(missing)
        assert any(all(o + p in left for p in mask) for mask in dc.MASKS for o in range(dc.WINDOW - mask[-1]))


def plain_words(text):
    return brute.words("".join(c for c in (text or "").lower() if c not in dc.MARKS))


def plain_verdict(text, items):
    w, found, best = plain_words(text), set(), 0
    for i, item in items:
        b = plain_words(item)
        for start in range(-len(b) + 1, len(w)) if b else ():
            same = [int(0 <= start + k < len(w) and w[start + k] == b[k]) for k in range(len(b))]
            n = min(13, len(b))
            if any(sum(same[k : k + n]) * 13 >= n * 11 for k in range(len(b) - n + 1)):
                found.add(i)
                best = max(best, sum(same))
    return bool(found), sorted(x for x in found if x is not None), best


def test_decontamination_matches_brute_force(spark, frame):
    items = [(1, brute.prose(70, 40)), (2, brute.prose(71, 14)), (3, None), (4, ""), (5, brute.prose(70, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1].split()
    changed = [x if k % 7 else "other" for k, x in enumerate(w)]
    far = [x if k % 3 else "other" for k, x in enumerate(w)]
    rows = brute.edge_rows() + [(200, "x y " + items[0][1].upper().replace(" ", ", ") + " z", "en", "s", 0), (201, " ".join(["p", *changed, "q"]), "en", "s", 0),
                                (202, " ".join(["p", *far, "q"]), "en", "s", 0), (203, " ".join(w[10:24]), "en", "s", 0), (204, " ".join(w[10:20]), "en", "s", 0),
                                (205, "lead\n" + items[1][1], "en", "s", 0), (205, "lead\n" + items[1][1], "en", "s", 0)]
    df = frame(rows, more=True)
    got = sorted((str(r.doc_id), r.contaminated, r["items"], r.best_equal) for r in dc.verdicts(df, bench).collect())
    want = {r[1]: plain_verdict(r[1], items) for r in rows}
    assert got == sorted((str(r[0]), *want[r[1]]) for r in rows)
    assert sum(x[0] for x in want.values()) >= 4 and not want[rows[-5][1]][0]
    clean = dc.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not want[r[1]][0] for r in rows)
    assert dc.verdicts(frame([]), bench).count() == 0
    assert not dc.verdicts(df, bench.limit(0)).where("contaminated").count()


def test_connected_groups(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_and_run(spark):
    """Each stage on its predecessor's output: columns, and what it keeps, against the operators' own verdicts or brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = tables.stage(corpus_pipeline.quality(spark, docs, SF))
    verdict = {r.doc_id: r.kept for r in quality_rules.op4_quality_rules(spark, SF).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in verdict.items() if v)
    single = tables.stage(corpus_pipeline.near_duplicates(spark, kept, SF))
    rows = sorted((tuple(r) for r in kept.select("doc_id", "text").collect()))
    first = brute.groups([brute.shingles(t) for _, t in rows], 85)
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[i][0] for i in first})
    clean = tables.stage(corpus_pipeline.clean_of_benchmark(spark, single, SF))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    flags = {r.doc_id: r.contaminated for r in dc.verdicts(single, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k for k, v in flags.items() if not v)
    mixed = tables.stage(corpus_pipeline.mix(spark, clean, SF))
    assert mixed.columns == docs.columns and not mixed.join(clean, "doc_id", "left_anti").count()
    out = corpus_pipeline.shards(spark, mixed, SF)
    assert out.count() == mixed.count()
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_is_registered(n):
    assert sum(name.startswith(f"op{n}_") for name in catalog.QUERIES) == 1
