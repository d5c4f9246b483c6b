"""Operators 11, 12 and 13: held-out accuracy, dense linear algebra and a plain shortest-path search."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tillwork.llm import auction_path as ap, conversation_repair as cr, feast, language_id as li, whitening as wh

from conftest import SF

def crc():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))

CONV = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- language identification

def test_terms_are_the_n_grams_of_the_whole_text():
    def plain(text):
        s = re.sub(" +", " ", " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "") + " ")
        return [len({(n, s[i : i + n]) for i in range(len(s) - n + 1)}) for n in (1, 2, 3)] if s.strip() else []

    texts = [None, "", " 12 ", "a", "Ab, aB!", "Éa 世界 É", "x" * 5000, "\U0001d54f y"]
    for text, grams in zip(texts, li.terms(pa.array(texts))):
        want = plain(text)
        assert len(grams) == (min(3, len(want)) if want else 0)
        assert all(len(np.unique(g)) <= w for g, w in zip(grams, want))
    one, two = list(li.terms(pa.array(["Ab  ab1", "ab ab"])))
    assert [g.tolist() for g in one] == [g.tolist() for g in two]


def test_weights_are_sparse_and_the_temperature_fits():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        label = int(rng.integers(3))
        at = np.sort(rng.choice(60, 12, replace=False))
        at = np.unique(np.append(at, label * 20 + rng.integers(0, 5, 4)))
        rows.append((np.append(at, 60), np.append(np.full(len(at), len(at) ** -0.5), 1.0), label))
    w = li.follow_the_leader(rows[:300], 61, 3, l1=0.5)
    zeros = [(li.follow_the_leader(rows[:300], 61, 3, l1=x)[:-1] == 0).mean() for x in (0.0, 0.5, 1.0, 2.0)]
    assert zeros == sorted(zeros) and zeros[0] == 0 and zeros[-1] > 0.3
    right = [int((values @ w[at]).argmax()) == label for at, values, label in rows[300:]]
    assert np.mean(right) > 0.9
    logits = rng.standard_normal((4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in li.softmax(logits / 2.5)])
    assert 2.2 < li.temperature(logits, labels) < 2.8


def test_held_out_accuracy_and_inputs(spark, frame, table):
    docs = frame(table, more=True)
    got = {r.doc_id: r for r in li.identify(docs, crc() % 3 == 1).collect()}
    assert len(got) == len({r[0] for r in table})
    held = [r for r in table if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in table)
    lettered = [r for r in held if r[1] and any(c.isalpha() for c in r[1])]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in lettered]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    # lang and source of the held-out rows are never looked at
    changed = frame([(d, t, "xx", "other", n) if zlib.crc32(str(d).encode()) % 3 == 1 else (d, t, lang, s, n) for d, t, lang, s, n in table])
    again = {r.doc_id: r.lang_pred for r in li.identify(changed, crc() % 3 == 1).collect()}
    assert again == {k: r.lang_pred for k, r in got.items()}


def test_document_frequencies_cover_all_rows(frame):
    rows = [(1, "ab", "x", None, 1), (2, "ab ab", "x", None, 1), (3, None, "y", None, 1), (4, "12", "y", None, 1)]
    n, df = li.document_frequencies(frame(rows))
    assert n == 2 and df.max() == 2
    assert (df > 0).sum() == len({int(x) for g in list(li.terms(pa.array(["ab", "ab ab"])))[1] for x in g} | {int(x) for g in list(li.terms(pa.array(["ab"])))[0] for x in g})


def test_language_edges(frame):
    rows = brute.edge_rows()
    got = li.identify(frame(rows, more=True), crc() % 3 == 1).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for d, t, *_ in rows if d == r.doc_id]
        if all(not t or not any(c.isalpha() for c in t) for t in texts):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert li.identify(frame([]), crc() % 3 == 1).collect() == []
    unlabelled = li.identify(frame([(1, "some words", None, None, 1)]), crc() % 3 == 1).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
    single = li.identify(frame([(2, "some words", "en", None, 1), (None, "more", None, None, 1)]), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("en", 1.0)}


# ---------------------------------------------------------------- whitening

@pytest.mark.parametrize("kind", ["spread", "low rank", "equal", "uneven"])
def test_eigenpairs_against_dense_solver(kind):
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 24):
        a = rng.standard_normal((n, n + 2))
        if kind == "low rank":
            a[:, 2:] = 0
        if kind == "equal":
            a = np.eye(n) * 3
        if kind == "uneven":
            a[0] *= 1e4
        v = a @ a.T
        values = np.linalg.eigvalsh(v)[::-1]
        for shift in rng.uniform(0.01, values[0], 6):
            assert feast.above(v, shift) == (values > shift).sum()
        e, q = feast.eigenpairs(v, min(16, n))
        assert np.allclose(e, values[: len(e)], rtol=1e-12, atol=1e-12 * values[0])
        assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-12


def test_intervals_miss_no_eigenvalue():
    v = np.diag([9.0, 9.0, 9.0, 8.999999999, 5.0, 4.0, 4.0, 1.0])
    got = feast.intervals(v, 6, most=2)
    assert sum(c for *_, c in got) >= 6
    for low, high, count in got:
        assert count == sum(low < x <= high for x in np.diag(v))


def whitened(rows, components=16):
    """x of the kept rows, eigenvalues and whitened values up to sign."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in kept], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit - np.array([float(t) / n for t in s])).astype(float)
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    own = (x - np.array([float(t) / n for t in s])).astype(float)
    return [i for i, _ in kept], n, [sum((n * a - t) ** 2 for a, t in zip(r, s)) for r in x.tolist()], own @ q / np.sqrt(e), e / np.trace(cov)


def test_whitening_of_a_table(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in source.collect()]
    bad = [(9001, None), (9002, [None] + rows[0][1][1:]), (9003, [float("nan")] + rows[0][1][1:]), (9004, [float("inf")] + rows[0][1][1:]), (9005, rows[3][1]), (None, rows[4][1])]
    more = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS x", "3 AS component")
    ids, n, deviation, white, share = whitened(rows + bad)
    got = wh.whiten(more).collect()
    assert len(got) == 16 * len(ids)
    place = {i: k for k, i in enumerate(ids)}
    columns = defaultdict(list)
    for r in got:
        k = place[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[k])
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        columns[r.component].append((r.whitened, white[k][r.component - 1]))
    for pairs in columns.values():
        a, b = np.array(pairs).T
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-6


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<double>"
    count = lambda rows: wh.whiten(spark.createDataFrame(rows, kind)).count()
    assert count([]) == 0
    assert count([(1, None)]) == 0
    assert count([(1, [])]) == 0
    assert count([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == 0
    assert count([(1, [0.5, 1.0]), (2, [0.5, 2.0])]) == 2  # one component
    got = wh.whiten(spark.createDataFrame([(1, [3.0]), (2, [1.0, 2.0]), (3, [5.0, 7.0]), (3, [5.0, 7.0])], kind)).collect()
    ids, n, deviation, white, share = whitened([(1, [3.0, 0.0]), (2, [1.0, 2.0]), (3, [5.0, 7.0])])
    assert len(got) == 8 and {(r.n, r.deviation) for r in got} == {(n, d) for d in deviation}
    far = wh.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])], kind)).collect()
    assert far and all(r.deviation is None or r.deviation >= 0 for r in far)


# ---------------------------------------------------------------- conversation repair

def least_edits(rows):
    """(cost, audit, repaired) of (role, text, fault) rows: best (cost, audit) of every state, row by row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for c in "ua":
                    after = step.get((state, c))
                    new = (cost + 2, audit + "I", turns + [(full[c], "")])
                    if after and (after not in best or new[:2] < best[after][:2]):
                        best[after] = new
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        following = {}
        for state, (cost, audit, turns) in inserted(best).items():
            options = [(state, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                options += [(step.get((state, role[:1])), late, "K", [(role, text)])]
                options += [(step.get((state, c)), 2 + late, "R", [(full[c], text)]) for c in "ua"]
            for after, price, name, turn in options:
                new = (cost + price, audit + name, turns + turn)
                if after is not None and (after not in following or new[:2] < following[after][:2]):
                    following[after] = new
        best = following
    return min((v for s, v in inserted(best).items() if s in ("", "a")), key=lambda v: v[:2])


def expected(rows):
    """Result rows of op13 for (conv_id, turn, role, text) rows, which have no two different rows of one turn."""
    known = lambda x: " " if x is None else x
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        turns, seen, faults = [t for t, *_ in own if t is not None], set(), []
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "fine")
            seen.add((role, text))
        cost, audit, repaired = least_edits([(r, t, f) for (_, r, t), f in zip(own, faults)])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, brute.sha("\n".join(f"{r}:{t}" for r, t in repaired))))
    return out


def told(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def audit_of(rows):
    return cr.audited(cr.as_turns(rows), cr.damage(cr.as_turns(rows)))


def test_auction_finds_least_cost_and_least_letters():
    rng = random.Random(9)
    roles, faults = {0: "system", 1: "user", 2: "assistant", 3: "tool"}, ap.FAULTS
    for k in range(800):
        marks = [(rng.choice([0, 1, 1, 2, 2, 3] if k % 2 else [1, 2]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 11))]
        codes = "".join(ap.letter(*m) for m in marks)
        cost, audit, _ = least_edits([(roles[i], "x", faults[f]) for i, f in marks])
        assert ap.repair(codes) == (cost, audit)
        assert ap.repair(codes, block=2) == (cost, audit)


def test_prices_are_feasible_and_exact():
    lattice = ap.Lattice("".join(ap.letter(*m) for m in [(1, 0), (1, 3), (2, 1), (0, 0), (3, 0), (2, 2), (2, 0)]), list(ap.CLOSING))
    distances = [lattice.settle(s) for s in range(4)]
    for node in range(len(lattice.prices) - 1):
        assert all(lattice.prices[node] <= cost + lattice.prices[j] for _, cost, j in lattice.arcs(node))
    assert distances == [lattice.prices[s] + lattice.shift for s in range(4)]


def test_repair_of_the_whole_table(spark):
    source = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in source.select("conv_id", "turn", "role", "text").collect()]
    assert told(audit_of(source.selectExpr("*", "1 AS part", "2 AS at", "'x' AS digest"))) == sorted(expected(rows), key=str)


def test_repair_edges(spark):
    rng = random.Random(4)
    says = ["Yes.", "No", "", " \n", None, "What?", "Yes."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(says)) for c in range(60) for t in range(rng.randint(1, 9)) if rng.random() < 0.8]
    rows += [(None, t, "user", "Yes.") for t in range(4)] + [(70, None, "user", "No."), (71, -5, "assistant", "z" * 100_000), (71, 9, "user", "é.")]
    assert told(audit_of(spark.createDataFrame(rows, CONV))) == sorted(expected(rows), key=str)
    assert told(audit_of(spark.createDataFrame([], CONV))) == []


def test_one_long_conversation_over_many_parts(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["One.", "Two", "Three!", f"{t}.", f"{t}"])) for t in range(700)]
    rows += [(8, t, "user", f"{t}.") for t in range(5)]
    turns = cr.placed(cr.damage(cr.as_turns(spark.createDataFrame(rows, CONV))), rows_per_part=60)
    assert turns.select("part").distinct().count() > 8
    summary = cr.edits(cr.letters(turns)).cache()
    hashed = {r.conv_id: r.repaired_sha256 for r in cr.digests(cr.apply_edits(turns, summary, "conv_id")).collect()}
    want = {r[0]: r for r in expected(rows)}
    assert {r.conv_id: (r.cost, r.audit) for r in summary.collect()} == {k: r[6:8] for k, r in want.items()}
    assert hashed == {k: r[8] for k, r in want.items()}
    spread = sorted((r.conv_id, r.part, r.at, k, r.role, r.text) for k, r in enumerate(cr.apply_edits(turns, summary, "conv_id", "part").collect()))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for c, *_, r, t in spread if c == 7).encode()).hexdigest() == want[7][8]
