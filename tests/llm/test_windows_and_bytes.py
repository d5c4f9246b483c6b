"""Operators 3 and 5 against brute force; deep-shallow sorting and the rolling helpers by themselves."""

import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tillwork.llm import words as wd
from tillwork.llm.suffix_dedup import anchors, gram_hashes, op3_suffix_dedup, remove_repeated_bytes, starts_of, with_grams
from tillwork.llm.suffix_sort import common, deep_shallow
from tillwork.llm.window_dedup import is_in, op5_window_dedup, remove_repeated_windows

from conftest import SF


def gone(column="removed"):
    return F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def both(rows, got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)


def test_words_are_those_of_the_pattern():
    texts = [None, "", " a\tb\x0bc\x0c\rd\n", "é ü x", "long" * 20 + " z"]
    part = wd.words(pa.array(texts))
    for i, t in enumerate(texts):
        a, b = part.first[i], part.first[i + 1]
        assert [part.raw[s:e].tobytes().decode() for s, e in zip(part.starts[a:b], part.ends[a:b])] == brute.words(t)


def test_hashes_depend_on_content_only():
    a, b = wd.words(pa.array(["x y zebra crossing"])), wd.words(pa.array(["pre fix", "q x y zebra crossing"]))
    assert a.hashes.tolist() == b.hashes[3:].tolist()
    assert wd.rolling(a.hashes, 3).tolist() == wd.rolling(b.hashes, 3)[3:].tolist()


def test_chosen_is_the_leftmost_least():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 9, 200).astype(np.uint64) << np.uint64(40)
    for w in (1, 2, 5, 7, 64):
        assert wd.chosen(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(200 - w + 1)]


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    values = np.random.default_rng(2).integers(0, 2**64, 500, np.uint64, endpoint=False)
    raw = values.view(np.uint8)[:700] % 3
    whole = wd.mix(values).tolist(), wd.rolling(values, 40).tolist(), wd.chosen(values, 40).tolist(), gram_hashes(raw).tolist()
    found = np.sort(values[::7])
    for size in (1, 17, 64):
        monkeypatch.setattr(wd, "CHUNK", size)
        assert (wd.mix(values).tolist(), wd.rolling(values, 40).tolist(), wd.chosen(values, 40).tolist(), gram_hashes(raw).tolist()) == whole
        assert is_in(values, found).tolist() == [i % 7 == 0 for i in range(500)]
    assert not is_in(values, found[:0]).any()


def test_only_texts_with_a_found_gram_are_anchored_again():
    texts = pa.array(["", brute.prose(1, 60), None, brute.prose(2, 90), "short", brute.prose(3, 90)])
    raw, offsets, grams, starts, picks = anchors(texts, 90)
    assert starts.tolist() == [i for a, b in zip(offsets, offsets[1:]) for i in range(a, b - 89)]
    assert starts_of(offsets, 10**6).tolist() == []
    of_text = {i: np.unique(grams[picks[(starts >= offsets[i]) & (starts < offsets[i + 1])]]) for i in (1, 3, 5)}
    for i, own in of_text.items():
        assert with_grams(texts, own[:1]).to_pylist() == [texts[i].as_py()]
    assert len(with_grams(texts, np.zeros(0, np.uint64))) == 0


def test_deep_shallow_sorts_groups():
    rng = random.Random(5)
    for _ in range(60):
        strings, group = [], []
        for g in range(rng.randint(1, 4)):
            base = bytes(rng.choice(b"ab\0") for _ in range(rng.choice([3, 70, 130])))
            for _ in range(rng.randint(1, 8)):
                s = bytearray(base)
                if s:
                    s[rng.randrange(len(s))] = rng.choice(b"ab\0c")
                strings.append(bytes(s[: rng.randint(0, len(s))] if rng.random() < 0.4 else s))
                group.append(g)
        order, lcps = deep_shallow(strings, np.array(group))
        at = 0
        for g in sorted(set(group)):
            mine = sorted(s for s, k in zip(strings, group) if k == g)
            assert [strings[i] for i in order[at : at + len(mine)]] == mine
            assert lcps[at : at + len(mine)].tolist() == [-1, *(common(a, b) for a, b in zip(mine, mine[1:]))]
            at += len(mine)


def test_windows_match_brute_force_on_awkward_rows(frame):
    rows = brute.edge_rows()
    out = remove_repeated_windows(frame(rows, more=True), 10, 3).select("doc_id", "n_words", gone(), F.sha2("kept", 256))
    both(rows, out.collect(), brute.repeated_windows([r[1] for r in rows], 10))


def test_bytes_match_brute_force_on_awkward_rows(frame):
    rows = brute.edge_rows()
    want = brute.repeated_bytes([r[1] for r in rows], 90)
    for most in (1 << 15, 1):  # sorted in the task, or counted as strings
        out = remove_repeated_bytes(frame(rows, more=True), 90, most).select("doc_id", "n_bytes", gone(), F.size("removed"), F.sha2("kept", 256))
        both(rows, out.collect(), want)


def test_whole_queries_match_brute_force(spark, table):
    both(table, op5_window_dedup(spark, SF).collect(), brute.repeated_windows([r[1] for r in table], 35))
    both(table, op3_suffix_dedup(spark, SF).collect(), brute.repeated_bytes([r[1] for r in table], 400))


def test_empty_tables(frame):
    assert remove_repeated_windows(frame([])).count() == 0
    assert remove_repeated_bytes(frame([])).count() == 0
