"""Results do not depend on how many blocks the texts are dealt into: brute force, and one block against many."""

import brute
import pytest
from pyspark.sql import functions as F
from tillwork.llm import fuzzy_lines, near_dup, suffix_dedup, tables, window_dedup


def gone():
    return F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def told(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(params=[2000, 40_000, 6 << 20])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(tables, "BLOCK_BYTES", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows(table):
    """Rows of the given table with passages shared by documents far apart, and the awkward cases."""
    shared = brute.prose(50, 60)
    more = [(10_000 + i, brute.prose(60 + i, 30) + " " + shared + " " + brute.prose(90 + i, 30), "en", "s", 1) for i in range(12)]
    return table + more + brute.edge_rows()


def test_blocks_hold_every_row_once(frame, rows, block_bytes):
    texts, n = tables.blocks(tables.as_documents(frame(rows)))
    assert texts.count() == len(rows) == texts.select("uid").distinct().count()
    held = texts.select("block").distinct().count()
    assert held <= n and (held > 1) == (n > 1)


def test_windows_at_any_number_of_blocks(frame, rows, block_bytes):
    got = window_dedup.remove_repeated_windows(frame(rows), 35).select("doc_id", "n_words", gone().alias("n"), F.sha2("kept", 256).alias("sha"))
    want = [(r[0], *w) for r, w in zip(rows, brute.repeated_windows([r[1] for r in rows], 35))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_bytes_at_any_number_of_blocks(frame, rows, block_bytes):
    small = [r for r in rows if len(r[1] or "") < 6000]
    want = [(r[0], *w) for r, w in zip(small, brute.repeated_bytes([r[1] for r in small], 400))]
    for most in (1 << 15, 3):  # sorted, and counted as a hot group
        got = suffix_dedup.remove_repeated_bytes(frame(small), 400, most)
        got = got.select("doc_id", "n_bytes", gone().alias("n"), F.size("removed").alias("spans"), F.sha2("kept", 256).alias("sha"))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("block_bytes", [40_000, 6 << 20], indirect=True)
def test_near_duplicates_at_any_number_of_blocks(frame, rows, block_bytes):
    found = brute.groups([brute.shingles(r[1]) for r in rows], 85)
    got = near_dup.near_duplicates(frame(rows))
    ids = [r[0] for r in rows]
    least = {}
    for i, g in enumerate(found):
        if ids[i] is not None:
            least[g] = min(least.get(g, ids[i]), ids[i])
    want = sorted((str(ids[i]), str(least.get(g))) for i, g in enumerate(found))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == want
    kept = near_dup.keep_one(frame(rows, more=True))
    assert kept.count() == len(set(found))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least[g] for g in set(found) if g in least)


@pytest.mark.parametrize("block_bytes", [40_000], indirect=True)
def test_lines_at_any_number_of_blocks(frame, rows, block_bytes, monkeypatch):
    got = told(fuzzy_lines.fuzzy_lines(frame(rows)))
    monkeypatch.setattr(tables, "BLOCK_BYTES", 1 << 30)
    assert got == told(fuzzy_lines.fuzzy_lines(frame(rows)))


def test_dropped_tables_and_parts_are_gone(spark):
    import os

    table = tables.stage(spark.range(9).selectExpr("id", "CAST(id % 3 AS INT) AS level"), "levels", "level")
    files = table.inputFiles()
    tables.drop(table, part="level=1")
    left = [f for f in files if os.path.exists(f.split("file:")[-1].replace("///", "/"))]
    assert {os.path.basename(os.path.dirname(f)) for f in left} == {"level=0", "level=2"}
    assert sorted(r.id for r in table.where("level = 2").collect()) == [2, 5, 8]
    tables.drop(table)
    assert not any(os.path.exists(f.split("file:")[-1].replace("///", "/")) for f in files)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
