"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

1. One pass makes each text's set of 5-word shingles, its size, a 128-bit digest and the hashes of its signature's bands. Texts
   with equal sets are one node from here on, whatever their number.
2. Nodes that share a band are linked to the least of the band's nodes, so a band of n nodes gives n - 1 links. The connected
   groups of these links hold every pair that shares a band; they are only candidates.
3. Each candidate group is verified on full sets. A task compares leaders with all its nodes through an inverted index and unites
   what is similar enough, until every node outside the group that is largest at the end has been a leader: then any two nodes of
   different groups have been compared. A tight group needs few leaders, and no pairs are listed.
4. A candidate group larger than a task is cut into chunks that are verified alone; then its best connected node is compared with
   every node of the group; then the nodes not yet united with it, as a rule few, meet every chunk. This is exact as well.

With 36 bands of 7 values a pair of similarity 0.85 shares no band with a chance below 1e-6, one of 0.9 below 1e-10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables, words as wd

SHINGLE, BANDS, ROWS = 5, 36, 7
SLOTS = BANDS * ROWS  # at most 256, so that a permutation fits bytes
SLICE = 1 << 17  # elements whose permutations are held at once
SETS = "block int, uid long, doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
MEMBER = "task long, side int, label long, uid long, shingles binary"
LINKS = "a long, b long, links long"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one behind the other, and the n + 1 offsets."""
    part = wd.words(texts, lower=True)
    n, count = len(texts), np.diff(part.first)
    owner, hashes = [], []
    starts = np.flatnonzero(wd.within(part.first, SHINGLE))
    owner.append(part.text[starts])
    hashes.append(wd.rolling(part.hashes, SHINGLE)[starts])
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        owner.append(short)
        hashes.append(wd.mix(wd.rolling(part.hashes, k)[part.first[short]] + np.uint64(k)))
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[fresh], hashes[fresh]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def _signatures(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SuperMinHash: in round j every element draws the j-th place of its own permutation of the slots and a value in [j, j + 1).

    A set whose slots are all below j + 1 after round j cannot change any more and stops.
    """
    out = np.full(n * SLOTS, np.uint64(2**64 - 1))
    places = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
    live = np.arange(len(elements))
    for j in range(SLOTS):
        drawn = wd.mix(elements[live] + np.uint64(int(wd.BASE) * (j + 1) % 2**64))
        k = j + ((drawn & np.uint64(0xFFFFFF)) * np.uint64(SLOTS - j) >> np.uint64(24)).astype(np.int64)
        slot = places[live, k]
        places[live, k] = places[live, j]
        np.minimum.at(out, owner[live] * SLOTS + slot, (np.uint64(j) << np.uint64(40)) | (drawn >> np.uint64(24)))
        sets = np.unique(owner[live])
        open_ = np.zeros(n, bool)
        open_[sets] = out.reshape(n, SLOTS)[sets].max(axis=1) >= np.uint64((j + 1) << 40)
        live = live[open_[owner[live]]]
        if not len(live):
            break
    return out.reshape(n, SLOTS)


def signatures(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signature of each set; sets are taken in slices, and a longer set is the least of its slices' signatures."""
    n = len(first) - 1
    out = np.full((n, SLOTS), np.uint64(2**64 - 1))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE, "right")) - 1)
        b = min(b, n)
        for low in range(first[a], max(first[b], first[a] + 1), SLICE):
            high = min(low + SLICE, first[b])
            owner = np.searchsorted(first[a : b + 1], np.arange(low, high), "right") - 1
            out[a:b] = np.minimum(out[a:b], _signatures(elements[low:high], owner, b - a))
        a = b
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * wd.BASE, (len(signature), 1))
    values = signature.reshape(-1, BANDS, ROWS)
    for i in range(ROWS):
        out = wd.mix(out * wd.M1 + values[:, :, i])
    return out


def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    """SETS rows of the rows (block, uid, doc_id, text)."""
    n, d1, d2, marks = [], [], [], []
    for a, b in wd.pieces(batch.column(3), 1 << 20):
        elements, first = shingle_sets(batch.column(3).slice(a, b - a))
        count = np.diff(first)
        full = count > 0
        one, two = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
        if full.any():
            one[full] = np.add.reduceat(wd.mix(elements ^ wd.M1), first[:-1][full])
            two[full] = np.add.reduceat(wd.mix(elements ^ wd.M2), first[:-1][full])
        band = np.zeros((b - a, BANDS), np.uint64)
        if full.any():
            band[full] = bands(signatures(elements, np.concatenate([[0], np.cumsum(count[full])])))
        n.append(count), d1.append(one), d2.append(two), marks.append(band)
    flat = np.concatenate(marks).view(np.int64).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
    columns = [*batch.columns[:3], pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(d1).view(np.int64)),
               pa.array(np.concatenate(d2).view(np.int64)), lists]
    return pa.RecordBatch.from_arrays(columns, names=["block", "uid", "doc_id", "n_shingles", "d1", "d2", "bands"])


def unite(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """Links (index, index, links of the first) that connect what is similar; enough of them, not all.

    Nodes of equal labels are united already. If any node is of side 1, only sides 1 and 0 are compared with each other.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    token, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(number, kind="stable")
    holders, at = owner[order], np.searchsorted(number[order], np.arange(len(token) + 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    spread = np.add.reduceat(np.diff(at)[number].astype(float), first[:-1]) / sizes
    _, group = np.unique(label, return_inverse=True)
    two = bool((side == 1).any())
    out: list[tuple[int, int, int]] = []
    counts = np.bincount(group)
    led, order = np.zeros(n, bool), np.argsort(-spread, kind="stable")
    todo = order[side[order] != 0] if two else order
    while len(todo):
        for i in todo.tolist():
            if counts.max() == n:
                return out
            if not two and out and counts.argmax() == group[i]:
                continue
            led[i] = True
            mine = number[first[i] : first[i + 1]]
            met = np.bincount(np.concatenate([holders[at[t] : at[t + 1]] for t in mine.tolist()]), minlength=n)
            linked = 100 * met >= percent * (sizes + sizes[i] - met)
            linked[i] = False
            if two:
                linked &= side == 0
            n_links = int(linked.sum())
            for j in np.flatnonzero(linked & (group != group[i])).tolist():
                if group[j] != group[i]:
                    out.append((i, j, n_links))
                    counts[group[i]] += counts[group[j]]
                    counts[group[j]] = 0
                    group[group == group[j]] = group[i]
        # Another group may be the largest now: those left out for the former one that are not in it lead as well.
        todo = order[~led[order] & (group[order] != counts.argmax())] if not two else order[:0]
    return out


def _verify(batches, percent: int):
    """LINKS of MEMBER rows that come sorted by task."""
    held: list[tuple] = []

    def flush(rows):
        found = []
        edge = [0, *(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]), len(rows)]
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                group = rows[a:b]
                hits = unite([np.frombuffer(r[4], np.uint64) for r in group], np.array([r[1] for r in group]), np.array([r[2] for r in group]), percent)
                found.extend((group[i][3], group[j][3], n) for i, j, n in hits)
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut:
            yield flush(held[:cut])
            held = held[cut:]
    if held:
        yield flush(held)


def near_duplicates(docs: DataFrame, percent: int = 85, task_nodes: int = 2000, task_shingles: int = 1 << 20) -> DataFrame:
    """Links texts with 100 * |intersection| >= percent * |union| of their shingle sets and groups what links connect.

    Result: doc_id, n_shingles, component_id (least doc_id of the group); one row per row of ``docs``. A shingle is 5 words, lower-cased; a text of 1 to 4 words is one
    shingle; a text without words (or null) has no shingle and is a group of its own, like every other such text. Rows with a null
    doc_id take part, but do not name a group unless all its rows have none. An empty table gives an empty result; extra columns are
    ignored. ``task_nodes`` and ``task_shingles`` only bound the memory of a task.
    """
    texts, _ = tables.blocks(tables.as_documents(docs))
    named = grouped(texts, percent, task_nodes, task_shingles)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "n_shingles", "component_id")


def grouped(texts: DataFrame, percent: int, task_nodes: int, task_shingles: int) -> DataFrame:
    """(block, uid, doc_id, n_shingles, root) of the rows of a table of ``tables.blocks``; equal roots make a group."""
    # A text's row of the blocks is found again by block and uid.
    sets = tables.stage(texts.select("block", "uid", "doc_id", "text").mapInArrow(lambda batches: (describe(b) for b in batches if b.num_rows), SETS), "sets")
    node = F.min("uid").alias("node")
    nodes = tables.stage(sets.where("n_shingles > 0").groupBy("d1", "d2").agg(node, F.min_by("block", "uid").alias("block"), F.first("n_shingles").alias("n")), "nodes")
    marked = sets.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select("uid", F.explode("bands").alias("band"))
    buckets = marked.groupBy("band").agg(F.min("uid").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    candidates = tables.components(marked.join(buckets, "band").select(F.col("uid").alias("a"), F.col("least").alias("b")))

    members = candidates.join(nodes, "node").select("node", "block", "root", "n")
    weight = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    weight = weight.withColumn("chunks", F.greatest(F.ceil(F.col("m") / task_nodes), F.ceil(F.col("s") / task_shingles)).cast("long"))
    members = members.join(weight.select("root", "chunks"), "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    members = tables.stage(members, "members")

    def shingles_of(tasks: DataFrame) -> DataFrame:
        """MEMBER rows of tasks (block, uid, task, side, label): the sets are made from the texts again, only where they are needed."""
        def emit(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = [[], [], [], [], []]
            if left.num_rows and right.num_rows:
                place = {u: i for i, u in enumerate(left.column("uid").to_pylist())}
                wanted = sorted({place[u] for u in right.column("uid").to_pylist()})
                text = left.column("text").combine_chunks().take(pa.array(wanted))
                made = {}
                for a, b in wd.pieces(text):
                    elements, first = shingle_sets(text.slice(a, b - a))
                    for i in range(a, b):
                        made[wanted[i]] = elements[first[i - a] : first[i - a + 1]].tobytes()
                for task, side, label, uid in zip(*(right.column(c).to_pylist() for c in ("task", "side", "label", "uid"))):
                    for column, value in zip(rows, (task, side, label, uid, made[place[uid]])):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(MEMBER.split(", "), rows, kinds)})

        return texts.groupBy("block").cogroup(tasks.groupBy("block")).applyInArrow(emit, MEMBER)

    def verify(tasks: DataFrame) -> DataFrame:
        made = shingles_of(tasks.select("block", "uid", "task", F.col("side").cast("int").alias("side"), "label"))
        return made.repartition("task").sortWithinPartitions("task").mapInArrow(lambda batches: _verify(batches, percent), LINKS)

    uid, own = F.col("node").alias("uid"), F.col("node").alias("label")
    task = lambda *keys: F.xxhash64(*keys).alias("task")
    links = tables.stage(verify(members.select("block", uid, task("root", "chunk"), F.lit(0).alias("side"), own)), "links")
    wide = members.where("chunks > 1")
    if not wide.isEmpty():
        best = links.withColumnRenamed("a", "node").join(wide, "node").groupBy("root").agg(F.max(F.struct("links", "node", "block")).alias("hub"))
        each = wide.select("root", "chunk").distinct().join(best, "root")
        hub = each.select(F.col("hub.block").alias("block"), F.col("hub.node").alias("uid"), task("root", "chunk"), F.lit(1).alias("side"), (-F.col("hub.node") - 1).alias("label"))
        near = tables.stage(verify(wide.select("block", uid, task("root", "chunk"), F.lit(0).alias("side"), own).unionByName(hub)), "links")
        # What is linked with the hub of its group is one group; the rest meets every chunk.
        main = near.select(F.col("b").alias("node"), F.col("a").alias("main")).distinct()
        wide = tables.stage(wide.join(main, "node", "left"), "wide")
        rest = wide.where("main is null")
        shares = rest.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / task_nodes, F.sum("n") / task_shingles)).cast("long").alias("shares"))
        spread = lambda c, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)
        left = wide.join(shares, "root").select("block", "node", "root", "chunk", F.coalesce("main", "node").alias("label"), spread("share", "shares"))
        right = rest.join(shares, "root").select("block", "node", "root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")).alias("share"), spread("chunk", "chunks"))
        tasks = left.select("block", uid, task("root", "chunk", "share"), F.lit(0).alias("side"), "label").unionByName(
            right.select("block", uid, task("root", "chunk", "share"), F.lit(1).alias("side"), own))
        links = links.unionByName(near).unionByName(verify(tasks))
    groups = tables.components(links.select("a", "b"))
    named = sets.where("n_shingles > 0").join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("block", "uid", "doc_id", "n_shingles", "node")
    named = named.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    alone = sets.where("n_shingles = 0").select("block", "uid", "doc_id", "n_shingles", F.col("uid").alias("root"))
    return named.select("block", "uid", "doc_id", "n_shingles", "root").unionByName(alone)


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without those that are not the first of their near-duplicate group, all columns as they are.

    The first has the least doc_id, a null being last; among equal ones any single row stays. Texts without words (null, empty) are groups of their
    own and all stay; a very long text is one row of its block; an empty table stays empty; columns of any name are kept as they are.
    """
    texts, _ = tables.blocks(docs, whole=True)
    named = grouped(texts.drop("_row"), percent, 2000, 1 << 20)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "block")
    first = named.groupBy("root").agg(F.min(order).alias("first")).select("first.block", "first.uid")
    return tables.of_blocks(texts.select("block", "uid", "_row"), first).select("_row.*")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, similarity of at least 0.85."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
