"""Removal of byte strings of a given length that occur more than once, by deep-shallow sorting of suffixes.

Only suffixes at anchors are sorted. A start's anchor is the least hash among the grams of its string, leftmost among equals, so
equal strings have equal anchors at equal distances. Anchors that occur once are left out (exact: their strings are unique). The
others travel with the bytes of all strings they anchor to the task of their hash, where both sides of the anchor are sorted
(multikey sorting to a shallow depth, blind tries beyond). Two occurrences that agree on l bytes before and r bytes from the anchor
share the strings that start up to l before it and end within r. Sets of the order of the right sides are merged from the
longest common prefix down, the smaller into the larger, and only neighbours in the order of the left sides are compared, so no
pairs of a group are listed. Of an anchor with more than ``most`` occurrences, whose group could outgrow a task, the strings
themselves are hashed and counted, first inside blocks of documents: the exact way for hot groups, with no bound on their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables, words as wd
from tillwork.llm.suffix_sort import common, deep_shallow
from tillwork.llm.window_dedup import HASHES, _hash_batch, in_blocks, is_in, repeated

GRAM = 32
SEGMENT = "hash long, block int, uid long, at long, before int, bytes binary"
FOUND = "block int, uid long, first long, last long"
RESULT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every byte."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at, factors = wd.loads(raw), wd.powers(GRAM // 8, wd.BASE)[1:]
    out = np.zeros(n, np.uint64)
    for a, b in wd.chunks(n):
        own, words = out[a:b], np.array(at[a : b + GRAM - 8])
        for j, factor in enumerate(factors):
            own += words[8 * j : 8 * j + b - a]
            own *= factor
            own ^= own >> np.uint64(29)
    return wd.mix(out)


def starts_of(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of strings inside a text."""
    inside = np.zeros(offsets[-1], bool)
    for first, past in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[first : max(first, past - length + 1)] = True
    return np.flatnonzero(inside)


def anchors(texts: pa.Array, length: int):
    """Bytes, offsets, gram hashes, and the starts of strings inside a text with the anchor of each."""
    raw, offsets = wd.joined(texts)
    grams = gram_hashes(raw)
    picks, starts = wd.chosen(grams, length - GRAM + 1), starts_of(offsets, length)
    return raw, offsets, grams, starts, picks[starts]


def with_grams(texts: pa.Array, found: np.ndarray) -> pa.Array:
    """The texts that hold a gram whose hash is in the sorted array ``found``; the anchors of the others are not in it."""
    raw, offsets = wd.joined(texts)
    hits = np.flatnonzero(is_in(gram_hashes(raw), found))
    return texts.take(pa.array(np.unique(np.searchsorted(offsets, hits, "right") - 1)))


def shared(group: list[tuple[bytes, bytes]], order: np.ndarray, lcps: np.ndarray, rank: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each occurrence the intervals [x0, x1] of distances before the anchor whose strings another occurrence has too.

    ``group`` holds (bytes before the anchor, reversed; bytes from the anchor), ``order`` and ``lcps`` the sorted right sides, ``rank``
    the place of each left side in their order.
    """
    n, out = len(order), [[] for _ in order]
    by_rank = sorted(range(n), key=rank.__getitem__)
    root, sets = list(range(n)), [[int(rank[i])] for i in order]

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for p in sorted(range(1, n), key=lambda q: -lcps[q]):
        r = int(lcps[p])
        a, b = find(p - 1), find(p)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for e in small:
            i, place = by_rank[e], bisect_left(large, e)
            for q in (place - 1, place):
                if 0 <= q < len(large):
                    j = by_rank[large[q]]
                    l = common(group[i][0], group[j][0])
                    if l + r >= length:
                        out[i].append((max(0, length - r), l))
                        out[j].append((max(0, length - r), l))
        if len(small) * 16 < len(large):
            for e in small:
                insort(large, e)
        else:
            sets[a] = sorted(large + small)
        sets[b], root[b] = [], a
    return out


def sort_groups(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(block, uid, first start, last start) of repeated strings; ``rows`` are the SEGMENT rows of whole groups, in order of hash."""
    out: list[tuple[int, int, int, int]] = []
    group_of, left, right, owners = [], [], [], []
    seen: dict[tuple, int] = {}
    number, last = -1, None
    for hash_, block, uid, at, before, content in rows:
        if hash_ != last:
            number, last = number + 1, hash_
            seen = {}
        key = (before, content)
        k = seen.setdefault(key, len(owners))
        if k == len(owners):
            owners.append([])
            group_of.append(number)
            left.append(content[:before][::-1])
            right.append(content[before:])
        owners[k].append((block, uid, at))
    for k, own in enumerate(owners):  # occurrences that agree in every byte
        if len(own) > 1:
            out.extend((block, uid, at - len(left[k]), at + len(right[k]) - length) for block, uid, at in own)
    groups = np.array(group_of, np.int64)
    order, lcps = deep_shallow(right, groups)
    back, _ = deep_shallow(left, groups)
    rank = np.empty(len(back), np.int64)
    rank[back] = np.arange(len(back))
    edge = wd.runs(groups)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            pairs = [(left[i], right[i]) for i in range(a, b)]
            for i, intervals in enumerate(shared(pairs, order[a:b] - a, lcps[a:b], rank[a:b] - a, length)):
                for x0, x1 in set(intervals):
                    out.extend((block, uid, at - x1, at - x0) for block, uid, at in owners[a + i])
    return out


def remove_repeated_bytes(docs: DataFrame, length: int = 400, most: int = 1 << 15) -> DataFrame:
    """Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same document or another, goes.

    Result: doc_id, n_bytes, removed (byte intervals [start, end), maximal), kept (the other bytes; a cut may fall inside a character);
    one row per row of ``docs``. Texts are UTF-8 bytes, a null text is empty; a text shorter than ``length`` loses nothing; repeated rows are
    documents of their own, so long copies lose everything; rows with a null doc_id count like others. An empty table gives an empty
    result; other columns are ignored. ``most`` only chooses where the equality of strings is decided; neither it nor the number of blocks
    changes what is found.
    """
    texts, _ = tables.blocks(tables.as_documents(docs))

    def emit_anchors(batches):
        for batch in batches:
            for block, part in in_blocks(batch):
                _, _, grams, _, picks = anchors(part, length)
                yield _hash_batch(block, *wd.counted(grams[np.unique(picks)]))

    def emit_segments(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {c.split()[0]: [] for c in SEGMENT.split(", ")}
        found = np.unique(right.column("hash").to_numpy().view(np.uint64))
        if left.num_rows and len(found):
            text, uids, block = left.column("text").combine_chunks(), left.column("uid").to_pylist(), left.column("block")[0].as_py()
            for first, past in wd.pieces(text):
                raw, offsets, grams, starts, picks = anchors(text.slice(first, past - first), length)
                if not len(starts):
                    continue
                edge = wd.runs(picks)  # an anchor's starts are one run
                keep = is_in(grams[picks[edge[:-1]]], found)
                low, high, at = starts[edge[:-1]][keep], starts[edge[1:] - 1][keep], picks[edge[:-1]][keep]
                doc = np.searchsorted(offsets, low, "right") - 1
                data = raw.tobytes()
                rows["hash"] += grams[at].view(np.int64).tolist()
                rows["block"] += [block] * len(at)
                rows["uid"] += [uids[first + d] for d in doc.tolist()]
                rows["at"] += (at - offsets[doc]).tolist()
                rows["before"] += (at - low).tolist()
                rows["bytes"] += [data[a : b + length] for a, b in zip(low.tolist(), high.tolist())]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(rows.items(), kinds)})

    def sort_segments(batches):
        held: list[tuple] = []

        def found(rows):
            hits = sort_groups(rows, length)
            columns = list(zip(*hits)) if hits else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                              names=["block", "uid", "first", "last"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= 4000:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield found(held[:cut])
                    held = held[cut:]
        if held:
            yield found(held)

    def emit_hot(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = np.unique(right.column("hash").to_numpy().view(np.uint64)), []
        if left.num_rows and len(found):
            text, block = left.column("text").combine_chunks(), left.column("block")[0].as_py()
            for first, past in wd.pieces(text):
                part = with_grams(text.slice(first, past - first), found)
                raw, _, grams, starts, picks = anchors(part, length)
                starts = starts[is_in(grams[picks], found)]
                if len(starts):
                    out.append(_hash_batch(block, *wd.counted(wd.rolling(raw.astype(np.uint64) + np.uint64(1), length)[starts])))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_hash_batch(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        text, uids = left.column("text").combine_chunks(), np.asarray(left.column("uid"))
        sorted_, order = right.filter(pa.compute.is_valid(right.column("uid"))), np.argsort(uids)
        row = order[np.searchsorted(uids[order], np.asarray(sorted_.column("uid")))]
        low, high = np.asarray(sorted_.column("first")), np.asarray(sorted_.column("last"))
        hot = np.unique(right.filter(pa.compute.is_valid(right.column("hash"))).column("hash").to_numpy().view(np.uint64))
        n_bytes, removed, kept = [], [], []
        for first, past in wd.pieces(text):
            raw, offsets = wd.joined(text.slice(first, past - first))
            mine = (row >= first) & (row < past)
            base = offsets[row[mine] - first]
            starts, width = low[mine] + base, high[mine] - low[mine] + length
            if len(hot) and len(raw) >= length:
                inside = starts_of(offsets, length)
                more = inside[is_in(wd.rolling(raw.astype(np.uint64) + np.uint64(1), length)[inside], hot)]
                starts, width = np.concatenate([starts, more]), np.concatenate([width, np.full(len(more), length)])
            gone, data = wd.covered(starts, width, len(raw)), raw.tobytes()
            for i in range(past - first):
                a, b = int(offsets[i]), int(offsets[i + 1])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).tolist()
                n_bytes.append(b - a)
                removed.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
                kept.append(b"".join(data[a + s : a + e] for s, e in zip([0, *edge[1::2]], [*edge[::2], b - a])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "removed": pa.array(removed, kind),
                         "kept": pa.array(kept, pa.binary())})

    marks = repeated(texts.select("block", "text").mapInArrow(emit_anchors, HASHES), "anchors")
    marks = tables.stage(marks.select("block", "hash", (F.col("total") > most).alias("hot")), "marks")
    usual, hot = marks.where("not hot"), marks.where("hot")
    by_block = lambda df: df.groupBy("block")
    segments = by_block(texts).cogroup(by_block(usual)).applyInArrow(emit_segments, SEGMENT)
    found = segments.repartition("hash").sortWithinPartitions("hash").mapInArrow(sort_segments, FOUND)
    strings = by_block(texts).cogroup(by_block(hot)).applyInArrow(emit_hot, HASHES)
    counts = repeated(strings, "strings")
    none = lambda kind: F.lit(None).cast(kind)
    flags = found.withColumn("hash", none("long")).unionByName(
        counts.select("block", "hash", none("long").alias("uid"), none("long").alias("first"), none("long").alias("last")))
    return by_block(texts).cogroup(by_block(flags)).applyInArrow(cut, RESULT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, strings of 400 bytes."""
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
