"""Removal of word windows that occur more than once, by Rabin-Karp hashes counted in Spark.

Every window of k words has an anchor: the least hash among its grams of ``gram`` words, leftmost among equals. Equal windows have
equal anchors, so a window whose anchor occurs once is unique and needs no count; this is exact. The windows left are hashed with
the rolling polynomial and counted. Counts are first summed inside runs of documents of one block, so a passage that very many
documents share is a row per block and task, not per document, then by partial sums over all; the answer goes back by a join. Words are
compared by 64-bit hashes: two different windows meet with a chance of about 2**-64 for each pair of windows that also share an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables, words as wd

HASHES = "block int, hash long, n long"
RESULT = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string"


def _hash_batch(block: int, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), block, np.int32)), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))],
                                      names=["block", "hash", "n"])


def anchors(part: wd.Words, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each gram, the window starts that stay inside a text, and the gram that anchors each of them."""
    grams = wd.rolling(part.hashes, gram)
    starts = np.flatnonzero(wd.within(part.first, k))
    return grams, starts, wd.chosen(grams, k - gram + 1)[starts]


def in_blocks(batch: pa.RecordBatch):
    """(block, texts) of the runs of rows of one block in a batch (block, text), in slices of bounded size.

    A bucket holds the blocks whose number hashes to it, one after the other, so a batch may hold rows of several.
    """
    edge = wd.runs(np.asarray(batch.column(0)))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        texts = batch.column(1).slice(a, b - a)
        for first, past in wd.pieces(texts):
            yield batch.column(0)[a].as_py(), texts.slice(first, past - first)


def repeated(counts: DataFrame, name: str) -> DataFrame:
    """(block, hash, total) of the hashes whose sum of n over all rows is at least two; ``counts`` is written, as it is read twice."""
    counts = tables.stage(counts, name)
    totals = counts.groupBy("hash").agg(F.sum("n").alias("total")).where("total >= 2")
    return counts.select("block", "hash").join(totals, "hash")


def flagged(flags: pa.Table) -> np.ndarray:
    return np.unique(flags.column("hash").to_numpy().view(np.uint64))


def is_in(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted array."""
    out = np.zeros(len(values), bool)
    if not len(found):
        return out
    marks = np.zeros(1 << 20, bool)  # most values are ruled out by their upper bits
    marks[found >> np.uint64(44)] = True
    for a, b in wd.chunks(len(values)):
        some = np.flatnonzero(marks[values[a:b] >> np.uint64(44)])
        left = values[a:b][some]
        out[a + some] = found[np.minimum(np.searchsorted(found, left), len(found) - 1)] == left
    return out


def remove_repeated_windows(docs: DataFrame, k: int = 35, gram: int = 8) -> DataFrame:
    """Every word inside a window of k words whose sequence also starts anywhere else, in the same document or another, goes.

    Result: doc_id, n_words, removed (word intervals [start, end), maximal), kept (the other words joined by one space); one row per
    row of ``docs``. Windows are judged on the input, overlapping ones too. A null or empty text has no words and is kept as an
    empty text; a text of fewer than k words has no window; repeated rows are documents of their own, so copies of k or more words
    lose every word; rows with a null doc_id count like others. An empty table gives an empty result; other columns are ignored. A text of any
    length is cut in one task. How many blocks the texts are dealt into does not change the result.
    """
    texts, _ = tables.blocks(tables.as_documents(docs))

    def emit_anchors(batches):
        for batch in batches:
            for block, texts_ in in_blocks(batch):
                grams, _, picks = anchors(wd.words(texts_), k, gram)
                yield _hash_batch(block, *wd.counted(grams[np.unique(picks)]))

    def emit_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = flagged(right), []
        if left.num_rows and len(found):
            text, block = left.column("text").combine_chunks(), left.column("block")[0].as_py()
            for first, past in wd.pieces(text):
                part = wd.words(text.slice(first, past - first))
                grams, starts, picks = anchors(part, k, gram)
                starts = starts[is_in(grams[picks], found)] if len(starts) else starts
                out.append(_hash_batch(block, *wd.counted(wd.rolling(part.hashes, k)[starts])))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_hash_batch(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found, text = flagged(right), left.column("text").combine_chunks()
        n_words, removed, kept = [], [], []
        for first, past in wd.pieces(text):
            part = wd.words(text.slice(first, past - first))
            inside = np.flatnonzero(wd.within(part.first, k))
            hits = inside[is_in(wd.rolling(part.hashes, k)[inside], found)]
            gone = wd.covered(hits, k, len(part.starts))
            raw = part.raw.tobytes()
            for i in range(past - first):
                a, b = part.first[i], part.first[i + 1]
                n_words.append(b - a)
                mask = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                removed.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                kept.append(b" ".join(raw[s:e] for s, e in zip(part.starts[a:b][~mask].tolist(), part.ends[a:b][~mask].tolist())))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "removed": pa.array(removed, kind),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    by_block = texts.groupBy("block")
    marks = repeated(texts.select("block", "text").mapInArrow(emit_anchors, HASHES), "anchors").select("block", "hash")
    windows = by_block.cogroup(marks.groupBy("block")).applyInArrow(emit_windows, HASHES)
    found = repeated(windows, "windows").select("block", "hash")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, RESULT)


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, windows of 35 words."""
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
