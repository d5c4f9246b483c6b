"""A probabilistic suffix tree over words: contexts of varying length, kept by a divergence test, score texts.

A state is a context of up to ``depth`` words (the start of a text counts as one) that learning texts hold at least twice; its next
symbols are those that followed it at least twice. Their counts are discounted, and what that and the rarer symbols free is dealt by
the distribution of the context's suffix; the root is the add-one distribution over all words, with one share for unknown ones. A state
is kept if its smoothed distribution fits its visits better than its suffix's by at least ``divergence`` nats per visit (held symbols,
and the rest as one) and by more than ``price`` nats for each held symbol; suffixes of kept states are kept too. A word is scored by the
longest kept context before it. Nothing else prunes, so the tree grows with the corpus, and none of it is collected or broadcast.

A context, a context with its next symbol, and the suffixes of both are runs of one to ``depth + 1`` symbols, so all counts are counts of
runs, by 64-bit hashes. The texts lie in blocks. A block sends the hashes of its runs as sorted arrays, one per range of hashes; the task
of a range adds them up and sends back to each block the totals of those of its own that are repeated; a run is only sent if all
its pairs of words are repeated, as else it cannot be. A hash is in each array once, so a passage that all documents share costs
a range one entry per block. The distributions are Spark tables keyed by run, joined with those of their suffixes level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables, words as wd

END = np.uint64(0x454E44)  # the hash that stands for the end of a text
START = np.uint64(0x535441)  # and the one before its first word
COUNTED = "range int, level int, block int, keys binary, counts binary"
FOUND = "range int, level int, block int, keys binary, totals binary, first binary"
PAIRS = "level int, key long, context long, suffix long, context_suffix long, n long, visits long, log_root double"
REPLY = "block int, level int, keys binary, log_chance binary, log_rest binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, tree double"
SUMS = -1  # the block of a row that holds a range's number of tokens and of distinct ones


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and its end, one behind the other, and the n + 1 offsets."""
    part = wd.words(texts, lower=True)
    n = len(texts)
    first = part.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    mask = np.ones(first[-1], bool)
    mask[first[1:] - 1] = False
    out[mask] = part.hashes
    return out, first


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``tokens``, with a start in front of each text."""
    hashes, first = tokens(texts)
    offsets = first + np.arange(len(first))
    out = np.full(offsets[-1], START, np.uint64)
    mask = np.ones(offsets[-1], bool)
    mask[offsets[:-1]] = False
    out[mask] = hashes
    return out, offsets


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _range_column(key: str, ranges: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * ranges, 32).cast("int")


def _counted(level: int, block: int, keys: np.ndarray, weight: np.ndarray, ranges: int) -> list[tuple]:
    """COUNTED rows: distinct keys and the sums of their weights, cut into ranges."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = wd.runs(keys)
    sums = np.add.reduceat(weight[order], edge[:-1]) if len(keys) else np.zeros(0, np.int64)
    keys = keys[edge[:-1]]
    at = wd.runs(range_of(keys, ranges))
    return [(int(range_of(keys[a : a + 1], ranges)[0]), level, block, keys[a:b].tobytes(), sums[a:b].astype(np.int64).tobytes())
            for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns)})


class Lookup:
    """Values by key and level, from the rows that a block was sent."""

    def __init__(self, sent: pa.Table, names: tuple[str, ...], kind=np.int64):
        self.levels: dict[int, tuple] = {}
        for level in set(sent.column("level").to_pylist()):
            own = sent.filter(pa.compute.equal(sent.column("level"), level))
            join = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in own.column(c).to_pylist()])
            keys = join("keys", np.uint64)
            order = np.argsort(keys, kind="stable")
            self.levels[level] = keys[order], [join(c, kind)[order] for c in names]

    def at(self, level: int, keys: np.ndarray, value: int = 0, absent=0) -> np.ndarray:
        if level not in self.levels or not len(keys):
            return np.full(len(keys), absent)
        known, values = self.levels[level]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[value][at], absent)


def _repeated(lookup: Lookup, pairs: np.ndarray) -> np.ndarray:
    return lookup.at(2, pairs) >= 2


def _candidates(pairs: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of the n - k + 1 runs of k symbols those whose pairs are all marked in ``pairs``."""
    out = np.ones(max(0, n - k + 1), bool)
    for i in range(k - 1):
        out &= pairs[i : i + len(out)]
    return out


def sum_up(sent: pa.Table) -> pa.Table:
    """For one range and level: the totals of each block's keys, of those with at least two (level 1: any) in all, and which block has it first."""
    level, where = sent.column("level")[0].as_py(), sent.column("range")[0].as_py()
    keys = [np.frombuffer(b, np.uint64) for b in sent.column("keys").to_pylist()]
    size = np.cumsum([0, *map(len, keys)])
    all_keys, counts = np.concatenate(keys), np.concatenate([np.frombuffer(b, np.int64) for b in sent.column("counts").to_pylist()])
    order = np.argsort(all_keys, kind="stable")
    edge = wd.runs(all_keys[order])
    sums = np.add.reduceat(counts[order], edge[:-1])
    totals, first = np.empty(len(all_keys), np.int64), np.zeros(len(all_keys), np.int8)
    totals[order] = np.repeat(sums, np.diff(edge))
    first[order[edge[:-1]]] = 1
    rows = []
    for i, block in enumerate(sent.column("block").to_pylist()):
        own = slice(size[i], size[i + 1])
        keep = totals[own] >= (1 if level == 1 else 2)
        if keep.any():
            rows.append((where, level, block, keys[i][keep].tobytes(), totals[own][keep].tobytes(), first[own][keep].tobytes()))
    if level == 1:
        start = all_keys[order[edge[:-1]]] == wd.rolling(np.array([START]), 1)[0]
        rows.append((where, level, SUMS, b"", np.array([sums[~start].sum(), (sums[~start] > 0).sum()], np.int64).tobytes(), b""))
    return _table(rows, FOUND)


def learn_pairs(blocks: DataFrame, ranges: int, depth: int) -> tuple[DataFrame, DataFrame, int, int]:
    """PAIRS rows of all repeated runs of 2 to depth + 1 symbols, the FOUND rows of all blocks, tokens and distinct tokens.

    ``blocks``: a table of ``tables.blocks`` with the column held_out. Runs of held-out texts are looked up but count as nothing.
    """
    def weights(held: pa.Array, offsets: np.ndarray) -> np.ndarray:
        return np.repeat((~np.asarray(held)).astype(np.int64), np.diff(offsets))

    def emit_words_and_pairs(left: pa.Table) -> pa.Table:
        # A block sends each run once, so its texts are read in one piece.
        s, offsets = symbols(left.column("text").combine_chunks())
        train, rows, block = weights(left.column("held_out").combine_chunks(), offsets), [], left.column("block")[0].as_py()
        for k in (1, 2):
            inside = np.flatnonzero(wd.within(offsets, k))
            rows += _counted(k, block, wd.rolling(s, k)[inside], train[inside], ranges)
        return _table(rows, COUNTED)

    def emit_longer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            known, text, block = Lookup(right, ("totals",)), left.column("text").combine_chunks(), left.column("block")[0].as_py()
            held = left.column("held_out").combine_chunks()
            s, offsets = symbols(text)
            train, pairs = weights(held, offsets), _repeated(known, wd.rolling(s, 2))
            for k in range(3, depth + 2):
                mask = _candidates(pairs, len(s), k)
                at = np.flatnonzero(mask & wd.within(offsets, k)) if len(mask) else np.zeros(0, np.int64)
                rows += _counted(k, block, wd.rolling(s, k)[at], train[at], ranges)
        return _table(rows, COUNTED)

    summed = lambda df: df.groupBy("range", "level").applyInArrow(sum_up, FOUND)
    by_block = lambda df: df.groupBy("block")
    short = tables.stage(summed(by_block(blocks.select("block", "text", "held_out")).applyInArrow(emit_words_and_pairs, COUNTED)), "runs")
    total, kinds = (int(x) for x in np.sum([np.frombuffer(r["totals"], np.int64) for r in short.where(F.col("block") == SUMS).select("totals").collect()]
                                           or [[0, 0]], axis=0))
    found = short.where("block >= 0")
    if depth > 1:
        pairs = found.where("level = 2").select("block", "level", "keys", "totals")
        found = found.unionByName(tables.stage(summed(by_block(blocks).cogroup(by_block(pairs)).applyInArrow(emit_longer, COUNTED)), "longer_runs"))

    def emit_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[tuple, list] = {}
        if left.num_rows and right.num_rows:
            known = Lookup(right, ("totals",))
            firsts = {k: np.sort(np.concatenate([np.frombuffer(keys, np.uint64)[np.frombuffer(first, np.int8) == 1]
                                                 for level, keys, first in zip(*(right.column(c).to_pylist() for c in ("level", "keys", "first"))) if level == k] or [np.zeros(0, np.uint64)]))
                      for k in range(2, depth + 2)}
            text = left.column("text").combine_chunks()
            for a, b in wd.pieces(text):
                s, offsets = symbols(text.slice(a, b - a))
                runs = {k: wd.rolling(s, k) for k in range(1, depth + 2)}
                for k, own in firsts.items():
                    if not len(own) or not len(runs[k]):
                        continue
                    at = np.flatnonzero(wd.within(offsets, k))
                    keys, first = np.unique(runs[k][at], return_index=True)
                    hit = own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys
                    keys, j = keys[hit], at[first[hit]]
                    firsts[k] = own[~np.isin(own, keys)]
                    columns = [np.full(len(j), k, np.int32), keys, runs[k - 1][j], runs[k - 1][j + 1], runs[k - 2][j + 1] if k > 2 else np.zeros(len(j), np.uint64),
                               known.at(k, keys), known.at(k - 1, runs[k - 1][j]),
                               np.log((known.at(1, runs[1][j + 1]) + 1.0) / (total + kinds + 1.0)) if k == 2 else np.zeros(len(j))]
                    for i, c in enumerate(columns):
                        out.setdefault(i, []).append(c.view(np.int64) if c.dtype == np.uint64 else c)
        names = [c.split()[0] for c in PAIRS.split(", ")]
        kinds_ = [pa.int32()] + [pa.int64()] * 6 + [pa.float64()]
        return pa.table({name: pa.array(np.concatenate(out[i]) if i in out else [], kind) for i, (name, kind) in enumerate(zip(names, kinds_))})

    return tables.stage(by_block(blocks).cogroup(by_block(found)).applyInArrow(emit_pairs, PAIRS), "pairs", "level"), found, total, kinds


def grow(pairs: DataFrame, depth: int, divergence: float, price: float, discount: float) -> tuple[DataFrame, DataFrame]:
    """The kept part of the tree: (level, key, log_chance) of runs whose last symbol the state before it holds, and (level, key, log_rest) of the
    states, whose level is their length. Each level of ``pairs`` is dropped once it is read."""
    n, visits = F.col("n").cast("double"), F.col("visits").cast("double")
    chances, states, above = {}, {}, None
    for k in range(2, depth + 2):
        own = pairs.where(F.col("level") == k)
        if above is None:
            own = own.withColumn("log_above", F.col("log_root"))
        else:
            own = own.join(above.select(F.col("key").alias("suffix"), F.col("log_chance").alias("log_above")), "suffix")
        held = own.groupBy("context").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("kinds"))
        own = own.join(held, "context").withColumn("rest", 1 - (F.col("held") - discount * F.col("kinds")) / visits)
        own = own.withColumn("log_chance", F.log((n - discount) / visits + F.col("rest") * F.exp("log_above")))
        above = tables.stage(own.select("key", "context", "context_suffix", "n", "visits", "held", "kinds", "rest", "log_chance", "log_above"), "chances")
        loose = F.max(F.col("visits") - F.col("held"))
        gain = F.sum(n * (F.col("log_chance") - F.col("log_above"))) + F.when(loose > 0, loose * F.log(F.max("rest"))).otherwise(0.0)
        tested = above.groupBy("context").agg(F.max("context_suffix").alias("suffix"), F.max("visits").alias("visits"), F.max("kinds").alias("kinds"),
                                              F.log(F.max("rest")).alias("log_rest"), gain.alias("gain"))
        fits = (F.col("gain") >= divergence * F.col("visits")) & (F.col("gain") > price * F.col("kinds"))
        states[k - 1] = tables.stage(tested.withColumn("fits", fits), "states")
        wide, above = above, tables.stage(above.select("key", "context", "log_chance"), "chances")
        chances[k] = above
        tables.drop(wide)
        tables.drop(pairs, part=f"level={k}")
    kept, needed, every = {}, None, None
    for length in range(depth, 0, -1):
        wanted = states[length].where("fits").select("context")
        if needed is not None:
            wanted = wanted.unionByName(needed)
        kept[length] = tables.stage(states[length].join(wanted.distinct(), "context", "left_semi"), "kept")
        needed = kept[length].select(F.col("suffix").alias("context"))
    rows = lambda df, level, value: df.select(F.lit(level).alias("level"), "key", value)
    for length in range(1, depth + 1):
        made = (rows(chances[length + 1].join(kept[length].select("context"), "context", "left_semi"), length + 1, "log_chance"),
                rows(kept[length].withColumnRenamed("context", "key"), length, "log_rest"))
        every = made if every is None else tuple(a.unionByName(b) for a, b in zip(every, made))
    out = tuple(tables.stage(t, "tree") for t in every)
    tables.drop(*chances.values(), *states.values(), *kept.values())
    return out


def score(docs: DataFrame, held_out: Column, depth: int = 3, divergence: float = 0.02, price: float = 3.0, discount: float = 0.75) -> DataFrame:
    """Learns from the rows that are not ``held_out`` and scores all rows of ``docs``.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row. A null or empty text is its end alone;
    where ``held_out`` is null (a null doc_id) the row is learned from; repeated rows count as often as they stand there. Without any training
    token every symbol is unknown and both scores are 0. A text of any length is scored whole, in the task of its block. An empty table gives
    an empty result; extra columns are ignored.
    """
    rows = tables.as_documents(docs.withColumn("_held", F.coalesce(held_out, F.lit(False))), F.col("_held").alias("held_out"))
    blocks, ranges = tables.blocks(rows, more=("held_out",))
    pairs, found, total, kinds = learn_pairs(blocks, ranges, depth)
    chances, states = grow(pairs, depth, divergence, price, discount)
    none = F.lit(None).cast("double")
    tree = chances.withColumn("log_rest", none).unionByName(states.withColumn("log_chance", none)).withColumn("range", _range_column("key", ranges))

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            keys = np.asarray(right.column("key")).view(np.uint64)
            order = np.argsort(keys, kind="stable")
            edge = wd.runs(keys[order])
            known = keys[order][edge[:-1]]
            values = [np.fmax.reduceat(right.column(c).to_numpy()[order], edge[:-1]) for c in ("log_chance", "log_rest")]
            for level, block, sent in zip(*(left.column(c).to_pylist() for c in ("level", "block", "keys"))):
                mine = np.frombuffer(sent, np.uint64)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[at] == mine
                if hit.any():
                    out.append((block, level, mine[hit].tobytes(), values[0][at[hit]].tobytes(), values[1][at[hit]].tobytes()))
        return _table(out, REPLY)

    key = ["range", "level"]
    replies = tables.stage(found.select(*key, "block", "keys").groupBy(*key).cogroup(tree.groupBy(*key)).applyInArrow(reply, REPLY), "replies")
    nothing = F.lit(None).cast("binary")
    words = tables.stage(found.where("level = 1").select("block", F.lit(0).alias("level"), "keys", "totals", nothing.alias("log_chance"), nothing.alias("log_rest")), "words")
    tables.drop(chances, states, found)
    sent = replies.withColumn("totals", nothing).unionByName(words)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = pa.compute.equal(right.column("level"), 0)
        counts = Lookup(right.filter(is_word), ("totals",))
        tree = Lookup(right.filter(pa.compute.invert(is_word)), ("log_chance", "log_rest"), np.float64)
        out, text = [], left.column("text").combine_chunks()
        ids, held = left.column("doc_id").to_pylist(), left.column("held_out").to_pylist()
        for a, b in wd.pieces(text):
            s, offsets = symbols(text.slice(a, b - a))
            runs = {k: wd.rolling(s, k) for k in range(1, depth + 2)}
            place = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))  # 0 is the start of a text
            c = counts.at(0, runs[1])
            base = np.log((c + 1.0) / (total + kinds + 1.0))
            logs, open_, inside = np.zeros(len(s)), place > 0, np.zeros(len(s), bool)
            for length in range(depth, 0, -1):
                p = np.flatnonzero(open_ & (place >= length))
                rest = tree.at(length, runs[length][p - length], 1, np.nan)
                inside[p] |= ~np.isnan(rest)  # a longer or this context is kept
                p, rest = p[inside[p]], rest[inside[p]]
                chance = tree.at(length + 1, runs[length + 1][p - length], 0, np.nan)
                hit = ~np.isnan(chance)
                logs[p] += np.where(hit, chance, rest)
                open_[p[hit]] = False
            logs[open_] += base[open_]
            base[place == 0] = 0
            sums = lambda x: np.add.reduceat(x, offsets[:-1])
            known, n = sums(((c > 0) & (place > 0)).astype(np.int64)), np.diff(offsets) - 1
            out += zip(ids[a:b], held[a:b], n.tolist(), known.tolist(), (sums(base) / np.log(10)).tolist(), (sums(logs) / np.log(10)).tolist())
        return _table(out, SCORED)

    scored = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(judge, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         F.col("base").alias("base_score"), F.col("tree").alias("score"))


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``; held out are the doc_ids whose crc32 leaves 2 modulo 7."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
