"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks.

The words of a source are a stream: its rows in the order of a seeded hash, one behind the other, cut into blocks of equal length (the last may
be shorter). Blocks are allotted to sources by the highest quotients target / (2 * allotted + 1), shard by shard: the method never takes
back a block when there are more to allot, so the quotas of the first shards add up to an allotment too. A source's blocks in the order of
a seeded permutation, round after round, fill its quota of the first shard, then of the second, and so on. A block is taken three times at
most, and with it each of its words. One row per source is gathered to allot the blocks: a mixture is a list of sources. All else stays in Spark.
"""

from __future__ import annotations

import heapq
import itertools
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm import tables

MOST = 3  # times a source, a block and so a row may be taken
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of the sum of sizes by weight; none above MOST times its size, the excess shared among the others by weight."""
    out, capped = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = sum(sizes) - sum(MOST * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        fresh = False
        for i, (s, w) in enumerate(zip(sizes, weights)):
            if capped[i]:
                out[i] = float(MOST * s)
            else:
                out[i] = left * w / weight
        for i, s in enumerate(sizes):
            if not capped[i] and out[i] > MOST * s:
                capped[i] = fresh = True
        if not fresh:
            return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by highest quotients; ties go to the earlier share. Starts from rounded shares, which is an allotment of its own sum."""
    total = sum(shares)
    if not total:
        return [0] * len(shares)
    held = [math.floor(seats * s / total + 0.5) for s in shares]
    gap = seats - sum(held)
    if gap > 0:
        queue = [(-s / (2 * h + 1), i) for i, (s, h) in enumerate(zip(shares, held)) if s > 0]
    else:
        queue = [(s / (2 * h - 1), -i) for i, (s, h) in enumerate(zip(shares, held)) if h > 0]
    heapq.heapify(queue)
    for _ in range(abs(gap)):
        i = abs(heapq.heappop(queue)[1])
        held[i] += 1 if gap > 0 else -1
        if gap > 0:
            heapq.heappush(queue, (-shares[i] / (2 * held[i] + 1), i))
        elif held[i] > 0:
            heapq.heappush(queue, (shares[i] / (2 * held[i] - 1), -i))
    return held


def quotas(target: list[float], sizes: list[int], block: int, shards: int) -> list[list[int]]:
    """Blocks of each source for each shard ([source][shard]); no source more than MOST times the blocks it has."""
    seats = math.floor(sum(target) / block + 0.5)
    sums = [sainte_lague(target, seats * (k + 1) // shards) for k in range(shards)]
    most = [MOST * -(-s // block) for s in sizes]
    upto = [[min(row[i], most[i]) for row in sums] for i in range(len(sizes))]
    return [[b - a for a, b in zip([0, *row], row)] for row in upto]


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block: int = 32, shards: int = 8, seed: int = 17,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """How much of each row the mix takes.

    Result: doc_id, source, size (words), source_size, target (of its source), taken (words, repeats counted), shards (these words by shard of
    the mix), and the columns ``keep``. Sources
    are ordered by code point, null last, and get the weights in turn. A null or empty text has size 0 and gives nothing; null doc_ids do not
    matter; equal rows may differ in ``taken``, but reruns agree on how many of them have which. A very long text is a long stretch of its
    stream. An empty table gives an empty result. A missing column ``source`` is one null source; extra columns are ignored.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"),
                       F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(F.lit(seed), "doc_id", F.col("text")).alias("place"), *keep)
    rows = tables.stage(rows, "sizes")
    spark = docs.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in found]
    target = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))]) if found else []
    allotted = [list(itertools.accumulate(q, initial=0)) for q in quotas(target, sizes, block, shards)]
    plan = []
    for i, r in enumerate(found):
        n = max(1, -(-sizes[i] // block))
        step = random.Random(f"{seed}:{i}").randrange(1, min(n, 1 << 20) + 1)
        while math.gcd(step, n) != 1:
            step += 1
        plan.append((r["source"], sizes[i], target[i], n, step, allotted[i]))
    kinds = [("source", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("n", T.LongType()), ("step", T.LongType()), ("upto", T.ArrayType(T.LongType()))]
    plan = spark.createDataFrame(plan, T.StructType([T.StructField(c, k) for c, k in kinds]))
    streams = tables.numbered(rows, F.col("source"), [F.col("place"), F.col("doc_id"), F.col("size")], "offset", weight=F.col("size"))
    streams = streams.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    end = F.col("offset") + F.col("size")
    touched = F.sequence(F.floor(F.col("offset") / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    part = lambda i: F.least(end, (i + 1) * block) - F.greatest(F.col("offset"), i * block)
    place = lambda i: F.pmod(i * F.col("step"), F.col("n"))
    times = lambda i, x: F.greatest(F.lit(0), F.ceil((x - place(i)) / F.col("n"))).cast("long")  # noqa: E731  rounds in which block i is one of the first x
    first = F.transform("upto", lambda x: F.aggregate(touched, F.lit(0).cast("long"), lambda s, i: s + part(i) * times(i, x)))
    words = F.when(F.col("size") > 0, first).otherwise(F.transform("upto", lambda x: F.lit(0).cast("long")))
    by_shard = F.transform(F.slice("_first", 2, F.size("_first") - 1), lambda x, k: x - F.get("_first", k))
    return streams.withColumn("_first", words).select("doc_id", "source", "size", "source_size", "target", F.element_at("_first", -1).alias("taken"),
                                                      by_shard.alias("shards"), *keep)


UNIT = 1 << 20  # a copy, as a whole number


def _copies(taken: DataFrame, seed: int) -> DataFrame:
    """Adds ``_times``: whole copies of each row of ``mixed`` with columns source, size, taken and _draw.

    The fractions of copies are rounded together: along the rows of a source in classes of growing size, a row gets the copy at which their
    running sum passes a whole number. Sums are those of ranges and classes, and because sizes grow along the row, the words that are written
    stay about one document of the source away from the words taken.
    """
    part = F.floor(F.col("taken") % F.col("size") * F.lit(float(UNIT)) / F.col("size")).cast("long")
    rows = taken.withColumns({"_part": part, "_class": F.floor(F.log2("size") * 8).cast("int"), "_whole": F.floor(F.col("taken") / F.col("size")).cast("int")})
    sums = rows.groupBy("source", "_class").agg(F.sum("_part").alias("_s"))
    smaller = Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_class").alias("_c"), F.coalesce(F.sum("_s").over(smaller), F.lit(0)).alias("_below"))
    inside = tables.numbered(rows, F.struct("source", "_class"), [F.col("_draw"), F.col("doc_id")], "_before", weight=F.col("_part"))
    joined = inside.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_c")))
    at = F.col("_below") + F.col("_before") + F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(UNIT))
    return joined.withColumn("_times", F.col("_whole") + (F.floor((at + F.col("_part")) / UNIT) - F.floor(at / UNIT)).cast("int"))


def mix(docs: DataFrame, block: int = 32, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it.

    A row of which the mix takes x times its words appears floor(x) times or once more, see ``_copies``. Texts without words (null, empty) are
    taken by no mix and do not appear; equal rows are rows of their own; null doc_ids and sources do not matter; an empty table stays empty.
    Columns named like this module's own are set aside while it works.
    """
    rows, key = tables.keyed(docs), ("_file", "_index")
    source = F.col("_row.source") if "source" in docs.columns else F.lit(None)
    drawn = F.xxhash64(F.lit(seed + 1), "_row.doc_id", "_row.text").alias("_draw")
    narrow = rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), source.cast("string").alias("source"), drawn, *key)
    taken = tables.stage(mixed(narrow, block=block, seed=seed, keep=(*key, "_draw")).where("taken > 0").drop("shards"), "taken")
    wanted = _copies(taken, seed).select(*key, "_times").where("_times > 0")
    out = rows.join(tables.stage(wanted, "wanted").hint("merge"), list(key))  # the same plan at every size
    return out.select("_row", F.explode(F.sequence(F.lit(1), "_times")).alias("_n")).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``."""
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")
