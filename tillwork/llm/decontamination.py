"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

Words are lower-cased, without marks, and taken as 64-bit hashes. A seed is the hash of the words at the places of a mask, so the words
between them may differ. Seeds of benchmark items and documents are joined; a hit fixes how the two texts lie against each other. Each
such alignment is verified whole: a document is contaminated if some WINDOW aligned words of an item differ in at most ``differing``
places. Any such window holds a seed of MASKS that misses all of two differing words (all placements were enumerated), so none is lost.
An item shorter than the window must agree as a whole in all but that share of its words: of up to 6 words in all, of 7 to 12 in all but
one. Where MASKS leave such an item without a seed (up to 5 words, and some places of 7 and 8), a mask of SHORT holds its first word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables

# Fixed masks: places of the words that count, from the first one.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 4, 8, 9))
# By the length of an item: a mask from its first word, for the differences that leave it no seed of MASKS.
SHORT = {1: (0,), 2: (0, 1), 3: (0, 1, 2), 4: (0, 1, 2, 3), 5: (0, 1, 2, 3, 4), 7: (0, 2, 3, 6), 8: (0, 1, 2, 3, 4)}
WINDOW, DIFFERING = 13, 2
MARKS = ".,;:!?\"'()[]"
BROADCAST_SEEDS = 2_000_000  # about 60 MB as a hash table; more seeds are joined by shuffling


def word_hashes(text: Column) -> Column:
    """Array of the hashes of a text's words; a null or empty text has none."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(text), MARKS, ""), r"[\x09-\x0D]", " "))
    return F.transform(F.filter(F.split(F.coalesce(plain, F.lit("")), " +"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, *keep: str, masks: dict[int, tuple[int, ...]] = dict(enumerate(MASKS))) -> DataFrame:
    """(keep, pos, seed) of every word position and mask (by number) of a table with ``hashes``; a mask that runs over the end gives none."""
    placed = rows.select(*keep, "hashes", F.posexplode("hashes").alias("pos", "_word"))
    at = lambda k: F.get("hashes", F.col("pos") + k)
    each = F.array(*(F.when(F.col("pos") + mask[-1] < F.size("hashes"), F.xxhash64(F.lit(i), *(at(k) for k in mask))) for i, mask in masks.items()))
    return placed.select(*keep, "pos", F.explode(each).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: (doc_id, text_hash, item_id, start, equal, n_words), one for each text, item and alignment that is contaminated.

    ``start`` is the word of the document that lies against the item's first (below 0 if the item begins before the text), ``equal`` counts
    equal words of the item's ``n_words``. Texts are named by doc_id and text hash, so equal rows are judged once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("hashes"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("hashes")).where(F.size("hashes") > 0)
    items = tables.stage(items.withColumn("item", F.monotonically_increasing_id()), "items")
    known = seeds(items, "item")
    # Masks for short items only where the benchmark has such items; at most one length each reaches the driver.
    lengths = sorted(r[0] for r in items.select(F.size("hashes").alias("n")).distinct().where(F.col("n").isin(*SHORT)).collect())
    short = {len(MASKS) + n: SHORT[n] for n in lengths}
    for n in lengths:
        known = known.unionByName(seeds(items.where(F.size("hashes") == n), "item", masks={len(MASKS) + n: SHORT[n]}).where("pos = 0"))
    known = known.select("item", F.col("pos").alias("item_pos"), "seed")
    found = seeds(texts, "doc_id", "text_hash", masks={**dict(enumerate(MASKS)), **short})
    size = items.agg(F.sum(F.size("hashes"))).first()[0] or 0
    known = F.broadcast(known) if size * len(MASKS) <= BROADCAST_SEEDS else known
    hits = found.join(known, "seed").select("doc_id", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("start")).distinct()
    hits = tables.stage(hits, "hits")
    doc = texts.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("hashes").alias("own"))
    doc = doc.join(hits.select(F.col("text_hash").alias("_t")).distinct(), "_t", "left_semi")
    both = hits.join(items, "item").join(doc.dropDuplicates(["_d", "_t"]), F.col("text_hash").eqNullSafe(F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    n = F.size("hashes")
    place = lambda i: F.col("start") + i
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((place(i) >= 0) & (F.get("own", F.greatest(place(i), F.lit(0))) == F.get("hashes", i)), 1).otherwise(0))
    both = both.select("doc_id", "text_hash", "item_id", "start", n.alias("n_words"), equal.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = F.exists(F.sequence(F.lit(1), F.greatest(F.col("n_words") - WINDOW + 1, F.lit(1))),
                       lambda k: total(F.slice("same", k, F.least(F.lit(WINDOW), "n_words"))) * WINDOW >= F.least(F.lit(WINDOW), "n_words") * (WINDOW - DIFFERING))
    return both.where(windows).select("doc_id", "text_hash", "item_id", "start", total(F.col("same")).alias("equal"), "n_words")


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of every row of ``docs``: doc_id, contaminated, items (sorted item ids), best_equal (most equal words in one alignment, else 0).

    A null or empty text is clean; rows with a null doc_id are judged like others; equal rows get equal verdicts. Items with a null or empty
    text match nothing, a null item_id is left out of ``items``; without items all is clean; an empty table gives an empty result; extra
    columns are ignored.
    """
    found = overlaps(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("equal").alias("best"))
    found = tables.stage(found.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}), "verdicts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = rows.join(found, F.col("text_hash").eqNullSafe(F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return joined.select("doc_id", F.col("_t").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
                         F.coalesce("best", F.lit(0)).cast("long").alias("best_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are, whatever their names.

    Null and empty texts are clean and stay; equal rows stay or go together; a null doc_id does not matter; texts of any length are judged whole;
    without benchmark items everything stays; an empty table stays empty.
    """
    found = tables.stage(overlaps(docs, benchmark).select(F.col("doc_id").alias("_found_doc"), F.col("text_hash").alias("_found_text")).distinct(), "verdicts")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    return rows.join(found, F.col("_hash").eqNullSafe(F.col("_found_text")) & F.col("_id").eqNullSafe(F.col("_found_doc")), "left_anti").select("_row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables ``documents`` and ``benchmark``."""
    out = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "best_equal")
