"""Tables that the operators of this package write to the shared folder, and links between rows."""

from __future__ import annotations

import math
import os
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.session import checkpoint_dir

__all__ = ["BLOCK_BYTES", "as_documents", "blocks", "bucketed", "components", "drop", "keyed", "numbered", "of_blocks", "parts", "release", "scope", "stage"]

BLOCK_BYTES = 6 << 20
_made: dict[str, list[tuple[str, str | None]]] = {}  # of each scope the folders written in it, and the table on each
_open: list[str] = []


@contextmanager
def scope(name: str):
    """Tables written inside belong to ``name`` until ``release(name)``."""
    _open.append(name)
    try:
        yield
    finally:
        _open.pop()


def _written(path: str, table: str | None = None) -> None:
    if _open:
        _made.setdefault(_open[-1], []).append((path, table))


def release(spark: SparkSession, name: str) -> None:
    """Delete what was written in the scope ``name``; to be called once the result that was made of it has been written elsewhere."""
    for path, table in _made.pop(name, []):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Writes inside drop their shuffle files when they end, as only what they wrote is read later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write a table that is read several times to the shared folder and read it back; the folder belongs to the open scope.

    With ``by`` the rows of each value of that column lie in a folder of their own, so that ``drop`` can delete these alone.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with _shuffles_dropped(spark):
        df.write.parquet(path, partitionBy=by, compression="zstd")
    _written(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*staged: DataFrame, part: str | None = None) -> None:
    """Delete tables of ``stage``, or their folder ``part``, that nothing reads any more; to be called once all made of them has been written."""
    for df in staged:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            if part and os.path.basename(folder) != part:
                continue
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def as_documents(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and text (and ``more``) of a table that may have other columns or lack rows; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def parts(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def blocks(docs: DataFrame, block_bytes: int | None = None, whole: bool = False, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Write documents dealt by hash into blocks of about ``block_bytes`` (BLOCK_BYTES) of text; the table is bucketed by block.

    Gives the table (block int, uid long, doc_id, text and the columns ``more``) and the number of blocks; with ``whole`` also the row as the
    struct ``_row``, which then is all that is stored. ``uid`` is fixed by the write, so it names a row even where doc_id is null or repeated. What is keyed by
    block comes to the texts without moving them again. A row longer than a block makes its block longer; copies spread.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    n = parts(total, block_bytes or BLOCK_BYTES)
    kept = [F.struct("*").alias("_row")] if whole else ["doc_id", "text", *more]
    rows = docs.select(*kept, F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))
    name = f"blocks_{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(spark), name)
    with _shuffles_dropped(spark):
        (rows.repartition(n, "block").write.option("path", path).option("compression", "zstd")
         .bucketBy(n, "block").sortBy("block").saveAsTable(name))
    _written(path, name)
    table = spark.table(name)
    if whole:
        table = table.withColumns({"doc_id": F.col("_row.doc_id").cast("long"), "text": F.col("_row.text").cast("string")})
    return table, n


def bucketed(df: DataFrame, n: int, by: str, name: str) -> DataFrame:
    """Write a table in ``n`` buckets by a column and read it back; joins on that column do not move it."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = os.path.join(checkpoint_dir(spark), name)
    with _shuffles_dropped(spark):
        df.repartition(n, by).write.option("path", path).option("compression", "zstd").bucketBy(n, by).sortBy(by).saveAsTable(name)
    _written(path, name)
    return spark.table(name)


def of_blocks(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of a table of ``blocks`` whose (block, uid) are in ``chosen``; one list per block meets it, so no text is moved."""
    lists = chosen.groupBy("block").agg(F.collect_set("uid").alias("_uids"))
    return table.join(lists, "block").where(F.array_contains("_uids", F.col("uid"))).drop("_uids")


def keyed(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``_row`` with a name that a second reading finds again: (_file, _index).

    That is the place in its Parquet file where ``docs`` is such a table as read; any other table is written first.
    """
    row = F.struct("*").alias("_row")
    try:
        return docs.select(row, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return stage(docs.select(row, F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_index")), "rows")


def numbered(df: DataFrame, key: Column | None, order: list[Column], name: str, weight: Column | None = None, per: int = 50_000) -> DataFrame:
    """Adds ``name``: how many rows (or how much ``weight``) of the same key stand before the row, in an order spread by hash.

    ``order`` must be hashes: their first column, a signed 64-bit hash, is cut into equal ranges; only the sums of ranges of one key
    meet, and each range is summed alone, so a key that holds most rows is spread. Ties keep a total order as far as ``order`` goes.
    """
    from pyspark.sql import Window as W

    rows = df.count()
    n = parts(rows, per)
    key = F.lit(0) if key is None else key
    weight = F.lit(1) if weight is None else weight
    width = 2.0**64 / n
    marked = df.withColumns({"_k": key, "_w": weight.cast("long"),
                             "_r": F.least(F.lit(n - 1), F.floor((order[0].cast("double") + F.lit(2.0**63)) / F.lit(width))).cast("int")})
    sums = marked.groupBy("_k", "_r").agg(F.sum("_w").alias("_s"))
    before = sums.withColumn("_b", F.sum("_s").over(W.partitionBy("_k").orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_s"))
    before = before.select(F.col("_k").alias("_k2"), F.col("_r").alias("_r2"), "_b")
    inside = marked.withColumn("_i", F.sum("_w").over(W.partitionBy("_k", "_r").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_w"))
    joined = inside.join(before, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_r") == F.col("_r2")))
    return joined.withColumn(name, F.col("_b") + F.col("_i")).drop("_k", "_w", "_r", "_s", "_b", "_i", "_k2", "_r2")


def components(edges: DataFrame) -> DataFrame:
    """Least node of the connected group of every node of ``edges`` (a long, b long): table (node, root).

    A node takes the least label among its own, its neighbours' and the label of its label, so what is known doubles its reach each
    round. Labels are least by aggregation, map side first; each round is a written table, so a lost executor costs a round at most.
    """
    pairs = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    links = stage(pairs.select("e.a", "e.b").distinct(), "edges")
    labels, seen = stage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels"), None
    while True:
        near = links.join(labels, links.b == labels.node).select(F.col("a").alias("node"), "root")
        least = labels.unionByName(near).groupBy("node").agg(F.min("root").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = stage(least.join(jump, "root").select("node", F.least("root", "further").alias("root")), "labels")
        mark = tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first())
        if mark == seen or not mark[0]:
            return labels
        seen = mark
