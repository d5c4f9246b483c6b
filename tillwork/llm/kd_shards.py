"""Shards of near equal bytes by a k-d tree over metadata, with DataFrame operations only.

A node with k leaves is cut in two where floor(k / 2) / k of its bytes lie, along its widest dimension; the cut of all nodes of a level is found
together. A cut is a place in the order of (coordinate, tie), tie being hashes of the text and of the row, so rows of equal
coordinates are cut too, equal texts stay side by side, and no sort of a node is needed: the place is narrowed down by counting bytes in
BUCKETS equal ranges of what is left, again and again, first of the coordinate, then of the ties. Each count is one aggregation of a
narrow written table; what reaches the driver is at most one row per node and range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import tables

BUCKETS = 512
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Node:
    """Rows of leaves [first, first + leaves); the search for its cut: keys fixed so far, range of the next one, bytes still to go left."""

    first: int
    leaves: int
    dimension: int = -1
    fixed: tuple[int, ...] = ()
    low: int = 0
    high: int = 0
    goal: float = 0.0
    done: bool = False


def _case(column: Column, values: Mapping[int, Column | int], otherwise=None) -> Column:
    """Value by node number: a lookup in a literal map of at most one entry per node."""
    if not values:
        return F.lit(otherwise)
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.create_map(*pairs)[column]
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def _keys(nodes: list[Node], dims: int) -> list[Column]:
    """The three sort keys of a row: its coordinate in the node's dimension, and the ties."""
    axis = _case(F.col("node"), {n.first: n.dimension for n in nodes})
    return [F.element_at("coords", axis + 1), F.col("tie1"), F.col("tie2")]


def _cuts(rows: DataFrame, nodes: list[Node], slack: float, text_slack: float) -> list[Node]:
    """The nodes with their cut found: rows whose keys are at most ``fixed`` (a last key at most ``low``) go left."""
    while not all(n.done for n in nodes):
        open_ = {n.first: n for n in nodes if not n.done}
        keys = _keys(nodes, 0)
        node = F.col("node")
        depth = _case(node, {k: len(n.fixed) for k, n in open_.items()})
        same = F.lit(True)
        for i in range(2):
            value = _case(node, {k: n.fixed[i] for k, n in open_.items() if len(n.fixed) > i}, None)
            same = same & ((depth <= i) | (keys[i] == value))
        key = F.when(depth == 0, keys[0]).when(depth == 1, keys[1]).otherwise(keys[2])
        low, high = (_case(node, {k: getattr(n, side) for k, n in open_.items()}) for side in ("low", "high"))
        width = {k: max(1, -(-(n.high - n.low + 1) // BUCKETS)) for k, n in open_.items()}
        inside = rows.where(node.isin(list(open_))).where(same & key.between(low, high))
        wide = (key.cast("decimal(20,0)") - low.cast("decimal(20,0)"))
        bucket = F.floor(wide / _case(node, {k: F.lit(w).cast("decimal(20,0)") for k, w in width.items()})).cast("long")
        counts = inside.groupBy("node", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most"))
        found: dict[int, list] = {}
        for r in counts.collect():
            found.setdefault(r["node"], []).append(r)
        out = []
        for n in nodes:
            if n.done:
                out.append(n)
                continue
            before, hit = 0.0, None
            ranges = sorted(found.get(n.first, []), key=lambda r: r["bucket"])
            for r in ranges:
                if before + r["bytes"] > n.goal:
                    hit = r
                    break
                before += r["bytes"]
            if hit is None:  # nothing, or all of it, lies left of the goal
                out.append(replace(n, low=n.high, done=True))
            elif n.goal - before <= slack or hit["least"] == hit["most"] and len(n.fixed) == 1 and hit["bytes"] <= text_slack or hit["least"] == hit["most"] and len(n.fixed) == 2:
                low = hit["least"] - 1 if n.goal - before <= hit["bytes"] / 2 else hit["most"]
                out.append(replace(n, low=max(low, LOW), done=True))
            elif before + hit["bytes"] - n.goal <= slack:
                out.append(replace(n, low=hit["most"], done=True))
            elif hit["least"] == hit["most"]:
                out.append(replace(n, fixed=(*n.fixed, hit["least"]), low=LOW, high=HIGH, goal=n.goal - before))
            else:
                out.append(replace(n, low=hit["least"], high=hit["most"], goal=n.goal - before))
        nodes = out
    return nodes


def split(rows: DataFrame, shards: int, dims: int, slack_share: float = 1e-3, text_share: float = 0.02) -> DataFrame:
    """Adds ``shard`` to a written table (coords array<long>, tie1 long, tie2 long, size long).

    A cut may miss its goal by ``slack_share`` of a shard; copies of one text of up to ``text_share`` of a shard are not cut apart.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = slack_share * total / shards
    rows = rows.withColumn("node", F.lit(0))
    leaves, whole = {0: shards}, None
    while any(k > 1 for k in leaves.values()):
        wide = {first: k for first, k in leaves.items() if k > 1}
        extent = rows.where(F.col("node").isin(list(wide))).groupBy("node").agg(
            F.sum("size").alias("bytes"), *(f(F.col("coords")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("min", F.min), ("max", F.max))))
        extent = {r["node"]: r for r in extent.collect()}
        if whole is None:
            whole = [max(1, extent[0][f"max{i}"] - extent[0][f"min{i}"]) if extent else 1 for i in range(dims)]
        nodes = []
        for first, k in wide.items():
            r = extent.get(first)
            if r is None:
                nodes.append(Node(first, k, 0, done=True))
                continue
            axis = max(range(dims), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / whole[i], -i))
            nodes.append(Node(first, k, axis, (), r[f"min{axis}"], r[f"max{axis}"], r["bytes"] * (k // 2) / k))
        nodes = _cuts(rows, nodes, slack, text_share * total / shards)
        keys, node = _keys(nodes, dims), F.col("node")
        right = F.lit(False)
        for level in range(3):
            here = {n.first: n for n in nodes if len(n.fixed) == level}
            if here:
                past = keys[level] > _case(node, {k: n.low for k, n in here.items()})
                equal = F.lit(True)
                for i in range(level - 1, -1, -1):
                    fixed = _case(node, {k: n.fixed[i] for k, n in here.items()})
                    past = (keys[i] > fixed) | ((keys[i] == fixed) & past)
                right = F.when(node.isin(list(here)), past & equal).otherwise(right)
        move = _case(node, {n.first: n.first + n.leaves // 2 for n in nodes}, -1)
        rows = tables.stage(rows.withColumn("node", F.when((move >= 0) & right, move).otherwise(node)), "kd")
        leaves = {f: k for first, k in leaves.items() for f, k in (((first, k // 2), (first + k // 2, k - k // 2)) if k > 1 else ((first, k),)) if k}
    return rows.withColumnRenamed("node", "shard")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 16), text_crc32, coords (log size, source, lang) and ties.

    Equal texts get equal coordinates: the least of their sources and of their languages, a null being least.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = text.cast("binary")
    size = (F.octet_length(text) + 16).cast("long")
    named = lambda c: (F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 20)) + 1 if c in docs.columns else F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"),
                       *(F.coalesce(named(c) if c not in docs.columns else F.when(F.col(c).isNotNull(), named(c)), F.lit(0)).alias(f"_{c}") for c in ("source", "lang")),
                       F.xxhash64(raw).alias("tie1"), F.xxhash64("doc_id", raw).alias("tie2"))
    rows = tables.stage(rows, "meta")
    least = rows.groupBy("tie1").agg(F.min("_source").alias("source"), F.min("_lang").alias("lang"))
    level = F.floor(F.log2(F.col("size").cast("double")) * 4096).cast("long")
    return rows.join(least, "tie1").select("doc_id", "size", "text_crc32", F.array(level, "source", "lang").alias("coords"), "tie1", "tie2")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, per_range: int = 50_000) -> DataFrame:
    """Deals rows into ``shards`` leaves, or into as many as make ``target_bytes`` each. Result: doc_id, size, text_crc32, law, shard, slot.

    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of their hashes. Dimensions are the size, source and lang (where the table has
    them); a null counts as a value of its own. Sizes differ from the mean by about the longest row at most; equal texts lie together unless a
    cut falls among them, which many copies can cause; rows that are equal in doc_id and text always do. A null text has size 16; an empty table gives no shard;
    other columns are left out.
    """
    rows = tables.stage(metadata(docs), "meta")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    placed = split(rows, shards, 3)
    slots = tables.numbered(placed, F.col("shard"), [F.col("tie2"), F.col("tie1"), F.col("doc_id")], "slot", per=per_range)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, 40 shards."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.withColumn("grown_shard", F.lit(None).cast("int"))
