"""Whitening of embeddings onto their leading components, found by contour integration (``feast``).

Sums over the distinct vectors are exact: entries are whole numbers, each task sums its own matrix of products of entries centred on
the nearest whole mean, and Spark adds these up entry by entry. Only the covariance (dimensions squared) reaches the driver. The
resolvent solves of FEAST, one per interval and quadrature node, are tasks of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import feast, tables

SCALE, OFFSET = 64, 1_000_000
FAR = 2.0**40
SMALL = 1e-9
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
CELLS = "i int, j int, value double"


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>): entries c as floor(64 c) + 1000000; rows whose vector is null or holds null or non-finite entries are left out.

    Entries beyond 2**40 / 64 either way count as that bound, so that every sum stays a whole number of double.
    """
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), v * SCALE))).cast("long") + OFFSET)
    return vectors.where(c.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; a shorter vector is filled with the x of zero."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.full((len(column), width), float(OFFSET))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _cells(df: DataFrame, width: int, rows, size: int) -> np.ndarray:
    """Sum over all vectors of the products rows(X)' rows(X), a matrix of ``size``: partial sums per task, added by Spark."""
    def emit(batches):
        total = np.zeros((size, size))
        for batch in batches:
            r = rows(_matrix(batch.column(0), width))
            total += r.T @ r
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])

    out = np.zeros((size, size))
    for i, j, value in df.select("x").mapInArrow(emit, CELLS).groupBy("i", "j").agg(F.sum("value")).collect():
        out[i, j] = out[j, i] = value
    return out


def _project(spark: SparkSession, matrix: np.ndarray):
    """Quadrature with a task for each solve."""
    shared = spark.sparkContext.broadcast(matrix)

    def project(jobs):
        solves = [(k, pickle.dumps((z, w, block))) for k, (low, high, block) in enumerate(jobs) for z, w in feast.contour(low, high)]

        def emit(batches):
            for batch in batches:
                for k, solve in zip(*(c.to_pylist() for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([feast.solved(shared.value, *pickle.loads(solve)).tobytes()])],
                                                     names=["k", "share"])

        tasks = spark.createDataFrame(solves, "k int, solve binary").repartition(len(solves)).mapInArrow(emit, "k int, share binary")
        out = [np.zeros_like(block) for _, _, block in jobs]
        for k, share in sorted(tasks.collect()):  # in a fixed order, so that reruns agree
            out[k] += np.frombuffer(share).reshape(out[k].shape)
        return out

    return project


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Projection of every vector on the leading components of the distinct ones, each scaled to unit variance (RESULT).

    Result: a row per kept row of (vec_id, embedding) and component. Repeated rows keep their rows but are fitted once. A vector shorter
    than the longest counts as filled with zeros. Components whose variance is less than 1e-9 of the greatest (vectors without spread)
    are left out, so fewer than two distinct vectors, or an empty table, give no rows. Equal eigenvalues: any orthonormal basis of their
    space, the same for all rows. ``deviation`` is null where a long cannot hold it. A null vec_id is kept; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = tables.stage(whole(vectors), "vectors")
    fit = tables.stage(rows.select("x").distinct(), "fit")
    n, width = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not width:
        return spark.createDataFrame([], RESULT)
    filled = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum((F.col("c") - OFFSET).cast("decimal(38,0)")).alias("s"))
    sums = [n * OFFSET] * width
    for i, s in filled.collect():
        sums[i] += int(s)
    near = [(2 * s + n) // (2 * n) for s in sums]  # the whole numbers next to the means
    rest = np.array([(s - n * c) / n for s, c in zip(sums, near)])
    centre = np.array(near, float)
    covariance = _cells(fit, width, lambda x: x - centre, width) / n - np.outer(rest, rest)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return spark.createDataFrame([], RESULT)
    values, basis = feast.eigenpairs(covariance, min(components, width), _project(spark, covariance))
    values, basis = values[values > SMALL * values[0]], basis[:, values > SMALL * values[0]]
    onto = basis / np.sqrt(values)
    project = lambda x: (x - centre - rest) @ onto
    identity_error = float(np.abs(_cells(fit, width, project, len(values)) / n - np.eye(len(values))).max())
    shift = [n * c - s for c, s in zip(near, sums)]

    def emit(batches):
        k = len(values)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(part)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.full(len(part) * k, n)), pa.array([d for d in deviations(x) for _ in range(k)], pa.int64()), pa.array(project(x).ravel()),
                     pa.array(np.tile(values / trace, len(part))), pa.array(np.full(len(part) * k, identity_error))],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact: n x - S is n (x - c) + (n c - S), small whole numbers."""
        away = (x - centre).astype(np.int64)
        if (n * int(np.abs(away).max()) + max(map(abs, shift))) ** 2 * width < 2**63:
            return ((n * away + np.array(shift, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * v + s) ** 2 for v, s in zip(row, shift)) for row in away.tolist()]
        return [d if d < 2**63 else None for d in exact]

    return rows.select("vec_id", "x").mapInArrow(emit, RESULT)


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``embeddings``, 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
