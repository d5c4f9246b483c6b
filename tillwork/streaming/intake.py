"""Incremental intake: newly arrived report files are parsed once and their rows appended to tables of parsed rows.

Shares, ranks and flags look at all reports of a kind, so they are not a batch's: ``cleaned`` derives them, and the layers above them,
from the rows of all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..plans.flows import layers, typed_tables
from ..session import stage
from ..sources import lines as L, reports as R

AUDIT = "file_audit"


def seen_files(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """Hashes of the files that earlier batches have taken in; a repeated batch does not see itself."""
    try:
        audit = spark.read.parquet(f"{out}/{AUDIT}")
    except AnalysisException:
        return None
    return audit.where((F.col("status") == "parsed") & (F.col("batch") != batch_id)).select("hash", "file")


def take_in(raw: DataFrame, batch_id: int, out: str) -> None:
    """Parse the files of one micro-batch. Each batch owns one partition of every table, so repeating it replaces its rows."""
    spark = raw.sparkSession
    lines = stage(L.decode(stage(L.place(raw), "placed")), "lines")
    audit = stage(R.audit_files(lines, seen=seen_files(spark, out, batch_id)), AUDIT)
    for name, df in typed_tables(lines, audit).items():
        _write(df, out, name, batch_id)
    _write(audit, out, AUDIT, batch_id)


def _write(df: DataFrame, out: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")


def cleaned(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Cleaned tables, dimensions, checks and features of everything taken in so far."""
    parsed = {s.name: spark.read.parquet(f"{out}/{s.name}").drop("batch") for s in R.REGISTRY}
    clean = R.clean_tables(parsed)
    return {**clean, **layers(clean)}


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.csv") -> StreamingQuery:
    """Take in every file not seen before and stop (``availableNow``); the checkpoint makes each file count once."""
    raw = L.scan(spark.readStream, folder, glob)
    return (raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, batch_id: take_in(df, batch_id, out)).start())
