"""Result store: every run writes its own folder, readers use the newest complete run, nothing is deleted.

A table is laid out for its point lookups: partitioned by the columns that name a branch or scope, sorted inside the files
by the rest of the key, so that a lookup reads one partition and few row groups.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

# Key of each stored table: partition columns, sort columns.
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "combo_pairs": (["scope_type"], ["scope", "item_a", "item_b"]),
    "demand_forecast_all": (["scenario"], ["branch", "forecast_period"]),
    "branch_kpis": ([], ["branch"]),
    "feasibility_scores": ([], ["branch"]),
    "staffing_gap_hourly": ([], ["branch", "day_of_week", "hour"]),
    "branch_staffing_findings": ([], ["branch"]),
    "branch_beverage_kpis": ([], ["branch"]),
    "branch_growth_potential": ([], ["branch"]),
    "assoc_rules_by_branch": (["is_total"], ["branch", "antecedents", "consequents"]),
}
RUNS = "_runs"


def new_run_id() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def table_path(root: str, run_id: str, table: str) -> str:
    return f"{root}/run_id={run_id}/{table}"


def write_table(df: DataFrame, root: str, run_id: str, table: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                sort_by: Sequence[str] | None = None) -> None:
    """Write one table of a run; ``partition_by=["branch"]`` gives one folder per branch, ``fmt="csv"`` has a header."""
    parts, keys = LAYOUT.get(table, ([], []))
    parts = list(parts if partition_by is None else partition_by)
    keys = [k for k in (keys if sort_by is None else sort_by) if k in df.columns]
    if keys:
        df = df.repartitionByRange(*parts, *keys).sortWithinPartitions(*parts, *keys)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        arrays = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        writer = df.withColumns({c: F.to_json(c) for c in arrays}).write.mode("overwrite").format(fmt).option("header", True).option("escape", '"')
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(table_path(root, run_id, table))


def write_json(df: DataFrame, root: str, run_id: str, table: str) -> None:
    """One JSON document per row, for recommendations and run metadata."""
    df.write.mode("overwrite").json(table_path(root, run_id, table))


def finish_run(spark: SparkSession, root: str, run_id: str, tables: Sequence[str]) -> None:
    """Mark a run complete; only then do readers see it."""
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.array(*[F.lit(t) for t in tables]).alias("tables"),
                                F.current_timestamp().alias("finished_at"))
    row.write.mode("append").parquet(f"{root}/{RUNS}")


def newest_run(spark: SparkSession, root: str) -> str | None:
    try:
        return spark.read.parquet(f"{root}/{RUNS}").agg(F.max("run_id")).first()[0]
    except AnalysisException:
        return None


def read_table(spark: SparkSession, root: str, table: str, schema=None, run_id: str | None = None) -> DataFrame:
    """A table of the newest complete run; without one, an empty table of ``schema`` (or an error if none is given)."""
    run_id = run_id or newest_run(spark, root)
    try:
        if run_id is None:
            raise AnalysisException("no complete run")
        return spark.read.parquet(table_path(root, run_id, table))
    except AnalysisException:
        if schema is None:
            raise FileNotFoundError(f"no table '{table}' of a complete run under {root}") from None
        return spark.createDataFrame([], schema)


def key_value_items(df: DataFrame, pk: Sequence[str], sk: Sequence[str], digits: int = 4) -> DataFrame:
    """Rows as (pk, sk, attributes): key texts joined by '#', NULLs skipped, doubles as rounded decimals in JSON."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in pk]
    sort = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("#"), F.lit("_")) for c in sk]
    values = [(F.col(c).cast(f"decimal(28,{digits})") if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes]
    return df.select(F.concat_ws("#", *key).alias("pk"), F.concat_ws("#", *sort).alias("sk"), F.to_json(F.struct(*values)).alias("attributes"))


def write_run(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], documents: Mapping[str, DataFrame] | None = None,
              run_id: str | None = None) -> str:
    """Write all tables and documents of a run and mark it complete; returns the run id."""
    run_id = run_id or new_run_id()
    for name, df in tables.items():
        write_table(df, root, run_id, name)
    for name, df in (documents or {}).items():
        write_json(df, root, run_id, name)
    finish_run(spark, root, run_id, [*tables, *(documents or {})])
    return run_id
