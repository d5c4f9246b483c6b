"""Typed tables from CSV or Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import text_bool


def coerce(df: DataFrame, schema: T.StructType, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` by lower-cased, stripped name; text that does not fit a type becomes NULL (booleans: false).

    Absent columns are NULL. ``fill`` replaces NULLs of the named columns.
    """
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    have = dict(df.dtypes)

    def column(field: T.StructField) -> Column:
        kind = field.dataType
        if field.name not in have:
            c = F.lit(None).cast(kind)
        elif have[field.name] != "string":
            c = F.col(field.name).cast(kind)
        elif isinstance(kind, T.BooleanType):
            c = text_bool(F.col(field.name))
        elif isinstance(kind, T.ArrayType):
            c = F.from_json(field.name, kind)
        elif isinstance(kind, (T.TimestampType, T.DateType)):
            c = F.try_to_timestamp(F.col(field.name)).cast(kind)
        else:
            c = F.trim(F.col(field.name)).try_cast(kind)
        return c.alias(field.name)

    out = df.select(*[column(f) for f in schema.fields])
    return out.na.fill(dict(fill)) if fill else out


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, fill: Mapping[str, object] | None = None) -> DataFrame:
    """CSV with a header, read as text once and coerced column by column."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    return coerce(raw, schema, fill)


def read_line_items(spark: SparkSession, path: str) -> DataFrame:
    """Line items from CSV or Parquet in any accepted layout."""
    from ..operators.baskets import order_lines

    if path.rstrip("/").lower().endswith(".csv"):
        return order_lines(spark.read.option("header", True).option("escape", '"').csv(path))
    return order_lines(spark.read.parquet(path))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The stored pair table; a clear error if it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"no pair table at {path}; compute it with plans.flows.combos first") from exc


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored result table, or an empty one of the given schema if it is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
