"""Readers for CSV tables, payload documents and property-graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

C = F.col
#: property-graph header types to Spark types
_GRAPH_TYPES = {"string": "string", "int": "int", "integer": "int", "long": "bigint", "double": "double",
                "float": "float", "bool": "boolean", "boolean": "boolean", "date": "timestamp"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV. Give a schema in production: without one Spark reads the file twice to infer it."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return nan_to_null(df)


def read_table(spark: SparkSession, path: str, nan_as_null: bool = False) -> DataFrame:
    """Parquet table. NaN is normalised only on request: the extra projection would hold back filter push-down."""
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_as_null else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(C(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def read_payloads(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """One JSON object per application to one wide row; the schema is given, nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Property-graph CSV with a typed header (``name:Type``).

    Bad cells become null and are counted in ``_bad_cells``; a bad row never fails the load.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    out, bad = [], F.lit(0)
    for name in raw.columns:
        plain, _, kind = name.partition(":")
        target = _GRAPH_TYPES.get(kind.split("(")[0].lower(), "string") if kind else "string"
        cell = F.col(f"`{name}`")
        typed = cell if target == "string" else cell.try_cast(target)
        bad = bad + (cell.isNotNull() & typed.isNull()).cast("int")
        out.append(typed.alias(plain.lstrip("~")))
    return raw.select(*out, bad.alias("_bad_cells"))
