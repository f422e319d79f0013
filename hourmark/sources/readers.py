"""Table readers with explicit types and UTC normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_utc(text: Column) -> Column:
    """ISO text to an instant; unreadable stamps become null."""
    return F.try_to_timestamp(text)


def as_instants(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Zone-less timestamps (or the named columns) to ``TIMESTAMP`` in session zone UTC."""
    wanted = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)} if columns is None else set(columns)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in df.columns if c in wanted})


def as_plain_timestamps(df: DataFrame) -> DataFrame:
    """Instants back to zone-less timestamps for engines without time zones."""
    wanted = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in wanted})


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan, only the named columns, with instants normalised."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    return as_instants(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, utc: Sequence[str] = ()) -> DataFrame:
    """Compressed CSV with a declared schema; ``utc`` columns are declared as text and parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: parse_utc(F.col(c)) for c in utc})
