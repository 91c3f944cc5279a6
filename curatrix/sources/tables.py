"""Reading tables: names, scopes, samples, asset files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def full_name(name: str, catalog: str | None = None, schema: str | None = None) -> str | None:
    """Three-part name from one, two or three parts; None when a default is missing."""
    parts = name.split(".")
    if len(parts) == 3:
        return name
    if len(parts) == 2:
        return f"{catalog}.{name}" if catalog else None
    return f"{catalog}.{schema}.{name}" if len(parts) == 1 and catalog and schema else None


def read_table(spark: SparkSession, name: str, catalog: str | None = None, schema: str | None = None) -> DataFrame | None:
    """Table by qualified name; None when the name cannot be completed, an analysis error when it cannot be read."""
    known = full_name(name, catalog, schema)
    return None if known is None else spark.table(known)


def lookback_seconds(text: str | None) -> int:
    text = text or "1h"
    n = int(re.sub(r"\D", "", text) or "1")
    unit = re.sub(r"[^A-Za-z]", "", text).lower() or "h"
    return n * {"h": 3600, "m": 60, "d": 86400}.get(unit, 3600)


def read_scoped(df: DataFrame, strategy: str, column: str | None = None, lookback: str | None = None, as_of=None) -> DataFrame:
    """``time-window`` keeps rows not older than the lookback, as a typed literal that Parquet can use; anything else is a full read."""
    if strategy != "time-window" or not column or column not in df.columns:
        return df
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {lookback_seconds(lookback)} seconds")
    return df.filter(F.col(column) >= cutoff)


def sample_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows in key order, and whether the limit was reached."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn("truncated", head.agg(F.count(F.lit(1)) >= n).scalar())


def read_asset_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV of assets, every field as text, any number of rows."""
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in columns), quote='"', escape='"')
