"""Parquet tables of a data directory, with one-row-per-key views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null key: the given columns of its latest delivery, all from that one row.

    The latest is the one of greatest `loaded_at` (nulls lose); of deliveries at one time, or in a table without
    that column, the row of greatest values counts. Only the columns asked for are shuffled.
    """
    order = ["loaded_at"] if "loaded_at" in df.columns and "loaded_at" not in columns else []
    latest = F.max(F.struct(*order, *columns)).alias("_latest")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(latest).select(key, *[F.col("_latest")[c].alias(c) for c in columns])
