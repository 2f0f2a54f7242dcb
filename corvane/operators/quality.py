"""Data-quality profiles in one pass over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, blanks, distinct_values); values are told apart by 128-bit digests, so long texts are not shuffled."""
    c = [x for n in columns for x in (F.count_if(F.col(n).isNull()).alias(f"{n}#0"), F.count_if(F.col(n).isNotNull() & (X.squash(F.col(n).cast("string")) == "")).alias(f"{n}#1"))]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}#0").alias("nulls"), F.col(f"{n}#1").alias("blanks")) for n in columns])).alias("x")
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *c).select("rows", long).select("x.column", "rows", "x.nulls", "x.blanks")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.when(F.col(n).isNotNull(), F.md5(F.col(n).cast("string"))).alias("v")) for n in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
    different = values.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return counts.join(different, "column", "left").na.fill(0, ["distinct_values"])


def repeated_rows(df: DataFrame, key: str) -> DataFrame:
    """(rows, distinct_rows, distinct_keys, repeated_keys) of a table."""
    whole = df.select(F.col(key).alias("k"), F.xxhash64(*df.columns).alias("h"))
    per = whole.groupBy("k", "h").agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("kinds"))
    return per.agg(F.sum("rows").alias("rows"), F.sum("kinds").alias("distinct_rows"), F.count("k").alias("distinct_keys"), F.count_if((F.col("rows") > 1) & F.col("k").isNotNull()).alias("repeated_keys"))


def json_validity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, valid): texts that are JSON, of those that are not blank.

    The parser stops after the first value, so a text counts only if it is one element of an array and one field
    of an object as well: text after the value breaks one of them.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("v")) for n in columns])).alias("x")).select("x.*").where("trim(v) <> ''")
    listed = F.concat(F.lit("["), "v", F.lit("]"))
    whole = F.try_parse_json(listed).isNotNull() & (F.size(F.from_json(listed, "array<string>")) == 1) & F.try_parse_json(F.concat(F.lit('{"a":'), "v", F.lit(',"b":0}'))).isNotNull()
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("filled"), F.count_if(whole).alias("valid"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def top_values(df: DataFrame, columns: list[str], k: int = 30) -> DataFrame:
    """(value, rows): the k most frequent comma-separated values over several columns; repeats count, ties by value."""
    every = df.select(F.explode(F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), ",") for c in columns]))).alias("v")).select(X.squash(F.col("v")).alias("value")).where("value <> ''")
    return every.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(k)
