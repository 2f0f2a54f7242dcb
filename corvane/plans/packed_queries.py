"""p4: packed fields of demands and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.packed import name_pattern, parse_fields, unpack
from corvane.sources.tables import one_per_key, table

#: Reference lists are read to the driver; a list longer than this is refused (they do not grow with the data).
MAX_NAMES = 100_000


def reference_names(spark: SparkSession, sf_dir: str, name: str, column: str) -> list[str]:
    rows = table(spark, sf_dir, name).select(column).where(F.col(column).isNotNull()).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"{name} has more than {MAX_NAMES} names")
    return [r[0] for r in rows]


def skill_names(spark: SparkSession, sf_dir: str) -> str:
    return name_pattern(reference_names(spark, sf_dir, "skill_reference", "skill_name"))


def title_names(spark: SparkSession, sf_dir: str) -> str:
    return name_pattern(reference_names(spark, sf_dir, "title_reference", "title_name"))


def demand_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(table(spark, sf_dir, "demands"), "id", "all_skills")


def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(table(spark, sf_dir, "profiles"), "id", "all_skills", "potential_roles")


def demand_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, all_skills array) of every demand, each id once."""
    return parse_fields(demand_fields(spark, sf_dir), {"all_skills": skill_names(spark, sf_dir)})


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: every value of demands.all_skills, profiles.all_skills and profiles.potential_roles."""
    skills, titles = skill_names(spark, sf_dir), title_names(spark, sf_dir)
    return unpack(demand_fields(spark, sf_dir), "id", {"all_skills": skills}).unionByName(
        unpack(profile_fields(spark, sf_dir), "id", {"all_skills": skills, "potential_roles": titles})
    )


def value_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per field: records with a value, values, different values, longest record."""
    items = found(spark, sf_dir)
    per = items.groupBy("field_name", "record_id").agg(F.count(F.lit(1)).alias("k"))
    sizes = per.groupBy("field_name").agg(F.count(F.lit(1)).alias("records"), F.sum("k").alias("values"), F.max("k").cast("long").alias("longest"))
    kinds = items.select("field_name", F.lower("item").alias("v")).distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("different"))
    return sizes.join(kinds, "field_name").select("field_name", "records", "values", "different", "longest")


QUERIES = {"p4_found": found, "p4_value_report": value_report}
