"""p5: skills, titles and cities of demands, profiles and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.mapping import map_values
from corvane.operators.packed import unpack
from corvane.plans import packed_queries as packed
from corvane.sources.tables import one_per_key, table


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, ref_id, name, alias) of the three reference lists."""
    names = [("skill", "skill_reference", "skill_id", "skill_name", F.split("aliases", r"\|")), ("title", "title_reference", "title_id", "title_name", None), ("city", "city_reference", "city_id", "city_name", F.array("other_name"))]
    out = None
    for domain, name, key, column, aliases in names:
        t = table(spark, sf_dir, name)
        own = F.array(F.struct(F.col(column).alias("name"), F.lit(False).alias("alias")))
        all_ = own if aliases is None else F.concat(own, F.coalesce(F.transform(aliases, lambda x: F.struct(x.alias("name"), F.lit(True).alias("alias"))), F.array()))
        part = t.select(F.lit(domain).alias("domain"), F.col(key).alias("ref_id"), F.explode(all_).alias("n")).select("domain", "ref_id", "n.name", "n.alias")
        out = part if out is None else out.unionByName(part)
    return out


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value: domain, record_id, field_name, pos, item."""
    names = {"all_skills": packed.skill_names(spark, sf_dir)}
    profiles = one_per_key(table(spark, sf_dir, "profiles"), "id", "all_skills")
    skills = unpack(packed.demand_fields(spark, sf_dir), "id", names).unionByName(unpack(profiles, "id", names)).select(F.lit("skill").alias("domain"), "*")
    single = None
    for name, key in (("demands", "id"), ("jd_cleaned", "jd_id")):
        t = one_per_key(table(spark, sf_dir, name), key, "job_title", "city")
        t = t.select(F.col(key).alias("record_id"), F.explode(F.array(
            F.struct(F.lit("title").alias("domain"), F.lit("job_title").alias("field_name"), F.col("job_title").alias("item")),
            F.struct(F.lit("city").alias("domain"), F.lit("city").alias("field_name"), F.col("city").alias("item")),
        )).alias("x")).select("x.domain", "record_id", "x.field_name", F.lit(1).alias("pos"), "x.item").where("item IS NOT NULL")
        single = t if single is None else single.unionByName(t)
    return skills.unionByName(single)


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_values(typed(spark, sf_dir), references(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).select("record_id", "field_name", F.col("pos").cast("int").alias("pos"), F.col("ref_id").cast("int").alias("ref_id"))


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different values that no reference entry was meant by, with their rows."""
    return mapped(spark, sf_dir).where("ref_id = 0").groupBy("domain", F.lower(F.trim("item")).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"p5_found": found, "p5_unmatched": unmatched}
