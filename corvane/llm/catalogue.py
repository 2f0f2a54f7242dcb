"""Queries pN_ of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans import packed_queries as packed
from corvane.session import written
from corvane.sources.tables import one_per_key, table


def _pairs(spark: SparkSession, sf_dir: str, min_count: int, min_share: float) -> DataFrame:
    from corvane.llm.cooccurrence import cooccurrence

    skills = packed.demand_skills(spark, sf_dir).select(F.transform("all_skills", lambda x: F.lower(F.trim(x))).alias("skills"))
    return cooccurrence(written(skills, "skills"), "skills", min_count, min_share)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs together in at least 5 demands and 0.5 % of N, with n_both * N >= 2.5 * n_a * n_b."""
    return (
        _pairs(spark, sf_dir, 5, 0.005)
        .where(F.col("n_both") * F.col("n") * 2 >= F.col("n_a") * F.col("n_b") * 5)
        .select(F.col("item_a").alias("skill_a"), F.col("item_b").alias("skill_b"))
    )


def p2_pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, however rare, with lift, odds ratio and the z value of its logarithm."""
    return _pairs(spark, sf_dir, 1, 0.0).withColumnsRenamed({"item_a": "skill_a", "item_b": "skill_b"})


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.leakage import leaked

    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every test item: documents that contain part of it, and the most runs found in one."""
    found = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("runs").alias("most_runs"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "test_set")
    return items.join(found, "item_id", "left").select(
        "item_id", "test_set", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_runs", F.lit(0)).alias("most_runs")
    )


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks most similar to every chunk."""
    from corvane.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "chunk_vectors"), "chunk_id", "embedding", 128, 5).select(
        F.col("id").alias("chunk_id"), "rank", F.col("near_id").alias("near_chunk_id"), F.round("similarity", 3).alias("similarity")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p3_neighbours(spark, sf_dir)
    return near.select(F.least("chunk_id", "near_chunk_id").alias("chunk_id_a"), F.greatest("chunk_id", "near_chunk_id").alias("chunk_id_b")).distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score for abusive, hateful or sexual text and the kind of its worst passage."""
    from corvane.llm.abuse import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_reviews"), keep=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.abuse import THRESHOLD

    return p8_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cases and rate of cases per source (null: no source)."""
    from corvane.llm.abuse import THRESHOLD

    case = F.col("score") >= THRESHOLD
    return (
        p8_scores(spark, sf_dir)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(case).alias("cases"), F.round(F.avg(case.cast("double")), 6).alias("rate"))
    )


def _mixture(spark: SparkSession, sf_dir: str):
    from corvane.llm.mixture import mixture

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts in training order."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every target source."""
    return _mixture(spark, sf_dir)[1]


def _groups(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    from corvane.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, name), key, "job_text", width=3, similarity=0.5, least_words=25)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted posting and description with its group and number of links."""
    parts = [_groups(spark, sf_dir, n, k).select(F.lit(n).alias("table_name"), "*") for n, k in (("demands", "id"), ("jd_cleaned", "jd_id"))]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ids of a group, as TESTDATA.md asks for them; the two tables are kept apart."""
    g = written(p1_groups(spark, sf_dir).select("table_name", "group_id", "id"), "groups")
    a, b = g.withColumnRenamed("id", "id_a"), g.withColumnRenamed("id", "id_b")
    return a.join(b, ["table_name", "group_id"]).where("id_a < id_b").select("id_a", "id_b")


_RUNS = "list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))"
_LEAKS = f"""WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), items AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
drun AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS r FROM docs WHERE len(w) >= 13), irun AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS r FROM items WHERE len(w) >= 13),
leak AS (SELECT doc_id, item_id, count(*) AS runs FROM drun JOIN irun USING (r) GROUP BY ALL)"""
#: Exact SQL where there is one: shared runs as an equality join, groups by brute force over shared sequences.
SQL = {
    "p6_found": f"{_LEAKS} SELECT doc_id, item_id FROM leak",
    "p6_item_report": f"{_LEAKS} SELECT e.item_id, test_set, coalesce(documents, 0) AS documents, coalesce(most, 0) AS most_runs FROM eval_items e LEFT JOIN (SELECT item_id, count(*) AS documents, max(runs) AS most FROM leak GROUP BY ALL) l USING (item_id)",
}

#: Further modules of this subpackage with QUERIES and SQL.
MODULES: list[str] = ["mapping_queries"]


def queries() -> dict:
    out = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_pair_measures": p2_pair_measures, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_scores": p8_scores, "p8_found": p8_found, "p8_source_rates": p8_source_rates, "p6_found": p6_found, "p6_item_report": p6_item_report}
    for m in MODULES:
        out |= import_module(f"corvane.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = dict(SQL)
    for m in MODULES:
        out |= getattr(import_module(f"corvane.llm.{m}"), "SQL", {})
    return out
