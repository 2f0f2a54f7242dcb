"""Graph and text evidence, weighted scores, reranking hook and explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vocab as V
from corvane.functions.arrays import entity_class

SKILL_TYPES = ["ProgrammingLanguage", "Framework", "Tool", "Database", "CloudPlatform", "Skill"]


def evidence(candidates: DataFrame, chunk_skills: DataFrame, seeds: DataFrame, expansion: DataFrame) -> DataFrame:
    """candidates (query_id, chunk_id, text, ...) with graph and text evidence.

    chunk_skills: chunk_id, skills array (lower case). Adds direct and neighbour matches (sorted by name),
    graph_rel_score, matched_seeds, matched_expanded, graph_text_score and graph_score. Candidates without
    skills and queries without seeds score 0.
    """
    own = seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("seed_entities"))
    # the most confident path of an entity speaks for it
    rel = expansion.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", "path_confidence"))).alias("related"))
    c = candidates.join(own, "query_id", "left").join(rel, "query_id", "left").join(chunk_skills.select("chunk_id", "skills"), "chunk_id", "left")
    none = F.array().cast("array<string>")
    c = c.withColumn("skills", F.coalesce(F.array_distinct("skills"), none)).withColumn("seed_entities", F.coalesce("seed_entities", none))
    c = c.withColumn("related", F.coalesce("related", F.create_map().cast("map<string,double>")))
    c = c.withColumn("direct", F.array_sort(F.array_intersect("skills", "seed_entities")))
    c = c.withColumn("neighbours", F.array_sort(F.array_except(F.array_intersect("skills", F.map_keys("related")), "seed_entities")))
    n = F.size("neighbours")
    conf = F.aggregate("neighbours", F.lit(0.0), lambda s, x: s + F.col("related")[x]) / F.greatest(n, F.lit(1))
    onto = F.size(F.filter("skills", lambda s: entity_class(s).isin(SKILL_TYPES))) / F.greatest(F.size("skills"), F.lit(1))
    cover = F.least((F.size("direct") + n) / F.greatest(F.size("seed_entities"), F.lit(1)), F.lit(1.0))
    score = F.when((F.size("skills") > 0) & (F.size("seed_entities") > 0), F.round(0.30 * onto + 0.25 * conf + 0.25 * cover + 0.20 * conf, 6)).otherwise(0.0)
    c = c.withColumn("graph_rel_score", score)
    doc = F.lower(F.concat_ws(" ", "text", F.array_join("skills", " ")))
    c = c.withColumn("matched_seeds", F.filter("seed_entities", lambda e: F.contains(doc, e)))
    c = c.withColumn("matched_expanded", F.filter(F.array_sort(F.map_keys("related")), lambda e: F.contains(doc, e)))
    s = F.size("matched_seeds") / F.greatest(F.size("seed_entities"), F.lit(1))
    e = F.size("matched_expanded") / F.greatest(F.size(F.map_keys("related")), F.lit(1))
    has_s, has_e = F.size("seed_entities") > 0, F.size(F.map_keys("related")) > 0
    text = F.when(has_s & has_e, 0.7 * s + 0.3 * e).when(has_s, s).when(has_e, e).otherwise(0.0)
    c = c.withColumn("graph_text_score", F.round(text, 6))
    return c.withColumn("graph_score", F.round(V.TEXT_WEIGHT * F.col("graph_text_score") + V.REL_WEIGHT * F.col("graph_rel_score"), 6)).drop("related", "skills")


def combine(candidates: DataFrame) -> DataFrame:
    """Adds final_score and graph_rank: 0.65 of the normalised fusion score and 0.20 of the graph score; ties keep the fused rank."""
    top = 2.0 / (V.RRF_K + 1)
    final = F.round(V.RRF_WEIGHT * F.least(F.col("rrf_score") / top, F.lit(1.0)) + V.GRAPH_WEIGHT * F.col("graph_score"), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "fused_rank")
    return candidates.withColumn("final_score", final).withColumn("graph_rank", F.row_number().over(order))


def rerank(ranked: DataFrame, logit: Callable[[], F.Column] | None = None, pool: int = V.POOL, k: int = V.FINAL) -> DataFrame:
    """The pool rescored by a model's logit (a Column expression or UDF call), or left as it is without one."""
    rows = ranked.where(F.col("graph_rank") <= pool)
    x = logit() if logit is not None else None
    normal = F.lit(0.0) if x is None else F.round(1 / (1 + F.pow(F.lit(2.718281828), -x)), 6)
    rows = rows.withColumn("ce_score", F.lit(0.0) if x is None else F.round(x, 6)).withColumn("ce_normal", normal)
    rows = rows.withColumn("combined_score", F.col("final_score") if x is None else F.round(F.col("final_score") + V.CE_WEIGHT * F.col("ce_normal"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "graph_rank")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def quality_label(score):
    out = F.lit("weak")
    for least, name in ((0.20, "partial"), (0.40, "moderate"), (0.60, "strong"), (0.80, "excellent")):
        out = F.when(score >= least, name).otherwise(out)
    return out


def explain(ranked: DataFrame, expansion: DataFrame) -> DataFrame:
    """Adds `explanation`: label, summary sentence, reason, contributing paths (10 at most) and scores."""
    paths = expansion.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity", "path", "path_confidence"))).alias("_paths"))
    r = ranked.join(paths, "query_id", "left")
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(c, 1, 5), ", ")))
    parts = F.concat_ws(" | ", part("Directly matched", "matched_seeds"), part("Graph-expanded matches", "matched_expanded"), part("Graph relationship direct matches", "direct"), part("Graph relationship neighbour matches", "neighbours"))
    any_ = parts != ""
    label = quality_label(F.col("final_score"))
    text = F.concat(F.lit("This result has a "), label, F.lit(" relevance to your query '"), F.col("query"), F.lit("'. "), F.when(any_, parts).otherwise("No direct or expanded entity matches found."), F.lit("."))
    why = F.when(any_, "Candidate matches explicit user requirements and graph-related technologies.").otherwise("Candidate was retained by hybrid retrieval, but graph evidence is weak.")
    used = F.slice(F.filter(F.coalesce("_paths", F.array().cast("array<struct<rank:int,entity:string,path:array<string>,path_confidence:double>>")), lambda p: F.array_contains("matched_expanded", p["entity"])), 1, 10)
    scores = F.struct("rrf_score", "graph_score", "graph_text_score", "graph_rel_score", "final_score")
    return r.withColumn("explanation", F.struct(label.alias("quality_label"), text.alias("summary"), why.alias("reason"), used.alias("paths"), scores.alias("scores"))).drop("_paths")
