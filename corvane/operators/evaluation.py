"""Retrieval metrics over ranked results of many queries and stages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vocab as V


def judged(results: DataFrame, benchmark: DataFrame) -> DataFrame:
    """results (stage, query_id, chunk_id, rank, text) with `hits` (keywords in the text) and `relevant`.

    Relevant without labels: at least max(1, 35 % of the keywords, rounded up) stand in the text.
    """
    b = benchmark.select("query_id", "keywords")
    r = results.join(b, "query_id").withColumn("hits", F.filter("keywords", lambda k: F.contains(F.lower(F.coalesce("text", F.lit(""))), k)))
    need = F.greatest(F.lit(1), F.ceil(0.35 * F.size("keywords")))
    return r.withColumn("relevant", (F.size("hits") >= need).cast("int"))


def _ideal(n):
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))).otherwise(0.0)


def metrics(judgements: DataFrame, ks: tuple[int, ...] = V.METRIC_KS) -> DataFrame:
    """(stage, query_id, k, precision, recall, mrr, ndcg, ndcg_top, coverage), every value rounded to 6 places.

    precision divides by k even where fewer results came; recall by the relevant results of the whole
    list; ndcg takes its ideal from the whole list, ndcg_top from the first k; coverage is the share of
    keywords found in the first k texts. One aggregation for all k.
    """
    j = judgements.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.col("rank") <= F.col("k")
    gain = F.col("relevant") / F.log2(F.col("rank") + F.lit(1.0))
    g = j.groupBy("stage", "query_id", "k").agg(
        F.sum(F.when(inside, F.col("relevant")).otherwise(0)).alias("top"),
        F.sum("relevant").alias("all"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(inside, gain).otherwise(0.0)).alias("dcg"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(inside, F.col("hits")))))).alias("found"),
        F.max(F.size("keywords")).alias("keywords"),
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return g.select(
        "stage", "query_id", F.col("k").cast("long").alias("k"),
        ratio(F.col("top").cast("double"), F.col("k").cast("double")).alias("precision"),
        F.least(F.lit(1.0), ratio(F.col("top").cast("double"), F.greatest(F.col("all"), F.lit(1)).cast("double"))).alias("recall"),
        ratio(F.lit(1.0), F.col("first").cast("double")).alias("mrr"),
        ratio(F.col("dcg"), F.nullif(_ideal(F.least("k", "all")), F.lit(0.0))).alias("ndcg"),
        ratio(F.col("dcg"), F.nullif(_ideal(F.least(F.col("k"), F.col("top"))), F.lit(0.0))).alias("ndcg_top"),
        ratio(F.col("found").cast("double"), F.nullif(F.col("keywords"), F.lit(0)).cast("double")).alias("coverage"),
    )


def stage_summary(rows: DataFrame, k: int = 10) -> DataFrame:
    names = ["precision", "recall", "mrr", "ndcg", "coverage"]
    return rows.where(F.col("k") == k).groupBy("stage").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(n), 5).alias(n) for n in names])


def winners(rows: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """(query_id, stage): of each query the stage with most coverage, then precision, then by the given order."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    w = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("precision"), place)
    return rows.where(F.col("k") == k).withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "stage")


def rank_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, moved_up, moved_down, gain, loss) between two rankings of the same rows."""
    j = before.select("query_id", "chunk_id", F.col("rank").alias("old")).join(after.select("query_id", "chunk_id", F.col("rank").alias("new")), ["query_id", "chunk_id"])
    d = F.col("old") - F.col("new")
    return j.groupBy("query_id").agg(
        F.count_if(d > 0).alias("moved_up"), F.count_if(d < 0).alias("moved_down"),
        F.round(F.avg(F.greatest(d, F.lit(0))), 5).alias("gain"), F.round(F.avg(F.least(d, F.lit(0))), 5).alias("loss"),
    )


def understanding(understood: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, intent_correct, entity_precision, entity_recall, missing, incorrect) of the reading of each query."""
    got = seeds.groupBy("query_id").agg(F.collect_set("entity").alias("got"))
    u = understood.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    both = F.size(F.array_intersect("entities", "got"))
    return u.select(
        "query_id", (F.col("intent") == F.col("predicted_intent")).cast("int").alias("intent_correct"),
        F.round(both / F.greatest(F.size("got"), F.lit(1)), 6).alias("entity_precision"), F.round(both / F.greatest(F.size("entities"), F.lit(1)), 6).alias("entity_recall"),
        F.array_join(F.array_sort(F.array_except("entities", "got")), ", ").alias("missing"), F.array_join(F.array_sort(F.array_except("got", "entities")), ", ").alias("incorrect"),
    )


def errors(read: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, category): the error classes of each query, from its reading and its precision at 10 by stage."""
    at = rows.where("k = 10").groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("stage") == s, F.col("precision"))), F.lit(0.0)).alias(s) for s in ("bm25", "semantic", "rrf", "graph")])
    j = read.join(at, "query_id", "left").na.fill(0.0, ["bm25", "semantic", "rrf", "graph"])
    cases = [
        (F.col("intent_correct") == 0, "Wrong intent"), (F.col("missing") != "", "Missing entity"), (F.col("incorrect") != "", "Hallucinated/incorrect entity"),
        (F.col("bm25") == 0, "Wrong BM25 retrieval"), (F.col("semantic") == 0, "Weak semantic retrieval"),
        (F.col("rrf") < F.greatest("bm25", "semantic"), "Poor RRF fusion"), (F.col("graph") < F.col("rrf"), "Incorrect graph score"),
    ]
    return j.select("query_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))).alias("category"))


def expansion_rows(expansion: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(query_id, source, entity, hop, useful, noisy): each expansion against the query's entities and keywords.

    Useful: it contains, or is contained in, one of them. Noisy: a soft skill, or below the least confidence.
    """
    from corvane.functions.arrays import entity_class

    b = benchmark.select("query_id", F.array_union("entities", "keywords").alias("terms"))
    x = expansion.join(b, "query_id").withColumn("source", F.element_at("path", -2))
    useful = F.exists("terms", lambda t: F.contains(F.col("entity"), t) | F.contains(t, F.col("entity")))
    noisy = (entity_class(F.col("entity")) == "SoftSkill") | (F.col("path_confidence") < V.MIN_CONFIDENCE)
    return x.select("query_id", "source", "entity", "hop", useful.cast("int").alias("useful"), noisy.cast("int").alias("noisy"))


def expansion_scores(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(query_id, size, precision, noise_ratio) of every query, zeros where nothing was expanded."""
    g = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"), F.avg("useful").alias("p"))
    z = benchmark.select("query_id").join(g, "query_id", "left")
    return z.select("query_id", F.coalesce("size", F.lit(0)).alias("size"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(1 - F.col("p"), F.lit(0.0)), 6).alias("noise_ratio"))


def unrelated_producers(rows: DataFrame, k: int = 20) -> DataFrame:
    """(source, expansions): the entities that most often lead to expansions of no use."""
    return rows.where("useful = 0").groupBy("source").agg(F.count(F.lit(1)).alias("expansions")).orderBy(F.desc("expansions"), "source").limit(k)


def graph_contribution(ranked: DataFrame, k: int = V.FINAL) -> DataFrame:
    """(query_id, improved, hurt, mean_graph, mean_rrf, mean_final) over the first k results; means are exact, of whole units of the last place."""
    return ranked.where(F.col("graph_rank") <= k).groupBy("query_id").agg(
        F.count_if(F.col("final_score") > 1.05 * F.col("rrf_score")).alias("improved"), F.count_if(F.col("final_score") < 0.95 * F.col("rrf_score")).alias("hurt"),
        *[(F.sum(F.round(F.col(c) * unit).cast("long")) / (F.count(F.lit(1)) * F.lit(unit))).alias(n) for n, c, unit in (("mean_graph", "graph_score", 1e6), ("mean_rrf", "rrf_score", 1e9), ("mean_final", "final_score", 1e6))],
    )


def explanation_issues(explained: DataFrame) -> DataFrame:
    """(query_id, chunk_id, issue): what an explanation lacks: a summary, or a path's steps or confidence."""
    e = F.col("explanation")
    bad = F.filter(e["paths"], lambda p: (F.size(p["path"]) < 2) | (p["path_confidence"] <= 0))
    issues = F.array_compact(F.array(F.when(F.coalesce(e["summary"], F.lit("")) == "", F.lit("Missing explanation summary")), F.when(F.size(bad) > 0, F.lit("Incomplete path"))))
    return explained.select("query_id", "chunk_id", F.explode(issues).alias("issue"))


def acceptance(expansion: DataFrame, summary: DataFrame, contribution: DataFrame) -> DataFrame:
    """(criterion, passed): the acceptance criteria over one-row aggregates of the reports."""
    x = expansion.agg(F.avg("precision").alias("ep"), F.avg("noise_ratio").alias("en"))
    p = summary.agg(*[F.coalesce(F.max(F.when(F.col("stage") == s, F.col("precision"))), F.lit(0.0)).alias(s) for s in ("bm25", "semantic", "rrf", "graph")])
    c = contribution.agg(F.sum("improved").alias("up"), F.sum("hurt").alias("down"))
    one = x.join(p).join(c)  # one row each
    checks = {
        "expansion precision at least 0.5": F.col("ep") >= 0.5, "expansion noise at most 0.5": F.col("en") <= 0.5, "bm25 contributes": F.col("bm25") > 0, "semantic contributes": F.col("semantic") > 0,
        "graph does not hurt": F.col("graph") >= 0.98 * F.col("rrf"), "graph improves more than it hurts": F.col("down") < F.col("up"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")
