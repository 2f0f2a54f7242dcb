"""Graph upserts and neighbourhoods, method evaluation, validation metrics and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import vocab as V
from corvane.functions.arrays import entity_class
from corvane.session import local_table

# ---- graph -------------------------------------------------------------------------------------


def merged_nodes(edges: DataFrame) -> DataFrame:
    """(label, name, source, ontology_type) of the end points of edges (src_label, src, dst_label, dst, origin, turn).

    Upsert by (label, name): the first origin stays (by turn), the last type counts; blank names make no node.
    """
    end = lambda label, name: edges.select(F.col(label).alias("label"), F.col(name).alias("name"), "origin", "turn")
    ends = end("src_label", "src").unionByName(end("dst_label", "dst")).where("trim(name) <> ''")
    one = ends.groupBy("label", "name").agg(F.min_by("origin", "turn").alias("source"))
    documents = F.col("label").isin("Candidate", "Demand", "JobDescription", "Location", "Domain")
    return one.withColumn("ontology_type", F.when(documents, F.col("label")).otherwise(entity_class(F.col("name"))))


def merged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two end points exist under their labels, one for each (source, relation, target): the last confidence counts.

    Two joins on (label, name), then one aggregation; of one turn the greatest confidence counts.
    """
    at = lambda side: nodes.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(side))
    held = edges.join(at("src"), ["src_label", "src"], "left_semi").join(at("dst"), ["dst_label", "dst"], "left_semi")
    last = F.max_by("confidence", F.struct("turn", "confidence")).alias("confidence")
    return held.groupBy("src_label", "src", "relation", "dst_label", "dst").agg(last)


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, degree, neighbours): different targets of each source in the order of their names."""
    return edges.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("neighbours")).select("source", F.size("neighbours").alias("degree"), "neighbours")


def degree_summary(edges: DataFrame) -> DataFrame:
    """(nodes, sources, edges, mean_degree): mean of the different targets over the nodes that have some."""
    pairs = edges.select("source", "target").distinct()
    ends = pairs.select(F.explode(F.array("source", "target")).alias("n")).agg(F.count_distinct("n").alias("nodes"))
    return pairs.agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("edges")).join(ends).select("nodes", "sources", "edges", (F.col("edges") / F.col("sources")).alias("mean_degree"))


def related(seeds: DataFrame, edges: DataFrame, k: int = V.EXPANSION_LIMIT, least: float = V.MIN_CONFIDENCE) -> DataFrame:
    """(query_id, entity, relation, confidence, rank): typed neighbours of seeds (query_id, entity), one hop, no soft skills.

    The best k of a query by confidence; ties by name and relation. An entity reached twice counts once, by its best edge.
    """
    firm = edges.where((F.col("confidence") >= least) & (F.col("target_type") != "SoftSkill")).select(F.col("source").alias("entity"), "target", "relation", "confidence")
    near = seeds.select("query_id", "entity").distinct().join(firm, "entity").groupBy("query_id", F.col("target").alias("entity")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "relation")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("b.c", "entity"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "entity", "b.relation", (-F.col("b.c")).alias("confidence"), "rank")


def paths(seeds: DataFrame, edges: DataFrame, k: int = V.EXPANSION_LIMIT, least: float = V.MIN_CONFIDENCE) -> DataFrame:
    """(query_id, entity, path, confidence, rank): paths of one or two edges in either direction, no node twice.

    Every edge has the least confidence; a path's is the product. Of the paths to one entity the best counts (ties:
    shorter, then by the names on it); the best k entities of a query stay. Seeds and soft skills are no targets.
    """
    both = edges.where(F.col("confidence") >= least).select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence").unionByName(edges.where(F.col("confidence") >= least).select(F.col("target").alias("a"), F.col("source").alias("b"), "confidence"))
    step = both.groupBy("a", "b").agg(F.max("confidence").alias("w"))
    own = seeds.select("query_id", "entity").distinct()
    one = own.join(step, F.col("entity") == F.col("a")).select("query_id", F.col("b").alias("end"), F.array("a", "b").alias("path"), F.col("w").alias("c"))
    two = one.join(step, F.col("end") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("query_id", F.col("b").alias("end"), F.concat("path", F.array("b")).alias("path"), (F.col("c") * F.col("w")).alias("c"))
    every = one.unionByName(two).withColumn("c", F.round("c", 6)).where(~F.col("end").isin(V.TERMS["SoftSkill"])).withColumnRenamed("end", "entity").join(own, ["query_id", "entity"], "left_anti")
    best = every.groupBy("query_id", "entity").agg(F.min(F.struct((-F.col("c")).alias("c"), F.size("path").alias("n"), F.array_join("path", ">").alias("path"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("b.c", "b.n", "entity"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "entity", "b.path", (-F.col("b.c")).alias("confidence"), "rank")


def existing(names: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """The rows of names (name, ...) that are nodes of the label."""
    return names.join(nodes.where(F.col("label") == label).select("name"), "name", "left_semi")


def relation_lists(edges: DataFrame, relations: dict[str, list[str]]) -> DataFrame:
    """(src_label, src, skills): lower-case targets of each document by the relations that count for its label."""
    wanted = F.lit(False)
    for label, names in relations.items():
        wanted = wanted | ((F.col("src_label") == label) & F.col("relation").isin(names))
    return edges.where(wanted).groupBy("src_label", "src").agg(F.array_sort(F.collect_set(F.lower("dst"))).alias("skills"))


def counted(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(value, rows) for every known value, 0 where there is none, and for the values that are not known."""
    fixed = local_table(rows.sparkSession, [(v,) for v in known], "value string")
    got = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return fixed.join(got, "value", "full").select("value", F.coalesce("rows", F.lit(0)).alias("rows"))


# ---- evaluation --------------------------------------------------------------------------------


def method_runs(results: DataFrame, benchmark: DataFrame, methods: list[str], top: int = 5) -> DataFrame:
    """(query_id, method, results, top1_matches, top5_coverage, mean_score): every query by every method, zeros where it found nothing.

    results: query_id, method, rank, score, text. Keywords are counted once each, in the text of rank 1 and in the
    first `top` texts joined by blanks; mean_score is the mean over all results.
    """
    b = benchmark.select("query_id", "keywords")
    asked = b.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    first = F.when(F.col("rank") <= top, F.struct("rank", F.lower(F.coalesce("text", F.lit(""))).alias("t")))
    got = results.groupBy("query_id", "method").agg(F.count(F.lit(1)).alias("results"), F.array_sort(F.collect_list(first)).alias("x"), (F.sum(F.round(F.col("score") * 1e6).cast("long")) / (F.count("score") * F.lit(1e6))).alias("mean_score"))
    hits = lambda t: F.size(F.filter("keywords", lambda k: F.contains(t, k)))
    joined = F.array_join(F.transform("x", lambda v: v["t"]), " ")
    return asked.join(got, ["query_id", "method"], "left").select(
        "query_id", "method", F.coalesce("results", F.lit(0)).alias("results"), F.when(F.size("x") > 0, hits(F.element_at("x", 1)["t"])).otherwise(0).alias("top1_matches"),
        F.when(F.size("x") > 0, hits(joined)).otherwise(0).alias("top5_coverage"), "mean_score",
    )


def timed_runs(searches: dict, benchmark: DataFrame, text: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, str | None]]]:
    """Runs of searches (name -> function without arguments giving query_id, chunk_id, rank, score), and of each its seconds and error.

    A search that fails takes part with no results and its message; the others go on. Results are written once.
    """
    import time

    from corvane.session import written

    out, notes = None, {}
    for name, search in searches.items():
        began = time.time()
        try:
            part = written(search().select("query_id", "chunk_id", "rank", "score", F.lit(name).alias("method")), "run")
            out = part if out is None else out.unionByName(part)
            notes[name] = (time.time() - began, None)
        except Exception as e:  # noqa: BLE001 - any failure of a method is a result of the evaluation
            notes[name] = (time.time() - began, str(e).splitlines()[0] if str(e) else type(e).__name__)
    if out is None:
        out = text.sparkSession.createDataFrame([], "query_id string, chunk_id string, rank int, score double, method string")
    return method_runs(out.join(text, "chunk_id", "left"), benchmark, list(searches)), notes


def method_summary(runs: DataFrame) -> DataFrame:
    """(method, queries, empty, mean_top1, mean_top5, mean_score) over all queries; empty: queries without a result."""
    mean = lambda c: F.sum(c) / F.count(c)
    units = F.round(F.col("mean_score") * 1e6).cast("long")
    return runs.groupBy("method").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("results") == 0).alias("empty"), mean("top1_matches").alias("mean_top1"), mean("top5_coverage").alias("mean_top5"), (F.sum(units) / (F.count(units) * F.lit(1e6))).alias("mean_score"))


def method_winners(runs: DataFrame, order: list[str]) -> DataFrame:
    """(query_id, method): of each query the method with most coverage, then most matches in its first text, then by the given order."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("top5_coverage"), F.desc("top1_matches"), place))
    return runs.withColumn("n", n).where("n = 1").select("query_id", "method")


def labelled_metrics(results: DataFrame, labels: DataFrame, ks: tuple[int, ...] = V.METRIC_KS) -> DataFrame:
    """(query_id, k, labels, precision, recall, mrr) where relevance is given: labels (query_id, chunk_id).

    Queries without labels are left out; a query whose results hold none of its labels has zeros.
    """
    known = labels.select("query_id", "chunk_id").distinct()
    count = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("labels"))
    hit = results.select("query_id", "chunk_id", "rank").join(known.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"])
    k = count.withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks])))
    g = k.join(hit, "query_id", "left").groupBy("query_id", "k", "labels").agg(F.count_if(F.col("rank") <= F.col("k")).alias("top"), F.min("rank").alias("first"))
    return g.select("query_id", "k", "labels", F.round(F.col("top") / F.col("k"), 6).alias("precision"), F.round(F.col("top") / F.col("labels"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def validation_metrics(results: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(stage, query_id, p5, p10, r5, r10, mrr, ndcg10) by expected entities instead of keywords.

    results: stage, query_id, chunk_id, rank, text. A text is relevant if it holds any expected entity; recall is the
    share of expected entities held by the first k texts; ndcg takes its ideal from the first 10.
    """
    r = results.join(benchmark.select("query_id", F.col("entities").alias("expected")), "query_id").where("rank <= 10")
    r = r.withColumn("hits", F.filter("expected", lambda e: F.contains(F.lower(F.coalesce("text", F.lit(""))), e))).withColumn("rel", (F.size("hits") > 0).cast("int"))
    gain = lambda: F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))
    held = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("hits"))))))
    g = r.groupBy("stage", "query_id").agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("t5"), F.sum("rel").alias("t10"), held(5).alias("h5"), held(10).alias("h10"), F.max(F.size("expected")).alias("e"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(gain()).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("t10", F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    part = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b) if isinstance(b, str) else b, F.lit(1)), 6)
    return g.select(
        "stage", "query_id", part("t5", F.lit(5)).alias("p5"), part("t10", F.lit(10)).alias("p10"), part("h5", "e").alias("r5"), part("h10", "e").alias("r10"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.when(F.col("t10") > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg10"),
    )


#: Types between which an expansion is noise.
FORBIDDEN = [("ProgrammingLanguage", "SoftSkill"), ("Framework", "SoftSkill"), ("Tool", "SoftSkill"), ("ProgrammingLanguage", "Industry"), ("Framework", "Industry")]


def expansion_quality(expansion: DataFrame) -> DataFrame:
    """(query_id, good, bad, precision, noise_ratio): bad are expansions between forbidden types, soft skills and those below the least confidence."""
    x = expansion.select("query_id", "entity", "path_confidence", entity_class(F.element_at("path", -2)).alias("a"), entity_class(F.col("entity")).alias("b"))
    bad = F.concat_ws(">", "a", "b").isin([f"{a}>{b}" for a, b in FORBIDDEN]) | F.col("entity").isin(V.TERMS["SoftSkill"]) | (F.col("b") == "SoftSkill") | (F.col("path_confidence") < V.MIN_CONFIDENCE)
    g = x.groupBy("query_id").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
    every = F.col("good") + F.col("bad")
    return g.select("query_id", "good", "bad", F.round(F.col("good") / every, 6).alias("precision"), F.round(F.col("bad") / every, 6).alias("noise_ratio"))


def ranking_summary(moves: DataFrame) -> DataFrame:
    """One row over moves (query_id, chunk_id, old, new, old_score, new_score, relevant).

    mean_gain, mean_loss: of the score; improved, worse: results that rose or fell; reduced: relevant results that fell.
    """
    d = F.round((F.col("new_score") - F.col("old_score")) * 1e6).cast("long")
    rise = F.col("old") - F.col("new")
    mean = lambda x: F.sum(x) / (F.count(F.lit(1)) * F.lit(1e6))
    return moves.agg(mean(F.greatest(d, F.lit(0))).alias("mean_gain"), mean(F.least(d, F.lit(0))).alias("mean_loss"), F.count_if(rise > 0).alias("improved"), F.count_if(rise < 0).alias("worse"), F.count_if((rise < 0) & (F.col("relevant") == 1)).alias("reduced"))


def acceptance_all(base: DataFrame, summary: DataFrame, reranked: DataFrame, issues: DataFrame) -> DataFrame:
    """(criterion, passed): base, with whether the reranker helps, explanations name their relations, and no stage degrades.

    summary: precision by stage; reranked: one row of `ranking_summary`; issues: rows of explanation issues.
    The last row says whether the system is ready: five or more of the first seven criteria hold.
    """
    p = summary.agg(*[F.coalesce(F.max(F.when(F.col("stage") == s, F.col("precision"))), F.lit(0.0)).alias(s) for s in ("rrf", "graph")])
    one = p.join(reranked.select("improved", "worse")).join(issues.agg(F.count_if(F.col("issue").startswith("Generic")).alias("generic")))  # one row each
    checks = {"reranker improves the ranking": (F.col("improved") >= F.col("worse")) | (F.col("improved") == 0), "explanations name their relations": F.col("generic") == 0, "no stage degrades retrieval": F.col("graph") >= 0.95 * F.col("rrf")}
    more = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), v.alias("passed")) for k, v in checks.items()])).alias("x")).select("x.*")
    every = base.unionByName(more)
    counted = every.where(~F.col("criterion").isin("explanations name their relations", "no stage degrades retrieval"))
    return every.unionByName(counted.agg((F.count_if("passed") >= 5).alias("passed")).select(F.lit("ready").alias("criterion"), "passed"))


def further_errors(expansion_scores: DataFrame, reranked: DataFrame, k: int = V.FINAL, most: float = 0.70) -> DataFrame:
    """(query_id, category): queries whose expansions are noise for the most part, and those whose precision at k the reranker lowers."""
    noise = expansion_scores.where(F.col("noise_ratio") > most).select("query_id", F.lit("Incorrect graph expansion").alias("category"))
    at = lambda c: F.sum(F.when(F.col(c) <= k, F.col("relevant")).otherwise(0))
    lower = reranked.groupBy("query_id").agg(at("old").alias("a"), at("new").alias("b")).where("b < a")
    return noise.unionByName(lower.select("query_id", F.lit("Cross encoder mistake").alias("category")))


def reducing_edges(moves: DataFrame, expansion: DataFrame, k: int = 20) -> DataFrame:
    """(edge, results): the edges on paths to entities that stand in relevant results which fell, the k most frequent (ties by name).

    moves as for `ranking_summary`, with matched_expanded.
    """
    fell = moves.where("new > old AND relevant = 1").select("query_id", F.explode("matched_expanded").alias("entity"))
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.concat(F.element_at("path", i), F.lit(" > "), F.element_at("path", i + 1)))
    on = expansion.select("query_id", "entity", F.explode(steps).alias("edge"))
    return fell.join(on, ["query_id", "entity"]).groupBy("edge").agg(F.count(F.lit(1)).alias("results")).orderBy(F.desc("results"), "edge").limit(k)


def seed_categories(read: DataFrame) -> DataFrame:
    """(query_id, category, names): the seeds of a reading by category, and `all_skills`, the skill-like ones without repeats."""
    none = F.array().cast("array<string>")
    part = {"skills": "skills", "technologies": "technologies", "tools": "tools", "frameworks": "frameworks", "programming_languages": "languages"}
    lists = {k: F.transform(c, lambda v: F.lower(F.trim(v))) for k, c in part.items()} | {"soft_skills": none, "roles": F.array_compact(F.array(F.lower(F.trim("role")))), "locations": F.array_compact(F.array(F.lower("city")))}
    every = F.array_distinct(F.concat(*[lists[k] for k in ("skills", "technologies", "tools", "frameworks", "programming_languages")]))
    scored = F.array_distinct(F.concat(*[lists[k] for k in ("skills", "technologies", "tools", "frameworks", "programming_languages")]))
    entities = F.array_distinct(F.concat(lists["roles"], every, lists["locations"], F.array_compact(F.array("country"))))
    return read.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("names")) for k, v in (lists | {"all_skills": every, "scoring_skills": scored, "entities": entities}).items()])).alias("x")).select("query_id", "x.*").where("size(names) > 0")


def markdown(tables: dict[str, DataFrame], most: int = 100) -> str:
    """Small report tables as one markdown text; a table of more than `most` rows is cut, and says so."""
    out = []
    for title, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
        out += ([f"More than {most} rows."] if len(rows) > most else []) + [""]
    return "\n".join(out)


def skills_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, skills) from the metadata of chunks; chunks without skills are left out."""
    return chunks.select("chunk_id", A.metadata_skills(F.col("metadata")).alias("skills")).where("size(skills) > 0")
