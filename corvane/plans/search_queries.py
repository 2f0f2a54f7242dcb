"""Queries of indexing, retrieval, fusion, graph, ranking, evaluation and quality, with their SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import text as X
from corvane.functions import vocab as V
from corvane.operators import evaluation as E
from corvane.operators import graph as G
from corvane.operators import quality as Q
from corvane.operators import querying as U
from corvane.operators import ranking as K
from corvane.operators import retrieval as R
from corvane.plans import prep_queries as P
from corvane.session import written
from corvane.sources.tables import one_per_key, table

# ---- SQL pieces -------------------------------------------------------------------------------


def _v(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_v, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_v, r)) + ")" for r in rows)


_SOURCE = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{s}'" for i, s in V.INTENT_SOURCE.items()) + " END"
Q_BENCH = f"""seeds AS (SELECT * FROM (VALUES {_rows([(i, a, b, c) for i, (a, b, c) in enumerate(V.BENCHMARK_SEEDS)])}) t(s, intent, seed, ents)),
mods AS (SELECT * FROM (VALUES {_rows(list(enumerate(V.BENCHMARK_MODIFIERS)))}) t(m, modifier)),
bench0 AS (SELECT 'Q' || lpad(CAST(s * {len(V.BENCHMARK_MODIFIERS)} + m + 1 AS VARCHAR), 3, '0') AS query_id, lower(trim(modifier || ' ' || seed)) AS query, intent, {_SOURCE} AS source,
  list_concat(ents, list_filter(string_split(modifier, ' '), lambda w: w <> '')) AS e, list_concat(ents, list_slice(string_split(seed, ' '), 1, 3)) AS w
  FROM seeds, mods WHERE s * {len(V.BENCHMARK_MODIFIERS)} + m + 1 <= {V.BENCHMARK_SIZE}),
bench AS (SELECT query_id, query, intent, source, list_filter(e, lambda x, i: list_position(e, x) = i) AS entities, list_filter(w, lambda x, i: list_position(w, x) = i) AS keywords FROM bench0)"""
Q_CORPUS = f"""corpus AS (
  SELECT 'demand_' || id AS chunk_id, 'demand' AS source, job_text AS text, job_title AS title, all_skills AS skills FROM {P.q_keys('demands', 'id', 'job_text', 'job_title', 'all_skills')}
  UNION ALL SELECT 'profile_' || id, 'profile', concat_ws(' ', potential_roles, all_skills, skill_summary), potential_roles, all_skills FROM {P.q_keys('profiles', 'id', 'potential_roles', 'all_skills', 'skill_summary')}
  UNION ALL SELECT 'jd_' || jd_id, 'jd', job_text, job_title, NULL FROM {P.q_keys('jd_cleaned', 'jd_id', 'job_text', 'job_title')})"""


def q_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9+#.]+')"


def q_index(name: str, column: str) -> str:
    return f"""{name}_tok AS (SELECT chunk_id, source, {q_tokens(column)} AS toks FROM corpus),
{name}_post AS (SELECT chunk_id, source, term, count(*) AS tf FROM (SELECT chunk_id, source, unnest(toks) AS term FROM {name}_tok) GROUP BY ALL),
{name}_len AS (SELECT chunk_id, source, len(toks) AS dl FROM {name}_tok),
{name}_df AS (SELECT source, term, count(*) AS df FROM {name}_post GROUP BY ALL),
{name}_n AS (SELECT source, count(*) AS n, avg(dl) AS avgdl FROM {name}_len GROUP BY ALL)"""


Q_TERMS = f"qterm AS (SELECT query_id, source, term, count(*) AS qtf FROM (SELECT query_id, source, unnest({q_tokens('query')}) AS term FROM bench) GROUP BY ALL)"


def q_scores(name: str, k1: float = V.BM25_K1, b: float = V.BM25_B, terms: str = "qterm") -> str:
    return f"""SELECT query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / greatest(avgdl, 1)))), 6) AS score
FROM {terms} t JOIN {name}_df d ON t.source = d.source AND t.term = d.term JOIN {name}_n c ON t.source = c.source JOIN {name}_post p ON p.source = t.source AND p.term = t.term JOIN {name}_len l ON l.chunk_id = p.chunk_id
GROUP BY query_id, p.chunk_id HAVING score > 0"""


def q_top(scores: str, k: int) -> str:
    return f"SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM ({scores}) QUALIFY rank <= {k}"


Q_IX = f"WITH {Q_BENCH}, {Q_CORPUS}, {q_index('ix', 'text')}, {Q_TERMS}"
Q_SETC = """SELECT query_id, chunk_id, round(c / sqrt(nq * nd), 6) AS score FROM (
  SELECT query_id, d.chunk_id, count(*) AS c FROM docterm d JOIN (SELECT DISTINCT query_id, source, term FROM qterm) t ON d.source = t.source AND d.term = t.term GROUP BY ALL)
  JOIN (SELECT chunk_id, count(*) AS nd FROM docterm GROUP BY ALL) USING (chunk_id) JOIN (SELECT query_id, count(DISTINCT term) AS nq FROM qterm GROUP BY ALL) USING (query_id)"""
Q_DOCTERM = f"docterm AS (SELECT DISTINCT chunk_id, source, term FROM (SELECT chunk_id, source, term FROM ix_post UNION ALL SELECT chunk_id, source, unnest({q_tokens('skills')}) FROM corpus))"
Q_LEGS = f"{Q_IX}, {Q_DOCTERM}, bm AS ({q_top(q_scores('ix'), V.DEPTH)}), se AS ({q_top(Q_SETC, V.DEPTH)})"
Q_FUSED = f"""{Q_LEGS}, fused0 AS (
  SELECT query_id, chunk_id, round(sum(1.0 / ({V.RRF_K} + rank)), 9) AS rrf_score, count(*) AS sources, min(rank) AS best_rank,
    max(CASE WHEN leg = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN leg = 'bm25' THEN score END) AS bm25_score, max(CASE WHEN leg = 'semantic' THEN rank END) AS semantic_rank, max(CASE WHEN leg = 'semantic' THEN score END) AS semantic_score,
    string_agg(leg, '+' ORDER BY leg) AS trace
  FROM (SELECT *, 'bm25' AS leg FROM bm UNION ALL SELECT *, 'semantic' FROM se) GROUP BY query_id, chunk_id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, sources DESC, best_rank, chunk_id) AS INT) AS fused_rank FROM fused0 QUALIFY fused_rank <= {V.DEPTH})"""
_ORDERED = sorted(V.QUERY_SKILLS, key=lambda s: (-len(s), s))
_FEW = "list_filter(string_split(regexp_extract(q, '([a-z ]+\\b{w})', 1), ' '), lambda w: w <> '')"
_ROLE = "CASE " + " ".join(f"WHEN regexp_extract(q, '([a-z ]+\\b{w})', 1) <> '' THEN array_to_string(list_slice({_FEW.format(w=w)}, greatest(1, len({_FEW.format(w=w)}) - 3), len({_FEW.format(w=w)})), ' ')" for w in V.QUERY_ROLES) + " END"
_CITY = "regexp_extract(q, '\\b(" + "|".join(sorted(V.QUERY_CITIES)) + ")\\b', 1)"
Q_READ = f"""qread AS (SELECT *, list_filter(list_filter(list_filter(skills, lambda s: NOT list_contains({_v(V.QUERY_LANGUAGES)}, s)), lambda s: NOT list_contains({_v(V.QUERY_FRAMEWORKS)}, s)), lambda s: NOT list_contains({_v(V.QUERY_TOOLS)}, s)) AS technologies,
  list_filter(skills, lambda s: list_contains({_v(V.QUERY_LANGUAGES)}, s)) AS languages, list_filter(skills, lambda s: list_contains({_v(V.QUERY_FRAMEWORKS)}, s)) AS frameworks, list_filter(skills, lambda s: list_contains({_v(V.QUERY_TOOLS)}, s)) AS tools
  FROM (SELECT query_id, query, intent, source, entities, keywords, list_filter({_v(_ORDERED)}, lambda s: contains(q, s)) AS skills, {_ROLE} AS role, CASE WHEN {_CITY} = '' THEN NULL WHEN {_CITY} = 'bangalore' THEN 'bengaluru' ELSE {_CITY} END AS city,
    CASE WHEN regexp_matches(q, '{"|".join(V.PROFILE_WORDS)}') THEN 'profile_search' WHEN regexp_matches(q, '{"|".join(V.JOB_WORDS)}') THEN CASE WHEN regexp_matches(q, 'jd|description') THEN 'jd_search' ELSE 'job_search' END ELSE 'profile_search' END AS predicted_intent
    FROM (SELECT *, lower(query) AS q FROM bench)))"""
Q_SEEDS = """qseed0 AS (SELECT query_id, list_filter(flatten([[role], skills, technologies, tools, frameworks, languages]), lambda x: x IS NOT NULL) AS xs FROM qread),
qseed AS (SELECT query_id, entity, pos FROM (SELECT query_id, unnest(ys) AS entity, generate_subscripts(ys, 1) - 1 AS pos FROM (SELECT query_id, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS ys FROM qseed0)))"""


def q_class(x: str) -> str:
    T = V.TERMS
    y = f"lower({x})"
    parts = [(k, f"list_contains({_v(T[k])}, {y})") for k in ("ProgrammingLanguage", "Framework", "Database", "CloudPlatform", "Tool")]
    parts += [("Certification", f"(list_contains({_v(T['Certification'])}, {y}) OR regexp_matches({y}, 'certification|certified'))"), ("SoftSkill", f"list_contains({_v(T['SoftSkill'])}, {y})")]
    parts += [("Role", f"(list_contains({_v(T['Role'])}, {y}) OR regexp_matches({y}, '{'|'.join(V.ROLE_WORDS)}'))"), ("Education", f"regexp_matches({y}, '{'|'.join(V.EDUCATION_WORDS)}')")]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in parts) + " ELSE 'Skill' END"


_MEMBERS = [(i, s, V.PARTS[p], n) for i, (s, parts) in enumerate(V.STACKS.items()) for p, ns in parts.items() for n in ([ns] if isinstance(ns, str) else ns)]
Q_ONTO = f"""member AS (SELECT * FROM (VALUES {_rows(_MEMBERS)}) t(stack_no, stack, type, name)), rule AS (SELECT * FROM (VALUES {_rows(V.RULES)}) t(source_type, target_type, relation, confidence)),
edge AS (SELECT a.name AS source, b.name AS target, a.type AS source_type, b.type AS target_type, relation, CAST(confidence AS DOUBLE) AS confidence, a.stack, CAST(round(confidence * 100) AS BIGINT) AS weight
  FROM member a JOIN member b ON a.stack = b.stack JOIN rule r ON r.source_type = a.type AND r.target_type = b.type
  WHERE NOT (a.type || '>' || b.type IN ('Framework>Skill', 'Skill>Framework')) OR a.stack IN (SELECT stack FROM member WHERE type = 'ProgrammingLanguage')
  QUALIFY row_number() OVER (PARTITION BY a.name, b.name, relation ORDER BY confidence DESC, a.stack_no) = 1)"""
Q_EXPAND = f"""firm AS (SELECT source, target, max(confidence) AS confidence FROM edge WHERE confidence >= {V.MIN_CONFIDENCE} AND target_type <> 'SoftSkill' GROUP BY ALL),
hop1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, pc DESC, entity) AS turn FROM (
  SELECT s.query_id, f.target AS entity, f.confidence AS pc, [f.source, f.target] AS path, s.pos FROM (SELECT query_id, entity, min(pos) AS pos FROM qseed WHERE NOT list_contains({_v(V.TERMS['SoftSkill'])}, entity) GROUP BY ALL) s JOIN firm f ON s.entity = f.source
  WHERE NOT EXISTS (SELECT 1 FROM qseed x WHERE x.query_id = s.query_id AND x.entity = f.target) QUALIFY row_number() OVER (PARTITION BY s.query_id, f.target ORDER BY s.pos, f.confidence DESC) = 1)),
hop2 AS (SELECT h.query_id, f.target AS entity, h.pc * f.confidence AS pc, list_append(h.path, f.target) AS path, h.turn FROM hop1 h JOIN firm f ON h.entity = f.source
  WHERE NOT EXISTS (SELECT 1 FROM qseed x WHERE x.query_id = h.query_id AND x.entity = f.target) AND NOT EXISTS (SELECT 1 FROM hop1 y WHERE y.query_id = h.query_id AND y.entity = f.target)
  QUALIFY row_number() OVER (PARTITION BY h.query_id, f.target ORDER BY h.turn, f.confidence DESC) = 1),
expansion AS (SELECT query_id, entity, hop, path, path_confidence, CAST(row_number() OVER (PARTITION BY query_id ORDER BY path_confidence DESC, hop, turn, entity) AS INT) AS rank
  FROM (SELECT query_id, entity, 1 AS hop, path, round(pc, 6) AS path_confidence, turn FROM hop1 UNION ALL SELECT query_id, entity, 2, path, round(pc, 6), turn FROM hop2) QUALIFY rank <= {V.EXPANSION_LIMIT})"""
Q_GRAPH = f"WITH {Q_BENCH}, {Q_READ}, {Q_SEEDS}, {Q_ONTO}, {Q_EXPAND}"

# ---- queries ----------------------------------------------------------------------------------


def corpus(s: SparkSession, d: str) -> DataFrame:
    """(chunk_id, source, text, title, skills): postings, profiles and descriptions as retrieval units."""
    a = one_per_key(table(s, d, "demands"), "id", "job_text", "job_title", "all_skills").select(F.concat(F.lit("demand_"), "id").alias("chunk_id"), F.lit("demand").alias("source"), F.col("job_text").alias("text"), F.col("job_title").alias("title"), F.col("all_skills").alias("skills"))
    p = one_per_key(table(s, d, "profiles"), "id", "potential_roles", "all_skills", "skill_summary")
    b = p.select(F.concat(F.lit("profile_"), "id").alias("chunk_id"), F.lit("profile").alias("source"), F.concat_ws(" ", "potential_roles", "all_skills", "skill_summary").alias("text"), F.col("potential_roles").alias("title"), F.col("all_skills").alias("skills"))
    c = one_per_key(table(s, d, "jd_cleaned"), "jd_id", "job_text", "job_title").select(F.concat(F.lit("jd_"), "jd_id").alias("chunk_id"), F.lit("jd").alias("source"), F.col("job_text").alias("text"), F.col("job_title").alias("title"), F.lit(None).cast("string").alias("skills"))
    return a.unionByName(b).unionByName(c)


@dataclass
class Prepared:
    """What every search of a data directory reads: written once, then only read."""

    corpus: DataFrame
    index: R.Index
    titles: R.Index
    sets: DataFrame
    ranked: DataFrame | None = None  # of the benchmark, once a report asked for it


_HELD: dict[tuple, Prepared] = {}


def prepared(s: SparkSession, d: str) -> Prepared:
    """The corpus and its indexes as written tables, for as long as the session lives and the sources do not change.

    The key holds the sources' files with their times and sizes, so changed tables are indexed anew.
    """
    fs_of = s._jvm.org.apache.hadoop.fs.Path
    files = tuple(f for n in ("demands", "profiles", "jd_cleaned") for f in table(s, d, n).inputFiles())
    states = [fs_of(f).getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(fs_of(f)) for f in files]
    key = (s.sparkContext.applicationId, files, tuple((x.getModificationTime(), x.getLen()) for x in states))
    if key not in _HELD:
        c = written(corpus(s, d), "corpus")
        index = R.write_index(R.index(c))
        _HELD[key] = Prepared(c, index, R.write_index(R.index(c, "title")), R.write_postings(R.sets(c)))
    return _HELD[key]


def _ix(s, d):
    return prepared(s, d).index


def legs(s: SparkSession, d: str) -> dict[str, DataFrame]:
    q, x = U.benchmark(s), prepared(s, d)
    return {"bm25": R.bm25(x.index, q), "semantic": R.set_cosine(x.sets, q)}


def fused(s: SparkSession, d: str) -> DataFrame:
    return R.fuse(legs(s, d))


def _reading(s):
    """The benchmark's queries read, their seeds and expansions, each written because several steps use them."""
    read = written(U.understand(U.benchmark(s)), "read")
    seeds = written(U.seeds(read), "seeds")
    return read, seeds, written(G.expand(seeds, G.ontology_edges(s)), "expansion")


def ranked(s: SparkSession, d: str) -> DataFrame:
    """The whole pipeline up to graph-aware ranking: both legs, fusion, evidence, combined score; written once for all reports."""
    held = prepared(s, d)
    if held.ranked is not None:
        return held.ranked
    read, seeds, expansion = _reading(s)
    docs = held.corpus
    # the top k are written before texts and skills join them: the smaller side of those joins is then known
    top = written(fused(s, d), "fused")
    rows = top.join(docs.select("chunk_id", "text"), "chunk_id").join(read.select("query_id", "query"), "query_id")
    own = top.select("chunk_id").distinct().join(docs.select("chunk_id", "skills"), "chunk_id").select("chunk_id", A.split_keep(F.col("skills")).alias("skills"))
    held.ranked = written(K.combine(K.evidence(rows, own, seeds, expansion)), "ranked")
    return held.ranked


def stages(s: SparkSession, d: str) -> DataFrame:
    """Judged results of all stages, written once because several reports read them."""
    r = ranked(s, d)
    per = {"bm25": "bm25_rank", "semantic": "semantic_rank", "rrf": "fused_rank", "graph": "graph_rank"}
    long = r.select("query_id", "chunk_id", "text", F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(c).alias("rank")) for n, c in per.items()])).alias("x")).select("query_id", "chunk_id", "text", "x.stage", "x.rank")
    return written(E.judged(long.where("rank IS NOT NULL"), U.benchmark(s)).select("stage", "query_id", "chunk_id", "rank", "relevant", "hits", "keywords"), "judged")


def metric_rows(s: SparkSession, d: str) -> DataFrame:
    return E.metrics(stages(s, d))


def _edges(s, d) -> DataFrame:
    return G.candidate_edges(P.profiles(s, d)).unionByName(G.demand_edges(P.demands(s, d))).unionByName(G.description_edges(P.descriptions(s, d)))


def _embeddings(s, d) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select(F.col(e.columns[0]).cast("long").alias("id"), R.unit(F.col("embedding")).alias("vec"))


def _explained(s, d) -> DataFrame:
    _, _, expansion = _reading(s)
    x = K.explain(written(K.rerank(ranked(s, d)), "reranked"), expansion)
    return x.select("query_id", "chunk_id", "final_rank", "combined_score", "explanation.quality_label", "explanation.summary", F.size("explanation.paths").alias("paths"))


def _moves(s, d) -> DataFrame:
    r = ranked(s, d)
    return E.rank_moves(r.select("query_id", "chunk_id", F.col("fused_rank").alias("rank")), r.select("query_id", "chunk_id", F.col("graph_rank").alias("rank")))


def _errors(s, d) -> DataFrame:
    read, seeds, _ = _reading(s)
    return E.errors(E.understanding(read, seeds), metric_rows(s, d)).groupBy("category").agg(F.count(F.lit(1)).alias("queries"))


QUERIES = {
    "hybrid_explained": _explained,
    "term_df_top": lambda s, d: _ix(s, d).frequencies.orderBy(F.desc("df"), "source", "term").limit(50),
    "collection_stats": lambda s, d: _ix(s, d).collection.select("source", "n", F.round("avgdl", 6).alias("avgdl")),
    "bm25_batch": lambda s, d: R.bm25(_ix(s, d), U.benchmark(s)),
    "bm25_multifield": lambda s, d: R.bm25_fields({"text": (_ix(s, d), 3.0), "title": (prepared(s, d).titles, 2.0)}, U.benchmark(s)),
    "set_cosine_batch": lambda s, d: R.set_cosine(prepared(s, d).sets, U.benchmark(s)),
    "dense_knn": lambda s, d: R.exact_vectors(_embeddings(s, d), _embeddings(s, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec"), 10, len(table(s, d, "embeddings").select("embedding").first()[0])),
    "l2_norms": lambda s, d: _embeddings(s, d).select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2")),
    "rrf_fuse": lambda s, d: fused(s, d),
    "rrf_enriched": lambda s, d: fused(s, d).where("fused_rank <= 10").join(prepared(s, d).corpus.select("chunk_id", "source", "title"), "chunk_id", "left").select("query_id", "chunk_id", "fused_rank", "source", "title"),
    "highlights": lambda s, d: R.bm25(_ix(s, d), U.benchmark(s), 5).join(U.benchmark(s).select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("terms")), "query_id").join(prepared(s, d).corpus.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", X.highlight(F.col("text"), F.col("terms")).alias("highlight")),
    "benchmark_bootstrap": lambda s, d: U.benchmark(s).select("query_id", "query", "intent", "source", F.array_join("entities", "|").alias("entities"), F.array_join("keywords", "|").alias("keywords")),
    "query_parse": lambda s, d: U.understand(U.benchmark(s)).select("query_id", F.array_join("skills", "|").alias("skills"), F.array_join("technologies", "|").alias("technologies"), F.array_join("languages", "|").alias("languages"), F.array_join("frameworks", "|").alias("frameworks"), F.array_join("tools", "|").alias("tools"), "role", "city", "country", "predicted_intent"),
    "query_seeds": lambda s, d: U.seeds(U.understand(U.benchmark(s))).select("query_id", "entity", F.col("pos").cast("long").alias("pos")),
    "entity_classify": lambda s, d: P.demands(s, d).select(F.explode("all_skills").alias("name")).unionByName(P.demands(s, d).select(F.col("job_title").alias("name"))).where("name <> ''").distinct().select("name", A.entity_class(F.col("name")).alias("type")),
    "ontology_edges": lambda s, d: G.ontology_edges(s),
    "ontology_counts": lambda s, d: G.ontology_edges(s).groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("edges")),
    "expand_2hop": lambda s, d: _reading(s)[2].select("query_id", "entity", "hop", F.array_join("path", ">").alias("path"), "path_confidence", "rank"),
    "expanded_query": lambda s, d: U.expanded_text(U.benchmark(s), _reading(s)[2]).select("query_id", "expanded_query"),
    "graph_edges": _edges,
    "graph_nodes": lambda s, d: G.nodes(_edges(s, d)),
    "candidate_skills": lambda s, d: G.candidate_edges(P.profiles(s, d)).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("skills")),
    "node_degree_top": lambda s, d: G.degrees(G.ontology_edges(s)).orderBy(F.desc("degree"), "source").limit(20),
    "edge_top": lambda s, d: G.ontology_edges(s).where("source < target").select("source", "target", "relation", "weight").orderBy(F.desc("weight"), "source", "target", "relation").limit(20),
    "components": lambda s, d: G.labels(_edges(s, d).select(F.concat_ws(":", "src_label", "src").alias("source"), F.concat_ws(":", "dst_label", "dst").alias("target"))),
    "schema_summary": lambda s, d: _edges(s, d).groupBy("src_label", "relation", "dst_label").agg(F.count(F.lit(1)).alias("edges")),
    "graph_rank": lambda s, d: ranked(s, d).select("query_id", "chunk_id", "fused_rank", F.array_join("direct", "|").alias("direct"), F.array_join("neighbours", "|").alias("neighbours"), "graph_rel_score", "graph_text_score", "graph_score", "final_score", "graph_rank"),
    "quality_labels": lambda s, d: ranked(s, d).groupBy(K.quality_label(F.col("final_score")).alias("label")).agg(F.count(F.lit(1)).alias("results")),
    "rerank_hook": lambda s, d: K.rerank(ranked(s, d), lambda: F.col("graph_score") * 4 - 2).select("query_id", "chunk_id", "ce_normal", "combined_score", "final_rank"),
    "metrics_by_stage": metric_rows,
    "stage_summary": lambda s, d: E.stage_summary(metric_rows(s, d)),
    "stage_winners": lambda s, d: E.winners(metric_rows(s, d), ["bm25", "semantic", "rrf", "graph"]),
    "rank_moves": _moves,
    "error_classes": _errors,
    "understanding_scores": lambda s, d: E.understanding(*_reading(s)[:2]),
    "expansion_rows": lambda s, d: E.expansion_rows(_reading(s)[2], U.benchmark(s)),
    "expansion_scores": lambda s, d: E.expansion_scores(E.expansion_rows(_reading(s)[2], U.benchmark(s)), U.benchmark(s)),
    "unrelated_producers": lambda s, d: E.unrelated_producers(E.expansion_rows(_reading(s)[2], U.benchmark(s))),
    "graph_contribution": lambda s, d: E.graph_contribution(ranked(s, d)),
    "acceptance": lambda s, d: E.acceptance(E.expansion_scores(E.expansion_rows(_reading(s)[2], U.benchmark(s)), U.benchmark(s)), E.stage_summary(metric_rows(s, d)), E.graph_contribution(ranked(s, d))),
    "quality_profile": lambda s, d: Q.profile(table(s, d, "demands"), _DQ),
    "repeated_rows": lambda s, d: Q.repeated_rows(table(s, d, "demands").select("id", "job_title", "experience_lower", "experience_upper", "loaded_at"), "id"),
    "json_validity": lambda s, d: Q.json_validity(table(s, d, "jd_cleaned"), ["must_have_skills", "tools", "education", "job_title"]),
    "value_counts": lambda s, d: Q.value_counts(table(s, d, "documents"), "doc_kind"),
    "top_skills": lambda s, d: Q.top_values(table(s, d, "demands"), ["primary_skills", "secondary_skills"]),
}

_RANKED = f"""{Q_FUSED}, {Q_READ}, {Q_SEEDS}, {Q_ONTO}, {Q_EXPAND},
chunkskill AS (SELECT chunk_id, list_filter(sk, lambda x, i: list_position(sk, x) = i) AS skills FROM (SELECT chunk_id, {P.q_split('skills', True)} AS sk FROM corpus)),
seedset AS (SELECT query_id, list_sort(list(DISTINCT entity)) AS seeds FROM qseed GROUP BY ALL),
relset AS (SELECT query_id, list_sort(list(entity)) AS rel FROM expansion GROUP BY ALL),
ev0 AS (SELECT f.query_id, f.chunk_id, f.fused_rank, f.rrf_score, f.bm25_rank, f.semantic_rank, c.text, c.skills AS raw, k.skills, coalesce(s.seeds, CAST([] AS VARCHAR[])) AS seeds, coalesce(r.rel, CAST([] AS VARCHAR[])) AS rel,
  lower(concat_ws(' ', c.text, array_to_string(k.skills, ' '))) AS doc
  FROM fused f JOIN corpus c ON f.chunk_id = c.chunk_id JOIN chunkskill k ON f.chunk_id = k.chunk_id LEFT JOIN seedset s ON f.query_id = s.query_id LEFT JOIN relset r ON f.query_id = r.query_id),
ev1 AS (SELECT *, list_filter(seeds, lambda x: list_contains(skills, x)) AS direct, list_filter(rel, lambda x: list_contains(skills, x) AND NOT list_contains(seeds, x)) AS neighbours,
  list_filter(seeds, lambda x: contains(doc, x)) AS ms, list_filter(rel, lambda x: contains(doc, x)) AS me FROM ev0),
conf AS (SELECT query_id, chunk_id, sum(path_confidence) AS pc FROM (SELECT query_id, chunk_id, unnest(neighbours) AS entity FROM ev1) JOIN expansion USING (query_id, entity) GROUP BY ALL),
onto AS (SELECT chunk_id, avg(CASE WHEN ty IN ('ProgrammingLanguage', 'Framework', 'Tool', 'Database', 'CloudPlatform', 'Skill') THEN 1.0 ELSE 0.0 END) AS o FROM (SELECT chunk_id, {q_class('x')} AS ty FROM (SELECT chunk_id, unnest(skills) AS x FROM chunkskill)) GROUP BY ALL),
ev2 AS (SELECT e.*, CASE WHEN len(skills) > 0 AND len(seeds) > 0 THEN round(0.30 * o + 0.25 * coalesce(pc, 0) / greatest(len(neighbours), 1) + 0.25 * least((len(direct) + len(neighbours)) / greatest(len(seeds), 1), 1.0) + 0.20 * coalesce(pc, 0) / greatest(len(neighbours), 1), 6) ELSE 0.0 END AS graph_rel_score,
  round(CASE WHEN len(seeds) > 0 AND len(rel) > 0 THEN 0.7 * len(ms) / len(seeds) + 0.3 * len(me) / len(rel) WHEN len(seeds) > 0 THEN len(ms) / len(seeds) WHEN len(rel) > 0 THEN len(me) / len(rel) ELSE 0.0 END, 6) AS graph_text_score
  FROM ev1 e LEFT JOIN conf c ON e.query_id = c.query_id AND e.chunk_id = c.chunk_id LEFT JOIN onto o ON e.chunk_id = o.chunk_id),
ev3 AS (SELECT *, round({V.TEXT_WEIGHT} * graph_text_score + {V.REL_WEIGHT} * graph_rel_score, 6) AS graph_score FROM ev2),
ev4 AS (SELECT *, round({V.RRF_WEIGHT} * least(rrf_score / (2.0 / {V.RRF_K + 1}), 1.0) + {V.GRAPH_WEIGHT} * graph_score, 6) AS final_score FROM ev3),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, fused_rank) AS INT) AS graph_rank FROM ev4)"""
_METRICS = f"""{_RANKED}, long AS (SELECT query_id, chunk_id, text, stage, rank FROM (
  SELECT query_id, chunk_id, text, 'bm25' AS stage, bm25_rank AS rank FROM ranked UNION ALL SELECT query_id, chunk_id, text, 'semantic', semantic_rank FROM ranked
  UNION ALL SELECT query_id, chunk_id, text, 'rrf', fused_rank FROM ranked UNION ALL SELECT query_id, chunk_id, text, 'graph', graph_rank FROM ranked) WHERE rank IS NOT NULL),
hit AS (SELECT l.*, keywords, list_filter(keywords, lambda k: contains(lower(coalesce(text, '')), k)) AS hits FROM long l JOIN bench b ON l.query_id = b.query_id),
judged AS (SELECT *, CASE WHEN len(hits) >= greatest(1, ceil(0.35 * len(keywords))) THEN 1 ELSE 0 END AS relevant FROM hit),
byk AS (SELECT stage, query_id, k, sum(CASE WHEN rank <= k THEN relevant ELSE 0 END) AS top, sum(relevant) AS every, min(CASE WHEN relevant = 1 THEN rank END) AS first,
  sum(CASE WHEN rank <= k THEN relevant / log2(rank + 1.0) ELSE 0.0 END) AS dcg, len(list_distinct(flatten(list(CASE WHEN rank <= k THEN hits ELSE CAST([] AS VARCHAR[]) END)))) AS found, max(len(keywords)) AS kw
  FROM judged, (VALUES (5), (10), (20)) t(k) GROUP BY ALL),
ideal AS (SELECT n, (SELECT sum(1 / log2(i + 1.0)) FROM range(1, n + 1) t(i)) AS v FROM range(1, 21) r(n)),
metric AS (SELECT stage, query_id, CAST(k AS BIGINT) AS k, round(top / k, 6) AS precision, least(1.0, round(top / greatest(every, 1), 6)) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
  round(coalesce(dcg / (SELECT v FROM ideal WHERE n = least(k, every)), 0), 6) AS ndcg, round(coalesce(dcg / (SELECT v FROM ideal WHERE n = top), 0), 6) AS ndcg_top, round(found / kw, 6) AS coverage FROM byk)"""
_EDGES = f"""WITH {P.Q_PK}, {P.Q_PROFILES}, {P.Q_DEMANDS}, {P.Q_JD}, gedge AS (
  SELECT DISTINCT 'Candidate' AS src_label, src, CASE dst_label WHEN 'Framework' THEN 'USES_FRAMEWORK' WHEN 'Tool' THEN 'USES_TOOL' WHEN 'Database' THEN 'USES_DATABASE' WHEN 'CloudPlatform' THEN 'USES_CLOUD' WHEN 'Certification' THEN 'CERTIFIED_IN' ELSE 'HAS_SKILL' END AS relation, dst_label, dst, CASE WHEN dst_label = 'SoftSkill' THEN 0.55 ELSE 0.85 END AS confidence
  FROM (SELECT id AS src, dst, {q_class('dst')} AS dst_label FROM (SELECT id, unnest(all_skills) AS dst FROM clean_profiles))
  UNION ALL SELECT DISTINCT 'Candidate', id, 'WORKED_AS', 'Role', dst, 0.70 FROM (SELECT id, unnest(roles) AS dst FROM clean_profiles) WHERE {q_class('dst')} = 'Role'
  UNION ALL SELECT 'Demand', id, 'MATCHES_ROLE', 'Role', job_title, 0.82 FROM clean_demands WHERE job_title <> '' AND {q_class('job_title')} = 'Role'
  UNION ALL SELECT 'Demand', id, 'LOCATED_IN', 'Location', string_split(location, ', ')[1], 0.95 FROM clean_demands WHERE location <> ''
  UNION ALL SELECT 'Demand', src, CASE dst_label WHEN 'Framework' THEN 'REQUIRES_FRAMEWORK' WHEN 'Tool' THEN 'REQUIRES_TOOL' WHEN 'Database' THEN 'REQUIRES_DATABASE' WHEN 'CloudPlatform' THEN 'REQUIRES_CLOUD' WHEN 'Certification' THEN 'REQUIRES_CERTIFICATION' ELSE 'REQUIRES_SKILL' END, dst_label, dst, 0.88
  FROM (SELECT id AS src, dst, {q_class('dst')} AS dst_label FROM (SELECT id, unnest(all_skills) AS dst FROM clean_demands))
  UNION ALL SELECT 'JobDescription', jd_id, 'MATCHES_ROLE', 'Role', job_title, 0.82 FROM jd WHERE job_title <> '' AND {q_class('job_title')} = 'Role'
  UNION ALL SELECT 'JobDescription', jd_id, 'BELONGS_TO_DOMAIN', 'Domain', industry, 0.90 FROM jd WHERE industry <> ''
  UNION ALL SELECT 'JobDescription', src, CASE dst_label WHEN 'Framework' THEN 'REQUIRES_FRAMEWORK' WHEN 'Tool' THEN 'REQUIRES_TOOL' WHEN 'Database' THEN 'REQUIRES_DATABASE' WHEN 'CloudPlatform' THEN 'REQUIRES_CLOUD' WHEN 'Certification' THEN 'REQUIRES_CERTIFICATION' ELSE 'REQUIRES_SKILL' END AS relation, dst_label, dst, max(confidence)
  FROM (SELECT jd_id AS src, dst, confidence, {q_class('dst')} AS dst_label FROM ({' UNION ALL '.join(f"SELECT jd_id, unnest(list_filter({f}, lambda x: length(x) <= 80)) AS dst, {c} AS confidence FROM jd" for f, c in V.JD_CONFIDENCE.items())})) GROUP BY src, relation, dst_label, dst)"""
_BX, _BT = q_scores("ix", 1.2), q_scores("it", 1.2)
_FUSED_COLUMNS = "query_id, chunk_id, rrf_score, sources, best_rank, bm25_rank, bm25_score, semantic_rank, semantic_score, trace, fused_rank"
_LABEL = "CASE WHEN final_score >= 0.80 THEN 'excellent' WHEN final_score >= 0.60 THEN 'strong' WHEN final_score >= 0.40 THEN 'moderate' WHEN final_score >= 0.20 THEN 'partial' ELSE 'weak' END"
_CE = "round(1 / (1 + pow(2.718281828, -(graph_score * 4 - 2))), 6)"
_PART = lambda label, c: f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}[1:5], ', ') END"
_PARTS = f"concat_ws(' | ', {_PART('Directly matched', 'ms')}, {_PART('Graph-expanded matches', 'me')}, {_PART('Graph relationship direct matches', 'direct')}, {_PART('Graph relationship neighbour matches', 'neighbours')})"
_MISS = "list_sort(list_filter(entities, lambda x: NOT list_contains(got, x)))"
_WRONG = "list_sort(list_filter(got, lambda x: NOT list_contains(entities, x)))"
Q_UNDER = f"""under AS (SELECT query_id, CASE WHEN intent = predicted_intent THEN 1 ELSE 0 END AS intent_correct, round(b / greatest(len(got), 1), 6) AS entity_precision, round(b / greatest(len(entities), 1), 6) AS entity_recall, array_to_string({_MISS}, ', ') AS missing, array_to_string({_WRONG}, ', ') AS incorrect
  FROM (SELECT q.*, coalesce(s.got, CAST([] AS VARCHAR[])) AS got, len(list_filter(entities, lambda x: list_contains(coalesce(s.got, CAST([] AS VARCHAR[])), x))) AS b FROM qread q LEFT JOIN (SELECT query_id, list(DISTINCT entity) AS got FROM qseed GROUP BY ALL) s ON q.query_id = s.query_id))"""
_TERMS = "list_concat(entities, keywords)"
Q_XROWS = f"xrow AS (SELECT x.query_id, path[-2] AS source, entity, hop, CASE WHEN len(list_filter({_TERMS}, lambda t: contains(entity, t) OR contains(t, entity))) > 0 THEN 1 ELSE 0 END AS useful, CASE WHEN {q_class('entity')} = 'SoftSkill' OR path_confidence < {V.MIN_CONFIDENCE} THEN 1 ELSE 0 END AS noisy FROM expansion x JOIN bench b ON x.query_id = b.query_id)"
_XSCORES = "SELECT b.query_id, coalesce(size, 0) AS size, round(coalesce(p, 0), 6) AS precision, round(coalesce(1 - p, 0), 6) AS noise_ratio FROM bench b LEFT JOIN (SELECT query_id, count(*) AS size, avg(useful) AS p FROM xrow GROUP BY ALL) g ON b.query_id = g.query_id"
_CONTRIB = f"SELECT query_id, count(*) FILTER (final_score > 1.05 * rrf_score) AS improved, count(*) FILTER (final_score < 0.95 * rrf_score) AS hurt, sum(CAST(round(graph_score * 1e6) AS BIGINT)) / (count(*) * 1e6) AS mean_graph, sum(CAST(round(rrf_score * 1e9) AS BIGINT)) / (count(*) * 1e9) AS mean_rrf, sum(CAST(round(final_score * 1e6) AS BIGINT)) / (count(*) * 1e6) AS mean_final FROM ranked WHERE graph_rank <= {V.FINAL} GROUP BY query_id"
_AT10 = "SELECT " + ", ".join(f"coalesce(avg(CASE WHEN stage = '{x}' THEN precision END), 0) AS {x}" for x in ("bm25", "semantic", "rrf", "graph")) + " FROM metric WHERE k = 10"
_CHECKS = [("expansion precision at least 0.5", "ep >= 0.5"), ("expansion noise at most 0.5", "en <= 0.5"), ("bm25 contributes", "bm25 > 0"), ("semantic contributes", "semantic > 0"), ("graph does not hurt", "graph >= 0.98 * rrf"), ("graph improves more than it hurts", "down < up")]
_DQ = ["id", "account_code", "job_title", "primary_skills", "secondary_skills", "all_skills", "city", "country", "experience_lower", "experience_upper", "job_text", "posted_at", "loaded_at"]

_UNIT = """e AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), l AS MATERIALIZED (SELECT id, e, sqrt(list_inner_product(e, e)) AS len FROM e),
n AS MATERIALIZED (SELECT id, list_transform(e, lambda x: x / len) AS v FROM l)"""

SQL = {
    "hybrid_explained": f"{_RANKED} SELECT query_id, chunk_id, graph_rank AS final_rank, final_score AS combined_score, {_LABEL} AS quality_label, 'This result has a ' || {_LABEL} || ' relevance to your query ''' || query || '''. ' || CASE WHEN {_PARTS} <> '' THEN {_PARTS} ELSE 'No direct or expanded entity matches found.' END || '.' AS summary, CAST(least(len(me), 10) AS INT) AS paths FROM ranked JOIN bench USING (query_id) WHERE graph_rank <= {V.FINAL}",
    "term_df_top": f"{Q_IX} SELECT source, term, df FROM ix_df ORDER BY df DESC, source, term LIMIT 50",
    "collection_stats": f"{Q_IX} SELECT source, n, round(avgdl, 6) AS avgdl FROM ix_n",
    "bm25_batch": f"{Q_IX} {q_top(q_scores('ix'), V.DEPTH)}",
    "bm25_multifield": f"{Q_IX}, {q_index('it', 'title')} {q_top(f'SELECT query_id, chunk_id, round(max(score), 6) AS score FROM (SELECT query_id, chunk_id, score * 3.0 AS score FROM ({_BX}) UNION ALL SELECT query_id, chunk_id, score * 2.0 FROM ({_BT})) GROUP BY ALL', V.DEPTH)}",
    "set_cosine_batch": f"{Q_IX}, {Q_DOCTERM} {q_top(Q_SETC, V.DEPTH)}",
    "dense_knn": f"WITH {_UNIT} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM (SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v), 6) AS score FROM (SELECT * FROM n WHERE id % 20 = 0) a, n b WHERE a.id <> b.id) QUALIFY rank <= 10",
    "l2_norms": f"WITH {_UNIT} SELECT id, round(list_inner_product(v, v), 6) AS norm2 FROM n",
    "rrf_fuse": f"{Q_FUSED} SELECT {_FUSED_COLUMNS} FROM fused",
    "rrf_enriched": f"{Q_FUSED} SELECT query_id, f.chunk_id, fused_rank, c.source, title FROM fused f JOIN corpus c ON f.chunk_id = c.chunk_id WHERE fused_rank <= 10",
    "benchmark_bootstrap": f"WITH {Q_BENCH} SELECT query_id, query, intent, source, array_to_string(entities, '|') AS entities, array_to_string(keywords, '|') AS keywords FROM bench",
    "query_parse": f"WITH {Q_BENCH}, {Q_READ} SELECT query_id, array_to_string(skills, '|') AS skills, array_to_string(technologies, '|') AS technologies, array_to_string(languages, '|') AS languages, array_to_string(frameworks, '|') AS frameworks, array_to_string(tools, '|') AS tools, role, city, CASE WHEN city IS NOT NULL THEN 'india' END AS country, predicted_intent FROM qread",
    "query_seeds": f"WITH {Q_BENCH}, {Q_READ}, {Q_SEEDS} SELECT query_id, entity, CAST(pos AS BIGINT) AS pos FROM qseed",
    "entity_classify": f"WITH {P.Q_DEMANDS} SELECT name, {q_class('name')} AS type FROM (SELECT DISTINCT name FROM (SELECT unnest(all_skills) AS name FROM clean_demands UNION ALL SELECT job_title FROM clean_demands) WHERE name <> '')",
    "ontology_edges": f"WITH {Q_ONTO} SELECT * FROM edge",
    "ontology_counts": f"WITH {Q_ONTO} SELECT source_type, target_type, count(*) AS edges FROM edge GROUP BY ALL",
    "expand_2hop": f"{Q_GRAPH} SELECT query_id, entity, hop, array_to_string(path, '>') AS path, path_confidence, rank FROM expansion",
    "expanded_query": f"{Q_GRAPH} SELECT b.query_id, trim(concat_ws(' ', query, array_to_string(list_filter(coalesce(x.xs, CAST([] AS VARCHAR[])), lambda e: NOT list_contains(string_split(query, ' '), e)), ' '))) AS expanded_query FROM bench b LEFT JOIN (SELECT query_id, list(entity ORDER BY rank) AS xs FROM expansion GROUP BY ALL) x ON b.query_id = x.query_id",
    "graph_edges": f"{_EDGES} SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM gedge",
    "graph_nodes": f"{_EDGES} SELECT src_label AS label, src AS name FROM gedge UNION SELECT dst_label, dst FROM gedge",
    "candidate_skills": f"{_EDGES} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), '|') AS skills FROM gedge WHERE src_label = 'Candidate' GROUP BY src",
    "node_degree_top": f"WITH {Q_ONTO} SELECT source, count(DISTINCT target) AS degree FROM edge GROUP BY ALL ORDER BY degree DESC, source LIMIT 20",
    "edge_top": f"WITH {Q_ONTO} SELECT source, target, relation, weight FROM edge WHERE source < target ORDER BY weight DESC, source, target, relation LIMIT 20",
    "schema_summary": f"{_EDGES} SELECT src_label, relation, dst_label, count(*) AS edges FROM gedge GROUP BY ALL",
    "graph_rank": f"{_RANKED} SELECT query_id, chunk_id, fused_rank, array_to_string(direct, '|') AS direct, array_to_string(neighbours, '|') AS neighbours, graph_rel_score, graph_text_score, graph_score, final_score, graph_rank FROM ranked",
    "quality_labels": f"{_RANKED} SELECT {_LABEL} AS label, count(*) AS results FROM ranked GROUP BY ALL",
    "rerank_hook": f"{_RANKED} SELECT query_id, chunk_id, ce_normal, combined_score, final_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, graph_rank) AS INT) AS final_rank FROM (SELECT *, {_CE} AS ce_normal, round(final_score + {V.CE_WEIGHT} * {_CE}, 6) AS combined_score FROM ranked WHERE graph_rank <= {V.POOL})) WHERE final_rank <= {V.FINAL}",
    "metrics_by_stage": f"{_METRICS} SELECT * FROM metric",
    "stage_summary": f"{_METRICS} SELECT stage, count(*) AS queries, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg, round(avg(coverage), 5) AS coverage FROM metric WHERE k = 10 GROUP BY stage",
    "stage_winners": f"{_METRICS} SELECT query_id, stage FROM metric WHERE k = 10 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, precision DESC, list_position(['bm25', 'semantic', 'rrf', 'graph'], stage)) = 1",
    "rank_moves": f"{_RANKED} SELECT query_id, CAST(count(*) FILTER (d > 0) AS BIGINT) AS moved_up, CAST(count(*) FILTER (d < 0) AS BIGINT) AS moved_down, round(avg(greatest(d, 0)), 5) AS gain, round(avg(least(d, 0)), 5) AS loss FROM (SELECT query_id, fused_rank - graph_rank AS d FROM ranked) GROUP BY query_id",
    "error_classes": f"{_METRICS}, {Q_UNDER}, at10 AS (SELECT query_id, " + ", ".join(f"coalesce(max(CASE WHEN stage = '{x}' THEN precision END), 0) AS {x}" for x in ("bm25", "semantic", "rrf", "graph")) + " FROM metric WHERE k = 10 GROUP BY ALL), j AS (SELECT u.*, " + ", ".join(f"coalesce(a.{x}, 0) AS {x}" for x in ("bm25", "semantic", "rrf", "graph")) + " FROM under u LEFT JOIN at10 a ON u.query_id = a.query_id) SELECT category, count(*) AS queries FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS category FROM j WHERE {c}" for n, c in [("Wrong intent", "intent_correct = 0"), ("Missing entity", "missing <> ''"), ("Hallucinated/incorrect entity", "incorrect <> ''"), ("Wrong BM25 retrieval", "bm25 = 0"), ("Weak semantic retrieval", "semantic = 0"), ("Poor RRF fusion", "rrf < greatest(bm25, semantic)"), ("Incorrect graph score", "graph < rrf")]) + ") GROUP BY category",
    "understanding_scores": f"WITH {Q_BENCH}, {Q_READ}, {Q_SEEDS}, {Q_UNDER} SELECT * FROM under",
    "expansion_rows": f"{Q_GRAPH}, {Q_XROWS} SELECT * FROM xrow",
    "expansion_scores": f"{Q_GRAPH}, {Q_XROWS} {_XSCORES}",
    "unrelated_producers": f"{Q_GRAPH}, {Q_XROWS} SELECT source, count(*) AS expansions FROM xrow WHERE useful = 0 GROUP BY source ORDER BY expansions DESC, source LIMIT 20",
    "graph_contribution": f"{_RANKED} {_CONTRIB}",
    "acceptance": f"{_METRICS}, {Q_XROWS}, one AS (SELECT * FROM (SELECT avg(precision) AS ep, avg(noise_ratio) AS en FROM ({_XSCORES})), ({_AT10}), (SELECT sum(improved) AS up, sum(hurt) AS down FROM ({_CONTRIB}))) " + " UNION ALL ".join(f"SELECT '{n}' AS criterion, {c} AS passed FROM one" for n, c in _CHECKS),
    "quality_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({P.q_squash(f'CAST({c} AS VARCHAR)')} = '' AND {c} IS NOT NULL) AS blanks, count(DISTINCT {c}) AS distinct_values FROM demands" for c in _DQ),
    "repeated_rows": "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT id, job_title, experience_lower, experience_upper, loaded_at FROM demands)) AS distinct_rows, count(DISTINCT id) AS distinct_keys, (SELECT count(*) FROM (SELECT id FROM demands WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) AS repeated_keys FROM demands",
    "json_validity": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS filled, count(*) FILTER (json_valid({c})) AS valid FROM jd_cleaned WHERE trim({c}) <> ''" for c in ("must_have_skills", "tools", "education", "job_title")),
    "value_counts": "SELECT doc_kind AS value, count(*) AS rows FROM documents GROUP BY doc_kind",
    "top_skills": f"SELECT value, count(*) AS rows FROM (SELECT {P.q_squash('v')} AS value FROM (SELECT unnest(string_split(coalesce(primary_skills, ''), ',')) AS v FROM demands UNION ALL SELECT unnest(string_split(coalesce(secondary_skills, ''), ',')) FROM demands)) WHERE value <> '' GROUP BY value ORDER BY rows DESC, value LIMIT 30",
}
# label propagation, unrolled: more rounds than the graph of documents, skills, roles and places is wide
_ROUNDS = 14
SQL["components"] = (
    f"{_EDGES}, pair AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT src_label || ':' || src AS a, dst_label || ':' || dst AS b FROM gedge UNION ALL SELECT dst_label || ':' || dst, src_label || ':' || src FROM gedge)), l0 AS MATERIALIZED (SELECT a AS node, least(a, min(b)) AS c FROM pair GROUP BY a)"
    + "".join(f", l{i} AS MATERIALIZED (SELECT x.node, least(x.c, min(y.c)) AS c FROM l{i - 1} x JOIN pair p ON x.node = p.a JOIN l{i - 1} y ON y.node = p.b GROUP BY x.node, x.c)" for i in range(1, _ROUNDS))
    + f" SELECT node, c AS component FROM l{_ROUNDS - 1}"
)
