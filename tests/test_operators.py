import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators import graph as G
from corvane.operators import preparation as P
from corvane.operators import quality as Q
from corvane.operators import querying as U
from corvane.operators import ranking as K
from corvane.operators import retrieval as R
from corvane.sources import files
from corvane.streaming import upsert


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", "s", t) for i, t in enumerate(texts)], "chunk_id string, source string, text string")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", "s", t) for i, t in enumerate(texts)], "query_id string, source string, query string")


def test_bm25_matches_formula_ties_and_empty(spark):
    ix = R.index(chunks(spark, "java java sql", "java", "python", None, "", "java"))
    got = {r.chunk_id: (r.score, r.rank) for r in R.bm25(ix, queries(spark, "java java")).collect()}
    n, avg = 6, 6 / 6
    def score(tf, dl):
        return round(2 * math.log(1 + (n - 3 + 0.5) / 3.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / max(avg, 1))), 6)
    assert got == {"c0": (score(2, 3), 3 if score(2, 3) < score(1, 1) else 1), "c1": (score(1, 1), 1 if score(2, 3) < score(1, 1) else 2), "c5": (score(1, 1), 2 if score(2, 3) < score(1, 1) else 3)}
    assert R.bm25(R.index(chunks(spark, "x").where(F.lit(False))), queries(spark, "java")).count() == 0


def test_bm25_grows_with_tf(spark):
    ix = R.index(chunks(spark, "java x x x", "java java x x", "java java java x"))
    assert [r.chunk_id for r in R.bm25(ix, queries(spark, "java")).orderBy("rank").collect()] == ["c2", "c1", "c0"]


def test_fusion_is_symmetric_and_keeps_best_rank(spark):
    leg = lambda *rows: spark.createDataFrame(list(rows), "query_id string, chunk_id string, score double, rank int")
    a, b = leg(("q", "x", 2.0, 1), ("q", "y", 1.0, 2), ("q", "x", 0.5, 3)), leg(("q", "y", 9.0, 1), ("q", "z", 1.0, 2))
    one = {r.chunk_id: (r.rrf_score, r.fused_rank, r.trace) for r in R.fuse({"a": a, "b": b}).collect()}
    two = {r.chunk_id: r.rrf_score for r in R.fuse({"b": b, "a": a}).collect()}
    assert {k: v[0] for k, v in one.items()} == two
    assert one["y"] == (round(1 / 61 + 1 / 62, 9), 1, "a+b") and one["x"] == (round(1 / 61, 9), 2, "a")


def test_exact_vectors_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((50, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(5)
    got = R.exact_vectors(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 3, 4).collect()
    for q in (0, 20, 40):
        s = np.round(x @ x[q], 6)
        s[q] = -9
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(np.lexsort((np.arange(50), -s))[:3])


def test_ontology_and_expansion(spark):
    edges = G.ontology_edges(spark)
    assert edges.count() == 318
    seeds = spark.createDataFrame([("q", "fastapi", 0), ("q", "teamwork", 1)], "query_id string, entity string, pos int")
    got = G.expand(seeds, edges).collect()
    assert len(got) == 5 and all(r.entity not in ("fastapi", "teamwork") and r.path[0] == "fastapi" for r in got)
    assert [r.entity for r in sorted(got, key=lambda r: r["rank"])][0] == "python"


def test_labels_find_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d"), (None, "z")], "source string, target string")
    assert {r.node: r.component for r in G.labels(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_sections_last_heading_wins(spark):
    d = spark.createDataFrame([(1, "lost\n## Skills\n- a\n\n### deep\n## Duties\nx\r\n## Skills\n- b"), (2, None), (3, "no heading")], "id int, text string")
    assert {(r.id, r.heading, r.body) for r in P.sections(d, "id", "text").collect()} == {(1, "Duties", "x"), (1, "Skills", "- b")}


def test_chunks_skip_empty_slots(spark):
    j = spark.createDataFrame([("7", "Cook", None, "X", None, "X", '["fry"]', None, "bad", None, None, None, None, None, None)], "jd_id string, job_title string, industry string, city string, country string, job_location string, " + ", ".join(f"{c} string" for c in P.JD_LISTS))
    got = {r.chunk_id for r in P.description_chunks(P.clean_descriptions(j)).collect()}
    assert got == {"jd_7_header", "jd_7_responsibilities", "jd_7_skills"}


def test_understanding_quirks(spark):
    q = queries(spark, "html developer job in Bangalore", "jd for java and javascript")
    got = {r.query_id: r for r in U.understand(q).collect()}
    assert "ml" in got["q0"].skills and got["q0"].city == "bengaluru" and got["q0"].predicted_intent == "profile_search"
    assert got["q1"].skills[0] == "javascript" and got["q1"].predicted_intent == "jd_search"


def test_benchmark_has_120_queries(spark):
    b = U.benchmark(spark).collect()
    assert len(b) == 120 and len({r.query_id for r in b}) == 120


def test_metrics_by_hand(spark):
    j = spark.createDataFrame([("s", "q", f"c{i}", i, 1 if i in (2, 4) else 0, ["k"] if i == 2 else [], ["k", "m"]) for i in range(1, 7)], "stage string, query_id string, chunk_id string, rank int, relevant int, hits array<string>, keywords array<string>")
    m = {r.k: r for r in E.metrics(j).collect()}
    assert m[5].precision == 0.4 and m[5].recall == 1.0 and m[5].mrr == 0.5 and m[5].coverage == 0.5
    assert abs(m[5].ndcg - (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))) < 1e-6 and m[20].precision == 0.1


def test_quality_labels(spark):
    got = spark.createDataFrame([(x,) for x in (0.8, 0.6, 0.4, 0.2, 0.1)], "x double").select(K.quality_label(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == ["excellent", "strong", "moderate", "partial", "weak"]


def test_quality_counts(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None), ("3", " ")], "id string, v string")
    assert tuple(Q.repeated_rows(df, "id").first()) == (4, 3, 3, 1)
    assert {r.column: (r.rows, r.nulls, r.blanks, r.distinct_values) for r in Q.profile(df, ["v"]).collect()} == {"v": (4, 1, 1, 2)}


def test_csv_round_trip_and_upsert(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,v\n1,"a ""b"",\nc"\n2,N/A\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), ["id", "v"]).orderBy("id").collect()] == [("1", 'a "b",\nc'), ("2", None)]
    t = str(tmp_path / "t")
    row = lambda *r: spark.createDataFrame(list(r), "k string, v int, at int")
    assert files.keyed_overwrite(row(("a", 1, 1), ("b", 1, 1), (None, 1, 1)), t, "k", "at") == (3, 2)
    files.keyed_overwrite(row(("a", 2, 2), ("b", 0, 0)), t, "k", "at")
    assert {r.k: r.v for r in files.read_keyed(spark, t).collect()} == {"a": 2, "b": 1}
    (tmp_path / "t" / "v=000000000003").mkdir()  # a write that did not end counts for nothing
    assert files.read_keyed(spark, t).count() == 2
    assert files.keyed_overwrite(row(("c", 1, 1)), t, "k", "at") == (1, 3)
    assert files.keyed_overwrite(row(("d", 1, 1)), t, "k", "at") == (1, 4) and files.read_keyed(spark, t).count() == 4
    with pytest.raises(ValueError):
        files.read_keyed(spark, str(tmp_path / "none"))
    files.write_csv(spark.createDataFrame([("1", "  a, b "), ("2", 'c "d"\ne')], "id string, v string"), str(tmp_path / "c"))
    assert {r.id: r.v for r in files.read_csv(spark, str(tmp_path / "c"), ["id", "v"]).collect()} == {"1": "  a, b ", "2": 'c "d"\ne'}


def test_markdown_tree(spark, tmp_path):
    for n in (10, 2):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "d.md").write_text(f"## T\n{n}")
    assert [(r.doc_id, r.text) for r in files.read_markdown(spark, f"{tmp_path}/*/d.md").orderBy("doc_id").collect()] == [(2, "## T\n2"), (10, "## T\n10")]


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", "java", 1), ("a", "sql", 2), ("b", "java java", 1)], "chunk_id string, text string, loaded_at int")
    df.write.parquet(src)
    upsert.upsert_chunks(spark, src, df.schema, out, str(tmp_path / "cp")).awaitTermination()
    assert {r.chunk_id: r.text for r in upsert.current(spark, out).collect()} == {"a": "sql", "b": "java java"}


def test_the_latest_delivery_counts_as_a_whole(spark):
    from corvane.sources.tables import one_per_key

    rows = [("a", "9", "x", 1), ("a", "10", None, 2), ("b", "1", "y", None), ("b", "0", "z", 1), (None, "5", "q", 9)]
    df = spark.createDataFrame(rows, "id string, n string, t string, loaded_at int")
    assert {r.id: (r.n, r.t) for r in one_per_key(df, "id", "n", "t").collect()} == {"a": ("10", None), "b": ("0", "z")}


def test_only_whole_texts_are_json(spark):
    texts = ['["a"]', "{}", "2", "2 x developer", "[1] tail", '{"a": 1} {"b": 2}', "1, 2", "1], [2", '"x"', "null", " ", None, "{'a': 1", '{"a": }']
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert tuple(Q.json_validity(df, ["v"]).first()) == ("v", 12, 5)


def test_checked_sources(spark, tmp_path):
    import json

    (tmp_path / "k.csv").write_text("id,v\na,1\n ,2\nb,3\n")
    assert files.read_keyed_csv(spark, str(tmp_path / "k.csv"), ["id", "v"], "id").count() == 2
    (tmp_path / "k2.csv").write_text("id,v\na,1\na,2\n")
    with pytest.raises(ValueError, match="repeated id: a"):
        files.read_keyed_csv(spark, str(tmp_path / "k2.csv"), ["id", "v"], "id")
    good = [{"query": "java", "intent": "job_search", "expected_keywords": ["a", "b"]}]
    for name, content, words, wrong in (("a", good, 2, None), ("b", good, 5, "number of keywords"), ("c", [{"query": " ", "intent": "x"}], None, "blank query, unknown intent")):
        (tmp_path / name).write_text(json.dumps(content))
        if wrong is None:
            assert files.read_benchmark(spark, str(tmp_path / name), ["job_search"], words).count() == 1
        else:
            with pytest.raises(ValueError, match=wrong):
                files.read_benchmark(spark, str(tmp_path / name), ["job_search"], words)
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, float("nan")])], "chunk_id string, embedding array<double>")
    assert files.write_vectors(v.where("chunk_id = 'a'"), str(tmp_path / "v"), dim=2) == 1
    for bad in (v, v.where("chunk_id = 'x'")):
        with pytest.raises(ValueError):
            files.write_vectors(bad, str(tmp_path / "w"), dim=2)
    assert files.create_if_missing(spark, {"one": "a int", "two": "b string"}, str(tmp_path)) == ["one", "two"]
    assert files.create_if_missing(spark, {"one": "a int"}, str(tmp_path)) == []
    with pytest.raises(ValueError):
        files.require_unique(spark.createDataFrame([("a", 1), ("a", 1)], "n string, l int"), "n", "l")


def test_chunks_are_checked_before_use(spark):
    from corvane.operators import preparation as O

    df = spark.createDataFrame([("a", "x"), ("a", " "), (None, None)], "chunk_id string, text string")
    assert {r.check: r.rows for r in O.violations(df).collect()} == {"rows": 3, "no id": 1, "null text": 1, "blank text": 1, "repeated id": 1}
    for bad in (df, df.where("chunk_id = 'z'"), df.drop("text")):
        with pytest.raises(ValueError):
            O.checked(bad)
    assert O.checked(df.limit(1)).count() == 1
    got = O.dense_ids(spark.createDataFrame([(f"k{i:03d}", i) for i in range(500)], "chunk_id string, dense int"), "chunk_id").collect()
    assert sorted((r.dense_id, r.chunk_id) for r in got) == [(i, f"k{i:03d}") for i in range(500)]
    assert O.dense_ids(df.where(F.lit(False)), "chunk_id").count() == 0


def test_descriptions_are_assembled_with_and_without_markdown(spark):
    from corvane.operators import preparation as O

    rows = [("m", "intro\n## Skill Requirements\n- Strong communication\n- Kubernetes and Jenkins\n- kubernetes and jenkins\n## Other Requirements\n- Bachelor's degree in Computer Science"), ("p", "Skill Requirements\n- 5+ years of Java\n\nResponsibilities\n- Lead audits"), ("n", None), ("e", " ")]
    got = {(r.id, r.bucket): r["items"] for r in O.assembled(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}
    assert got["m", "tools"] == ["Kubernetes and Jenkins"] and got["m", "soft_skills"] == ["Strong communication"] and got["m", "education"] == ["Bachelor's degree in Computer Science"]
    assert got["p", "experience"] == ["5+ years of Java"] and got["p", "responsibilities"] == ["Lead audits"] and {k for k, _ in got} == {"m", "p"}


def test_a_failing_method_does_not_end_the_evaluation(spark):
    from corvane.operators import reports as T

    b = spark.createDataFrame([("q1", ["java", "sql"])], "query_id string, keywords array<string>")
    text = spark.createDataFrame([("c1", "Java"), ("c2", "sql java")], "chunk_id string, text string")
    one = spark.createDataFrame([("q1", "c1", 1, 0.5), ("q1", "c2", 2, 0.25)], "query_id string, chunk_id string, rank int, score double")

    def broken():
        raise OSError("no index")

    runs, notes = T.timed_runs({"a": lambda: one, "b": broken}, b, text)
    got = {r.method: r for r in runs.collect()}
    assert (got["a"].top1_matches, got["a"].top5_coverage, got["a"].mean_score) == (1, 2, 0.375) and got["b"].results == 0 and got["b"].mean_score is None
    assert notes["b"][1] == "no index" and notes["a"][1] is None and notes["a"][0] > 0
    assert "| a | 2 |" in T.markdown({"Runs": runs.select("method", "results")}) and "More than 1 rows" in T.markdown({"Runs": runs}, 1)


def test_graph_upserts_keep_first_source_and_last_confidence(spark):
    from corvane.operators import reports as T

    e = spark.createDataFrame([("Candidate", "1", "HAS_SKILL", "Skill", "x", 0.5, "profiles", 0), ("Candidate", "1", "HAS_SKILL", "Skill", "x", 0.9, "ontology", 3), ("Demand", "2", "R", "Skill", " ", 0.9, "demands", 1)], "src_label string, src string, relation string, dst_label string, dst string, confidence double, origin string, turn int")
    nodes = T.merged_nodes(e)
    assert {(r.label, r.name): r.source for r in nodes.collect()} == {("Candidate", "1"): "profiles", ("Skill", "x"): "profiles", ("Demand", "2"): "demands"}
    assert [(r.src, r.dst, r.confidence) for r in T.merged_edges(e, nodes).collect()] == [("1", "x", 0.9)]
    assert T.existing(spark.createDataFrame([("x",), ("y",)], "name string"), nodes, "Skill").count() == 1
