"""One call for a batch of typed queries: reading, expansion, both legs, fusion, ranking, explanation.

    python -m corvane.pipeline --data DIR --query "java developer in pune" [--query ...] [--top-k 10]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import vocab as V
from corvane.operators import graph as G
from corvane.operators import querying as U
from corvane.operators import ranking as K
from corvane.operators import retrieval as R


def run(queries: DataFrame, chunks: DataFrame, index: R.Index | None = None, k: int = V.FINAL, logit=None, sets: DataFrame | None = None) -> DataFrame:
    """Explained results of queries (query_id, query) over chunks (chunk_id, source, text, skills as comma list).

    The dataset searched follows from the intent read from the query. Queries without a result give no
    row. Blank queries are an error. index and sets: those of the chunks, written before, if there are any.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").limit(1).count():
        raise ValueError("a query is empty")
    spark = queries.sparkSession
    read = U.understand(queries)
    source = F.create_map(*[F.lit(x) for kv in V.INTENT_SOURCE.items() for x in kv])
    read = read.withColumn("source", source[F.col("predicted_intent")])
    seeds = U.seeds(read)
    expansion = G.expand(seeds, G.ontology_edges(spark))
    searched = U.expanded_text(read.select("query_id", "query", "source"), expansion).select("query_id", F.col("expanded_query").alias("query"), "source")
    index = index or R.index(chunks)
    if sets is None:
        sets = R.sets(chunks)
    fused = R.fuse({"bm25": R.bm25(index, searched), "semantic": R.set_cosine(sets, searched)})
    rows = fused.join(chunks.select("chunk_id", "source", "text"), "chunk_id").join(read.select("query_id", "query"), "query_id")
    own = chunks.select("chunk_id", A.split_keep(F.col("skills")).alias("skills"))
    ranked = K.rerank(K.combine(K.evidence(rows, own, seeds, expansion)), logit, k=k)
    return K.explain(ranked, expansion)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--query", action="append", required=True)
    p.add_argument("--top-k", type=int, default=V.FINAL)
    a = p.parse_args(argv)
    from corvane.plans.search_queries import corpus
    from corvane.session import local_session

    spark: SparkSession = local_session("pipeline")
    queries = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(a.query)], "query_id string, query string")
    for r in run(queries, corpus(spark, a.data), k=a.top_k).orderBy("query_id", "final_rank").select(F.to_json(F.struct("query_id", "chunk_id", "final_rank", "combined_score", "explanation")).alias("j")).collect():
        print(json.dumps(json.loads(r.j), ensure_ascii=False))


if __name__ == "__main__":
    main()
