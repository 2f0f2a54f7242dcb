"""Token index, BM25, set cosine, exact vectors and rank fusion; every search takes a batch of queries.

Index tables are plain DataFrames: postings (source, chunk_id, term, tf, dl: the chunk's length), frequencies
(source, term, df) and collection (source, n, avgdl). They are written once and clustered by term (`write_index`). Term frequencies are combined before
anything is shuffled, and a search joins only the postings of the queries' terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions import vocab as V
from corvane.session import written


@dataclass
class Index:
    postings: DataFrame
    frequencies: DataFrame
    collection: DataFrame


def index(chunks: DataFrame, text: str = "text") -> Index:
    """Index of chunks (chunk_id, source, text); empty and null texts have length 0 and no postings."""
    toks = chunks.select("chunk_id", "source", X.tokens(F.col(text)).alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    postings = toks.select("chunk_id", "source", "dl", F.explode("toks").alias("term")).groupBy("source", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    return Index(postings, postings.groupBy("source", "term").agg(F.count(F.lit(1)).alias("df")), toks.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")))


def write_postings(postings: DataFrame) -> DataFrame:
    """Postings in the shared folder, each file sorted by source and term, so a search skips the row groups it does not need."""
    return written(postings.sortWithinPartitions("source", "term"), "postings")


def write_index(ix: Index) -> Index:
    """The index as written tables; frequencies are counted from the written postings."""
    postings = write_postings(ix.postings)
    return Index(postings, written(postings.groupBy("source", "term").agg(F.count(F.lit(1)).alias("df")), "frequencies"), written(ix.collection, "collection"))


def sets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, term, nd): the different tokens of the text and the skills of every chunk, and their number; no shuffle.

    chunks: chunk_id, source, text, skills (a text; may be null).
    """
    both = F.array_distinct(F.concat(X.tokens(F.col("text")), X.tokens(F.col("skills"))))
    return chunks.select("chunk_id", "source", both.alias("terms")).select("chunk_id", "source", F.explode("terms").alias("term"), F.size("terms").cast("long").alias("nd"))


#: Terms of a query batch that are sent to every task; the terms of a larger batch are joined by a shuffle.
MAX_TERMS = 100_000


def _checked(terms: DataFrame) -> DataFrame:
    """The terms marked for broadcast if they are counted to be few."""
    return F.broadcast(terms) if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS else terms


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, source, term, qtf): repeated words of a query count repeatedly."""
    return queries.select("query_id", "source", F.explode(X.tokens(F.col(text))).alias("term")).groupBy("query_id", "source", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top(scored: DataFrame, score: str, k: int, key: str = "chunk_id", per: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank; ties by key. Filtered on the window, so partitions are cut first."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(score), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_scores(ix: Index, queries: DataFrame, k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """(query_id, chunk_id, score), score rounded to 6 places before it is ranked."""
    terms = query_terms(queries)
    few = _checked(terms)
    # terms (small) meet frequencies first, so postings are read through one join
    weighted = ix.frequencies.join(few, ["source", "term"]).join(ix.collection, "source")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = weighted.select("query_id", "source", "term", (idf * F.col("qtf")).alias("w"), F.greatest("avgdl", F.lit(1.0)).alias("avgdl"))
    hits = ix.postings.join(weighted if few is terms else F.broadcast(weighted), ["source", "term"])  # a row of terms is a row here at most
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def bm25(ix: Index, queries: DataFrame, k: int = V.DEPTH) -> DataFrame:
    return top(bm25_scores(ix, queries), "score", k)


def bm25_fields(fields: dict[str, tuple[Index, float]], queries: DataFrame, k: int = V.DEPTH, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best-fields search: the largest of the fields' boosted scores counts."""
    legs = None
    for ix, boost in fields.values():
        leg = bm25_scores(ix, queries, k1, b).withColumn("score", F.col("score") * boost)
        legs = leg if legs is None else legs.unionByName(leg)
    return top(legs.groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), 6).alias("score")), "score", k)


def set_cosine(docs: DataFrame, queries: DataFrame, k: int = V.DEPTH) -> DataFrame:
    """Shared different tokens over the root of the product of both counts; docs as made by `sets`."""
    own = F.array_distinct(X.tokens(F.col("query")))
    terms = queries.select("query_id", "source", own.alias("own")).select("query_id", "source", F.explode("own").alias("term"), F.size("own").cast("long").alias("nq"))
    both = docs.join(_checked(terms), ["source", "term"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("c"), F.first("nd").alias("nd"), F.first("nq").alias("nq"))
    return top(both.select("query_id", "chunk_id", F.round(F.col("c") / F.sqrt(F.col("nq") * F.col("nd")), 6).alias("score")), "score", k)


def unit(v):
    """A vector column at unit length, in double precision; zero vectors stay as they are."""
    x = F.transform(v, lambda a: a.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.when(norm > 0, F.transform(x, lambda a: a / norm)).otherwise(x)


#: Query vectors held by a task at once in the exact search.
VECTOR_BLOCK = 2_048


def exact_vectors(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """Inner products of unit query vectors (query_id, vec) with all unit vectors (id, vec): the exact k best of each.

    Queries are a stated set, taken in blocks of VECTOR_BLOCK; each block scans the vectors once, and a
    task keeps only its k best per query, so what is shuffled does not grow with the collection.
    """
    import numpy as np
    import pyarrow as pa

    def scan(q_ids: list[int], q: np.ndarray):
        keep_k = k + 1  # a query may find itself

        def run(batches):
            best: list[tuple] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.asarray(batch.column(0))
                v = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                s = np.round(q @ v.T, 6)
                for i, qid in enumerate(q_ids):
                    keep = np.flatnonzero(s[i] >= np.partition(s[i], -keep_k)[-keep_k]) if len(ids) > keep_k else np.arange(len(ids))
                    best.append((np.full(len(keep), qid), ids[keep], s[i][keep]))
                if len(best) > 64 * len(q_ids):
                    best = _shorten(best, keep_k)
            best = _shorten(best, keep_k)
            if best:
                a, b, c = best[0]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "id", "score"])

        def _shorten(parts, k):
            if not parts:
                return []
            a, b, c = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.lexsort((b, -c, a))
            a, b, c = a[order], b[order], c[order]
            start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
            keep = place < k
            return [(a[keep], b[keep], c[keep])]

        return run

    out, last = None, None
    while True:
        block = queries if last is None else queries.where(F.col("query_id") > last)
        rows = block.orderBy("query_id").limit(VECTOR_BLOCK).collect()
        if not rows and out is not None:
            break
        q = np.array([r.vec for r in rows], np.float64).reshape(-1, dim)
        part = vectors.select("id", "vec").mapInArrow(scan([r.query_id for r in rows], q), "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
        if len(rows) < VECTOR_BLOCK:
            break
        last = rows[-1].query_id
    return top(out.where("query_id <> id"), "score", k, "id")


def fuse(legs: dict[str, DataFrame], k: int = V.DEPTH, rrf_k: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, chunk_id, score, rank).

    A repeated chunk keeps its best rank in a leg. Order: score, number of legs, best rank, chunk_id.
    Result: query_id, chunk_id, rrf_score, sources, best_rank, <leg>_rank, <leg>_score (null where absent),
    trace ('bm25+semantic'), fused_rank.
    """
    union = None
    for name, leg in legs.items():
        part = leg.select("query_id", "chunk_id", F.lit(name).alias("leg"), "score", "rank")
        union = part if union is None else union.unionByName(part)
    one = union.groupBy("query_id", "chunk_id", "leg").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    per = [x for n in legs for x in (F.max(F.when(F.col("leg") == n, F.col("rank"))).alias(f"{n}_rank"), F.max(F.when(F.col("leg") == n, F.col("score"))).alias(f"{n}_score"))]
    fused = one.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("rrf_score"), F.count(F.lit(1)).alias("sources"), F.min("rank").alias("best_rank"), *per
    )
    trace = F.concat_ws("+", *[F.when(F.col(f"{n}_rank").isNotNull(), F.lit(n)) for n in legs])
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.desc("sources"), "best_rank", "chunk_id")
    return fused.withColumn("trace", trace).withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)
