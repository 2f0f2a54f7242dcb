"""p7: a training mixture with target shares, capped repeats and a time-varying curriculum.

The size of the mixture is the largest T for which every source can give share * T tokens within its
repeats. Source i is drawn with weight w_i(t) = share_i * (1 + tilt_i * (2 t - 1)) at time t in [0, 1];
the tilts are centred (sum of share_i * tilt_i = 0), so weights sum to one at every t and each integrates
to its share. An occurrence of a document whose tokens are the c-th of its source's demand belongs where
the integrated schedule has demanded c tokens: share_i * T * ((1 - tilt_i) t + tilt_i t^2) = c. The
equation is inverted in closed form, and the occurrences are range-sorted by t.

Token offsets are prefix sums in two levels: totals per (source, bucket of the hashed id), which are few,
and running sums inside a bucket; no source is ever handled by one task.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written

#: Folder of the public tokenizers' vocabulary files, and the file used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Documents a bucket of the prefix sums should hold.
BUCKET_DOCS = 50_000
#: Mixtures name sources one by one; more targets than this are refused.
MAX_TARGETS = 10_000


def count_tokens(df: DataFrame, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row with a long column `tokens`: its text's length in tokens; 0 for null or empty texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", tokens long"
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts: list[int] = []
            for k in range(0, len(texts), 256):
                counts += [len(e.ids) for e in tokenizer.encode_batch(texts[k : k + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokens"])

    return df.mapInArrow(run, schema)


def default_tilts(targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """A curriculum from broad to curated: sources that may be repeated more come later.

    Tilts lie in [-0.5, 0.5] by the rank of max_repeats and are centred by share.
    """
    levels = sorted({r for _, r in targets.values()})
    raw = {s: (levels.index(r) / max(1, len(levels) - 1) - 0.5 if len(levels) > 1 else 0.0) for s, (_, r) in targets.items()}
    return centred(raw, targets)


def centred(tilts: dict[str, float], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tilts with a share-weighted mean of zero, scaled to stay within [-1, 1]."""
    whole = sum(w for w, _ in targets.values()) or 1.0
    mean = sum(tilts.get(s, 0.0) * w for s, (w, _) in targets.items()) / whole
    out = {s: tilts.get(s, 0.0) - mean for s in targets}
    most = max([1.0, *map(abs, out.values())])
    return {s: x / most for s, x in out.items()}


def plan(targets: dict[str, tuple[float, int]], available: dict[str, int]) -> tuple[float, dict[str, float]]:
    """(T, share of each source that has tokens): shares of sources without documents go to the others in proportion."""
    usable = {s: w for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s, 0) > 0}
    whole = sum(usable.values())
    shares = {s: w / whole for s, w in usable.items()}
    return (min(available[s] * targets[s][1] / shares[s] for s in shares) if shares else 0.0), shares


def _offsets(docs: DataFrame, buckets: int) -> tuple[DataFrame, dict[str, int]]:
    """docs with `upto`, the tokens of its source up to and with it in hashed order; and the sources' tokens.

    The totals of the buckets stay a table: their running sums are a window over one short row a bucket, joined
    back by (source, bucket). Only one total a target source reaches the driver.
    """
    keyed = docs.withColumn("h", F.xxhash64("doc_id", "line")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = written(keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("s")), "buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    totals = {r.source: r.s for r in sums.groupBy("source").agg(F.sum("s").alias("s")).collect()}
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "line").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("inside", F.sum("tokens").over(own)).join(base, ["source", "bucket"])
    return out.withColumn("upto", F.col("base") + F.col("inside")).drop("h", "bucket", "inside", "base"), totals


def mixture(documents: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(occurrences, shares).

    documents: doc_id bigint, text, source; targets: source, target_share, max_repeats.
    occurrences: position (0 to 1, sorted), doc_id, source, pass (from 1), tokens, text.
    shares: one row per target source: target_share, share (reached), tokens, documents (occurrences),
    repeats_used, available (tokens of the source once). Sources of targets without documents have
    share 0, and the others' targets grow in proportion.
    Left out: documents of other or no source and of no tokens (null or empty texts). Of targets given
    twice the largest share counts; null sources and shares are ignored. Equal documents are counted
    as separate rows. Empty tables give no occurrence.
    """
    spark = documents.sparkSession
    wanted = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    goal = {r.source: (float(r.w), int(r.r or 0)) for r in wanted}
    names = spark.createDataFrame([(s,) for s in goal], "source string")
    rows = documents.select("doc_id", "source", "text").join(F.broadcast(names), "source", "left_semi")
    docs = written(count_tokens(rows, "text", folder, vocabulary).where("tokens > 0").withColumn("line", F.monotonically_increasing_id()), "tokens")
    placed, available = _offsets(docs, max(1, math.ceil(docs.count() / BUCKET_DOCS)))
    total, shares = plan(goal, available)
    bent = centred(tilts, goal) if tilts is not None else default_tilts({s: (shares[s], goal[s][1]) for s in shares})
    lines = [(s, float(available[s]), shares[s] * total, bent.get(s, 0.0), goal[s][1]) for s in shares]
    facts = spark.createDataFrame(lines, "source string, whole double, demand double, tilt double, most int")
    middle = F.col("upto") - F.col("tokens") / 2
    passes = F.least(F.col("most"), F.ceil((F.col("demand") - middle) / F.col("whole")).cast("int"))
    used = (
        placed.join(F.broadcast(facts), "source")
        .withColumn("passes", passes)
        .where("passes > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
        .withColumn("x", F.least(F.lit(1.0), (middle + (F.col("pass") - 1) * F.col("whole")) / F.col("demand")))
    )
    # (1 - tilt) t + tilt t^2 = x, in a form that is stable at tilt = 0
    lead = 1 - F.col("tilt")
    position = 2 * F.col("x") / (lead + F.sqrt(lead * lead + 4 * F.col("tilt") * F.col("x")))
    occurrences = used.withColumn("position", position).select("position", "doc_id", "source", "pass", "tokens", "text").orderBy("position", "doc_id", "pass")
    counted = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("pass").alias("repeats_used"))
    given = spark.createDataFrame([(s, w, available.get(s, 0)) for s, (w, _) in goal.items()], "source string, target_share double, available long")
    whole = counted.agg(F.sum("tokens").alias("all"))
    report = (
        given.join(F.broadcast(counted), "source", "left")
        .join(F.broadcast(whole))
        .select(
            "source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), "available",
        )
    )
    return occurrences, report
