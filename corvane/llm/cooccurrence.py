"""p2: items that appear together, by an external sort of packed 64-bit pair codes.

1. The support of every item is counted (combined map-side).
2. Only items whose own support reaches the pair threshold can be in a frequent pair, so the rest are
   dropped without loss. Up to MAX_ITEMS items are numbered by a dictionary sent to every task; more are
   numbered in a table and joined to the records, so a low threshold needs no bound on the vocabulary.
3. Each task codes the pairs of its records as `low << 32 | high`, sorts them in memory blocks and
   spills every block as a sorted run of (code, run length). A pair that stands in a third of all
   records leaves a task as one row per block.
4. The runs are exchanged by code and merge-sorted by Spark's external sorter, which spills to disk;
   a last scan adds up the run lengths of equal codes.

Measures use Haldane-Anscombe's continuity correction (0.5 in each cell of the 2 x 2 table).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written

#: Pair codes held by a task before they are sorted and spilled as one run (8 bytes each).
RUN_CODES = 1 << 22
#: Items that may be shipped to every task; more are joined.
MAX_ITEMS = 1 << 16
_RUN = "code long, n long"


def _lengths(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of sorted codes."""
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    if weights is None:
        return codes[starts], np.diff(np.r_[starts, len(codes)])
    return codes[starts], np.add.reduceat(weights, starts)


def _pair_blocks(items: pa.ListArray, code_of: dict[str, int]) -> Iterator[np.ndarray]:
    """Pair codes of the records of a batch: records of equal length are paired at once."""
    flat = items.flatten()
    if not len(flat):
        return
    enc = flat.dictionary_encode()
    table = np.array([code_of.get(v, -1) if v is not None else -1 for v in enc.dictionary.to_pylist()] or [-1], np.int64)
    codes = table[np.asarray(enc.indices.fill_null(len(table) - 1))] if enc.null_count == 0 else np.array([code_of.get(v, -1) for v in flat.to_pylist()], np.int64)
    yield from _code_blocks(items, codes)


def _code_blocks(items: pa.ListArray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """Pair codes of records whose items have the codes (-1: dropped)."""
    lengths = np.asarray(pa.compute.list_value_length(items).fill_null(0), np.int64)
    record = np.repeat(np.arange(len(lengths)), lengths)
    keep = codes >= 0
    both = np.unique((record[keep] << 32) | codes[keep])  # once per record, sorted within it
    record, codes = both >> 32, both & 0xFFFFFFFF
    if not len(codes):
        return
    starts = np.flatnonzero(np.r_[True, record[1:] != record[:-1]])
    sizes = np.diff(np.r_[starts, len(record)])
    for size in np.unique(sizes):
        if size < 2:
            continue
        first = starts[sizes == size]
        a, b = np.triu_indices(size, 1)
        step = max(1, (1 << 20) // len(a))
        for k in range(0, len(first), step):
            at = first[k : k + step, None]
            yield ((codes[at + a] << 32) | codes[at + b]).ravel()


def _runs(code_of: dict[str, int] | None, run_codes: int):
    """Sorted runs of the pairs of records; without a dictionary their items are codes already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def spill() -> pa.RecordBatch:
            codes, n = _lengths(np.sort(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n, pa.int64())], names=["code", "n"])

        for batch in batches:
            items = batch.column(0)
            for block in _code_blocks(items, np.asarray(items.flatten(), np.int64)) if code_of is None else _pair_blocks(items, code_of):
                held.append(block)
                size += len(block)
                if size >= run_codes:
                    yield spill()
                    held, size = [], 0
        if held:
            yield spill()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length count of a sorted stream of (code, n); a run may span batches."""
    last: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, n = _lengths(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
        if last is not None:
            if codes[0] == last[0]:
                n[0] += last[1]
            else:
                codes, n = np.r_[last[0], codes], np.r_[last[1], n]
        last = (int(codes[-1]), int(n[-1]))
        if len(codes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(n[:-1], pa.int64())], names=["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], names=["code", "n"])


def _numbered(support: DataFrame) -> DataFrame:
    """(i, item, c) with numbers from 0 on, for any number of items below 2^31."""
    spark = support.sparkSession
    coded = written(support.withColumn("m", F.monotonically_increasing_id()), "items").withColumn("part", F.shiftright("m", 33))
    first, at = [], 0
    for r in coded.groupBy("part").agg(F.count(F.lit(1)).alias("c")).orderBy("part").collect():
        first.append((r.part, at))
        at += r.c
    if at >= 1 << 31:
        raise ValueError(f"{at} items do not fit pair codes of 2 x 31 bits")
    start = F.broadcast(spark.createDataFrame(first, "part long, start long"))
    return coded.join(start, "part").select((F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")).alias("i"), "item", "c")


def cooccurrence(records: DataFrame, items: str, min_count: int = 5, min_share: float = 0.005, run_codes: int = RUN_CODES) -> DataFrame:
    """Pairs of items together in at least min_count records and min_share of the records with an item.

    records: one row per record with an array<string> column `items`; other columns are ignored.
    An item counts once per record; null items and null or empty arrays count nothing, so an empty
    table gives no row. Pairs are ordered by code point.
    Result: item_a, item_b, n_both, n_a, n_b, n, lift, odds_ratio, log_odds_z.
    `records` is read twice; pass a written table where it is expensive.
    """
    spark = records.sparkSession
    sets = records.select(F.filter(F.array_distinct(F.col(items)), lambda x: x.isNotNull()).alias("items")).where(F.size("items") > 0)
    total = sets.count()
    support = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    least = max(1, min_count, math.ceil(min_share * total - 1e-9))
    support = support.where(F.col("c") >= least)
    rows = support.limit(MAX_ITEMS + 1).collect()
    if len(rows) <= MAX_ITEMS:
        names = sorted(r.item for r in rows)
        counts = {r.item: r.c for r in rows}
        coded = F.broadcast(spark.createDataFrame([(i, v, counts[v]) for i, v in enumerate(names)], "i long, item string, c long"))
        runs = sets.mapInArrow(_runs({v: i for i, v in enumerate(names)}, run_codes), _RUN)
    else:
        coded = _numbered(support)
        # records keep a number across the join by being written first
        kept = written(sets.withColumn("record", F.monotonically_increasing_id()), "records")
        flat = kept.select("record", F.explode("items").alias("item")).join(coded.select("item", "i"), "item")
        runs = flat.groupBy("record").agg(F.collect_list("i").alias("codes")).select("codes").mapInArrow(_runs(None, run_codes), _RUN)
    merged = (
        runs.repartition("code")
        .sortWithinPartitions("code")
        .mapInArrow(_merge, _RUN)
        .where(F.col("n") >= least)
    )
    a = coded.select(F.col("i").alias("ia"), F.col("item").alias("item_a"), F.col("c").alias("n_a"))
    b = coded.select(F.col("i").alias("ib"), F.col("item").alias("item_b"), F.col("c").alias("n_b"))
    pairs = (
        merged.select(F.shiftright("code", 32).alias("ia"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ib"), F.col("n").alias("n_both"))
        .join(a, "ia")
        .join(b, "ib")
        .withColumn("n", F.lit(total).cast("long"))
    )
    if len(rows) > MAX_ITEMS:  # numbers of the table do not follow the names
        x, y = F.struct(F.col("item_a").alias("v"), F.col("n_a").alias("c")), F.struct(F.col("item_b").alias("v"), F.col("n_b").alias("c"))
        pairs = pairs.select("n_both", "n", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).select("n_both", "n", F.col("x.v").alias("item_a"), F.col("x.c").alias("n_a"), F.col("y.v").alias("item_b"), F.col("y.c").alias("n_b"))
    c11, c10 = F.col("n_both") + 0.5, F.col("n_a") - F.col("n_both") + 0.5
    c01, c00 = F.col("n_b") - F.col("n_both") + 0.5, F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_both") + 0.5
    return pairs.select(
        "item_a", "item_b", "n_both", "n_a", "n_b", "n",
        (F.col("n_both") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        (c11 * c00 / (c10 * c01)).alias("odds_ratio"),
        (F.log(c11 * c00 / (c10 * c01)) / F.sqrt(1 / c11 + 1 / c10 + 1 / c01 + 1 / c00)).alias("log_odds_z"),
    )
