"""p3: the k most similar vectors of every vector, within an acceptable accuracy loss.

Vectors of unit length are projected by 2-stable (Gaussian) directions into spaces of DIMS dimensions;
each space is indexed by a kd-tree fitted on a bounded sample. The difference of two vectors at
distance d projects to a coordinate distributed N(0, d^2), its square over d^2 to a chi-square variate.
A vector is first verified against its own leaf in FIRST trees, which gives the distance d_k of its
k-th neighbour so far. The chi-square test (one degree of freedom per splitting plane) then bounds the
chance that a point within d_k lies beyond the planes of every leaf seen. Vectors whose chance exceeds
MISS go on, in rounds, to the likeliest leaves of one further tree a round, as many as the test asks for;
a round may see WIDER times as many leaves as the one before, up to all of them, so no vector stops
before it passes the test.

A leaf holds about LEAF vectors whatever their number; the leaves a vector needs grow with the depth.
Equal vectors are one point, whose k + 1 smallest ids stand for it (further copies could not appear in
any list), so no leaf is filled by copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written

#: The index: dimensions of a projection, trees verified first, chance accepted.
DIMS, FIRST, MISS = 8, 3, 0.02
#: Leaves a vector may see in the first round of further trees, and the factor from round to round.
LEAVES, WIDER = 8, 8
#: Bits of a leaf inside its block: a vector that searches several leaves of a block is sent there once, with a mask.
BLOCK = 2
#: Searching vectors that one task should hold with a block, and (vector, leaf) cells weighed at once.
ASKERS, CELLS = 50_000, 1 << 18
#: Vectors a leaf should hold, and the bound of the sample the trees are fitted on (at least LEAST_SAMPLE a node).
LEAF, SAMPLE, LEAST_SAMPLE = 4_000, 20_000, 24
SEED = 11
#: Repeated rows and copies up to this many are dropped by a broadcast list, more by a shuffled join.
MAX_BROADCAST = 100_000


def _depth(total: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(max(1, total) / leaf)))


def _rounds(depth: int) -> int:
    """Rounds of further trees until one may see every leaf."""
    rounds = 0
    while depth and (not rounds or LEAVES * WIDER ** (rounds - 1) < 2**depth):
        rounds += 1
    return rounds


class Forest:
    """kd-trees over projections: split dimensions and thresholds by level."""

    def __init__(self, sample: np.ndarray, total: int, trees: int, dims: int = DIMS, leaf: int = LEAF):
        self.depth = _depth(total, leaf)
        width = sample.shape[1] if len(sample) else 1
        rng = np.random.default_rng(SEED)
        self.trees = []
        fitted = max(0, min(self.depth, int(math.log2(max(1, len(sample)) / LEAST_SAMPLE)))) if len(sample) else 0
        for _ in range(trees):
            directions = rng.standard_normal((width, dims + self.depth - fitted)).astype(np.float32)
            x = sample @ directions if len(sample) else np.zeros((0, directions.shape[1]), np.float32)
            node = np.zeros(len(x), np.int64)
            levels = []
            for level in range(fitted):
                dim, cut = np.zeros(1 << level, np.int64), np.zeros(1 << level, np.float32)
                for j in range(1 << level):
                    own = x[node == j]
                    if len(own):
                        dim[j] = int(np.argmax(own[:, :dims].var(axis=0)))
                        cut[j] = np.median(own[:, dim[j]])
                levels.append((dim, cut))
                node = 2 * node + (x[np.arange(len(x)), dim[node]] > cut[node])
            # beyond what the sample can split: further directions, cut at their median
            rest = [(dims + i, float(np.median(x[:, dims + i])) if len(x) else 0.0) for i in range(self.depth - fitted)]
            self.trees.append((directions, levels, rest))

    def place(self, tree: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector, and its distances to the planes passed (vectors x levels)."""
        directions, levels, rest = self.trees[tree]
        x = v @ directions
        row = np.arange(len(v))
        node, planes = np.zeros(len(v), np.int64), []
        for dim, cut in levels:
            gap = x[row, dim[node]] - cut[node]
            node = 2 * node + (gap > 0)
            planes.append(np.abs(gap))
        for dim, cut in rest:
            gap = x[:, dim] - cut
            node = 2 * node + (gap > 0)
            planes.append(np.abs(gap))
        return node, np.stack(planes, axis=1) if planes else np.zeros((len(v), 0), np.float32)

    def chance_missed(self, trees: range, v: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Chance that a point at distance d lies outside the leaf of v in all the trees."""
        miss = np.ones(len(v))
        for t in trees:
            _, planes = self.place(t, v)
            z = planes / np.maximum(d, 1e-6)[:, None]
            miss *= 1 - _within(z).prod(axis=1)
        return miss


    def visits(self, tree: int, v: np.ndarray, d: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf) in parallel: the likeliest leaves of a point at distance d, and the chance left beside them.

        Leaves are added until that chance is `allowed` or there are `most`. A leaf is a box of independent
        coordinates N(x, d^2), so its chance is a product; on the way down the unlikeliest nodes are dropped.
        """
        directions, levels, rest = self.trees[tree]
        x, n = (v @ directions).astype(np.float64), len(v)
        row, node, mass, lost = np.arange(n), np.zeros(n, np.int64), np.ones(n), np.zeros(n)
        low, high = np.zeros(x.shape), np.ones(x.shape)  # the box, as values of the distribution function
        for level, (dim, cut) in enumerate([*levels, *rest]):
            at = np.arange(len(node))
            dim, cut = (dim[node], cut[node]) if level < len(levels) else (np.full(len(node), dim), np.full(len(node), cut))
            z = (cut - x[row, dim]) / np.maximum(d[row], 1e-6)
            below = np.where(z >= 0, _within(np.abs(z)), 1 - _within(np.abs(z)))
            a, b = low[at, dim], high[at, dim]
            below = np.clip(below, a, b)
            share = np.where(b > a, (below - a) / np.maximum(b - a, 1e-300), 0.5)
            left_high, right_low = high.copy(), low.copy()
            left_high[at, dim], right_low[at, dim] = below, below
            row, node, mass = np.r_[row, row], np.r_[2 * node, 2 * node + 1], np.r_[mass * share, mass * (1 - share)]
            low, high = np.concatenate([low, right_low]), np.concatenate([left_high, high])
            order = np.lexsort((mass, row))
            row, mass = row[order], mass[order]
            count = np.bincount(row, minlength=n)
            ends = np.cumsum(count)
            sums = np.cumsum(mass)
            below_row = np.r_[0.0, sums][ends - count]
            keep = (sums - below_row[row] + lost[row] > allowed[row] * (level + 1) / self.depth) | (allowed[row] <= 0)
            keep &= ends[row] - np.arange(len(row)) <= most
            lost += np.bincount(row[~keep], weights=mass[~keep], minlength=n)
            order = order[keep]
            row, node, mass, low, high = row[keep], node[order], mass[keep], low[order], high[order]
        return row, node, lost


def _within(z: np.ndarray) -> np.ndarray:
    """Chance that a difference does not cross a plane z standard deviations away: (1 + chi2_1(z^2)) / 2.

    Abramowitz and Stegun 7.1.26 for the error function (error below 2e-7).
    """
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return (1 + erf) / 2


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors as a 32-bit scale and 12 bits a component: about the error of 16-bit floats in three quarters of the bytes."""
    x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
    scale = (np.abs(x).max(axis=1) / 2047).astype("<f4")
    u = (np.rint(x / scale[:, None]).astype(np.int32) + 2048).astype(np.uint32)
    pair = u[:, ::2] << 12 | u[:, 1::2]
    body = np.stack([pair >> 16, pair >> 8 & 255, pair & 255], axis=2).astype(np.uint8).reshape(len(x), -1)
    return [r.tobytes() for r in np.concatenate([scale.view(np.uint8).reshape(-1, 4), body], axis=1)]


def _halves(column) -> np.ndarray:
    """Packed vectors as 32-bit floats."""
    blobs = column.to_pylist()
    if not blobs:
        return np.zeros((0, 2), np.float32)
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    three = raw[:, 4:].reshape(len(raw), -1, 3).astype(np.int32)
    pair = three[:, :, 0] << 16 | three[:, :, 1] << 8 | three[:, :, 2]
    return (np.stack([pair >> 12, pair & 4095], axis=2).reshape(len(raw), -1) - 2048).astype(np.float32) * scale


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vec, h): one row per given row; vec is the vector at unit length (`_packed`), h its 128-bit digest.

    Null ids, and vectors that are null, of another length, zero, or hold a null or a number that is
    not finite, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            right = np.asarray(pa.compute.equal(pa.compute.list_value_length(v), dim).fill_null(False))
            ids = batch.column(0).filter(pa.array(right))
            flat = v.filter(pa.array(right)).flatten().cast(pa.float64()).fill_null(float("nan"))
            x = np.asarray(flat).reshape(-1, dim)
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
                ok = np.isfinite(x).all(axis=1) & (top > 0)
                x = x[ok] / top[ok, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(_packed(x) if len(x) else [], pa.binary())], names=["id", "vec"])

    rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.mapInArrow(run, "id string, vec binary").withColumn("h", F.unhex(F.md5("vec")))


def _spread(forest: Forest, trees: range, ask: bool):
    """Rows (block, mask, rid, ask, member, bar, vec) for the own leaves of vectors in the trees.

    ask: they search there as well, and a leaf is a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _halves(batch.column("vec"))
            n = len(v)
            for t in trees:
                leaf, _ = forest.place(t, v)
                block = (np.int64(t) << 44) + leaf
                block, mask = (block, np.ones(n)) if ask else (block >> BLOCK, 1 << (leaf & (1 << BLOCK) - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(mask.astype(np.int32)), batch.column("rid"), pa.array(np.full(n, ask)), pa.array(np.ones(n, bool)), pa.array(np.full(n, -2, np.float32)), batch.column("vec")],
                    names=["block", "mask", "rid", "ask", "member", "bar", "vec"],
                )

    return run


def _go_on(forest: Forest, tree: int, most: int):
    """Of (rid, vec, bar, left) those that fail the test, with the leaves of the tree to see and the chance left then.

    bar is the k-th similarity so far (null: fewer than k), left the chance left by the rounds before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, left = _halves(batch.column("vec")), np.asarray(batch.column("left"))
            bar = np.asarray(batch.column("bar").fill_null(-2.0), np.float32)
            d = np.sqrt(np.maximum(0, 2 - 2 * bar))
            miss = forest.chance_missed(range(FIRST), v, d) * left
            few = (bar <= -2) & (left > 1e-6)  # sees every leaf, if it must
            fails = np.flatnonzero((miss > MISS * (1 + 1e-6)) | few)
            step = max(1, CELLS // min(most, 1 << forest.depth))
            for k in range(0, len(fails), step):
                at = fails[k : k + step]
                allowed = np.where(few[at], 0, MISS / np.maximum(miss[at], MISS))
                row, leaf, lost = forest.visits(tree, v[at], d[at], allowed, most)
                order = np.lexsort((leaf, row))
                row, block, bit = row[order], ((np.int64(tree) << 44) + leaf[order]) >> BLOCK, 1 << (leaf[order] & (1 << BLOCK) - 1)
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
                offsets = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(at)))]
                places = pa.StructArray.from_arrays([pa.array(block[new]), pa.array(np.add.reduceat(bit, new).astype(np.int32))], names=["block", "mask"])
                leaves = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(take), leaves, pa.array(bar[at]), pa.array(left[at] * lost), batch.column("vec").take(take)], names=["rid", "leaves", "bar", "left", "vec"])

    return run


def _search(k: int):
    """The k most similar within the leaves of a block of every vector that asks, above its bar."""

    def run(table):
        rid = np.asarray(table.column("rid").combine_chunks())
        bar = np.asarray(table.column("bar").combine_chunks())
        v = _halves(table.column("vec").combine_chunks())
        mask = np.asarray(table.column("mask").combine_chunks())
        ask = np.asarray(table.column("ask").combine_chunks())
        member = np.asarray(table.column("member").combine_chunks())
        who, near, sims = [], [], []
        for bit in range(1 << BLOCK):
            inside = (mask >> bit & 1) > 0
            asks, members = np.flatnonzero(ask & inside), np.flatnonzero(member & inside)
            members = members[np.argsort(rid[members])]
            base, ids = v[members], rid[members]
            for at in range(0, len(asks) if len(members) else 0, 512):
                q = asks[at : at + 512]
                s = np.minimum(v[q] @ base.T, 1)
                own = np.minimum(np.searchsorted(ids, rid[q]), len(ids) - 1)
                here = ids[own] == rid[q]
                s[np.flatnonzero(here), own[here]] = -3
                low = np.maximum(bar[q], -2)
                if s.shape[1] > k:
                    # a bar at the k-th largest of a row thins it before it is sorted, where its own does not
                    many = np.flatnonzero((low <= -2) | ((s >= low[:, None]).sum(axis=1) > 4 * k))
                    low[many] = np.maximum(low[many], np.partition(s[many], -k, axis=1)[:, -k])
                i, j = np.nonzero(s >= low[:, None])
                who.append(rid[q[i]])
                near.append(ids[j])
                sims.append(s[i, j])
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
        return pa.table({"rid": join(who, np.int64), "near": join(near, np.int64), "sim": join(sims, np.float32)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """Of every rid its k best different neighbours, as arrays sorted by similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, nears, sims = [], [], []
            for rid, pairs in zip(batch.column(0).to_pylist(), batch.column(1)):
                near = np.asarray(pairs.values.field("near"))
                sim = np.asarray(pairs.values.field("sim"))
                order = np.lexsort((near, -sim))
                seen: dict[int, float] = {}
                for o in order:
                    if int(near[o]) not in seen:
                        seen[int(near[o])] = float(sim[o])
                        if len(seen) == k:
                            break
                rids.append(rid)
                nears.append(list(seen))
                sims.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(nears, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32()))], names=["rid", "near", "sims"])

    return found.groupBy("rid").agg(F.collect_list(F.struct("near", "sim")).alias("p")).mapInArrow(run, "rid long, near array<long>, sims array<float>")


def nearest(df: DataFrame, key: str, vector: str, dim: int, k: int = 5) -> DataFrame:
    """(id, rank, near_id, similarity): the k most similar other ids of every id with a valid vector.

    Similarity is the cosine, of components kept to 12 bits; ties go to the smaller id. Of an id given several
    times the vector of the greatest digest counts.
    Fewer than k rows where the collection holds fewer other vectors; none for an empty table.
    Further columns are ignored.
    """
    rows = written(unit_vectors(df, key, vector, dim).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # one row of each id, and classes of equal vectors: m numbers the ids of a class, rep is the row that stands for it.
    # Neither shuffles a vector.
    kept = rows.groupBy("id").agg(F.max(F.struct("h", "rid")).alias("k")).select("id", "k.h", "k.rid")
    same = Window.partitionBy("h").orderBy("id")
    members = kept.withColumn("m", F.row_number().over(same)).withColumn("rep", F.first("rid").over(same))
    members = written(members.select("rid", "id", "m", "rep"), "members")
    some = members.where("m > 1").limit(1).count()
    beside = rows.select("rid").join(members.where("m = 1").select("rid"), "rid", "left_anti")
    points = rows.select("rid", "vec")
    if (over := rows.count() - members.where("m = 1").count()) > 0:
        beside = written(beside, "beside")
        points = points.join(F.broadcast(beside) if over <= MAX_BROADCAST else beside, "rid", "left_anti")
    total = points.count()
    sample = points.select("vec").sample(min(1.0, 1.2 * SAMPLE / max(1, total)), 3).limit(SAMPLE).collect()
    depth = _depth(total, LEAF)
    forest = Forest(_halves(pa.array([bytes(r.vec) for r in sample], pa.binary())), total, FIRST + _rounds(depth), leaf=LEAF)
    leaves = "block long, mask int, rid long, ask boolean, member boolean, bar float, vec binary"
    pairs = "rid long, near long, sim float"
    first = points.mapInArrow(_spread(forest, range(FIRST), True), leaves).groupBy("block").applyInArrow(_search(k), pairs)
    first = written(_best(first, k), "first")
    state = points.withColumn("left", F.lit(1.0))
    for turn in range(_rounds(depth)):
        bars = first.select("rid", F.when(F.size("sims") >= k, F.element_at("sims", k)).cast("float").alias("bar"))
        tree = FIRST + turn
        state = state.select("rid", "vec", "left").join(bars, "rid", "left")
        state = written(state.mapInArrow(_go_on(forest, tree, LEAVES * WIDER**turn), "rid long, leaves array<struct<block: long, mask: int>>, bar float, left double, vec binary"), "failing")
        seen = state.agg(F.sum(F.size("leaves")).alias("s")).first().s
        if not seen:
            break
        # a block that many search is dealt out in slices, each with all its members
        slices = math.ceil(seen / max(1, 2**depth >> BLOCK) / ASKERS)
        members_of = points.mapInArrow(_spread(forest, range(tree, tree + 1), False), leaves).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        askers = state.select(F.inline("leaves"), "rid", "bar", "vec").select("block", "mask", "rid", F.lit(True).alias("ask"), F.lit(False).alias("member"), "bar", "vec", F.pmod(F.hash("rid"), F.lit(slices)).alias("slice"))
        more = members_of.unionByName(askers).groupBy("block", "slice").applyInArrow(_search(k), pairs)
        flat = first.select("rid", F.explode(F.arrays_zip("near", "sims")).alias("p")).select("rid", F.col("p.near").alias("near"), F.col("p.sims").alias("sim"))
        first = written(_best(flat.unionByName(more), k), "best")
    found = first.select("rid", F.explode(F.arrays_zip("near", "sims")).alias("p")).select(F.col("rid").alias("rep"), F.col("p.near").alias("near"), F.col("p.sims").cast("double").alias("similarity"))
    # a class stands in a list with its k + 1 smallest ids; the members of a class find each other first
    heads = members.where(F.col("m") <= k + 1).select(F.col("rep").alias("near"), F.col("id").alias("near_id"))
    lists = found.join(heads, "near").select("rep", "near_id", "similarity")
    copied = members.where("m = 2").select("rep")
    if some:
        own = members.where(F.col("m") <= k + 1).join(copied, "rep", "left_semi").select("rep", F.col("id").alias("near_id"), F.lit(1.0).alias("similarity"))
        lists = lists.unionByName(own)
    # ranked by rep, so that the join with the members finds its rows where they are
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "near_id"))
    lists = lists.withColumn("rank", place).where(F.col("rank") <= k + 1)
    if not some:
        return lists.where(F.col("rank") <= k).join(members.select("rep", "id"), "rep").select("id", "rank", "near_id", "similarity")
    lists = written(lists, "lists")
    alone = lists.where(F.col("rank") <= k).join(members.select("rep", "id").join(copied, "rep", "left_anti"), "rep").select("id", "rank", "near_id", "similarity")
    many = lists.join(members.select("rep", "id").join(copied, "rep", "left_semi"), "rep").where("id <> near_id")
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "near_id"))
    return alone.unionByName(many.withColumn("rank", again).where(F.col("rank") <= k).select("id", "rank", "near_id", "similarity"))
