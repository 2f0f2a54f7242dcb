"""p6: passages of test items inside training documents.

The unit retrieved is a run of RUN consecutive words of a test item. A BM25 inverted index holds the runs; the
threshold of a run is its own score, the least a passage that contains it can have, so nothing verifiable is lost
and there is no top-k and no cap. With that threshold WAND's pivot is the run's heaviest (rarest) term: a passage
without it stays below. Runs that follow each other and share that term at one place form a block, posted once,
under that term only. A posting is met by the passages around each occurrence of the term, the RUN - 1 words on
both sides; the block-max test drops the block unless the passage has every term that all runs of the block hold
(without one of them no run of the block can reach its threshold). What is left is verified word by word.

All steps work on arrays of a batch of documents. Items with fewer than RUN words cannot have a case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 13
K1, B = 1.5, 0.75
#: Items indexed at once. More items are searched in further blocks of this many, each read by one more scan of the documents.
MAX_INDEX = 50_000
#: (occurrence, block) pairs tested at once, and words of documents taken at once.
PAIRS, WORDS = 1 << 20, 1 << 20
_WORD = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class BlockMaxIndex:
    """Blocks of runs by their heaviest term, as arrays."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        docs = [(i, w) for i, t in sorted(items) if len(w := words(t)) >= run]
        self.ids = np.array([i for i, _ in docs], np.int64)
        self.terms: dict[str, int] = {}
        own = [np.array([self.terms.setdefault(t, len(self.terms)) for t in w], np.int32) for _, w in docs]
        gap = np.full(run, -2, np.int32)  # no run and no comparison reaches from one item into the next
        self.flat = np.concatenate([gap, *(x for w in own for x in (w, gap))])
        item = np.full(len(self.flat), -1, np.int64)
        weight = np.zeros(len(self.flat))
        df = np.zeros(len(self.terms))
        for w in own:
            df[np.unique(w)] += 1
        idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        average, at = sum(map(len, own)) / max(1, len(own)), run
        for d, w in enumerate(own):
            _, place, count = np.unique(w, return_inverse=True, return_counts=True)
            tf = count[place]
            weight[at : at + len(w)] = idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / average))
            item[at : at + len(w)] = d
            at += len(w) + run
        windows = np.lib.stride_tricks.sliding_window_view
        start = np.flatnonzero((windows(self.flat, run) >= 0).all(axis=1)) if len(docs) else np.zeros(0, np.int64)
        pivot = start + windows(weight, run)[start].argmax(axis=1) if len(start) else start
        # blocks: runs in a row with their pivot at one place
        new = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(pivot) != 0)]) if len(start) else start
        self.first, self.last, self.pivot = start[new], start[np.r_[new[1:], len(start)] - 1] if len(new) else start, pivot[new]
        order = np.argsort(self.flat[self.pivot], kind="stable")
        self.first, self.last, self.pivot = self.first[order], self.last[order], self.pivot[order]
        self.item = item[self.pivot]
        self.offsets = np.searchsorted(self.flat[self.pivot], np.arange(len(self.terms) + 1))
        self.bit = np.uint64(1) << (np.arange(len(self.terms), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
        # the terms that stand in every run of a block are those from its last start to its first end
        self.common = np.zeros(len(self.pivot), np.uint64)
        bits = np.where(self.flat >= 0, self.bit[np.maximum(self.flat, 0)], np.uint64(0)) if len(docs) else np.zeros(len(self.flat), np.uint64)
        for d in range(run):
            inside = self.last + d <= self.first + run - 1
            self.common[inside] |= bits[self.last[inside] + d]
        # runs of equal words are one run
        self.content = np.full(len(self.flat), -1, np.int64)
        if len(start):
            cut = np.ascontiguousarray(windows(self.flat, run)[start]).view(np.dtype((np.void, 4 * run))).ravel()
            self.content[start] = np.unique(cut, return_inverse=True)[1].ravel()

    def retrieve(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, blocks) that pass the block-max test; x: term numbers of documents, RUN words of -1 between them."""
        run = self.run
        known = x >= 0
        here = np.where(known, self.bit[np.maximum(x, 0)], np.uint64(0))
        around, width = here.copy(), 1  # terms of the passage around each place
        reach = 2 * run - 1
        while width < reach:
            step = min(width, reach - width)
            around[: len(x) - step] |= around[step:].copy()
            width += step
        around = np.r_[np.zeros(run - 1, np.uint64), around[: len(x) - run + 1]]
        # a run needs RUN words in a row that the index knows
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        long = np.zeros(len(x) + 1, np.int8)
        keep = edge[1::2] - edge[::2] >= run
        np.add.at(long, edge[::2][keep], 1)
        np.add.at(long, edge[1::2][keep], -1)
        place = np.flatnonzero(np.cumsum(long[:-1]) > 0)
        t = x[place]
        count = self.offsets[t + 1] - self.offsets[t]
        place, t, count = place[count > 0], t[count > 0], count[count > 0]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(place):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            c = count[lo:hi]
            p = np.repeat(place[lo:hi], c)
            b = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.offsets[t[lo:hi]], c)
            ok = self.common[b] & ~around[p] == 0
            yield p[ok], b[ok]
            lo = hi

    def verify(self, x: np.ndarray, p: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, run) of the runs that stand in x word by word."""
        q = self.pivot[b]
        extent = []
        for sign in (1, -1):
            n, alive = np.zeros(len(p), np.int64), np.arange(len(p))
            for d in range(1, self.run):
                alive = alive[x[p[alive] + sign * d] == self.flat[q[alive] + sign * d]]
                if not len(alive):
                    break
                n[alive] = d
            extent.append(n)
        low, high = np.maximum(self.first[b], q - extent[1]), np.minimum(self.last[b], q + extent[0] - self.run + 1)
        n = np.maximum(0, high - low + 1)
        start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(p, n), np.repeat(self.item[b], n), self.content[start]

    def leaks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, runs): numbers of the texts, of the items they hold runs of, and how many different runs."""
        found, get, run = [], self.terms.get, self.run
        none = np.zeros(0, np.int64)
        if not self.terms:
            return none, none, none
        held, sizes, which = [], [], []

        def take() -> None:
            if not held:
                return
            n = np.array(sizes)
            at = np.cumsum(n + run) - n  # RUN places before each text, and after the last
            x = np.full(int((n + run).sum()) + run, -1, np.int32)
            flat = np.array(held, np.int32)
            x[np.repeat(at, n) + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
            for p, b in self.retrieve(x):
                where, item, content = self.verify(x, p, b)
                if len(where):
                    found.append(np.unique(np.stack([np.array(which)[np.searchsorted(at, where, "right") - 1], item, content]), axis=1))
            held.clear(), sizes.clear(), which.clear()

        for i, text in enumerate(texts):
            w = words(text)
            if len(w) >= run:
                held.extend([get(t, -1) for t in w])
                sizes.append(len(w))
                which.append(i)
                if len(held) > WORDS:
                    take()
        take()
        if not found:
            return none, none, none
        every = np.unique(np.concatenate(found, axis=1), axis=1)
        pairs, n = np.unique(every[:2], axis=1, return_counts=True)
        return pairs[0], pairs[1], n


def _search(held):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockMaxIndex.__new__(BlockMaxIndex)  # the arrays are broadcast, the code travels with this function
        index.__dict__.update(held.value)
        for batch in batches:
            which, item, runs = index.leaks(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(index.ids[item]), pa.array(runs, pa.int64())], names=["doc_id", "item_id", "runs"])

    return go


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN, max_index: int = MAX_INDEX) -> DataFrame:
    """(doc_id, item_id, runs): documents with `run` or more consecutive words of an item, and how many different such runs.

    documents: doc_id bigint, text; items: item_id bigint, text; further columns are ignored. Null, blank and
    short texts have no case; repeated documents each give their rows; the texts of a repeated item_id count as
    one item. Items are taken in blocks of max_index rows (a stated query set, searched against all documents; a
    block ends with an item_id), indexed once on the driver and broadcast. Documents are scanned once per block,
    whole, without a shuffle.
    """
    sc = documents.sparkSession.sparkContext
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    out, last = None, -math.inf
    while True:
        block = wanted if last == -math.inf else wanted.where(F.col("item_id") > last)
        rows = block.orderBy("item_id").limit(max_index).collect()
        if not rows and out is not None:
            return out
        whole = len(rows) < max_index
        if not whole:
            last = rows[-1].item_id
            rows = [r for r in rows if r.item_id < last] + wanted.where(F.col("item_id") == last).collect()
        part = texts.mapInArrow(_search(sc.broadcast(vars(BlockMaxIndex([(r.item_id, r.text) for r in rows], run)))), "doc_id long, item_id long, runs long")
        out = part if out is None else out.unionByName(part)
        if whole:
            return out
