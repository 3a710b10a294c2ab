"""Exact top-k by inner product with an impact-ordered index, processed score at a time.

Components are integers. In a shard, the postings of each dimension lie in the order of their distance from
the dimension's median, cut into segments of equal quantised distance; a segment's impact for a query is the
largest product that a member can add to, or take from, the score of the medians. Segments are processed by
descending impact. The largest impacts not yet processed, one for each of a row's open dimensions, bound its score from
both sides; processing stops only when that proves that few rows can be among the best, and those are scored
exactly. A bounded sample of rows gives each query a first score to beat. All queries meet all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.sources.shared import materialise, pick

SCALE = 256
#: Rows of a shard at most, about, and at least while there are idle tasks (a hash deals them out).
SHARD_ROWS, LEAST_ROWS = 32_768, 1024
#: Rows whose best scores are the first to beat.
SAMPLE_ROWS = 1024
#: Quantised distances of a dimension, at most twice as many.
LEVELS = 64
#: Processing ends once so many rows at most, or this share of the shard, can be among the best.
FEW, SHARE = 64, 16


def integer_vectors(embeddings: DataFrame, scale: int = SCALE, *, every_row: bool = False) -> DataFrame:
    """vec_id and vec array<long>: floor(scale * x) of each component.

    Rows without an id, null vectors and vectors with a null or non-finite component are left out. With
    every_row all others count, as in the query's SQL; without, of repeated ids the smallest vector.
    """
    rows = pick(embeddings, vec_id="long", embedding="array<double>").where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))
    rows = rows.where(finite).select("vec_id", vec.alias("vec"))
    return rows if every_row else rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


class ImpactIndex:
    """Posting segments of a shard. vectors: one row each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, width = vectors.shape
        self.center = np.sort(self.vectors, axis=0)[n // 2] if n else np.zeros(width, np.int64)
        away = self.vectors - self.center
        by = np.argsort(away.T, axis=1, kind="stable")
        self.rows, values = by, np.take_along_axis(away.T, by, axis=1)
        self.most = np.abs(away).max(axis=0, initial=0)
        self.largest = int(self.most.max(initial=0))
        self.shift = max(0, self.largest.bit_length() - LEVELS.bit_length() + 1)
        levels = np.arange((self.largest >> self.shift) + 2) << self.shift
        self.top = len(levels) - 1
        #: Where, in a dimension's postings, the distances of a level and above begin, and where those below the median end.
        self.above = np.stack([np.searchsorted(v, levels) for v in values]) if width else np.zeros((0, len(levels)), np.int64)
        self.below = np.stack([np.searchsorted(v, -levels, side="right") for v in values]) if width else self.above
        self.below[:, 0] = self.above[:, 0]
        self.values = values.astype(np.float64)
        self.begin = 1 / 4  # share of the largest impact at which the last proof came
        self.queries = self.processed = self.scored = 0  # postings processed and rows scored exactly

    def search(self, query: np.ndarray, k: int, own: int, beat: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the query's own id, ties to the smaller id; rows below the score to beat may be left out."""
        n = len(self.ids)
        left_out = slice(*(int(np.searchsorted(self.ids, own, side)) for side in ("left", "right")))
        k = min(k, n - (left_out.stop - left_out.start))
        if k <= 0:
            return self.ids[:0], self.vectors[:0].sum(axis=1)
        self.queries += 1
        dims = np.flatnonzero(query)
        size = np.abs(query[dims])
        if float(size.sum()) * max(1, self.largest) * (len(dims) + 1) >= 2**50:  # sums and counts would not be exact
            possible = np.arange(n)
        else:
            possible = self._possible(query, dims, size, k, left_out, beat)
        possible = possible[(possible < left_out.start) | (possible >= left_out.stop)]
        self.scored += len(possible)
        exact = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible[best]], exact[best]

    def _possible(self, query: np.ndarray, dims: np.ndarray, size: np.ndarray, k: int, left_out: slice, beat: float) -> np.ndarray:
        n, base = len(self.ids), float(self.center @ query)
        one = float(1 << (2 * int(float(size.sum()) * self.largest) + 2).bit_length())  # a posting adds this to what it adds to a score, so one sum counts too
        score, left = np.full(n, base), np.full(n, len(dims))
        score[left_out] = -np.inf
        level = np.full(len(dims), self.top)
        largest, share = int(size.max(initial=0)) * self.largest, self.begin
        while True:
            impact = max(1.0, largest * share)
            to = np.minimum(level, np.ceil(impact / size).astype(np.int64) >> self.shift)
            if impact == 1.0:
                to[:] = 0
            rows, adds = [], []
            for d, a, b, c, e, w in zip(dims.tolist(), self.above[dims, to].tolist(), self.above[dims, level].tolist(), self.below[dims, level].tolist(), self.below[dims, to].tolist(), query[dims].tolist(), strict=True):
                if a < b:
                    rows.append(self.rows[d, a:b])
                    adds.append(self.values[d, a:b] * w + one)
                if c < e:
                    rows.append(self.rows[d, c:e])
                    adds.append(self.values[d, c:e] * w + one)
            level = to
            if rows:
                every = np.concatenate(rows)
                self.processed += len(every)
                sums = np.bincount(every, np.concatenate(adds), n)
                counts = np.rint(sums / one)
                score += sums - counts * one
                left -= counts.astype(np.int64)
            # The most that a row's open dimensions can add or take: the largest impacts not processed, one a dimension.
            rest = np.sort(size * np.minimum(np.maximum((level << self.shift) - 1, 0), self.most[dims]))[::-1]
            open_ = np.concatenate([[0.0], np.cumsum(rest, dtype=np.float64)])[left]
            proof = max(np.partition(score - open_, n - k)[n - k], beat)
            possible = np.flatnonzero(score + open_ >= proof)
            if len(possible) <= max(FEW, k, n // SHARE) or not level.any():
                self.begin = share * 1.2 if share == self.begin else share
                return possible
            share /= 1.4


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))])
    out = np.zeros((len(vectors), width), np.int64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def _beaten(queries: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """Queries with the k-th best of their scores in a bounded sample of the rows (null if it has fewer): no row of the result scores less."""
    known = [(r[0], r[1]) for r in sample.collect()]  # SAMPLE_ROWS at most
    width = max((len(v) for _, v in known), default=0)
    shared = queries.sparkSession.sparkContext.broadcast((np.array([i for i, _ in known], np.int64), np.array([[*v, *[0] * (width - len(v))] for _, v in known], np.int64).reshape(len(known), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        for part in batches:
            for at in range(0, part.num_rows, 256):
                few = part.slice(at, 256)
                vectors = _matrix(few.column("vec"), max(width, int(few.column("vec").value_lengths().to_numpy(zero_copy_only=False).max(initial=0))))
                out = []
                for own, vector in zip(few.column("vec_id").to_pylist(), vectors, strict=True):
                    scores = np.sort((rows @ vector[:width])[ids != own])
                    out.append(float(scores[-k]) if len(scores) >= k else None)
                yield pa.RecordBatch.from_arrays([few.column("vec_id"), few.column("vec"), pa.array(out, pa.float64())], names=["vec_id", "vec", "beat"])

    return queries.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<long>, beat double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each id of the rows that is_query marks; rows with that id are no candidates.

    vectors: vec_id and vec array<long>. Every row is a candidate, so an id that repeats can be listed repeatedly; where
    queries share an id, the best of all their pairs count. Shorter vectors count as if they ended in zeros.
    A query with no other row has no result; an empty table gives an empty one. The rows of a shard move once, and each
    query once a shard.
    """
    vectors = materialise(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_rows = vectors.count()
    idle = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n_rows // SHARD_ROWS), min(idle, -(-n_rows // LEAST_ROWS)))
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("vec_id", "vec")
    queries = _beaten(vectors.where(is_query), sample, k)
    rows = vectors.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "vec", F.lit(None).cast("double").alias("beat"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vec", "beat")
    met = rows.union(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "asks")
    out = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        for part in batches:
            keys, asks = part.column("shard").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]), [True]])) if len(keys) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some = part.slice(a, b - a)
                if keys[a] != shard:
                    shard, held, index = keys[a], [], None
                if not asks[a]:
                    held.append(some)
                    continue
                if index is None:
                    every = pa.Table.from_batches(held).combine_chunks() if held else some.slice(0, 0)
                    vecs = every.column("vec").combine_chunks() if held else every.column("vec")
                    width = int(vecs.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
                    index, held = ImpactIndex(every.column("vec_id").to_numpy(), _matrix(vecs, width)), []
                longest = max(width, int(some.column("vec").value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))
                found: tuple[list, list, list] = ([], [], [])
                for query_id, beat, query in zip(some.column("vec_id").to_pylist(), some.column("beat").to_pylist(), _matrix(some.column("vec"), longest), strict=True):
                    ids, scores = index.search(query[:width], k, query_id, -np.inf if beat is None else beat)
                    found[0].extend([query_id] * len(ids)), found[1].extend(ids.tolist()), found[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(found, out, strict=True)], names=[c for c, _ in out])

    best = met.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
