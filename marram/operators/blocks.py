"""Searches from many sources at once, by ranges of nodes and blocks of sources.

A row holds what a block of sources has reached in a range of nodes, as a table of bits. A level joins these rows with the arcs
that leave their range; a task adds up what the arcs of one range bring before it is shuffled, and the parts for a range and block are
merged as they stream by in order of their key. So a level moves a node's bits once for each range that it has neighbours in,
not once for each arc, and no task holds more than one range and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marram.sources.shared import Rounds, materialise

#: Nodes of a range, sources of a block (a multiple of 512), and arcs that lie in one row or are gathered at once.
SPAN, WIDE, ARCS, GATHERED = 8192, 2048, 1 << 20, 1 << 16
_WORDS = WIDE // 64
#: Rows of arcs are repeated for this many groups of blocks in all, so that few ranges still make many tasks.
_TASKS = 64

_STATE = "i long, b long, n long, ring binary, seen binary, reached binary, total binary, far binary"
_PARTS = "i long, b long, at binary, bits binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches one by one, as large values are not to be copied all at once."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield tuple(column[r].as_py() for column in batch.columns)


def packed_arcs(arcs: DataFrame, most: int = ARCS) -> DataFrame:
    """(j, heads, tails, starts): arcs (u, v) between labels by the range j of their tail u, in order of their head v, in rows of a bounded number of arcs. tails are places in the range; starts is where each head's tails begin."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(j: int, u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
            tails, ends = np.concatenate(u), np.concatenate(v)
            heads, starts = np.unique(ends, return_index=True)
            return pa.RecordBatch.from_pylist([dict(j=j, heads=heads.astype("<i8").tobytes(), tails=(tails - j * SPAN).astype("<i4").tobytes(), starts=starts.astype("<i4").tobytes())])

        key, us, vs, held = None, [], [], 0
        for batch in batches:
            j, u, v = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(j)) + 1).tolist(), len(j)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and (key != j[a] or held >= most):
                    yield row(key, us, vs)
                    us, vs, held = [], [], 0
                key = int(j[a])
                us.append(u[a:b])
                vs.append(v[a:b])
                held += b - a
        if held:
            yield row(key, us, vs)

    ranged = arcs.select(F.floor(F.col("u") / SPAN).alias("j"), "u", "v").repartition("j").sortWithinPartitions("j", "v", "u")
    return ranged.mapInArrow(pack, "j long, heads binary, tails binary, starts binary")


def _pushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, b, at, bits) of (b, ring, heads, tails, starts): what the arcs bring to the ranges of their heads; at is null if it names every node of the range."""
    for b, ring, heads, tails, starts in _rows(batches):
        ring = np.frombuffer(ring, "<u8").reshape(SPAN, _WORDS)
        heads, tails, starts = np.frombuffer(heads, "<i8"), np.frombuffer(tails, "<i4"), np.frombuffer(starts, "<i4")
        full = ring.any(axis=1)
        if not full.all():  # arcs whose tail has nothing new bring nothing
            kept = full[tails]
            of = np.repeat(np.arange(len(heads)), np.diff(starts, append=len(tails)))[kept]
            tails = tails[kept]
            if not len(tails):
                continue
            used, starts = np.unique(of, return_index=True)
            heads = heads[used]
        ranges = heads // SPAN
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            got = np.empty((last - first, _WORDS), "<u8")
            at = first
            while at < last:  # a head has no more tails than a range has nodes, so a slice is bounded
                to = max(at + 1, min(last, int(np.searchsorted(starts, starts[at] + GATHERED, side="right")) - 1))
                low, high = int(starts[at]), int(starts[to]) if to < len(starts) else len(tails)
                got[at - first : to - first] = np.bitwise_or.reduceat(ring[tails[low:high]], starts[at:to] - low, axis=0)
                at = to
            i = int(ranges[first])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([b], pa.int64()), pa.array([(heads[first:last] - i * SPAN).astype("<i4").tobytes()], pa.binary()), pa.array([got.tobytes()], pa.binary())], ["i", "b", "at", "bits"])


def _merged(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The state at distance d from rows (state..., at, bits) in order of (i, b): what was reached, and parts that come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, new, old = None, None, None

        def settled() -> pa.RecordBatch:
            seen = np.zeros((SPAN, _WORDS), "<u8") if old is None else np.frombuffer(old[0], "<u8").reshape(SPAN, _WORDS).copy()
            sums = [np.zeros(SPAN, t) if old is None else np.frombuffer(s, t).copy() for s, t in zip((None,) * 3 if old is None else old[1:], ("<i8", "<i8", "<i4"), strict=True)]
            n, ring = 0, None
            if new is not None:
                fresh = new & ~seen
                counts = np.bitwise_count(fresh).sum(axis=1, dtype=np.int64)
                n = int(counts.sum())
                if n:
                    ring = fresh.tobytes()
                    seen |= fresh
                    if d:
                        sums[0] += counts
                        sums[1] += counts * d
                        sums[2][counts > 0] = d
            values = [key[0], key[1], n, ring, seen.tobytes(), *[s.tobytes() for s in sums]]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k < 3 else pa.binary()) for k, v in enumerate(values)], ["i", "b", "n", "ring", "seen", "reached", "total", "far"])

        for i, b, seen, reached, total, far, at, bits in _rows(batches):
            if key is not None and key != (i, b):
                yield settled()
                new, old = None, None
            key = (i, b)
            if seen is not None:
                old = (seen, reached, total, far)
            else:
                new = np.zeros((SPAN, _WORDS), "<u8") if new is None else new
                places = np.frombuffer(at, "<i4")
                new[places] |= np.frombuffer(bits, "<u8").reshape(-1, _WORDS)
        if key is not None:
            yield settled()

    return run


_KEPT = ("seen", "reached", "total", "far")


def _merge(parts: DataFrame, state: DataFrame | None, d: int, tasks: int) -> DataFrame:
    rows = parts.select("i", "b", *[F.lit(None).cast("binary").alias(c) for c in _KEPT], "at", "bits")
    if state is not None:
        rows = rows.union(state.select("i", "b", *_KEPT, *[F.lit(None).cast("binary").alias(c) for c in ("at", "bits")]))
    # Spark would put partitions together by their compressed size, and bits that are nearly all 0 or 1 are packed to nothing.
    return rows.repartition(tasks, "i", "b").sortWithinPartitions("i", "b").mapInArrow(_merged(d), _STATE)


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part for each source: its own bit, at its own node."""
    for batch in batches:
        node, source = (c.to_numpy() for c in batch.columns)
        if not len(node):
            continue
        bits = np.zeros((len(node), _WORDS), "<u8")
        bits[np.arange(len(node)), source % WIDE // 64] = np.left_shift(np.uint64(1), (source % 64).astype("<u8"))
        at = (node % SPAN).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array(node // SPAN, pa.int64()), pa.array(source // WIDE, pa.int64()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary())], ["i", "b", "at", "bits"])


#: Rows of a state (at most 4 MB each) from which on a search goes on with half of its blocks and leaves the others for later.
MOST = 256


def levels(arcs: DataFrame, sources: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(d, state) for d = 1, 2, ... of a search from sources (node, source: a number from 0) along arcs (u, v), nodes by label from 0, until nothing new is reached.

    The last state is that of the level before, with what each node was reached by in sum (sums). A state must be used up before the next but one is asked for.
    """
    for d, state, _ in searches(arcs, sources, None):
        yield d, state


def searches(arcs: DataFrame, sources: DataFrame, most: int | None = MOST) -> Iterator[tuple[int, DataFrame, bool]]:
    """As levels, in turns of blocks: (d, state, whether it is the last one of its blocks).

    While a state has more than `most` rows the later half of its blocks is written down and taken up at its level when the others have ended, so what is
    kept at once doesn't grow with nodes times sources: `most` rows at work, and as many left for each halving. No limit if it is None.
    """
    packed = materialise(packed_arcs(arcs), "arcs")
    ranges = max(1, packed.select("j").distinct().count())
    groups = max(1, _TASKS // ranges)
    dealt = packed.withColumn("g", F.explode(F.array(*[F.lit(k) for k in range(groups)])))

    def tasks(told: dict) -> int:
        return max(arcs.sparkSession.sparkContext.defaultParallelism, min(_TASKS, told["rows"] // 12))

    def written(rows: DataFrame, states: Rounds) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = states.write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.min("b").alias("first"), F.max("b").alias("last")), "state")
        return out, seen.get

    states = Rounds(2)
    waiting = [(0, *written(_merge(sources.select("node", "source").mapInArrow(_started, _PARTS), None, 0, _TASKS), states), states)]
    while waiting:
        d, state, told, states = waiting.pop()
        while True:
            if most is not None and told["rows"] > most and told["first"] < told["last"]:
                middle = (told["first"] + told["last"]) // 2
                later = Rounds(2)
                waiting.append((d, *written(state.where(F.col("b") > middle), later), later))
                state, told = written(state.where(F.col("b") <= middle), states)
                continue
            d += 1
            ring = state.where("n > 0").select("i", "b", "ring").withColumn("g", F.pmod("b", F.lit(groups)).cast("int"))
            met = ring.join(dealt, (ring["i"] == dealt["j"]) & (ring["g"] == dealt["g"])).select("b", "ring", "heads", "tails", "starts")
            state, told = written(_merge(met.mapInArrow(_pushed, _PARTS), state, d, tasks(told)), states)
            done = not told["n"]
            yield d, state, done
            if done:
                break
        states.paths.pop()  # the caller may still read the last state
        states.clear(arcs.sparkSession)


def packed_members(rows: DataFrame) -> DataFrame:
    """(key, s, m): of rows (key, set, at) with sets by number from 0, the (set, at) of each key and 256 sets (s) in one list."""
    return rows.groupBy("key", F.floor(F.col("set") / 256).alias("s")).agg(F.collect_list(F.struct((F.col("set") % 256).cast("int").alias("set"), F.col("at").cast("int").alias("at"))).alias("m"))


def _lists(column: pa.Array, r: int) -> tuple[np.ndarray, np.ndarray]:
    values = column[r].values
    return values.field("set").to_numpy(), values.field("at").to_numpy()


def met_in_sets(state: DataFrame, at: DataFrame, of: DataFrame) -> DataFrame:
    """(set, n): how many pairs of a set's sources and nodes a state has reached anew. at: packed_members of nodes by range, places in it; of: those of sources by block, places in it.

    A range gives a block of sources the bits of the nodes that are in sets, once for 256 sets; there they are counted under the masks of these sets.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b, s = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                ring = np.frombuffer(batch.column(2)[r].as_py(), "<u8").reshape(SPAN, _WORDS)
                sets, places = _lists(batch.column(3), r)
                some = ring.any(axis=1)[places]
                sets, places = sets[some], places[some]
                if len(places):
                    own, row = np.unique(places, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([s], pa.int64()), pa.array([sets.astype("<i4").tobytes()], pa.binary()), pa.array([row.astype("<i4").tobytes()], pa.binary()), pa.array([ring[own].tobytes()], pa.binary())], ["b", "s", "sets", "rows", "bits"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = batch.column(0)[r].as_py()
                sets, rows = (np.frombuffer(batch.column(k)[r].as_py(), "<i4") for k in (1, 2))
                bits = np.frombuffer(batch.column(3)[r].as_py(), "<u8").reshape(-1, _WORDS)
                mask, (whose, places) = np.zeros((256, _WORDS), "<u8"), _lists(batch.column(4), r)
                np.bitwise_or.at(mask, (whose, places // 64), np.left_shift(np.uint64(1), (places % 64).astype("<u8")))
                n = np.zeros(256, np.int64)
                for first in range(0, len(sets), GATHERED):
                    own = sets[first : first + GATHERED]
                    np.add.at(n, own, np.bitwise_count(bits[rows[first : first + GATHERED]] & mask[own]).sum(axis=1, dtype=np.int64))
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(found + 256 * s, pa.int64()), pa.array(n[found], pa.int64())], ["set", "n"])

    ring = state.where("n > 0").select("i", "b", "ring")
    got = ring.join(at.select(F.col("key").alias("i"), "s", "m"), "i").select("b", "s", "ring", "m").mapInArrow(gathered, "b long, s long, sets binary, rows binary, bits binary")
    under = got.join(of.select(F.col("key").alias("b"), "s", "m"), ["b", "s"]).select("s", "sets", "rows", "bits", "m")
    return under.mapInArrow(counted, "set long, n long").groupBy("set").agg(F.sum("n").alias("n"))


def sums(state: DataFrame) -> DataFrame:
    """(label, reached, total, farthest) of every node that another source has reached, from a state; one row for each block of sources that did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, *values in _rows(batches):
            reached, total, far = (np.frombuffer(v, t) for v, t in zip(values, ("<i8", "<i8", "<i4"), strict=True))
            at = np.flatnonzero(reached)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (at + i * SPAN, reached[at], total[at], far[at])], ["label", "reached", "total", "farthest"])

    return state.select("i", "reached", "total", "far").mapInArrow(run, "label long, reached long, total long, farthest long")
