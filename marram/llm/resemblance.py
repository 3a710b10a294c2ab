"""Near copies by SimHash fingerprints and by word shingles: a Jaccard similarity of 0.8 or more, candidates by MinHash, each link verified.

Fingerprints are those of simhash, linked through its pivot tables at three differing bits or fewer. Pairs of similarity 0.8 differ in
more bits than that, so the sets of shingles add their own links; neither kind replaces the other.

A text is the set of its shingles of five words (hashed to 64 bits; words are cut at ASCII blanks, A to Z in
lower case). Least values of the set under 80 permutations form 20 keys of four values each; a pair of similarity s
shares no key with probability (1 - s^4)^20, 2.6e-5 at 0.8 and 5e-10 at 0.9. Texts that share a key meet in a
task, where their sets are built again and compared exactly; only links that pass connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm import simhash
from marram.llm.arrays import batch, carried, ddl, few, raw, word_pieces
from marram.operators.components import connected_components
from marram.sources.shared import materialise, pick

WORDS = 5
SEED = 42
KEYS, VALUES = 20, 4
#: Bytes of a piece that a longer text is hashed in.
PIECE_BYTES = 1 << 20
#: Texts and shingles of a key that are compared in one piece; a larger key is dealt out as pairs of pieces.
PIECE, PIECE_SHINGLES = 1024, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.array([[xxhash.xxh64_intdigest(bytes([i, j]), SEED) for i in range(KEYS * VALUES)] for j in range(2)], np.uint64)


def shingles(body: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one of none has none."""
    found, digest = [np.zeros(0, np.uint64)], xxhash.xxh64_intdigest
    for first, words, _ in word_pieces(body.translate(_LOWER), size - 1, PIECE_BYTES):
        if not words or (first and len(words) < size):
            continue
        line, n = b" ".join(words), max(1, len(words) - size + 1)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
        found.append(np.unique(np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist(), strict=True)], np.uint64, n)))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def keys(own: np.ndarray) -> list[int]:
    """The keys of a set, none for the empty one."""
    if not len(own):
        return []
    least = np.full(KEYS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, ((own[at : at + 4096, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[VALUES * k : VALUES * (k + 1)].tobytes(), k) - (1 << 63) for k in range(KEYS)]


def tree(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Verified links that connect all sets which chains of similar sets connect."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    mark, left = np.zeros(len(known), np.int64), np.ones(len(sets), bool)
    found: tuple[list[int], list[int]] = ([], [])
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue:
            i = queue.pop()
            other = np.flatnonzero(left & (5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i])))
            if not len(other):
                continue
            mark[parts[i]] = 1
            common = np.add.reduceat(mark[np.concatenate([parts[j] for j in other])], np.concatenate([[0], np.cumsum(sizes[other])[:-1]]))
            mark[parts[i]] = 0
            near = other[9 * common >= 4 * (sizes[i] + sizes[other])]  # common / union >= 4 / 5
            left[near] = False
            found[0].extend([i] * len(near)), found[1].extend(near.tolist())
            queue += near.tolist()
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each file of rows sorted by (key, lo, hi); a file may go on in the next batch."""
    file, nodes, sets = None, [], []

    def linked() -> pa.RecordBatch:
        a, b = tree(sets) if len(sets) > 1 else ([], [])
        return batch([("a", pa.int64()), ("b", pa.int64())], [[nodes[i] for i in a], [nodes[i] for i in b]])

    for rows in (some for part in batches for some in few(part, 4 * PIECE_BYTES)):
        for *place, node, body in zip(*(rows.column(c).to_pylist() for c in ("key", "lo", "hi", "node")), raw(rows.column("text")), strict=True):
            if place != file:
                yield linked()
                file, nodes, sets = place, [], []
            nodes.append(node), sets.append(shingles(body))
    yield linked()


def sketches(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns (name: type), the SimHash fingerprint, a digest of the shingle set, its size and keys, and a row number that holds once written."""
    out = [("fp", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, 4 * PIECE_BYTES)):
            found = []
            for body in raw(rows.column("text")):
                own = shingles(body)
                fp = simhash.fingerprint(body)
                found.append((fp - (1 << 64) if fp >> 63 else fp, xxhash.xxh3_128_digest(own.tobytes()), len(own), keys(own)))
            yield carried(batch(out, [list(x) for x in zip(*found, strict=True)] or [[], [], [], []]), rows, columns)

    return pick(docs, **columns).mapInArrow(run, "fp long, digest binary, size long, keys array<long>" + ddl(columns)).withColumn("row", F.monotonically_increasing_id())


def links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of similarity 0.8 or more that connect all that are; not every pair is listed."""
    filed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("sum")).where("n > 1")
    pieces = F.ceil(F.greatest(F.col("n") / PIECE, F.col("sum") / PIECE_SHINGLES)).cast("long")
    met = filed.join(shared, "key").withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    place = F.struct("key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"))
    places = dealt.groupBy("node").agg(F.collect_list(place).alias("places"))
    texts = rows.select(F.col("row").alias("node"), "text").join(places, "node").select("node", "text", F.inline("places"))
    placed = texts.select("key", "lo", "hi", "node", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return placed.mapInArrow(_links, "a long, b long")


def fingerprint_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are linked by simhash, through the least node of each fingerprint."""
    of = materialise(rows.select("digest", "fp").distinct().join(nodes.select("digest", "node"), "digest").select("node", "fp"), "prints")
    least = materialise(of.groupBy("fp").agg(F.min("node").alias("first")), "first")
    same = of.join(least, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (least.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in ("a", "b"))
    near = simhash.links(least.select("fp")).join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.union(near)


def keep_one_of_each(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of each group that chains of texts with linked fingerprints or similar sets connect: the smallest doc_id, null ones last, of equal ids any one row.

    columns: name and type of what is kept, with doc_id and text. Texts with equal shingle sets are one
    node, so groups of copies cost nothing; rows without a word are copies of each other.
    """
    rows = materialise(sketches(docs, columns), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    nodes = materialise(rows.groupBy("digest").agg(F.min("row").alias("node"), first, F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    groups = connected_components(fingerprint_links(rows, nodes).union(links(rows, nodes)))
    member = nodes.join(groups, "node", "left").select(F.coalesce("component", "node").alias("component"), "first")
    kept = member.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*columns)
