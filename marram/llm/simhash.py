"""SimHash near-duplicates through pivot distance tables.

Pivots are reference fingerprints. The first table holds the distances to the zero fingerprint and
to 32 pivots of two bits each; as no bit belongs to two of them, a pair that differs in three bits
or fewer agrees in all but three of the 32 coordinates at most. Of six groups of coordinates at least
three agree, so a row is filed under each choice of three groups and meets every partner there. Among
rows that meet, pairs whose distances to any of 16 dense pivots differ by more than three are
discarded, and the survivors are verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, few, raw, runs, word_pieces
from marram.operators.components import connected_components
from marram.sources.shared import materialise, pick

RADIUS = 3
SHINGLE = 3
SEED = 42
GROUPS = 6
#: Rows of a file that are compared in one piece; a larger file is dealt out as pairs of pieces.
PIECE = 1024
#: Bytes of a piece that a longer text is hashed in.
PIECE_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Dense pivots: bit j of pivot i is the parity of the bits that i + 1 and j share, so any two differ in 32 bits.
DENSE = np.array([sum(((i + 1) & j).bit_count() % 2 << j for j in range(64)) for i in range(16)], np.uint64)


def fingerprint(body: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the hashes of all shingles, repeats included; no words: zero."""
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    for first, words, _ in word_pieces(body.translate(_LOWER), size - 1, PIECE_BYTES):
        if not words or (first and len(words) < size):
            continue
        n = max(1, len(words) - size + 1)
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
        ends = ends[min(size, len(words)) - 1 :].tolist()
        h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, n)
        for at in range(0, n, 4096):
            part = h[at : at + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row. A null or empty text has fingerprint zero."""
    out = [("doc_id", pa.int64()), ("fp", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, 4 * PIECE_BYTES)):
            fp = np.fromiter((fingerprint(b) for b in raw(rows.column("text"))), np.uint64, rows.num_rows)
            yield batch(out, [rows.column("doc_id"), fp.view(np.int64)])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def _filed(distinct: DataFrame) -> DataFrame:
    """(key, fp): a row for each choice of three of the six groups of pivot coordinates."""
    x = F.col("fp")
    to = [F.bit_count(x.bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))) for p in (3 << (2 * i) for i in range(32))]
    zero = F.bit_count(x)
    groups = []
    for g in range(GROUPS):
        packed = F.lit(0).cast("long")
        for i in range(g, 32, GROUPS):
            packed = packed * 3 + F.shiftright(zero - to[i] + 2, 1)  # d(x, 0) - d(x, pivot) is -2, 0 or 2
        groups.append(packed.alias(f"g{g}"))
    base = distinct.select("fp", *groups)
    keys = [((F.lit(k).cast("long") * 1024 + F.col(f"g{a}")) * 1024 + F.col(f"g{b}")) * 1024 + F.col(f"g{c}") for k, (a, b, c) in enumerate(combinations(range(GROUPS), GROUPS // 2))]
    return base.select("fp", F.explode(F.array(*keys)).alias("key"))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is linked to by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _linked(fp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of sorted files: fp by file, size of the file from each row on (1 at its last row)."""
    table = np.stack([np.bitwise_count(fp ^ p) for p in DENSE], axis=1).astype(np.int8)
    found_a, found_b, held, label = [], [], 0, None
    rows, shift = np.flatnonzero(size > 1), 1
    while len(rows):
        for at in range(0, len(rows), 1 << 16):
            a = rows[at : at + (1 << 16)]
            b = a + shift
            near = (np.abs(table[a] - table[b]) <= RADIUS).all(axis=1)
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
            found_a.append(a[near]), found_b.append(b[near])
            held += int(near.sum())
        if held > 1 << 20:  # keep a forest, not all links
            label = _forest(len(fp), np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [np.flatnonzero(label != np.arange(len(fp)))], [label[label != np.arange(len(fp))]], 0
        shift += 1
        rows = rows[size[rows] > shift]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = _forest(len(fp), np.concatenate(found_a), np.concatenate(found_b))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return own, label[own]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each file of rows sorted by (key, lo, hi); a file may go on in the next batch."""
    held: list[np.ndarray] = []

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        starts = runs(rows[0] * 0 + np.cumsum(np.concatenate([[0], (np.diff(rows[:3], axis=1) != 0).any(axis=0)])))
        lengths = np.diff(starts)
        size = np.repeat(starts[1:], lengths) - np.arange(rows.shape[1])
        a, b = _linked(rows[3].view(np.uint64), size)
        pairs = np.unique(np.stack([rows[3][a], rows[3][b]]), axis=1)
        return batch([("a", pa.int64()), ("b", pa.int64())], [pairs[0], pairs[1]])

    for part in batches:
        rows = np.stack([part.column(i).to_numpy() for i in range(4)])
        if not rows.shape[1]:
            continue
        rows = np.concatenate([*held, rows], axis=1)
        last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield linked(rows[:, :cut])
        held = [rows[:, cut:].copy()]
    if held and held[0].shape[1]:
        yield linked(held[0])


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints within the radius that connect all that are; not every pair is listed."""
    filed = _filed(distinct)
    shared = filed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = filed.join(shared, "key").withColumn("pieces", F.ceil(F.col("size") / PIECE).cast("long")).withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    dealt = dealt.select("key", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "fp")
    placed = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return placed.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    component_id is the smallest doc_id reachable over links of three differing bits or fewer; rows
    without words have fingerprint zero and are linked like others. Equal fingerprints are one node, so
    groups of copies cost nothing. A null doc_id is kept and never is a component_id (a component
    of null ids only has a null one); repeated rows give repeated results; an empty table gives an empty result;
    very long texts are hashed in pieces that overlap; other columns are ignored, whatever their names.
    """
    prints = materialise(fingerprints(docs), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = connected_components(links(nodes.select("fp")))
    member = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    of = member.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
