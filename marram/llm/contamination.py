"""Benchmark decontamination: an FM-index over each training shard, searched for every test window.

A shard is a bounded slice of a partition. Its words are numbered by the vocabulary of the test
windows; words outside it can't be part of an occurrence, so the index holds only the runs of known
words that are long enough for the shortest window. All windows are searched backward together,
occurrences are located by sampled positions, and their spans are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, carried, ddl, few, raw, word_pieces
from marram.llm.fmindex import FMIndex
from marram.sources.shared import materialise, pick

WINDOW = 13
#: A block of test items holds about so many bytes of text; more items make more blocks, each searched over all rows.
BLOCK_BYTES = 4 << 20
#: Text bytes of a shard at most (one longer document makes a shard of its own).
SHARD_BYTES = 4 << 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split(body: bytes) -> list[bytes]:
    """Lower-cased words: runs of a-z, 0-9 and bytes from 128."""
    return body.translate(_WORDS).split()


class Windows:
    """The distinct windows of a block of items as right-aligned symbol rows, with the items each occurs in."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        rows, of = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, body in items:
            symbols = np.array([self.number.setdefault(w, len(self.number) + 1) for w in split(body)], np.int32)
            if not len(symbols):
                continue
            padded = np.concatenate([np.zeros(max(0, window - len(symbols)), np.int32), symbols])
            rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(padded, window), axis=0))
            of.append(np.full(len(rows[-1]), item))
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        #: Items by window: those of window w are items[first[w] : first[w + 1]].
        order = np.lexsort((np.concatenate(of), which.ravel()))
        self.items, self.first = np.concatenate(of)[order], np.searchsorted(which.ravel()[order], np.arange(len(self.patterns) + 1))


def _spans(windows: Windows, bodies: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """Words, merged hit spans (in words) and items of each document of a shard."""
    n_words, spans, items = [], [[] for _ in bodies], [set() for _ in bodies]
    parts, docs, firsts = [], [], []  # the runs of known words: symbols, document, first word
    get = windows.number.get
    for d, body in enumerate(bodies):
        found = split(body)
        n_words.append(len(found))
        if not windows.shortest or len(found) < windows.shortest:
            continue
        symbols = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        gaps = np.flatnonzero(np.concatenate([[True], symbols == 0, [True]]))
        for a, b in zip(*(x[np.diff(gaps) > windows.shortest] for x in (gaps[:-1], gaps[1:])), strict=True):
            parts.append(np.append(symbols[a : b - 1], 0))
            docs.append(d)
            firsts.append(a)
    if not parts:
        return n_words, spans, items
    index = FMIndex(np.concatenate(parts), len(windows.number))
    lo, hi = index.search(windows.patterns, windows.lengths)
    hit = np.flatnonzero(lo < hi)
    counts = hi[hit] - lo[hit]
    rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    window = np.repeat(hit, counts)
    at = index.locate(rows)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    part = np.searchsorted(starts, at, side="right") - 1
    first = at - starts[part] + np.array(firsts)[part]
    doc = np.array(docs)[part]
    order = np.lexsort((first, doc))
    for d, a, w in zip(doc[order].tolist(), first[order].tolist(), window[order].tolist(), strict=True):
        b = a + int(windows.lengths[w])
        own = spans[d]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], b))
        else:
            own.append((a, b))
        items[d].update(windows.items[windows.first[w] : windows.first[w + 1]].tolist())
    return n_words, spans, items


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _search(docs: DataFrame, windows: Windows, carry: dict[str, str]) -> DataFrame:
    """Searches for one block of items; spans and items that a row has from earlier blocks are merged in."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (some for rows in batches for some in few(rows, SHARD_BYTES)):
            n_words, spans, items = _spans(shared.value, raw(part.column("text")))
            if "spans" in part.schema.names:
                spans = [_merged([*map(tuple, old), *new]) for old, new in zip(part.column("spans").to_pylist(), spans, strict=True)]
                items = [new.union(old) for old, new in zip(part.column("items").to_pylist(), items, strict=True)]
            yield carried(batch(_OUT, [part.column("doc_id"), n_words, spans, [sorted(s) for s in items]]), part, carry)

    return docs.mapInArrow(run, "doc_id long, n_words long, spans array<array<int>>, items array<long>" + ddl(carry))


def _test_pieces(tests: DataFrame, window: int) -> DataFrame:
    """item_id, first and text: items longer than a quarter of a block come in pieces that overlap, so that all windows stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, BLOCK_BYTES)):
            out: tuple[list, list, list] = ([], [], [])
            for item, body in zip(rows.column("item_id").to_pylist(), raw(rows.column("text")), strict=True):
                for first, words, _ in word_pieces(body.translate(_WORDS), window - 1, max(1, BLOCK_BYTES // 4)):
                    if words and not (first and len(words) < window):
                        out[0].append(item), out[1].append(first), out[2].append(b" ".join(words).decode())
            yield batch([("item_id", pa.int64()), ("first", pa.int64()), ("text", pa.string())], list(out))

    return tests.mapInArrow(run, "item_id long, first long, text string")


def find_occurrences(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, spans array<array<int>> (first word, word after the last), items array<long> of every row, and the columns to carry (name: type).

    Test items are read in blocks of bounded size; each block is one more pass over the rows, without a
    shuffle. Test rows without an id or a text take no part; repeated ones count once. A null or empty
    text has no words. Null document ids are kept, repeated rows give repeated results, empty tables give no
    hits or no rows, very long texts make shards (and very long items blocks) of their own, and other columns are
    ignored, whatever their names.
    """
    carry = carry or {}
    found = pick(docs, **{"doc_id": "long", "text": "string", **carry})
    tests = _test_pieces(pick(benchmark, item_id="long", text="string").where("item_id is not null and text is not null"), window)
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    if blocks > 1:
        tests = materialise(tests.distinct(), "tests")  # repeated rows would all be in one block
    for k in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("item_id", "first", "text"), F.lit(blocks)) == k) if blocks > 1 else tests
        windows = Windows([(r[0], r[1].encode()) for r in block.select("item_id", "text").collect()], window)
        found = _search(found, windows, carry if k == blocks - 1 else {"text": "string", **carry})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", *carry)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))
