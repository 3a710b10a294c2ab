"""Substring deduplication: every window of 20 words but its first occurrence is removed.

1. Segments. A window's minimiser is the smallest hash among its runs of ten words. Consecutive windows
   with the same minimiser make a segment, filed under it. Equal windows have equal minimisers, so all
   occurrences of a window meet under one key. A task keeps the first of equal segments before the
   shuffle; segments alone under their key hold nothing that repeats and end here.
2. Shards. The distinct segments under shared keys go, as words, into the FM-index of a shard of bounded size.
   All are streamed against it from right to left by backward steps over the wavelet tree, with the
   interval and length of the match at every word (matching statistics, cut at the threshold by the
   parent interval). Places that match 20 words report their interval; of the occurrences in an interval all but
   the first are repeats, whichever copies of a segment they come from.
3. The windows found are joined to the documents, and the words they cover are removed.

Hashes of words only decide where rows go. Windows are compared by their words, in the index; copies of a
segment are recognised by a BLAKE2 digest of 128 bits of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, few, raw, runs, word_pieces
from marram.llm.fmindex import FMIndex
from marram.sources.shared import materialise, pick

WINDOW = 20
GRAM = 10
#: Windows of a segment at most.
PIECE = 32
#: Text bytes that a task handles at once; longer texts are taken in pieces that overlap.
CHUNK_BYTES = 2 << 20
#: A key is hot if it heads HOT_IN_SAMPLE segments or more of a sixteenth of the documents, and one in HOT_SHARE of all
#: of them (so there are HOT_SHARE hot keys at most). Its windows are filed one by one under hashes of their own. This
#: decides only where rows go, never what is found.
HOT_IN_SAMPLE, HOT_SHARE = 64, 20_000
#: Different segments under a key at most; a key with more is filed again, window by window.
SPLIT_SEGMENTS = 4096
#: Rows of a key that a task holds while it decides.
HELD_ROWS = 1 << 18
#: Words of an FM-index shard, about (the segments of the key at its end may be more).
SHARD_WORDS = 200_000

_C = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hash of each word met; forgets all when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _groups(bodies: list[bytes], most: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Pieces (document, first word, words) with a window or more, gathered to about so many bytes."""
    held, size = [], 0
    for i, body in enumerate(bodies):
        for first, words, _ in word_pieces(body, WINDOW - 1, most):
            if len(words) >= WINDOW:
                held.append((i, first, words))
            size += min(len(body), most)
            if size >= most and held:
                yield held
                held, size = [], 0
    if held:
        yield held


def _segments(group: list[tuple[int, int, list[bytes]]], table: _Hashes, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, two halves of the digest, piece, first window in the piece, windows and self-repetition of each segment."""
    words = [w for _, _, part in group for w in part]
    hashes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    gram = hashes[: len(hashes) - GRAM + 1].copy()
    for t in range(1, GRAM):
        gram = gram * _C + hashes[t : len(hashes) - GRAM + 1 + t]
    gram = _mix(gram)
    two = np.minimum(gram[:-1], gram[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    least = np.minimum(eight[:-3], eight[3:])  # over the WINDOW - GRAM + 1 = 11 runs of a window
    sizes = np.array([len(part) for _, _, part in group], np.int64)
    n_windows, begins = sizes - WINDOW + 1, np.cumsum(sizes) - sizes
    total = int(n_windows.sum())
    piece = np.repeat(np.arange(len(group)), n_windows)
    inside = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = inside + begins[piece]
    key = least[at]
    if len(hot):
        k = np.searchsorted(hot, key).clip(max=len(hot) - 1)
        for own in np.array_split(np.flatnonzero(hot[k] == key), 16):
            h = np.zeros(len(own), np.uint64)
            for t in range(WINDOW):
                h = h * _C + hashes[at[own] + t]
            key[own] = _mix(h)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])])
    run = np.flatnonzero(new)
    place = np.arange(total) - np.repeat(run, np.diff(np.append(run, total)))
    cut = np.flatnonzero(place % PIECE == 0)
    n = np.diff(np.append(cut, total))
    start = at[cut]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[start].tolist()
    content = np.frombuffer(b"".join([_digest(line[a:b]) for a, b in zip(first, ends[start + n + WINDOW - 2].tolist(), strict=True)]), np.int64).reshape(-1, 2)
    # A segment may repeat itself if its minimiser occurs in it twice.
    grams = n + WINDOW - GRAM
    where = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(start, grams)
    same = gram[where] == np.repeat(least[start], grams)
    inner = (np.add.reduceat(same.astype(np.int32), np.cumsum(grams) - grams) > 1) & (n > 1)
    return key[cut].view(np.int64), content[:, 0], content[:, 1], piece[cut], inside[cut], n, inner


#: Kinds of rows: a segment, one that may repeat itself, a known repeat, a segment for an index (whole or by windows),
#: a further copy of one, and one that was passed on already.
PLAIN, INNER, REPEAT, INDEXED, SPLIT, COPY, SENT = range(7)
_ROW = [("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("kind", pa.int8())]
_ROW_DDL = "key long, c1 long, c2 long, doc_id long, place long, kind tinyint"
_ORDER = ["key", "c1", "c2", "doc_id", "place"]


def _place(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First window and windows in one number, in the order of the first."""
    return start * 64 + n


def _columns(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return batch(_ROW, [pa.array(x, t) for x, (_, t) in zip(rows, _ROW, strict=True)])


def _heads(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: which begin a content under a key, and which occur later than its first."""
    key, c1, c2, doc_id, place = rows[:5]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, (doc_id != doc_id[head]) | (place != place[head])


def _occurrences(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    keys = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_SHARE numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        for part in batches:
            for some in few(part, 2 * CHUNK_BYTES):
                ids = some.column("doc_id").to_numpy()
                for group in _groups(raw(some.column("text")), CHUNK_BYTES):
                    key, c1, c2, piece, inside, n, inner = _segments(group, table, keys.value)
                    doc_id = ids[np.array([i for i, _, _ in group], np.int64)][piece]
                    place = _place(np.array([first for _, first, _ in group], np.int64)[piece] + inside, n)
                    order = np.lexsort((place, doc_id, c2, c1, key))
                    rows = tuple(x[order] for x in (key, c1, c2, doc_id, place, np.where(inner, INNER, PLAIN).astype(np.int8)))
                    new, again = _heads(rows)
                    # Copies within a task are known; they go anywhere, so that those of a frequent segment are spread.
                    anywhere = _mix(rows[3].view(np.uint64) * _C + rows[4].view(np.uint64)).view(np.int64)
                    rows = (np.where(again, anywhere, rows[0]), *rows[1:5], np.where(again, REPEAT, rows[5]).astype(np.int8))
                    yield _columns(tuple(x[new | again] for x in rows))

    return docs.mapInArrow(run, _ROW_DDL)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, those under a shared key: the first of each content for the index, and its copies."""
    held: tuple[np.ndarray, ...] | None = None
    splitting = False  # the key of the rows held goes window by window

    def settled(rows: tuple[np.ndarray, ...], first_key_split: bool) -> pa.RecordBatch:
        new, again = _heads(rows)
        edges = runs(rows[0])
        lengths = np.diff(edges)
        split = np.add.reduceat(new.astype(np.int64), edges[:-1]) > SPLIT_SEGMENTS
        split[0] |= first_key_split
        shared = split | (np.add.reduceat((new | again).astype(np.int64), edges[:-1]) > 1) | (np.maximum.reduceat(rows[5] == INNER, edges[:-1]))
        split, shared = np.repeat(split, lengths), np.repeat(shared, lengths)
        kind = np.where(new, np.where(split, SPLIT, INDEXED), np.where(split, REPEAT, COPY)).astype(np.int8)
        keep = shared & (new | again) & (rows[5] != SENT)
        return _columns(tuple(x[keep] for x in (*rows[:5], kind)))

    for part in batches:
        rows = tuple(part.column(i).to_numpy() for i in range(6))
        known = rows[5] == REPEAT
        if known.any():
            yield _columns(tuple(x[known] for x in rows))
            rows = tuple(x[~known] for x in rows)
        if held is not None:
            rows = tuple(np.concatenate([a, b]) for a, b in zip(held, rows, strict=True))
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield settled(tuple(x[:cut] for x in rows), splitting)
            splitting = False
        held = tuple(x[cut:].copy() for x in rows)
        if len(held[0]) > HELD_ROWS:
            new, again = _heads(held)
            if splitting or int(new.sum()) > SPLIT_SEGMENTS:  # pass all on but the last content's first row, against which later rows are told
                yield settled(held, True)
                splitting, last = True, np.flatnonzero(new)[-1:]
                held = (*(x[last] for x in held[:5]), np.array([SENT], np.int8))
            else:  # many copies of few segments: repeats whatever else the key holds
                yield _columns((*(x[again & ~new] for x in held[:5]), np.full(int((again & ~new).sum()), REPEAT, np.int8)))
                one = np.maximum.reduceat(np.where(held[5] == INNER, INNER, PLAIN), np.flatnonzero(new)).astype(np.int8)
                held = (*(x[new] for x in held[:5]), np.full(int(new.sum()), INNER, np.int8) if again.any() else one)
    if held is not None and len(held[0]):
        yield settled(held, splitting)


_FETCHED = [*_ROW[:5], ("body", pa.binary())]
_FETCHED_DDL = "key long, c1 long, c2 long, doc_id long, place long, body binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each segment asked for of a document; where its key is split, those of each window."""
    out: list[tuple] = []
    size = 0
    for part in batches:
        for some in few(part, 2 * CHUNK_BYTES):
            for doc_id, body, asked in zip(some.column("doc_id").to_pylist(), raw(some.column("text")), some.column("asked"), strict=True):
                key, c1, c2, place, kind = (asked.values.field(k).to_numpy() for k in range(5))
                order = np.argsort(place)
                starts = place[order] >> 6
                done = 0
                for first, words, last in word_pieces(body, PIECE + WINDOW, CHUNK_BYTES):
                    to = len(order) if last else int(np.searchsorted(starts, first + len(words) - PIECE - WINDOW))
                    for j in order[done:to].tolist():
                        start, n = int(place[j]) >> 6, int(place[j]) & 63
                        own = words[start - first : start - first + n + WINDOW - 1]
                        text = b" ".join(own)
                        a, b = np.frombuffer(_digest(text), np.int64).tolist()
                        if (a, b) != (c1[j], c2[j]):
                            continue  # another row of the same id
                        if kind[j] == SPLIT:
                            for w in range(n):
                                text = b" ".join(own[w : w + WINDOW])
                                a, b = np.frombuffer(_digest(text), np.int64).tolist()
                                out.append((a, a, b, doc_id, (start + w) * 64 + 1, text))
                                size += len(text)
                        else:
                            out.append((int(key[j]), a, b, doc_id, int(place[j]), text))
                            size += len(text)
                        if size > CHUNK_BYTES:
                            yield batch(_FETCHED, [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FETCHED, strict=True)])
                            out, size = [], 0
                    done = to
    if out:
        yield batch(_FETCHED, [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FETCHED, strict=True)])


def shard_repeats(bodies: list[bytes], doc_id: np.ndarray, place: np.ndarray, of: np.ndarray, copy_doc: np.ndarray, copy_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows) of the repeats among a shard's segments and their copies.

    bodies: the words of distinct segments, with the document and place of the first occurrence of each; of: the
    segment of each further copy.
    """
    number: dict[bytes, int] = {}
    symbols = [[number.setdefault(w, len(number) + 1) for w in b.split(b" ")] for b in bodies]
    lengths = np.fromiter(map(len, symbols), np.int64, len(symbols))
    text = np.fromiter((x for s in symbols for x in (*s, 0)), np.int64, int(lengths.sum()) + len(symbols))
    begins = np.cumsum(lengths + 1) - lengths - 1
    index = FMIndex(text, len(number), depth=WINDOW - 1)
    match, lo, _ = index.stream(text, begins, lengths)
    start, n = place >> 6, place & 63
    seg = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begins[seg] + inside
    assert (match[at] >= WINDOW).all()  # each matches itself
    interval, where = lo[at], start[seg] + inside
    order = np.lexsort((where, doc_id[seg], interval))
    head = np.repeat(runs(interval[order])[:-1], np.diff(runs(interval[order])))
    first_doc, first_where = np.empty_like(where), np.empty_like(where)  # of the interval each window reports
    first_doc[order], first_where[order] = doc_id[seg[order[head]]], where[order[head]]
    again = (doc_id[seg] != first_doc) | (where != first_where)
    # Copies report the intervals of their segment; their own windows are compared with the first of each.
    offset = np.cumsum(n) - n
    many = n[of]
    copy = np.repeat(np.arange(len(of)), many)
    window = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    slot = np.repeat(offset[of], many) + window
    later = (copy_doc[copy] != first_doc[slot]) | ((copy_place >> 6)[copy] + window != first_where[slot])
    docs, windows, rows = np.concatenate([doc_id[seg], copy_doc[copy]]), np.concatenate([where, (copy_place >> 6)[copy] + window]), np.concatenate([seg, copy + len(n)])
    found = np.flatnonzero(np.concatenate([again, later]))
    docs, windows, rows = docs[found], windows[found], rows[found]
    if not len(found):
        return docs, windows, windows
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1] + 1)])
    run = np.flatnonzero(new)
    return docs[run], windows[run], np.diff(np.append(run, len(found)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among rows in order; keys are gathered to shards. The first row of a content has its words."""
    out = [("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
    bodies: list[bytes] = []
    places: list[tuple[int, int, int]] = []  # key, document and place of the first occurrences
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    words = n_copies = 0
    last: tuple[int, int, int] | None = None

    def shard(to: int) -> pa.RecordBatch:
        """The repeats of the first segments held, and of the copies of them."""
        of, copy_doc, copy_place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 3
        own = of < to
        _, doc_id, place = (np.array(x, np.int64) for x in zip(*places[:to], strict=True))
        found = shard_repeats(bodies[:to], doc_id, place, of[own], copy_doc[own], copy_place[own])
        return batch(out, [pa.array(x, t) for x, (_, t) in zip(found, out, strict=True)])

    for part in batches:
        if not part.num_rows:
            continue
        key, c1, c2, doc_id, place = (part.column(i).to_numpy() for i in range(5))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        if last is not None:
            new[0] = (key[0], c1[0], c2[0]) != last
        last = (key[-1], c1[-1], c2[-1])
        firsts = np.flatnonzero(new)
        of = len(bodies) - 1 + np.cumsum(new)
        copied = np.flatnonzero(~new)
        copies.append((of[copied], doc_id[copied], place[copied]))
        n_copies += len(copied)
        bodies += part.column("body").take(pa.array(firsts)).to_pylist()
        places += zip(key[firsts].tolist(), doc_id[firsts].tolist(), place[firsts].tolist(), strict=True)
        words += int(((place[firsts] & 63) + WINDOW - 1).sum())
        if words < SHARD_WORDS and n_copies < HELD_ROWS:
            continue
        end = len(places) - 1
        while end > 0 and places[end - 1][0] == places[-1][0]:
            end -= 1
        if end:  # the keys before the last one, which may go on
            at = 0
            size = np.cumsum([(p[2] & 63) + WINDOW - 1 for p in places[:end]])
            keys = np.array([p[0] for p in places[:end]])
            for b in (runs(keys)[1:]).tolist():
                if size[b - 1] - (size[at - 1] if at else 0) >= SHARD_WORDS or b == end:
                    held = (bodies, places, copies)
                    bodies, places = bodies[at:b], places[at:b]
                    copies = [tuple(x[(c[0] >= at) & (c[0] < b)] - (at if i == 0 else 0) for i, x in enumerate(c)) for c in held[2]]
                    yield shard(len(places))
                    bodies, places, copies = held
                    at = b
            copies = [tuple(x[c[0] >= end] - (end if i == 0 else 0) for i, x in enumerate(c)) for c in copies]
            bodies, places = bodies[end:], places[end:]
        elif n_copies >= HELD_ROWS:  # copies of few segments: what they repeat is held already
            yield shard(len(places))
            copies = []
        n_copies = sum(len(c[0]) for c in copies)
        words = sum((p[2] & 63) + WINDOW - 1 for p in places)
    if places:
        yield shard(len(places))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    for rows in batches:
        for part in few(rows, 2 * CHUNK_BYTES):
            n_words, n_removed, digests, texts = [], [], [], []
            for body, repeats in zip(raw(part.column("text")), part.column("repeats"), strict=True):
                gone = np.zeros(0, np.int64)
                if repeats.is_valid:
                    starts, n = (repeats.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    gone = np.stack([starts, starts + n + WINDOW - 1])
                total, kept, digest, lines = 0, 0, hashlib.sha256(), []
                for first, words, _ in word_pieces(body, 0, CHUNK_BYTES):
                    total += len(words)
                    if len(gone):
                        change = np.zeros(len(words) + 1, np.int64)
                        a, b = (gone - first).clip(0, len(words))
                        np.add.at(change, a, 1)
                        np.add.at(change, b, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) <= 0).tolist()]
                    if words:
                        line = b" " * (kept > 0) + b" ".join(words)
                        digest.update(line)
                        lines.append(line)
                        kept += len(words)
                n_words.append(total), n_removed.append(total - kept), digests.append(digest.hexdigest()), texts.append(b"".join(lines))
            yield batch(out, [part.column("doc_id"), n_words, n_removed, digests, pa.array(texts, pa.binary()).cast(pa.string())])


def remove_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with_text adds the kept words joined by a space.

    Each word covered by a window of 20 words that also starts earlier (in a smaller doc_id, or earlier in
    the same one) is removed; windows are judged on the input. A null or empty text has no words; an empty
    table gives an empty result; a very long text is handled in overlapping pieces. A row without a
    doc_id is kept whole and is no one's earlier occurrence. Rows that share a doc_id are one document,
    read again: neither is earlier, and what is removed from one is removed from the others.
    Other columns are ignored, whatever their names.
    """
    rows = pick(docs, doc_id="long", text="string").where("doc_id is not null")
    sample = _occurrences(rows.where("pmod(xxhash64(doc_id), 16) = 0"), np.zeros(0, np.uint64)).where(F.col("kind") != REPEAT)
    counts = materialise(sample.groupBy("key").agg(F.count("*").alias("n")), "sampled")
    of_all = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.col("n") >= HOT_IN_SAMPLE) & (F.col("n") * HOT_SHARE >= of_all)).select("key")
    hot = np.sort(np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64))  # HOT_SHARE rows at most

    filed = _occurrences(rows, hot).repartition("key").sortWithinPartitions(*_ORDER)
    resolved = materialise(filed.mapInArrow(_resolve, _ROW_DDL), "segments")
    asked = resolved.where(F.col("kind").isin(INDEXED, SPLIT)).groupBy("doc_id").agg(F.collect_list(F.struct("key", "c1", "c2", "place", "kind")).alias("asked"))
    fetched = rows.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_fetch, _FETCHED_DDL)
    copies = resolved.where(F.col("kind") == COPY).select(*_ORDER, F.lit(None).cast("binary").alias("body"))
    in_shards = fetched.union(copies).repartition("key").sortWithinPartitions(*_ORDER).mapInArrow(_shards, "doc_id long, start int, n int")
    known = resolved.where(F.col("kind") == REPEAT).select("doc_id", F.shiftright("place", 6).cast("int").alias("start"), F.col("place").bitwiseAND(63).cast("int").alias("n"))
    of_doc = known.union(in_shards).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("repeats"))
    joined = rows.join(of_doc, "doc_id", "left")
    unnamed = pick(docs, doc_id="long", text="string").where("doc_id is null").withColumn("repeats", F.lit(None).cast("array<struct<start:int,n:int>>"))
    every = joined.select("doc_id", "text", "repeats").union(unnamed)
    done = every.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if with_text else done.drop("kept")
