"""Periodic runs of words, by Lyndon arrays over ordered words.

A run of period q whose next word is the smaller one has its roots as longest Lyndon words, in one of the two orders
of words (the words' own and its reverse). So each order gives, for every word, the next smaller suffix and how far the
two suffixes agree, and a root that is repeated at once is a run of that period. Suffixes are compared only along
the edges of the Lyndon array, from left to right, and each match serves the later ones: an edge of the same word takes
the smaller of two known extensions, an edge inside what has matched takes that of its earlier copy. Words are therefore
matched once each, whatever the text, and need nothing but an order: no suffix array or tree, no hash, no ranks.
"""

from __future__ import annotations

import operator
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marram.llm.arrays import batch, carried, ddl, few, raw, sha256
from marram.sources.shared import pick

SLICE_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]


def repeated_roots(words: Sequence, less: Callable = operator.lt) -> tuple[np.ndarray, np.ndarray]:
    """For every word, the start of the next smaller suffix (the number of words if there is none), and how many words the two have in common.

    The end of the text is smaller than any word. Time is linear: `reach` is the end of all that has matched, by the edge (near, far), and no word
    before it is matched again.
    """
    n = len(words)
    smaller, agree = array("i", [n]) * n, array("i", [0]) * n  # of the edge to the next smaller suffix
    above, shared = array("i", [-1]) * n, array("i", [0]) * n  # of the edge to the suffix before that is smaller
    near = far = reach = 0
    for j in range(1, n):
        word, i, last, common = words[j], j - 1, -1, 0
        while i >= 0:
            if not common and words[i] != word:
                if not less(word, words[i]):
                    break
                smaller[i], last, i = j, i, above[i]
                continue
            if last >= 0 and shared[last] != common:
                common = min(shared[last], common)
            else:
                end, back = j + common, far - near
                if end < reach:
                    known = -1
                    if i >= back:
                        if smaller[i - back] == j - back:
                            known = agree[i - back]
                        elif above[j - back] == i - back:
                            known = shared[j - back]
                    if known >= 0:
                        end = min(j + known, reach)
                if end >= reach or known < 0:
                    while end < n and words[i + end - j] == words[end]:
                        end += 1
                    if end > reach:
                        near, far, reach = i, j, end
                common = end - j
            if j + common < n and not less(words[j + common], words[i + common]):
                shared[j] = common
                break
            smaller[i], agree[i], last, i = j, common, i, above[i]
        above[j] = i
    return np.frombuffer(smaller, np.int32), np.frombuffer(agree, np.int32)


def find_runs(words: Sequence, exponent: int = 4, shortest: int = 6) -> list[Run]:
    """All runs (start, length, period) of that exponent and length or more, by start and period.

    A run is a stretch of smallest period q that neither neighbour extends. The exponent is 3 or more, so that a root is followed by a whole second one.
    """
    if exponent < 3:
        raise ValueError("runs are told by a root with two more behind it")
    found: set[Run] = set()
    for less in (operator.lt, operator.gt):
        smaller, agree = repeated_roots(words, less)
        starts = np.arange(len(smaller), dtype=np.int64)
        roots = np.flatnonzero((smaller < len(smaller)) & (agree >= smaller - starts))
        ends: dict[int, int] = {}  # of the last run of each period
        for start, period, end in zip(roots.tolist(), (smaller - starts)[roots].tolist(), (smaller + agree)[roots].tolist(), strict=True):
            if ends.get(period) == end:
                continue
            ends[period] = end
            first = start
            while first and words[first - 1] == words[first - 1 + period]:
                first -= 1
            if end - first >= max(shortest, exponent * period):
                found.add((first, end - first, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs, np.int64).T
    np.add.at(at, start + period, 1)
    np.add.at(at, start + length, -1)
    keep = np.cumsum(at)[:-1] == 0
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def as_they_are(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which a tenth (by CRC-32 of the id in decimal; null as the empty string) repeat a stretch from some word on: text with known loops."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
_OUT += [("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(
    docs: DataFrame,
    *,
    exponent: int = 4,
    shortest: int = 6,
    words_of: Callable[[int | None, list[bytes]], list[bytes]] = as_they_are,
    with_text: bool = False,
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Finds the periodic runs of words in every whole text and takes out all but the first period of each.

    Returns doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli; ties to the smallest start, then period),
    runs_sha256 and collapsed_sha256; with_text adds runs array<struct<start, length, period>> and collapsed; carry names further columns to
    keep. words_of may change the words of a text before they are searched. A null or empty text, or one of blanks, has no words, no run (four nulls)
    and the digests of the empty string; a null doc_id is kept; repeated rows give repeated results; an empty table gives an empty result; other
    columns are ignored, whatever their names. Very long texts are searched whole, in time and memory linear in their words.
    """
    schema = _OUT + [("runs", _RUNS), ("collapsed", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, SLICE_BYTES)):
            columns: list[list] = [[] for _ in schema[1:]]
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), raw(rows.column("text")), strict=True):
                words = words_of(doc_id, _WORD.findall(text))
                runs = find_runs(words, exponent, shortest)
                text = collapsed(words, runs)
                longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                values = [len(words), len(runs), *longest, 1000 * longest[1] // longest[2] if runs else None]
                values += [sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha256(text)]
                if with_text:
                    values += [[{"start": s, "length": k, "period": q} for s, k, q in runs], text.decode("utf-8", "replace")]
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield carried(batch(schema, [rows.column("doc_id"), *columns]), rows, carry)

    out = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    out += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * with_text
    return pick(docs, **{"doc_id": "long", "text": "string", **(carry or {})}).mapInArrow(run, out + ddl(carry))
