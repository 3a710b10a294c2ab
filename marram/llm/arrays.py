"""Small Arrow and numpy helpers for code that runs inside tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = re.compile(rb"[ \t-\r]")


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(bodies: Sequence[bytes | str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices that hold so many bytes (or characters) at most, or one longer text."""
    sizes, at = np.cumsum([len(b) for b in bodies]), 0
    while at < len(bodies):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def few(rows: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose values of a column hold so many bytes at most, or one longer value; no value is copied."""
    sizes = pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < rows.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        to = min(to, at + 1024)
        yield rows.slice(at, to - at)
        at = to


def word_pieces(body: bytes, overlap: int, most: int) -> Iterator[tuple[int, list[bytes], bool]]:
    """(first word, words, last piece?) of a text in pieces of about so many bytes; each begins with the last words of the one before."""
    at, first, tail = 0, 0, []
    while True:
        to = at + most
        if to < len(body):
            cut = _BLANK.search(body, to)
            to = cut.end() if cut else len(body)
        words = tail + body[at:to].split()
        yield first, words, to >= len(body)
        if to >= len(body):
            return
        tail = words[max(0, len(words) - overlap) :]
        at, first = to, first + len(words) - len(tail)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 byte by byte: how many bytes each has, all lowest ones, all second ones, ..."""
    k = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :k].T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    k = packed[0]
    out = np.zeros(((len(packed) - 1) // k, 4), np.uint8)
    out[:, :k] = np.frombuffer(packed, np.uint8, offset=1).reshape(k, -1).T
    return out.view("<u4").ravel()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, and its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def carried(own: pa.RecordBatch, rows: pa.RecordBatch, carry: dict[str, str] | None) -> pa.RecordBatch:
    """A result with further columns of its rows, unchanged."""
    names = list(carry or {})
    return pa.RecordBatch.from_arrays([*own.columns, *(rows.column(n) for n in names)], names=[*own.schema.names, *names])


def ddl(carry: dict[str, str] | None) -> str:
    return "".join(f", {n} {t}" for n, t in (carry or {}).items())
