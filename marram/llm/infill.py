"""Fill-in-the-middle: texts cut at two token boundaries and put in another order, so that a model learns to fill gaps.

A text becomes an array of code points (UTF-32 in numpy). Where a word's last code point has a blank beside it, a token
ends; `flatnonzero` gives all ends at once, the drawn ranks pick two of them, and the three slices are encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marram.llm.arrays import batch, carried, ddl, few, sha256, texts
from marram.sources.shared import pick

SLICE_BYTES = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Plan:
    """How many of a hundred texts are cut, how many of those begin with the suffix, and the seed of all draws."""

    rate: int = 50
    suffix_first: int = 80
    seed: int = 42


def token_ends(points: np.ndarray) -> np.ndarray:
    """Ends of the tokens: each word with the blanks before it, and the blanks at the end of the text."""
    if not len(points):
        return np.zeros(0, np.int64)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    return np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(points))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 from the SHA-256 of the seed and the id in decimal (null: nothing)."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = token_ends(points)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, plan.seed)
    if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < plan.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of an output. No part holds a mark, and marks can't arise where parts meet, so each is found where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    one, found, rest = output[len(first) :].partition(second)
    two, also, middle = rest.partition(MIDDLE)
    if not (found and also):
        raise ValueError(f"no {form} output")
    return two + middle + one if form == "spm" else one + middle + two


_OUT = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_OUT += [("output_sha256", pa.string()), ("restored_sha256", pa.string())]


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), *, with_text: bool = False, carry: dict[str, str] | None = None) -> DataFrame:
    """Cuts every whole text in prefix, middle and suffix and writes them in the drawn order.

    Returns doc_id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars in code points (null if plain), output_sha256 and
    restored_sha256 (of the text rebuilt from output and form); with_text adds output; carry names further columns to keep. A null or empty text
    has no tokens and stays plain, with the digests of the empty string; one of blanks is one token; a text that holds a mark stays plain. A null
    doc_id draws as the empty string; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored,
    whatever their names. Very long texts are cut whole, in memory of about six times their code points.
    """
    schema = _OUT + [("output", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, SLICE_BYTES)):
            columns: list[list] = [[] for _ in schema[1:]]
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts(rows.column("text")), strict=True):
                n, form, prefix, middle, output = transform(doc_id, text, plan)
                back = restore(output, form)
                values = [n, form, prefix, middle, *(sha256(x.encode("utf-8", "surrogatepass")) for x in (output, back))] + [output] * with_text
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield carried(batch(schema, [rows.column("doc_id"), *columns]), rows, carry)

    out = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_text
    return pick(docs, **{"doc_id": "long", "text": "string", **(carry or {})}).mapInArrow(run, out + ddl(carry))
