"""Token counts that follow edits: a segment tree over the pre-tokens of each document, kept in a table.

A leaf is a pre-token with its characters and its number of tokens; leaves lie in blocks, and the tree above the
blocks holds characters and tokens of each subtree. keep_trees writes the leaves of each document beside its text, so
that later edits encode nothing again but what they touch; apply_edits takes such rows and returns them changed.
An edit re-splits the text from the first leaf that can see it until a boundary meets an old one behind the edit;
only those leaves are encoded, and only the sums above their blocks change. The pattern never looks back; ahead it
sees the next character, and behind blanks as far as they go and the character there, so re-splitting starts before
all leaves that end in a blank in front of the leaf that touches the edit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, carried, ddl, few, pack, texts, unpack
from marram.sources.shared import pick

#: Leaves of a block when a tree is built; the tree is built anew when a block has grown to eight times that.
BLOCK = 128
#: Text bytes that a task handles at once (or one longer text).
SLICE_BYTES = 4 << 20
#: Distinct pre-tokens whose counts a task holds at once.
TABLE = 300_000

_BLANKS = regex.compile(r"\s*")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


class Counter:
    """Tokens of a pre-token; each distinct one is encoded once."""

    def __init__(self, ranks: bytes, pattern: str):
        self.encoding, self.pattern = _encoding(ranks, pattern), regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > TABLE:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
            self.encoded += 1
        return n


class TokenTree:
    """The tree of a text from its leaves: characters and tokens of each pre-token."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, counter: Counter):
        self.counter = counter
        self.reencoded = 0
        self._build(text, chars.astype(np.int64), tokens.astype(np.int64))

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        """Splits and encodes the whole text."""
        pieces = counter.pattern.findall(text)
        return cls(text, *(np.fromiter(map(f, pieces), np.int64, len(pieces)) for f in (len, counter.count)), counter)

    def _build(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        starts = np.arange(0, max(1, len(chars)), BLOCK)
        self.blocks = _Blocks(text, chars, tokens)
        self.size = 1 << (len(starts) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        if len(chars):
            for sums, leaves in ((self.chars, chars), (self.tokens, tokens)):
                sums[self.size : self.size + len(starts)] = np.add.reduceat(leaves, starts)
        width = self.size
        while width > 1:
            for sums in (self.chars, self.tokens):
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
            width //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def _update(self, b: int) -> None:
        node = self.size + b
        self.chars[node], self.tokens[node] = sum(map(len, self.blocks[b])), sum(self.blocks.tokens(b))
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, leaf and start of the first leaf that ends at or behind a position; the end of the text if there is none."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.chars[node] < at:
                start += int(self.chars[node])
                node += 1
        b = min(node - self.size, len(self.blocks) - 1)
        if node - self.size > b:
            start = self.length - int(self.chars[self.size + b])
        leaf = 0
        while leaf < len(self.blocks[b]) and start + len(self.blocks[b][leaf]) < at:
            start += len(self.blocks[b][leaf])
            leaf += 1
        return b, leaf, start

    def _before_blanks(self, b: int, leaf: int, start: int) -> tuple[int, int, int]:
        """The same for the first leaf that has only leaves ending in a blank between it and the given one."""
        at = (b, leaf)
        while True:
            while leaf == 0 and b > 0:
                b, leaf = b - 1, len(self.blocks[b - 1])
            if leaf == 0 or not _BLANKS.match(self.blocks[b][leaf - 1][-1])[0]:
                return *at, start
            leaf -= 1
            start -= len(self.blocks[b][leaf])
            at = (b, leaf)

    def _next(self, b: int, leaf: int) -> tuple[int, int]:
        """The place of a leaf, past the ends of blocks."""
        while b < len(self.blocks) and leaf >= len(self.blocks[b]):
            b, leaf = b + 1, 0
        return b, leaf

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replaces so many characters from start (both cut to the text) by others."""
        start = max(0, min(start, self.length))
        end = min(self.length, start + max(0, deleted))
        b0, k0, base = self._before_blanks(*self._find(start))
        b, k = self._next(b0, k0)
        buffer, have = "", base  # old text from base to have
        ends: list[int] = []  # old boundaries in it
        after: list[tuple[int, int]] = []  # the place behind each

        def more(to: int) -> bool:
            nonlocal b, k, buffer, have
            parts = []
            while b < len(self.blocks) and have < to:
                piece = self.blocks[b][k]
                parts.append(piece)
                have += len(piece)
                b, k = self._next(b, k + 1)
                ends.append(have)
                after.append((b, k))
            buffer += "".join(parts)
            return bool(parts)

        more(end + 64)
        text = buffer[: start - base] + inserted + buffer[end - base :]
        shift = len(inserted) - (end - start)
        pieces, at, stop, known = [], 0, None, {e: i for i, e in enumerate(ends)}
        while at < len(text) or b < len(self.blocks):
            m = self.counter.pattern.match(text, at)
            while (m is None or _BLANKS.match(text, m.end()).end() >= len(text) - 1) and b < len(self.blocks):  # what follows may change the match
                had, listed = len(buffer), len(ends)
                more(have + 64 + len(text) // 2)
                text += buffer[had:]
                known.update({e: i + listed for i, e in enumerate(ends[listed:])})
                m = self.counter.pattern.match(text, at)
            if m is None:
                break
            pieces.append(m[0])
            at = m.end()
            old = base + at - shift
            if at >= start - base + len(inserted) and old >= end and old in known:
                stop = after[known[old]]
                break
        self.reencoded += len(pieces)
        eb, ek = stop if stop is not None else (len(self.blocks), 0)
        if eb >= len(self.blocks):
            eb, ek = len(self.blocks) - 1, len(self.blocks[len(self.blocks) - 1])
        counts = [self.counter.count(p) for p in pieces]
        if eb > b0:
            tail, tail_counts = self.blocks[eb][ek:], self.blocks.tokens(eb)[ek:]
            self.blocks.put(b0, self.blocks[b0][:k0] + pieces, self.blocks.tokens(b0)[:k0] + counts)
            for x in range(b0 + 1, eb):
                self.blocks.put(x, [], [])
            self.blocks.put(eb, tail, tail_counts)
        else:
            self.blocks.put(b0, self.blocks[b0][:k0] + pieces + self.blocks[b0][ek:], self.blocks.tokens(b0)[:k0] + counts + self.blocks.tokens(b0)[ek:])
        if len(self.blocks[b0]) > 8 * BLOCK:
            self._build(*self.leaves())
            return
        for x in range(b0, eb + 1):
            self._update(x)

    def leaves(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text as it now is, with the characters and tokens of its pre-tokens."""
        return self.blocks.leaves()


class _Blocks:
    """Pre-tokens by block. Those of a block are cut from the text when they are first asked for."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.counts = text, chars, tokens
        self.starts = np.concatenate([[0], np.cumsum(chars)])
        self.cut: dict[int, tuple[list[str], list[int]]] = {}

    def __len__(self) -> int:
        return max(1, -(-len(self.chars) // BLOCK))

    def _of(self, b: int) -> tuple[list[str], list[int]]:
        if b not in self.cut:
            at = self.starts[b * BLOCK : (b + 1) * BLOCK + 1].tolist()
            self.cut[b] = [self.text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], self.counts[b * BLOCK : (b + 1) * BLOCK].tolist()
        return self.cut[b]

    def __getitem__(self, b: int) -> list[str]:
        return self._of(b)[0]

    def tokens(self, b: int) -> list[int]:
        return self._of(b)[1]

    def put(self, b: int, pieces: list[str], tokens: list[int]) -> None:
        self.cut[b] = pieces, tokens

    @property
    def n_leaves(self) -> int:
        return len(self.chars) + sum(len(pieces) - len(self.chars[b * BLOCK : (b + 1) * BLOCK]) for b, (pieces, _) in self.cut.items())

    def leaves(self) -> tuple[str, np.ndarray, np.ndarray]:
        text, chars, tokens, at = [], [], [], 0
        for b in [*sorted(self.cut), len(self)]:  # runs of untouched blocks stay as they are
            a, to = at * BLOCK, min(b * BLOCK, len(self.chars))
            text.append(self.text[int(self.starts[min(a, len(self.chars))]) : int(self.starts[to])])
            chars.append(self.chars[a:to])
            tokens.append(self.counts[a:to])
            if b in self.cut:
                pieces, counts = self.cut[b]
                text += pieces
                chars.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
                tokens.append(np.array(counts, np.int64))
            at = b + 1
        return "".join(text), np.concatenate(chars), np.concatenate(tokens)


def _shared(df: DataFrame, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))  # a fixed vocabulary file of about a MB


_TREE = [("doc_id", pa.int64()), ("text", pa.string()), ("chars", pa.binary()), ("tokens", pa.binary())]
_TREE_DDL = "doc_id long, text string, chars binary, tokens binary"


def keep_trees(docs: DataFrame, ranks_path: str, pattern: str, *, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text, and its pre-tokens' characters and tokens (packed) of every row, and the columns to carry (name: type). Write it to a table.

    A null text is empty; null ids are kept; repeated rows give repeated results; an empty table gives an empty
    result; very long texts are split whole; other columns are ignored, whatever their names.
    """
    shared = _shared(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for rows in (some for part in batches for some in few(part, SLICE_BYTES)):
            bodies, chars, tokens = texts(rows.column("text")), [], []
            for text in bodies:
                pieces = counter.pattern.findall(text)
                chars.append(pack(np.fromiter(map(len, pieces), np.int64, len(pieces))))
                tokens.append(pack(np.fromiter(map(counter.count, pieces), np.int64, len(pieces))))
            yield carried(batch(_TREE, [rows.column("doc_id"), bodies, chars, tokens]), rows, carry)

    return pick(docs, **{"doc_id": "long", "text": "string", **(carry or {})}).mapInArrow(run, _TREE_DDL + ddl(carry))


def apply_edits(trees: DataFrame, edits: Column, ranks_path: str, pattern: str, *, with_tree: bool = False) -> DataFrame:
    """doc_id, n_tokens of the text, n_tokens_edited after its edits, n_pieces and n_reencoded pre-tokens; with_tree adds text, chars and tokens as they now are, for further edits.

    trees: rows of keep_trees or of this function. edits: an array<struct<start:int, deleted:int, inserted:string>>,
    applied one after the other in code points of the text as it then is, and cut to it. Null edits are none, and
    null fields count as zero or the empty string.
    """
    shared = _shared(trees, ranks_path, pattern)
    out = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_pieces", pa.int64()), ("n_reencoded", pa.int64())]
    out += _TREE[1:] * with_tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for rows in (some for part in batches for some in few(part, SLICE_BYTES)):
            columns: list[list] = [[] for _ in out[1:]]
            for text, chars, tokens, todo in zip(texts(rows.column("text")), rows.column("chars").to_pylist(), rows.column("tokens").to_pylist(), rows.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text, unpack(chars), unpack(tokens), counter)
                row = [tree.total]
                for e in todo or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                row += [tree.total, tree.blocks.n_leaves, tree.reencoded]
                if with_tree:
                    text, chars, tokens = tree.leaves()
                    row += [text, pack(chars), pack(tokens)]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield batch(out, [rows.column("doc_id"), *columns])

    kind = "array<struct<start:int,deleted:int,inserted:string>>"
    rows = trees.select("doc_id", "text", "chars", "tokens", edits.cast(kind).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_reencoded long" + ", text string, chars binary, tokens binary" * with_tree)


def routine_edits(text: str = "text") -> Column:
    """A note at the front, a passage in the middle reworded, the last characters cut: the edits of the registered query."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda start, deleted, inserted: F.struct(start.cast("int").alias("start"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(edit(F.floor(n / 2), 24, " (see the note) "), edit(F.lit(0), 0, "Update: "), edit(F.greatest(n - 16, F.lit(0)), 64, "."))
