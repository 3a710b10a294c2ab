"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to three bytes. Its counts come from a bounded sample of
labelled rows and are then frozen. A byte is coded in the longest context that the tree has: by its count if it was
seen there (escape method C), else by an escape to the context one byte shorter, in which the bytes of the longer
one are excluded, so the probabilities of all bytes after a context sum to one. Code lengths are whole numbers of
1 / UNIT bits; those of a text are added exactly. The lengths of all byte fourgrams in the trees lie in a hash
table; other fourgrams are worked out from the trees where they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, carried, ddl, raw, slices
from marram.sources.shared import materialise, pick

#: Expected number of labelled rows per language that the trees are grown from (all, where there are fewer).
SAMPLE_ROWS = 1500
#: Languages whose trees a task holds at once; more are a further pass with a running best.
BLOCK_LANGUAGES = 16
ORDER = 3
#: Code lengths are counted in 1 / UNIT bits.
UNIT = 1 << 16
#: Text bytes that a task handles at once (or one longer text).
SLICE_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PAD = b" " * ORDER


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3 (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of all texts with the three before it, as one number, and where each text starts; a text is preceded by blanks."""
    joined = np.frombuffer(_PAD + _PAD.join(bodies), np.uint8).astype(np.uint32)
    grams = (joined[:-3] << 24) | (joined[1:-2] << 16) | (joined[2:-1] << 8) | joined[3:]
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    return grams, np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]]) if len(bodies) else np.zeros(0, np.int64)


def _own(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The grams that end in a byte of a text, not in the blanks between two."""
    keep = np.ones(len(grams), bool)
    for k in range(1, ORDER + 1):
        keep[starts[1:] - k] = False
    return grams[keep]


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of numbers in a sorted array, and whether they are there."""
    at = np.searchsorted(known, asked).clip(max=max(0, len(known) - 1))
    return at, known[at] == asked if len(known) else np.zeros(len(asked), bool)


class Tree:
    """A language's contexts, from the counts of byte fourgrams (each the last byte after three)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        #: By order, from 0: the sorted symbols with their contexts, their counts, the contexts, their totals and kinds.
        self.orders: list[tuple[np.ndarray, ...]] = []
        for order in range(ORDER + 1):
            known, of = np.unique(grams.astype(np.int64) & ((1 << (8 * order + 8)) - 1), return_inverse=True)
            n = np.bincount(of, counts, len(known)).astype(np.int64)
            contexts, inside = np.unique(known >> 8, return_inverse=True)
            total = np.bincount(inside, n, len(contexts)).astype(np.int64)
            kinds = np.bincount(inside, minlength=len(contexts))
            # The same totals and kinds one order down, without the bytes seen here.
            if order:
                low_known, low_n, low_contexts, low_total, low_kinds = self.orders[-1][:5]
                there = np.searchsorted(low_contexts, contexts & ((1 << (8 * order - 8)) - 1))
                shared = np.bincount(inside, low_n[np.searchsorted(low_known, known & ((1 << (8 * order)) - 1))], len(contexts)).astype(np.int64)
                rest, fresh = low_total[there] - shared, low_kinds[there] - kinds
            else:
                rest = fresh = 256 - kinds  # below all orders, each byte that was never seen has the same chance
            self.orders.append((known, n, contexts, total, kinds, rest, fresh))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length, in 1 / UNIT bits, of the last byte of each fourgram after the three before it."""
        grams, out = grams.astype(np.int64), np.zeros(len(grams))
        todo = np.arange(len(grams))
        total, kinds = np.full(len(grams), -1), np.zeros(len(grams), np.int64)  # of the context at hand, without what is excluded; -1: none was found yet
        for order in range(ORDER, -1, -1):
            known, n, contexts, own_total, own_kinds, rest, fresh = self.orders[order]
            asked = grams[todo] & ((1 << (8 * order + 8)) - 1)
            context, there = _find(contexts, asked >> 8)
            start = there & (total[todo] < 0)
            total[todo[start]], kinds[todo[start]] = own_total[context[start]], own_kinds[context[start]]
            symbol, seen = _find(known, asked)
            with np.errstate(divide="ignore"):
                done = todo[seen]
                out[done] += np.log2(total[done] + kinds[done]) - np.log2(n[symbol[seen]])
                off = todo[there & ~seen]
                costs = off[kinds[off] > 0]  # where no further byte is known, the escape is certain
                out[costs] += np.log2(total[costs] + kinds[costs]) - np.log2(kinds[costs])
            total[off], kinds[off] = rest[context[there & ~seen]], fresh[context[there & ~seen]]
            todo = todo[~seen]
        unseen = np.where(total[todo] < 0, 256, kinds[todo])
        out[todo] += np.log2(unseen)
        return np.rint(out * UNIT).astype(np.int64)


class Trees:
    """The trees of a block of languages, and a hash table of the fourgrams in them with the code lengths in each language."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(t.orders[ORDER][0] for t in trees)])).astype(np.uint32)
        self.lengths = np.stack([t.bits(grams) for t in trees]).astype(np.int32) if trees else np.zeros((0, 0), np.int32)
        self.power = max(4, (4 * len(grams)).bit_length())
        self.keys, self.rows = np.zeros(1 << self.power, np.uint32), np.full(1 << self.power, -1, np.int32)
        todo, slot = np.arange(len(grams)), self._slot(grams)
        while len(todo):
            _, first = np.unique(slot[todo], return_index=True)
            placed = todo[first][self.rows[slot[todo[first]]] < 0]
            self.keys[slot[placed]], self.rows[slot[placed]] = grams[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            taken = self.keys[slot[todo]] != grams[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & ((1 << self.power) - 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.power)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Rows of lengths, -1 for fourgrams that are in no tree."""
        slot = self._slot(grams)
        row = self.rows[slot]
        todo = np.flatnonzero((row >= 0) & (self.keys[slot] != grams))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.power) - 1)
            row[todo] = self.rows[slot[todo]]
            todo = todo[(row[todo] >= 0) & (self.keys[slot[todo]] != grams[todo])]
        return row

    def sums(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        row = self.find(grams)
        other = np.flatnonzero(row < 0)
        rare, of = np.unique(grams[other], return_inverse=True)
        row[other] = self.lengths.shape[1] + of
        out = np.zeros((len(self.trees), len(starts)), np.int64)
        for i, tree in enumerate(self.trees):
            lengths = np.concatenate([self.lengths[i], tree.bits(rare).astype(np.int32)])
            total = np.zeros(len(row) + 1, np.int64)
            np.cumsum(lengths[row], out=total[1:])
            out[i] = total[ends] - total[starts]
        return out


def labels(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The rows that can be learned from, and how many there are of each language; one row a language reaches the driver."""
    labelled = pick(docs, doc_id="long", text="string", lang="string").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return labelled, {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}


def train(labelled: DataFrame, sizes: dict[str, int]) -> tuple[list[str], Trees]:
    """Languages (sorted) and their trees, from text and lang of labelled rows; sizes has the rows of each language to learn.

    A row is taken if the hash of its id falls below the share of its language that makes about
    SAMPLE_ROWS rows. Only the summed counts of the sample's fourgrams reach the driver, all of them.
    """
    langs = sorted(sizes)
    if not langs:
        return [], Trees([])
    grid = 1 << 20
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(grid, np.ceil(grid * SAMPLE_ROWS / sizes[k]))))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(grid)) < share[F.col("lang")]).select("text", "lang")
    out = [("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bodies, of = raw(rows.column("text")), rows.column("lang").to_pylist()
            for lang in sorted(set(of)):
                own = [b for b, k in zip(bodies, of, strict=True) if k == lang]
                for at, to in slices(own, SLICE_BYTES):
                    gram, n = np.unique(_own(*_grams(own[at:to])), return_counts=True)
                    yield batch(out, [pa.array([lang] * len(gram), pa.string()), gram.astype(np.int64), n])

    summed = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (summed.column(c).to_numpy() for c in ("lang", "gram", "n"))
    return langs, Trees([Tree(gram[lang == k], n[lang == k]) for k in langs])


def _has_letter(body: bytes) -> bool:
    return any(c.isalpha() for c in body.decode("utf-8", "replace"))


def identify(docs: DataFrame, *, learn_from: DataFrame | None = None, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row, and the columns to carry (name: type).

    lang_pred is the learned language whose tree codes the whole text in the fewest bits (ties: the
    first by name); score is its share of the posterior under equal priors. A null text, one without
    a letter, and every text if no language was learned are `und` with score 0. Null ids are kept,
    repeated rows give repeated results, an empty table gives an empty result, very long texts are coded whole, and
    other columns are ignored, whatever their names.
    """
    labelled, sizes = labels(docs if learn_from is None else learn_from)
    every = sorted(sizes)
    rows = pick(docs, **{"doc_id": "long", "text": "string", **(carry or {})}).withColumn("held_out", held_out(F.col("doc_id")))
    for at in range(0, len(every) or 1, BLOCK_LANGUAGES):
        langs, trees = train(labelled, {k: sizes[k] for k in every[at : at + BLOCK_LANGUAGES]})
        last = at + BLOCK_LANGUAGES >= len(every)
        rows = _scored(rows, langs, trees, carry if last else {"text": "string", **(carry or {})})
        rows = rows if last else materialise(rows, "scored")
    return rows.drop("__bits", "__total")


def _scored(rows: DataFrame, langs: list[str], trees: Trees, carry: dict[str, str] | None) -> DataFrame:
    """The results after a block of languages, given those of the blocks before (if any) in lang_pred, __bits and __total.

    __bits is the best code length, __total the sum of 2 ** (best - code length) over the languages so far.
    """
    further = "__bits" in rows.columns
    frozen = rows.sparkSession.sparkContext.broadcast(trees)  # BLOCK_LANGUAGES trees of about SAMPLE_ROWS rows each, whatever the input
    out = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
    out += [("__bits", pa.float64()), ("__total", pa.float64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = frozen.value
        for rows in batches:
            every = raw(rows.column("text"))
            for at, to in slices(every, SLICE_BYTES):
                part, bodies = rows.slice(at, to - at), every[at:to]
                grams, starts = _grams(bodies)
                lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
                ends = starts + lengths
                bits = trees.sums(grams, starts, ends) / UNIT
                letters = np.concatenate([[0], np.cumsum(_LETTER[np.frombuffer(_PAD.join(bodies), np.uint8)], dtype=np.int64)])
                ascii_letter = letters[ends] > letters[starts]
                preds, scores, rates, best, totals = [], [], [], [], []
                before = list(zip(*(part.column(c).to_pylist() for c in ("lang_pred", "__bits", "__total")), strict=True)) if further else []
                for j, body in enumerate(bodies):
                    if not langs or not (ascii_letter[j] or _has_letter(body)):
                        preds.append("und"), scores.append(0.0), rates.append(0.0), best.append(0.0), totals.append(0.0)
                        continue
                    b = bits[:, j]
                    k = int(np.argmin(b))
                    pred, least, total = langs[k], float(b[k]), 0.0
                    if further:
                        if before[j][1] <= least:
                            pred, least = before[j][:2]
                        total = before[j][2] * float(np.exp2(max(least - before[j][1], -1000)))
                    total += float(np.exp2(np.maximum(least - b, -1000)).sum())
                    preds.append(pred), scores.append(1 / total), rates.append(least / len(body)), best.append(least), totals.append(total)
                own = batch(out, [part.column("doc_id"), part.column("held_out"), preds, scores, rates, best, totals])
                yield carried(own, part, carry)

    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double, __bits double, __total double" + ddl(carry))
