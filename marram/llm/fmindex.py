"""FM-index over words: suffix order, Burrows-Wheeler transform, Huffman-shaped wavelet tree, sampled positions.

A shard's text is a series of phrases of symbols above zero. Each phrase ends in a separator of its
own, smaller than all symbols, so every suffix differs from every other within its phrase.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words and the count before each of them."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol; 0 for those that don't occur, 1 for a single one."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weight, n = counts[used].tolist(), len(used)
    parent, leaf, node = [0] * (2 * n - 1), 0, n
    for new in range(n, 2 * n - 1):  # leaves by weight, and inner nodes, which come by weight too
        total = 0
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                at, leaf = leaf, leaf + 1
            else:
                at, node = node, node + 1
            parent[at] = new
            total += weight[at]
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for at in range(2 * n - 3, -1, -1):
        depth[at] = depth[parent[at]] + 1
    out[used] = depth[:n]
    return out


class WaveletTree:
    """Rank of any symbol, and access, in as many steps as the symbol's Huffman code has bits.

    The bits of a level lie in one vector, node after node by canonical code, so the tree takes about as
    many bits as the entropy of the symbols, and frequent symbols are found in few steps.
    """

    def __init__(self, symbols: np.ndarray, largest: int):
        counts = np.bincount(symbols, minlength=largest + 1)
        self.length = code_lengths(counts)
        by_code = np.lexsort((np.arange(largest + 1), self.length))
        self.symbols = by_code[self.length[by_code] > 0]  # by canonical code
        deepest = int(self.length.max(initial=0))
        per_length = np.bincount(self.length[self.symbols], minlength=deepest + 1)
        #: By length: the first code, where its symbols begin, and the first prefix that is an inner node.
        self.first, self.offset, self.inner = (np.zeros(deepest + 1, np.int64) for _ in range(3))
        for k in range(1, deepest + 1):
            self.first[k] = self.inner[k - 1] * 2
            self.inner[k] = self.first[k] + per_length[k]
        self.offset[1:] = np.cumsum(per_length)[:-1]
        self.code = np.zeros(largest + 1, np.int64)
        place = np.arange(len(self.symbols))
        self.code[self.symbols] = self.first[self.length[self.symbols]] + place - self.offset[self.length[self.symbols]]
        #: Bits of a level, where its nodes begin, and the ones before them.
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        code, rest = self.code[symbols], self.length[symbols]  # rest: bits that follow
        for level in range(deepest):
            node = (code >> rest) - self.inner[level]
            one = (code >> (rest - 1)) & 1
            sizes = np.bincount(node)
            begin = np.cumsum(sizes) - sizes
            bits = Bits(one == 1)
            ones = bits.rank(begin)
            self.levels.append((bits, begin, ones))
            before = np.cumsum(one) - one - ones[node]  # ones of the node before each place
            inside = np.arange(len(code)) - begin[node]
            zeros = sizes - np.bincount(node, weights=one, minlength=len(sizes)).astype(np.int64)
            place = begin[node] + np.where(one == 1, zeros[node] + before, inside - before)
            after, follow = np.empty_like(code), np.empty_like(rest)
            after[place], follow[place] = code, rest - 1
            code, rest = after[follow > 0], follow[follow > 0]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position i."""
        length, code = self.length[symbol], self.code[symbol]
        out = np.where(length > 0, i, 0)
        live = np.arange(len(symbol))
        for level, (bits, begin, ones) in enumerate(self.levels):
            live = live[length[live] > level]
            if not len(live):
                break
            rest = length[live] - level
            node = (code[live] >> rest) - self.inner[level]
            at = out[live]
            one = bits.rank(begin[node] + at) - ones[node]
            out[live] = np.where((code[live] >> (rest - 1)) & 1 == 1, one, at - one)
        return out

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i, and how often it occurs before."""
        out, symbol, prefix = i.copy(), np.zeros_like(i), np.zeros_like(i)
        live = np.arange(len(i))
        for level, (bits, begin, ones) in enumerate(self.levels):
            node, at = prefix[live] - self.inner[level], out[live]
            place = begin[node] + at
            one, bit = bits.rank(place) - ones[node], bits.get(place)
            out[live] = np.where(bit, one, at - one)
            prefix[live] = prefix[live] * 2 + bit
            leaf = prefix[live] < self.inner[level + 1]
            done = live[leaf]
            symbol[done] = self.symbols[self.offset[level + 1] + prefix[done] - self.first[level + 1]]
            live = live[~leaf]
            if not len(live):
                break
        return symbol, out


def suffix_ranks(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The rank of every suffix, and the ranks by the first 1, 2, 4, ... symbols on the way there.

    ends: positions of the separators, in order; they sort first, by position, and differ from each other.
    """
    n = len(text)
    first = text + len(ends)
    first[ends] = np.arange(len(ends))
    _, rank = np.unique(first, return_inverse=True)
    rank, width, kinds = rank.astype(np.int64), 1, 0
    classes = {1: rank}
    while kinds < n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        kinds, width = int(step.sum()) + 1, width * 2
        classes[width] = rank
    return rank, classes


class FMIndex:
    """Built from phrases (symbols above zero) laid end to end, each followed by a zero.

    With a depth, rows that agree in so many symbols can be told: the parent interval of a match, as matching
    statistics need it when a match is cut at its right end.
    """

    def __init__(self, text: np.ndarray, largest: int, sample: int = 8, depth: int = 0):
        text = text.astype(np.int64)
        self.n, self.sample = len(text), sample
        ends = np.flatnonzero(text == 0)
        rank, classes = suffix_ranks(text, ends) if self.n else (np.zeros(0, np.int64), {})
        order = np.empty(self.n, np.int64)
        order[rank] = np.arange(self.n)
        bwt = text[order - 1]
        self.wavelet = WaveletTree(bwt, largest)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        # Sampled positions: every so many symbols from the start of a phrase, so that no walk leaves its phrase.
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        offset = np.arange(self.n) - np.repeat(starts, np.diff(np.concatenate([[-1], ends]))) if self.n else np.zeros(0, np.int64)
        kept = (offset % sample == 0)[order]
        self.sampled, self.positions = Bits(kept), order[kept]
        self.depth = depth
        if depth and self.n:
            width = max((w for w in classes if w <= depth), default=1)
            known = classes[width]  # two runs of this width, at the start and at the end, cover the depth
            last = known[np.minimum(order + depth - width, self.n - 1)]
            differ = (known[order][1:] != known[order][:-1]) | (last[1:] != last[:-1])
            begins = np.concatenate([[True], differ])
            self.begins, self.borders = Bits(begins), np.append(np.flatnonzero(begins), self.n)

    def backward(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that start with symbol and then what the rows lo..hi start with."""
        m, base = len(symbol), self.smaller[symbol]
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[:m], base + both[m:]

    def parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that agree with row lo in the first depth symbols."""
        k = self.begins.rank(lo + 1) - 1
        return self.borders[k], self.borders[k + 1]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns (a matrix of symbols above zero, padded at the left)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            lo[live], hi[live] = self.backward(patterns[live, -k].astype(np.int64), lo[live], hi[live])
        return lo, hi

    def back(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step to the left: the symbol before each row's suffix, and the row of the suffix that starts there."""
        symbol, before = self.wavelet.access_rank(rows)
        return symbol, self.smaller[symbol] + before

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps to the left up to a sampled one."""
        rows, out = rows.copy(), np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = self.sampled.get(rows[todo])
            done = todo[here]
            out[done] = self.positions[self.sampled.rank(rows[done])] + steps
            todo = todo[~here]
            _, rows[todo] = self.back(rows[todo])
            steps += 1
        return out

    def stream(self, symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of documents streamed from right to left, up to depth + 1 symbols.

        Returns for each place of symbols how many symbols from there on match the index (depth + 1 at most) and the
        rows lo..hi that match. A match of full length gives way to its parent before it is extended. The documents
        are phrases of the index, so every extension has rows.
        """
        match, lo, hi = (np.zeros(len(symbols), np.int64) for _ in range(3))
        n, a, b = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64), np.full(len(begins), self.n, np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        for step in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            live = order[: np.searchsorted(-sizes, -step, side="right")]
            at = begins[live] + lengths[live] - step
            full = live[n[live] > self.depth]
            a[full], b[full] = self.parent(a[full])
            n[full] = self.depth
            a[live], b[live] = self.backward(symbols[at], a[live], b[live])
            n[live] += 1
            match[at], lo[at], hi[at] = n[live], a[live], b[live]
        return match, lo, hi
