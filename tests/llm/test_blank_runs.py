"""Edits that touch runs of blanks, compared piece by piece with a full split."""

import random

import public_tokenizers as P
import pytest

from marram.llm import tokens
from marram.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def counter():
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tokens.Counter(f.read(), P.PATTERN)


def check(text, counter, *edits):
    tree = tokens.TokenTree.of(text, counter)
    for at, deleted, inserted in edits:
        tree.edit(at, deleted, inserted)
        text = text[:at] + inserted + text[at + deleted :]
        pieces = counter.pattern.findall(text)
        assert [p for b in range(len(tree.blocks)) for p in tree.blocks[b]] == pieces, (text, at, deleted, inserted)
        assert tree.total == sum(map(counter.count, pieces)) and tree.blocks.n_leaves == len(pieces)
        whole, chars, counts = tree.leaves()
        assert (whole, chars.tolist(), counts.tolist()) == (text, list(map(len, pieces)), list(map(counter.count, pieces)))


def test_known_cases(counter):
    check("ab\n\nfoo", counter, (4, 0, " (see the note) "))
    check("ab\n   foo", counter, (6, 3, "\n"))
    check("ab\n\n  \n foo", counter, (7, 0, "\n"))
    check("ab" + "\n" + " " * 300 + "\nfoo", counter, (1, 1, "c"))


def test_random_blank_runs(counter):
    rng = random.Random(5)
    marks = ["a", "foo", " ", "  ", "\n", "\n\n", "\t", "\r\n", "!", "'s", "7", " "]
    for _ in range(4000):
        text = "".join(rng.choices(marks, [2, 2, 6, 4, 6, 4, 2, 2, 1, 1, 1, 1], k=rng.choice([5, 30, 400])))
        edits, n = [], len(text)
        for _ in range(3):
            at = rng.randint(0, n)
            deleted, inserted = rng.randint(0, min(6, n - at)), rng.choice(["", "\n", " \n", " x", "x"]) + rng.choice(["", " ", "y"])
            edits.append((at, deleted, inserted))
            n += len(inserted) - deleted
        check(text, counter, *edits)
