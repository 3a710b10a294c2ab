"""Code lengths of prediction by partial matching against a plain version, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from marram.llm import language


def plain_bits(seen, context, byte):
    """-log2 of a byte's chance after three bytes; seen: fourgram counts as {bytes: n}. Method C with exclusions."""
    after = defaultdict(Counter)
    for gram, n in seen.items():
        for k in range(4):
            after[gram[k:3]][gram[3]] += n
    bits, out = 0.0, set()
    for k in range(4):
        c = context[k:]
        if c not in after:
            continue
        left = {b: n for b, n in after[c].items() if b not in out}
        total = sum(left.values()) + len(left)
        if byte in left:
            return bits + math.log2(total) - math.log2(left[byte])
        if left:
            bits += math.log2(total) - math.log2(len(left))
        out |= set(after[c])
    return bits + math.log2(256 - len(out))


def number(gram):
    return int.from_bytes(gram, "big")


def test_code_lengths_are_exact():
    rng = random.Random(6)
    alphabet = b"ab \xc3\xa9\xd0"
    seen = Counter(bytes(rng.choice(alphabet) for _ in range(4)) for _ in range(150))
    tree = language.Tree(np.array([number(g) for g in seen], np.int64), np.array(list(seen.values())))
    asked = [bytes(rng.choice(alphabet + b"xyz\xff") for _ in range(4)) for _ in range(600)]
    want = [plain_bits(seen, g[:3], g[3]) for g in asked]
    got = tree.bits(np.array([number(g) for g in asked], np.uint32)) / language.UNIT
    assert np.abs(got - want).max() < 1e-4
    for context in {g[:3] for g in asked}:  # a code: the chances of all bytes sum to one
        lengths = tree.bits(np.array([number(context + bytes([b])) for b in range(256)], np.uint32)) / language.UNIT
        assert abs(np.exp2(-lengths).sum() - 1) < 1e-3
    empty = language.Tree(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert (empty.bits(np.array([1, 2], np.uint32)) == 8 * language.UNIT).all()


def test_whole_texts_cost_the_sum_of_their_bytes():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc \xe9") for _ in range(rng.choice([0, 1, 2, 50]))) for _ in range(30)]
    trees, seen = [], []
    for part in (texts[:10], texts[10:20], []):
        grams = Counter((b"   " + t)[i : i + 4] for t in part for i in range(len(t)))
        seen.append(grams)
        trees.append(language.Tree(np.array([number(g) for g in grams], np.int64), np.array(list(grams.values()), np.int64)))
    grams, starts = language._grams(texts)
    got = language.Trees(trees).sums(grams, starts, starts + np.array([len(t) for t in texts]))
    for i in range(3):
        for j, t in enumerate(texts):
            want = sum(plain_bits(seen[i], (b"   " + t)[k : k + 3], t[k]) for k in range(len(t)))
            assert abs(got[i, j] / language.UNIT - want) < 1e-3


def test_trees_hold_every_fourgram_of_their_sample(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(1000 + i, "a short text", "b") for i in range(20)], "doc_id long, text string, lang string")
    labelled, sizes = language.labels(docs)
    langs, trees = language.train(labelled, sizes)
    own = {f"   {r.text}"[i : i + 4] for r in labelled.where("lang = 'a'").collect() for i in range(len(r.text))}
    assert langs == ["a", "b"] and len(own) > 1 << 17
    assert trees.trees[0].orders[language.ORDER][0].tolist() == sorted(number(g.encode()) for g in own)


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} of a text {i}" * 3, "ab"[i % 2]) for i in range(60)] + [(99, None, "a"), (98, "", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert len(found) == 62 and found[99] == found[98] == "und" and "und" not in {found[i] for i in range(60)}
    assert language.identify(docs.limit(0)).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, carry={"lang": "string", "text": "string"}).where("held_out and lang is not null and lang_pred <> 'und' and length(text) >= 50").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
