"""The near-duplicate stage against all pairs of shingle sets."""

import random

import corpus_pipeline as cp
from test_contracts import prose

from marram.llm import resemblance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return {r[0] for i, r in enumerate(rows) if root[i] == i}


def test_changed_words_are_found_and_less_similar_texts_stay(spark):
    rng = random.Random(3)
    texts = []
    for n, changed in [(100, 1), (100, 2), (300, 3), (300, 30)] * 8:
        words = prose(rng, n).split()
        copy = list(words)
        for at in rng.sample(range(n), changed):
            copy[at] = f"new{rng.random()}"
        texts += [" ".join(words), " ".join(copy)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    want = survivors(rows)
    assert 32 < len(want) < 50
    df = spark.createDataFrame(rows, SCHEMA)
    old = resemblance.PIECE
    try:
        for resemblance.PIECE in (1024, 1):
            assert {r.doc_id for r in cp.drop_near_duplicates(spark, df, "").collect()} == want
    finally:
        resemblance.PIECE = old


def test_links_are_exact_at_the_threshold():
    import numpy as np

    base = np.arange(8, dtype=np.uint64)
    sets = [np.append(base, np.uint64(100)), np.append(base, np.uint64(200)), base[:7], np.append(base, np.arange(300, 303).astype(np.uint64))]
    pairs = resemblance.tree(sets)
    assert sorted(zip(*pairs, strict=True)) == [(0, 1)]  # 8/10 links; 7/9 and 8/12 don't


def test_linked_fingerprints_go_whatever_their_shingle_sets(spark):
    """Texts of few distinct shingles whose counts differ: equal or near fingerprints, but sets of a similarity below 0.8."""
    from marram.llm import simhash

    base = "the same few words come again and again until the page is full "
    texts = [base * 40, base * 40 + "an ending that only one copy has got", "something else " * 3, "a text about other matters that stays"]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < min((prints[0] ^ p).bit_count() for p in prints[2:])
    assert len(survivors([(i, t) for i, t in enumerate(texts)])) == 4
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == {0, 2, 3}
