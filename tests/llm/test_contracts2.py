"""Substring removal, exact top-k and edit-aware token counts against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from marram.llm import substring, tokens, topk
from marram.llm.arrays import unpack, word_pieces
from marram.llm.fmindex import FMIndex

WORDS = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute_repeats(rows):
    """rows: (doc_id, text), ids may repeat."""
    first, out = {}, []
    named = sorted({(d, t) for d, t in rows if d is not None})
    for d, t in named:
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            first[g] = min(first.get(g, (d, i)), (d, i))
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if d is not None:
            for i in range(len(w) - 19):
                if first[tuple(w[i : i + 20])] < (d, i):
                    gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "split", "held"), [(64, 4096, 1 << 18), (1, 4096, 1 << 18), (64, 2, 1 << 18), (64, 3, 5), (64, 4096, 4)])
def test_substring_removal(spark, monkeypatch, hot, split, held):
    monkeypatch.setattr(substring, "HOT_IN_SAMPLE", hot)
    monkeypatch.setattr(substring, "SPLIT_SEGMENTS", split)
    monkeypatch.setattr(substring, "HELD_ROWS", held)
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring, "CHUNK_BYTES", 700)
    rng = random.Random(4)
    rows, pool = [], [prose(rng, 60) for _ in range(8)]
    for d in range(150):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, 40)
            w += prose(rng, rng.randint(0, 40)) + p[a : a + rng.randint(1, 60)]
        sep = rng.choice([" ", "\n", "  \t"])
        rows.append((d, sep.join(w)))
    line = prose(rng, 25)
    rows += [(1000 + i, " ".join(prose(rng, 30) + line + prose(rng, 30))) for i in range(80)]
    rows += [(200 + i, rows[7][1]) for i in range(20)] + [(300, "a " * 200), (301, "a b " * 100), (302, None), (303, ""), (304, "x"), (None, rows[7][1]), (5, rows[5][1])]
    rows += [(400, " ".join(pool[0] + pool[0])), (-3, " ".join(pool[1])), (401, "é x " * 50)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("Text"), F.lit("x").alias("DOC_ID")).repartition(5)
    got = sorted((tuple(r) for r in substring.remove_repeats(docs).collect()), key=str)
    assert got == sorted(brute_repeats(rows), key=str)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_words_of_equal_letter_sums(spark):
    """Two words whose polynomial hashes modulo 2 ** 64 agree for every odd base are different words."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    side = [f"s{i}" for i in range(24)]
    rows = [(1, " ".join([*side[:12], one, *side[12:]])), (2, " ".join([*side[:12], other, *side[12:]]))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_very_long_text_is_taken_in_pieces():
    rng = random.Random(5)
    words = [str(rng.randint(0, 30)).encode() for _ in range(3000)]
    body = b"  ".join(words)
    for overlap in (0, 5, 19):
        parts = list(word_pieces(body, overlap, 500))
        assert len(parts) > 5 and [last for *_, last in parts] == [False] * (len(parts) - 1) + [True]
        assert all(w == words[first : first + len(w)] for first, w, _ in parts)
        assert all(a + len(w) - overlap == b for (a, w, _), (b, *_) in zip(parts, parts[1:], strict=False))


def test_matching_statistics():
    rng = random.Random(2)
    phrases = [[rng.randint(1, 3) for _ in range(rng.randint(0, 15))] for _ in range(30)]
    text = np.array([x for p in phrases for x in (*p, 0)])
    index = FMIndex(text, 3, depth=4)
    lengths = np.array([len(p) for p in phrases])
    begins = np.cumsum(lengths + 1) - lengths - 1
    match, lo, hi = index.stream(text, begins, lengths)
    grams = lambda n: [tuple(p[i : i + n]) for p in phrases for i in range(len(p) - n + 1)]
    for begin, p in zip(begins, phrases, strict=True):
        for i in range(len(p)):
            n = int(match[begin + i])
            assert n == min(5, len(p) - i)
            assert hi[begin + i] - lo[begin + i] == grams(n).count(tuple(p[i : i + n]))


def test_fm_index():
    rng = random.Random(9)
    for size in (1, 2, 7, 64, 65, 200):
        phrases = [[rng.randint(1, 4) for _ in range(rng.randint(0, 9))] for _ in range(size)]
        text = np.array([x for p in phrases for x in (*p, 0)])
        index = FMIndex(text, 4, sample=3)
        for n in (1, 2, 3):
            grams = {tuple(text[i : i + n]) for i in range(len(text) - n + 1) if 0 not in text[i : i + n]} | {(4,) * n}
            patterns = np.array(sorted(grams))
            lo, hi = index.search(patterns, np.full(len(patterns), n))
            for p, a, b in zip(sorted(grams), lo, hi, strict=True):
                want = [i for i in range(len(text) - n + 1) if tuple(text[i : i + n]) == p]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("sizes", [(4096, 1024), (20, 3)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(topk, "SAMPLE_ROWS", sizes[1])
    monkeypatch.setattr(topk, "FEW", sizes[1])
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=16) / 4]) for i in range(300)]
    rows += [(500, rows[50][1]), (501, rows[50][1]), (502, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf")]), (700, [0.5, -0.25]), (750, []), (None, [1.0]), (3, rows[3][1])]
    rows[100] = (100, [0.0] * 16)
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = plain.selectExpr("*", "1 as label", "2 as VEC_ID", "3 as Vec", "4 as row")
    is_query = F.col("vec_id") % 50 == 0
    got = sorted(map(tuple, topk.top_k(topk.integer_vectors(df), is_query).collect()))
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = np.zeros(16, np.int64)
            w[: len(v)] = np.floor(256 * np.array(v))
            vectors[i] = w
    want = []
    for q, v in vectors.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in vectors.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(topk.integer_vectors(df.limit(0)), is_query).count() == 0
    assert topk.top_k(topk.integer_vectors(plain.where("vec_id = 50")), is_query).count() == 0


def test_processing_stops_early_on_proof():
    """Directions without structure, the hardest case: about half of the postings, and few rows, are touched."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(4000, 64)) / 8).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), x)
    for q in range(0, 4000, 100):
        scores = x @ x[q]
        scores[q] = -(1 << 60)
        beat = np.sort(scores[:1000])[-5]
        want = np.lexsort((np.arange(4000), -scores))[:5]
        ids, got = index.search(x[q], 5, q, beat)
        assert ids.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
    assert index.processed < 0.75 * index.queries * x.size
    assert index.scored < 0.03 * index.queries * len(x)
    large = topk.ImpactIndex(np.arange(3), np.array([[1 << 40, 5], [1 << 40, 7], [-(1 << 40), 1]]))
    assert large.search(np.array([1 << 20, 3]), 2, -1)[0].tolist() == [1, 0]


def test_edited_counts(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    alphabet = ["the", " ", "  ", "\n", "\n\n", "'s", "'", "x", "é", "ß", "1", "23", "!", "...", " Word", "日本", "\t", "don't", "'ll"]
    rows = []
    for d in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30, 400, 3000])))
        edits = [(rng.randint(-2, len(text) + 5), rng.choice([0, 0, 1, 5, 60, 5000]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 0, 1, 3, 40, 2000])))) for _ in range(rng.randint(0, 5))]
        rows.append((d, text, edits))
    rows += [(900, None, [(0, 0, "hello")]), (901, "abc", None), (902, "abc", [None, (None, None, None)]), (None, "abc", [])]
    kind = "array<struct<start:int,deleted:int,inserted:string>>"
    docs = spark.createDataFrame(rows, f"doc_id long, text string, e {kind}").selectExpr("*", "1 as edits", "2 as Text", "3 as TOKENS", "4 as Doc_Id")
    trees = tokens.keep_trees(docs, path, P.PATTERN, carry={"e": kind})
    edited = tokens.apply_edits(trees, F.col("e"), path, P.PATTERN, with_tree=True)
    got = {r.doc_id: r for r in edited.collect()}
    for d, text, edits in rows:
        now = text or ""
        for e in edits or []:
            if e is not None:
                a = max(0, min(len(now), e[0] or 0))
                now = now[:a] + (e[2] or "") + now[a + max(0, e[1] or 0) :]
        assert got[d].text == now
        assert (got[d].n_tokens, got[d].n_tokens_edited) == (len(enc.encode_ordinary(text or "")), len(enc.encode_ordinary(now))), (d, text, edits)
    # Trees that are kept take further edits as they are; what they hold equals a split of the whole text.
    again = tokens.apply_edits(edited, F.array(F.struct(F.lit(3).alias("start"), F.lit(2).alias("deleted"), F.lit(" x").alias("inserted"))), path, P.PATTERN, with_tree=True)
    for r in again.collect():
        now = got[r.doc_id].text
        now = now[:3] + " x" + now[5:]
        assert r.text == now and r.n_tokens_edited == len(enc.encode_ordinary(now))
        assert unpack(r.chars).tolist() == [len(p) for p in regex.findall(P.PATTERN, now)]
    long = tokens.keep_trees(spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").where("length(text) > 2000"), path, P.PATTERN)
    counts = tokens.apply_edits(long, tokens.routine_edits(), path, P.PATTERN).collect()
    assert all(r.n_reencoded < 60 < r.n_pieces for r in counts)
    assert tokens.apply_edits(tokens.keep_trees(docs.limit(0), path, P.PATTERN), tokens.routine_edits(), path, P.PATTERN).count() == 0


def test_edits_encode_only_what_they_touch():
    import public_tokenizers as P

    ranks = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    text = "".join(f"word{i} and\n" for i in range(5000))
    first = tokens.TokenTree.of(text, tokens.Counter(ranks, P.PATTERN))
    fresh = tokens.Counter(ranks, P.PATTERN)
    tree = tokens.TokenTree(*first.leaves(), fresh)
    tree.edit(20_000, 3, "something else")
    assert fresh.encoded <= tree.reencoded < 10 and len(tree.blocks.cut) <= 2
    assert tree.total == tokens.TokenTree.of(tree.leaves()[0], fresh).total
