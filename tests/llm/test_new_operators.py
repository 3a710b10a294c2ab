"""Fill-in-the-middle, periodic runs and mixing against brute force."""

import hashlib
import itertools
import operator
import random
import re
import zlib

import numpy as np
import pytest

from marram.llm import bpe, infill, mixing, periodic
from marram.llm.registry import tokenizer_path

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "doc_id long, text string, source string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def awkward(rng, n):
    """Texts with odd blanks, marks, wide letters and none at all."""
    bits = ["a", "word", "été", "中文", "\U0001f600", " ", " x", "<", "<P", "S>", "M", ">", ".", "\x1c"]
    out = [None, "", " ", "\n\t ", "x", " x", "x ", "<P> x", "a <S> b", "a<M>"]
    while len(out) < n:
        out.append("".join(rng.choice(bits) + rng.choice(["", rng.choice(BLANK), "  ", "\r\n"]) for _ in range(rng.randint(1, 30))))
    return out


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle(spark):
    rng = random.Random(11)
    rows = [(i, t, "s") for i, t in enumerate(awkward(rng, 300))]
    rows += [(None, "no id here", None), (5, "the same", "s"), (5, "the same", "s"), (7_000, "long words " * 200_000 + "中", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(repr, (plain_infill(d, t) for d, t, _ in rows)))
    assert sorted(repr(tuple(r)) for r in infill.fill_in_middle(docs).collect()) == want
    clash = docs.selectExpr("doc_id", "text", "source as N", "source as FORM", "source as `Text`")
    assert infill.fill_in_middle(clash).count() == len(rows)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    forms = {r.form for r in infill.fill_in_middle(docs, with_text=True, carry={"source": "string"}).collect()}
    assert forms == {"plain", "spm", "psm"}


def test_infill_plan_and_restore():
    rng = random.Random(12)
    for text in awkward(rng, 400)[1:]:
        for seed in range(6):
            n, form, _, _, output = infill.transform(3, text, infill.Plan(rate=100, suffix_first=50, seed=seed))
            assert infill.restore(output, form) == text
            assert (form == "plain") == (not text or any(m in text for m in ("<P>", "<S>", "<M>")))
    with pytest.raises(ValueError):
        infill.restore("<P>a", "psm")
    with pytest.raises(ValueError):
        infill.restore("a", "spm")


def plain_runs(w, exponent=4, shortest=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        same = [w[k] == w[k + q] for k in range(len(w) - q)] + [False]
        k = 0
        while k < len(same):
            start = k
            while same[k]:
                k += 1
            length = k - start + q
            part = w[start : start + length]
            if k > start and length >= max(shortest, exponent * q) and not any(part[r:] == part[: length - r] for r in range(1, q)):
                out.append((start, length, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_all_short_series_and_of_nested_repeats():
    for n in range(13):
        for w in itertools.product((0, 1), repeat=n):
            assert periodic.find_runs(w) == plain_runs(w)
    for n in range(9):
        for w in itertools.product((0, 1, 2), repeat=n):
            assert periodic.find_runs(w, 3, 3) == plain_runs(w, 3, 3)
    rng = random.Random(13)
    for _ in range(1500):
        w = []
        while len(w) < rng.randrange(5, 150):
            root = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
            part = root * rng.randrange(1, 9)
            w += part[: rng.randrange(1, len(part) + 1)]
        assert periodic.find_runs(w) == plain_runs(w)
    with pytest.raises(ValueError):
        periodic.find_runs([1, 1], 2)


class Counted:
    """A word that counts how often it is compared."""

    asked = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Counted.asked += 1
        return self.value == other.value

    def __lt__(self, other):
        Counted.asked += 1
        return self.value < other.value

    def __gt__(self, other):
        Counted.asked += 1
        return self.value > other.value


def test_lyndon_arrays_are_right_and_linear():
    rng = random.Random(14)
    for less in (operator.lt, operator.gt):
        for _ in range(300):
            w = [rng.randrange(2) for _ in range(rng.randrange(40))]
            n, sign = len(w), 1 if less is operator.lt else -1
            suffix = [[sign * x for x in w[i:]] for i in range(n)]
            smaller, agree = periodic.repeated_roots(w, less)
            for i in range(n):
                j = next((j for j in range(i + 1, n) if suffix[j] < suffix[i]), n)
                assert smaller[i] == j
                assert j == n or agree[i] == next((k for k in range(n) if j + k >= n or w[i + k] != w[j + k]), 0)
    fib = [0]
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    nested = [9]
    for k in range(8):
        nested = nested * 3 + [k]
    rising = [x for q in range(190) for x in [0] * q + [1]]
    for w in (fib + b, [0] * 20_000, [0, 1] * 10_000, nested, rising, [1 - x for x in rising], [bin(i).count("1") & 1 for i in range(20_000)]):
        Counted.asked = 0
        periodic.repeated_roots([Counted(x) for x in w])
        assert Counted.asked < 12 * len(w)


def plain_collapse(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    text = b" ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), hashlib.sha256(text).hexdigest()


def test_periodic_runs_of_documents(spark):
    rng = random.Random(15)
    rows = [(i, t, "s") for i, t in enumerate(awkward(rng, 120))]
    for i in range(200, 500):
        w = [rng.choice("abcde") for _ in range(rng.randrange(60))]
        k = rng.randrange(len(w) + 1)
        w[k:k] = [rng.choice("abé") for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 9)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w), "s"))
    rows += [(None, "x " * 9, None), (None, "x " * 9, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = periodic.collapse_runs(docs, words_of=periodic.looped).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(plain_collapse(d, t)) for d, t, _ in rows)
    assert sum(r.n_runs > 0 for r in got) > 50
    plain = periodic.collapse_runs(docs.selectExpr("doc_id", "text", "source", "source as N_RUNS", "source as `START`"), with_text=True, carry={"source": "string"})
    by = {r.doc_id: r for r in plain.collect()}
    assert by[None].collapsed == "x" and by[None].runs[0].asDict() == {"start": 0, "length": 9, "period": 1}
    assert periodic.collapse_runs(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b " * 150_000 + "c", "s")], SCHEMA)
    r = periodic.collapse_runs(long).first()
    assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (300_001, 1, 0, 300_000, 2, 150_000_000)


def plain_targets(sizes, weights=(3, 1, 2), budget=150, passes=2):
    """Shares, and the excess shared again until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values()) * budget / 100
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[k] for k in open_) for s in open_}
        over = [s for s in open_ if share[s] > passes * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = float(passes * sizes[s])
            left -= full[s]


def check_mix(rows, got, goals):
    size = {}
    for d, t, s in rows:
        size.setdefault((d, s), []).append(len((t or "").split()))
    taken = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(goals[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, n) for (d, _), ns in size.items() for n in ns)
    return taken


def test_mixing_meets_its_targets(spark):
    rng = random.Random(16)
    names = [f"s{i}" for i in range(7)] + [None, "", "é", "\U0001f600", "￮"]
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 40, rng.randrange(200)]), rng.choice(names[: 1 + i % 12])) for i in range(900)]
    rows += [(None, "a b c", "s0")] * 3 + [(7, "x y", "s1"), (7, "x y", "s1"), (8, None, "s2"), (9, "w " * 3000, "long"), (10, "w", "long")]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goals = plain_targets(sizes)
    got = mixing.per_row(mixing.plan(docs)).collect()
    taken = check_mix(rows, got, goals)
    for s in goals:
        if s != "long":
            assert abs(taken[s] - goals[s]) <= 1, (s, taken[s], goals[s])
    again = mixing.per_row(mixing.plan(docs.repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    other = mixing.per_row(mixing.plan(docs, seed=1)).collect()
    assert sorted(map(repr, got)) != sorted(map(repr, other))
    copies = mixing.mix(docs, {"n": "long"} if "n" in docs.columns else None).collect()
    assert sum(len((r.text or "").split()) for r in copies) == sum(taken.values())
    assert {r.source for r in copies} <= set(goals)


def test_mixing_in_small_bins_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 4)
    rows = [(i, "one two three", "hot") for i in range(400)] + [(i % 3, "same words", "copies") for i in range(60)] + [(1, "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "source", "source as SIZE", "source as `Target`")
    goals = plain_targets({"hot": 1200, "copies": 120, None: 1})
    got = mixing.per_row(mixing.plan(docs)).collect()
    taken = check_mix(rows, got, goals)
    assert all(abs(taken[s] - goals[s]) <= 1.5 for s in goals)
    assert mixing.per_row(mixing.plan(docs.limit(0))).count() == 0
    nothing = mixing.per_row(mixing.plan(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA))).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in nothing) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert [(r.doc_id, r.taken) for r in mixing.per_row(mixing.plan(spark.createDataFrame([(1, "a b", "x")], SCHEMA), budget=900)).collect()] == [(1, 4)]


def nearest(lengths, counts, budget):
    sums = {0}
    for length, n in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return min(abs(s - budget) for s in sums)


def test_budgets_are_fitted_exactly(monkeypatch):
    rng = random.Random(17)
    for _ in range(400):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 5)))
        counts = [rng.randint(0, 6) for _ in lengths]
        budget = rng.randint(0, 150)
        taken = mixing.fit(np.array(lengths), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert abs(int((taken * lengths).sum()) - budget) == nearest(lengths, counts, budget)
    monkeypatch.setattr(mixing, "SUMS", 64)  # longer budgets are filled first
    for _ in range(100):
        lengths = np.array(sorted({1, 2, *rng.sample(range(3, 300), 6)}))
        counts = np.array([70, 70, *(rng.randint(1, 9) for _ in lengths[2:])])
        budget = rng.randint(200, int((lengths * counts).sum()))
        taken = mixing.fit(lengths, counts, budget)
        assert (taken <= counts).all() and int((taken * lengths).sum()) == budget


def test_words_of_every_plain_letter_have_the_ids_of_the_library():
    with open(tokenizer_path(), encoding="utf-8") as f:
        tok = bpe.Tokenizer(f.read())
    texts = [x for c in bpe._AGREED for x in (chr(c), f"li{chr(c)}ma", f"{chr(c)}li {chr(c).lower()}é")]
    texts += ["Əli", "ƏLİ VƏ", "Kelvin Ångström", "STRAẞE", "ǅ Ǳ"]
    for text in texts:
        ids = [i for w in bpe.words(text, tok) for i in bpe.ids_of(w, tok)]
        assert ids == tok.library.encode(text, add_special_tokens=False).ids, repr(text)
