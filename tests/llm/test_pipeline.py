"""The pipeline against brute force, stage by stage."""

import hashlib
import random
import re
import struct

import corpus_pipeline as cp
import pytest
import xxhash
from test_contracts import base_spans, prose, words1

from marram.llm import pii
from marram.llm.registry import tokenizer_path


def brute(rows, bench):
    """rows: (doc_id, text, lang, source, n_chars)"""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    prints = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    root = [r[0] for r in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    rows = [r for r, k in zip(rows, root, strict=True) if r[0] == k]
    grams = {tuple(w[i : i + 13]) for _, t in bench if t for w in [words1(t)] for i in range(max(1, len(w) - 12) if w else 0)}
    clean = []
    for r in rows:
        w, hit = words1(r[1]), set()
        for i in range(len(w)):
            for n in {len(g) for g in grams}:
                if tuple(w[i : i + n]) in grams and i + n <= len(w):
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)
    return rows, clean


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([5, 30, 200])) for _ in range(30)]
    item = prose(rng, 30)
    texts += [texts[3], texts[3] + " ", texts[4], None, "", "12 34", "§§§ !!", item + " " + prose(rng, 20), prose(rng, 3000) + " " + item + " " + prose(rng, 3000)]
    texts += ["write to jo@ex.org or +49 30 1234567, card 4111 1111 1111 1111 " + prose(rng, 40), "IP 10.0.0.1 " + prose(rng, 50), "ÉCOLE Straße " + prose(rng, 30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    bench = [(0, item), (1, None), (2, "")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", rows, bench


def test_pipeline(spark, case):
    from tokenizers import Tokenizer

    folder, rows, bench = case
    single, clean = brute(rows, bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        kept.append({r.doc_id: r for r in docs.collect()})
        assert name == cp.STAGES[-1][0] or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept[0]) == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert set(kept[1]) == {r[0] for r in single} and set(kept[2]) == {r[0] for r in clean} == set(kept[3])
    assert len(single) > len(clean) > 20
    for stage in kept[:3]:
        assert all(tuple(r) == rows[d] for d, r in stage.items())
    tok = Tokenizer.from_file(tokenizer_path())
    for d, text, *_ in clean:
        spans = base_spans(text)
        assert pii.find(text) == spans
        want = pii.redact(text, spans)
        assert (kept[3][d].text, kept[3][d].n_chars) == (want, len(want))
        ids = tok.encode(want, add_special_tokens=False).ids
        assert kept[4][d].ids == ids and kept[4][d].n_tokens == len(ids)
        assert kept[4][d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert "[EMAIL]" in kept[3][39].text and "[CARD]" in kept[3][39].text and "[PHONE]" in kept[3][39].text and "[IP]" in kept[3][40].text
    ran = {r.doc_id: tuple(r) for r in cp.run(spark, folder).collect()}
    assert ran == {d: tuple(r) for d, r in kept[4].items()}


def test_empty_and_untidy_tables(spark, case):
    folder, rows, _ = case
    untidy = spark.createDataFrame([(None, None, None, None, None, 1, 2), (None, "the of", None, None, None, 1, 2), (7, "und die", "x", "y", None, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, TEXT2 int, spans int").withColumnRenamed("TEXT2", "Text")
    for _, stage in cp.STAGES:
        assert stage(spark, untidy.where("false"), folder).count() == 0
        assert stage(spark, untidy, folder).count() >= 1
