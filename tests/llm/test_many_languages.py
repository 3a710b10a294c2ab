"""Every labelled language is learned, however many there are, and blocks of them change nothing."""

import random

from marram.llm import language


def test_more_languages_than_a_block(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(50):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 5)
        rows += [(100 * k + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(20)), f"l{k:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(tuple, language.identify(docs).collect()))
    assert {r[2] for r in want} == {f"l{k:02}" for k in range(50)}
    assert sum(p == f"l{d // 100:02}" for d, _, p, *_ in want) > 570
    for block in (7, 64):
        monkeypatch.setattr(language, "BLOCK_LANGUAGES", block)
        got = sorted(map(tuple, language.identify(docs, carry={"lang": "string"}).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte").collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want, strict=True))
