"""The corpus operators against brute force over small fixtures with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash

from marram.llm import bpe, contamination, language, pii, simhash, urls, warc
from marram.llm.arrays import pack, unpack
from marram.llm.registry import SITE_RULES, tokenizer_path

WORDS = "the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts):
    rows = [(i, t, "x", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string, lang string").withColumnRenamed("TEXT2", "Text")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([0, 1, 3, 12, 13, 14, 40, 300])) for _ in range(40)]
    texts += [None, "", "  \n\t ", texts[5], texts[5], "naïve Straße ÉCOLE 123 déjà-vu", "x" * 5000, "word " * 3000, "!!! ??? 42", "日本語 テスト ’quoted’ €5", "it's <|endoftext|> They'LL"]
    return texts


def words1(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination(spark, corpus):
    rng = random.Random(3)
    items = [(i, " ".join(words1(corpus[i])[:30])) for i in range(0, 20, 2)] + [(100, "it"), (101, prose(rng, 20)), (102, None), (103, "..."), (None, "the of"), (100, "it"), (9, "Straße école")]
    want = []
    grams = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = words1(text)
        for at in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[at : at + 13]), set()).add(item)
    for d, t in enumerate(corpus):
        w, hit, ids = words1(t), set(), set()
        for at in range(len(w)):
            for n in {len(g) for g in grams}:
                if (g := tuple(w[at : at + n])) in grams and len(g) == n:
                    hit |= set(range(at, at + n))
                    ids |= grams[g]
        text = ",".join(sorted(map(str, ids)))
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(text.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    docs, bench = documents(spark, corpus), spark.createDataFrame(items, "item_id long, text string")
    got = contamination.digest(contamination.find_occurrences(docs, bench)).collect()
    assert sorted(map(tuple, got)) == want
    old = contamination.BLOCK_BYTES
    try:
        contamination.BLOCK_BYTES = 200
        assert sorted(map(tuple, contamination.digest(contamination.find_occurrences(docs, bench)).collect())) == want
    finally:
        contamination.BLOCK_BYTES = old
    assert contamination.digest(contamination.find_occurrences(docs.limit(0), bench)).count() == 0
    assert {r.n_hit for r in contamination.find_occurrences(docs, bench.limit(0)).collect()} == {0}


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = []
    for d, t in enumerate(corpus):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.encode_documents(documents(spark, corpus), path).collect()
    assert sorted(map(tuple, got)) == want
    both = bpe.encode_documents(documents(spark, corpus), path, with_ids=True, with_text=True).collect()
    for r in both:
        assert r.ids == tok.encode(corpus[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == tok.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode_documents(documents(spark, corpus).limit(0), path).count() == 0


def test_bpe_words_and_parts(spark, monkeypatch):
    """Small chunks and parts; odd scripts, added tokens and marks at part borders; each distinct word is encoded once."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 400)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    rng = random.Random(1)
    atoms = ["the", "Straße", " ", " ", "\n", "it's", "x'LL", "日本", "e\u0301", "\u0301", "\0", "\1a", "\2", "<|endoftext|>", "<|startoftext|>x", "<|", "42", "Σας", "İ", "\u00a0", "\x85", "\x1c", "ﬁ", "½", "𝟘", "…", "!?", "👍🏽", "각", "\u1100\u1161"]
    for plain in (True, False):
        sample = [t for t in ["".join(rng.choice(atoms[: 8 if plain else None]) for _ in range(rng.choice([0, 3, 20, 200]))) for _ in range(60)]]
        rows = [(i, t) for i, t in enumerate(sample)]
        got = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, with_ids=True, with_text=True).collect()}
        for i, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids
            assert got[i].ids == ids, t
            assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)
    codes = np.array([0, 255, 256, 70000], np.uint32)
    assert unpack(pack(codes)).tolist() == codes.tolist() and len(unpack(pack(codes[:0]))) == 0
    table = spark.createDataFrame([(0, i, w) for i in range(50) for w in ("the", "\1<|endoftext|>", "Xyz")], "chunk long, place int, word string")
    encoded = [(r.place, tuple(np.frombuffer(r.ids, '<u2').tolist())) for r in bpe.encode_words(table, spark.sparkContext.broadcast(open(path).read())).collect()]
    one = [tuple(tok.encode("the", add_special_tokens=False).ids), (tok.token_to_id("<|endoftext|>"),)]
    assert len(encoded) == 150 and all((i, x) in encoded for i in range(50) for x in one)


def test_bpe_encodes_each_word_once(monkeypatch):
    """The rows of a task come sorted by word; equal ones are encoded once, also across batches."""
    import pyarrow as pa

    asked, rows = [], [(0, 0, "a"), (1, 5, "a"), (2, 1, "a"), (0, 3, "b"), (1, 0, "c"), (3, 0, "c")]
    monkeypatch.setattr(bpe, "ids_of", lambda word, spec: asked.append(word) or [len(asked)])

    class Rows:
        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):  # noqa: N802
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            parts = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 2], strict=True)], names=["chunk", "place", "word"]) for i in (0, 2, 4)]
            return [tuple(r.values()) for part in run(iter(parts)) for r in part.to_pylist()]

    class Spec:
        value = open(tokenizer_path()).read()

    assert [(c, p, *np.frombuffer(ids, '<u2').tolist()) for c, p, ids in bpe.encode_words(Rows(), Spec())] == [(0, 0, 1), (1, 5, 1), (2, 1, 1), (0, 3, 2), (1, 0, 3), (3, 0, 3)]
    assert asked == ["a", "b", "c"]


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_pii(spark, corpus):
    rng = random.Random(1)
    tricky = ["a@b.c d.e@f@g.hi.j", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (555) 123-4567-", "é@x.y +49 30 1234567 mail: á.b@c-d.e-f", "@@a@b@c.d..", "IBAN GB82 WEST 1234 5698 7654 32 ok", "x" * 50000 + "@a.b", "1" * 5000, "9" * 3000 + ".1.1.1"]
    tricky += ["".join(rng.choice("@ab.1 +-()0245") for _ in range(200)) for _ in range(300)]
    texts = corpus + tricky
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(documents(spark, texts))).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        want = base_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[d].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert set(want) <= {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[d].spans.split(",") if s)}
    assert "iban:5:32" in got[len(corpus) + 7].spans
    red = {r.doc_id: r.redacted for r in pii.find_spans(documents(spark, texts), redacted=True).collect()}
    assert red[len(corpus)].startswith("[EMAIL] ") and red[40] is None


def test_simhash(spark, corpus):
    rng = random.Random(5)
    texts = list(corpus)
    base = prose(rng, 400).split()
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(400)] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    prints = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    want = [(d, f"{prints[d]:016x}", root[d]) for d in range(len(texts))]
    old = simhash.PIECE
    try:
        for simhash.PIECE in (1024, 4):
            assert sorted(map(tuple, simhash.near_duplicates(documents(spark, texts)).collect())) == want
    finally:
        simhash.PIECE = old
    assert simhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_simhash_pairs_at_the_radius(spark):
    rng = random.Random(11)
    prints = set()
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        prints |= {x, y}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert len({frozenset(r) for r in links}) == 300


def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": "the of and in that", "bb": "und der die das nicht", "cc": "que los una con para"}
    rows = []
    for i in range(300):
        k = rng.choice(list(kinds))
        rows.append((i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(3, 50))), k))
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (1003, "ü", None), (None, "und der", None), (5, "und der", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 5}
    assert all(by[i].lang_pred == k for i, _, k in rows[:300] if i != 5)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred != "und"
    import zlib

    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= by[i].score <= 1 for i in by)
    blind = language.identify(docs.limit(0)).collect() + language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in blind} == {"und"}


def test_urls(spark):
    rows = [(1, "HTTPS://A.Example.ORG/en/17?x=1"), (2, "http://example.org/es/"), (3, "https://x.com/fr/a"), (4, "https://x.com/de/a#b"), (5, None), (6, "no scheme"), (7, "http://n.net/a?utm_source=f"), (8, "http://notorg/"), (9, "http://org"), (10, "http://h.org?p=/es/"), (10, "http://h.org?p=/es/"), (None, "http://example.com/de/")]
    got = {r.page_id: tuple(r)[1:5] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("URL2", __import__("pyspark").sql.functions.lit(1)), SITE_RULES).collect()}
    assert got == {
        1: ("a.example.org", "/en/17", "example.org/en/1", "block"), 2: ("example.org", "/es/", "example.org/es/", "block"), 3: ("x.com", "/fr/a", "com/fr/", "allow"),
        4: ("x.com", "/de/a", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("n.net", "/a", None, "block"), 8: ("notorg", "/", None, "allow"),
        9: ("org", "", None, "allow"), 10: ("h.org", "", None, "allow"), None: ("example.com", "/de/", "com/de/", "block"),
    }
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string"), SITE_RULES).count() == len(rows)


def test_warc(spark):
    import base64

    body = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb é\n"
    odd = ["\r", "\n", "\r\n", "\r\r\n", "\n\r", "\r\n\r\n", "\r\n\r\nx\r", "\r\n\r\n\r", "\r" * 70000 + "\r\n" * 40000]
    rows = [(3, "http://a/", body), (1, "http://b/ c\r\nX: y", body), (2, None, None), (4, "u", ""), (5, "u", "x" * 100000), (5, "u", "x" * 100000), (None, "u", "x" * 100000), (7, "u", "é")]
    rows += [(20 + i, "u", t) for i, t in enumerate(odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as HTML", "2 as Page_Id", "3 as number", "'x' as digest").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    size = lambda t: len((t or "").encode())
    first = {3: 1, 1: None, 2: None, 4: 2, 7: None} | {20 + i: None for i in range(len(odd))}
    want = [(p, size(t), sha(t), "revisit" if first[p] else "response", first[p]) for p, _, t in rows if p in first]
    big = rows[4][2]
    want += [(5, size(big), sha(big), "response", None), (5, size(big), sha(big), "revisit", 5), (None, size(big), sha(big), "revisit", 5)]
    assert got == sorted(want, key=str)


def test_warc_archives(spark, tmp_path):
    """Archives far larger than a batch, one gzip member a record, small payloads, and archives that are cut off or wrong."""
    import gzip

    record = lambda k, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nContent-Type: application/http\r\nContent-Length: {len(body) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [bytes([65 + k % 26, 13, 10, 255]) * (1 + 20000 * (k % 7 == 0)) for k in range(300)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in enumerate(bodies)))
    (tmp_path / "b.warc").write_bytes(record(300, b"plain"))
    got = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    import base64

    assert got == {f"<{k}>": (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for k, b in enumerate([*bodies, b"plain"])}
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages, min_bytes=3).collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    for name, bad in (("cut", record(1, b"abc")[:-6]), ("header", record(1, b"abc")[:40]), ("long", record(1, b"abc").replace(b"Content-Length: 22", b"Content-Length: 21"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="ends within a record|longer than its Content-Length"):
            warc.read_archives(spark, str(tmp_path / name)).collect()
