"""BPE encoding and decoding through a table of distinct words.

1. A task splits its texts in chunks. A chunk has a list of its distinct words, and a text is the series of its
   words' places in that list.
2. The lists' rows (chunk, place, word) meet by word: each distinct word of the corpus is in one task, which encodes it
   once and answers all chunks that have it.
3. The answers meet the texts, written as places, by chunk. Ids are put in place by position, and joined to
   their pieces through the vocabulary, which is broadcast (its size is fixed). Words do not depend on their
   neighbours in this kind of tokenizer, so these are the ids of the whole text.

So the shuffles hold a row for each distinct word of a chunk, twice, and each text once, as numbers; no row per
position. The texts are split twice rather than kept, and a digest of each chunk's list tells if they changed.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, few, pack, sha256, slices, texts, unpack
from marram.sources.shared import pick

#: Characters of a chunk's texts and its distinct words, about, and of the pieces that longer texts are split in.
CHUNK_CHARS, CHUNK_WORDS, PIECE_CHARS = 64 << 20, 500_000, 1 << 20
#: Characters of the texts whose results are put together at once.
SLICE_WORDS = 1 << 20

# Code points whose class (letter, number, space, other), lower case and normal form every Unicode version agrees on, and whose lower case is one of them.
_AGREED = [*range(2, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]
_PLAIN = [c for c in _AGREED if all(ord(x) in _AGREED for x in chr(c).lower())]
_ODD = re.compile("[^" + "".join(map(re.escape, map(chr, _PLAIN))) + "]|<\\|", re.S)
#: What a table entry begins with that is no plain word: a piece in the tokenizer's byte alphabet, an added token.
MAPPED, ADDED = "\0", "\1"


def _class(major: str) -> str:
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] == major)


_SPACE = "\\t-\\r \\x85\\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+", re.S)
_BLANK = re.compile("[ \n]")


class Tokenizer:
    """The library's tokenizer of a file, with its parts at hand."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.normalizer, self.splitter = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        #: How an id is packed.
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def vocabulary(self) -> list[str]:
        return [self.library.id_to_token(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]


@lru_cache(maxsize=4)
def tokenizer(spec: str) -> Tokenizer:
    """Asked for once a task: to look up so long a key takes a while."""
    return Tokenizer(spec)


def words(text: str, tok: Tokenizer) -> list[str]:
    """The words of a text in order. Where scripts are rare or tokens are added, the library's own steps split it."""
    if not _ODD.search(text):
        return _WORD.findall(text.lower())
    out = []
    for k, part in enumerate(tok.added.split(text) if tok.added else [text]):
        if k % 2:
            out.append(ADDED + part)
        elif part:
            out += [MAPPED + piece for piece, _ in tok.splitter.pre_tokenize_str(tok.normalizer.normalize_str(part))]
    return out


def parts(text: str, most: int) -> Iterator[str]:
    """A long text in parts that begin at a blank; words, and normal forms, do not reach over one."""
    at = 0
    while len(text) - at > most:
        cut = _BLANK.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def ids_of(word: str, tok: Tokenizer) -> list[int]:
    """Ids of a table entry. The byte alphabet maps visible ASCII to itself, so such a word goes to the merges as it is."""
    if word.startswith(ADDED):
        return [tok.library.token_to_id(word[1:])]
    if word.startswith(MAPPED):
        return [t.id for t in tok.model.tokenize(word[1:])]
    if word.isascii() and word.isprintable():
        return [t.id for t in tok.model.tokenize(word)]
    return tok.library.encode(word, add_special_tokens=False).ids


_LISTED = [("chunk", pa.int64()), ("place", pa.int32()), ("word", pa.string())]
_CODED = [("chunk", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("digest", pa.int64())]


class _Chunk:
    def __init__(self, number: int):
        self.number, self.places, self.chars = number, {}, 0

    def code(self, text: str, tok: Tokenizer) -> bytes:
        """The places of a text's words in the list, which grows by new ones."""
        places, codes = self.places, []
        for piece in parts(text, PIECE_CHARS):
            found = words(piece, tok)
            try:
                codes.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
            except KeyError:
                for word in found:
                    places.setdefault(word, len(places))
                codes.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
        self.chars += len(text)
        return pack(np.concatenate(codes))

    @property
    def full(self) -> bool:
        return self.chars > CHUNK_CHARS or len(self.places) > CHUNK_WORDS

    def close(self) -> int:
        """A digest of the list."""
        state = xxhash.xxh3_64(str(len(self.places)))
        for word in self.places:
            state.update(word.encode("utf-8", "surrogatepass") + b" ")
        return state.intdigest() - (1 << 63)


def _coded(rows: DataFrame, spec, lists: bool) -> DataFrame:
    """The lists of the chunks (chunk, place, word), or the texts (chunk, doc_id, codes); either ends with the list's digest (place -1, or no codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, tok = None, tokenizer(spec.value)

        def ended() -> Iterator[pa.RecordBatch]:
            digest = chunk.close()
            if not lists:
                yield batch(_CODED, [[chunk.number], [None], [None], [digest]])
                return
            yield batch(_LISTED, [[chunk.number], [-1], [str(digest)]])
            found = list(chunk.places)
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                yield batch(_LISTED, [[chunk.number] * len(some), list(range(at, at + len(some))), some])

        for part in batches:
            for some in few(part, 4 << 20):
                chunk = chunk or _Chunk(some.column("part")[0].as_py() << 32)
                of, planes = [], []
                done = 0
                for i, text in enumerate(texts(some.column("text"))):
                    planes.append(chunk.code(text, tok))
                    of.append(chunk.number)
                    if chunk.full:
                        if not lists:
                            yield batch(_CODED, [of, some.column("doc_id").slice(done, len(of)), planes, pa.nulls(len(of), pa.int64())])
                        yield from ended()
                        chunk, of, planes, done = _Chunk(chunk.number + 1), [], [], i + 1
                if of and not lists:
                    yield batch(_CODED, [of, some.column("doc_id").slice(done, len(of)), planes, pa.nulls(len(of), pa.int64())])
        if chunk is not None:
            yield from ended()

    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, "chunk long, place int, word string" if lists else "chunk long, doc_id long, codes binary, digest long")


def encode_words(listed: DataFrame, spec) -> DataFrame:
    """(chunk, place, ids binary) of (chunk, place, word): equal words meet in a task, in a row, and are encoded once. Ids are packed; digests pass as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, tok = None, None, tokenizer(spec.value)
        code = {"<u2": "H", "<u4": "I"}[tok.kind]
        for rows in batches:
            out = []
            for place, word in zip(rows.column("place").to_pylist(), rows.column("word").to_pylist(), strict=True):
                if place < 0:
                    out.append(word.encode())
                    continue
                if word != last:
                    found = ids_of(word, tok)
                    last, ids = word, struct.pack(f"<{len(found)}{code}", *found)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([rows.column("chunk"), rows.column("place"), pa.array(out, pa.binary())], names=["chunk", "place", "ids"])

    return listed.repartition("word").sortWithinPartitions("word").mapInArrow(run, "chunk long, place int, ids binary")


def encode_documents(docs: DataFrame, tokenizer_path: str, *, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encodes and decodes the whole text of every row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids array<int>, with_text
    adds decoded. A null or empty text has no tokens and decodes to the empty string; very long texts are split
    part by part; a null doc_id is kept; repeated rows give repeated results; an empty table gives an empty
    result; other columns are ignored, whatever their names. The tokenizer file must have no decoder, and
    added tokens that match as they are.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    stated = json.loads(text)
    if stated["decoder"] or any(t[k] for t in stated["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("the tokenizer's words depend on more than themselves")
    spec = docs.sparkSession.sparkContext.broadcast(text)  # a fixed vocabulary file of a few MB
    rows = pick(docs, doc_id="long", text="string")
    lists = encode_words(_coded(rows, spec, True), spec).select("chunk", "place", "ids", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("digest"))
    numbers = _coded(rows, spec, False).select("chunk", F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("ids"), "doc_id", "codes", "digest")
    # Of a chunk, its list comes first, in order, with its digest in front; then the texts' digest, then the texts.
    met = lists.union(numbers).repartition("chunk").sortWithinPartitions("chunk", F.col("place").asc_nulls_last(), F.col("digest").asc_nulls_last())
    out = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(spec.value)
        vocabulary, size = tok.vocabulary(), np.dtype(tok.kind).itemsize
        chunk, lists, lengths, pieces, digest = None, [], [], [], None
        flat = offsets = None
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                chunks = part.column("chunk").to_numpy()
                is_word = part.column("place").is_valid().to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.concatenate([[True], (chunks[1:] != chunks[:-1]) | (is_word[1:] != is_word[:-1]), [True]]))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    run = part.slice(a, b - a)
                    if chunks[a] != chunk:
                        chunk, lists, lengths, pieces, digest, flat = chunks[a], [], [], [], None, None
                    if is_word[a]:
                        own = run.column("ids").to_pylist()
                        if digest is None:
                            digest, own = int(own[0]), own[1:]
                        lists.append(np.frombuffer(b"".join(own), tok.kind))
                        lengths.append(np.fromiter(map(len, own), np.int64, len(own)) // size)
                        at_hand, ends = [vocabulary[i] for i in lists[-1].tolist()], np.cumsum(lengths[-1]).tolist()
                        pieces += [" ".join(at_hand[x:y]) for x, y in zip([0, *ends][: len(ends)], ends, strict=True)]
                        continue
                    if flat is None:
                        told = run.column("digest")[0].as_py()
                        if told != digest:
                            raise ValueError("the rows came in another order when they were read again; write them to a table first")
                        run = run.slice(1)
                        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))]).astype(np.int64)
                        flat = np.concatenate([np.zeros(0, tok.kind), *lists]).astype("<u4")
                    planes = run.column("codes").to_pylist()
                    for c, d in slices(planes, SLICE_WORDS):
                        ids, decoded = [], []
                        for p in planes[c:d]:
                            codes = unpack(p)
                            n = offsets[codes + 1] - offsets[codes]
                            where = np.repeat(offsets[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                            ids.append(flat[where])
                            decoded.append(" ".join([pieces[k] for k in codes.tolist()]))
                        columns = [run.column("doc_id").slice(c, d - c), [len(x) for x in ids], [sha256(x.tobytes()) for x in ids], [sha256(x.encode("utf-8", "surrogatepass")) for x in decoded]]
                        if with_ids:
                            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32))))
                        if with_text:
                            columns.append(decoded)
                        yield batch(out, columns)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return met.mapInArrow(assemble, ddl)
