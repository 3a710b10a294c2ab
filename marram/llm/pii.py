"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.arrays import batch, carried, ddl, few, texts
from marram.sources.shared import pick

#: The base kinds, and what this operator adds to them.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from every later one, so later starts are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words before a span that make it likelier.
CONTEXT = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|ruf", re.I),
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
}
#: Score without and with such a word; a checksum counts for more than a shape.
SCORES = {"email": (0.9, 0.99), "ip": (0.6, 0.9), "card": (0.8, 0.99), "phone": (0.6, 0.9), "iban": (0.9, 0.99)}
WINDOW = 40
#: Text bytes that a task handles at once (or one longer text).
SLICE_BYTES = 4 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; walks from one @ to the next, so a long run of letters costs nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def find(text: str) -> list[tuple[str, int, int]]:
    """All confirmed spans (kind, start, end) in code points, by start and then kind as listed."""
    spans = [("email", s, e) for s, e in _emails(text)]
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    if first := _DIGIT.search(text):
        at = first.start()
        if "." in text:
            spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text, at) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        for m in _IBAN.finditer(text, max(0, at - 2)):
            if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
                spans.append(("iban", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def score(text: str, kind: str, start: int) -> float:
    return SCORES[kind][bool(CONTEXT[kind].search(text, max(0, start - WINDOW), start))]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or group of overlapping spans, gives way to its first kind in brackets."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, *, redacted: bool = False) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, score>> of every row; redacted adds the text without them.

    Whole texts are searched, very long ones too. A null text has no spans and stays null, an empty one has none;
    null ids are kept; repeated rows give repeated results; an empty table gives an empty result; other
    columns are ignored, whatever their names. Of spans with equal starts the first kind as listed comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, SLICE_BYTES)):
            bodies = texts(rows.column("text"))
            found = [find(t) for t in bodies]
            spans = pa.array([[{"kind": k, "start": s, "end": e, "score": score(t, k, s)} for k, s, e in x] for t, x in zip(bodies, found, strict=True)], _SPANS)
            out = {"doc_id": rows.column("doc_id"), "spans": spans}
            if redacted:
                out["redacted"] = pa.array([None if old is None else redact(t, x) if x else t for t, x, old in zip(bodies, found, rows.column("text").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    ddl = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>" + ", redacted string" * redacted
    return pick(docs, doc_id="long", text="string").mapInArrow(run, ddl)


def redact_documents(docs: DataFrame, carry: dict[str, str]) -> DataFrame:
    """doc_id, text without personal data (null stays null), n_spans, and the columns to carry (name: type)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (some for part in batches for some in few(part, SLICE_BYTES)):
            bodies = rows.column("text").to_pylist()
            found = [find(t or "") for t in bodies]
            clean = [redact(t, x) if x else t for t, x in zip(bodies, found, strict=True)]
            yield carried(batch([("doc_id", pa.int64()), ("text", pa.string()), ("n_spans", pa.int64())], [rows.column("doc_id"), clean, [len(x) for x in found]]), rows, carry)

    return pick(docs, **{"doc_id": "long", "text": "string", **carry}).mapInArrow(run, "doc_id long, text string, n_spans long" + ddl(carry))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text, of each row of find_spans (no spans: zeros and empty strings)."""
    spans = F.col("spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
