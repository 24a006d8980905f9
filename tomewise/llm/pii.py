"""Personal data: high-recall generators propose spans, boosted trees select among them.

Base kinds (email, ip, card, phone) come from their definitions and always stay. Further generators propose whatever
holds digits, an at sign or a key=value pair; the trees see the format of a span and the words before it, are fitted
on weak labels (base spans and what covers the value of a known credential format, against the rest) from a bounded sample of documents, and are
calibrated on rows kept apart, which also set the threshold. So the labels of the base kinds come from the same patterns
as the base spans, and what the trees add are credentials and what looks like them. A selected span is kept where it overlaps no base span; of two, the one that holds the
other.

Defined results: null and empty texts have no spans; a text of any length is read whole; rows that repeat a doc_id, a
null one too, are answered row by row; of overlapping selected spans with one probability the one that begins first
stays, then the longer one; redaction keeps all columns, others than text and n_chars as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees, threshold
from . import shared
from .shared import column, rows

FIT_DOCS = 20_000  # documents, in expectation, whose candidates the trees are fitted on
FIT_ROWS = 100_000  # and of these candidates those of the least hashes
KINDS = ("email", "ip", "card", "phone")
ADDED = "other"
CONTEXT = 32  # characters before a span that the features see

# The formats of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CREDENTIAL = re.compile(r"AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?(?P<value>[^\s]{6,})", re.I)

DIGIT = re.compile(r"[0-9]")
KEY = r"[A-Za-z][A-Za-z0-9_-]{2,}+[\"']?\s*+[=:]"
#: what follows white space is no value where it is the key of a pair itself
PAIR = re.compile(rf"(?<![A-Za-z0-9_-]){KEY}(?:\s++(?!{KEY}))?(?:\"[^\"\n]{{4,}}+\"|'[^'\n]{{4,}}+'|[^\s]{{4,}}+)")
HINTS = ("mail", "phone", "tel", "call", "contact", "card", "pass", "key", "secret", "token", "user", "id", "ssn", "iban")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: an address starts with the run of local characters before its at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may overlap: digit-bearing tokens, runs of digits and separators, pairs, what surrounds an at sign."""
    out = set()
    if DIGIT.search(text):
        done = 0
        for m in DIGIT.finditer(text):
            if m.start() < done:
                continue
            begin, end = m.span()
            while begin > done and not text[begin - 1].isspace():
                begin -= 1
            while end < len(text) and not text[end].isspace():
                end += 1
            done = end
            if end - begin >= 7:
                while end > begin and text[end - 1] in ".,;:!?)":
                    end -= 1
                out.add((begin, end))
        out.update(m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 9)
    if "=" in text or ":" in text:
        out.update(m.span() for m in PAIR.finditer(text))
    out.update(_emails(text))
    return sorted(x for x in out if x[1] - x[0] >= 4)


def credentials(text: str) -> list[tuple[int, int]]:
    """The values of known credential formats, without quotes, in order."""
    out = []
    for m in CREDENTIAL.finditer(text):
        a, b = m.span("value") if m["value"] else m.span()
        if text[a] in "\"'":
            close = text.find(text[a], a + 1, b)
            a, b = a + 1, close if close > a + 1 else b
        out.append((a, b))
    return out


def features(text: str, begin: int, end: int) -> list[float]:
    span, before = text[begin:end], text[max(0, begin - CONTEXT) : begin].lower()
    n = len(span)
    digits, upper, lower = sum(c.isdigit() for c in span), sum(c.isupper() for c in span), sum(c.islower() for c in span)
    counts = np.bincount(np.frombuffer(span.encode("utf-8", "replace"), np.uint8))
    share = counts[counts > 0] / counts.sum()
    changes = sum(a.isalpha() != b.isalpha() for a, b in zip(span, span[1:]))
    return [
        min(n, 200), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, float(-(share * np.log2(share)).sum()), changes / n,
        span.count("."), span.count("@"), span.count("=") + span.count(":"), span.count(" "), span.count("-"), float(span[0] == "+"), float(span[0].isupper()),
        float(digits >= 13 and luhn("".join(c for c in span if c in "0123456789"))), max(map(len, re.findall("[0-9]+", span)), default=0), max(map(len, re.findall("[^\\W\\d_]+", span)), default=0),
        sum(h in before for h in HINTS), sum(h in span.lower() for h in HINTS), float(begin == 0 or text[begin - 1].isspace()), float(end == len(text) or text[end].isspace()),
    ]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("x", pa.binary()), ("y", pa.int32())])
    for batch in batches:
        x, y = [], []
        for text in column(batch, "text").to_pylist():
            text = text or ""
            sure, secret = {(a, b) for _, a, b in base_spans(text)}, credentials(text)
            starts, ends = [a for a, _ in secret], [b for _, b in secret]
            for a, b in candidates(text):
                k = bisect_left(starts, a)
                covers = k < len(secret) and ends[k] <= b
                # a part of a secret's value is no example of either kind
                if not covers and (a, b) not in sure and (i := bisect_left(ends, b)) < len(secret) and starts[i] <= a:
                    continue
                x.append(np.array(features(text, a, b)).tobytes())
                y.append(int(covers or (a, b) in sure))
        yield rows(schema, x=x, y=y)


class Selector:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        apart = np.arange(len(x)) % 4 == 3
        if all(0 < y[part].sum() < part.sum() for part in (apart, ~apart)):
            self.trees = BoostedTrees().fit(x[~apart], y[~apart]).calibrate(x[apart], y[apart])
            self.least = threshold(self.trees.predict(x[apart]), y[apart])
        else:  # too few of a kind for a part of their own
            self.trees, self.least = BoostedTrees().fit(x, y), 0.5

    def select(self, text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Added spans: those within another come last, then by falling probability; none overlaps a base span or one before it."""
        found = candidates(text)
        if not found:
            return []
        p = self.trees.predict(np.array([features(text, a, b) for a, b in found]))
        chosen, within, end = [i for i in range(len(found)) if p[i] >= self.least], set(), -1
        for i in sorted(chosen, key=lambda i: (found[i][0], -found[i][1])):
            if found[i][1] <= end:
                within.add(i)
            end = max(end, found[i][1])
        taken, out = [(a, b) for _, a, b in spans], []
        for i in sorted(chosen, key=lambda i: (i in within, -round(p[i], 9), found[i][0], -found[i][1])):
            a, b = found[i]
            if all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                out.append((ADDED, a, b))
        return sorted(out, key=lambda s: s[1])


def fit(docs: DataFrame) -> Selector | None:
    """Fitted on what the sample has; None only where no text of it has a candidate."""
    n = docs.count()
    share = min(1.0, FIT_DOCS / max(n, 1))
    some = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < share).select("text")
    some = some.mapInArrow(_labelled, "x binary, y int").orderBy(F.xxhash64("x", "y")).limit(FIT_ROWS)  # the bound of the fit
    found = sorted((bytes(r.x), r.y) for r in some.collect())
    if not found:
        return None
    y = np.array([f[1] for f in found])
    order = np.random.default_rng(7).permutation(len(y))
    return Selector(np.stack([np.frombuffer(f[0]) for f in found])[order], y[order])


def spans_of(text: str, selector: Selector | None) -> list[tuple[str, int, int]]:
    spans = base_spans(text)
    return spans + (selector.select(text, spans) if selector else [])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, selector: Selector | None) -> DataFrame:
    """Per document: counts of the base kinds, base_sha256 and spans."""
    names = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())])
    told = docs.sparkSession.sparkContext.broadcast(selector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("pii")
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                spans = spans_of(text or "", told.value)
                base = [s for s in spans if s[0] != ADDED]
                out["doc_id"].append(doc_id)
                for k, n in zip(KINDS, names):
                    out[n].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
                out["spans"].append(digest(spans))
            yield rows(schema, **out)

    ddl = ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def redact(docs: DataFrame, selector: Selector | None) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; n_chars, where there is one, follows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    told = docs.sparkSession.sparkContext.broadcast(selector)
    schema = to_arrow_schema(docs.schema)

    def clean(text: str | None) -> str | None:
        spans = spans_of(text or "", told.value)
        done, parts = 0, []
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b <= done:
                continue
            if a >= done:
                parts += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join([*parts, text[done:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("pii")
        for batch in batches:
            texts = [clean(t) for t in column(batch, "text").to_pylist()]
            arrays = dict(zip(batch.schema.names, batch.columns)) | {"text": pa.array(texts, schema.field("text").type)}
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([None if t is None else len(t) for t in texts], schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema], schema=schema)

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return find(docs, fit(docs.select("doc_id", "text")))
