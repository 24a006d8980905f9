"""Benchmark decontamination by latent semantic retrieval.

1. The terms of the benchmark passages are counted over the whole corpus (for idf); very common ones carry no weight.
2. A distributed randomised SVD of the TF-IDF matrix of the benchmark passages gives the latent space.
3. Every document is cut into overlapping windows; a window goes to the space and every passage whose energy it
   covers well enough by cosine becomes a candidate.
4. Candidates are checked by the longest common subsequence of words with the passage, and with its last quarter, the
   answer, which settles paraphrases.
5. Exact copies need no candidate: each place of a passage's rarest word is compared with the passage word by word.

The corpus is read once for the counts of all passages, and once for each PASS blocks of BLOCK passages, whose latent
spaces are broadcast together; so what a task holds has a bound. All windows of all documents are searched for every block.

Defined results: null, empty or word-free texts and passages match nothing; a passage under MIN_WORDS words must
occur word by word; repeated rows are answered row by row, repeated passages once; a null doc_id is allowed, and so is
a null item_id; other columns are kept by `clean` and not read by `leaks`; without documents or passages there are no
leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Words, chunks, column, rows

RANK = 512  # dimensions of the latent space, at most
BLOCK = RANK  # passages of one block, at most; more would lose passages whose energy lies outside the space
PASS = 4  # blocks that are searched for in one reading of the corpus
STRIDE = 16  # words between windows
CELLS = 4096  # strides that are projected at a time
COMMON = 1e-3  # terms with a larger share of the corpus' words have no weight
ENERGY = 0.4  # of a passage's energy that a candidate window covers
COSINE = 0.3  # between a candidate window's weighted terms and the passage
LCS = 0.6  # of a passage's words, in order: a leak
LCS_ANSWER, ANSWER = 0.45, 0.75  # or this much of the passage and of its answer
MIN_WORDS = 8

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(9, 14), *range(32, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def words_of(texts: list[bytes]) -> Words:
    return Words(texts, space=_PUNCTUATION)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = places.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def place(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted terms, -1 for other words."""
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


class Passages:
    """One block of passages with their terms."""

    def __init__(self, items: list[tuple[int, str]]):
        found = words_of([(t or "").encode() for _, t in items])
        h = found.hashes()
        spans = list(zip(found.first[:-1].tolist(), found.first[1:].tolist()))
        self.ids = [i for (i, _), (a, b) in zip(items, spans) if b > a]
        self.words = [h[a:b] for a, b in spans if b > a]
        self.terms = np.unique(np.concatenate(self.words)) if self.words else np.empty(0, np.uint64)
        # a window of so many strides holds the passage wherever it begins
        self.strides = np.array([-(-len(w) // STRIDE) + 1 for w in self.words])

    def place(self, h: np.ndarray) -> np.ndarray:
        return place(self.terms, h)


def term_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the sorted terms occurs in the corpus, and the words of the corpus."""
    told = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("decontaminate")
        counts, total = np.zeros(len(told.value), np.int64), 0
        for batch in batches:
            for _, texts in chunks(batch):
                h = words_of(texts).hashes()
                at = place(told.value, h)
                counts += np.bincount(at[at >= 0], minlength=len(counts))
                total += len(h)
        hit = np.flatnonzero(counts)
        yield rows(schema, term=np.append(hit, -1), n=np.append(counts[hit], total))

    counts, total = np.zeros(len(terms)), 0
    for term, n in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        if term < 0:
            total = n
        else:
            counts[term] = n
    return counts, total


def randomised_svd(spark, weights: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates of the rows, basis: width x rank) of a sparse matrix whose rows are spread over the executors.

    The range finder Y = A Omega and the small factor B = Q' A are computed from the rows where they are; the driver
    orthogonalises Y and factors B, both bounded by BLOCK rows and RANK columns.
    """
    n = len(weights)
    rank = min(rank, n, width)
    sketch = min(rank + 16, width)
    frame = spark.createDataFrame([(i, at.astype(np.int32).tolist(), w.tolist()) for i, (at, w) in enumerate(weights)], "i int, at array<int>, w array<double>").repartition(max(1, n // 64))

    def omega(at: np.ndarray) -> np.ndarray:
        key = shared.mix((at.astype(np.uint64)[:, None] * np.uint64(sketch) + np.arange(sketch, dtype=np.uint64)[None, :]) + np.uint64(seed << 32))
        return 1.0 - 2.0 * (key >> np.uint64(63)).astype(np.float64)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "y": [(np.asarray(w) @ omega(np.asarray(at))).tolist() if len(at) else [0.0] * sketch for at, w in zip(pdf["at"], pdf["w"])]})

    y = np.zeros((n, sketch))
    for i, row in frame.mapInPandas(project, "i int, y array<double>").collect():
        y[i] = row
    q, _ = np.linalg.qr(y)
    told = spark.sparkContext.broadcast(q)

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, at, w in zip(pdf["i"], pdf["at"], pdf["w"]):
                for j, x in zip(at, w):
                    total[j] = total.get(j, 0) + told.value[i] * x
        yield pd.DataFrame({"j": pd.Series(list(total), dtype="int32"), "b": pd.Series([v.tolist() for v in total.values()], dtype=object)})

    b = np.zeros((q.shape[1], width))
    for j, col in frame.mapInPandas(factor, "j int, b array<double>").toLocalIterator():
        b[:, j] += col
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    return (q @ u * s)[:, :rank], vt[:rank].T


class Searcher:
    def __init__(self, passages: Passages, idf: np.ndarray, coordinates: np.ndarray, basis: np.ndarray):
        self.passages, self.idf = passages, idf
        self.words = [w.tolist() for w in passages.words]
        energy = (coordinates**2).sum(axis=1)
        order = np.argsort(passages.strides, kind="stable")
        #: the passages with energy, shortest window first, and their coordinates
        self.items = order[energy[order] > 0]
        self.strides, self.energy = passages.strides[self.items], energy[self.items]
        self.coordinates = np.ascontiguousarray(coordinates[self.items].astype(np.float32).T)
        self.lifted = (basis * idf[:, None]).astype(np.float32)  # a term's share in the latent space
        #: term -> (passage, its offset there) of the passages whose rarest word it is
        self.rarest: dict[int, list[tuple[int, int]]] = {}
        for item, w in enumerate(passages.words):
            at = passages.place(w)
            k = int(np.argmax(idf[at]))
            self.rarest.setdefault(int(at[k]), []).append((item, k))
        self.is_rarest = np.zeros(len(idf), bool)
        self.is_rarest[list(self.rarest)] = True

    def search(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, passage) -> the best (lcs, answer, cosine) of its verified windows.

        A window's dot product with a passage is the sum of those of its cells, so each cell is projected once.
        """
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        at = self.passages.place(h)
        hit = np.flatnonzero((at >= 0) & (self.idf[at] > 0))
        if not len(hit) or not len(self.items):
            return best
        # cells of STRIDE words, counted within each text; the cells of all texts lie side by side
        cells = -(-np.diff(first) // STRIDE)
        begin = np.concatenate([[0], np.cumsum(cells)])
        doc = np.searchsorted(first, hit, side="right") - 1
        cell = begin[doc] + (hit - first[doc]) // STRIDE
        edge = np.searchsorted(cell, np.arange(begin[-1] + 1))
        owner = np.repeat(np.arange(len(cells)), cells)
        tail, known = int(self.strides[-1]) - 1, {}
        for a in range(0, int(begin[-1]), CELLS):
            b = min(a + CELLS, int(begin[-1]))
            for c, size, j, dot in self._near(at[hit], edge, begin, owner, a, b, min(b + tail, int(begin[-1]))):
                d, item = int(owner[c]), int(self.items[j])
                last = min(c + size, int(begin[d + 1]))
                lo, hi = int(first[d]) + (c - int(begin[d])) * STRIDE, min(int(first[d + 1]), int(first[d]) + (last - int(begin[d])) * STRIDE)
                if (c, last) not in known:
                    terms, tf = np.unique(at[hit[edge[c] : edge[last]]], return_counts=True)
                    known[c, last] = float(np.sqrt(((tf * self.idf[terms]) ** 2).sum()))
                norm = known[c, last] * float(np.sqrt(self.energy[j]))
                if dot < COSINE * norm - 1e-3:
                    continue
                found = self.verify(item, h[lo:hi].tolist())
                if found:
                    score = (*found, dot / norm)
                    best[d, item] = max(best.get((d, item), score), score)
            known.clear()
        for d, item, start in self._exact(h, first, at, hit):
            if (d, item) not in best:
                lo = int(first[d]) + (start - int(first[d])) // STRIDE * STRIDE
                window = at[lo : min(lo + int(self.passages.strides[item]) * STRIDE, int(first[d + 1]))]
                best[d, item] = (1.0, 1.0, self._cosine(item, window[window >= 0]))
        return best

    def _exact(self, h: np.ndarray, first: np.ndarray, at: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, passage, place of its first word) of the word-by-word copies."""
        places = hit[self.is_rarest[at[hit]]]
        places = places[np.argsort(at[places], kind="stable")]
        terms, edge = np.unique(at[places], return_index=True)
        for term, own in zip(terms.tolist(), np.split(places, edge[1:])):
            text = np.searchsorted(first, own, side="right") - 1
            for item, offset in self.rarest[term]:
                words = self.passages.words[item]
                start = own - offset
                fits = (start >= first[text]) & (start + len(words) <= first[text + 1])
                start, inside = start[fits], text[fits]
                for k, w in enumerate(words):
                    if not len(start):
                        break
                    same = h[start + k] == w
                    start, inside = start[same], inside[same]
                yield from zip(inside.tolist(), [item] * len(start), start.tolist())

    def _cosine(self, item: int, terms: np.ndarray) -> float:
        window, own = (np.bincount(t, minlength=len(self.idf)) * self.idf for t in (terms, self.passages.place(self.passages.words[item])))
        return float(window @ own / np.sqrt((window @ window) * (own @ own)))

    def _near(self, terms: np.ndarray, edge: np.ndarray, begin: np.ndarray, owner: np.ndarray, a: int, b: int, end: int) -> Iterator[tuple[int, int, int, float]]:
        """(first cell, cells, place in items, dot product) of the windows from a to b that cover enough of a passage's energy."""
        part = terms[edge[a] : edge[end]]
        if not len(part):
            return
        per = np.diff(edge[a : end + 1])
        filled = np.flatnonzero(per)
        dots = np.zeros((end - a, len(self.items)), np.float32)
        dots[filled] = np.add.reduceat(self.lifted[part], edge[a + filled] - edge[a], axis=0) @ self.coordinates
        mass = np.concatenate([[0.0], np.cumsum(np.add.reduceat(np.append(self.idf[part] ** 2, 0.0), np.minimum(edge[a:end] - edge[a], len(part))) * (per > 0))])
        at = np.arange(a, b)
        window, own = dots[: b - a].copy(), owner[a:b]
        for size in range(1, int(self.strides[-1]) + 1):
            if size > 1:  # one cell more, of the same text
                n = max(0, min(b - a, end - a - size + 1))
                more = owner[a + size - 1 : a + size - 1 + n] == own[:n]
                low = np.searchsorted(self.strides, size)
                window[:n, low:] += dots[size - 1 : size - 1 + n, low:] * more[:, None]
            lo, hi = np.searchsorted(self.strides, [size, size + 1])
            if lo == hi:
                continue
            stop = begin[own + 1]
            usable = (at == begin[own]) | (at + size <= stop)
            least = mass[np.minimum(at + size, stop) - a] - mass[at - a]  # at most the squared norm
            energy = self.energy[lo:hi]
            good = usable[:, None] & (window[:, lo:hi] >= ENERGY * energy - 1e-3)
            for k, j in zip(*(x.tolist() for x in np.nonzero(good))):
                dot = float(window[k, lo + j])
                if dot >= COSINE * np.sqrt(least[k] * energy[j]) - 1e-3:
                    yield a + k, size, int(lo + j), dot

    def verify(self, item: int, window: list[int]) -> tuple[float, float] | None:
        own = self.words[item]
        share = lcs(own, window) / len(own)
        if len(own) < MIN_WORDS:
            return (1.0, 1.0) if any(window[i : i + len(own)] == own for i in range(len(window) - len(own) + 1)) else None
        if share < LCS_ANSWER:
            return None
        tail = own[-max(4, len(own) // 4) :]
        answer = lcs(tail, window) / len(tail)
        return (share, answer) if share >= LCS or answer >= ANSWER else None


def prepare(spark, passages: Passages, counts: np.ndarray, total: int) -> Searcher:
    """counts: of the passages' terms in the corpus."""
    idf = np.log((total + 1.0) / (counts + 1.0))
    common = counts > max(COMMON * total, 50)
    weights = []
    for w in passages.words:
        at, tf = np.unique(passages.place(w), return_counts=True)
        rare = ~common[at]
        weights.append((at, tf, rare.sum()))
    lifted = np.zeros(len(idf), bool)
    for at, _, rare in weights:
        lifted[at] |= rare < 5  # a passage of common words keeps them all
    idf = np.where(common & ~lifted, 0.0, np.maximum(idf, 1e-3))
    rows_ = [(at[idf[at] > 0], (tf * idf[at])[idf[at] > 0]) for at, tf, _ in weights]
    coordinates, basis = randomised_svd(spark, rows_, len(passages.terms), RANK)
    return Searcher(passages, idf, coordinates, basis)


def blocks(benchmark: DataFrame, item_id: str = "item_id") -> Iterator[list[tuple[int | None, str]]]:
    rows_ = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    n = max(1, -(-rows_.count() // BLOCK))
    for k in range(n):
        found = rows_.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        found = sorted(((r.item_id, r.text) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for a in range(0, len(found), BLOCK):  # a hash bucket may hold more than its share
            yield found[a : a + BLOCK]


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Searcher]]:
    """The searchers of all passages, those of one reading of the corpus together."""
    parts = [p for p in map(Passages, blocks(benchmark)) if p.ids]
    if not parts:
        return
    terms = np.unique(np.concatenate([p.terms for p in parts]))
    counts, total = term_counts(docs, terms)
    for a in range(0, len(parts), PASS):
        yield [prepare(docs.sparkSession, p, counts[place(terms, p.terms)], total) for p in parts[a : a + PASS]]


def found_in(told: list[Searcher], texts: list[bytes]) -> Iterator[tuple[int, int | None, tuple[float, float, float]]]:
    """(text, item_id, (lcs, answer, cosine)) of the passages that the texts hold."""
    words = words_of(texts)
    h = words.hashes()
    for searcher in told:
        for (d, i), score in sorted(searcher.search(h, words.first).items()):
            yield d, searcher.passages.ids[i], score


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs_ratio", pa.float64()), ("answer_ratio", pa.float64()), ("cosine", pa.float64())])


DDL = "doc_id long, item_id long, lcs_ratio double, answer_ratio double, cosine double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and passage that it holds: doc_id, item_id, lcs_ratio, answer_ratio, cosine."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], DDL)
    for some in searchers(docs, benchmark):
        told = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            shared.enter("decontaminate")
            for batch in batches:
                ids = column(batch, "doc_id").to_pylist()
                for piece, texts in chunks(batch):
                    found = [(ids[piece.start + d], item, *score) for d, item, score in found_in(told.value, texts)]
                    if found:
                        yield rows(SCHEMA, **{f.name: [o[k] for o in found] for k, f in enumerate(SCHEMA)})

        out = out.unionByName(docs.mapInArrow(run, DDL))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of the benchmark."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)
    out = docs
    for some in searchers(docs.select("text"), benchmark):
        told = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            shared.enter("decontaminate")
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for piece, texts in chunks(batch):
                    for d, _, _ in found_in(told.value, texts):
                        keep[piece.start + d] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, schema=schema)

        out = out.mapInArrow(run, docs.schema)
    return out
