"""Language identification with string kernels.

A text is the set of its letter n-grams of the orders 1 to 3 (a blended-spectrum presence kernel): k(x, y) is the
number of shared n-grams over sqrt(|x| |y|). Landmarks (Nystroem) turn it into LANDMARKS features a language, on
which one-versus-rest kernel ridge regression is fitted; texts are scored in batches by matrix products.

The classifier is fitted on a bounded sample: PER_LANGUAGE labelled rows of each language. All texts are scored whole.

Defined results: null text or one without a letter gives `und` with score 0; without labelled rows every text does; of
languages with one score the first by name is taken; rows that repeat a doc_id, a null one too, are answered row by
row; other columns are not read, and kept by `keep_known`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import column, crc_of_id, rows

PER_LANGUAGE = 400  # labelled rows of a language that the classifier is fitted on, at most
LANDMARKS = 24  # of these, landmarks
RIDGE = 1e-2
SHARPNESS = 4.0  # of the softmax over the one-versus-rest scores
SYMBOLS = 64  # letter classes: 0 is anything but a letter
SIZES = (SYMBOLS, SYMBOLS**2, SYMBOLS**3)
TOTAL = sum(SIZES)
UNKNOWN = "und"
BATCH = 256

_TABLE: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """A class for each code point: a to z have their own, other letters share the rest by a multiplicative hash."""
    if not _TABLE:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        code = np.arange(0x110000, dtype=np.uint64)
        table = np.where(letter, 27 + (code * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - 27), 0)
        table[97:123] = np.arange(1, 27)
        _TABLE.append(table.astype(np.uint8))
    return _TABLE[0]


def grams(text: str | None, flags: np.ndarray) -> bool:
    """Sets the flags of the n-grams that the text has; False if it has no letter."""
    flags[:] = False
    c = _classes()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")]
    if not c.any():
        return False
    c = np.concatenate([[0], c, [0]]).astype(np.int32)
    flags[c] = True
    flags[SIZES[0] + c[:-1] * SYMBOLS + c[1:]] = True
    flags[SIZES[0] + SIZES[1] + (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]] = True
    flags[[0, SIZES[0], SIZES[0] + SIZES[1]]] = False
    return True


def _sample_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, flags = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("codes", pa.binary())]), np.zeros(TOTAL, bool)
    for batch in batches:
        out = {"lang": [], "key": [], "codes": []}
        for lang, key, text in zip(*(column(batch, k).to_pylist() for k in ("lang", "key", "text"))):
            if grams(text, flags):
                out["lang"].append(lang)
                out["key"].append(key)
                out["codes"].append(np.flatnonzero(flags).astype("<u4").tobytes())
        yield rows(schema, **out)


class KernelRidge:
    def fit(self, sets: list[np.ndarray], labels: list[str]) -> KernelRidge:
        self.names = sorted(set(labels))
        seen: dict[str, int] = {}
        chosen = []
        for i, name in enumerate(labels):
            seen[name] = seen.get(name, 0) + 1
            if seen[name] <= LANDMARKS:
                chosen.append(i)
        self.vocabulary = np.unique(np.concatenate([sets[i] for i in chosen])).astype(np.int64)
        self.weights = np.zeros((len(self.vocabulary), len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.weights[np.searchsorted(self.vocabulary, sets[i]), j] = len(sets[i]) ** -0.5
        own, flags = np.empty((len(sets), len(chosen))), np.zeros(TOTAL, bool)
        for a in range(0, len(sets), BATCH):
            part = sets[a : a + BATCH]
            rows_, sizes = np.zeros((len(part), len(self.vocabulary)), np.float32), np.array([len(s) for s in part])
            for r, s in enumerate(part):
                flags[:] = False
                flags[s] = True
                rows_[r] = flags[self.vocabulary]
            own[a : a + BATCH] = self.kernel(rows_, sizes)
        value, vector = np.linalg.eigh(own[chosen])
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = own @ root
        target = np.where(np.array(labels)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        balance = 1 / np.array([labels.count(x) for x in labels])[:, None]
        self.bias = 1.0
        phi = np.hstack([phi, np.full((len(phi), 1), self.bias)])
        solved = np.linalg.solve(phi.T @ (phi * balance) + RIDGE * np.eye(phi.shape[1]), phi.T @ (target * balance))
        self.project, self.offset = (root @ solved[:-1]).astype(np.float32), solved[-1] * self.bias
        return self

    def kernel(self, present: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return present @ self.weights / np.sqrt(np.maximum(sizes, 1))[:, None]

    def scores(self, present: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
        raw = SHARPNESS * (self.kernel(present, sizes) @ self.project + self.offset)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return [self.names[k] for k in p.argmax(axis=1)], p.max(axis=1).astype(np.float64)


def fit(docs: DataFrame, learn: Column) -> KernelRidge | None:
    """docs: doc_id, text, lang; learn: which rows the classifier may see."""
    rows_ = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows_.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # texts that surely hold the sample: those under a hash bound of twice the share that is wanted
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * PER_LANGUAGE + 50) / n)))])
    key = F.xxhash64("doc_id", "text")
    near = rows_.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) <= share[F.col("lang")])
    sets = near.select("lang", key.alias("key"), "text").mapInArrow(_sample_sets, "lang string, key long, codes binary")
    sets = sets.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key", "codes"))).where(f"r <= {PER_LANGUAGE}")
    found = sorted((r["lang"], r["r"], r["codes"]) for r in sets.select("lang", "r", "codes").collect())
    return KernelRidge().fit([np.frombuffer(c, "<u4") for _, _, c in found], [k for k, _, _ in found]) if found else None


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("language_id")
        ridge: KernelRidge | None = model.value
        flags = np.zeros(TOTAL, bool)
        present = np.zeros((BATCH, len(ridge.vocabulary)), np.float32) if ridge else None
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a in range(0, len(ids), BATCH):
                part = texts[a : a + BATCH].to_pylist()
                names, scores, sizes, asked = [UNKNOWN] * len(part), [0.0] * len(part), [], []
                for i, text in enumerate(part):
                    if ridge and grams(text, flags):
                        present[len(asked)] = flags[ridge.vocabulary]
                        sizes.append(np.count_nonzero(flags))
                        asked.append(i)
                if asked:
                    for i, name, score in zip(asked, *ridge.scores(present[: len(asked)], np.array(sizes))):
                        names[i], scores[i] = name, float(score)
                yield rows(schema, doc_id=ids[a : a + BATCH], lang_pred=names, score=scores)

    return run


def predict(docs: DataFrame, model: KernelRidge | None) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(told), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: KernelRidge | None, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with at least this score."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, score = to_arrow_schema(docs.schema), _predict(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("language_id")
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), column(batch, "text")], names=["doc_id", "text"])
            keep = np.concatenate([np.array([x != UNKNOWN for x in column(b, "lang_pred").to_pylist()]) & (column(b, "score").to_numpy() >= least) for b in score(iter([asked]))] or [np.empty(0, bool)])
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, fold: int = 2) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) modulo 4 is not fold, answers for all."""
    held_out = crc_of_id() % 4 == fold
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
