"""LM scoring with Brown's class-based bigrams.

Exchange clustering assigns the CLUSTERED most frequent words to CLASSES classes so that the likelihood of the class
bigrams grows; each further word that occurs LEAST times, however many there are, goes to the class where its neighbours'
classes gain most, and words too rare for that belong to a class by their shape. A text's score is the sum over its tokens of
log10 P(class | class before) + log10 P(word | class), with smoothed transitions and emissions; the end of a text is a
token of a class of its own, which also stands before the first word.

Counts are exact over all training texts. Words travel as 64-bit hashes and get their classes in a shuffle by hash bucket.
Frequent words, whose number MAX_FREQUENT bounds, are known everywhere; tokens of rarer words meet their counts and
classes in their buckets, which go back to the block of texts that they came from. Transitions are counted and scored
over the blocks' lines of classes, one byte a token, so MAX_FREQUENT changes no result. No vocabulary is broadcast whole
or collected.

Defined results: null and empty texts are the end token alone; rows that repeat a doc_id are scored row by row; a
null doc_id is scored but never learned from; an empty training set leaves every token unknown; of words that occur
equally often the one of the lesser hash ranks first; columns besides doc_id and text are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Scratch, Words, chunks, column, crc_of_id, rows, split_by_bucket

MAX_FREQUENT = 1 << 20  # bound of the words that are known everywhere; the others meet their classes in a shuffle
CLUSTERED = 1000  # words that are exchanged between classes; the others are placed once
LEAST = 2  # occurrences of a word that has a class of its neighbours; a word that occurs once stands for those that never did
CLASSES = 64  # with those of shapes and of the end at most 128, as sides and classes travel as bytes
SHAPES = 6
PASSES = 3  # of exchange clustering over all its words
FLUSH = 1 << 21  # tokens that a task holds before it writes them to its buckets
NONE = 255  # class of a word that belongs to one by its shape
PLACE = 1 << 14  # words that are placed at a time

_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouy")] = True


def shapes(words: Words) -> np.ndarray:
    """Class of a rare word: three lengths, and whether it ends in a vowel."""
    size = words.end - words.start
    return (np.digitize(size, [5, 9]) * 2 + _VOWEL[words.buf[words.end - 1]]).astype(np.uint8) if len(size) else np.empty(0, np.uint8)


def _count_words(bits: int):
    schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("shapes", pa.binary())])

    def flush(h: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
        word, at, count = np.unique(np.concatenate(h), return_index=True, return_counts=True)
        shape = np.concatenate(s)[at]
        out: dict[str, list] = {f.name: [] for f in schema}
        for b, *parts in split_by_bucket((word >> np.uint64(64 - bits)).astype(np.int64), word, count.astype("<u4"), shape):
            for name, value in zip(out, (b, *(p.tobytes() for p in parts))):
                out[name].append(value)
        return rows(schema, **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, s, size = [], [], 0
        for batch in batches:
            for _, texts in chunks(batch):
                words = Words(texts)
                h.append(words.hashes())
                s.append(shapes(words))
                size += len(h[-1])
                if size >= FLUSH:
                    yield flush(h, s)
                    h, s, size = [], [], 0
        if size:
            yield flush(h, s)

    return run


def _sum_words(pdf: pd.DataFrame) -> pd.DataFrame:
    word = np.concatenate([np.frombuffer(b, "<u8") for b in pdf["words"]])
    count = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["counts"]]).astype(np.int64)
    shape = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["shapes"]])
    word, at, inverse = np.unique(word, return_index=True, return_inverse=True)
    total = np.bincount(inverse, count).astype("<i8")
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].to_numpy(), "words": [word.tobytes()], "counts": [total.tobytes()], "shapes": [shape[at].tobytes()], "n": [int(total.sum())], "v": [len(word)]})


def _frequent(least: int, first: int | None = None):
    """Words of at least so many occurrences; of each bucket only the first by rank, where first is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, c, s in zip(pdf["words"], pdf["counts"], pdf["shapes"]):
                w, c, s = np.frombuffer(w, "<i8"), np.frombuffer(c, "<i8"), np.frombuffer(s, np.uint8)
                keep = np.flatnonzero(c >= least)
                if first is not None:
                    keep = keep[np.lexsort((w[keep], -c[keep]))[:first]]
                yield pd.DataFrame({"word": w[keep], "n": c[keep], "shape": s[keep].astype(np.int32)})

    return run


class Frequent:
    """Words known everywhere, with their counts and symbols: clustered words by rank, then shapes, the end, and the classes of placed words."""

    def __init__(self, word: np.ndarray, n: np.ndarray, shape: np.ndarray):
        rank = np.lexsort((word, -n))[:CLUSTERED]
        self.clustered = len(rank)
        symbol = self.clustered + shape.astype(np.int64)
        symbol[rank] = np.arange(self.clustered)
        order = np.argsort(word.view(np.uint64))
        self.word, self.n, self.symbol, self.shape = word.view(np.uint64)[order], n[order], symbol[order], shape[order]
        self.own = np.zeros(self.clustered, np.int64)
        self.own[:] = n[rank]
        self.end = self.clustered + SHAPES
        self.classes = max(1, min(CLASSES, self.clustered))

    def place(self, at: np.ndarray, classes: np.ndarray) -> Frequent:
        """These words with those at the given places in the classes."""
        out = copy(self)
        out.symbol = self.symbol.copy()
        out.symbol[at] = self.end + 1 + classes
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there is one)"""
        if not len(self.word):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return at, self.word[at] == h

    def symbols(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols with an end after each text, place in that of each word, place here, whether known here)"""
        at, known = self.find(h)
        symbol = self.clustered + shapes(words).astype(np.int64)
        if len(self.word):
            symbol = np.where(known, self.symbol[at], symbol)
        text = np.searchsorted(words.first, np.arange(len(h)), side="right") - 1
        place = np.arange(len(h)) + text
        line = np.full(len(h) + len(words.first) - 1, self.end)
        line[place] = symbol
        return line, place, at, known


def _pairs(total: np.ndarray) -> pa.RecordBatch:
    u = np.flatnonzero(total.any(axis=1))
    v = [np.flatnonzero(total[i]) for i in u]
    schema = pa.schema([("u", pa.int32()), ("v", pa.binary()), ("n", pa.binary())])
    return rows(schema, u=u, v=[k.astype("<u2").tobytes() for k in v], n=[total[i][k].astype("<u4").tobytes() for i, k in zip(u, v)])


def _count_pairs(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = told.value
        size = frequent.end + 1
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, texts in chunks(batch):
                words = Words(texts)
                line = frequent.symbols(words, words.hashes())[0]
                before = np.concatenate([[frequent.end], line[:-1]])
                total += np.bincount(before * size + line, minlength=size * size)
        yield _pairs(total.reshape(size, size))

    return run


def _sum_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.concatenate([np.frombuffer(b, "<u2") for b in pdf["v"]])
    n = np.bincount(v, np.concatenate([np.frombuffer(b, "<u4") for b in pdf["n"]])).astype("<i8")
    return pd.DataFrame({"u": pdf["u"].iloc[:1].to_numpy(), "n": [n.tobytes()]})


def gather_pairs(counted: DataFrame, size: int) -> np.ndarray:
    pairs = np.zeros((size, size), np.int64)
    for u, row in counted.groupBy("u").applyInPandas(_sum_pairs, "u int, n binary").toLocalIterator():
        row = np.frombuffer(row, "<i8")
        pairs[u, : len(row)] = row
    return pairs


NEAR = "bucket int, words binary, sizes binary, sides binary, n binary, many binary"  # n: a byte, MANY where many has the number
MANY = 255


def _neighbours(told, bits: int):
    """Per bucket of words that aren't clustered: how often each has each class after it and before it."""
    schema = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name in ("words", "sizes", "sides", "n", "many"))])

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> pa.RecordBatch:
        after, before = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        word, row = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        key, n = np.unique(np.concatenate([row * width + after, row * width + before]), return_counts=True)
        row, side = np.divmod(key, width)
        out: dict[str, list] = {f.name: [] for f in schema}
        for b, r, sides, k in split_by_bucket((word >> np.uint64(64 - bits)).astype(np.int64)[row], row, side.astype(np.uint8), n.astype("<u4")):
            first = np.flatnonzero(np.diff(r, prepend=-1))
            sizes = np.diff(first, append=len(r)).astype("<u2")
            for name, value in zip(out, (b, *(p.tobytes() for p in (word[r[first]], sizes, sides, np.minimum(k, MANY).astype(np.uint8), k[k >= MANY])))):
                out[name].append(value)
        return rows(schema, **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, of, m = told.value
        held, size = [], 0
        for batch in batches:
            for _, texts in chunks(batch):
                words = Words(texts)
                h = words.hashes()
                line, place, _, _ = frequent.symbols(words, h)
                if not len(h):
                    continue
                own = line[place] >= frequent.clustered
                place, classes = place[own], of[line]
                held.append((h[own], classes[place + 1], len(m) + np.where(place > 0, classes[place - 1], of[frequent.end])))
                size += len(place)
                if size >= FLUSH:
                    yield flush(held, 2 * len(m))
                    held, size = [], 0
        if size:
            yield flush(held, 2 * len(m))

    return run


PLACED = "bucket int, words binary, counts binary, classes binary, own array<double>, shape_n array<long>, shape_v array<long>"


def _place(told):
    """Of one bucket: the class of each word, and what the classes hold of it but for clustered words."""

    def run(key, near: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        frequent, _, m = told.value
        word, count, shape = (np.frombuffer(counts[name].iloc[0], kind) for name, kind in (("words", "<u8"), ("counts", "<i8"), ("shapes", np.uint8)))
        classes, width = np.full(len(word), NONE, np.uint8), 2 * len(m)
        if len(near):
            at = np.concatenate([np.repeat(np.searchsorted(word, np.frombuffer(w, "<u8")), np.frombuffer(k, "<u2")) for w, k in zip(near["words"], near["sizes"])])
            side, n, many = (np.concatenate([np.frombuffer(b, kind) for b in near[name]]) for name, kind in (("sides", np.uint8), ("n", np.uint8), ("many", "<u4")))
            n = n.astype(np.int64)
            n[n == MANY] = many
            keep = count[at] >= LEAST
            entry, inverse = np.unique(at[keep] * width + side[keep], return_inverse=True)
            n = np.bincount(inverse, n[keep], len(entry))
            at, side = np.divmod(entry, width)
            own, row = np.unique(at, return_inverse=True)
            edge = np.searchsorted(row, np.arange(0, len(own) + PLACE, PLACE))
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                if b > a:
                    classes[own[k * PLACE : (k + 1) * PLACE]] = gains(m, frequent.classes, row[a:b] - k * PLACE, side[a:b], n[a:b]).argmax(axis=1)
        placed, rest = classes != NONE, count < LEAST
        shape_n, shape_v = (np.bincount(shape[rest], w, SHAPES).astype(np.int64).tolist() for w in (count[rest], np.ones(rest.sum())))
        own = np.bincount(classes[placed], count[placed] + 0.5, frequent.classes).tolist()
        return pd.DataFrame({"bucket": counts["bucket"].iloc[:1].to_numpy(), "words": [word.tobytes()], "counts": [count.tobytes()], "classes": [classes.tobytes()], "own": [own], "shape_n": [shape_n], "shape_v": [shape_v]})

    return run


def _classes(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, c, k in zip(pdf["words"], pdf["counts"], pdf["classes"]):
                k = np.frombuffer(k, np.uint8)
                keep = (k != NONE) & (np.frombuffer(c, "<i8") >= least)
                yield pd.DataFrame({"word": np.frombuffer(w, "<i8")[keep], "class": k[keep].astype(np.int32)})

    return run


def gains(m: np.ndarray, classes: int, row: np.ndarray, side: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Likelihood gain of each word (rows, ascending) in each class; side: the class after it, or the classes' number and that before it."""
    both = np.concatenate([m[:classes].T, m[:, :classes]])
    alone = _xlogx(both)
    out = np.zeros((row[-1] + 1, classes))
    for a in range(0, len(row), 1 << 15):
        k = slice(a, a + (1 << 15))
        first = np.flatnonzero(np.diff(row[k], prepend=-1))
        out[row[k][first]] += np.add.reduceat(_xlogx(both[side[k]] + n[k, None]) - alone[side[k]], first)
    total = np.bincount(row, n * (side < len(m)))[:, None]
    for had in (m.sum(axis=1)[:classes], m.sum(axis=0)[:classes]):
        out -= _xlogx(had + total) - _xlogx(had)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, clustered: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol; symbols from clustered on have classes of their own that no word may join."""
    symbols = len(pairs)
    classes = max(1, min(classes, clustered))
    of = np.concatenate([np.arange(clustered) % classes, classes + np.arange(symbols - clustered)]).astype(np.int64)
    total = classes + symbols - clustered
    pairs = pairs.astype(np.float64)
    m = np.zeros((total, total))
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    k = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for w in range(clustered):
            right, left, own = np.bincount(of, pairs[w], total), np.bincount(of, pairs[:, w], total), pairs[w, w]
            old = of[w]
            right[old] -= own
            left[old] -= own
            m[old] -= right
            m[:, old] -= left
            m[old, old] -= own
            out, into = m.sum(axis=1)[:classes], m.sum(axis=0)[:classes]
            a, b = m[:classes], m[:, :classes].T
            gain = (_xlogx(a + right) - _xlogx(a)).sum(axis=1) + (_xlogx(b + left) - _xlogx(b)).sum(axis=1)
            d = m[k, k]
            gain += _xlogx(d + right[:classes] + left[:classes] + own) - _xlogx(d) - (_xlogx(d + right[:classes]) - _xlogx(d)) - (_xlogx(d + left[:classes]) - _xlogx(d))
            gain -= _xlogx(out + right.sum() + own) - _xlogx(out) + _xlogx(into + left.sum() + own) - _xlogx(into)
            new = int(np.argmax(np.where(k == old, gain + 1e-9, gain)))
            m[new] += right
            m[:, new] += left
            m[new, new] += own
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of


class ClassModel:
    def __init__(self, frequent: Frequent, of: np.ndarray, placed: np.ndarray, texts: int, n: int, v: int, shape_n: np.ndarray, shape_v: np.ndarray):
        self.frequent = frequent
        self.of = np.concatenate([of, np.arange(frequent.classes)])
        self.total = int(self.of.max()) + 1
        own = np.bincount(self.of[: frequent.clustered], frequent.own, frequent.classes) + placed
        # a clustered word's share of its class; of other words the part without their count. Shapes have only words of no class
        self.emit = np.concatenate([
            np.log10(np.maximum(frequent.own, 1) / np.maximum(own[self.of[: frequent.clustered]], 1)), -np.log10(np.array(shape_n, float) + 0.5 * (np.array(shape_v) + 1)), [0.0],
            -np.log10(np.maximum(own, 1)),
        ])
        self.by_class = np.concatenate([self.emit[frequent.end + 1 :], self.emit[frequent.clustered : frequent.end + 1]])
        self.log_count = np.log10(frequent.n + 0.5)
        self.texts, self.n = texts, n
        self.log_total = np.log10(n + 0.5 * (v + 1))

    def learn(self, m: np.ndarray) -> None:
        """Transitions from the counts of class pairs."""
        alone = (m.sum(axis=0) + 0.5) / (m.sum() + 0.5 * self.total)
        self.step = np.log10((m + self.total * alone[None, :]) / (m.sum(axis=1, keepdims=True) + self.total))


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
BLOCK = "ids binary, flags binary, sizes binary, line binary, seen binary, log_counts binary, emits binary"
LINES = f"part long, block int, {BLOCK}, bucket int, words binary, places binary"
MET = "part long, block int, places binary, n binary, classes binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
HELD_OUT, LEARN, NO_ID = 1, 2, 4  # flags of a text


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in columns.split(", ")])


def _lines(told, bits: int):
    """Blocks of texts: a row with the class of each token and the sums over known words, then the words to be met by bucket."""
    schema = _schema(LINES)

    def flush(part: int, block: int, texts: list[tuple], far: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = {c.split()[0]: [np.concatenate([x[k] for x in texts]).tobytes()] for k, c in enumerate(BLOCK.split(", "))}
        yield rows(schema, part=[part], block=[block], **columns)
        word, place = (np.concatenate([x[k] for x in far]) for k in (0, 1))
        out: dict[str, list] = {"bucket": [], "words": [], "places": []}
        for b, w, p in split_by_bucket((word >> np.uint64(64 - bits)).astype(np.int64), word, place.astype("<u4")):
            for name, value in zip(out, (b, w.tobytes(), p.tobytes())):
                out[name].append(value)
        if len(word):
            yield rows(schema, part=[part] * len(out["bucket"]), block=[block] * len(out["bucket"]), **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ClassModel = told.value
        frequent, part, block = model.frequent, TaskContext.get().partitionId(), 0
        held, far, size, far_size = [], [], 0, 0
        end_known, end_log = int(model.texts > 0), np.log10(model.texts + 0.5)
        for batch in batches:
            ids = column(batch, "doc_id")
            flags = ids.is_null().to_numpy(zero_copy_only=False) * NO_ID
            for name, flag in (("held_out", HELD_OUT), ("learn", LEARN)):
                flags = flags + column(batch, name).to_numpy(zero_copy_only=False) * flag
            ids, flags = ids.fill_null(0).to_numpy(), flags.astype(np.uint8)
            for piece, texts in chunks(batch):
                words = Words(texts)
                h = words.hashes()
                line, place, at, known = frequent.symbols(words, h)
                away = np.flatnonzero(~known)
                log_count = np.zeros(len(line))
                log_count[place[known]] = model.log_count[at[known]] if len(frequent.n) else 0
                value = model.emit[line] + np.where(line >= frequent.clustered, log_count, 0)
                value[place[away]] = 0
                is_end = np.zeros(len(line), bool)
                first = words.first + np.arange(len(words.first))
                is_end[first[1:] - 1] = True
                log_count[is_end] = end_log
                seen = np.zeros(len(line), np.int64)
                seen[place[known]] = 1
                seen[is_end] = end_known
                sums = [np.add.reduceat(x, first[:-1]) for x in (seen, log_count, value)]
                held.append((ids[piece], flags[piece], np.diff(first), model.of[line].astype(np.uint8), *sums))
                far.append((h[away], size + place[away]))
                size += len(line)
                far_size += len(away)
                if far_size >= FLUSH or size >= 2 * FLUSH:
                    yield from flush(part, block, held, far)
                    held, far, size, far_size, block = [], [], 0, 0, block + 1
        if size:
            yield from flush(part, block, held, far)

    return run


def _meet(key, tokens: pd.DataFrame, placed: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, for each block: the places of its words with their counts and classes."""
    word, count, classes = (np.frombuffer(placed[name].iloc[0], kind) if len(placed) else np.empty(0, kind) for name, kind in (("words", "<u8"), ("counts", "<i8"), ("classes", np.uint8)))
    out: dict[str, list] = {c.split()[0]: [] for c in MET.split(", ")}
    for part, block, w, places in zip(tokens["part"], tokens["block"], tokens["words"], tokens["places"]):
        w = np.frombuffer(w, "<u8")
        n, of = np.zeros(len(w), np.int64), np.full(len(w), NONE, np.uint8)
        if len(word):
            at = np.minimum(np.searchsorted(word, w), len(word) - 1)
            found = word[at] == w
            n[found], of[found] = count[at[found]], classes[at[found]]
        for name, value in zip(out, (part, block, places, n.astype("<u4").tobytes(), of.tobytes())):
            out[name].append(value)
    return pd.DataFrame(out)


def _resolve(by_class: np.ndarray):
    """A block with the classes, counts and emissions of the words that were met."""

    def run(key, texts: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        (block,) = texts.to_dict("records")
        if len(far):
            line, end = np.frombuffer(block["line"], np.uint8).copy(), np.cumsum(np.frombuffer(block["sizes"], "<i8"))
            place, n, of = (np.concatenate([np.frombuffer(b, kind) for b in far[name]]) for name, kind in (("places", "<u4"), ("n", "<u4"), ("classes", np.uint8)))
            line[place] = of = np.where(of == NONE, line[place], of)
            row, log_n = np.searchsorted(end, place, side="right"), np.log10(n + 0.5)
            for name, kind, more in (("seen", "<i8", n > 0), ("log_counts", "<f8", log_n), ("emits", "<f8", log_n + by_class[of])):
                block[name] = (np.frombuffer(block[name], kind) + np.bincount(row, more, len(end)).astype(kind)).tobytes()
            block["line"] = line.tobytes()
        return pd.DataFrame({c.split()[0]: [block[c.split()[0]]] for c in BLOCK.split(", ")})

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    kinds = dict(zip((c.split()[0] for c in BLOCK.split(", ")), ("<i8", np.uint8, "<i8", np.uint8, "<i8", "<f8", "<f8")))
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: np.frombuffer(column(batch, name)[k].as_buffer(), kinds[name]) for name in batch.schema.names}


def _count_class_pairs(total: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, np.int64)
        for x in _blocks(batches):
            line = x["line"].astype(np.int64)
            before = np.concatenate([[end], line[:-1]])
            sums += np.bincount((before * total + line)[np.repeat(x["flags"] & LEARN > 0, x["sizes"])], minlength=total * total)
        yield _pairs(sums.reshape(total, total))

    return run


def _score(told):
    schema = _schema(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, end, log_total, train = told.value
        for x in _blocks(batches):
            line, n = x["line"], x["sizes"]
            steps = np.add.reduceat(step[np.concatenate([[end], line[:-1]]), line], np.cumsum(n) - n)
            ids = pa.array(x["ids"], pa.int64(), mask=x["flags"] & NO_ID > 0)
            yield rows(schema, doc_id=ids, held_out=x["flags"] & HELD_OUT > 0, n_tokens=n, n_known=x["seen"], train_tokens=np.full(len(n), train), base_score=x["log_counts"] - n * log_total, score=x["emits"] + steps)

    return run


def score(docs: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row; learn: which rows are training texts."""
    spark = docs.sparkSession
    scratch, tell = Scratch(spark, "lm"), spark.sparkContext.broadcast
    bits = shared.shuffle_buckets(spark).bit_length() - 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    train = docs.where("learn").select("text")
    counts = train.mapInArrow(_count_words(bits), "bucket int, words binary, counts binary, shapes binary").groupBy("bucket")
    counts = scratch.table(counts.applyInPandas(_sum_words, "bucket int, words binary, counts binary, shapes binary, n long, v long"), "counts")
    texts = train.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    least = max(LEAST, -(-n // MAX_FREQUENT))
    found = counts.select("words", "counts", "shapes").mapInPandas(_frequent(least), "word long, n long, shape int").toPandas()
    if len(found) < CLUSTERED and least > LEAST:  # the first words are clustered, also where none is that frequent
        found = counts.select("words", "counts", "shapes").mapInPandas(_frequent(LEAST, CLUSTERED), "word long, n long, shape int").orderBy(F.desc("n"), "word").limit(CLUSTERED).toPandas()
    frequent = Frequent(found["word"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["shape"].to_numpy(np.int64))
    size = frequent.end + 1
    pairs = gather_pairs(train.mapInArrow(_count_pairs(tell(frequent)), "u int, v binary, n binary"), size)
    of = exchange(pairs, frequent.clustered, frequent.classes)
    m = np.zeros((int(of.max()) + 1,) * 2)
    np.add.at(m, (of[:, None], of[None, :]), pairs)
    told = tell((frequent, of, m))
    near = train.mapInArrow(_neighbours(told, bits), NEAR)
    placed = near.groupBy("bucket").cogroup(counts.select("bucket", "words", "counts", "shapes").groupBy("bucket")).applyInPandas(_place(told), PLACED)
    placed = scratch.table(placed, "placed")
    sums = [F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for c, k in (("own", frequent.classes), ("shape_n", SHAPES), ("shape_v", SHAPES)) for i in range(k)]
    sums = np.array(placed.agg(*sums).first(), float)
    if len(frequent.word) > frequent.clustered:
        found = placed.select("words", "counts", "classes").mapInPandas(_classes(least), "word long, class int").toPandas()
        frequent = frequent.place(frequent.find(found["word"].to_numpy(np.int64).view(np.uint64))[0], found["class"].to_numpy(np.int64))
    model = ClassModel(frequent, of, sums[: frequent.classes], texts, n + texts, v + (texts > 0), *np.split(sums[frequent.classes :], 2))
    lines = scratch.table(docs.mapInArrow(_lines(tell(model), bits), LINES), "lines")
    far = lines.where("bucket is not null").select("bucket", "part", "block", "words", "places").groupBy("bucket").cogroup(placed.select("bucket", "words", "counts", "classes").groupBy("bucket")).applyInPandas(_meet, MET)
    own = lines.where("bucket is null").drop("bucket", "words", "places")
    blocks = scratch.table(own.groupBy("part", "block").cogroup(far.groupBy("part", "block")).applyInPandas(_resolve(model.by_class), BLOCK), "blocks")
    end = int(model.of[frequent.end])
    model.learn(gather_pairs(blocks.select("flags", "sizes", "line").mapInArrow(_count_class_pairs(model.total, end), "u int, v binary, n binary"), model.total))
    scratch.drop_but("blocks")
    out = blocks.mapInArrow(_score(tell((model.step, end, float(model.log_total), int(model.n)))), SCORED)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(docs: DataFrame, fold: int = 1) -> DataFrame:
    held_out = crc_of_id() % 5 == fold
    return score(docs, ~held_out, held_out)
