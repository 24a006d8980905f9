"""N-gram Jaccard join over a count-vector R-tree.

A document's tokens are the hashes of its distinct 5-word shingles. Hashing the tokens into groups gives
a point of group counts; the coordinate minima of two points sum to an upper bound of the overlap of their sets. Larger
sets have more groups; points of unlike numbers of groups meet after the greater number is folded to the lesser.

1. `_first_pass`: set sizes and set fingerprints; token frequencies for the global token order.
2. `_second_pass`: equal sets become one node (its fingerprint). In a global order (light tokens by hash, then
   heavy ones by frequency) two sets with Jaccard similarity t share a token among the first n - ceil(t n) + 1, so
   nodes meet in the blocks of these tokens. Any global order is exact; this one keeps common passages out. Where the
   first token that two sets share stands tells how many they can share at most: a node's reach in a block is the
   greatest size of a set that it can link with there, and nodes out of reach of each other do not meet.
3. Blocks: each node is compared with the node of its block that reaches farthest for its size, which is the least
   changed of a group of copies, and with the greatest. What remains open, nodes of one block in different components, is searched in rounds: first the nodes outside their block's largest component ask an
   R-tree over the points of the block for the few best targets in other components that the bound allows; they are
   verified exactly, and links join components before the next round. In each further round the nodes that had more
   such targets ask for more, until none has, so every pair that could link is settled, but a group of copies never
   yields all its pairs.

Equal member lists count as one block. Blocks over SPLIT members are dealt over several tasks. Nothing is capped.

Defined results: null, empty or word-free texts have an empty set and link with nothing; rows that repeat a doc_id
are answered row by row; a null doc_id gives a null component_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Scratch, Words, chunks, column, components, rows, shingle_sets, split_by_bucket

NUM, DEN = 75, 100  # the threshold as a fraction
GROUPS = 128  # coordinates of a point, at least
CROWD = 8  # tokens of a group, at most, on average: fuller groups are alike by chance, so larger sets have more of them
MAX_HEAVY = 1 << 22  # a token is heavy from max(16, tokens counted / MAX_HEAVY) occurrences, which bounds their number
HOT = 4096  # heavier tokens go through SQL, whose sums are combined before the shuffle
SPLIT = 2048  # members of a block that one task takes
FIRST_ASK, MORE = 16, 8  # targets that a node asks for in the first round, and times more in each further one
FEW = 1 << 16  # ids that may be broadcast
FLUSH = 1 << 20  # tokens that a task holds before it writes them to its buckets
LEAF = 16  # points in a leaf of the R-tree
FLAT = 64  # points that are compared without a tree

FIRST = "kind int, doc_id long, n int, fp long, point binary, bucket int, blob binary"
SECOND = "kind int, fp long, hot array<long>, reach array<long>, bucket int, tokens binary, nodes binary, reaches binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(", ")])


def fingerprint(s: np.ndarray) -> int:
    """One number for a set of hashes; 0 is the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        both = np.array([shared.mix(s).sum() + np.uint64(len(s))], dtype=np.uint64)
    return int(shared.mix(both).view(np.int64)[0])


def point(s: np.ndarray) -> bytes:
    """The counts of a set's groups in the least width that holds them all, after a byte that says the width."""
    groups = max(GROUPS, 1 << (-(-len(s) // CROWD) - 1).bit_length())
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def points_of(blobs) -> np.ndarray:
    """The points as rows, folded to the least number of groups, in the least width that holds them."""
    found = [np.frombuffer(b, f"<u{b[0]}", offset=1) for b in blobs]
    groups = min(map(len, found))
    if all(len(f) == groups and f.itemsize == 1 for f in found):
        return np.stack(found)
    out = np.stack([f.reshape(-1, groups).sum(axis=0, dtype=np.int64) for f in found])
    return out.astype("<u1" if out.max() < 1 << 8 else "<u2" if out.max() < 1 << 16 else "<u4")


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap: the coordinate minima, summed."""
    return np.minimum(x, y).sum(axis=-1, dtype=np.int64)


def packed(values: np.ndarray, width: int) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane, so that compression finds the empty planes."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    planes = np.zeros((8, len(blob) // width), np.uint8)
    planes[:width] = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def needed(a, b):
    """The least overlap of linked sets of these sizes."""
    return -(-NUM * (a + b) // (NUM + DEN))


def reaches(n: int) -> np.ndarray:
    """For each place in the prefix of a set of n tokens the greatest size of a set that it can link with, if they share no token before it."""
    return (n - np.arange(prefix_length(n))) * (NUM + DEN) // NUM - n


def _first_pass(bits: int):
    schema = _arrow(FIRST)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held) >> np.uint64(24)
        low = np.sort(keys)
        bucket, blob = [], []
        for b, part in split_by_bucket((low >> np.uint64(40 - bits)).astype(np.int64), low):
            bucket.append(b)
            blob.append(packed(part & np.uint64((1 << 40 - bits) - 1), 4))
        return rows(schema, kind=[1] * len(bucket), bucket=bucket, blob=blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("jaccard_join")
        held, size, seen = [], 0, set()
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for piece, texts in chunks(batch):
                n, fp, points = [], [], []
                for s in shingle_sets(Words(texts)):
                    n.append(len(s))
                    fp.append(fingerprint(s))
                    new = len(s) > 0 and fp[-1] not in seen
                    points.append(point(s) if new else None)
                    if new:
                        seen.add(fp[-1])
                        held.append(s[: (len(s) + 1) // 2])
                        size += len(held[-1])
                        if size >= FLUSH:
                            yield flush(held)
                            held, size = [], 0
                yield rows(schema, kind=[0] * len(n), doc_id=ids[piece], n=n, fp=fp, point=points)
        if held:
            yield flush(held)

    return run


def _heavy(least: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.sort(np.concatenate([unpacked(b, 4) for b in pdf["blob"]]))
        cut = np.flatnonzero(np.diff(low)) + 1
        begin = np.concatenate([[0], cut])
        count = np.diff(np.concatenate([begin, [len(low)]]))
        keep = count >= least
        key = low[begin[keep]].astype(np.int64) | (int(pdf["bucket"].iloc[0]) << (40 - bits))
        return pd.DataFrame({"key": key, "df": count[keep].astype(np.int64)})

    return run


def _second_pass(heavy, bits: int):
    schema = _arrow(SECOND)

    def flush(held: list[tuple[np.ndarray, int, np.ndarray]]) -> pa.RecordBatch:
        tokens = np.concatenate([t for t, _, _ in held]) >> np.uint64(16)
        nodes = np.repeat(np.array([f for _, f, _ in held], dtype="<i8"), [len(t) for t, _, _ in held])
        reach = np.concatenate([r for _, _, r in held]).astype("<u4")
        order = np.argsort(tokens)
        tokens, nodes, reach = tokens[order], nodes[order], reach[order]
        bucket, a, b, c = [], [], [], []
        for k, t, f, r in split_by_bucket((tokens >> np.uint64(48 - bits)).astype(np.int64), tokens, nodes, reach):
            bucket.append(k)
            a.append(packed(t & np.uint64((1 << 48 - bits) - 1), 5))
            b.append(f.tobytes())
            c.append(r.tobytes())
        return rows(schema, kind=[1] * len(bucket), bucket=bucket, tokens=a, nodes=b, reaches=c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("jaccard_join")
        keys, counts = heavy.value
        held, size, seen = [], 0, set()
        for batch in batches:
            known = column(batch, "doc_id").is_valid().to_pylist()
            for piece, texts in chunks(batch):
                fps, hot, far = [], [], []
                for i, s in enumerate(shingle_sets(Words(texts)), piece.start):
                    fp = fingerprint(s)
                    if not len(s) or fp in seen or not known[i]:
                        continue
                    seen.add(fp)
                    key = (s >> np.uint64(24)).astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                    weight = np.where(keys[at] == key, counts[at], 0) if len(keys) else np.zeros(len(s), np.int64)
                    order = np.argsort(weight, kind="stable")[: prefix_length(len(s))]
                    first, weight, reach = s[order], weight[order], reaches(len(s))
                    held.append((first[weight <= HOT], fp, reach[weight <= HOT]))
                    size += len(held[-1][0])
                    if weight[-1] > HOT:
                        fps.append(fp)
                        hot.append(first[weight > HOT].view(np.int64).tolist())
                        far.append(reach[weight > HOT].tolist())
                    if size >= FLUSH:
                        yield flush(held)
                        held, size = [], 0
                if fps:
                    yield rows(schema, kind=[0] * len(fps), fp=fps, hot=hot, reach=far)
        if size:
            yield flush(held)

    return run


def _blocks(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket the tokens that two or more nodes have; equal member lists come once, with the farthest reach of each member. Hot tokens pass through."""
    pdf = pdf[pdf["kind"] == 1]
    tokens = np.concatenate([np.empty(0, np.uint64), *(unpacked(b, 5) for b in pdf["tokens"])])
    nodes = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(b, "<i8") for b in pdf["nodes"])])
    reach = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(b, "<u4") for b in pdf["reaches"])]).astype(np.int64)
    order = np.lexsort((nodes, tokens))
    tokens, nodes, reach = tokens[order], nodes[order], reach[order]
    once = (np.diff(tokens, prepend=~tokens[:1]) != 0) | (np.diff(nodes, prepend=0) != 0)  # a set that several tasks met
    tokens, nodes, reach = tokens[once], nodes[once], reach[once]
    cut = np.flatnonzero(np.diff(tokens)) + 1
    begin, end = np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(tokens)]]).astype(np.int64)
    two = begin[end - begin == 2]
    two = two[np.lexsort((nodes[two + 1], nodes[two]))]
    new = np.flatnonzero((np.diff(nodes[two], prepend=0) != 0) | (np.diff(nodes[two + 1], prepend=0) != 0) | (np.arange(len(two)) == 0))
    pairs = np.stack([nodes[two[new]], nodes[two[new] + 1]], axis=1)
    far = np.stack([np.maximum.reduceat(reach[two + k], new) for k in (0, 1)], axis=1) if len(two) else pairs
    many = np.flatnonzero(end - begin > 2).tolist()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for members, r in [*zip(pairs, far), *((nodes[begin[i] : end[i]], reach[begin[i] : end[i]]) for i in many)]:
        block = fingerprint(members.view(np.uint64))
        found[block] = (members, np.maximum(r, found[block][1]) if block in found else r)
    lists = [pd.Series([v[k].tolist() for v in found.values()], dtype=object) for k in (0, 1)]
    return pd.DataFrame({"block": pd.Series(list(found), dtype=np.int64), "members": lists[0], "reach": lists[1]})


class RTree:
    """A packed R-tree over count points: leaves of LEAF points with their least size and coordinate maxima."""

    def __init__(self, n: np.ndarray, points: np.ndarray):
        heavy = np.argsort(-points.var(axis=0))[:2]  # the widest coordinates order the points of similar size
        self.order = np.lexsort((points[:, heavy[1]], points[:, heavy[0]], np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) * 4)))
        self.n, self.points = n[self.order], points[self.order]
        edge = np.arange(0, len(n), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, edge, axis=0), np.minimum.reduceat(self.n, edge))]
        while len(self.levels[-1][1]) > LEAF:
            top, least = self.levels[-1]
            edge = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(top, edge, axis=0), np.minimum.reduceat(least, edge)))

    def search(self, n: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places as given, bounds) of the points whose bound allows the overlap that a link needs."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            at = at[bound(top[at], q) >= needed(n, least[at])]
            size = len(self.levels[depth - 1][1]) if depth else len(self.n)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < size]
        over = bound(self.points[at], q)
        good = over >= needed(n, self.n[at])
        return self.order[at[good]], over[good]


def _search(ask_for: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each asking node the ask_for best targets in other components that it has not met yet; pdf holds several blocks."""
        pdf = pdf.sort_values(["block", "part"])
        fp, root, n, reach, home, asks, block, part, met = (pdf[k].to_numpy() for k in ("fp", "root", "n", "reach", "home", "asks", "block", "part", "met"))
        blobs = pdf["point"].to_numpy()
        edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1
        found: list[tuple] = []
        more = np.zeros(len(fp), bool)
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)]):
            here = lo + np.flatnonzero(home[lo:hi])
            ask = lo + np.flatnonzero(asks[lo:hi])
            if len(here) and len(ask):
                ask = ask[reach[ask] >= n[here].min()]
            if len(here) and len(ask):
                here = here[(reach[here] >= n[ask].min()) & (n[here] <= reach[ask].max())]
            if not len(here) or not len(ask):
                continue
            points = points_of(blobs[lo:hi])
            targets = points[here - lo]
            if len(here) <= FLAT:
                over = np.concatenate([bound(points[ask[k : k + FLAT] - lo, None], targets) for k in range(0, len(ask), FLAT)])
                x, y = np.nonzero((over >= needed(n[ask][:, None], n[here])) & (root[ask][:, None] != root[here]))
                over, x, y = over[x, y], ask[x], here[y]
            else:
                tree = RTree(n[here], targets)
                hits = [tree.search(int(n[i]), points[i - lo]) for i in ask.tolist()]
                x, y, over = np.repeat(ask, [len(k) for k, _ in hits]), here[np.concatenate([k for k, _ in hits])], np.concatenate([k for _, k in hits])
                other = root[x] != root[y]
                x, y, over = x[other], y[other], over[other]
            near = (n[x] <= reach[y]) & (n[y] <= reach[x])
            x, y, over = x[near], y[near], over[near]
            if len(x):
                new = np.ones(len(x), bool)
                for i in np.unique(x[np.array([m is not None for m in met[x]])]).tolist():
                    own = x == i
                    new[own] = ~np.isin(fp[y[own]], np.frombuffer(met[i], "<i8"))
                x, y, over = x[new], y[new], over[new]
                keep, many = _best(x, fp[y], over / (n[x] + n[y] - over), ask_for)  # by the Jaccard similarity that the bound allows
                more[many] = True
                found.append((x[keep], fp[y[keep]], (over / (n[x] + n[y] - over))[keep]))
        x, target, score = (np.concatenate([f[k] for f in found]) if found else np.empty(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        return _told(x, fp, {"targets": target, "scores": score}, more, "a")

    return run


def _best(x: np.ndarray, target: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the `most` rows of each x with the best scores, the x that have more rows)"""
    order = np.lexsort((target, -score, x))
    begin = np.flatnonzero(np.diff(x[order], prepend=-1))
    rank = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    return order[rank < most], x[order[rank == most]]


def _told(x: np.ndarray, fp: np.ndarray, lists: dict[str, np.ndarray], more: np.ndarray, name: str) -> pd.DataFrame:
    """A row for each node of x, which is sorted in runs: its lists as bytes, and whether it has more."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    begin = np.flatnonzero(np.diff(x, prepend=-1))
    end = np.append(begin[1:], len(x))[: len(begin)]
    out = {name: pd.Series(fp[x[begin]], dtype=np.int64)}
    for k, values in lists.items():
        values = values[order]
        out[k] = pd.Series([values[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())], dtype=object)
    return pd.DataFrame(out | {"more": pd.Series(more[x[begin]], dtype=bool)})


def _choose(ask_for: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of some nodes the best targets from all of their blocks, and whether there are more."""
        fp, row = np.unique(pdf["a"].to_numpy(np.int64), return_inverse=True)
        target, score = (np.concatenate([np.frombuffer(t, kind) for t in pdf[k]]) for k, kind in (("targets", "<i8"), ("scores", "<f8")))
        x = np.repeat(row, [len(t) // 8 for t in pdf["targets"]])
        order = np.lexsort((target, x))
        once = order[(np.diff(x[order], prepend=-1) != 0) | (np.diff(target[order], prepend=0) != 0)]
        x, target, score = x[once], target[once], score[once]
        keep, many = _best(x, target, score, ask_for)
        more = np.bincount(row, pdf["more"].to_numpy(bool), len(fp)) > 0
        more[many] = True
        return _told(x[keep], fp, {"targets": target[keep]}, more, "fp")

    return run


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        b = [np.frombuffer(t, "<i8") for t in pdf["targets"]]
        a = np.repeat(pdf["fp"].to_numpy(np.int64), [len(x) for x in b])
        b = np.concatenate([np.empty(0, np.int64), *b])
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            over = np.array([int(bound(*points_of(both))) for both in zip(pdf["point_a"], pdf["point_b"])])
            pdf = pdf[over >= needed(pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy())]
        yield pdf[["a", "b"]]


def _marks(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 << bits, dtype=bool)
        for pdf in batches:
            out[_mark(pdf["doc_id"].to_numpy(np.int64), bits)] = True
        yield pd.DataFrame({"bitmap": [np.packbits(out).tobytes()]})

    return run


def _mark(ids: np.ndarray, bits: int) -> np.ndarray:
    return (shared.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs, which has a text, with fp: the fingerprint of each row's set."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    if "fp" in docs.columns:
        raise ValueError("docs has a column fp")
    out = StructType([*docs.schema.fields, StructField("fp", LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("jaccard_join")
        for batch in batches:
            fps = [fingerprint(s) for _, texts in chunks(batch) for s in shingle_sets(Words(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], schema=schema)

    return docs.mapInArrow(run, out)


def _sets_of(marks, bits: int):
    schema = pa.schema([("fp", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.enter("jaccard_join")
        asked = np.unpackbits(np.frombuffer(marks.value, np.uint8)).view(bool)
        for batch in batches:
            ids = column(batch, "doc_id")
            batch = batch.filter(pa.array(asked[_mark(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)]))
            for _, texts in chunks(batch):
                sets = [s for s in shingle_sets(Words(texts)) if len(s)]
                prints = [fingerprint(s) for s in sets]
                yield rows(schema, fp=prints, tokens=[packed(s >> np.uint64(16), 6) for s in sets])

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for x, y in zip(pdf["tokens_a"], pdf["tokens_b"]):
            both = len(np.intersect1d(unpacked(x, 6), unpacked(y, 6), assume_unique=True))
            keep.append(DEN * both >= NUM * (len(x) // 6 + len(y) // 6 - both))
        yield pdf[["a", "b"]][np.array(keep, dtype=bool)].drop_duplicates()


class Sets:
    """The sets of the nodes that were asked for, each taken from its text once and kept as a table."""

    def __init__(self, scratch: Scratch, docs: DataFrame, nodes: DataFrame):
        self.scratch, self.docs, self.nodes = scratch, docs, nodes
        self.kept: DataFrame | None = None

    def of(self, asked: DataFrame, name: str) -> DataFrame:
        """(fp, tokens) of the asked nodes; a set may come more than once. asked: a table of distinct fp."""
        if self.kept is None:
            missing = asked
        else:
            missing = self.scratch.table(asked.join(self.kept.select("fp"), "fp", "left_anti"), f"{name}-missing")
        n = missing.count()
        if n:
            sets = self.scratch.table(self._read(missing, n, name), f"{name}-sets")
            self.kept = sets if self.kept is None else self.kept.unionByName(sets)
        if self.kept is None:
            return self.docs.sparkSession.createDataFrame([], "fp long, tokens binary")
        if asked.count() > FEW:
            return self.kept.join(asked, "fp", "left_semi")
        return self.kept.join(F.broadcast(asked), "fp", "left_semi")

    def _read(self, missing: DataFrame, n: int, name: str) -> DataFrame:
        """Straight from the texts: a set that the bitmap lets pass by chance finds no pair, or repeats one."""
        ids = self.scratch.table(missing.join(self.nodes.select("fp", "doc_id"), "fp").select("doc_id"), f"{name}-ids")
        bits = int(min(27, max(16, (n * 16).bit_length())))  # a bitmap of 16 MB at most: beyond its size it only lets more texts pass
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for row in ids.coalesce(4).mapInPandas(_marks(bits), "bitmap binary").toLocalIterator():
            bitmap |= np.frombuffer(row.bitmap, np.uint8)
        marks = self.docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
        docs = self.docs.join(F.broadcast(ids), "doc_id", "left_semi") if n <= FEW else self.docs
        return docs.mapInArrow(_sets_of(marks, bits), "fp long, tokens binary")


def _near(scratch: Scratch, nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Those of the candidate edges (a, b) whose sizes and points allow a link."""
    side = lambda k: nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("point").alias(f"point_{k}"))
    near = edges.distinct().join(side("a"), "a").join(side("b"), "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    return scratch.table(near.mapInPandas(_bound, "a long, b long"), f"{name}-near")


def _links(scratch: Scratch, sets: Sets, near: DataFrame, name: str) -> DataFrame:
    """Those of the candidate edges (a, b) whose sets are similar enough. near: a table."""
    asked = scratch.table(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), f"{name}-asked")
    found = sets.of(asked, name)
    side = lambda k: found.select(F.col("fp").alias(k), F.col("tokens").alias(f"tokens_{k}"))
    links = scratch.table(near.join(side("b"), "b").join(side("a"), "a").mapInPandas(_verify, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-asked")
    return links


def _merge(scratch: Scratch, roots: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """(fp, root) of all nodes that have links, their roots included."""
    if roots is None:
        found = components(scratch, links, name)
    else:
        at = lambda k: roots.select(F.col("fp").alias(k), F.col("root").alias(f"root_{k}"))
        edges = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
        found = components(scratch, edges, name)
    found = scratch.table(found, f"{name}-found")
    fresh = found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())
    if roots is not None:
        moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("fp", F.coalesce("new", "root").alias("root"))
        fresh = moved.unionByName(fresh.join(roots, "fp", "left_anti"))
    return scratch.table(fresh, f"{name}-roots")


def _round(scratch: Scratch, sets: Sets, nodes: DataFrame, members: DataFrame, roots: DataFrame, met: DataFrame | None, step: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(fp, targets, more) of the asking nodes, and the links among them and their targets.

    Without met, nodes outside the largest component of a block ask; then those of met that have more targets, in all of their blocks.
    """
    name, ask_for = f"round{step}", FIRST_ASK * MORE**step
    sizes = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root")
    placed = members.join(sizes, "fp", "left").select("block", "fp", "reach", F.coalesce("root", "fp").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
    if met is not None:
        placed = placed.join(met.where("more").select("fp", F.col("targets").alias("met")), "fp", "left")
    else:
        placed = placed.withColumn("met", F.lit(None).cast("binary"))
    placed = scratch.table(placed, f"{name}-placed")
    open_ = placed.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("of"), F.max(F.struct("size", "root")).alias("m"), F.count("met").alias("asking"))
    open_ = open_.where("lo <> hi" if met is None else "lo <> hi and asking > 0").select("block", "of", F.col("m.root").alias("main"))
    inside = placed.join(open_, "block").withColumn("asks", F.expr("root <> main" if met is None else "met is not null"))
    inside = inside.select("block", "fp", "reach", "root", "of", "asks", "met").join(nodes.select("fp", "n", "point"), "fp")
    inside = inside.withColumn("parts", F.expr(f"cast(ceil(of / {SPLIT}) as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    inside = inside.withColumn("part", F.explode(F.expr("if(asks, sequence(0, parts - 1), array(own))"))).withColumn("home", F.expr("part = own"))
    inside = inside.select("block", "part", "fp", "root", "home", "asks", "n", "reach", "point", "met")
    found = inside.groupBy(F.expr(f"cast(pmod(xxhash64(block, part), {buckets}) as int)").alias("bucket")).applyInPandas(_search(ask_for), "a long, targets binary, scores binary, more boolean")
    found = found.groupBy(F.expr(f"cast(pmod(xxhash64(a), {buckets}) as int)").alias("bucket")).applyInPandas(_choose(ask_for), "fp long, targets binary, more boolean")
    found = scratch.table(found, f"{name}-asked-for")
    near = scratch.table(found.mapInPandas(_pairs, "a long, b long"), f"{name}-pairs")  # a pair whose nodes both ask comes twice
    links = _links(scratch, sets, near, name)
    scratch.drop(f"{name}-placed", f"{name}-pairs")
    return found, links


def _settle(scratch: Scratch, sets: Sets, nodes: DataFrame, members: DataFrame, roots: DataFrame, buckets: int) -> DataFrame:
    """The roots once no pair of a block is left that could link and is neither verified nor within one component."""
    met, step = None, 0
    while True:
        found, links = _round(scratch, sets, nodes, members, roots, met, step, buckets)
        roots = _merge(scratch, roots, links, f"merge{step}")
        if not found.where("more").limit(1).count():
            return roots
        if met is None:
            met = found
        else:
            before = met.select("fp", F.col("targets").alias("t"))
            met = found.where("more").join(before, "fp", "left").select("fp", F.concat("targets", F.coalesce("t", F.lit(b""))).alias("targets"), "more")
            met = scratch.table(met, f"met{step}")
        step += 1


def _members(scratch: Scratch, docs: DataFrame, nodes: DataFrame, heavy, bits: int) -> DataFrame:
    """(block, fp, n, reach): the nodes of each block, split into size bands so that only nodes of like size meet.

    Linked sets differ in size by 4/3 at most, so their size classes to the base 4/3 are equal or neighbours: a node
    of class c stands in the bands c and c + 1. A node that reaches no other of its band is left out, and bands with the
    same members as another are one, with the farthest reach of each member.
    """
    second = docs.mapInArrow(_second_pass(heavy, bits), SECOND)
    # hot tokens come as rows of their own, the others by bucket
    second = second.groupBy(F.coalesce("bucket", F.expr(f"cast(-1 - pmod(fp, {1 << bits}) as int)")).alias("b"))
    blocks = second.applyInPandas(lambda key, pdf: _tell_hot(pdf) if key[0] < 0 else _blocks(key, pdf), "block long, members array<long>, reach array<long>")
    blocks = scratch.table(blocks, "blocks").select("block", F.explode(F.arrays_zip("members", "reach")).alias("m"))
    rows_ = blocks.groupBy("block", F.col("m.members").alias("fp")).agg(F.max("m.reach").alias("reach"))
    rows_ = rows_.join(nodes.select("fp", "n"), "fp").withColumn("c", F.expr(f"cast(floor(ln(n) / ln({DEN} / {NUM}) + 1e-9) as int)"))
    rows_ = rows_.select(F.explode(F.expr("array(c, c + 1)")).alias("band"), "block", "fp", "n", "reach").select(F.xxhash64("block", "band").alias("block"), "fp", "n", "reach")
    rows_ = scratch.table(rows_, "bands")
    ends = rows_.groupBy("block").agg(F.min("n").alias("least"), F.max("reach").alias("most"), F.count("*").alias("of")).where("of > 1").drop("of")
    rows_ = scratch.table(rows_.join(ends, "block").where("reach >= least and n <= most").drop("least", "most"), "within")
    scratch.drop("blocks", "bands")
    one = rows_.groupBy("block").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.expr("pmod(xxhash64(fp, 1), 1000000007)")).alias("y")).where("size > 1")
    same = one.groupBy("size", "x", "y").agg(F.min("block").alias("first"), F.collect_list("block").alias("blocks")).select("first", F.explode("blocks").alias("block"))
    found = rows_.join(same, "block").groupBy(F.col("first").alias("block"), "fp").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    return scratch.table(found, "members")


def _tell_hot(pdf: pd.DataFrame) -> pd.DataFrame:
    """A member list of one for each hot token of a node; SQL brings the nodes of a token together."""
    block = [t for tokens in pdf["hot"] for t in tokens]
    members, reach = [[f] for f, tokens in zip(pdf["fp"], pdf["hot"]) for _ in tokens], [[r] for far in pdf["reach"] for r in far]
    return pd.DataFrame({"block": pd.Series(block, dtype=np.int64), "members": pd.Series(members, dtype=object), "reach": pd.Series(reach, dtype=object)})


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and, with_sets, fp (the fingerprint of its set) of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    buckets = shared.shuffle_buckets(spark)
    bits = buckets.bit_length() - 1
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    first = scratch.table(docs.mapInArrow(_first_pass(bits), FIRST), "first")
    known = scratch.table(first.where("kind = 0").select("doc_id", "n", "fp"), "known")
    nodes = first.where("kind = 0 and n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("point").alias("point"))
    nodes = scratch.table(nodes, "nodes")
    total = known.agg(F.coalesce(F.sum(F.expr("(n + 1) div 2")), F.lit(0))).first()[0]
    least = max(16, total // MAX_HEAVY)
    heavy = first.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInPandas(_heavy(least, bits), "key long, df long").toPandas()
    order = np.argsort(heavy["key"].to_numpy(np.int64))
    told = spark.sparkContext.broadcast((heavy["key"].to_numpy(np.int64)[order], heavy["df"].to_numpy(np.int64)[order]))
    scratch.drop("first")

    members = _members(scratch, docs, nodes, told, bits)
    ends = members.groupBy("block").agg(F.max(F.struct(F.expr("reach / n"), "fp"))["fp"].alias("lo"), F.max("fp").alias("hi"))
    stars = members.join(ends, "block").select("fp", F.explode(F.array("lo", "hi")).alias("p")).where("p <> fp").select(F.least("fp", "p").alias("a"), F.greatest("fp", "p").alias("b"))
    sets = Sets(scratch, docs, nodes)
    links = _links(scratch, sets, _near(scratch, nodes, stars, "stars"), "stars")
    roots = _settle(scratch, sets, nodes, members, _merge(scratch, None, links, "merge"), buckets)
    named = nodes.select("fp", "doc_id").join(roots, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = scratch.table(named.join(smallest, "root").select("fp", "component_id"), "named")
    scratch.drop_but("known", "named")
    return known.join(named, "fp", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *["fp"] * with_sets
    )
