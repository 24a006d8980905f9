"""What the operators share: scratch tables, the word kernel and block helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call takes; a single longer text is taken whole.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where driver and executors are one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tomewise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def drop_but(self, *names: str) -> None:
        """Only tables that a lazy result still reads stay."""
        self.drop(*sorted(self.names.difference(names)))


_HELD: dict = {}
_OWNER = [""]


def enter(owner: str) -> dict:
    """What a Python worker keeps from task to task of one operator.

    Workers serve task after task: where another operator's task was before, what that one kept goes, and memory that is
    free goes back to the system.
    """
    if _OWNER[0] != owner:
        _HELD.clear()
        _POWERS.clear()
        _OWNER[0] = owner
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)
    return _HELD


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))


def shuffle_buckets(spark: SparkSession) -> int:
    """Buckets of the block shuffles: four for each shuffle partition, a power of two, 256 at least.

    The partitions are sized for the data, so a bucket holds a quarter of what a task takes, however large the input is.
    """
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(256, 1 << (wanted - 1).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 65536)
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the bytes before each place, weighted by powers; the powers' inverses): equal bytes have equal scaled differences."""
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    own = total[1:]
    with np.errstate(over="ignore"):
        own[:] = buf
        own += np.uint64(1)
        own *= up
        np.cumsum(own, out=own)
    return total, down


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts, side by side.

    start, end: byte places in buf; first: the first word of each text, with the total at the end.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, space: np.ndarray = _SPACE):
        joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.buf = _LOWER[joined] if lower else joined
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        inside = ~space[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes modulo 2**64, mixed."""
        n = len(self.buf)
        if not len(self.start):
            return np.empty(0, np.uint64)
        total, down = prefix_sums(self.buf)
        with np.errstate(over="ignore"):
            return mix((total[self.end] - total[self.start]) * down[self.start])


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than size make one shingle, no word none."""
    h = words.hashes()
    out = []
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        s = np.zeros(n, np.uint64)
        for j in range(size):
            s += h[j : j + n] * _SHINGLE[j]
        s = mix(s)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(s[a : b - size + 1]))
            elif b > a:
                out.append(mix((h[a:b] * _SHINGLE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[slice, list[bytes]]]:
    """Slices of a batch with the UTF-8 texts (null: empty), of about CHUNK_BYTES each."""
    values = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, done = 0, 0
    while begin < len(values):
        end = min(int(np.searchsorted(ends, done + CHUNK_BYTES)) + 1, len(values))
        part = values.slice(begin, end - begin).cast(pa.large_binary()).to_pylist()
        yield slice(begin, end), [value or b"" for value in part]
        begin, done = end, int(ends[end - 1])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def split_by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, pieces of the arrays) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_bucket)) + 1
    begin = np.concatenate([[0], cut]).astype(np.int64)
    end = np.concatenate([cut, [len(order)]]).astype(np.int64)
    arrays = [a[order] for a in arrays]
    for a, b in zip(begin.tolist(), end.tolist()):
        if b > a:
            yield int(sorted_bucket[a]), *(x[a:b] for x in arrays)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the nodes that have an edge (a, b), but for the roots; root is the least node of the component.

    Alternating large-star and small-star steps over tables in the shared folder; the driver sees counts only.
    """
    spark = scratch.spark
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), f"{name}-0")
    before, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38,0)))")).first()
        if mark == before or mark[0] == 0:  # all edges are stars
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, step = mark, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.table(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = after
