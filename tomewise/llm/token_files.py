"""Token ids as Arrow files of equal-length sequences.

A file holds record batches of fixed-size lists, `ids` and `mask`; the ids of the texts follow one another without a
gap and only a file's last sequence is padded (mask false). Any sequence and its mask is a view into the mapped file.
Texts are dealt by ranges of doc_id, so the files in the manifest's order hold the corpus in ascending doc_id order;
an index file beside each one says where each text begins. A task that runs again writes a new file, and only the
manifest, made of what tasks returned, says which files count.

Encoding: words of Latin letters go through tiktoken with the merges of the word-level BPE (a byte no text has stands
for the word end); other texts, and those with special tokens, through tokenizers.

Defined results: a null text has the end id alone; null doc_ids come first; rows that repeat a doc_id follow one
another in the order of their texts' hashes; a text of any length is encoded whole; columns besides doc_id and text
are not read; an empty table gives no ids and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import chunks, column, rows

END = 1  # appended to each text
LENGTH = 1024  # ids of a sequence
BATCH = 64  # sequences of a record batch
MARK = "\x00"  # word end on the way to tiktoken
# The pre-tokenizer's classes among the letters below U+0180.
LATIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\t-\r\x20\x85\xa0a-zªµºß-öø-ſ0-9²³¹¼-¾]+")


class WordEncoder:
    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        vocab, suffix = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if ends else token)) + MARK.encode() * ends

        special = {t["content"] for t in told["added_tokens"]}
        self.special = [s.encode() for s in special]
        id_of = {raw(t): i for t, i in vocab.items() if t not in special}
        # ranks: bytes, then bytes that end a word, then the merges in order
        order = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)]
        seen = set(order)
        for merge in told["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = raw(a + b)
            if token not in seen:
                seen.add(token)
                order.append(token)
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        self.ids = np.array([id_of.get(t, -1) for t in order], dtype=np.int64)

    def encode(self, text: bytes) -> np.ndarray:
        if text and (text.isascii() or np.frombuffer(text, np.uint8).max() < 0xC6) and b"\x00" not in text and not any(s in text for s in self.special):
            found = LATIN_WORD.findall(text.decode().lower())
            ids = self.ids[np.array(self.fast.encode_ordinary(MARK.join(found) + MARK), dtype=np.int64)] if found else np.empty(0, np.int64)
            if not (ids < 0).any():
                return ids
        return np.array(self.slow.encode(text.decode(), add_special_tokens=False).ids, dtype=np.int64)


def encoder(vocabulary: str) -> WordEncoder:
    held = shared.enter("token_files")
    if vocabulary not in held:
        held[vocabulary] = WordEncoder(vocabulary)
    return held[vocabulary]


class TokenWriter:
    """Writes ids to one file of fixed-size lists."""

    def __init__(self, sink, wide: bool = False):
        self.type = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(self.type, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.type.to_pandas_dtype())), LENGTH), pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= BATCH * LENGTH:
            ids = np.concatenate(self.held)
            whole = len(ids) // (BATCH * LENGTH) * (BATCH * LENGTH)
            for a in range(0, whole, BATCH * LENGTH):
                self._write(ids[a : a + BATCH * LENGTH], BATCH * LENGTH)
            self.held, self.size = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            self._write(np.pad(ids, (0, -len(ids) % LENGTH)), len(ids))
        self.writer.close()


class TokenReader:
    """Random access to the sequences, masks and spans of one file."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)

    def _batch(self, k: int, name: str) -> pa.Array:
        return self.file.get_batch(k).column(self.file.schema.get_field_index(name)).flatten()

    def sequence(self, i: int) -> np.ndarray:
        return self._batch(i // BATCH, "ids").to_numpy()[i % BATCH * LENGTH :][:LENGTH]

    def mask(self, i: int) -> pa.BooleanArray:
        """A view of the file's bits; NumPy has no type for them, so what turns it into an array of NumPy copies it."""
        return self._batch(i // BATCH, "mask").slice(i % BATCH * LENGTH, LENGTH)

    def span(self, start: int, n: int) -> np.ndarray:
        size, parts = BATCH * LENGTH, []
        for k in range(start // size, (start + n - 1) // size + 1 if n else 0):
            parts.append(self._batch(k, "ids").to_numpy()[max(0, start - k * size) : start + n - k * size])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, file string, index_file string, n_tokens long, n_docs long"


def _write_part(folder: str, vocabulary: str):
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("index_file", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.arrow"
        docs = 0
        with fs.open_output_stream(f"{path}/ids-{name}") as a, fs.open_output_stream(f"{path}/docs-{name}") as b:
            writer, index = TokenWriter(a, wide=own.slow.get_vocab_size() > 1 << 16), pa.ipc.new_file(b, INDEX)
            for batch in batches:
                ids = column(batch, "doc_id")
                for piece, texts in chunks(batch):
                    start, n = [], []
                    for text in texts:
                        found = np.append(own.encode(text), END)
                        start.append(writer.total)
                        n.append(len(found))
                        writer.add(found)
                    index.write_batch(rows(INDEX, doc_id=ids[piece], start=start, n_tokens=n))
                    docs += len(texts)
            writer.close()
            index.close()
        yield rows(schema, part=[part], file=[f"{folder}/ids-{name}"], index_file=[f"{folder}/docs-{name}"], n_tokens=[writer.total], n_docs=[docs])

    return run


def write(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Writes the ids below folder; the manifest: MANIFEST and base, the ids in the files before."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(_write_part(folder, vocabulary), MANIFEST).write.parquet(f"{folder}/manifest")
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect()  # a row for each file
    base = np.concatenate([[0], np.cumsum([f.n_tokens for f in files])]).tolist()
    return spark.createDataFrame([(*f, b) for f, b in zip(files, base)], MANIFEST + ", base long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file of each text, from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, index_file, base in zip(pdf["file"], pdf["index_file"], pdf["base"]):
                reader = TokenReader(file)
                fs, path = pyarrow.fs.FileSystem.from_uri(index_file)
                with fs.open_input_file(path) as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        batch = index.get_batch(k)
                        crc = [zlib.crc32(reader.span(a, n).astype("<u4").tobytes()) for a, n in zip(batch["start"].to_pylist(), batch["n_tokens"].to_pylist())]
                        yield pd.DataFrame({"doc_id": pd.Series(batch["doc_id"].to_pylist(), dtype="Int64"), "start": batch["start"].to_numpy() + base, "n_tokens": batch["n_tokens"].to_numpy(), "ids_crc32": crc, "file": file})

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return read(write(docs, vocabulary, f"{shared.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"))
