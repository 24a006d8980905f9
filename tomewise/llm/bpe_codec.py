"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts a text into chunks, so equal passages of different documents give equal chunks
wherever they stand. A worker encodes a chunk once and keeps it; the join of two chunks is checked by encoding the
words on both sides together, and where that disagrees the chunks are encoded as one, until it agrees exactly.

Chunks of Latin letters go through tiktoken with the same merges, the rest and special tokens through tokenizers.

Defined results: null text is empty: no ids, the hashes of nothing; rows that repeat a doc_id, a null one too, are
answered row by row; columns besides doc_id and text are not read; an empty table gives an empty result; a text of any
length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import chunks, column, rows

WINDOW = 16  # bytes that the rolling hash sees
EVERY = 96  # a word start in so many is a cut
CACHE_BYTES = 48 << 20  # of chunks and their ids that a worker keeps, in two generations
OVERHEAD = 700  # bytes of an entry besides its text and ids

SPECIAL = b"<|endoftext|>"
_STARTS_WORD = np.zeros(256, bool)  # bytes that certainly begin a character other than white space
_STARTS_WORD[0x21:0x7F] = True
_STARTS_WORD[0xC3:0xC9] = True


class Codec:
    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        """vocabulary: a byte-level BPE of the tokenizers library; ranks, pattern: the same one for tiktoken."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        with open(vocabulary, encoding="utf-8") as f:
            told = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        table = {i: bytes(byte[c] for c in token) for token, i in told["model"]["vocab"].items()}
        table |= {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        self.bytes_of = [table.get(i, b"") for i in range(max(table) + 1)]
        self.digits_of = [str(i) for i in range(max(table) + 1)]
        self.kept: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}
        self.size = 0

    def encode(self, text: bytes) -> list[int]:
        if self.fast and (text.isascii() or np.frombuffer(text, np.uint8).max() < 0xC9) and SPECIAL not in text:
            return self.fast.encode_ordinary(text.decode())
        return self.slow.encode(text.decode(), add_special_tokens=False).ids

    def chunk(self, text: bytes) -> tuple:
        """(ids, decimal ids, decoded bytes, first word, its number of ids, last word, its number of ids)"""
        found = self.kept.get(text)
        if found is None:
            found = self.older.get(text) or self._told(text)
            size = OVERHEAD + 3 * len(text) + 12 * len(found[0])
            self.size += size
            if 2 * self.size > CACHE_BYTES:  # what was not asked for since the last time goes
                self.older, self.kept, self.size = self.kept, {}, size
            self.kept[text] = found
        return found

    def _told(self, text: bytes) -> tuple:
        ids = self.encode(text)
        head, tail = _first_cut(text), _last_cut(text)
        digits, values = self.digits_of, self.bytes_of
        return ids, ",".join([digits[i] for i in ids]), b"".join([values[i] for i in ids]), text[:head], self._covering(ids, head), text[tail:], self._covering(reversed(ids), len(text) - tail)

    def _covering(self, ids, size: int) -> int:
        """How many of the ids hold the first size bytes; beyond all, and so never agreeing, if none ends there."""
        n = 0
        for i in ids if size else ():
            size -= len(self.bytes_of[i])
            n += 1
            if size <= 0:
                break
        return n if size == 0 else 1 << 30

    def joined(self, parts: list[bytes]) -> list[tuple]:
        """The chunks of a text; two whose join disagrees with encoding across it become one."""
        done: list[tuple[bytes, tuple]] = []
        for part in parts:
            now = (part, self.chunk(part))
            while done:
                left, right = done[-1][1], now[1]
                across = self.encode(left[5] + right[3])
                if left[6] <= len(left[0]) and right[4] <= len(right[0]) and across == left[0][len(left[0]) - left[6] :] + right[0][: right[4]]:
                    break
                now = (done[-1][0] + now[0], self.chunk(done[-1][0] + now[0]))
                done.pop()
            done.append(now)
        return [x for _, x in done]


def _first_cut(text: bytes) -> int:
    at = text.find(b" ", 1)
    while at >= 0 and not (at + 1 < len(text) and _STARTS_WORD[text[at + 1]]):
        at = text.find(b" ", at + 1)
    return len(text) if at < 0 else at


def _last_cut(text: bytes) -> int:
    at = text.rfind(b" ")
    while at > 0 and not (at + 1 < len(text) and _STARTS_WORD[text[at + 1]]):
        at = text.rfind(b" ", 0, at)
    return max(at, 0)


def cuts(texts: list[bytes]) -> list[list[int]]:
    """For each text the places of its cuts: word starts whose preceding WINDOW bytes have a hash of one class."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(lengths)])
    if len(buf) <= WINDOW + 1:
        return [[] for _ in texts]
    at = np.flatnonzero((buf[:-1] == 0x20) & _STARTS_WORD[buf[1:]])
    doc = np.searchsorted(begin, at, side="right") - 1
    at = at[at - begin[doc] >= WINDOW]
    total, down = shared.prefix_sums(buf)
    with np.errstate(over="ignore"):
        h = shared.mix((total[at] - total[at - WINDOW]) * down[at - WINDOW])
    at = at[h % np.uint64(EVERY) == 0]
    edge = np.searchsorted(at, begin)
    return [(at[a:b] - s).tolist() for a, b, s in zip(edge[:-1].tolist(), edge[1:].tolist(), begin.tolist())]


def codec(*paths: str) -> Codec:
    """One codec a worker, whose chunks serve all of its tasks."""
    held = shared.enter("bpe_codec")
    if paths not in held:
        held[paths] = Codec(*paths)
    return held[paths]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _whole(codec: Codec, text: bytes, at: list[int]) -> list[tuple]:
    if SPECIAL in text:
        return [codec.chunk(text)]
    return codec.joined([text[a:b] for a, b in zip([0, *at], [*at, len(text)])]) if text else []


def encode(docs: DataFrame, *paths: str) -> DataFrame:
    """doc_id, ids, decoded of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*paths)
        for batch in batches:
            for piece, texts in chunks(batch):
                parts = [_whole(own, t, c) for t, c in zip(texts, cuts(texts))]
                yield rows(schema, doc_id=column(batch, "doc_id")[piece], ids=[[i for p in x for i in p[0]] for x in parts], decoded=[b"".join(p[2] for p in x).decode("utf-8", "replace") for x in parts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def query(docs: DataFrame, *paths: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*paths)
        for batch in batches:
            for piece, texts in chunks(batch):
                n, a, b = [], [], []
                for text, at in zip(texts, cuts(texts)):
                    parts = [p for p in _whole(own, text, at) if p[0]]
                    n.append(sum(len(p[0]) for p in parts))
                    a.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                yield rows(SCHEMA, doc_id=column(batch, "doc_id")[piece], n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
