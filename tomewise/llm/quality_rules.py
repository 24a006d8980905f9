"""Quality rules with a verdict on the host.

Each text is measured once; rules fail or pass it. By host (`source`) the failures are summed, and the failure rate is
shrunk towards all hosts by a beta prior fitted to the hosts' counts: its mean is the overall rate, and its spread is
what the hosts' rates vary beyond binomial noise, so hosts of few documents tell nothing by chance. A host is trusted
where its shrunk rate is clearly under the prior's mean, and distrusted where it is clearly over it: by CLEAR standard
deviations of the posterior and by MARGIN of the mean. The verdict goes back to the host's documents: one that breaks
a soft rule stays on a trusted host, one that breaks half of a soft rule's limit goes on a distrusted one.

Defined results: a null or empty text has no words and fails; null is a host of its own; rows that repeat a doc_id, a
null one too, are judged and counted row by row; measures are of the whole text; of other columns only the host is
read; an empty table gives an empty result; where all hosts fail alike none is trusted or distrusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _SHINGLE, Words, chunks, column, mix, rows

WINDOW = 8  # words of a window that must not repeat
MIN_WORDS = 20
MAX_REPEAT = 30  # per cent of the words in repeated windows
MAX_SYMBOLS = 10  # soft: symbols per hundred words
MAX_DUP_LINES = 30  # soft: per cent of the lines
WORD_LENGTH = (2, 15)  # soft: mean code points of a word
CLEAR = 1.645  # standard deviations of a host's posterior between its rate and the prior's mean
MARGIN = 0.1  # and the least difference, as a share of the mean
STRICT = 0.5  # of the soft rules' limits, for documents of distrusted hosts
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(texts, lower=False)
    h = words.hashes()
    n = np.diff(words.first)
    starts = (words.buf & 0xC0) != 0x80  # bytes that begin a code point
    points = np.concatenate([[0], np.cumsum(starts)])
    of_word = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.buf])])
    windows = np.zeros(max(0, len(h) - WINDOW + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            windows += h[j : j + len(windows)] * _SHINGLE[j]
    windows = mix(windows)
    repeat, dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b - a > WINDOW:
            own = windows[a : b - WINDOW + 1]
            order = np.argsort(own, kind="stable")
            same = own[order][1:] == own[order][:-1]
            if same.any():
                twice = np.zeros(len(own), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                cover = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(twice)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
                repeat[i] = np.count_nonzero(np.cumsum(cover[:-1]))
        found = texts[i].split(b"\n")
        if len(found) > 1:
            found = [x for x in found if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(found) - len(set(found))
            lines[i] = len(found)
        else:
            lines[i] = b > a
    return {"n_words": n, "word_chars": np.diff(of_word[words.first]), "n_symbols": np.diff(symbols[words.at]), "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((m, pa.int64()) for m in MEASURES)])
    for batch in batches:
        for piece, texts in chunks(batch):
            yield rows(schema, doc_id=column(batch, "doc_id")[piece], host=column(batch, "host")[piece], **measure(texts))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    ddl = ", ".join(["doc_id long", "host string", *(f"{m} long" for m in MEASURES)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text").mapInArrow(_measure, ddl)


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")


def soft_failed(limits: float = 1.0) -> Column:
    low, high = WORD_LENGTH
    return F.expr(f"100 * n_symbols > {limits * MAX_SYMBOLS} * n_words or 100 * n_dup_lines > {limits * MAX_DUP_LINES} * n_lines or word_chars < {low} * n_words or word_chars > {high} * n_words")


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Per host: n, n_failed, rate (shrunk), prior_mean and verdict (trusted, distrusted or neither); judged has host and failed."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    # moments of the hosts' counts; one row, joined as such
    prior = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum(F.expr("double(n) * n")).alias("squares"), (F.sum("n_failed") / F.sum("n")).alias("m"), F.sum(F.expr("double(n_failed) * n_failed / n")).alias("spread"))
    # what the hosts differ by, without the variance that equal hosts would show
    prior = prior.withColumn("beyond", F.expr("(spread - docs * m * m - (hosts - 1) * m * (1 - m)) / nullif(docs - squares / docs, 0)"))
    prior = prior.withColumn("k", F.expr("if(coalesce(beyond, 0) > 0, greatest(m * (1 - m) / beyond - 1, 0.001), 1e6)")).select("m", "k")
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", F.expr("(n_failed + m * k) / (n + k)"))
    shrunk = shrunk.withColumn("apart", F.expr(f"greatest({CLEAR} * sqrt(rate * (1 - rate) / (n + k + 1)), {MARGIN} * m)"))
    verdict = F.expr("case when rate < m - apart then 'trusted' when rate > m + apart then 'distrusted' else 'neither' end")
    return shrunk.select("host", "n", "n_failed", "rate", F.col("m").alias("prior_mean"), verdict.alias("verdict"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, host_rate and host_verdict of each row."""
    from .shared import Scratch

    scratch = Scratch(docs.sparkSession, "quality")
    found = measured(docs, host).withColumn("base_failed", base_failed()).withColumn("soft", soft_failed()).withColumn("strict", soft_failed(STRICT)).withColumn("failed", F.expr("base_failed or soft"))
    found = scratch.table(found, "measured")
    hosts = host_verdicts(found).select(F.col("host").alias("h"), "verdict", F.col("rate").alias("host_rate"))
    out = found.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    kept = F.expr("not base_failed and case verdict when 'trusted' then true when 'distrusted' then not strict else not soft end")
    return out.select("doc_id", *MEASURES[:-1], "base_failed", kept.alias("kept"), "host_rate", F.col("verdict").alias("host_verdict"))
