"""URL filter: rules first, then gradient-boosted trees on lexical features.

URLs that a rule decides are the labelled ones. The share of blocked URLs of each top-level suffix, smoothed, is counted
over all labelled URLs and joined to every URL; for a labelled one its own row is left out. The trees learn from the
features of a sample of the labelled URLs, FIT_ROWS in expectation; only features come to the driver, not URLs. URLs that no rule
fits get the trees' verdict.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged by the trees; where no URL
is labelled every other URL is allowed, and where all labels are one kind the trees give it to every URL; of rules of
one length that fit, the first given wins; rows that repeat a page_id, a null one too, are judged row by row; columns
besides page_id and url are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boost import BoostedTrees
from .shared import column, rows

FIT_ROWS = 20_000  # labelled URLs, in expectation, that the trees are fitted on
SMOOTHING = 20.0  # URLs of the overall share that each suffix has besides its own

# The rules, each an action and a host with the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and action of the longest rule that fits."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last that fits stands
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return out.withColumn("rule", rule).withColumn("action", action)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def features(url: str | None, host: str, path: str, share: float) -> list[float]:
    url = url or ""
    n = max(len(url), 1)
    counts = np.bincount(np.frombuffer(url.encode("utf-8", "replace") or b"\0", np.uint8))
    p = counts[counts > 0] / counts.sum()
    query = url.partition("#")[0].partition("?")[2]
    parts = [x for x in path.split("/") if x]
    labels = host.split(".")
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(parts), len(labels), digits / n, sum(c.isdigit() for c in host), float(-(p * np.log2(p)).sum()),
        query.count("=") + query.count("&"), len(query), url.count("-"), host.count("-"), url.count("_"), url.count("%"), float(url.startswith("https")), float("#" in url),
        max(map(len, labels)), len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0, float("." in parts[-1]) if parts else 0, float(labels[0] in ("www", "m", "blog")), share,
    ]


def with_shares(found: DataFrame) -> DataFrame:
    """found with share: of the labelled URLs of its suffix those that are blocked, its own row left out; null without labelled URLs."""
    label = F.when(F.col("action").isNotNull(), (F.col("action") == "block").cast("long"))
    found = found.withColumn("suffix", suffix_of(F.col("host"))).withColumn("label", label)
    counts = found.groupBy("suffix").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    overall = counts.agg(F.expr("sum(b) / nullif(sum(n), 0)").alias("overall"))  # one row, joined as such
    out = found.join(counts, "suffix", "left").crossJoin(F.broadcast(overall))
    own = "if(label is null, 0, {})"
    return out.withColumn("share", F.expr(f"(b - {own.format('label')} + {SMOOTHING} * overall) / (n - {own.format('1')} + {SMOOTHING})")).drop("suffix", "n", "b", "overall")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("x", pa.binary()), ("y", pa.int64())])
    for batch in batches:
        found = zip(*(column(batch, k).to_pylist() for k in ("url", "host", "path", "share")))
        yield rows(schema, x=[np.array(features(*f), np.float64).tobytes() for f in found], y=column(batch, "label"))


def fit(found: DataFrame) -> BoostedTrees | None:
    """Trees over the labelled rows of found, which has shares; None where no row is labelled."""
    labelled = found.where("label is not null")
    n = labelled.count()
    if not n:
        return None
    some = labelled.where((F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) / (1 << 20)) < min(1.0, FIT_ROWS / n)).select("url", "host", "path", "share", "label")
    some = sorted((bytes(r.x), r.y) for r in some.mapInArrow(_features, "x binary, y long").collect())
    if not some:
        return None
    order = np.random.default_rng(5).permutation(len(some))
    x, y = np.stack([np.frombuffer(some[i][0]) for i in order]), np.array([some[i][1] for i in order], float)
    apart = np.arange(len(y)) % 5 == 4
    if all(0 < y[part].sum() < part.sum() for part in (apart, ~apart)):
        return BoostedTrees(rounds=80).fit(x[~apart], y[~apart]).calibrate(x[apart], y[apart])
    return BoostedTrees(rounds=80).fit(x, y)  # too few of a kind for a part of their own


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block; null where a rule decides)."""
    found = with_shares(ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), rules))
    told = pages.sparkSession.sparkContext.broadcast(fit(found))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path, share, verdict = (column(batch, k).to_pylist() for k in ("url", "host", "path", "share", "action"))
            score: list[float | None] = [None] * len(url)
            asked = [i for i, v in enumerate(verdict) if v is None]
            trees = told.value
            found = trees.predict(np.array([features(url[i], host[i], path[i], share[i]) for i in asked])) if trees and asked else np.zeros(len(asked))
            for i, p in zip(asked, found.tolist()):
                score[i], verdict[i] = p, "block" if p >= 0.5 else "allow"
            yield rows(schema, page_id=column(batch, "page_id"), host=host, path=path, rule=column(batch, "rule"), verdict=verdict, score=score)

    return found.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


query = judge
