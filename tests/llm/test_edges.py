"""Each operator on nulls in any column, empty and very long texts, repeated rows, ties, clashing columns and empty tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomewise.llm import bpe_codec, class_lm, decontaminate, jaccard_join, language_id, license_scan, pii, quality_rules, token_files, url_filter
from tomewise.llm.queries import bpe_paths, tokenizer_path

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"passage{i}" for i in range(30))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, LONG, "en", None), (5, f"{PASSAGE} mail a.b@c.example.com Released under the MIT License.", "en", "b"),
    (6, "the same text in two rows of one id and one more", "en", "b"), (6, "the same text in two rows of one id and one more", "en", "b"), (6, "the same id with another text of its own here", None, "b"),
    (None, f"a null id {PASSAGE}", "en", "b"), (None, None, None, None), (7, "one", "de", "c"), (8, "one", "de", "c"), (9, "é日本 😀 \x00", "de", "c"),
]
#: names that the operators use themselves
CLASHING = ("n", "fp", "h", "host", "ids", "key", "bucket", "w", "own", "part", "row", "label", "share", "block", "failed", "words", "kind", "learn", "held_out", "bands", "tokens", "n_chars")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit("x") if c != "n_chars" else F.lit(None).cast("long") for c in CLASHING})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (None, "a passage of a null id that no document holds at all", "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, n string")


PER_ROW = {
    "op1": class_lm.query, "op3": lambda d: token_files.query(d, tokenizer_path("word_bpe_49k.json")), "op4": quality_rules.judge, "op5": pii.query,
    "op6": lambda d: bpe_codec.query(d, *bpe_paths()), "op7": language_id.query, "op8": jaccard_join.join,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_per_row(spark, docs, name):
    got = PER_ROW[name](docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    same = [tuple(v for k, v in r.asDict().items() if k != "start") for r in got if r.doc_id == 6]
    assert max(Counter(same).values()) >= 2  # rows that are equal get equal answers
    assert PER_ROW[name](docs.where("false")).count() == 0


def test_leaks(docs, bench):
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1), (5, 1)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == len(ROWS)


def test_a_passage_without_an_id_counts(spark, docs):
    one = spark.createDataFrame([(None, PASSAGE)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, one).collect()) == [(0, None), (5, None)]
    assert decontaminate.clean(docs, one).count() == len(ROWS) - 2


def test_rewriting_stages_keep_columns(docs):
    known = language_id.keep_known(docs, language_id.fit(docs.select("doc_id", "text", "lang"), F.lit(True)), 0.0)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} >= {4, 5, 6}
    clean = pii.redact(docs, pii.fit(docs.select("doc_id", "text")))
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert "[EMAIL]" in clean.where("doc_id = 5").first().text


def test_licenses(docs):
    assert [(r.doc_id, r.license) for r in license_scan.scan(docs).collect()] == [(5, "MIT")]
    assert license_scan.scan(docs.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "http://a.com/en/" + "x/" * 20_000), (4, "http://b.net/fr/1"), (4, "http://b.net/fr/1"), (None, "x://c.org/es/"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASHING})
    got = url_filter.query(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows) and {r.verdict for r in got} <= {"allow", "block"}
    assert {r.rule for r in got} == {None, "com/en/", "org/es/"} and len({tuple(r) for r in got if r.page_id == 4}) == 1
    assert url_filter.query(pages.where("false")).count() == 0
    tie = url_filter.ruled(spark.createDataFrame([(1, "http://x.com/aa")], "page_id long, url string"), (("allow", "com/a"), ("block", "com/a"))).first()
    assert tie.action == "allow"
    free = url_filter.query(pages.where("url like '%net%'")).collect()  # no labelled URL
    assert {r.verdict for r in free} == {"allow"}


def test_url_shares_leave_the_own_row_out(spark):
    urls = [f"http://h{i}.{('com', 'net')[i % 2]}/{('en', 'de')[i % 2]}/x" for i in range(50)] + ["http://a.zz/1", "http://only.com/en/"]
    found = url_filter.with_shares(url_filter.ruled(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"))).collect()
    label = {r.page_id: r.label for r in found}
    suffix = {i: re.sub("^.*://[^/]*[.]|/.*$", "", u) for i, u in enumerate(urls)}
    known = [v for v in label.values() if v is not None]
    overall = sum(known) / len(known)
    for r in found:
        others = [label[i] for i in label if suffix[i] == suffix[r.page_id] and i != r.page_id and label[i] is not None]
        assert abs(r.share - (sum(others) + url_filter.SMOOTHING * overall) / (len(others) + url_filter.SMOOTHING)) < 1e-9


def test_license_windows_meet_their_bound():
    # the chance that one common shingle is hidden in both of its windows, by simulation of its hash and its neighbours'
    import numpy as np

    r = np.random.default_rng(0)
    bins, trials = 1 << license_scan.BINS_LOG2, 400_000
    own, others = r.random(trials) * bins, r.random((2, license_scan.WINDOW - 1, trials)) * bins
    hidden = ((np.floor(others) == np.floor(own)) & (others < own)).any(axis=1).all(axis=0)
    assert hidden.mean() <= license_scan.miss(1) * 1.5 and license_scan.miss(5) < 1e-15
