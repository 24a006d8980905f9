import hashlib
import random
import re

import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from tests.llm.test_operators import plain_spans
from tomewise.llm import decontaminate
from tomewise.llm.queries import tokenizer_path

WORDS = {"aa": "banana mango papaya guava lychee".split(), "bb": "kirsche pflaume zwetschge quitte birne".split()}


def corpus():
    r = random.Random(7)
    word = lambda lang: "".join(r.sample(r.choice(WORDS[lang]), 4)) + r.choice(WORDS[lang])
    passages = [" ".join(word("aa") for _ in range(25)) for _ in range(4)]
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        rows.append([i, " ".join(word(lang) for _ in range(r.randrange(30, 80))), lang])
    for i in range(0, 12, 3):
        rows[i][1] += "\n" + passages[i // 3]  # a leak
    for i in range(20, 30):
        rows[i][1] += f" write to someone{i}@mail.example.com or call +1 555 010 {1000 + i}, from 10.0.0.{i}"
    for i in range(40, 46):
        rows.append([500 - i, rows[i][1], "aa"])  # exact copies
        w = rows[i][1].split()
        rows.append([600 - i, " ".join([*w[:-1], "other"]), "bb"])  # near ones
    rows += [[700, None, "aa"], [701, "", "bb"], [702, "12 34 ++", None]]
    rows += [[800, rows[50][1] + " x", "aa"], [800, " ".join(word("bb") for _ in range(40)), "bb"], [801, " ".join(word("aa") for _ in range(40)), "aa"]]
    rows += [rows[-1], [None, rows[51][1], "bb"]]
    return [tuple(x) for x in rows], passages


def plain(rows, passages):
    """The stages, one row after another."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    key = {n: n for n in range(len(rows))}
    order = sorted(key, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    # numbers in the order of doc_id stand in for rows, so that the brute force can tell those of one id apart
    found = brute([(k, rows[n][1]) for k, n in enumerate(order) if rows[n][0] is not None])
    kept, seen = [], set()
    for k, n in enumerate(order):
        if rows[n][0] is None or rows[order[found[k][1]]][0] == rows[n][0] and (rows[n][0], found[k][1]) not in seen:
            kept.append(rows[n])
            if rows[n][0] is not None:
                seen.add((rows[n][0], found[k][1]))
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())

    def leaks(text):
        w = words(text)
        for p in map(words, passages):
            if any(decontaminate.lcs(p, w[a : a + len(p) + 16]) >= 0.6 * len(p) for a in range(max(1, len(w) - len(p) + 1))):
                return True
        return False

    out = []
    for i, t, _ in kept:
        if not leaks(t):
            for kind, a, b in sorted(plain_spans(t), key=lambda s: -s[1]):
                t = t[:a] + f"[{kind.upper()}]" + t[b:]
            out.append((i, t))
    return out


def test_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, passages = corpus()
    spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(passages)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, t in plain(rows, passages):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_on_the_smallest_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == before
