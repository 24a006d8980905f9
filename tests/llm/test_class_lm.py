import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tomewise.llm import class_lm


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def base(rows):
    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    end = len(train)
    n, v = sum(c.values()) + end, len(c) + (end > 0)
    out = {}
    for i, t in rows:
        counts = [c[w] for w in words(t)] + [end]
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(counts), sum(x > 0 for x in counts), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts))
    return out


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "FLUSH", 500)
    r = random.Random(1)
    follow = {w: r.sample("the of and in a to be is it on".split(), 3) for w in "the of and in a to be is it on".split()}
    rows = []
    for i in range(150):
        w, t = "the", []
        for _ in range(r.randrange(0, 120)):
            w = r.choice(follow.get(w, ["the"])) if r.random() < 0.9 else "rare%d" % r.randrange(300)
            t.append(w.title() if r.random() < 0.1 else w)
        rows.append((i, " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in class_lm.query(df).collect()}
    want = base(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, score) in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held, n, known, total)
        assert abs(g.base_score - score) < 1e-6 * max(1, abs(score)) and math.isfinite(g.score) and g.score <= 0
    held = [i for i in want if want[i][0]]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_exchange_finds_classes():
    # words 0-3 are always followed by words 4-7 and the other way round
    pairs = np.zeros((9, 9), int)
    r = np.random.default_rng(0)
    pairs[:4, 4:8] = r.integers(5, 40, (4, 4))
    pairs[4:8, :4] = r.integers(5, 40, (4, 4))
    of = class_lm.exchange(pairs, 8, classes=2)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4]


def test_empty(spark):
    assert class_lm.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = class_lm.query(spark.createDataFrame([(None, "a b"), (7, "a")], "doc_id long, text string")).collect()
    assert len(one) == 2 and all(math.isfinite(r.score) for r in one)
