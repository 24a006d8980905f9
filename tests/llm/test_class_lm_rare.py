import random

import numpy as np
import pytest

from tomewise.llm import class_lm


@pytest.mark.parametrize("known", [1, 30, 200])
def test_words_that_are_not_known_everywhere_have_the_same_classes(spark, monkeypatch, known):
    """The bound of the words known everywhere changes no result: rarer words get their classes in a shuffle."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 6)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    r = random.Random(4)
    kinds = [[f"{k}{i:02}{k}" for i in range(30)] for k in "nva"]
    heavy = [40] * 2 + [2] * 28
    rows = [(i, " ".join("only%d" % r.randrange(10**9) if r.random() < 0.05 else r.choices(kinds[k % 3], heavy)[0] for k in range(r.randrange(50)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "n00n v05v a09a unseen"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(class_lm.query(docs).collect(), key=str)
    models, made = [], class_lm.ClassModel.__init__
    monkeypatch.setattr(class_lm.ClassModel, "__init__", lambda self, *a: (made(self, *a), models.append(self))[0])
    monkeypatch.setattr(class_lm, "MAX_FREQUENT", known)
    monkeypatch.setattr(class_lm, "FLUSH", 400)
    got = sorted(class_lm.query(docs).collect(), key=str)
    assert 6 <= len(models[0].frequent.word) < 90  # others are known in their bucket only
    assert len(got) == len(want) == len(rows)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_counts_of_neighbours_beyond_a_byte(spark, monkeypatch):
    """One task's counts of a word and a class travel in a byte where they fit; cut over many tasks they all do."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 3)
    monkeypatch.setattr(class_lm, "CLASSES", 3)
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(r.choices("nva"[k % 3] + "012", [9, 3, 3, 3])[0] + "x" for k in range(60))) for i in range(200)], "doc_id long, text string")
    frequent = class_lm.Frequent(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    told = spark.sparkContext.broadcast((frequent, np.arange(frequent.end + 1), np.zeros((frequent.end + 1,) * 2)))
    wide = [sum(len(x.many) for x in docs.repartition(k, "doc_id").select("text").mapInArrow(class_lm._neighbours(told, 8), class_lm.NEAR).collect()) for k in (1, 60)]
    assert wide[0] > 0 == wide[1]
    one, many = (sorted(class_lm.query(docs.repartition(k, "doc_id")).collect(), key=str) for k in (1, 60))
    for g, w in zip(one, many):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
