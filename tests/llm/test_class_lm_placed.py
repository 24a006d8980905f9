import random

import numpy as np

from tomewise.llm import class_lm


def test_words_beyond_the_clustered_get_a_class_by_their_neighbours(spark, monkeypatch):
    # nouns and verbs take turns; all have one shape, and only six of forty are clustered
    monkeypatch.setattr(class_lm, "CLUSTERED", 6)
    monkeypatch.setattr(class_lm, "CLASSES", 2)
    models = []
    made = class_lm.ClassModel.__init__
    monkeypatch.setattr(class_lm.ClassModel, "__init__", lambda self, *a: (made(self, *a), models.append(self))[0])
    r = random.Random(4)
    nouns, verbs = [f"n{i:02}n" for i in range(20)], [f"v{i:02}v" for i in range(20)]
    heavy = [30] * 3 + [5] * 17
    rows = [(i, " ".join(r.choices((nouns, verbs)[k % 2], heavy)[0] for k in range(60))) for i in range(200)]
    got = class_lm.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 200
    (model,) = models
    frequent = model.frequent
    assert len(frequent.word) == 40 and not ((frequent.symbol >= frequent.clustered) & (frequent.symbol <= frequent.end)).any()
    of = {w: int(model.of[frequent.symbol[frequent.find(class_lm.Words([w.encode()]).hashes())[0][0]]]) for w in nouns + verbs}
    assert len({of[w] for w in nouns}) == len({of[w] for w in verbs}) == 1 and of[nouns[0]] != of[verbs[0]]
    # what a class emits adds up to at most one
    share = 10 ** (model.emit[frequent.symbol] + np.where(frequent.symbol >= frequent.clustered, model.log_count, 0))
    assert all(x < 1.001 for x in np.bincount(model.of[frequent.symbol], share))
