import random
import re

from tomewise.llm import jaccard_join


def brute(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=240, seed=3):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows, passage = [], " ".join(r.choices(vocabulary, k=40))
    for i in range(n):
        if rows and r.random() < 0.6:
            w = (rows[r.randrange(len(rows))][1] or "a").split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 5, 30, 80, 200])))
            if r.random() < 0.5:
                text += "\n" + passage
        rows.append((i * 3 + 1, text if r.random() < 0.97 else None))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_split_blocks_and_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SPLIT", 8)
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    check(spark, corpus(200, 5))


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies that few of their fellows link with, and neighbours just under the threshold, over several rounds."""
    monkeypatch.setattr(jaccard_join, "FIRST_ASK", 1)
    monkeypatch.setattr(jaccard_join, "MORE", 2)
    monkeypatch.setattr(jaccard_join, "SPLIT", 16)
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(3000)]
    base, rows = r.choices(vocabulary, k=120), []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((1000 - i, " ".join(w)))
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (7, "a b c d e"), (8, "Éa b c d e"), (9, "éa b c d e")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(jaccard_join.join(again).collect(), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None)], key=str)


def test_tree_search_is_complete():
    import numpy as np

    r = np.random.default_rng(1)
    points = r.poisson(2, (300, jaccard_join.GROUPS))
    points[150:] = points[:150] + r.integers(0, 2, (150, jaccard_join.GROUPS))
    n = points.sum(axis=1)
    tree = jaccard_join.RTree(n, points)
    for i in range(0, 300, 7):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(axis=1) >= jaccard_join.needed(n[i], n))
        assert sorted(tree.search(int(n[i]), points[i])[0].tolist()) == want.tolist()
