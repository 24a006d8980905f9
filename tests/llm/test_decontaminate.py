import numpy as np

from tomewise.llm import decontaminate


def test_exact_copies_of_many_passages(spark, monkeypatch):
    # more passages than dimensions: each exact copy is found, whatever its share of the latent space
    monkeypatch.setattr(decontaminate, "RANK", 16)
    r = np.random.default_rng(5)
    vocabulary = ["".join(r.choice(list("abcdefghijklmnop"), 7)) for _ in range(3000)]
    word = lambda n: r.choice(vocabulary, n).tolist()
    items = [" ".join(word(30)) for _ in range(80)]
    rows = [(i, " ".join([*word(int(r.integers(0, 200))), t.upper(), *word(90)])) for i, t in enumerate(items)]
    df = spark.createDataFrame(rows + [(900, " ".join(word(300)))], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(i, i) for i in range(80)}
    assert all(x.lcs_ratio == x.answer_ratio == 1 and 0 < x.cosine < 1.001 for x in got.values())
    assert [x.doc_id for x in decontaminate.clean(df, bench).collect()] == [900]


def test_blocks_hold_no_more_passages_than_dimensions(spark):
    n = 3 * decontaminate.RANK - 20
    found = list(decontaminate.blocks(spark.range(n).selectExpr("id item_id", "concat('text ', id) text")))
    assert max(map(len, found)) <= decontaminate.RANK
    assert sorted(i for b in found for i, _ in b) == list(range(n))
