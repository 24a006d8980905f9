import random

from tomewise.llm import jaccard_join, shared

from tests.llm.test_jaccard_join import check


def test_copies_out_of_reach_do_not_meet(spark, monkeypatch):
    """Copies whose changes come first in the order and leave too little for any link: most places in blocks go."""
    kept, counts = shared.Scratch.table, {}

    def table(self, df, name):
        out = kept(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(shared.Scratch, "table", table)
    r = random.Random(4)
    base, rows = ["w%d" % i for i in range(200)], []
    for i in range(60):
        w = list(base)
        for k in range(17):
            w[11 * k + 5 + r.randrange(5)] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    check(spark, rows)
    assert 4 * counts["members"] < counts["bands"]  # each node stands in two bands, of which one is left of equal ones


def test_reach():
    for n in range(1, 200):
        reach = jaccard_join.reaches(n)
        assert len(reach) == jaccard_join.prefix_length(n)
        for p, most in enumerate(reach.tolist()):
            linked = [m for m in range(1, 2 * n) if 100 * min(n - p, m) >= 75 * (n + m - min(n - p, m))]
            assert max(linked, default=0) <= most
