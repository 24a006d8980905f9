"""Operators on the driver's tables against plain versions, and held-out or planted figures."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from tomewise.llm import class_lm, decontaminate, language_id, pii, url_filter
from tomewise.llm.shared import Words

SF = "/root/testdata/sf0.01"


def test_score_is_the_probability_of_the_model(spark, monkeypatch):
    """Class bigrams counted anew from the texts, with the classes that the model found."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 200)
    models, made = [], class_lm.ClassModel.__init__
    monkeypatch.setattr(class_lm.ClassModel, "__init__", lambda self, *a: (made(self, *a), models.append(self))[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in class_lm.query(docs).collect()}
    (model,), texts = models, {r.doc_id: r.text or "" for r in docs.collect()}
    frequent, end = model.frequent, "</s>"

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))

    vocabulary = sorted({w for t in texts.values() for w in words(t)})
    told = Words([w.encode() for w in vocabulary])
    at, known = frequent.find(told.hashes())
    symbol = {w: int(frequent.symbol[a]) if k else frequent.clustered + int(s) for w, a, k, s in zip(vocabulary, at, known, class_lm.shapes(told))}
    of = {w: int(model.of[s]) for w, s in symbol.items()} | {end: int(model.of[frequent.end])}
    train = [words(texts[i]) for i in texts if not got[i].held_out]
    count = Counter(w for t in train for w in t)
    pairs, into, out = Counter(), Counter(), Counter()
    for t in train:
        for a, b in zip([end, *t], [*t, end]):
            pairs[of[a], of[b]] += 1
            into[of[b]] += 1
            out[of[a]] += 1
    total, classes = sum(into.values()), len(model.step)
    alone = {c: (into[c] + 0.5) / (total + 0.5 * classes) for c in range(classes)}
    assert abs(sum(alone.values()) - 1) < 1e-9
    of_shape, in_class = defaultdict(list), defaultdict(float)
    for w in count:
        if symbol[w] < frequent.clustered:
            in_class[of[w]] += count[w]
        elif symbol[w] > frequent.end:
            in_class[of[w]] += count[w] + 0.5
        else:
            of_shape[of[w]].append(count[w])

    def emission(w):
        if w == end:
            return 1.0
        if symbol[w] < frequent.clustered:
            return count[w] / in_class[of[w]]
        if symbol[w] > frequent.end:
            return (count[w] + 0.5) / in_class[of[w]]
        own = of_shape[of[w]]
        return (count[w] + 0.5) / (sum(own) + 0.5 * (len(own) + 1))

    for i, t in texts.items():
        want, before = 0.0, end
        for w in [*words(t), end]:
            step = (pairs[of[before], of[w]] + classes * alone[of[w]]) / (out[of[before]] + classes)
            want += math.log10(step * emission(w))
            before = w
        assert abs(got[i].score - want) < 1e-6 * max(1, abs(want)), i
    # each class' words, with one for all that were never seen in a class by shape, and the classes after a class, add up to one
    sums = defaultdict(float)
    for w in count:
        sums[of[w]] += emission(w)
    for c, own in of_shape.items():
        sums[c] += 0.5 / (sum(own) + 0.5 * (len(own) + 1))
    assert all(abs(x - 1) < 1e-9 for x in sums.values())
    assert np.allclose((10**model.step).sum(axis=1), 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_leaks_without_a_latent_space(spark):
    """Every window at the operator's strides that holds 0.4 of a passage's words goes through the operator's last check."""
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    passages = decontaminate.Passages(items)
    check = decontaminate.Searcher.verify
    holder = type("Holder", (), {"words": [w.tolist() for w in passages.words]})()
    sets, sizes = [set(w) for w in holder.words], passages.strides
    want = set()
    for r in docs.select("doc_id", "text").collect():
        h = decontaminate.words_of([(r.text or "").encode()]).hashes().tolist()
        own = set(h)
        for k, item in enumerate(passages.ids):
            if len(sets[k] & own) < 0.4 * len(sets[k]):
                continue
            size = int(sizes[k]) * decontaminate.STRIDE
            for a in range(0, max(1, len(h)), decontaminate.STRIDE):
                window = h[a : a + size]
                if len(sets[k].intersection(window)) >= 0.4 * len(sets[k]) and check(holder, k, window):
                    want.add((r.doc_id, item))
                    break
    assert want and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(got)


def test_secrets_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.query(docs).collect()}
    wanted = covered = noisy = clean = 0
    for i, t in texts.items():
        secrets = pii.credentials(t)
        wanted += len(secrets)
        covered += sum(any(int(a) <= x and y <= int(b) for _, a, b in found[i]) for x, y in secrets)
        if not secrets and not pii.base_spans(t):
            clean += 1
            noisy += bool(found[i])
    assert wanted >= 100 and covered >= 0.9 * wanted and noisy <= 0.02 * clean


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.where("text is not null and lang is not null").select("doc_id", "lang").collect()}
    held = [r for r in language_id.query(docs).collect() if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(held) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_rules_of_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in url_filter.query(pages).collect()}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for r in pages.select("page_id", "url").collect():
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(low)
        best = None
        for action, rule in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (action, rule)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, best and best[1]) and (best is None or g.verdict == best[0])
