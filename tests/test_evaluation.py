"""Ranking evaluation by counting against whole rankings."""

import numpy as np
import pytest

from casebook.operators import evaluation as E

KS = (1, 3, 10)


def whole(order, rel):
    """Metrics of one query from the relevance of all cases in order."""
    ranked, ideal = rel[order], np.sort(rel)[::-1]
    hits = np.flatnonzero(ranked > 0)
    dcg = lambda x: float((x / np.log2(np.arange(2, len(x) + 2))).sum())
    out = {"mrr": 1 / (hits[0] + 1) if len(hits) else 0.0}
    for k in KS:
        out |= {f"recall@{k}": float((ranked[:k] > 0).any()), f"precision@{k}": float((ranked[:k] > 0).sum() / k), f"ndcg@{k}": dcg(ranked[:k]) / dcg(ideal[:k]) if dcg(ideal[:k]) > 0 else 0.0}
    return out


def tables(spark, n_kb, n_q, seed=0):
    g = np.random.default_rng(seed)
    kb, q = g.standard_normal((n_kb, 6)).round(1), g.standard_normal((n_q, 6)).round(1)  # rounded: ties
    # a label that half of all cases hold, some rare ones, a label that no case holds, and cases without any
    labels = lambda n: [sorted({x for x, p in (("half", 0.5), ("some", 0.1), ("rare", 0.01)) if g.random() < p}) for _ in range(n)]
    kl, ql = labels(n_kb), labels(n_q)
    ql[0], ql[1] = ["unknown"], []
    ql[2] = ["rare"]
    kl[-1] = ["rare"]
    df = lambda rows, name: spark.createDataFrame(rows, name)
    vec = lambda m, base: [(base + i, v.tolist()) for i, v in enumerate(m)]
    lab = lambda ls, base: [(base + i, x) for i, row in enumerate(ls) for x in row]
    return kb, q, kl, ql, df(vec(q, 10_000), "uid long, embedding array<double>"), df(vec(kb, 0), "uid long, embedding array<double>"), df(lab(ql, 10_000), "uid long, label string"), df(lab(kl, 0), "uid long, label string")


def close(got, want):
    assert got.keys() == want.keys()
    for q, m in want.items():
        for name, v in m.items():
            assert got[q][name] == pytest.approx(v, abs=1e-9), (q, name)


def test_cosine_metrics(spark):
    kb, q, kl, ql, *sides = tables(spark, 331, 25)
    got = {r.query: r.asDict() for r in E.cosine_metrics(*sides, KS).collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(unit(q) @ unit(kb).T, 9)
    want = {10_000 + i: whole(np.lexsort((np.arange(331), -s[i])), np.array([len(set(ql[i]) & set(x)) for x in kl])) for i in range(25)}
    close({k: {n: v for n, v in m.items() if n != "query"} for k, m in got.items()}, want)
    seen = E.cosine_ranks(*sides, 10)
    assert seen.where("rank > 10").groupBy("query").count().where("count > 1").count() == 0  # beyond k, the first relevant one alone


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 331, 1023])
def test_random_order_is_a_permutation(n):
    for query in (0, 17, 2**40 + 3):
        ids = np.full(n, query)
        there = E.permuted(np.arange(n), n, ids, 3)
        assert sorted(there) == list(range(n))
        assert (E.permuted(there, n, ids, 3, inverse=True) == np.arange(n)).all()
    if n > 100:
        a, b = (E.permuted(np.arange(n), n, np.full(n, 5), s) for s in (1, 2))
        assert (a == b).mean() < 0.05 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.2


def test_random_metrics(spark):
    kb, q, kl, ql, *sides = tables(spark, 331, 25, 2)
    got = {r.query: {n: v for n, v in r.asDict().items() if n != "query"} for r in E.random_metrics(*sides, KS, (1, 2, 3)).collect()}
    want = {}
    for i in range(25):
        rel = np.array([len(set(ql[i]) & set(x)) for x in kl])
        runs = [whole(E.permuted(np.arange(331), 331, np.full(331, 10_000 + i), s), rel) for s in (1, 2, 3)]
        want[10_000 + i] = {m: np.mean([r[m] for r in runs]) for m in runs[0]}
    close(got, want)


def test_links_follow_sets(spark):
    *_, q_labels, kb_labels = tables(spark, 3_000, 40)
    links = E.relevance_links(q_labels, kb_labels)
    assert links.count() <= 8 * 8
    pairs = E.relevance_pairs(q_labels, kb_labels, block=100)
    want = q_labels.withColumnRenamed("uid", "query").join(kb_labels, "label").groupBy("query", "uid").count()
    assert pairs.count() == want.count() and pairs.join(want, ["query", "uid"]).where("relevance <> count").count() == 0
