"""Similarity joins: what travels grows with documents and near pairs, not with pairs that share a rare term."""

import numpy as np
import pytest

from casebook.operators import dedup as D
from casebook.operators.components import connected_components
from casebook.plans import registry
from tests.test_splits import vectors


def near_copies(spark, n, words=200):
    """``n`` near copies of one text, each with a word or two of its own that one other text has."""
    g = np.random.default_rng(2)
    base = [f"b{x}" for x in range(words)]
    rows = [(i, " ".join([*base[: (k := int(g.integers(0, words)))], f"own{i // 2}", *base[k:]])) for i in range(n)]
    return spark.createDataFrame(rows, "uid long, text string")


def test_a_shared_rare_term_makes_no_candidate(spark):
    # one rare term for every two documents, and 60 more that are each document's and one other's
    rows = [(i, f"rare{min(i, j)}x{max(i, j)}", 2) for i in range(30) for j in range(30) if i != j]
    rows += [(i, "common", 30) for i in range(30)]
    x = [(u, t, 30**-0.5, df) for u, t, df in rows]
    packed = D.packed_vectors(spark.createDataFrame(x, "uid long, term string, w double, df long"))
    assert D.prefix_candidates(packed, 0.9).count() == 0  # 49 where the first shared term alone is looked at


def test_a_vector_goes_to_its_group_once(spark, monkeypatch):
    sizes = {}
    kept = D.written

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(D, "written", counted)
    n = 60
    pairs = D.packed_pairs(D.tfidf_packed(near_copies(spark, n)), 0.9)
    assert pairs.count() == n * (n - 1) // 2
    assert sizes["members"] == n  # not a row for each of 1,770 candidates


@pytest.mark.parametrize("group,block,cells", [(200, 500, 50), (1 << 20, 3_000, 700)])
def test_pairs_in_blocks_are_all_there(spark, monkeypatch, group, block, cells):
    df, want = vectors(spark, seed=3)
    monkeypatch.setattr(D, "GROUP_ENTRIES", group)
    monkeypatch.setattr(D, "BLOCK_ENTRIES", block)
    near = D._near
    monkeypatch.setattr(D, "_near", lambda threshold: near(threshold, cells))
    got = {(r.a, r.b): r.similarity for r in D.cosine_pairs(df, 0.9).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_are_verified_once(spark, sf_dir):
    plan = registry.queries()["neardup_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert made.value == 20


@pytest.fixture
def sizes(monkeypatch):
    found = {}
    kept = D.written

    def counted(df, name):
        out = kept(df, name)
        found.setdefault(name, out.count())
        return out

    monkeypatch.setattr(D, "written", counted)
    return found


def test_a_cluster_sends_each_text_once(spark, sizes):
    texts = near_copies(spark, 40, words=400)
    again = texts.unionByName(texts.selectExpr("uid + 100 AS uid", "text"))
    got = D.cluster_near_duplicates(again).collect()
    assert len(got) == 80 and {r.cluster_id for r in got} == {0}
    assert sizes["members"] == len({r.text for r in texts.collect()})  # not a row for each candidate, and none for copies


def test_splits_of_a_large_cluster(spark, sizes):
    other = spark.createDataFrame([(i, " ".join(f"z{i}w{x}" for x in range(40))) for i in range(500, 510)], "uid long, text string")
    texts = near_copies(spark, 40).unionByName(other)
    flagged = spark.createDataFrame([(3,), (505,)], "uid long")
    got = {r.uid: r.split for r in D.make_splits(texts, flagged, texts.selectExpr("uid", "'L' AS label"), {"train": 0.7, "val": 0.15, "test": 0.15}).collect()}
    assert len(got) == 48 and len({got[i] for i in range(40) if i != 3}) == 1
    assert sizes["members"] == 39


def test_flagged_studies_shuffle_no_text(spark, monkeypatch):
    plans = []

    def seen(texts, *rest):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return texts.selectExpr("uid", "uid AS cluster_id")

    monkeypatch.setattr(D, "cluster_near_duplicates", seen)
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "uid long, text string")
    flagged = spark.range(4_000_000).where("id % 1000000 = 3").selectExpr("id AS uid")
    got = D.make_splits(texts, flagged, texts.selectExpr("uid", "'L' AS label"), {"train": 0.7, "val": 0.15, "test": 0.15})
    assert "SortMergeJoin" not in plans[0] and "hashpartitioning(uid" not in plans[0]
    assert sorted(r.uid for r in got.collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
