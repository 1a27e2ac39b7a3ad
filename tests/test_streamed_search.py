"""Nearest cases stream past blocks of queries: against brute force, with ties, and within bounded memory."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from casebook.operators import retrieval


def vectors(spark, uids, m):
    return spark.createDataFrame([(int(u), [float(x) for x in row]) for u, row in zip(uids, m)], "uid long, embedding array<float>")


def brute(q_ids, q, ids, m, k, allowed=None):
    q, m = q.astype(np.float32).astype(float), m.astype(np.float32).astype(float)
    s = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)) @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).T
    out = set()
    for i, u in enumerate(q_ids):
        fit = [j for j in range(len(ids)) if ids[j] != u and (allowed is None or allowed[i, j])]
        for r, j in enumerate(sorted(fit, key=lambda j: (-round(s[i, j], 9), ids[j]))[:k], 1):
            out.add((int(u), int(ids[j]), r))
    return out


def made(n, seed, d=16):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d))
    m[: n // 3] = m[0]  # a large group of equal vectors: ties go to the smallest uid
    m[n - 1] = 0
    return m


@pytest.mark.parametrize("block", [8192, 16])
def test_knn_topk_with_many_ties(spark, block):
    q, m = made(50, 1), made(300, 1)
    ids = np.random.default_rng(3).permutation(300)
    found = retrieval.knn_topk(vectors(spark, range(50), q), vectors(spark, ids, m), 4, block=block, slice_rows=70)
    assert "FlatMapCoGroupsInArrow" not in found._jdf.queryExecution().toString()  # no group is loaded whole
    assert {(r.query, r.uid, r.rank) for r in found.collect()} == brute(range(50), q, ids, m, 4)


def test_ann_topk_is_the_bucket_join(spark):
    q, m = made(40, 5), made(300, 6)
    ids = np.arange(1000, 1300)
    found = retrieval.ann_topk(vectors(spark, range(40), q), vectors(spark, ids, m), 3, block=16, slice_rows=70)
    assert "posexplode" not in found._jdf.queryExecution().toString()  # no codes or pairs leave the tasks
    planes, same = 4, 1 - math.acos(0.5) / math.pi
    tables = math.ceil(math.log(0.02) / math.log1p(-(same**planes)))
    normal = np.random.default_rng(11).standard_normal((16, planes * tables))
    code = lambda x: (x.astype(np.float32).astype(float) @ normal > 0).reshape(len(x), tables, planes) @ (1 << np.arange(planes))
    allowed = (code(q)[:, None] == code(m)[None]).any(2)
    assert {(r.query, r.uid, r.rank) for r in found.collect()} == brute(range(40), q, ids, m, 3, allowed)


def test_stream_holds_only_the_queries():
    rng = np.random.default_rng(0)

    def batch(is_base, first, n):
        m = rng.standard_normal(n * 16).astype(np.float32)
        embedding = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16), pa.int32()), pa.array(m))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array([is_base] * n), pa.array(np.arange(first, first + n)), embedding], names=["g", "is_base", "uid", "embedding"])

    def batches():
        yield batch(False, 0, 2000)
        for k in range(12):
            yield batch(True, 10_000 * (k + 1), 5000)

    tracemalloc.start()
    n = sum(b.num_rows for b in retrieval._best(5, None)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 48e6  # the similarities of the block to one such batch are 80 MB by themselves
