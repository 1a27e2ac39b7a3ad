"""Lattice hashing, the Merkle manifest and the filter audit against brute force."""

import hashlib
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import Row

from casebook.llm import filter_audit, lattice, merkle
from casebook.llm.filter_audit import _get
from tests.llm.test_llm import odd  # noqa: F401


# ---------------------------------------------------------------- vectors


def brute_links(rows, threshold=0.9):
    """Per row: linked rows, and the smallest id reachable."""
    fine = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for ok, (_, v) in zip(fine, rows)]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    low = [i for i, _ in rows]
    while True:
        new = [min([low[a], *(low[b] for b in links[a])]) if links[a] else low[a] for a in range(len(rows))]
        if new == low:
            return links, low
        low = new


def planted(g, n_free, groups, dim=64, cosines=(0.995, 0.97)):
    """Unrelated vectors, and groups around a centre of their own."""
    out = [g.standard_normal(dim) for _ in range(n_free)]
    for size, c in zip(groups, cosines * len(groups)):
        centre = g.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            z = g.standard_normal(dim)
            z -= (z @ centre) * centre
            out.append((c * centre + np.sqrt(1 - c * c) * z / np.linalg.norm(z)) * g.uniform(0.1, 9))
    return out


def test_nearest_e8_is_nearest():
    g = np.random.default_rng(1)
    x = g.uniform(-3, 3, (300, 8))
    got = lattice.nearest_e8(x)
    twice = np.rint(got * 2)
    assert np.array_equal(twice, got * 2) and ((twice % 2 == 0).all(1) | (twice % 2 == 1).all(1)).all() and (got.sum(1) % 2 == 0).all()
    best = ((x - got) ** 2).sum(1)
    for s in lattice.STEPS:  # no neighbour is nearer, which for E8 makes it the nearest point
        assert (((x - got - s) ** 2).sum(1) >= best - 1e-9).all()
    assert len(lattice.STEPS) == 240 and np.allclose((lattice.STEPS**2).sum(1), 2) and (lattice.STEPS.sum(1) % 2 == 0).all()


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_whole_groups(spark, block):
    g = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(g.permutation(2_000), planted(g, 500, [70, 25, 3, 2, 1]))]
    rows += [(3_000 + k, rows[k % 2 + 520][1]) for k in range(30)]  # copies
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).collect()}
    links, low = brute_links([(i, np.array(v, np.float32)) for i, v in rows])
    assert len(got) == len(rows)
    found, there = sum(n for n, _, _ in got.values()), sum(map(len, links))
    assert found <= there and found >= 0.97 * there
    assert all(got[i][0] <= len(s) for (i, _), s in zip(rows, links))
    assert all(got[i][1:] == (c, i == c) for (i, _), c in zip(rows, low))
    assert any(len(s) > 90 for s in links)


@pytest.mark.parametrize("cosine, least", [(0.901, 0.95), (0.93, 0.97), (0.97, 0.99)])
def test_near_vectors_recall_of_pairs(spark, cosine, least):
    """Single pairs at a given cosine among unrelated vectors."""
    g = np.random.default_rng(6)
    rows = []
    for k in range(600):
        a, z = g.standard_normal(64), g.standard_normal(64)
        a /= np.linalg.norm(a)
        z -= (z @ a) * a
        rows += [(2 * k, a.tolist()), (2 * k + 1, (cosine * a + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)).tolist())]
    rows += [(5_000 + k, g.standard_normal(64).tolist()) for k in range(4_000)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").collect()
    assert all(r.vec_id < 1_200 and r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got)
    assert len(got) >= least * 1_200


def test_near_vectors_odd(spark):
    v, w = [1.0, 2.0, 0.5], [1.0, 2.0, 0.6]
    rows = [(1, v), (2, w), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.5]), (7, [1.0, float("nan"), 0.5]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (None, v), (1, v), (12, [-1.0, -2.0, -0.5]), (13, [1e30, 2e30, 5e29]), (14, [1e-30, 2e-30, 5e-31])]
    df = spark.createDataFrame([(i, x, 0, "x", True) for i, x in rows], "vec_id long, embedding array<float>, n_links int, component_id string, kept boolean")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect())
    links, low = brute_links([(i, None if x is None else [None if y is None else np.float32(y) for y in x]) for i, x in rows])
    assert got == Counter((i, len(s), c, i is not None and i == c) for (i, _), s, c in zip(rows, links, low))
    assert lattice.near_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- Merkle trees

UP = {65 + k: 97 + k for k in range(26)}


def leaf_hash(r, text):
    show = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return hashlib.sha256("".join(map(show, (r.doc_id, r.source, r.lang, r.n_chars, text))).encode()).hexdigest()


def climb(nodes):
    """Levels of a tree, by the rule."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][a : a + 8]).encode()).hexdigest() for a in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_hash(r, r.text), r))
    trees = {}
    for lang, own in by.items():
        own.sort(key=lambda x: x[:3])
        trees[lang] = (own, climb([x[2] for x in own]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = climb([trees[x][1][-1][0] for x in names])
    out = []
    for k, lang in enumerate(names):
        own, levels = trees[lang]
        for i, (_, _, leaf, r) in enumerate(own):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            node, at, proof = (leaf_hash(r, r.text and r.text.translate(UP)) if tampered else leaf), i, ""
            for first, path in ((i, levels), (k, top)):
                at = first
                for level in path[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
                    proof, node, at = proof + left + right, hashlib.sha256((left + node + right).encode()).hexdigest(), at // 8
            out.append((r.doc_id, leaf, levels[-1][0], top[-1][0], hashlib.sha256(proof.encode()).hexdigest(), node, node == top[-1][0]))
    return Counter(out)


def shown(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_manifest_odd(spark, odd):  # noqa: F811
    assert shown(merkle.manifest(odd)) == brute_manifest(odd.collect())
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = odd.where("doc_id = 5")
    got = merkle.manifest(one).collect()
    assert len(got) == 1 and got[0].root == got[0].subroot == got[0].leaf and got[0].proof_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_many_blocks(spark, height):
    """Blocks of 8 or 64 leaves, so that trees have several rounds; runs of one at every level."""
    rows = [Row(doc_id=k, text=f"Text {k} X", lang=lang, source="s", n_chars=k) for lang, n in (("a", 513), ("b", 64), ("B", 65), (None, 9), ("é", 1), ("z", 4097), *((f"l{x}", 2) for x in range(70))) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = merkle.manifest(df, height=height)
    assert shown(got) == brute_manifest(rows)


def test_path_copying_shares_nodes():
    leaves = [hashlib.sha256(bytes([k])).hexdigest() for k in range(100)]
    tree = merkle.PathCopyTree(leaves)
    before, hashes, children = tree.top, list(tree.hashes), list(tree.children)
    for place in (0, 57, 99):
        size, top = len(tree.hashes), tree.with_leaf(place, "x" * 64)
        assert len(tree.hashes) == size + 1 + tree.height  # the leaf and its ancestors
        assert tree.hashes[top] == climb(leaves[:place] + ["x" * 64] + leaves[place + 1 :])[-1][0]
    assert tree.top == before and tree.hashes[: len(hashes)] == hashes and tree.children[: len(children)] == children


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    import re

    good, toxic = {r.doc_id for r in labels if r.quality == 1} - {None}, {r.doc_id for r in labels if r.toxic == 1} - {None}
    least, out = {}, {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    rows = []
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > least[t]}
        rows.append((r.lang or "", "".join(k for k in bad if bad[k]), r.doc_id in good, r.doc_id in toxic))
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for p in permutations("ABCDE"):
            left = own
            for step, f in enumerate(p, 1):
                gone = [r for r in left if f in r[1]]
                stay = [r for r in left if f not in r[1]]
                out[part, "".join(p), step] = [len(stay), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
                left = stay
        for (q, p, step), v in out.items():
            if q == part:
                v.append(total[p[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_odd(spark, odd):  # noqa: F811
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (3, 0, None), (700, 1, 0), (None, 1, 1), (12345, 1, 1)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(900 + k, "AB " * 60 + "w " * 50 * (k % 2) + "#" * (k % 3), ["en", "fr", None][k % 3], "s", 1, 0.1, True) for k in range(12)], odd.schema)
    docs = odd.unionByName(more)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.interactions(filter_audit.document_flags(docs), labels).collect()}
    assert got == brute_audit(docs.collect(), labels.collect())
    assert filter_audit.interactions(filter_audit.document_flags(odd.limit(0)), labels).count() == 0


@pytest.mark.parametrize("bucket_text", [1 << 24, 1_000, 10])
def test_term_matrix(spark, odd, bucket_text):  # noqa: F811
    """The matrix holds every document's words, under one dictionary."""
    import re

    dictionary, shards = filter_audit.term_matrix(odd.repartition(3), bucket_text=bucket_text)
    word = {r.id: r.word for r in dictionary.collect()}
    docs = odd.collect()
    assert dictionary.count() == len(word) and sorted(word.values()) == sorted({w for r in docs for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")})
    got = Counter()
    for s in shards.collect():
        ends, ids, times = _get(s.indptr, "<u4"), _get(s.indices, "<i8"), _get(s.data, "<u4")
        for k, doc_id in enumerate(s.doc_ids):
            own = ids[ends[k] : ends[k + 1]]
            assert (np.diff(own) > 0).all()
            got[doc_id, tuple(sorted((word[i], int(n)) for i, n in zip(own, times[ends[k] : ends[k + 1]])))] += 1
    assert got == Counter((r.doc_id, tuple(sorted(Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).items()))) for r in docs)
