"""Merkle manifest of a dataset with a persistent, path-copying tree.

Every row is a leaf: the SHA-256 of its fields. Leaves of a language ascend by doc_id; eight consecutive nodes become
their parent until one is left, the language's subroot; subroots, ordered by language, become the root in the same way.

Trees are worked in aligned blocks of ``8 ** 4`` nodes. A block is one row: its nodes, and the node four levels up that
they come to. Those nodes are blocks of the next round, a 4,096th as many, until each language has one block; so a round
is one shuffle and no task holds more than a block, however large a language is. On the way down every block gets the
path from its top to the root: the siblings to the left and right at each level.

Within a block the tree is persistent: nodes are never changed, and putting another hash in a leaf's place makes a
version, a new top whose only new nodes are the leaf's ancestors; all others are shared with the tree before. Versions
leave a block with its path: above the block only that path's nodes are copied, where the leaf is, so that the upper
levels of many versions never meet in one task.

Fields: doc_id, source, lang, n_chars, text; each is ``-`` if null, else its UTF-8 byte count, ``:`` and its value. A
null doc_id is the first of its language and is not tampered with; a null language is a language of its own, the first.
Rows that share a doc_id are ordered by their leaf; equal rows are leaves beside each other. An empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import sorted_groups
from casebook.operators.numbering import numbered
from casebook.session import written

WIDTH, HEIGHT = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class PathCopyTree:
    """Hash tree over the nodes of a block. ``hashes[i]`` and ``children[i]`` belong to node i; nodes are only ever added."""

    def __init__(self, leaves: list[str], block: int = 0, height: int = HEIGHT):
        """Block ``block`` of a tree that is cut into blocks of ``height`` levels. A tree's only block ends at its first
        single node, any other has all levels; a full first block comes to one node after all of them either way."""
        sole = block == 0 and len(leaves) < WIDTH**height
        self.hashes: list[str] = list(leaves)
        self.children: list[tuple[int, ...] | None] = [None] * len(leaves)
        self.height = 0
        level = list(range(len(leaves)))
        while len(level) > 1 if sole else self.height < height:
            level = [self._add(tuple(level[a : a + WIDTH])) for a in range(0, len(level), WIDTH)]
            self.height += 1
        self.top = level[0]

    def _add(self, children: tuple[int, ...]) -> int:
        self.hashes.append(H("".join(self.hashes[c] for c in children)))
        self.children.append(children)
        return len(self.hashes) - 1

    def _down(self, top: int, place: int) -> list[tuple[int, int]]:
        """(node, which child) from ``top`` to the parent of leaf ``place``."""
        path, node = [], top
        for level in range(self.height - 1, -1, -1):
            k = (place // WIDTH**level) % WIDTH
            path.append((node, k))
            node = self.children[node][k]
        return path

    def with_leaf(self, place: int, leaf: str) -> int:
        """The top of a version with another leaf; shares every node but the leaf and its ancestors."""
        self.hashes.append(leaf)
        self.children.append(None)
        node = len(self.hashes) - 1
        for parent, k in reversed(self._down(self.top, place)):
            old = self.children[parent]
            node = self._add((*old[:k], node, *old[k + 1 :]))
        return node

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """What stands left and right of the path at each level, from the leaf upward."""
        out = []
        for parent, k in reversed(self._down(self.top, place)):
            run = self.children[parent]
            out.append(("".join(self.hashes[c] for c in run[:k]), "".join(self.hashes[c] for c in run[k + 1 :])))
        return out


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_rows(docs: DataFrame, every: int = 3) -> DataFrame:
    """``(lang, doc_id, leaf, tampered)``; ``tampered`` is null but where ``every`` divides the crc32 of the doc_id."""
    doc_id, source, lang, n_chars, text = (docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))
    leaf = lambda t: F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, t))), 256))
    chosen = F.crc32(doc_id.cast("string")) % every == 0
    return docs.select(lang.cast("string").alias("lang"), doc_id.cast("long").alias("doc_id"), leaf(text).alias("leaf"), F.when(chosen, leaf(F.translate(text, UPPER, LOWER))).alias("tampered"))


BLOCK = "tree string, block long, top string, ids array<long>, nodes binary, changed binary, is_changed binary"


def _hex(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[a : a + 64] for a in range(0, len(text), 64)]


def _pack(height: int):
    """A row per aligned block of nodes in the order of their places, with the hash its tree comes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["tree", "block"]):
            block, nodes = group.column("block")[0].as_py(), b"".join(group.column("node").to_pylist())
            changed = group.column("changed").to_pylist()
            tree = PathCopyTree(_hex(nodes), block, height)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([group.column("tree")[0].as_py()], pa.string()), "block": pa.array([block], pa.int64()), "top": [tree.hashes[tree.top]],
                "ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())), "nodes": pa.array([nodes], pa.binary()),
                "changed": pa.array([b"".join(c for c in changed if c is not None)], pa.binary()), "is_changed": pa.array([bytes(c is not None for c in changed)], pa.binary()),
            })

    return run


def _blocks(nodes: DataFrame, name: str, height: int) -> DataFrame:
    """Blocks of ``(tree, place, id, node, changed)``."""
    cut = nodes.select("tree", F.floor(F.col("place") / WIDTH**height).alias("block"), "place", "id", "node", "changed")
    return written(cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(_pack(height), BLOCK), name)


PATHS = "tree string, place long, node string, lefts array<string>, rights array<string>, subroot string, root string"


def _paths(height: int):
    """For every node of a block, its path to the root: through the block, then the block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = _hex(row["nodes"])
                tree = PathCopyTree(nodes, row["block"], height)
                paths = [tree.siblings(k) for k in range(len(nodes))]
                n, base = len(nodes), row["block"] * WIDTH**height
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([row["tree"]] * n, pa.string()), "place": pa.array(range(base, base + n), pa.int64()), "node": nodes,
                    "lefts": pa.array([[a for a, _ in p] + row["lefts"] for p in paths], pa.list_(pa.string())), "rights": pa.array([[b for _, b in p] + row["rights"] for p in paths], pa.list_(pa.string())),
                    "subroot": pa.array([row["subroot"]] * n, pa.string()), "root": pa.array([row["root"]] * n, pa.string()),
                })

    return run


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied int"


def _versions(height: int):
    """Proof of every leaf of a block, and the root of the version in which the leaf is tampered with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves, is_changed = _hex(row["nodes"]), row["is_changed"]
                tree = PathCopyTree(leaves, row["block"], height)
                above, changed = list(zip(row["lefts"], row["rights"])), iter(_hex(row["changed"]))
                tail = "".join(a + b for a, b in above)
                proofs, folded, copied = [], [], []
                for k in range(len(leaves)):
                    proofs.append(H("".join(a + b for a, b in tree.siblings(k)) + tail))
                    before = len(tree.hashes)
                    node = tree.hashes[tree.with_leaf(k, next(changed)) if is_changed[k] else tree.top]
                    copied.append(len(tree.hashes) - before + len(above) if is_changed[k] else 0)
                    for a, b in above:  # the version goes on over the block's path
                        node = H(a + node + b)
                    folded.append(node)
                n = len(leaves)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"], pa.int64()), "leaf": leaves, "subroot": [row["subroot"]] * n, "root": [row["root"]] * n,
                    "proof_sha256": proofs, "folded_root": folded, "verified": [f == row["root"] for f in folded], "n_copied": pa.array(copied, pa.int32()),
                })

    return run


def _climb(nodes: DataFrame, name: str, height: int) -> list[DataFrame]:
    """Blocks of nodes, blocks of what these come to, and so on until every tree has one block."""
    rounds = [_blocks(nodes, name, height)]
    while not rounds[-1].where("block > 0").isEmpty():
        tops = rounds[-1].select("tree", F.col("block").alias("place"), F.lit(None).cast("long").alias("id"), F.unhex("top").alias("node"), F.lit(None).cast("binary").alias("changed"))
        rounds.append(_blocks(tops, name, height))
    return rounds


def _beneath(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path of the node they come to."""
    p = paths.select(F.col("tree").alias("__t"), F.col("place").alias("__p"), "lefts", "rights", "subroot", "root")
    return blocks.join(p, blocks["tree"].eqNullSafe(p["__t"]) & (blocks["block"] == p["__p"])).drop("__t", "__p")


def manifest(docs: DataFrame, every: int = 3, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256 (the siblings up to the root), folded_root
    (the root of the leaf's version, tampered or not), verified (it is still the root) and n_copied, the number of new
    nodes that the version has."""
    leaves = written(leaf_rows(docs, every), "leaves")
    # the order within a language: by doc_id, null first, then by leaf
    keyed = leaves.select("lang", F.struct("doc_id", "leaf").alias("k"), "tampered")
    placed = numbered(keyed, "place", "k", ["lang"]).select(F.col("lang").alias("tree"), "place", F.col("k.doc_id").alias("id"), F.col("k.leaf").alias("node"), F.col("tampered").alias("changed"))
    own = _climb(placed, "merkle", height)
    subroots = own[-1].select(F.col("tree").alias("lang"), F.col("top").alias("subroot"))
    ordered = written(numbered(subroots, "place", "lang"), "subroots")
    whole = _climb(ordered.select(F.lit("").alias("tree"), "place", F.lit(None).cast("long").alias("id"), F.unhex("subroot").alias("node"), F.lit(None).cast("binary").alias("changed")), "merkle-root", height)
    none = F.array().cast("array<string>")
    paths = None
    for blocks in reversed(whole):
        top = blocks.withColumns({"lefts": none, "rights": none, "subroot": F.lit(None).cast("string"), "root": F.col("top")}) if paths is None else _beneath(blocks, paths)
        paths = top.mapInArrow(_paths(height), PATHS)
    # from here on a path belongs to a language; it leads on from its subroot
    paths = ordered.join(paths.select("place", "lefts", "rights", "root"), "place").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", "subroot", "root")
    for blocks in reversed(own[1:]):
        paths = written(_beneath(blocks, paths).mapInArrow(_paths(height), PATHS), "merkle-paths")
    return _beneath(own[0], paths).mapInArrow(_versions(height), RESULT)


def op12_sql(levels: int = 7) -> str:
    """The same in SQL, for up to ``8 ** levels`` leaves a language and as many languages."""
    up = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = lambda t: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"
    parts = [
        f"r AS (SELECT row_number() OVER () AS r, doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(up)} END AS tampered FROM documents)",
        "n0 AS (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c, leaf AS h, r FROM r)",
        "d0 AS (SELECT r.r, n0.g, n0.i, '' AS proof, coalesce(tampered, leaf) AS f FROM r JOIN n0 ON n0.r = r.r)",
    ]

    def climb(a: str, first: int, until: int) -> None:
        for k in range(first, until):
            n, d = f"n{k}", f"d{k}"
            parts.append(f"q{k} AS (SELECT g, i // 8 AS j, c, string_agg(h, '' ORDER BY i) AS run FROM {n} GROUP BY g, i // 8, c)")
            parts.append(f"n{k + 1} AS (SELECT g, j AS i, CASE WHEN c > 1 THEN (c + 7) // 8 ELSE 1 END AS c, CASE WHEN c > 1 THEN sha256(run) ELSE run END AS h FROM q{k})")
            left, right = "substr(run, 1, 64 * (i % 8))", "substr(run, 64 * (i % 8) + 65)"
            parts.append(f"d{k + 1} AS (SELECT r, d.g, j AS i, CASE WHEN c > 1 THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN c > 1 THEN sha256({left} || f || {right}) ELSE f END AS f FROM {d} d JOIN q{k} q ON d.g IS NOT DISTINCT FROM q.g AND d.i // 8 = q.j)")

    climb("", 0, levels)
    parts.append(f"s AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM n{levels})")
    a = levels + 1
    parts.append(f"n{a} AS (SELECT 0 AS g, i, c, subroot AS h FROM s)")
    parts.append(f"d{a} AS (SELECT d.r, 0 AS g, s.i, proof, f FROM d{levels} d JOIN s ON d.g IS NOT DISTINCT FROM s.lang)")
    climb("", a, a + levels)
    z = a + levels
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM r JOIN d{z} d ON d.r = r.r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang JOIN n{z} root ON true"
