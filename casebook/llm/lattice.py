"""Near-duplicate vectors by lattice hashing.

Each table projects the unit vectors on eight random orthonormal directions, scales and shifts them, and decodes the
result to its nearest point of the E8 lattice: the vector's home cell. Besides, it probes the ``probes`` neighbouring
cells (of the lattice's 240 shortest steps) that lie nearest. Two vectors are candidates if one's home is a home or a
probe of the other in some table; candidates are verified by their cosine in double precision.

Scale and number of tables: the cells get finer with the number of vectors (cells as its square root), so that a cell
holds ever less of the base, and there are as many tables as it takes for a pair right at the threshold to be missed with
a chance of ``miss`` at most; that chance is worked out on made pairs of the same dimension, once, on the driver.
Pairs well above the threshold are missed far less often.

What keeps it bounded:

* equal vectors are one class with a number of copies; they are found by a grouped key that is aggregated partly before
  its shuffle, and never compared;
* cells with no company are dropped before any vector moves; a cell of more than ``block`` entries is cut into blocks
  that meet two by two, so no task holds more than two blocks;
* pairs never become rows: a group of two blocks gives, for each class, the number of vectors it links with there, and
  one link that spans its component. A pair that meets more than once is counted where it meets first, in the order of
  tables and of home before probe, which every group can tell from the codes of both.

The number of comparisons within one group of m *different* near copies is still m squared, block by block, as each pair
has to be counted.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
lengths, nor rows without vec_id. Rows that share a vec_id are vectors each, in one component if either links. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import mix64, sorted_groups
from casebook.operators.components import connected_components
from casebook.session import written

BLOCK = 1024
#: The 240 shortest vectors of E8: (+-1, +-1, 0, ...) in all places, and (+-1/2, ...) with an even number of minus signs.
STEPS = np.array(
    [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    + [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of every row: E8 is D8 and D8 moved by a half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def _named(points: np.ndarray, dim: int) -> np.ndarray:
    """32-bit names of lattice points; the vectors' dimension is part of them."""
    twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    h = np.full(points.shape[:-1], dim, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(8):
            h = mix64(h + twice[..., k] * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(32)).astype(np.uint32)


def _plane(table: int, dim: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dim x 8, orthonormal where there are eight) times the scale, and a shift."""
    g = np.random.default_rng([seed, table, dim])
    a = g.standard_normal((dim, 8))
    a = np.linalg.qr(a)[0] if dim >= 8 else a / math.sqrt(dim)
    return a * scale * math.sqrt(dim), g.random(8) * 2


def codes_of(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int = 7) -> np.ndarray:
    """Names of the home cell and the nearest ``probes`` neighbours in every table: rows x tables x (1 + probes)."""
    out = np.empty((len(unit), tables, 1 + probes), dtype=np.uint32)
    for t in range(tables):
        a, shift = _plane(t, unit.shape[1], scale, seed)
        y = unit @ a + shift
        home = nearest_e8(y)
        # a step's distance to y falls with its product with what is left
        gain = (y - home) @ STEPS.T
        near = np.argpartition(-gain, probes, axis=1)[:, :probes]
        out[:, t, 0] = _named(home, unit.shape[1])
        out[:, t, 1:] = _named(home[:, None] + STEPS[near], unit.shape[1])
    return out


def _scale(n: int) -> float:
    """Standard deviation of a projected coordinate in lattice units; the number of cells goes with its eighth power."""
    return 0.5 * (max(n, 1) / 10_000) ** (1 / 16)


def n_tables(n: int, dim: int, threshold: float, probes: int, miss: float) -> int:
    """Tables needed for a pair right at the threshold to be missed with a chance of ``miss`` at most."""
    g = np.random.default_rng(11)
    a = g.standard_normal((4_000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = g.standard_normal((4_000, dim))
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * z
    ca, cb = (codes_of(x, 3, probes, _scale(n), seed=13) for x in (a, b))
    met = (ca[:, :, 0] == cb[:, :, 0]) | (ca[:, :, 1:] == cb[:, :, :1]).any(2) | (cb[:, :, 1:] == ca[:, :, :1]).any(2)
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(max(met.mean(), 1e-4), 1 - 1e-9))))


def _packed(kind: str):
    """Rows with their vector as bytes; null where it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, ends = v.values.to_numpy(zero_copy_only=False).astype(kind), v.offsets.to_numpy().astype(np.int64)
            hole = v.values.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(flat)
            holes = np.concatenate([[0], np.cumsum(hole)])[ends]
            some = np.concatenate([[0], np.cumsum(~hole & (flat != 0))])[ends]
            fine = v.is_valid().to_numpy(zero_copy_only=False) & (np.diff(holes) == 0) & (np.diff(some) > 0) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            flat = flat + np.array(0, kind)  # minus zero becomes zero
            packed = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], fine)]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("id"), "v": pa.array(packed, pa.binary())})

    return run


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # lengths of very small or large vectors would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(kind: str, tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            codes: list[bytes | None] = [None] * len(rows)
            sizes = np.array([len(r) for r in rows])
            for size in np.unique(sizes):
                where = np.flatnonzero(sizes == size)
                for k, c in zip(where, codes_of(_unit([rows[i] for i in where], kind), tables, probes, scale)):
                    codes[k] = c.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "codes"])

    return run


def _entries(tables: int, probes: int):
    """An entry per cell that a class lives in or probes: (cell, digest, probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u4").reshape(n, tables, 1 + probes)
            again = np.zeros(codes.shape, dtype=bool)  # names of different cells may be equal by chance
            for k in range(1, 1 + probes):
                again[:, :, k] = (codes[:, :, :k] == codes[:, :, k : k + 1]).any(2)
            row, table, k = np.nonzero(~again)
            cell = (table.astype(np.int64) << 32) | codes[row, table, k].astype(np.int64)
            taken = batch.column("digest").take(pa.array(row))
            for a in range(0, len(row), 50_000):
                b = min(a + 50_000, len(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell[a:b]), taken.slice(a, b - a), pa.array(k[a:b] > 0)], names=["cell", "digest", "probe"])

    return run


FOUND = "rep long, digest binary, links long, low long"


def _verified(kind: str, threshold: float, tables: int, probes: int):
    """Links within a group of two blocks of a cell (or within one block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cell", "i", "j"]):
            n = group.num_rows
            probe = group.column("probe").to_numpy()
            if n < 2 or probe.all():
                continue
            table = group.column("cell")[0].as_py() >> 32
            rep, copies, side = (group.column(c).to_numpy() for c in ("rep", "copies", "side"))
            packed = group.column("v").to_pylist()
            if len({len(p) for p in packed}) > 1:  # names of cells of different dimensions may be equal by chance
                sizes = np.array([len(p) for p in packed])
                width = sizes.max()
                packed = [p + bytes(width - len(p)) for p in packed]
            else:
                sizes = None
            unit = _unit(packed, kind)
            linked = unit @ unit.T >= threshold
            linked[np.ix_(probe, probe)] = False
            np.fill_diagonal(linked, False)
            if sizes is not None:
                linked &= sizes[:, None] == sizes[None, :]
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                linked &= side[:, None] != side[None, :]  # pairs within a block have their own group
            if not linked.any():
                continue
            place = np.argsort(rep, kind="stable")  # labels are ranks of reps
            label = np.empty(n, dtype=np.int64)
            label[place] = np.arange(n)
            while True:
                lower = np.minimum(label, np.where(linked, label[None, :], n).min(1))
                lower = lower[place[lower]]  # jump
                if (lower == label).all():
                    break
                label = lower
            a, b = np.nonzero(np.triu(linked))
            # rows are in the order of digests, so every group of a pair sees it the same way round
            codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), "<u4").reshape(n, tables, 1 + probes)[:, : table + 1]
            links = np.zeros(n, dtype=np.int64)
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                met = np.empty((len(x), table + 1, 3), dtype=bool)
                met[:, :, 0] = codes[x, :, 0] == codes[y, :, 0]
                met[:, :, 1] = (codes[y, :, 1:] == codes[x, :, :1]).any(2)
                met[:, :, 2] = (codes[x, :, 1:] == codes[y, :, :1]).any(2)
                here = 3 * table + np.where(probe[y], 1, np.where(probe[x], 2, 0))
                # x lives where y probes: the cell of this group is x's home; met[.., 1]
                first = met.reshape(len(x), -1).argmax(1) == here
                np.add.at(links, x[first], copies[y[first]])
                np.add.at(links, y[first], copies[x[first]])
            any_ = linked.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(rep[any_]), group.column("digest").combine_chunks().filter(pa.array(any_)), pa.array(links[any_]), pa.array(rep[place[label[any_]]])], names=["rep", "digest", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", probes: int = 4, miss: float = 0.02, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors with a cosine of ``threshold`` or more that were
    found), component_id (smallest vec_id reachable over links) and kept (vec_id = component_id)."""
    single = vectors.select(vectors[vector]).dtypes[0][1] == "array<float>"
    kind = "<f4" if single else "<f8"
    given = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[vector].cast("array<float>" if single else "array<double>").alias("v"))
    rows = written(given.mapInArrow(_packed(kind), "vec_id long, v binary").withColumn("digest", F.unhex(F.md5("v"))), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("digest", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "vector-classes")
    n, bytes_ = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(64))).first()
    tables = n_tables(n, bytes_ // int(kind[2]), threshold, probes, miss)
    coded = written(classes.mapInArrow(_coded(kind, tables, probes, _scale(n)), "digest binary, v binary, rep long, copies long, codes binary"), "vector-codes")
    entries = written(coded.select("digest", "codes").mapInArrow(_entries(tables, probes), "cell long, digest binary, probe boolean"), "cell-entries")
    # cells with a resident and company
    sizes = entries.groupBy("cell").agg(F.count("*").alias("k"), F.min("probe").alias("empty")).where("k > 1 AND NOT empty").select("cell", F.ceil(F.col("k") / block).alias("nb"))
    dealt = entries.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("digest"), F.col("nb"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.select("cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("side"), "digest", "probe")
    group = ["cell", "i", "j"]
    found = dealt.join(coded, "digest").repartition(*group).sortWithinPartitions(*group, "digest").mapInArrow(_verified(kind, threshold, tables, probes), FOUND)
    found = written(found, "vector-links")
    links = found.groupBy("rep", "digest").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("src"), F.col("low").alias("dst"))).withColumnRenamed("node", "rep")
    decided = classes.select("digest", "rep", "copies").join(links.select("digest", "links"), "digest", "left").join(joined, "rep", "left")
    decided = decided.select("digest", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = rows.where("digest IS NOT NULL").select("vec_id", "digest").join(decided, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
