"""Bootstrap resamples without a row per draw.

``n`` draws with replacement over ``n`` cases fall into the ranges of a binary tree: a node's draws are split between
its halves by a seeded deviate, so a task that holds a leaf's cases finds out by itself, from the root down, how many
draws of every replicate fall there, makes the counts of its own cases as one array and sends back sums. What is
shuffled is one row per task, group and replicate.

All of it is a fixed function of the seed and the places of the cases in their order, told here once for the library and,
in the SQL of the registered queries, once more:

* ``mix`` is a scrambling of 32-bit integers;
* leaf r of m holds the places ``r * n // m`` up to ``(r + 1) * n // m``, with m the number of cases over ``leaf``, rounded up;
* a node of leaves [lo, hi) is cut in the middle; its k draws go to the left with the mean ``k a`` and the variance
  ``k a (1 - a)``, rounded and cut to 0 .. k, where a is the left half's share of the cases. As the halves are about
  equal and k is at least about ``leaf``, this normal deviate stands in for the binomial one;
* draw t of a leaf takes the case at ``mix(q + 40503 (t + 1))`` modulo the leaf's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.numbering import numbered
from casebook.session import written

LEAF = 128
MASK, FACTOR = 0xFFFFFFFF, 73244475


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) & np.uint64(MASK)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(FACTOR) & np.uint64(MASK)
    return x ^ (x >> np.uint64(16))


def _stream(n_boot: int, seed: int, group: int) -> np.ndarray:
    """A replicate's number for a group; nodes go on from it."""
    rep = mix(np.arange(n_boot, dtype=np.uint64) + np.uint64(seed * 69069 & MASK))
    return mix(rep + np.uint64(group * 7919 & MASK))


def leaf_draws(n: int, m: int, leaf: int, stream: np.ndarray) -> np.ndarray:
    """Draws of every replicate that fall on ``leaf``."""
    lo, hi, k = 0, m, np.full(len(stream), n, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first, middle, end = lo * n // m, mid * n // m, hi * n // m
        a = (middle - first) / (end - first)
        h1 = mix(mix(stream + np.uint64(lo)) + np.uint64(hi))
        h2 = mix(h1 + np.uint64(1))
        z = np.sqrt(-2 * np.log((h1.astype(np.float64) + 1) / 4294967297.0)) * np.cos(2 * np.pi * h2.astype(np.float64) / 4294967296.0)
        left = np.clip(np.floor(k * a + np.sqrt(k * a * (1 - a)) * z + 0.5), 0, k).astype(np.int64)
        lo, hi, k = (lo, mid, left) if leaf < mid else (mid, hi, k - left)
    return k


def leaf_counts(n: int, m: int, leaf: int, stream: np.ndarray) -> np.ndarray:
    """How often each replicate draws each case of a leaf: replicates x cases."""
    size = (leaf + 1) * n // m - leaf * n // m
    k = leaf_draws(n, m, leaf, stream)
    q = mix(stream + np.uint64(leaf))
    rep = np.repeat(np.arange(len(k)), k)
    t = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
    place = mix(q[rep] + (t.astype(np.uint64) + np.uint64(1)) * np.uint64(40503)) % np.uint64(size)
    return np.bincount(rep * size + place.astype(np.int64), minlength=len(k) * size).reshape(len(k), size)


def resampled_sums(cases: DataFrame, values: list[str], n_boot: int, seed: int, group: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """``(*group, rep, drawn, *values)``: for every group and replicate the number of draws, which is the group's size,
    and the sums of ``values`` over the drawn cases (uid, ...); nulls count as 0. Groups are classes or metrics, few."""
    group = group or []
    names = [f"v{k}" for k in range(len(values))]
    rows = cases.select("uid", *group, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(n) for v, n in zip(values, names)])
    placed = numbered(rows, "i", "uid", group)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("g", (F.row_number().over(Window.orderBy(*group)) - 1).cast("int") if group else F.lit(0)).where("n > 0")
    sizes = written(sizes.withColumn("m", F.ceil(F.col("n") / leaf)), "resample-groups")
    j = placed.join(sizes, group) if group else placed.crossJoin(sizes)  # one row
    # the leaf of place i: the largest r with r * n // m <= i
    dealt = j.select("g", "n", "m", F.floor(((F.col("i") + 1) * F.col("m") - 1) / F.col("n")).alias("leaf"), "i", *names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total, drawn, g = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n_boot, g, np.int32)), pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(drawn), *(pa.array(total[:, k].copy()) for k in range(len(names)))], names=["g", "rep", "drawn", *names])

        def close(rows: pa.Table) -> None:
            nonlocal total, drawn
            n, m, r = (rows.column(c)[0].as_py() for c in ("n", "m", "leaf"))
            counts = leaf_counts(n, m, r, _stream(n_boot, seed, g))
            drawn = drawn + counts.sum(1)
            total = total + counts @ np.column_stack([rows.column(c).to_numpy() for c in names])

        key = None
        for batch in batches:
            marks = np.stack([batch.column("g").to_numpy(), batch.column("leaf").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key is not None and tuple(marks[a]) != key:
                    close(pa.Table.from_batches(held))
                    held = []
                if key is None or marks[a][0] != g:
                    if key is not None:
                        yield out()
                    g, total, drawn = int(marks[a][0]), np.zeros((n_boot, len(names))), np.zeros(n_boot, np.int64)
                key = tuple(marks[a])
                held.append(batch.slice(a, b - a))
        if held:
            close(pa.Table.from_batches(held))
            yield out()

    schema = "g int, rep int, drawn long, " + ", ".join(f"{n} double" for n in names)
    parts = dealt.repartition("g", "leaf").sortWithinPartitions("g", "leaf", "i").mapInArrow(sums, schema)
    added = parts.groupBy("g", "rep").agg(F.sum("drawn").alias("drawn"), *[F.sum(n).alias(n) for n in names])
    return added.join(sizes.select("g", *group), "g").select(*group, "rep", "drawn", *[F.col(n).alias(v) for n, v in zip(names, values)])


def mix_sql(x: str) -> str:
    x = f"(({x}) & {MASK})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {FACTOR}) & {MASK})"
    return f"xor({x}, {x} >> 16)"


def draws_sql(src: str, value: str, name: str, n_boot: int, seed: int, part: str = "", leaf: int = LEAF) -> str:
    """CTEs that end in ``name``: a row per draw (b, the columns of ``src``'s case, v). Needs WITH RECURSIVE."""
    col, over = (f"{part}, ", f"PARTITION BY {part} ") if part else ("", "")
    rank = f"dense_rank() OVER (ORDER BY {part}) - 1" if part else "0"
    share = "((mid * n // m) - (lo * n // m)) / ((hi * n // m) - (lo * n // m))::DOUBLE"
    z = "sqrt(-2 * ln((h1 + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * h2 / 4294967296.0::DOUBLE)"
    node = f"SELECT *, {mix_sql('q + hi')} AS h1 FROM (SELECT *, {mix_sql('s + lo')} AS q, (lo + hi) // 2 AS mid FROM {name}t WHERE hi - lo > 1)"
    split = f"SELECT *, greatest(0, least(k, floor(k * a + sqrt(k * a * (1 - a)) * ({z}) + 0.5)))::BIGINT AS k1 FROM (SELECT *, {share} AS a, {mix_sql('h1 + 1')} AS h2 FROM ({node}))"
    return (
        f"{name}n AS (SELECT {col}uid, {value} AS v, row_number() OVER ({over}ORDER BY uid) - 1 AS i, count(*) OVER ({over}) AS n, {rank} AS g FROM {src}), "
        f"{name}b AS (SELECT g, n, (n + {leaf - 1}) // {leaf} AS m, b, {mix_sql(f'{seed * 69069 & MASK} + b')} AS p FROM (SELECT DISTINCT g, n FROM {name}n), range({n_boot}) t(b)), "
        f"{name}t AS (SELECT g, n, m, b, {mix_sql('p + g * 7919')} AS s, 0::BIGINT AS lo, m::BIGINT AS hi, n::BIGINT AS k FROM {name}b UNION ALL "
        f"SELECT g, n, m, b, s, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END, CASE WHEN side = 0 THEN k1 ELSE k - k1 END FROM ({split}), (VALUES (0), (1)) x(side)), "
        f"{name}l AS (SELECT g, n, m, b, lo, q, unnest(range(k)) AS t FROM (SELECT *, {mix_sql('s + lo')} AS q FROM {name}t WHERE hi - lo = 1)), "
        f"{name}d AS (SELECT g, b, lo * n // m + {mix_sql('q + 40503 * (t + 1)')} % ((lo + 1) * n // m - lo * n // m) AS i FROM {name}l), "
        f"{name} AS (SELECT d.b, x.* FROM {name}d d JOIN {name}n x ON d.i = x.i AND d.g = x.g)"
    )
