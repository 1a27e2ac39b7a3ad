"""Ranking evaluation without ranking the knowledge base.

A query's metrics need its first ``k`` cases, the rank of its first relevant case, and the ideal order. Cases with equal
label sets are one class: relevance is a number per pair of classes, and the ideal follows from class sizes. The first
``k`` cases of a similarity order, and its best relevant one, come from one pass over blocks; where that one lies behind
the first ``k``, a second pass counts the cases above it. A random order is a keyed bijection of places, of which only
the first ranks, and those that settle the first relevant case, are ever worked out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.numbering import numbered
from casebook.operators.resampling import MASK, mix, mix_sql
from casebook.session import written

# ---------------------------------------------------------------- classes of equal label sets


def label_sets(case_labels: DataFrame) -> DataFrame:
    """``(uid, labels)``: a case's labels as a sorted array, which names its class."""
    return case_labels.groupBy("uid").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def relevance_links(query_labels: DataFrame, kb_labels: DataFrame) -> DataFrame:
    """``(query_set, kb_set, relevance, n_queries, n_cases)``: labels that the cases of two classes share, and how many
    queries and cases are in them. Rows follow the distinct label sets, whatever the number of cases."""
    q = label_sets(query_labels).groupBy(F.col("labels").alias("query_set")).agg(F.count("*").alias("n_queries"))
    k = label_sets(kb_labels).groupBy(F.col("labels").alias("kb_set")).agg(F.count("*").alias("n_cases"))
    met = q.select("query_set", F.explode("query_set").alias("label")).join(k.select("kb_set", F.explode("kb_set").alias("label")), "label")
    links = met.groupBy("query_set", "kb_set").agg(F.count("*").alias("relevance"))
    return links.join(q, "query_set").join(k, "kb_set").select("query_set", "kb_set", "relevance", "n_queries", "n_cases")


def relevance_pairs(query_labels: DataFrame, kb_labels: DataFrame, block: int = 4096) -> DataFrame:
    """``(query, uid, relevance)``: the class links written out to pairs of cases; pairs that share no label don't occur.
    A class with more than ``block`` cases is dealt over several keys, so none gathers all of them."""
    links = written(relevance_links(query_labels, kb_labels), "relevance-links")
    parts = links.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_cases") / block) - 1)))
    sizes = links.select("kb_set", F.ceil(F.col("n_cases") / block).alias("parts")).distinct()
    cases = label_sets(kb_labels).withColumnRenamed("labels", "kb_set").join(sizes, "kb_set").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts"))).select("kb_set", "part", "uid")
    queries = label_sets(query_labels).select(F.col("uid").alias("query"), F.col("labels").alias("query_set"))
    return queries.join(parts, "query_set").join(cases, ["kb_set", "part"]).select("query", "uid", "relevance")


def ideal_dcg(query_labels: DataFrame, kb_labels: DataFrame, ks: tuple[int, ...], exponential: bool = False) -> DataFrame:
    """``(query, ideal<k>, ...)``: DCG of the ``k`` highest relevances that the knowledge base has for a query, from class
    sizes. Queries to which nothing is relevant don't occur."""
    links = relevance_links(query_labels, kb_labels)
    sums = [0.0]
    for rank in range(1, max(ks) + 1):
        sums.append(sums[-1] + 1 / math.log2(rank + 1))
    table = F.array(*[F.lit(x) for x in sums])  # discounts of the first 0, 1, ... ranks
    steps = links.groupBy("query_set", "relevance").agg(F.sum("n_cases").alias("n"))
    upto = Window.partitionBy("query_set").orderBy(F.desc("relevance"))  # a row per number of shared labels
    end = F.sum("n").over(upto)
    placed = steps.withColumn("end", end).withColumn("begin", end - F.col("n"))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1 if exponential else F.col("relevance").cast("double")
    upper = lambda c, k: table[F.least(F.col(c), F.lit(k)).cast("int")]
    ideal = placed.groupBy("query_set").agg(*[F.sum(gain * (upper("end", k) - upper("begin", k))).alias(f"ideal{k}") for k in ks])
    queries = label_sets(query_labels).select(F.col("uid").alias("query"), F.col("labels").alias("query_set"))
    return queries.join(ideal, "query_set").drop("query_set")


# ---------------------------------------------------------------- orders of which only the needed ranks are known


def _normed(column: pa.Array) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _shared(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Number of labels that each pair of rows shares."""
    code = {x: i for i, x in enumerate(sorted({x for row in left for x in row or ()}))}
    a, b = np.zeros((len(left), len(code)), np.float32), np.zeros((len(right), len(code)), np.float32)
    for m, rows in ((a, left), (b, right)):
        for i, row in enumerate(rows):
            for x in row or ():
                if x in code:
                    m[i, code[x]] = 1
    return a @ b.T


CHUNK = 512  # cases that meet a block of queries at a time
SEEN = "query long, uid long, s double, relevance int, best boolean"


def _blocks(queries: DataFrame, kb: DataFrame, block: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries by (block, slice) and cases by (block, slice): every slice of the base meets every block of queries."""
    n_blocks = max(1, -(-queries.count() // block))
    n_slices = max(1, int(kb.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_blocks, -(-kb.count() // slice_rows))
    q = queries.withColumn("b", F.pmod(F.xxhash64("query"), F.lit(n_blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    k = kb.withColumn("ks", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(n_slices)).cast("int")).withColumn("kb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return q, k


def cosine_ranks(queries: DataFrame, kb: DataFrame, query_labels: DataFrame, kb_labels: DataFrame, k: int, block: int = 2048, slice_rows: int = 32_768) -> DataFrame:
    """``(query, rank, relevance)`` by cosine (to nine digits), ties by uid: the first ``k`` ranks of each query, and that
    of its first relevant case wherever it lies. A task returns ``k + 1`` rows per query at most."""
    q = queries.select(F.col("uid").cast("long").alias("query"), "embedding").where("query IS NOT NULL AND embedding IS NOT NULL")
    q = written(q.join(label_sets(query_labels).withColumnRenamed("uid", "query"), "query", "left"), "rank-queries")
    base = kb.select(F.col("uid").cast("long").alias("uid"), F.col("embedding").alias("k_embedding")).where("uid IS NOT NULL AND k_embedding IS NOT NULL")
    base = written(base.join(label_sets(kb_labels).withColumnRenamed("labels", "k_labels"), "uid", "left"), "rank-base")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "uid": [], "s": [], "relevance": [], "best": []}
        if left.num_rows and right.num_rows:
            ids, a, labels = left.column("query").to_numpy(), _normed(left.column("embedding").combine_chunks()), left.column("labels").to_pylist()
            held = {c: np.zeros(0) for c in ("i", "uid", "s", "rel", "best")}
            for batch in right.to_batches(max_chunksize=CHUNK):
                uid = batch.column("uid").to_numpy()
                s = np.round(a @ _normed(batch.column("k_embedding")).T, 9)
                rel = _shared(labels, batch.column("k_labels").to_pylist())
                s[uid[None, :] == ids[:, None]] = -np.inf
                kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                i, j = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
                hit = np.where((rel > 0) & np.isfinite(s), s, -np.inf)
                x, y = np.nonzero((hit == hit.max(1)[:, None]) & np.isfinite(hit))
                held = {c: np.concatenate([held[c], v]) for c, v in (("i", np.concatenate([i, x])), ("uid", np.concatenate([uid[j], uid[y]])), ("s", np.concatenate([s[i, j], s[x, y]])), ("rel", np.concatenate([rel[i, j], rel[x, y]])), ("best", np.repeat([0, 1], [len(i), len(x)])))}
                order = np.lexsort((held["uid"], -held["s"], held["best"], held["i"]))
                group = held["i"][order] * 2 + held["best"][order]
                first = np.searchsorted(group, group)
                keep = order[np.arange(len(order)) - first < np.where(held["best"][order] > 0, 1, k)]
                held = {c: v[keep] for c, v in held.items()}
            out = {"query": ids[held["i"].astype(int)], "uid": held["uid"].astype(np.int64), "s": held["s"], "relevance": held["rel"].astype(np.int32), "best": held["best"] > 0}
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()))})

    left, right = _blocks(q, base, block, slice_rows)
    seen = written(left.groupBy("b", "s").cogroup(right.groupBy("kb", "ks")).applyInArrow(near, SEEN), "rank-seen")
    w = Window.partitionBy("query").orderBy(F.desc("s"), "uid")  # k rows per slice
    top = seen.where("NOT best").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    best = seen.where("best").groupBy("query").agg(F.min(F.struct((-F.col("s")).alias("d"), "uid", "relevance")).alias("f")).select("query", (-F.col("f.d")).alias("s0"), F.col("f.uid").alias("u0"), F.col("f.relevance").alias("relevance"))
    behind = best.join(top.where("relevance > 0").select("query").distinct(), "query", "left_anti")
    behind = written(q.select("query", "embedding").join(behind, "query"), "rank-behind")

    def above(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(left.num_rows, np.int64)
        ids = left.column("query").to_numpy()
        if left.num_rows and right.num_rows:
            a, s0, u0 = _normed(left.column("embedding").combine_chunks()), left.column("s0").to_numpy()[:, None], left.column("u0").to_numpy()[:, None]
            for batch in right.to_batches(max_chunksize=CHUNK):
                uid = batch.column("uid").to_numpy()[None, :]
                s = np.round(a @ _normed(batch.column("k_embedding")).T, 9)
                n += (((s > s0) | ((s == s0) & (uid < u0))) & (uid != u0) & (uid != ids[:, None])).sum(1)
        return pa.table({"query": ids, "n": n})

    left, right = _blocks(behind, base, block, slice_rows)
    counted = left.select("b", "s", "query", "embedding", "s0", "u0").groupBy("b", "s").cogroup(right.select("kb", "ks", "uid", "k_embedding").groupBy("kb", "ks")).applyInArrow(above, "query long, n long")
    first = counted.groupBy("query").agg((F.sum("n") + 1).alias("rank")).join(behind.select("query", "relevance"), "query")
    return top.select("query", "rank", "relevance").unionByName(first.select("query", "rank", "relevance"))


def half_bits(n: int) -> int:
    """Bits of either half of the smallest square domain that holds 0 .. n - 1."""
    h = 1
    while 4**h < n:
        h += 1
    return h


def _round_keys(query: np.ndarray, seed: int, rounds: int = 4) -> list[np.ndarray]:
    q = query.astype(np.int64).view(np.uint64)
    k = mix(mix(q & np.uint64(MASK)) + (q >> np.uint64(32)) + np.uint64(seed * 69069 & MASK))
    return [mix(k + np.uint64(r)) for r in range(rounds)]


def permuted(place: np.ndarray, n: int, query: np.ndarray, seed: int, inverse: bool = False) -> np.ndarray:
    """A bijection of 0 .. n - 1 for each query and seed, as a Feistel network over a square domain that is applied until
    the result lies in it: the case at a place of the order, or with ``inverse`` the place of a case."""
    h = half_bits(n)
    mask, x = np.uint64((1 << h) - 1), place.astype(np.uint64)
    keys = _round_keys(query, seed)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(h), x[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left + k[todo]) & mask), left
            else:
                left, right = right, left ^ (mix(right + k[todo]) & mask)
        x[todo] = (left << np.uint64(h)) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def random_ranks(queries: DataFrame, kb: DataFrame, query_labels: DataFrame, kb_labels: DataFrame, seed: int, k: int) -> DataFrame:
    """``(query, rank, uid, relevance)`` of a random order of the base for each query: the first ``k`` ranks, and the first
    relevant case wherever it lies.

    For the latter a query with c relevant cases of n either takes the places of all of them (c * c <= n), or walks on
    from rank ``k`` in windows that grow fourfold, some n / c ranks: at most about the root of n either way."""
    base = written(numbered(kb.select("uid").join(label_sets(kb_labels), "uid", "left"), "i", "uid"), "random-base")
    n = base.count()
    q = queries.select(F.col("uid").cast("long").alias("query")).where("query IS NOT NULL").distinct().join(label_sets(query_labels).select(F.col("uid").alias("query"), F.col("labels").alias("query_set")), "query", "left")
    links = written(relevance_links(query_labels, kb_labels), "relevance-links")
    q = written(q.join(links.groupBy("query_set").agg(F.sum("n_cases").alias("c")), "query_set", "left").withColumn("c", F.coalesce("c", F.lit(0))), "random-queries")

    def at_ranks(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, max(1, 100_000 // max(1, high - low))):
                    ids = batch.column("query").to_numpy()[a : a + max(1, 100_000 // max(1, high - low))]
                    query, place = np.repeat(ids, high - low), np.tile(np.arange(low, high), len(ids))
                    for at in range(0, len(query), 100_000):
                        part = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_pydict({"query": query[part], "rank": place[part] + 1, "i": permuted(place[part], n, query[part], seed)})

        return run

    def window(open_: DataFrame, low: int, high: int) -> DataFrame:
        rows = open_.select("query").mapInArrow(at_ranks(low, high), "query long, rank long, i long")
        shared = F.coalesce(F.size(F.array_intersect("query_set", "labels")), F.lit(0))
        return rows.join(base, "i").join(open_.select("query", "query_set"), "query").select("query", "rank", "uid", F.when(F.col("query_set").isNull() | F.col("labels").isNull(), 0).otherwise(shared).alias("relevance"))

    top = written(window(q, 0, min(k, n)), "random-top")
    open_ = q.where("c > 0").join(top.where("relevance > 0").select("query").distinct(), "query", "left_anti")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query = batch.column("query").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(permuted(batch.column("i").to_numpy(), n, query, seed, inverse=True) + 1), batch.column("uid"), batch.column("relevance")], names=["query", "rank", "uid", "relevance"])

    few = open_.where(F.col("c") * F.col("c") <= n).join(links.select("query_set", "kb_set", F.col("relevance").cast("int").alias("relevance")), "query_set").join(base.withColumnRenamed("labels", "kb_set"), "kb_set")
    found = [few.select("query", "i", "uid", "relevance").mapInArrow(places, "query long, rank long, uid long, relevance int")]
    walkers = written(open_.where(F.col("c") * F.col("c") > n), "random-open")
    low, high = k, 5 * k
    while low < n and not walkers.isEmpty():
        hits = written(window(walkers, low, min(high, n)).where("relevance > 0"), "random-hits")
        found.append(hits)
        walkers = written(walkers.join(hits.select("query").distinct(), "query", "left_anti"), "random-open")
        low, high = high, high + 4 * (high - low)
    out = top
    for rows in found:
        first = rows.groupBy("query").agg(F.min(F.struct("rank", "uid", "relevance")).alias("f")).select("query", "f.*")
        out = out.unionByName(first.select(*top.columns))
    return out


def random_order_sql(name: str, queries: str, base: str, seed: int) -> str:
    """CTEs that end in ``name`` (query, uid, rank): the whole of the same random order, for small tables. Needs WITH
    RECURSIVE; ``queries`` and ``base`` have a column uid."""
    inner = "SELECT *, x >> h AS l0, x & ((1::BIGINT << h) - 1) AS r0, (1::BIGINT << h) - 1 AS m FROM {}"
    for r in range(4):
        inner = f"SELECT *, r{r} AS l{r + 1}, xor(l{r}, {mix_sql(f'r{r} + k{r}')} & m) AS r{r + 1} FROM ({inner})"
    keys = ", ".join(f"{mix_sql(f'k + {r}')} AS k{r}" for r in range(4))
    step = lambda src: f"SELECT query, place, k0, k1, k2, k3, n, h, (l4 << h) | r4 AS x FROM ({inner.format(src)})"
    return (
        f"{name}n AS (SELECT n, (SELECT min(t.h) FROM range(1, 31) t(h) WHERE (1::BIGINT << (2 * t.h)) >= n) AS h FROM (SELECT count(*) AS n FROM {base})), "
        f"{name}q AS (SELECT query, {keys} FROM (SELECT query, {mix_sql(f'a + (query >> 32) + {seed * 69069 & MASK}')} AS k FROM (SELECT uid AS query, {mix_sql('uid')} AS a FROM {queries}))), "
        f"{name}w AS ({step(f'(SELECT query, place, k0, k1, k2, k3, n, h, place AS x FROM {name}q, (SELECT n, h, unnest(range(n)) AS place FROM {name}n))')} UNION ALL {step(f'(SELECT * FROM {name}w WHERE x >= n)')}), "
        f"{name} AS (SELECT query, uid, place + 1 AS rank FROM {name}w JOIN (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS i FROM {base}) ON i = x)"
    )


# ---------------------------------------------------------------- metrics


def metrics_of(seen: DataFrame, ideal: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per query of ``seen`` (query, rank, relevance), which has the first ranks and the first relevant case: mrr over the
    whole order; recall@k (a hit rate), precision@k and ndcg@k (linear gain; 0 where the ideal is 0)."""
    within = lambda k, x: F.when(F.col("rank") <= k, x).otherwise(0.0)
    hit, worth = (F.col("relevance") > 0).cast("double"), F.col("relevance") / F.log2(F.col("rank") + 1)
    parts = [F.coalesce(1 / F.min(F.when(F.col("relevance") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        parts += [F.max(within(k, hit)).alias(f"recall@{k}"), (F.sum(within(k, hit)) / k).alias(f"precision@{k}"), F.sum(within(k, worth)).alias(f"dcg{k}")]
    m = seen.groupBy("query").agg(*parts).join(ideal, "query", "left")
    ndcg = [F.when(F.coalesce(f"ideal{k}", F.lit(0.0)) > 0, F.col(f"dcg{k}") / F.col(f"ideal{k}")).otherwise(0.0).alias(f"ndcg@{k}") for k in ks]
    return m.select("query", "mrr", *[f"`{x}@{k}`" for k in ks for x in ("recall", "precision")], *ndcg)


def metric_names(ks: tuple[int, ...]) -> list[str]:
    return ["mrr", *[f"{x}@{k}" for k in ks for x in ("recall", "precision")], *[f"ndcg@{k}" for k in ks]]


def cosine_metrics(queries: DataFrame, kb: DataFrame, query_labels: DataFrame, kb_labels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    return metrics_of(cosine_ranks(queries, kb, query_labels, kb_labels, max(ks)), ideal_dcg(query_labels, kb_labels, ks), ks)


def random_metrics(queries: DataFrame, kb: DataFrame, query_labels: DataFrame, kb_labels: DataFrame, ks: tuple[int, ...], seeds: tuple[int, ...]) -> DataFrame:
    """The baseline: a query's metrics averaged over random orders."""
    ideal = written(ideal_dcg(query_labels, kb_labels, ks), "ideal")
    runs = [metrics_of(random_ranks(queries, kb, query_labels, kb_labels, s, max(ks)), ideal, ks) for s in seeds]
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    return every.groupBy("query").agg(*[F.avg(f"`{m}`").alias(m) for m in metric_names(ks)])


def encoder_comparison(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    """``(level, encoder, cls, *metrics)`` over rows (query, encoder, cls, *metrics): per encoder the mean over its queries
    (micro), per encoder and class the mean over the class's queries (class), and the mean of these (macro)."""
    means = lambda df, *keys: df.groupBy(*keys).agg(*[F.avg(f"`{m}`").alias(m) for m in metrics])
    classes = written(means(per_query, "encoder", "cls"), "per-class")
    none = F.lit(None).cast("string")
    shown = lambda df, level, cls: df.select(F.lit(level).alias("level"), "encoder", cls.alias("cls"), *[f"`{m}`" for m in metrics])
    return shown(means(per_query, "encoder"), "micro", none).unionByName(shown(means(classes, "encoder"), "macro", none)).unionByName(shown(classes, "class", F.col("cls")))
