"""Nearest cases, votes and evidence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from casebook.functions.vectors import dot
from casebook.session import new_path


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def knn_topk(queries: DataFrame, kb: DataFrame, k: int, block: int = 8192, slice_rows: int = 65_536) -> DataFrame:
    """Exact cosine neighbours: ``(query, uid, similarity, rank)``, ties by uid; a case is no neighbour of itself.

    Inputs are ``(uid, embedding)``. Queries are dealt into blocks of ``block`` vectors or so, each a few MB, and every
    slice of the knowledge base, ``slice_rows`` vectors or so whatever the size of the base, meets every block: a slice
    streams past its block in small products, of which only the best ``k`` per query are kept. The final rank is a window
    over ``k`` rows per query and slice.
    """
    return topk_per_query(_streamed(queries, kb, k, block, slice_rows), k)


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("uid").cast("long").alias("uid"), "embedding").where("uid IS NOT NULL AND embedding IS NOT NULL")


def _streamed(queries: DataFrame, kb: DataFrame, k: int, block: int, slice_rows: int, codes: Callable | None = None) -> DataFrame:
    """``(query, uid, similarity)``: the best ``k`` per query and slice; with ``codes`` only of cases that share a bucket."""
    spark = kb.sparkSession
    q, base = _vectors(queries), _vectors(kb)
    if q.schema["embedding"].dataType.elementType != base.schema["embedding"].dataType.elementType:
        q, base = (x.withColumn("embedding", F.col("embedding").cast("array<double>")) for x in (q, base))
    n_blocks = max(1, -(-q.count() // block))
    # small bases still give every core some
    n_slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks, -(-base.count() // slice_rows))
    q = q.select(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("s"), F.lit(False).alias("is_base"), "uid", "embedding")
    base = base.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(n_slices)).alias("s"), F.lit(True).alias("is_base"), "uid", "embedding")
    both = q.unionByName(base).select((F.col("b") * n_slices + F.col("s")).cast("long").alias("g"), "is_base", "uid", "embedding")
    met = both.repartition(n_blocks * n_slices, "g").sortWithinPartitions("g", "is_base")
    return met.mapInArrow(_best(k, codes), "query long, uid long, similarity double")


def _best(k: int, codes: Callable | None, rows: int = 2048, cells: int = 1 << 19):
    """Rows (g, is_base, uid, embedding) sorted by the first two: a group's queries are held, its cases stream past them,
    at most ``cells`` similarities at a time."""

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def found(held) -> Iterator[pa.RecordBatch]:
        _, ids, _, _, top_s, _, top_u = held
        for at in range(0, len(ids), 2048):
            part = slice(at, at + 2048)
            ok = np.isfinite(top_s[part])
            yield pa.RecordBatch.from_pydict({"query": np.repeat(ids[part], ok.sum(1)), "uid": top_u[part][ok], "similarity": top_s[part][ok]})

    def meet(held, uid: np.ndarray, m: np.ndarray) -> None:
        _, ids, a, own, top_s, top_r, top_u = held
        theirs = codes(m) if codes else None
        u, step = unit(m).T, max(1, cells // max(1, len(uid)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            s = a[part] @ u
            s[ids[part, None] == uid] = -np.inf
            if codes:
                s[~_shared(own[part], theirs)] = -np.inf
            # equal to nine digits ranks by uid, so what equals the last one held is looked at too
            pick = np.isfinite(s) & (s >= top_r[part, -1:] - 1e-9)
            if s.shape[1] > k and pick.sum() > 8 * k * len(s):
                finite = np.where(pick, s, -np.inf)
                pick &= s >= np.partition(finite, -k, axis=1)[:, -k, None] - 2e-9
            row, col = np.nonzero(pick)
            if not len(row):
                continue
            row = np.concatenate([np.repeat(np.arange(len(s)), k), row])
            sims, ids_ = np.concatenate([top_s[part].ravel(), s[pick]]), np.concatenate([top_u[part].ravel(), uid[col]])
            order = np.lexsort((ids_, -np.round(sims, 9), row))
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(s)))[row]
            order = order[place < k]
            top_s[part], top_u[part] = sims[order].reshape(-1, k), ids_[order].reshape(-1, k)
            top_r[part] = np.round(top_s[part], 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                g, is_base, uid, m = batch.column("g").to_numpy(), batch.column("is_base").to_numpy(zero_copy_only=False), batch.column("uid").to_numpy(), batch.column("embedding")
                cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (is_base[1:] != is_base[:-1])) + 1).tolist(), len(g)]
                for x, y in zip(cuts, cuts[1:]):
                    if held is not None and held[0] != g[x]:
                        yield from found(held)
                        held = None
                    if not is_base[x]:
                        if waiting and waiting[0][0] != g[x]:
                            waiting = []
                        waiting.append((g[x], uid[x:y].copy(), _matrix(m.slice(x, y - x))))
                        continue
                    if held is None and waiting and waiting[0][0] == g[x]:
                        ids, a = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
                        held = (g[x], ids, unit(a), codes(a) if codes else None, np.full((len(ids), k), -np.inf), np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64))
                    waiting = []
                    if held is not None:
                        meet(held, uid[x:y], _matrix(m.slice(x, y - x)))
        if held is not None:
            yield from found(held)

    return run


def _shared(own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Which of two sets of vectors share a bucket of a table, from their codes by (vector, table)."""
    out = np.zeros((len(own), len(theirs)), bool)
    for t in range(own.shape[1]):
        order = np.argsort(theirs[:, t])
        ranked = theirs[order, t]
        start = np.searchsorted(ranked, own[:, t])
        count = np.searchsorted(ranked, own[:, t], "right") - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        out[np.repeat(np.arange(len(own)), count), order[at]] = True
    return out


def topk_per_query(scored: DataFrame, k: int) -> DataFrame:
    """Rank ``(query, uid, similarity)`` per query and keep the first ``k``; equal similarities (to nine digits) by uid."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "uid")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ann_topk(queries: DataFrame, kb: DataFrame, k: int, bucket_rows: int = 256, least: float = 0.5, missed: float = 0.02, seed: int = 11, block: int = 8192, slice_rows: int = 65_536) -> DataFrame:
    """Approximate neighbours: signed random projections put unit vectors into buckets of several tables; cases that share
    a bucket with a query are ranked exactly. Every case is in every table.

    The number of planes follows the base, for buckets of about ``bucket_rows`` vectors; the number of tables follows
    from it, so that a case with a cosine of ``least`` is missed with a chance of ``missed`` at most. Vectors move as in
    ``knn_topk``, in blocks of queries and slices of the base; buckets are met inside the tasks, and neither codes nor
    pairs leave them."""
    n = kb.count()
    planes = max(4, math.ceil(math.log2(max(1, n / bucket_rows))))
    same_side = 1 - math.acos(least) / math.pi
    tables = math.ceil(math.log(missed) / math.log1p(-(same_side**planes)))

    def codes(m: np.ndarray) -> np.ndarray:
        normal = np.random.default_rng(seed).standard_normal((m.shape[1], planes * tables))
        parts = [((m[at : at + 1024] @ normal > 0).reshape(-1, tables, planes) @ (1 << np.arange(planes))).astype(np.int32) for at in range(0, len(m), 1024)]
        return np.concatenate(parts)

    return topk_per_query(_streamed(queries, kb, k, block, slice_rows, codes), k)


def retrieve(near: DataFrame, least: float, k: int) -> DataFrame:
    """The ``k`` nearest first, the threshold after that: no others move up."""
    return near.where((F.col("rank") <= k) & (F.col("similarity") >= least))


def get_by_ids(requested: DataFrame, index: DataFrame) -> DataFrame:
    """Stored cases for ``(session, uid, rank)`` in the order asked for; unknown ids fall out; similarity is 1."""
    return requested.join(index, "uid").withColumn("similarity", F.lit(1.0))


def session_evidence(requested: DataFrame, index: DataFrame, case_labels: DataFrame, similarity: str = "unit") -> DataFrame:
    """``(query, evidence, votes)``: the stored cases of a session in the order of their ranks and the vote over them;
    ``requested`` (query, uid, rank), ids without a case fall out. Cases weigh 1 each (``unit``), or what ``requested``
    has as their similarity (``stored``)."""
    found = get_by_ids(requested, index) if similarity == "unit" else requested.join(index, "uid")
    listed = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "uid", "similarity"))).alias("evidence"))
    votes = label_vote(found, case_labels).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("vote_rank", "label", "vote_weight", "agreement"))).alias("votes"))
    return listed.join(votes, "query", "left")


def label_vote(near: DataFrame, case_labels: DataFrame) -> DataFrame:
    """``(query, label, vote_weight, agreement, vote_rank)``: sum of similarities and share of the query's cases with the
    label. Ties by the smallest case rank, then the label. Agreement divides by all cases of the query."""
    n = near.groupBy("query").agg(F.count("*").alias("n"))
    votes = near.join(case_labels, "uid").groupBy("query", "label").agg(F.sum("similarity").alias("vote_weight"), F.count("*").alias("c"), F.min("rank").alias("r"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("vote_weight", 9)), "r", "label")
    return votes.join(n, "query").select("query", "label", "vote_weight", (F.col("c") / F.col("n")).alias("agreement"), F.row_number().over(w).cast("long").alias("vote_rank"))


def _evidence():
    return [F.desc(F.round("similarity", 9)), F.col("uid").cast("string")]


def evidence_order(near: DataFrame) -> DataFrame:
    """Cases by falling similarity, then by uid as text."""
    return near.withColumn("evidence_rank", F.row_number().over(Window.partitionBy("query").orderBy(*_evidence())).cast("long"))


def collapse_near_dups(near: DataFrame) -> DataFrame:
    """The best case of each cluster; cases without cluster (-1 or null) all stay."""
    single = (F.coalesce("cluster_id", F.lit(-1)) == -1).cast("int")
    key = F.when(single == 1, F.col("uid").cast("string")).otherwise(F.col("cluster_id").cast("string"))
    w = Window.partitionBy("query", single, key).orderBy(*_evidence())
    return near.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def partition_for_label(near: DataFrame, case_labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Supporting and contradicting cases of ``chosen`` (query, label), each in evidence order."""
    has = case_labels.groupBy("uid").agg(F.collect_set("label").alias("labels"))
    ranked = evidence_order(near).join(chosen, "query").join(has, "uid", "left").withColumn("yes", F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False)))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("evidence_rank", "uid")))), lambda x: x["uid"])
    return ranked.groupBy("query", "label").agg(pick(F.col("yes")).alias("supporting"), pick(~F.col("yes")).alias("contradictory"))


def text_evidence(near: DataFrame, texts: DataFrame, field: str) -> DataFrame:
    """Distinct texts of ``field`` per query in order of first sight; blank ones count."""
    first = evidence_order(near).join(texts, "uid").groupBy("query", F.coalesce(field, F.lit("")).alias("t")).agg(F.min("evidence_rank").alias("r"))
    return first.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias(field))


def retrieval_stats(near: DataFrame, case_labels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Eight measures per query; zeros for queries of ``queries`` without cases. ``near`` carries cluster_id."""
    kept = collapse_near_dups(near)
    a = near.groupBy("query").agg(F.count("*").alias("n_cases"))
    real = F.when(F.col("cluster_id") != -1, F.col("cluster_id"))
    b = kept.groupBy("query").agg(F.count("*").alias("n_kept"), F.avg("similarity").alias("mean_similarity"), F.min("similarity").alias("min_similarity"), F.max("similarity").alias("max_similarity"), F.countDistinct(real).alias("n_clusters"))
    c = kept.join(case_labels, "uid").groupBy("query").agg(F.countDistinct("label").alias("n_labels"))
    j = a.join(b, "query").join(c, "query", "left")
    if queries is not None:
        j = queries.select("query").distinct().join(j, "query", "left")
    j = j.withColumn("n_collapsed", F.col("n_cases") - F.col("n_kept"))
    return j.select("query", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_cases", "n_kept", "n_collapsed", "mean_similarity", "min_similarity", "max_similarity", "n_labels", "n_clusters")])


def build_context(near: DataFrame, case_labels: DataFrame, texts: DataFrame) -> DataFrame:
    """One nested evidence record per query: cases after collapsing, votes, label evidence for the top vote, distinct
    texts and the statistics."""
    kept = collapse_near_dups(near)
    vote = label_vote(near, case_labels)
    votes = vote.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("vote_rank", "label", "vote_weight", "agreement"))).alias("votes"))
    cases = evidence_order(kept).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("evidence_rank", "uid", "similarity", "cluster_id"))).alias("cases"))
    top = partition_for_label(kept, case_labels, vote.where("vote_rank = 1").select("query", "label")).select("query", F.struct("label", "supporting", "contradictory").alias("label_evidence"))
    stats = retrieval_stats(near, case_labels)
    stats = stats.select("query", F.struct(*[c for c in stats.columns if c != "query"]).alias("stats"))
    j = cases.join(votes, "query", "left").join(top, "query", "left").join(stats, "query", "left")
    for field in ("findings", "impression"):
        j = j.join(text_evidence(kept, texts, field), "query", "left")
    return j


def agreement_badge(near: DataFrame, cases: DataFrame) -> DataFrame:
    """Share of the most frequent primary label: strong from 0.6, mixed from 0.3, else weak; similarities in percent."""
    j = near.join(cases.select("uid", "primary_label"), "uid")
    by = j.groupBy("query", "primary_label").agg(F.count("*").alias("c"), F.min("rank").alias("r"))
    w = Window.partitionBy("query").orderBy(F.desc("c"), "r", "primary_label")
    lead = by.withColumn("k", F.row_number().over(w)).withColumn("spread", F.count("*").over(Window.partitionBy("query"))).where("k = 1")
    sims = j.groupBy("query").agg(F.count("*").alias("n"), F.max("similarity").alias("top"), F.avg("similarity").alias("mean"))
    share = F.col("c") / F.col("n")
    badge = F.when(share >= 0.6, "strong").when(share >= 0.3, "mixed").otherwise("weak")
    return lead.join(sims, "query").select("query", F.col("primary_label").alias("label"), share.alias("fraction"), badge.alias("badge"), (F.col("top") * 100).alias("top_percent"), (F.col("mean") * 100).alias("mean_percent"), F.col("spread").alias("label_spread"))


# ---------------------------------------------------------------- index


def index_records(cases: DataFrame, normal: str, model: str, version: str = "v1", dataset: str = "") -> DataFrame:
    """The stored record of every case. ``image_path``, ``label_set`` and ``patient_uid`` are taken from ``cases`` where it
    has them (the patient is else derived from the uid, the others empty); missing texts are empty, a missing cluster is -1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cases.columns else F.lit("")
    patient = F.col("patient_uid") if "patient_uid" in cases.columns else F.concat(F.lit("SYN-"), F.col("uid").cast("string"))
    return cases.select(
        F.col("uid").cast("string").alias("study_uid"), patient.alias("patient_uid"), text("image_path").alias("image_path"), F.lit("Frontal").alias("projection"),
        "primary_label", text("label_set").alias("label_set"), (F.col("primary_label") == normal).alias("is_normal"), text("findings").alias("findings"), text("impression").alias("impression"),
        F.lit(dataset).alias("dataset"), F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_version"), "split", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"), "embedding", F.current_timestamp().alias("indexed_at"),
    )


def _rule_counts(records: DataFrame, vectors: DataFrame, dimension: int, test_split: str, tolerance: float) -> DataFrame:
    """One row: how many records, and the rules with their counts, from one pass over either side and one join by uid."""
    size = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = records.groupBy("uid").agg(F.count("*").alias("records"), F.count_if(F.col("split") == test_split).alias("test"), F.count_if(F.col("primary_label").isNull() | F.col("split").isNull()).alias("missing"))
    v = vectors.select("uid", F.coalesce(F.size("embedding"), F.lit(0)).alias("n"), odd.alias("odd"), size.alias("size")).groupBy("uid").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("n") != dimension).alias("dimension"), F.count_if("odd").alias("odd"),
        F.count_if(F.col("size") < 1e-12).alias("zero"), F.count_if((F.col("size") >= 1e-12) & (F.abs(F.col("size") - 1) > tolerance)).alias("deviates"),
    )
    alone = lambda side, other: F.sum(F.when(F.col(other).isNull(), F.col(side)))
    rules = [
        ("error", "test split in index", F.sum("test")), ("error", "record without vector", alone("records", "vectors")), ("error", "vector without record", alone("vectors", "records")),
        ("error", "duplicate record", F.count_if(F.col("records") > 1)), ("error", "duplicate vector", F.count_if(F.col("vectors") > 1)), ("error", "missing field", F.sum("missing")),
        ("error", "dimension", F.sum("dimension")), ("error", "not finite", F.sum("odd")), ("error", "zero norm", F.sum("zero")), ("warning", "norm deviates", F.sum("deviates")),
    ]
    listed = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(name).alias("rule"), F.coalesce(n, F.lit(0)).alias("n")) for s, name, n in rules])
    return r.join(v, "uid", "full").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"), listed.alias("rules"))


def index_validate(records: DataFrame, vectors: DataFrame, dimension: int, test_split: str = "test", tolerance: float = 0.01) -> DataFrame:
    """``(severity, rule, n)`` of broken rules; no rows when all hold. ``records`` (uid, split, primary_label),
    ``vectors`` (uid, embedding)."""
    return _rule_counts(records, vectors, dimension, test_split, tolerance).select(F.inline("rules")).where("n > 0")


def index_build(records: DataFrame, vectors: DataFrame, dimension: int, path: str | None = None, dry_run: bool = False) -> tuple[str | None, DataFrame]:
    """Check, align by uid, write to a new path, verify the count. Returns the path (none on errors or a dry run) and the
    broken rules. What was written before stays as it is; readers switch by taking the new path."""
    spark = records.sparkSession
    counts = _rule_counts(records, vectors, dimension, "test", 0.01).first()  # ten rules, one row
    found = [(r.severity, r.rule, r.n) for r in counts.rules if r.n]
    broken = spark.createDataFrame(found, "severity string, rule string, n long")
    if dry_run or any(severity == "error" for severity, _, _ in found):
        return None, broken
    target = path or new_path(spark, "index")
    seen = Observation()  # counted as it is written
    records.join(vectors, "uid").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(target)
    # tasks that ran twice may have been counted twice: then the files decide
    if seen.get["n"] != counts.total and spark.read.parquet(target).count() != counts.total:
        raise RuntimeError(f"{target} does not hold every record")
    return target, broken


def index_summary(index: DataFrame) -> DataFrame:
    per = index.groupBy("primary_label").agg(F.count("*").alias("n"))
    dist = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("primary_label", "n")))).alias("class_distribution"))
    totals = index.agg(F.count("*").alias("records"), F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"))
    return totals.join(dist, F.lit(True))
