"""Metadata consolidation and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.session import written


def projection_rollup(projections: DataFrame) -> DataFrame:
    return projections.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list("filename")), ";").alias("image_ids"), F.array_join(F.array_sort(F.collect_set("projection")), ";").alias("projections_available"), F.count("*").alias("num_images"))


def master_metadata(index: DataFrame, reports: DataFrame, splits: DataFrame, projections: DataFrame, paths: DataFrame) -> DataFrame:
    """The study index with texts, split and cluster, projections and paths; missing sides stay null."""
    return reduce(lambda a, b: a.join(b, "uid", "left"), [reports, splits, projection_rollup(projections), paths], index)


def preserve_created_at(new: DataFrame, old: DataFrame, now) -> DataFrame:
    return new.join(old.select("uid", F.col("created_at").alias("__c")), "uid", "left").withColumn("created_at", F.coalesce("__c", F.lit(now).cast("timestamp"))).drop("__c")


def with_embedding_cached(studies: DataFrame, caches: list[DataFrame]) -> DataFrame:
    keys = reduce(DataFrame.union, [c.select("uid") for c in caches]).distinct().withColumn("__k", F.lit(True))
    return studies.join(keys, "uid", "left").withColumn("embedded", F.coalesce("__k", F.lit(False))).drop("__k")


def purity_gate(index: DataFrame, splits: DataFrame) -> DataFrame:
    """Index ids that are test ids, and index ids outside train and validation."""
    test = splits.where("split = 'test'").select("uid")
    allowed = splits.where("split IN ('train', 'val')").select("uid")
    a = index.select("uid").intersect(test).agg(F.count("*").alias("n")).select(F.lit("in test").alias("rule"), "n")
    b = index.select("uid").distinct().join(allowed, "uid", "left_anti").agg(F.count("*").alias("n")).select(F.lit("not allowed").alias("rule"), "n")
    return a.unionByName(b).withColumn("passed", F.col("n") == 0)


def drop_reasons(df: DataFrame, predicates: list[tuple[str, object]]) -> DataFrame:
    """Rows lost to each predicate in order: a row counts for the first one it fails."""
    first = reduce(lambda w, p: w.when(~p[1], p[0]), predicates[1:], F.when(~predicates[0][1], predicates[0][0]))
    return df.select(first.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def id_set_checks(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.select("uid").distinct(), right.select("uid").distinct()
    return a.join(b, "uid", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "uid", "left_anti").withColumn("side", F.lit("right")))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def common_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("uid").intersect(right.select("uid"))


def hashed_order(*columns, seed: int):
    """An order that looks random and is the same in every engine that multiplies integers: (a * 48271 + seed * 69621) mod 2^31 - 1 over integer keys."""
    key = reduce(lambda a, b: (a * 31 + b) % 2147483647, [F.col(c).cast("long") % 2147483647 for c in columns])
    return (key * 48271 + seed * 69621) % 2147483647


def sample_stratified(rows: DataFrame, cls: str, n: int, seed: int) -> DataFrame:
    """Per class ``min(size, max(1, n // classes))`` rows in hashed order, filled up from the others, cut to ``n``.

    The best rows of a class are found by a limited rank, of which every task sends its own best alone; the filling is an
    ordered limit. No task holds a class."""
    k = rows.select(cls).distinct().count()
    take = max(1, n // max(k, 1))
    hashed = rows.withColumn("__h", hashed_order("uid", seed=seed))
    best = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(cls).orderBy("__h", "uid"))).where(F.col("__r") <= take).drop("__r")
    best = written(best.orderBy("__h", "uid").limit(n), "sample")
    missing = n - best.count()
    rest = hashed.join(best.select("uid"), "uid", "left_anti").orderBy("__h", "uid").limit(missing)
    return best.unionByName(rest.select(*best.columns)).drop("__h")


def sample_n(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(hashed_order("uid", seed=seed), "uid").limit(n)


def derangement(ids: DataFrame, seed: int) -> DataFrame:
    """``(uid, partner)``: a permutation without fixed point (but for a single id). Ids are put into hashed order over
    ranges, and each takes the next; the last of a range takes the first of the next range that has any, and the last of
    all the first of all. Beyond its range a task needs to know range ends alone."""
    put = ids.select("uid").distinct().withColumn("h", hashed_order("uid", seed=seed))
    ranged = written(put.repartitionByRange("h", "uid").withColumn("__p", F.spark_partition_id()), "ranged")
    next_ = ranged.select("uid", "__p", F.lead("uid").over(Window.partitionBy("__p").orderBy("h", "uid")).alias("n"))
    firsts = ranged.groupBy("__p").agg(F.min_by("uid", F.struct("h", "uid")).alias("f"))  # a row per range
    w = Window.orderBy("__p")
    ring = firsts.select("__p", F.coalesce(F.lead("f").over(w), F.first("f").over(w)).alias("f2"))
    return next_.join(ring, "__p").select("uid", F.coalesce("n", "f2").alias("partner"))
