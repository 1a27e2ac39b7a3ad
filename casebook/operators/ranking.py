"""Ranking evaluation, embedding quality and resampling statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.vectors import dot, is_finite, norm
from casebook.operators.metadata import hashed_order, sample_n
from casebook.operators.resampling import resampled_sums

KS = (1, 3, 5, 10)


def gain(relevance, exponential: bool = False):
    return F.pow(F.lit(2.0), relevance) - 1 if exponential else relevance.cast("double")


def dcg(ranked: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """``(query, dcg)`` over rows (query, rank, relevance)."""
    return ranked.where(F.col("rank") <= k).groupBy("query").agg(F.sum(gain(F.col("relevance"), exponential) / F.log2(F.col("rank") + 1)).alias("dcg"))


def micro_average(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    return per_query.groupBy("encoder").agg(*[F.avg(f"`{m}`").alias(m) for m in metrics])


def per_class_average(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    return per_query.groupBy("encoder", "cls").agg(*[F.avg(f"`{m}`").alias(m) for m in metrics])


def macro_average(per_query: DataFrame, metrics: list[str]) -> DataFrame:
    return micro_average(per_class_average(per_query, metrics), metrics)


def perclass_pivot(per_query: DataFrame, metric: str, encoders: list[str]) -> DataFrame:
    p = per_query.groupBy("cls").pivot("encoder", encoders).agg(F.avg(f"`{metric}`"))
    return p.withColumn("first_wins", (F.col(encoders[0]) > F.col(encoders[1])).cast("int"))


# ---------------------------------------------------------------- embedding quality


def array_health(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    n = norm(F.col("embedding"))
    return vectors.agg(F.count("*").alias("n"), F.min(is_finite(F.col("embedding"))).alias("all_finite"), F.count_if(n < 1e-8).alias("zero_vectors"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm")).withColumn("ok", F.col("all_finite") & (F.col("zero_vectors") == 0) & (F.abs(F.col("mean_norm") - 1) <= tolerance))


def neardup_cohesion(vectors: DataFrame, clusters: DataFrame, n_random: int, seed: int, gap: float = 0.1, block: int = 512) -> DataFrame:
    """Similarity of all pairs within clusters against that of hashed random pairs: n_cluster_pairs, within_mean,
    within_min, n_random_pairs, random_mean, passed.

    The mean over a cluster's pairs follows from the sum of its vectors. The least similarity needs the pairs: they are
    formed between blocks of about ``block`` members, each pair of blocks a key of its own, and reduced where they are
    formed. ``n_random`` pairs are the stated size of the sample."""
    v = vectors.join(clusters, "uid").select("uid", "cluster_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    size = v.groupBy("cluster_id").agg(F.count("*").alias("k"), F.sum(dot(F.col("embedding"), F.col("embedding"))).alias("own")).where("k > 1")
    sums = v.select("cluster_id", F.posexplode("embedding").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("cluster_id").agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    mean = size.join(whole, "cluster_id").agg((F.sum((F.col("all") - F.col("own")) / 2) / F.sum(F.col("k") * (F.col("k") - 1) / 2)).alias("within_mean"), F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("n_cluster_pairs"))
    blocks = v.join(size.select("cluster_id", F.ceil(F.col("k") / block).alias("n")), "cluster_id").withColumn("b", F.pmod(F.xxhash64("uid"), F.col("n")))
    every = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    left = blocks.select("cluster_id", F.col("b").alias("l"), F.explode(every).alias("r"), F.col("uid").alias("lu"), F.col("embedding").alias("le"))
    right = blocks.select("cluster_id", F.explode(every).alias("l"), F.col("b").alias("r"), F.col("uid").alias("ru"), F.col("embedding").alias("re"))
    least = left.join(right, ["cluster_id", "l", "r"]).where("lu < ru").agg(F.min(dot(F.col("le"), F.col("re"))).alias("within_min"))
    order = v.select("uid", "embedding", hashed_order("uid", seed=seed).alias("h")).orderBy("h", "uid").limit(2 * n_random)  # a stated sample
    w = Window.orderBy("h", "uid")
    pairs = order.withColumn("r", F.row_number().over(w)).withColumn("other", F.lead("embedding").over(w)).where("r % 2 = 1 AND other IS NOT NULL")
    random = pairs.agg(F.avg(dot(F.col("embedding"), F.col("other"))).alias("random_mean"), F.count("*").alias("n_random_pairs"))
    return mean.join(least).join(random).withColumn("passed", F.col("within_mean") - F.col("random_mean") > gap)


def cross_modal_accuracy(a: DataFrame, b: DataFrame, batch: int = 50) -> DataFrame:
    """Within batches of ids: does a vector's own partner come first, or among the first five?"""
    left = a.select((F.col("uid") / batch).cast("long").alias("g"), F.col("uid").alias("query"), F.col("embedding").alias("q"))
    right = b.select((F.col("uid") / batch).cast("long").alias("g"), "uid", "embedding")
    s = left.join(right, "g").select("g", "query", "uid", dot(F.col("q"), F.col("embedding")).alias("s"))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "uid"))).where("query = uid")
    size = right.groupBy("g").agg(F.count("*").alias("k")).agg(F.avg(1 / F.col("k")).alias("baseline"))
    return r.agg(F.avg((F.col("r") == 1).cast("double")).alias("top1"), F.avg((F.col("r") <= 5).cast("double")).alias("top5"), F.count("*").alias("n")).join(size)


def masking_impact(before: DataFrame, after: DataFrame, least: float = 0.9) -> DataFrame:
    j = before.join(after.select("uid", F.col("embedding").alias("other")), "uid")
    s = dot(F.col("embedding"), F.col("other")) / (norm(F.col("embedding")) * norm(F.col("other")))
    return j.select("uid", s.alias("similarity")).withColumn("flagged", F.col("similarity") < least)


# ---------------------------------------------------------------- resampling


def percentile_ci(df: DataFrame, column: str, group: list[str], alpha: float = 0.05) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return df.groupBy(*group).agg(q.alias("q")).select(*group, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def resampled_means(cases: DataFrame, value: str, n_boot: int, seed: int, group: list[str] | None = None) -> DataFrame:
    """``(*group, rep, m)``: mean of the drawn cases that have a value."""
    group = group or []
    rows = cases.select("uid", *group, F.col(value).alias("s"), F.col(value).isNotNull().cast("int").alias("k"))
    return resampled_sums(rows, ["s", "k"], n_boot, seed, group).where("k > 0").select(*group, "rep", (F.col("s") / F.col("k")).alias("m"))


def bootstrap_mean_ci(cases: DataFrame, value: str, n_boot: int, seed: int) -> DataFrame:
    reps = resampled_means(cases, value, n_boot, seed)
    return cases.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(percentile_ci(reps, "m", []))


def bootstrap_stratified_macro(cases: DataFrame, value: str, cls: str, n_boot: int, seed: int) -> DataFrame:
    reps = resampled_means(cases, value, n_boot, seed, [cls]).groupBy("rep").agg(F.avg("m").alias("m"))
    point = cases.groupBy(cls).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))
    return point.join(percentile_ci(reps, "m", []))


def bootstrap_paired_diff(cases: DataFrame, a: str, b: str, cls: str, n_boot: int, seed: int) -> DataFrame:
    """Both systems on the same draws."""
    return bootstrap_stratified_macro(cases.withColumn("__d", F.col(a) - F.col(b)), "__d", cls, n_boot, seed).withColumnRenamed("mean", "delta")


def f1_rows(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of rows with tp, fp, fn; 0 where undefined."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", part(tp, tp + fp)).withColumn("recall", part(tp, tp + fn)).withColumn("f1", part(2 * tp, 2 * tp + fp + fn))


def confusion_counts(matrix: DataFrame, keys: list[str]) -> DataFrame:
    g, r = F.col("gen") == 1, F.col("ref") == 1
    return matrix.groupBy(*keys).agg(F.count_if(g & r).alias("tp"), F.count_if(g & ~r).alias("fp"), F.count_if(~g & r).alias("fn"))


def confusion_f1(matrix: DataFrame) -> DataFrame:
    """Per label, plus the rows ``(macro)`` and ``(micro)``; ``matrix`` (uid, label, ref, gen)."""
    per = f1_rows(confusion_counts(matrix, ["label"]))
    macro = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).withColumn("label", F.lit("(macro)"))
    micro = f1_rows(confusion_counts(matrix, [])).withColumn("label", F.lit("(micro)"))
    return reduce(DataFrame.unionByName, [per, macro, micro])


def bootstrap_f1_ci(matrix: DataFrame, n_boot: int, seed: int, partners: DataFrame | None = None) -> DataFrame:
    """``(metric, low, high, excludes_zero)``: intervals of micro and macro f1; a case is drawn with all its labels.

    With ``partners`` (uid, partner) the same draws also score each case against its partner's reference: rows of that
    mismatched baseline, and of the macro f1 gained over it."""
    sides = matrix.select("uid", F.lit("").alias("side"), "label", "gen", "ref")
    if partners is not None:
        other = matrix.select(F.col("uid").alias("partner"), "label", "ref")
        crossed = matrix.select("uid", "label", "gen").join(partners, "uid").join(other, ["partner", "label"])
        sides = sides.unionByName(crossed.select("uid", F.lit("baseline_").alias("side"), "label", "gen", "ref"))
    # a case is one row of counts, three for every side and label; labels are the classes of the taxonomy, few
    kinds = [(r.side, r.label) for r in sides.select("side", "label").distinct().orderBy("side", "label").collect()]
    cells = {"tp": "gen = 1 AND ref = 1", "fp": "gen = 1 AND ref <> 1", "fn": "gen <> 1 AND ref = 1"}
    count = lambda k, test: F.count_if((F.col("side") == k[0]) & (F.col("label") == k[1]) & F.expr(test))
    wide = sides.groupBy("uid").agg(*[count(k, test).alias(f"{c}{i}") for i, k in enumerate(kinds) for c, test in cells.items()])
    sums = resampled_sums(wide, [f"{c}{i}" for i in range(len(kinds)) for c in cells], n_boot, seed)
    parts = [F.struct(F.lit(k[0]).alias("side"), F.lit(k[1]).alias("label"), *[F.col(f"{c}{i}").alias(c) for c in cells]) for i, k in enumerate(kinds)]
    per = f1_rows(sums.select("rep", F.explode(F.array(*parts)).alias("x")).select("rep", "x.*"))
    both = per.groupBy("rep", "side").agg(F.avg("f1").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    both = f1_rows(both).select("rep", "side", "macro_f1", F.col("f1").alias("micro_f1"))
    long = both.unpivot(["rep", "side"], ["macro_f1", "micro_f1"], "m", "v").select("rep", F.concat("side", "m").alias("metric"), "v")
    if partners is not None:
        sign = F.when(F.col("side") == "", 1.0).otherwise(-1.0)
        long = long.unionByName(both.groupBy("rep").agg(F.sum(sign * F.col("macro_f1")).alias("v")).select("rep", F.lit("macro_f1_gain").alias("metric"), "v"))
    return percentile_ci(long, "v", ["metric"]).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def metric_ci_table(cases: DataFrame, metrics: list[str], n_boot: int, seed: int) -> DataFrame:
    """n, mean, interval and width of every metric column."""
    long = cases.unpivot("uid", metrics, "metric", "v").where("v IS NOT NULL")
    reps = resampled_means(long, "v", n_boot, seed, ["metric"])
    point = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return point.join(percentile_ci(reps, "m", ["metric"]), "metric").withColumn("width", F.col("high") - F.col("low"))


def gate_table(intervals: DataFrame) -> DataFrame:
    """Over (comparison, metric, delta, low, high): does the interval exclude zero, and which way?"""
    out = intervals.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
    return out.withColumn("direction", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("not distinguishable"))


def gate_decision(gates: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """A comparison passes when every metric it requires is better with an interval that excludes zero."""
    need = reduce(lambda a, b: a | b, [(F.col("comparison") == c) & F.col("metric").isin(ms) for c, ms in required.items()])
    return gates.where(need).groupBy("comparison").agg(F.bool_and(F.col("direction") == "better").alias("passed"))


def required_n(table: DataFrame, target: float = 0.2, failure_rate: float = 0.0) -> DataFrame:
    """Cases needed for a width of ``target`` times the mean, the width falling with the root of n; the binding metric
    needs most. ``table``: rows of ``metric_ci_table``."""
    need = table.withColumn("required", F.col("n") * F.pow(F.col("width") / (target * F.col("mean")), 2))
    need = need.withColumn("to_sample", F.ceil(F.col("required") / (1 - failure_rate)))
    top = need.agg(F.max_by("metric", "required").alias("binding"))
    return need.join(F.broadcast(top)).withColumn("is_binding", F.col("metric") == F.col("binding")).drop("binding")


def width_scaling(cases: DataFrame, metrics: list[str], sizes: tuple[int, ...], n_boot: int, seed: int) -> DataFrame:
    """``(metric, n, width, predicted)``: widths measured on hashed sub-samples of stated ``sizes`` beside what the root
    rule of ``required_n`` predicts for them from all cases."""
    whole = metric_ci_table(cases, metrics, n_boot, seed).select("metric", F.col("n").alias("n_all"), F.col("width").alias("width_all"))
    parts = [metric_ci_table(sample_n(cases, n, seed), metrics, n_boot, seed).select("metric", "n", "width") for n in sizes]
    j = reduce(DataFrame.unionByName, parts).join(whole, "metric")
    return j.select("metric", "n", "width", (F.col("width_all") * F.sqrt(F.col("n_all") / F.col("n"))).alias("predicted"))
