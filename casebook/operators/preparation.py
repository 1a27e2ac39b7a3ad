"""Small table operators around cleaning, paths, boxes, labels and evaluation pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import is_real_text
from casebook.operators.metadata import sample_stratified

# ---------------------------------------------------------------- texts


def with_full_text(df: DataFrame) -> DataFrame:
    """``has_findings`` and ``full_text`` beside cleaned findings and impression."""
    return df.withColumn("has_findings", F.length("findings") > 0).withColumn("full_text", F.trim(F.concat_ws(" ", "findings", "impression")))


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """One row: studies, those without findings, those without any text."""
    t = with_full_text(cleaned)
    return t.agg(F.count("*").alias("studies"), F.count_if(~F.col("has_findings")).alias("missing_findings"), F.count_if(F.col("full_text") == "").alias("empty_text"))


def null_safe_fields(rows: DataFrame, texts: tuple[str, ...] = ("findings", "impression"), cluster: str = "cluster_id") -> DataFrame:
    """Missing texts become empty, a missing cluster becomes -1; other columns stay."""
    rows = reduce(lambda d, c: d.withColumn(c, F.coalesce(c, F.lit(""))), texts, rows)
    return rows.withColumn(cluster, F.coalesce(cluster, F.lit(-1)))


# ---------------------------------------------------------------- keys, paths and stages


def synthetic_keys(studies: DataFrame, raw: DataFrame, masked: DataFrame) -> DataFrame:
    """Adds ``study_uid``, ``patient_uid``, ``raw_path``, ``masked_path`` and whether each path exists. ``raw`` (uid,
    raw_path) lists frontal files, ``masked`` (uid, listed) the masked ones; a mask counts where its raw file exists."""
    j = studies.join(raw, "uid", "left").join(masked, "uid", "left")
    j = j.withColumn("study_uid", F.col("uid").cast("string")).withColumn("patient_uid", F.concat(F.lit("SYN-"), "study_uid"))
    j = j.withColumn("masked_path", F.when(F.col("raw_path").isNotNull(), F.col("listed"))).drop("listed")
    return j.withColumn("raw_exists", F.col("raw_path").isNotNull()).withColumn("masked_exists", F.col("masked_path").isNotNull())


def processing_stage(raw: Column, masked: Column, embedded: Column) -> Column:
    return F.when(raw.isNull(), "Missing").when(embedded, "Embedded").when(masked.isNotNull(), "Masked").otherwise("Raw")


def stage_distribution(keys: DataFrame) -> DataFrame:
    """Studies by stage over (raw_path, masked_path, embedded)."""
    return keys.groupBy(processing_stage(F.col("raw_path"), F.col("masked_path"), F.col("embedded")).alias("stage")).agg(F.count("*").alias("n"))


def embed_input_choice(keys: DataFrame) -> DataFrame:
    """``(uid, input, fallback)``: the masked file, else the raw one; studies with neither fall out."""
    return keys.select("uid", F.coalesce("masked_path", "raw_path").alias("input"), F.col("masked_path").isNull().alias("fallback")).where("input IS NOT NULL")


def train_metadata(cases: DataFrame, keys: DataFrame) -> DataFrame:
    """``(uid, raw_path, missing_masked)`` of train cases with a raw file."""
    j = cases.join(keys, "uid").where("split = 'train' AND raw_path IS NOT NULL")
    return j.select("uid", "raw_path", F.col("masked_path").isNull().alias("missing_masked"))


# ---------------------------------------------------------------- labels


def parse_labels(primary: Column, label_set: Column) -> Column:
    """Primary label first, then the other labels of a ``;``-joined set, trimmed, once each, sorted."""
    rest = F.filter(F.transform(F.split(F.coalesce(label_set, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.when(F.coalesce(primary, F.lit("")) != "", F.array(primary)).otherwise(F.array().cast("array<string>"))
    return F.concat(head, F.array_except(F.array_sort(F.array_distinct(rest)), head))


def present_binary(code: Column, present: tuple[int, ...] = (1, 3)) -> Column:
    """1 where a labeller's class code says present or uncertain, else 0 (null too)."""
    return F.coalesce(code.isin(*present), F.lit(False)).cast("int")


def label_matrix(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """``(uid, gen_<label>.., ref_<label>..)`` from rows (uid, label, ref, gen)."""
    cell = lambda side, x: F.max(F.when(F.col("label") == x, F.col(side))).alias(f"{side}_{x}")
    return matrix.groupBy("uid").agg(*[cell(side, x) for side in ("gen", "ref") for x in labels])


# ---------------------------------------------------------------- boxes


def filter_regions(detections: Column, least: float = 0.30, pad: int = 6, width: int = 200, height: int = 100) -> Column:
    """Regions of at least ``least`` confidence, padded, clipped to the image, with three characters of their text.
    Input and output are arrays of struct<confidence, x0, y0, x1, y1, text> per image."""
    grow = lambda r: F.struct(r["confidence"].alias("confidence"), *pad_clip_box(r, pad, width, height), F.substring(r["text"], 1, 3).alias("text"))
    return F.transform(F.filter(detections, lambda r: r["confidence"] >= least), grow)


def pad_clip_box(box: Column, pad: int, width: int, height: int) -> list[Column]:
    """x0, y0, x1, y1 of a box grown by ``pad`` on every side and cut at the image's edges."""
    low = [F.greatest(box[c] - pad, F.lit(0)).alias(c) for c in ("x0", "y0")]
    return low + [F.least(box[c] + pad, F.lit(top)).alias(c) for c, top in (("x1", width), ("y1", height))]


def masked_area(regions: Column) -> Column:
    return F.aggregate(regions, F.lit(0).cast("long"), lambda s, x: s + (x["x1"] - x["x0"]) * (x["y1"] - x["y0"]))


def masking_log(images: DataFrame, regions: str = "regions", seconds: str | None = None) -> DataFrame:
    """One row per image: image_id, num_regions_detected, confidence_scores (joined by ``;`` in the regions' order),
    masking_applied, processing_time_sec (null without a column of times)."""
    scores = F.array_join(F.transform(regions, lambda r: r["confidence"].cast("string")), ";")
    n = F.coalesce(F.size(regions), F.lit(0))
    return images.select("image_id", n.alias("num_regions_detected"), F.coalesce(scores, F.lit("")).alias("confidence_scores"), (n > 0).alias("masking_applied"), (F.col(seconds) if seconds else F.lit(None)).cast("double").alias("processing_time_sec"))


def masking_log_summary(log: DataFrame) -> DataFrame:
    """One row over the rows of ``masking_log``: images, regions, images with any, their share, and the mean time."""
    some = F.count_if("masking_applied")
    return log.agg(F.count("*").alias("images"), F.sum("num_regions_detected").alias("regions"), some.alias("masked"), (some / F.count("*")).alias("share_masked"), F.avg("processing_time_sec").alias("mean_seconds"))


# ---------------------------------------------------------------- pools and summaries


def index_join_splits(index: DataFrame, splits: DataFrame) -> DataFrame:
    """Index rows that a split was given to."""
    return index.join(splits.select("uid", "split"), "uid")


def eligible_pool(texts: DataFrame, splits: DataFrame, paths: DataFrame, split: str = "test") -> DataFrame:
    """Ids of ``split`` with a raw file and two real texts."""
    pool = texts.join(splits.where(F.col("split") == split), "uid", "left_semi").join(paths.where("raw_path IS NOT NULL"), "uid", "left_semi")
    return pool.where(is_real_text(F.col("findings")) & is_real_text(F.col("impression"))).select("uid")


def smoke_subset(rows: DataFrame, cls: str, n: int, seed: int) -> DataFrame:
    """The rows, with all their columns, of a stratified sample of ``n``."""
    return rows.join(sample_stratified(rows.select("uid", cls), cls, n, seed), "uid", "left_semi")


def review_sample(rows: DataFrame, texts: DataFrame, cls: str, n: int, seed: int) -> DataFrame:
    """A stratified sample with its texts and an empty ``rating`` to be filled in."""
    return sample_stratified(rows.select("uid", cls), cls, n, seed).join(texts, "uid", "left").withColumn("rating", F.lit(None).cast("int"))


def review_detail(near: DataFrame, case_labels: DataFrame, texts: DataFrame, cases: DataFrame) -> DataFrame:
    """Neighbours (query, uid, rank, similarity) as a sheet to be rated: primary labels of both sides from ``cases`` (uid,
    primary_label); ``first_label``, the neighbour's first label in class order; the labels shared with the query, how
    many and whether any; findings and impression of both sides; an empty ``rating``."""
    own = case_labels.groupBy("uid").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    n = near.join(own, "uid").join(own.select(F.col("uid").alias("query"), F.col("labels").alias("q_labels")), "query")
    both = F.array_sort(F.array_intersect("labels", "q_labels"))
    side = lambda key, name: texts.select(F.col("uid").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("findings", "impression")])
    primary = lambda key, name: cases.select(F.col("uid").alias(key), F.col("primary_label").alias(f"{name}_primary"))
    j = n.join(side("uid", "case"), "uid", "left").join(side("query", "query"), "query", "left").join(primary("uid", "case"), "uid", "left").join(primary("query", "query"), "query", "left")
    said = [F.coalesce(f"{s}_{c}", F.lit("")).alias(f"{s}_{c}") for s in ("case", "query") for c in ("findings", "impression")]
    return j.select("query", "uid", "rank", "similarity", "query_primary", "case_primary", F.element_at("labels", 1).alias("first_label"), both.alias("overlap"), F.size(both).alias("overlap_count"), (F.size(both) > 0).alias("proxy_relevant"), *said, F.lit(None).cast("int").alias("rating"))


def score_summary(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of score columns per group."""
    return scores.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def completion_counts(runs: DataFrame, completed: str) -> DataFrame:
    """Runs by outcome and status; every status but ``completed`` is a failure."""
    outcome = F.when(F.col("status") == completed, "completed").otherwise("failed")
    return runs.groupBy(outcome.alias("outcome"), F.col("status").alias("reason")).agg(F.count("*").alias("n"))
