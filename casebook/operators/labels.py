"""Taxonomy operators: raw ``;``-joined terms to label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "Other"


def resolve_terms(problems: DataFrame, taxonomy: DataFrame, normal: str = "Normal", other: str = OTHER) -> DataFrame:
    """``(uid, term, kind, class)`` of every term. Precedence: exclude, normal (whatever the case), drop, class, other."""
    terms = problems.select("uid", F.explode(F.split("problems", ";")).alias("t")).select("uid", F.trim("t").alias("term")).where("term <> ''")
    listed = taxonomy.select(F.col("term").alias("l_term"), F.col("kind").alias("l_kind"), F.col("class").alias("l_class"))
    normals = listed.where("l_kind = 'normal'").select(F.lower("l_term").alias("n_term")).distinct()
    # a taxonomy is configuration: some hundred rows at most
    best = listed.groupBy("l_term").agg(F.max(F.col("l_kind") == "exclude").alias("x"), F.max(F.col("l_kind") == "drop").alias("d"), F.max(F.when(F.col("l_kind") == "class", F.col("l_class"))).alias("c"))
    j = terms.join(F.broadcast(best), terms["term"] == best["l_term"], "left").join(F.broadcast(normals), F.lower("term") == F.col("n_term"), "left")
    kind = F.when(F.col("x"), "exclude").when(F.col("n_term").isNotNull(), "normal").when(F.col("d"), "drop").when(F.col("c").isNotNull(), "class").otherwise("other")
    label = F.when(kind == "normal", normal).when(kind == "class", F.col("c")).when(kind == "other", other)
    return j.select("uid", "term", kind.alias("kind"), label.alias("class"))


def resolve_labels(problems: DataFrame, taxonomy: DataFrame, normal: str = "Normal", other: str = OTHER) -> DataFrame:
    """``(uid, labels, exclude_flag)``: union of the classes per study; none left gives ``other``; normal goes when any
    other class is present. A null ``problems`` has no terms."""
    resolved = resolve_terms(problems, taxonomy, normal, other).groupBy("uid").agg(F.array_sort(F.collect_set("class")).alias("found"), F.max(F.col("kind") == "exclude").alias("flag"))
    j = problems.select("uid").join(resolved, "uid", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    abnormal = F.array_remove(found, normal)
    labels = F.when(F.size(found) == 0, F.array(F.lit(other))).when(F.size(abnormal) > 0, abnormal).otherwise(found)
    return j.select("uid", labels.alias("labels"), F.coalesce("flag", F.lit(False)).alias("exclude_flag"))


def unmapped_terms(problems: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return resolve_terms(problems, taxonomy).where("kind = 'other'").groupBy("term").agg(F.count("*").alias("n"))


def label_frequency(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def primary_label(labelled: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(uid, primary_label)``: the rarest label of a study; ties by taxonomy order, then name."""
    order = taxonomy.where("class IS NOT NULL").groupBy(F.col("class").alias("label")).agg(F.min("ord").alias("ord"))
    rank = F.broadcast(label_frequency(labelled).join(order, "label", "left"))  # one row per class
    each = labelled.select("uid", F.explode("labels").alias("label")).join(rank, "label")
    return each.groupBy("uid").agg(F.min_by("label", F.struct("n", F.coalesce("ord", F.lit(1 << 30)), "label")).alias("primary_label"))


def one_hot(labelled: DataFrame, classes: list[str]) -> DataFrame:
    return labelled.select("uid", *[F.array_contains("labels", c).cast("int").alias(c) for c in classes])


def select_frontal(projections: DataFrame) -> DataFrame:
    """``(uid, frontal_filename)``: the first frontal file of a study by name."""
    return projections.where("projection = 'Frontal'").groupBy("uid").agg(F.min("filename").alias("frontal_filename"))


def study_index(problems: DataFrame, taxonomy: DataFrame, projections: DataFrame, classes: list[str]) -> DataFrame:
    labelled = resolve_labels(problems, taxonomy)
    j = labelled.join(primary_label(labelled, taxonomy), "uid", "left").join(select_frontal(projections), "uid", "left")
    return j.select(
        "uid", "primary_label", F.array_join("labels", ";").alias("label_set"), F.size("labels").cast("long").alias("num_labels"), F.col("frontal_filename").isNotNull().alias("has_frontal"), "frontal_filename", "exclude_flag", *[F.array_contains("labels", c).cast("int").alias(c) for c in classes]
    )


def label_cardinality(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.avg(F.size("labels")).alias("mean_labels"), F.max(F.size("labels")).cast("long").alias("max_labels"))


def questionnaire_lookup(labels: DataFrame, questions: DataFrame, default: str = "default") -> DataFrame:
    """Ordered question set per row of ``labels`` (label), that of ``default`` where the label has none."""
    sets = questions.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "question"))).alias("q"))
    fallback = sets.where(F.col("label") == default).select(F.col("q").alias("q0"))
    j = labels.join(F.broadcast(sets), "label", "left").join(F.broadcast(fallback), how="left", on=F.lit(True))  # one row
    return j.select(*labels.columns, F.transform(F.coalesce("q", "q0"), lambda x: x["question"]).alias("questions"))


def limit_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
