"""Queries of the text and scalar operators."""

from pyspark.sql import functions as F

from casebook.functions import text as T
from casebook.functions import vectors as V
from casebook.operators import preparation as O
from casebook.operators.retrieval import index_records as records
from casebook.plans.fixtures import base, duck, view
from casebook.plans.registry import query

_BARE = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
_REAL = "coalesce({c} IS NOT NULL AND " + _BARE + " NOT IN ('', 'nan'), false)"
_CLEAN = (
    "CASE WHEN " + _REAL + " THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?i)\\bx{{2,}}\\b', '[REDACTED]', 'g'),"
    " '\\s+([.,;:])', '\\1', 'g'), '((^|\\.\\s*)\\.\\s*)+$', '. ', 'g'), '\\s+', ' ', 'g')) ELSE '' END"
)
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), 'x{{2,}}', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_R = duck("f_reports")
_CLEANED = f"{_R}, cleaned AS (SELECT uid, {_CLEAN.format(c='findings')} AS findings, {_CLEAN.format(c='impression')} AS impression FROM f_reports)"


def cleaned(spark, sf_dir):
    r = view(spark, sf_dir, "f_reports")
    return r.select("uid", T.clean_text(F.col("findings")).alias("findings"), T.clean_text(F.col("impression")).alias("impression"))


@query("clean_text", f"WITH {_CLEANED} SELECT * FROM cleaned")
def clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query("report_text", f"WITH {_CLEANED} SELECT uid, length(findings) > 0 AS has_findings, trim(concat(findings, ' ', impression)) AS full_text FROM cleaned")
def report_text(spark, sf_dir):
    return O.with_full_text(cleaned(spark, sf_dir)).select("uid", "has_findings", "full_text")


@query("cleaning_stats", f"WITH {_CLEANED} SELECT count(*) AS studies, count(*) FILTER (findings = '') AS missing_findings, count(*) FILTER (trim(concat(findings, ' ', impression)) = '') AS empty_text FROM cleaned")
def cleaning_stats(spark, sf_dir):
    return O.cleaning_stats(cleaned(spark, sf_dir))


@query("normalize_text", f"WITH {_R} SELECT uid, {_NORM.format(c='findings')} AS normalized FROM f_reports")
def normalize_text(spark, sf_dir):
    return view(spark, sf_dir, "f_reports").select("uid", T.normalize_text(F.col("findings")).alias("normalized"))


@query("real_text_filter", f"WITH {_R} SELECT uid FROM f_reports WHERE {_REAL.format(c='findings')} AND {_REAL.format(c='impression')}")
def real_text_filter(spark, sf_dir):
    return view(spark, sf_dir, "f_reports").where(T.is_real_text(F.col("findings")) & T.is_real_text(F.col("impression"))).select("uid")


@query("null_safe_fields", f"WITH {_R}, {duck('f_cases')} SELECT r.uid, coalesce(findings, '') AS findings, coalesce(impression, '') AS impression, coalesce(cluster_id, -1) AS cluster_id FROM f_reports r LEFT JOIN f_cases USING (uid)")
def null_safe_fields(spark, sf_dir):
    r, c = view(spark, sf_dir, "f_reports"), view(spark, sf_dir, "f_cases").select("uid", "cluster_id")
    return O.null_safe_fields(r.join(c, "uid", "left")).select("uid", "findings", "impression", "cluster_id")


_STAGE = "CASE WHEN raw_path IS NULL THEN 'Missing' WHEN embedded THEN 'Embedded' WHEN masked_path IS NOT NULL THEN 'Masked' ELSE 'Raw' END"
_KEYS = """keys AS (SELECT uid, CAST(uid AS VARCHAR) AS study_uid, concat('SYN-', uid) AS patient_uid,
  CASE WHEN uid % 3 > 0 THEN concat('raw/', uid, '.png') END AS raw_path, CASE WHEN uid % 3 > 0 AND uid % 4 > 0 THEN concat('masked/', uid, '.png') END AS masked_path, uid % 5 = 1 AS embedded FROM (SELECT c_custkey AS uid FROM customer))"""


def keyed(spark, sf_dir):
    """Synthetic keys and paths per study: a raw path where a frontal file exists, a masked path where the listing of
    masked files has it."""
    c = base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"))
    frontal = c.where("uid % 3 > 0").select("uid", F.concat(F.lit("raw/"), "uid", F.lit(".png")).alias("raw_path"))
    listing = c.where("uid % 4 > 0").select("uid", F.concat(F.lit("masked/"), "uid", F.lit(".png")).alias("listed"))
    return O.synthetic_keys(c, frontal, listing).withColumn("embedded", F.col("uid") % 5 == 1)


@query("synthetic_keys", f"WITH {_KEYS} SELECT uid, study_uid, patient_uid, raw_path, masked_path, raw_path IS NOT NULL AS raw_exists, masked_path IS NOT NULL AS masked_exists FROM keys")
def synthetic_keys(spark, sf_dir):
    return keyed(spark, sf_dir).drop("embedded")


@query("processing_stage", f"WITH {_KEYS} SELECT uid, {_STAGE} AS stage FROM keys")
def processing_stage_query(spark, sf_dir):
    return keyed(spark, sf_dir).select("uid", O.processing_stage(F.col("raw_path"), F.col("masked_path"), F.col("embedded")).alias("stage"))


@query("stage_distribution", f"WITH {_KEYS} SELECT {_STAGE} AS stage, count(*) AS n FROM keys GROUP BY ALL")
def stage_distribution(spark, sf_dir):
    return O.stage_distribution(keyed(spark, sf_dir))


@query("embed_input_choice", f"WITH {_KEYS} SELECT uid, coalesce(masked_path, raw_path) AS input, masked_path IS NULL AS fallback FROM keys WHERE raw_path IS NOT NULL")
def embed_input_choice(spark, sf_dir):
    return O.embed_input_choice(keyed(spark, sf_dir))


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(list_transform(embedding, lambda x: x::DOUBLE * 3), lambda y: abs(y)))::DOUBLE / (3 * greatest(sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))), 1e-12)), 5) AS l1, len(embedding) AS n FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = base(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    u = e.select("vec_id", V.l2_normalize(F.col("v")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"), F.size("u").cast("long").alias("n"))


@query("cosine_similarity", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf_dir):
    e = base(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@query("parse_labels", f"WITH {duck('f_cases')} SELECT uid, concat_ws(';', primary_label, CASE WHEN a <> primary_label THEN a END, CASE WHEN b <> primary_label AND b <> a THEN b END) AS labels FROM (SELECT uid, primary_label, least(second_label, 'L5') AS a, greatest(second_label, 'L5') AS b FROM f_cases)")
def parse_labels_query(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases")
    joined = F.concat_ws("; ", "second_label", F.lit(" L5"), "primary_label", F.lit(""))
    return c.select("uid", F.array_join(O.parse_labels(F.col("primary_label"), joined), ";").alias("labels"))


_TERMS = ("the", "is", "la", "der", "idiot", "of")


@query("mentioned_classes", "SELECT doc_id, concat_ws(';', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_]){t}($|[^\\pL\\pN_])') THEN '{t}' END" for t in _TERMS) + ") AS mentioned FROM documents")
def mentioned_classes(spark, sf_dir):
    d = base(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.mentioned_classes(F.col("text"), list(_TERMS)), ";").alias("mentioned"))


def detections(spark, sf_dir):
    d = view(spark, sf_dir, "f_detections")
    rows = F.array_sort(F.collect_list(F.struct("region", "confidence", "x0", "y0", "x1", "y1", "text")))
    return d.groupBy("image_id").agg(rows.alias("regions"))


@query("filter_regions", f"WITH {duck('f_detections')} SELECT image_id, round(confidence, 6) AS confidence, greatest(x0 - 6, 0) AS x0, greatest(y0 - 6, 0) AS y0, least(x1 + 6, 200) AS x1, least(y1 + 6, 100) AS y1, substr(text, 1, 3) AS text FROM f_detections WHERE confidence >= 0.30")
def filter_regions_query(spark, sf_dir):
    kept = detections(spark, sf_dir).select("image_id", F.explode(O.filter_regions(F.col("regions"))).alias("r")).select("image_id", "r.*")
    return kept.withColumn("confidence", F.round("confidence", 6))


@query("pad_clip_boxes", f"WITH {duck('f_detections')} SELECT image_id, count(*) AS boxes, sum((least(x1 + 6, 200) - greatest(x0 - 6, 0)) * (least(y1 + 6, 100) - greatest(y0 - 6, 0)))::BIGINT AS area FROM f_detections WHERE confidence >= 0.30 GROUP BY image_id")
def pad_clip_boxes(spark, sf_dir):
    r = detections(spark, sf_dir).select("image_id", O.filter_regions(F.col("regions")).alias("r")).where(F.size("r") > 0)
    return r.select("image_id", F.size("r").cast("long").alias("boxes"), O.masked_area(F.col("r")).alias("area"))


def masking_log_rows(spark, sf_dir):
    kept = detections(spark, sf_dir).select("image_id", O.filter_regions(F.col("regions")).alias("regions"), (F.col("image_id") % 10 / 10).alias("seconds"))
    return O.masking_log(kept, seconds="seconds")


@query("masking_log", f"WITH {duck('f_detections')} SELECT image_id, count(*) FILTER (confidence >= 0.30) AS num_regions_detected, coalesce(round(sum(confidence) FILTER (confidence >= 0.30), 6), 0) AS confidences, count(*) FILTER (confidence >= 0.30) > 0 AS masking_applied, image_id % 10 / 10 AS processing_time_sec FROM f_detections GROUP BY image_id")
def masking_log(spark, sf_dir):
    # numbers are written as text in other ways in each engine: the joined scores are added up again
    total = F.aggregate(F.transform(F.filter(F.split("confidence_scores", ";"), lambda x: x != ""), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return masking_log_rows(spark, sf_dir).select("image_id", F.col("num_regions_detected").cast("long").alias("num_regions_detected"), F.round(total, 6).alias("confidences"), "masking_applied", "processing_time_sec")


@query("masking_log_summary", f"WITH {duck('f_detections')}, per AS (SELECT image_id, count(*) FILTER (confidence >= 0.30) AS n FROM f_detections GROUP BY image_id) SELECT count(*) AS images, sum(n)::BIGINT AS regions, count(*) FILTER (n > 0) AS masked, round(count(*) FILTER (n > 0) / count(*), 6) AS share_masked, round(avg(image_id % 10 / 10), 6) AS mean_seconds FROM per")
def masking_log_summary(spark, sf_dir):
    s = O.masking_log_summary(masking_log_rows(spark, sf_dir))
    return s.withColumns({"share_masked": F.round("share_masked", 6), "mean_seconds": F.round("mean_seconds", 6)})


@query("present_binary", "SELECT doc_id, CASE WHEN (quality + 2 * toxic) IN (1, 3) THEN 1 ELSE 0 END AS present FROM labels")
def present_binary(spark, sf_dir):
    return base(spark, sf_dir, "labels").select("doc_id", O.present_binary(F.col("quality") + 2 * F.col("toxic")).alias("present"))


@query("index_records", f"WITH {duck('f_cases')}, {duck('f_case_texts')} SELECT CAST(uid AS VARCHAR) AS study_uid, concat('SYN-', uid) AS patient_uid, concat('masked/', uid, '.png') AS image_path, 'Frontal' AS projection, primary_label, second_label AS label_set, 'driver' AS dataset, 'v1' AS embedding_version, primary_label = 'L0' AS is_normal, coalesce(findings, '') AS findings, coalesce(impression, '') AS impression, split, coalesce(cluster_id, -1) AS cluster_id, 'hashed' AS embedding_model FROM f_cases LEFT JOIN f_case_texts USING (uid)")
def index_records(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases").join(view(spark, sf_dir, "f_case_texts"), "uid", "left")
    c = c.withColumn("image_path", F.concat(F.lit("masked/"), "uid", F.lit(".png"))).withColumn("label_set", F.col("second_label"))
    return records(c, normal="L0", model="hashed", dataset="driver").drop("embedding", "indexed_at")


@query("contains_term", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN_])der($|[^\\pL\\pN_])')")
def contains_term(spark, sf_dir):
    return base(spark, sf_dir, "documents").where(T.mentions(F.col("text"), "der")).select("doc_id")
