"""Queries of metadata consolidation, sampling and set checks."""

from datetime import datetime

from pyspark.sql import functions as F

from casebook.operators import labels as L
from casebook.operators import evaluation as E
from casebook.operators import metadata as M
from casebook.operators import preparation as O
from casebook.plans.fixtures import base, derangement_sql, duck, view
from casebook.plans.registry import query
from casebook.plans.retrieval_queries import _NEAR, near
from casebook.plans.text_queries import _KEYS, keyed

_C, _P = duck("f_cases"), duck("f_projections")
_ROLL = f"{_P}, roll AS (SELECT uid, string_agg(filename, ';' ORDER BY filename) AS image_ids, string_agg(DISTINCT projection, ';' ORDER BY projection) AS projections_available, count(*) AS num_images FROM f_projections GROUP BY uid)"


@query("projection_rollup", f"WITH {_ROLL} SELECT * FROM roll")
def projection_rollup(spark, sf_dir):
    return M.projection_rollup(view(spark, sf_dir, "f_projections"))


@query("master_metadata", f"WITH {_C}, {duck('f_case_texts')}, {_ROLL}, {_KEYS} SELECT c.uid, c.primary_label, t.findings, t.impression, c.split, c.cluster_id, roll.image_ids, roll.projections_available, roll.num_images, keys.study_uid, keys.raw_path, keys.masked_path FROM f_cases c LEFT JOIN f_case_texts t USING (uid) LEFT JOIN roll USING (uid) LEFT JOIN keys USING (uid)")
def master_metadata(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases")
    paths = keyed(spark, sf_dir).select("uid", "study_uid", "raw_path", "masked_path")
    return M.master_metadata(c.select("uid", "primary_label"), view(spark, sf_dir, "f_case_texts"), c.select("uid", "split", "cluster_id"), view(spark, sf_dir, "f_projections"), paths)


@query("preserve_created_at", "SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at FROM orders")
def preserve_created_at(spark, sf_dir):
    o = base(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    out = M.preserve_created_at(o.select("uid"), o.where("uid % 3 = 0"), datetime(2024, 1, 1))
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("embedding_cached", "SELECT c_custkey AS uid, c_custkey IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) AS embedded FROM customer")
def embedding_cached(spark, sf_dir):
    e = base(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"))
    return M.with_embedding_cached(base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), [e.where("uid % 2 = 0"), e.where("uid % 3 = 0")])


@query("index_join_splits", f"WITH {_C} SELECT uid, primary_label, split FROM f_cases WHERE uid % 4 > 0")
def index_join_splits(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases")
    return O.index_join_splits(c.select("uid", "primary_label"), c.where("uid % 4 > 0"))


@query("eligible_pool", f"WITH {_C}, {duck('f_case_texts')}, {_KEYS} SELECT uid FROM f_cases JOIN f_case_texts USING (uid) JOIN keys USING (uid) WHERE split = 'test' AND raw_path IS NOT NULL AND trim(coalesce(findings, '')) NOT IN ('', 'nan') AND trim(coalesce(impression, '')) NOT IN ('', 'nan')")
def eligible_pool(spark, sf_dir):
    c, t = view(spark, sf_dir, "f_cases"), view(spark, sf_dir, "f_case_texts")
    return O.eligible_pool(t, c, keyed(spark, sf_dir))


@query("purity_gate", f"WITH {_C}, i AS (SELECT uid, split FROM f_cases WHERE split <> 'test' OR uid % 40 = 19) SELECT 'in test' AS rule, count(*) FILTER (split = 'test') AS n, count(*) FILTER (split = 'test') = 0 AS passed FROM i UNION ALL SELECT 'not allowed', count(*) FILTER (split = 'test'), count(*) FILTER (split = 'test') = 0 FROM i")
def purity_gate(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases").select("uid", "split")
    return M.purity_gate(c.where("split <> 'test' OR uid % 40 = 19"), c)


@query("relevance_pairs", f"WITH {_C}, {duck('f_case_labels')} SELECT q.uid AS query, k.uid, count(*) AS relevance FROM f_case_labels q JOIN f_case_labels k USING (label) WHERE q.uid % 20 BETWEEN 14 AND 16 AND k.uid % 20 < 14 GROUP BY ALL")
def relevance_pairs(spark, sf_dir):
    labels = view(spark, sf_dir, "f_case_labels")
    return E.relevance_pairs(labels.where("uid % 20 BETWEEN 14 AND 16"), labels.where("uid % 20 < 14"))


_REVIEW = f"""WITH {_NEAR}, lb AS (SELECT uid, list_sort(list(DISTINCT label)) AS l FROM f_case_labels GROUP BY uid),
r AS (SELECT n.*, q.primary_label AS query_primary, c.primary_label AS case_primary, b.l[1] AS first_label, list_sort(list_intersect(a.l, b.l)) AS o FROM near n JOIN f_cases q ON q.uid = n.query JOIN f_cases c ON c.uid = n.uid JOIN lb a ON a.uid = n.query JOIN lb b ON b.uid = n.uid)
SELECT query, r.uid, rank, round(similarity, 6) AS similarity, query_primary, case_primary, first_label, array_to_string(o, ';') AS overlap, len(o) AS overlap_count, len(o) > 0 AS proxy_relevant, coalesce(t.findings, '') AS case_findings, coalesce(t.impression, '') AS case_impression, coalesce(u.findings, '') AS query_findings, coalesce(u.impression, '') AS query_impression
FROM r LEFT JOIN f_case_texts t ON t.uid = r.uid LEFT JOIN f_case_texts u ON u.uid = r.query"""


@query("review_detail", _REVIEW)
def review_detail(spark, sf_dir):
    d = O.review_detail(near(spark, sf_dir), view(spark, sf_dir, "f_case_labels"), view(spark, sf_dir, "f_case_texts"), view(spark, sf_dir, "f_cases"))
    return d.withColumns({"overlap": F.array_join("overlap", ";"), "overlap_count": F.col("overlap_count").cast("long"), "similarity": F.round("similarity", 6)}).drop("rating")


@query("drop_reasons", f"WITH {_C}, {_KEYS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN split <> 'train' THEN 'not train' WHEN raw_path IS NULL THEN 'no image' WHEN masked_path IS NULL THEN 'not masked' END AS reason FROM f_cases JOIN keys USING (uid)) WHERE reason IS NOT NULL GROUP BY reason")
def drop_reasons(spark, sf_dir):
    j = view(spark, sf_dir, "f_cases").join(keyed(spark, sf_dir), "uid")
    return M.drop_reasons(j, [("not train", F.col("split") == "train"), ("no image", F.col("raw_path").isNotNull()), ("not masked", F.col("masked_path").isNotNull())])


@query("train_metadata", f"WITH {_C}, {_KEYS} SELECT uid, raw_path, masked_path IS NULL AS missing_masked FROM f_cases JOIN keys USING (uid) WHERE split = 'train' AND raw_path IS NOT NULL")
def train_metadata(spark, sf_dir):
    return O.train_metadata(view(spark, sf_dir, "f_cases"), keyed(spark, sf_dir))


@query("id_set_checks", "SELECT c_custkey AS uid, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT c_custkey FROM customer)")
def id_set_checks(spark, sf_dir):
    return M.id_set_checks(base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), base(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid")))


@query("duplicate_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return M.duplicate_keys(base(spark, sf_dir, "lineitem"), "l_orderkey")


@query("common_ids", "SELECT c_custkey AS uid FROM customer INTERSECT SELECT vec_id FROM embeddings")
def common_ids(spark, sf_dir):
    return M.common_ids(base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), base(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid")))


def _h(seed):
    return f"(uid % 2147483647 * 48271 + {seed} * 69621) % 2147483647"


_STRAT = f"strat AS (SELECT uid, primary_label FROM (SELECT *, row_number() OVER (PARTITION BY primary_label ORDER BY {_h(3)}, uid) AS r FROM f_cases) ORDER BY (r > greatest(1, 47 // (SELECT count(DISTINCT primary_label) FROM f_cases)))::INT, {_h(3)}, uid LIMIT 47)"


@query("sample_stratified", f"WITH {_C}, {_STRAT} SELECT * FROM strat")
def sample_stratified(spark, sf_dir):
    return M.sample_stratified(view(spark, sf_dir, "f_cases").select("uid", "primary_label"), "primary_label", 47, 3)


@query("smoke_subset", f"WITH {_C}, {_STRAT} SELECT uid, split, cluster_id FROM f_cases WHERE uid IN (SELECT uid FROM strat)")
def smoke_subset(spark, sf_dir):
    return O.smoke_subset(view(spark, sf_dir, "f_cases"), "primary_label", 47, 3).select("uid", "split", "cluster_id")


@query("review_sample", f"WITH {_C}, {duck('f_case_texts')}, {_STRAT} SELECT uid, primary_label, findings, NULL::INT AS rating FROM strat LEFT JOIN f_case_texts USING (uid)")
def review_sample(spark, sf_dir):
    return O.review_sample(view(spark, sf_dir, "f_cases"), view(spark, sf_dir, "f_case_texts").select("uid", "findings"), "primary_label", 47, 3)


@query("sample_n", f"SELECT c_custkey AS uid FROM customer ORDER BY (c_custkey % 2147483647 * 48271 + 5 * 69621) % 2147483647, c_custkey LIMIT 100")
def sample_n(spark, sf_dir):
    return M.sample_n(base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), 100, 5)


_DER = f"ids AS (SELECT c_custkey AS uid FROM customer), {derangement_sql('ids', 9)}"


@query("derangement", f"WITH {_DER} SELECT * FROM der")
def derangement(spark, sf_dir):
    return M.derangement(base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")), 9)


@query("oldest_pending", f"WITH {duck('f_store')} SELECT doctor_id, report_id, strftime(created_at, '%Y-%m-%d') AS d FROM (SELECT *, row_number() OVER (PARTITION BY doctor_id ORDER BY created_at, report_id) AS r FROM f_store WHERE status <> 'final') WHERE r = 1")
def oldest_pending(spark, sf_dir):
    s = view(spark, sf_dir, "f_store").where("status <> 'final'")
    first = L.limit_per_group(s, ["doctor_id"], ["created_at", "report_id"], 1)
    return first.select("doctor_id", "report_id", F.date_format("created_at", "yyyy-MM-dd").alias("d"))
