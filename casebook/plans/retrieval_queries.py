"""Queries of retrieval, voting, evidence and the index."""

from pyspark.sql import functions as F

from casebook.operators import retrieval as R
from casebook.plans.fixtures import duck, view
from casebook.plans.registry import query

K = 5
_C = f"{duck('f_cases')}, {duck('f_case_labels')}, {duck('f_case_texts')}"
_NEAR = f"""{_C}, scored AS (SELECT q.uid AS query, k.uid, list_dot_product(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(k.embedding::DOUBLE[], k.embedding::DOUBLE[])) AS similarity
  FROM f_cases q JOIN f_cases k ON q.split = 'val' AND k.split = 'train' AND q.uid <> k.uid),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, uid) AS rank FROM scored) WHERE rank <= {K})"""
_KNN = f"WITH {_NEAR} "
_SIM = "round(similarity, 6) AS similarity"


def parts(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases")
    return c, c.where("split = 'val'").select("uid", "embedding"), c.where("split = 'train'").select("uid", "embedding")


def near(spark, sf_dir, k=K):
    _, q, kb = parts(spark, sf_dir)
    return R.knn_topk(q, kb, k)


def clustered(spark, sf_dir):
    return near(spark, sf_dir).join(view(spark, sf_dir, "f_cases").select("uid", "cluster_id"), "uid")


_CL = f"{_NEAR}, nc AS (SELECT near.*, cluster_id FROM near JOIN f_cases USING (uid)), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, cluster_id = -1, CASE WHEN cluster_id = -1 THEN uid ELSE cluster_id END ORDER BY round(similarity, 9) DESC, uid::VARCHAR) AS cr FROM nc) WHERE cr = 1)"
_VOTE = f"{_NEAR}, vote AS (SELECT query, label, sum(similarity) AS vote_weight, count(*) / any_value(n) AS agreement, min(rank) AS r FROM near JOIN f_case_labels USING (uid) JOIN (SELECT query, count(*) AS n FROM near GROUP BY query) USING (query) GROUP BY query, label), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(vote_weight, 9) DESC, r, label) AS vote_rank FROM vote)"


@query("knn_topk", _KNN + f"SELECT query, uid, rank, {_SIM} FROM near")
def knn_topk(spark, sf_dir):
    return near(spark, sf_dir).select("query", "uid", "rank", F.round("similarity", 6).alias("similarity"))


@query("topk_per_query", f"WITH {duck('f_neighbours')} SELECT query, uid, rank FROM (SELECT query, uid, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, uid) AS rank FROM f_neighbours) WHERE rank <= 3")
def topk_per_query(spark, sf_dir):
    return R.topk_per_query(view(spark, sf_dir, "f_neighbours"), 3).select("query", "uid", "rank")


@query("ann_topk")
def ann_topk(spark, sf_dir):
    _, q, kb = parts(spark, sf_dir)
    return R.ann_topk(q, kb, K)


@query("retrieve", _KNN + f"SELECT query, uid, rank, {_SIM} FROM near WHERE rank <= 4 AND similarity >= 0.25")
def retrieve(spark, sf_dir):
    return R.retrieve(near(spark, sf_dir), 0.25, 4).select("query", "uid", "rank", F.round("similarity", 6).alias("similarity"))


@query("rank_rows", f"WITH {duck('f_neighbours')} SELECT query, uid, turn, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, uid) AS rank FROM f_neighbours")
def rank_rows(spark, sf_dir):
    return R.topk_per_query(view(spark, sf_dir, "f_neighbours"), 1 << 30).select("query", "uid", "turn", "rank")


_REQ = f"{duck('f_neighbours')}, {duck('f_cases')}"


def requested(spark, sf_dir):
    return view(spark, sf_dir, "f_neighbours").select(F.col("query").alias("session"), "uid", F.col("turn").alias("rank"))


@query("get_by_ids", f"WITH {_REQ} SELECT query AS session, uid, turn AS rank, primary_label, CAST(1.0 AS DOUBLE) AS similarity FROM f_neighbours JOIN f_cases USING (uid)")
def get_by_ids(spark, sf_dir):
    index = view(spark, sf_dir, "f_cases").select("uid", "primary_label")
    unknown = requested(spark, sf_dir).withColumn("uid", -1 - F.col("uid"))  # ids that no row has: dropped without a word
    return R.get_by_ids(requested(spark, sf_dir).unionByName(unknown), index).select("session", "uid", "rank", "primary_label", "similarity")


@query("session_evidence", f"WITH {_REQ}, {duck('f_case_labels')}, e AS (SELECT query, uid, turn AS rank FROM f_neighbours JOIN f_cases USING (uid)), v AS (SELECT query, label, count(*)::DOUBLE AS w, min(rank) AS r FROM e JOIN f_case_labels USING (uid) GROUP BY ALL), t AS (SELECT query, label, w FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w DESC, r, label) AS k FROM v) WHERE k = 1) SELECT query, label AS top_label, w AS vote_weight, (SELECT string_agg(uid::VARCHAR, ',' ORDER BY rank) FROM e WHERE e.query = t.query) AS evidence FROM t")
def session_evidence(spark, sf_dir):
    index = view(spark, sf_dir, "f_cases").select("uid", "primary_label")
    e = R.session_evidence(requested(spark, sf_dir).withColumnRenamed("session", "query"), index, view(spark, sf_dir, "f_case_labels"))
    listed = F.array_join(F.transform("evidence", lambda x: x["uid"].cast("string")), ",")
    return e.select("query", F.col("votes")[0]["label"].alias("top_label"), F.col("votes")[0]["vote_weight"].alias("vote_weight"), listed.alias("evidence")).where("top_label IS NOT NULL")


@query("session_evidence_stored", f"WITH {_REQ}, {duck('f_case_labels')}, e AS (SELECT query, uid, turn AS rank, similarity FROM f_neighbours JOIN f_cases USING (uid)), v AS (SELECT query, label, sum(similarity) AS w, min(rank) AS r FROM e JOIN f_case_labels USING (uid) GROUP BY ALL), t AS (SELECT query, label, w FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, r, label) AS k FROM v) WHERE k = 1) SELECT query, label AS top_label, round(w, 6) AS vote_weight, (SELECT round(sum(similarity), 6) FROM e WHERE e.query = t.query) AS similarities FROM t")
def session_evidence_stored(spark, sf_dir):
    asked = view(spark, sf_dir, "f_neighbours").select("query", "uid", F.col("turn").alias("rank"), F.col("similarity").cast("double").alias("similarity"))
    e = R.session_evidence(asked, view(spark, sf_dir, "f_cases").select("uid", "primary_label"), view(spark, sf_dir, "f_case_labels"), "stored")
    total = F.round(F.aggregate("evidence", F.lit(0.0), lambda s, x: s + x["similarity"]), 6)
    return e.select("query", F.col("votes")[0]["label"].alias("top_label"), F.round(F.col("votes")[0]["vote_weight"], 6).alias("vote_weight"), total.alias("similarities")).where("top_label IS NOT NULL")


@query("label_vote", f"WITH {_VOTE} SELECT query, label, round(vote_weight, 6) AS vote_weight, round(agreement, 6) AS agreement, vote_rank FROM ranked")
def label_vote(spark, sf_dir):
    v = R.label_vote(near(spark, sf_dir), view(spark, sf_dir, "f_case_labels"))
    return v.select("query", "label", F.round("vote_weight", 6).alias("vote_weight"), F.round("agreement", 6).alias("agreement"), "vote_rank")


@query("evidence_order", _KNN + "SELECT query, uid, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, uid::VARCHAR) AS evidence_rank FROM near")
def evidence_order(spark, sf_dir):
    return R.evidence_order(near(spark, sf_dir)).select("query", "uid", "evidence_rank")


@query("collapse_near_dups", f"WITH {_CL} SELECT query, uid, cluster_id FROM kept")
def collapse_near_dups(spark, sf_dir):
    return R.collapse_near_dups(clustered(spark, sf_dir)).select("query", "uid", "cluster_id")


@query("first_per_group", f"WITH {duck('f_cases')} SELECT cluster_id, min(uid) AS uid FROM f_cases GROUP BY cluster_id")
def first_per_group(spark, sf_dir):
    from casebook.operators.labels import limit_per_group

    return limit_per_group(view(spark, sf_dir, "f_cases").select("cluster_id", "uid"), ["cluster_id"], ["uid"], 1)


@query("limit_per_group", f"WITH {duck('f_cases')} SELECT split, uid FROM (SELECT split, uid, row_number() OVER (PARTITION BY split ORDER BY uid) AS r FROM f_cases) WHERE r <= 10")
def limit_per_group_query(spark, sf_dir):
    from casebook.operators.labels import limit_per_group

    return limit_per_group(view(spark, sf_dir, "f_cases").select("split", "uid"), ["split"], ["uid"], 10)


@query("partition_for_label", _KNN + ", x AS (SELECT query, uid, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, uid::VARCHAR) AS er, EXISTS (SELECT 1 FROM f_case_labels l WHERE l.uid = near.uid AND l.label = 'L3') AS yes FROM near) SELECT query, coalesce(string_agg(uid::VARCHAR, ',' ORDER BY er) FILTER (yes), '') AS supporting, coalesce(string_agg(uid::VARCHAR, ',' ORDER BY er) FILTER (NOT yes), '') AS contradictory FROM x GROUP BY query")
def partition_for_label(spark, sf_dir):
    n = near(spark, sf_dir)
    p = R.partition_for_label(n, view(spark, sf_dir, "f_case_labels"), n.select("query", F.lit("L3").alias("label")).distinct())
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select("query", text("supporting").alias("supporting"), text("contradictory").alias("contradictory"))


@query("text_evidence", _KNN + ", x AS (SELECT query, uid, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, uid::VARCHAR) AS er FROM near), f AS (SELECT query, coalesce(findings, '') AS t, min(er) AS r FROM x JOIN f_case_texts USING (uid) GROUP BY ALL) SELECT query, string_agg(t, '|' ORDER BY r) AS findings FROM f GROUP BY query")
def text_evidence(spark, sf_dir):
    t = R.text_evidence(near(spark, sf_dir), view(spark, sf_dir, "f_case_texts"), "findings")
    return t.select("query", F.array_join("findings", "|").alias("findings"))


_STATS = "SELECT query, (SELECT count(*) FROM nc WHERE nc.query = k.query) AS n_cases, count(*) AS n_kept, round(avg(similarity), 6) AS mean_similarity, round(min(similarity), 6) AS min_similarity, round(max(similarity), 6) AS max_similarity, (SELECT count(DISTINCT label) FROM kept z JOIN f_case_labels USING (uid) WHERE z.query = k.query) AS n_labels, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters FROM kept k GROUP BY query"


@query("retrieval_stats", f"WITH {_CL} {_STATS}")
def retrieval_stats(spark, sf_dir):
    s = R.retrieval_stats(clustered(spark, sf_dir), view(spark, sf_dir, "f_case_labels")).drop("n_collapsed")
    for c in ("mean_similarity", "min_similarity", "max_similarity"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@query("build_context", f"WITH {_CL}, vote AS (SELECT query, label, sum(similarity) AS w, min(rank) AS r FROM near JOIN f_case_labels USING (uid) GROUP BY ALL), top AS (SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, r, label) AS k FROM vote) WHERE k = 1) SELECT k.query, count(*) AS n_cases, any_value(top.label) AS top_label, count(*) FILTER (EXISTS (SELECT 1 FROM f_case_labels l WHERE l.uid = k.uid AND l.label = top.label)) AS n_supporting, count(DISTINCT coalesce(t.findings, '')) AS n_findings FROM kept k JOIN top ON top.query = k.query JOIN f_case_texts t ON t.uid = k.uid GROUP BY k.query")
def build_context(spark, sf_dir):
    c = R.build_context(clustered(spark, sf_dir), view(spark, sf_dir, "f_case_labels"), view(spark, sf_dir, "f_case_texts"))
    size = lambda x: F.size(x).cast("long")
    return c.select("query", size("cases").alias("n_cases"), F.col("label_evidence.label").alias("top_label"), size("label_evidence.supporting").alias("n_supporting"), size("findings").alias("n_findings"))


@query("agreement_badge", _KNN + ", b AS (SELECT query, primary_label, count(*) AS c, min(rank) AS r FROM near JOIN f_cases USING (uid) GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, r, primary_label) AS k, count(*) OVER (PARTITION BY query) AS label_spread, sum(c) OVER (PARTITION BY query) AS n FROM b) SELECT query, primary_label AS label, round(c / n, 6) AS fraction, CASE WHEN c / n >= 0.6 THEN 'strong' WHEN c / n >= 0.3 THEN 'mixed' ELSE 'weak' END AS badge, (SELECT round(max(similarity) * 100, 4) FROM near WHERE near.query = l.query) AS top_percent, label_spread FROM l WHERE k = 1")
def agreement_badge(spark, sf_dir):
    b = R.agreement_badge(near(spark, sf_dir), view(spark, sf_dir, "f_cases"))
    return b.select("query", "label", F.round("fraction", 6).alias("fraction"), "badge", F.round("top_percent", 4).alias("top_percent"), "label_spread")


def records(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases")
    r = c.where("split <> 'test' OR uid % 40 = 19").select("uid", "split", "primary_label", "cluster_id")
    v = c.where("split <> 'test' OR uid % 40 = 39").select("uid", F.when(F.col("uid") % 50 == 7, F.transform("embedding", lambda x: x * F.lit(2).cast("float"))).otherwise(F.col("embedding")).alias("embedding"))
    return r, v


@query("index_validate", f"WITH {duck('f_cases')}, r AS (SELECT * FROM f_cases WHERE split <> 'test' OR uid % 40 = 19), v AS (SELECT * FROM f_cases WHERE split <> 'test' OR uid % 40 = 39), rules AS (SELECT 'error' AS severity, 'test split in index' AS rule, count(*) AS n FROM r WHERE split = 'test' UNION ALL SELECT 'error', 'record without vector', count(*) FROM r WHERE uid NOT IN (SELECT uid FROM v) UNION ALL SELECT 'error', 'vector without record', count(*) FROM v WHERE uid NOT IN (SELECT uid FROM r) UNION ALL SELECT 'warning', 'norm deviates', count(*) FROM v WHERE uid % 50 = 7) SELECT * FROM rules WHERE n > 0")
def index_validate(spark, sf_dir):
    return R.index_validate(*records(spark, sf_dir), 64)


@query("index_build", f"WITH {duck('f_cases')} SELECT uid, split, primary_label, cluster_id, len(embedding) AS dimension FROM f_cases WHERE split <> 'test'")
def index_build(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases").where("split <> 'test'")
    path, _ = R.index_build(c.select("uid", "split", "primary_label", "cluster_id"), c.select("uid", "embedding"), 64)
    return spark.read.parquet(path).select("uid", "split", "primary_label", "cluster_id", F.size("embedding").cast("long").alias("dimension"))


@query("index_summary", f"WITH {duck('f_cases')}, t AS (SELECT primary_label, count(*) AS n FROM f_cases GROUP BY 1) SELECT (SELECT count(*) FROM f_cases) AS records, (SELECT count(DISTINCT cluster_id) FROM f_cases WHERE cluster_id <> -1) AS clusters, (SELECT string_agg(concat(primary_label, '=', n), ',' ORDER BY primary_label) FROM t) AS class_distribution")
def index_summary(spark, sf_dir):
    s = R.index_summary(view(spark, sf_dir, "f_cases"))
    pairs = F.transform(F.array_sort(F.map_entries("class_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("records", "clusters", F.array_join(pairs, ",").alias("class_distribution"))
