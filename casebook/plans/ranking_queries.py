"""Queries of ranking evaluation. The ranking under test is that of the query vectors over the whole knowledge base."""

from pyspark.sql import functions as F

from casebook.operators import evaluation as E
from casebook.operators import ranking as K
from casebook.operators import retrieval as R
from casebook.plans.fixtures import duck, view
from casebook.plans.registry import query

METRICS = E.metric_names(K.KS)
_BASE = f"{duck('f_cases')}, {duck('f_case_labels')}, q AS (SELECT * FROM f_cases WHERE split = 'val'), kb AS (SELECT * FROM f_cases WHERE split = 'train'), rel AS (SELECT q.uid AS query, k.uid, count(*) AS relevance FROM f_case_labels q JOIN f_case_labels k USING (label) WHERE q.uid % 20 BETWEEN 14 AND 16 AND k.uid % 20 < 14 GROUP BY ALL)"
_COS = f"{_BASE}, ranking AS (SELECT q.uid AS query, kb.uid, row_number() OVER (PARTITION BY q.uid ORDER BY round(list_dot_product(q.embedding::DOUBLE[], kb.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(kb.embedding::DOUBLE[], kb.embedding::DOUBLE[])), 9) DESC, kb.uid) AS rank FROM q JOIN kb ON true)"


def _rand(seed, name):
    return E.random_order_sql(name, "q", "kb", seed)


def _metrics(ranking, name):
    ks = ", ".join(f"max(CASE WHEN rank <= {k} AND r > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS \"recall@{k}\", sum(CASE WHEN rank <= {k} AND r > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE / {k} AS \"precision@{k}\", CASE WHEN coalesce(any_value(i{k}), 0) > 0 THEN sum(CASE WHEN rank <= {k} THEN r / log2(rank + 1) ELSE 0 END) / any_value(i{k}) ELSE 0 END AS \"ndcg@{k}\"" for k in K.KS)
    ideal = ", ".join(f"sum(CASE WHEN ir <= {k} THEN relevance / log2(ir + 1) END) AS i{k}" for k in K.KS)
    return f"{name} AS (SELECT x.query, coalesce(1.0 / min(CASE WHEN r > 0 THEN rank END), 0)::DOUBLE AS mrr, {ks} FROM (SELECT {ranking}.*, coalesce(relevance, 0) AS r FROM {ranking} LEFT JOIN rel USING (query, uid)) x LEFT JOIN (SELECT query, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, uid) AS ir FROM rel) GROUP BY query) y ON x.query = y.query GROUP BY x.query)"


_ROUND = ", ".join(f'round("{m}", 5) AS "{m}"' for m in METRICS)
_AVG = ", ".join(f'round(avg("{m}"), 5) AS "{m}"' for m in METRICS)
_TWO = f"{_COS}, {_rand(1, 'rnd')}, {_metrics('ranking', 'm1')}, {_metrics('rnd', 'm2')}, pq AS (SELECT 'cosine' AS encoder, m1.*, primary_label AS cls FROM m1 JOIN f_cases ON uid = m1.query UNION ALL SELECT 'random', m2.*, primary_label FROM m2 JOIN f_cases ON uid = m2.query)"


def inputs(spark, sf_dir):
    """Cases, query vectors, base vectors, labels of queries, labels of the base."""
    c, labels = view(spark, sf_dir, "f_cases"), view(spark, sf_dir, "f_case_labels")
    return c, c.where("split = 'val'").select("uid", "embedding"), c.where("split = 'train'").select("uid", "embedding"), labels.where("uid % 20 BETWEEN 14 AND 16"), labels.where("uid % 20 < 14")


def rounded(df, names=METRICS):
    return df.select(*[c for c in df.columns if c not in names], *[F.round(f"`{m}`", 5).alias(m) for m in names])


def per_query(spark, sf_dir):
    c, *sides = inputs(spark, sf_dir)
    cls = c.select(F.col("uid").alias("query"), F.col("primary_label").alias("cls"))
    a = E.cosine_metrics(*sides, K.KS).withColumn("encoder", F.lit("cosine"))
    b = E.random_metrics(*sides, K.KS, (1,)).withColumn("encoder", F.lit("random"))
    return a.unionByName(b).join(cls, "query")


@query("dcg", f"WITH {_COS} SELECT query, round(sum(relevance / log2(rank + 1)), 5) AS dcg FROM ranking JOIN rel USING (query, uid) WHERE rank <= 10 GROUP BY query")
def dcg(spark, sf_dir):
    _, q, kb, q_labels, kb_labels = inputs(spark, sf_dir)
    near = R.knn_topk(q, kb, 10).select("query", "uid", "rank")
    sets = lambda labels, uid, name: E.label_sets(labels).select(F.col("uid").alias(uid), F.col("labels").alias(name))
    both = near.join(sets(q_labels, "query", "a"), "query").join(sets(kb_labels, "uid", "b"), "uid").withColumn("relevance", F.size(F.array_intersect("a", "b")))
    return K.dcg(both.where("relevance > 0"), 10).withColumn("dcg", F.round("dcg", 5))


@query("ideal_dcg", f"WITH {_BASE} SELECT query, round(sum((pow(2, relevance) - 1) / log2(r + 1)), 5) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, uid) AS r FROM rel) WHERE r <= 10 GROUP BY query")
def ideal_dcg(spark, sf_dir):
    return E.ideal_dcg(*inputs(spark, sf_dir)[3:], (10,), exponential=True).select("query", F.round("ideal10", 5).alias("dcg"))


@query("ranking_metrics", f"WITH {_COS}, {_metrics('ranking', 'm')} SELECT query, {_ROUND} FROM m")
def ranking_metrics(spark, sf_dir):
    return rounded(E.cosine_metrics(*inputs(spark, sf_dir)[1:], K.KS))


_R3 = f"{_BASE}, {_rand(1, 'r1')}, {_rand(2, 'r2')}, {_rand(3, 'r3')}, {_metrics('r1', 'a1')}, {_metrics('r2', 'a2')}, {_metrics('r3', 'a3')}, al AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)"


@query("random_ranking", f"WITH RECURSIVE {_R3} SELECT query, {_AVG} FROM al GROUP BY query")
def random_ranking(spark, sf_dir):
    return rounded(E.random_metrics(*inputs(spark, sf_dir)[1:], K.KS, (1, 2, 3)))


@query("relevance_links", f"WITH {_BASE}, qs AS (SELECT uid, string_agg(label, ';' ORDER BY label) AS s FROM f_case_labels WHERE uid % 20 BETWEEN 14 AND 16 GROUP BY uid), ks AS (SELECT uid, string_agg(label, ';' ORDER BY label) AS s FROM f_case_labels WHERE uid % 20 < 14 GROUP BY uid) SELECT qs.s AS query_set, ks.s AS kb_set, any_value(relevance) AS relevance, count(DISTINCT query) AS n_queries, count(DISTINCT rel.uid) AS n_cases FROM rel JOIN qs ON qs.uid = rel.query JOIN ks ON ks.uid = rel.uid GROUP BY qs.s, ks.s")
def relevance_links(spark, sf_dir):
    links = E.relevance_links(*inputs(spark, sf_dir)[3:])
    return links.withColumn("query_set", F.array_join("query_set", ";")).withColumn("kb_set", F.array_join("kb_set", ";"))


@query("micro_average", f"WITH RECURSIVE {_TWO} SELECT encoder, {_AVG} FROM pq GROUP BY encoder")
def micro_average(spark, sf_dir):
    return rounded(K.micro_average(per_query(spark, sf_dir), METRICS))


@query("per_class_average", f"WITH RECURSIVE {_TWO} SELECT encoder, cls, {_AVG} FROM pq GROUP BY encoder, cls")
def per_class_average(spark, sf_dir):
    return rounded(K.per_class_average(per_query(spark, sf_dir), METRICS))


_PC = ", ".join(f'avg("{m}") AS "{m}"' for m in METRICS)


@query("macro_average", f"WITH RECURSIVE {_TWO}, pc AS (SELECT encoder, cls, {_PC} FROM pq GROUP BY encoder, cls) SELECT encoder, {_AVG} FROM pc GROUP BY encoder")
def macro_average(spark, sf_dir):
    return rounded(K.macro_average(per_query(spark, sf_dir), METRICS))


_EACH = ", ".join(f'round("{m}", 5) AS "{m}"' for m in METRICS)


@query("encoder_comparison", f"WITH RECURSIVE {_TWO}, pc AS (SELECT encoder, cls, {_PC} FROM pq GROUP BY encoder, cls), mi AS (SELECT encoder, {_PC} FROM pq GROUP BY encoder), ma AS (SELECT encoder, {_PC} FROM pc GROUP BY encoder), al AS (SELECT 'micro' AS level, NULL::VARCHAR AS cls, * FROM mi UNION ALL SELECT 'macro', NULL::VARCHAR, * FROM ma UNION ALL SELECT 'class', cls, * EXCLUDE (cls) FROM pc) SELECT level, encoder, cls, {_EACH} FROM al")
def encoder_comparison(spark, sf_dir):
    return rounded(E.encoder_comparison(per_query(spark, sf_dir), METRICS))


@query("perclass_pivot", f"WITH RECURSIVE {_TWO} SELECT cls, round(avg(\"recall@5\") FILTER (encoder = 'cosine'), 5) AS cosine, round(avg(\"recall@5\") FILTER (encoder = 'random'), 5) AS random, (avg(\"recall@5\") FILTER (encoder = 'cosine') > avg(\"recall@5\") FILTER (encoder = 'random'))::INT AS first_wins FROM pq GROUP BY cls")
def perclass_pivot(spark, sf_dir):
    p = K.perclass_pivot(per_query(spark, sf_dir), "recall@5", ["cosine", "random"])
    return p.withColumn("cosine", F.round("cosine", 5)).withColumn("random", F.round("random", 5))
