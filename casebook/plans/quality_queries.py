"""Queries of embedding quality."""

from pyspark.sql import functions as F

from casebook.operators import ranking as K
from casebook.operators.embedding import cache_valid as cache_valid_
from casebook.operators.embedding import content_hash, embed_batch, embedding_run_summary, fingerprints, hashed_embedder
from casebook.operators.embedding import to_embed as to_embed_
from casebook.plans.fixtures import base, duck, view
from casebook.plans.registry import query

_E = "e AS (SELECT vec_id AS uid, embedding::DOUBLE[] AS embedding FROM embeddings)"


def vectors(spark, sf_dir):
    return base(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding")


def _round(df, *names, digits=5):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("array_health", f"WITH {_E}, n AS (SELECT sqrt(list_dot_product(embedding, embedding)) AS s FROM e) SELECT count(*) AS n, true AS all_finite, count(*) FILTER (s < 1e-8) AS zero_vectors, round(avg(s), 5) AS mean_norm, round(stddev_pop(s), 5) AS std_norm, abs(avg(s) - 1) <= 1e-3 AS ok FROM n")
def array_health(spark, sf_dir):
    return _round(K.array_health(vectors(spark, sf_dir)), "mean_norm", "std_norm")


@query("neardup_cohesion", f"WITH {_E}, {duck('f_cases')}, c AS (SELECT e.uid, e.embedding, cluster_id FROM e JOIN f_cases USING (uid) WHERE cluster_id >= 0), w AS (SELECT list_dot_product(a.embedding, b.embedding) AS s FROM c a JOIN c b ON a.cluster_id = b.cluster_id AND a.uid < b.uid), o AS (SELECT uid, embedding, row_number() OVER (ORDER BY (uid % 2147483647 * 48271 + 4 * 69621) % 2147483647, uid) AS r FROM c), o2 AS (SELECT r, list_dot_product(embedding, lead(embedding) OVER (ORDER BY r)) AS s FROM o WHERE r <= 4000), p AS (SELECT s FROM o2 WHERE r % 2 = 1 AND s IS NOT NULL) SELECT count(*) AS n_cluster_pairs, round(avg(w.s), 5) AS within_mean, round(min(w.s), 5) AS within_min, (SELECT count(*) FROM p) AS n_random_pairs, (SELECT round(avg(s), 5) FROM p) AS random_mean, avg(w.s) - (SELECT avg(s) FROM p) > 0.1 AS passed FROM w")
def neardup_cohesion(spark, sf_dir):
    clusters = view(spark, sf_dir, "f_cases").where("cluster_id >= 0").select("uid", "cluster_id")
    return _round(K.neardup_cohesion(vectors(spark, sf_dir), clusters, 2000, 4), "within_mean", "within_min", "random_mean")


_B = "b AS (SELECT vec_id AS uid, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + (CASE WHEN (vec_id + i) % 3 = 0 THEN 0.15 ELSE -0.05 END)) AS embedding FROM embeddings)"


def shifted(spark, sf_dir):
    return vectors(spark, sf_dir).select("uid", F.transform("embedding", lambda x, i: x.cast("double") + F.when((F.col("uid") + i + 1) % 3 == 0, 0.15).otherwise(-0.05)).alias("embedding"))


@query("cross_modal_accuracy", f"WITH {_E}, {_B}, s AS (SELECT a.uid AS query, b.uid, row_number() OVER (PARTITION BY a.uid ORDER BY round(list_dot_product(a.embedding, b.embedding), 9) DESC, b.uid) AS r FROM e a JOIN b ON a.uid // 50 = b.uid // 50), k AS (SELECT avg(1.0 / n) AS baseline FROM (SELECT count(*) OVER (PARTITION BY uid // 50) AS n FROM b)) SELECT round(avg((r = 1)::INT), 5) AS top1, round(avg((r <= 5)::INT), 5) AS top5, count(*) AS n FROM s WHERE query = uid")
def cross_modal_accuracy(spark, sf_dir):
    return _round(K.cross_modal_accuracy(vectors(spark, sf_dir), shifted(spark, sf_dir)), "top1", "top5").drop("baseline")


@query("masking_impact", f"WITH {_E}, {_B}, s AS (SELECT uid, list_dot_product(e.embedding, b.embedding) / sqrt(list_dot_product(e.embedding, e.embedding) * list_dot_product(b.embedding, b.embedding)) AS s FROM e JOIN b USING (uid)) SELECT uid, round(s, 5) AS similarity, s < 0.9 AS flagged FROM s")
def masking_impact(spark, sf_dir):
    return _round(K.masking_impact(vectors(spark, sf_dir), shifted(spark, sf_dir)), "similarity")


# a cache was made before some texts changed, and there is none for one language
_CHANGED = "CASE WHEN lang IN ('de', 'fr') AND doc_id % 40 = 3 THEN concat(text, ' before') ELSE text END"
_HASH = lambda text: f"('0x' || substr(md5(concat(coalesce(length(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(length({text})::VARCHAR || ':' || {text}, '-'))), 1, 15))::BIGINT"
_CACHES = f"""src AS (SELECT doc_id, lang, {_HASH('text')} AS h FROM documents), old AS (SELECT doc_id, lang, {_HASH(f'({_CHANGED})')} AS h FROM documents WHERE lang <> 'es'),
n AS (SELECT lang, count(*) AS n, sum(h) AS t, bit_xor(h) AS m FROM src GROUP BY lang), o AS (SELECT lang, count(*) AS n, sum(h) AS t, bit_xor(h) AS m FROM old GROUP BY lang),
dec AS (SELECT coalesce(n.lang, o.lang) AS lang, coalesce(n.n, 0) AS n_source, coalesce(o.n, 0) AS n_stored, coalesce(n.n = o.n AND n.t = o.t AND n.m = o.m, false) AS valid FROM n FULL JOIN o ON n.lang = o.lang)"""


def caches(spark, sf_dir):
    source = base(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "doc_id", "lang", "text")
    old = source.where("lang <> 'es'").withColumn("text", F.expr(_CHANGED))
    return source, old, cache_valid_(source, fingerprints(old, ["doc_id", "text"], ["lang"]), ["doc_id", "text"], ["lang"])


@query("cache_valid", f"WITH {_CACHES} SELECT * FROM dec")
def cache_valid(spark, sf_dir):
    return caches(spark, sf_dir)[2]


@query("to_embed", f"WITH {_CACHES} SELECT src.doc_id AS uid FROM src JOIN dec ON dec.lang = src.lang AND NOT valid LEFT JOIN old ON old.doc_id = src.doc_id AND old.h = src.h WHERE old.doc_id IS NULL")
def to_embed(spark, sf_dir):
    source, old, decisions = caches(spark, sf_dir)
    cache = old.select("uid", "lang", content_hash("doc_id", "text").alias("content_hash"))
    return to_embed_(source, cache, decisions, ["doc_id", "text"], ["lang"]).select("uid")


@query("embed_batch")
def embed_batch_query(spark, sf_dir):
    t = base(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "text")
    return embed_batch(t, hashed_embedder(64))


@query("embedding_run_summary", f"WITH {duck('f_cases')} SELECT split, 'image' AS kind, count(*) AS n, count(*) FILTER (uid % 2 = 0) AS cached, count(*) FILTER (uid % 2 = 1) AS made FROM f_cases GROUP BY split")
def embedding_run_summary_query(spark, sf_dir):
    c = view(spark, sf_dir, "f_cases").select("uid", "split", F.lit("image").alias("kind"), (F.col("uid") % 2 == 0).alias("cached"))
    return embedding_run_summary(c)
