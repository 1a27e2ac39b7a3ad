"""Views over the driver tables that stand in for the library's inputs. Each is portable SQL, so that the Spark query and
its oracle start from the same definition; ``SQL`` holds the text, ``view`` the DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "f_problems": """SELECT p_partkey AS uid, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE
        concat(p_type, ';', replace(p_name, ' ', '; '), ';', p_brand) END AS problems FROM part""",
    "f_taxonomy": """SELECT * FROM (VALUES ('standard', 'normal', 'Normal', 0), ('Brand#13', 'exclude', NULL, NULL),
        ('hot', 'drop', NULL, NULL), ('cold', 'drop', NULL, NULL), ('old', 'drop', NULL, NULL), ('new', 'drop', NULL, NULL),
        ('red', 'drop', NULL, NULL), ('blue', 'drop', NULL, NULL), ('small', 'drop', NULL, NULL), ('large', 'drop', NULL, NULL),
        ('LARGE', 'class', 'Bulk', 1), ('MEDIUM', 'class', 'Bulk', 1), ('SMALL', 'class', 'Compact', 2), ('PROMO', 'class', 'Promo', 3),
        ('bolt', 'class', 'Fastener', 4), ('ring', 'class', 'Fastener', 4), ('rod', 'class', 'Fastener', 4),
        ('widget', 'class', 'Device', 5), ('gizmo', 'class', 'Device', 5), ('gear', 'class', 'Device', 5),
        ('plate', 'class', 'Plate', 6), ('anvil', 'class', 'Plate', 6)) AS t(term, kind, class, ord)""",
    "f_projections": """SELECT l_partkey AS uid, concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '.png') AS filename,
        CASE WHEN l_returnflag = 'A' THEN 'Frontal' ELSE 'Lateral' END AS projection FROM lineitem""",
    "f_reports": """SELECT doc_id AS uid, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat(replace(text, '. ', ' XXXX . '), ' xxx') ELSE text END AS findings,
        CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN 'nan' ELSE concat(split_part(text, '.', 1), '.') END AS impression FROM documents""",
    "f_cases": """SELECT vec_id AS uid, embedding, concat('L', CAST(label AS STRING)) AS primary_label,
        concat('L', CAST((label * 3 + vec_id) % 10 AS STRING)) AS second_label,
        CASE WHEN vec_id % 5 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor(vec_id / 3) AS BIGINT) END AS cluster_id,
        CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM embeddings""",
    "f_case_labels": """SELECT uid, primary_label AS label FROM ({f_cases}) a UNION SELECT uid, second_label AS label FROM ({f_cases}) b""",
    "f_case_texts": """SELECT vec_id AS uid, text AS findings, split_part(text, '.', 2) AS impression
        FROM embeddings LEFT JOIN documents ON vec_id = doc_id""",
    "f_neighbours": """SELECT conv_id AS query, turn, (conv_id * 7 + turn * 3) % (SELECT count(*) FROM embeddings) AS uid, 1.0 / (1 + turn) AS similarity FROM conversations""",
    "f_store": """SELECT o_orderkey AS report_id, o_orderkey AS session_id, o_custkey AS patient_id,
        CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_custkey % 25 END AS doctor_id,
        CASE WHEN o_orderstatus = 'O' THEN 'ai_draft' WHEN o_orderstatus = 'P' THEN 'doctor_edited' ELSE 'final' END AS status,
        o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS report_date, o_orderpriority AS findings, o_totalprice AS price,
        concat('study ', o_orderstatus) AS examination, concat('history ', CAST(o_custkey % 7 AS STRING)) AS clinical_history,
        CASE WHEN o_orderkey % 2 = 0 THEN 'AP' ELSE 'PA' END AS technique, CASE WHEN o_orderkey % 3 = 0 THEN 'now urgent.' WHEN o_orderkey % 7 = 0 THEN 'Low, not high' ELSE 'none' END AS impression,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'review' END AS recommendation, 'machine draft' AS disclaimer,
        CASE WHEN o_orderkey % 4 = 0 THEN 'empty section: recommendation' END AS warning FROM orders""",
    "f_edit_log": """SELECT event_id, user_id AS report_id, user_id % 5 AS owner, event_id % 5 AS actor, ts AS happened,
        event_type AS action, value FROM events""",
    "f_detections": """SELECT l_orderkey AS image_id, l_linenumber AS region, l_discount * 10 AS confidence, CAST(l_quantity AS BIGINT) * 3 AS x0,
        l_linenumber * 10 AS y0, CAST(l_quantity AS BIGINT) * 3 + 40 AS x1, l_linenumber * 10 + 12 AS y1,
        concat(l_linestatus, l_returnflag, 'text') AS text FROM lineitem""",
    "f_scores": """SELECT c_custkey AS uid, c_mktsegment AS cls, c_acctbal / 1000 AS a, (c_acctbal * 0.9 + (c_custkey % 7) * 100) / 1000 AS b FROM customer""",
    "f_label_matrix": """SELECT doc_id AS uid, 'quality' AS label, quality AS ref, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS gen FROM labels
        UNION ALL SELECT doc_id AS uid, 'toxic' AS label, toxic AS ref, CASE WHEN doc_id % 3 = 0 THEN 1 - toxic ELSE toxic END AS gen FROM labels""",
    "f_pairs": """SELECT a.conv_id * 1000 + a.turn AS case_id, a.text AS hyp, b.text AS ref FROM conversations a
        JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant' AND b.role = 'user'""",
}


def sql(name: str) -> str:
    """The text of a view with the views it is built on put in."""
    return re.sub(r"\{(f_\w+)\}", lambda m: sql(m[1]), SQL[name])


def duck(name: str) -> str:
    return f"{name} AS ({sql(name)})"


def derangement_sql(ids: str, seed: int) -> str:
    """CTEs that end in ``der`` (uid, partner) over the column uid of ``ids``."""
    return f"""h AS (SELECT uid, (uid % 2147483647 * 48271 + {seed} * 69621) % 2147483647 AS h FROM {ids}),
der AS (SELECT uid, coalesce(lead(uid) OVER w, first_value(uid) OVER w) AS partner FROM h WINDOW w AS (ORDER BY h, uid))"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql(name)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            base(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
