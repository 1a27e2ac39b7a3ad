"""Queries of the taxonomy operators."""

from pyspark.sql import functions as F

from casebook.operators import labels as L
from casebook.plans.fixtures import duck, view
from casebook.plans.registry import query

CLASSES = ["Normal", "Bulk", "Compact", "Promo", "Fastener", "Device", "Plate", "Other"]
TERMS = f"""{duck('f_problems')}, {duck('f_taxonomy')},
raw AS (SELECT uid, trim(unnest(string_split(problems, ';'))) AS term FROM f_problems),
terms AS (SELECT r.uid, r.term,
  CASE WHEN EXISTS (SELECT 1 FROM f_taxonomy t WHERE t.term = r.term AND kind = 'exclude') THEN 'exclude'
       WHEN EXISTS (SELECT 1 FROM f_taxonomy t WHERE lower(t.term) = lower(r.term) AND kind = 'normal') THEN 'normal'
       WHEN EXISTS (SELECT 1 FROM f_taxonomy t WHERE t.term = r.term AND kind = 'drop') THEN 'drop'
       WHEN EXISTS (SELECT 1 FROM f_taxonomy t WHERE t.term = r.term AND kind = 'class') THEN 'class' ELSE 'other' END AS kind FROM raw r WHERE r.term <> ''),
classed AS (SELECT DISTINCT t.uid, CASE kind WHEN 'normal' THEN 'Normal' WHEN 'other' THEN 'Other' ELSE (SELECT max(class) FROM f_taxonomy x WHERE x.term = t.term AND x.kind = 'class') END AS label FROM terms t WHERE kind IN ('normal', 'class', 'other')),
full_set AS (SELECT p.uid, coalesce(c.label, 'Other') AS label FROM f_problems p LEFT JOIN classed c ON p.uid = c.uid),
labelled AS (SELECT uid, label FROM full_set f WHERE label <> 'Normal' OR NOT EXISTS (SELECT 1 FROM full_set g WHERE g.uid = f.uid AND g.label <> 'Normal')),
flags AS (SELECT uid, bool_or(kind = 'exclude') AS flag FROM terms GROUP BY uid),
freq AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
ords AS (SELECT class AS label, min(ord) AS ord FROM f_taxonomy WHERE class IS NOT NULL GROUP BY class),
prim AS (SELECT uid, label AS primary_label FROM (SELECT l.uid, l.label, row_number() OVER (PARTITION BY l.uid ORDER BY n, coalesce(ord, 1073741824), l.label) AS r FROM labelled l JOIN freq USING (label) LEFT JOIN ords USING (label)) WHERE r = 1),
front AS (SELECT uid, min(filename) AS frontal_filename FROM ({duck('f_projections').partition(' AS ')[2]}) WHERE projection = 'Frontal' GROUP BY uid)"""


def labelled(spark, sf_dir):
    return L.resolve_labels(view(spark, sf_dir, "f_problems"), view(spark, sf_dir, "f_taxonomy"))


@query("resolve_labels", f"WITH {TERMS} SELECT l.uid, string_agg(label, ';' ORDER BY label) AS labels, coalesce(any_value(flag), false) AS exclude_flag FROM labelled l LEFT JOIN flags f ON l.uid = f.uid GROUP BY l.uid")
def resolve_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("uid", F.array_join("labels", ";").alias("labels"), "exclude_flag")


@query("unmapped_terms", f"WITH {TERMS} SELECT term, count(*) AS n FROM terms WHERE kind = 'other' GROUP BY term")
def unmapped_terms(spark, sf_dir):
    return L.unmapped_terms(view(spark, sf_dir, "f_problems"), view(spark, sf_dir, "f_taxonomy")).orderBy(F.desc("n"), "term")


@query("label_frequency", f"WITH {TERMS} SELECT label, n FROM freq")
def label_frequency(spark, sf_dir):
    return L.label_frequency(labelled(spark, sf_dir))


@query("primary_label", f"WITH {TERMS} SELECT uid, primary_label FROM prim")
def primary_label(spark, sf_dir):
    return L.primary_label(labelled(spark, sf_dir), view(spark, sf_dir, "f_taxonomy"))


_HOT = ", ".join(f"max(CASE WHEN label = '{c}' THEN 1 ELSE 0 END)::INT AS \"{c}\"" for c in CLASSES)


@query("one_hot", f"WITH {TERMS} SELECT uid, {_HOT} FROM labelled GROUP BY uid")
def one_hot(spark, sf_dir):
    return L.one_hot(labelled(spark, sf_dir), CLASSES)


@query("select_frontal", f"WITH {TERMS} SELECT * FROM front")
def select_frontal(spark, sf_dir):
    return L.select_frontal(view(spark, sf_dir, "f_projections"))


@query("study_index", f"WITH {TERMS} SELECT l.uid, any_value(primary_label) AS primary_label, string_agg(label, ';' ORDER BY label) AS label_set, count(*) AS num_labels, any_value(frontal_filename) IS NOT NULL AS has_frontal, any_value(frontal_filename) AS frontal_filename, coalesce(any_value(flag), false) AS exclude_flag, {_HOT} FROM labelled l LEFT JOIN flags f ON l.uid = f.uid LEFT JOIN prim p ON p.uid = l.uid LEFT JOIN front q ON q.uid = l.uid GROUP BY l.uid")
def study_index(spark, sf_dir):
    return L.study_index(view(spark, sf_dir, "f_problems"), view(spark, sf_dir, "f_taxonomy"), view(spark, sf_dir, "f_projections"), CLASSES)


@query("class_distribution", f"WITH {TERMS} SELECT label, n FROM freq")
def class_distribution(spark, sf_dir):
    return L.label_frequency(labelled(spark, sf_dir)).orderBy(F.desc("n"), "label")


@query("label_cardinality", f"WITH {TERMS} SELECT round(avg(k), 6) AS mean_labels, max(k) AS max_labels FROM (SELECT count(*) AS k FROM labelled GROUP BY uid)")
def label_cardinality(spark, sf_dir):
    return L.label_cardinality(labelled(spark, sf_dir)).withColumn("mean_labels", F.round("mean_labels", 6))


_QUESTIONS = "q AS (SELECT * FROM (VALUES ('Bulk', 1, 'How heavy?'), ('Bulk', 2, 'How many?'), ('Device', 1, 'Which kind?'), ('default', 1, 'Anything else?'), ('default', 2, 'Since when?')) AS t(label, pos, question))"


@query("questionnaire_lookup", f"WITH {TERMS}, {_QUESTIONS}, s AS (SELECT label, string_agg(question, '|' ORDER BY pos) AS qs FROM q GROUP BY label) SELECT uid, coalesce(s.qs, (SELECT qs FROM s WHERE label = 'default')) AS questions FROM prim LEFT JOIN s ON s.label = primary_label")
def questionnaire_lookup(spark, sf_dir):
    q = spark.sql(_QUESTIONS.partition(" AS ")[2][1:-1])
    p = primary_label(spark, sf_dir).withColumnRenamed("primary_label", "label")
    return L.questionnaire_lookup(p, q).select("uid", F.array_join("questions", "|").alias("questions"))
