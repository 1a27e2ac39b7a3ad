"""Queries of text scoring."""

from pyspark.sql import functions as F

from casebook.operators import metadata as M
from casebook.operators import scoring as S
from casebook.plans.fixtures import base, derangement_sql, duck, view
from casebook.plans.registry import query

_P = duck("f_pairs")


def _tokens(c):
    t = f"coalesce({c}, '')"
    for mark, put in S.MARKS:
        t = f"replace({t}, {_text(mark)}, '{put}')"
    t = f"concat(' ', {t}, ' ')"
    for pattern, put in S.SPLITS:
        t = f"regexp_replace({t}, '{pattern}', '{put.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return f"regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')"


def _text(x):
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


def _bleu(src, p=""):
    """CTEs that end in ``{p}bleu`` (case_id, bleu) over ``src`` (case_id, hyp, ref)."""
    grams = lambda s: f"SELECT case_id, n, g, count(*) AS c FROM (SELECT case_id, n, unnest(list_transform(range(1, greatest(len({s}) - n + 2, 1)), lambda i: array_to_string({s}[i:i + n - 1], ' '))) AS g FROM {p}tk, range(1, 5) x(n)) GROUP BY ALL"
    return f"""{p}tk AS (SELECT case_id, {_tokens('hyp')} AS h, {_tokens('ref')} AS r FROM {src}), {p}hg AS ({grams('h')}), {p}rg AS ({grams('r')}),
{p}per AS (SELECT case_id, n, sum(least(h.c, coalesce(r.c, 0))) AS m, sum(h.c) AS total FROM {p}hg h LEFT JOIN {p}rg r USING (case_id, n, g) GROUP BY case_id, n),
{p}sm AS (SELECT *, pow(2, sum((m = 0)::INT) OVER (PARTITION BY case_id ORDER BY n)) AS d FROM {p}per),
{p}bl AS (SELECT case_id, avg(CASE WHEN m > 0 THEN ln(m / total) ELSE -ln(d * total) END) AS s, max(m) AS hit FROM {p}sm GROUP BY case_id),
{p}bleu AS (SELECT case_id, CASE WHEN hit > 0 THEN 100 * (CASE WHEN len(h) < len(r) THEN exp(1 - len(r) / len(h)) ELSE 1 END) * exp(s) ELSE 0 END AS bleu FROM {p}tk LEFT JOIN {p}bl USING (case_id))"""


_BLEU = f"{_P}, {_bleu('f_pairs')}"


def pairs(spark, sf_dir):
    return view(spark, sf_dir, "f_pairs").withColumn("case_id", F.col("case_id").cast("long"))


@query("sentence_bleu", f"WITH {_BLEU} SELECT case_id, round(bleu, 4) AS bleu FROM bleu")
def sentence_bleu(spark, sf_dir):
    return S.sentence_bleu(pairs(spark, sf_dir)).withColumn("bleu", F.round("bleu", 4))


@query("rouge_l")
def rouge_l(spark, sf_dir):
    return S.rouge_l(pairs(spark, sf_dir))


@query("meteor")
def meteor(spark, sf_dir):
    return S.meteor(pairs(spark, sf_dir))


@query("tier1_table")
def tier1_table(spark, sf_dir):
    c = base(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"))
    p = pairs(spark, sf_dir)
    both = p.withColumn("field", F.lit("findings")).unionByName(p.select("case_id", F.col("ref").alias("hyp"), F.col("hyp").alias("ref"), F.lit("impression").alias("field")))
    return S.tier1_table(both, c)


_DERP = f"""{_BLEU}, ids AS (SELECT case_id AS uid FROM f_pairs), {derangement_sql('ids', 9)},
crossed AS (SELECT a.case_id, a.hyp, b.ref FROM f_pairs a JOIN der ON der.uid = a.case_id JOIN f_pairs b ON b.case_id = der.partner), {_bleu('crossed', 'x')},
both_ AS (SELECT (SELECT avg(bleu) FROM bleu) AS real, (SELECT avg(bleu) FROM xbleu) AS baseline)"""


@query("baseline_mismatch", f"WITH {_DERP} SELECT round(real, 4) AS real, round(baseline, 4) AS baseline, round(real - baseline, 4) AS gap FROM both_")
def baseline_mismatch(spark, sf_dir):
    p = pairs(spark, sf_dir)
    partners = M.derangement(p.select(F.col("case_id").alias("uid")), 9)
    found = S.baseline_mismatch(p, partners, "bleu", S.sentence_bleu)
    return found.select(*[F.round(c, 4).alias(c) for c in ("real", "baseline", "gap")])


_WD = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS w, coalesce(lang, '') AS lang FROM documents)"


@query("word_diff", f"WITH {_WD} SELECT doc_id AS id, round(CASE WHEN len(w) + (lang <> '')::INT > 0 THEN 100.0 * 2 * (len(w) // 5) / (len(w) + (lang <> '')::INT) ELSE 0 END, 6) AS edit_percentage, (len(w) >= 5)::INT AS sections_changed FROM w")
def word_diff(spark, sf_dir):
    d = base(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("w"))
    # the edit: every fifth word of the whole text is another one that occurs nowhere else; the language field stays
    edited = F.transform("w", lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("zq_"), i)).otherwise(x))
    draft = F.struct(F.array_join("w", " ").alias("findings"), F.col("lang").alias("impression"))
    final = F.struct(F.array_join(edited, " ").alias("findings"), F.col("lang").alias("impression"))
    found = S.word_diff(d.select(F.col("doc_id").alias("id"), draft.alias("draft"), final.alias("final")), ("findings", "impression"))
    return found.withColumn("edit_percentage", F.round("edit_percentage", 6))
