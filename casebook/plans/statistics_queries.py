"""Queries of resampling statistics and gates."""

from pyspark.sql import functions as F

from casebook.operators import preparation as O
from casebook.operators import ranking as K
from casebook.operators.metadata import derangement
from casebook.operators.resampling import draws_sql
from casebook.plans.fixtures import base, derangement_sql, duck, view
from casebook.plans.registry import query

B, SEED = 2000, 7
_S, _M = duck("f_scores"), duck("f_label_matrix")


def _draw(src, value, name, part=""):
    return draws_sql(src, value, name, B, SEED, part)


def _r(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("bootstrap_mean_ci", f"WITH RECURSIVE {_S}, {_draw('f_scores', 'a', 'x')}, m AS (SELECT b, avg(v) AS m FROM x GROUP BY b) SELECT (SELECT round(avg(a), 6) FROM f_scores) AS mean, (SELECT count(*) FROM f_scores) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_mean_ci(spark, sf_dir):
    return _r(K.bootstrap_mean_ci(view(spark, sf_dir, "f_scores"), "a", B, SEED), "mean", "low", "high")


_STR = f"m AS (SELECT b, avg(m) AS m FROM (SELECT b, cls, avg(v) AS m FROM x GROUP BY b, cls) GROUP BY b)"


@query("bootstrap_stratified_macro", f"WITH RECURSIVE {_S}, {_draw('f_scores', 'a', 'x', 'cls')}, {_STR} SELECT (SELECT round(avg(m), 6) FROM (SELECT avg(a) AS m FROM f_scores GROUP BY cls)) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_stratified_macro(spark, sf_dir):
    return _r(K.bootstrap_stratified_macro(view(spark, sf_dir, "f_scores"), "a", "cls", B, SEED), "mean", "low", "high")


_DIFF = f"{_S}, {_draw('f_scores', 'a - b', 'x', 'cls')}, {_STR}, d AS (SELECT (SELECT avg(m) FROM (SELECT avg(a - b) AS m FROM f_scores GROUP BY cls)) AS delta, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m)"
_DIFF = _DIFF.replace("a - b AS v", "f_scores.a - f_scores.b AS v")


@query("bootstrap_paired_diff", f"WITH RECURSIVE {_DIFF} SELECT round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high FROM d")
def bootstrap_paired_diff(spark, sf_dir):
    return _r(K.bootstrap_paired_diff(view(spark, sf_dir, "f_scores"), "a", "b", "cls", B, SEED), "delta", "low", "high")


@query("percentile_ci", f"WITH RECURSIVE {_S} SELECT cls, round(quantile_cont(a, 0.05), 4) AS low, round(quantile_cont(a, 0.95), 4) AS high FROM f_scores GROUP BY cls")
def percentile_ci(spark, sf_dir):
    return _r(K.percentile_ci(view(spark, sf_dir, "f_scores"), "a", ["cls"], 0.1), "low", "high", digits=4)


_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
_CNT = "sum((gen = 1 AND ref = 1)::INT)::BIGINT AS tp, sum((gen = 1 AND ref = 0)::INT)::BIGINT AS fp, sum((gen = 0 AND ref = 1)::INT)::BIGINT AS fn"
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"


@query("confusion_f1", f"WITH {_M}, per AS (SELECT label, {_CNT} FROM f_label_matrix GROUP BY label), pf AS (SELECT label, tp, fp, fn, {_PR}, {_F1} AS f1 FROM per), mi AS (SELECT {_CNT} FROM f_label_matrix), al AS (SELECT * FROM pf UNION ALL SELECT '(macro)', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, avg(precision), avg(recall), avg(f1) FROM pf UNION ALL SELECT '(micro)', tp, fp, fn, {_PR}, {_F1} FROM mi) SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM al")
def confusion_f1(spark, sf_dir):
    return _r(K.confusion_f1(view(spark, sf_dir, "f_label_matrix")), "precision", "recall", "f1").select("label", "tp", "fp", "fn", "precision", "recall", "f1")


@query("label_matrix", f"WITH {_M} SELECT uid, max(gen) FILTER (label = 'quality') AS gen_quality, max(gen) FILTER (label = 'toxic') AS gen_toxic, max(ref) FILTER (label = 'quality') AS ref_quality, max(ref) FILTER (label = 'toxic') AS ref_toxic FROM f_label_matrix GROUP BY uid")
def label_matrix(spark, sf_dir):
    return O.label_matrix(view(spark, sf_dir, "f_label_matrix"), ["quality", "toxic"])


_KIND = "SELECT uid, '' AS side, label, gen, ref FROM f_label_matrix UNION ALL SELECT a.uid, 'baseline_', a.label, a.gen, b.ref FROM f_label_matrix a JOIN der USING (uid) JOIN f_label_matrix b ON b.uid = der.partner AND b.label = a.label"
_DM = f"{_M}, ids AS (SELECT DISTINCT uid FROM f_label_matrix), {derangement_sql('ids', SEED)}, kinds AS ({_KIND}), {_draw('ids', '0', 'x')}, per AS (SELECT b, side, label, {_CNT} FROM x JOIN kinds USING (uid) GROUP BY b, side, label), bm AS (SELECT b, side, avg({_F1}) AS macro_f1, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM per GROUP BY b, side), al AS (SELECT concat(side, 'macro_f1') AS metric, macro_f1 AS v FROM bm UNION ALL SELECT concat(side, 'micro_f1'), {_F1} FROM bm UNION ALL SELECT 'macro_f1_gain', a.macro_f1 - z.macro_f1 FROM bm a JOIN bm z ON a.b = z.b AND a.side = '' AND z.side <> ''), iv AS (SELECT metric, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM al GROUP BY metric)"


@query("bootstrap_f1_ci", f"WITH RECURSIVE {_DM} SELECT metric, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS excludes_zero FROM iv")
def bootstrap_f1_ci(spark, sf_dir):
    m = view(spark, sf_dir, "f_label_matrix")
    partners = derangement(m.select("uid").distinct(), SEED)
    return _r(K.bootstrap_f1_ci(m, B, SEED, partners), "low", "high")


_L = f"{_S}, l AS (SELECT uid, 'a' AS metric, a AS v FROM f_scores UNION ALL SELECT uid, 'b', b FROM f_scores), {_draw('l', 'v', 'x', 'metric')}, m AS (SELECT metric, b, avg(v) AS m FROM x GROUP BY metric, b), t AS (SELECT metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY metric), p AS (SELECT metric, count(*) AS n, avg(v) AS mean FROM l GROUP BY metric), tab AS (SELECT *, high - low AS width FROM p JOIN t USING (metric))"


@query("metric_ci_table", f"WITH RECURSIVE {_L} SELECT metric, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(width, 6) AS width FROM tab")
def metric_ci_table(spark, sf_dir):
    return _r(K.metric_ci_table(view(spark, sf_dir, "f_scores"), ["a", "b"], B, SEED), "mean", "low", "high", "width")


@query("required_n", f"WITH RECURSIVE {_L}, r AS (SELECT metric, n * pow(width / (0.2 * mean), 2) AS required FROM tab) SELECT metric, round(required, 4) AS required, ceil(required / 0.98)::BIGINT AS to_sample, required = (SELECT max(required) FROM r) AS is_binding FROM r")
def required_n(spark, sf_dir):
    t = K.metric_ci_table(view(spark, sf_dir, "f_scores"), ["a", "b"], B, SEED)
    return K.required_n(t, failure_rate=0.02).select("metric", F.round("required", 4).alias("required"), F.col("to_sample").cast("long").alias("to_sample"), "is_binding")


_GATES = f"{_DIFF}, g AS (SELECT 'a-b' AS comparison, 'recall@5' AS metric, low, high FROM d UNION ALL SELECT 'a-b', 'ndcg@10', low - 1, high + 1 FROM d UNION ALL SELECT 'b-a', 'recall@5', -high, -low FROM d)"
_DIR = "CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'not distinguishable' END"


def intervals(spark, sf_dir):
    d = K.bootstrap_paired_diff(view(spark, sf_dir, "f_scores"), "a", "b", "cls", B, SEED)
    row = lambda c, m, low, high: d.select(F.lit(c).alias("comparison"), F.lit(m).alias("metric"), low.alias("low"), high.alias("high"))
    low, high = F.col("low"), F.col("high")
    return row("a-b", "recall@5", low, high).unionByName(row("a-b", "ndcg@10", low - 1, high + 1)).unionByName(row("b-a", "recall@5", -high, -low))


@query("gate_table", f"WITH RECURSIVE {_GATES} SELECT comparison, metric, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS excludes_zero, {_DIR} AS direction FROM g")
def gate_table(spark, sf_dir):
    return _r(K.gate_table(intervals(spark, sf_dir)), "low", "high")


@query("gate_decision", f"WITH RECURSIVE {_GATES} SELECT comparison, bool_and({_DIR} = 'better') AS passed FROM g WHERE comparison = 'a-b' OR metric = 'recall@5' GROUP BY comparison")
def gate_decision(spark, sf_dir):
    return K.gate_decision(K.gate_table(intervals(spark, sf_dir)), {"b-a": ["recall@5"], "a-b": ["recall@5", "ndcg@10"]})


@query("score_summary", f"WITH RECURSIVE {_S} SELECT cls, round(avg(a), 6) AS mean_a, round(stddev_samp(a), 6) AS std_a FROM f_scores GROUP BY cls")
def score_summary(spark, sf_dir):
    return _r(O.score_summary(view(spark, sf_dir, "f_scores"), ["cls"], ["a"]), "mean_a", "std_a")


@query("completion_counts", f"WITH {duck('f_store')} SELECT CASE WHEN status = 'final' THEN 'completed' ELSE 'failed' END AS outcome, status AS reason, count(*) AS n FROM f_store GROUP BY ALL")
def completion_counts(spark, sf_dir):
    return O.completion_counts(view(spark, sf_dir, "f_store"), "final")


def _sub(n):
    return f"SELECT * FROM (SELECT * FROM f_scores ORDER BY (uid % 2147483647 * 48271 + {SEED} * 69621) % 2147483647, uid LIMIT {n})"


_WS = ", ".join(f"s{n} AS ({_sub(n)}), l{n} AS (SELECT uid, 'a' AS metric, a AS v FROM s{n} UNION ALL SELECT uid, 'b', b FROM s{n}), {_draw(f'l{n}', 'v', f'x{n}', 'metric')}, m{n} AS (SELECT metric, b, avg(v) AS m FROM x{n} GROUP BY metric, b), w{n} AS (SELECT metric, (SELECT count(*) FROM s{n}) AS n, quantile_cont(m, 0.975) - quantile_cont(m, 0.025) AS width FROM m{n} GROUP BY metric)" for n in (70, 50))


@query("width_scaling", f"WITH RECURSIVE {_L}, {_WS} SELECT u.metric, u.n, round(u.width, 6) AS width, round(tab.width * sqrt(tab.n / u.n), 6) AS predicted FROM (SELECT * FROM w70 UNION ALL SELECT * FROM w50) u JOIN tab USING (metric)")
def width_scaling(spark, sf_dir):
    return _r(K.width_scaling(view(spark, sf_dir, "f_scores"), ["a", "b"], (70, 50), B, SEED), "width", "predicted")
