"""Queries of the report life-cycle."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.operators import reports as P
from casebook.operators import retrieval as R
from casebook.plans.fixtures import base, duck, view
from casebook.plans.registry import query

DAY = "1996-01-02"
_S, _E = duck("f_store"), duck("f_edit_log")
_D = "strftime({}, '%Y-%m-%d')"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def store(spark, sf_dir):
    return view(spark, sf_dir, "f_store")


@query("dashboard_stats", f"WITH {_S} SELECT doctor_id, count(*) AS my_reports, (SELECT count(*) FROM f_store) AS total_reports, count(DISTINCT patient_id) AS my_patients, count(*) FILTER (created_at::DATE = DATE '{DAY}') AS sessions_today, count(*) FILTER (status <> 'final') AS not_final, arg_min(report_id, (created_at, report_id)) FILTER (status <> 'final') AS oldest_id, {_D.format('min(created_at) FILTER (status <> ' + chr(39) + 'final' + chr(39) + ')')} AS oldest_at FROM f_store WHERE doctor_id IS NOT NULL GROUP BY doctor_id")
def dashboard_stats(spark, sf_dir):
    return P.dashboard_stats(store(spark, sf_dir), DAY).withColumn("oldest_at", day("oldest_at"))


@query("doctor_reports", f"WITH {_S} SELECT report_id, patient_id, c_name AS patient, {_D.format('created_at')} AS created FROM f_store LEFT JOIN customer ON c_custkey = patient_id AND c_custkey % 2 = 0 WHERE doctor_id = 7 ORDER BY created_at DESC, report_id DESC LIMIT 20")
def doctor_reports(spark, sf_dir):
    patients = base(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("patient"))
    return P.doctor_reports(store(spark, sf_dir), patients, 7, 20).select("report_id", "patient_id", "patient", day("created_at").alias("created"))


@query("patient_history", f"WITH {_S} SELECT patient_id, report_id, row_number() OVER (PARTITION BY patient_id ORDER BY created_at, report_id) AS position FROM f_store")
def patient_history(spark, sf_dir):
    return P.patient_history(store(spark, sf_dir)).select("patient_id", "report_id", F.col("position").cast("long").alias("position"))


_PRIOR = f"{_S}, prior AS (SELECT a.report_id, a.patient_id, arg_max(b.report_id, (b.created_at, b.report_id)) AS prior_id FROM f_store a JOIN f_store b ON a.patient_id = b.patient_id AND a.report_id <> b.report_id GROUP BY ALL)"


@query("prior_report", f"WITH {_PRIOR} SELECT * FROM prior")
def prior_report(spark, sf_dir):
    return P.prior_report(store(spark, sf_dir))


@query("prior_report_strict", f"WITH {_S}, p AS (SELECT report_id, patient_id, lag(report_id) OVER (PARTITION BY patient_id ORDER BY created_at, report_id) AS prior_id FROM f_store) SELECT * FROM p WHERE prior_id IS NOT NULL")
def prior_report_strict(spark, sf_dir):
    return P.prior_report(store(spark, sf_dir), strict=True)


_PRIO = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]


def _mentions(c):
    said = f"lower(concat_ws(' ', {c}.findings, {c}.impression))"
    return [f"regexp_matches({said}, '(^|[^\\pL\\pN_]){x.lower()}($|[^\\pL\\pN_])')" for x in _PRIO]


def _facts(join):
    pick = lambda test: "concat_ws('" + join + "', " + ", ".join(f"CASE WHEN {test(o, n)} THEN '{x}' END" for x, o, n in zip(_PRIO, _mentions("o"), _mentions("n"))) + ")"
    return f"{pick(lambda o, n: f'{o} AND NOT {n}')} AS resolved, {pick(lambda o, n: f'{o} AND {n}')} AS persistent, {pick(lambda o, n: f'{n} AND NOT {o}')} AS new, date_diff('day', o.report_date, n.report_date) AS days"


_COMPARED = "FROM prior p JOIN f_store n ON n.report_id = p.report_id JOIN f_store o ON o.report_id = p.prior_id"


@query("compare_reports", f"WITH {_PRIOR} SELECT p.report_id, p.prior_id, p.patient_id, {_facts(';')} {_COMPARED}")
def compare_reports(spark, sf_dir):
    c = P.compare_reports(store(spark, sf_dir), _PRIO)
    for x in ("resolved", "persistent", "new"):
        c = c.withColumn(x, F.array_join(x, ";"))
    return c.withColumn("days", F.col("days").cast("long"))


_DIFFT = ("the", "is", "of", "la")


@query("findings_diff", "WITH p AS (SELECT doc_id, text, lag(text) OVER (ORDER BY doc_id) AS old FROM documents), m AS (SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(lower(text), '(^|[^\\pL\\pN_]){t}($|[^\\pL\\pN_])'), false) AS n{i}, coalesce(regexp_matches(lower(old), '(^|[^\\pL\\pN_]){t}($|[^\\pL\\pN_])'), false) AS o{i}" for i, t in enumerate(_DIFFT)) + " FROM p) SELECT doc_id, " + ", ".join("concat_ws(';', " + ", ".join(f"CASE WHEN {cond.format(i=i)} THEN '{t}' END" for i, t in enumerate(_DIFFT)) + f") AS {name}" for name, cond in (("resolved", "o{i} AND NOT n{i}"), ("persistent", "o{i} AND n{i}"), ("new", "n{i} AND NOT o{i}"))) + " FROM m WHERE doc_id > 0")
def findings_diff(spark, sf_dir):
    d = base(spark, sf_dir, "documents").select("doc_id", "text")
    j = d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")
    j = j.select("doc_id", P.findings_diff(F.col("old"), F.col("text"), list(_DIFFT)).alias("d")).select("doc_id", "d.*")
    return j.select("doc_id", *[F.array_join(c, ";").alias(c) for c in ("resolved", "persistent", "new")])


#: what an event of the log says of each field, in both engines
_EDITS = {
    "clinical_history": "CASE WHEN event_id % 11 = 0 THEN concat('h', CAST(event_id % 100 AS STRING)) END",
    "technique": "CASE WHEN event_id % 7 = 0 THEN concat('t', CAST(event_id % 100 AS STRING)) END",
    "findings": "CASE WHEN action = 'click' THEN concat('v', CAST(CAST(floor(value) AS BIGINT) AS STRING)) END",
    "impression": "CASE WHEN action = 'view' THEN concat('v', CAST(CAST(floor(value) AS BIGINT) AS STRING)) WHEN action = 'signup' THEN '' END",
    "recommendation": "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'again' END",
}
_FIRST = {"clinical_history": "'old'", "technique": "CAST(NULL AS STRING)", "findings": "'draft'", "impression": "CASE WHEN report_id % 2 = 0 THEN 'draft' END", "recommendation": "'none'"}


def fold(spark, sf_dir):
    e = view(spark, sf_dir, "f_edit_log")
    log = e.select("event_id", "report_id", F.col("happened").alias("at"), "actor", F.when(F.col("action") == "purchase", "finalize").otherwise("edit").alias("kind"), *[F.expr(x).alias(f) for f, x in _EDITS.items()])
    reports = e.select("report_id", F.when(F.col("report_id") % 11 > 0, F.col("owner")).alias("owner")).distinct().select("*", *[F.expr(x).alias(f) for f, x in _FIRST.items()])
    return P.fold_edits(reports, log)


_NOW = ", ".join(f"coalesce(last_value(CASE WHEN own AND kind = 'edit' THEN {f} END IGNORE NULLS) OVER w, {_FIRST[f]}) AS {f}_now" for f in P.EDITABLE)
_FOLD = f"""{_E}, log AS (SELECT event_id, report_id, CASE WHEN report_id % 11 > 0 THEN owner END AS owner, actor, happened, CASE WHEN action = 'purchase' THEN 'finalize' ELSE 'edit' END AS kind, {", ".join(f"{x} AS {f}" for f, x in _EDITS.items())} FROM f_edit_log),
o AS (SELECT *, coalesce(actor = owner, false) AS own FROM log),
c AS (SELECT *, {_NOW} FROM o WINDOW w AS (PARTITION BY report_id ORDER BY happened, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, coalesce(trim(findings_now) <> '' AND trim(impression_now) <> '', false) AS complete, row_number() OVER (PARTITION BY report_id ORDER BY happened, event_id) AS rn FROM c),
z AS (SELECT *, min(CASE WHEN kind = 'finalize' AND own AND complete THEN rn END) OVER (PARTITION BY report_id) AS stop FROM k),
dec AS (SELECT *, CASE WHEN NOT own THEN 'not the owner' WHEN coalesce(rn > stop, false) THEN 'already final' WHEN kind = 'finalize' AND NOT complete THEN 'incomplete' END AS reason FROM z),
lst AS (SELECT report_id, max(rn) AS top, count(*) FILTER (kind = 'edit') AS edits, bool_or(kind = 'finalize') AS fin FROM dec WHERE reason IS NULL GROUP BY report_id),
fin AS (SELECT r.report_id, {", ".join(f"CASE WHEN top IS NULL THEN {_FIRST[f].replace('report_id', 'r.report_id')} ELSE dec.{f}_now END AS {f}" for f in P.EDITABLE)}, CASE WHEN fin THEN 'final' WHEN edits > 0 THEN 'doctor_edited' ELSE 'ai_draft' END AS status, coalesce(edits, 0) AS edits FROM (SELECT DISTINCT report_id FROM log) r LEFT JOIN lst USING (report_id) LEFT JOIN dec ON dec.report_id = lst.report_id AND dec.rn = lst.top)"""


@query("apply_edits", f"WITH {_FOLD} SELECT * FROM fin")
def apply_edits(spark, sf_dir):
    return fold(spark, sf_dir)[0].select("report_id", *P.EDITABLE, "status", "edits")


@query("finalize", f"WITH {_FOLD} SELECT report_id, event_id, actor, {_D.format('happened')} AS d FROM dec WHERE reason IS NULL AND kind = 'finalize'")
def finalize(spark, sf_dir):
    d = fold(spark, sf_dir)[1].where("accepted AND kind = 'finalize'")
    return d.select("report_id", "event_id", "actor", day("at").alias("d"))


@query("ownership_check", f"WITH {_FOLD} SELECT coalesce(reason, 'accepted') AS outcome, kind, count(*) AS n FROM dec GROUP BY ALL")
def ownership_check(spark, sf_dir):
    return fold(spark, sf_dir)[1].groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), "kind").agg(F.count("*").alias("n"))


@query("audit_trail", f"WITH {_FOLD} SELECT report_id, string_agg(event_id::VARCHAR, ',' ORDER BY happened, event_id) AS events FROM dec WHERE reason IS NULL AND kind = 'edit' GROUP BY report_id")
def audit_trail(spark, sf_dir):
    a = P.audit_trail(fold(spark, sf_dir)[1])
    return a.select("report_id", F.array_join(F.transform("audit", lambda x: x["event_id"].cast("string")), ",").alias("events"))


_TEXT = lambda c, fields: "concat_ws('|', " + ", ".join(f"coalesce({c(f)}, '-')" for f in fields) + ")"
_DETAIL = f"""WITH {_S}, {duck('f_neighbours')}, {duck('f_cases')}, {_FOLD}
SELECT s.report_id, s.status, {_TEXT(lambda f: f"CASE WHEN fin.report_id IS NULL THEN s.{f} ELSE fin.{f} END" if f in P.EDITABLE else f"s.{f}", P.FIELDS)} AS content, {_TEXT(lambda f: f"s.{f}", P.FIELDS)} AS ai_draft_content, coalesce(warning, '') AS warnings, warning IS NULL AS is_clean,
coalesce((SELECT string_agg(concat(n.uid, ':', primary_label), ',' ORDER BY turn, n.uid) FROM f_neighbours n JOIN f_cases c ON c.uid = n.uid WHERE n.query = s.report_id), '') AS evidence,
coalesce((SELECT string_agg(event_id::VARCHAR, ',' ORDER BY happened, event_id) FROM dec WHERE dec.report_id = s.report_id AND reason IS NULL AND kind = 'edit'), '') AS audit FROM f_store s LEFT JOIN fin ON fin.report_id = s.report_id"""


@query("report_detail", _DETAIL)
def report_detail(spark, sf_dir):
    state, decisions = fold(spark, sf_dir)
    n = view(spark, sf_dir, "f_neighbours").select(F.col("query").alias("session_id"), "uid", F.col("turn").alias("rank"))
    s = store(spark, sf_dir).withColumn("validation_warnings", F.when(F.col("warning").isNotNull(), F.array("warning")))
    d = P.report_detail(s, state, decisions, n, view(spark, sf_dir, "f_cases").select("uid", "primary_label"))
    text = lambda c: F.concat_ws("|", *[F.coalesce(f"{c}.{f}", F.lit("-")) for f in P.FIELDS]).alias(c)
    joined = lambda c, x: F.coalesce(F.array_join(F.transform(c, x), ","), F.lit("")).alias(c)
    return d.select("report_id", "status", text("content"), text("ai_draft_content"), F.array_join("validation_warnings", ";").alias("warnings"), "is_clean", joined("evidence", lambda e: F.concat(e["uid"].cast("string"), F.lit(":"), e["primary_label"])), joined("audit", lambda e: e["event_id"].cast("string")))


def documents_json(spark, sf_dir):
    d = base(spark, sf_dir, "documents")
    return d.select("doc_id", F.to_json(F.struct(F.lit("chest").alias("examination"), F.col("text").alias("findings"), F.col("lang").alias("impression"))).alias("doc"))


@query("report_struct", "SELECT doc_id, 'chest' AS examination, text AS findings, lang AS impression, NULL::VARCHAR AS recommendation FROM documents")
def report_struct(spark, sf_dir):
    return P.report_struct(documents_json(spark, sf_dir), "doc").select("doc_id", "content.examination", "content.findings", "content.impression", "content.recommendation")


@query("create_report_rows", "SELECT doc_id, text AS draft, text AS final, 'ai_draft' AS status FROM documents")
def create_report_rows(spark, sf_dir):
    r = P.create_report_rows(P.report_struct(documents_json(spark, sf_dir), "doc"))
    return r.select("doc_id", F.col("ai_draft_content.findings").alias("draft"), F.col("final_content.findings").alias("final"), "status")


def evidence(spark, sf_dir):
    n = view(spark, sf_dir, "f_neighbours").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("turn")))
    return n.join(view(spark, sf_dir, "f_cases").select("uid", "cluster_id"), "uid")


_EV = f"{duck('f_neighbours')}, {duck('f_cases')}, {duck('f_case_labels')}, ev AS (SELECT n.query, n.uid, n.similarity, row_number() OVER (PARTITION BY query ORDER BY turn) AS rank FROM f_neighbours n), evv AS (SELECT query, label, sum(similarity) AS w, count(*) / any_value(nn) AS agreement, min(rank) AS r FROM ev JOIN f_case_labels USING (uid) JOIN (SELECT query, count(*) AS nn FROM ev GROUP BY query) USING (query) GROUP BY query, label), vt AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, r, label) AS vr FROM evv)"


@query("semantic_validate", f"WITH {_EV}, rep AS (SELECT conv_id AS report_id, string_agg(text, ' ' ORDER BY turn) FILTER (turn % 2 = 0) || ' L1 and l2.' AS findings, string_agg(text, ' ' ORDER BY turn) FILTER (turn % 2 = 1) || ' L3' AS impression FROM conversations GROUP BY conv_id), t AS (SELECT *, lower(concat(coalesce(findings, ''), ' ', coalesce(impression, ''))) AS t FROM rep), x AS (SELECT report_id, trim(coalesce(findings, '')) = '' AS missing_findings, trim(coalesce(impression, '')) = '' AS missing_impression, " + "concat_ws(';', " + ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^\\pL\\pN_])l{k}($|[^\\pL\\pN_])') AND NOT EXISTS (SELECT 1 FROM evv WHERE evv.query = report_id AND label = 'L{k}') THEN 'L{k}' END" for k in range(10)) + ") AS unsupported, coalesce((SELECT agreement >= 0.5 AND NOT regexp_matches(t, concat('(^|[^\\pL\\pN_])', lower(label), '($|[^\\pL\\pN_])')) FROM vt WHERE vr = 1 AND vt.query = report_id), false) AS top_unreflected FROM t) SELECT report_id, missing_findings, missing_impression, unsupported, top_unreflected FROM x")
def semantic_validate(spark, sf_dir):
    c = base(spark, sf_dir, "conversations")
    side = lambda k: F.array_sort(F.collect_list(F.when((F.col("turn") % 2 == k) & F.col("text").isNotNull(), F.struct("turn", "text")))).alias(f"t{k}")
    said = lambda k, end: F.when(F.size(f"t{k}") > 0, F.concat(F.array_join(F.transform(f"t{k}", lambda x: x["text"]), " "), F.lit(end)))
    rep = c.groupBy(F.col("conv_id").alias("report_id")).agg(side(0), side(1)).select("report_id", said(0, " L1 and l2.").alias("findings"), said(1, " L3").alias("impression"))
    ev, labels = evidence(spark, sf_dir), view(spark, sf_dir, "f_case_labels")
    votes = R.label_vote(ev, labels).withColumnRenamed("query", "report_id")
    s = P.semantic_validate(rep, votes.select("report_id", "label"), votes, [f"L{k}" for k in range(10)])
    return s.select("report_id", "missing_findings", "missing_impression", F.array_join("unsupported", ";").alias("unsupported"), "top_unreflected")


def raw_responses(spark, sf_dir):
    """Marked texts built from conversations, broken in one of seven ways by the conversation's number."""
    c = base(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_replace("text", "[#\n`]", " ").alias("t"))
    k = F.col("id") % 7
    mark = lambda f, bad=None: F.concat(F.when(bad[0], F.lit(bad[1])).otherwise(F.lit(f"###{f.upper()}###")) if bad else F.lit(f"###{f.upper()}###"), F.lit("\n"), F.trim("t"), F.lit(f" {f}\n"))
    parts = [mark("examination"), F.when(k == 1, F.lit("")).otherwise(mark("clinical_history")), mark("technique", (k == 2, "###Technique###")), mark("findings"), mark("impression", (k == 3, "###IMPRESS###")), mark("recommendation"), mark("disclaimer")]
    text = F.concat(*parts)
    swapped = F.concat(parts[1], parts[0], *parts[2:])
    raw = F.when(k == 4, F.concat(text, mark("findings"))).when(k == 5, swapped).when(k == 6, F.col("t")).otherwise(F.concat(F.lit("```\n"), text, F.lit("```")))
    return c.select("id", "t", raw.alias("raw"))


_W7 = "CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN 'missing field: clinical_history' WHEN 2 THEN 'malformed marker: ###Technique###|missing field: technique' WHEN 3 THEN 'unknown marker: ###IMPRESS###|missing field: impression' WHEN 4 THEN 'repeated field: findings' WHEN 5 THEN 'fields out of order' ELSE 'no field markers' END"


@query("structural_validate", f"WITH c AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(text, '[#\\n`]', ' ', 'g')) AS t FROM conversations) SELECT id, id % 7 = 0 AS valid, {_W7} AS errors, CASE WHEN id % 7 = 0 THEN trim(concat(t, ' findings')) END AS findings FROM c")
def structural_validate(spark, sf_dir):
    v = P.structural_validate(raw_responses(spark, sf_dir), "raw")
    return v.select("id", "valid", F.array_join("errors", "|").alias("errors"), F.col("content.findings").alias("findings"))


def contexts(spark, sf_dir):
    ev, labels = evidence(spark, sf_dir), view(spark, sf_dir, "f_case_labels")
    return R.build_context(ev, labels, view(spark, sf_dir, "f_case_texts"))


@query("render_prompts")
def render_prompts(spark, sf_dir):
    return P.render_prompts(contexts(spark, sf_dir), "You write reports from evidence.", "Seven fields, each under its marker.", "Use nothing but the evidence.")


@query("render_variants")
def render_variants(spark, sf_dir):
    p = render_prompts(spark, sf_dir)
    return P.render_variants(p, F.array(F.lit("missing field: findings")), F.lit("Why this finding?"), "findings")


@query("regen_inputs", f"WITH {_S}, {_EV} SELECT report_id, report_id % 12 = 0 AS context_incomplete, report_id IN (SELECT query FROM ev) AS has_evidence, report_id % 4 > 0 AS has_answers, report_id % 6 > 0 AS has_notes FROM f_store WHERE status <> 'final'")
def regen_inputs(spark, sf_dir):
    k = F.col("report_id")
    s = store(spark, sf_dir).withColumn("answers", F.when(k % 4 > 0, F.create_map(F.lit("since"), F.concat(k % 30, F.lit(" days"))))).withColumn("notes", F.when(k % 6 > 0, F.concat(F.lit("note "), k)))
    r = P.regen_inputs(s, contexts(spark, sf_dir), "impression", "You write reports from evidence.", "Use nothing but the evidence.")
    has = lambda x: F.contains("prompt", F.lit(x))
    return r.select("report_id", "context_incomplete", has("[1] case ").alias("has_evidence"), has("Answers:\nsince ").alias("has_answers"), has("Notes: note ").alias("has_notes"))


_FACT = lambda c: f"CASE WHEN {c} <> '' THEN {c} ELSE 'none' END"
_PROMPT = f"concat('You compare two reports.', chr(10), chr(10), 'Previous report:', chr(10), before, chr(10), chr(10), 'Current report:', chr(10), now, chr(10), chr(10), 'Resolved: ', {_FACT('resolved')}, chr(10), 'Persistent: ', {_FACT('persistent')}, chr(10), 'New: ', {_FACT('new')}, chr(10), 'Days between: ', days, chr(10), chr(10), 'Say nothing that the facts do not.')"


@query("comparison_prompts", f"WITH {_PRIOR}, f AS (SELECT p.report_id, o.findings AS before, n.findings AS now, {_facts(', ')} {_COMPARED}) SELECT report_id, {_PROMPT} AS prompt FROM f")
def comparison_prompts(spark, sf_dir):
    s = store(spark, sf_dir)
    return P.comparison_prompts(P.compare_reports(s, _PRIO), s, "You compare two reports.", "Say nothing that the facts do not.")
