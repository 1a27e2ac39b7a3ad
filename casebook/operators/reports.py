"""Report life-cycle on tables: edits, audit trail, histories, comparisons, work queues, prompts and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.text import mentioned_classes, mentions

# fixed values: the seven fields of a report, in order, and those an editor may change
FIELDS = ("examination", "clinical_history", "technique", "findings", "impression", "recommendation", "disclaimer")
EDITABLE = ("clinical_history", "technique", "findings", "impression", "recommendation")
STATUSES = ("ai_draft", "under_review", "doctor_edited", "final")


def report_struct(rows: DataFrame, document: str) -> DataFrame:
    """A JSON document column as a typed struct ``content``."""
    return rows.withColumn("content", F.from_json(document, ", ".join(f"{f} string" for f in FIELDS))).drop(document)


def create_report_rows(drafts: DataFrame) -> DataFrame:
    """Draft and final content are the same at creation; warnings and model columns pass through."""
    return drafts.withColumn("ai_draft_content", F.col("content")).withColumn("final_content", F.col("content")).withColumn("status", F.lit("ai_draft")).drop("content")


def fold_edits(reports: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold an ordered log over reports: ``(state, decisions)``.

    ``reports`` (report_id, owner, the ``EDITABLE`` fields), ``log`` (event_id, report_id, at, actor, kind, the same
    fields); kind is ``edit`` or ``finalize``. An event counts when its actor owns the report (no owner, no match) and the
    report is not final yet; an edit overlays its non-null fields, even none; finalising needs findings and impression
    that are not blank as they stand then. Events go by (at, event_id). Rejected ones keep a reason. In ``decisions``,
    ``<field>_now`` is a field as it stands after the owner's edits up to the event."""
    w = Window.partitionBy("report_id").orderBy("at", "event_id")
    j = log.join(reports.select("report_id", "owner", *[F.col(f).alias(f"{f}_first") for f in EDITABLE]), "report_id")
    owned = j.withColumn("own", F.coalesce(F.col("actor") == F.col("owner"), F.lit(False)))
    edit = (F.col("kind") == "edit") & F.col("own")
    owned = owned.withColumns({f"{f}_now": F.coalesce(F.last(F.when(edit, F.col(f)), ignorenulls=True).over(w), F.col(f"{f}_first")) for f in EDITABLE})
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    complete = ~blank(F.col("findings_now")) & ~blank(F.col("impression_now"))
    closes = (F.col("kind") == "finalize") & F.col("own") & complete
    end = F.min(F.when(closes, F.struct("at", "event_id"))).over(Window.partitionBy("report_id"))
    here = F.struct("at", "event_id")
    seen = owned.withColumn("end", end).withColumn("late", F.coalesce(here > F.col("end"), F.lit(False)))
    reason = F.when(~F.col("own"), "not the owner").when(F.col("late"), "already final").when((F.col("kind") == "finalize") & ~complete, "incomplete")
    decisions = seen.select("event_id", "report_id", "kind", "at", "actor", reason.isNull().alias("accepted"), reason.alias("reason"), *[f"{f}_now" for f in EDITABLE])
    last = decisions.where("accepted").groupBy("report_id").agg(
        F.max_by(F.struct(*[F.col(f"{f}_now").alias(f) for f in EDITABLE]), F.struct("at", "event_id")).alias("now"),
        F.count_if(F.col("kind") == "edit").alias("edits"), F.max(F.when(F.col("kind") == "finalize", F.col("at"))).alias("finalized_at"), F.max(F.when(F.col("kind") == "finalize", F.col("actor"))).alias("finalized_by"),
    )
    s = reports.join(last, "report_id", "left")
    status = F.when(F.col("finalized_at").isNotNull(), STATUSES[3]).when(F.col("edits") > 0, STATUSES[2]).otherwise(STATUSES[0])
    content = [F.when(F.col("now").isNotNull(), F.col(f"now.{f}")).otherwise(F.col(f)).alias(f) for f in EDITABLE]
    state = s.select("report_id", "owner", *content, status.alias("status"), F.coalesce("edits", F.lit(0)).alias("edits"), "finalized_at", "finalized_by")
    return state, decisions


def audit_trail(decisions: DataFrame) -> DataFrame:
    """One row per report: its accepted edits in order; finalising leaves none."""
    return decisions.where("accepted AND kind = 'edit'").groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "actor"))).alias("audit"))


def report_detail(store: DataFrame, state: DataFrame, decisions: DataFrame, evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per report: its columns; the draft as it was generated and the content as it stands after the edits of
    ``fold_edits`` (state and decisions), both as structs of all seven ``FIELDS``; the warnings of its validation and
    whether there are none; the evidence as whole cases in order of rank, at a similarity of 1; the audit rows by time.

    ``store`` (report_id, session_id, patient_id, doctor_id, status, the fields, validation_warnings), ``evidence``
    (session_id, uid, rank), ``cases`` (uid, ...); ids without a case fall out of the evidence."""
    found = evidence.join(cases, "uid").withColumn("similarity", F.lit(1.0))
    case = F.struct("rank", "uid", "similarity", *[c for c in cases.columns if c != "uid"])
    listed = found.groupBy("session_id").agg(F.array_sort(F.collect_list(case)).alias("evidence"))
    now = state.select("report_id", F.struct(*EDITABLE).alias("now"), "finalized_at", "finalized_by")
    j = store.join(listed, "session_id", "left").join(now, "report_id", "left").join(audit_trail(decisions), "report_id", "left")
    content = [F.when(F.col("now").isNotNull(), F.col(f"now.{f}")).otherwise(F.col(f)).alias(f) if f in EDITABLE else F.col(f) for f in FIELDS]
    warnings = F.coalesce("validation_warnings", F.array().cast("array<string>"))
    return j.select(
        "report_id", "session_id", "patient_id", "doctor_id", "status", F.struct(*content).alias("content"), F.struct(*FIELDS).alias("ai_draft_content"),
        warnings.alias("validation_warnings"), (F.size(warnings) == 0).alias("is_clean"), "finalized_at", "finalized_by", "evidence", "audit",
    )


def prior_report(store: DataFrame, strict: bool = False) -> DataFrame:
    """``(report_id, patient_id, prior_id)``: the last other report of the patient by (created_at, report_id), which may
    be later than the current one; ``strict`` takes the one just before."""
    order = ["created_at", "report_id"]
    w = Window.partitionBy("patient_id").orderBy(*order)
    if strict:
        prior = F.lag("report_id").over(w)
        return store.select("report_id", "patient_id", prior.alias("prior_id")).where("prior_id IS NOT NULL")
    last2 = store.groupBy("patient_id").agg(F.max(F.struct(*order)).alias("top"))
    second = store.join(last2, "patient_id").where(F.col("report_id") != F.col("top.report_id")).groupBy("patient_id").agg(F.max(F.struct(*order)).alias("next"))
    j = store.join(last2, "patient_id").join(second, "patient_id")
    prior = F.when(F.col("report_id") == F.col("top.report_id"), F.col("next.report_id")).otherwise(F.col("top.report_id"))
    return j.select("report_id", "patient_id", prior.alias("prior_id"))


def findings_diff(previous: Column, current: Column, classes: list[str]) -> Column:
    """Classes that went, stayed and came between two texts, in taxonomy order."""
    a, b = mentioned_classes(previous, classes), mentioned_classes(current, classes)
    return F.struct(F.array_except(a, b).alias("resolved"), F.array_intersect(a, b).alias("persistent"), F.array_except(b, a).alias("new"))


def compare_reports(store: DataFrame, classes: list[str], strict: bool = False) -> DataFrame:
    """``prior_report`` and ``findings_diff`` for every report at once, with the days between the report dates. A class
    counts as mentioned in findings or impression."""
    said = F.concat_ws(" ", "findings", "impression")
    old = store.select(F.col("report_id").alias("prior_id"), said.alias("old_text"), F.col("report_date").alias("old_date"))
    j = store.withColumn("text", said).join(prior_report(store, strict).select("report_id", "prior_id"), "report_id").join(old, "prior_id")
    return j.select("report_id", "prior_id", "patient_id", findings_diff(F.col("old_text"), F.col("text"), classes).alias("d"), F.date_diff("report_date", "old_date").alias("days")).select("report_id", "prior_id", "patient_id", "d.*", "days")


def dashboard_stats(store: DataFrame, as_of) -> DataFrame:
    """Per doctor: reports, distinct patients, sessions of the day, reports not final, the oldest of those and its date;
    and how many reports there are in all. Null doctors are left out."""
    open_ = F.col("status") != "final"
    oldest = F.min(F.when(open_, F.struct("created_at", "report_id")))
    mine = store.where("doctor_id IS NOT NULL").groupBy("doctor_id").agg(
        F.count("*").alias("my_reports"), F.countDistinct("patient_id").alias("my_patients"), F.count_if(F.col("created_at").cast("date") == F.lit(as_of).cast("date")).alias("sessions_today"), F.count_if(open_).alias("not_final"), oldest.alias("o")
    )
    total = store.agg(F.count("*").alias("total_reports"))
    return mine.join(F.broadcast(total)).select("doctor_id", "my_reports", "total_reports", "my_patients", "sessions_today", "not_final", F.col("o.report_id").alias("oldest_id"), F.col("o.created_at").alias("oldest_at"))


def doctor_reports(store: DataFrame, patients: DataFrame, doctor, n: int) -> DataFrame:
    j = store.where(F.col("doctor_id") == doctor).join(patients, "patient_id", "left")
    return j.orderBy(F.desc("created_at"), F.desc("report_id")).limit(n)


def patient_history(store: DataFrame) -> DataFrame:
    """Every report with its place in its patient's history."""
    w = Window.partitionBy("patient_id").orderBy("created_at", "report_id")
    return store.withColumn("position", F.row_number().over(w))


# ---------------------------------------------------------------- validation of generated text


def _unfenced(text: Column) -> Column:
    """Text without white space around it and without three backticks at both ends and the word behind the first."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    inside = F.substring(bare, F.lit(4), F.length(bare) - 6)
    fenced = bare.startswith("```") & bare.endswith("```") & (F.length(bare) > 6)
    return F.btrim(F.when(fenced, F.regexp_replace(inside, r"^\w+", "")).otherwise(bare), F.lit(" \t\r\n"))


def _marker_name(line: Column) -> Column:
    """The word between two or more hash signs on either side that make up a line; empty for other lines."""
    bare = F.btrim(line, F.lit(" \t\r"))
    signs = [F.length(bare) - F.length(trim(bare, F.lit("#"))) for trim in (F.ltrim, F.rtrim)]
    word = F.btrim(F.btrim(bare, F.lit("#")), F.lit(" \t"))
    plain = F.translate(F.lower(word), "abcdefghijklmnopqrstuvwxyz_", "") == ""
    return F.when(plain & (signs[0] >= 2) & (signs[1] >= 2), word).otherwise("")


def structural_validate(rows: DataFrame, raw: str) -> DataFrame:
    """Adds ``valid``, ``errors`` and, where valid, ``content`` to responses that mark seven fields by ``###FIELD###``
    lines. A surrounding code fence is taken off. Unknown, malformed and repeated markers are errors, and so are missing
    fields and a wrong order."""
    lines = rows.withColumn("__l", F.transform(F.split(_unfenced(F.col(raw)), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line"), _marker_name(x).alias("name"))))
    marks = lines.withColumn("__m", F.filter("__l", lambda x: x["name"] != ""))
    known = F.array(*[F.lit(f) for f in FIELDS])
    exact = lambda m: F.trim(m["line"]) == F.concat(F.lit("###"), F.upper(m["name"]), F.lit("###"))
    is_known = lambda m: F.array_contains(known, F.lower(m["name"]))
    good = F.filter("__m", lambda m: is_known(m) & exact(m))
    names = F.transform(good, lambda m: F.lower(m["name"]))
    staged = marks.withColumn("__g", good).withColumn("__n", names).withColumn("__u", F.array_distinct("__n"))
    note = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    unknown = F.transform(F.filter("__m", lambda m: ~is_known(m)), lambda m: F.concat(F.lit("unknown marker: "), F.trim(m["line"])))
    malformed = F.transform(F.filter("__m", lambda m: is_known(m) & ~exact(m)), lambda m: F.concat(F.lit("malformed marker: "), F.trim(m["line"])))
    twice = F.transform(F.filter("__u", lambda n: F.size(F.filter("__n", lambda x: x == n)) > 1), lambda n: F.concat(F.lit("repeated field: "), n))
    missing = F.transform(F.array_except(known, F.col("__u")), lambda n: F.concat(F.lit("missing field: "), n))
    order = note(F.col("__u") != F.array_intersect(known, F.col("__u")), F.lit("fields out of order"))
    none = note(F.size("__m") == 0, F.lit("no field markers"))
    errors = F.when(F.size("__m") == 0, none).otherwise(F.concat(unknown, malformed, twice, missing, order))
    checked = staged.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)

    def segment(k: int) -> Column:
        start = F.element_at("__m", k + 1)["i"] + 2
        stop = F.element_at("__m", k + 2)["i"] if k + 1 < len(FIELDS) else F.size("__l")
        body = F.transform(F.slice("__l", start, F.greatest(stop - start + 1, F.lit(0))), lambda x: x["line"])
        return F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias(FIELDS[k])

    content = F.when(F.col("valid"), F.struct(*[segment(k) for k in range(len(FIELDS))]))
    return checked.withColumn("content", content).drop("__l", "__m", "__g", "__n", "__u")


def semantic_validate(reports: DataFrame, evidence_labels: DataFrame, votes: DataFrame, classes: list[str], least: float = 0.5) -> DataFrame:
    """``(report_id, missing_findings, missing_impression, unsupported, top_unreflected, warnings, is_clean)``.
    ``evidence_labels`` (report_id, label), ``votes`` (report_id, label, agreement, vote_rank)."""
    labels = evidence_labels.groupBy("report_id").agg(F.collect_set("label").alias("supported"))
    top = votes.where("vote_rank = 1").select("report_id", F.col("label").alias("top_label"), "agreement")
    text = F.concat_ws(" ", F.coalesce("findings", F.lit("")), F.coalesce("impression", F.lit("")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    j = reports.join(labels, "report_id", "left").join(top, "report_id", "left").withColumn("__t", text)
    said = F.array_except(mentioned_classes(F.col("__t"), classes), F.coalesce("supported", F.array().cast("array<string>")))
    shown = F.lit(False)
    for c in classes:
        shown = shown | ((F.col("top_label") == c) & mentions(F.col("__t"), c))
    j = j.withColumn("missing_findings", blank("findings")).withColumn("missing_impression", blank("impression")).withColumn("unsupported", said)
    j = j.withColumn("top_unreflected", F.coalesce((F.col("agreement") >= least) & ~shown, F.lit(False)))
    some = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(
        some(F.col("missing_findings"), F.lit("no findings")), some(F.col("missing_impression"), F.lit("no impression")),
        F.transform("unsupported", lambda x: F.concat(F.lit("no case supports: "), x)),
        some(F.col("top_unreflected"), F.concat(F.lit("leading vote left out: "), "top_label", F.lit(", share "), F.format_number("agreement", 2))),
    )
    return j.select("report_id", "missing_findings", "missing_impression", "unsupported", "top_unreflected", warnings.alias("warnings"), (F.size(warnings) == 0).alias("is_clean"))


# ---------------------------------------------------------------- prompts


def _prompt(columns: list[str], role: str, schema: str, rules: str, language: str) -> Column:
    votes = F.array_join(F.transform("votes", lambda v: F.concat(F.lit("- "), v["label"], F.lit(": "), F.format_number(v["agreement"] * 100, 0), F.lit(" % of cases"))), "\n")
    cases = F.array_join(F.transform("cases", lambda c: F.concat(F.lit("["), c["evidence_rank"].cast("string"), F.lit("] case "), c["uid"].cast("string"), F.lit(" (similarity "), F.format_number(c["similarity"], 3), F.lit(")"))), "\n")
    parts = [F.lit(role), F.lit(f"Answer in {language}."), F.lit(schema), F.lit(rules), F.concat(F.lit("Votes:\n"), F.coalesce(votes, F.lit("none"))), F.concat(F.lit("Evidence:\n"), F.coalesce(cases, F.lit("none")))]
    if "answers" in columns:
        pairs = F.array_sort(F.map_entries("answers"))
        parts.append(F.when(F.size(pairs) > 0, F.concat(F.lit("Answers:\n"), F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(" "), e["value"])), "\n"))))
    if "notes" in columns:
        parts.append(F.when(F.trim("notes") != "", F.concat(F.lit("Notes: "), F.col("notes"))))
    return F.concat_ws("\n\n", *parts)


def render_prompts(context: DataFrame, role: str, schema: str, rules: str, language: str = "English") -> DataFrame:
    """``(query, prompt)``: role, language, output schema, grounding rules, votes, evidence in order, answers by question
    and notes, as one text per case. ``context`` has votes and cases as ``build_context`` makes them, and may have
    ``answers`` (map) and ``notes``; where these are missing or blank, their part is left out."""
    return context.select("query", _prompt(context.columns, role, schema, rules, language).alias("prompt"))


def regen_inputs(reports: DataFrame, context: DataFrame, section: str, role: str, rules: str, language: str = "English") -> DataFrame:
    """``(report_id, context_incomplete, prompt)``: what one section of every open report is written anew from.

    ``reports`` (report_id, session_id, status, answers, notes); final ones are left out. ``context`` is the stored
    evidence of ``build_context`` with the session as ``query``. The context counts as incomplete only when answers and
    notes are both null: an empty answer is known, not missing."""
    j = reports.where("status <> 'final'").join(context.withColumnRenamed("query", "session_id"), "session_id", "left")
    prompt = _prompt(j.columns, role, f"Write the section {section} alone.", rules, language)
    return j.select("report_id", (F.col("answers").isNull() & F.col("notes").isNull()).alias("context_incomplete"), prompt.alias("prompt"))


def comparison_prompts(compared: DataFrame, store: DataFrame, role: str, rules: str) -> DataFrame:
    """``(report_id, prompt)``: both reports' texts and the facts of ``compare_reports`` for every compared pair."""
    side = lambda key, name: store.select(F.col("report_id").alias(key), F.coalesce("findings", F.lit("")).alias(name))
    j = compared.join(side("report_id", "now"), "report_id").join(side("prior_id", "before"), "prior_id")
    facts = [F.concat(F.lit(f"{c.capitalize()}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")) for c in ("resolved", "persistent", "new")]
    days = F.concat(F.lit("Days between: "), F.coalesce(F.col("days").cast("string"), F.lit("unknown")))
    parts = [F.lit(role), F.concat(F.lit("Previous report:\n"), "before"), F.concat(F.lit("Current report:\n"), "now"), F.concat_ws("\n", *facts, days), F.lit(rules)]
    return j.select("report_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def render_variants(prompts: DataFrame, errors: Column | None = None, question: Column | None = None, section: str | None = None) -> DataFrame:
    """The retry, explanation and section prompts that follow from a first prompt."""
    out = prompts
    if errors is not None:
        out = out.withColumn("retry_prompt", F.concat_ws("\n\n", "prompt", F.concat(F.lit("The last answer was refused:\n"), F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n"))))
    if question is not None:
        out = out.withColumn("explain_prompt", F.concat_ws("\n\n", "prompt", F.concat(F.lit("Question: "), question)))
    if section is not None:
        out = out.withColumn("section_prompt", F.concat_ws("\n\n", "prompt", F.lit(f"Write the section {section} alone.")))
    return out
