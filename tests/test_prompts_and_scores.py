"""Whole contents of prompts, stemmed ROUGE-L and embeddings against plain Python."""

import re
import zlib

import numpy as np
import pytest

from casebook.functions.stem import stem
from casebook.operators import embedding, reports, retrieval, scoring


def test_prompts_in_full(spark):
    near = spark.createDataFrame([(1, 11, 1, 0.9, -1), (1, 12, 2, 0.8, 5), (1, 13, 3, 0.7, 5), (2, 11, 1, 0.5, -1)], "query long, uid long, rank long, similarity double, cluster_id long")
    labels = spark.createDataFrame([(11, "Mass"), (12, "Mass"), (12, "Normal"), (13, "Normal")], "uid long, label string")
    texts = spark.createDataFrame([(11, "f", "i"), (12, "g", "j"), (13, "h", "k")], "uid long, findings string, impression string")
    context = retrieval.build_context(near, labels, texts)
    got = {r.query: r.prompt for r in reports.render_prompts(context, "ROLE", "SCHEMA", "RULES").collect()}
    # case 13 is folded into 12, whose cluster it shares; votes are those of all three cases
    assert got[1] == "\n\n".join(["ROLE", "Answer in English.", "SCHEMA", "RULES", "Votes:\n- Mass: 67 % of cases\n- Normal: 67 % of cases", "Evidence:\n[1] case 11 (similarity 0.900)\n[2] case 12 (similarity 0.800)"])
    assert got[2] == "\n\n".join(["ROLE", "Answer in English.", "SCHEMA", "RULES", "Votes:\n- Mass: 100 % of cases", "Evidence:\n[1] case 11 (similarity 0.500)"])
    from pyspark.sql import functions as F

    v = reports.render_variants(reports.render_prompts(context, "R", "S", "U"), F.array(F.lit("e1"), F.lit("e2")), F.lit("Why?"), "findings").where("query = 2").first()
    assert v.retry_prompt == v.prompt + "\n\nThe last answer was refused:\n- e1\n- e2" and v.explain_prompt == v.prompt + "\n\nQuestion: Why?" and v.section_prompt == v.prompt + "\n\nWrite the section findings alone."
    asked = spark.createDataFrame([(7, 2, "ai_draft", {"b": "2", "a": "1"}, " "), (8, 9, "ai_draft", None, None), (9, 2, "final", None, None)], "report_id long, session_id long, status string, answers map<string,string>, notes string")
    r = {x.report_id: x for x in reports.regen_inputs(asked, context, "impression", "R", "U").collect()}
    assert set(r) == {7, 8} and not r[7].context_incomplete and r[8].context_incomplete
    assert r[7].prompt == "\n\n".join(["R", "Answer in English.", "Write the section impression alone.", "U", "Votes:\n- Mass: 100 % of cases", "Evidence:\n[1] case 11 (similarity 0.500)", "Answers:\na 1\nb 2"])
    assert r[8].prompt == "\n\n".join(["R", "Answer in English.", "Write the section impression alone.", "U", "Votes:\nnone", "Evidence:\nnone"])


def test_edits_in_full(spark):
    none = (None,) * 5
    base = spark.createDataFrame([(1, 5, "h", "t", "f", "i", "r"), (2, None, "h", "t", "f", "i", "r"), (3, 5, "h", "t", "f", " ", None)], f"report_id long, owner long, {', '.join(f'{f} string' for f in reports.EDITABLE)}")
    events = [
        (1, 1, 1, 5, "edit", "h2", *none[1:]), (2, 1, 2, 6, "edit", *("x",) * 5), (3, 1, 3, 5, "edit", None, "t2", None, None, ""), (4, 1, 4, 5, "finalize", *none), (5, 1, 5, 5, "edit", *("y",) * 5),
        (6, 2, 1, 5, "edit", *("x",) * 5), (7, 3, 1, 5, "finalize", *none), (8, 3, 2, 5, "edit", *none),
    ]
    log = spark.createDataFrame(events, f"event_id long, report_id long, at long, actor long, kind string, {', '.join(f'{f} string' for f in reports.EDITABLE)}")
    state, decisions = reports.fold_edits(base, log)
    got = {r.report_id: (*[r[f] for f in reports.EDITABLE], r.status, r.edits) for r in state.collect()}
    assert got == {1: ("h2", "t2", "f", "i", "", "final", 2), 2: ("h", "t", "f", "i", "r", "ai_draft", 0), 3: ("h", "t", "f", " ", None, "doctor_edited", 1)}
    assert {r.event_id: r.reason for r in decisions.collect()} == {1: None, 2: "not the owner", 3: None, 4: None, 5: "already final", 6: "not the owner", 7: "incomplete", 8: None}


def test_comparison_reads_the_impression(spark):
    rows = [(1, 1, "2024-01-01", "clear lungs", "Pneumonia."), (2, 1, "2024-01-11", "cardiomegaly", "no change"), (3, 2, "2024-01-01", "x", "y")]
    store = spark.createDataFrame(rows, "report_id long, patient_id long, d string, findings string, impression string").selectExpr("*", "cast(d as timestamp) as created_at", "cast(d as date) as report_date")
    got = {r.report_id: (r.prior_id, r.resolved, r.persistent, r.new, r.days) for r in reports.compare_reports(store, ["Cardiomegaly", "Pneumonia"], strict=True).collect()}
    assert got == {2: (1, ["Pneumonia"], [], ["Cardiomegaly"], 10)}


def test_rouge_against_tables(spark, sf_dir):
    from casebook.plans.scoring_queries import pairs

    def want(h, r):
        h, r = ([stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (h, r))
        row = [0] * (len(r) + 1)
        for x in h:
            new = [0]
            for j, y in enumerate(r):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return 2 * row[-1] / (len(h) + len(r)) if h and r else 0.0

    p = pairs(spark, sf_dir).limit(150).cache()
    got = {r.case_id: r.rouge_l for r in scoring.rouge_l(p).collect()}
    assert len(got) > 20
    for r in p.collect():
        assert got[r.case_id] == pytest.approx(want(r.hyp, r.ref))
    p.unpersist()


def test_scores_per_field(spark):
    p = spark.createDataFrame([(1, "findings", "the cat sat on the mat", "the cat sat on the mat"), (1, "impression", "a b", "c d"), (2, "findings", "x", "")], "case_id long, field string, hyp string, ref string")
    s = spark.createDataFrame([(1, "completed", None), (2, "completed", None), (3, "failed", "time")], "case_id long, status string, reason string")
    got = {r.case_id: r for r in scoring.tier1_table(p, s).collect()}
    assert (round(got[1].findings_bleu, 6), got[1].findings_rouge_l, got[1].impression_meteor) == (100.0, 1.0, 0.0) and got[1].findings_meteor == pytest.approx(1 - 0.5 / 216)
    assert got[2].findings_rouge_l == 0 and got[2].impression_bleu is None and got[3].findings_bleu is None and got[3].reason == "time"


def test_scores_without_shuffles(spark, sf_dir):
    """No n-gram leaves its task; a field takes one pass; the scores are those of each scorer by itself."""
    from casebook.plans.scoring_queries import pairs

    p = pairs(spark, sf_dir)
    assert not re.search("Generate|Aggregate", scoring.sentence_bleu(p)._jdf.queryExecution().optimizedPlan().toString())
    p = spark.createDataFrame([tuple(r) for r in p.collect()], p.schema)
    both = p.selectExpr("case_id", "'findings' AS field", "hyp", "ref").unionByName(p.selectExpr("case_id", "'impression' AS field", "ref AS hyp", "hyp AS ref"))
    table = scoring.tier1_table(both, p.selectExpr("case_id", "'completed' AS status", "'' AS reason"))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = {r.case_id: r for r in table.collect()}
    for field, side in (("findings", p), ("impression", p.selectExpr("case_id", "ref AS hyp", "hyp AS ref"))):
        for name, scorer in (("bleu", scoring.sentence_bleu), ("rouge_l", scoring.rouge_l), ("meteor", scoring.meteor)):
            assert {r.case_id: r[name] for r in scorer(side).collect()} == {k: r[f"{field}_{name}"] for k, r in got.items()}


def test_baseline_scores_pairs_where_they_lie(spark):
    p = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "e f", "e f"), (3, "g", "h")], "case_id long, hyp string, ref string")
    partners = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "uid long, partner long")
    found = scoring.baseline_mismatch(p, partners, "bleu", scoring.sentence_bleu)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row per n-gram
    r = found.first()
    assert (r.real, r.baseline, r.gap) == (pytest.approx(200 / 3), 0, pytest.approx(200 / 3))


def test_embeddings_against_counts(spark):
    texts = [(1, "a b a"), (2, ""), (3, None), (4, "Word word other")]
    got = {r.uid: np.array(r.embedding) for r in embedding.embed_batch(spark.createDataFrame(texts, "uid long, text string"), embedding.hashed_embedder(8), batch=2).collect()}
    for uid, t in texts:
        v = np.zeros(8)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 8] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        assert np.allclose(got[uid], v / n if n else v, atol=1e-6)


def test_changed_text_under_an_old_key(spark):
    src = spark.createDataFrame([(1, "train", "a"), (2, "train", "b"), (3, "val", "c"), (4, "test", None)], "uid long, split string, text string")
    old = spark.createDataFrame([(1, "train", "a"), (2, "train", "B"), (3, "val", "c"), (9, "gone", "x")], "uid long, split string, text string")
    decided = embedding.cache_valid(src, embedding.fingerprints(old.repartition(3), ["uid", "text"], ["split"]), ["uid", "text"], ["split"])
    assert {r.split: (r.n_source, r.n_stored, r.valid) for r in decided.collect()} == {"train": (2, 2, False), "val": (1, 1, True), "test": (1, 0, False), "gone": (0, 1, False)}
    cache = old.select("uid", "split", embedding.content_hash("uid", "text").alias("content_hash"))
    assert sorted(r.uid for r in embedding.to_embed(src, cache, decided, ["uid", "text"], ["split"]).collect()) == [2, 4]


def test_content_stays_where_it_is_read(spark):
    """Hashes are shuffled, not texts; no row is dealt by its cache."""
    src = spark.range(50).selectExpr("id AS uid", "concat('s', id % 2) AS split", "repeat('x', 1 + int(id)) AS text")
    decided = spark.createDataFrame([("s0", False), ("s1", True)], "split string, valid boolean")
    cache = src.where("uid % 4 = 0").select("uid", "split", embedding.content_hash("uid", "text").alias("content_hash"))
    whole = embedding.to_embed(src, cache, decided, ["uid", "text"], ["split"])
    assert whole.columns == ["uid", "content_hash", "split", "text"]
    found, held = whole.select("uid"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert sorted(r.uid for r in found.collect()) == [u for u in range(50) if u % 2 == 0 and u % 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moved = re.findall(r"\) (?:Exchange|Sort)\s*\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("text" in x for x in moved) and "BroadcastHashJoin" in plan
