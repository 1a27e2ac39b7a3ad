"""Hand-calculated cases."""

import pytest
from pyspark.sql import functions as F

from casebook.functions.text import clean_text, mentioned_classes, normalize_text
from casebook.operators import dedup, labels, metadata, ranking, reports, retrieval, scoring
from casebook.operators.components import connected_components
from casebook.operators.preparation import parse_labels


def near(spark, rows):
    return spark.createDataFrame(rows, "query long, uid string, similarity double, rank long, cluster_id long")


def case_labels(spark, rows):
    return spark.createDataFrame(rows, "uid string, label string")


def test_vote(spark):
    n = near(spark, [(1, "a", 0.9, 1, -1), (1, "b", 0.6, 2, -1), (1, "c", 0.5, 3, -1)])
    v = {r.label: (round(r.vote_weight, 6), round(r.agreement, 4), r.vote_rank) for r in retrieval.label_vote(n, case_labels(spark, [("a", "Normal"), ("b", "Cardiomegaly"), ("c", "Normal")])).collect()}
    assert v == {"Normal": (1.4, 0.6667, 1), "Cardiomegaly": (0.6, 0.3333, 2)}
    n = near(spark, [(1, "a", 0.8, 1, -1), (1, "b", 0.4, 2, -1)])
    v = {r.label: (round(r.vote_weight, 6), r.agreement) for r in retrieval.label_vote(n, case_labels(spark, [("a", "Pneumonia"), ("a", "Effusion"), ("b", "Pneumonia")])).collect()}
    assert v == {"Pneumonia": (1.2, 1.0), "Effusion": (0.8, 0.5)}
    assert retrieval.label_vote(near(spark, []), case_labels(spark, [])).count() == 0


def test_evidence(spark):
    n = near(spark, [(1, "z", 0.5, 2, -1), (1, "a", 0.5, 3, -1), (1, "m", 0.9, 1, -1)])
    assert [r.uid for r in retrieval.evidence_order(n).orderBy("evidence_rank").collect()] == ["m", "a", "z"]
    n = near(spark, [(1, "a1", 0.9, 2, 10), (1, "a2", 0.95, 1, 10), (1, "a3", 0.7, 3, 20)])
    assert sorted(r.uid for r in retrieval.collapse_near_dups(n).collect()) == ["a2", "a3"]
    n = near(spark, [(1, x, 0.5, k, -1) for k, x in enumerate("abc")])
    assert retrieval.collapse_near_dups(n).count() == 3


def test_stats(spark):
    n = near(spark, [(1, "a", 0.9, 1, 1), (1, "b", 0.8, 2, 1), (1, "c", 0.6, 3, 2), (1, "d", 0.4, 4, -1)])
    queries = spark.createDataFrame([(1,), (2,)], "query long")
    got = {r.query: r for r in retrieval.retrieval_stats(n, case_labels(spark, [("a", "P"), ("c", "Q"), ("d", "P")]), queries).collect()}
    r = got[1]
    assert (r.n_cases, r.n_kept, r.n_collapsed, round(r.mean_similarity, 4), r.min_similarity, r.max_similarity, r.n_labels, r.n_clusters) == (4, 3, 1, 0.6333, 0.4, 0.9, 2, 2)
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("primary, joined, want", [("Cardiomegaly", "Atelectasis;Cardiomegaly;Effusion", ["Cardiomegaly", "Atelectasis", "Effusion"]), ("Cardiomegaly", "", ["Cardiomegaly"]), ("", "b; a", ["a", "b"]), (None, None, [])])
def test_parse_labels(spark, primary, joined, want):
    df = spark.createDataFrame([(primary, joined)], "p string, s string")
    assert df.select(parse_labels(F.col("p"), F.col("s"))).first()[0] == want


def test_text(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("NaN",), ("XXXX seen .  ok , xxxl",), ("b . . c",), ("a  b",)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["", "", "", "[REDACTED] seen. ok, xxxl", "b.. c", "a b"]
    assert spark.range(1).select(normalize_text(F.lit("The XXXX is  (big)"))).first()[0] == "the is big"
    assert spark.range(1).select(mentioned_classes(F.lit("No pneumothorax; abnormality"), ["Normal", "Pneumothorax"])).first()[0] == ["Pneumothorax"]


def test_labels(spark):
    p = spark.createDataFrame([(1, "NORMAL;Nodule"), (2, "normal"), (3, None), (4, "Bad;Lung"), (5, " ; odd")], "uid long, problems string")
    t = spark.createDataFrame([("normal", "normal", "Normal", 0), ("Nodule", "class", "Mass", 1), ("Bad", "exclude", None, None), ("Lung", "drop", None, None)], "term string, kind string, class string, ord int")
    got = {r.uid: (r.labels, r.exclude_flag) for r in labels.resolve_labels(p, t).collect()}
    assert got == {1: (["Mass"], False), 2: (["Normal"], False), 3: (["Other"], False), 4: (["Other"], True), 5: (["Other"], False)}


def test_findings_diff(spark):
    d = spark.range(1).select(reports.findings_diff(F.lit("Pneumonia and Cardiomegaly."), F.lit("cardiomegaly, Pleural Effusion"), ["Normal", "Cardiomegaly", "Pleural Effusion", "Pneumonia"]).alias("d")).first().d
    assert (d.resolved, d.persistent, d.new) == (["Pneumonia"], ["Cardiomegaly"], ["Pleural Effusion"])


def test_structural(spark):
    good = "\n".join(f"###{f.upper()}###\n{f} text" for f in reports.FIELDS)
    cases = {1: good, 2: "```\n" + good + "\n```", 3: good.replace("###FINDINGS###", "###Findings###"), 4: "no markers", 5: good + "\n###FINDINGS###\nmore", 6: good.replace("###TECHNIQUE###\ntechnique text\n", ""), 7: None, 8: good.replace("findings text", "")}
    df = spark.createDataFrame(list(cases.items()), "id long, raw string")
    got = {r.id: r for r in reports.structural_validate(df, "raw").collect()}
    assert [got[i].valid for i in range(1, 9)] == [True, True, False, False, False, False, False, True]
    assert got[1].content.findings == "findings text" and got[8].content.findings == "" and got[2].content.disclaimer == "disclaimer text"
    assert got[6].errors == ["missing field: technique"] and got[4].errors == ["no field markers"]


def test_edit_percentage(spark):
    rows = [(1, ("same text",), ("same text",)), (2, ("one two",), ("three four",)), (3, ("a b",), ("a  b",)), (4, ("",), ("new words",)), (5, ("fine",), ("fine!",))]
    df = spark.createDataFrame(rows, "id long, draft struct<findings:string>, final struct<findings:string>")
    got = {r.id: (r.edit_percentage, r.sections_changed) for r in scoring.word_diff(df, ("findings",)).collect()}
    assert got[1] == (0, 0) and got[2] == (200, 1) and got[3] == (0, 1) and got[4] == (0, 1) and got[5][1] == 1


def test_rouge(spark):
    p = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b c d", "b d x y"), (3, "", "x"), (4, "w " * 500, "w " * 450)], "case_id long, hyp string, ref string")
    assert {r.case_id: round(r.rouge_l, 4) for r in scoring.rouge_l(p).collect()} == {1: 1.0, 2: 0.5, 3: 0.0, 4: round(900 / 950, 4)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (6, 7), (7, 8), (8, 10), (10, 11)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 6: 6, 7: 6, 8: 6, 10: 6, 11: 6}
    assert connected_components(e.limit(0)).count() == 0


def test_derangement(spark):
    ids = spark.range(57).withColumnRenamed("id", "uid")
    got = metadata.derangement(ids, 3).collect()
    assert sorted(r.partner for r in got) == list(range(57)) and all(r.uid != r.partner for r in got)


def test_stratify_keeps_clusters_whole(spark, sf_dir):
    from casebook.plans.clusters_queries import RATIOS, case_clusters
    from casebook.plans.fixtures import view
    from tests.test_splits import greedy

    units = dedup.cluster_units(case_clusters(spark, sf_dir), view(spark, sf_dir, "f_case_labels"))
    got = dedup.iterative_stratify(units, RATIOS).toPandas()
    assert len(got) == units.count() and got.cluster_id.is_unique
    # ratios are those of studies, not of clusters: the heaviest clusters are dealt first, and train needs most
    weight = {r.cluster_id: r.weight for r in units.collect()}
    for name, share in RATIOS.items():
        assert abs(sum(weight[c] for c in got[got.split == name].cluster_id) / sum(weight.values()) - share) < 0.1
    assert dict(zip(got.cluster_id, got.split)) == greedy([(r.cluster_id, r.labels, r.weight) for r in units.collect()], RATIOS)


def test_ann_recall(spark, sf_dir):
    from casebook.plans.retrieval_queries import near, parts

    _, q, kb = parts(spark, sf_dir)
    exact = {(r.query, r.uid) for r in near(spark, sf_dir).collect()}
    found = {(r.query, r.uid) for r in retrieval.ann_topk(q, kb, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_gates(spark):
    df = spark.createDataFrame([("x", "m", 0.2, 0.1, 0.3), ("y", "m", 0.2, -0.1, 0.3), ("z", "m", -0.2, -0.3, -0.1)], "comparison string, metric string, delta double, low double, high double")
    got = {r.comparison: (r.excludes_zero, r.direction) for r in ranking.gate_table(df).collect()}
    assert got == {"x": (True, "better"), "y": (False, "not distinguishable"), "z": (True, "worse")}


def test_stem():
    from casebook.functions.stem import stem

    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "skies": "sky", "relational": "relat", "hopefulness": "hope", "adjustable": "adjust", "probate": "probat", "rate": "rate", "generalization": "gener", "dies": "die", "": "", "by": "by"}
    assert {w: stem(w) for w in want} == want


def test_bleu(spark):
    p = spark.createDataFrame([(1, "The cat sat.", "The cat sat."), (2, "the cat sat.", "The cat sat."), (3, "yes", "yes"), (4, "", "x"), (5, None, None), (6, "x", "y")], "case_id long, hyp string, ref string")
    got = {r.case_id: r.bleu for r in scoring.sentence_bleu(p).collect()}
    assert round(got[1], 6) == 100 and got[2] < 80 and round(got[3], 6) == 100 and got[4] == got[5] == got[6] == 0  # case counts; short ones have their orders
    assert spark.range(1).select(scoring.tokens(F.lit("a,b 1,000 (x) 5-6 &quot;q&quot;"))).first()[0] == ["a", ",", "b", "1,000", "(", "x", ")", "5", "-", "6", '"', "q", '"']


def test_structural_fences_and_markers(spark):
    good = "\n".join(f"###{f.upper()}###\n{f} text" for f in reports.FIELDS)
    cases = {1: "```text\n" + good + "\n```", 2: good.replace("###FINDINGS###", "## findings ##"), 3: good + "\n####\n##x y##\n#a#", 4: "``````", 5: ""}
    got = {r.id: r for r in reports.structural_validate(spark.createDataFrame(list(cases.items()), "id long, raw string"), "raw").collect()}
    assert got[1].valid and got[2].errors[0].startswith("malformed marker") and got[3].valid and got[3].content.disclaimer == "disclaimer text\n####\n##x y##\n#a#"
    assert got[4].errors == got[5].errors == ["no field markers"]


def test_index_rules(spark):
    r = spark.createDataFrame([(1, "train", "A"), (2, "test", "A"), (2, "train", None), (3, "train", "B"), (None, "train", "B")], "uid long, split string, primary_label string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, [2.0, 0.0]), (4, [float("nan"), 1.0]), (5, None)], "uid long, embedding array<double>")
    got = {x.rule: x.n for x in retrieval.index_validate(r, v, 2).collect()}
    assert got == {"test split in index": 1, "record without vector": 2, "vector without record": 3, "duplicate record": 1, "duplicate vector": 1, "missing field": 1, "dimension": 1, "not finite": 1, "zero norm": 1, "norm deviates": 2}
    assert retrieval.index_validate(r.limit(0), v.limit(0), 2).count() == 0
    assert retrieval.index_build(r, v, 2)[0] is None
