"""Versioned tables: what a commit rewrites, what a crash leaves, what a retry does."""

import os

import pytest
from pyspark.sql import functions as F

from casebook.sources import tables
from casebook.sources.versioned import BUCKET, VersionedTable


def contents(t, version=None):
    return sorted((r.k, r.v) for r in t.read(version).collect())


@pytest.fixture()
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k", "k long, v string", n_buckets=8)
    t.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    return t


def test_one_row_rewrites_one_bucket(spark, table):
    before = table.manifest()["live"]
    assert table.upsert(spark.createDataFrame([(7, "b")], "k long, v string")) == 1
    after = table.manifest()["live"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8
    assert contents(table) == [(k, "b" if k == 7 else "a") for k in range(200)]
    assert contents(table, 1) == [(k, "a") for k in range(200)]  # the version before is still there


def test_appends_count_once(spark, table):
    more = spark.createDataFrame([(7, "no"), (300, "x"), (300, "y"), (301, None)], "k long, v string")
    assert table.append(more, "job-1") == 2
    assert table.append(more, "job-1") == 0  # a retry
    assert table.append(more, "job-2") == 0  # nothing new
    got = dict(contents(table)[:-2]) | {300: table.read().where("k = 300").first().v, 301: table.read().where("k = 301").first().v}
    assert table.read().count() == 202 and got[7] == "a" and got[300] == "y" and got[301] is None


def test_crash_leaves_the_version_before(spark, table, monkeypatch):
    rows = spark.createDataFrame([(1, "new")], "k long, v string")
    monkeypatch.setattr(VersionedTable, "_write", lambda self, m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(rows, "c")
    monkeypatch.undo()
    assert dict(contents(table))[1] == "a"
    with open(os.path.join(table.path, "manifest-00000002.json"), "w") as f:
        f.write('{"version": 2, "li')  # a manifest that was not written to its end
    again = VersionedTable(spark, table.path, "k")
    assert dict(contents(again))[1] == "a"
    assert again.upsert(rows, "c") == 1 and dict(contents(again))[1] == "new" and again.manifest()["version"] == 3


def test_two_writers(spark, table, monkeypatch):
    """A second writer commits while the first is at work: both rows are there, and neither key twice."""
    other = VersionedTable(spark, table.path, "k")
    put = VersionedTable._put
    done = []

    def slow(self, rows, folder):
        if self is table and not done:
            done.append(1)
            other.append(spark.createDataFrame([(500, "other"), (501, "other")], "k long, v string"))
        return put(self, rows, folder)

    monkeypatch.setattr(VersionedTable, "_put", slow)
    table.append(spark.createDataFrame([(501, "mine"), (502, "mine")], "k long, v string"))
    got = contents(table)
    assert len(got) == 203 and dict(got)[500] == "other" and dict(got)[501] == "other" and dict(got)[502] == "mine"


def test_vacuum_and_odd_rows(spark, table):
    table.upsert(spark.createDataFrame([(None, "null"), (None, "nulm"), (3, "c")], "k long, v string"))
    table.upsert(spark.createDataFrame([(None, "z")], "k long, v string"))
    assert [r.v for r in table.read().where("k IS NULL").collect()] == ["z"]
    rows = table.read().count()
    table.vacuum()
    assert table.read().count() == rows == 201 and len(table._numbers()) == 1
    live = {d for ds in table.manifest()["live"].values() for d in ds}
    there = {os.path.relpath(os.path.join(d, x), table.path) for d, ds, _ in os.walk(table.path) for x in ds if x.startswith(BUCKET)}
    assert live == there
    empty = spark.createDataFrame([], "k long, v string")
    assert table.append(empty) == 0 and table.read().count() == rows


def test_store(spark, tmp_path):
    s = tables.CaseStore(spark, str(tmp_path / "store"))
    s.add_sessions(spark.createDataFrame([(1, 9)], "session_id long, patient_id long"), spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "session_id long, study_uid string, similarity double"), "one")
    s.add("reports", spark.createDataFrame([(5, 1, "ai_draft", ["w"])], "report_id long, session_id long, status string, validation_warnings array<string>"))
    s.add("explanations", spark.createDataFrame([(5, "why?", "so"), (5, "why?", "so")], "report_id long, question string, answer string"))
    assert [(r.study_uid, r.rank) for r in s.read("retrieved_evidence").orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert s.read("reports").first().validation_warnings == ["w"] and s.read("reports").first().final_content is None
    assert s.read("explanations").count() == 1 and s.read("comparisons").count() == 0 and s.read("retrieval_sessions").first().patient_id == 9
