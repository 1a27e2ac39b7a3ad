"""Frequent lines of pages, packed case files, embeddings in small lots, ranking in small tiles."""

import numpy as np

from casebook.llm import html_diff
from casebook.operators import embedding, evaluation
from casebook.sources import tables


def test_frequent_lines_are_aligned_exactly():
    a, b = ["y"] + ["x"] * 70, ["x"] * 70 + ["y"] + ["x"] * 70
    assert html_diff.shared_lines(a, b) == set(range(71))  # dealt in the order of occurrence: 70
    rng = np.random.default_rng(1)
    a, b = ([str(x) for x in rng.integers(0, 3, 300)] for _ in range(2))
    row = [0] * 301
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    assert len(html_diff.shared_lines(a, b)) == row[-1]


def test_case_json_as_files_and_packed(spark, tmp_path):
    files = {"7": '{"generated": {"findings": "a", "impression": null},\n "ground_truth": {"findings": "b"}}', "x9": '{"generated": {"impression": "c"}}'}
    (tmp_path / "one").mkdir()
    for name, text in files.items():
        (tmp_path / "one" / f"{name}.json").write_text(text)
    spark.createDataFrame([(f"deep/{n}.json", t) for n, t in files.items()], "path string, content string").write.parquet(f"{tmp_path}/packed")
    want = {("7", ("a", None), ("b", None)), ("x9", (None, "c"), None)}
    for df in (tables.read_case_json(spark, f"{tmp_path}/one"), tables.read_case_json(spark, f"{tmp_path}/packed", packed=True)):
        assert {(r.study_uid, r.generated and tuple(r.generated), r.ground_truth and tuple(r.ground_truth)) for r in df.collect()} == want


def test_embed_batch_by_arrow_in_lots(spark):
    seen = spark.createDataFrame([(i, None if i == 3 else f"w{i} w{i} v") for i in range(10)], "uid long, text string")

    def embedder(texts):
        assert len(texts) <= 4
        return np.array([[len(t), 0.0] for t in texts])

    df = embedding.embed_batch(seen, embedder, batch=4)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()  # no lot of 10,000 texts as Python's
    assert {r.uid: r.embedding for r in df.collect()} == {i: [0.0, 0.0] if i == 3 else [1.0, 0.0] for i in range(10)}


def test_ranks_by_small_tiles():
    assert evaluation.CHUNK * 2048 * 8 <= 1 << 24  # similarities of a block of queries to the cases that meet it at a time
