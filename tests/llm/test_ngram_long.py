"""The n-gram join on long texts, whose Arrow batches are worked in slices."""

import numpy as np
import pyarrow as pa
import pytest

from casebook.llm import ngram_join
from casebook.llm.common import plain_words, text_chunks
from tests.llm.test_llm import brute_components


def long_table(letters):
    """1,600 texts of 5 KB, one of 2.9 MB, 40 copies of a text, and the long one again."""
    g = np.random.default_rng(3)
    words = np.array([f"{letters}{k}" for k in range(60_000)])
    short = [" ".join(words[g.integers(0, len(words), 700)]) for _ in range(1_600)]
    long = " ".join(words[g.integers(0, len(words), 420_000)])
    return [*short, long, *[short[0].replace(letters, letters.upper(), 30)] * 40, long]


def unsliced(texts, n):
    return [s for t in texts for s in ngram_join.shingle_sets(pa.array([t]), n)]


@pytest.mark.parametrize("letters", ["word", "wört"])
def test_slices(letters):
    """Every function of texts gives for slices of a batch what it gives for each text alone."""
    texts = long_table(letters)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    got = [s for c in text_chunks(iter([batch])) for s in ngram_join.shingle_sets(c.column("text"), 4)]
    want = unsliced(texts, 4)
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want))
    small = pa.array([None, "A b", "", "ÄB c  D", "x" * 9 + " Y", " Z\tz "] * 3)
    for a in range(len(small)):
        for b in range(a, len(small) + 1):
            words, codes, offsets = plain_words(small.slice(a, b - a).fill_null(""), lower=True)
            shown = [[words[int(c)].as_py() for c in codes[i:j]] for i, j in zip(offsets, offsets[1:])]
            assert shown == [(t or "").replace("A", "a").replace("B", "b").replace("D", "d").replace("Y", "y").replace("Z", "z").split() for t in small.slice(a, b - a).to_pylist()]


@pytest.mark.parametrize("limit", ["8m", "64m"])
def test_long_texts(spark, limit):
    texts = long_table("word")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, 4, 85).collect()}
    sizes = [len(s) for s in unsliced(texts, 4)]
    copies = {0, *range(1_601, 1_641)}
    for i in range(len(texts)):
        want = (0, 40) if i in copies else (1_600, 1) if i in (1_600, 1_641) else (i, 0)
        assert got[i] == (sizes[i], *want)
    tiny = [*texts[:3], texts[1_700 % 1_642], *texts[1_601:1_604], "A b"]
    small = spark.createDataFrame(list(enumerate(tiny)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(small, 4, 85).collect()} == dict(enumerate(brute_components(tiny, 4, 85)))
