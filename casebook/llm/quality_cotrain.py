"""Quality by co-training: a classifier of the text's content and one of its page's metadata teach each other.

Both are logistic models over hashed features. The content view sees words and how they repeat; the metadata view sees
source, language, stated length, and the page's layout (lines, their lengths, shares of capitals, digits and signs). From
the labelled sample each view is fitted, scores all other documents that are not held out, and hands those it is surest
of, of either class in the sample's proportion, to the other view as further training rows; after some rounds both are
calibrated on labelled rows kept apart for it, and a logistic combination of the calibrated views scores every document.

Only the labelled sample is bounded (a documented parameter); it is chosen by a hash of the id. The exchange runs in
Spark over every unlabelled document: features are written once, packed per chunk of documents, and a round's bounds of
confidence are distributed quantiles of the margins (a hash decides ties). Which rows were handed over follows from the
weights and bounds of the rounds so far, so it is told anew in each pass and never stored; each further step of a view
sums the gradients of all rows handed to it, task by task and then by block of weights. The driver sees the labelled
sample, the bounds and the summed gradients (2 ** BITS a view). However many rows are handed over, together they weigh
no more than they would if the unlabelled documents were as few as the labelled ones. Both models are about a megabyte.

Null text counts as empty, other nulls as a value of their own; missing metadata columns count as null. Null ids and
repeated rows are scored like others, but labels without id or label are left out; of repeated labels the lowest counts.
Without labels of both classes every score is the smoothed share of good labels. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import merged, mix64, plain_words, text_chunks, word_hashes
from casebook.llm.toxicity_crf import bare, held_out
from casebook.session import written

BITS = 18
VIEWS = ("content", "metadata")


@dataclass
class CoTrained:
    weights: dict[str, np.ndarray]  # per view: 2 ** BITS hashed weights, the bias in place 0
    combination: np.ndarray  # of (1, margin of the content view, margin of the metadata view), calibrated
    base_rate: float
    fitted: bool


Ragged = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature ids, values, offsets of rows


def _hash_names(names: pa.Array) -> np.ndarray:
    coded = names.dictionary_encode()
    return (mix64(word_hashes(coded.dictionary)) % np.uint64(2**BITS - 1)).astype(np.int64)[coded.indices.to_numpy()] + 1


def _bucketed(name: str, x: np.ndarray) -> pa.Array:
    return pa.array([f"{name}:{v}" for v in np.round(x, 1)], pa.large_string())


def content_view(texts: pa.Array) -> Ragged:
    """Distinct words by the root of their count, and how far the text repeats itself."""
    words, codes, offsets = plain_words(texts)
    stem = bare(words)
    ids = _hash_names(stem) if len(words) else np.zeros(0, np.int64)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    key, count = np.unique(doc * max(1, len(words)) + codes, return_counts=True)
    row, word = key // max(1, len(words)), key % max(1, len(words))
    distinct = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    value = np.sqrt(count) / np.sqrt(np.maximum(sizes, 1))[row]
    full = np.maximum(sizes, 1)
    extra = [_bucketed("distinct", distinct / full), _bucketed("top", top / full), _bucketed("length", np.log2(full) // 1)]
    back = np.concatenate([[False], codes[1:] == codes[:-1]]) if len(codes) else np.zeros(0, bool)
    back[offsets[:-1][(sizes > 0)]] = False
    extra.append(_bucketed("again", np.bincount(doc[back], minlength=n) / full))
    rows = np.concatenate([row, *[np.arange(n)] * (len(extra) + 1)])
    feature = np.concatenate([ids[word], *[_hash_names(e) for e in extra], np.zeros(n, np.int64)])
    values = np.concatenate([value, *[np.ones(n) * 0.5] * len(extra), np.ones(n)])
    order = np.argsort(rows, kind="stable")
    return feature[order], values[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def metadata_view(texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> Ragged:
    """Source, language, stated length, and the layout of the page."""
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1).astype(float)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1.0
    share = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / chars
    stated = pc.fill_null(n_chars, -1).to_numpy(zero_copy_only=False).astype(float)
    named = lambda name, column: pa.array([f"{name}:{v}" for v in column.to_pylist()], pa.large_string())
    columns = [
        named("lang", lang), named("source", source), _bucketed("stated", np.log2(np.maximum(stated, 0.5)) // 1), _bucketed("lines", np.log2(lines) // 1),
        _bucketed("line", np.log2(chars / lines) // 1), _bucketed("capitals", share(r"\p{Lu}")), _bucketed("digits", share(r"\p{Nd}")), _bucketed("signs", share(r"[^\pL\p{Nd}\s.,;:'!?-]")), _bucketed("marks", share(r"[!?]")), _bucketed("white", share(r"\s")),
    ]
    n = len(texts)
    feature = np.stack([*[_hash_names(c) if n else np.zeros(0, np.int64) for c in columns], np.zeros(n, np.int64)], axis=1).reshape(-1)
    return feature, np.ones(len(feature)), np.arange(n + 1) * (len(columns) + 1)


def views(batch: pa.RecordBatch) -> dict[str, Ragged]:
    texts = batch.column("text").cast(pa.large_string())
    return {"content": content_view(texts), "metadata": metadata_view(texts, batch.column("lang"), batch.column("source"), batch.column("n_chars"))}


def margins(view: Ragged, w: np.ndarray) -> np.ndarray:
    feature, value, offsets = view
    return np.diff(np.concatenate([[0], np.cumsum(w[feature] * value)])[offsets])


class Learner:
    """One view's weights, fitted by Adam to labelled rows and to gradients of further rows that Spark has summed."""

    def __init__(self, view: Ragged, y: np.ndarray):
        self.view, self.y = view, y
        self.row = np.repeat(np.arange(len(y)), np.diff(view[2]))
        self.w, self.m, self.v, self.k = np.zeros(2**BITS), np.zeros(2**BITS), np.zeros(2**BITS), 0

    def step(self, extra: np.ndarray | float = 0.0, extra_weight: float = 0.0, rate: float = 0.3, l2: float = 1e-5) -> None:
        feature, value, _ = self.view
        z = np.bincount(self.row, self.w[feature] * value, minlength=len(self.y))
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y
        g = (np.bincount(feature, miss[self.row] * value, minlength=2**BITS) + extra) / (len(self.y) + extra_weight) + l2 * self.w
        self.k += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        self.w -= rate * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.v / (1 - 0.99**self.k)) + 1e-9)


def _rows(view: Ragged, take: np.ndarray) -> Ragged:
    feature, value, offsets = view
    sizes = np.diff(offsets)[take]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1][take] - ends[:-1], sizes)
    return feature[at], value[at], ends


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.clip(np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w), -5, 5)
    return w


OTHER = dict(zip(VIEWS, VIEWS[::-1]))
FEATURES = "sizes binary, codes binary, names binary, values binary, metadata binary, jitter binary"
BLOCK = 2**12  # weights whose gradients are summed in one group


def _planes(a: np.ndarray) -> bytes:
    """Byte planes, packed: high bytes are mostly zero or alike."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 3)


def _from_planes(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(-1)


def pack_views(found: dict[str, Ragged], jitter: np.ndarray) -> dict[str, bytes]:
    """The features of a chunk of documents: content features as codes by falling frequency into the chunk's own list."""
    feature, value, offsets = found["content"]
    names, codes, count = np.unique(feature, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    arrays = {"sizes": np.diff(offsets).astype("<u4"), "codes": place[codes].astype("<u4"), "names": names[order].astype("<u4"), "values": value.astype("<f2"), "metadata": found["metadata"][0].astype("<u4"), "jitter": jitter.astype("<u4")}
    return {k: _planes(a) for k, a in arrays.items()}


def unpack_views(row: dict[str, bytes]) -> tuple[dict[str, Ragged], np.ndarray]:
    sizes, jitter = _from_planes(row["sizes"], "<u4").astype(np.int64), _from_planes(row["jitter"], "<u4")
    names, metadata = _from_planes(row["names"], "<u4").astype(np.int64), _from_planes(row["metadata"], "<u4").astype(np.int64)
    content = names[_from_planes(row["codes"], "<u4")], _from_planes(row["values"], "<f2").astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
    width = len(metadata) // max(1, len(sizes))
    return {"content": content, "metadata": (metadata, np.ones(len(metadata)), np.arange(len(sizes) + 1) * width)}, jitter * 1e-6 / 2**30


def _pool_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(merged(batches, "text", 2 << 20), limit=4 << 20):
        packed = pack_views(views(chunk), chunk.column("jitter").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in packed.items()})


def handed_over(data: dict[str, Ragged], jitter: np.ndarray, history: list[dict]) -> dict[str, np.ndarray]:
    """Per learner the label that each row was given by the other view (-1: none so far).

    A round of ``history`` is per teaching view its weights, and the bounds of low and high margins it was sure of."""
    given = {v: np.full(len(jitter), -1) for v in VIEWS}
    for known in history:
        for v in VIEWS:
            w, low, high = known[v]
            z, to = margins(data[v], w) + jitter, OTHER[v]
            for label, sure in ((0, (z <= low) & (z < -1)), (1, (z >= high) & (z > 1))):
                given[to][sure & (given[to] < 0)] = label
    return given


def _margins_left(shared):
    """Margins of each teaching view, null where the other view was taught the row already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *history, now = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                data, jitter = unpack_views(row)
                given = handed_over(data, jitter, history)
                yield pa.RecordBatch.from_pydict({v: pa.array(margins(data[v], now[v][0]) + jitter, mask=given[OTHER[v]] >= 0) for v in VIEWS})

    return run


def gradient(view: Ragged, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over rows of (probability - label) * value per feature."""
    feature, value, offsets = view
    miss = 1 / (1 + np.exp(-np.clip(margins(view, w), -30, 30))) - y
    return np.bincount(feature, np.repeat(miss, np.diff(offsets)) * value, minlength=2**BITS)


def _gradients(shared):
    """A task's sum of gradients over the rows handed over, and their number in place of block -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, weights = shared.value
        total, number = {v: np.zeros(2**BITS) for v in VIEWS}, {v: 0 for v in VIEWS}
        for batch in batches:
            for row in batch.to_pylist():
                data, jitter = unpack_views(row)
                for v, y in handed_over(data, jitter, history).items():
                    own = np.flatnonzero(y >= 0)
                    if len(own):
                        total[v] += gradient(_rows(data[v], own), y[own], weights[v])
                        number[v] += len(own)
        task = TaskContext.get().partitionId()
        for v in VIEWS:
            if number[v]:
                parts = [(-1, np.array([float(number[v])]).tobytes())] + [(b // BLOCK, total[v][b : b + BLOCK].tobytes()) for b in range(0, 2**BITS, BLOCK) if total[v][b : b + BLOCK].any()]
                yield pa.RecordBatch.from_pydict({"learner": pa.array([v] * len(parts), pa.string()), "block": pa.array([p[0] for p in parts], pa.int32()), "task": pa.array([task] * len(parts), pa.int32()), "g": pa.array([p[1] for p in parts], pa.binary())})

    return run


def _add_up(table: pa.Table) -> pa.Table:
    table = table.sort_by("task")  # the same order of summands in every run
    g = sum(np.frombuffer(b, float) for c in table.column("g").chunks for b in c.to_pylist())
    return pa.table({"learner": table.column("learner")[:1], "block": table.column("block")[:1], "g": pa.array([g.tobytes()], pa.binary())})


def summed_gradients(pool: DataFrame, history: list[dict], weights: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Per view the gradient of the logistic loss over all rows of ``pool`` handed to it, and how many these are."""
    shared = pool.sparkSession.sparkContext.broadcast((history, {v: w.astype(np.float32) for v, w in weights.items()}))
    parts = pool.mapInArrow(_gradients(shared), "learner string, block int, task int, g binary").groupBy("learner", "block").applyInArrow(_add_up, "learner string, block int, g binary")
    out, number = {v: np.zeros(2**BITS) for v in VIEWS}, {v: 0 for v in VIEWS}
    for r in parts.collect():  # at most 2 * (2 ** BITS / BLOCK + 1) rows
        if r.block < 0:
            number[r.learner] = int(np.frombuffer(r.g, float)[0])
        else:
            out[r.learner][r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.g, float)
    shared.unpersist()
    return out, number


def co_train(pool: DataFrame, data: dict[str, Ragged], y: np.ndarray, rounds: int = 4, steps: int = 3, share: float = 0.1) -> tuple[dict[str, np.ndarray], np.ndarray, list[dict[str, int]]]:
    """Weights per view, the combination, and how many rows of ``pool`` each view was taught by the end of each round.

    ``data`` and ``y`` are the labelled sample; ``pool`` has the written features of all unlabelled documents."""
    known = np.arange(len(y))
    apart = known[::4]  # for calibration
    start = np.setdiff1d(known, apart)
    if len(np.unique(y[start])) < 2:
        start = known
    good, context = y[start].mean(), pool.sparkSession.sparkContext
    learners = {v: Learner(_rows(data[v], start), y[start].astype(float)) for v in VIEWS}
    for learner in learners.values():
        for _ in range(50):
            learner.step()
    history: list[dict] = []
    numbers: list[dict[str, int]] = []
    size = pool.mapInArrow(_count_rows, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    trust = 0.5 * min(1.0, len(start) / max(1, size))
    n_taught = {v: 0 for v in VIEWS}
    for _ in range(rounds if size else 0):
        now = {v: (learners[v].w.astype(np.float32), -np.inf, np.inf) for v in VIEWS}
        left = {v: max(1, size - n_taught[OTHER[v]]) for v in VIEWS}
        n = max(1, int(share * size))
        n_low, n_high = max(1, round(n * (1 - good))), max(1, round(n * good))
        at = {v: [min(1.0, n_low / left[v]), max(0.0, (left[v] - n_high + 1) / left[v])] for v in VIEWS}
        shared = context.broadcast([*history, now])
        bounds = pool.mapInArrow(_margins_left(shared), "content double, metadata double").agg(*[F.percentile_approx(v, at[v], 10_000).alias(v) for v in VIEWS]).first()
        shared.unpersist()
        history.append({v: (now[v][0], *(bounds[v] or (-np.inf, np.inf))) for v in VIEWS})
        for _ in range(steps):
            g, n_taught = summed_gradients(pool, history, {v: learners[v].w for v in VIEWS})
            for v in VIEWS:
                learners[v].step(trust * g[v], trust * n_taught[v])
        numbers.append(n_taught)
    weights = {v: learners[v].w for v in VIEWS}
    x = np.stack([np.ones(len(apart)), *[np.clip(margins(_rows(data[v], apart), weights[v]), -20, 20) for v in VIEWS]], axis=1)
    # each view is calibrated by itself; the combination then weighs the calibrated margins
    single = [_logistic(x[:, [0, i]], y[apart].astype(float)) for i in (1, 2)]
    calibrated = np.stack([np.ones(len(apart)), *[x[:, [0, i]] @ s for i, s in zip((1, 2), single)]], axis=1)
    c = _logistic(calibrated, y[apart].astype(float))
    return weights, np.array([c[0] + c[1] * single[0][0] + c[2] * single[1][0], c[1] * single[0][1], c[2] * single[1][1]]), numbers


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(_from_planes(b.as_py(), "<u4")) for b in batch.column("jitter")], pa.int64())})


def _inputs(docs: DataFrame) -> DataFrame:
    column = lambda name, kind: (docs[name].cast(kind) if name in docs.columns else F.lit(None).cast(kind)).alias(name)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))


def unlabelled(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Written features of every row that is neither held out nor in the labelled sample, rows without id included."""
    jitter = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**30))
    pool = rows.where(~held_out()).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").withColumn("jitter", jitter)
    return written(pool.mapInArrow(_pool_features, FEATURES), "quality-pool")


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = 6_000, rounds: int = 4) -> CoTrained:
    """Fit on at most ``labelled_rows`` labelled documents and on all others, of those that are not held out."""
    rows = _inputs(docs)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    chosen = written(given.where(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows), "quality-labels")
    sample = rows.join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=2 << 20):
            found = views(chunk)
            cut = lambda v, k: [found[v][k][a:b].astype("<f4" if k else "<i4").tobytes() for a, b in zip(found[v][2], found[v][2][1:])]  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"y": chunk.column("y"), **{f"{v}{k}": pa.array(cut(v, k), pa.binary()) for v in VIEWS for k in (0, 1)}})

    got = sample.mapInArrow(features, "y int, content0 binary, content1 binary, metadata0 binary, metadata1 binary")
    got = got.orderBy("y", F.xxhash64("content0", "metadata0")).toPandas()  # the labelled sample
    y = got["y"].to_numpy() if len(got) else np.zeros(0, int)
    base = ((y == 1).sum() + 0.5) / ((y >= 0).sum() + 1)
    if not (y == 1).any() or not (y == 0).any():
        return CoTrained({}, np.array([np.log(base / (1 - base)), 0, 0]), base, False)
    data = {v: (np.concatenate([np.frombuffer(b, "<i4") for b in got[f"{v}0"]]), np.concatenate([np.frombuffer(b, "<f4") for b in got[f"{v}1"]]), np.concatenate([[0], np.cumsum([len(b) // 4 for b in got[f"{v}0"]])])) for v in VIEWS}
    weights, combination, _ = co_train(unlabelled(rows, chosen), data, y, rounds)
    return CoTrained({v: w.astype(np.float32) for v, w in weights.items()}, combination, base, True)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``(doc_id, score, content_margin, metadata_margin, predicted, kept)`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in text_chunks(batches):
            z = [margins(view, m.weights[v].astype(float)) for v, view in views(chunk).items()] if m.fitted else [np.zeros(chunk.num_rows)] * 2
            p = 1 / (1 + np.exp(-np.clip(m.combination[0] + m.combination[1] * np.clip(z[0], -20, 20) + m.combination[2] * np.clip(z[1], -20, 20), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id"), "score": p, "content_margin": z[0], "metadata_margin": z[1], "predicted": pa.array((p >= 0.5).astype(np.int32)), "kept": pa.array(p >= 0.5)})

    return _inputs(docs).mapInArrow(run, "doc_id long, score double, content_margin double, metadata_margin double, predicted int, kept boolean")
