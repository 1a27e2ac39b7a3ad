"""Toxic spans by a linear-chain conditional random field, toxicity of documents from its marginals.

Labels are given per document, so tokens are labelled first: over a bounded sample of labelled documents, a word or a
word beginning whose documents are toxic far more often than chance allows (likelihood ratio) marks its tokens as
toxic. On all whole documents of the sample, each a chain, a two-state linear-chain CRF is fitted: hashed features of the
word, its beginnings and ending, its neighbours and its shape; transition weights; gradients from forward-backward
marginals. The sample is dealt into ``SHARDS`` shards by a hash; every shard makes some steps from the common weights on
its own chains, and the shards' weights are averaged, each feature by its uses there, for the next round.

Every document is tagged as one chain: windows of ``WINDOW`` tokens are worked side by side, but the forward and backward
messages that enter a window are carried over all windows of its document, so marginals are those of the whole chain.
The marginals of a document's tokens give the highest, the expected number and the expected share of toxic tokens, and a
logistic function of these, fitted on the same sample, is the score. Tokens with a marginal of at least one half are the
offending spans.

A task scores 1.3 million tokens or so at once: features per distinct word, marginals for all windows side by side.
Model and calibration are some MB whatever the input; only the scan of the documents grows.

Null text counts as empty; texts without words get the score of a document without toxic tokens. Null doc_ids and
repeated rows are scored like others. Labels with a null id or label are left out, repeated ones count as toxic if any
says so. Without toxic or without clean labels every score is the smoothed share of toxic labels. An empty table gives
an empty result. ``lang``, ``source``, ``doc_id`` and labels are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import doc_text, mix64, plain_words, text_chunks, word_hashes
from casebook.session import written

WINDOW = 64
SHARDS = 16
BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)


@dataclass
class Crf:
    """Emission weights of the toxic state (hashed features), transitions, calibration and the share of toxic labels."""

    weights: np.ndarray  # float32, 2 ** BITS
    transitions: np.ndarray  # 2 x 2, log scale
    start: np.ndarray  # 2
    calibration: np.ndarray  # of (1, logit of the highest, log of the expected number, log of the expected share)
    base_rate: float
    fitted: bool


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 on division by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bare(words: pa.Array) -> pa.Array:
    """Lower case, without what is neither letter nor digit at both ends."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\pL\pN]+|[^\pL\pN]+$", ""))


def _feature_ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct word: ids of its own features (-1: none), its feature as left neighbour, as right neighbour."""
    stem = bare(words)
    long = pc.utf8_length(stem).to_numpy(zero_copy_only=False)

    def ids(column: pa.Array, kind: int, ok: np.ndarray | None = None) -> np.ndarray:
        coded = column.dictionary_encode()
        with np.errstate(over="ignore"):
            hashed = (mix64(word_hashes(coded.dictionary) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(2**BITS)).astype(np.int64)
        out = hashed[coded.indices.to_numpy()] if len(column) else np.zeros(0, np.int64)
        return out if ok is None else np.where(ok, out, -1)

    own = [ids(stem, 0)]
    own += [ids(pc.utf8_slice_codeunits(stem, 0, k), k, long > k) for k in PREFIXES]
    own.append(ids(pc.utf8_slice_codeunits(stem, -3, 2**30), 20, long > 3))
    own.append(ids(pc.if_else(pc.utf8_is_upper(words), "upper", pc.if_else(pc.utf8_is_title(words), "title", "plain")), 21))
    return np.stack(own, axis=1), ids(stem, 22), ids(stem, 23)


def _neighbours(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the word before and after within the document; -1 at its ends."""
    before = np.concatenate([[-1], codes[:-1]]) if len(codes) else codes
    after = np.concatenate([codes[1:], [-1]]) if len(codes) else codes
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = -1
    after[offsets[1:][np.diff(offsets) > 0] - 1] = -1
    return before, after


def marginals(emission: np.ndarray, valid: np.ndarray, transitions: np.ndarray, start: np.ndarray, enters: np.ndarray | None = None, leaves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all rows (windows) side by side. ``emission``: log weight of the toxic state by window and
    position; the clean state has 0. ``enters``: the forward message from the window before, a row of nan where a chain
    begins; ``leaves``: the backward message from the window behind. Without them every window is a chain. Returns
    P(toxic), P(states of neighbours) summed over windows and positions (2 x 2), and P(first state) summed over chains."""
    n, t = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    move = np.exp(transitions)
    enters = np.full((n, 2), np.nan) if enters is None else enters
    begins = np.isnan(enters[:, 0])
    alpha, beta = np.empty((t, n, 2)), np.empty((t, n, 2))
    for k in range(t):
        a = np.where(begins[:, None], np.exp(start)[None, :], enters @ move) if k == 0 else alpha[k - 1] @ move
        a[:, 1] *= e[:, k]
        alpha[k] = a / a.sum(1, keepdims=True)
    beta[t - 1] = 1 if leaves is None else leaves
    for k in range(t - 2, -1, -1):
        b = beta[k + 1].copy()
        b[:, 1] *= e[:, k + 1]
        b = b @ move.T
        beta[k] = np.where(valid[:, k + 1, None], b / b.sum(1, keepdims=True), 1)
    both = alpha * beta
    p = both[:, :, 1] / both.sum(2)
    pairs = np.zeros((2, 2))
    for k in range(t):
        left = enters if k == 0 else alpha[k - 1]
        here = ~begins if k == 0 else valid[:, k]
        right = beta[k].copy()
        right[:, 1] *= e[:, k]
        joint = left[:, :, None] * move[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True))[here].sum(0)
    first = p[0][valid[:, 0] & begins]
    return p.T, pairs, np.array([(1 - first).sum(), first.sum()])


def messages(emission: np.ndarray, valid: np.ndarray, n_windows: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward message that enters every window and the backward message that it gets from behind, carried over all
    windows of a document through the product of each window's transfer matrices. ``n_windows``: windows by document."""
    n, t = emission.shape
    enters, leaves = np.full((n, 2), np.nan), np.ones((n, 2))
    first = np.concatenate([[0], np.cumsum(n_windows)])[:-1]
    if n_windows.max(initial=0) < 2:
        return enters, leaves
    rows = np.flatnonzero(np.repeat(n_windows > 1, n_windows))
    e, ok, move = np.exp(np.clip(emission[rows], -30, 30)), valid[rows], np.exp(transitions)
    begins = np.isin(rows, first)
    product = np.broadcast_to(np.eye(2), (len(rows), 2, 2)).copy()
    for k in range(t):
        moved = product @ move
        if k == 0:
            moved[begins] = product[begins]
        moved[:, :, 1] *= e[:, None, k]
        product = np.where(ok[:, k, None, None], moved / moved.sum((1, 2), keepdims=True), product)
    transfer = np.empty((n, 2, 2))
    transfer[rows] = product
    for w in range(1, int(n_windows.max())):
        at = first[n_windows > w] + w
        before = enters[at - 1] if w > 1 else np.broadcast_to(np.exp(start), (len(at), 2))
        a = np.einsum("ni,nij->nj", before, transfer[at - 1])
        enters[at] = a / a.sum(1, keepdims=True)
    last = first + n_windows - 1
    for w in range(1, int(n_windows.max())):
        at = last[n_windows > w] - w
        b = np.einsum("nij,nj->ni", transfer[at + 1], leaves[at + 1])
        leaves[at] = b / b.sum(1, keepdims=True)
    return enters, leaves


def _windows(values: np.ndarray, offsets: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WINDOW tokens, cut per document: values, which places hold tokens, and the place of every token."""
    sizes = np.diff(offsets)
    rows = -(-sizes // WINDOW)
    first_row = np.concatenate([[0], np.cumsum(rows)])[:-1]
    within = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
    place = np.repeat(first_row, sizes) * WINDOW + within
    n = int(rows.sum())
    out, valid = np.full(n * WINDOW, fill, dtype=values.dtype), np.zeros(n * WINDOW, dtype=bool)
    out[place], valid[place] = values, True
    return out.reshape(n, WINDOW), valid.reshape(n, WINDOW), place


def chain_marginals(emission: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, start: np.ndarray, step: int = 8_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``marginals`` of whole chains: tokens of all documents in a row, cut by ``offsets``."""
    if not len(emission):
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
    rows, valid, place = _windows(emission, offsets, 0.0)
    enters, leaves = messages(rows, valid, -(-np.diff(offsets) // WINDOW), transitions, start)
    p, pairs, first = np.empty(rows.shape), np.zeros((2, 2)), np.zeros(2)
    for a in range(0, len(rows), step):
        b = a + step
        p[a:b], more, begun = marginals(rows[a:b], valid[a:b], transitions, start, enters[a:b], leaves[a:b])
        pairs, first = pairs + more, first + begun
    return p.reshape(-1)[place], pairs, first


def token_marginals(crf: Crf, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token of every text and the offsets of the texts."""
    words, codes, offsets = plain_words(texts)
    own, left, right = _feature_ids(words)
    w = np.append(crf.weights, 0).astype(np.float64)
    score = w[own].sum(1)
    before, after = _neighbours(codes, offsets)
    emission = score[codes] + np.append(w[left], 0)[before] + np.append(w[right], 0)[after] if len(codes) else np.zeros(0)
    return chain_marginals(emission, offsets, crf.transitions, crf.start)[0], offsets


def _aggregates(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(1, logit of the highest marginal, log(1 + expected number), log(1 + 1000 * expected share)) per text."""
    sizes = np.diff(offsets)
    sums = np.add.reduceat(np.append(p, 0), offsets[:-1])[: len(sizes)] * (sizes > 0) if len(sizes) else np.zeros(0)
    tops = np.maximum.reduceat(np.append(p, 0), np.minimum(offsets[:-1], len(p)))[: len(sizes)] * (sizes > 0) if len(sizes) else np.zeros(0)
    tops = np.clip(tops, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(sizes)), np.log(tops / (1 - tops)), np.log1p(sums), np.log1p(1000 * sums / np.maximum(sizes, 1))], axis=1)


# ---------------------------------------------------------------- fitting


def _document_features(texts: pa.Array) -> list[set[str]]:
    words, codes, offsets = plain_words(texts)
    stems = bare(words).to_pylist()
    own = [{"=" + s, *(s[:k] + "*" for k in PREFIXES if len(s) > k)} if s else set() for s in stems]
    return [set().union(*(own[c] for c in np.unique(codes[a:b]))) for a, b in zip(offsets, offsets[1:])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in text_chunks(batches, limit=2 << 20):
        seen = Counter(), Counter()
        for features, y in zip(_document_features(chunk.column("text")), chunk.column("y").to_pylist()):
            seen[y].update(features)
            seen[y][""] += 1  # documents
        names = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([seen[1][x] for x in names], pa.int64()), "clean": pa.array([seen[0][x] for x in names], pa.int64())})


def telling(a: Column, b: Column, n1: int, n0: int, least_ratio: float = 20, least_llr: float = 20) -> Column:
    """Which features say toxic: seen in ``a`` of ``n1`` toxic and ``b`` of ``n0`` clean documents."""
    rate, share = n1 / (n1 + n0), a / (a + b)
    part = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
    llr = 2 * (part(a, share, F.lit(rate)) + part(b, 1 - share, F.lit(1 - rate)))
    return (a > 0) & (share > rate) & (llr >= least_llr) & ((a + 0.5) / n1 >= least_ratio * (b + 0.5) / n0)


@dataclass
class Chains:
    """Documents as chains: distinct words' features, words in order, and which tokens are labelled toxic."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    label: np.ndarray

    def gradient(self, w: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the negative log likelihood: by feature (2 ** BITS), transition and start."""
        codes = self.codes.astype(np.int64)
        before, after = _neighbours(codes, self.offsets)
        emission = np.append(w, 0)[self.own].sum(1)[codes] + np.append(w[self.left], 0)[before] + np.append(w[self.right], 0)[after]
        p, pairs, first = chain_marginals(emission, self.offsets, transitions, start)
        miss, n = p - self.label, len(self.left)
        g = np.bincount(self.own.reshape(-1) + 1, np.repeat(np.bincount(codes, miss, n), self.own.shape[1]), len(w) + 1)[1:]
        for ids, at in ((self.left, before), (self.right, after)):
            g += np.bincount(ids, np.bincount(at + 1, miss, n + 1)[1:], len(w))
        inner = before >= 0  # tokens with one before them in their document
        was, is_ = self.label[np.flatnonzero(inner) - 1].astype(int), self.label[inner].astype(int)
        begun = self.label[~inner]
        return g, pairs - np.bincount(2 * was + is_, minlength=4).reshape(2, 2), first - np.array([(~begun).sum(), begun.sum()])

    def uses(self) -> np.ndarray:
        """How often each feature occurs."""
        codes, n = self.codes.astype(np.int64), len(self.left)
        before, after = _neighbours(codes, self.offsets)
        found = np.bincount(self.own.reshape(-1) + 1, np.repeat(np.bincount(codes, minlength=n), self.own.shape[1]), 2**BITS + 1)[1:]
        for ids, at in ((self.left, before), (self.right, after)):
            found += np.bincount(ids, np.bincount(at + 1, minlength=n + 1)[1:], 2**BITS)
        return found


def chains(texts: pa.Array, y: np.ndarray, marked: frozenset[str]) -> Chains:
    words, codes, offsets = plain_words(texts)
    own, left, right = _feature_ids(words)
    hot = np.array([bool(s) and ("=" + s in marked or any(s[:k] + "*" in marked for k in PREFIXES if len(s) > k)) for s in bare(words).to_pylist()], dtype=bool)
    label = hot[codes] & np.repeat(y == 1, np.diff(offsets)) if len(codes) else np.zeros(0, bool)
    return Chains(own.astype(np.int32), left.astype(np.int32), right.astype(np.int32), codes.astype(np.int32), offsets, label)


def descend(parts: list[Chains], x: np.ndarray, steps: int, rate: float = 0.3, l2: float = 1e-5) -> np.ndarray:
    """``steps`` steps of Adam from ``x`` (features, 4 transitions, 2 starts) on the likelihood of all chains."""
    x, m, v = x.copy(), np.zeros_like(x), np.zeros_like(x)
    n = max(1, sum(len(c.codes) for c in parts) / WINDOW)
    for step in range(1, steps + 1):
        g = np.zeros_like(x)
        for c in parts:
            features, transitions, start = c.gradient(x[:-6], x[-6:-2].reshape(2, 2), x[-2:])
            g += np.concatenate([features, transitions.reshape(-1), start])
        g = g / n + l2 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x


BLOCK = 2**15  # features whose averages are taken in one group
PARTS = "block int, shard int, place binary, value binary, uses binary"


def _shard(shared, steps: int):
    """A shard's steps from the common weights: new values of what it has seen, with the number of uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, marked = shared.value
        for_shard: dict[int, list[Chains]] = {}
        for chunk in text_chunks(batches, limit=4 << 20):
            shards = chunk.column("shard").to_numpy()
            for k in np.unique(shards).tolist():
                part = chunk.filter(pa.array(shards == k))
                for_shard.setdefault(k, []).append(chains(part.column("text"), part.column("y").to_numpy(zero_copy_only=False), marked))
        for k, parts in for_shard.items():
            tokens = sum(len(c.codes) for c in parts)
            if not tokens:
                continue
            after = descend(parts, x, steps)
            uses = np.concatenate([sum(c.uses() for c in parts), np.full(6, tokens)])
            for b in range(0, len(x), BLOCK):
                seen = np.flatnonzero(uses[b : b + BLOCK])
                if len(seen):
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([b // BLOCK], pa.int32()), "shard": pa.array([k], pa.int32()), "place": pa.array([seen.astype("<u2").tobytes()], pa.binary()),
                        "value": pa.array([after[b : b + BLOCK][seen].astype("<f4").tobytes()], pa.binary()), "uses": pa.array([uses[b : b + BLOCK][seen].astype("<f4").tobytes()], pa.binary()),
                    })

    return run


def _average(table: pa.Table) -> pa.Table:
    """Each feature's mean over the shards that have it, weighted by uses; in the order of shards."""
    total, weight = np.zeros(BLOCK), np.zeros(BLOCK)
    for r in table.sort_by("shard").to_pylist():
        at, uses = np.frombuffer(r["place"], "<u2"), np.frombuffer(r["uses"], "<f4").astype(float)
        total[at] += uses * np.frombuffer(r["value"], "<f4")
        weight[at] += uses
    seen = np.flatnonzero(weight)
    return pa.table({"block": table.column("block")[:1], "place": pa.array([seen.astype("<u2").tobytes()], pa.binary()), "value": pa.array([(total[seen] / weight[seen]).astype("<f4").tobytes()], pa.binary())})


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + l2 * w), -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, rounds: int = 2, steps: int = 8) -> Crf:
    """Fit on labelled documents that are not held out: at most ``sample_rows`` labels, chosen by a hash of the id, with
    all tokens of their documents. The chosen labels are few enough to be broadcast; their documents are written once."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    chosen = given.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = written(doc_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "y", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int").alias("shard")), "toxic-sample")
    counted = sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    counted = written(counted, "toxic-features")
    total = next(((r.a, r.b) for r in counted.where("feature = ''").collect()), (0, 0))
    base = (total[0] + 0.5) / (total[0] + total[1] + 1)
    none = Crf(np.zeros(2**BITS, np.float32), np.zeros((2, 2)), np.zeros(2), np.array([math.log(base / (1 - base)), 0, 0, 0]), base, False)
    if not all(total):
        return none
    says = counted.where((F.col("feature") != "") & telling(F.col("a"), F.col("b"), *total))
    marked = frozenset(r.feature for r in says.select("feature").collect())  # of a bounded sample
    if not marked:
        return none
    context = docs.sparkSession.sparkContext
    x = np.concatenate([np.zeros(2**BITS + 5), [-2.0]])
    for _ in range(rounds):
        shared = context.broadcast((x, marked))
        dealt = sample.repartitionById(SHARDS, "shard").sortWithinPartitions(F.xxhash64("text"), "text")
        for r in dealt.mapInArrow(_shard(shared, steps), PARTS).groupBy("block").applyInArrow(_average, "block int, place binary, value binary").collect():  # one row per block
            x[r.block * BLOCK + np.frombuffer(r.place, "<u2").astype(np.int64)] = np.frombuffer(r.value, "<f4")
        shared.unpersist()
    crf = Crf(x[:-6].astype(np.float32), x[-6:-2].reshape(2, 2).copy(), x[-2:].copy(), np.zeros(4), base, True)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            x = _aggregates(*token_marginals(shared.value, chunk.column("text")))
            yield pa.RecordBatch.from_pydict({"top": x[:, 1], "sum": x[:, 2], "share": x[:, 3], "y": chunk.column("y")})

    seen = sample.mapInArrow(measure, "top double, sum double, share double, y int").toPandas()
    x = np.stack([np.ones(len(seen)), seen["top"], seen["sum"], seen["share"]], axis=1)
    crf.calibration = _logistic(x, seen["y"].to_numpy(float))
    return crf


def score(docs: DataFrame, crf: Crf, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, <keep>, score, predicted, spans)`` for every row of ``docs``; ``spans`` are the offending pieces as
    (start, end, marginal) in code points of the text, neighbouring ones joined."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, word = shared.value, re.compile(r"[^\x20\x09-\x0D]+")
        for chunk in text_chunks(batches):
            p, offsets = token_marginals(model, chunk.column("text")) if model.fitted else (np.zeros(0), np.zeros(chunk.num_rows + 1, np.int64))
            z = _aggregates(p, offsets) @ model.calibration
            value = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            found: list[list] = [[] for _ in range(chunk.num_rows)]
            hot = np.flatnonzero(p >= 0.5)
            for row in np.unique(np.searchsorted(offsets, hot, side="right") - 1):
                local = {int(t - offsets[row]) for t in hot[np.searchsorted(hot, offsets[row]) : np.searchsorted(hot, offsets[row + 1])]}
                for i, m in enumerate(word.finditer(chunk.column("text")[int(row)].as_py())):
                    if i in local:
                        if found[row] and i - 1 in local:
                            found[row][-1] |= {"end": m.end(), "marginal": max(found[row][-1]["marginal"], float(p[offsets[row] + i]))}
                        else:
                            found[row].append({"start": m.start(), "end": m.end(), "marginal": float(p[offsets[row] + i])})
            yield pa.RecordBatch.from_pydict({k: chunk.column(k) for k in ("doc_id", *keep)} | {"score": value, "predicted": pa.array((value >= 0.5).astype(np.int32)), "spans": pa.array(found, span)})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *(k for k in keep if k != "text"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    kinds = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"doc_id long{kinds}, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>")
