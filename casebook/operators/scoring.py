"""Scores of generated text against references, for whole tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.sequences import lcs_length, lcs_pairs, script_pairs
from casebook.functions.stem import stem as stem_

stem = lru_cache(1 << 16)(stem_)

# fixed values: the standard tokenisation of machine-translation scores (mteval 13a): what is replaced, in order
MARKS = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SPLITS = ((r"([{-~\[-` -&(-+:-@/])", r" {1} "), (r"([^0-9])([.,])", r"{1} {2} "), (r"([.,])([^0-9])", r" {1} {2}"), (r"([0-9])(-)", r"{1} {2} "))


def lots(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, so that no more texts than these are held as Python's."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def tokens(c: Column) -> Column:
    """Tokens of the standard tokenisation, case kept; null gives none."""
    t = F.coalesce(c, F.lit(""))
    for mark, put in MARKS:
        t = F.replace(t, F.lit(mark), F.lit(put))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, put in SPLITS:
        t = F.regexp_replace(t, pattern, put.replace("{1}", "$1").replace("{2}", "$2"))
    return F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), 0)


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def pieces(c: Column) -> Column:
    """Lower-case words and marks; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)


def bleu_score(hyp: list[str], ref: list[str], order: int = 4) -> float:
    total, hits, divisor, orders = 0.0, 0, 1.0, min(order, len(hyp))
    for n in range(1, orders + 1):
        ours, theirs = (Counter(zip(*(side[k:] for k in range(n)))) for side in (hyp, ref))
        found, size = sum(min(c, theirs[g]) for g, c in ours.items() if g in theirs), len(hyp) - n + 1
        divisor *= 1 if found else 2
        total += math.log(found / size) if found else -math.log(divisor * size)
        hits += found
    return 100 * (math.exp(1 - len(ref) / len(hyp)) if len(hyp) < len(ref) else 1.0) * math.exp(total / orders) if hits else 0.0


def rouge_score(hyp: list[str], ref: list[str]) -> float:
    h, r = ([stem(x) if len(x) > 3 else x for x in side] for side in (hyp, ref))
    return 2 * lcs_length(h, r) / (len(h) + len(r)) if h and r else 0.0


PLACES = 4_000_000


def _runs(a: list[str], b: list[str], limit: int) -> list[tuple[int, int]]:
    """Pairs of equal words, as many as can be, taken in common runs: the longest first, of equal ones the first."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    found: list[tuple[int, int]] = []
    hits = [where.get(w, ()) for w in a]
    if sum(map(len, hits)) > limit:
        found = lcs_pairs(a, b)
        taken_a, taken_b = {i for i, _ in found}, {j for _, j in found}
        left = {w: [j for j in js if j not in taken_b][::-1] for w, js in where.items()}
        return found + [(i, left[w].pop()) for i, w in enumerate(a) if i not in taken_a and left.get(w)]
    heap: list[tuple[int, int, int]] = []
    after: dict[int, int] = {}  # by place in b, the length of the run from there and the place in a at hand
    for i in range(len(a) - 1, -1, -1):
        after = {j: 1 + after.get(j + 1, 0) for j in hits[i]}
        heap += [(-n, i, j) for j, n in after.items()]
    heapify(heap)
    free_a, free_b = [True] * len(a), [True] * len(b)
    while heap:
        n, i, j = heappop(heap)
        free = 0
        while free < -n and free_a[i + free] and free_b[j + free]:
            free += 1
        if free == -n:
            for k in range(free):
                free_a[i + k] = free_b[j + k] = False
                found.append((i + k, j + k))
        elif free:
            heappush(heap, (-free, i, j))
    return found


def alignment(hyp: list[str], ref: list[str], limit: int = PLACES) -> list[tuple[int, int]]:
    """Matched places of two word lists in stages: equal words, then equal stems of what is left. In a stage as many words
    are matched as can be, in runs as long as can be, so that there are few of them. Where more than ``limit`` pairs of
    places are equal, those of a longest common subsequence come first and the others in order."""
    pairs: list[tuple[int, int]] = []
    h, r = list(range(len(hyp))), list(range(len(ref)))
    for form in (str, stem):
        found = _runs([form(hyp[i]) for i in h], [form(ref[j]) for j in r], limit)
        pairs += [(h[i], r[j]) for i, j in found]
        taken_h, taken_r = {i for i, _ in found}, {j for _, j in found}
        h, r = [x for i, x in enumerate(h) if i not in taken_h], [x for j, x in enumerate(r) if j not in taken_r]
    return sorted(pairs)


def meteor_score(hyp: list[str], ref: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Weighted harmonic mean of precision and recall of the alignment, less a penalty for the number of stretches in
    which both sides run in step. Synonyms are not matched."""
    pairs = alignment(hyp, ref)
    if not pairs:
        return 0.0
    precision, recall = len(pairs) / len(hyp), len(pairs) / len(ref)
    stretches = 1 + sum(q != (p[0] + 1, p[1] + 1) for p, q in zip(pairs, pairs[1:]))
    return precision * recall / (alpha * precision + (1 - alpha) * recall) * (1 - gamma * (stretches / len(pairs)) ** beta)


SCORES = {"bleu": (tokens, bleu_score), "rouge_l": (words, rouge_score), "meteor": (pieces, meteor_score)}


def scored(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``(case_id, *names)``: the named scores of every pair (case_id, hyp, ref), in one pass in which no row leaves its
    task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lots(batches):
            sides = lambda name: zip(*(part.column(f"{name}_{c}").to_pylist() for c in ("hyp", "ref")))
            found = {name: pa.array([SCORES[name][1](h, r) for h, r in sides(name)], pa.float64()) for name in names}
            yield pa.RecordBatch.from_pydict({"case_id": part.column("case_id")} | found)

    t = pairs.select("case_id", *[SCORES[name][0](F.col(c)).alias(f"{name}_{c}") for name in names for c in ("hyp", "ref")])
    return t.mapInArrow(run, ", ".join([f"case_id {t.schema['case_id'].dataType.simpleString()}", *[f"{name} double" for name in names]]))


def sentence_bleu(pairs: DataFrame) -> DataFrame:
    """``(case_id, bleu)`` in percent: clipped n-gram precisions up to four, exponential smoothing of the orders without a
    match, brevity penalty. A hypothesis of fewer tokens than that is scored on the orders it has. 0 when a side has no
    token or nothing matches."""
    return scored(pairs, ["bleu"])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """``(case_id, rouge_l)``: F-measure of the longest common subsequence of stemmed words (words of up to three letters
    stay as they are); 0 when a side has none."""
    return scored(pairs, ["rouge_l"])


def meteor(pairs: DataFrame) -> DataFrame:
    """``(case_id, meteor)`` over lower-case words and marks; 0 when a side has none."""
    return scored(pairs, ["meteor"])


def tier1_table(pairs: DataFrame, statuses: DataFrame, fields: tuple[str, ...] = ("findings", "impression")) -> DataFrame:
    """Every case of ``statuses`` (case_id, status, reason) with a column per field and score, ``<field>_bleu``,
    ``<field>_rouge_l`` and ``<field>_meteor``, over ``pairs`` (case_id, field, hyp, ref); cases without a pair have nulls.
    A field's scores come from one pass over its pairs and one join."""
    out = statuses
    for f in fields:
        own = scored(pairs.where(F.col("field") == f).select("case_id", "hyp", "ref"), list(SCORES))
        out = out.join(own.withColumnsRenamed({name: f"{f}_{name}" for name in SCORES}), "case_id", "left")
    return out


def baseline_mismatch(pairs: DataFrame, partners: DataFrame, metric: str, scorer) -> DataFrame:
    """Mean score of the real pairs, of hypotheses against another case's reference, and the gap. ``partners`` (uid,
    partner) is a permutation without fixed point of the case ids."""
    other = pairs.select(F.col("case_id").alias("partner"), F.col("ref").alias("ref"))
    crossed = pairs.select("case_id", "hyp").join(partners.withColumnRenamed("uid", "case_id"), "case_id").join(other, "partner").select("case_id", "hyp", "ref")
    real, base = scorer(pairs).agg(F.avg(metric).alias("real")), scorer(crossed).agg(F.avg(metric).alias("baseline"))
    return real.join(base).withColumn("gap", F.col("real") - F.col("baseline"))


PIECE = re.compile(r"\w+|[^\S\r\n]+|\r?\n|\r|[^\w\s]")


def changed_words(a: str, b: str) -> int:
    """Words removed and added by a shortest edit script over words, white space, line ends and punctuation; words of one
    removed or added stretch are counted as white space separates them."""
    x, y = PIECE.findall(a), PIECE.findall(b)
    n, i, j = 0, 0, 0
    for p, q in [*script_pairs(x, y), (len(x), len(y))]:
        if i < p:
            n += len("".join(x[i:p]).split())
        if j < q:
            n += len("".join(y[j:q]).split())
        i, j = p + 1, q + 1
    return n


def word_diff(rows: DataFrame, fields: tuple[str, ...], draft: str = "draft", final: str = "final") -> DataFrame:
    """``(id, edit_percentage, sections_changed)``: words added and removed over the words of the draft, times 100, over
    ``fields`` of the structs ``draft`` and ``final``; 0 when the draft has no words. A section counts as changed when its
    text differs at all. The script is a shortest one; of several, which one is taken is not told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lots(batches):
            percent, changed = [], []
            for d, e in zip(part.column("d").to_pylist(), part.column("e").to_pylist()):
                texts = [(a or "", b or "") for a, b in zip(d, e)]
                words = sum(len(a.split()) for a, _ in texts)
                touched = sum(changed_words(a, b) for a, b in texts if a != b)
                percent.append(100.0 * touched / words if words else 0.0)
                changed.append(sum(a != b for a, b in texts))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "edit_percentage": pa.array(percent, pa.float64()), "sections_changed": pa.array(changed, pa.int32())})

    side = lambda c: F.array(*[F.col(f"{c}.{x}") for x in fields])
    return rows.select(F.col("id").cast("long").alias("id"), side(draft).alias("d"), side(final).alias("e")).mapInArrow(run, "id long, edit_percentage double, sections_changed int")
