"""Packing of documents into training sequences by cutting-stock column generation.

A document's ids and an end id are cut into pieces of at most ``width`` ids; only documents longer than a sequence are
cut. Spark counts the pieces per length class (lengths rounded up to ``unit`` ids, so at most ``width / unit``
classes); on the driver, which sees nothing but these counts, a linear program over packing patterns is solved by
column generation: the master's dual prices go into a knapsack dynamic program, which returns the pattern most worth
adding, until none is. The rounded-down pattern counts are kept, whatever the pattern's fill, and the pieces left over,
less than one sequence per class on average, are packed by best-fit decreasing on their exact lengths. Pieces are ranked within their class (by partial
counts per hash bucket, so a very common length is no hot group), and their rank says which sequence of which pattern
they belong to. Both pattern and slot tables are bounded by the number of classes, not by the input.

Sequences are filled up to ``width`` with padding; a sequence whose ids make a power of two needs none.

Null text counts as empty: its document is the end id alone. Null doc_ids and repeated rows are packed like others;
pieces of rows with the same id are told apart by a row key. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import doc_text, encode_column, text_chunks
from casebook.session import written

PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(width: int, end_id: int, json_path: str | None, rank_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for chunk in text_chunks(batches):
            ids, offsets = encode_column(chunk.column("text"), json_path, rank_path)
            closed = np.insert(ids, offsets[1:], end_id)
            raw, offsets = memoryview(closed.astype("<u4").tobytes()), offsets + np.arange(len(offsets))
            sizes = np.diff(offsets)
            count = -(-sizes // width)
            doc = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * width
            length = np.minimum(width, sizes[doc] - start)
            at = offsets[:-1][doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_pydict({"row": pa.array(row + doc), "doc_id": chunk.column("doc_id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(sizes[doc])})
            row += chunk.num_rows

    return run


# ---------------------------------------------------------------- the linear program


def best_pattern(prices: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Bounded knapsack over class sizes: the pattern of highest price that fits, by dynamic programming over capacity.

    Classes enter as packages of 1, 2, 4, ... pieces, which cover every count up to ``most``."""
    value = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for c in np.flatnonzero(prices > 1e-12):
        left, package = int(min(most[c], capacity // sizes[c])), 1
        while left > 0:
            n = min(package, left)
            w = n * int(sizes[c])
            gain = value[: capacity + 1 - w] + n * prices[c]
            better = gain > value[w:] + 1e-12
            if better.any():
                value[w:] = np.where(better, gain, value[w:])
                taken.append((int(c), n, better))
            left -= n
            package *= 2
    pattern, room = np.zeros(len(prices), dtype=np.int64), int(value.argmax())
    best = float(value[room])
    for c, n, better in reversed(taken):
        w = n * int(sizes[c])
        if room >= w and better[room - w]:
            pattern[c] += n
            room -= w
    return pattern, best


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often to use each (not rounded) so that every class's demand is met with as few
    sequences as possible. Revised simplex: one basic pattern per class, priced by ``best_pattern``. Ends when no
    pattern is worth more than ``1 + gap`` sequences, which bounds the distance to the optimum by ``gap``."""
    m = len(sizes)
    most = np.minimum(capacity // sizes, demand).astype(np.int64)
    columns = np.diag(np.maximum(1, most)).astype(float)  # column c: a sequence of class c alone
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(rounds):
        pattern, worth = best_pattern(inverse.sum(0), sizes, most, capacity)
        if worth <= 1 + gap:
            break
        d = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        columns[:, out] = pattern
        x = np.maximum(x - step * d, 0)
        x[out] = step
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
    return columns.T.astype(np.int64), x


def best_fit(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices into ``lengths``."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = np.zeros(width + 1, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = np.flatnonzero(open_rooms[n:])
        if len(fits):
            room = n + int(fits[0])
            b = by_room[room].pop()
            open_rooms[room] -= 1
        else:
            room, b = width, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room.setdefault(room - n, []).append(b)
        open_rooms[room - n] += 1
    return bins


def plan(counts: dict[int, int], width: int, unit: int) -> tuple[list[tuple[int, int, int, int]], dict[int, int], int]:
    """Slots, leftovers and sequences used, from the number of pieces per class (class ``c``: up to ``c * unit`` ids).

    A slot (class, first rank, per sequence, first sequence) says: from that rank on, ``per sequence`` pieces of the
    class go to each sequence, counting from ``first sequence``. Leftovers: ranks from there on are packed apart."""
    if not counts:
        return [], {}, 0
    classes = np.array(sorted(counts))
    demand = np.array([counts[c] for c in classes.tolist()], dtype=float)
    patterns, use = column_generation(classes, demand, width // unit)
    used = np.zeros(len(classes), dtype=np.int64)
    slots, sequence = [], 0
    for p, n in zip(patterns, np.floor(use + 1e-9).astype(np.int64)):
        over = np.where(p > 0, (demand - used) // np.maximum(p, 1), np.inf).min()
        n = int(min(n, over))
        if n <= 0:
            continue
        for c in np.flatnonzero(p):
            slots.append((int(classes[c]), int(used[c]), int(p[c]), sequence))
            used[c] += p[c] * n
        sequence += n
    if (demand - used) @ classes > rest_bound(counts, width, unit):  # only when rounding errors of the simplex add up
        for c, per in enumerate((width // unit) // classes):
            n = int((demand[c] - used[c]) // per)
            if n:
                slots.append((int(classes[c]), int(used[c]), int(per), sequence))
                used[c] += per * n
                sequence += n
    return slots, {int(c): int(u) for c, u in zip(classes, used)}, sequence


def rest_bound(counts: dict[int, int], width: int, unit: int) -> int:
    """Most that leftovers may add up to, in units: a sequence per class, since a plan has one pattern per class."""
    return len(counts) * (width // unit)


def pack(docs: DataFrame, width: int = 2048, end_id: int = 1, unit: int = 8, n_hash: int = 64, doc_id: str = "doc_id", text: str = "text", json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(doc_text(docs, doc_id, text).mapInArrow(_pieces(width, end_id, json_path, rank_path), PIECES), "pieces")
    spark = docs.sparkSession
    classed = pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int")).withColumn("h", F.pmod(F.xxhash64("row", "start"), F.lit(n_hash)).cast("int"))
    by_hash = classed.groupBy("class", "h").agg(F.count("*").alias("k"))
    counts = {r["class"]: r.k for r in by_hash.groupBy("class").agg(F.sum("k").alias("k")).collect()}  # one row per class
    slots, rest_from, n_sequences = plan(counts, width, unit)
    before = by_hash.select("class", "h", F.coalesce(F.sum("k").over(Window.partitionBy("class").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("class", "h").orderBy("row", "start"))
    ranked = classed.withColumn("local", local).join(before, ["class", "h"]).withColumn("rank", F.col("before") + F.col("local") - 1).drop("before", "local", "h")
    ranked = written(ranked, "ranked")
    # a slot ends where the class's next one, or its leftovers, begin
    table, by_class = [], {}
    for c, first, per, sequence in slots:
        by_class.setdefault(c, []).append((first, per, sequence))
    for c, own in by_class.items():
        ends = [f for f, _, _ in own[1:]] + [rest_from[c]]
        table += [(c, f, e, per, s) for (f, per, s), e in zip(own, ends)]
    slot_rows = spark.createDataFrame(table, "class int, first long, till long, per long, sequence long")
    fit = (ranked["class"] == slot_rows["class"]) & (ranked["rank"] >= slot_rows["first"]) & (ranked["rank"] < slot_rows["till"])
    placed = ranked.join(F.broadcast(slot_rows), fit).select(ranked["*"], (F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).alias("sequence_id"))
    rest_rows = spark.createDataFrame(sorted(rest_from.items()) or [], "class int, rest long")
    rest = ranked.join(F.broadcast(rest_rows), "class").where("rank >= rest").select("row", "start", "length")
    if sum((counts[c] - u) * c for c, u in rest_from.items()) > rest_bound(counts, width, unit):
        raise AssertionError("leftovers exceed a sequence per class")
    left = rest.orderBy("row", "start").toPandas()  # bounded by the number of classes, as just asserted
    bins = best_fit(left["length"].to_numpy(np.int64), width)
    where = [(int(left["row"][i]), int(left["start"][i]), n_sequences + b) for b, own in enumerate(bins) for i in own]
    apart = ranked.join(F.broadcast(spark.createDataFrame(where, "row long, start long, sequence_id long")), ["row", "start"]).select(*ranked.columns, "sequence_id")
    every = placed.unionByName(apart)
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
