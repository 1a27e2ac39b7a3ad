"""Token files under Re-Pair grammar compression.

Documents are encoded, closed with an end id and laid out in ascending doc_id order over shards of about a million ids.
In each shard frequent pairs of neighbouring ids are replaced by new symbols, again and again, until no pair has two
uses; the shard keeps the rules, the expanded length of every rule and the shortened sequence. From the lengths follows where any position of the
shard lies in the sequence, so a document is read back by expanding only the symbols that cover it.

File format: Parquet, one row per shard, so that any file system Spark writes to will do. Integers in binary columns
are little-endian unsigned 32-bit.

====================  =========================================================================================
part, shard           position in the global order: ascending part, then ascending shard
first_id, last_id     smallest and largest doc_id of the shard (for pushed-down filters)
n_tokens              ids in the shard
doc_ids, doc_lengths  its documents in order and their ids, end id included
base                  symbols below are ids; symbol ``base + k`` is rule ``k``
rules                 left and right symbol of each rule, in turn
rule_lengths          ids that each rule expands to
sequence              the shard's symbols
====================  =========================================================================================

Null text counts as empty: the document is its end id alone. A null doc_id sorts first. Repeated rows are stored each,
ties ordered by text. An empty table gives files without shards. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.bpe import chained
from casebook.llm.common import doc_text, encode_column, gather, lists, text_chunks

SHARD = "part int, shard int, first_id long, last_id long, n_tokens long, doc_ids array<long>, doc_lengths binary, base long, rules binary, rule_lengths binary, sequence binary"
SHARD_TOKENS = 1 << 20


def build_grammar(ids: np.ndarray, step: int = 8) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules, rule lengths, sequence) of a sequence of ids.

    Frequent pairs go first: a round replaces every pair that occurs at least ``threshold`` times, from left to right
    without overlap, and the threshold then falls to a ``step``-th of the highest count left, down to 2. It ends when no
    pair has two uses that don't overlap. A pair that occurs once never occurs twice again unless a new symbol is in it,
    so a round looks only at places whose pair was seen twice or is new.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    seq, rules, lengths, symbols = ids.astype(np.int32), [], [], base
    size_of = np.ones(base, dtype=np.int64)
    threshold = None
    at = np.arange(max(0, len(seq) - 1))  # places whose pair may be used
    while at.size:
        keys, at = _by_pair(seq[at] * np.int64(symbols) + seq[at + 1], at)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        counts = np.diff(edge)
        highest = int(counts.max())
        if highest < 2:
            break
        threshold = max(2, min(highest, threshold or highest) // step)
        # number of the pair at every place: -2 not in question, -1 waiting for its round
        pair = np.full(len(seq), -2, dtype=np.int32)
        number = np.where(counts >= threshold, np.arange(len(counts)), -1)
        number[counts < 2] = -2
        pair[at] = np.repeat(number, counts)
        used, uses = _without_overlap(pair, len(counts))
        if threshold == 2 and not (uses >= 2).any():  # every pair lost a use to its neighbours: one by one, the most frequent first
            used, uses = _apart(seq, at, edge, counts, pair)
            if not len(used):
                break
        worth = uses >= 2  # a rule that would be used once saves nothing
        used = used[worth[pair[used]]]
        left, right = np.divmod(keys[edge[:-1][worth]], symbols)
        rules.append(np.stack([left, right], axis=1))
        lengths.append(size_of[left] + size_of[right])
        size_of = np.concatenate([size_of, lengths[-1]])
        seq[used] = symbols + (np.cumsum(worth) - 1)[pair[used]]
        symbols += int(worth.sum())
        open_ = pair >= -1
        open_[used] = open_[used[used > 0] - 1] = True
        keep = np.ones(len(seq), dtype=bool)
        keep[used + 1] = False
        seq, open_ = seq[keep], open_[keep]
        at = np.flatnonzero(open_[:-1])
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.concatenate(lengths) if lengths else np.zeros(0, np.int64), seq.astype(np.int64)


def _by_pair(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their places, sorted by both; in one integer each where there is room, as that sorts faster."""
    bits = int(at[-1]).bit_length()
    if int(keys.max()).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], at[order]
    both = np.sort(keys << bits | at)
    return both >> bits, both & ((1 << bits) - 1)


def _without_overlap(pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which pairs are used, every second one within a run of neighbouring places, and uses by pair."""
    hit = np.flatnonzero(pair >= 0)
    place = np.arange(len(hit))
    run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, place, 0)) if len(hit) else place
    used = hit[(place - run) % 2 == 0]
    return used, np.bincount(pair[used], minlength=n)


def _apart(seq: np.ndarray, at: np.ndarray, edge: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with two uses or more, the most frequent first, none of which shares a symbol with another: so each keeps
    all its uses. Fills ``pair`` in at their places."""
    taken: set[int] = set()
    used, uses = [], np.zeros(len(counts), dtype=np.int64)
    often = np.flatnonzero(counts > 1)
    for k in often[np.argsort(-counts[often], kind="stable")].tolist():
        places = at[edge[k] : edge[k + 1]].tolist()
        own = {int(seq[places[0]]), int(seq[places[0] + 1])}
        if not taken.isdisjoint(own):
            continue
        if len(own) == 1:  # runs of one symbol: every second place
            free: list[int] = []
            for x in places:
                if not free or x > free[-1] + 1:
                    free.append(x)
            places = free
        if len(places) >= 2:
            taken |= own
            pair[places], uses[k] = k, len(places)
            used += places
    return np.sort(np.array(used, dtype=np.int64)), uses


def expansions(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each rule stands for, as a ragged array. A rule only refers to rules before it, so a few passes
    that open all symbols of all rules at once are enough."""
    flat, offsets = rules.reshape(-1).astype(np.int64), np.arange(len(rules) + 1, dtype=np.int64) * 2
    while (open_ := flat >= base).any():
        size = np.where(open_, 2, 1)
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(ends[-1], dtype=np.int64)
        out[ends[:-1][~open_]] = flat[~open_]
        pair = rules[flat[open_] - base]
        out[ends[:-1][open_]], out[ends[:-1][open_] + 1] = pair[:, 0], pair[:, 1]
        flat, offsets = out, ends[offsets]
    return flat, offsets


def expand(base: int, rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids of a sequence of symbols."""
    flat, offsets = expansions(base, rules, lengths)
    terminal = np.arange(base, dtype=np.int64)
    values = np.concatenate([terminal, flat])
    ends = np.concatenate([np.arange(base + 1, dtype=np.int64), base + offsets[1:]])
    return gather(values, ends, seq)[0]


def expand_range(base: int, rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray, start: int, length: int) -> np.ndarray:
    """Ids ``start .. start + length`` of a shard, opening only the symbols that cover them."""
    size = np.where(seq < base, 1, lengths[np.maximum(seq - base, 0)] if len(lengths) else 1)
    ends = np.concatenate([[0], np.cumsum(size)])
    a = max(0, int(np.searchsorted(ends, start, side="right")) - 1)
    b = int(np.searchsorted(ends, start + length, side="left"))
    out: list[int] = []
    todo = seq[a:b][::-1].tolist()
    while todo:
        s = todo.pop()
        if s < base:
            out.append(s)
        else:
            left, right = rules[s - base]
            todo += [int(right), int(left)]
    return np.array(out[start - ends[a] : start - ends[a] + length], dtype=np.int64)


def _u4(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).astype("<u4").tobytes()


def _shards(end_id: int, shard_tokens: int, json_path: str | None, rank_path: str | None):
    def shard(number: int, doc_ids: list, sizes: list[int], pieces: list[np.ndarray]) -> dict:
        base, rules, lengths, seq = build_grammar(np.concatenate(pieces))
        known = [i for i in doc_ids if i is not None]
        return {
            "part": TaskContext.get().partitionId(), "shard": number, "first_id": min(known, default=None), "last_id": max(known, default=None),
            "n_tokens": sum(sizes), "doc_ids": doc_ids, "doc_lengths": _u4(np.array(sizes)), "base": base, "rules": _u4(rules), "rule_lengths": _u4(lengths), "sequence": _u4(seq),
        }

    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.binary()), ("base", pa.int64()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("sequence", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, sizes, pieces, held = 0, [], [], [], 0
        for chunk in text_chunks(batches, limit=8 << 20):
            ids, offsets = encode_column(chunk.column("text"), json_path, rank_path)
            closed = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            names, at = chunk.column("doc_id").to_pylist(), 0
            while at < len(names):
                upto = min(len(names), max(at + 1, int(np.searchsorted(offsets, offsets[at] + shard_tokens - held, side="right")) - 1))
                doc_ids += names[at:upto]
                sizes += np.diff(offsets[at : upto + 1]).tolist()
                pieces.append(closed[offsets[at] : offsets[upto]])
                held += int(offsets[upto] - offsets[at])
                at = upto
                if held >= shard_tokens or at < len(names):
                    yield pa.RecordBatch.from_pylist([shard(number, doc_ids, sizes, pieces)], schema=kinds)
                    number, doc_ids, sizes, pieces, held = number + 1, [], [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_pylist([shard(number, doc_ids, sizes, pieces)], schema=kinds)

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text", json_path: str | None = None, rank_path: str | None = None) -> None:
    """Encode every whole text with the byte-level BPE of ``json_path``, append ``end_id`` and write compressed shards
    to ``path`` in ascending doc_id order. One shuffle, of the texts, by ranges of doc_id."""
    ordered = doc_text(docs, doc_id, text).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(end_id, shard_tokens, json_path, rank_path), SHARD).write.option("compression", "zstd").parquet(path)


def _u4s(scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_py(), "<u4").astype(np.int64)


def read_token_files(spark: SparkSession, path: str, then: tuple = (), column: str = "ids", kind: str = "array<int>") -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every stored document; ``start`` counts the ids of all documents before it.
    ``then``: Arrow steps to run in the same Python workers, such as ``with_crc``, that turn ``ids`` into ``column``.

    Positions come from two small prefix sums, over the parts and over the shards of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(name)[r]  # noqa: B023, E731
                ids = expand(cell("base").as_py(), _u4s(cell("rules")).reshape(-1, 2), _u4s(cell("rule_lengths")), _u4s(cell("sequence")))
                sizes = _u4s(cell("doc_lengths"))
                ends, doc_ids = np.concatenate([[0], np.cumsum(sizes)]), cell("doc_ids").values
                for a in range(0, len(sizes), 2000):
                    b = min(a + 2000, len(sizes))
                    n = b - a
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([cell("part").as_py()] * n, pa.int32()), "shard": pa.array([cell("shard").as_py()] * n, pa.int32()), "doc_id": doc_ids.slice(a, n), "local": pa.array(ends[a:b]), "n_tokens": pa.array(sizes[a:b]), "ids": lists(ids[ends[a] : ends[b]].astype(np.int32), ends[a : b + 1] - ends[a]),
                    })

    stored = spark.read.schema(SHARD).parquet(path)
    docs = stored.mapInArrow(chained(run, *then), f"part int, shard int, doc_id long, local long, n_tokens long, {column} {kind}")
    shards = stored.select("part", "shard", "n_tokens")
    before = (Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_start"))
    within = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("shard_start"))
    starts = within.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base_start"))
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("base_start") + F.col("local")).alias("start"), "n_tokens", column)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of a short list of documents: only shards whose id range can hold one are read, and in them
    only the symbols that cover the documents are expanded."""
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(name)[r]  # noqa: B023, E731
                here, sizes = cell("doc_ids").as_py(), _u4s(cell("doc_lengths"))
                starts = np.concatenate([[0], np.cumsum(sizes)])
                rows = [i for i, d in enumerate(here) if d in set(wanted)]
                if rows:
                    grammar = cell("base").as_py(), _u4s(cell("rules")).reshape(-1, 2), _u4s(cell("rule_lengths")), _u4s(cell("sequence"))
                    found = [expand_range(*grammar, int(starts[i]), int(sizes[i])).astype(np.int32).tolist() for i in rows]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([here[i] for i in rows], pa.int64()), "ids": pa.array(found, pa.list_(pa.int32()))})

    may = F.lit(False)
    for i in wanted:
        may = may | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    return spark.read.schema(SHARD).parquet(path).where(may).mapInArrow(run, "doc_id long, ids array<int>")


def with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow step that puts the crc32 of the ids in the place of the ids."""
    for batch in batches:
        column = batch.column("ids")
        raw = memoryview(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64) * 4
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in batch.schema.names if k != "ids"} | {"ids_crc32": pa.array(crc, pa.int64())})
