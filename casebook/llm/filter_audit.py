"""Audit of how five document filters interact, from a sparse document-term matrix.

Texts are cut into words, and each chunk of documents becomes a shard of the document-term matrix in compressed sparse
rows: ``indptr``, ``indices``, ``data``. Words have ids of one dictionary of the whole table: a chunk first numbers its
own distinct words, in the order of buckets by hash, and sends each bucket one packet of those it owns; a bucket tells
equal words of all chunks apart once, names them, and sends each chunk its ids back, by which the shard's indices are
renamed. So a word moves once per shard that has it, packets never outnumber these words, a very frequent word is one
entry per shard, and texts do not move at all. A row's sum is a document's number of words, its number of nonzero entries
that of its distinct words; these decide filters A and B. C and D are told by the chunk; E, whether a document with a
smaller doc_id has the same text, by one minimum per digest, which is then joined by doc_id, so that a text with very
many copies is no hot key. Documents then count by part and the set of filters that they fail, 32 rows a part at most,
and every order of the filters follows from these counts.

Null text is empty: no words, fails A alone. A null part is the empty string. Rows without doc_id have no labels, fail
no E and make no other row fail it. Repeated rows are documents each; rows that share a doc_id do not make each other
fail E. Labels that repeat a doc_id count if any of them says so. An empty table gives an empty result. Further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import plain_words, sorted_groups, text_chunks, word_hashes
from casebook.session import written

FILTERS = "ABCDE"
FAILS_C, FAILS_D = 4, 8  # bits of the filters by their place in FILTERS
BUCKET_TEXT = 16 << 20
LOCAL = "shard long, bucket int, doc_ids array<long>, parts array<string>, digests array<binary>, flags binary, indptr binary, indices binary, data binary, sizes binary, letters binary"
SHARD = "shard long, doc_ids array<long>, parts array<string>, digests array<binary>, flags binary, indptr binary, indices binary, data binary"


def _put(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _get(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _local_shards(n_buckets: int):
    """Per chunk of documents a shard with the chunk's own numbers for words (bucket -1), and a packet of its distinct
    words for every bucket that owns some; numbers run through the buckets in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for chunk in text_chunks(batches):
            n = chunk.num_rows
            texts = chunk.column("text").take(pa.array(np.arange(n)))  # an array of its own, not a slice
            words, codes, offsets = plain_words(texts)
            used, codes = np.unique(codes, return_inverse=True)
            words = words.take(pa.array(used))
            bucket = (word_hashes(words) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            words, bucket = words.take(pa.array(order)), bucket[order]
            entry, times = np.unique(np.repeat(np.arange(n), np.diff(offsets)) * max(1, len(used)) + number[codes], return_counts=True)
            row, column = np.divmod(entry, max(1, len(used)))
            capitals = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False)
            flags = FAILS_C * (100 * capitals.astype(np.int64) > 10 * pc.utf8_length(texts).to_numpy(zero_copy_only=False)) + FAILS_D * pc.match_substring_regex(texts, "[#$%&*|]").to_numpy(zero_copy_only=False)
            owned, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:].tolist(), len(words)]
            packets = [words.slice(a, b - a) for a, b in zip(starts.tolist(), ends)]
            more = len(packets)
            lists = lambda c, kind: pa.array([chunk.column(c).to_pylist(), *[None] * more], pa.list_(kind))  # noqa: B023, E731
            head = lambda x: pa.array([x, *[None] * more], pa.binary())  # noqa: B023, E731
            table = pa.RecordBatch.from_pydict({
                "shard": pa.array([(part << 24) + count] * (1 + more), pa.int64()), "bucket": pa.array([-1, *owned.tolist()], pa.int32()),
                "doc_ids": lists("doc_id", pa.int64()), "parts": lists("part", pa.string()), "digests": lists("digest", pa.binary()), "flags": head(flags.astype("u1").tobytes()),
                "indptr": head(_put(np.searchsorted(row, np.arange(n + 1)), "<u4")), "indices": head(_put(column, "<u4")), "data": head(_put(times, "<u4")),
                "sizes": pa.array([None, *[pc.binary_length(w).to_numpy(zero_copy_only=False).astype("<u4").tobytes() for w in packets]], pa.binary()),
                "letters": pa.array([None, *[zstandard.compress("".join(w.to_pylist()).encode(), 1) for w in packets]], pa.binary()),
            })
            for a in range(0, table.num_rows, 2_000):
                yield table.slice(a, 2_000)
            count += 1

    return run


def _words_of(group: pa.Table) -> pa.Array:
    """The words of a bucket's packets, one packet behind the other."""
    sizes = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in group.column("sizes")]).astype(np.int64)
    letters = b"".join(zstandard.decompress(x.as_py()) for x in group.column("letters"))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(letters))


def _ids(n_buckets: int):
    """A bucket's ids for the words of every packet: a word's number within the bucket times ``n_buckets``, plus the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket"]):
            b = group.column("bucket")[0].as_py()
            ids = _words_of(group).dictionary_encode().indices.to_numpy().astype(np.int64) * n_buckets + b
            ends = np.cumsum([len(x.as_py()) // 4 for x in group.column("sizes")])
            named = pa.array([_put(x, "<i8") for x in np.split(ids, ends[:-1])], pa.binary())
            table = pa.RecordBatch.from_arrays([group.column("shard").combine_chunks(), group.column("bucket").combine_chunks(), named], names=["shard", "bucket", "ids"])
            for a in range(0, table.num_rows, 2_000):
                yield table.slice(a, 2_000)

    return run


def _dictionary(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket"]):
            words = _words_of(group).dictionary_encode().dictionary
            ids = np.arange(len(words)) * n_buckets + group.column("bucket")[0].as_py()
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words.slice(a, 50_000).cast(pa.string()), pa.array(ids[a : a + 50_000])], names=["word", "id"])

    return run


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards whose indices are ids of the dictionary, ascending in each row."""
    for group in sorted_groups(batches, ["shard"]):
        one = group.slice(0, 1)  # the shard itself, then its ids bucket by bucket
        ids = np.concatenate([np.zeros(0, np.int64), *[_get(x.as_py(), "<i8") for x in group.column("ids").slice(1)]])
        ends, local, times = (_get(one.column(c)[0].as_py(), "<u4").astype(np.int64) for c in ("indptr", "indices", "data"))
        named = ids[local]
        order = np.lexsort((named, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        columns = {c: one.column(c).combine_chunks() for c in ("shard", "doc_ids", "parts", "digests", "flags", "indptr")}
        yield pa.RecordBatch.from_pydict(columns | {"indices": pa.array([_put(named[order], "<i8")], pa.binary()), "data": pa.array([_put(times[order], "<u4")], pa.binary())})


def term_matrix(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text", bucket_text: int = BUCKET_TEXT) -> tuple[DataFrame, DataFrame]:
    """``(dictionary, shards)``: ``(word, id)`` with unique, not consecutive ids, and the document-term matrix of ``docs``
    as a row per shard. ``indptr`` and ``data`` (unsigned 32 bits) and ``indices`` (64 bits) are little-endian and
    compressed by zstd; ``doc_ids``, ``parts``, ``digests`` (SHA-256 of the text) and ``flags`` have an entry per row."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), t.alias("text"))
    n_buckets = max(1, math.ceil(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n / bucket_text))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    local = written(rows.mapInArrow(_local_shards(n_buckets), LOCAL), "local-shards")
    packets = local.where("bucket >= 0").select("shard", "bucket", "sizes", "letters").repartition("bucket").sortWithinPartitions("bucket")
    ids = packets.mapInArrow(_ids(n_buckets), "shard long, bucket int, ids binary")
    heads = local.where("bucket < 0").drop("sizes", "letters")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in heads.drop("shard", "bucket").dtypes]
    whole = heads.withColumn("ids", F.lit(None).cast("binary")).unionByName(ids.select("shard", "bucket", *none, "ids"))
    shards = whole.repartition("shard").sortWithinPartitions("shard", "bucket").mapInArrow(_renamed, SHARD)
    return packets.mapInArrow(_dictionary(n_buckets), "word string, id long"), shards


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row of a shard: its sum, its number of nonzero entries, and the filters A to D that it fails."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            ends, times = _get(one.column("indptr")[0].as_py(), "<u4").astype(np.int64), _get(one.column("data")[0].as_py(), "<u4").astype(np.int64)
            sums = np.diff(np.concatenate([[0], np.cumsum(times)])[ends])
            nonzero = np.diff(ends)
            fails = np.frombuffer(one.column("flags")[0].as_py(), "u1") + (sums < 100) + 2 * (100 * nonzero < 80 * sums)
            yield pa.RecordBatch.from_pydict({
                "doc_id": one.column("doc_ids")[0].values, "part": one.column("parts")[0].values, "digest": one.column("digests")[0].values,
                "n_words": pa.array(sums, pa.int64()), "n_distinct": pa.array(nonzero, pa.int64()), "fails": pa.array(fails, pa.int32()),
            })


def document_flags(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """``(doc_id, part, n_words, n_distinct, fails)``: ``fails`` has bit k set if the document fails ``FILTERS[k]``."""
    _, shards = term_matrix(docs, doc_id, part, text)
    rows = written(shards.mapInArrow(_measured, "doc_id long, part string, digest binary, n_words long, n_distinct long, fails int"), "document-flags")
    named = rows.where("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = named.join(firsts, ["doc_id", "digest"], "left").withColumn("fails", F.col("fails") + F.when(F.col("first"), 0).otherwise(16))
    columns = ["doc_id", "part", "n_words", "n_distinct", "fails"]
    return later.select(columns).unionByName(rows.where("doc_id IS NULL").select(columns))


def orders() -> list[tuple[str, int, int, int]]:
    """Every (order, step, bit of the step's filter, bits of those before it)."""
    out = []
    for p in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(p, 1):
            out.append(("".join(FILTERS[i] for i in p), step, 1 << k, before))
            before |= 1 << k
    return out


def interactions(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from ``(doc_id, part, fails)`` and ``(doc_id, quality, toxic)``."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id have no label; they stay out of the join, where they would be one key
    known = flags.where("doc_id IS NOT NULL").join(told, "doc_id", "left").select("part", "fails", "good", "toxic")
    rest = flags.where("doc_id IS NULL").select("part", "fails", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    sets = known.unionByName(rest).groupBy("part", "fails").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    # 600 steps for each of at most 32 rows a part
    step = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"own":{own},"before":{before}}}' for o, s, own, before in orders()) + "]"), "array<struct<o string, s int, own int, before int>>")
    steps = sets.withColumn("x", F.explode(step)).select("part", "fails", "n", "good", "toxic", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), F.col("x.own").alias("own"), F.col("x.before").alias("before"))
    fails_own, fails_before = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    removed = fails_own & ~fails_before
    # of a document that fails k filters each removes it in 120 / k of the orders
    share = F.expr(f"n * {len(orders()) // len(FILTERS)} div greatest(bit_count(fails), 1)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails_own & ~fails_before).alias("kept"), total(removed).alias("removed"), total(fails_own & fails_before).alias("redundant"), total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), F.sum(F.when(fails_own, share).otherwise(0)).cast("long").alias("shapley"),
    )


def op13_sql() -> str:
    steps = ", ".join(f"('{o}', {s}, {own}, {before})" for o, s, own, before in orders())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
s(filter_order, step, own, before) AS (VALUES {steps})
SELECT part, filter_order, step::INTEGER AS step,
  sum(CASE WHEN fails & own = 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  (sum(sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, own, before
"""
