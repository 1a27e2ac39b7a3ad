"""Embedding jobs: which rows lack a vector, and the hook for an embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """60 bits of a digest over values, each with its length, so that none runs into the next."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def fingerprints(rows: DataFrame, content: list[str], group: list[str]) -> DataFrame:
    """``(*group, n, total, mixed)``: number, sum and exclusive or of the content hashes of a group's rows, in any order.
    Stored beside a cache, they tell whether it still is what would be made from the source."""
    h = rows.select(*group, content_hash(*content).alias("h"))
    return h.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def cache_valid(source: DataFrame, stored: DataFrame, content: list[str], group: list[str]) -> DataFrame:
    """``(*group, n_source, n_stored, valid)``: a decision per cache. ``stored`` holds the ``fingerprints`` that were
    taken when the caches were made. A cache whose source is gone, and a source without a cache, are not valid."""
    now = fingerprints(source, content, group)
    old = stored.select(*group, F.col("n").alias("n_stored"), F.col("total").alias("old_total"), F.col("mixed").alias("old_mixed"))
    j = now.join(old, group, "full")
    same = (F.col("n") == F.col("n_stored")) & (F.col("total") == F.col("old_total")) & (F.col("mixed") == F.col("old_mixed"))
    return j.select(*group, F.coalesce("n", F.lit(0)).alias("n_source"), F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce(same, F.lit(False)).alias("valid"))


def to_embed(source: DataFrame, cache: DataFrame, decisions: DataFrame, content: list[str], group: list[str]) -> DataFrame:
    """Rows of ``source`` (uid, ...) to be embedded: of the caches that ``cache_valid`` decided against, those whose
    content hash the cache (uid, content_hash, the group) does not hold.

    ``decisions`` has a row per cache and goes to all tasks, so no row is dealt by its cache. Content is hashed where it is
    read: hashes are what moves, with such columns of the source as the caller goes on to use."""
    refused = F.broadcast(decisions.where("NOT valid").select(*group).distinct())
    # an inner join, since a semi join is pushed below the hash and takes the content along
    stale = source.withColumn("content_hash", content_hash(*content)).join(refused, group).select(*source.columns, "content_hash")
    return stale.join(cache.select("uid", "content_hash", *group), ["uid", "content_hash", *group], "left_anti")


def hashed_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The built-in embedder: signed counts of hashed words. Any callable from texts to a matrix can take its place."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h >> 31 else -1
        return out

    return embed


def embed_batch(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 64) -> DataFrame:
    """``(uid, embedding)`` of norm 1 (a zero vector stays zero), ``batch`` texts at a time, of which no more are held
    as Python's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                m = embedder([t or "" for t in part.column("text").to_pylist()])
                m = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(list(m), pa.list_(pa.float32()))], names=["uid", "embedding"])

    rows = texts.select("uid", F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"uid {rows.schema['uid'].dataType.simpleString()}, embedding array<float>")


def embedding_run_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "kind").agg(F.count("*").alias("n"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("made"))
