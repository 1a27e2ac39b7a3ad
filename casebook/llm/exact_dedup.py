"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

The index is a table of one row per distinct text: SHA-256, the document that stays, and how many rows of its first
batch had the text. It is bucketed and sorted by digest, so the join against it moves only the new rows. A batch is
hashed once, aggregated by digest (partly before the shuffle, so that a text with very many copies is no hot key),
reduced to unseen digests by a sort-merge anti-join with the index, and appended. Rows then get their group by a join on
digest in which the few texts that hold more than 1 in ``HOT`` of all rows are looked up from a broadcast table; there
can be at most ``HOT`` of those, whatever the data.

Null text counts as empty. Of equal texts the row with the largest doc_id stays; a text that an earlier batch brought
keeps that batch's document. A null doc_id is the smallest. Rows that repeat both id and text are one document: all
carry the same decision. An empty table appends nothing and gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import doc_text
from casebook.session import new_path, written

HOT = 256


class DigestIndex:
    """The index of digests under a table name; ``path`` is where a new one is stored."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, n_buckets: int | None = None):
        path = path or new_path(spark, "digests")
        self.spark = spark
        self.name = name or "digests_" + path.rpartition("-")[2]
        if not spark.catalog.tableExists(self.name):
            n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, first_size BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Append the unseen texts of ``docs`` and return one row per row of ``docs``: doc_id, keep_id, group_size
        (rows of this batch with the text), kept, seen_before, digest."""
        hashed = written(doc_text(docs, doc_id, text).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "hashed")
        groups = written(hashed.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("group_size")), "groups")
        unseen = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        # what the append reads must not be what it writes
        fresh = written(unseen.select("digest", F.col("last_id").alias("keep_id"), F.col("group_size").alias("first_size")), "unseen")
        known = self.rows().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        sized = written(groups.join(known.hint("merge"), "digest", "left").select("digest", "group_size", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("last_id")).alias("keep_id"), F.coalesce("old", F.lit(False)).alias("seen_before")), "sized")
        n = int(self.spark.table(self.name).sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fresh.repartition(n, "digest").write.insertInto(self.name)
        total = hashed.count()
        hot = sized.where(F.col("group_size") * HOT > total)  # at most HOT rows, as sizes sum to the total
        frequent = hashed.join(F.broadcast(hot), "digest")
        rest = hashed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(sized, "digest")
        same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("seen_before")
        return frequent.unionByName(rest).select("doc_id", "keep_id", "group_size", same.alias("kept"), "seen_before", "digest")


def op6_sql() -> str:
    return """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
