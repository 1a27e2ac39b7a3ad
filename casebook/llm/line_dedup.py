"""Line deduplication against levelled sorted runs of line hashes. DataFrame functions only.

Seen lines are kept as runs: Parquet tables sorted by hash, each hash in one run only, with the document that brought
it first. A new batch of documents is merge-joined with the runs; hashes found there are repeats of earlier documents,
the others become a new run of level 0. When a level holds ``fanout`` runs they are merged into one run of the next
level, so a batch meets few runs and a hash is rewritten only as often as there are levels.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased; its hash is the
128-bit MD5. Keys below ``min_chars`` code points are left alone. A key of two or more documents stays in the one that
brought it first (the smallest doc_id of its batch; batches in ascending order make that the smallest of all) and goes
from the others. Aggregation by hash is partial before the shuffle, and joins on hash are sort-merge joins between two
shuffles, which Spark splits where a line is very frequent; a line repeated within a document counts once there.

Null or empty text is one empty line. Rows without doc_id keep all lines and count as no document. Rows that share a
doc_id are one document. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.common import doc_text
from casebook.session import new_path, remove, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def hash_of(line: Column, min_chars: int) -> Column:
    key = key_of(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


@dataclass
class LineRuns:
    """The runs of lines seen so far; ``levels[k]`` lists the paths of level k."""

    spark: SparkSession
    min_chars: int = 10
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)

    def seen(self) -> DataFrame:
        """``(h, first_id)`` of all runs."""
        runs = [self.spark.read.schema("h binary, first_id long").parquet(p) for level in self.levels for p in level]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], "h binary, first_id long")

    def _put(self, level: int, rows: DataFrame) -> None:
        path = new_path(self.spark, f"run{level}")
        rows.repartition("h").sortWithinPartitions("h").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def compact(self) -> None:
        """Merge every level that holds ``fanout`` runs into one run of the next level."""
        for level in range(len(self.levels)):
            if len(old := self.levels[level]) >= self.fanout:
                merged = reduce(DataFrame.unionByName, [self.spark.read.schema("h binary, first_id long").parquet(p) for p in old])
                self._put(level + 1, merged)
                self.levels[level] = []
                for p in old:
                    remove(self.spark, p)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``(doc_id, n_lines, n_dropped, kept_text)`` of a batch; its unseen lines become a run."""
        rows = doc_text(docs, doc_id, text)
        lines = rows.select("doc_id", F.split("text", "\n", -1).alias("lines"))
        hashes = F.array_distinct(F.filter(F.transform("lines", lambda x: hash_of(x, self.min_chars)), lambda h: h.isNotNull()))
        keys = written(lines.where("doc_id IS NOT NULL").select("doc_id", F.explode(hashes).alias("h")), "line-keys")
        batch = keys.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        # one pass over the runs: every hash of the batch with the document that brought it before, if any
        matched = written(batch.join(self.seen().hint("merge"), "h", "left"), "line-match")
        self._put(0, matched.where("first_id IS NULL").select("h", F.col("low").alias("first_id")))
        repeated = matched.where("first_id IS NOT NULL OR low <> high").select("h", F.coalesce("first_id", "low").alias("keep"))
        gone = keys.join(repeated.hint("merge"), "h").where("doc_id <> keep").groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
        gone = written(gone, "line-gone")
        self.compact()
        both = lines.join(gone.hint("merge"), "doc_id", "left")
        kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("gone"), hash_of(x, self.min_chars)), F.lit(False)))
        kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept)
        return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"), "lines").select(
            "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")
        )


def dedup_lines(docs: DataFrame, n_batches: int = 4, min_chars: int = 10, fanout: int = 3) -> DataFrame:
    """The whole table in ``n_batches`` batches of ascending doc_id (cut at approximate quantiles)."""
    runs = LineRuns(docs.sparkSession, min_chars, fanout)
    ids = docs.select(F.col("doc_id").cast("double").alias("d")).where("d IS NOT NULL")
    cuts = [] if n_batches < 2 or ids.isEmpty() else ids.approxQuantile("d", [k / n_batches for k in range(1, n_batches)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        above = F.lit(True) if low is None else F.col("doc_id") > int(low)
        below = F.lit(True) if high is None else F.col("doc_id") <= int(high)
        wanted = above & below if low is not None else (above & below) | F.col("doc_id").isNull()
        parts.append(runs.add(docs.where(wanted)))
    return reduce(DataFrame.unionByName, parts)


def op9_sql() -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {white}), '{UPPER}', '{LOWER}') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> keep, false) AS gone FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
