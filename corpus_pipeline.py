"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with all their columns, whatever these are
called; the last one returns the packed pieces. Between stages the documents are written as Parquet and read again.

Null texts count as empty (they fail the quality rules), rows without doc_id pass the two deduplicating stages by their
text, repeated rows end as one, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import exact_dedup, fertility, ngram_join, packing, toxicity_crf
from casebook.llm.common import table
from casebook.session import written

ROW = "__row"  # a document with all its columns, out of the way of the operators' own


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []), F.struct(*[docs[c] for c in docs.columns]).alias(ROW))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the CRF's marginals call toxic."""
    rows = _whole(docs)
    crf = toxicity_crf.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity_crf.score(rows, crf, keep=(ROW,)).where("predicted = 0").select(f"{ROW}.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that fail the base rules or fall outside the fertility bands."""
    return fertility.assess(_whole(docs), keep=(ROW,)).where("kept").select(f"{ROW}.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    decided = exact_dedup.DigestIndex(spark).add(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d")).distinct()
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)).alias("digest"), F.struct(*[docs[c] for c in docs.columns]).alias(ROW))
    kept = rows.join(decided, rows["doc_id"].cast("long").eqNullSafe(decided["__id"]) & (rows["digest"] == decided["__d"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "digest"]).select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents with a Jaccard of 0.8 or more on five-word shingles keep the smallest doc_id."""
    groups = ngram_join.jaccard_components(docs, n=5, percent=80)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(stays["__id"]), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", pack),
]

#: The stages are a fitted model, tokenisers and a packing plan, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs
