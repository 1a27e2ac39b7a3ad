"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import bpe, exact_dedup, fertility, filter_audit, html_diff, lattice, line_dedup, merkle, ngram_join, packing, quality_cotrain, repair, toxicity_crf
from casebook.llm.common import table
from casebook.session import new_path


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cotrain.score(docs, quality_cotrain.fit(docs, table(spark, sf_dir, "labels")))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), then=(bpe.decoder(spark), bpe.digester), schema=bpe.DIGESTS)


def op3_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    repair.write_token_files(table(spark, sf_dir, "documents"), path)
    return repair.read_token_files(spark, path, (repair.with_crc,), "ids_crc32", "long")


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_crf.score(docs, toxicity_crf.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity_crf.held_out().alias("held_out"), "score", "predicted", "spans")


def op5_html_url_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.main_text(table(spark, sf_dir, "pages"))


def op6_exact_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.DigestIndex(spark).add(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.assess(table(spark, sf_dir, "documents"))


def op11_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("n_copied")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(filter_audit.document_flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_cotraining": op1_quality_cotraining,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_repair_token_files": op3_repair_token_files,
    "op4_toxicity_crf": op4_toxicity_crf,
    "op5_html_url_diff": op5_html_url_diff,
    "op6_exact_dedup_index": op6_exact_dedup_index,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_cutting_stock_packing": op8_cutting_stock_packing,
    "op9_line_dedup_runs": op9_line_dedup_runs,
    "op10_fertility_rules": op10_fertility_rules,
    "op11_lattice_near_dups": op11_lattice_near_dups,
    "op12_merkle_versions": op12_merkle_versions,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op6_exact_dedup_index": exact_dedup.op6_sql(), "op7_ngram_jaccard": ngram_join.op7_sql(), "op9_line_dedup_runs": line_dedup.op9_sql(), "op12_merkle_versions": merkle.op12_sql(), "op13_filter_audit": filter_audit.op13_sql()}
