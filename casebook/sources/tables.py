"""Reading and writing tables; every sink takes a path on whatever file system Spark has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.sources.versioned import VersionedTable


def read_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV table with header and explicit schema; only ``columns`` are parsed."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.select(*columns) if columns else df


def load_taxonomy(spark: SparkSession, config: dict) -> DataFrame:
    """``(term, kind, class, ord)`` from a configuration with ``normal_class``, ``exclude_flags``, ``classes`` and
    ``drop_terms``; classes keep their order behind the normal one."""
    rows = [(config["normal_class"], "normal", config["normal_class"], 0)]
    rows += [(t, "exclude", None, None) for t in config.get("exclude_flags", [])] + [(t, "drop", None, None) for t in config.get("drop_terms", [])]
    rows += [(t, "class", c, k) for k, (c, ts) in enumerate(config.get("classes", {}).items(), 1) for t in ts]
    return spark.createDataFrame(rows, "term string, kind string, class string, ord int")


CASE_JSON = "generated struct<findings:string,impression:string>, ground_truth struct<findings:string,impression:string>"


def read_case_json(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One JSON file per case; the uid is the file's stem. With ``packed`` the files lie in a Parquet table (path, content)
    under ``path``, a row per file: as many small files as there are cases take longer to open than to read."""
    stem = lambda name: F.regexp_extract(name, r"([^/]+)\.json$", 1).alias("study_uid")
    if packed:
        files = spark.read.schema("path string, content string").parquet(path)
        return files.select(stem(F.col("path")), F.from_json("content", CASE_JSON).alias("x")).select("study_uid", "x.generated", "x.ground_truth")
    return spark.read.schema(CASE_JSON).json(path, multiLine=True).select(stem(F.input_file_name()), "generated", "ground_truth")


def read_embeddings(spark: SparkSession, path: str, kind: str, split: str) -> DataFrame:
    """Vectors of one kind and split of a table partitioned by both."""
    return spark.read.parquet(path).where((F.col("kind") == kind) & (F.col("split") == split))


def read_clusters(clusters: DataFrame) -> DataFrame:
    """``(cluster_id, uid)`` of rows with ``;``-joined member ids."""
    return clusters.select("cluster_id", F.explode(F.split("member_uids", ";")).alias("u")).select("cluster_id", F.col("u").cast("long").alias("uid"))


def write_table(df: DataFrame, path: str, order: str, fmt: str = "parquet") -> None:
    """A sink ordered by its key: ranges of the key, sorted within."""
    writer = df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").format(fmt)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)


def write_nested_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def append_results(new: DataFrame, path: str, key: str, commit_id: str | None = None) -> int:
    """Append rows whose key is not there yet, one per key, to the versioned table under ``path``, which is made if there
    is none; returns how many. A repeated call with the same ``commit_id`` appends nothing."""
    return VersionedTable(new.sparkSession, path, key, _ddl(new)).append(new, commit_id)


def upsert_vectors(new: DataFrame, path: str, key: str, commit_id: str | None = None) -> int:
    """Put rows into the versioned collection under ``path``, in place of those with their keys; only the buckets of
    these keys are rewritten. Of rows that repeat a key the largest stays."""
    return VersionedTable(new.sparkSession, path, key, _ddl(new)).upsert(new, commit_id)


#: the tables of the case store with their keys and columns
STORE = {
    "retrieval_sessions": (("session_id",), "session_id long, patient_id long, doctor_id long, created_at timestamp"),
    "retrieved_evidence": (("session_id", "rank"), "session_id long, rank int, study_uid string, similarity double"),
    "reports": (("report_id",), "report_id long, session_id long, status string, ai_draft_content string, final_content string, validation_warnings array<string>, created_at timestamp"),
    "comparisons": (("report_id", "prior_id"), "report_id long, prior_id long, patient_id long, resolved array<string>, persistent array<string>, new array<string>, days int"),
    "explanations": (("report_id", "question"), "report_id long, question string, answer string"),
}


class CaseStore:
    """Sessions, evidence, reports, comparisons, and questions with their answers, as versioned tables under ``root``.
    Columns that the rows lack are null; those that the table lacks are left behind."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = {name: VersionedTable(spark, f"{root}/{name}", list(key), schema) for name, (key, schema) in STORE.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def add(self, name: str, rows: DataFrame, commit_id: str | None = None) -> int:
        """Append rows whose keys are new."""
        fields = self.read(name).schema
        return self.tables[name].append(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]), commit_id)

    def add_sessions(self, sessions: DataFrame, near: DataFrame, commit_id: str | None = None) -> int:
        """Sessions and their evidence (session_id, study_uid, similarity), ranked by similarity, ties by study."""
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("similarity"), "study_uid")))
        self.add("retrieved_evidence", ranked, commit_id)
        return self.add("retrieval_sessions", sessions, commit_id)  # last: a session that is there has its evidence
