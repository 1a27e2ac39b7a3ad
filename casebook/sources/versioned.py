"""Tables with versions on any file system of Spark's: keyed upserts and appends that rewrite little and count once.

Rows are dealt into a fixed number of buckets by a hash of their key. A commit writes new files beside the old ones, for
the buckets it touches alone, and last a small manifest that names the live folders of every bucket. Manifests are
numbered and made only where no other has the number, so of two writers one starts over from the other's result; a
manifest that was not written to its end is passed over, so a crash before that leaves the version before. Commits carry
an id: one that a manifest knows already, which is one of the last ``COMMITS_KEPT``, is not made again.

Nulls in keys equal each other. Of rows of one commit that repeat a key the largest stays, in the order of the columns.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.session import remove, written

BUCKET = "__bucket"
COMMITS_KEPT = 10_000


class VersionedTable:
    """The table under ``path``, keyed by ``key``. ``schema`` and ``n_buckets`` hold for a new one; a table that exists
    keeps its own."""

    def __init__(self, spark: SparkSession, path: str, key: list[str] | str, schema: str | None = None, n_buckets: int = 16):
        self.spark, self.path, self.key = spark, path.rstrip("/"), [key] if isinstance(key, str) else list(key)
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._numbers():
            if schema is None:
                raise ValueError(f"no table at {path}, and no schema to make one")
            self._write({"version": 0, "schema": schema, "n_buckets": n_buckets, "commits": [], "live": {}})

    # ------------------------------------------------------------ manifests

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}.json"

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._fs_path(f"{self.path}/manifest-*.json"))
        return sorted(int(x.getPath().getName()[9:-5]) for x in found) if found else []

    def _read(self, version: int) -> dict | None:
        stream = self._fs.open(self._fs_path(self._manifest_path(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # not written to its end
            return None

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or the newest whole one."""
        for v in [version] if version is not None else reversed(self._numbers()):
            if (m := self._read(v)) is not None:
                return m
        raise ValueError(f"no version {version} of {self.path}")

    def _write(self, manifest: dict) -> bool:
        """Put a manifest in place; false if its number is taken."""
        target = self._fs_path(self._manifest_path(manifest["version"]))
        if self._fs.exists(target):
            return False
        try:
            out = self._fs.create(target, False)
        except Exception as e:  # the other writer was faster
            if self._fs.exists(target):
                return False
            raise e
        out.writeBytes(json.dumps(manifest))
        out.close()
        return True

    # ------------------------------------------------------------ reading

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        live = manifest["live"]
        folders = [f"{self.path}/{d}" for b in (live if buckets is None else map(str, buckets)) for d in live.get(b, [])]
        if not folders:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    # ------------------------------------------------------------ writing

    def _bucketed(self, rows: DataFrame, manifest: dict) -> DataFrame:
        names = self.spark.createDataFrame([], manifest["schema"]).columns
        return rows.select(*names, F.pmod(F.xxhash64(*self.key), F.lit(manifest["n_buckets"])).cast("int").alias(BUCKET))

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        """Of rows that repeat a key, the largest in the order of the columns; partly aggregated before the shuffle."""
        whole = F.max(F.struct(*[c for c in rows.columns if c not in (*self.key, BUCKET)], F.lit(0).alias("__"))).alias("__row")
        return rows.groupBy(*self.key, BUCKET).agg(whole).select(*[F.col(c) if c in (*self.key, BUCKET) else F.col(f"__row.{c}").alias(c) for c in rows.columns])

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows whose key no row of ``others`` has."""
        keys = others.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)])
        same = [rows[k].eqNullSafe(keys[f"__k{i}"]) for i, k in enumerate(self.key)]
        return rows.join(keys, same, "left_anti")

    def _put(self, rows: DataFrame, folder: str) -> list[int]:
        """Write bucketed rows; which buckets have any."""
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        found = self._fs.globStatus(self._fs_path(f"{self.path}/{folder}/{BUCKET}=*"))
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in found) if found else []

    def _commit(self, rows: DataFrame, commit_id: str | None, replace: bool) -> int:
        commit_id = commit_id or uuid.uuid4().hex
        staged = None
        while True:
            base = self.manifest()
            if commit_id in base["commits"]:
                return 0
            if staged is None:
                staged = written(self._one_per_key(self._bucketed(rows, base)), "commit")
                touched = [r[0] for r in staged.select(BUCKET).distinct().collect()]  # at most n_buckets numbers
            old, folder = self._bucketed(self._rows(base, touched), base), f"data/{commit_id}-{uuid.uuid4().hex[:8]}"
            if replace:
                n, put = staged.count(), staged.unionByName(self._without(old, staged))
            else:
                put = written(self._without(staged, old), "fresh")
                n = put.count()
            live = {b: list(d) for b, d in base["live"].items()}
            for b in self._put(put, folder):
                live[str(b)] = [f"{folder}/{BUCKET}={b}"] if replace else [*live.get(str(b), []), f"{folder}/{BUCKET}={b}"]
            number = max(self._numbers()) + 1 if self._read(max(self._numbers())) is None else base["version"] + 1
            if self._write(base | {"version": number, "commits": [*base["commits"], commit_id][-COMMITS_KEPT:], "live": live}):
                return n
            remove(self.spark, f"{self.path}/{folder}")  # another writer was first: start over from its version

    def upsert(self, rows: DataFrame, commit_id: str | None = None) -> int:
        """Put rows in, in place of those with their keys; returns how many. Only touched buckets are rewritten."""
        return self._commit(rows, commit_id, True)

    def append(self, rows: DataFrame, commit_id: str | None = None) -> int:
        """Add the rows whose keys are not there yet; returns how many."""
        return self._commit(rows, commit_id, False)

    def vacuum(self, keep: int = 1) -> None:
        """Drop all versions but the newest ``keep`` whole ones, and the folders that only those named."""
        whole = [m for v in self._numbers() if (m := self._read(v)) is not None]
        gone, stay = whole[:-keep], whole[-keep:]
        used = {d for m in stay for ds in m["live"].values() for d in ds}
        for folder in {d for m in gone for ds in m["live"].values() for d in ds} - used:
            remove(self.spark, f"{self.path}/{folder}")
        for m in gone:
            remove(self.spark, self._manifest_path(m["version"]))
