"""Row numbers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.session import written


def numbered(rows: DataFrame, name: str, order: str, group: list[str] | None = None) -> DataFrame:
    """``rows`` with the place of each, from 0, in the order of ``order`` within ``group`` (within all rows if none).

    Ranges of (group, order) are numbered by themselves and moved on by the sizes of the ranges before them, so a group of
    any size spreads over many tasks. Ties of ``order`` are numbered in any order."""
    group = group or []
    ranged = written(rows.repartitionByRange(*[F.col(g) for g in group], F.col(order)).withColumn("__p", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p", *group).orderBy(order)) - 1)
    sizes = ranged.groupBy("__p", *group).agg(F.count("*").alias("__c"))  # a row per range and group in it
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], before.alias("__o"))
    same = local["__p"] == offsets["__p"]
    for i, g in enumerate(group):
        same = same & local[g].eqNullSafe(offsets[f"__g{i}"])
    return local.join(offsets, same).select(*rows.columns, (F.col("__r") + F.col("__o")).cast("long").alias(name))


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, name)``: distinct keys numbered 0, 1, ... in their order."""
    return numbered(keys.select(key), name, key)
