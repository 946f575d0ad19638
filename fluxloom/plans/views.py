"""Materialised views: storage tiers and schema policy."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from fluxloom.errors import Coded


def store(rows: DataFrame, name: str, storage: dict | None, root: str) -> DataFrame:
    """A view's rows in the tiers it asks for, and as temp view ``name``: what a pull surface reads.

    hot: kept in executors' memory and disk; warm: a table under its collection; cold: a table partitioned by columns.
    """
    storage = storage or {}
    spark = rows.sparkSession
    if storage.get("warm") is not None:
        path = f"{root}/{(storage['warm'] or {}).get('collection') or name}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
    if storage.get("cold") is not None:
        by = (storage["cold"] or {}).get("partition_by") or []
        by = [by] if isinstance(by, str) else by
        missing = [c for c in by if c not in rows.columns]
        if missing:
            raise Coded("dsl.illegal-value", value=missing[0], expected="a column of the view", path="view.storage.cold.partition_by")
        # one task per partition value would make as many small files as tasks; gather each value first
        (rows.repartition(*by) if by else rows).write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{name}.cold")
    if storage.get("hot") is not None:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.createOrReplaceTempView(name)
    return rows


def evolve(old: DataFrame, new: DataFrame, schema: dict | None) -> DataFrame:
    """Rows of a view under its schema policy: enforced, a change of columns is an error; additive, new ones are added."""
    schema = schema or {}
    if schema.get("enforce") in (True, "true", "strict") and set(old.columns) != set(new.columns):
        raise Coded("connector.write-failed", detail=f"columns changed: {sorted(set(old.columns) ^ set(new.columns))}")
    if schema.get("evolution") == "additive" and not set(old.columns) <= set(new.columns):
        raise Coded("connector.write-failed", detail=f"columns gone: {sorted(set(old.columns) - set(new.columns))}")
    return old.unionByName(new, allowMissingColumns=True)
