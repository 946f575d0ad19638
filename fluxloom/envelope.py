"""Change events, the one row type that flows through a pipeline.

Columns: ``op`` (r, i, u, d, ddl), ``ts`` (epoch ms; data, never an order), ``src`` (logical table), ``before`` and
``after`` (rows), ``schema`` (name -> type, on ddl), ``src_pos`` (opaque position, null on r), and ``_seq``, the total
order that arrival has in a single lane.  i and r carry only ``after``, d only ``before``, u both, ddl only ``schema``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("r", "i", "u", "d", "ddl")
COLUMNS = ["op", "ts", "src", "before", "after", "schema", "src_pos", "_seq"]
SCHEMA_MAP = "map<string,string>"


def null_row(schema: T.StructType) -> Column:
    return F.lit(None).cast(schema)


def snapshot_of(df: DataFrame, src: str, ts: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Rows as snapshot events; they precede every change (``_seq`` at most 0 unless the caller orders them)."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(
        F.lit("r").alias("op"), (ts if ts is not None else F.lit(0)).cast("bigint").alias("ts"), F.lit(src).alias("src"), null_row(df.schema).alias("before"), row.alias("after"),
        F.lit(None).cast(SCHEMA_MAP).alias("schema"), F.lit(None).cast("string").alias("src_pos"), (seq if seq is not None else F.lit(0)).cast("bigint").alias("_seq"),
    )


def changes_of(df: DataFrame, seq: Column, op: Column | str = "op", ts: Column | str = "ts", src: Column | str = "src", before: str = "before", after: str = "after", schema: str | None = None, src_pos: Column | str | None = None) -> DataFrame:
    """A change log as events: images an operation must not have are dropped, so downstream steps may rely on the shape."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    o = F.lower(F.btrim(col(op)))
    return df.select(
        o.alias("op"), F.coalesce(col(ts).cast("bigint"), F.lit(0)).cast("bigint").alias("ts"), col(src).alias("src"),
        F.when(o.isin("u", "d"), F.col(before)).alias("before"), F.when(o.isin("r", "i", "u"), F.col(after)).alias("after"),
        (F.when(o == "ddl", F.col(schema)) if schema else F.lit(None).cast(SCHEMA_MAP)).alias("schema"),
        F.when(o != "r", col(src_pos)).cast("string").alias("src_pos") if src_pos is not None else F.lit(None).cast("string").alias("src_pos"),
        seq.cast("bigint").alias("_seq"),
    )


def change_log_from(df: DataFrame, key: Sequence[str], order: Sequence[str], src: str, deletes: Column, ts: Column) -> DataFrame:
    """A change log out of successive states of keyed rows: first i, then u with the state before, d where ``deletes``
    holds (and i again after it)."""
    w = Window.partitionBy(*key).orderBy(*order)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    marked = df.select(row.alias("_row"), deletes.alias("_d"), F.lag(row).over(w).alias("_prev"), F.lag(deletes).over(w).alias("_pd"), F.struct(*[F.col(c) for c in order]).alias("_order"), ts.alias("_ts"))
    op = F.when(F.col("_d"), "d").when(F.col("_prev").isNull() | F.col("_pd"), "i").otherwise("u")
    return marked.withColumn("op", op).select(
        "op", F.col("_ts").cast("bigint").alias("ts"), F.lit(src).alias("src"), F.when(F.col("op") == "d", F.col("_row")).when(F.col("op") == "u", F.col("_prev")).alias("before"),
        F.when(F.col("op") != "d", F.col("_row")).alias("after"), F.lit(None).cast(SCHEMA_MAP).alias("schema"), F.lit(None).cast("string").alias("src_pos"), "_order",
    )
