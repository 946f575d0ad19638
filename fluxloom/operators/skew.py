"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def salted(df: DataFrame, by: Column, salts: int, name: str = "_salt") -> DataFrame:
    """``df`` with its rows scattered over ``salts`` sub-keys by a hash of ``by``."""
    return df.withColumn(name, F.pmod(F.hash(by), F.lit(salts)))


def replicated(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """``df`` once for every sub-key, the other side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


#: Measured bytes up to which the other side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: 16 bytes a column, and the length of what has no fixed one."""
    open_ended = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    size = F.lit(16 * len(df.columns)).cast("bigint")
    for c in [*open_ended, *nested]:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return size


class Narrow:
    """The other side of joins where one key may hold a large share of the rows.

    It is measured once (give it materialized).  Up to ``most`` bytes it is broadcast and the left side stays where it
    is; beyond, the left side is scattered over sub-keys by a hash of a column, this side is replicated, and both are
    sorted and merged, so neither size nor skew matters.  There are as many sub-keys as the left side would have
    shuffle partitions, so the part of a hot key that meets one task falls as the cluster grows.
    """

    def __init__(self, right: DataFrame, keys: list[str], by: Column, most: int = BROADCAST_BYTES, salts: int | None = None):
        self.right, self.keys, self.by = right, keys, by
        self.salts = salts or max(2, min(64, int(right.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
        self.bytes = right.agg(F.sum(row_bytes(right))).first()[0] or 0
        self.small = self.bytes <= most

    def join(self, left: DataFrame, how: str = "inner") -> DataFrame:
        if self.small:
            return left.join(F.broadcast(self.right), self.keys, how)
        return salted(left, self.by, self.salts).join(replicated(self.right, self.salts).hint("merge"), [*self.keys, "_salt"], how).drop("_salt")

    def left(self, left: DataFrame) -> DataFrame:
        """All rows of the left side, with nulls where this side has no match."""
        return self.join(left, "left")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], by: Column, salts: int | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join with a ``right`` of narrow rows, as ``Narrow`` does it."""
    return Narrow(right, keys, by, most, salts).join(left)
