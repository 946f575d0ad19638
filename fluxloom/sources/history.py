"""Schema history of the streams of a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def schema_history(ddl: DataFrame, keys: Sequence[str], pos: str = "pos", arrival: str = "delivery_id", schema: str = "schema") -> DataFrame:
    """(``keys``, ``version``, ``since``, ``fields``): the versions of every stream's schema, numbered from 1.

    ``ddl``: the schema events alone (they are few beside the rows).  Of an event that was delivered more than once the
    first copy counts; events follow each other by position; one that repeats the schema before it makes no version.
    ``fields`` is the schema as text, name and type in order of name.  Events without a schema or a position are left out.
    """
    keys = list(keys)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(schema)), lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("null")))), ", ")
    once = ddl.where(F.col(schema).isNotNull() & F.col(pos).isNotNull()).groupBy(*keys, pos).agg(F.min_by(text, arrival).alias("fields"))
    w = Window.partitionBy(*keys).orderBy(pos)
    new = once.where(F.col("fields").isNotNull()).withColumn("_before", F.lag("fields").over(w)).where(~F.col("_before").eqNullSafe(F.col("fields")))
    return new.select(*keys, F.row_number().over(w).alias("version"), F.col(pos).alias("since"), "fields")
