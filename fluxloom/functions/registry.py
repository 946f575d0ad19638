"""Functions of one's own for the SQL of a join step: aggregates and table functions in Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from fluxloom.storage import ship


def register_aggregate(spark: SparkSession, name: str, function: Callable[..., object], returns: str) -> None:
    """An aggregate: ``function`` takes the values of a group as pandas series and returns one value.

    A group is gathered in one task, so use it where groups are bounded, or over the results of built-in aggregates.
    """
    ship(spark)

    def whole(*columns: pd.Series) -> object:  # series in, one value out: an aggregate
        return function(*columns)

    spark.udf.register(name, pandas_udf(whole, returnType=returns))


def register_table_function(spark: SparkSession, name: str, function: Callable[..., object], returns: str) -> None:
    """A table function: ``function`` takes the arguments of a row and yields tuples."""
    ship(spark)

    class Rows:
        def eval(self, *args):
            yield from function(*args)

    spark.udtf.register(name, udtf(Rows, returnType=returns))
