"""Compressed bitmaps over whole numbers, as tables of their nonzero 64-bit words.

A number is addressed by its word and its bit inside it.  A set of numbers is a
table with one row (``word``, ``bits``) per occupied word: numbers in a row share
words, a number on its own costs one row.  Sets are united by ``bit_or``, on
fixed-length values, so the aggregates stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_of(number: Column) -> Column:
    """Word of a whole number; negative numbers have words of their own."""
    return F.shiftright(number.cast("bigint"), 6)


def mask_of(number: Column) -> Column:
    """The number's bit inside its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number.cast("bigint").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def is_set(bits: Column, number: Column) -> Column:
    """Whether the number's bit is set in its word; false where there is no word."""
    return F.coalesce(bits.bitwiseAND(mask_of(number)) != 0, F.lit(False))


def words(df: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """(``keys``, ``word``, ``bits``): the set of numbers of every group of keys."""
    return df.groupBy(*keys, word_of(number).alias("word")).agg(F.bit_or(mask_of(number)).alias("bits"))


def united(df: DataFrame, keys: list[str]) -> DataFrame:
    """The union of bitmaps that lie in one table."""
    return df.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def numbers(word: Column, bits: Column) -> Column:
    """The numbers of a word, as an array."""
    every = F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")
    return F.transform(F.filter(every, lambda b: bits.bitwiseAND(mask_of(b)) != 0), lambda b: word * 64 + b)
