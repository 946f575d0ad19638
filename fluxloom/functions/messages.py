"""What spellings of an operation, a stream name or a position denote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks.
BLANKS = " \t\r\n"


def plain(text: Column) -> Column:
    """Lower case without outer blanks (operations and stream names)."""
    return F.lower(F.btrim(text, F.lit(BLANKS)))


def position_digits(token: Column) -> Column:
    """Digits of a position token without leading zeros; null where it is no position."""
    digits = F.regexp_extract(plain(token), r"^w0*(\d+)$", 1)
    return F.when(digits != "", digits)


def position(token: Column) -> Column:
    """The number a position token stands for, null beyond a bigint."""
    return position_digits(token).try_cast("bigint")
