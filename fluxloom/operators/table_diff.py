"""Differences between two copies of a dataset, field by field.

Both sides are brought to one normal form (one row per key, normalised fields,
all as text), the rows both have are removed by EXCEPT ALL in both directions,
and only the residues are joined by key.  The work after the two set
differences grows with the differences, not with the tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.storage import materialize


def number_text(value: Column) -> Column:
    """Canonical text of a number however it is written, of any length; empty is null; what is no number keeps its text, marked.

    Numbers a decimal(38,12) holds go that way; of others the digits themselves are brought to one form.
    """
    trimmed = F.btrim(value.cast("string"), F.lit(" \t\r\n"))
    number, point = trimmed.try_cast("decimal(38,12)"), F.instr(trimmed, ".")
    # without an exponent and with at most twelve digits behind the point nothing was rounded
    exact = number.isNotNull() & ((point == 0) | (F.length(trimmed) - point <= 12)) & ~trimmed.contains("e") & ~trimmed.contains("E")
    usual = F.when(number == 0, "0").otherwise(F.rtrim(F.rtrim(number.cast("string"), F.lit("0")), F.lit(".")))
    return (
        F.when(trimmed == "", F.lit(None)).when(exact, usual)
        .when(F.rlike(trimmed, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,9})?$")), _digits(trimmed)).otherwise(F.concat(F.lit("text:"), trimmed))
    )


def _digits(number: Column) -> Column:
    """A written number in plain notation, or, where that would be longer than 400 places, as its digits and the place of the point."""
    part = lambda i: F.regexp_extract(number, r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", i)
    whole, every = part(2), F.concat(part(2), part(3))
    core = F.ltrim(every, F.lit("0"))
    point = F.length(whole) - (F.length(every) - F.length(core)) + F.coalesce(part(4).try_cast("int"), F.lit(0))  # 0.core times ten to this
    core = F.rtrim(core, F.lit("0"))
    size = F.length(core)
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), core)).when(point >= size, F.concat(core, F.repeat(F.lit("0"), point - size))).otherwise(
        F.concat(F.substring(core, F.lit(1), point), F.lit("."), F.substring(core, point + 1, size))
    )
    text = F.when(F.abs(point) <= 400, plain).otherwise(F.concat(core, F.lit("@"), point.cast("string")))
    return F.when(core == "", "0").otherwise(F.concat(F.when(part(1) == "-", "-").otherwise(""), text))


def text_value(value: Column) -> Column:
    """Text without trailing blanks, otherwise untouched."""
    return F.rtrim(value.cast("string"))


def key_number(value: Column) -> Column:
    """A key written as text or number, as a bigint; null where it is none (see ``unkeyed``)."""
    text = F.btrim(value.cast("string"), F.lit(" \t\r\n"))
    written = number_text(value)
    return F.coalesce(text.try_cast("bigint"), F.when(F.rlike(written, F.lit(r"^-?\d{1,19}$")), written.try_cast("bigint")))


def unkeyed(df: DataFrame, key: Column) -> DataFrame:
    """(``key_text``, ``n``): the rows that have no key and so no counterpart, by what stands in its place."""
    return df.where(key_number(key).isNull()).groupBy(key.cast("string").alias("key_text")).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: Column, newest: Column, fields: Mapping[str, Column]) -> DataFrame:
    """One row (``id`` and the fields) per key, the one with the greatest ``newest``; rows without a key are left out
    (``unkeyed`` reports them).

    Partially aggregated, so a key that holds most of the rows costs a task one row.  A null ``newest`` is older than any other.
    """
    image = F.struct(*[c.alias(n) for n, c in fields.items()])
    order = F.struct(newest.isNotNull().alias("known"), newest.alias("at"), image.alias("image"))
    last = df.select(key.alias("id"), image.alias("image"), order.alias("order")).where("id is not null").groupBy("id").agg(F.max_by("image", "order").alias("image"))
    return last.select("id", "image.*")


def differences(source: DataFrame, target: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (``id``, ``diff_kind``, ``field_name``) between two normalised sides with unique ``id``.

    Null equals null and nothing else.  Two empty sides give no rows.
    """
    cols = ["id", *fields]
    source, target = materialize(source.select(*cols), "diff-source"), materialize(target.select(*cols), "diff-target")
    left = source.exceptAll(target).select("id", F.lit(True).alias("in_s"), *[F.col(c).alias(f"s_{c}") for c in fields])
    right = target.exceptAll(source).select("id", F.lit(True).alias("in_t"), *[F.col(c).alias(f"t_{c}") for c in fields])
    both = left.join(right, "id", "full")
    case = lambda kind, field: F.struct(F.lit(kind).alias("diff_kind"), F.lit(field).alias("field_name"))
    unequal = F.filter(F.array(*[F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), case("differs", c)) for c in fields]), lambda x: x.isNotNull())
    cases = F.when(F.col("in_t").isNull(), F.array(case("missing_in_target", "row"))).when(F.col("in_s").isNull(), F.array(case("missing_in_source", "row"))).otherwise(unequal)
    return both.select("id", F.explode(cases).alias("case")).select("id", "case.*")
