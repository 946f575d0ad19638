"""Table selection, row filters on source columns, read modes and start positions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.errors import Coded
from fluxloom.expressions import ExpressionError, Scope, compile_predicate
from fluxloom.expressions.compiler import failing

READ_MODES = ("snapshot_and_cdc", "cdc_only", "snapshot_only")


@dataclass(frozen=True)
class TableSpec:
    """A selected table with what its own entry adds."""

    name: str
    filter: str | None = None
    pk: tuple[str, ...] = ()


def is_pattern(text: str) -> bool:
    return len(text) >= 2 and text[0] == text[-1] == "/"


def pattern(text: str, code: str) -> re.Pattern:
    try:
        return re.compile(text[1:-1])
    except re.error as e:
        raise Coded(code, regex=text, detail=e) from e


def table_specs(selectors: Sequence[str | dict] | None, discovered: Sequence[str] | None) -> list[TableSpec]:
    """Selected tables in order of selection, each once.  No selector: all that were discovered; ``/regex/`` matches
    whole names; a literal must have been discovered."""
    if discovered is None:
        raise Coded("actuation.source-schema-not-discovered")
    out: dict[str, TableSpec] = {}
    for s in discovered if selectors is None else selectors:
        entry = s if isinstance(s, dict) else {"name": s}
        name = entry["name"]
        if is_pattern(name):
            rx = pattern(name, "actuation.source-table-regex-invalid")
            found = [t for t in discovered if rx.fullmatch(t)]
        elif name in discovered:
            found = [name]
        else:
            raise Coded("actuation.source-table-not-discovered", table=name)
        pk = entry.get("pk") or ()
        for t in found:
            out.setdefault(t, TableSpec(t, entry.get("filter"), (pk,) if isinstance(pk, str) else tuple(pk)))
    if not out:
        raise Coded("actuation.source-table-selection-empty")
    return list(out.values())


def select_tables(selectors: Sequence[str | dict] | None, discovered: Sequence[str] | None) -> list[str]:
    return [t.name for t in table_specs(selectors, discovered)]


def declared(df: DataFrame, required: Sequence[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A table under its discovered model: columns that are NOT NULL (default: all) and logical types that differ from
    the stored ones.  Comparisons of required columns cannot fail, so they stay plain and reach the scan."""
    marks = {c: {"required": True} for c in (df.columns if required is None else required)}
    for c, t in (types or {}).items():
        marks[c] = {**marks.get(c, {}), "type": t}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=marks[c]) if c in marks else F.col(f"`{c}`") for c in df.columns])


def filter_table(df: DataFrame, expr: str) -> DataFrame:
    """A source's own row filter, over its columns directly."""
    try:
        cond, err = compile_predicate(expr, Scope(columns=df.schema))
    except ExpressionError as e:
        raise Coded(f"dsl.{e.kind}", expr=expr, detail=e, **e.args_) from e
    return df.where(failing(expr, cond, err))


def start_from(tail: DataFrame, start: str = "earliest") -> DataFrame:
    """The tail from a position: all of it, none of what is there, or everything from the first change at or after an instant."""
    if start == "earliest":
        return tail
    if start == "latest":
        return tail.where(F.lit(False))
    if not re.fullmatch(r"\d{4}-\d\d-\d\d([Tt]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:\d\d)?)?", start):
        raise Coded("capture.start-from-unparsable", value=start)
    at = F.unix_millis(F.lit(start).cast("timestamp"))
    first = tail.where(F.col("ts") >= at).agg(F.min("_seq").alias("_first"))
    return tail.join(F.broadcast(first), F.col("_seq") >= F.col("_first")).drop("_first")  # one row


@dataclass(frozen=True)
class Consumption:
    """What a pipeline reads of a source: a snapshot, a tail, and whether through the shared change log."""

    snapshot: bool
    tail: bool
    shared: bool


def consumption(read_mode: str = "snapshot_and_cdc", srs_enabled: bool = True) -> Consumption:
    if read_mode not in READ_MODES:
        raise Coded("dsl.illegal-value", value=read_mode, expected=", ".join(READ_MODES), path="settings.read_mode")
    tail = read_mode != "snapshot_only"
    return Consumption(read_mode != "cdc_only", tail, tail and srs_enabled)


def read_source(snapshot: DataFrame | None, tail: DataFrame | None, start: str = "earliest") -> DataFrame:
    """Events of one table: the snapshot, which precedes every change, and the tail from its start position on."""
    from fluxloom.operators.rows import union_rows

    return union_rows(*[x for x in (snapshot, None if tail is None else start_from(tail, start)) if x is not None])


def only_selected(events: DataFrame, tables: Sequence[str]) -> DataFrame:
    """An event of a table that was not selected fails the run."""
    known = F.col("src").isin(list(tables))
    return events.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("capture.event-table-not-selected: "), F.coalesce("src", F.lit("null")))).cast("boolean")))
