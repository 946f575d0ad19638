"""Hierarchical rows: children embedded into their parents, level by level from the leaves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Embed:
    """A child: ``on`` maps its fields to the parent's; ``mode`` array (1:N) or object (1:1), put at dotted ``path``.

    ``array_key`` names an element within the array (of several with one key the last by ``_seq`` stays);
    ``ignore_updates`` keeps the first version of a child instead of the last.
    """

    source: str
    on: dict[str, str]
    path: str
    mode: str = "array"
    array_key: tuple[str, ...] = ()
    embed: tuple["Embed", ...] = ()
    ignore_updates: bool = False


@dataclass(frozen=True)
class Root:
    source: str
    key: tuple[str, ...] = ()
    embed: tuple[Embed, ...] = field(default=())


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """``value`` at a dotted path of the rows; missing levels are made."""
    head, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(head, value)
    if head in df.columns:
        top = F.col(head)
        parts, at = rest.split("."), df.schema[head].dataType
        for i, p in enumerate(parts[:-1]):
            if p not in at.names:
                for inner in reversed(parts[i + 1 :]):
                    value = F.struct(value.alias(inner))
                return df.withColumn(head, top.withField(".".join(parts[: i + 1]), value))
            at = at[p].dataType
        return df.withColumn(head, top.withField(rest, value))
    for part in reversed(rest.split(".")):
        value = F.struct(value.alias(part))
    return df.withColumn(head, value)


def _version(rows: DataFrame, by: Sequence[str], first: bool) -> DataFrame:
    """One row per ``by``: the last (or first) by ``_seq``."""
    cols = [c for c in rows.columns if c not in by]
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*by).agg(pick(F.struct(*cols), F.struct("_seq", *[c for c in cols if c != "_seq"])).alias("_v")).select(*by, "_v.*")


def nest(tables: dict[str, DataFrame], root: Root) -> DataFrame:
    """The root's rows with everything embedded.  Tables are states (rows with ``_seq``; it is dropped at every level).

    One shuffle per child on its join columns, partially aggregated; parents without children get an empty array or a
    null object; children without a parent appear nowhere; null join columns match nothing.
    """
    return _embedded(tables, tables[root.source], root.embed).drop("_seq")


def _embedded(tables: dict[str, DataFrame], rows: DataFrame, embeds: Sequence[Embed]) -> DataFrame:
    for e in embeds:
        child = tables[e.source]
        if "_seq" not in child.columns:
            child = child.withColumn("_seq", F.lit(0).cast("bigint"))
        on = list(e.on)
        if e.array_key:
            child = _version(child, list(dict.fromkeys([*on, *e.array_key])), e.ignore_updates)
        child = _embedded(tables, child, e.embed).where(" and ".join(f"`{c}` is not null" for c in on))
        body = F.struct(*[c for c in child.columns if c != "_seq"])
        up = [F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)]
        if e.mode == "object":
            pick = F.min_by if e.ignore_updates else F.max_by
            grouped = child.groupBy(*up).agg(pick(body, F.struct("_seq", body.alias("b"))).alias("_embedded"))
        else:
            grouped = child.groupBy(*up).agg(F.array_sort(F.collect_list(body)).alias("_embedded"))
        cond = F.lit(True)
        for i, c in enumerate(on):
            cond = cond & (rows[e.on[c]] == grouped[f"_on_{i}"])
        joined = rows.join(grouped, cond, "left").drop(*[f"_on_{i}" for i in range(len(on))])
        value = F.col("_embedded") if e.mode == "object" else F.coalesce("_embedded", F.array().cast(grouped.schema["_embedded"].dataType))
        rows = put(joined, e.path, value).drop("_embedded")
    return rows


def sql_join(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A query over the current states of its inputs, each known by its alias; Catalyst picks and orders the joins.

    The aliases live as views of their own session, so pipelines never see each other's.
    """
    from pyspark.errors import ParseException

    from fluxloom.errors import Coded

    try:
        return next(iter(tables.values())).sparkSession.sql(_inlined(sql, tables), **{f"t_{a}": d for a, d in tables.items()})
    except ParseException as e:
        raise Coded("dsl.illegal-expression", expr=sql, detail=e, path="sql") from e


def _inlined(sql: str, tables: dict[str, DataFrame]) -> str:
    """The query with each alias bound by a CTE to its DataFrame."""
    ctes = ", ".join(f"`{a}` AS (SELECT * FROM {{t_{a}}})" for a in tables)
    body = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
