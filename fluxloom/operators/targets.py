"""What reaches a target: the rows alive per key, or every event as a row; table names; ddl."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fluxloom.errors import Coded


def _key_row(events: DataFrame, keys: Sequence[str]) -> list:
    """Key columns of an event: of the row it sets, or of the row it ends."""
    before = set(events.schema["before"].dataType.names) if "before" in events.columns else set()
    return [F.when(F.col("op") == "d", F.col(f"before.`{k}`")).otherwise(F.col(f"after.`{k}`")).alias(k) if k in before else F.col(f"after.`{k}`").alias(k) for k in keys]


def steps_of(events: DataFrame, keys: Sequence[str], counted: Observation | None = None) -> DataFrame:
    """Events as (keys, ``_seq``, ``alive``, ``row``): an update that moves its key also ends the row it leaves.  ``counted``
    observes the events, as ``n``, when the steps are computed."""
    rows = events.where("op <> 'ddl'")
    at = _key_row(rows, keys)
    sets = rows.select(*at, "_seq", (F.col("op") != "d").alias("alive"), F.col("after").alias("row"))
    sets = sets if counted is None else sets.observe(counted, F.count(F.lit(1)).alias("n"))
    before = rows.schema["before"].dataType.names
    if not set(keys) <= set(before):
        return sets
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"before.`{k}`").eqNullSafe(F.col(f"after.`{k}`"))
    left = rows.where((F.col("op") == "u") & F.col("before").isNotNull() & ~same)
    ends = left.select(*[F.col(f"before.`{k}`").alias(k) for k in keys], "_seq", F.lit(False).alias("alive"), F.lit(None).cast(rows.schema["after"].dataType).alias("row"))
    return sets.unionByName(ends)


def latest(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows alive per key after all events, by the last in ``_seq``; partially aggregated, no sort.

    Replaying events changes nothing; events in any physical order give the same rows.
    """
    last = steps_of(events, keys).groupBy(*keys).agg(F.max_by(F.struct("alive", "row"), F.struct("_seq", "alive")).alias("_l"))
    return last.where("_l.alive").select("_l.row.*")


def first_images(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows alive per key after all events, each as it was first set (since it last ended, if it ever did)."""
    steps = steps_of(events, keys)
    ends = steps.where(~F.col("alive")).groupBy(*keys).agg(F.max("_seq").alias("_end")).select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], "_end")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_e{i}"))
    since = steps.where("alive").join(ends, on, "left").where("_end is null or _seq >= _end")
    return since.groupBy(*keys).agg(F.min_by("row", "_seq").alias("_r")).select("_r.*")


def append_rows(events: DataFrame) -> DataFrame:
    """Every event as an inserted row: its ``after``, else its ``before``; ddl is no row."""
    after, before = events.schema["after"].dataType, events.schema["before"].dataType
    old = F.struct(*[(F.col(f"before.`{c}`") if c in before.names else F.lit(None)).cast(after[c].dataType).alias(c) for c in after.names])
    return events.where("op <> 'ddl'").select(F.when(F.col("after").isNotNull(), F.col("after")).otherwise(old).alias("_r")).select("_r.*")


def apply_ddl_policy(events: DataFrame, policy: str = "fail") -> DataFrame:
    """fail: a ddl event fails the batch; ignore: it is dropped; apply: dropped here, the target evolves by the rows' schema."""
    if policy not in ("fail", "ignore", "apply"):
        raise Coded("dsl.illegal-value", value=policy, expected="fail, ignore, apply", path="ddl")
    if policy == "fail":
        return events.where(F.when(F.col("op") == "ddl", F.raise_error(F.lit("connector.write-failed: ddl event under policy fail")).cast("boolean")).otherwise(True))
    return events.where("op <> 'ddl'")


def segments(name: str) -> list[str]:
    """Parts of a table name: at non-alphanumerics, at a capital after a small letter, before the last capital of an acronym."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[^A-Za-z0-9]+", " ", name))
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced).split()


@dataclass(frozen=True)
class Rename:
    """Table name at the target: an explicit map wins; else case, then prefix and suffix."""

    map: dict[str, str] = field(default_factory=dict)
    case: str | None = None
    prefix: str = ""
    suffix: str = ""

    def target(self, table: str) -> str:
        if table in self.map:
            return self.map[table]
        parts = segments(table)
        name = {
            None: lambda: table, "upper": table.upper, "lower": table.lower, "pascal": lambda: "".join(p[:1].upper() + p[1:].lower() for p in parts),
            "camel": lambda: "".join(p[:1].upper() + p[1:].lower() if i else p.lower() for i, p in enumerate(parts)),
        }[self.case]()
        return f"{self.prefix}{name}{self.suffix}"

    def check(self, tables: Iterable[str], path: str = "rename") -> dict[str, str]:
        """Table -> target; no blank target, no two tables on one."""
        out: dict[str, str] = {}
        for t in tables:
            name = self.target(t)
            if not name.strip():
                raise Coded("dsl.illegal-value", value=name, expected="a table name", path=path)
            if name in out.values():
                raise Coded("dsl.illegal-value", value=name, expected="one table per target", path=path)
            out[t] = name
        return out


def push_json(events: DataFrame, format: str | dict | None = None) -> DataFrame:
    """Events as payloads: the whole envelope, one expression, or an object by field rules."""
    from fluxloom.expressions import Scope, compile_column
    from fluxloom.operators.rows import map_columns

    if format is None:
        cols = [c for c in ("op", "ts", "src", "before", "after", "schema") if c in events.columns]
        return events.select(F.to_json(F.struct(*cols)).alias("payload"))
    scope = Scope.envelope(events.schema)
    if isinstance(format, str):
        value = compile_column(format.removeprefix("="), scope)
        return events.select(F.to_json(F.struct(value.alias("v"))).alias("j")).select(F.get_json_object("j", "$.v").alias("payload"))
    row = events.schema["after"].dataType
    made = [c for c in map_columns(format, row, "after", scope)][: sum(1 for r in format.values() if r is not False)]
    return events.select(F.to_json(F.struct(*made)).alias("payload"))
