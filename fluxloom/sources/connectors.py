"""What connectors can do: modes, sinks, configuration; and the identity of a shared change log."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.errors import Coded


@dataclass(frozen=True)
class Field:
    """A configuration field: its type, its choices, whether and when it must be set."""

    type: str = "string"
    choices: tuple[str, ...] = ()
    required: bool = False
    default: object = None
    visible: tuple[str, tuple[str, ...]] | None = None  # (controlling field, its values)


@dataclass(frozen=True)
class Connector:
    """``capabilities`` as a connector describes itself; modes and sinks follow from them unless they are declared."""

    capabilities: frozenset[str] = frozenset()
    declared: tuple[str, ...] | None = None
    database: bool = False
    config: dict[str, Field] = field(default_factory=dict)
    format: str | None = None  # Spark reader

    @property
    def modes(self) -> tuple[str, ...]:
        if self.declared is not None:
            return self.declared
        return tuple(m for c, m in (("batch_read", "snapshot"), ("stream_read", "cdc")) if c in self.capabilities)

    @property
    def sinks(self) -> tuple[str, ...]:
        """Write modes: none unless it is writable; append always; upsert unless it names policies without an update."""
        if "write" not in self.capabilities:
            return ()
        named = {c for c in self.capabilities if "_on_" in c}
        return ("append", "upsert") if not named or "update_on_exists" in named else ("append",)


_DB = frozenset({"batch_read", "stream_read", "write", "update_on_exists", "ignore_on_exists"})
#: Connectors that Spark or this package serves.  Unknown names are left to the place that runs them.
REGISTRY: dict[str, Connector] = {
    **{n: Connector(_DB, database=True, format="jdbc") for n in ("postgres", "oracle", "sqlserver", "db2")},
    "mysql": Connector(_DB, database=True, format="jdbc", config={
        "deploymentMode": Field(choices=("standalone", "master-slave"), default="standalone"), "host": Field(), "port": Field("number"),
        "masterSlaveAddress": Field("array", visible=("deploymentMode", ("master-slave",))), "database": Field(), "username": Field(), "password": Field(),
    }),
    "mongodb": Connector(_DB, database=True), "kafka": Connector(frozenset({"stream_read", "write"}), ("stream",), format="kafka"),
    **{n: Connector(frozenset({"batch_read", "stream_read", "write"}), format=n) for n in ("csv", "json", "parquet", "orc", "text", "xml")},
    "elasticsearch": Connector(frozenset({"write"})), "quickapi": Connector(frozenset({"batch_read"}), ("api",)),
}


def _fits(kind: str, value: object) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, {"boolean": bool, "array": list, "object": dict}.get(kind, str)) if kind != "string" else not isinstance(value, (dict, list))


def check_source(body: dict, complete: bool = False) -> None:
    """Mode and configuration of a source against its connector; ``complete`` also asks for required fields."""
    name = body.get("connector")
    c = REGISTRY.get(name)
    if c is None:
        return
    mode = body.get("mode")
    if mode is not None and c.modes and (c.database or c.declared is not None) and mode not in c.modes:
        raise Coded("dsl.unsupported-mode", connector=name, mode=mode, allowed=", ".join(c.modes), path="mode")
    config = body.get("config") or {}
    opaque = lambda v: isinstance(v, str) and "${" in v
    for key, value in config.items():
        f = c.config.get(key)
        if f is None or opaque(value):
            continue
        if not _fits(f.type, value):
            raise Coded("dsl.config-type-mismatch", connector=name, field=key, expected=f.type, path=f"config.{key}")
        if f.choices and value not in f.choices:
            raise Coded("dsl.invalid-config-value", connector=name, field=key, value=value, allowed=", ".join(f.choices), path=f"config.{key}")
    if complete:
        for key, f in c.config.items():
            seen = f.visible is None or str(config.get(f.visible[0], c.config[f.visible[0]].default)) in f.visible[1]
            if f.required and seen and f.default is None and config.get(key) is None:
                raise Coded("dsl.config-required", connector=name, field=key, path=f"config.{key}")


def check_sink(connector: str, write_mode: str, path: str) -> None:
    c = REGISTRY.get(connector)
    if c is not None and write_mode not in c.sinks:
        raise Coded("dsl.unsupported-mode", connector=connector, mode=write_mode, allowed=", ".join(c.sinks), path=path)


def chain_id(source: dict) -> str:
    """Identity of the change log a source shares: its explicit key, else connector and settings, whatever its tables."""
    key = (source.get("srs") or {}).get("key")
    if key:
        return f"key-{key}"
    same = json.dumps({"connector": source.get("connector"), "config": source.get("config") or {}}, sort_keys=True, default=str)
    return "mc-" + hashlib.sha256(same.encode()).hexdigest()[:16]


class SharedLogs:
    """Which pipelines read which change log, and what each has acknowledged: a pipeline that is given it attaches when it
    runs, acknowledges every micro-batch its targets hold, and detaches when it is stopped."""

    def __init__(self):
        self.tables: dict[str, set[str]] = {}
        self.consumers: dict[str, dict[str, int | None]] = {}

    def attach(self, chain: str, pipeline: str, tables: Iterable[str]) -> set[str]:
        """Join a chain; its tables are the union of what its consumers read."""
        self.tables.setdefault(chain, set()).update(tables)
        self.consumers.setdefault(chain, {}).setdefault(pipeline, None)
        return set(self.tables[chain])

    def acknowledge(self, chain: str, pipeline: str, position: str) -> None:
        """Positions are ordered by their number, and only ever rise."""
        n = int(re.sub(r"\D", "", position) or 0)
        held = self.consumers[chain].get(pipeline)
        self.consumers[chain][pipeline] = n if held is None else max(held, n)

    def durable_frontier(self, chain: str) -> int | None:
        """The lowest position every consumer has acknowledged; none as long as one has acknowledged nothing."""
        held = list(self.consumers.get(chain, {}).values())
        return None if not held or None in held else min(held)

    def affected(self, chain: str) -> list[str]:
        """Pipelines a teardown would stop."""
        return sorted(self.consumers.get(chain, {}))

    def detach(self, chain: str, pipeline: str) -> None:
        self.consumers.get(chain, {}).pop(pipeline, None)


def frontier(log: DataFrame, acked: DataFrame) -> DataFrame:
    """(chain_id, consumers, frontier, beyond): of every change log the lowest position that all its consumers have
    acknowledged, null as long as one has acknowledged nothing or there is none, and the distinct positions beyond it,
    which must be kept.

    ``log``: chain_id, pos; ``acked``: chain_id, pipeline_id, pos.  A consumer's position only ever rises, so its greatest
    counts.  Rows of the log without a position are none of its positions.
    """
    each = acked.groupBy("chain_id", "pipeline_id").agg(F.max("pos").alias("pos"))
    low = F.when(F.count("pos") == F.count(F.lit(1)), F.min("pos"))
    known = each.groupBy("chain_id").agg(F.count(F.lit(1)).alias("consumers"), low.alias("frontier"))
    rows = log.where("pos is not null").distinct().join(known, "chain_id", "left")
    beyond = F.count_if(F.col("frontier").isNull() | (F.col("pos") > F.col("frontier")))
    return rows.groupBy("chain_id").agg(F.coalesce(F.max("consumers"), F.lit(0)).alias("consumers"), F.max("frontier").alias("frontier"), beyond.alias("beyond"))
