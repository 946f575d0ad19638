"""Readers: a source's discovered model, its snapshot and its tail, as event DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import envelope
from fluxloom.errors import Coded
from fluxloom.sources.tables import only_selected
from fluxloom.storage import file_system


@dataclass(frozen=True)
class Model:
    """A discovered table: its row type (logical types and NOT NULL in the fields' metadata) and its key."""

    row: T.StructType
    key: tuple[str, ...] = ()


@dataclass
class Reader:
    """Tables of one source as files of a Spark format: ``<root>/<table>.<ext>`` (a file or a folder), and change logs
    under ``<root>/<table>.log/`` (rows: op, ts, before, after, src_pos, seq).  ``keys`` declares primary keys."""

    spark: SparkSession
    root: str
    format: str = "parquet"
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}.{self.format}"

    def tables(self) -> list[str]:
        """Names of all tables, those with a log alone included."""
        fs, at = file_system(self.spark, self.root)
        names = [s.getPath().getName().rsplit(".", 1) for s in fs.listStatus(at)]
        return sorted({n[0] for n in names if len(n) == 2 and n[1] in (self.format, "log") and n[0][:1] not in "._"})

    def frame(self, table: str) -> DataFrame:
        return self.spark.read.format(self.format).options(**self.options).load(self._path(table))

    def discover(self) -> dict[str, Model]:
        out = {}
        for t in self.tables():
            row = self.frame(t).schema if self._has(t, self.format) else self.log(t).schema["after"].dataType
            out[t] = Model(row, tuple(self.keys.get(t, ())))
        return out

    def _has(self, table: str, ext: str) -> bool:
        fs, at = file_system(self.spark, f"{self.root}/{table}.{ext}")
        return fs.exists(at)

    def sample(self, table: str, rows: int = 10) -> DataFrame:
        """A connection test: a few rows."""
        return self.frame(table).limit(rows)

    def snapshot(self, table: str) -> DataFrame | None:
        return envelope.snapshot_of(self.frame(table), table) if self._has(table, self.format) else None

    def log(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}.log")

    def _as_events(self, log: DataFrame, table: str) -> DataFrame:
        """Changes of a table; a log that says of its own what table a change is of may hold no other's."""
        schema = "schema" if "schema" in log.columns else None
        named = "src" in log.columns
        events = envelope.changes_of(log if named else log.withColumn("src", F.lit(table)), F.col("seq"), schema=schema, src_pos="src_pos" if "src_pos" in log.columns else None)
        return only_selected(events, [table]) if named else events

    def tail(self, table: str) -> DataFrame | None:
        return self._as_events(self.log(table), table) if self._has(table, "log") else None

    def tail_stream(self, table: str, files_per_trigger: int | None = None) -> DataFrame | None:
        """The same log as a stream; files that arrive later are read when they arrive."""
        if not self._has(table, "log"):
            return None
        read = self.spark.readStream.schema(self.log(table).schema)
        if files_per_trigger:
            read = read.option("maxFilesPerTrigger", files_per_trigger)
        return self._as_events(read.parquet(f"{self.root}/{table}.log"), table)


def reader_for(spark: SparkSession, source: dict) -> Reader:
    """A reader for a file source by its document; other connectors need their own driver on the cluster."""
    config = source.get("config") or {}
    if source.get("connector") not in ("parquet", "csv", "json", "orc", "text", "xml") or "path" not in config:
        raise Coded("connector.not-registered", connector=source.get("connector"))
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in config.items() if k not in ("path", "keys")}
    return Reader(spark, config["path"], source["connector"], {t: tuple(k) if isinstance(k, list) else (k,) for t, k in (config.get("keys") or {}).items()}, options)
