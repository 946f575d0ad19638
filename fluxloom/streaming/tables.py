"""Target tables on a shared file system.

An upsert table is a log of keyed steps (key, ``_seq``, ``_alive``, row) in parts,
merged when it is read and compacted in tiers: ``compact_after`` parts of a tier become
one of the next, so a row is rewritten once a tier and a batch costs about its own
size, not the table's.  A part becomes visible with the manifest that names it, which is put
in place by one rename; a batch that is already in the manifest is not applied
again, so replays change nothing.  What is computed anew as a whole has parts of its
owner's, which a later computation replaces in one manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.manifest import Manifest


def _owned(state: dict) -> list[str]:
    return [p for parts in state.get("owned", {}).values() for p in parts]


class UpsertTable:
    """Rows by key; the last step in ``_seq`` decides, whatever the order the batches came in."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], compact_after: int = 8):
        self.spark, self.path, self.keys, self.compact_after = spark, path.rstrip("/"), list(keys), compact_after
        self.manifest = Manifest(spark, path)

    def _flat(self, steps: DataFrame) -> DataFrame:
        cols = [c for c in steps.schema["row"].dataType.names if c not in self.keys]
        return steps.select(*self.keys, "_seq", F.col("alive").alias("_alive"), *[F.col(f"row.`{c}`").alias(c) for c in cols])

    def apply(self, steps: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Add one batch of steps (keys, _seq, alive, row); False if it was there already."""
        held, state = self.manifest.load()
        if batch is not None and batch <= state["batches"].get(stream, -1):
            return False
        parts, merged = [*state["parts"], self._write(self._flat(steps), 0)], []
        level = 0
        while len(tier := [p for p in parts if p.startswith(f"part-{level}-")]) > self.compact_after:
            # order lies in the rows, so merging parts in any grouping is exact
            parts = [p for p in parts if p not in tier] + [self._write(self._read(tier), level + 1)]
            merged += tier
            level += 1
        batches = {**state["batches"], **({stream: batch} if batch is not None else {})}
        self.manifest.commit(held, {**state, "parts": parts, "batches": batches}, merged)
        return True

    def replace(self, owned: Mapping[str, DataFrame]) -> None:
        """Put steps in place of what their owners gave before, all in one commit."""
        parts = {owner: [self._write(self._flat(steps), 0)] for owner, steps in owned.items()}
        held, state = self.manifest.load()
        old = [p for o in parts for p in state.get("owned", {}).get(o, [])]
        self.manifest.commit(held, {**state, "owned": {**state.get("owned", {}), **parts}}, old)

    def _write(self, flat: DataFrame, level: int) -> str:
        part = f"part-{level}-{uuid.uuid4().hex}"
        self._collapsed(flat).write.option("compression", "zstd").parquet(f"{self.path}/{part}")
        return part

    def _read(self, parts: Sequence[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in parts])

    def _collapsed(self, flat: DataFrame) -> DataFrame:
        """Last step per key; ended rows stay as marks, an older batch may still arrive."""
        rest = [c for c in flat.columns if c not in self.keys]
        return flat.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct("_seq", "_alive")).alias("_s")).select(*self.keys, "_s.*")

    def read(self) -> DataFrame | None:
        _, state = self.manifest.load()
        parts = [*state["parts"], *_owned(state)]
        if not parts:
            return None
        return self._collapsed(self._read(parts)).where("_alive").drop("_seq", "_alive")


class AppendTable:
    """Every row of every batch, once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def apply(self, rows: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        held, state = self.manifest.load()
        if batch is not None and batch <= state["batches"].get(stream, -1):
            return False
        part = self._write(rows)
        self.manifest.commit(held, {**state, "parts": [*state["parts"], part], "batches": {**state["batches"], **({stream: batch} if batch is not None else {})}})
        return True

    def replace(self, owned: Mapping[str, DataFrame]) -> None:
        """Put rows in place of what their owners gave before, all in one commit."""
        parts = {owner: [self._write(rows)] for owner, rows in owned.items()}
        held, state = self.manifest.load()
        old = [p for o in parts for p in state.get("owned", {}).get(o, [])]
        self.manifest.commit(held, {**state, "owned": {**state.get("owned", {}), **parts}}, old)

    def _write(self, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{part}")
        return part

    def read(self) -> DataFrame | None:
        _, state = self.manifest.load()
        parts = [*state["parts"], *_owned(state)]
        if not parts:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in parts])
