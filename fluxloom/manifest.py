"""Versioned state of a table under a folder, put in place by one rename.

What a table consists of is a small JSON document.  A writer prepares parts under
names nobody else uses and then commits the document that names them: a reader
sees all of a commit or nothing, of two writers the second one fails, and what is
noted as done in the document is done exactly once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from fluxloom.storage import file_system

#: Commits for which replaced parts and documents stay, for readers that began before.
GRACE = 8


class Manifest:
    """Versioned document of parts and batches under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> tuple[int, dict]:
        """The latest version and its document; 0 and an empty one if there is none."""
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return 0, {"parts": [], "batches": {}}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        n = max((int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")), default=0)
        if not n:
            return 0, {"parts": [], "batches": {}}
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{n}.json"))
        try:
            return n, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, held: int, state: dict, retired: Iterable[str] = ()) -> None:
        """Put ``state`` in place of version ``held``.  ``retired``: parts it no longer names, deleted some commits later."""
        jvm = self.spark.sparkContext._jvm
        mine = held + 1
        waiting = [*state.get("retired", []), *([mine, p] for p in retired)]
        gone = [p for n, p in waiting if n <= mine - GRACE]
        state = {**state, "retired": [[n, p] for n, p in waiting if n > mine - GRACE]}
        fs, tmp = file_system(self.spark, f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{mine}.json")
        if fs.exists(at) or not fs.rename(tmp, at):  # a local file system would rename over what is there
            fs.delete(tmp, False)
            raise RuntimeError(f"{self.path}: somebody else committed version {mine}")
        for p in [*gone, f"manifest-{mine - GRACE}.json"]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}"), True)
