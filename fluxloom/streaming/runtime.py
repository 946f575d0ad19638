"""The life of a pipeline: states, verbs, one pass over what there is, and the running tail."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluxloom.errors import Coded, first_code, one_line
from fluxloom.manifest import Manifest
from fluxloom.operators import targets
from fluxloom.plans import views
from fluxloom.plans.pipeline import Branch, Output, Plan, build
from fluxloom.sources import connectors
from fluxloom.sources import tables as sel
from fluxloom.sources.readers import Reader
from fluxloom.spec import Workspace, content_hash
from fluxloom.storage import materialize
from fluxloom.streaming.tables import AppendTable, UpsertTable

#: From which states a verb is legal, and where it leads.
VERBS = {
    "start": (("NEW", "STOPPED", "COMPLETED"), "RUNNING"),
    "pause": (("RUNNING",), "PAUSED"),
    "resume": (("PAUSED",), "RUNNING"),
    "stop": (("RUNNING", "PAUSED", "FAILED"), "STOPPED"),
}


@dataclass
class Status:
    """What is known of a run.  ``record_count``: events that reached the targets (of nest and join the last result's);
    ``error_count``: events in the dead-letter table, and the failure; ``snapshot_rows``: rows per table."""

    state: str = "NEW"
    record_count: int = 0
    error_count: int = 0
    error_code: str | None = None
    error_detail: str | None = None
    snapshot_rows: dict[str, int] = field(default_factory=dict)
    revision: str | None = None
    epoch: int = 0


class Count(Observation):
    """Rows that went by while something was computed."""

    @property
    def n(self) -> int:
        return int(self.get.get("n") or 0)


def _branch_tables(b: Branch) -> list[str]:
    """Logical tables of a branch; a step that may re-route events is asked which (one row a table)."""
    return sorted(r[0] for r in b.events.select("src").distinct().collect()) if b.rerouted else [b.table]


@dataclass
class Write:
    """One table's share of an output: a name that stays the same, the table, what it takes, and the count of events that is
    observed while it is written."""

    name: str
    table: AppendTable | UpsertTable
    rows: DataFrame
    counted: Count


def _writes(spark: SparkSession, out: Output, root: str) -> Iterator[Write]:
    """What a sync, push or view writes under ``root``."""
    rename = targets.Rename(**{**(out.spec.get("rename") or {}), "map": dict((out.spec.get("rename") or {}).get("map") or {})})
    mode = out.spec.get("write_mode") or "upsert"
    # what a step may have re-routed is computed once, then taken apart by table
    branches = [replace(b, events=materialize(b.events, "rerouted")) if b.rerouted else b for b in out.branches]
    parts = [(b, t) for b in branches for t in _branch_tables(b)]
    if out.kind == "sync" and mode == "append" and len({t for _, t in parts}) > 1:
        raise Coded("connector.write-failed", detail="append takes one table per batch")
    for b, t in parts:
        name, events, counted = f"{out.id}/{b.id}/{t}", b.events.where(F.col("src") == t) if b.rerouted else b.events, Count()
        count = lambda df, counted=counted: df.observe(counted, F.count(F.lit(1)).alias("n"))
        if out.kind == "push":
            yield Write(name, AppendTable(spark, f"{root}/{out.spec.get('topic') or out.id}"), count(targets.push_json(events, out.spec.get("format"))), counted)
            continue
        events = targets.apply_ddl_policy(events, out.spec.get("ddl") or ("ignore" if out.kind == "view" else "fail"))
        path = f"{root}/{out.id if out.kind == 'view' else rename.target(t)}"
        if mode == "append" or not b.key:
            yield Write(name, AppendTable(spark, path), count(targets.append_rows(events)), counted)
            continue
        table = UpsertTable(spark, path, b.key)
        if out.kind == "view" and out.spec.get("schema") and (held := table.read()) is not None:
            views.evolve(held.limit(0), events.select("after.*").limit(0), out.spec["schema"])
        yield Write(name, table, targets.steps_of(events, b.key, counted), counted)


def write_output(spark: SparkSession, out: Output, root: str, batch: int | None = None, stream: str = "") -> int:
    """Write one sync, push or view under ``root``; the number of events it took, 0 for a batch that was there."""
    return sum(w.counted.n for w in list(_writes(spark, out, root)) if w.table.apply(w.rows, batch, f"{stream}/{w.name}"))


class Pipeline:
    """One pipeline of a workspace over its readers and a target folder per target source.

    A run is a snapshot pass and, where the tail is read, micro-batches over the change logs from a checkpoint, so a
    restart goes on where it stopped; the snapshot is taken once.  A failure is sticky until ``stop``.
    """

    def __init__(self, spark: SparkSession, ws: Workspace, pipeline: str, readers: Mapping[str, Reader], target: str, logs: connectors.SharedLogs | None = None):
        self.logs = logs
        self.spark, self.ws, self.id, self.readers, self.target = spark, ws, pipeline, readers, target.rstrip("/")
        self.seen = Status()
        self.queries: list[StreamingQuery] = []
        self._writing = Lock()
        if pipeline not in ws.by_id:
            raise Coded("lifecycle.unknown-pipeline", pipeline=pipeline)

    def _go(self, verb: str) -> str:
        legal, to = VERBS[verb]
        if self.seen.state not in legal:
            raise Coded("lifecycle.illegal-transition", verb=verb, state=self.seen.state)
        self.seen.epoch += 1
        return to

    def _folder(self, out: Output) -> str:
        return f"{self.target}/{out.spec.get('source') or self.id}"

    def start(self, follow: bool = False, files_per_trigger: int | None = None) -> Status:
        """Run at the latest applied revision: all there is (then COMPLETED), or, with ``follow``, on as a stream."""
        to = self._go("start")
        self.seen = Status(state=to, revision=content_hash(self.ws.by_id[self.id]), epoch=self.seen.epoch)
        return self._run(follow, files_per_trigger)

    def resume(self, follow: bool = False, files_per_trigger: int | None = None) -> Status:
        self.seen.state = self._go("resume")
        return self._run(follow, files_per_trigger)

    def pause(self) -> Status:
        self.seen.state = self._go("pause")
        self._halt()
        return self.seen

    def stop(self) -> Status:
        self.seen.state = self._go("stop")
        self._halt()
        for s in self.ws.sources(self.ws.by_id[self.id]) if self.logs else ():
            self.logs.detach(connectors.chain_id(s.body), self.id)
        return self.seen

    def _halt(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries = []

    def _fail(self, error: BaseException) -> Status:
        self._halt()
        self.seen.state, self.seen.error_count = "FAILED", self.seen.error_count + 1
        self.seen.error_code, self.seen.error_detail = first_code(error), one_line(error)
        return self.seen

    def _run(self, follow: bool, files_per_trigger: int | None) -> Status:
        try:
            p = self.ws.by_id[self.id]
            settings = p.body.get("settings") or {}
            self.ws.check_types(p, {s.id: {t: m.row for t, m in self.readers[s.id].discover().items()} for s in self.ws.sources(p)})
            for s in self.ws.sources(p) if self.logs else ():
                if sel.consumption(settings.get("read_mode") or "snapshot_and_cdc", (s.body.get("srs") or {}).get("enabled") is not False).shared:
                    self.logs.attach(connectors.chain_id(s.body), self.id, self.readers[s.id].tables())
            self._starts()
            if self._stateful():
                self._recompute()
                if follow and settings.get("read_mode") != "snapshot_only":
                    self._follow_recomputing(files_per_trigger)
            elif settings.get("read_mode") != "cdc_only":
                self._snapshot()
            if not self._stateful() and settings.get("read_mode") != "snapshot_only":
                self._tail(follow, files_per_trigger)
            if not self.queries:
                self.seen.state = "COMPLETED"
        except Exception as e:  # every failure becomes an observation
            return self._fail(e)
        return self.seen

    def _snapshot(self) -> None:
        plan = build(self.ws, self.id, {k: _SnapshotOnly(r) for k, r in self.readers.items()})
        for out in plan.outputs:
            if out.kind != "query":
                self.seen.record_count += write_output(self.spark, out, self._folder(out), 0, f"{self.id}/snapshot")
        for b, dead in zip(plan.dead_of, plan.dead):
            self._bury(b, dead, 0, "snapshot")
        self._count_snapshot(plan)

    def _dead(self) -> AppendTable:
        return AppendTable(self.spark, f"{self.target}/_dead/{self.id}")

    def _bury(self, b: Branch, dead: DataFrame, batch: int, stream: str) -> None:
        """Keep the events a filter failed on, and count them once."""
        n = dead.count()
        if n and self._dead().apply(dead, batch, f"{stream}/{b.id}"):
            self.seen.error_count += n

    def dead_letters(self) -> DataFrame | None:
        """The events on which a filter failed under ``error_policy: dead_letter``."""
        return self._dead().read()

    def _starts(self) -> dict[str, int]:
        """First ``_seq`` of every tail under ``start_from``, resolved once and kept beside the checkpoints; a tail whose
        instant has not come yet has none."""
        start = (self.ws.by_id[self.id].body.get("settings") or {}).get("start_from") or "earliest"
        if start == "earliest":
            return {}
        kept = Manifest(self.spark, f"{self.target}/_checkpoints/{self.id}/starts")
        held, state = kept.load()
        known = state.get("starts", {})
        fresh = dict(known)
        for s in self.ws.sources(self.ws.by_id[self.id]):
            for t in self.readers[s.id].tables():
                tail = None if f"{s.id}.{t}" in known else self.readers[s.id].tail(t)
                if tail is None:
                    continue
                if start == "latest":
                    last = tail.agg(F.max("_seq")).first()[0]
                    fresh[f"{s.id}.{t}"] = -(2**63) if last is None else last + 1
                elif (first := sel.start_from(tail, start).agg(F.min("_seq")).first()[0]) is not None:
                    fresh[f"{s.id}.{t}"] = first
        if fresh != known:
            kept.commit(held, {"starts": fresh})
        return fresh

    def _started(self, b: Branch, df: DataFrame, starts: Mapping[str, int]) -> DataFrame:
        """A micro-batch from the start position on, where the plan could not know it yet."""
        start = (self.ws.by_id[self.id].body.get("settings") or {}).get("start_from") or "earliest"
        if start == "earliest" or f"{b.source}.{b.table}" in starts:
            return df
        first = self._starts().get(f"{b.source}.{b.table}")
        return df.where(F.lit(False) if first is None else F.col("_seq") >= first)

    def _count_snapshot(self, plan: Plan) -> None:
        for (_, table), n in {(b.source, b.table): b for o in plan.outputs[:1] for b in o.branches if b.source}.items():
            self.seen.snapshot_rows[table] = self.readers[n.source].frame(table).count() if self.readers[n.source]._has(table, self.readers[n.source].format) else 0

    def _tail(self, follow: bool, files_per_trigger: int | None) -> None:
        """One streaming query per output and branch."""
        starts = self._starts()
        plan = build(self.ws, self.id, self.readers, stream=True, files_per_trigger=files_per_trigger, starts=starts) if self._has_tail() else None
        for out in plan.outputs if plan else []:
            for b in out.branches if out.kind != "query" else []:
                if not b.events.isStreaming:
                    continue

                def each(df: DataFrame, batch: int, out: Output = out, b: Branch = b) -> None:
                    with self._writing:  # branches may end in one table
                        one = Output(out.kind, out.id, out.spec, [replace(b, events=self._started(b, df, starts))], out.error_policy)
                        self.seen.record_count += write_output(self.spark, one, self._folder(out), batch, f"{self.id}/tail")
                        self._acknowledge(b, df)

                self._run_stream(b.events, each, f"{out.id}-{b.id}", follow)
        for b, dead in zip(plan.dead_of, plan.dead) if plan else ():
            if not dead.isStreaming:
                continue

            def bury(df: DataFrame, batch: int, b: Branch = b) -> None:
                with self._writing:
                    self._bury(b, self._started(b, df, starts), batch, "tail")

            self._run_stream(dead, bury, f"dead-{b.id}", follow)

    def _acknowledge(self, b: Branch, df: DataFrame) -> None:
        """Tell a shared log how far the targets hold it."""
        chain = connectors.chain_id(self.ws.by_id[b.source].body) if self.logs and b.source else None
        if chain and self.id in self.logs.consumers.get(chain, {}) and (last := df.agg(F.max("_seq")).first()[0]) is not None:
            self.logs.acknowledge(chain, self.id, str(last))

    def _run_stream(self, events: DataFrame, each: Callable[[DataFrame, int], None], name: str, follow: bool) -> None:
        writer = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.target}/_checkpoints/{self.id}/{name}")
        q = (writer if follow else writer.trigger(availableNow=True)).start()
        if follow:
            self.queries.append(q)
        else:
            q.awaitTermination()

    def _recompute(self) -> None:
        """The result of nest and join from the current states, in place of the one before; exact, and one commit a table."""
        with self._writing:
            plan = build(self.ws, self.id, self.readers, starts=self._starts())
            tables: dict[str, AppendTable | UpsertTable] = {}
            owned: dict[str, dict[str, DataFrame]] = {}
            counts = []
            for out in plan.outputs:
                for w in _writes(self.spark, out, self._folder(out)) if out.kind != "query" else ():
                    tables.setdefault(w.table.path, w.table)
                    owned.setdefault(w.table.path, {})[f"{self.id}/{w.name}"] = w.rows
                    counts.append(w.counted)
            for path, table in tables.items():
                table.replace(owned[path])
            taken = sum(c.n for c in counts)
            if plan.dead:
                self._dead().replace({b.id: dead for b, dead in zip(plan.dead_of, plan.dead)})
            self.seen.record_count, self.seen.error_count = taken, sum(dead.count() for dead in plan.dead)
            self._count_snapshot(plan)

    def _follow_recomputing(self, files_per_trigger: int | None) -> None:
        """Recompute whenever a log has grown; a log's files that are there already are one trigger more, which changes nothing."""
        for s in self.ws.sources(self.ws.by_id[self.id]):
            for t in self.readers[s.id].tables():
                tail = self.readers[s.id].tail_stream(t, files_per_trigger)
                if tail is None:
                    continue
                self._run_stream(tail, lambda df, batch: self._recompute(), f"recompute-{s.id}-{t}", True)

    def _has_tail(self) -> bool:
        return any(r._has(t, "log") for r in self.readers.values() for t in r.tables())

    def _stateful(self) -> bool:
        steps = self.ws.by_id[self.id].body["transforms"]
        kinds = {(self.ws.by_id[s["use"]].body if "use" in s else s)["type"] for s in steps}
        return bool(kinds & {"nest", "join"})

    def process_available(self) -> Status:
        """Wait until the running tail has read all there is now."""
        try:
            for q in self.queries:
                q.processAllAvailable()
        except Exception as e:
            return self._fail(e)
        return self.seen

    def table(self, target: str, name: str, keys: tuple[str, ...] | None = None) -> DataFrame | None:
        """Rows of a target table; ``keys`` of an upsert target."""
        path = f"{self.target}/{target}/{name}"
        return UpsertTable(self.spark, path, keys).read() if keys else AppendTable(self.spark, path).read()

    def view(self, name: str) -> DataFrame:
        """A view as its last run left it, in the storage tiers it asks for and as temp view ``name``."""
        out = next((o for o in self.plan().outputs if o.kind == "view" and o.id == name), None)
        rows = None if out is None else UpsertTable(self.spark, f"{self._folder(out)}/{name}", out.branches[0].key).read()
        if rows is None:
            raise Coded("dsl.missing-reference", ref=name, path="view")
        return views.store(rows, name, out.spec.get("storage"), f"{self.target}/_views")

    def status(self) -> Status:
        return self.seen

    def plan(self) -> Plan:
        return build(self.ws, self.id, self.readers)


class _SnapshotOnly:
    """A reader without its tails."""

    def __init__(self, reader: Reader):
        self._r = reader

    def __getattr__(self, name: str):
        return getattr(self._r, name)

    def snapshot(self, table: str) -> DataFrame | None:
        """The table's snapshot; an empty one where there is a log alone."""
        found = self._r.snapshot(table)
        return found if found is not None or (log := self._r.tail(table)) is None else log.where(F.lit(False))

    def tail(self, table: str) -> DataFrame | None:
        return None
