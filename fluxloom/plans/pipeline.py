"""A pipeline document -> one DataFrame plan per output.

A node of the plan is a list of branches, one per table that flows through it:
rows of different tables keep their own schema from the scan to the target, so
Catalyst prunes and pushes per table, and expressions are typed per table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom import envelope
from fluxloom.errors import Coded
from fluxloom.operators import nest as nesting
from fluxloom.operators import rows, targets
from fluxloom.sources import tables as sel
from fluxloom.sources.readers import Reader
from fluxloom.spec import Resource, Workspace


@dataclass(frozen=True)
class Branch:
    """Events of one table: where from, under which key, and which rows none of them lacks."""

    source: str
    table: str
    events: DataFrame
    key: tuple[str, ...] = ()
    present: frozenset[str] = frozenset()
    rerouted: bool = False  # a step may have changed src
    path: str = ""  # the steps it came through
    id: str = ""  # its own name in an output: source, steps, table, and place among equals

    def state(self, first: bool = False) -> DataFrame:
        """The rows alive, with ``_seq``, as they are, or as they were ``first`` set; without a key every event is a row."""
        if not self.key:
            return targets.append_rows(self.events).withColumn("_seq", F.lit(0).cast("bigint"))
        kept = self.events.withColumn("after", F.when(F.col("after").isNotNull(), F.col("after").withField("_seq", F.col("_seq"))))
        return (targets.first_images if first else targets.latest)(kept, self.key)


@dataclass
class Output:
    """A sync, push, view or query of a pipeline with the branches it takes."""

    kind: str
    id: str
    spec: dict
    branches: list[Branch]
    error_policy: str = "fail"


@dataclass
class Plan:
    pipeline: Resource
    nodes: dict[str, list[Branch]]
    outputs: list[Output] = field(default_factory=list)
    dead: list[DataFrame] = field(default_factory=list)
    dead_of: list[Branch] = field(default_factory=list)  # the branch each of them fell out of; its id says where

    def view(self, name: str) -> DataFrame:
        """Rows of the view: what a pull surface serves."""
        return states(self.nodes[name])


def states(branches: list[Branch]) -> DataFrame:
    parts = [b.state().drop("_seq") for b in branches]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _with(ws: Workspace, block: dict) -> dict:
    """A block with its definition in place of ``use``."""
    return {**ws.by_id[block["use"]].body, **{k: v for k, v in block.items() if k != "use" and v is not None}} if "use" in block else block


def _scan(ws: Workspace, p: Resource, readers: Mapping[str, Reader], settings: dict, stream: bool, files_per_trigger: int | None, starts: Mapping[str, int]) -> dict[tuple[str, str], Branch]:
    out: dict[tuple[str, str], Branch] = {}
    for s in ws.sources(p):
        reader, srs = readers[s.id], s.body.get("srs") or {}
        models = reader.discover()
        bounded = s.body.get("mode") in ("snapshot", "file", "api")
        plan = sel.consumption("snapshot_only" if bounded else settings.get("read_mode") or "snapshot_and_cdc", srs.get("enabled") is not False)
        for spec in sel.table_specs(s.body.get("tables"), list(models)):
            key = spec.pk or models[spec.name].key
            snap = reader.snapshot(spec.name) if plan.snapshot and not stream else None
            tail = None
            if plan.tail:
                tail = reader.tail_stream(spec.name, files_per_trigger) if stream else reader.tail(spec.name)
            if stream and tail is None:
                continue
            if tail is not None and (first := starts.get(f"{s.id}.{spec.name}")) is not None:
                tail = tail.where(F.col("_seq") >= first)
            if snap is None and tail is None:
                raise Coded("actuation.source-table-not-discovered", table=spec.name)
            start = "earliest" if stream or f"{s.id}.{spec.name}" in starts else settings.get("start_from") or "earliest"
            events = sel.read_source(snap, tail, start)
            if spec.filter:
                events = _raw_filter(events, spec.filter)
            out[s.id, spec.name] = Branch(s.id, spec.name, events, tuple(key), frozenset({"after"}) if tail is None else frozenset())
    return out


def _raw_filter(events: DataFrame, expr: str) -> DataFrame:
    """A table's own filter over its columns, on the row an event carries; ddl passes."""
    from fluxloom.expressions import ExpressionError, Scope, compile_predicate
    from fluxloom.expressions.compiler import failing

    try:
        row = events.schema["after"].dataType
        cond, err = compile_predicate(expr, Scope(columns=row))
    except ExpressionError as e:
        raise Coded(f"dsl.{e.kind}", expr=expr, detail=e, **e.args_) from e
    flat = events.select("*", *[F.coalesce(F.col(f"after.`{c}`"), F.col(f"before.`{c}`")).alias(c) for c in row.names if c not in events.columns])
    return flat.where(F.when(F.col("op") == "ddl", True).otherwise(failing(expr, cond, err))).select(*events.columns)


def resolve(ref: str, scans: Mapping[tuple[str, str], Branch], nodes: Mapping[str, list[Branch]]) -> list[Branch]:
    """Branches a reference names: a step, a source (all its tables), source.table, a bare table; or, by pattern, every
    table whose name, qualified name or source matches whole, then every step, in order of declaration."""
    if sel.is_pattern(ref):
        if len(ref) == 2:
            raise Coded("actuation.from-regex-empty", ref=ref)
        rx = sel.pattern(ref, "actuation.from-regex-invalid")
        hit = [b for (s, t), b in scans.items() if rx.fullmatch(t) or rx.fullmatch(f"{s}.{t}") or rx.fullmatch(s)]
        return hit + [b for name, bs in nodes.items() if rx.fullmatch(name) for b in bs]
    if ref in nodes:
        return nodes[ref]
    owner, dot, table = ref.partition(".")
    if dot:
        if (owner, table) in scans:
            return [scans[owner, table]]
    else:
        whole = [b for (s, _), b in scans.items() if s == ref]
        if whole:
            return whole
        named = [b for (_, t), b in scans.items() if t == ref]
        if len(named) > 1:
            raise Coded("actuation.source-table-ambiguous", table=ref)
        if named:
            return named
    raise Coded("dsl.missing-reference", ref=ref, path="from")


def _child(e: dict) -> str:
    """The table of a child: its alias, or the first images of it."""
    return f"{e['from']}, as first set" if e.get("ignoreUpdates") else e["from"]


def _frozen(items: list[dict] | None) -> set[str]:
    """Aliases of which some child wants the first images."""
    return {a for e in items or [] for a in [*([e["from"]] if e.get("ignoreUpdates") else []), *_frozen(e.get("embed"))]}


def _embeds(items: list[dict] | None) -> tuple[nesting.Embed, ...]:
    return tuple(
        nesting.Embed(_child(e), dict(e["on"]), e.get("path") or e["from"], e.get("as") or "array", tuple(e.get("arrayKey") or ()), _embeds(e.get("embed")), bool(e.get("ignoreUpdates")))
        for e in items or []
    )


#: Steps that may fail on an event and follow the error policy.
_JUDGED = ("filter", "map", "py")


def _step(body: dict, inputs: dict[str, list[Branch]], policy: str, dead: list[DataFrame], name: str) -> list[Branch]:
    kind = body["type"]
    flow = [b for bs in inputs.values() for b in bs]
    each: Callable[[Branch], Branch]
    if kind == "union":
        return flow
    if policy == "dead_letter" and kind in _JUDGED:
        dead += [rows.dead_letters(b.events, kind, body) for b in flow]
    if kind == "filter":
        each = lambda b: replace(b, events=rows.filter_rows(b.events, body["expr"], b.present, policy))
    elif kind == "map":

        def each(b: Branch) -> Branch:
            renamed = {str(r)[1:]: n for n, r in body["fields"].items() if isinstance(r, str) and r.startswith("$")}
            return replace(b, events=rows.map_fields(b.events, body["fields"], b.present, b.key, policy), key=tuple(renamed.get(k, k) for k in b.key))

    elif kind == "py":
        each = lambda b: replace(b, events=rows.py_step(b.events, body["script"], policy=policy), present=frozenset(), rerouted=True)
    elif kind == "js":
        raise Coded("transform.script-compile-failed", detail="no JavaScript here; write the step as type: py with the same contract")
    elif kind == "join":
        table = nesting.sql_join({a: states(bs) for a, bs in inputs.items()}, body["sql"])
        return [Branch("", name, envelope.snapshot_of(table, name), (), frozenset({"after"}))]
    elif kind == "nest":
        root = body["root"]
        alias = root["from"]
        key = tuple(root.get("key") or ([body["primary_key"]] if body.get("primary_key") else inputs[alias][0].key))
        frozen = _frozen(root.get("embed"))
        tables = {}
        for a, bs in inputs.items():
            for name_, first in [(a, False), *([(_child({"from": a, "ignoreUpdates": True}), True)] if a in frozen else [])]:
                parts = [b.state(first) for b in bs]
                tables[name_] = parts[0]
                for part in parts[1:]:
                    tables[name_] = tables[name_].unionByName(part, allowMissingColumns=True)
        out = nesting.nest(tables, nesting.Root(alias, key, _embeds(root.get("embed"))))
        return [Branch("", name, envelope.snapshot_of(out, name), key, frozenset({"after"}))]
    else:
        raise Coded("dsl.illegal-value", value=kind, expected="a step type", path="type")
    return [each(b) for b in flow]


def _named(branches: list[Branch]) -> list[Branch]:
    """The branches of an output under names that tell them apart and stay the same from run to run."""
    met: dict[str, int] = {}
    out = []
    for b in branches:
        name = f"{b.source}+{b.path}+{b.table}"
        met[name] = met.get(name, 0) + 1
        out.append(replace(b, id=f"{name}+{met[name]}"))
    return out


def build(ws: Workspace, pipeline: str, readers: Mapping[str, Reader], stream: bool = False, files_per_trigger: int | None = None, starts: Mapping[str, int] | None = None) -> Plan:
    """The plan of a pipeline; nothing runs.  ``stream``: over the tails alone, as streaming DataFrames.  ``starts``: the
    first ``_seq`` of a tail by source.table, where a run has resolved it; else a batch plan takes ``start_from``."""
    p = ws.by_id.get(pipeline)
    if p is None:
        raise Coded("actuation.pipeline-not-found", pipeline=pipeline)
    if p.kind != "pipeline":
        raise Coded("actuation.not-a-pipeline", pipeline=pipeline)
    settings = p.body.get("settings") or {}
    policy = settings.get("error_policy") or "fail"
    scans = _scan(ws, p, readers, settings, stream, files_per_trigger, starts or {})
    plan = Plan(p, {})
    for step in p.body["transforms"]:
        body = _with(ws, step)
        refs = body["from"].items() if isinstance(body["from"], dict) else enumerate(body["from"])
        inputs = {str(a): resolve(str(r), scans, plan.nodes) for a, r in refs}
        if policy == "dead_letter" and body["type"] in _JUDGED:
            plan.dead_of += [replace(b, id=f"{step['id']}+{b.id}") for b in _named([b for bs in inputs.values() for b in bs])]
        plan.nodes[step["id"]] = [replace(b, path=f"{b.path}~{step['id']}") for b in _step(body, inputs, policy, plan.dead, step["id"])]
    view = p.body.get("view")
    if view is not None:
        spec = _with(ws, view)
        key = spec.get("primary_key")
        inputs_ = _named([replace(b, key=(key,)) if key else b for b in resolve(view["from"], scans, plan.nodes)])
        plan.nodes[view["id"]] = inputs_
        plan.outputs.append(Output("view", view["id"], spec, inputs_, policy))
    serve = p.body.get("serve")
    if serve is not None:
        spec, inputs_ = _with(ws, serve), _named(resolve(serve["from"], scans, plan.nodes))
        for part in ("sync", "push"):
            plan.outputs += [Output(part, e["id"], e, inputs_, policy) for e in spec.get(part) or []]
        plan.outputs += [Output("query", f"query_{i + 1}", e, inputs_, policy) for i, e in enumerate(spec.get("query") or [])]
    return plan
