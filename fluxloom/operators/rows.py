"""Row steps: filter, map, union, Python steps.  Stateless, so they never shuffle and stream as they are."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom import envelope
from fluxloom.errors import Coded
from fluxloom.expressions import ExpressionError, Scope, compile_column, compile_predicate
from fluxloom.expressions.compiler import compile_value, failing
from fluxloom.storage import ship


_LOG = logging.getLogger("fluxloom.step")


def coded(text: str, error: ExpressionError, **args: object) -> Coded:
    return Coded(f"dsl.{error.kind}", expr=text, detail=error, **{**error.args_, **args})


def filter_rows(events: DataFrame, expr: str, present: Iterable[str] = (), policy: str = "fail") -> DataFrame:
    """Keep the events for which ``expr`` is exactly true; ddl events always pass and are never judged.

    ``present`` names rows that no event lacks (``after`` on inserts and snapshots): then plain comparisons reach the
    scan.  ``policy`` says what becomes of an event on which the expression fails: fail the job, skip or dead_letter
    (both drop it here, see ``failed_rows``).
    """
    try:
        cond, err = compile_predicate(expr, Scope.envelope(events.schema, frozenset(present)))
    except ExpressionError as e:
        raise coded(expr, e) from e
    ddl = F.col("op") == "ddl"
    if err is None and "after" in present:
        return events.where(cond)  # every event carries a row, so there is no ddl among them
    if policy != "fail" and err is not None:
        return events.where(ddl | (err.isNull() & cond))
    return events.where(F.when(ddl, True).otherwise(failing(expr, cond, err)))


def failed_rows(events: DataFrame, expr: str) -> DataFrame:
    """The events on which ``expr`` fails, with ``_error``: what a dead-letter target takes."""
    _, err = compile_predicate(expr, Scope.envelope(events.schema))
    if err is None:
        return events.where(F.lit(False)).withColumn("_error", F.lit(None).cast("string"))
    return events.where(F.col("op") != "ddl").withColumn("_error", err).where(F.col("_error").isNotNull())


def literal(value: object) -> Column:
    """A constant, nested ones included."""
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[literal(v) for v in value])
    return F.lit(value).cast("bigint") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def map_columns(fields: dict[str, object], row: T.StructType, at: str, scope: Scope, strict: bool = True) -> list[Column]:
    """The columns of a mapped row: declared rules first, in order, then what no rule takes or drops.  Not ``strict``, a
    computed field that fails is not raised; see ``map_error``.

    ``$name`` renames (without the source: no column, and a field of the output's name passes), ``false`` drops,
    ``=expr`` computes on the original event, anything else is a constant.
    """
    out, taken, made = [], set(), set()
    for name, rule in fields.items():
        if rule is False:
            taken.add(name)
        elif rule is None:
            raise Coded("dsl.illegal-value", value=rule, expected="a rule", path=f"fields.{name}")
        elif isinstance(rule, str) and rule.startswith("$"):
            if rule[1:] in row.names:
                out.append(F.col(f"{at}.`{rule[1:]}`").alias(name))
                taken.add(rule[1:])
                made.add(name)
        elif isinstance(rule, str) and rule.startswith("="):
            try:
                out.append((compile_column(rule[1:], scope) if strict else compile_value(rule[1:], scope).col).alias(name))
            except ExpressionError as e:
                raise coded(rule[1:], e, path=f"fields.{name}") from e
            made.add(name)
        else:
            out.append(literal(rule).alias(name))
            made.add(name)
    return out + [F.col(f"{at}.`{c}`").alias(c) for c in row.names if c not in taken and c not in made]


def map_error(events: DataFrame, fields: dict[str, object], present: Iterable[str] = ()) -> Column | None:
    """Why the first of the computed fields that fails does, null where none does; None if none can."""
    scope = Scope.envelope(events.schema, frozenset(present))
    errs = [e for rule in fields.values() if isinstance(rule, str) and rule.startswith("=") and (e := compile_value(rule[1:], scope).err) is not None]
    return F.when(F.col("after").isNotNull(), F.coalesce(*errs)) if errs else None


def _dead(events: DataFrame) -> DataFrame:
    """Events with ``_error`` as a dead-letter table takes them: rows of any table, as text."""
    return events.select("op", "ts", "src", F.to_json("before").alias("before"), F.to_json("after").alias("after"), "src_pos", "_seq", "_error")


def dead_letters(events: DataFrame, kind: str, body: dict) -> DataFrame:
    """The events on which a step (filter, map or py) fails, with ``_error``."""
    if kind == "py":
        return _py_failed(events, body["script"])
    if kind == "filter":
        return _dead(failed_rows(events, body["expr"]))
    err = map_error(events, body["fields"])
    bad = events.where(F.lit(False)).withColumn("_error", F.lit(None).cast("string")) if err is None else events.withColumn("_error", err).where(F.col("_error").isNotNull())
    return _dead(bad)


def map_fields(events: DataFrame, fields: dict[str, object], present: Iterable[str] = (), key: Iterable[str] = (), policy: str = "fail") -> DataFrame:
    """Project ``after`` by ``fields``; events without it pass untouched.  ``policy`` is that of ``filter_rows``, for computed fields.

    ``before`` keeps its columns, but a renamed key column is renamed there too, so deletes still find their row.
    """
    scope = Scope.envelope(events.schema, frozenset(present))
    row = events.schema["after"].dataType
    if policy != "fail" and (err := map_error(events, fields, present)) is not None:
        events = events.where(err.isNull())
    mapped = F.struct(*map_columns(fields, row, "after", scope, policy == "fail")) if row.names else F.col("after")
    if "after" not in present:
        mapped = F.when(F.col("after").isNotNull(), mapped)
    renamed = {str(rule)[1:]: name for name, rule in fields.items() if isinstance(rule, str) and rule.startswith("$") and rule[1:] in set(key)}
    out = events.withColumn("after", mapped)
    if renamed:
        old = events.schema["before"].dataType
        out = out.withColumn("before", F.when(F.col("before").isNotNull(), F.struct(*[F.col(f"before.`{c}`").alias(renamed.get(c, c)) for c in old.names])))
    return out


def union_rows(*arms: DataFrame) -> DataFrame:
    """Bag union of event streams, no de-duplication; rows keep their ``src``, missing columns are null."""
    if not arms:
        raise ValueError("union of nothing")
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(_with_rows(arm, out), allowMissingColumns=True)
    return out


def _with_rows(arm: DataFrame, like: DataFrame) -> DataFrame:
    """Null rows take the type of the other side's rows where theirs is empty."""
    for side in ("before", "after"):
        if side in arm.columns and side in like.columns and arm.schema[side].dataType == T.StructType([]):
            arm = arm.withColumn(side, F.lit(None).cast(like.schema[side].dataType))
    return arm


class Context:
    """What a Python step may use: ``emit`` gives further records, ahead of the returned one; ``log`` notes a line in the
    executor's log (logger ``fluxloom.step``)."""

    def __init__(self):
        self.out: list[dict] = []
        self.lines: list[str] = []

    def emit(self, record: dict) -> None:
        self.out.append(json.loads(json.dumps(record, default=str)))  # as it is now, whatever becomes of it

    def log(self, line: object) -> None:
        self.lines.append(str(line))
        _LOG.info("%s", line)


def _checked(record: Any, source: dict) -> dict:
    """An output record: op and src default to the source's, a position always is the source's."""
    bad = lambda why: Coded("transform.script-output-invalid", detail=why)
    if not isinstance(record, dict):
        raise bad(f"{type(record).__name__} is no record")
    op = record.get("op", source["op"])
    if op not in envelope.OPS:
        raise bad(f"unknown op {op!r}")
    for side in ("before", "after", "schema"):
        if record.get(side) is not None and not isinstance(record[side], dict):
            raise bad(f"{side} is neither object nor null")
    ts = record.get("ts")
    src = record.get("src", source["src"])
    return {"op": op, "ts": int(ts) if isinstance(ts, (int, float)) and not isinstance(ts, bool) else source["ts"], "src": str(src), "before": record.get("before"), "after": record.get("after"), "schema": record.get("schema"), "src_pos": source["src_pos"]}


def run_record(record: dict, process: Callable, keep: Callable | None = None) -> list[dict]:
    """One event through a Python step: nothing, one or several events."""
    source = dict(record)
    try:
        if keep is not None and not keep(record):
            return []
        context = Context()
        returned = process(record, context)
    except Coded:
        raise
    except Exception as e:
        raise Coded("transform.script-failed", detail=repr(e)) from e
    return [_checked(r, source) for r in [*context.out, *([] if returned is None else [returned])]]


def script(text: str) -> tuple[Callable, Callable | None]:
    """``process`` and ``filter`` of a Python step given as text."""
    space: dict = {}
    try:
        exec(compile(text, "<step>", "exec"), space)  # noqa: S102 - a step is the pipeline author's own code
    except Exception as e:
        raise Coded("transform.script-compile-failed", detail=repr(e)) from e
    if not callable(space.get("process")):
        raise Coded("transform.script-no-process")
    return space["process"], space.get("filter") if callable(space.get("filter")) else None


def _cell(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _cell(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_cell(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {str(k): _cell(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.IntegralType) and isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value, default=str)
    return value


def py_step(events: DataFrame, code: str | tuple[Callable, Callable | None], after: T.StructType | None = None, policy: str = "fail") -> DataFrame:
    """Events through a Python step, in Arrow batches; it sees every event, ddl and deletes too.

    ``after`` declares the row type the step writes (default: that of its input); ``policy`` is that of ``filter_rows``.
    """
    rows = after or events.schema["after"].dataType
    steps = script(code) if isinstance(code, str) else code
    text = code if isinstance(code, str) else None
    names = ["op", "ts", "src", "before", "after", "schema", "src_pos", "_seq"]
    schema = T.StructType([events.schema["op"], events.schema["ts"], events.schema["src"], T.StructField("before", rows), T.StructField("after", rows), T.StructField("schema", T.MapType(T.StringType(), T.StringType())), events.schema["src_pos"], events.schema["_seq"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process, keep = script(text) if text is not None else steps
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                seq = r.pop("_seq")
                r["schema"] = dict(r["schema"]) if r["schema"] is not None else None
                try:
                    made_of = run_record({k: _plain(v) for k, v in r.items()}, process, keep)
                except Coded:
                    if policy == "fail":
                        raise
                    continue
                for made in made_of:
                    out.append((made["op"], made["ts"], made["src"], _cell(made["before"], rows), _cell(made["after"], rows), made["schema"], made["src_pos"], seq))
            yield pd.DataFrame(out, columns=names)

    ship(events.sparkSession)
    return events.select(*names).mapInPandas(run, schema)


def _py_failed(events: DataFrame, code: str) -> DataFrame:
    """The events on which a Python step fails, as a dead-letter table takes them."""
    names = ["op", "ts", "src", "before", "after", "schema", "src_pos", "_seq"]
    text = events.withColumns({"_b": F.to_json("before"), "_a": F.to_json("after")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process, keep = script(code)
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                seq, before, after = r.pop("_seq"), r.pop("_b"), r.pop("_a")
                r["schema"] = dict(r["schema"]) if r["schema"] is not None else None
                try:
                    run_record({k: _plain(v) for k, v in r.items()}, process, keep)
                except Coded as e:
                    out.append((r["op"], r["ts"], r["src"], before, after, r["src_pos"], seq, str(e)))
            yield pd.DataFrame(out, columns=["op", "ts", "src", "before", "after", "src_pos", "_seq", "_error"])

    ship(events.sparkSession)
    return text.select(*names, "_b", "_a").mapInPandas(run, "op string, ts bigint, src string, before string, after string, src_pos string, _seq bigint, _error string")


def _plain(v: Any) -> Any:
    """Pandas cells as plain Python values."""
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist") and not isinstance(v, str):
        return _plain(v.tolist())
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v
