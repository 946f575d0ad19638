"""One document: interpolation, parsing, its shape, and its canonical text."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import yaml

from fluxloom.errors import Coded
from fluxloom.expressions import ExpressionError, Scope
from fluxloom.expressions.compiler import compile_value
from fluxloom.expressions.parser import parse
from fluxloom.sources.tables import is_pattern

# ---------------------------------------------------------------- text


def interpolate(text: str, values: Mapping[str, str] | None = None) -> str:
    """``${NAME}`` and ``${var:NAME:default}`` in the raw text; a name without value or default is an error."""
    values = os.environ if values is None else values

    def one(m: re.Match) -> str:
        body = m[1]
        if body is None:
            raise Coded("dsl.malformed-interpolation", ref=m[0])
        parts = body.split(":", 2)
        if len(parts) == 3 and parts[0] == "var" and re.fullmatch(r"[A-Za-z_]\w*", parts[1]):
            return values.get(parts[1], parts[2])
        if len(parts) > 1 or not re.fullmatch(r"[A-Za-z_]\w*", body):
            raise Coded("dsl.malformed-interpolation", ref=m[0])
        if body not in values:
            raise Coded("dsl.undefined-variable", name=body)
        return values[body]

    return re.sub(r"\$\{(?:([^}]*)\}|[^\n]*)", one, text)


class _Loader(yaml.SafeLoader):
    """Scalars by a small set of rules: true/false, whole numbers (also 0o, 0x), decimals, null; all else is text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _rx, _first in (
    ("bool", r"true|false", "tf"),
    ("int", r"[-+]?\d+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][-+]?\d+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
    ("null", r"null|~|", ["n", "~", ""]),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_rx})$"), list(_first))


def _int(loader: yaml.Loader, node: yaml.Node) -> int:
    v = loader.construct_scalar(node)
    return int(v, 0) if v[:2] in ("0o", "0x") else int(v)


def _mapping(loader: yaml.Loader, node: yaml.MappingNode) -> dict:
    keys = [loader.construct_object(k) for k, _ in node.value]
    for k in keys:
        if keys.count(k) > 1:
            raise Coded("dsl.malformed-yaml", detail=f"key {k!r} stands twice")
    return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}


_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def compose(text: str) -> Any:
    try:
        return yaml.load(text, _Loader)  # noqa: S506 - a restricted safe loader
    except yaml.YAMLError as e:
        raise Coded("dsl.malformed-yaml", detail=e) from e


# ---------------------------------------------------------------- shape

#: A check takes (value, path) and raises.
Check = Callable[[Any, str], None]


def _bad(value: Any, expected: str, path: str) -> Coded:
    return Coded("dsl.illegal-value", value=value, expected=expected, path=path)


def anything(_: Any, __: str) -> None: ...


def text(v: Any, path: str) -> None:
    if isinstance(v, (dict, list)):
        raise _bad(type(v).__name__, "a scalar", path)


def kind_of(t: type, name: str) -> Check:
    def check(v: Any, path: str) -> None:
        if not isinstance(v, t) or (t is int and isinstance(v, bool)):
            raise _bad(v, name, path)

    return check


def choice(*of: str) -> Check:
    def check(v: Any, path: str) -> None:
        if v not in of:
            raise _bad(v, "one of: " + ", ".join(of), path)

    return check


def many(check: Check) -> Check:
    def each(v: Any, path: str) -> None:
        for i, x in enumerate(v if isinstance(v, list) else [v]):
            check(x, f"{path}[{i}]")

    return each


def identifier(v: Any, path: str) -> None:
    if not isinstance(v, str) or not v or "." in v or "/" in v:
        raise _bad(v, "an id without '.' and '/'", path)


def shape(**fields: Check) -> Check:
    """A mapping with these fields and no others."""
    named = {k.rstrip("_").replace("__", "-"): c for k, c in fields.items()}

    def check(v: Any, path: str) -> None:
        if not isinstance(v, dict):
            raise _bad(type(v).__name__, "a mapping", path)
        for k, x in v.items():
            at = f"{path}.{k}" if path else str(k)
            if k not in named:
                raise Coded("dsl.unknown-field", field=k, path=at)
            if x is not None:
                named[k](x, at)

    return check


def expression(boolean: bool) -> Check:
    def check(v: Any, path: str) -> None:
        check_expression(str(v), path, boolean)

    return check


#: Before discovery any column is possible: names are checked, columns are not.
_OPEN = Scope(plain={n: ("dyn", None) for n in ("op", "ts", "src", "schema", "before", "after")})


def check_expression(expr: str, path: str, boolean: bool = False) -> None:
    """Syntax, names and functions of an expression, without a table model."""
    try:
        _names(parse(expr), frozenset())
    except ExpressionError as e:
        raise Coded(f"dsl.{e.kind}", expr=expr, detail=e, path=path) from e


_FUNCTIONS = {"size", "contains", "startsWith", "endsWith", "matches", "int", "uint", "double", "string", "bytes", "bool", "dyn", "type", "timestamp", "duration", "now"}


def _names(n, bound: frozenset[str]) -> None:
    if n.kind == "name" and n.value not in bound | set(_OPEN.plain):
        raise ExpressionError(f"undeclared reference to {n.value!r}")
    if n.kind == "call" and n.value not in _FUNCTIONS and not re.fullmatch(r"get(FullYear|Month|Date|DayOfMonth|DayOfWeek|DayOfYear|Hours|Minutes|Seconds|Milliseconds)", n.value):
        raise ExpressionError(f"undeclared function {n.value!r}")
    if n.kind == "index" and n.kids[0].kind == "name" and n.kids[0].value in ("before", "after"):
        raise ExpressionError(f"write {n.kids[0].value}.field, not {n.kids[0].value}[...]")
    if n.kind == "macro":
        _names(n.kids[0], bound)
        for k in n.kids[2:]:
            _names(k, bound | {n.kids[1].value})
        return
    for k in n.kids:
        _names(k, bound)


def field_rules(v: Any, path: str) -> None:
    if not isinstance(v, dict):
        raise _bad(type(v).__name__, "a mapping", path)
    for name, rule in v.items():
        if rule is None:
            raise _bad(None, "a rule", f"{path}.{name}")
        if isinstance(rule, str) and rule.startswith("="):
            check_expression(rule[1:], f"{path}.{name}")


def push_format(v: Any, path: str) -> None:
    if isinstance(v, dict):
        field_rules(v, path)
    else:
        check_expression(str(v).removeprefix("="), path)


def _embed(v: Any, path: str) -> None:
    shape(from_=text, on=kind_of(dict, "a mapping"), as_=choice("array", "object"), path=text, arrayKey=many(text), ignoreUpdates=kind_of(bool, "true or false"), trackJoinKeyChanges=kind_of(bool, "true or false"), embed=many(_embed))(v, path)


_FREE = kind_of(dict, "a mapping")
_HEAD = {"version": text, "kind": text, "id": identifier, "metadata": shape(labels=_FREE, description=text), "experimental": _FREE}
_STORAGE = shape(hot=shape(ttl=text), warm=shape(collection=text, indexes=many(text)), cold=shape(partition_by=many(text)))
_VIEW = {"primary_key": text, "storage": _STORAGE, "schema": shape(enforce=anything, evolution=text)}
_SYNC = shape(id=text, source=text, write_mode=choice("upsert", "append"), rename=shape(map=_FREE, case=choice("upper", "lower", "camel", "pascal"), prefix=text, suffix=text), ddl=choice("fail", "ignore", "apply"), options=_FREE)
_SERVE = {"sync": many(_SYNC), "query": many(shape(type=choice("rest", "graphql", "mcp"), backend=text)), "push": many(shape(id=text, source=text, topic=text, format=push_format, options=_FREE))}
#: Payload of each step type.
BODIES = {
    "filter": {"expr": expression(True)}, "map": {"fields": field_rules}, "js": {"script": text}, "py": {"script": text}, "union": {}, "join": {"engine": text, "sql": text},
    "nest": {"primary_key": text, "order": choice("main_first", "sub_first"), "root": shape(from_=text, key=many(text), mode=text, embed=many(_embed))},
}
_SETTINGS = shape(error_policy=choice("dead_letter", "skip", "fail"), batch_size=kind_of(int, "a whole number"), parallelism=kind_of(int, "a whole number"), schedule=text, read_mode=choice("snapshot_and_cdc", "cdc_only", "snapshot_only"), start_from=text)


def _table(v: Any, path: str) -> None:
    if isinstance(v, dict):
        shape(name=text, filter=text, pk=many(text), options=_FREE)(v, path)
    else:
        text(v, path)


def _source_options(v: Any, path: str) -> None:
    _FREE(v, path)
    for moved in ("snapshot_mode", "start_from"):  # these belong to a pipeline's settings
        if moved in v:
            raise Coded("dsl.unknown-field", field=moved, path=f"{path}.{moved}")


def _step(v: Any, path: str) -> None:
    if not isinstance(v, dict):
        return text(v, path)
    if "use" in v:
        return shape(id=identifier, use=text, from_=anything, options=_FREE)(v, path)
    if v.get("type") is None:
        raise Coded("dsl.composition", detail="a step needs a type or a use", path=f"{path}.type")
    return shape(id=identifier, type=choice(*BODIES), from_=anything, options=_FREE, experimental=_FREE, **BODIES.get(v["type"], {}))(v, path)


def _block(inline: dict[str, Check]) -> Check:
    def check(v: Any, path: str) -> None:
        if not isinstance(v, dict):
            text(v, path)
        else:
            shape(id=identifier, from_=text, **({"use": text} if "use" in v else inline))(v, path)

    return check


def _definition(fields: dict[str, Check]) -> Check:
    def check(v: Any, path: str) -> None:
        if "from" in v:
            raise Coded("dsl.forbidden-field", field="from", path="from")
        shape(**_HEAD, **fields)(v, path)

    return check


def _transform(v: Any, path: str) -> None:
    if v.get("type") is None:
        raise Coded("dsl.composition", detail="a transform definition needs a type", path="type")
    _definition({"type": choice(*BODIES), "options": _FREE, **BODIES.get(v["type"], {})})(v, path)


KINDS: dict[str, Check] = {
    "source": shape(**_HEAD, connector=text, config=_FREE, mode=choice("cdc", "snapshot", "stream", "file", "api"), tables=many(_table), options=_source_options, srs=shape(key=text, retention=text, schema_evolution=choice("track", "ignore"), queryable=kind_of(bool, "true or false"), enabled=kind_of(bool, "true or false"))),
    "pipeline": shape(**_HEAD, source=many(text), transforms=many(_step), view=_block(_VIEW), serve=_block(_SERVE), settings=_SETTINGS),
    "transform": _transform,
    "view": _definition(_VIEW),
    "serve": _definition(_SERVE),
}

# ---------------------------------------------------------------- resources


@dataclass(frozen=True)
class Resource:
    """A checked document with its sugar expanded: every step has an id and a ``from``, sources are a list."""

    kind: str
    id: str | None
    body: dict


def _wired(step: Any, index: int, previous: str | None) -> dict:
    """A step as a mapping with id and from; without a from it reads the step before it."""
    out = {"use": step} if not isinstance(step, dict) else dict(step)
    out["id"] = out.get("id") or out.get("use") or f"{out['type']}_{index + 1}"
    path = f"transforms[{index}].from"
    if out.get("type") in ("nest", "join"):
        if not isinstance(out.get("from"), dict):
            raise Coded("dsl.composition", detail="nest and join need a mapping of aliases", path=path)
        return out
    at = out.get("from")
    if at is None:
        if previous is None:
            raise Coded("dsl.composition", detail="the first step must say what it reads", path="transforms")
        at = previous
    if isinstance(at, dict):
        raise _bad("a mapping", "a scalar or list", path)
    out["from"] = [str(x) for x in at] if isinstance(at, list) else [str(at)]
    return out


def _wired_block(block: Any, name: str, previous: str | None) -> dict:
    out = {"use": block} if not isinstance(block, dict) else dict(block)
    out["id"] = out.get("id") or (out["use"] if "use" in out and name == "view" else name)
    if out.get("from") is None:
        if previous is None:
            raise Coded("dsl.composition", detail="nothing upstream to read from", path=f"{name}.from")
        out["from"] = previous
    for part in ("sync", "push"):
        if out.get(part) is not None:
            out[part] = [{**e, "id": e.get("id") or f"{part}_{i + 1}"} for i, e in enumerate(out[part])]
    return out


def load(text_: str, values: Mapping[str, str] | None = None) -> Resource:
    """A resource from the text of its document.  The first violation is raised, with its code and path."""
    doc = compose(interpolate(text_, values))
    if not isinstance(doc, dict):
        raise _bad(type(doc).__name__, "a mapping", "")
    kind = doc.get("kind")
    if kind not in KINDS:
        raise _bad(kind or "(absent)", "one of: " + ", ".join(KINDS), "kind")
    KINDS[kind](doc, "")
    body = {k: v for k, v in doc.items() if k not in ("version", "kind", "id")}
    if kind == "pipeline":
        sources = body.get("source") or []
        body["source"] = [str(s) for s in sources] if isinstance(sources, list) else [str(sources)]
        steps: list[dict] = []
        for i, s in enumerate(body.get("transforms") or []):
            steps.append(_wired(s, i, steps[-1]["id"] if steps else None))
        body["transforms"] = steps
        last = steps[-1]["id"] if steps else None
        if body.get("view") is not None:
            body["view"] = _wired_block(body["view"], "view", last)
            last = body["view"]["id"]
        if body.get("serve") is not None:
            body["serve"] = _wired_block(body["serve"], "serve", last)
    elif kind == "serve":
        body = {k: v for k, v in _wired_block({**body, "from": ""}, "serve", "").items() if k not in ("from", "id")}
    return Resource(kind, doc.get("id"), body)


def _sorted(v: Any) -> Any:
    if isinstance(v, dict):
        return {str(k): _sorted(x) for k, x in sorted(v.items(), key=lambda kv: str(kv[0])) if x is not None}
    return [_sorted(x) for x in v] if isinstance(v, list) else v


def canonical(r: Resource) -> str:
    """One text for all documents that mean the same.  Field rules keep their order, it is the order of the output."""
    body = dict(r.body)
    text_ = json.dumps({"kind": r.kind, "id": r.id, "body": _sorted(body), "fields": [list((s.get("fields") or {})) for s in body.get("transforms") or []] or list(body.get("fields") or {})}, ensure_ascii=False, sort_keys=True)
    return text_


def content_hash(r: Resource) -> str:
    return hashlib.sha256(canonical(r).encode()).hexdigest()


def probe_types(expr: str, scope: Scope) -> str:
    """The type of an expression under a table's model; the error kinds of the type gate are raised as codes."""
    try:
        return compile_value(expr, scope).type
    except ExpressionError as e:
        raise Coded(f"dsl.{e.kind}", expr=expr, detail=e, **e.args_) from e


__all__ = ["Resource", "canonical", "compose", "content_hash", "interpolate", "is_pattern", "load", "probe_types"]
