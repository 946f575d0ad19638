"""Deeply nested JSON documents as related flat tables, by shared inlining.

A grammar names the element types of a document and under which labels they lie.
The documents are parsed once, where they lie and without recursion; each leaves
its elements and the edges of the schema graph it uses (parent type, child type,
how, most children under one parent).  The graph of all documents decides what
becomes a table: the root, and every type that is repeated (declared so, or met
twice under one parent), shared by several parents or recursive.  Any other type
is a singleton descendant: it is inlined, as dotted attributes, into the nearest
table above it, and what named it as parent names that table's row instead.
Every row carries its own path and, as foreign key, the path of its parent.

The work of a task is the size of its documents; nothing is shuffled but the
edges, of which a document has no more than the grammar.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.storage import materialize, spread

#: How the value under a label leads to elements of the child type: itself (its elements, where it is a list), the elements of a list, the members of an object.
ONE, LIST, MEMBERS = "one", "list", "members"


@dataclass(frozen=True)
class Element:
    """An element type.  ``labels``: label -> (how, child type); ``others``: the type behind any other label or
    list index, None where nothing of interest lies there.  A transparent element is structure only and never a row;
    an ``anchor`` is what rows below it name as their parent."""

    labels: dict[str, tuple[str, str]] = field(default_factory=dict)
    others: tuple[str, str] | None = None
    transparent: bool = False
    anchor: bool = False


@dataclass(frozen=True)
class Grammar:
    root: str
    elements: dict[str, Element]


_BLANK = re.compile(r"[ \t\r\n]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")
_NAMED = {"true": True, "false": False, "null": None}


def _refuse(_: str):
    raise ValueError("no JSON constant")


def _loads(text: str):
    """A JSON text; numbers stay as they are written, however long."""
    try:
        return json.loads(text, parse_int=str, parse_float=str, parse_constant=_refuse)
    except RecursionError:
        return deep_loads(text)


def deep_loads(text: str):
    """The same for texts nested deeper than the parser's stack."""
    skip = lambda i: _BLANK.match(text, i).end()
    out: list = []
    open_: list = [out]
    names: list = [None]

    def put(value: object) -> None:
        if isinstance(open_[-1], dict):
            open_[-1][names[-1]] = value
        else:
            open_[-1].append(value)

    def name(i: int) -> int:
        """The position behind a member's name and colon."""
        if text[i : i + 1] != '"':
            raise ValueError(f"no name at {i}")
        names[-1], i = scanstring(text, i + 1)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return skip(i + 1)

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            value: dict | list = {} if c == "{" else []
            put(value)
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                open_.append(value)
                names.append(None)
                if c == "{":
                    i = name(i)
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1)
            put(value)
        elif m := _ATOM.match(text, i):
            put(_NAMED.get(m[0], m[0]))
            i = m.end()
        else:
            raise ValueError(f"no value at {i}")
        while True:  # a value has ended
            i = skip(i)
            if len(open_) == 1:
                if i != len(text):
                    raise ValueError(f"more at {i}")
                return out[0]
            c, inside = text[i : i + 1], isinstance(open_[-1], dict)
            if c == ",":
                i = skip(i + 1)
                if inside:
                    i = name(i)
                break
            if c != ("}" if inside else "]"):
                raise ValueError(f"no end at {i}")
            i += 1
            open_.pop()
            names.pop()


def _text(value: object) -> str:
    """An attribute's text: a string or number as it is, anything else as JSON."""
    if isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # punctuation
            out.append(x[0])
        elif isinstance(x, (dict, list)):
            parts: list = []
            for n, item in enumerate(x.items() if isinstance(x, dict) else x):
                lead = ", " if n else ""
                parts += [(f"{lead}{json.dumps(item[0], ensure_ascii=False)}: ",), item[1]] if isinstance(x, dict) else [(lead,), item]
            ends = "{}" if isinstance(x, dict) else "[]"
            todo += [(ends[1],), *reversed(parts), (ends[0],)]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def unfold(value):
    """A JSON object or list kept as text (also text inside text) as what it stands for; any other value as it is."""
    if not isinstance(value, str):
        return value
    inner = value
    while isinstance(inner, str):
        text = inner.strip(" \t\r\n﻿")
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = _loads(text)
        except ValueError:
            return value
    return inner if isinstance(inner, (dict, list)) else value


def elements_of(body: str | None, grammar: Grammar, attributes: bool = False) -> list[list]:
    """[type, path, owner, anchor, how, prefix, attributes] of every element in a body that is a whole JSON object, else nothing.

    Elements stand in an order where ``owner``, the place of the nearest element around, and ``anchor``, that of the nearest
    anchor around, come first (-1 for the root's); ``prefix`` is the label path from the owner.  Null elements and members
    are no elements but keep their index.
    """
    root = unfold(body) if body is not None else None
    if not isinstance(root, dict):
        return []
    rows: list[list] = [[grammar.root, "$", -1, -1, ONE, "", {}]]
    # value, type, path, owner, attribute prefix, what elements below name as parent
    stack = [(root, grammar.root, "$", 0, "", 0)]
    plain = Element()

    def element(x: object, child: str, path: str, owner: int, anchor: int, how: str, prefix: str) -> None:
        rows.append([child, path, owner, anchor, how, prefix, {}])
        if attributes or grammar.elements[child] != plain:
            at = len(rows) - 1
            stack.append((x, child, path, at, "", at if grammar.elements[child].anchor else anchor))

    while stack:
        value, kind, path, owner, prefix, anchor = stack.pop()
        value, rule, attrs = unfold(value), grammar.elements[kind], rows[owner][6]
        if isinstance(value, dict):
            items: Iterable = value.items()
        elif isinstance(value, list):
            items = ((str(i), x) for i, x in enumerate(value))
        else:
            if attributes and value is not None:
                attrs[prefix or "value"] = _text(value)
            continue
        labels = rule.labels if isinstance(value, dict) else {}
        for label, x in items:
            if x is None:
                continue
            how, child = labels.get(label) or rule.others or (None, None)
            at, name = f"{path}/{label}", f"{prefix}.{label}" if prefix else label
            if child is None:
                if attributes:
                    attrs[name] = _text(unfold(x))
            elif how == ONE and grammar.elements[child].transparent:
                stack.append((x, child, at, owner, name, anchor))
            elif how == MEMBERS:
                x = unfold(x)
                beyond = rule.others[1] if rule.others else None
                if isinstance(x, dict):
                    for key, y in x.items():
                        if y is not None:
                            element(y, child, f"{at}/{key}", owner, anchor, how, name)
                elif beyond and isinstance(x, list):
                    stack.append((x, beyond, at, owner, name, anchor))
            else:
                x = unfold(x)
                if how == ONE and not isinstance(x, list):
                    element(x, child, at, owner, anchor, how, name)
                    continue
                for i, y in enumerate(x) if isinstance(x, list) else [(0, x)]:
                    if y is not None:
                        element(y, child, f"{at}/{i}", owner, anchor, how, name)
    return rows


def edges_of(rows: list[list]) -> list[tuple[str, str, str, int]]:
    """(parent type, child type, how, most children under one parent) of the edges a document uses."""
    under: dict[tuple, int] = {}
    for kind, _, owner, _, how, prefix, _ in rows[1:]:
        under[owner, kind, how, prefix] = under.get((owner, kind, how, prefix), 0) + 1
    most: dict[tuple, int] = {}
    for (owner, kind, how, _), n in under.items():
        e = rows[owner][0], kind, how
        most[e] = max(most.get(e, 0), n)
    return sorted((*e, n) for e, n in most.items())


def tables_of(edges: Iterable[tuple[str, str, str, int]], root: str) -> list[str]:
    """Types that need a table of their own: the root, repeated, shared and recursive ones."""
    below: dict[str, set[str]] = {}
    above: dict[str, set[str]] = {}
    repeated = set()
    for parent, child, how, most in edges:
        below.setdefault(parent, set()).add(child)
        above.setdefault(child, set()).add(parent)
        if how != ONE or most > 1:
            repeated.add(child)
    shared = {c for c, parents in above.items() if len(parents) > 1}

    def reaches_itself(kind: str) -> bool:
        seen, todo = set(), [kind]
        while todo:
            for c in below.get(todo.pop(), ()):
                if c == kind:
                    return True
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return False

    return sorted({root} | repeated | shared | {k for k in above if reaches_itself(k)})


def inlined(rows: list[list], tables: frozenset[str]) -> Iterator[tuple[str, str, str, dict]]:
    """(type, path, parent path, attributes) of the rows of the tables, with the attributes of the singletons below them."""
    home: list[int] = []  # where an element's content goes
    for i, (kind, _, owner, _, _, prefix, attrs) in enumerate(rows):
        home.append(i if kind in tables else home[owner])
        if kind not in tables:
            rows[i][5] = prefix = f"{rows[owner][5]}.{prefix}" if rows[owner][0] not in tables else prefix
            rows[home[i]][6].update({prefix if k == "value" and len(attrs) == 1 else f"{prefix}.{k}": v for k, v in attrs.items()})
    for kind, path, _, anchor, _, _, attrs in rows:
        if kind in tables:
            yield kind, path, "" if anchor < 0 else rows[home[anchor]][1], attrs


_ELEMENTS = "array<struct<type:string,path:string,owner:int,anchor:int,how:string,prefix:string{}>>"
_EDGES = "array<struct<parent:string,child:string,how:string,most:int>>"


def parsed(df: DataFrame, key: str, body: str, grammar: Grammar, attributes: bool = False) -> DataFrame:
    """Documents (``_k``, ``elements``, ``edges``), each parsed once and written; those that are no whole object are left out."""

    def frame(*columns: list) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("_k", "elements", "edges"), columns)})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, elements, edges, n = [], [], [], 0
            for k, text in zip(batch["_k"], batch["_b"]):
                if rows := elements_of(text, grammar, attributes):
                    keys.append(k)
                    elements.append([tuple(r if attributes else r[:6]) for r in rows])
                    edges.append(edges_of(rows))
                    n += len(rows)
                if n > 50_000:
                    yield frame(keys, elements, edges)
                    keys, elements, edges, n = [], [], [], 0
            yield frame(keys, elements, edges)

    kinds = _ELEMENTS.format(",attributes:map<string,string>" if attributes else "")
    bodies = spread(df.select(F.col(key).alias("_k"), F.col(body).cast("string").alias("_b")))
    return materialize(bodies.mapInPandas(parse, f"_k {df.schema[key].dataType.simpleString()}, elements {kinds}, edges {_EDGES}"), "elements")


def schema_graph(documents: DataFrame) -> list[tuple[str, str, str, int]]:
    """The edges between element types that parsed documents use, never more than the grammar has."""
    e = documents.select(F.explode("edges").alias("e")).groupBy("e.parent", "e.child", "e.how").agg(F.max("e.most"))
    return sorted(tuple(r) for r in e.collect())


def shred(df: DataFrame, key: str, body: str, grammar: Grammar, attributes: bool = False) -> DataFrame:
    """Rows (``key``, ``entity``, ``node_path``, ``parent_path``[, ``attributes``]) of all tables.

    Bodies that are null, empty, cut off or no JSON object have no rows; repeated descriptions have rows each;
    a null key is kept.  Other columns of ``df`` are not read.
    """
    documents = parsed(df, key, body, grammar, attributes)
    edges = schema_graph(documents)
    tables = frozenset(tables_of(edges, grammar.root))
    away = {c for _, c, _, _ in edges} - tables
    kind = df.schema[key].dataType.simpleString()
    if not (away and (attributes or any(grammar.elements[c].anchor for c in away))):  # parents are rows: their paths stand in the same array
        e = F.col("e")
        parent = F.when(e["anchor"] < 0, "").otherwise(F.get("elements", e["anchor"])["path"])
        columns = [F.col("_k").alias(key), e["type"].alias("entity"), e["path"].alias("node_path"), parent.alias("parent_path"), *([e["attributes"].alias("attributes")] if attributes else [])]
        return documents.select("_k", "elements", F.explode("elements").alias("e")).where(e["type"].isin(*tables)).select(*columns)
    names = [key, "entity", "node_path", "parent_path", *(["attributes"] if attributes else [])]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["type", "path", "owner", "anchor", "how", "prefix"]
        for batch in batches:
            out = []
            for k, elements in zip(batch["_k"], batch["elements"]):
                rows = [[*(e[f] for f in fields), dict(e["attributes"]) if attributes else {}] for e in elements]
                out += [(k, *r)[: len(names)] for r in inlined(rows, tables)]
            yield pd.DataFrame(out, columns=names)

    schema = f"`{key}` {kind}, entity string, node_path string, parent_path string" + (", attributes map<string,string>" if attributes else "")
    return documents.select("_k", "elements").mapInPandas(place, schema)


def flat_table(rows: DataFrame, key: str, entity: str, columns: dict[str, str]) -> DataFrame:
    """One flat table of shredded rows: key, own path, parent path and the attributes named, output name -> attribute."""
    return rows.where(F.col("entity") == entity).select(key, "node_path", "parent_path", *[F.col("attributes")[a].alias(c) for c, a in columns.items()])
