"""Syntax tree -> Spark column, with the language's types and errors.

Every node becomes a pair: the value and, where it can fail, a text that says why
(null: it did not).  Values are computed by expressions that never throw, so
Catalyst may evaluate them in any order; ``&&`` and ``||`` absorb an error of one
side as the language wants; only the root raises.  Where types and the discovered
model prove that nothing can fail, no error is carried at all, the root is the
plain predicate, and it is pushed into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.expressions.parser import ExpressionError, Node, parse

#: Types whose values may be carried but not computed on (fixed values of the type system).
OPAQUE = {"DECIMAL", "DATE", "TIME", "DATETIME", "YEAR", "JSON"}


def logical_type(f: T.StructField) -> str:
    """Type of a column in the closed set of 14; the discovered model may name it in the field's metadata."""
    named = (f.metadata or {}).get("type")
    if named:
        return named
    d = f.dataType
    for kinds, name in (
        ((T.StringType, T.VarcharType, T.CharType), "STRING"), ((T.LongType, T.IntegerType, T.ShortType, T.ByteType), "INT64"),
        ((T.DoubleType, T.FloatType), "DOUBLE"), (T.BooleanType, "BOOLEAN"), (T.BinaryType, "BINARY"), (T.DecimalType, "DECIMAL"), (T.DateType, "DATE"),
        ((T.TimestampType, T.TimestampNTZType), "DATETIME"), (T.ArrayType, "ARRAY"), ((T.MapType, T.StructType), "MAP"), (T.VariantType, "JSON"),
    ):
        if isinstance(d, kinds):
            return name
    return "UNKNOWN"


@dataclass(frozen=True)
class Value:
    """A compiled node: language type, value, error (None: cannot fail) and what is known of it."""

    type: str
    col: Column | None
    err: Column | None = None
    maybe_null: bool = False
    spark: T.DataType | None = None  # of structs, arrays and maps
    lit: object = None  # of literals
    label: str = ""  # of columns, for messages


@dataclass
class Scope:
    """What an expression can name.  ``rows``: root name -> struct type of its row; ``present``: rows that are never
    null; ``plain``: other root names -> (type, column); ``columns``: raw columns named directly (table filters)."""

    rows: dict[str, T.StructType] = field(default_factory=dict)
    present: frozenset[str] = frozenset()
    plain: dict[str, tuple[str, Column]] = field(default_factory=dict)
    columns: T.StructType | None = None
    now: Column | None = None

    @classmethod
    def envelope(cls, schema: T.StructType, present: frozenset[str] | set[str] = frozenset()) -> "Scope":
        rows = {n: schema[n].dataType for n in ("before", "after") if n in schema.names}
        plain = {"op": ("string", F.col("op")), "ts": ("int", F.col("ts")), "src": ("string", F.col("src")), "schema": ("map(string)", F.col("schema"))}
        return cls(rows, frozenset(present), plain, now=F.timestamp_millis(F.col("ts")))


def _UINT_MAX() -> Column:  # noqa: N802
    return F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")


def _fails(when: Column, why: str) -> Column:
    return F.when(when, F.lit(why))


def _first(*errors: Column | None) -> Column | None:
    real = [e for e in errors if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


#: Names of types, as ``type()`` gives them.
_TYPE_NAMES = ("int", "uint", "double", "bool", "string", "bytes", "list", "map", "null_type", "timestamp", "duration")


def _fraction(micros: Column) -> Column:
    """Digits behind the point of a second, without closing zeros; nothing for whole seconds."""
    return F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(micros.cast("string"), 6, "0"), F.lit("0"))))


def _strict(v: Value, what: str) -> Column | None:
    """Error of an operand that may not be null."""
    return _first(v.err, _fails(v.col.isNull(), f"no such overload: {what} of null") if v.maybe_null else None)


def column_value(f: T.StructField, col: Column, present: Column | None = None) -> Value:
    """A table column by its logical type; whole numbers widen to 64 bits, float to double."""
    kind, missing = logical_type(f), None if present is None else _fails(~present, f"no such field: {f.name}")
    null = f.nullable and not (f.metadata or {}).get("required")  # NOT NULL in the discovered model
    null = null or present is not None
    if kind == "UNKNOWN":
        raise ExpressionError(f"column {f.name} has no known type", "row-expression-type-unknown", column=f.name)
    if kind in OPAQUE:
        return Value(f"opaque:{kind}", col, missing, null, f.dataType, label=f.name)
    kinds = {"STRING": "string", "DOUBLE": "double", "BOOLEAN": "bool", "BINARY": "bytes", "ARRAY": "list", "MAP": "map"}
    if kind == "INT64":
        if isinstance(f.dataType, T.DecimalType):  # unsigned 64-bit: beyond the signed range it cannot be computed on
            return Value("int", col.try_cast("bigint"), _first(missing, _fails(col.isNotNull() & col.try_cast("bigint").isNull(), "integer overflow")), null)
        return Value("int", col if isinstance(f.dataType, T.LongType) else col.cast("bigint"), missing, null)
    return Value(kinds[kind], col.cast("double") if kind == "DOUBLE" and not isinstance(f.dataType, T.DoubleType) else col, missing, null, f.dataType)


class _Compiler:
    def __init__(self, scope: Scope):
        self.scope, self.locals = scope, {}

    def visit(self, n: Node) -> Value:
        return getattr(self, f"on_{n.kind}")(n)

    def operand(self, n: Node) -> Value:
        v = self.visit(n)
        if v.type.startswith("opaque:"):
            raise ExpressionError(f"{v.label or 'value'} of type {v.type[7:]} can be carried but not computed on", "row-expression-type-unsupported", column=v.label, type=v.type[7:])
        if v.type == "row":
            raise ExpressionError("a whole row is no operand")
        return v

    # --- names, fields, literals
    def on_lit(self, n: Node) -> Value:
        if n.type == "int" and not -(1 << 63) <= n.value < 1 << 63:
            raise ExpressionError("integer literal out of range")
        if n.type == "uint":
            return Value("uint", F.lit(str(n.value)).cast("decimal(20,0)"), lit=n.value)
        cast = {"int": "bigint", "double": "double", "string": "string", "bool": "boolean", "bytes": "binary", "null": "void"}[n.type]
        return Value(n.type, F.lit(n.value) if n.type == "bytes" else F.lit(n.value).cast(cast), maybe_null=n.type == "null", lit=n.value)

    def on_name(self, n: Node) -> Value:
        s = self.scope
        if n.value in self.locals:
            return self.locals[n.value]
        if s.columns is not None:
            if n.value in s.columns.names:
                return column_value(s.columns[n.value], F.col(f"`{n.value}`"))
            if n.value in _TYPE_NAMES:
                return Value("string", F.lit(n.value), lit=n.value)
            raise ExpressionError(f"undeclared reference to {n.value!r}")
        if n.value in s.rows:
            return Value("row", F.col(n.value), None, n.value not in s.present, s.rows[n.value], label=n.value)
        if n.value in s.plain:
            kind, col = s.plain[n.value]
            return Value(kind, col, None, n.value not in ("op", "src", "ts"), label=n.value)
        if n.value in _TYPE_NAMES:
            return Value("string", F.lit(n.value), lit=n.value)
        raise ExpressionError(f"undeclared reference to {n.value!r}")

    def on_field(self, n: Node) -> Value:
        base, name = self.visit(n.kids[0]), n.value
        if base.type == "row":
            there = base.col.isNotNull() if base.maybe_null else None
            if name not in base.spark.names:
                return Value("dyn", F.lit(None), F.lit(f"no such field: {name}"), True)
            return column_value(base.spark[name], base.col[name], there)
        return self.member(base, name)

    def member(self, base: Value, name: str) -> Value:
        err = _strict(base, f"field {name}")
        if isinstance(base.spark, T.StructType):
            if name not in base.spark.names:
                return Value("dyn", F.lit(None), F.lit(f"no such field: {name}"), True)
            v = column_value(base.spark[name], base.col[name])
            return Value(v.type, v.col, _first(err, v.err), True, v.spark, label=name)
        if base.type.startswith("map"):
            inner = base.spark.valueType if isinstance(base.spark, T.MapType) else T.StringType()
            v = column_value(T.StructField(name, inner), F.try_element_at(base.col, F.lit(name)))
            return Value(v.type, v.col, _first(err, _fails(~F.map_contains_key(base.col, F.lit(name)), f"no such key: {name}"), v.err), True, v.spark, label=name)
        raise ExpressionError(f"{base.type} has no field {name!r}")

    def on_has(self, n: Node) -> Value:
        base = self.visit(n.kids[0])
        if base.type in ("row",) or isinstance(base.spark, T.StructType):
            known = n.value in base.spark.names
            if known and logical_type(base.spark[n.value]) == "UNKNOWN":
                raise ExpressionError(f"column {n.value} has no known type", "row-expression-type-unknown", column=n.value)
            col = F.lit(known) if not (known and base.maybe_null) else base.col.isNotNull()
            if known and base.type == "row" and "_fields" in base.spark.names:  # rows of several tables: each says which fields it has
                col = F.coalesce(F.array_contains(base.col["_fields"], F.lit(n.value)), F.lit(False))
            return Value("bool", col, base.err)
        if base.type.startswith("map"):
            return Value("bool", F.map_contains_key(base.col, F.lit(n.value)), _strict(base, "has"))
        raise ExpressionError(f"{base.type} has no fields")

    def on_index(self, n: Node) -> Value:
        base, key = self.visit(n.kids[0]), self.operand(n.kids[1])
        if base.type == "row":
            raise ExpressionError(f"write {base.label}.field, not {base.label}[...]")
        if base.type.startswith("map"):
            if key.lit is not None and isinstance(key.lit, str):
                return self.member(base, key.lit)
            return Value("dyn" if base.spark else "string", F.try_element_at(base.col, key.col), _first(_strict(base, "index"), key.err, _fails(~F.map_contains_key(base.col, key.col), "no such key")), True)
        if base.type != "list" or key.type not in ("int", "dyn"):
            raise ExpressionError(f"no such overload: {base.type}[{key.type}]")
        bad = _fails((key.col < 0) | (key.col >= F.size(base.col)), "index out of range")
        inner = base.spark.elementType if isinstance(base.spark, T.ArrayType) else T.StringType()
        v = column_value(T.StructField("element", inner), F.get(base.col, key.col.cast("int")))
        return Value(v.type, v.col, _first(_strict(base, "index"), _strict(key, "index"), bad, v.err), True, v.spark)

    def on_list(self, n: Node) -> Value:
        items = [self.visit(k) for k in n.kids]
        kinds = {i.type for i in items} - {"null"}
        if len(kinds) > 1:
            raise ExpressionError("list elements must have one type")
        if not items:
            return Value("list", F.array().cast("array<string>"), spark=T.ArrayType(T.StringType()))
        return Value("list", F.array(*[i.col for i in items]), _first(*[i.err for i in items]), spark=T.ArrayType(_spark_type(items[0])))

    def on_map(self, n: Node) -> Value:
        items = [self.visit(k) for k in n.kids]
        if not items:
            return Value("map", F.create_map().cast("map<string,string>"), spark=T.MapType(T.StringType(), T.StringType()))
        if len({i.type for i in items[::2]}) > 1 or len({i.type for i in items[1::2]} - {"null"}) > 1:
            raise ExpressionError("map keys and values must each have one type")
        return Value("map", F.create_map(*[i.col for i in items]), _first(*[i.err for i in items]), spark=T.MapType(_spark_type(items[0]), _spark_type(items[1])))

    # --- operators
    def on_cond(self, n: Node) -> Value:
        test, yes, no = self.operand(n.kids[0]), self.visit(n.kids[1]), self.visit(n.kids[2])
        if test.type not in ("bool", "dyn") or (yes.type != no.type and "dyn" not in (yes.type, no.type) and "null" not in (yes.type, no.type)):
            raise ExpressionError(f"no such overload: {test.type} ? {yes.type} : {no.type}")
        inner = None
        if yes.err is not None or no.err is not None:
            inner = F.when(test.col, yes.err if yes.err is not None else F.lit(None)).otherwise(no.err if no.err is not None else F.lit(None))
        kind = no if yes.type in ("null", "dyn") else yes
        return Value(kind.type, F.when(test.col, yes.col).otherwise(no.col), _first(_strict(test, "?:"), inner), yes.maybe_null or no.maybe_null, kind.spark)

    def on_op(self, n: Node) -> Value:
        op = n.value
        if op == "!_":
            v = self.operand(n.kids[0])
            self.want(v, "bool", "!")
            return Value("bool", ~v.col, _strict(v, "!"))
        if op == "-_":
            v = self.operand(n.kids[0])
            if v.type not in ("int", "double", "duration", "dyn"):
                raise ExpressionError(f"no such overload: -{v.type}")
            bad = _fails(v.col == F.lit(-(1 << 63)), "integer overflow") if v.type == "int" else None
            return Value(v.type, F.try_subtract(F.lit(0).cast("bigint"), v.col) if v.type == "int" else -v.col, _first(_strict(v, "-"), bad))
        left, right = self.operand(n.kids[0]), self.operand(n.kids[1])
        if op in ("&&", "||"):
            return self.logic(op, left, right)
        if op in ("==", "!="):
            if left.type != right.type and not {"dyn", "null"} & {left.type, right.type}:
                raise ExpressionError(f"no such overload: {left.type} {op} {right.type}")
            plain = (not left.maybe_null or not right.maybe_null) and "null" not in (left.type, right.type) and not (left.maybe_null or right.maybe_null)
            same = (left.col == right.col) if plain else left.col.eqNullSafe(right.col)
            return Value("bool", same if op == "==" else ~same, _first(left.err, right.err))
        if op == "in":
            if right.type == "list":
                # null stands for itself among the elements
                return Value("bool", F.coalesce(F.array_contains(right.col, left.col), F.lit(False)), _first(left.err, _strict(right, "in")))
            if right.type.startswith("map"):
                return Value("bool", F.coalesce(F.map_contains_key(right.col, left.col), F.lit(False)), _first(_strict(left, "in"), _strict(right, "in")))
            raise ExpressionError(f"no such overload: {left.type} in {right.type}")
        err = _first(_strict(left, op), _strict(right, op))
        kinds = (left.type, right.type)
        if op in ("<", "<=", ">", ">="):
            if kinds[0] != kinds[1] and "dyn" not in kinds or kinds[0] in ("list", "map", "null"):
                raise ExpressionError(f"no such overload: {kinds[0]} {op} {kinds[1]}")
            return Value("bool", {"<": left.col < right.col, "<=": left.col <= right.col, ">": left.col > right.col, ">=": left.col >= right.col}[op], err)
        return self.arithmetic(op, left, right, err)

    def want(self, v: Value, kind: str, what: str) -> None:
        if v.type not in (kind, "dyn"):
            raise ExpressionError(f"no such overload: {what} of {v.type}")

    def logic(self, op: str, a: Value, b: Value) -> Value:
        self.want(a, "bool", op)
        self.want(b, "bool", op)
        ea, eb = _strict(a, op), _strict(b, op)
        both = (a.col & b.col) if op == "&&" else (a.col | b.col)
        if ea is None and eb is None:
            return Value("bool", both)
        decides = (lambda v: ~v.col) if op == "&&" else (lambda v: v.col)
        sure = lambda v, e: F.coalesce(decides(v) if e is None else (e.isNull() & decides(v)), F.lit(False))
        settled = sure(a, ea) | sure(b, eb)
        return Value("bool", F.when(settled, F.lit(op == "||")).otherwise(F.lit(op == "&&")), F.when(~settled, _first(ea, eb)))

    def arithmetic(self, op: str, a: Value, b: Value, err: Column | None) -> Value:
        kinds = (a.type, b.type)
        if "dyn" in kinds:
            kinds = tuple(k if k != "dyn" else next((x for x in kinds if x != "dyn"), "int") for k in kinds)
        whole = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
        if kinds == ("int", "int"):
            if op in whole:
                col = whole[op](a.col, b.col)
                return Value("int", col, _first(err, _fails(col.isNull(), "integer overflow")))
            zero = _fails(b.col == 0, "divide by zero" if op == "/" else "modulus by zero")
            safe = F.when(b.col != 0, b.col)
            if op == "/":
                col = F.when(~((a.col == F.lit(-(1 << 63))) & (b.col == -1)), F.call_function("div", a.col, safe))
                return Value("int", col, _first(err, zero, _fails(col.isNull(), "integer overflow")))
            return Value("int", a.col % safe, _first(err, zero))
        if kinds == ("uint", "uint"):
            if op in whole:
                col = whole[op](a.col, b.col).try_cast("decimal(20,0)")
                return Value("uint", col, _first(err, _fails(col.isNull() | (col < 0) | (col > _UINT_MAX()), "unsigned overflow")))
            zero = _fails(b.col == 0, "divide by zero" if op == "/" else "modulus by zero")
            safe = F.when(b.col != 0, b.col)
            return Value("uint", (F.floor(a.col / safe) if op == "/" else a.col % safe).cast("decimal(20,0)"), _first(err, zero))
        if kinds == ("double", "double") and op != "%":
            if op == "/":  # a quotient by zero is infinite, or no number
                none = F.when((a.col == 0) | F.isnan(a.col), F.lit(float("nan"))).when(a.col > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
                return Value("double", F.when(b.col == 0, none).otherwise(a.col / F.when(b.col != 0, b.col)), err)
            return Value("double", {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], err)
        if op == "+" and kinds in (("string", "string"), ("bytes", "bytes"), ("list", "list")):
            return Value(kinds[0], F.concat(a.col, b.col), err, spark=a.spark)
        if kinds == ("timestamp", "duration") and op in "+-":
            return Value("timestamp", a.col + b.col if op == "+" else a.col - b.col, err)
        if kinds == ("duration", "timestamp") and op == "+":
            return Value("timestamp", b.col + a.col, err)
        if kinds == ("duration", "duration") and op in "+-":
            return Value("duration", a.col + b.col if op == "+" else a.col - b.col, err)
        if kinds == ("timestamp", "timestamp") and op == "-":
            return Value("duration", a.col - b.col, err)
        raise ExpressionError(f"no such overload: {kinds[0]} {op} {kinds[1]}")

    # --- macros and functions
    def on_macro(self, n: Node) -> Value:
        base, var, body = self.operand(n.kids[0]), n.kids[1].value, n.kids[2:]
        if base.type.startswith("map"):
            base = Value("list", F.map_keys(base.col), base.err, base.maybe_null, T.ArrayType(base.spark.keyType if base.spark else T.StringType()))
        if base.type != "list":
            raise ExpressionError(f"no such overload: {base.type}.{n.value}")
        inner = base.spark.elementType if isinstance(base.spark, T.ArrayType) else T.StringType()

        def at(x: Column, part: Node) -> Value:
            saved, self.locals = self.locals, self.locals | {var: column_value(T.StructField(var, inner), x)}
            try:
                return self.operand(part)
            finally:
                self.locals = saved

        probe = [at(F.lit(None), p) for p in body]
        tests = probe[:1] if n.value != "map" or len(body) == 2 else []
        for p in tests:
            self.want(p, "bool", n.value)
        good = lambda part: lambda x: F.coalesce(at(x, part).col, F.lit(False))
        bad = lambda part: lambda x: F.coalesce(_strict(at(x, part), n.value).isNotNull(), F.lit(False))
        outer = _strict(base, n.value)
        fails = lambda part: None if _strict(at(F.lit(None), part), n.value) is None else F.exists(base.col, bad(part))
        broken = fails(body[0]) if tests else None
        why = f"evaluation failed in {n.value}"
        if n.value == "exists":
            col = F.exists(base.col, good(body[0]))
            return Value("bool", col, _first(outer, None if broken is None else _fails(~col & broken, why)))
        if n.value == "all":
            denied = F.exists(base.col, lambda x: F.coalesce(~at(x, body[0]).col, F.lit(False)))
            return Value("bool", ~denied, _first(outer, None if broken is None else _fails(~denied & broken, why)))
        err = _first(outer, None if broken is None else _fails(broken, why))
        if n.value == "exists_one":
            return Value("bool", F.size(F.filter(base.col, good(body[0]))) == 1, err)
        if n.value == "filter":
            return Value("list", F.filter(base.col, good(body[0])), err, spark=base.spark)
        kept = F.filter(base.col, good(body[0])) if len(body) == 2 else base.col
        out = body[-1]
        last = at(F.lit(None), out)
        moved = None if last.err is None else _fails(F.exists(kept, lambda x: F.coalesce(at(x, out).err.isNotNull(), F.lit(False))), why)
        return Value("list", F.transform(kept, lambda x: at(x, out).col), _first(err, moved), spark=T.ArrayType(_spark_type(last)))

    def on_call(self, n: Node) -> Value:
        name = n.value
        if name == "now" and not n.kids:
            if self.scope.now is None:
                raise ExpressionError("now() has no event here")
            return Value("timestamp", self.scope.now)
        args = [self.operand(k) if name != "dyn" else self.visit(k) for k in n.kids]
        f: Callable | None = getattr(self, f"fn_{name}", None)
        if f is None and re.fullmatch(r"get[A-Z]\w+", name) and n.type == "method":
            return self.part(name, args)
        if f is None:
            raise ExpressionError(f"undeclared function {name!r}")
        try:
            return f(*args)
        except TypeError:
            raise ExpressionError(f"no such overload: {name}({', '.join(a.type for a in args)})") from None

    def fn_size(self, v: Value) -> Value:
        if v.type == "string":
            col = F.char_length(v.col)
        elif v.type == "bytes":
            col = F.octet_length(v.col)
        elif v.type == "list" or v.type.startswith("map"):
            col = F.size(v.col)
        else:
            raise TypeError
        return Value("int", col.cast("bigint"), _strict(v, "size"))

    def text(self, a: Value, b: Value, what: str, col: Callable[[Column, Column], Column]) -> Value:
        if a.type not in ("string", "dyn") or b.type not in ("string", "dyn"):
            raise TypeError
        return Value("bool", col(a.col, b.col), _first(_strict(a, what), _strict(b, what)))

    def fn_contains(self, a: Value, b: Value) -> Value:
        return self.text(a, b, "contains", lambda x, y: F.contains(x, y))

    def fn_startsWith(self, a: Value, b: Value) -> Value:  # noqa: N802
        return self.text(a, b, "startsWith", lambda x, y: F.startswith(x, y))

    def fn_endsWith(self, a: Value, b: Value) -> Value:  # noqa: N802
        return self.text(a, b, "endsWith", lambda x, y: F.endswith(x, y))

    def fn_matches(self, a: Value, b: Value) -> Value:
        if not isinstance(b.lit, str):
            raise ExpressionError("matches() takes a literal pattern")
        if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?>|[*+?}]\+", b.lit):
            raise ExpressionError("the pattern uses lookaround, back references or possessive repeats")
        try:
            re.compile(b.lit)
        except re.error as e:
            raise ExpressionError(f"invalid pattern: {e}") from None
        return self.text(a, b, "matches", lambda x, y: F.rlike(x, y))

    def convert(self, v: Value, what: str, to: str, kinds: tuple[str, ...], spark: str, extra: Callable[[Column], Column] | None = None) -> Value:
        if v.type not in (*kinds, "dyn"):
            raise TypeError
        col = v.col.try_cast(spark) if v.type != to else v.col
        bad = _fails(v.col.isNotNull() & (col.isNull() | (extra(v.col) if extra else F.lit(False))), f"cannot convert to {what}") if v.type != to else None
        return Value(to, col, _first(_strict(v, what), bad))

    def fn_int(self, v: Value) -> Value:
        if v.type == "timestamp":
            return Value("int", F.unix_seconds(v.col), _strict(v, "int"))
        if v.type == "string":  # digits only; a fraction or blanks are no whole number
            return self.convert(v, "int", "int", ("string",), "bigint", lambda c: ~F.rlike(c, F.lit(r"^[+-]?\d+$")))
        return self.convert(v, "int", "int", ("int", "uint", "double"), "bigint", (lambda c: F.isnan(c)) if v.type == "double" else None)

    def fn_uint(self, v: Value) -> Value:
        out = self.convert(v, "uint", "uint", ("int", "uint", "double", "string"), "decimal(20,0)")
        return Value("uint", F.floor(out.col).cast("decimal(20,0)") if v.type == "double" else out.col, _first(out.err, _fails((out.col < 0) | (out.col > _UINT_MAX()), "cannot convert to uint")))

    def fn_double(self, v: Value) -> Value:
        return self.convert(v, "double", "double", ("int", "uint", "double", "string"), "double")

    def fn_string(self, v: Value) -> Value:
        if v.type == "timestamp":
            at = F.unix_micros(v.col.cast("timestamp"))
            # the fraction only where there is one, without closing zeros
            whole = F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss")
            return Value("string", F.concat(whole, _fraction(F.pmod(at, F.lit(1_000_000))), F.lit("Z")), _strict(v, "string"))
        if v.type == "duration":  # seconds, however long
            micros = F.unix_micros(F.timestamp_micros(F.lit(0)) + v.col)
            size = F.abs(micros)
            text = F.concat(F.when(micros < 0, "-").otherwise(""), F.call_function("div", size, F.lit(1_000_000)).cast("string"), _fraction(size % 1_000_000), F.lit("s"))
            return Value("string", text, _strict(v, "string"))
        if v.type == "bytes":
            return Value("string", F.try_validate_utf8(v.col.cast("string")), _first(_strict(v, "string"), _fails(~F.is_valid_utf8(v.col.cast("string")), "invalid UTF-8")))
        return self.convert(v, "string", "string", ("int", "uint", "double", "bool", "string"), "string")

    def fn_bytes(self, v: Value) -> Value:
        return self.convert(v, "bytes", "bytes", ("string", "bytes"), "binary")

    def fn_bool(self, v: Value) -> Value:
        return self.convert(v, "bool", "bool", ("string", "bool"), "boolean", (lambda c: ~c.isin("1", "t", "T", "true", "TRUE", "True", "0", "f", "F", "false", "FALSE", "False")) if v.type == "string" else None)

    def fn_dyn(self, v: Value) -> Value:
        return v

    def fn_type(self, v: Value) -> Value:
        return Value("string", F.when(v.col.isNull(), "null_type").otherwise(v.type.split("(")[0]) if v.maybe_null else F.lit(v.type.split("(")[0]), v.err)

    def fn_timestamp(self, v: Value) -> Value:
        if v.type == "timestamp":
            return v
        if v.type == "int":
            return Value("timestamp", F.timestamp_seconds(v.col), _strict(v, "timestamp"))
        if v.type not in ("string", "dyn"):
            raise TypeError
        shape = F.rlike(v.col, F.lit(r"^\d{4}-\d\d-\d\d([Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d))?$"))
        col = F.when(shape, F.upper(v.col).try_cast("timestamp"))
        return Value("timestamp", col, _first(_strict(v, "timestamp"), _fails(v.col.isNotNull() & col.isNull(), "cannot convert to timestamp")))

    def fn_duration(self, v: Value) -> Value:
        if v.type == "duration":
            return v
        if not isinstance(v.lit, str) or not re.fullmatch(r"-?(?:\d+(?:\.\d+)?(?:h|ms|us|ns|m|s))+|0", v.lit):
            raise ExpressionError("duration() takes a literal such as '1h30m'")
        unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
        sec = sum(float(x) * unit[u] for x, u in re.findall(r"(\d+(?:\.\d+)?)(h|ms|us|ns|m|s)", v.lit)) * (-1 if v.lit[0] == "-" else 1)
        return Value("duration", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(sec).cast("decimal(18,6)")))

    def part(self, name: str, args: list[Value]) -> Value:
        """Part of a timestamp; months, days of month, week and year count from 0, as the language has it."""
        v = args[0]
        if v.type not in ("timestamp", "dyn"):
            raise ExpressionError(f"no such overload: {v.type}.{name}()")
        c = v.col
        if len(args) == 2:
            if args[1].type != "string":
                raise ExpressionError(f"{name} takes a time zone")
            c = F.from_utc_timestamp(c, args[1].col)
        parts = {
            "getFullYear": lambda: F.year(c), "getMonth": lambda: F.month(c) - 1, "getDate": lambda: F.dayofmonth(c), "getDayOfMonth": lambda: F.dayofmonth(c) - 1,
            "getDayOfWeek": lambda: F.dayofweek(c) - 1, "getDayOfYear": lambda: F.dayofyear(c) - 1, "getHours": lambda: F.hour(c), "getMinutes": lambda: F.minute(c),
            "getSeconds": lambda: F.second(c), "getMilliseconds": lambda: F.call_function("div", F.pmod(F.unix_micros(c), F.lit(1_000_000).cast("bigint")), F.lit(1000).cast("bigint")),
        }
        if name not in parts:
            raise ExpressionError(f"undeclared function {name!r}")
        return Value("int", parts[name]().cast("bigint"), _strict(v, name))


def _spark_type(v: Value) -> T.DataType:
    if v.spark is not None:
        return v.spark
    return {"int": T.LongType(), "uint": T.DecimalType(20, 0), "double": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "timestamp": T.TimestampType()}.get(v.type, T.StringType())


def compile_value(text: str, scope: Scope) -> Value:
    """Value and error of an expression; raises ExpressionError where it is wrong whatever the row."""
    v = _Compiler(scope).visit(parse(text))
    if v.type == "row":
        raise ExpressionError("a whole row is no value")
    return v


def _raised(text: str, err: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"transform.expression-failed: {' '.join(text.split())[:160]}: "), err))


def compile_column(text: str, scope: Scope) -> Column:
    """The value; a row on which the expression fails fails the job."""
    v = compile_value(text, scope)
    return v.col if v.err is None else F.when(v.err.isNotNull(), _raised(text, v.err)).otherwise(v.col)


def compile_predicate(text: str, scope: Scope) -> tuple[Column, Column | None]:
    """(condition, error) of a filter: only true keeps a row; a null condition is an error."""
    v = compile_value(text, scope)
    if v.type not in ("bool", "dyn"):
        raise ExpressionError(f"a filter must be bool, not {v.type}")
    return v.col, _strict(v, "filter")


def failing(text: str, cond: Column, err: Column | None) -> Column:
    """A condition that fails the job where it cannot be evaluated; the plain condition where it always can."""
    return cond if err is None else F.when(err.isNotNull(), _raised(text, err).cast("boolean")).otherwise(cond)
