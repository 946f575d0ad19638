import pytest
from pyspark.sql import types as T

from fluxloom.errors import Coded
from fluxloom.spec import Workspace, content_hash, interpolate, load

SRC = "version: fluxloom/v1\nkind: source\nid: {id}\nconnector: {c}\nconfig: {{ host: h }}\nmode: {mode}\ntables: [ {tables} ]\n"


def source(id="s", c="mysql", mode="cdc", tables="orders, customers", extra=""):
    return SRC.format(id=id, c=c, mode=mode, tables=tables) + extra


def pipeline(body, source="s"):
    return f"version: fluxloom/v1\nkind: pipeline\nid: p\nsource: {source}\n{body}"


OUT = "serve: { from: orders, sync: [ { id: out, source: s } ] }\n"


def check(*docs):
    return Workspace([load(d, {}) for d in docs])


def test_sugar_is_expanded():
    p = load(pipeline("transforms:\n  - { type: filter, from: orders, expr: \"op != 'd'\" }\n  - mask\nview: v\nserve: api\n"), {})
    assert [(s["id"], s["from"]) for s in p.body["transforms"]] == [("filter_1", ["orders"]), ("mask", ["filter_1"])]
    assert p.body["view"] == {"use": "v", "id": "v", "from": "mask"} and p.body["serve"]["from"] == "v"
    q = load(pipeline("serve: { from: /.*/, sync: [ { source: s }, { source: s } ], push: [ { source: s } ] }\n"), {})
    assert [e["id"] for e in q.body["serve"]["sync"]] == ["sync_1", "sync_2"] and q.body["serve"]["push"][0]["id"] == "push_1"


def test_scalars_of_the_dialect():
    s = load("kind: source\nid: a\nconnector: x\nconfig: { a: yes, b: on, c: 0x1F, d: 0o17, e: 1.5, f: true, g: ~, h: 2021-01-01, i: '5' }\n", {})
    assert s.body["config"] == {"a": "yes", "b": "on", "c": 31, "d": 15, "e": 1.5, "f": True, "g": None, "h": "2021-01-01", "i": "5"}


def test_interpolation():
    assert interpolate("${A}-${var:B:x:y}-${var:A:z}", {"A": "1"}) == "1-x:y-1"
    for text, code in (("${B}", "undefined-variable"), ("${A", "malformed"), ("${a:b}", "malformed"), ("${1x}", "malformed")):
        with pytest.raises(Coded, match=code):
            interpolate(text, {"A": "1"})


def test_hash_sees_meaning_only():
    a = load("kind: source\nid: a\nconnector: x\nconfig: { p: 1, q: 2 }\n", {})
    b = load("# same\nid: a\nconfig: { q: 2, p: 1 }\nkind: source\nconnector: x\n", {})
    assert content_hash(a) == content_hash(b) != content_hash(load("kind: source\nid: a\nconnector: x\nconfig: { p: 1, q: 3 }\n", {}))
    f = "kind: transform\nid: t\ntype: map\nfields: {{ {} }}\n"
    assert content_hash(load(f.format("a: $x, b: $y"), {})) != content_hash(load(f.format("b: $y, a: $x"), {}))  # their order is the output's


@pytest.mark.parametrize(
    "docs, code, path",
    [
        ([source(extra="mod: cdc\n")], "unknown-field", "mod"), ([source(id="a.b")], "illegal-value", "id"), ([source(), source()], "duplicate-id", "id"), ([source(mode="cdd")], "illegal-value", "mode"),
        ([source(extra="options: { start_from: earliest }\n")], "unknown-field", "options.start_from"), ([source(mode="stream", c="kafka", extra="srs: { retention: 7d }\n")], "mode-mismatch", "srs"),
        ([source(c="kafka")], "unsupported-mode", "mode"), ([source().replace("host: h", "deploymentMode: x")], "invalid-config-value", "config.deploymentMode"), ([source().replace("host: h", "port: many")], "config-type-mismatch", "config.port"),
        ([source(), pipeline("")], "composition", ""), ([source(), pipeline(OUT, "t")], "missing-reference", "source"), ([source(), pipeline(OUT.replace("orders", "nope"))], "missing-reference", "serve.from"),
        ([source(), pipeline("transforms: [ { id: orders, from: orders, type: union } ]\n" + OUT)], "duplicate-id", "transforms[0].id"), ([source(), pipeline("transforms: [ { id: s, from: orders, type: union } ]\n" + OUT)], "duplicate-id", "transforms[0].id"),
        ([source(), pipeline("transforms: [ { type: union } ]\n" + OUT)], "composition", "transforms"), ([source(), pipeline("transforms: [ { from: orders } ]\n" + OUT)], "composition", "transforms[0].type"),
        ([source(), pipeline("transforms: [ { id: f, from: orders, type: filter, expr: 'afterr.x' } ]\n" + OUT)], "illegal-expression", "transforms[0].expr"),
        ([source(), pipeline("transforms: [ { id: m, from: orders, type: map, fields: { a: '=1 +' } } ]\n" + OUT)], "illegal-expression", "transforms[0].fields.a"),
        ([source(), source(id="t"), pipeline(OUT, "[s, t]")], "ambiguous-reference", "serve.from"), ([source(), pipeline("settings: { schedule: daily }\n" + OUT)], "mode-mismatch", "settings.schedule"),
        ([source(mode="snapshot"), pipeline("settings: { start_from: earliest }\n" + OUT)], "mode-mismatch", "settings.start_from"), ([source(), pipeline(OUT.replace("source: s", "source: s, ddl: maybe"))], "illegal-value", "serve.sync[0].ddl"),
        ([source(), pipeline(OUT.replace("source: s", "source: s, rename: { map: { orders: x, customers: x } }"))], "illegal-value", "serve.sync[0].rename.map.customers"),
        (["kind: transform\nid: t\ntype: map\nfrom: x\nfields: {}\n"], "forbidden-field", "from"), ([source(), pipeline("transforms: [ { from: { a: orders }, type: filter, expr: 'true' } ]\n" + OUT)], "illegal-value", "transforms[0].from"),
        ([source(), pipeline("transforms: [ { from: [orders], type: join, sql: x } ]\n" + OUT)], "composition", "transforms[0].from"), ([source(), pipeline("view: nope\n" + OUT).replace("view: nope", "view: { use: nope, from: orders }")], "missing-reference", "view.use"),
        ([source(c="quickapi", mode="api"), pipeline(OUT)], "unsupported-mode", "serve.sync[0].write_mode"), (["kind: nothing\n"], "illegal-value", "kind"), (["[1]"], "illegal-value", ""), (["a: [\n"], "malformed-yaml", None), (["kind: source\nkind: source\n"], "malformed-yaml", None),
    ],
)
def test_violations(docs, code, path):
    with pytest.raises(Coded) as e:
        check(*docs)
    assert e.value.code == f"dsl.{code}" and e.value.args_.get("path") == path


def test_open_sources_and_patterns_resolve():
    check(source(tables="/ord.*/"), pipeline(OUT.replace("from: orders", "from: anything")))
    check(source(), pipeline(OUT.replace("from: orders", "from: /nothing/")))
    check(source(), source(id="t"), pipeline(OUT.replace("from: orders", "from: t.orders"), "[s, t]"))


def test_types_are_judged_per_table(spark):  # columns are built, which needs a session
    ws = check(source(), pipeline("transforms: [ { id: f, from: [orders, customers], type: filter, expr: 'after.n > 1' } ]\nserve: { from: f, sync: [ { source: s } ] }\n"))
    row = lambda t: T.StructType([T.StructField("n", t)])
    p = ws.by_id["p"]
    ws.check_types(p, {"s": {"orders": row(T.LongType()), "customers": row(T.IntegerType())}})
    with pytest.raises(Coded, match="needs-discovery"):
        ws.check_types(p, {})
    for t, code in ((T.StringType(), "illegal-expression"), (T.DecimalType(10, 2), "type-unsupported"), (T.CalendarIntervalType(), "type-unknown")):
        with pytest.raises(Coded, match=code) as e:
            ws.check_types(p, {"s": {"orders": row(T.LongType()), "customers": row(t)}})
        assert e.value.args_["table"] == "customers"
