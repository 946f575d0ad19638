import itertools
import json
import math

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from fluxloom.operators import drift, shred
from fluxloom.queries.schemas import CONNECTOR, ENTITIES


def nodes(body):
    rows = shred.elements_of(body, CONNECTOR)
    return sorted((r[0], r[1], "" if r[3] < 0 else rows[r[3]][1]) for r in rows if r[0] in ENTITIES)


def test_nodes_of_a_description():
    field = {"type": "string", "enum": ["a", None, {"v": 1}], "x-reactions": {"target": "t"}, "items": {"properties": {"in": 1, "no": None}}, "note": "{not json"}
    body = {"properties": {"id": "x"}, "configOptions": json.dumps({"capabilities": "cap", "connection": [{"properties": json.dumps({"host": field})}], "node": {"deep": {"properties": {"n": None, "m": 2}}}}), "messages": {"default": "en", "en": {"a": "b", "c": None}, "de": '{"x": {"y": 1}}'}}
    host = "$/configOptions/connection/0/properties/host"
    want = [
        ("connector", "$", ""), ("capability", "$/configOptions/capabilities/0", "$"), ("field", host, "$"), ("choice", f"{host}/enum/0", host), ("choice", f"{host}/enum/2", host), ("reaction", f"{host}/x-reactions/0", host),
        ("field", f"{host}/items/properties/in", host), ("field", "$/configOptions/node/deep/properties/m", "$"), ("message", "$/messages/en/a", "$"), ("message", "$/messages/de/x", "$"),
    ]
    assert nodes("﻿" + json.dumps(body)) == nodes(json.dumps(json.dumps(body))) == sorted(want)


@pytest.mark.parametrize("body", [None, "", "  ", "{", "[1]", "12", '"text"', "null", '{"a": NaN}', '{"a": 1} x', "[" * 100_000])
def test_what_is_no_object_has_no_nodes(body):
    assert nodes(body) == []


def test_deep_and_long_bodies():
    inner: dict = {}
    for _ in range(300):
        inner = {"properties": {"f": inner}}
    deep = nodes(json.dumps({"configOptions": {"connection": inner}}))
    assert len(deep) == 301 and deep[-1][1].count("/properties/f") == 300
    assert len(nodes(json.dumps({"configOptions": {"connection": {"properties": {f"f{i}": {"enum": ["x"] * 10} for i in range(5000)}}}}))) == 55_001


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda k: st.lists(k, max_size=3) | st.dictionaries(st.sampled_from(["properties", "enum", "x-reactions", "configOptions", "connection", "capabilities", "messages", "a"]), k, max_size=4), max_leaves=25))
def test_every_node_hangs_on_one_that_is_there(value):
    got = nodes(json.dumps(value))
    paths = {p for _, p, _ in got}
    assert len(paths) == len(got) and all(o == "" or o in paths for _, _, o in got)


def test_tables_by_shared_inlining():
    edges = [("a", "b", "one", 1), ("a", "c", "list", 1), ("b", "d", "one", 1), ("c", "d", "one", 1), ("d", "e", "one", 1), ("e", "f", "one", 1), ("f", "e", "one", 1), ("a", "g", "one", 2), ("a", "h", "one", 1)]
    assert shred.tables_of(edges, "a") == ["a", "c", "d", "e", "f", "g"]


ORDER = shred.Grammar("order", {
    "order": shred.Element({"buyer": (shred.ONE, "party"), "lines": (shred.LIST, "line")}, anchor=True), "party": shred.Element({"home": (shred.ONE, "place"), "phones": (shred.LIST, "phone")}, anchor=True),
    "place": shred.Element(), "phone": shred.Element(), "line": shred.Element({"seller": (shred.ONE, "party")}),
})


def test_the_documents_decide_what_is_a_table_and_what_a_column(spark):
    def tables(*bodies):
        df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, body string")
        return shred.shred(df, "id", "body", ORDER, attributes=True)

    single = '{"no": 7, "buyer": {"name": "n", "home": {"city": "c"}, "phones": ["1"]}, "lines": {"sku": 1.50}}'
    one = tables(single)
    assert rows(one.select("entity", "node_path", "parent_path")) == [("line", "$/lines/0", "$"), ("order", "$", ""), ("phone", "$/buyer/phones/0", "$")]
    assert one.where("entity = 'order'").first().attributes == {"no": "7", "buyer.name": "n", "buyer.home.city": "c"}
    assert rows(one.where("entity <> 'order'").select("attributes").selectExpr("attributes['value'] v", "attributes['sku'] s")) == [(None, "1.50"), ("1", None)]
    # two buyers in one document: the type is a table of its own in all of them
    more = tables(single, '{"buyer": [{"name": "a"}, {"name": "b"}]}')
    assert rows(more.where("entity = 'party'").select("id", "node_path", "parent_path")) == [(0, "$/buyer", "$"), (1, "$/buyer/0", "$"), (1, "$/buyer/1", "$")]
    assert more.where("entity = 'order' and id = 0").first().attributes == {"no": "7"} and rows(more.where("entity = 'phone'").select("parent_path")) == [("$/buyer",)]
    # shared by two parents: a table too, and its own singleton stays inlined in it
    shared = tables(single, '{"lines": [{"seller": {"home": {"city": "x"}}}]}')
    assert {r.id: r.attributes for r in shared.where("entity = 'party'").collect()} == {0: {"name": "n", "home.city": "c"}, 1: {"home.city": "x"}}


def test_deep_texts_are_read_without_recursion():
    deep = '{"a": ' * 20_000 + '"x"' + "}" * 20_000
    assert shred._text(shred.deep_loads(deep)) == deep
    got = nodes('{"configOptions": {"connection": {"properties": {"f": 1}, "more": ' + deep + "}}}")
    assert got == [("connector", "$", ""), ("field", "$/configOptions/connection/properties/f", "$")]
    assert len(shred.elements_of('{"n": ' + "9" * 10_000 + "}", CONNECTOR, True)[0][6]["n"]) == 10_000


@given(st.text("[]{}\",:1a \\", max_size=12) | st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda k: st.lists(k, max_size=3) | st.dictionaries(st.text(max_size=3), k, max_size=3)).map(json.dumps))
def test_both_parsers_agree(text):
    def read(f):
        try:
            return f(text)
        except ValueError:
            return "refused"

    assert read(shred.deep_loads) == read(lambda t: json.loads(t, parse_int=str, parse_float=str, parse_constant=shred._refuse))


def test_shredding_keeps_keys_and_inlines_the_rest(spark):
    df = spark.createDataFrame([(1, '{"properties": {"id": 5, "tags": ["x"]}, "configOptions": {"connection": {"type": "object", "properties": {"h": {"type": "s", "deep": {"er": true}}}}}}', "k"), (None, "{}", "k"), (1, "{}", "k"), (2, "cut {", "k")], "id long, body string, entity string")
    out = shred.shred(df, "id", "body", CONNECTOR, attributes=True)
    assert rows(out.select("id", "entity", "node_path")) == [(None, "connector", "$"), (1, "connector", "$"), (1, "connector", "$"), (1, "field", "$/configOptions/connection/properties/h")]
    assert rows(shred.flat_table(out, "id", "field", {"t": "type", "e": "deep.er"})) == [(1, "$/configOptions/connection/properties/h", "$", "s", "true")]
    assert out.where("entity = 'connector' and attributes['configOptions.connection.type'] = 'object' and attributes['properties.id'] = '5'").count() == 1
    assert shred.shred(df.limit(0), "id", "body", CONNECTOR).count() == 0


@given(st.dictionaries(st.tuples(st.sampled_from("abcd"), st.sampled_from("wxyz")), st.floats(0.1, 5), max_size=10))
def test_matching_is_the_heaviest(weights):
    got = drift.best_matching(weights)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got}) and all(p in weights for p in got)
    best = 0.0
    edges = list(weights)
    for n in range(min(4, len(edges)) + 1):
        for some in itertools.combinations(edges, n):
            if len({a for a, _ in some}) == n == len({b for _, b in some}):
                best = max(best, sum(weights[e] for e in some))
    assert math.isclose(sum(weights[e] for e in got), best, abs_tol=1e-9)


FILES = "file_id bigint, source_id string, stream_name string, file_no int, field_list array<struct<name:string,data_type:string>>"


def drifted(spark, files, lines):
    f = spark.createDataFrame(files, FILES)
    r = spark.createDataFrame([(i, n, json.dumps(p) if isinstance(p, dict) else p, "x") for i, n, p in lines], "file_id bigint, line_no int, payload string, pair string")
    v = drift.track(f, r)
    records: dict = {}
    for c in drift.unified(v, r).collect():
        assert c.column not in records.setdefault((c.source_id, c.file_no, c.line_no), {})
        records[c.source_id, c.file_no, c.line_no][c.column] = (c.type, c.value)
    return rows(drift.changes(v).drop("source_id", "stream_name")), records, v, r


def test_drift_over_files(spark):
    files = [
        (1, "s", "t", 1, [("id", "INT"), ("a", "INT"), ("b", "varchar ( 5 )"), ("gone", None)]), (3, "s", "t", 3, None), (2, "s", "t", 2, [("id", "int "), ("A", "BIGINT"), ("b", None), ("new", "DATE")]), (9, "s", "t", 2, [("id", "int "), ("A", "BIGINT"), ("b", None), ("new", "DATE")]),
        (4, "s", "t", 4, [("id", "int"), ("A", "bigint"), ("b", "VARCHAR(9)"), ("new", "date")]), (5, None, "t", 1, [("id", "int")]),
    ]
    one = {i: {"id": i, "a": i, "b": "x", "gone": 5} for i in (1, 2, 3)}
    lines = [(1, i, p) for i, p in one.items()] + [(2, i, {"id": i, "A": i if i < 3 else 99, "b": "x", "new": "d"}) for i in (1, 2, 3)] + [(3, i, {"id": i, "A": i, "b": None, "new": "d"}) for i in (1, 2)] + [(4, 1, "broken {"), (4, 2, {"A": 1}), (4, 3, {"id": 1, "A": 1})]
    changes, unified, v, r = drifted(spark, files, lines)
    assert changes == sorted([(2, "renamed", "A", "a"), (2, "removed", "gone", "gone"), (2, "added", "new", "new"), (2, "retyped", "A", "A"), (4, "retyped", "b", "b")], key=lambda t: tuple((True, str(x)) for x in t))
    assert unified["s", 1, 1] == {"id": ("int", "1"), "A": ("bigint", "1"), "b": ("string", "x"), "gone": ("string", "5"), "new": ("date", None)} and len(unified) == 11
    assert unified["s", 4, 1] == {"id": ("int", None), "A": ("bigint", None), "b": ("string", None), "gone": ("string", None), "new": ("date", None)}
    table = drift.stream_table(v, r, "s", "t")
    assert dict(table.dtypes) == {"file_no": "int", "line_no": "int", "id": "int", "A": "bigint", "b": "string", "gone": "string", "new": "date"}
    assert table.where("file_no = 2 and line_no = 3").select("id", "A", "b", "new").first() == (3, 99, "x", None)  # "d" is no date


def test_fields_that_would_share_a_name(spark):
    # a becomes b while another a comes and stays; the record also carries a name that is no field of its file
    files = [(1, "s", "t", 1, [("id", "int"), ("a", "int"), ("z", "int")]), (2, "s", "t", 2, [("id", "int"), ("b", "double"), ("z", "int")]), (3, "s", "t", 3, [("id", "int"), ("b", "double"), ("a", "text")]), (4, "s", "t", 4, [("id", "int"), ("c", "bigint"), ("a", "text")])]
    lines = [(1, i, {"id": i, "a": i, "z": i}) for i in (1, 2, 3)] + [(2, i, {"id": i, "b": i, "z": i, "a": "stray"}) for i in (1, 2, 3)] + [(3, i, {"id": i, "b": i, "a": "t"}) for i in (1, 2, 3)] + [(4, i, {"id": i, "c": i, "a": "t"}) for i in (1, 2, 3)]
    changes, unified, _, _ = drifted(spark, files, lines)
    assert ("renamed", "b", "a") in {c[1:] for c in changes} and ("renamed", "c", "b") in {c[1:] for c in changes}
    assert unified["s", 2, 1] == {"id": ("int", "1"), "a": ("string", None), "c": ("string", "1"), "z": ("int", "1")}  # int, double and bigint meet in text


def test_pairs_the_sketches_settle_are_not_compared(spark):
    cols = [f"c{i}" for i in range(6)]
    files = [(n, "s", "t", n, [("id", "int")] + [(f"{c}v{n}", "text") for c in cols]) for n in (1, 2)]
    lines = [(n, i, {"id": i, **{f"{c}v{n}": f"{c}-{i % 7}" for c in cols}}) for n in (1, 2) for i in range(60)]
    f, r = spark.createDataFrame(files, FILES), spark.createDataFrame([(i, n, json.dumps(p)) for i, n, p in lines], "file_id bigint, line_no int, payload string")
    files_ = f.select("file_id", "source_id", "stream_name", "file_no", "field_list")
    pairs = drift.versions_of(files_, r).where("size(gone) > 0").select("file_id", "prev_id", "gone", "came")
    left = drift.candidates(drift.profiles(drift.met_records(r, pairs)))
    assert left.count() <= 9 and left.where("i = j").count() == 6  # of 36 combinations
    assert {c[1] for c in drifted(spark, files, lines)[0]} == {"renamed"}


def test_ambiguous_pairs_and_half_agreement(spark):
    files = [(1, "s", "t", 1, [("id", "i"), ("p", "i"), ("q", "i")]), (2, "s", "t", 2, [("id", "i"), ("x", "i"), ("y", "i")])]
    lines = [(1, i, {"id": i, "p": i, "q": i % 2}) for i in range(8)] + [(2, i, {"id": i, "x": i % 2 if i < 6 else 7, "y": i}) for i in range(8)]
    assert {c[1:] for c in drifted(spark, files, lines)[0]} == {("renamed", "y", "p"), ("renamed", "x", "q")}
    half = [(1, i, {"id": i, "p": 1, "q": None}) for i in range(4)] + [(2, i, {"id": i, "x": i % 2, "y": None}) for i in range(4)]
    assert {c[1] for c in drifted(spark, files, half)[0]} == {"removed", "added"}  # two of four is not more than half; null against null says nothing


def test_a_stream_without_a_name_is_a_stream(spark):
    files = [(i, None, "t", i, [("id", "i"), (f"c{i}", "int" if i < 3 else "text"), (f"d{i}", "x")]) for i in (1, 2, 3)]
    lines = [(i, k, {"id": k, f"c{i}": k, f"d{i}": f"{i}{k}"}) for i in (1, 2, 3) for k in range(4)]
    changes, unified, *_ = drifted(spark, files, lines)
    want = [(n, *c) for n in (2, 3) for c in (("renamed", f"c{n}", f"c{n - 1}"), ("removed", f"d{n - 1}", f"d{n - 1}"), ("added", f"d{n}", f"d{n}"))] + [(3, "retyped", "c3", "c3")]
    assert set(changes) == set(want) and len(changes) == 7
    assert sum(r["c3"] == ("string", "2") for r in unified.values()) == 3  # one column over both renames


def test_no_files(spark):
    assert drifted(spark, [], [])[:2] == ([], {})
