import random

import pytest
from conftest import rows

from fluxloom import envelope
from fluxloom.errors import Coded, first_code
from fluxloom.operators import nest as nesting
from fluxloom.operators import rows as steps
from fluxloom.operators import targets
from fluxloom.sources import connectors, tables

SCHEMA = "op string, ts long, src string, before struct<id:int,v:string>, after struct<id:int,v:string>, schema map<string,string>, src_pos string, _seq long"
LOG = [
    ("r", 0, "t", None, (1, "a"), None, None, 0), ("r", 0, "t", None, (2, "b"), None, None, 0), ("u", 5, "t", (1, "a"), (1, "a2"), None, "w1", 1), ("d", 4, "t", (2, "b"), None, None, "w2", 2),
    ("i", 9, "t", None, (3, "c"), None, "w3", 3), ("u", 1, "t", (3, "c"), (4, "c"), None, "w4", 4), ("ddl", 0, "t", None, None, {"id": "INT"}, "w5", 5), ("i", 1, "t", None, (2, "again"), None, "w6", 6),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, SCHEMA)


def test_latest_follows_order_not_time_and_moved_keys(log):
    assert rows(targets.latest(log, ["id"])) == [(1, "a2"), (2, "again"), (4, "c")]


def test_replay_and_disorder_change_nothing(spark, log):
    twice = LOG * 2
    random.Random(3).shuffle(twice)
    assert rows(targets.latest(spark.createDataFrame(twice, SCHEMA), ["id"])) == rows(targets.latest(log, ["id"]))


def test_empty_log_has_no_rows(log):
    assert rows(targets.latest(log.limit(0), ["id"])) == []


def test_append_takes_after_else_before(log):
    assert rows(targets.append_rows(log)) == sorted([(1, "a"), (2, "b"), (1, "a2"), (2, "b"), (3, "c"), (4, "c"), (2, "again")])


def test_ddl_policies(log):
    with pytest.raises(Exception, match="connector.write-failed") as e:
        targets.apply_ddl_policy(log, "fail").collect()
    assert first_code(e.value) == "connector.write-failed"
    assert targets.apply_ddl_policy(log, "ignore").count() == targets.apply_ddl_policy(log, "apply").count() == 7


@pytest.mark.parametrize("name, case, want", [("ORDER_ITEMS", "pascal", "OrderItems"), ("orderItems", "camel", "orderItems"), ("XMLFile2", "camel", "xmlFile2"), ("Mixed-name", "lower", "mixed-name"), ("a b", "pascal", "AB"), ("t", "upper", "T")])
def test_table_names(name, case, want):
    assert targets.Rename(case=case).target(name) == want


def test_renames_may_not_collide_or_vanish():
    with pytest.raises(Coded):
        targets.Rename(case="lower").check(["A", "a"])
    with pytest.raises(Coded):
        targets.Rename({"a": " "}).check(["a"])


def test_union_keeps_src_and_fills_missing(spark):
    a, b = envelope.snapshot_of(spark.sql("select 1 x"), "a"), envelope.snapshot_of(spark.sql("select 'p' y"), "b")
    assert rows(steps.union_rows(a, b).select("src", "after.x", "after.y")) == [("a", 1, None), ("b", None, "p")]


def test_py_step_contract(spark):
    df = envelope.snapshot_of(spark.sql("select id, cast(id as string) s from range(4)"), "t")
    out = steps.py_step(df, "def filter(r):\n    return r['after']['id'] != 0\ndef process(r, ctx):\n    ctx.emit(r)\n    r['after']['s'] += '!'\n    return None if r['after']['id'] == 3 else {**r, 'src': 'x'}")
    assert rows(out.select("src", "after.id", "after.s")) == [("t", 1, "1"), ("t", 2, "2"), ("t", 3, "3"), ("x", 1, "1!"), ("x", 2, "2!")]
    for code, want in (("x = 1", "transform.script-no-process"), ("def process(", "transform.script-compile-failed")):
        with pytest.raises(Coded, match=want):
            steps.py_step(df, code)
    for code, want in (("def process(r, c): return 1", "script-output-invalid"), ("def process(r, c): return {'op': 'z'}", "script-output-invalid"), ("def process(r, c): return 1 / 0", "script-failed")):
        with pytest.raises(Exception, match=want):
            steps.py_step(df, code).collect()


def test_nest_handles_missing_null_and_repeated(spark):
    t = {
        "c": spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, n string"),
        "o": spark.createDataFrame([(10, 1, 1), (11, 1, 2), (11, 1, 3), (12, None, 1), (13, 9, 1)], "oid int, cid int, _seq int"),
    }
    out = nesting.nest(t, nesting.Root("c", ("id",), (nesting.Embed("o", {"cid": "id"}, "a.b", array_key=("oid",)), nesting.Embed("o", {"cid": "id"}, "last", mode="object"))))
    got = {r.n: ([x.oid for x in r.a.b], r.last and r.last.oid) for r in out.collect()}
    assert got == {"x": ([10, 11], 11), "y": ([], None), "z": ([], None)}
    first = nesting.nest({"c": t["c"], "o": t["o"].withColumn("v", t["o"]._seq)}, nesting.Root("c", ("id",), (nesting.Embed("o", {"cid": "id"}, "o", array_key=("oid",), ignore_updates=True),)))
    assert {x.oid: x.v for x in first.where("id = 1").first().o} == {10: 1, 11: 2}


def test_sql_join_refuses_what_does_not_parse(spark):
    t = {"c": spark.sql("select 1 id")}
    assert rows(nesting.sql_join(t, "SELECT id FROM c WHERE '{x}' = '{x}'")) == [(1,)]
    with pytest.raises(Coded, match="dsl.illegal-expression"):
        nesting.sql_join(t, "SELEC 1")


def test_selectors():
    found = ["orders", "order_items", "timezone_test"]
    assert tables.select_tables(None, found) == found
    assert tables.select_tables(["/order.*/", "orders"], found) == ["orders", "order_items"]
    assert tables.select_tables(["/^(?!timezone_test$).*/"], found) == ["orders", "order_items"]
    for sel, code in ((["nope"], "not-discovered"), (["/x/"], "selection-empty"), (["/(/"], "regex-invalid")):
        with pytest.raises(Coded, match=code):
            tables.select_tables(sel, found)
    with pytest.raises(Coded, match="schema-not-discovered"):
        tables.select_tables(None, None)


def test_start_from_takes_everything_after_the_first_hit(log):
    tail = log.where("op <> 'r'")
    from pyspark.sql import functions as F

    at = tail.withColumn("ts", F.col("ts") * 1000)
    assert [r._seq for r in tables.start_from(at, "1970-01-01T00:00:09Z").orderBy("_seq").collect()] == [3, 4, 5, 6]
    assert tables.start_from(at, "2000-01-01").count() == 0 and tables.start_from(at, "latest").count() == 0 and tables.start_from(at).count() == 6
    with pytest.raises(Coded, match="start-from-unparsable"):
        tables.start_from(at, "yesterday")


def test_consumption_and_unselected_tables(log):
    assert tables.consumption("cdc_only", False) == tables.Consumption(False, True, False)
    assert tables.consumption("snapshot_only") == tables.Consumption(True, False, False)
    with pytest.raises(Exception, match="event-table-not-selected"):
        tables.only_selected(log, ["other"]).collect()


def test_shared_logs():
    a, b = {"connector": "mysql", "config": {"host": "h"}, "tables": ["x"]}, {"connector": "mysql", "config": {"host": "h"}, "tables": ["y"]}
    assert connectors.chain_id(a) == connectors.chain_id(b) != connectors.chain_id({**a, "srs": {"key": "k"}})
    s = connectors.SharedLogs()
    s.attach("c", "p1", ["x"])
    assert s.attach("c", "p2", ["y"]) == {"x", "y"}
    s.acknowledge("c", "p1", "w10")
    assert s.durable_frontier("c") is None
    s.acknowledge("c", "p2", "w9")
    s.acknowledge("c", "p2", "w2")
    assert s.durable_frontier("c") == 9 and s.affected("c") == ["p1", "p2"]


def test_connector_sinks():
    c = connectors.Connector
    assert c(frozenset({"write"})).sinks == ("append", "upsert") and c(frozenset({"write", "ignore_on_exists"})).sinks == ("append",) and c().sinks == ()
    assert c(frozenset({"batch_read", "stream_read"})).modes == ("snapshot", "cdc") and c(frozenset({"batch_read"}), ("file",)).modes == ("file",)


def test_the_seam_needs_both_sides(spark, tmp_path):
    from fluxloom.queries import pipelines

    events = [(i, u, k, f"2024-01-01 00:{m:02d}:00") for i, (u, k, m) in enumerate([(1, "view", 0), (2, "view", 1), (3, "view", 2), (3, "error", 3), (4, "view", 29), (2, "error", 40), (1, "view", 59)] + [(5, "view", 4), (6, "view", 59)])]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, at string").selectExpr("event_id", "user_id", "event_type", "cast(at as timestamp_ntz) ts", "1.0D value").write.parquet(f"{tmp_path}/events.parquet")
    snap, tail = pipelines._seam(spark, str(tmp_path))
    assert rows(snap.select("after.user_id")) == [(1,), (2,), (4,), (5,)]  # the state at 00:30, whole
    assert rows(tail.select("after.event_id", "before.event_id")) == [(None, 5), (4, None), (6, 0), (8, None)]
    assert rows(pipelines.snapshot_cdc_overlap(spark, str(tmp_path))) == [(1, 6), (4, 4), (5, 7), (6, 8)]
