import pytest
from conftest import rows

from fluxloom.errors import Coded
from fluxloom.plans.pipeline import build
from fluxloom.sources.readers import Reader
from fluxloom.spec import Workspace, load
from fluxloom.streaming.runtime import Pipeline
from fluxloom.streaming.tables import AppendTable, UpsertTable

ROW = "struct<id:bigint,region:string,qty:bigint>"
LOG = f"op string, ts bigint, before {ROW}, after {ROW}, src_pos string, seq bigint"


def docs(*steps, serve="sync: [ { id: out, source: tgt, rename: { prefix: ods_ } } ]", src="", settings="", view=""):
    return Workspace(
        [
            load("kind: source\nid: src\nconnector: parquet\nconfig: { path: x }\nmode: cdc\n" + (src or "tables: [ orders ]\n"), {}), load("kind: source\nid: tgt\nconnector: parquet\nconfig: { path: y }\n", {}),
            load(f"kind: pipeline\nid: p\nsource: src\n{settings}transforms:\n" + "".join(f"  - {s}\n" for s in steps) + view + f"serve: {{ from: {'/.*_out/' if len(steps) > 1 else 's_out'}, {serve} }}\n", {}),
        ]
    )


@pytest.fixture()
def land(spark, tmp_path):
    spark.createDataFrame([(1, "eu", 5), (2, "us", 6), (3, "eu", 7)], ROW[7:-1].replace(":", " ")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([("u", 1, (1, "eu", 5), (1, "eu", 50), "w1", 1), ("d", 2, (2, "us", 6), None, "w2", 2)], LOG).coalesce(1).write.parquet(f"{tmp_path}/orders.log")

    def more(*events):
        spark.createDataFrame(list(events), LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.log")

    return Reader(spark, str(tmp_path), keys={"orders": ("id",)}), more


KEEP = "{ id: s_out, from: orders, type: filter, expr: \"op == 'd' || after.qty > 5\" }"


def test_snapshot_then_tail_then_restart(spark, land, tmp_path):
    reader, more = land
    p = Pipeline(spark, docs(KEEP), "p", {"src": reader}, f"{tmp_path}/out")
    seen = p.start()
    assert (seen.state, seen.error_count, seen.snapshot_rows) == ("COMPLETED", 0, {"orders": 3}), seen
    assert rows(p.table("tgt", "ods_orders", ("id",))) == [(1, "eu", 50), (3, "eu", 7)]
    more(("i", 3, None, (4, "us", 9), "w3", 3), ("i", 3, None, (5, "us", 1), "w4", 4))
    assert p.start().state == "COMPLETED"  # the snapshot is taken once, the tail goes on at its checkpoint
    assert rows(p.table("tgt", "ods_orders", ("id",))) == [(1, "eu", 50), (3, "eu", 7), (4, "us", 9)]


def test_a_running_tail_can_be_paused_and_stopped(spark, land, tmp_path):
    reader, more = land
    p = Pipeline(spark, docs("{ id: s_out, from: orders, type: map, fields: { key: $id, region: false } }"), "p", {"src": reader}, f"{tmp_path}/out")
    assert p.start(follow=True).state == "RUNNING"
    p.process_available()
    more(("i", 3, None, (4, "us", 9), "w3", 3))
    p.process_available()
    assert rows(p.table("tgt", "ods_orders", ("key",))) == [(1, 50), (3, 7), (4, 9)]
    assert p.pause().state == "PAUSED"
    with pytest.raises(Coded, match="illegal-transition"):
        p.start()
    assert p.stop().state == "STOPPED" and p.status().epoch == 3


def test_batch_plan_and_stream_agree_whatever_the_batches(spark, land, tmp_path):
    reader, more = land
    for i in range(3, 9):
        more(("i" if i % 2 else "u", i, None if i % 2 else (i - 1, "eu", i), (i, "eu", 10 + i), f"w{i}", i))
    ws = docs(KEEP)
    want = rows(build(ws, "p", {"src": reader}).outputs[0].branches[0].state().drop("_seq"))
    for files in (1, 3):
        p = Pipeline(spark, ws, "p", {"src": reader}, f"{tmp_path}/out{files}")
        assert p.start(files_per_trigger=files).state == "COMPLETED"
        assert rows(p.table("tgt", "ods_orders", ("id",))) == want


def test_failures_are_observed_and_sticky(spark, land, tmp_path):
    p = Pipeline(spark, docs("{ id: s_out, from: orders, type: filter, expr: 'after.qty / (after.qty - 5) > 0' }"), "p", {"src": land[0]}, f"{tmp_path}/out")
    seen = p.start()
    assert (seen.state, seen.error_count, seen.error_code) == ("FAILED", 1, "transform.expression-failed")
    with pytest.raises(Coded):
        p.start()
    assert p.stop().state == "STOPPED"


def test_dead_letters_and_js(spark, land):
    ws = docs("{ id: s_out, from: orders, type: filter, expr: 'after.qty > 5' }", settings="settings: { error_policy: dead_letter }\n")
    plan = build(ws, "p", {"src": land[0]})
    assert [r.op for r in plan.dead[0].collect()] == ["d"] and plan.outputs[0].branches[0].events.count() == 3
    with pytest.raises(Coded, match="script-compile-failed"):
        build(docs("{ id: s_out, from: orders, type: js, script: 'x' }"), "p", {"src": land[0]})


def test_nest_join_view_and_references(spark, land, tmp_path):
    reader, _ = land
    ws = docs("{ id: agg, type: join, from: { o: src.orders }, engine: spark, sql: 'SELECT region, sum(qty) AS q FROM o GROUP BY region' }", "{ id: n_out, type: nest, from: { o: orders, a: agg }, root: { from: o, key: [id], embed: [ { from: a, on: { region: region }, as: object, path: total } ] } }", view="view: { id: v, from: n_out, primary_key: id }\n")
    plan = build(ws, "p", {"src": reader})
    assert rows(plan.view("v").selectExpr("id", "total.q")) == [(1, 57), (3, 57)]
    p = Pipeline(spark, ws, "p", {"src": reader}, f"{tmp_path}/out")
    assert p.start().state == "COMPLETED"


@pytest.mark.parametrize("follow", [False, True])
def test_recomputed_results_replace_the_target(spark, land, tmp_path, follow):
    reader, more = land
    ws = docs("{ id: agg_out, type: join, from: { o: src.orders }, engine: spark, sql: 'SELECT region, sum(qty) AS q FROM o GROUP BY region' }", "{ id: n_out, type: nest, from: { o: orders, a: agg_out }, root: { from: o, key: [id], embed: [ { from: a, on: { region: region }, as: object, path: total } ] } }")
    p = Pipeline(spark, ws, "p", {"src": reader}, f"{tmp_path}/out")
    nested = lambda: rows(p.table("tgt", "ods_n_out", ("id",)).selectExpr("id", "total.q"))
    assert p.start(follow).state == ("RUNNING" if follow else "COMPLETED"), p.seen
    p.process_available()
    assert nested() == [(1, 57), (3, 57)] and rows(p.table("tgt", "ods_agg_out")) == [("eu", 57)]  # 2 is deleted in the log
    more(("d", 3, (3, "eu", 7), None, "w3", 3), ("i", 4, None, (4, "us", 9), "w4", 4))
    p.process_available() if follow else p.start()
    assert p.status().error_count == 0, p.seen
    assert nested() == [(1, 50), (4, 9)] and rows(p.table("tgt", "ods_agg_out")) == [("eu", 50), ("us", 9)]
    if follow:
        assert p.stop().state == "STOPPED"


def test_dead_letters_of_a_run_are_kept_and_counted(spark, land, tmp_path):
    reader, more = land
    ws = docs("{ id: s_out, from: orders, type: filter, expr: 'after.qty / (after.qty - 5) > 0' }", settings="settings: { error_policy: dead_letter }\n")
    p = Pipeline(spark, ws, "p", {"src": reader}, f"{tmp_path}/out")
    seen = p.start()  # the row with qty 5 in the snapshot, the delete without an after in the log
    assert (seen.state, seen.error_count) == ("COMPLETED", 2), seen
    assert rows(p.dead_letters().select("op", "_seq")) == [("d", 2), ("r", 0)] and rows(p.dead_letters().where("op = 'r'").selectExpr("get_json_object(after, '$.id')")) == [("1",)]
    more(("i", 3, None, (4, "us", 5), "w3", 3))
    assert p.start().error_count == 1 and p.dead_letters().count() == 3


@pytest.mark.parametrize("step", ["{ id: s_out, from: orders, type: map, fields: { part: '=100 / (after.qty - 5)' } }", "{ id: s_out, from: orders, type: py, script: \"def process(r, ctx):\\n    1 / ((r['after'] or r['before'])['qty'] - 5)\\n    return r\\n\" }"])
@pytest.mark.parametrize("policy", ["fail", "skip", "dead_letter"])
def test_map_and_py_follow_the_error_policy(spark, land, tmp_path, step, policy):
    p = Pipeline(spark, docs(step, settings=f"settings: {{ error_policy: {policy}, read_mode: snapshot_only }}\n"), "p", {"src": land[0]}, f"{tmp_path}/out")
    seen = p.start()
    if policy == "fail":
        assert (seen.state, seen.error_count) == ("FAILED", 1), seen
        return
    assert (seen.state, seen.error_count, seen.record_count) == ("COMPLETED", int(policy == "dead_letter"), 2), seen
    assert rows(p.table("tgt", "ods_orders", ("id",)).select("id")) == [(2,), (3,)]
    if policy == "dead_letter":
        assert rows(p.dead_letters().selectExpr("op", "get_json_object(after, '$.id')")) == [("r", "1")]


@pytest.mark.parametrize("start, want, later", [("latest", [(1, 5), (2, 6), (3, 7)], [(1, 5), (2, 6), (3, 7), (4, 9)]), ("1970-01-01T00:00:00.002Z", [(1, 5), (3, 7)], [(1, 5), (3, 7), (4, 9)]), ("1970-01-01T00:00:00.003Z", [(1, 5), (2, 6), (3, 7)], [(1, 5), (2, 6), (3, 7), (4, 9)])])
def test_the_tail_starts_where_it_is_told_to(spark, land, tmp_path, start, want, later):
    reader, more = land
    p = Pipeline(spark, docs("{ id: s_out, from: orders, type: map, fields: { region: false } }", settings=f"settings: {{ start_from: '{start}' }}\n"), "p", {"src": reader}, f"{tmp_path}/out")
    assert p.start().state == "COMPLETED", p.seen
    assert rows(p.table("tgt", "ods_orders", ("id",))) == want
    more(("i", 3, None, (4, "us", 9), "w3", 3))
    assert p.start().state == "COMPLETED", p.seen
    assert rows(p.table("tgt", "ods_orders", ("id",))) == later


@pytest.mark.parametrize("follow", [False, True])
def test_two_arms_of_a_fan_out_end_in_one_target(spark, land, tmp_path, follow):
    reader, more = land
    arms = ["{ id: %s_out, from: orders, type: filter, expr: \"op == 'd' || after.region == '%s'\" }" % (r, r) for r in ("eu", "us")]
    more(("i", 3, None, (4, "us", 9), "w3", 3), ("i", 4, None, (5, "eu", 8), "w4", 4))
    p = Pipeline(spark, docs(*arms), "p", {"src": reader}, f"{tmp_path}/out")
    assert p.start(follow).error_count == 0, p.seen
    assert p.process_available().error_count == 0, p.seen
    more(("i", 5, None, (6, "us", 1), "w5", 5), ("i", 6, None, (7, "eu", 2), "w6", 6))
    p.process_available() if follow else p.start()
    assert p.status().error_count == 0, p.seen
    assert rows(p.table("tgt", "ods_orders", ("id",))) == [(1, "eu", 50), (3, "eu", 7), (4, "us", 9), (5, "eu", 8), (6, "us", 1), (7, "eu", 2)]
    if follow:
        p.stop()


def test_convergence_to_what_is_asked_for(spark, land, tmp_path):
    from fluxloom.streaming.control import Control, converge

    reader, more = land
    p = Pipeline(spark, docs(KEEP), "p", {"src": reader}, f"{tmp_path}/out")
    c, other = Control(spark, f"{tmp_path}/control"), Control(spark, f"{tmp_path}/control")
    assert c.read() == ("STOPPED", 0) and converge(p, c) == "NEW"
    assert c.ask("RUNNING") == 1 and converge(p, c) == "RUNNING" == converge(p, c)
    with pytest.raises(Coded):
        other.ask("PAUSED", epoch=0)  # it has changed since
    assert other.ask("PAUSED", epoch=1) == 2 and converge(p, c) == "PAUSED"
    more(("i", 3, None, (4, "us", 9), "w3", 3))  # captured while it pauses
    c.ask("RUNNING")
    assert converge(p, c) == "RUNNING" and p.process_available().error_count == 0
    assert rows(p.table("tgt", "ods_orders", ("id",))) == [(1, "eu", 50), (3, "eu", 7), (4, "us", 9)]
    c.ask("STOPPED")
    assert converge(p, c) == "STOPPED"
    failing = Pipeline(spark, docs("{ id: s_out, from: orders, type: filter, expr: 'after.qty / (after.qty - 5) > 0' }"), "p", {"src": reader}, f"{tmp_path}/out2")
    c.ask("RUNNING")
    assert converge(failing, c) == "FAILED" == converge(failing, c)


def test_append_takes_one_table_and_types_are_checked_at_start(spark, land, tmp_path):
    reader, _ = land
    spark.createDataFrame([(1, "x")], "id long, name string").write.parquet(f"{tmp_path}/people.parquet")
    two = docs("{ id: s_out, from: src, type: union }", src="tables: [ orders, people ]\n", serve="sync: [ { id: out, source: tgt, write_mode: append } ]")
    seen = Pipeline(spark, two, "p", {"src": reader}, f"{tmp_path}/out").start()
    assert (seen.state, seen.error_code, seen.record_count) == ("FAILED", "connector.write-failed", 0)
    wrong = docs("{ id: s_out, from: orders, type: filter, expr: \"after.region > 5\" }")
    assert Pipeline(spark, wrong, "p", {"src": reader}, f"{tmp_path}/out3").start().state == "FAILED"


def test_shared_logs_hear_of_every_batch(spark, land, tmp_path):
    from fluxloom.sources.connectors import SharedLogs, chain_id

    reader, more = land
    ws, logs = docs("{ id: s_out, from: orders, type: map, fields: { region: false } }"), SharedLogs()
    chain = chain_id(ws.by_id["src"].body)
    logs.attach(chain, "other", ["orders"])
    p = Pipeline(spark, ws, "p", {"src": reader}, f"{tmp_path}/out", logs)
    assert p.start().state == "COMPLETED" and logs.consumers[chain] == {"other": None, "p": 2} and logs.durable_frontier(chain) is None
    logs.acknowledge(chain, "other", "w1")
    more(("i", 3, None, (4, "us", 9), "w3", 3))
    p.start()
    assert logs.durable_frontier(chain) == 1 and logs.consumers[chain]["p"] == 3


def test_a_log_with_a_change_of_another_table_fails_the_run(spark, tmp_path):
    spark.createDataFrame([("i", 1, None, (1, "eu", 5), "w1", 1, "orders"), ("i", 2, None, (2, "eu", 5), "w2", 2, "others")], LOG + ", src string").write.parquet(f"{tmp_path}/orders.log")
    p = Pipeline(spark, docs("{ id: s_out, from: orders, type: map, fields: { region: false } }"), "p", {"src": Reader(spark, str(tmp_path), keys={"orders": ("id",)})}, f"{tmp_path}/out")
    seen = p.start()
    assert (seen.state, seen.error_code) == ("FAILED", "capture.event-table-not-selected")


def test_counts_are_taken_once(spark, land, tmp_path):
    p = Pipeline(spark, docs("{ id: s_out, from: orders, type: map, fields: { region: false } }"), "p", {"src": land[0]}, f"{tmp_path}/out")
    assert p.start().record_count == 5 and p.start().record_count == 0  # three rows, two changes; nothing new


def test_children_as_first_set_start_again_after_they_ended(spark):
    from fluxloom.operators.targets import first_images

    row = "struct<id:bigint,v:string>"
    log = [("i", None, (1, "a"), 1), ("u", (1, "a"), (1, "b"), 2), ("i", None, (2, "c"), 3), ("d", (2, "c"), None, 4), ("i", None, (2, "d"), 5), ("u", (2, "d"), (2, "e"), 6), ("i", None, (3, "f"), 7), ("d", (3, "f"), None, 8)]
    df = spark.createDataFrame(log, f"op string, before {row}, after {row}, _seq bigint")
    assert rows(first_images(df, ["id"])) == [(1, "a"), (2, "d")]


def test_table_filter_and_missing_pipeline(land):
    reader, _ = land
    ws = docs("{ id: s_out, from: src, type: union }", src="tables: [ { name: orders, filter: \"region == 'eu'\", pk: [id] } ]\n", settings="settings: { read_mode: snapshot_only }\n")
    assert build(ws, "p", {"src": reader}).outputs[0].branches[0].events.count() == 2
    for name, code in (("q", "pipeline-not-found"), ("src", "not-a-pipeline")):
        with pytest.raises(Coded, match=code):
            build(ws, name, {"src": reader})


def test_upsert_table_is_idempotent_and_compacts(spark, tmp_path):
    t = UpsertTable(spark, f"{tmp_path}/t", ["id"], compact_after=2)
    steps = lambda *r: spark.createDataFrame([(i, s, a, None if v is None else (i, v)) for i, s, a, v in r], "id int, _seq bigint, alive boolean, row struct<id:int,v:string>")
    assert t.read() is None
    assert t.apply(steps((1, 1, True, "a"), (2, 1, True, "b")), 0)
    assert not t.apply(steps((1, 9, True, "zzz")), 0)
    t.apply(steps((2, 5, False, None)), 1)
    t.apply(steps((2, 3, True, "late"), (3, 3, True, "c")), 2)  # older than the end of 2
    assert rows(t.read()) == [(1, "a"), (3, "c")]
    for n in range(3, 12):
        t.apply(steps((n, n, True, str(n)), (1, 2, True, "older" if n > 3 else "newer")), n)
    parts = t.manifest.load()[1]["parts"]
    assert len(parts) <= 5 and {p.split("-")[1] for p in parts} >= {"1", "2"} and t.read().count() == 10
    a = AppendTable(spark, f"{tmp_path}/a")
    assert a.apply(spark.range(2), 0) and not a.apply(spark.range(2), 0) and a.read().count() == 2


def test_view_tiers_and_schema_policy(spark, tmp_path):
    from fluxloom.plans import views

    rows_ = spark.createDataFrame([(1, "eu"), (2, "us")], "id int, region string")
    got = views.store(rows_, "v_test", {"hot": {"ttl": "1h"}, "warm": {"collection": "c"}, "cold": {"partition_by": ["region"]}}, str(tmp_path))
    assert rows(got) == rows(spark.table("v_test")) == rows(spark.read.parquet(f"{tmp_path}/c")) == [(1, "eu"), (2, "us")]
    assert (tmp_path / "v_test.cold" / "region=eu").is_dir() and got.storageLevel.useMemory
    got.unpersist()
    with pytest.raises(Coded):
        views.store(rows_, "v_test", {"cold": {"partition_by": ["nope"]}}, str(tmp_path))
    wider = rows_.selectExpr("*", "1 AS x")
    assert views.evolve(rows_, wider, {"evolution": "additive"}).columns == ["id", "region", "x"]
    for old, new, policy in ((rows_, wider, {"enforce": True}), (wider, rows_, {"evolution": "additive"})):
        with pytest.raises(Coded):
            views.evolve(old, new, policy)
