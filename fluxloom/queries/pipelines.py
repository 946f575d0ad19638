"""Queries of the pipeline operators: scans, row steps, unions, targets, nesting and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom import envelope
from fluxloom.operators import nest as nesting
from fluxloom.functions.messages import plain
from fluxloom.operators import rows, targets
from fluxloom.queries.feeds import read
from fluxloom.queries.relational import joined, plain_sql
from fluxloom.sources import tables as source_tables

#: Rows that snapshot events never lack.
_ROW = frozenset({"after"})


def _events(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table as snapshot events, under its discovered model: the columns of the star schema are NOT NULL."""
    return envelope.snapshot_of(source_tables.declared(read(spark, sf, table)), table)


def _after(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(f"after.{c}") for c in cols]) if cols else df.select("after.*")


def snapshot_scan(spark, sf):
    return _events(spark, sf, "nation").select("op", "src", "after.*")


def table_select_regex(spark, sf):
    names = source_tables.select_tables(["/^(?!part$)[rn].*/"], ["region", "nation", "part", "supplier"])
    arms = [_events(spark, sf, t).select("src", F.col(f"after.{t[0]}_name").alias("name")) for t in names]
    return arms[0].unionByName(arms[1])


def filter_predicate(spark, sf):
    return _after(rows.filter_rows(_events(spark, sf, "lineitem"), "after.l_returnflag == 'R' && after.l_quantity < 10.0", _ROW), "l_orderkey", "l_partkey", "l_quantity")


def filter_and_or_ternary(spark, sf):
    expr = "(after.o_orderstatus == 'F' || after.o_totalprice > 200000.0) && (after.o_orderpriority == '1-URGENT' ? after.o_custkey > 100 : true) && !(after.o_orderkey % 7 == 0)"
    return _after(rows.filter_rows(_events(spark, sf, "orders"), expr, _ROW), "o_orderkey", "o_custkey", "o_orderstatus")


def filter_string_fns(spark, sf):
    expr = "after.p_name.contains('e') && (after.p_type.startsWith('STANDARD') || after.p_type.endsWith('COPPER') || after.p_brand.matches('Brand#[1-3]')) && size(after.p_name) > 5"
    return _after(rows.filter_rows(_events(spark, sf, "part"), expr, _ROW), "p_partkey", "p_name", "p_type")


def filter_in_list(spark, sf):
    return _after(rows.filter_rows(_events(spark, sf, "customer"), "after.c_mktsegment in ['BUILDING', 'MACHINERY'] && after.c_nationkey in [1, 2, 3]", _ROW), "c_custkey", "c_mktsegment")


def filter_or_absorbs_error(spark, sf):
    log = _change_log(spark, sf)
    return rows.filter_rows(log, "op == 'd' || after.event_id % 2 == 0").select("op", F.coalesce("after.event_id", "before.event_id").alias("event_id"))


def filter_ddl_bypass(spark, sf):
    log = read(spark, sf, "change_log")
    events = envelope.changes_of(log, F.col("delivery_id"), before="before_row", after="after_row", schema="row_schema", src_pos="src_pos")
    return rows.filter_rows(events, "op != 'd' && op != 'u' && has(after.region)").select("op", "_seq")


def table_filter(spark, sf):
    return source_tables.filter_table(source_tables.declared(read(spark, sf, "supplier")), "s_acctbal > 1000.0 && s_nationkey != 3").select("s_suppkey", "s_nationkey")


def map_rename_drop_literal(spark, sf):
    out = rows.map_fields(_events(spark, sf, "customer"), {"id": "$c_custkey", "c_acctbal": False, "origin": "tpch", "rank": 1, "gone": "$nothing", "copy": "$c_custkey"}, _ROW)
    return _after(out)


def map_computed_arith(spark, sf):
    out = rows.map_fields(_events(spark, sf, "lineitem"), {"net": "=after.l_extendedprice * (1.0 - after.l_discount)", "line2": "=int(after.l_linenumber) * 2 + 1"}, _ROW)
    return _after(out, "l_orderkey", "l_linenumber", "line2", "net")


def map_int_div_mod(spark, sf):
    out = rows.map_fields(_events(spark, sf, "orders"), {"q": "=(after.o_orderkey - 5000) / 7", "m": "=(after.o_orderkey - 5000) % 7"}, _ROW)
    return _after(out, "o_orderkey", "q", "m")


def map_string_concat(spark, sf):
    out = rows.map_fields(_events(spark, sf, "part"), {"label": "=after.p_brand + '/' + after.p_type + '#' + string(after.p_size)"}, _ROW)
    return _after(out, "p_partkey", "label")


def map_timestamp_parts(spark, sf):
    log = envelope.snapshot_of(read(spark, sf, "events"), "events", ts=F.unix_millis(F.col("ts").cast("timestamp")))
    out = rows.map_fields(log, {"y": "=now().getFullYear()", "mo": "=now().getMonth()", "d": "=now().getDate()", "dow": "=now().getDayOfWeek()", "h": "=now().getHours()", "ms": "=now().getMilliseconds()"}, _ROW)
    return _after(out, "event_id", "y", "mo", "d", "dow", "h", "ms")


def map_order_passthrough(spark, sf):
    out = rows.map_fields(_events(spark, sf, "nation"), {"region": "$n_regionkey", "tag": True})
    return out.select(F.lit(",".join(out.schema["after"].dataType.names)).alias("columns"), "after.*")


def cel_list_macros(spark, sf):
    docs = envelope.snapshot_of(read(spark, sf, "documents").select("doc_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")), "documents")
    out = rows.map_fields(docs, {
        "n": "=size(after.tags)", "any": "=after.tags.exists(t, t.contains('e'))", "every": "=after.tags.all(t, size(t) > 3)", "one": "=after.tags.exists_one(t, t == 'beginner')",
        "long": "=size(after.tags.filter(t, size(t) > 6))", "sizes": "=size(after.tags.map(t, size(t) * 2))", "has_beginner": "='beginner' in after.tags",
    }, _ROW)
    return _after(out, "doc_id", "n", "any", "every", "one", "long", "sizes", "has_beginner")


def union_bag(spark, sf):
    a = rows.map_fields(_events(spark, sf, "customer"), {"name": "$c_name", "nation": "$c_nationkey", "c_custkey": False, "c_mktsegment": False, "c_acctbal": False})
    b = rows.map_fields(_events(spark, sf, "supplier"), {"name": "$s_name", "nation": "$s_nationkey", "s_suppkey": False})
    return rows.union_rows(a, b).select("src", "after.name", "after.nation", "after.s_acctbal")


def fan_in_filter(spark, sf):
    return rows.filter_rows(rows.union_rows(_events(spark, sf, "nation"), _events(spark, sf, "region")), "src == 'region' || after.n_regionkey == 1").select("src", "after.n_name", "after.r_name")


def fanout_exclusive(spark, sf):
    events, out = _events(spark, sf, "events"), None
    arms = {"view": "after.event_type == 'view'", "click": "after.event_type == 'click'", "rest": "!(after.event_type in ['view', 'click'])"}
    for name, expr in arms.items():
        arm = rows.filter_rows(events, expr, _ROW).groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("after.event_id").alias("first")).select(F.lit(name).alias("branch"), "n", "first")
        out = arm if out is None else out.unionByName(arm)
    return out


def _change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as a change log: first i, then u, error events as d; ``_seq`` is the unique event number in time order."""
    df = read(spark, sf, "events")
    log = envelope.change_log_from(df, ["user_id"], ["ts", "event_id"], "events", F.col("event_type") == "error", F.unix_millis(F.col("ts").cast("timestamp")))
    return log.withColumn("_seq", F.unix_micros(F.col("_order.ts").cast("timestamp"))).drop("_order")


def upsert_latest(spark, sf):
    out = targets.latest(envelope.snapshot_of(read(spark, sf, "events"), "events", seq=F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"])
    return out.select("user_id", "event_id", "event_type", "value")


def upsert_with_deletes(spark, sf):
    return targets.latest(_change_log(spark, sf), ["user_id"]).select("user_id", "event_id", "event_type")


def append_reforge(spark, sf):
    return targets.append_rows(_change_log(spark, sf)).select("event_id", "user_id", "event_type")


def _seam(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The whole state as of the middle of the log, as a snapshot, and the log from a little before that instant."""
    log = _change_log(spark, sf)
    lo, hi = log.agg(F.min("_seq"), F.max("_seq")).first()
    at = ((lo or 0) + (hi or 0)) // 2
    snap = envelope.snapshot_of(targets.latest(log.where(F.col("_seq") <= at), ["user_id"]), "events", seq=F.lit(0))
    return snap, log.where(F.col("_seq") > at - ((hi or 0) - (lo or 0)) // 20)


def snapshot_cdc_overlap(spark, sf):
    """A snapshot taken in the middle and a tail that begins before it: the upsert absorbs the overlap."""
    return targets.latest(rows.union_rows(*_seam(spark, sf)), ["user_id"]).select("user_id", "event_id")


def start_from_instant(spark, sf):
    """Not the changes at or after an instant, but all from the first such one on, whatever their own ts."""
    log = envelope.changes_of(read(spark, sf, "change_log"), F.col("delivery_id"), before="before_row", after="after_row", src_pos="src_pos").where("op <> 'r'")
    return source_tables.start_from(log, "2024-03-17T00:00:00Z").select("_seq", "op")


def ddl_policy_ignore(spark, sf):
    events = envelope.changes_of(read(spark, sf, "change_log"), F.col("delivery_id"), before="before_row", after="after_row", schema="row_schema")
    return targets.apply_ddl_policy(events, "ignore").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def dead_letter(spark, sf):
    return rows.failed_rows(_change_log(spark, sf), "after.event_id > 0").select(F.col("before.event_id").alias("event_id"), F.col("_error").alias("error"))


def _state(df: DataFrame, seq: str) -> DataFrame:
    return df.withColumn("_seq", F.col(seq).cast("bigint"))


def nest_array(spark, sf):
    """Every embedded order with its place in the array; parents without orders have one row."""
    t = {"customer": _state(read(spark, sf, "customer"), "c_custkey"), "orders": _state(read(spark, sf, "orders"), "o_orderkey")}
    out = nesting.nest(t, nesting.Root("customer", ("c_custkey",), (nesting.Embed("orders", {"o_custkey": "c_custkey"}, "orders"),)))
    return out.select("c_custkey", F.size("orders").alias("n"), F.posexplode_outer("orders").alias("place", "o")).select("c_custkey", "n", "place", "o.o_orderkey", "o.o_totalprice")


def nest_two_level(spark, sf):
    t = {n: read(spark, sf, n) for n in ("region", "nation", "supplier")}
    tree = nesting.Root("region", ("r_regionkey",), (nesting.Embed("nation", {"n_regionkey": "r_regionkey"}, "geo.nations", embed=(nesting.Embed("supplier", {"s_nationkey": "n_nationkey"}, "suppliers"),)),))
    out = nesting.nest(t, tree).select("r_name", F.explode("geo.nations").alias("n"))
    return out.select("r_name", "n.n_name", F.size("n.suppliers").alias("n_suppliers"), F.explode_outer("n.suppliers.s_suppkey").alias("supplier"))


def nest_object(spark, sf):
    t = {"orders": _state(read(spark, sf, "orders"), "o_orderkey"), "customer": _state(read(spark, sf, "customer"), "c_custkey")}
    out = nesting.nest(t, nesting.Root("customer", ("c_custkey",), (nesting.Embed("orders", {"o_custkey": "c_custkey"}, "latest", mode="object"),)))
    return out.select("c_custkey", F.col("latest.o_orderkey").alias("latest_order"))


def nest_array_key_dedup(spark, sf):
    t = {"part": read(spark, sf, "part"), "lineitem": read(spark, sf, "lineitem").withColumn("_seq", F.col("l_orderkey") * 100 + F.col("l_linenumber"))}
    out = nesting.nest(t, nesting.Root("part", ("p_partkey",), (nesting.Embed("lineitem", {"l_partkey": "p_partkey"}, "lines", array_key=("l_suppkey",)),)))
    return out.select("p_partkey", F.size("lines").alias("n_suppliers"))


_JOIN_SQL = {
    "join_wide": ({"o": "orders", "c": "customer", "n": "nation"}, "SELECT o.o_orderkey, c.c_name, n.n_name FROM o JOIN c ON o.o_custkey = c.c_custkey JOIN n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000"),
    "join_agg": ({"c": "customer", "o": "orders"}, "SELECT c.c_custkey AS customer_id, count(*) AS order_cnt, max(o.o_totalprice) AS dearest FROM c JOIN o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey"),
    "join_left_full": ({"p": "part", "l": "lineitem"}, "SELECT p.p_partkey, count(l.l_orderkey) AS n FROM p LEFT JOIN l ON l.l_partkey = p.p_partkey AND l.l_quantity > 49 GROUP BY p.p_partkey"),
    "join_semi_anti": ({"c": "customer", "o": "orders"}, "SELECT c_custkey, 'big' AS kind FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND o_totalprice > 400000) UNION ALL SELECT c_custkey, 'none' FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND o_totalprice > 50000)"),
    "join_range": ({"a": "nation", "b": "region"}, "SELECT a.n_name, b.r_name FROM a JOIN b ON a.n_nationkey BETWEEN b.r_regionkey * 5 AND b.r_regionkey * 5 + 4"),
    "join_window_topk": ({"o": "orders"}, "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM o) t WHERE rk <= 2"),
    "join_analytic": ({"e": "events"}, "SELECT event_id, lag(event_id) OVER w AS prev_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "join_cube": ({"l": "lineitem"}, "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM l GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "join_rollup": ({"o": "orders"}, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM o GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "join_set_ops": ({"c": "customer", "s": "supplier"}, "(SELECT c_nationkey AS k FROM c INTERSECT SELECT s_nationkey FROM s) UNION ALL (SELECT c_nationkey FROM c WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM s WHERE s_acctbal > 9000)"),
    "join_subqueries": ({"p": "part", "l": "lineitem"}, "WITH avg_q AS (SELECT l_partkey AS k, avg(l_quantity) AS q FROM l GROUP BY l_partkey) SELECT p_partkey FROM p WHERE p_size > (SELECT avg(p_size) FROM p) AND p_partkey IN (SELECT k FROM avg_q WHERE q > 30)"),
}


def join_time_windows(spark, sf):
    sql = "SELECT event_type, count(*) AS n, window(ts, '1 day').start AS day FROM e GROUP BY event_type, window(ts, '1 day')"
    return joined(spark, sf, {"e": "events"}, sql).withColumn("day", F.col("day").cast("date").cast("string"))


def view_latest(spark, sf):
    return targets.latest(_change_log(spark, sf), ["user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


def push_envelope(spark, sf):
    out = targets.push_json(_events(spark, sf, "events"))
    return out.select(F.get_json_object("payload", "$.op").alias("op"), F.get_json_object("payload", "$.after.event_id").cast("bigint").alias("event_id"), F.get_json_object("payload", "$.after.event_type").alias("kind"), F.get_json_object("payload", "$.src").alias("src"))


def push_projection(spark, sf):
    docs = envelope.snapshot_of(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), "documents")
    out = targets.push_json(docs, {"site": "$source", "key": "=after.doc_id + 100", "n_chars": False})
    return out.select(F.get_json_object("payload", "$.site").alias("site"), F.get_json_object("payload", "$.key").cast("bigint").alias("key"), F.get_json_object("payload", "$.n_chars").alias("chars"))


def rename_tables(spark, sf):
    r = targets.Rename({"region": "ods_area"}, "pascal", "t_", "_x")
    return spark.createDataFrame([(k, v) for k, v in r.check(["region", "nation", "ORDER_ITEMS", "httpServerLog", "XMLFile2"]).items()], "source string, target string")


def py_fanout(spark, sf):
    """A Python step that drops, emits and changes records."""
    code = """
def filter(record):
    return record["after"]["event_type"] != "view"

def process(record, ctx):
    if record["after"]["user_id"] % 2 == 0:
        ctx.emit({**record, "src": "even", "op": "i"})
    record["after"]["event_type"] = record["after"]["event_type"].upper()
    return record if record["after"]["event_type"] != "CLICK" else None
"""
    events = envelope.snapshot_of(source_tables.declared(read(spark, sf, "events").select("event_id", "user_id", "event_type")), "events")
    return rows.py_step(events, code).select("op", "src", "after.event_id", "after.event_type")


_DOCUMENTS = [
    "kind: source\nid: shop\nconnector: parquet\nconfig: {{ path: '{path}', keys: {{ orders: [o_orderkey], customer: [c_custkey], nation: [n_nationkey] }} }}\nmode: snapshot\ntables: [ orders, /customer|nation/ ]\n",
    """kind: pipeline
id: customers_with_orders
source: shop
settings: { read_mode: snapshot_only }
transforms:
  - { id: dear, from: orders, type: filter, expr: "after.o_totalprice > 250000.0" }
  - { id: slim, type: map, fields: { order_id: $o_orderkey, customer_id: $o_custkey, urgent: "=after.o_orderpriority == '1-URGENT'", o_orderdate: false, o_orderstatus: false } }
  - { id: named, from: { c: shop.customer, n: nation }, type: join, engine: spark, sql: "SELECT c.c_custkey, c.c_name, n.n_name FROM c JOIN n ON c.c_nationkey = n.n_nationkey" }
  - id: tree
    type: nest
    from: { c: named, o: slim }
    root: { from: c, key: [c_custkey], embed: [ { from: o, on: { customer_id: c_custkey }, as: array, path: orders, arrayKey: [order_id] } ] }
view: { id: customers, from: tree, primary_key: c_custkey }
""",
]


def pipeline_documents(spark, sf):
    """A pipeline from its documents: filter, map, join, nest and a keyed view over one source."""
    from fluxloom.plans.pipeline import build
    from fluxloom.sources.readers import reader_for
    from fluxloom.spec import Workspace, load

    ws = Workspace([load(_DOCUMENTS[0].format(path=sf), {}), load(_DOCUMENTS[1], {})])
    view = build(ws, "customers_with_orders", {"shop": reader_for(spark, ws.by_id["shop"].body)}).view("customers")
    return view.select("c_custkey", "c_name", "n_name", F.size("orders").alias("n_orders"), F.size(F.filter("orders", lambda o: o["urgent"])).alias("n_urgent"))


def stream_upsert(spark, sf):
    """The change log as a stream of files into an upsert table; rows alive by arrival after all micro-batches."""
    from fluxloom.storage import file_system, scratch_path
    from fluxloom.streaming.tables import UpsertTable

    path, keys = f"{sf}/change_log.parquet", ["chain_id", "src", "id"]
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8)
    fs, at = file_system(spark, path)
    # a stream reads a folder: the table's own, or the one its single file lies in
    stream = stream.parquet(path) if fs.getFileStatus(at).isDirectory() else stream.option("pathGlobFilter", "change_log.parquet").parquet(sf)
    row = lambda side: F.when(F.col(side).isNotNull(), F.struct("chain_id", "src", f"{side}.id", f"{side}.customer", f"{side}.region"))
    shaped = stream.withColumn("src", plain(F.col("src"))).withColumn("old", row("before_row")).withColumn("new", row("after_row"))
    events = envelope.changes_of(shaped, F.col("delivery_id"), before="old", after="new", src_pos="src_pos")
    table = UpsertTable(spark, scratch_path(spark, "stream-upsert"), keys)
    out = events.writeStream.foreachBatch(lambda df, n: table.apply(targets.steps_of(df, keys), n) and None).option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
    out.trigger(availableNow=True).start().awaitTermination()
    return table.read().select("chain_id", "src", "id", "customer", "region")


_NAMED = [
    snapshot_scan, table_select_regex, table_filter, filter_predicate, filter_and_or_ternary, filter_string_fns, filter_in_list, filter_or_absorbs_error, filter_ddl_bypass, map_rename_drop_literal,
    map_computed_arith, map_int_div_mod, map_string_concat, map_timestamp_parts, map_order_passthrough, cel_list_macros, union_bag, fan_in_filter, fanout_exclusive, upsert_latest, upsert_with_deletes,
    append_reforge, snapshot_cdc_overlap, start_from_instant, ddl_policy_ignore, dead_letter, nest_array, nest_two_level, nest_object, nest_array_key_dedup, join_time_windows, view_latest,
    push_envelope, push_projection, rename_tables, py_fanout, pipeline_documents, stream_upsert,
]


def queries() -> dict:
    out = {f.__name__: f for f in _NAMED}
    for name, (aliases, sql) in _JOIN_SQL.items():
        out[name] = lambda spark, sf, a=aliases, q=sql: joined(spark, sf, a, q)
    return out


_LOG = """log AS (SELECT *, lag(event_type) OVER w AS pt, lag(event_id) OVER w AS pid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
chg AS (SELECT *, CASE WHEN event_type = 'error' THEN 'd' WHEN pid IS NULL OR pt = 'error' THEN 'i' ELSE 'u' END AS op FROM log)"""


def oracle_sql() -> dict:
    out = {
        "snapshot_scan": "SELECT 'r' AS op, 'nation' AS src, * FROM nation",
        "table_select_regex": "SELECT 'region' AS src, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation",
        "table_filter": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 1000 AND s_nationkey <> 3",
        "filter_predicate": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10",
        "filter_and_or_ternary": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND (CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey > 100 ELSE true END) AND o_orderkey % 7 <> 0",
        "filter_string_fns": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'e') AND (starts_with(p_type, 'STANDARD') OR ends_with(p_type, 'COPPER') OR regexp_matches(p_brand, 'Brand#[1-3]')) AND length(p_name) > 5",
        "filter_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)",
        "filter_or_absorbs_error": f"WITH {_LOG} SELECT op, event_id FROM chg WHERE op = 'd' OR event_id % 2 = 0",
        "filter_ddl_bypass": "SELECT lower(trim(op)) AS op, delivery_id AS _seq FROM change_log WHERE lower(trim(op)) IN ('ddl', 'i', 'r')",
        "map_rename_drop_literal": "SELECT c_custkey AS id, 'tpch' AS origin, 1::BIGINT AS rank, c_custkey AS copy, c_name, c_nationkey, c_mktsegment FROM customer",
        "map_computed_arith": "SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT * 2 + 1 AS line2, l_extendedprice * (1.0::DOUBLE - l_discount) AS net FROM lineitem",
        "map_int_div_mod": "SELECT o_orderkey, (o_orderkey - 5000) // 7 AS q, (o_orderkey - 5000) % 7 AS m FROM orders",
        "map_string_concat": "SELECT p_partkey, p_brand || '/' || p_type || '#' || p_size AS label FROM part",
        "map_timestamp_parts": "SELECT event_id, year(t) AS y, month(t) - 1 AS mo, day(t) AS d, dayofweek(t) AS dow, hour(t) AS h, millisecond(t) % 1000 AS ms FROM (SELECT event_id, date_trunc('milliseconds', ts) AS t FROM events)",
        "map_order_passthrough": "SELECT 'region,tag,n_nationkey,n_name' AS columns, n_regionkey AS region, true AS tag, n_nationkey, n_name FROM nation",
        "cel_list_macros": "SELECT doc_id, len(tags) AS n, len(list_filter(tags, lambda t: contains(t, 'e'))) > 0 AS \"any\", len(list_filter(tags, lambda t: length(t) <= 3)) = 0 AS every, len(list_filter(tags, lambda t: t = 'beginner')) = 1 AS one, len(list_filter(tags, lambda t: length(t) > 6)) AS long, len(tags) AS sizes, list_contains(tags, 'beginner') AS has_beginner FROM (SELECT doc_id, coalesce(tags, []) AS tags FROM documents)",
        "union_bag": "SELECT 'customer' AS src, c_name AS name, c_nationkey AS nation, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey, s_acctbal FROM supplier",
        "fan_in_filter": "SELECT 'nation' AS src, n_name, NULL AS r_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'region', NULL, r_name FROM region",
        "fanout_exclusive": "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'rest' END AS branch, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
        "upsert_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1",
        "upsert_with_deletes": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1 AND event_type <> 'error'",
        "append_reforge": "SELECT event_id, user_id, event_type FROM events",
        "snapshot_cdc_overlap": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1 AND event_type <> 'error'",
        "start_from_instant": "SELECT delivery_id AS _seq, lower(trim(op)) AS op FROM change_log WHERE lower(trim(op)) <> 'r' AND delivery_id >= (SELECT min(delivery_id) FROM change_log WHERE lower(trim(op)) <> 'r' AND ts >= 1710633600000)",
        "ddl_policy_ignore": "SELECT lower(trim(op)) AS op, count(*) AS n FROM change_log WHERE lower(trim(op)) <> 'ddl' GROUP BY 1",
        "dead_letter": "SELECT event_id, 'no such field: event_id' AS error FROM events WHERE event_type = 'error'",
        "nest_array": "SELECT c_custkey, count(o_orderkey) OVER (PARTITION BY c_custkey) AS n, CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 END AS place, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
        "nest_two_level": "SELECT r_name, n_name, count(s_suppkey) OVER (PARTITION BY n_nationkey) AS n_suppliers, s_suppkey AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey",
        "nest_object": "SELECT c_custkey, max(o_orderkey) AS latest_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "nest_array_key_dedup": "SELECT p_partkey, count(DISTINCT l_suppkey) AS n_suppliers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
        "join_time_windows": "SELECT event_type, count(*) AS n, ts::DATE::VARCHAR AS day FROM events GROUP BY 1, 3",
        "view_latest": "SELECT event_type, count(*) AS users FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1 AND event_type <> 'error' GROUP BY 1",
        "push_envelope": "SELECT 'r' AS op, event_id, event_type AS kind, 'events' AS src FROM events",
        "push_projection": "SELECT source AS site, doc_id + 100 AS key, NULL::VARCHAR AS chars FROM documents",
        "rename_tables": "SELECT * FROM (VALUES ('region', 'ods_area'), ('nation', 't_Nation_x'), ('ORDER_ITEMS', 't_OrderItems_x'), ('httpServerLog', 't_HttpServerLog_x'), ('XMLFile2', 't_XmlFile2_x')) v(source, target)",
        "pipeline_documents": "SELECT c_custkey, c_name, n_name, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1, 2, 3",
        "stream_upsert": """WITH e AS (SELECT chain_id, lower(trim(src)) AS src, lower(trim(op)) AS op, before_row AS b, after_row AS a, delivery_id AS n FROM change_log),
            s AS (SELECT chain_id, src, CASE WHEN op = 'd' THEN b.id ELSE a.id END AS id, n, op <> 'd' AS alive, a FROM e WHERE op <> 'ddl'
                  UNION ALL SELECT chain_id, src, b.id, n, false, NULL FROM e WHERE op = 'u' AND b IS NOT NULL AND b.id IS DISTINCT FROM a.id),
            l AS (SELECT *, row_number() OVER (PARTITION BY chain_id, src, id ORDER BY n DESC, alive DESC) AS rk FROM s)
            SELECT chain_id, src, id, a.customer AS customer, a.region AS region FROM l WHERE rk = 1 AND alive""",
        "py_fanout": "SELECT 'i' AS op, 'even' AS src, event_id, event_type FROM events WHERE event_type <> 'view' AND user_id % 2 = 0 UNION ALL SELECT 'r', 'events', event_id, upper(event_type) FROM events WHERE event_type NOT IN ('view', 'click')",
    }
    for name, (aliases, sql) in _JOIN_SQL.items():
        out[name] = plain_sql(aliases, sql)
    return out
