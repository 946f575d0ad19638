"""Queries that run a whole pipeline: from its documents through ``Pipeline.start`` into target tables, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom import envelope
from fluxloom.functions.messages import plain, position
from fluxloom.queries.feeds import read
from fluxloom.sources import connectors
from fluxloom.sources.history import schema_history
from fluxloom.sources.readers import Reader
from fluxloom.spec import Workspace, load
from fluxloom.storage import scratch_path
from fluxloom.streaming.runtime import Pipeline

#: Files, and so micro-batches, of a landed change log.
FILES = 4


def user_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as a change log: first i, then u, error events as d; ``_seq`` is their time."""
    df = read(spark, sf, "events")
    log = envelope.change_log_from(df, ["user_id"], ["ts", "event_id"], "events", F.col("event_type") == "error", F.unix_millis(F.col("ts").cast("timestamp")))
    return log.withColumn("_seq", F.unix_micros(F.col("_order.ts").cast("timestamp"))).drop("_order")


def order_log(spark: SparkSession, sf: str, table: str, key: str, customer: str) -> DataFrame:
    """A table as a change log of two changes a row: inserted without its customer, then updated to what it is."""
    df = read(spark, sf, table)
    row = F.struct(*[F.col(c) for c in df.columns])
    early = F.struct(*[(F.lit(0).cast(df.schema[c].dataType) if c == customer else F.col(c)).alias(c) for c in df.columns])
    each = df.select(F.col(key).cast("bigint").alias("n"), row.alias("new"), early.alias("old"))
    i = each.select(F.lit("i").alias("op"), F.lit(None).cast(df.schema).alias("before"), F.col("old").alias("after"), (F.col("n") * 2).alias("_seq"))
    u = each.select(F.lit("u").alias("op"), F.col("old").alias("before"), F.col("new").alias("after"), (F.col("n") * 2 + 1).alias("_seq"))
    return i.unionByName(u).withColumn("ts", F.col("_seq"))


def land(log: DataFrame, root: str, table: str) -> None:
    """A change log as files of a folder, in no order of its changes."""
    rows = log.select("op", "ts", "before", "after", F.col("_seq").alias("seq"), F.concat(F.lit("w"), F.col("_seq")).alias("src_pos"))
    rows.repartition(FILES, F.xxhash64("seq")).write.parquet(f"{root}/{table}.log")


_SOURCE = "kind: source\nid: {}\nconnector: parquet\nconfig: {{ path: x }}\nmode: cdc\ntables: [ {} ]\n"


def run(spark: SparkSession, pipeline: str, readers: dict[str, Reader], tables: dict[str, str]) -> Pipeline:
    """A pipeline (id p, target source ``out``) over landed sources, run until it has read all there is, a file a micro-batch."""
    sources = [load(_SOURCE.format(s, tables[s]), {}) for s in readers]
    ws = Workspace([*sources, load("kind: source\nid: out\nconnector: parquet\nconfig: { path: y }\n", {}), load(pipeline, {})])
    p = Pipeline(spark, ws, "p", readers, scratch_path(spark, "run"))
    seen = p.start(files_per_trigger=1)
    if seen.state != "COMPLETED":
        raise RuntimeError(f"{seen.error_code}: {seen.error_detail}")
    return p


def _reader(spark: SparkSession, **logs: tuple[DataFrame, str]) -> Reader:
    root = scratch_path(spark, "land")
    for table, (log, _) in logs.items():
        land(log, root, table)
    return Reader(spark, root, keys={t: (k,) for t, (_, k) in logs.items()})


def runtime_union_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Two filtered arms of one table, put together again into one target."""
    doc = """kind: pipeline
id: p
source: shop
transforms:
  - { id: even, from: events, type: filter, expr: "op == 'd' || after.user_id % 2 == 0" }
  - { id: odd, from: events, type: filter, expr: "op == 'd' || after.user_id % 2 == 1" }
  - { id: both, from: [ even, odd ], type: union }
serve: { from: both, sync: [ { id: s, source: out } ] }
"""
    p = run(spark, doc, {"shop": _reader(spark, events=(user_log(spark, sf), "user_id"))}, {"shop": "events"})
    return p.table("out", "events", ("user_id",)).select("user_id", "event_id", "event_type")


def runtime_two_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources with a table of the same name, into one target; and how many events the run counted."""
    doc = """kind: pipeline
id: p
source: [ left, right ]
transforms:
  - { id: both, from: [ left.events, right.events ], type: union }
serve: { from: both, sync: [ { id: s, source: out } ] }
"""
    log = user_log(spark, sf)
    user = F.coalesce("after.user_id", "before.user_id")
    readers = {n: _reader(spark, events=(log.where(user % 2 == i), "user_id")) for i, n in enumerate(("left", "right"))}
    p = run(spark, doc, readers, {"left": "events", "right": "events"})
    return p.table("out", "events", ("user_id",)).select("user_id", "event_id", F.lit(p.status().record_count).cast("bigint").alias("taken"))


def runtime_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    """The events a filter fails on, in the dead-letter table; the others go on.  Deletes carry no ``after``."""
    doc = """kind: pipeline
id: p
source: shop
settings: { error_policy: dead_letter }
transforms:
  - { id: some, from: events, type: filter, expr: "after.event_type != 'click'" }
serve: { from: some, sync: [ { id: s, source: out, write_mode: append } ] }
"""
    p = run(spark, doc, {"shop": _reader(spark, events=(user_log(spark, sf), "user_id"))}, {"shop": "events"})
    dead = p.dead_letters().select(F.get_json_object("before", "$.event_id").cast("bigint").alias("event_id"), F.lit("dead").alias("where_to"))
    return dead.unionByName(p.table("out", "events").select("event_id", F.lit("target").alias("where_to"))).withColumn("errors", F.lit(p.status().error_count).cast("bigint"))


def runtime_start_from_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A tail that starts at the end: what lies in the log is not read, what comes after the start is."""
    doc = """kind: pipeline
id: p
source: shop
settings: { read_mode: cdc_only, start_from: latest }
transforms:
  - { id: all, from: events, type: union }
serve: { from: all, sync: [ { id: s, source: out } ] }
"""
    log = user_log(spark, sf)
    lo, hi = log.agg(F.min("_seq"), F.max("_seq")).first()
    middle = ((lo or 0) + (hi or 0)) // 2
    reader = _reader(spark, events=(log.where(F.col("_seq") <= middle), "user_id"))
    p = run(spark, doc, {"shop": reader}, {"shop": "events"})
    later = log.where(F.col("_seq") > middle).select("op", "ts", "before", "after", F.col("_seq").alias("seq"), F.concat(F.lit("w"), F.col("_seq")).alias("src_pos"))
    later.repartition(FILES, F.xxhash64("seq")).write.mode("append").parquet(f"{reader.root}/events.log")
    if p.start(files_per_trigger=1).state != "COMPLETED":
        raise RuntimeError(str(p.status()))
    return p.table("out", "events", ("user_id",)).select("user_id", "event_id", "event_type")


_NEST = """kind: pipeline
id: p
source: shop
transforms:
  - id: tree
    type: nest
    from: {{ c: shop.customer, o: shop.orders }}
    root: {{ from: c, key: [c_custkey], embed: [ {{ from: o, on: {{ o_custkey: c_custkey }}, as: array, path: orders, arrayKey: [o_orderkey]{} }} ] }}
serve: {{ from: tree, sync: [ {{ id: s, source: out }} ] }}
"""


def _nested(spark: SparkSession, sf: str, more: str) -> DataFrame:
    logs = {"customer": (order_log(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_custkey"), "orders": (order_log(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_orderkey")}
    p = run(spark, _NEST.format(more), {"shop": _reader(spark, **logs)}, {"shop": "customer, orders"})
    return p.table("out", "tree", ("c_custkey",)).select("c_custkey", "c_nationkey", F.posexplode("orders").alias("place", "o")).select("c_custkey", "c_nationkey", "place", "o.o_orderkey", "o.o_totalprice", "o.o_orderpriority")


def stream_nest(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their orders, both from change logs: content and order of every array in the target."""
    return _nested(spark, sf, "")


def nest_ignore_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The same, where orders are embedded as they were first set."""
    return _nested(spark, sf, ", ignoreUpdates: true")


def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """A join step over two change logs, in the target."""
    doc = """kind: pipeline
id: p
source: shop
transforms:
  - { id: sums, type: join, engine: spark, from: { c: shop.customer, o: shop.orders }, sql: "SELECT c.c_nationkey, count(*) AS n, max(o.o_orderkey) AS newest FROM c JOIN o ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey" }
serve: { from: sums, sync: [ { id: s, source: out } ] }
"""
    logs = {"customer": (order_log(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_custkey"), "orders": (order_log(spark, sf, "orders", "o_orderkey", "o_custkey"), "o_orderkey")}
    return run(spark, doc, {"shop": _reader(spark, **logs)}, {"shop": "customer, orders"}).table("out", "sums")


def view_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """A view kept up by a run and stored in its tiers; what the warm collection and the partitioned cold table hold."""
    doc = """kind: pipeline
id: p
source: shop
transforms:
  - { id: all, from: events, type: union }
view: { id: latest_event, from: all, primary_key: user_id, storage: { warm: { collection: latest }, cold: { partition_by: [ event_type ] } } }
"""
    p = run(spark, doc, {"shop": _reader(spark, events=(user_log(spark, sf), "user_id"))}, {"shop": "events"})
    warm, cold = p.view("latest_event"), spark.read.parquet(f"{p.target}/_views/latest_event.cold")
    count = lambda df, tier: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.min("event_id").alias("oldest")).withColumn("tier", F.lit(tier))
    return count(warm, "warm").unionByName(count(cold, "cold"))


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day over a stream with a watermark: what comes later than the watermark allows is dropped."""
    from fluxloom.streaming.tables import UpsertTable

    e = read(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    root, half = scratch_path(spark, "late"), F.lit(lo) + (F.lit(hi) - F.lit(lo)) / 2 if lo else F.current_timestamp()
    for part in (e.where(F.col("ts") < half), e.where(F.col("ts") >= half), e.where(F.col("ts") < half - F.expr("INTERVAL 3 DAYS"))):
        part.coalesce(1).write.mode("append").parquet(root)  # the third arrives long after its time
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(root)
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    table = UpsertTable(spark, scratch_path(spark, "late-counts"), ["day", "event_type"])

    def keep(df: DataFrame, batch: int) -> None:
        row = F.struct(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
        table.apply(df.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", F.lit(batch).cast("bigint").alias("_seq"), F.lit(True).alias("alive"), row.alias("row")), batch)

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "late-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read().select("day", "event_type", "n")


def ring_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Of every change log: the lowest position that all its consumers have acknowledged, and what lies beyond it."""
    log = read(spark, sf, "change_log").select("chain_id", position(F.col("src_pos")).alias("pos"))
    acked = read(spark, sf, "consumer_offset").select("chain_id", "pipeline_id", position(F.col("sink_acked_srcpos")).alias("pos"))
    return connectors.frontier(log, acked)


def schema_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The versions of every stream's schema over the change log."""
    log = read(spark, sf, "change_log").where(plain(F.col("op")) == "ddl")
    return schema_history(log.select("delivery_id", "chain_id", plain(F.col("src")).alias("src"), position(F.col("src_pos")).alias("pos"), F.col("row_schema").alias("schema")), ["chain_id", "src"])


_NAMED = [
    runtime_union_arms, runtime_two_sources, runtime_dead_letter, runtime_start_from_latest, stream_nest, nest_ignore_updates, stream_join, view_tiers, stream_late_rows, ring_frontier, schema_versions,
]


def queries() -> dict:
    return {f.__name__: f for f in _NAMED}


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1 AND event_type <> 'error')"


def oracle_sql() -> dict:
    nest = "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS place, o_orderkey, {} AS o_totalprice, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey"
    return {
        "runtime_union_arms": f"SELECT user_id, event_id, event_type FROM {_LAST}",
        "runtime_two_sources": f"SELECT user_id, event_id, (SELECT count(*) FROM events) AS taken FROM {_LAST}",
        "runtime_dead_letter": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'target' END AS where_to, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors FROM events WHERE event_type <> 'click'",
        "runtime_start_from_latest": "WITH m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS middle FROM events) SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events, m WHERE epoch_us(ts) > middle) WHERE rk = 1 AND event_type <> 'error'",
        "stream_nest": nest.format("o_totalprice"), "nest_ignore_updates": nest.format("0::DOUBLE"),
        "stream_join": "SELECT c_nationkey, count(*) AS n, max(o_orderkey) AS newest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "view_tiers": f"SELECT event_type, count(*) AS users, min(event_id) AS oldest, tier FROM {_LAST}, (VALUES ('warm'), ('cold')) v(tier) GROUP BY 1, 4",
        "stream_late_rows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "schema_versions": r"""WITH d AS (SELECT chain_id, lower(trim(src)) AS src, TRY_CAST(regexp_extract(lower(trim(src_pos)), '^w(\d+)$', 1) AS BIGINT) AS pos, delivery_id,
              array_to_string(list_transform(list_sort(map_keys(row_schema)), lambda k: k || ' ' || coalesce(row_schema[k], 'null')), ', ') AS fields FROM change_log WHERE lower(trim(op)) = 'ddl' AND row_schema IS NOT NULL),
            o AS (SELECT chain_id, src, pos, arg_min(fields, delivery_id) AS fields FROM d WHERE pos IS NOT NULL GROUP BY 1, 2, 3),
            n AS (SELECT *, lag(fields) OVER (PARTITION BY chain_id, src ORDER BY pos) AS before FROM o)
            SELECT chain_id, src, row_number() OVER (PARTITION BY chain_id, src ORDER BY pos) AS version, pos AS since, fields FROM n WHERE before IS DISTINCT FROM fields""",
        "ring_frontier": r"""WITH c AS (SELECT chain_id, pipeline_id, max(TRY_CAST(regexp_extract(lower(trim(sink_acked_srcpos)), '^w(\d+)$', 1) AS BIGINT)) AS p FROM consumer_offset GROUP BY 1, 2),
            f AS (SELECT chain_id, count(*) AS consumers, CASE WHEN count(p) = count(*) THEN min(p) END AS frontier FROM c GROUP BY 1),
            l AS (SELECT DISTINCT chain_id, TRY_CAST(regexp_extract(lower(trim(src_pos)), '^w(\d+)$', 1) AS BIGINT) AS p FROM change_log WHERE regexp_matches(lower(trim(src_pos)), '^w(\d+)$'))
            SELECT l.chain_id, coalesce(any_value(f.consumers), 0) AS consumers, any_value(f.frontier) AS frontier, count(*) FILTER (f.frontier IS NULL OR l.p > f.frontier) AS beyond FROM l LEFT JOIN f ON f.chain_id = l.chain_id GROUP BY 1""",
    }
