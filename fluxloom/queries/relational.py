"""Queries of a join step's SQL: the families of relational operators a step may use, and as-of and windowed forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.functions import registry
from fluxloom.operators import asof
from fluxloom.operators import nest as nesting
from fluxloom.queries.feeds import read


def joined(spark: SparkSession, sf: str, aliases: dict[str, str], sql: str) -> DataFrame:
    return nesting.sql_join({a: read(spark, sf, t) for a, t in aliases.items()}, sql)


#: Name -> tables by alias, SQL of the step, and the SQL to compare with where it is spelled in another way.
STEPS: dict[str, tuple[dict[str, str], str, str | None]] = {
    "join_full": ({"c": "customer", "o": "orders"}, "SELECT c.c_custkey, o.o_orderkey FROM c FULL JOIN o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", None),
    "join_right": ({"s": "supplier", "n": "nation"}, "SELECT n.n_name, s.s_suppkey FROM s RIGHT JOIN n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 8000", None),
    "join_interval": ({"e": "events", "f": "events"}, "SELECT e.event_id, count(*) AS n FROM e JOIN f ON e.user_id = f.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 2 HOURS WHERE e.event_type = 'view' GROUP BY e.event_id", None),
    "join_cross": ({"n": "nation", "r": "region"}, "SELECT n.n_name, r.r_name FROM n CROSS JOIN r", None),
    "join_grouping_sets": ({"l": "lineitem"}, "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS rolled FROM l GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", None),
    "join_ranks": ({"l": "lineitem"}, "SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(3) OVER v AS third FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity), v AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)", None),
    "join_navigation": ({"e": "events"}, "SELECT event_id, lead(event_id, 2) OVER w AS after_next, first_value(event_id) OVER w AS opening, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "join_moving": ({"e": "events"}, "SELECT event_id, count(*) OVER w AS n, max(event_id) OVER w AS newest FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)", None),
    "join_top_n": ({"o": "orders"}, "SELECT o_orderkey, o_totalprice FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", None),
    "join_set_all": ({"c": "customer", "s": "supplier"}, "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM c INTERSECT ALL SELECT s_nationkey FROM s) x UNION ALL SELECT 'rest', k FROM (SELECT c_nationkey AS k FROM c EXCEPT ALL SELECT s_nationkey FROM s) y UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM c UNION SELECT s_nationkey FROM s) z", None),
    "join_pivot": (
        {"o": "orders"}, "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM o) PIVOT (count(o_orderkey) AS n FOR o_orderstatus IN ('F' AS done, 'O' AS open, 'P' AS part))",
        "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS done, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS open, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS part FROM orders GROUP BY 1",
    ),
    "join_unnest": ({"d": "documents"}, "SELECT d.doc_id, t.tag FROM d, LATERAL explode(d.tags) AS t(tag)", "SELECT doc_id, unnest(tags) AS tag FROM documents"),
    "join_approx_distinct": (
        {"l": "lineitem"}, "SELECT l_returnflag, abs(approx_count_distinct(l_orderkey, 0.02) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) AS close FROM l GROUP BY l_returnflag",
        "SELECT DISTINCT l_returnflag, true AS close FROM lineitem",
    ),
    "join_lateral": ({"c": "customer", "o": "orders"}, "SELECT c.c_custkey, t.o_orderkey FROM c, LATERAL (SELECT o_orderkey FROM o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS t", "SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1 AND o_custkey IN (SELECT c_custkey FROM customer)"),
    "join_functions": (
        {"p": "part"}, "SELECT p_partkey, upper(substr(p_name, 1, 3)) AS head, regexp_replace(p_type, '[AEIOU]', '_') AS type, lpad(cast(p_size AS string), 4, '0') AS size, split_part(p_brand, '#', 2) AS brand, greatest(p_size, 10) AS at_least FROM p",
        "SELECT p_partkey, upper(substr(p_name, 1, 3)) AS head, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS type, lpad(p_size::VARCHAR, 4, '0') AS size, split_part(p_brand, '#', 2) AS brand, greatest(p_size, 10) AS at_least FROM part",
    ),
    "join_sliding_windows": (
        {"e": "events"}, "SELECT event_type, count(*) AS n, cast(window(ts, '2 hours', '1 hour').start AS string) AS begins FROM e GROUP BY event_type, window(ts, '2 hours', '1 hour')",
        "SELECT event_type, count(*) AS n, strftime(date_trunc('hour', ts) - to_hours(d), '%Y-%m-%d %H:%M:%S') AS begins FROM events, (VALUES (0), (1)) v(d) GROUP BY 1, 3",
    ),
    "join_session_windows": (
        {"e": "events"}, "SELECT user_id, count(*) AS n, min(event_id) AS opening FROM e GROUP BY user_id, session_window(ts, '8 hours')",
        "SELECT user_id, count(*) AS n, min(event_id) AS opening FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 8 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s",
    ),
}


def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    """For every purchase the last view of the same user at or before it."""
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    out = asof.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], at, at, F.col("event_id"), 7 * 86_400_000_000)
    return out.where("matched is not null").select("event_id", F.col("matched.event_id").alias("view_id"))


def join_own_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate registered by the caller: the spread of the prices of each customer's orders, in whole units."""
    registry.register_aggregate(spark, "spread_of", lambda x: int(x.max() - x.min()), "bigint")
    return joined(spark, sf, {"o": "orders"}, "SELECT o_custkey, spread_of(cast(o_totalprice AS bigint)) AS spread FROM o GROUP BY o_custkey")


def join_own_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """A table function registered by the caller: the words of every title with their places."""
    registry.register_table_function(spark, "places_of", lambda text: ((i, w) for i, w in enumerate((text or "").split(" "))), "place int, word string")
    return joined(spark, sf, {"d": "documents"}, "SELECT d.doc_id, t.place, t.word FROM d, LATERAL places_of(d.title) AS t WHERE d.title IS NOT NULL")


def queries() -> dict:
    steps = {name: lambda spark, sf, a=aliases, q=sql: joined(spark, sf, a, q) for name, (aliases, sql, _) in STEPS.items()}
    return {**steps, "join_asof": join_asof, "join_own_aggregate": join_own_aggregate, "join_own_table_function": join_own_table_function}


def plain_sql(aliases: dict[str, str], sql: str) -> str:
    """A step's SQL with its aliases spelled out."""
    for a, t in aliases.items():
        sql = re.sub(rf"\b(FROM|JOIN) {a}\b", rf"\1 {t} AS {a}", sql)
    return sql


def oracle_sql() -> dict:
    return {
        **{name: other or plain_sql(aliases, sql) for name, (aliases, sql, other) in STEPS.items()},
        "join_asof": "SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY 1",
        "join_own_aggregate": "SELECT o_custkey, max(p) - min(p) AS spread FROM (SELECT o_custkey, trunc(o_totalprice)::BIGINT AS p FROM orders) GROUP BY 1",
        "join_own_table_function": "SELECT doc_id, (unnest(range(len(w))))::INT AS place, unnest(w) AS word FROM (SELECT doc_id, string_split(title, ' ') AS w FROM documents WHERE title IS NOT NULL)",
    }
