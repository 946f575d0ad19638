"""Queries over message feeds and table copies (problems 1 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.functions.messages import plain, position, position_digits
from fluxloom.operators import change_apply, exactly_once, skew, table_diff
from fluxloom.storage import materialize, scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Digits of a position that stay in the ordinal; any before them go to the namespace, so positions of any length are exact.
_ORDINAL_DIGITS = 15


def _identified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both feeds as encoded rows under their name, and the arrivals of what carries no identifier."""
    high = lambda d: F.when(F.length(d) <= _ORDINAL_DIGITS, "").otherwise(F.expr(f"substring(_digits, 1, length(_digits) - {_ORDINAL_DIGITS})"))
    low = F.expr(f"cast(right(_digits, {_ORDINAL_DIGITS}) as bigint)")
    log = read(spark, sf_dir, "change_log").select("delivery_id", "chain_id", plain(F.col("src")).alias("src"), plain(F.col("op")).eqNullSafe("r").alias("snapshot"), position_digits(F.col("src_pos")).alias("_digits"), F.col("after_row.id").alias("row"))
    snapshot = F.col("snapshot")
    number = F.when(snapshot, F.col("row")).otherwise(low)
    messages = exactly_once.encode(
        log, [F.lit("change_log"), F.col("chain_id"), F.col("src"), F.when(snapshot, "row").otherwise("position"), F.when(snapshot, "").otherwise(high(F.col("_digits")))],
        number, F.col("delivery_id"),
    )
    offsets = read(spark, sf_dir, "consumer_offset").select("offset_id", "pipeline_id", position_digits(F.col("sink_acked_srcpos")).alias("_digits"))
    checkpoints = exactly_once.encode(offsets, [F.lit("consumer_offset"), F.col("pipeline_id"), F.lit(""), F.lit("position"), high(F.col("_digits"))], low, F.col("offset_id"))
    others = exactly_once.unidentified(log, F.lit("change_log"), number, F.col("delivery_id")).unionByName(exactly_once.unidentified(offsets, F.lit("consumer_offset"), low, F.col("offset_id")))
    return messages.unionByName(checkpoints), others


def _kept(spark: SparkSession, sf_dir: str, batches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that carry an identifier, the kept ones of them, and the others."""
    rows, others = _identified(spark, sf_dir)
    arrivals = read(spark, sf_dir, "change_log").select(F.col("delivery_id").alias("a")).unionByName(read(spark, sf_dir, "consumer_offset").select(F.col("offset_id").alias("a")))
    rows, parts = exactly_once.arrival_batches(rows, batches, arrivals.agg(F.min("a"), F.max("a")).first())
    return rows, exactly_once.first_deliveries(parts, spark), others


def p1_found(spark: SparkSession, sf_dir: str, batches: int = 8) -> DataFrame:
    """The surplus deliveries: all but the first of the rows that carry the same identifier."""
    rows, kept, _ = _kept(spark, sf_dir, batches)
    return exactly_once.surplus(rows, kept).select(F.col("n0").alias("source_table"), F.col("arrival").alias("row_id"))


def p1_kept(spark: SparkSession, sf_dir: str, batches: int = 8) -> DataFrame:
    """The copies that come out: one arrival per identifier, and every row that carries none."""
    _, kept, others = _kept(spark, sf_dir, batches)
    return kept.unionByName(others).select(F.col("n0").alias("source_table"), F.col("arrival").alias("row_id"))


def _ring(spark: SparkSession, log: DataFrame, keys: list[str], batches: int) -> DataFrame:
    """The distinct positioned messages, numbered by chain, stream and position, in ``batches`` parts by their first arrival."""
    lo, hi = log.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    part = F.least(F.call_function("div", (F.col("delivery_id") - F.lit(lo or 0)) * batches, F.lit((hi or 0) - (lo or 0) + 1)), F.lit(batches - 1)).cast("int")
    # of a position longer than the ordinal's digits the part before them comes first in the order
    at = [F.expr(f"if(length(digits) <= {_ORDINAL_DIGITS}, '', substring(digits, 1, length(digits) - {_ORDINAL_DIGITS}))").alias("high"), F.expr(f"cast(right(digits, {_ORDINAL_DIGITS}) as bigint)").alias("low")]
    message = F.min_by(F.struct("op", "before_id", "after_id", "pos", part.alias("batch")), "delivery_id")
    ring = log.where("digits is not null and not (op <=> 'r')").groupBy(*keys, *at).agg(message.alias("m")).select(*keys, "high", "low", "m.*")
    path = scratch_path(spark, "ring")
    ring = change_apply.numbered(ring, [*keys, F.length("high"), "high", "low"]).drop("high", "low")
    ring.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return spark.read.schema(ring.schema).parquet(path)


def p2_found(spark: SparkSession, sf_dir: str, batches: int = 8) -> DataFrame:
    """Rows alive in each stream as each pipeline has read it, through delete vectors; the log is applied as it arrived."""
    token = F.col("src_pos")
    log = read(spark, sf_dir, "change_log").select("delivery_id", "chain_id", plain(F.col("src")).alias("src"), plain(F.col("op")).alias("op"), position_digits(token).alias("digits"), position(token).alias("pos"), F.col("before_row.id").alias("before_id"), F.col("after_row.id").alias("after_id"))
    keys = ["chain_id", "src"]
    ring = _ring(spark, log, keys, batches)
    wanted = (
        read(spark, sf_dir, "consumer_offset").select("pipeline_id", "chain_id", F.explode("per_table_seq").alias("name", "n"))
        .groupBy("pipeline_id", "chain_id", plain(F.col("name")).alias("src")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"))
    )
    cutoffs = skew.Narrow(materialize(change_apply.nth_number(ring, wanted, keys, "n").select("pipeline_id", *keys, "cutoff"), "cutoffs"), keys, F.col("id"))

    step = lambda i, alive: F.struct(i.alias("id"), F.lit(alive).alias("alive"))
    before, after = F.col("before_id"), F.col("after_id")
    sets = F.when(F.col("op").isin("i", "u") & after.isNotNull(), step(after, True))
    ends = F.when((F.col("op") == "d") | ((F.col("op") == "u") & ~before.eqNullSafe(after)), F.when(before.isNotNull(), step(before, False)))
    steps = ring.select(*keys, "_i", "pos", "batch", F.explode(F.filter(F.array(sets, ends), lambda x: x.isNotNull())).alias("s")).select(*keys, "_i", "pos", "batch", "s.*")
    read_by = cutoffs.join(steps).where("_i <= cutoff").select("pipeline_id", *keys, "id", "_i", "pos", "alive", "batch")
    snapshot = log.where("op = 'r' and after_id is not null").select(*keys, F.col("after_id").alias("id")).distinct()
    base = cutoffs.join(snapshot).select("pipeline_id", *keys, "id", F.lit(-1).cast("bigint").alias("_i"), F.lit(0).cast("bigint").alias("pos"), F.lit(True).alias("alive"))

    table = change_apply.DeltaTable(spark, ["pipeline_id", *keys, "id"], "_i", ["pos"]).apply(base)
    for b in range(batches):
        table.apply(read_by.where(F.col("batch") == b).drop("batch"))
    return table.read().select("pipeline_id", "src", "id", "pos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders missing on either side, and the fields that differ."""
    fields = {"customer": table_diff.text_value(F.col("customer")), "amount": table_diff.number_text(F.col("amount")), "region": table_diff.text_value(F.col("region"))}
    sides = [table_diff.latest(read(spark, sf_dir, t), table_diff.key_number(F.col("id")), F.col("loaded_at"), fields) for t in ("orders_source", "orders_target")]
    return table_diff.differences(*sides, list(fields))


def p3_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of either copy whose id is no number: they have no counterpart and are reported here."""
    sides = [table_diff.unkeyed(read(spark, sf_dir, t), F.col("id")).withColumn("source_table", F.lit(t)) for t in ("orders_source", "orders_target")]
    return sides[0].unionByName(sides[1])


def queries() -> dict:
    return {"p3_unkeyed": p3_unkeyed, "p1_found": p1_found, "p1_kept": p1_kept, "p2_found": p2_found, "p3_found": p3_found}


_P1 = r"""
WITH m AS (
  SELECT 'change_log' AS source_table, delivery_id AS row_id, chain_id AS a, lower(trim(src)) AS b, lower(trim(op)) = 'r' AS snap,
         CASE WHEN lower(trim(op)) = 'r' THEN after_row.id::HUGEINT ELSE TRY_CAST(regexp_extract(lower(trim(src_pos)), '^w(\d+)$', 1) AS HUGEINT) END AS k
  FROM change_log
  UNION ALL
  SELECT 'consumer_offset', offset_id, pipeline_id, '', false, TRY_CAST(regexp_extract(lower(trim(sink_acked_srcpos)), '^w(\d+)$', 1) AS HUGEINT) FROM consumer_offset
), n AS (SELECT source_table, row_id, k, row_number() OVER (PARTITION BY source_table, a, b, snap, k ORDER BY row_id) AS nth FROM m)
SELECT source_table, row_id FROM n WHERE """

_P2 = r"""
WITH log AS (
  SELECT delivery_id, chain_id, lower(trim(src)) AS src, lower(trim(op)) AS op, TRY_CAST(regexp_extract(lower(trim(src_pos)), '^w(\d+)$', 1) AS BIGINT) AS pos,
         before_row.id AS bid, after_row.id AS aid FROM change_log
), ring AS (
  SELECT *, row_number() OVER (PARTITION BY chain_id, src ORDER BY pos) AS num FROM (
    SELECT *, row_number() OVER (PARTITION BY chain_id, src, pos ORDER BY delivery_id) AS copy FROM log WHERE op <> 'r' AND pos IS NOT NULL) WHERE copy = 1
), entry AS (SELECT pipeline_id, chain_id, unnest(map_entries(per_table_seq)) AS e FROM consumer_offset
), want AS (SELECT pipeline_id, chain_id, lower(trim(e.key)) AS src, coalesce(max(e.value), 0) AS n FROM entry GROUP BY ALL
), ev AS (
  SELECT pipeline_id, chain_id, src, aid AS id, 0 AS num, 0 AS pos, true AS alive FROM log JOIN want USING (chain_id, src) WHERE op = 'r' AND aid IS NOT NULL
  UNION ALL SELECT pipeline_id, chain_id, src, aid, num, pos, true FROM ring JOIN want USING (chain_id, src) WHERE num <= n AND op IN ('i', 'u') AND aid IS NOT NULL
  UNION ALL SELECT pipeline_id, chain_id, src, bid, num, pos, false FROM ring JOIN want USING (chain_id, src)
    WHERE num <= n AND bid IS NOT NULL AND (op = 'd' OR op = 'u' AND bid IS DISTINCT FROM aid)
), fin AS (SELECT pipeline_id, chain_id, src, id, max(num) AS num, max_by(pos, num) AS pos, max_by(alive, num) AS alive FROM ev GROUP BY ALL)
SELECT pipeline_id, src, id, pos FROM fin WHERE alive
"""

_SIDE = r"""SELECT id, customer, amount, region FROM (
    SELECT TRY_CAST(trim(id::VARCHAR) AS BIGINT) AS id, rtrim(customer, ' ') AS customer, TRY_CAST(nullif(trim(amount::VARCHAR), '') AS DECIMAL(28, 8)) AS amount, rtrim(region, ' ') AS region,
      row_number() OVER (PARTITION BY TRY_CAST(trim(id::VARCHAR) AS BIGINT) ORDER BY loaded_at DESC NULLS LAST) AS nth FROM {}) WHERE nth = 1 AND id IS NOT NULL"""

_P3 = f"""
WITH s AS ({_SIDE.format("orders_source")}), t AS ({_SIDE.format("orders_target")}),
b AS (SELECT coalesce(s.id, t.id) AS id, s.id AS sid, t.id AS tid, s.customer AS sc, t.customer AS tc, s.amount AS sa, t.amount AS ta, s.region AS sr, t.region AS tr FROM s FULL JOIN t ON s.id = t.id)
SELECT id, CASE WHEN tid IS NULL THEN 'missing_in_target' ELSE 'missing_in_source' END AS diff_kind, 'row' AS field_name FROM b WHERE sid IS NULL OR tid IS NULL
UNION ALL SELECT id, 'differs', 'customer' FROM b WHERE sid = tid AND sc IS DISTINCT FROM tc
UNION ALL SELECT id, 'differs', 'amount' FROM b WHERE sid = tid AND sa IS DISTINCT FROM ta
UNION ALL SELECT id, 'differs', 'region' FROM b WHERE sid = tid AND sr IS DISTINCT FROM tr
"""


def oracle_sql() -> dict:
    lost = "SELECT id::VARCHAR AS key_text, count(*) AS n, '{0}' AS source_table FROM {0} WHERE TRY_CAST(trim(id::VARCHAR) AS BIGINT) IS NULL GROUP BY 1"
    return {"p3_unkeyed": f"{lost.format('orders_source')} UNION ALL {lost.format('orders_target')}", "p1_found": _P1 + "k IS NOT NULL AND nth > 1", "p1_kept": _P1 + "k IS NULL OR nth = 1", "p2_found": _P2, "p3_found": _P3}
