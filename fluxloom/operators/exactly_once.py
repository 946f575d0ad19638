"""Exactly one copy of every message that was delivered at least once.

An identifier is a namespace (any columns) and a whole number inside it.  It is
encoded exactly: a dictionary gives every namespace a code, and (code, number) is
one bit of a bitmap.  The bits that have been seen lie in shards as compressed
words (see ``bitmaps``).  A batch goes through five steps:

1. namespaces the dictionary does not hold get codes, dense within 64 classes;
2. one candidate per identifier, the smallest arrival, by a partially
   aggregated ``groupBy`` (a message repeated a billion times costs a task one row);
3. the candidates look up their word, in the shards they fall into; those whose
   bit is set are late copies;
4. the others are the batch's winners, and are written;
5. their bits are united with the words of those shards.

Dictionary, shards, winners and the name of the batch become visible by one
rename.  A batch that stopped before it is done again from the start; one that
stopped after it gives its winners again.  A word has at most 64 candidates, so
no lookup or union is skewed; nothing but shard numbers is collected, and only
a dictionary of a measured size is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom.functions.bitmaps import is_set, numbers, united, word_of, words
from fluxloom.manifest import Manifest
from fluxloom.operators.skew import Narrow
from fluxloom.storage import scratch_path

#: Classes of namespaces that are numbered on their own.
_CLASSES = 64
_NAMES = "ns string, code bigint"
_WORDS = "shard int, code bigint, word bigint, bits bigint"


class SeenBits:
    """Dictionary, seen bits and winners under a folder, as of its manifest."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)
        self._shards = shards
        self._known: tuple[list[str], Narrow] | None = None

    def shards(self, state: Mapping) -> int:
        """Shards of the bitmap, fixed by the first batch."""
        return state.get("n_shards") or self._shards or max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def version(self) -> int:
        return self.manifest.load()[0]

    def known(self, state: Mapping) -> Narrow:
        """The dictionary (``ns``, ``code``), measured anew when it has grown."""
        parts = state.get("names", [])
        if self._known is None or self._known[0] != parts:
            at = [f"{self.path}/{p}" for p in parts]
            self._known = parts, Narrow(self.spark.read.schema(_NAMES).parquet(*at) if at else self.spark.createDataFrame([], _NAMES), ["ns"], F.col("number"))
        return self._known[1]

    def bits(self, state: Mapping, shards: Iterable[int] | None = None) -> DataFrame | None:
        """The words (``shard``, ``code``, ``word``, ``bits``) of some shards, or of all; None if nothing has been seen there."""
        held = state.get("shards", {})
        at = [f"{self.path}/{held[s]}/at={s}" for s in (held if shards is None else map(str, shards)) if s in held]
        return self.spark.read.schema(_WORDS).parquet(*at) if at else None

    def winners(self, part: str) -> DataFrame:
        return self.spark.read.schema("n0 string, code bigint, number bigint, arrival bigint, shard int").parquet(f"{self.path}/{part}").select("n0", "arrival")


def _spelled(part: Column) -> Column:
    """A namespace part, spelled so that parts put together stay apart: its length, a colon and itself; null is a dash."""
    text = part.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def encode(df: DataFrame, namespace: Sequence[Column], ordinal: Column, arrival: Column) -> DataFrame:
    """Rows as (``n0``, ``ns``, ``number``, ``arrival``); rows without an ordinal have no identifier and are left to
    ``unidentified``, rows without an arrival cannot be told apart and are left out."""
    ns = F.concat(*[_spelled(c) for c in namespace])
    return df.select(namespace[0].cast("string").alias("n0"), ns.alias("ns"), ordinal.cast("bigint").alias("number"), arrival.cast("bigint").alias("arrival")).where("number is not null and arrival is not null")


def unidentified(df: DataFrame, feed: Column, ordinal: Column, arrival: Column) -> DataFrame:
    """(``n0``, ``arrival``) of the rows without an ordinal: never copies of anything, so each comes out."""
    return df.where(ordinal.cast("bigint").isNull() & arrival.isNotNull()).select(feed.cast("string").alias("n0"), arrival.cast("bigint").alias("arrival"))


def _coded(batch: DataFrame, seen: SeenBits, state: dict) -> tuple[DataFrame, dict, list[int]]:
    """The batch with codes and shards, the state with new namespaces in its dictionary, and the shards the batch falls into."""
    n = state["n_shards"]
    shard = F.pmod(F.xxhash64("ns", F.shiftright("number", 15)), F.lit(n)).cast("int")  # a shard holds runs of 512 words
    batch = batch.withColumn("shard", shard)
    named = seen.known(state).left(batch)
    new, touched = named.agg(F.count_if(F.col("code").isNull()), F.collect_set("shard")).first()  # at most one entry a shard
    if new:
        fresh = named.where("code is null").select("ns").distinct()
        base = state.get("named") or [0] * _CLASSES
        kind = F.pmod(F.xxhash64("ns"), F.lit(_CLASSES)).cast("int")
        nth = F.row_number().over(Window.partitionBy("_class").orderBy("ns")) - 1
        before = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in base]), F.col("_class") + 1)
        part = f"names-{uuid.uuid4().hex}"
        fresh.withColumn("_class", kind).select("ns", ((before + nth) * _CLASSES + F.col("_class")).alias("code")).write.option("compression", "zstd").parquet(f"{seen.path}/{part}")
        added = {r[0]: r[1] for r in seen.spark.read.schema(_NAMES).parquet(f"{seen.path}/{part}").groupBy((F.col("code") % _CLASSES).alias("c")).count().collect()}  # at most 64 rows
        state = {**state, "names": [*state.get("names", []), part], "named": [x + added.get(i, 0) for i, x in enumerate(base)]}
        named = seen.known(state).left(batch)
    return named.select("n0", "code", "number", "arrival", "shard"), state, sorted(touched)


def take_unseen(batch: DataFrame, seen: SeenBits, name: str | None = None) -> DataFrame:
    """Winners (``n0``, ``arrival``) of an encoded batch: the smallest arrival of every identifier whose bit is not set.

    Winners and bits are committed together under the ``name`` of the batch; a batch that is there gives its winners again.
    """
    held, state = seen.manifest.load()
    name = name or uuid.uuid4().hex
    if name in state["batches"]:
        return seen.winners(state["batches"][name])
    coded, state, touched = _coded(batch, seen, {**state, "n_shards": seen.shards(state)})
    best = coded.groupBy("n0", "code", "number", "shard").agg(F.min("arrival").alias("arrival"))
    part, known = f"winners-{uuid.uuid4().hex}", seen.bits(state, touched)
    if known is not None:
        same = (best["code"] == known["code"]) & (word_of(best["number"]) == known["word"])
        # words lie compressed: the size of their files says little about their size in memory, so never broadcast them
        best = best.join(known.hint("merge"), same, "left").where(~is_set(known["bits"], best["number"])).select(*[best[c] for c in best.columns])
    best.write.option("compression", "zstd").parquet(f"{seen.path}/{part}")
    fresh = words(seen.spark.read.schema(best.schema).parquet(f"{seen.path}/{part}"), ["shard", "code"], F.col("number"))
    if known is not None:
        fresh = united(fresh.unionByName(known), ["shard", "code"])
    bits = f"bits-{uuid.uuid4().hex}"
    # the shard is a column too, so that what is read from its folder alone knows it
    fresh.withColumn("at", F.col("shard")).repartition("at").sortWithinPartitions("at", "code", "word").write.partitionBy("at").option("compression", "zstd").parquet(f"{seen.path}/{bits}")
    held_at = state.get("shards", {})
    state = {**state, "shards": {**held_at, **{str(s): bits for s in touched}}, "batches": {**state["batches"], name: part}}
    seen.manifest.commit(held, state, [f"{held_at[str(s)]}/at={s}" for s in touched if str(s) in held_at])
    return seen.winners(part)


def first_deliveries(batches: Iterable[DataFrame] | Mapping[str, DataFrame], spark: SparkSession, seen: SeenBits | None = None) -> DataFrame:
    """(``n0``, ``arrival``) of the kept copies over encoded batches, given in order of arrival, under names if they may be replayed.

    ``n0`` is the first part of the namespace; several feeds with arrivals of their own go through together with the
    feed's name as that part.  A null namespace part equals a null.  The arrival must be unique in its feed; where it is
    not, rows that share the kept arrival count as one delivery.  No batch, or empty ones, give an empty result.
    """
    seen = seen or SeenBits(spark, scratch_path(spark, "seen"))
    kept = None
    for name, batch in batches.items() if isinstance(batches, Mapping) else ((None, b) for b in batches):
        won = take_unseen(batch, seen, name)
        kept = won if kept is None else kept.unionByName(won)
    return kept if kept is not None else spark.createDataFrame([], "n0 string, arrival bigint")


def arrival_batches(df: DataFrame, n: int, bounds: tuple[int, int] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Encoded rows, written once in ``n`` successive ranges of arrival: all of them, and each batch under its name.

    ``bounds``: the least and greatest arrival, where they are known; rows beyond them go to the first and last batch.
    """
    lo, hi = bounds or df.agg(F.min("arrival"), F.max("arrival")).first()
    if lo is None:
        return df, {}
    edges = [lo + (hi + 1 - lo) * i // n for i in range(1, n)]
    batch = F.lit(0)
    for e in edges:
        batch = batch + (F.col("arrival") >= e).cast("int")
    path = scratch_path(df.sparkSession, "arrivals")
    df.withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(df.withColumn("batch", batch).schema).parquet(path)
    return rows, {f"batch-{i}": rows.where(F.col("batch") == i).drop("batch") for i in range(n)}


def surplus(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(``n0``, ``arrival``) of the encoded ``rows`` whose arrival is not among ``kept``.

    Both sides are bitmaps over the arrivals, made where the rows lie: a word a task and 64 arrivals is all that is shuffled.
    """
    given = words(rows, ["n0"], F.col("arrival")).select("n0", "word", "bits", F.lit(0).cast("bigint").alias("kept"))
    stay = words(kept, ["n0"], F.col("arrival")).select("n0", "word", F.lit(0).cast("bigint").alias("bits"), F.col("bits").alias("kept"))
    both = given.unionByName(stay).groupBy("n0", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("kept").alias("kept"))
    lost = F.col("bits").bitwiseAND(F.bitwise_not("kept"))
    return both.where(lost != 0).select("n0", F.explode(numbers(F.col("word"), lost)).alias("arrival"))
