"""Applying a change feed to a keyed table, merge-on-read with delete vectors.

Row images lie in parquet files that are only ever added.  A key index, in
buckets by key hash, knows for every key that was ever changed the order of its
last change and, if the row is alive, the file and place of its image.  A batch
of changes, in any order and with repetitions, is applied in four steps:

1. the batch says which buckets it touches; the others are neither read nor written;
2. changes and index entries of those buckets meet in one partially aggregated
   ``groupBy`` of the key (a hot key costs one row per task).  The last change of
   a key wins if it follows what the index holds; a late or repeated one is dropped.
   An ended row stays in the index, so a late change cannot revive it;
3. the places of superseded images go, as bits, into the delete vectors of their files;
4. the new images are written, found again under their real file and place, and
   the touched buckets of the index are written anew.

All of it becomes visible by one rename, together with the name of the batch, so
a batch that is run again changes nothing.  ``read`` leaves out the places whose
bit is set; the vectors are broadcast where they are measured to be small.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.functions.bitmaps import is_set, united, word_of, words
from fluxloom.manifest import Manifest
from fluxloom.operators.skew import BROADCAST_BYTES
from fluxloom.storage import scratch_path

#: What becomes of a key in a batch: its index entry stays, it gets an image, it ends.
_KEPT, _IMAGE, _ENDED = 0, 1, 2
#: Parts of the delete vectors from which on they are merged into one.
_MERGE_AFTER = 8


class DeltaTable:
    """Rows keyed by ``keys`` under a folder: images, delete vectors and the key index, as of the manifest.

    Changes have the key columns, ``order_col`` (a whole number; null is before all others), ``alive`` (true: the row is
    set, false: it ends) and ``payload`` columns.  Keys compare as groupBy compares them (null equals null).  Of changes
    tied in order, one that ends the row loses to one that sets it; among equals any one counts.  Without a ``path`` the
    table lives as long as the session.  ``buckets`` is fixed by the first batch.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], order_col: str, payload: Sequence[str] = (), path: str | None = None, buckets: int | None = None):
        self.spark, self.keys, self.order, self.payload = spark, list(keys), order_col, [c for c in payload if c != order_col]
        self.path = (path or scratch_path(spark, "delta")).rstrip("/")
        self.manifest = Manifest(spark, self.path)
        self._buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _entry_types(self, schema: T.StructType) -> T.StructType:
        """Types of an index row: the key, the order of its last change, and where its image lies (null: ended)."""
        at = [T.StructField(n, T.LongType()) for n in ("_o", "_file", "_row")]
        return T.StructType([*(T.StructField(k, schema[k].dataType) for k in self.keys), *at])

    def index(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The index entries (keys, ``_o``, ``_file``, ``_row``) of some buckets, or of all; None if there are none."""
        return self._index(self.manifest.load()[1], buckets)

    def _index(self, state: dict, buckets: Sequence[int] | None) -> DataFrame | None:
        held = state.get("buckets", {})
        at = [f"{self.path}/{held[b]}/_bucket={b}" for b in (held if buckets is None else map(str, buckets)) if b in held]
        return self.spark.read.schema(self._entry_types(T.StructType.fromJson(state["row"]))).parquet(*at) if at else None

    def _stage(self, changes: DataFrame, state: dict, touched: Sequence[int], schema: T.StructType) -> DataFrame:
        """Every key of the touched buckets with what becomes of it."""
        image = F.struct(F.coalesce(F.col(self.order).cast("bigint"), F.lit(-(2**63))).alias("o"), F.col("alive").alias("a"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(self.payload)])
        rows = changes.select(*self.keys, image.alias("_new"))
        old = self._index(state, touched)
        entry = T.StructType([T.StructField(n, T.LongType()) for n in ("_o", "_file", "_row")])
        if old is None:
            rows = rows.withColumn("_old", F.lit(None).cast(entry))
        else:
            known = old.select(*self.keys, F.lit(None).cast(rows.schema["_new"].dataType).alias("_new"), F.struct("_o", "_file", "_row").alias("_old"))
            rows = rows.withColumn("_old", F.lit(None).cast(entry)).unionByName(known)
        met = rows.groupBy(*self.keys).agg(F.max_by("_new", F.when(F.col("_new").isNotNull(), F.struct("_new.o", "_new.a"))).alias("_new"), F.max("_old").alias("_old"))
        new, was = F.col("_new"), F.col("_old")
        same = (new["o"] == was["_o"]) & new["a"] & was["_file"].isNull()  # set and ended at the same order: it is set
        won = new.isNotNull() & (was.isNull() | (new["o"] > was["_o"]) | same)
        what = F.when(~won, _KEPT).when(new["a"], _IMAGE).otherwise(_ENDED)
        return met.withColumn("_won", won).select(
            *self.keys, F.when(F.col("_won"), new["o"]).otherwise(was["_o"]).alias("_o"), *[F.when(F.col("_won"), new[f"p{i}"]).alias(f"p{i}") for i in range(len(self.payload))],
            was["_file"].alias("_file"), was["_row"].alias("_row"), what.alias("_what"),
        )

    def apply(self, changes: DataFrame, name: str | None = None) -> "DeltaTable":
        """Apply one batch; batches, and the changes in them, may come in any order.  A ``name`` that was applied is passed over."""
        held, state = self.manifest.load()
        name = name or uuid.uuid4().hex
        if name in state["batches"]:
            return self
        n, batch, tag = state.get("n_buckets") or self._buckets, len(state["batches"]), uuid.uuid4().hex
        row = T.StructType([T.StructField(c, changes.schema[c].dataType) for c in [*self.keys, *self.payload]])
        state = {**state, "n_buckets": n, "row": state.get("row") or row.jsonValue()}
        touched = sorted(r[0] for r in changes.select(self._bucket(n).alias("b")).distinct().collect())  # at most one row a bucket
        held_at = state.get("buckets", {})
        retired: list[str] = []
        if touched:
            staged = self._stage(changes, state, touched, row)
            staged.write.partitionBy("_what").option("compression", "zstd").parquet(f"{self.path}/images-{tag}")
            back = self.spark.read.schema(staged.schema).parquet(f"{self.path}/images-{tag}")
            gone = back.where((F.col("_what") != _KEPT) & F.col("_file").isNotNull())
            vectors = state.get("vectors", [])
            if any(str(b) in held_at for b in touched):
                words(gone, ["_file"], F.col("_row")).write.option("compression", "zstd").parquet(f"{self.path}/vectors-{tag}")
                vectors = [*vectors, f"vectors-{tag}"]
            if len(vectors) > _MERGE_AFTER:
                self._vectors(vectors).repartition("_file").sortWithinPartitions("_file", "word").write.option("compression", "zstd").parquet(f"{self.path}/vectors-{tag}-merged")
                retired += vectors
                vectors = [f"vectors-{tag}-merged"]
            image, kept = F.col("_what") == _IMAGE, F.col("_what") == _KEPT
            entries = back.select(*self.keys, "_o", F.when(image, _file_number(batch)).when(kept, F.col("_file")).alias("_file"), F.when(image, F.col("_metadata.row_index")).when(kept, F.col("_row")).alias("_row"))
            entries.withColumn("_bucket", self._bucket(n)).repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/index-{tag}")
            retired += [f"images-{tag}/_what={_KEPT}", *(f"{held_at[str(b)]}/_bucket={b}" for b in touched if str(b) in held_at)]
            state = {**state, "vectors": vectors, "images": [*state.get("images", []), [batch, f"images-{tag}"]], "buckets": {**held_at, **{str(b): f"index-{tag}" for b in touched}}}
        self.manifest.commit(held, {**state, "batches": {**state["batches"], name: batch}}, retired)
        return self

    def _vectors(self, parts: Sequence[str]) -> DataFrame:
        """The delete vectors: (``_file``, ``word``, ``bits``), one row a word."""
        return united(self.spark.read.schema("_file bigint, word bigint, bits bigint").parquet(*[f"{self.path}/{p}" for p in parts]), ["_file"])

    def _images(self, state: dict) -> DataFrame | None:
        """All images with the file and place they lie at."""
        kinds = T.StructType.fromJson(state["row"])
        schema = T.StructType([*(kinds[k] for k in self.keys), T.StructField("_o", T.LongType()), *(T.StructField(f"p{i}", kinds[c].dataType) for i, c in enumerate(self.payload)), T.StructField("_what", T.IntegerType())])
        out = None
        for batch, part in state.get("images", []):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}").where(F.col("_what") == _IMAGE)
            rows = rows.select(*self.keys, "_o", *[f"p{i}" for i in range(len(self.payload))], _file_number(batch).alias("_file"), F.col("_metadata.row_index").alias("_row"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def read(self) -> DataFrame:
        """The rows alive: key columns, order and payload of the image that set each last."""
        _, state = self.manifest.load()
        if not state["batches"]:
            raise ValueError("no batch has been applied")
        live = self._images(state) if state.get("images") else None
        kinds = T.StructType.fromJson(state["row"])
        out = [*self.keys, self.order, *self.payload]
        if live is None:
            schema = T.StructType([*(kinds[k] for k in self.keys), T.StructField(self.order, T.LongType()), *(kinds[c] for c in self.payload)])
            return self.spark.createDataFrame([], schema).select(*out)
        if state.get("vectors"):
            dv = self._vectors(state["vectors"]).withColumnRenamed("_file", "_dv")
            # a word takes about 64 bytes in a hash relation
            dv = F.broadcast(dv) if dv.count() * 64 <= BROADCAST_BYTES else dv.hint("merge")
            live = live.join(dv, (F.col("_file") == F.col("_dv")) & (word_of(F.col("_row")) == F.col("word")), "left").where(~is_set(F.col("bits"), F.col("_row")))
        order = F.when(F.col("_o") != -(2**63), F.col("_o"))
        return live.select(*self.keys, order.alias(self.order), *[F.col(f"p{i}").alias(c) for i, c in enumerate(self.payload)])


def _file_number(batch: int) -> Column:
    """The number of a file of a batch, from the task and the file count in the name Spark gave it."""
    name = F.col("_metadata.file_name")
    task, nth = F.regexp_extract(name, r"^part-(\d+)-", 1).cast("bigint"), F.regexp_extract(name, r"[-.]c(\d+)\b", 1).cast("bigint")
    return F.lit(batch).cast("bigint") * (1 << 40) + task * (1 << 12) + nth


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "_i") -> DataFrame:
    """``df`` with a whole number that rises with ``order`` over the whole table, not without gaps.

    Rows are sorted by range, so no group of them, however large, is sorted in one task.  Write the result before it is used twice.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def nth_number(ring: DataFrame, wanted: DataFrame, keys: Sequence[str], n: str, number: str = "_i") -> DataFrame:
    """``wanted`` with ``cutoff``: the number of the ``n``-th row of its ring, for a written table that ``numbered`` made
    with ``keys`` as the first part of the order.

    A ring lies in successive tasks, in each of them without gaps, so counting its rows a task is enough.  n below 1 (or null) gives -1; beyond
    the end of the ring, or where there is none, the largest bigint.
    """
    keys = list(keys)
    task = F.shiftright(number, 33)
    blocks = ring.groupBy(*keys, task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_first"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    hit = F.when((F.col("_before") < F.col(n)) & (F.col(n) <= F.col("_upto")), F.col("_first") + F.col(n) - F.col("_before") - 1)
    found = wanted.join(blocks, keys, "left").groupBy(*wanted.columns).agg(F.max(hit).alias("cutoff"))
    rest = F.when(F.col(n) >= 1, F.lit((1 << 63) - 1)).otherwise(F.lit(-1))
    return found.withColumn("cutoff", F.coalesce("cutoff", rest.cast("bigint")))
