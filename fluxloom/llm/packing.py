"""Filling fixed-capacity containers with texts: best-fit decreasing.

Best fit decreasing looks only at lengths, and there are no more lengths than the
capacity has tokens.  So the histogram of lengths, at most ``capacity + 1``
numbers whatever the corpus, is all the driver needs to run the algorithm exactly:
a segment tree over the remaining capacities finds the tightest open container
for a length in logarithmic time, and all texts of one length are placed in bulk,
as runs of containers that stand at the same remaining capacity.  The outcome is
a list of runs (length, ranks, containers).  Executors number the texts within
their length and look their run up; no text ever leaves them.

Only a text above the capacity is split: into full containers and one remainder,
which is packed like any other text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.llm.tokens import with_token_counts
from fluxloom.storage import materialize


class OpenBins:
    """Runs of open containers by remaining capacity, in a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.open = [0] * (2 * self.size)  # how many leaves below a node hold a run
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def _mark(self, r: int, d: int) -> None:
        i = r + self.size
        while i:
            self.open[i] += d
            i >>= 1

    def put(self, r: int, run: tuple[int, int, int]) -> None:
        if not self.runs[r]:
            self._mark(r, 1)
        self.runs[r].append(run)

    def take(self, r: int) -> tuple[int, int, int]:
        run = self.runs[r].popleft()
        if not self.runs[r]:
            self._mark(r, -1)
        return run

    def tightest(self, w: int) -> int | None:
        """The smallest remaining capacity of at least ``w`` at which a container is open."""
        if w >= len(self.runs):
            return None
        i = w + self.size
        if self.open[i]:
            return w
        while i > 1:
            if not i & 1 and self.open[i + 1]:  # the right sibling holds only larger ones
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Texts of one length with ranks from ``rank`` on: ``each`` a container, from container ``bin``, after ``filled`` others."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    filled: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int, separator: int) -> tuple[list[Run], int]:
    """Placement of ``histogram`` (length -> texts) and the number of containers.

    With ``separator`` tokens between two texts a container holds lengths l with sum(l + separator) <= capacity + separator.
    """
    room = capacity + separator
    bins, out, opened = OpenBins(room), [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 <= length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        w, left, rank = length + separator, histogram[length], 0
        while left:
            r = bins.tightest(w)
            if r is None:
                r, first, n, filled = room, opened, -(-left // (room // w if w else left)), 0
                opened += n
            else:
                first, n, filled = bins.take(r)
            each = r // w if w else left
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
            if full:
                out.append(Run(length, rank, full * each, first, each, filled))
                bins.put(r - each * w, (first, full, filled + each))
            if rest:
                out.append(Run(length, rank + full * each, rest, first + full, rest, filled))
                bins.put(r - rest * w, (first + full, 1, filled + rest))
            if untouched := n - full - (rest > 0):
                bins.put(r, (first + n - untouched, untouched, filled))
            left -= full * each + rest
            rank += full * each + rest
    return out, opened


#: Texts of one length that are numbered in one task.
_PER_TASK = 500_000


def pack(texts: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per text, or piece of a split text, and target.

    Columns: ``target_name``, ``container`` (name, unique in its target), ``place`` (order in it), ``key``, ``piece``,
    ``token_from``, ``token_to``.  Null texts have no row, empty ones take a separator only; rows with the same or no
    key are packed one by one.  ``targets`` (target_name, capacity_tokens, separator_tokens) is a short list of sizes.
    """
    sizes = [(r[0], r[1], r[2] or 0) for r in targets.select("target_name", "capacity_tokens", "separator_tokens").where("capacity_tokens > 0").distinct().collect()]
    counted = with_token_counts(texts, key, text, tokenizer)
    counted = materialize(counted.withColumn("_row", F.monotonically_increasing_id()), "token-counts")
    spark = texts.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"target_name string, container string, place bigint, `{key}` {dict(counted.dtypes)[key]}, piece int, token_from int, token_to int")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("target_name"), F.lit(c).cast("int").alias("cap")) for n, c, _ in sizes]))
    per = counted.select(key, "_row", "n_tokens", each.alias("t")).select(key, "_row", "n_tokens", "t.*").withColumn("_full", F.when(F.col("n_tokens") > F.col("cap"), F.call_function("div", F.col("n_tokens"), F.col("cap"))).otherwise(0).cast("int"))
    whole = per.where("_full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_full") - 1))).select(
        "target_name", F.format_string("whole-%d-%d", "_row", "piece").alias("container"), F.lit(0).cast("bigint").alias("place"), key, "piece",
        (F.col("piece") * F.col("cap")).alias("token_from"), ((F.col("piece") + 1) * F.col("cap")).alias("token_to"),
    )
    rest = per.withColumn("_len", F.col("n_tokens") - F.col("_full") * F.col("cap")).where("_full = 0 or _len > 0")

    histograms: dict[str, dict[int, int]] = {n: {} for n, _, _ in sizes}
    for r in rest.groupBy("target_name", "_len").count().collect():  # at most the capacities' sum of rows
        histograms[r[0]][r[1]] = r[2]
    plans, most = {}, max((c for h in histograms.values() for c in h.values()), default=0)
    for name, capacity, separator in sizes:
        runs, _ = best_fit_decreasing(histograms[name], capacity, separator)
        runs.sort(key=lambda x: (x.length, x.rank))
        plans[name] = np.array([(x.length, x.rank, x.bin, x.each, x.filled) for x in runs], dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plans)  # its size depends on the capacities alone

    salts = max(1, -(-most // _PER_TASK))
    group = ["target_name", "_len", "_salt"]
    rest = rest.withColumn("_salt", F.pmod(F.hash("_row"), F.lit(salts)))
    before = Window.partitionBy("target_name", "_len").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rest.groupBy(*group).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_row")) - 1
    ranked = rest.withColumn("_in", inside).join(offsets, group).withColumn("_rank", F.col("_in") + F.col("_before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = {n: p[:, 0] * (1 << 40) + p[:, 1] for n, p in shared.value.items()}
        for batch in batches:
            for name, b in batch.groupby("target_name", sort=False):
                p = shared.value[name][np.searchsorted(keys[name], b["_len"].to_numpy(np.int64) * (1 << 40) + b["_rank"].to_numpy(np.int64), side="right") - 1]
                k = b["_rank"].to_numpy(np.int64) - p[:, 1]
                yield pd.DataFrame({"target_name": name, "container": p[:, 2] + k // p[:, 3], "place": p[:, 4] + k % p[:, 3], key: b[key], "piece": b["_full"], "token_from": b["_full"] * b["cap"], "token_to": b["n_tokens"]})

    kind = dict(counted.dtypes)[key]
    packed = ranked.select("target_name", "_len", "_rank", key, "_full", "cap", "n_tokens").mapInPandas(place, f"target_name string, container bigint, place bigint, `{key}` {kind}, piece int, token_from int, token_to int")
    return packed.withColumn("container", F.format_string("packed-%d", "container")).unionByName(whole)
