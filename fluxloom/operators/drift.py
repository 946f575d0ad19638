"""Fields that come, go, are renamed or change type between the files of a stream.

Successive versions of a stream are compared.  Where names go and others come,
each column on both sides gets one profile: how many values it has in the
records that both versions hold, and a sketch, the counts of its values in 64
hash classes.  Two columns cannot agree in more records than their sketches have
in common, class by class; where that is no more than half, the pair is settled
without a loss.  Only the pairs that are left are compared value by value; one with
more than half of the values the same may be one field.  A maximum-weight
bipartite matching over agreement, sketch, type and name picks the renames.
Renames tie the names of a field into one lineage, along which types are
followed and files unified.

Only versions that lose and gain fields are read for values.  Windows run over
metadata (one row a file, or a file and field); records meet their counterpart
on (version, record), so a file with a third of all rows is spread like any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.operators.skew import join_hot
from fluxloom.storage import materialize

STREAM = ["source_id", "stream_name"]
#: Stands for a null name inside, so that streams join by equality; no name holds it.
_NULL = "\0"


@dataclass
class Versions:
    """``files``: one row per version (stream, file_no, file_id, prev_no, prev_id, cols, gone, came);
    ``fields``: one row per version and field with its lineage (root, root_no) ; ``renames``: matched pairs."""

    files: DataFrame
    fields: DataFrame
    renames: DataFrame


def type_text(kind: Column) -> Column:
    """A type without letter case and blanks; null and empty are unknown."""
    text = F.regexp_replace(F.lower(kind), r"\s+", "")
    return F.when(text != "", text)


def record_of(payload: Column) -> Column:
    """A record as map name -> text; a value written as null is null, a record that is no object is null.

    Numbers are texts of what they denote (5.0 is 5), exact up to 38 digits.  Of a name that stands twice the last counts.
    """
    kind = "map<string,string>"
    return F.coalesce(F.try_variant_get(F.try_parse_json(payload), "$", kind), F.from_json(payload, kind))


def versions_of(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per (stream, file_no) with its columns.  Of a file that arrived more than once the first arrival with a
    field list counts.  A file without a list has the names its rows carry, of unknown type."""
    first = files.groupBy(*STREAM, "file_no").agg(F.min_by(F.struct("file_id", "field_list"), F.struct(F.col("field_list").isNull(), F.col("file_id"))).alias("f")).select(*STREAM, "file_no", "f.*")
    first = materialize(first, "versions")
    listed = first.where("field_list is not null").select("file_id", F.explode("field_list").alias("c")).select("file_id", F.col("c.name").alias("name"), type_text(F.col("c.data_type")).alias("type"))
    bare = first.where("field_list is null").select("file_id")
    carried = (
        join_hot(rows.select("file_id", "line_no", "payload"), bare, ["file_id"], F.col("line_no"))
        .select("file_id", F.explode(F.map_keys(record_of(F.col("payload")))).alias("name")).distinct().withColumn("type", F.lit(None).cast("string"))
    )
    cols = listed.unionByName(carried).where("name is not null").groupBy("file_id", "name").agg(F.min("type").alias("type"))
    cols = cols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("cols"))
    none = F.array().cast("array<struct<name:string,type:string>>")
    joined = first.drop("field_list").join(cols, "file_id", "left").withColumn("cols", F.coalesce("cols", none))
    order = Window.partitionBy(*STREAM).orderBy("file_no")
    back = joined.withColumn("prev_no", F.lag("file_no").over(order)).withColumn("prev_id", F.lag("file_id").over(order)).withColumn("prev_cols", F.lag("cols").over(order))
    names, before = F.col("cols.name"), F.coalesce(F.col("prev_cols.name"), F.array().cast("array<string>"))
    return back.withColumn("gone", F.array_except(before, names)).withColumn("came", F.array_except(names, before))


#: Hash classes of a value sketch.
_CLASSES = 64


def met_records(rows: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """(pair, ov, nv): the values of the gone and of the come fields in every record that both versions of a pair hold.

    Every payload is parsed once, whatever pairs its file is in; of lines with the same key the last counts.
    """
    side = lambda file, names, new: pairs.select(F.col(file).alias("file_id"), F.struct(F.col("file_id").alias("pair"), F.lit(new).alias("new"), F.col(names).alias("names")).alias("w"))
    wants = side("prev_id", "gone", False).unionByName(side("file_id", "came", True)).groupBy("file_id").agg(F.collect_list("w").alias("wants"))  # at most two a file
    hit = join_hot(rows.select("file_id", "line_no", "payload"), materialize(wants, "wants"), ["file_id"], F.col("line_no")).withColumn("r", record_of(F.col("payload")))
    each = hit.select(F.col("r")[key].alias("rec"), "line_no", "r", F.explode("wants").alias("w")).where("rec is not null")
    each = each.select("w.pair", "w.new", "rec", "line_no", F.transform("w.names", lambda n: F.col("r")[n]).alias("v"))
    last = lambda new: F.max_by("v", F.when(F.col("new") == new, F.col("line_no")))
    return each.groupBy("pair", "rec").agg(last(False).alias("ov"), last(True).alias("nv")).where("ov is not null and nv is not null").select("pair", "ov", "nv")


def profiles(met: DataFrame) -> DataFrame:
    """(pair, new, i, n, sketch): of every column of the pairs, its non-null values and their counts by hash class."""
    cells = lambda values, new: met.select("pair", F.lit(new).alias("new"), F.posexplode(values).alias("i", "x")).where("x is not null")
    both = cells("ov", False).unionByName(cells("nv", True))
    counts = both.groupBy("pair", "new", "i", F.pmod(F.xxhash64("x"), F.lit(_CLASSES)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("pair", "new", "i").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("sketch"))


def candidates(profiles: DataFrame) -> DataFrame:
    """(pair, i, j, overlap): the pairs of columns that may agree in more than half of their records; ``overlap`` is the most
    they can agree in, as a share.  All others are proven not to: no more values agree than both sketches hold of a class,
    and no fewer records count than the fuller column has values.  Combinations are bounded by the columns of a version."""
    old, new = (profiles.where(F.col("new") == side).select("pair", F.col("i").alias(at), F.col("n").alias(f"n{at}"), F.col("sketch").alias(f"s{at}")) for side, at in ((False, "i"), (True, "j")))
    common = F.aggregate(F.map_entries("si"), F.lit(0).cast("bigint"), lambda a, e: a + F.least(e["value"], F.coalesce(F.col("sj")[e["key"]], F.lit(0).cast("bigint"))))
    both = old.join(new, "pair").withColumn("overlap", common / F.greatest("ni", "nj"))
    return both.where("overlap > 0.5").select("pair", "i", "j", "overlap")


def agreements(met: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair, i, j, n, same): of the records where not both values are null, how many agree, for the wanted pairs of columns."""
    lists = wanted.groupBy("pair").agg(F.collect_list(F.struct("i", "j")).alias("w"))  # at most the columns of a version, squared
    each = join_hot(met, materialize(lists, "wanted"), ["pair"], F.col("nv")).select("pair", F.explode("w").alias("w"), "ov", "nv")
    each = each.select("pair", "w.i", "w.j", F.get("ov", F.col("w.i")).alias("o"), F.get("nv", F.col("w.j")).alias("v")).where("o is not null or v is not null")
    return each.groupBy("pair", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o") == F.col("v")).alias("same"))


def best_matching(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum-weight matching of a bipartite graph with positive weights: shortest augmenting paths over potentials."""
    left, right = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    if len(left) == len(weights) == len(right):
        return sorted(weights)
    n, m = len(left), len(right) + len(left)  # a dummy of weight 0 for every left node
    cost = lambda i, j: -weights.get((left[i], right[j]), 0.0) if j < len(right) else 0.0
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for i in range(n):
        dist, back, done, at, col = [math.inf] * m, [-1] * m, [False] * m, i, -1
        while True:
            step, nxt = math.inf, -1
            for j in range(m):
                if not done[j]:
                    d = cost(at, j) - u[at] - v[j] + (0 if col < 0 else dist[col])
                    if d < dist[j] - 1e-12:
                        dist[j], back[j] = d, col
                    if dist[j] < step:
                        step, nxt = dist[j], j
            done[nxt], col = True, nxt
            if owner[nxt] < 0:
                break
            at = owner[nxt]
        u[i] += step
        for j in range(m):
            if done[j] and j != col:
                u[owner[j]] += step - dist[j]
                v[j] -= step - dist[j]
        while col >= 0:
            prev = back[col]
            owner[col] = owner[prev] if prev >= 0 else i
            col = prev
    return sorted((left[owner[j]], right[j]) for j in range(len(right)) if owner[j] >= 0 and (left[owner[j]], right[j]) in weights)


def _match(edges: pd.DataFrame) -> pd.DataFrame:
    weights = {(r.old, r.new): -math.log2(1.02 - r.same / r.n) + 0.01 * r.overlap + 0.005 * r.same_type + 0.005 * r.likeness for r in edges.itertuples()}
    got = best_matching(weights)
    return pd.DataFrame({"pair": edges["pair"].iloc[0], "old": [a for a, _ in got], "new": [b for _, b in got]})


def renames_of(files: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """(pair, old, new) for the renamed fields of every version; a version's edges are at most its columns squared."""
    pairs = materialize(files.where((F.size("gone") > 0) & (F.size("came") > 0)).select("file_id", "prev_id", "gone", "came", "cols", "prev_cols"), "pairs")
    met = materialize(met_records(rows, pairs, key), "met")
    wanted = materialize(candidates(profiles(met)), "candidates")
    likely = agreements(met, wanted).where(F.col("same") * 2 > F.col("n")).join(wanted, ["pair", "i", "j"])
    kinds = pairs.select(F.col("file_id").alias("pair"), "gone", "came", F.map_from_entries("cols").alias("k"), F.map_from_entries("prev_cols").alias("pk"))
    edges = likely.join(kinds, "pair").withColumn("old", F.get("gone", F.col("i"))).withColumn("new", F.get("came", F.col("j"))).select(
        "pair", "old", "new", "n", "same", "overlap", F.coalesce(F.col("k")[F.col("new")] == F.col("pk")[F.col("old")], F.lit(False)).cast("int").alias("same_type"),
        (1 - F.levenshtein(F.lower("old"), F.lower("new")) / F.greatest(F.length("old"), F.length("new"), F.lit(1))).alias("likeness"),
    )
    edges = materialize(edges, "edges")
    # a pair of names that has no rival is its own matching; only the others are weighed against each other
    degree = lambda side: F.count(F.lit(1)).over(Window.partitionBy("pair", side))
    edges = edges.withColumn("_alone", (degree("old") == 1) & (degree("new") == 1))
    contested = edges.where(~F.col("_alone")).drop("_alone").groupBy("pair").applyInPandas(_match, "pair bigint, old string, new string")
    return edges.where("_alone").select("pair", "old", "new").unionByName(contested)


def _roots(links: DataFrame) -> DataFrame:
    """(stream, name, since, root, root_no) of every renamed field: the name it began with.  Links are followed by doubling,
    so a field that was renamed n times takes about log n rounds, and no stream is gathered in one task."""
    at = links.select(*STREAM, F.col("new").alias("name"), F.col("file_no").alias("since"), F.col("old").alias("root"), F.col("old_no").alias("root_no"))
    while True:
        on = at.select(*STREAM, F.col("name").alias("root"), F.col("since").alias("root_no"), F.col("root").alias("far"), F.col("root_no").alias("far_no"))
        far = at.join(on, [*STREAM, "root", "root_no"], "left").select(*STREAM, "name", "since", F.coalesce("far", "root").alias("root"), F.coalesce("far_no", "root_no").alias("root_no"), F.col("far").isNotNull().alias("moved"))
        far = materialize(far, "roots")
        if far.where("moved").isEmpty():
            return far.drop("moved")
        at = far.drop("moved")


def track(files: DataFrame, rows: DataFrame, key: str = "id") -> Versions:
    """Versions, fields with their lineage, and renames of every stream.

    ``files``: file_id, source_id, stream_name, file_no, field_list; ``rows``: file_id, line_no, payload.  Null stream
    names form a stream of their own; no files give no versions.
    """
    files = files.select("file_id", *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)).alias(c) for c in STREAM], "file_no", "field_list")
    versions = materialize(versions_of(files, rows), "versions-cols")
    renames = materialize(
        renames_of(versions, rows, key).join(versions.select(F.col("file_id").alias("pair"), *STREAM, "file_no", "prev_no"), "pair").drop("pair"), "renames"
    )
    fields = versions.select(*STREAM, "file_no", "file_id", "came", F.explode("cols").alias("c")).select(*STREAM, "file_no", "file_id", "c.*", F.array_contains("came", F.col("c.name")).alias("starts"))
    since = F.max(F.when(F.col("starts"), F.col("file_no"))).over(Window.partitionBy(*STREAM, "name").orderBy("file_no").rowsBetween(Window.unboundedPreceding, 0))
    fields = fields.withColumn("since", since).drop("starts")
    old = fields.select(*STREAM, F.col("file_no").alias("prev_no"), F.col("name").alias("old"), F.col("since").alias("old_no"))
    links = renames.join(old, [*STREAM, "prev_no", "old"]).select(*STREAM, "file_no", "old", "old_no", "new")
    links = materialize(links, "links")
    roots = _roots(links)
    traced = fields.join(roots, [*STREAM, "name", "since"], "left").withColumn("root", F.coalesce("root", "name")).withColumn("root_no", F.coalesce("root_no", "since"))
    return Versions(versions, materialize(traced, "fields"), renames)


def changes(v: Versions) -> DataFrame:
    """(source_id, stream_name, file_no, change_kind, field_name, prev_name) of every version against the one before it."""
    at = [*STREAM, "file_no"]
    later = v.files.where("prev_no is not null")
    renamed = v.renames.select(*at, F.lit("renamed").alias("change_kind"), F.col("new").alias("field_name"), F.col("old").alias("prev_name"))

    def plain(names: str, kind: str, matched: str) -> DataFrame:
        one = later.select(*at, F.explode(names).alias("field_name"))
        return one.join(v.renames.select(*at, F.col(matched).alias("field_name")), [*at, "field_name"], "left_anti").select(*at, F.lit(kind).alias("change_kind"), "field_name", F.col("field_name").alias("prev_name"))

    known = F.last("type", ignorenulls=True).over(Window.partitionBy(*STREAM, "root", "root_no").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    retyped = v.fields.withColumn("known", known).where("type <> known").select(*at, F.lit("retyped").alias("change_kind"), F.col("name").alias("field_name"), F.col("name").alias("prev_name"))
    return _named(renamed.unionByName(plain("gone", "removed", "old")).unionByName(plain("came", "added", "new")).unionByName(retyped))


def _named(df: DataFrame) -> DataFrame:
    """Streams under their own names again."""
    return df.select(*[F.nullif(F.col(c), F.lit(_NULL)).alias(c) if c in STREAM else c for c in df.columns])


#: What the head of a spelled type stands for; anything else is text.
_KINDS = {
    "boolean": ("bool", "boolean"), "int": ("int", "integer", "tinyint", "smallint", "mediumint", "short"), "bigint": ("bigint", "long"), "decimal(38,12)": ("decimal", "numeric", "number"),
    "double": ("float", "double", "real"), "date": ("date",), "timestamp": ("datetime", "timestamp"),
}
#: Sets of types that meet in their last one without a loss.
_WIDER = [["int", "bigint", "decimal(38,12)"], ["int", "double"], ["date", "timestamp"]]


def base_type(kind: Column) -> Column:
    """The Spark type a spelled type stands for, null where it is unknown."""
    head, out = F.regexp_extract(kind, r"^[a-z]*", 0), F.when(kind.isNull(), F.lit(None).cast("string"))
    for t, heads in _KINDS.items():
        out = out.when(head.isin(*heads), t)
    return out.otherwise("string")


def widest(kinds: Column) -> Column:
    """The narrowest type that holds all types of a set: the greatest of numbers or of times, else text; text too for none."""
    out = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
    for family in _WIDER:
        inside = F.size(F.array_except(kinds, F.array(*[F.lit(t) for t in family]))) == 0
        top = F.lit(None).cast("string")
        for t in family:
            top = F.when(F.array_contains(kinds, t), t).otherwise(top)
        out = out.when((F.size(kinds) > 1) & inside, top)
    return F.coalesce(out, F.lit("string"))


def columns(v: Versions) -> DataFrame:
    """(source_id, stream_name, root, root_no, column): the column every field belongs to in the one table of its stream.

    A column has the latest name of its lineage.  Lineages that would share a name and exist at the same time stay apart:
    all but the last get ``@`` and their first file_no.  Lineages that take turns under one name share its column.
    """
    line = [*STREAM, "root", "root_no"]
    ends = v.fields.groupBy(*line).agg(F.max_by("name", "file_no").alias("column"), F.min("file_no").alias("lo"), F.max("file_no").alias("hi"))
    nxt = F.min("lo").over(Window.partitionBy(*STREAM, "column").orderBy("hi", "lo", "root").rowsBetween(1, Window.unboundedFollowing))
    apart = F.concat("column", F.lit("@"), F.col("root_no").cast("string"))
    ends = ends.withColumn("column", F.when(nxt <= F.col("hi"), apart).otherwise(F.col("column")))
    # a field may really be called like one that was set apart: then all but one say their first name too
    nth = F.row_number().over(Window.partitionBy(*STREAM, "column", "lo").orderBy("root", "root_no"))
    return ends.select(*line, F.when(nth > 1, F.concat("column", F.lit("@"), "root")).otherwise(F.col("column")).alias("column"))


def column_types(v: Versions, cols: DataFrame) -> DataFrame:
    """(source_id, stream_name, column, type): every column with the type that holds all known types of its fields."""
    kinds = v.fields.join(cols, [*STREAM, "root", "root_no"]).groupBy(*STREAM, "column").agg(F.collect_set(base_type(F.col("type"))).alias("k"))
    return kinds.select(*STREAM, "column", widest(F.col("k")).alias("type"))


def table_columns(v: Versions) -> DataFrame:
    """(source_id, stream_name, column, type): the columns of the one table of every stream."""
    return _named(column_types(v, columns(v)))


def unified(v: Versions, rows: DataFrame) -> DataFrame:
    """(source_id, stream_name, file_no, line_no, column, type, value): every record of every version under the columns of its
    stream, all of them, with null where the record has no value; a cell has the text of its value and the column's type.

    Names that a record carries beside its file's fields are no columns.  A payload that is no object has null everywhere.
    """
    wide = _wide(v, rows)
    cell = F.explode(F.transform("all", lambda c: F.struct(c["column"].alias("column"), c["type"].alias("type"), F.col("r")[F.col("names")[c["column"]]].alias("value"))))
    return _named(wide.select(*STREAM, "file_no", "line_no", cell.alias("c")).select(*STREAM, "file_no", "line_no", "c.*"))


def _wide(v: Versions, rows: DataFrame) -> DataFrame:
    """Every record with the columns of its stream (``all``) and the names its file has for them (``names``)."""
    cols = materialize(columns(v), "columns")
    every = column_types(v, cols).groupBy(*STREAM).agg(F.array_sort(F.collect_list(F.struct("column", "type"))).alias("all"))
    place = v.fields.join(cols, [*STREAM, "root", "root_no"]).groupBy("file_id", "column").agg(F.min("name").alias("name"))
    held = place.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "name"))).alias("names"))
    at = materialize(v.files.select("file_id", *STREAM, "file_no").join(held, "file_id", "left").join(every, STREAM), "places")
    return join_hot(rows.select("file_id", "line_no", "payload"), at, ["file_id"], F.col("line_no")).withColumn("r", record_of(F.col("payload")))


def stream_table(v: Versions, rows: DataFrame, source: str | None, stream: str | None) -> DataFrame:
    """The one consistent table of a stream: file_no, line_no and its columns, each of its type; a value the type cannot hold is null."""
    mine = lambda df: df.where(F.col("source_id").eqNullSafe(F.lit(source)) & F.col("stream_name").eqNullSafe(F.lit(stream)))
    kinds = sorted(tuple(r) for r in mine(table_columns(v)).select("column", "type").collect())  # a stream's columns
    wide = mine(_named(_wide(v, rows)))
    return wide.select("file_no", "line_no", *[F.col("r")[F.col("names")[c]].try_cast(t).alias(c) for c, t in kinds])
