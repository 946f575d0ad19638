"""Queries over the text corpus (problems 6 to 8).  SQL cannot say their results; of the packing it can say what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import leakage, packing, subjects
from fluxloom.storage import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document, or piece of one, goes in the containers of each target."""
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "pack_target"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused space of each target."""
    targets = read(spark, sf_dir, "pack_target")
    rows = p6_packed(spark, sf_dir).groupBy("target_name", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"), F.count(F.lit(1)).alias("texts"))
    each = rows.join(targets, "target_name").select("target_name", "capacity_tokens", (F.col("used") + (F.col("texts") - 1) * F.col("separator_tokens")).alias("taken"), "used")
    return each.groupBy("target_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("taken").alias("fullest"),
        F.round(F.sum("taken") / F.sum("capacity_tokens"), 6).alias("filled"),
    )


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing of each target: every text is there once and whole, none is split that fits, no container
    is over its capacity or has a gap in its places, and there are not many more containers than the tokens alone would need."""
    targets = read(spark, sf_dir, "pack_target")
    rows = materialize(p6_packed(spark, sf_dir), "packed")
    texts = rows.groupBy("target_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("token_to") - F.col("token_from")).alias("sum"), F.max("token_to").alias("size"), F.min("token_from").alias("from"))
    each = texts.join(targets, "target_name").groupBy("target_name").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("sum") != F.col("size")) | (F.col("from") != 0)).alias("torn"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("split_needlessly")
    )
    bins = rows.groupBy("target_name", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used"), F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))
    taken = F.col("used") + (F.col("n") - 1) * F.col("separator_tokens")
    full = bins.join(targets, "target_name").groupBy("target_name").agg(
        F.count_if(taken > F.col("capacity_tokens")).alias("overfull"), F.count_if((F.col("last") != F.col("n") - 1) | (F.col("places") != F.col("n"))).alias("misplaced"),
        (F.count(F.lit(1)) <= F.ceil(1.02 * F.sum(taken) / F.max("capacity_tokens")) + 1).alias("near_bound"),
    )
    return each.join(full, "target_name")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "eval_item").select("item_id", "text", "answer"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a passage of an evaluation item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked: documents that carry them, verbatim ones, and ones with the answer beside."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("agreement") == 1).alias("verbatim"), F.count_if("answer_near").alias("with_answer")
    )


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "subject_label").select("doc_id", "subject"), read(spark, sf_dir, "subject_area"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus: documents of each subject, and the documents' worth of text it makes up."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("share"), 3).alias("weight"))


def queries() -> dict:
    return {"p6_packed": p6_packed, "p6_fill": p6_fill, "p6_whole": p6_whole, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_mix": p8_mix}


def oracle_sql() -> dict:
    whole = "SELECT target_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, 0 AS torn, 0 AS split_needlessly, 0 AS overfull, 0 AS misplaced, true AS near_bound FROM pack_target"
    return {"p6_whole": whole}
