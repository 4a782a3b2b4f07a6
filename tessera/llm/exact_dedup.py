"""Exact deduplication by content sort. Native: DataFrame functions only.

The rows are range-partitioned on the leading bytes of the normalised text (Spark samples the
splitters), each partition is sorted externally, and equal texts, now adjacent, are compared in
full. A text that holds more than its share of all rows is found first by a map-side-combined
count and gets a salt as the last part of the range key; its few runs are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialise, partitions, read

#: Characters of the text in the range key; the digest orders what shares them.
PREFIX = 32
#: Runs a hot text is cut into for each partition's worth of rows it has.
SALTS_PER_SHARE = 4


def identity(text: Column) -> Column:
    return text


def collapse(text: Column) -> Column:
    """Lower case, white-space runs to one space, ends trimmed: a common looser notion of equality."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_sort(docs: DataFrame, normalise: Callable[[Column], Column] = identity, keep: str = "min") -> DataFrame:
    """Groups of equal normalised texts.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    ``keep``: "min" or "max", which doc_id of a group stays. Null texts count as empty and empty
    texts are equal to each other. A doc_id that occurs in several rows of a group keeps one of
    them (the others get kept = false); null ids lose to any id, and stay only in groups without
    one. Empty input gives an empty result; columns other than doc_id and text are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark, n_parts = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), normalise(F.coalesce(F.col("text"), F.lit(""))).alias("t"))

    # Texts with over 1/(4 n_parts) of all rows: at most 4 n_parts of them, whatever the input.
    counts = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.filter("n > 1"), "copies")
    total = docs.count()
    share = max(1, total // (4 * n_parts))
    hot = counts.filter(F.col("n") > share).withColumn("salts", F.ceil(F.col("n") * SALTS_PER_SHARE / (4 * share)).cast("int") + 1)

    # Copies of one text come in any order, so an id's hash decides on the run.
    rows = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(hot.select("h", "salts")), "h", "left").drop("h")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("salts")), F.lit(-1)).cast("int"))
    rows = rows.withColumn("sha", F.sha2("t", 256)).withColumn("prefix", F.substring("t", 1, PREFIX))
    ranged = rows.select("doc_id", "t", "sha", "prefix", "salt").repartitionByRange(n_parts, "prefix", "sha", "salt")

    # The window's keys hold the range key, so no second exchange follows; its sort compares whole texts.
    best = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    run = W.partitionBy("prefix", "sha", "salt", "t")
    lines = ranged.withColumn("rn", F.row_number().over(run.orderBy(best)))
    lines = lines.withColumn("head", F.first("doc_id").over(run.orderBy(best).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    lines = lines.withColumn("size", F.count(F.lit(1)).over(run))
    light = materialise(
        lines.select("doc_id", "sha", "salt", "rn", "head", "size", F.when((F.col("salt") >= 0) & (F.col("rn") == 1), F.col("t")).alias("t")),
        "runs",
    )

    # Only hot texts have several runs: one row per run, merged on the full text.
    heads = light.filter((F.col("salt") >= 0) & (F.col("rn") == 1))
    pick = F.max if keep == "max" else F.min
    order = F.struct(F.col("head").isNotNull() if keep == "max" else F.col("head").isNull(), "head", "salt")
    merged = heads.groupBy("sha", "t").agg(pick(order).alias("b"), F.sum("size").alias("g_size"))
    merged = merged.select(F.col("sha").alias("g_sha"), F.col("b.head").alias("g_head"), F.col("b.salt").alias("g_salt"), "g_size")
    out = light.drop("t").join(F.broadcast(merged), (F.col("salt") >= 0) & (F.col("sha") == F.col("g_sha")), "left")
    in_run = F.col("rn") == 1
    return out.select(
        "doc_id",
        F.when(F.col("g_sha").isNull(), F.col("head")).otherwise(F.col("g_head")).alias("keep_id"),
        F.coalesce("g_size", "size").cast("long").alias("group_size"),
        (in_run & (F.col("g_sha").isNull() | (F.col("salt") == F.col("g_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, normalise: Callable[[Column], Column] = identity, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of repeated rows with one doc_id one stays."""
    own, keep_id, sha, twice_id = (fresh(docs, f"_exact_{x}") for x in ("own", "id", "sha", "twice"))
    kept = content_sort(docs, normalise, keep).filter("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(sha))
    marked = docs.withColumn(own, F.sha2(normalise(F.coalesce(F.col("text"), F.lit(""))), 256))
    out = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(sha)), "left_semi")
    # Rows that share doc_id and text would all pass: number them only where that happens.
    twice = materialise(out.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice_id)), "twice")
    if twice.isEmpty():
        return out.drop(own)
    same = F.col("doc_id").eqNullSafe(F.col(twice_id))
    several = out.join(twice, same, "left_semi").dropDuplicates(["doc_id", own])
    return out.join(twice, same, "left_anti").unionByName(several).drop(own)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return content_sort(read(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
