"""Grouping tensors by k-means on their symbol statistics, and what sharing a model in a group saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import symbols
from tessera.plans.scratch import materialise

#: Tensors to a group, about, and groups at least.
PER_GROUP, LEAST_GROUPS = 40, 8


def kmeans(rows: DataFrame, features: list[str], seed: int = 0) -> DataFrame:
    """``rows`` (tensor_id, features) with grp, the smallest tensor_id of the group, or null in groups of one,
    and size. max(8, n / 40) groups, features unscaled. Groups differ from those of other k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = materialise(rows, "features")
    n = rows.count()
    if not n:
        return rows.withColumn("grp", F.lit(None).cast("string")).withColumn("size", F.lit(0).cast("long"))
    x = VectorAssembler(inputCols=features, outputCol="_v").transform(rows)
    k = max(LEAST_GROUPS, n // PER_GROUP)
    labels = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_label").fit(x).transform(x).drop("_v")
    labels = materialise(labels, "labels")
    sizes = labels.groupBy(F.col("_label").alias("_l")).agg(F.min("tensor_id").alias("_first"), F.count(F.lit(1)).alias("size"))
    j = labels.join(sizes, F.col("_label") == F.col("_l"))
    return j.withColumn("grp", F.when(F.col("size") > 1, F.col("_first"))).drop("_label", "_l", "_first")


def group_stats(summary: DataFrame, keys: list[str]) -> DataFrame:
    """n_tensors, avg_unique_ratio, avg_entropy, tensor_bytes, hist_bytes (8 a symbol) and their ratio."""
    out = summary.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tensors"), F.avg("unique_ratio").alias("avg_unique_ratio"), F.avg("entropy").alias("avg_entropy"),
        F.sum("tensor_bytes").alias("tensor_bytes"), F.sum("hist_bytes_e2").alias("hist_bytes"),
    )
    return out.withColumn("hist_ratio", F.when(F.col("tensor_bytes") > 0, F.col("hist_bytes") / F.col("tensor_bytes")).otherwise(0.0))


def sized(c: DataFrame) -> DataFrame:
    """tensors (tensor_id, cluster) with the number of tensors in the cluster."""
    t = c.select("tensor_id", "cluster").distinct()
    n = t.groupBy(F.col("cluster").alias("_c")).agg(F.count(F.lit(1)).alias("size"))
    return t.join(n, F.col("cluster").eqNullSafe(F.col("_c"))).drop("_c")


def savings(c: DataFrame) -> DataFrame:
    """One row of histogram bytes, 8 a symbol and 64 a table: baseline_bytes (a table per tensor),
    cluster_bytes (one per cluster of several, its symbols estimated by merged sketches), singleton_bytes,
    total_bytes, saved_bytes, ratio, n_clusters, n_singletons, largest_cluster (most tensors; the smallest name)."""
    size = sized(c)
    s = symbols.summary(c).join(size.select(F.col("tensor_id").alias("_t"), "size"), F.col("tensor_id") == F.col("_t"))
    est = symbols.hll_estimate(symbols.hll_registers(c, ["cluster"]), ["cluster"])
    union = F.floor(F.col("estimate") * 8).cast("long") + 64
    clusters = size.groupBy("cluster").agg(F.max("size").alias("size")).join(est.withColumnRenamed("cluster", "_e"), F.col("cluster").eqNullSafe(F.col("_e"))).filter("size > 1")
    a = clusters.agg(F.coalesce(F.sum(union), F.lit(0)).alias("cluster_bytes"), F.count(F.lit(1)).alias("n_clusters"), F.min(F.struct(-F.col("size"), F.col("cluster").alias("c"))).getField("c").alias("largest_cluster"))
    single = F.when(F.col("size") == 1, F.col("hist_bytes_e2")).otherwise(0)
    b = s.agg(F.sum("hist_bytes_e2").alias("baseline_bytes"), F.sum(single).alias("singleton_bytes"), F.sum((F.col("size") == 1).cast("long")).alias("n_singletons"))
    out = a.crossJoin(b).withColumn("total_bytes", F.col("cluster_bytes") + F.col("singleton_bytes"))  # one row each
    return out.withColumn("saved_bytes", F.col("baseline_bytes") - F.col("total_bytes")).withColumn("ratio", F.col("total_bytes") / F.col("baseline_bytes"))


def cross_entropy(c: DataFrame) -> DataFrame:
    """One row: bytes of streams and models (8 a symbol) with a model per tensor and with one per cluster of
    several tensors, model_savings, stream_penalty and net_gain of sharing."""
    size = sized(c)
    own = c.withColumn("cluster", F.col("tensor_id"))
    per_tensor = symbols.xe_cost(own, symbols.xe_model(symbols.merge(own))).agg(F.sum("stream_bytes").alias("own_stream_bytes"))
    models = own.agg((F.count(F.lit(1)) * 8).alias("own_model_bytes"), (F.sum("cnt") * 4).alias("raw_bytes"))
    # a singleton's cluster is itself
    named = size.select(F.col("tensor_id").alias("_t"), F.when(F.col("size") > 1, F.concat(F.lit("cluster "), "cluster")).otherwise(F.concat(F.lit("tensor "), "tensor_id")).alias("_c"))
    shared = c.join(named, F.col("tensor_id") == F.col("_t")).select("tensor_id", F.col("_c").alias("cluster"), "sym", "cnt")
    merged = materialise(symbols.merge(shared), "merged")
    streams = symbols.xe_cost(shared, symbols.xe_model(merged)).agg(F.sum("stream_bytes").alias("shared_stream_bytes"))
    out = per_tensor.crossJoin(models).crossJoin(streams).crossJoin(merged.agg((F.count(F.lit(1)) * 8).alias("shared_model_bytes")))  # one row each
    out = out.withColumn("model_savings", F.col("own_model_bytes") - F.col("shared_model_bytes")).withColumn("stream_penalty", F.col("shared_stream_bytes") - F.col("own_stream_bytes"))
    return out.withColumn("net_gain", F.col("model_savings") - F.col("stream_penalty"))
