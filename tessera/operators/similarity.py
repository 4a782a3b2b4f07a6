"""Pairwise similarity, two-sample Kolmogorov-Smirnov, and fingerprint clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.bits import safe_div, similarity
from tessera.plans.running import running_total
from tessera.plans.scratch import materialise

FIELDS = ("mean", "stddev", "skewness", "excess_kurtosis", "median", "iqr")
DIMS = ("mean", "variance", "skewness", "kurtosis", "range")


def pairs(tensors: DataFrame) -> DataFrame:
    """Layer pairs i < j within (state_type, category)."""
    a = tensors.select("state_type", "category", F.col("layer").alias("l1"), F.col("tensor_id").alias("t1"))
    b = tensors.select("state_type", "category", F.col("layer").alias("l2"), F.col("tensor_id").alias("t2"))
    return a.join(b, ["state_type", "category"]).filter("l1 < l2")


def ks(t: DataFrame, pair: DataFrame) -> DataFrame:
    """t1, t2, ks: the greatest distance of two empirical distributions, ties counted right."""
    c = t.groupBy("tensor_id", "value").agg(F.count(F.lit(1)).alias("c"))
    one = pair.join(c, F.col("t1") == F.col("tensor_id")).select("t1", "t2", "value", F.col("c").alias("c1"), F.lit(0).cast("long").alias("c2"))
    two = pair.join(c, F.col("t2") == F.col("tensor_id")).select("t1", "t2", "value", F.lit(0).cast("long").alias("c1"), F.col("c").alias("c2"))
    v = one.unionByName(two).groupBy("t1", "t2", "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    n = c.groupBy(F.col("tensor_id").alias("_t")).agg(F.sum("c").alias("n"))
    v = v.join(n.withColumnsRenamed({"_t": "_t1", "n": "n1"}), F.col("t1") == F.col("_t1")).join(n.withColumnsRenamed({"_t": "_t2", "n": "n2"}), F.col("t2") == F.col("_t2"))
    # the gap after a value is the running sum of what both distributions gain
    gain = F.col("c1") / F.col("n1") - F.col("c2") / F.col("n2")
    v = running_total(v.select("t1", "t2", "value", gain.alias("gain")), ["t1", "t2"], [F.col("value")], F.col("gain"), "before")
    return v.groupBy("t1", "t2").agg(F.max(F.abs(F.col("before") + F.col("gain"))).alias("ks"))


#: What a pair's similarity is made of.
PARTS = (*FIELDS, "ks")


def pairwise(prints: DataFrame, pair: DataFrame, distance: DataFrame, part_weights: DataFrame | None = None) -> DataFrame:
    """Similarity of each pair: the weighted mean of six component similarities and the KS similarity, 0 if
    the weights are. ``part_weights``: state_type, category and a column w_ of each part, joined to ``pair``
    (which then has state_type and category); without it, or where a pair has no line, all weigh the same."""
    a = prints.select(F.col("tensor_id").alias("_a"), *[F.col(f).alias(f"a_{f}") for f in FIELDS])
    b = prints.select(F.col("tensor_id").alias("_b"), *[F.col(f).alias(f"b_{f}") for f in FIELDS])
    even = F.lit(1 / len(PARTS))
    if part_weights is None:
        pair = pair.withColumns({f"w_{n}": even for n in PARTS})
    else:
        w = part_weights.select(F.col("state_type").alias("_s"), F.col("category").alias("_c"), *[F.col(f"w_{n}").alias(f"_{n}") for n in PARTS])
        pair = pair.join(w, F.col("state_type").eqNullSafe(F.col("_s")) & F.col("category").eqNullSafe(F.col("_c")), "left").withColumns({f"w_{n}": F.coalesce(F.col(f"_{n}"), even) for n in PARTS})
    weight = [f"w_{n}" for n in PARTS]
    j = pair.select("t1", "t2", *weight).join(a, F.col("t1") == F.col("_a")).join(b, F.col("t2") == F.col("_b")).join(distance, ["t1", "t2"])
    parts = [similarity(F.col(f"a_{f}"), F.col(f"b_{f}")).alias(f"sim_{f}") for f in FIELDS]
    j = j.select("t1", "t2", *weight, *parts, F.greatest(F.lit(0.0), 100 * (1 - F.col("ks"))).alias("sim_ks"))
    total = sum((F.col(f"sim_{n}") * F.col(f"w_{n}") for n in PARTS), F.lit(0.0))
    return j.withColumn("similarity", safe_div(total, sum((F.col(w) for w in weight), F.lit(0.0)))).drop(*weight)


def weights(prints: DataFrame) -> DataFrame:
    """Importance of each dimension: its variance over all tensors, over the sum of all, to each of which
    a little is added. Equal fingerprints give weights of 0; no fingerprints count as equal ones."""
    v = prints.agg(*[F.coalesce(F.avg(F.col(d) * F.col(d)) - F.avg(d) * F.avg(d), F.lit(0.0)).alias(d) for d in DIMS])
    total = sum((F.col(d) + 1e-8 for d in DIMS), F.lit(0.0))
    return v.select(*[(F.col(d) / total).alias(f"w_{d}") for d in DIMS])


def clusters(prints: DataFrame) -> DataFrame:
    """state_type, tensor_id, cluster (smallest member), size. ``prints`` has state_type and the five dimensions.

    Pairs closer than the lower-quartile distance of their category (strictly) are linked. The number
    of tensors is small; components grow by min-label steps over the written edges.
    """
    by = W.partitionBy("state_type")
    z = prints
    for d in DIMS:
        s = F.stddev_pop(d).over(by)
        z = z.withColumn(f"z_{d}", (F.col(d) - F.avg(d).over(by)) / F.when(s * s < 1e-30, 1.0).otherwise(s))
    a = z.select("state_type", F.col("tensor_id").alias("a"), *[F.col(f"z_{d}").alias(f"a_{d}") for d in DIMS])
    b = z.select("state_type", F.col("tensor_id").alias("b"), *[F.col(f"z_{d}").alias(f"b_{d}") for d in DIMS])
    square = sum((F.pow(F.col(f"a_{d}") - F.col(f"b_{d}"), 2) for d in DIMS), F.lit(0.0))
    p = a.join(b, "state_type").filter("a < b").withColumn("dist", F.round(F.sqrt(square), 9))
    rank = F.row_number().over(by.orderBy("dist", "a", "b"))
    limit = F.max(F.when(F.col("rn") == F.floor(F.col("n") / 4) + 1, F.col("dist"))).over(by)
    edges = p.withColumn("rn", rank).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("limit", limit).filter("dist < limit").select("state_type", "a", "b")
    edges = edges.union(edges.select("state_type", "b", "a"))
    return _label(prints.select("state_type", "tensor_id"), edges)


def _label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    edges = materialise(edges, "edges")
    lab = materialise(nodes.withColumn("label", F.col("tensor_id")), "labels")
    while True:
        near = edges.join(lab.select("state_type", F.col("tensor_id").alias("a"), "label"), ["state_type", "a"]).groupBy("state_type", F.col("b").alias("tensor_id")).agg(F.min("label").alias("m"))
        new = lab.join(near, ["state_type", "tensor_id"], "left").select("state_type", "tensor_id", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved"))
        new = materialise(new, "labels")
        if new.filter("moved").isEmpty():
            break
        lab = new.drop("moved")
    size = F.count(F.lit(1)).over(W.partitionBy("state_type", "label"))
    return lab.select("state_type", "tensor_id", F.col("label").alias("cluster"), size.alias("size"))
