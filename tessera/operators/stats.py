"""Distribution statistics per tensor, as single-pass or two-pass aggregations (t: tensor_id, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.running import running_total


def fingerprint5(t: DataFrame, least_variance: float = 1e-9) -> DataFrame:
    """mean, variance, skewness, raw kurtosis, range (population moments; 0 where variance is tiny)."""
    flat = F.coalesce(F.var_pop("value"), F.lit(0.0)) <= least_variance
    return t.groupBy("tensor_id").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.kurtosis("value") + 3).alias("kurtosis"),
        (F.max("value") - F.min("value")).cast("double").alias("range"),
    )


def fingerprint10(t: DataFrame, least_variance: float = 1e-12) -> DataFrame:
    """count, moments with excess kurtosis, and linear quartiles."""
    flat = F.coalesce(F.var_pop("value"), F.lit(0.0)) <= least_variance
    m = t.groupBy("tensor_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.kurtosis("value")).alias("excess_kurtosis"),
    )
    q = quantiles(t, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("tensor_id", "_q")
    j = m.join(q, F.col("tensor_id").eqNullSafe(F.col("_q")), "left")
    return j.select("tensor_id", "n", "mean", "variance", F.sqrt("variance").alias("stddev"), "skewness", "excess_kurtosis", "median", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def quantiles(t: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """tensor_id and the linear quantiles ``wanted`` (name: share), exact: from running counts of distinct
    values, so that no task holds the values of a tensor. Nulls don't count."""
    c = t.filter("value IS NOT NULL").groupBy("tensor_id", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy(F.col("tensor_id").alias("_t")).agg(F.sum("c").alias("n"))
    r = running_total(c, ["tensor_id"], [F.col("value")], F.col("c"), "before").join(n, F.col("tensor_id").eqNullSafe(F.col("_t")))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("c")), F.col("value")))
    ends = []
    for name, share in wanted.items():
        place = (F.col("n") - 1) * share
        ends += [at(F.floor(place)).alias(f"lo_{name}"), at(F.ceil(place)).alias(f"hi_{name}"), F.max(place - F.floor(place)).alias(f"part_{name}")]
    e = r.groupBy("tensor_id").agg(*ends)
    return e.select("tensor_id", *[(F.col(f"lo_{x}") + (F.col(f"hi_{x}") - F.col(f"lo_{x}")) * F.col(f"part_{x}")).alias(x) for x in wanted])


def distribution(t: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of each key's values (keys, value): n, mean, std, median, iqr, skew, kurt (Fisher), all but
    n are NaN without values; skew and kurt are NaN for constants too. A key with nulls alone has none."""
    one = F.struct(*keys)
    v = t.select(one.alias("tensor_id"), F.col("value").cast("double").alias("value"))
    m = v.groupBy("tensor_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    q = quantiles(v, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("tensor_id", "_q")
    j = m.join(q, F.col("tensor_id") == F.col("_q"), "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    nan = lambda c: F.coalesce(F.col(c), F.lit(float("nan"))).alias(c)
    return j.select(*[F.col(f"tensor_id.{k}").alias(k) for k in keys], "n", *[nan(c) for c in ("mean", "std", "median", "iqr", "skew", "kurt")])


#: Points at which a density is given.
GRID = 300


def kde(t: DataFrame, points: int = GRID) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid from minimum to maximum: tensor_id, point,
    x, density. Tensors with fewer than two values, or one value alone, have none. Every batch of rows is
    reduced to ``points`` partial sums per tensor, so the samples never meet."""
    import numpy as np
    import pyarrow as pa

    c = t.filter("value IS NOT NULL").groupBy("tensor_id", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    m = t.groupBy(F.col("tensor_id").alias("_t")).agg(F.count("value").alias("n"), F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"), F.stddev_samp(F.col("value").cast("double")).alias("sd")).filter("n > 1 AND hi > lo")
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    rows = c.join(m, F.col("tensor_id") == F.col("_t")).select("tensor_id", "value", "c", "lo", "hi", h.alias("h"))

    def sums(batches):
        share = np.arange(points) / (points - 1)
        for b in batches:
            names, lo, hi, h, v, n = (b.column(x).to_numpy(zero_copy_only=False) for x in ("tensor_id", "lo", "hi", "h", "value", "c"))
            for name in dict.fromkeys(names):
                own = np.flatnonzero(names == name)
                total = np.zeros(points)
                grid = lo[own[0]] + share * (hi[own[0]] - lo[own[0]])
                for at in range(0, len(own), 4096):
                    some = own[at : at + 4096]
                    total += (n[some, None] * np.exp(-0.5 * ((grid - v[some, None]) / h[own[0]]) ** 2)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * points, pa.string()), pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], names=["tensor_id", "point", "total"])

    part = rows.mapInArrow(sums, "tensor_id string, point int, total double").groupBy("tensor_id", "point").agg(F.sum("total").alias("total"))
    j = part.join(m, F.col("tensor_id") == F.col("_t"))
    x = F.col("lo") + F.col("point") / (points - 1) * (F.col("hi") - F.col("lo"))
    return j.select("tensor_id", "point", x.alias("x"), (F.col("total") / (F.col("n") * h * math.sqrt(2 * math.pi))).alias("density"))


def histogram(t: DataFrame, bins: int = 256) -> DataFrame:
    """tensor_id, bin, cnt: bins of range / (bins - 1) from the minimum; a flat tensor has bin 0 alone."""
    bins = min(bins, 256)
    ends = t.groupBy("tensor_id").agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi")).withColumnRenamed("tensor_id", "_id")
    x = t.join(ends, F.col("tensor_id") == F.col("_id"))
    width = F.col("hi") - F.col("lo")
    at = F.floor((F.col("value").cast("double") - F.col("lo")) * (bins - 1) / width)
    return x.withColumn("bin", F.when(width <= 1e-9, 0).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("int")).groupBy("tensor_id", "bin").agg(F.count(F.lit(1)).alias("cnt"))


def ecdf(t: DataFrame) -> DataFrame:
    """tensor_id, value, share of smaller elements, from counts of distinct values."""
    c = t.groupBy("tensor_id", "value").agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy(F.col("tensor_id").alias("_t")).agg(F.sum("c").alias("n"))
    below = running_total(c, ["tensor_id"], [F.col("value")], F.col("c"), "below")
    return below.join(n, F.col("tensor_id").eqNullSafe(F.col("_t"))).select("tensor_id", "value", (F.col("below") / F.col("n")).alias("ecdf"))
