"""Running sums in two levels: no task holds all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key that come before, by ``order``.

    Rows are sorted into ranges of (keys, order) by Spark's sampled splitters; sums are taken inside a
    range, and over the ranges' sums, of which there are few. Rows that tie in ``order`` count in any
    order. A key may hold all rows. Sums of integers are long, of others double.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys]
    ranged = df.withColumn("_v", value).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_v").alias("_sum"))
    over = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[c.alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same &= c.eqNullSafe(F.col(f"_k{i}"))
    return inner.join(sums, same).withColumn(out, F.col("_in") + F.col("_base")).select(*df.columns, out)
