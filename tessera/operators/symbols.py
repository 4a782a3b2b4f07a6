"""Symbol statistics: counts, entropy, size models, HyperLogLog registers, coding costs.

``counts`` is the compact summary (tensor_id, cluster, sym, cnt) that everything else starts from.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import float_bits, fmix32

PRECISION = 14
REGISTERS = 1 << PRECISION


def counts(t: DataFrame, cluster: str = "state_type") -> DataFrame:
    """Equal values are counted first, so that only distinct ones are reinterpreted in Python."""
    c = t.groupBy("tensor_id", F.col(cluster).alias("cluster"), "value").agg(F.count(F.lit(1)).alias("cnt"))
    return c.select("tensor_id", "cluster", float_bits("value").alias("sym"), "cnt")


def summary(c: DataFrame) -> DataFrame:
    """numel, distinct symbols, their ratio, entropy, the two histogram size models, bytes as they are and
    as an ideal coder makes them, and the ratio of histogram and tensor."""
    n = c.groupBy("tensor_id", "cluster").agg(F.sum("cnt").alias("numel"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("cnt") * F.log2("cnt")).alias("w"))
    n = n.withColumn("unique_ratio", F.col("n_unique") / F.col("numel")).withColumn("entropy", F.log2("numel") - F.col("w") / F.col("numel")).drop("w")
    width = F.when(F.col("numel") < 65536, 2).otherwise(4)
    n = n.withColumn("hist_bytes_e1", (F.col("n_unique") * width + 64).cast("long")).withColumn("hist_bytes_e2", (F.col("n_unique") * 8 + 64).cast("long"))
    return n.withColumn("tensor_bytes", F.col("numel") * 4).withColumn("estimated_bytes", F.col("entropy") * F.col("numel") / 8).withColumn("hist_ratio", F.col("hist_bytes_e1") / F.col("tensor_bytes"))


def merge(c: DataFrame) -> DataFrame:
    """Vocabulary of each cluster with summed counts."""
    return c.groupBy("cluster", "sym").agg(F.sum("cnt").alias("cnt"))


def hll_registers(c: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse registers (keys, idx, rho); zero registers have no row. Grouping by fewer keys merges."""
    x = c.withColumn("h", fmix32(F.col("sym"))).withColumn("idx", F.shiftright("h", 32 - PRECISION).cast("int"))
    w = F.shiftleft("h", PRECISION).bitwiseAND(4294967295).bitwiseOR(1 << (PRECISION - 1))
    rho = F.least(F.greatest(33 - F.length(F.bin(w)), F.lit(1)), F.lit(32 - PRECISION))
    return x.groupBy(*keys, "idx").agg(F.max(rho).cast("int").alias("rho"))


def hll_estimate(registers: DataFrame, keys: list[str]) -> DataFrame:
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    s = registers.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("z"), F.count(F.lit(1)).alias("used"))
    empty = m - F.col("used")
    raw = alpha * m * m / (F.col("z") + empty)
    est = F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / F.greatest(empty, F.lit(1.0)))).when(raw > 2**32 / 30, -(2.0**32) * F.log(1 - raw / 2.0**32)).otherwise(raw)
    return s.select(*keys, est.alias("estimate"))


def xe_model(merged: DataFrame) -> DataFrame:
    """Quantised model of a cluster: norm = max(1, floor(cnt 2^p / total)); the most frequent symbol takes the drift."""
    total = merged.groupBy(F.col("cluster").alias("_c")).agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n"))
    x = merged.join(total, F.col("cluster").eqNullSafe(F.col("_c"))).drop("_c")
    x = x.withColumn("p", F.greatest(F.lit(14), F.ceil(F.log2(F.greatest("n", F.lit(2)))) + 1).cast("int"))
    x = x.withColumn("norm", F.greatest(F.lit(1), F.floor(F.col("cnt") * F.pow(F.lit(2.0), "p") / F.col("total"))).cast("long"))
    top = x.groupBy(F.col("cluster").alias("_c")).agg(F.sum("norm").alias("used"), F.max_by("sym", F.struct(F.col("cnt"), -F.col("sym"))).alias("top"))
    x = x.join(top, F.col("cluster").eqNullSafe(F.col("_c")))
    drift = (F.pow(F.lit(2.0), "p") - F.col("used")).cast("long")
    return x.select("cluster", "sym", "cnt", "p", F.when(F.col("sym") == F.col("top"), F.greatest(F.lit(1), F.col("norm") + drift)).otherwise(F.col("norm")).alias("norm"))


def xe_cost(c: DataFrame, model: DataFrame, key: str = "tensor_id") -> DataFrame:
    """Stream bytes of every tensor under its cluster's model."""
    m = model.select(F.col("cluster").alias("_c"), F.col("sym").alias("_s"), "p", "norm")
    j = c.join(m, (F.col("cluster") == F.col("_c")) & (F.col("sym") == F.col("_s")))
    return j.groupBy(key, "cluster").agg((F.sum(F.col("cnt") * (F.col("p") - F.log2("norm"))) / 8).alias("stream_bytes"))


def byte_counts(c: DataFrame, mask: int = 0xFFFFFFFF) -> DataFrame:
    """Counts of the little-endian bytes of the masked symbols."""
    x = c.withColumn("k", F.explode(F.array(*[F.lit(8 * i) for i in range(4)])))
    byte = F.expr(f"CAST(shiftright(sym & {mask}L, k) & 255 AS INT)")
    return x.groupBy("tensor_id", byte.alias("byte")).agg(F.sum("cnt").alias("cnt"))


def table_log(n: int) -> int:
    """log2 of the tANS table for n symbols."""
    return 4 if n <= 1 else min(16, max(8, math.ceil(math.log2(n))))
