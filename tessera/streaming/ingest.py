"""Streaming front-end: tensors' statistics and sketches kept up to date as files arrive.

Every micro-batch is reduced to partial states, one row per tensor (or register), and written to a
folder named by the batch id. A batch that is run again overwrites its own folder, so results are
exact whatever fails in between. Reading merges the partial states of all batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import symbols

STATE = "tensor_id string, n long, mean double, m2 double, m3 double, m4 double, lo float, hi float"


def moments(t: DataFrame) -> DataFrame:
    """Partial state of each tensor (t: tensor_id, value): count, mean, central sums, ends.

    Null values count nowhere; a tensor with nulls alone has no state.
    """
    n = F.count("value")
    var, skew, kurt = F.var_pop("value"), F.coalesce(F.skewness("value"), F.lit(0.0)), F.coalesce(F.kurtosis("value"), F.lit(-3.0))
    s = t.groupBy("tensor_id").agg(
        n.alias("n"), F.avg("value").cast("double").alias("mean"), (var * n).alias("m2"), (skew * n * F.pow(var, F.lit(1.5))).alias("m3"),
        ((kurt + 3) * n * var * var).alias("m4"), F.min("value").cast("float").alias("lo"), F.max("value").cast("float").alias("hi"),
    )
    return s.filter("n > 0")


def merge_moments(states: DataFrame) -> DataFrame:
    """One state per tensor: the central sums are moved to the common mean, which loses no digits."""
    total = states.groupBy("tensor_id").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean")).withColumnRenamed("tensor_id", "_id")
    x = states.join(total, F.col("tensor_id") == F.col("_id")).withColumn("d", F.col("mean") - F.col("_mean"))
    n, d, m2, m3 = (F.col(c) for c in ("n", "d", "m2", "m3"))
    return x.groupBy("tensor_id").agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )


def fingerprint5(states: DataFrame, least_variance: float = 1e-9) -> DataFrame:
    """The batch operator's columns, from merged states."""
    var = F.col("m2") / F.col("n")
    flat = var <= least_variance
    return states.select(
        "tensor_id", "mean", var.alias("variance"), F.when(flat, 0.0).otherwise(F.col("m3") / F.col("n") / F.pow(var, F.lit(1.5))).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.col("m4") / F.col("n") / (var * var)).alias("kurtosis"), (F.col("hi") - F.col("lo")).cast("double").alias("range"),
    )


def registers(t: DataFrame) -> DataFrame:
    """Partial HyperLogLog registers: tensor_id, idx, rho."""
    return symbols.hll_registers(symbols.counts(t, "tensor_id"), ["tensor_id"])


def merge_registers(states: DataFrame) -> DataFrame:
    return states.groupBy("tensor_id", "idx").agg(F.max("rho").alias("rho"))


def ingest(source: DataFrame, elements: Callable[[DataFrame], DataFrame], reduce: Callable[[DataFrame], DataFrame], root: str) -> int:
    """Reduce all that a streaming ``source`` has and that wasn't read before; returns the batches run.

    Progress is kept in ``root``/progress: calling it again reads new files alone. ``elements`` turns a
    micro-batch into tensor elements, ``reduce`` those into partial states.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        reduce(elements(batch)).write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    query = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])


def states(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The partial states of all batches so far."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/state").drop("batch")


def files(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files (a folder or one file) as a stream, at most ``files_per_batch`` in a micro-batch.

    A stream takes a plain path for a folder; as a pattern, the same path may be one file too.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def latest(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The states of the last batch that holds each tensor: a tensor that comes again replaces itself."""
    reader = spark.read if schema is None else spark.read.schema(schema + ", batch int")
    rows = reader.parquet(f"{root}/state")
    last = rows.groupBy(F.col("tensor_id").alias("_t")).agg(F.max("batch").alias("_b"))
    return rows.join(last, (F.col("tensor_id") == F.col("_t")) & (F.col("batch") == F.col("_b"))).drop("batch", "_t", "_b")


def reset(spark: SparkSession, root: str) -> None:
    """Forget progress and states, so that the next run reads everything anew."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Ingestion:
    """A running intake: ``start`` accepts new files as they come, ``stop`` ends it after the batch at hand,
    ``flush`` waits until all that has come is in the states."""

    def __init__(self, source: DataFrame, elements: Callable[[DataFrame], DataFrame], reduce: Callable[[DataFrame], DataFrame], root: str):
        self.source, self.elements, self.reduce, self.root, self.query = source, elements, reduce, root, None

    @property
    def accepting(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> None:
        if self.accepting:
            return

        def keep(batch: DataFrame, batch_id: int) -> None:
            self.reduce(self.elements(batch)).write.mode("overwrite").parquet(f"{self.root}/state/batch={batch_id}")

        self.query = self.source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.root}/progress").start()

    def flush(self) -> None:
        if not self.accepting:
            raise RuntimeError("not accepting")
        self.query.processAllAvailable()

    def stop(self) -> None:
        if self.accepting:
            self.query.stop()
