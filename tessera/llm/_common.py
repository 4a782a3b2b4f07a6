"""Helpers shared by the corpus operators.

Everything here works on DataFrames of any size: tables are cut from their lineage by writing them
to the folder that ``spark.checkpoint.dir`` names (all executors see it), and running sums are taken
in two levels so that no single key's rows meet in one task.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space as in ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on exactly these.
WORD_RE = "[^\\x20\\x09-\\x0D]+"
#: Text bytes handled at once inside a Python worker.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set (local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{scratch_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM is gone by then; the folder's owner clears it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, safe when executors die."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def running_total(df: DataFrame, keys: list[str], bucket: str, order: Iterable[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in the order (bucket, *order).

    Two levels: within (keys, bucket), and over the buckets' sums. ``bucket`` must split the rows of
    a key evenly, so a key with a third of all rows is spread over as many tasks as it has buckets.
    """
    part = [*keys, bucket]
    sums = df.groupBy(*part).agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(over.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.sum(value).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    inner = df.withColumn("_in", F.coalesce(within, F.lit(0)))
    right = sums.select(*[F.col(c).alias(f"_k_{c}") for c in part], "_base")
    on = None
    for c in part:
        cond = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        on = cond if on is None else on & cond
    return inner.join(right, on, "left").withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_in", "_base", *[f"_k_{c}" for c in part])


#: What a worker keeps for later tasks of a kind: the kind, and how to drop it.
KEPT: list[tuple[str, Callable[[], None]]] = []


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, kind: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``limit`` bytes of text, and the texts as UTF-8 (null: empty). What the
    worker keeps for tasks of another ``kind`` is dropped first."""
    for other, drop in KEPT:
        if other != kind:
            drop()
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index(column))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            start = total = 0
            for i, n in enumerate([*sizes, limit + 1]):
                if i > start and (total + n > limit or i == len(sizes)):
                    part = batch.slice(start, i - start)
                    own = part.column(part.schema.get_field_index(column))
                    yield part, [x or b"" for x in own.cast(pa.binary() if not pa.types.is_large_string(own.type) else pa.large_binary()).to_pylist()]
                    start, total = i, 0
                total += n
    finally:
        release()


def release() -> None:
    """Give memory that is free again back to the system: Python workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows and bytes in a batch for a Python worker, whichever come first. Texts may be long, and JVM and worker each
#: hold a batch several times.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to ``BATCH_ROWS`` and ``BATCH_BYTES`` if they are larger or unlimited;
    smaller ones stay."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, parse, most in (("maxRecordsPerBatch", int, BATCH_ROWS), ("maxBytesPerBatch", size, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < parse(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def one_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, play no part."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.col("text"))
