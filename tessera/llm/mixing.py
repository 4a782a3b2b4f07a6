"""Mixing sources to target weights by weighted fair queueing.

Each source's documents come in a shuffled order, its next pass after the last. A document's
virtual finish time is the words of its source up to and with it, divided by the source's target;
all documents are range-sorted by it and the queue is cut where the words reach the total budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialise, partitions, read, running_total, slices

WEIGHTS = (3, 1, 2)
#: The mix, as a share of all words.
BUDGET = 1.5
#: Times a document may be taken.
EPOCHS = 2
#: Rows aimed at in a bucket of the running sums, and in a range of the queue.
ROWS_PER_BUCKET = 20_000
#: Sources whose sums may go to the driver and to all executors; with more, the targets are found by a table.
DRIVER_SOURCES = 50_000


def count_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, h, size: hash of the row's id, source and text, and the ASCII-space separated
    words of the whole text (null: 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sizes = pa.array([len(t.split()) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("h"), sizes], names=["doc_id", "source", "h", "size"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "source", "text", row_hash(seed).alias("h")).mapInArrow(count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, h long, size long")


def row_hash(seed: int) -> Column:
    return F.xxhash64("doc_id", "source", "text", F.lit(seed))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> dict[str | None, float]:
    """Words each source gives: ``budget`` of all by weight, ``epochs`` times its size at most.

    What a source can't give is shared again by weight among the rest until none is above its bound.
    Sources are in order of code points, null last, and the weights repeat."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    bound = {s: float(epochs * n) for s, n in order}
    left, open_, out = min(budget * sum(n for _, n in order), sum(bound.values())), dict(weight), {}
    while open_:
        unit = left / sum(open_.values())
        over = [s for s in open_ if unit * open_[s] > bound[s]]
        if not over:
            return out | {s: unit * w for s, w in open_.items()}
        for s in over:
            out[s] = bound[s]
            left -= bound[s]
            del open_[s]
    return out


def targets_table(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``targets`` of a table (source, source_size) of any length: source, source_size, target.

    Sources are numbered in a range sort; a round of the sharing is one aggregate."""
    n = partitions(sizes.sparkSession)
    ranged = sizes.select("source", "source_size").repartitionByRange(n, F.col("source").asc_nulls_last())
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()), "sources")
    before, at = {}, 0
    for r in sorted(ranged.groupBy("range").count().collect(), key=lambda r: r["range"]):
        before[r["range"]], at = at, at + r["count"]
    if not before:
        return ranged.select("source", "source_size", F.lit(0.0).alias("target"))
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    place = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + base[F.col("range")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = materialise(ranged.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).cast("double").alias("bound")), "sources")
    total, bounds = table.agg(F.sum("source_size"), F.sum("bound")).first()
    # who is above its bound at one unit stays so at the next, larger one
    left, unit, shut = min(budget * total, bounds), 0.0, -1
    while True:
        over = F.col("bound") < F.col("weight") * F.lit(unit)
        r = table.agg(F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == shut or not r["w"]:
            return table.select("source", "source_size", F.when(over, F.col("bound")).otherwise(F.lit(unit) * F.col("weight")).alias("target"))
        unit, shut = (left - r["b"]) / r["w"], r["n"]


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """Row by row: doc_id, source, size, source_size, target, taken (words), copies (times taken), h, before.

    All documents, each as often as it may be taken, are sorted into ranges of their finish time; ranges
    count until the words reach the budget, and the one where they do is cut inside. Rows without words
    are never taken. Repeated rows are documents of their own; null sources form one, the last. Reruns
    agree: the order is a hash (h) of doc_id, source and text, and rows that agree in these are
    exchangeable. Sources may be few or many, and hold all rows or one. Empty input: no rows.
    """
    spark = docs.sparkSession
    rows = materialise(count_words(docs, seed), "sizes")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    n_sources, total, n_rows, most = sizes.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("rows"), F.max("rows")).first()
    if not total:
        none = F.lit(0).cast("long")
        return rows.select("doc_id", "source", "size", none.alias("source_size"), F.lit(0.0).alias("target"), none.alias("taken"), F.lit(0).alias("copies"), "h", none.alias("before"))
    if n_sources <= DRIVER_SOURCES:
        own = [(r["source"], r["source_size"]) for r in sizes.collect()]
        goal = targets(own, weights, budget, epochs)
        table = F.broadcast(spark.createDataFrame([(s, n, float(goal[s])) for s, n in own], "_source string, source_size long, target double"))
        budget_words = round(sum(goal.values()))
    else:
        table = materialise(targets_table(sizes, weights, budget, epochs).withColumnRenamed("source", "_source"), "targets")
        budget_words = round(table.agg(F.sum("target")).first()[0])
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    # Words of the source before each document, in shuffled order.
    n_buckets = max(partitions(spark), most // ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 33) * n_buckets) / float(1 << 31)).cast("long"))
    rows = running_total(rows, ["source"], "bucket", [F.shiftrightunsigned("h", 33), F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "before").drop("bucket")
    # All passes of a document; the finish time is in targets, so the budget ends close to 1.
    queue = rows.filter("size > 0 AND target > 0").withColumn("epoch", F.explode(F.array([F.lit(i) for i in range(epochs)])))
    queue = queue.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target"))
    order = [F.col("finish"), F.col("h"), F.col("doc_id"), F.col("size"), F.col("before"), F.col("epoch")]
    queue = queue.select("doc_id", "source", "size", "h", "before", "epoch", "finish").repartitionByRange(max(partitions(spark), epochs * n_rows // ROWS_PER_BUCKET), *order)
    queue = materialise(queue.withColumn("range", F.spark_partition_id()), "queue")
    last, base = None, 0
    for r in sorted(queue.groupBy("range").agg(F.sum("size").alias("n")).collect(), key=lambda r: r["range"]):
        last = r["range"]
        if base + r["n"] > budget_words:
            break
        base += r["n"]
    tail = queue.filter(F.col("range") == last).withColumn("upto", F.sum("size").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + base)
    queue = queue.filter(F.col("range") < last).unionByName(tail.filter(F.col("upto") <= budget_words).drop("upto"))
    taken = queue.groupBy("h", "before", F.col("doc_id").alias("_doc"), F.col("source").alias("_source")).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    taken = taken.withColumnsRenamed({"h": "_h", "before": "_before"})
    out = rows.join(taken, (F.col("h") == F.col("_h")) & (F.col("before") == F.col("_before")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") > 0), "left")
    copies = F.coalesce("copies", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "h", "before")


def sample(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken.

    Rows that agree in doc_id, source and text share what is taken of them evenly. Rows without words
    are never taken, null ids and sources are as in ``mix``. Columns may have any names. Empty input: no rows."""
    h, no, rows, copies, doc_id, source, other = (fresh(docs, f"_mix_{x}") for x in ("h", "no", "rows", "copies", "id", "source", "other"))
    plan = mix(docs, weights, budget, epochs, seed).groupBy(F.col("h").alias(other), F.col("doc_id").alias(doc_id), F.col("source").alias(source))
    plan = plan.agg(F.count(F.lit(1)).alias(rows), F.sum("copies").alias(copies)).filter(F.col(copies) > 0)
    out = docs.withColumn(h, row_hash(seed)).join(plan, (F.col(h) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)))
    # the few rows that agree are numbered, and take their parts in turn
    out = out.withColumn(no, F.when(F.col(rows) > 1, F.row_number().over(W.partitionBy(h, "doc_id", "source").orderBy(h))).otherwise(1))
    times = F.floor((F.col(copies) + F.col(rows) - F.col(no)) / F.col(rows)).cast("int")
    return out.withColumn(copies, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
