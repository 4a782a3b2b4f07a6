"""The tensors catalog: extraction of parameters, shards of flat groups, checkpoints, layouts.

Parameters come as a table; what a process would read off live objects are its columns. Nothing here
collects: every scan is a projection, a running sum or an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dtypes
from tessera.plans.running import running_total

CATEGORIES = ("model_state", "master_weights", "exp_avg", "exp_avg_sq")
#: Where an extraction may come from, the first that holds bytes counts.
SOURCES = ("ds_tensor.partition", "ds_tensor", "parameter", "data", "hp_tensor")


def resident(logical: Column, partition: Column, rank: Column) -> Column:
    """Elements of a tensor of ``logical`` ones that the rank holds, cut in partitions; 0 if none."""
    at = F.greatest(F.coalesce(rank, F.lit(0)), F.lit(0)) * partition
    return F.when((logical <= 0) | (partition <= 0) | (at >= logical), 0).otherwise(F.least(partition, logical - at)).cast("long")


def handle_bytes(h: str) -> Column:
    """Bytes behind a handle (struct column ptr, numel, element_size, untyped_bytes, typed_bytes): by its
    elements, else by its storage; null without a pointer or bytes."""
    own = F.coalesce(F.col(f"{h}.numel") * F.col(f"{h}.element_size"), F.lit(0))
    size = F.when(own > 0, own).when(F.coalesce(F.col(f"{h}.untyped_bytes"), F.lit(0)) > 0, F.col(f"{h}.untyped_bytes")).otherwise(F.col(f"{h}.typed_bytes"))
    return F.when(F.coalesce(F.col(f"{h}.ptr"), F.lit(False)) & (size > 0), size)


def extract(params: DataFrame) -> DataFrame:
    """One row per parameter: source, element_size, num_elements, byte_size, logical_num_elements,
    logical_byte_size; source is null where nothing can be read (such rows are the skipped ones).

    ``params``: name, dtype, rank, ds_numel, partition_numel, and the handles ds_tensor, parameter,
    data, hp_tensor (structs, see ``handle_bytes``, any may be null).
    """
    part = resident(F.coalesce("ds_numel", F.lit(0)), F.coalesce("partition_numel", F.lit(0)), F.col("rank"))
    part = F.when(F.col("ds_tensor.ptr") & (F.col("ds_tensor.element_size") > 0) & (part > 0), part)
    size = F.col("ds_tensor.element_size")
    found = [F.when(part.isNotNull(), F.struct(F.lit(SOURCES[0]).alias("source"), size.cast("long").alias("element_size"), (part * size).cast("long").alias("byte_size")))]
    for source in SOURCES[1:]:
        n = handle_bytes(source)
        own = F.coalesce(F.col(f"{source}.element_size"), dtypes.element_size(dtypes.parse(F.col("dtype")))).cast("long")
        found.append(F.when(n.isNotNull(), F.struct(F.lit(source).alias("source"), own.alias("element_size"), n.cast("long").alias("byte_size"))))
    out = params.withColumn("_x", F.coalesce(*found))
    elements = F.when(F.col("_x.element_size") > 0, F.floor(F.col("_x.byte_size") / F.col("_x.element_size"))).otherwise(0).cast("long")
    logical = F.when(F.coalesce("ds_numel", F.lit(0)) > 0, F.col("ds_numel")).otherwise(elements).cast("long")
    return out.select(
        "name", dtypes.parse(F.col("dtype")).alias("dtype"), F.col("_x.source").alias("source"), F.col("_x.element_size").alias("element_size"), F.when(F.col("_x").isNotNull(), elements).alias("num_elements"),
        F.col("_x.byte_size").alias("byte_size"), F.when(F.col("_x").isNotNull(), logical).alias("logical_num_elements"), F.when(F.col("_x").isNotNull(), logical * F.col("_x.element_size")).alias("logical_byte_size"),
    )


def suspect(extracted: DataFrame) -> DataFrame:
    """Rows that analysis would skip: nothing to read, or no elements."""
    return extracted.filter(F.col("source").isNull() | (F.coalesce("num_elements", F.lit(0)) == 0))


def flat_group_scan(params: DataFrame, groups: DataFrame, n_ranks: int) -> DataFrame:
    """Slices of the flat buffers that each rank tracks: rank, group_id, name, category, flat_offset, num_elements.

    ``params``: name, group_id, flat_offset, flat_numel, ds_numel, requires_grad. Of each group (``groups``:
    group_id, flat_size, has_model, has_exp_avg, has_exp_avg_sq) the trainable parameters follow each other
    by flat_offset; a rank's territory are the logical elements [rank, rank + 1) * flat_size, and every
    parameter that meets it gives up to four slices, one a category, named by their prefix. The ranks a
    parameter meets follow from its ends, so there is no product of parameters and ranks.
    """
    own = params.filter("requires_grad AND flat_numel > 0 AND ds_numel > 0").join(groups.filter("flat_size > 0"), "group_id")
    placed = running_total(own, ["group_id"], [F.col("flat_offset"), F.col("name")], F.col("ds_numel"), "p_start")
    total = own.groupBy(F.col("group_id").alias("_g")).agg(F.sum("ds_numel").alias("total"))
    placed = placed.join(total, F.col("group_id") == F.col("_g")).drop("_g").withColumn("p_end", F.col("p_start") + F.col("ds_numel"))
    last = F.least(F.floor((F.col("p_end") - 1) / F.col("flat_size")), F.lit(n_ranks - 1))
    first = F.floor(F.col("p_start") / F.col("flat_size"))
    met = placed.filter(first <= last).withColumn("rank", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    names = (("model_state", "", "has_model"), ("master_weights", "master_weights::", None), ("exp_avg", "optimizer.exp_avg::", "has_exp_avg"), ("exp_avg_sq", "optimizer.exp_avg_sq::", "has_exp_avg_sq"))
    made = F.array(*[F.when(F.col(has) if has else F.lit(True), F.concat(F.lit(prefix), "name")) for _, prefix, has in names])
    out = met.withColumn("slice", F.explode(F.filter(made, lambda x: x.isNotNull())))
    return out.select("rank", "group_id", F.col("slice").alias("name"), dtypes.category(F.col("slice")).alias("category"), "flat_offset", F.col("flat_numel").alias("num_elements"))


def narrow(t: DataFrame, offset: Column, n: Column) -> DataFrame:
    """Elements [offset, offset + n) of long rows (pos, ...), renumbered from 0."""
    return t.filter((F.col("pos") >= offset) & (F.col("pos") < offset + n)).withColumn("pos", F.col("pos") - offset)


def state_slices(params: DataFrame, states: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """Optimizer state of each parameter: name, pos, value. ``params``: name, group_id, flat_offset, flat_numel;
    ``states``: group_id, key, pos, value, a flat buffer per group and key. Parameters are cut in blocks of
    positions, so that the ranges meet the buffer in an equi-join."""
    own = params.filter("flat_numel > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("flat_offset") / block), F.floor((F.col("flat_offset") + F.col("flat_numel") - 1) / block))))
    flat = states.filter(F.col("key") == key).select(F.col("group_id").alias("_g"), F.floor(F.col("pos") / block).alias("_p"), F.col("pos").alias("_pos"), "value")
    j = own.join(flat, (F.col("group_id") == F.col("_g")) & (F.col("_b") == F.col("_p")) & (F.col("_pos") >= F.col("flat_offset")) & (F.col("_pos") < F.col("flat_offset") + F.col("flat_numel")))
    return j.select("name", (F.col("_pos") - F.col("flat_offset")).alias("pos"), "value")


def state_keys(states: DataFrame) -> DataFrame:
    """The distinct keys of the optimizer's states."""
    return states.select("key").distinct()


def concat_shards(shards: DataFrame) -> DataFrame:
    """One stream of the ranks' elements (rank, pos, value) in rank order: pos, value."""
    sizes = shards.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    base = running_total(sizes, [], [F.col("rank")], F.col("n"), "base").select(F.col("rank").alias("_r"), "base")
    return shards.join(base, F.col("rank") == F.col("_r")).select((F.col("pos") + F.col("base")).alias("pos"), "value")


def reconstruct(stream: DataFrame, shapes: DataFrame, block: int = 4096) -> DataFrame:
    """Parameters out of a stream (pos, value): name, pos, value. ``shapes``: place, name, numel; a parameter
    begins where the ones before it end. What lies behind the last one is dropped."""
    placed = running_total(shapes.withColumn("_one", F.lit(0)), [], [F.col("place")], F.col("numel"), "flat_offset")
    params = placed.select("name", F.lit(0).alias("group_id"), "flat_offset", F.col("numel").alias("flat_numel"))
    return state_slices(params, stream.select(F.lit(0).alias("group_id"), F.lit("flat").alias("key"), "pos", "value"), "flat", block)


def row_major(shape: Column) -> Column:
    """Strides of a tensor stored row by row."""
    product = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda x, y: x * y)
    return F.when(F.size(shape) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(shape), F.lit(1))), lambda i: product(F.slice(shape, i + 1, F.size(shape)))))


def layout(tensors: DataFrame) -> DataFrame:
    """``tensors`` (shape, strides array<long>, may be null or empty) with the column layout: scalar,
    contiguous or non-contiguous. Without strides a tensor is contiguous."""
    rank = F.size(F.coalesce("shape", F.array().cast("array<bigint>")))
    same = F.col("strides").isNull() | (F.size("strides") == 0) | (F.col("strides") == row_major(F.col("shape")))
    return tensors.withColumn("layout", dtypes.layout_text(same, rank))


def fragments(tensors: DataFrame, element_size: int = 4) -> DataFrame:
    """Rows of non-contiguous tensors (tensor_id, shape, strides): tensor_id, frag_no, element_offset,
    byte_offset, num_elements, step. A row's place follows from all its indices and strides, so views of
    any rank and order come out right; ``step`` is the distance of its elements."""
    t = layout(tensors).filter("layout = 'non-contiguous'").withColumn("_rows", F.aggregate(F.slice("shape", 1, F.size("shape") - 1), F.lit(1).cast("long"), lambda a, b: a * b)).filter("_rows > 0 AND element_at(shape, -1) > 0")
    t = t.withColumn("frag_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
    unit = row_major(F.slice("shape", 1, F.size("shape") - 1))
    index = F.transform(F.when(F.size("shape") > 1, unit).otherwise(F.array().cast("array<bigint>")), lambda u, i: F.pmod(F.floor(F.col("frag_no") / u), F.get("shape", i)) * F.get("strides", i))
    at = F.aggregate(index, F.lit(0).cast("long"), lambda a, b: a + b)
    return t.select("tensor_id", "frag_no", at.alias("element_offset"), (at * element_size).alias("byte_offset"), F.element_at("shape", -1).alias("num_elements"), F.element_at("strides", -1).alias("step"))


def gather(frags: DataFrame, buffer: DataFrame) -> DataFrame:
    """Contiguous elements of fragments (see ``fragments``) over a buffer (tensor_id, pos, value)."""
    each = frags.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_elements") - 1)))
    each = each.select("tensor_id", (F.col("frag_no") * F.col("num_elements") + F.col("_i")).alias("_to"), (F.col("element_offset") + F.col("_i") * F.col("step")).alias("pos"))
    return each.join(buffer, ["tensor_id", "pos"]).select("tensor_id", F.col("_to").alias("pos"), "value")


def strict_lookup(left: DataFrame, right: DataFrame, keys: list[str], what: str = "tensor") -> DataFrame:
    """``left`` with the columns of ``right``; a row without a partner raises when it is read."""
    marked = right.withColumn("_found", F.lit(True))
    text = F.concat(F.lit(f"missing {what}: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    j = left.join(marked, keys, "left")
    return j.filter(F.coalesce("_found", F.raise_error(text).cast("boolean"))).drop("_found")


def same_dtype(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; a group of ``keys`` with several dtypes raises when it is read."""
    mixed = rows.groupBy(*keys).agg(F.min("dtype").alias("_lo"), F.max("dtype").alias("_hi"))
    text = F.concat(F.lit("mixed dtypes in one group: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return rows.join(mixed, keys).filter(F.when(F.col("_lo") == F.col("_hi"), True).otherwise(F.raise_error(text).cast("boolean"))).drop("_lo", "_hi")


def cluster_ids(clusters: DataFrame) -> DataFrame:
    """state_type, tensor_id, cluster_id, anchor, is_anchor of rows (state_type, tensor_id, cluster, size).

    Clusters of several tensors are numbered from 0 by category and smallest member, which is the anchor;
    singletons get -1 and no anchor."""
    several = clusters.filter("size > 1").select("state_type", "cluster").distinct()
    numbered = running_total(several.withColumn("_one", F.lit(1)), [], [F.col("state_type"), F.col("cluster")], F.col("_one"), "cluster_id").drop("_one")
    j = clusters.join(numbered, ["state_type", "cluster"], "left")
    anchor = F.when(F.col("cluster_id").isNotNull(), F.col("cluster"))
    return j.select("state_type", "tensor_id", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"), anchor.alias("anchor"), F.coalesce(anchor == F.col("tensor_id"), F.lit(False)).alias("is_anchor"))


def synthetic(spark, n: int, scale: float = 0.0005, seed: int = 42) -> DataFrame:
    """n normal values around 0: pos, value."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.randn(seed) * scale).cast("float").alias("value"))


