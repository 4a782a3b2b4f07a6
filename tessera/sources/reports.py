"""CSV reports with fixed headers, written by Spark (a folder of part files with one header each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import safe_div
from tessera.functions.dtypes import megabytes

# The headers that readers of these reports expect.
FINGERPRINTS = (
    "tensor_key,layer,category,state_type,numel,mean,stddev,skewness,excess_kurtosis,median,q1,q3,iqr,input_bytes,"
    "peak_live_device_bytes,reserved_device_bytes,allocator_high_watermark_bytes,device_allocation_time_ms,pinned_allocation_time_ms,"
    "host_to_device_time_ms,moments_time_ms,mean_time_ms,std_time_ms,skewness_time_ms,kurtosis_time_ms,sort_time_ms,quantile_time_ms,"
    "total_time_ms,moments_result_bytes,sort_scratch_bytes,quantile_result_bytes,fingerprint_result_bytes"
).split(",")
SIMILARITY = (
    "state_type,category,anchor_layer,compare_layer,anchor_tensor_key,compare_tensor_key,similarity_pct,mean_similarity_pct,"
    "std_similarity_pct,skew_similarity_pct,kurt_similarity_pct,median_similarity_pct,iqr_similarity_pct,ks_similarity_pct,mean_weight,"
    "std_weight,skew_weight,kurt_weight,median_weight,iqr_weight,ks_weight,ks_sort_time_ms,ks_gap_time_ms,comparison_time_ms"
).split(",")
TENSOR_SIZES = (
    "state_type,category,group_id,layer,is_representative,dtype,numel,masked_mantissa_bits,original_size_mb,masked_only_size_mb,"
    "cfg_payload_size_mb,grammar_size_mb_charged,lossy_compressed_size_mb,residual_raw_size_mb,masking_only_ratio,compression_ratio,"
    "compressed_token_count,rule_count,time_ms"
).split(",")
GROUP_SIZES = (
    "state_type,category,group_id,layers,representative_layer,dtype,masked_mantissa_bits,rule_count,max_pair_frequency,"
    "original_group_size_mb,masked_only_group_size_mb,cfg_payload_group_size_mb,grammar_size_mb,lossy_compressed_group_size_mb,"
    "residual_raw_group_size_mb,masking_only_ratio,compression_ratio,total_time_ms"
).split(",")
#: Device and timing columns that Spark doesn't measure; they hold 0.
UNMEASURED = ("_time_ms", "time_ms", "_bytes")
_PARTS = (("mean", "mean"), ("std", "stddev"), ("skew", "skewness"), ("kurt", "excess_kurtosis"), ("median", "median"), ("iqr", "iqr"), ("ks", "ks"))


def write(rows: DataFrame, path: str, header: list[str]) -> None:
    """``rows`` in the order of ``header``. Columns of times and device bytes may be missing (0), others not."""
    have = set(rows.columns)
    missing = [c for c in header if c not in have and not c.endswith(UNMEASURED)]
    if missing:
        raise ValueError(f"report without {', '.join(missing)}")
    rows.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in header]).write.mode("overwrite").csv(path, header=True)


def fingerprints(prints: DataFrame, tensors: DataFrame) -> DataFrame:
    """``stats.fingerprint10`` with the tensors' keys: the data columns of FINGERPRINTS."""
    t = tensors.select(F.col("tensor_id").alias("tensor_key"), "layer", "category", "state_type")
    p = prints.withColumnRenamed("tensor_id", "_id").withColumnRenamed("n", "numel")
    return p.join(t, F.col("_id") == F.col("tensor_key")).drop("_id").withColumn("input_bytes", F.col("numel") * 4)


def similarity(pairwise: DataFrame, tensors: DataFrame) -> DataFrame:
    """``similarity.pairwise`` with both tensors' layers and the uniform weights: the columns of SIMILARITY."""
    a = tensors.select("state_type", "category", F.col("layer").alias("anchor_layer"), F.col("tensor_id").alias("_a"))
    b = tensors.select(F.col("layer").alias("compare_layer"), F.col("tensor_id").alias("_b"))
    j = pairwise.join(a, F.col("t1") == F.col("_a")).join(b, F.col("t2") == F.col("_b"))
    parts = [F.col(f"sim_{own}").alias(f"{name}_similarity_pct") for name, own in _PARTS]
    even = [F.lit(1 / len(_PARTS)).alias(f"{name}_weight") for name, _ in _PARTS]
    keys = [F.col("t1").alias("anchor_tensor_key"), F.col("t2").alias("compare_tensor_key"), F.col("similarity").alias("similarity_pct")]
    return j.select("state_type", "category", "anchor_layer", "compare_layer", *keys, *parts, *even)


def tensor_sizes(rows: DataFrame) -> DataFrame:
    """``codec.shared_grammar`` with keys, layer and dtype: the columns of TENSOR_SIZES."""
    mb = {"original_size_mb": "original_bytes", "masked_only_size_mb": "masked_only_bytes", "cfg_payload_size_mb": "payload_bytes", "grammar_size_mb_charged": "grammar_bytes", "lossy_compressed_size_mb": "lossy_bytes", "residual_raw_size_mb": "residual_bytes"}
    own = [F.col("n").alias("numel"), F.col("masked_bits").alias("masked_mantissa_bits"), F.col("n_tokens").alias("compressed_token_count"), F.col("n_rules").alias("rule_count")]
    return rows.select("state_type", "category", "group_id", "layer", "is_representative", "dtype", *own, *[megabytes(F.col(c)).alias(n) for n, c in mb.items()], "masking_only_ratio", "compression_ratio", F.lit(0.0).alias("time_ms"))


def group_sizes(rows: DataFrame) -> DataFrame:
    """``codec.grammar_groups`` with keys and dtype: the columns of GROUP_SIZES."""
    mb = {
        "original_group_size_mb": "original_bytes", "masked_only_group_size_mb": "masked_only_bytes", "cfg_payload_group_size_mb": "payload_bytes",
        "grammar_size_mb": "grammar_bytes", "lossy_compressed_group_size_mb": "lossy_bytes", "residual_raw_group_size_mb": "residual_bytes",
    }
    own = [F.col("masked_bits").alias("masked_mantissa_bits"), F.col("n_rules").alias("rule_count")]
    return rows.select("state_type", "category", "group_id", "layers", "representative_layer", "dtype", *own, "max_pair_frequency", *[megabytes(F.col(c)).alias(n) for n, c in mb.items()], "masking_only_ratio", "compression_ratio", F.lit(0.0).alias("total_time_ms"))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (part, place, line) as text, in order; a report is short."""
    lines.repartition(1).sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _fixed(c, digits: int) -> Column:
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def _texts(one: DataFrame, part: int, lines: list[Column]) -> DataFrame:
    """Each row's lines, numbered."""
    return one.select(F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("_i", "line"), F.monotonically_increasing_id().alias("_row")).select("part", (F.col("_row") * 1000 + F.col("_i")).alias("place"), "line")


def grammar_summary(groups: DataFrame, state_type=None, category=None, group_id=None, masked_bits=None, max_rules: int = 50) -> DataFrame:
    """Lines of the summary of shared grammars: settings, a line a group, and totals with their ratios."""
    spark = groups.sparkSession
    shown = lambda x, otherwise: otherwise if x is None else str(x)
    head = [
        "transform_mode: shared_group_mantissa_mask_cfg", f"state_type_filter: {shown(state_type, '<all>')}", f"category_filter: {shown(category, '<all>')}", f"group_id_filter: {shown(group_id, '<all>')}",
        f"masked_mantissa_bits_request: {shown(masked_bits, 'all_mantissa_bits')}", f"max_rules_shared_grammar: {max_rules}", "",
    ]
    top = _texts(spark.range(1), 0, [F.lit(x) for x in head])
    mb = lambda c: _fixed(megabytes(F.col(c)), 6)
    sizes = {
        "original_group_size_mb": "original_bytes", "masked_only_group_size_mb": "masked_only_bytes", "cfg_payload_group_size_mb": "payload_bytes", "grammar_size_mb": "grammar_bytes",
        "lossy_compressed_group_size_mb": "lossy_bytes", "residual_raw_group_size_mb": "residual_bytes",
    }
    parts = [F.col("grp"), ": layers=", F.col("layers"), ", representative_layer=", F.col("representative_layer").cast("string"), ", dtype=", F.col("dtype"), ", masked_mantissa_bits=", F.col("masked_bits").cast("string"), ", rule_count=", F.col("n_rules").cast("string")]
    for name, c in sizes.items():
        parts += [f", {name}=", mb(c)]
    parts += [", masking_only_ratio=", _fixed("masking_only_ratio", 6), ", compression_ratio=", _fixed("compression_ratio", 6)]
    each = _texts(groups.orderBy("grp"), 1, [_line(*parts)])
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes.values()])
    names = (("original_size_mb", "original_bytes"), ("masked_only_size_mb", "masked_only_bytes"), ("cfg_payload_size_mb", "payload_bytes"), ("total_grammar_mb", "grammar_bytes"), ("lossy_compressed_size_mb", "lossy_bytes"), ("residual_raw_size_mb", "residual_bytes"))
    ratio = lambda c: _fixed(safe_div(F.col("original_bytes").cast("double"), F.col(c)), 6)
    last = [F.lit(""), *[_line(f"selected_groups_{n}: ", mb(c)) for n, c in names], _line("selected_groups_masking_only_ratio: ", ratio("masked_only_bytes")), _line("selected_groups_compression_ratio: ", ratio("lossy_bytes"))]
    return top.unionByName(each).unionByName(_texts(total, 2, last))


def stream_report(summary: DataFrame, stream: str) -> DataFrame:
    """Lines of one stream's report: its tensors with their symbol statistics, then the global summary."""
    whole = lambda c: F.format_number(F.col(c), 0)
    bar = "=" * 80
    each = [
        F.lit(bar), F.lit(f"STREAM: {stream}"), _line("Tensor: ", F.col("tensor_id")), _line("Elements: ", whole("numel")), _line("Tensor Bytes: ", whole("tensor_bytes")), _line("Unique Values: ", whole("n_unique")),
        _line("Unique Ratio: ", _fixed("unique_ratio", 6)), _line("Entropy: ", _fixed("entropy", 4), " bits/symbol"), _line("Estimated Compressed Bytes: ", whole("estimated_bytes")), _line("Histogram Bytes: ", whole("hist_bytes_e1")),
        _line("Histogram/Tensor Ratio: ", _fixed("hist_ratio", 4)), F.lit(""),
    ]
    order = F.struct("hist_ratio", "tensor_id")
    t = summary.agg(
        F.count(F.lit(1)).alias("n"), F.avg("unique_ratio").alias("u"), F.avg("entropy").alias("e"), F.sum("tensor_bytes").alias("t"), F.sum("hist_bytes_e1").alias("h"),
        F.max(order).alias("hi"), F.min(order).alias("lo"),
    ).filter("n > 0")
    extreme = lambda title, s: [F.lit(f"{title} histogram ratio:"), _line("  ", F.col(f"{s}.tensor_id")), _line("  ratio=", _fixed(F.col(f"{s}.hist_ratio"), 4)), F.lit("")]
    last = [
        F.lit(bar), F.lit(f"GLOBAL SUMMARY: {stream}"), F.lit(bar), F.lit(""), _line("Total tensors: ", F.col("n").cast("string")), _line("Average unique ratio: ", _fixed("u", 6)), _line("Average entropy: ", _fixed("e", 4)),
        _line("Total tensor bytes: ", whole("t")), _line("Total histogram bytes: ", whole("h")), _line("Histogram/Tensor ratio: ", _fixed(F.col("h") / F.col("t"), 4)), F.lit(""), *extreme("Largest", "hi"), *extreme("Smallest", "lo"),
    ]
    return _texts(summary.orderBy("tensor_id"), 0, each).unionByName(_texts(t, 1, last))


def savings_report(s: DataFrame, stream: str) -> DataFrame:
    """Lines of ``groups.savings``."""
    whole = lambda c: F.format_number(F.col(c), 0)
    names = (("Baseline histogram bytes", "baseline_bytes"), ("Cluster-only bytes", "cluster_bytes"), ("Singleton bytes", "singleton_bytes"), ("TOTAL compressed", "total_bytes"), ("Savings", "saved_bytes"))
    head = [F.lit(f"STREAM: {stream}"), _line("Clusters: ", F.col("n_clusters").cast("string")), _line("Singletons: ", F.col("n_singletons").cast("string")), F.lit(""), F.lit("--- SAVINGS ---")]
    return _texts(s, 0, [*head, *[_line(f"{n}: ", whole(c)) for n, c in names], _line("Ratio: ", _fixed("ratio", 4))])


def cross_entropy_report(x: DataFrame) -> DataFrame:
    """Lines of ``groups.cross_entropy``: baseline, clustered, and the effect of clustering."""
    gb = lambda c: _fixed(c / 1e9, 3)
    share = lambda c: _fixed(safe_div(c.cast("double"), F.col("raw_bytes")), 4)
    block = lambda title, s, m: [F.lit(f"--- {title} ---"), *[_line(f"  {n}: ", gb(c), " GB  (", share(c), "x raw)") for n, c in (("XE stream", F.col(s)), ("Model", F.col(m)), ("Total", F.col(s) + F.col(m)))], F.lit("")]
    effect = [_line(f"{n}: ", _fixed(F.col(c) / 1e6, 1), " MB  (", share(F.col(c)), "x raw)") for n, c in (("  Model savings", "model_savings"), ("  XE penalty", "stream_penalty"), ("  Net gain", "net_gain"))]
    lines = [*block("BASELINE  (per-tensor model, own data)", "own_stream_bytes", "own_model_bytes"), *block("CLUSTERED (shared model per cluster)", "shared_stream_bytes", "shared_model_bytes"), F.lit("--- CLUSTER EFFECT ---"), *effect]
    return _texts(x, 0, lines)


def memory_report(tensors: DataFrame) -> DataFrame:
    """Lines of the catalog's memory (name, num_elements, byte_size, layout, total): each tensor by name, and totals."""
    n = lambda c: F.col(c).cast("string")
    each = _line("[mem] [", F.col("name"), "] elements=", n("num_elements"), " bytes=", n("byte_size"), " layout=", F.col("layout"), " buf_total=", n("total"))
    t = tensors.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("b"), F.coalesce(F.sum("total"), F.lit(0)).alias("p"))
    last = [_line("Total tensor data : ", n("b"), " B (", F.shiftright("b", 20).cast("string"), " MiB)"), _line("Total slab alloc  : ", n("p"), " B (", F.shiftright("p", 10).cast("string"), " KiB)")]
    return _texts(tensors.orderBy("name"), 0, [each]).unionByName(_texts(t, 1, last))


def tables_report(t: DataFrame) -> DataFrame:
    """Lines of ``codec.compare_tables``: sizes with a table of their own and with one per cluster."""
    whole = lambda c: F.format_number(F.col(c), 0)
    block = lambda title, x: [F.lit(f"--- {title} ---"), *[_line(f"  {n}: ", whole(f"{x}_{c}_bytes")) for n, c in (("Streams", "stream"), ("Tables", "table"), ("Total", "total"))], _line("  Ratio: ", _fixed(f"{x}_ratio", 4)), F.lit("")]
    better = F.when(F.col("shared_total_bytes") < F.col("own_total_bytes"), "clustered").otherwise("per tensor")
    return _texts(t, 0, [_line("Raw bytes: ", whole("raw_bytes")), F.lit(""), *block("PER TENSOR", "own"), *block("CLUSTERED", "shared"), _line("Smaller: ", better)])


def demo_report(prints: DataFrame) -> DataFrame:
    """Lines of one tensor's fingerprint (``stats.fingerprint10``)."""
    names = (("Mean", "mean"), ("StdDev", "stddev"), ("Skewness", "skewness"), ("Excess Kurtosis", "excess_kurtosis"), ("Median", "median"), ("IQR", "iqr"))
    return _texts(prints, 0, [F.lit("=== STATISTICAL FINGERPRINT ==="), _line("Tensor Target Size: ", F.col("n").cast("string"), " elements"), *[_line(f"{n}: ", _fixed(c, 6)) for n, c in names]])
