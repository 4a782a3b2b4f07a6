"""The engine's entry points: a catalog of tensors, its analysis, and its compression.

    c = load_catalog(spark, elements)
    a = analyze(c)
    compress(c, a.clusters, path)
    decompress(spark, path)

``export_report`` and ``mask_repair`` work on an exported folder (manifest.csv and raw files).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import bits, dtypes
from tessera.operators import codec, similarity, stats
from tessera.plans.scratch import materialise
from tessera.sources import catalog, containers, reports, tensors


@dataclass(frozen=True)
class Catalog:
    """elements: tensor_id, state_type, category, layer, rank, pos, value; tensors: one row each."""

    elements: DataFrame
    tensors: DataFrame
    histogram_bins: int


@dataclass(frozen=True)
class Analysis:
    fingerprints: DataFrame
    histograms: DataFrame
    weights: DataFrame
    clusters: DataFrame


def load_catalog(spark: SparkSession, source: DataFrame | str, histogram_bins: int = 256) -> Catalog:
    """A catalog of tensor elements, a table or its path. Columns that are missing get defaults (layer and
    rank 0, state_type and category from the name); tensors without elements aren't in it."""
    if histogram_bins <= 0:
        raise ValueError("histogram_bins: 1 at least")
    rows = spark.read.parquet(source) if isinstance(source, str) else source
    have = set(rows.columns)
    defaults = {"state_type": dtypes.category(F.col("tensor_id")), "category": bits.role(F.col("tensor_id")), "layer": F.lit(0), "rank": F.lit(0)}
    rows = rows.select("tensor_id", *[F.col(c) if c in have else d.alias(c) for c, d in defaults.items()], F.col("pos").cast("long").alias("pos"), F.col("value").cast("float").alias("value"))
    one = rows.groupBy("tensor_id").agg(*[F.first(c).alias(c) for c in defaults], F.count(F.lit(1)).alias("num_elements"))
    return Catalog(rows, one.withColumn("byte_size", F.col("num_elements") * 4), histogram_bins)


def analyze(c: Catalog) -> Analysis:
    """Fingerprints, histograms, importance of the fingerprint's dimensions, and numbered clusters with
    anchors by category (state_type). An empty catalog gives empty tables."""
    prints = materialise(stats.fingerprint5(c.elements), "fingerprints")
    named = prints.join(c.tensors.select("tensor_id", "state_type"), "tensor_id")
    return Analysis(prints, stats.histogram(c.elements, c.histogram_bins), similarity.weights(prints), catalog.cluster_ids(similarity.clusters(named)))


def compress(c: Catalog, clusters: DataFrame, path: str) -> DataFrame:
    """Write coded states, sidecars and tables of every rank under ``path``; one row of sizes and ratios.

    First each cluster's anchor builds its table, then every chunk is coded with the table of its cluster;
    tensors of no cluster (-1) have their own. ``clusters``: tensor_id, cluster_id.
    """
    named = clusters.select(F.col("tensor_id").alias("_t"), "cluster_id")
    rows = c.elements.join(named, F.col("tensor_id") == F.col("_t"), "left")
    alone = F.coalesce("cluster_id", F.lit(-1)) < 0
    cluster = F.when(alone, F.concat(F.lit("tensor "), "tensor_id")).otherwise(F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))
    rows = rows.select("rank", cluster.alias("cluster"), "tensor_id", F.floor(F.col("pos") / containers.CHUNK).alias("chunk"), "pos", bits.float_bits("value").alias("word"))
    coded = materialise(codec.coded(rows), "coded")
    # The places need names alone; the data isn't sorted along.
    place = (F.row_number().over(W.partitionBy("rank").orderBy("name")) - 1).cast("long").alias("place")
    placed = coded.select(F.col("rank").alias("_r"), F.col("name").alias("_n"), place).join(coded, F.col("rank").eqNullSafe(F.col("_r")) & (F.col("name") == F.col("_n")))
    dtype = F.lit(containers.DTYPES["float32"]).alias("dtype")
    containers.states.write(placed.withColumn("dtype", dtype).select(*[f.split()[0] for f in containers.STATES.split(", ")]), path)
    containers.sidecars.write(placed.select("rank", "place", "name", dtype, F.lit(2).alias("bytes_per_elem"), "num_elements", F.col("side").alias("data")), path)
    own = coded.groupBy("anchor_name").agg(F.min("rank").alias("rank"), F.first("norm_freq").alias("norm_freq"))
    number = (F.row_number().over(W.partitionBy("rank").orderBy("anchor_name")) - 1).cast("long").alias("place")
    containers.tables.write(own.select("rank", number, "anchor_name", "norm_freq", F.lit(None).cast("array<long>").alias("cum_freq")), path)
    return ratios(coded)


def ratios(coded: DataFrame) -> DataFrame:
    """One row over coded chunks: tensor bytes, coded bytes, sidecar bytes, ans_ratio (masked bytes to coded
    ones) and disk_ratio (all bytes to coded ones and sidecars); 0 of nothing."""
    t = coded.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("masked_bytes", F.col("original_bytes")), ("coded_bytes", F.octet_length("data")), ("sidecar_bytes", F.octet_length("side")), ("chunks", F.lit(1)), ("raw_chunks", F.col("is_raw").cast("long")))])
    t = t.withColumn("tensor_bytes", F.col("masked_bytes") + F.col("sidecar_bytes"))
    return t.withColumn("ans_ratio", bits.safe_div(F.col("masked_bytes").cast("double"), F.col("coded_bytes"))).withColumn("disk_ratio", bits.safe_div(F.col("tensor_bytes").cast("double"), F.col("coded_bytes") + F.col("sidecar_bytes")))


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """rank, name, words (little-endian bytes) of every chunk under ``path``. A file that is damaged or lacks
    its sidecar or table raises or gives no row."""
    side = containers.sidecars.read(spark, path).select(F.col("rank").alias("_r"), F.col("name").alias("_n"), F.col("data").alias("side"))
    table = containers.tables.read(spark, path).select(F.col("anchor_name").alias("_a"), "norm_freq")
    back = containers.states.read(spark, path).join(side, (F.col("rank") == F.col("_r")) & (F.col("name") == F.col("_n"))).join(table, F.col("anchor_name") == F.col("_a"))
    return codec.decoded(back.drop("_r", "_n", "_a"))


def export_elements(spark: SparkSession, export_dir: str) -> tuple[DataFrame, DataFrame]:
    """(elements, manifest) of an exported folder; raw files are read as float32. Files that aren't the
    manifest's size raise."""
    m = materialise(tensors.manifest(spark, f"{export_dir}/manifest.csv"), "manifest")
    words = tensors.raw_words(spark, f"{export_dir}/**/*.bin", expected=m.select("file_path", "numel"))
    name = F.expr("substring_index(path, '/', -1)")
    keyed = m.select("tensor_key", "state_type", "category", "layer", F.expr("substring_index(file_path, '/', -1)").alias("_f"))
    j = words.withColumn("_n", name).join(keyed, F.col("_n") == F.col("_f"))
    return j.select(F.col("tensor_key").alias("tensor_id"), "state_type", "category", "layer", "pos", "word", bits.float_value("word").alias("value")), m


def export_report(spark: SparkSession, export_dir: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints and pairwise similarities of an exported folder, written as CSV under ``out``."""
    elements, _ = export_elements(spark, export_dir)
    elements = materialise(elements, "elements")
    t = elements.groupBy("tensor_id").agg(F.first("state_type").alias("state_type"), F.first("category").alias("category"), F.first("layer").alias("layer"))
    prints = materialise(stats.fingerprint10(elements), "prints")
    pairs = materialise(similarity.pairs(t), "pairs")
    pairwise = similarity.pairwise(prints, pairs, similarity.ks(elements, pairs))
    a, b = reports.fingerprints(prints, t), reports.similarity(pairwise, t)
    reports.write(a, f"{out}/fingerprints.csv", reports.FINGERPRINTS)
    reports.write(b, f"{out}/pairwise_similarity.csv", reports.SIMILARITY)
    return a, b


def mask_repair(spark: SparkSession, export_dir: str, out: str, state_type: str | None = None, category: str | None = None, group_id: int | None = None, max_rules: int = 50, masked_mantissa_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sizes of the groups of an exported folder under shared grammars of masked words, per tensor and per
    group, as CSV and text under ``out``. A member without a manifest line raises, and so does a group of
    several dtypes; groups are read from analysis/plots/grouping_summary.csv."""
    elements, m = export_elements(spark, export_dir)
    g = tensors.grouping(spark, f"{export_dir}/analysis/plots/grouping_summary.csv", state_type, category, group_id)
    members = catalog.strict_lookup(g, m.select("state_type", "category", "layer", "tensor_key", "dtype"), ["state_type", "category", "layer"])
    members = materialise(catalog.same_dtype(members, ["state_type", "category", "group_id"]), "members")
    grp = F.concat_ws("/", "state_type", "category", F.concat(F.lit("group_"), F.col("group_id").cast("string")))
    named = members.select(grp.alias("grp"), F.col("tensor_key").alias("tensor_id"), "place", (F.col("layer") == F.col("representative_layer")).alias("is_representative"))
    per = materialise(codec.shared_grammar(named.join(elements.select("tensor_id", "pos", "word"), "tensor_id"), max_rules, masked_mantissa_bits), "grammar")
    key = members.select(grp.alias("_g"), F.col("tensor_key").alias("_t"), "state_type", "category", "group_id", "layer", "dtype")
    per_tensor = per.join(key, (F.col("grp") == F.col("_g")) & (F.col("tensor_id") == F.col("_t")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "layer"))), lambda x: x["layer"].cast("string"))
    named = members.groupBy(grp.alias("_g"), "state_type", "category", "group_id", "dtype").agg(F.array_join(listed, " ").alias("layers"), F.first("representative_layer").alias("representative_layer"))
    groups = codec.grammar_groups(per).drop("layers", "representative_layer").join(named, F.col("grp") == F.col("_g"))
    a, b = reports.tensor_sizes(per_tensor), reports.group_sizes(groups)
    reports.write(a, f"{out}/tensor_prefix_mask_repair.csv", reports.TENSOR_SIZES)
    reports.write(b, f"{out}/group_prefix_mask_repair.csv", reports.GROUP_SIZES)
    reports.write_text(reports.grammar_summary(groups, state_type, category, group_id, masked_mantissa_bits, max_rules), f"{out}/checkpoint_prefix_mask_repair_summary.txt")
    return a, b


def demo(spark: SparkSession, n: int = 16 << 20) -> list[str]:
    """Lines of the fingerprint of ``n`` generated values."""
    t = catalog.synthetic(spark, n).withColumn("tensor_id", F.lit("demo"))
    return [r["line"] for r in reports.demo_report(stats.fingerprint10(t)).orderBy("part", "place").collect()]
