"""Queries of the codecs: tables, round trips, grammars, compression of a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import api
from tessera.functions import bits
from tessera.operators import codec, groups, symbols
from tessera.plans.scratch import folder
from tessera.registry import _EMB, _NUM, _SYM, ORACLE_SQL, _counts, query
from tessera.sources import tensors

_LE = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"
_WORDS = f"""{_EMB}, w AS (SELECT tensor_id, state_type, category, layer, pos, b, printf('%08x', b) AS h FROM (
  SELECT tensor_id, state_type, category, layer, pos, CASE WHEN b < 0 THEN b + 4294967296 ELSE b END AS b FROM (SELECT *, value::FLOAT::BIT::INTEGER::BIGINT AS b FROM src)))"""


def _words(spark, sf_dir):
    return tensors.embeddings(spark, sf_dir).select("tensor_id", "state_type", "category", "layer", "pos", bits.float_bits("value").alias("word"))


@query(f"""{_NUM}, {_SYM}, b AS (SELECT DISTINCT tensor_id, CAST((sym >> k) & 255 AS INTEGER) AS byte FROM cnt, (SELECT unnest([0, 8, 16, 24]) AS k))
SELECT tensor_id, count(*) AS n_bytes, 4096 AS slots, min(byte) AS first_byte, true AS consistent FROM b GROUP BY 1""")
def rans_tables(spark, sf_dir):
    """Normalised tables: the bytes that occur share 4096 slots, and running sums follow from them."""
    t = codec.rans_tables(symbols.byte_counts(_counts(spark, sf_dir)))
    last = F.max_by(F.col("cum_freq") + F.col("norm_freq"), "byte")
    right = F.bool_and((F.col("norm_freq") > 0) & (F.col("x_max") == F.col("norm_freq") * (1 << 19))) & (last == F.sum("norm_freq")) & (F.min_by("cum_freq", "byte") == 0)
    return t.groupBy("tensor_id").agg(F.count(F.lit(1)).alias("n_bytes"), F.sum("norm_freq").cast("int").alias("slots"), F.min("byte").alias("first_byte"), right.alias("consistent"))


def _coded(spark, sf_dir):
    return codec.roundtrip(_words(spark, sf_dir).select("tensor_id", "pos", "word").withColumn("chunk", F.floor(F.col("pos") / codec.CHUNK_SYMBOLS)))


@query()
def codec_roundtrip(spark, sf_dir):
    return _coded(spark, sf_dir)


@query(f"""{_WORDS}, s AS (SELECT tensor_id, pos // 2000000 AS chunk, count(*) AS n, count(DISTINCT b) AS k FROM w GROUP BY ALL)
SELECT tensor_id, chunk, n, 2 * n AS sidecar_bytes, k AS tans_symbols, CAST(CASE WHEN k <= 1 THEN 4 ELSE least(16, greatest(8, ceil(log2(k)))) END AS INTEGER) AS tans_log, CAST(0 AS BIGINT) AS rans_mismatches, CAST(0 AS BIGINT) AS tans_mismatches, CAST(4096 AS BIGINT) AS freq_sum, true AS within FROM s""")
def codec_check(spark, sf_dir):
    """What SQL can say of codec_roundtrip: no wrong symbols, whole tables, and coded sizes within bounds."""
    within = (F.col("rans_bytes") <= 2 * F.col("n")) & (F.col("tans_bits") <= 32 * F.col("n"))
    return _coded(spark, sf_dir).select("tensor_id", "chunk", "n", "sidecar_bytes", "tans_symbols", "tans_log", "rans_mismatches", "tans_mismatches", "freq_sum", within.alias("within"))


@query()
def codec_shared_tables(spark, sf_dir):
    t = _words(spark, sf_dir).select(F.concat_ws("/", "state_type", "category").alias("cluster"), "tensor_id", "pos", "word")
    return codec.shared_tables(t.withColumn("chunk", F.floor(F.col("pos") / codec.CHUNK_SYMBOLS)))


@query(f"{_WORDS} SELECT tensor_id, count(*) AS n, sha256(unhex(string_agg({_LE}, '' ORDER BY pos))) AS sha256 FROM w GROUP BY 1")
def tans_streams(spark, sf_dir):
    """Whole words through chunked tANS streams and back."""
    streams, tables = codec.tans_streams(_words(spark, sf_dir).select(F.col("tensor_id").alias("cluster"), "tensor_id", "pos", "word"))
    back = codec.tans_words(streams, tables)
    whole = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("chunk", F.hex("words").alias("h")))), lambda x: x["h"]))
    return back.groupBy("tensor_id").agg(F.sum(F.octet_length("words") / 4).cast("long").alias("n"), F.sha2(F.unhex(whole), 256).alias("sha256"))


def _catalog_of(spark, sf_dir):
    return api.load_catalog(spark, tensors.embeddings(spark, sf_dir).withColumn("rank", F.col("layer")))


@query(f"SELECT rank, name, num_elements, sha256 FROM ({ORACLE_SQL['container_roundtrip']})")
def coded_container_roundtrip(spark, sf_dir):
    """A catalog analysed, compressed into containers with its clusters' tables, read and decoded to the words that went in."""
    root, c = folder(spark, "coded"), _catalog_of(spark, sf_dir)
    api.compress(c, api.analyze(c).clusters, root)
    return api.decompress(spark, root).select("rank", "name", (F.octet_length("words") / 4).cast("long").alias("num_elements"), F.sha2("words", 256).alias("sha256"))


@query(f"{_EMB} SELECT count(DISTINCT tensor_id) AS chunks, 4 * count(*) AS tensor_bytes, 2 * count(*) AS masked_bytes, 2 * count(*) AS sidecar_bytes, true AS smaller FROM src")
def compression_ratios(spark, sf_dir):
    """Sizes of the compressed catalog; coded bytes are never more than the masked ones."""
    c = _catalog_of(spark, sf_dir)
    r = api.compress(c, api.analyze(c).clusters, folder(spark, "ratios"))
    return r.select("chunks", "tensor_bytes", "masked_bytes", "sidecar_bytes", ((F.col("ans_ratio") >= 1) & (F.col("disk_ratio") >= 1)).alias("smaller"))


def _groups(spark, sf_dir):
    t = _words(spark, sf_dir)
    grp = F.concat_ws("/", "state_type", "category").alias("grp")
    return t.select(grp, "tensor_id", F.col("layer").alias("place"), (F.col("layer") == 1).alias("is_representative"), "pos", "word")


@query()
def shared_grammar(spark, sf_dir):
    return codec.shared_grammar(_groups(spark, sf_dir))


@query(f"""{_WORDS} SELECT state_type || '/' || category AS grp, tensor_id, CAST(any_value(layer) AS INTEGER) AS place, any_value(layer) = 1 AS is_representative, count(*) AS n, 23 AS masked_bits, 4 * count(*) AS original_bytes,
  CAST((count(*) * 9 + 7) // 8 AS BIGINT) AS masked_only_bytes, CAST((count(*) * 23 + 7) // 8 AS BIGINT) AS residual_bytes, sha256(unhex(string_agg({_LE}, '' ORDER BY pos))) AS restored_sha256 FROM w GROUP BY ALL""")
def grammar_sizes(spark, sf_dir):
    """What SQL can say of shared_grammar: sizes, and that tokens, rules and residual give the words again."""
    return shared_grammar(spark, sf_dir).select("grp", "tensor_id", "place", "is_representative", "n", "masked_bits", "original_bytes", "masked_only_bytes", "residual_bytes", "restored_sha256")


@query(f"""{_WORDS} SELECT state_type || '/' || category AS grp, string_agg(DISTINCT layer::VARCHAR, ' ' ORDER BY layer::VARCHAR) AS layers, 1 AS representative_layer, 0 AS n_rules, 4 * count(*) AS original_bytes,
  CAST(sum(9) AS BIGINT) * 0 + CAST((SELECT sum((n * 9 + 7) // 8) FROM (SELECT tensor_id, count(*) AS n FROM w w2 WHERE w2.state_type = w.state_type AND w2.category = w.category GROUP BY 1)) AS BIGINT) AS lossy_bytes FROM w GROUP BY state_type, category""")
def grammar_without_rules(spark, sf_dir):
    """Groups coded without a rule: the payload is what masking leaves."""
    return codec.grammar_groups(codec.shared_grammar(_groups(spark, sf_dir), max_rules=0)).select("grp", "layers", "representative_layer", "n_rules", "original_bytes", "lossy_bytes")


_TYPES = "CASE pos % 4 WHEN 0 THEN 'float32' WHEN 1 THEN 'float16' WHEN 2 THEN 'bfloat16' ELSE 'int8' END"


@query(f"""{_WORDS}, t AS (SELECT tensor_id, pos, {_TYPES} AS dtype, b, CASE pos % 4 WHEN 0 THEN b WHEN 3 THEN b % 256 ELSE b // 65536 END AS word FROM w)
SELECT dtype, count(*) AS n, CAST(sum(word - CASE dtype WHEN 'float32' THEN word % 65536 WHEN 'int8' THEN 0 ELSE word % 256 END) AS BIGINT) AS masked, CAST(sum(CASE dtype WHEN 'float32' THEN word % 65536 WHEN 'int8' THEN 0 ELSE word % 256 END) AS BIGINT) AS side,
  CAST(sum(CASE WHEN dtype = 'int8' THEN CASE WHEN word >= 128 THEN word - 256 ELSE word END WHEN dtype = 'bfloat16' THEN CASE WHEN word >= 32768 THEN -1 ELSE 1 END ELSE 0 END) AS BIGINT) AS signs FROM t GROUP BY 1""")
def word_types(spark, sf_dir):
    """Words of four types: their masked parts, sidecars, and values as far as SQL can tell."""
    w = _words(spark, sf_dir).withColumn("dtype", F.expr(_TYPES)).withColumn("word", F.expr("CASE pos % 4 WHEN 0 THEN word WHEN 3 THEN word % 256 ELSE word div 65536 END"))
    masked, side = bits.split_word(F.col("word"), F.col("dtype"))
    value = bits.to_float(F.col("word"), F.col("dtype"))
    sign = F.when(F.col("dtype") == "int8", value.cast("long")).when(F.col("dtype") == "bfloat16", F.when(F.signum(value) < 0, -1).otherwise(1)).otherwise(0)
    return w.groupBy("dtype").agg(F.count(F.lit(1)).alias("n"), F.sum(masked).alias("masked"), F.sum(side).alias("side"), F.sum(sign).cast("long").alias("signs"))




@query(f"""{_WORDS}, v AS (SELECT tensor_id, pos // 2000000 AS chunk, count(DISTINCT b) AS k, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT state_type, category, count(DISTINCT b) AS k FROM w GROUP BY ALL)
SELECT CAST(4 * (SELECT sum(n) FROM v) AS BIGINT) AS raw_bytes, CAST(8 * (SELECT sum(k) FROM v) AS BIGINT) AS own_table_bytes, CAST(8 * (SELECT sum(k) FROM c) AS BIGINT) AS shared_table_bytes, true AS smaller""")
def table_comparison(spark, sf_dir):
    """Tables per tensor against tables per cluster: table bytes, and that streams are shorter than the words."""
    t = codec.compare_tables(codec_shared_tables(spark, sf_dir))
    return t.select("raw_bytes", "own_table_bytes", "shared_table_bytes", ((F.col("own_stream_bytes") < F.col("raw_bytes")) & (F.col("shared_stream_bytes") < F.col("raw_bytes"))).alias("smaller"))


@query()
def kmeans_symbols(spark, sf_dir):
    """Groups by unique ratio and entropy alone."""
    return groups.kmeans(symbols.summary(_counts(spark, sf_dir)), ["unique_ratio", "entropy"]).select("tensor_id", "grp", "size")


@query(f"{_NUM} SELECT count(DISTINCT tensor_id) AS n, true AS grouped, true AS alone FROM src")
def kmeans_check(spark, sf_dir):
    """What SQL can say of the groups: every tensor is in one, of eight or n / 40; the others are alone."""
    out = kmeans_symbols(spark, sf_dir)
    n = F.count(F.lit(1))
    return out.agg(n.alias("n"), (F.countDistinct("grp") <= F.greatest(F.lit(8), F.floor(n / 40))).alias("grouped"), F.bool_and(F.col("grp").isNull() == (F.col("size") == 1)).alias("alone"))
