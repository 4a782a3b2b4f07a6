"""Queries of the tensors catalog: scans, shards, layouts, groups and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bits, dtypes
from tessera.operators import groups, similarity, stats, symbols
from tessera.plans.running import running_total
from tessera.registry import _EMB, _NUM, _SYM, _XE, ORACLE_SQL, _catalog, _counts, _plan, query, rounded
from tessera.sources import catalog, tensors


def _part(spark, sf_dir, **columns: str):
    """The part table's key and columns by SQL expressions that Spark and the oracle both understand."""
    return spark.sql(f"SELECT p_partkey AS id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/part.parquet"))


_DTYPES = "CASE p_partkey % 7 WHEN 0 THEN 'torch.float32' WHEN 1 THEN 'torch.float16' WHEN 2 THEN 'torch.bfloat16' WHEN 3 THEN 'torch.int8' WHEN 4 THEN 'torch.int64' WHEN 5 THEN 'float32' ELSE 'bfloat16' END"


@query(f"""WITH d AS (SELECT p_partkey AS id, {_DTYPES} AS text, p_size * 100 AS numel, p_type || '/' || p_brand AS name FROM part),
x AS (SELECT *, CASE WHEN text LIKE '%float32%' THEN 'float32' WHEN text LIKE '%bfloat16%' THEN 'bfloat16' WHEN text LIKE '%float16%' THEN 'float16' WHEN text LIKE '%int8%' THEN 'int8' ELSE 'unknown' END AS dtype FROM d),
y AS (SELECT *, CASE dtype WHEN 'float32' THEN 4 WHEN 'bfloat16' THEN 2 WHEN 'float16' THEN 2 WHEN 'int8' THEN 1 ELSE 0 END AS element_size, CASE dtype WHEN 'float32' THEN 23 WHEN 'bfloat16' THEN 7 WHEN 'float16' THEN 10 END AS mantissa_bits FROM x)
SELECT id, dtype, CAST(element_size AS INTEGER) AS element_size, CAST(coalesce(mantissa_bits, -1) AS INTEGER) AS mantissa_bits, CAST(numel * element_size AS BIGINT) AS logical_bytes,
  CAST(coalesce((numel * (element_size * 8 - mantissa_bits) + 7) // 8, -1) AS BIGINT) AS masked_only_bytes, CAST(coalesce((numel * mantissa_bits + 7) // 8, -1) AS BIGINT) AS residual_bytes,
  CAST(CASE WHEN numel <= 1 THEN 1 ELSE length(bin(CAST(numel - 1 AS BIGINT))) END AS INTEGER) AS index_bits, regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g') AS token, translate(name, '/.', '__') AS safe, '[' || numel || ',2]' AS shape FROM y""")
def dtype_layout(spark, sf_dir):
    p = _part(spark, sf_dir, text=_DTYPES, numel="CAST(p_size * 100 AS BIGINT)", name="p_type || '/' || p_brand").withColumn("dtype", dtypes.parse(F.col("text")))
    size = dtypes.element_size(F.col("dtype"))
    mantissa = F.when(F.col("dtype").isin(*dtypes.LAYOUTS), dtypes.storage(F.col("dtype"))["mantissa_bits"])
    return p.select(
        "id", "dtype", size.alias("element_size"), F.coalesce(mantissa, F.lit(-1)).alias("mantissa_bits"), (F.col("numel") * size).alias("logical_bytes"), F.coalesce(dtypes.bits_to_bytes(F.col("numel") * (size * 8 - mantissa)), F.lit(-1)).alias("masked_only_bytes"),
        F.coalesce(dtypes.bits_to_bytes(F.col("numel") * mantissa), F.lit(-1)).alias("residual_bytes"), bits.bit_length(F.col("numel")).alias("index_bits"), dtypes.sanitize(F.col("name")).alias("token"), dtypes.safe_name(F.col("name")).alias("safe"),
        dtypes.shape_text(F.array(F.col("numel"), F.lit(2).cast("long"))).alias("shape"),
    )


# Parameters by the key: partitioned on ten ranks of eight parts, plain shards, parameters with elements or
# storage alone, data, a mapped tensor, and nothing.
_LOGICAL, _RANK = "CAST(p_size * 100 AS BIGINT)", "CAST(p_partkey % 10 AS INT)"
_KIND = "p_partkey % 7"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size * 100 AS n, p_partkey % 7 AS k, p_partkey % 10 AS rank, (p_size * 100 + 7) // 8 AS part FROM part),
x AS (SELECT *, CASE WHEN k = 0 AND rank * part < n THEN 'ds_tensor.partition' WHEN k = 0 THEN 'parameter' WHEN k = 1 THEN 'ds_tensor' WHEN k IN (2, 3) THEN 'parameter' WHEN k = 4 THEN 'data' WHEN k = 5 THEN 'hp_tensor' END AS source,
  CASE WHEN k = 0 AND rank * part < n THEN 4 WHEN k = 0 THEN 2 WHEN k = 1 THEN 2 WHEN k IN (2, 3) THEN 4 WHEN k = 4 THEN 4 WHEN k = 5 THEN 4 END AS size,
  CASE WHEN k = 0 AND rank * part < n THEN least(part, n - rank * part) * 4 WHEN k = 0 THEN n * 2 WHEN k = 1 THEN n * 2 WHEN k = 2 THEN n * 4 WHEN k = 3 THEN n * 4 + 8 WHEN k = 4 THEN n * 4 WHEN k = 5 THEN n * 4 END AS bytes FROM p)
SELECT 'p' || id AS name, 'float32' AS dtype, coalesce(source, 'none') AS source, CAST(coalesce(size, -1) AS BIGINT) AS element_size, CAST(coalesce(bytes // size, -1) AS BIGINT) AS num_elements, CAST(coalesce(bytes, -1) AS BIGINT) AS byte_size, source IS NULL AS suspect,
  CAST(CASE WHEN source IS NULL THEN -1 WHEN k IN (0, 1) THEN n ELSE bytes // size END AS BIGINT) AS logical_num_elements, CAST(CASE WHEN source IS NULL THEN -1 WHEN k IN (0, 1) THEN n * size ELSE bytes // size * size END AS BIGINT) AS logical_byte_size FROM x""")
def extract_tensors(spark, sf_dir):
    """Where each parameter's bytes come from, and how many elements that are."""
    handle = lambda when, numel, size, untyped="NULL", typed="NULL": f"CASE WHEN {when} THEN named_struct('ptr', true, 'numel', CAST({numel} AS BIGINT), 'element_size', {size}, 'untyped_bytes', CAST({untyped} AS BIGINT), 'typed_bytes', CAST({typed} AS BIGINT)) END"
    params = _part(
        spark, sf_dir, name="concat('p', p_partkey)", dtype="'torch.float32'", rank=_RANK, ds_numel=f"CASE WHEN {_KIND} IN (0, 1) THEN {_LOGICAL} END", partition_numel=f"CASE WHEN {_KIND} = 0 THEN ({_LOGICAL} + 7) div 8 END",
        ds_tensor=handle(f"{_KIND} IN (0, 1)", f"CASE WHEN {_KIND} = 0 THEN 0 ELSE {_LOGICAL} END", f"CASE WHEN {_KIND} = 0 THEN 4 ELSE 2 END"),
        parameter=handle(f"{_KIND} IN (0, 2, 3)", f"CASE WHEN {_KIND} = 3 THEN 0 ELSE {_LOGICAL} END", f"CASE {_KIND} WHEN 0 THEN 2 ELSE 4 END", f"CASE WHEN {_KIND} = 3 THEN {_LOGICAL} * 4 + 8 END"),
        data=handle(f"{_KIND} = 4", "0", "CAST(NULL AS INT)", "NULL", f"{_LOGICAL} * 4"), hp_tensor=handle(f"{_KIND} = 5", _LOGICAL, "4"),
    )
    x = catalog.extract(params)
    bad = catalog.suspect(x).select(F.col("name").alias("_n"), F.lit(True).alias("suspect"))
    x = x.join(bad, F.col("name") == F.col("_n"), "left").drop("_n").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    return x.fillna(-1, ["element_size", "num_elements", "byte_size", "logical_num_elements", "logical_byte_size"]).fillna("none", ["source"])


# Four groups of parameters; every thirteenth isn't trainable, and the flat size is an eighth of the group.
_PARAMS = "WITH p AS (SELECT p_partkey AS id, 'p' || p_partkey AS name, p_partkey % 4 AS g, p_partkey * 7 % 1000003 AS off, CAST(p_size * 100 AS BIGINT) AS n, CAST((p_size * 100 + 7) // 8 AS BIGINT) AS part FROM part WHERE p_partkey % 13 <> 0)"


@query(f"""{_PARAMS}, gr AS (SELECT g, CAST(ceil(sum(n) / 8) AS BIGINT) AS flat FROM p GROUP BY g),
o AS (SELECT p.*, flat, coalesce(sum(n) OVER (PARTITION BY g ORDER BY off, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p JOIN gr USING (g)),
r AS (SELECT *, unnest(range(0, 8)) AS rank FROM o),
m AS (SELECT * FROM r WHERE s + n > rank * flat AND s < (rank + 1) * flat),
c AS (SELECT *, unnest(['model_state', 'master_weights', 'exp_avg', 'exp_avg_sq']) AS category, unnest(['', 'master_weights::', 'optimizer.exp_avg::', 'optimizer.exp_avg_sq::']) AS prefix FROM m)
SELECT CAST(rank AS INTEGER) AS rank, CAST(g AS INTEGER) AS group_id, prefix || name AS name, category, CAST(off AS BIGINT) AS flat_offset, part AS num_elements FROM c WHERE (category <> 'model_state' OR g <> 3) AND (category NOT LIKE 'exp%' OR g <> 2)""")
def zero3_scan(spark, sf_dir):
    """Slices of four flat groups on eight ranks; one group has no model states, another no optimizer's."""
    p = _part(spark, sf_dir, name="concat('p', p_partkey)", group_id="CAST(p_partkey % 4 AS INT)", flat_offset="CAST(p_partkey * 7 % 1000003 AS BIGINT)", ds_numel=_LOGICAL, flat_numel=f"({_LOGICAL} + 7) div 8", requires_grad="p_partkey % 13 <> 0").drop("id")
    size = p.filter("requires_grad").groupBy("group_id").agg(F.ceil(F.sum("ds_numel") / 8).alias("flat_size"))
    g = size.withColumns({"has_model": F.col("group_id") != 3, "has_exp_avg": F.col("group_id") != 2, "has_exp_avg_sq": F.col("group_id") != 2})
    return catalog.flat_group_scan(p, g, 8)


_FLAT = "flat AS (SELECT CAST(l_orderkey % 2 AS INTEGER) AS g, row_number() OVER (PARTITION BY l_orderkey % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, l_quantity AS v, l_discount AS v2 FROM lineitem)"
_SLICES = "sl AS (SELECT p_partkey AS id, 's' || p_partkey AS name, CAST(p_partkey % 2 AS INTEGER) AS g, p_size AS n, coalesce(sum(p_size) OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM part)"


def _flat_states(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("group_id", (F.col("l_orderkey") % 2).cast("int"))
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    t = running_total(t.select("group_id", *order, "l_discount"), ["group_id"], order, F.lit(1), "pos")
    pair = F.array(F.struct(F.lit("exp_avg").alias("key"), F.col("l_quantity").alias("value")), F.struct(F.lit("exp_avg_sq").alias("key"), F.col("l_discount").alias("value")))
    return t.select("group_id", "pos", F.explode(pair).alias("x")).select("group_id", "pos", "x.key", "x.value")


@query(f"""WITH {_FLAT}, {_SLICES}, e AS (SELECT name, 'exp_avg' AS key, v AS value, pos - off AS pos FROM sl JOIN flat ON sl.g = flat.g AND pos >= off AND pos < off + n
  UNION ALL SELECT name, 'exp_avg_sq', v2, pos - off FROM sl JOIN flat ON sl.g = flat.g AND pos >= off AND pos < off + n)
SELECT name, key, count(*) AS n, round(sum(value * (pos + 1)), 2) AS weighted FROM e GROUP BY ALL""")
def optimizer_state(spark, sf_dir):
    """Each parameter's own part of the flat optimizer states."""
    states = _flat_states(spark, sf_dir)
    p = _part(spark, sf_dir, name="concat('s', p_partkey)", group_id="CAST(p_partkey % 2 AS INT)", flat_numel="CAST(p_size AS BIGINT)")
    p = running_total(p, ["group_id"], [F.col("id")], F.col("flat_numel"), "flat_offset")
    out = None
    for key in ("exp_avg", "exp_avg_sq"):
        own = catalog.state_slices(p, states, key).withColumn("key", F.lit(key))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * (F.col("pos") + 1)), 2).alias("weighted"))


@query("SELECT unnest(['exp_avg', 'exp_avg_sq']) AS key")
def optimizer_keys(spark, sf_dir):
    return catalog.state_keys(_flat_states(spark, sf_dir))


@query("""WITH f AS (SELECT vec_id * 64 + unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings),
sh AS (SELECT p_partkey, p_size * 3 AS n, coalesce(sum(p_size * 3) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM part)
SELECT 'w' || p_partkey AS name, count(*) AS n, round(sum(value * (pos - off + 1)), 3) AS weighted FROM sh JOIN f ON pos >= off AND pos < off + n GROUP BY p_partkey""")
def checkpoint_reconstruct(spark, sf_dir):
    """Parameters out of the shards of eight ranks, concatenated in rank order."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    per = F.ceil(F.lit(e.count()) / 8)
    shards = e.select(F.floor(F.col("vec_id") / per).cast("int").alias("rank"), F.pmod("vec_id", per).alias("i"), F.posexplode("embedding").alias("d", "value"))
    shards = shards.select("rank", (F.col("i") * 64 + F.col("d")).alias("pos"), F.col("value").cast("double").alias("value"))
    shapes = _part(spark, sf_dir, place="p_partkey", name="concat('w', p_partkey)", numel="CAST(p_size * 3 AS BIGINT)")
    out = catalog.reconstruct(catalog.concat_shards(shards), shapes)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * (F.col("pos") + 1)), 3).alias("weighted"))


# Views of rank 0 to 3: whole, without strides, with padded rows, transposed, and permuted.
_VIEW = "p_partkey % 6"
_SHAPE = f"CASE {_VIEW} WHEN 0 THEN array(p_size, 3L) WHEN 1 THEN array(4L, p_size) WHEN 2 THEN array(p_size, 5L) WHEN 3 THEN array(3L, p_size) WHEN 4 THEN array(2L, p_size, 3L) ELSE CAST(array() AS ARRAY<BIGINT>) END"
_STRIDES = f"CASE {_VIEW} WHEN 0 THEN array(3L, 1L) WHEN 1 THEN NULL WHEN 2 THEN array(8L, 1L) WHEN 3 THEN array(1L, 3L) WHEN 4 THEN array(3L, 6L, 1L) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def _views(spark, sf_dir):
    p = spark.sql("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM {t}", t=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return spark.sql(f"SELECT p_partkey AS tensor_id, {_SHAPE} AS shape, {_STRIDES} AS strides FROM {{t}}", t=p)


@query("""SELECT p_partkey AS tensor_id, CASE WHEN k = 5 THEN 'scalar' WHEN k IN (0, 1) THEN 'contiguous' ELSE 'non-contiguous' END AS layout,
  CAST(CASE k WHEN 2 THEN p_size WHEN 3 THEN 3 WHEN 4 THEN 2 * p_size ELSE 0 END AS BIGINT) AS n_fragments,
  CAST(CASE k WHEN 2 THEN 8 * p_size * (p_size - 1) // 2 WHEN 3 THEN 3 WHEN 4 THEN 3 * p_size + 2 * 6 * p_size * (p_size - 1) // 2 ELSE 0 END * 4 AS BIGINT) AS offset_bytes
FROM (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part)""")
def contiguity(spark, sf_dir):
    """Layouts of views, and the number and places of the fragments of those that aren't contiguous."""
    v = catalog.layout(_views(spark, sf_dir))
    f = catalog.fragments(_views(spark, sf_dir)).groupBy(F.col("tensor_id").alias("_t")).agg(F.count(F.lit(1)).alias("n"), F.sum("byte_offset").alias("b"))
    return v.join(f, F.col("tensor_id") == F.col("_t"), "left").select("tensor_id", "layout", F.coalesce("n", F.lit(0)).alias("n_fragments"), F.coalesce("b", F.lit(0)).alias("offset_bytes"))


@query("""WITH b AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding) AS value FROM embeddings)
SELECT vec_id AS tensor_id, (pos % 8) * 8 + pos // 8 AS pos, value FROM b""")
def gathered_fragments(spark, sf_dir):
    """Each embedding as a matrix of 8 x 8, transposed: elements of its strided rows put side by side."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    view = e.select(F.col("vec_id").alias("tensor_id"), F.array(*[F.lit(8).cast("long")] * 2).alias("shape"), F.array(F.lit(1).cast("long"), F.lit(8).cast("long")).alias("strides"))
    buffer = e.select(F.col("vec_id").alias("tensor_id"), F.posexplode("embedding").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    return catalog.gather(catalog.fragments(view), buffer)


@query("SELECT p_size AS group_id, p_partkey AS id, p_brand AS category, 'float32' AS dtype, CAST(p_size * 100 AS BIGINT) AS numel FROM part")
def group_manifest(spark, sf_dir):
    """Members of groups with their manifest lines; a missing line or a second dtype in a group raises."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    members = p.select(F.col("p_size").alias("group_id"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"))
    lines = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.lit("float32").alias("dtype"), (F.col("p_size") * 100).cast("long").alias("numel"))
    return catalog.same_dtype(catalog.strict_lookup(members, lines, ["id", "category"]), ["group_id"]).select("group_id", "id", "category", "dtype", "numel")


@query(f"""WITH c AS ({ORACLE_SQL['fingerprint_clusters']}), n AS (SELECT state_type, cluster, row_number() OVER (ORDER BY state_type, cluster) - 1 AS cluster_id FROM (SELECT DISTINCT state_type, cluster FROM c WHERE size > 1))
SELECT c.state_type, tensor_id, CAST(coalesce(cluster_id, -1) AS INTEGER) AS cluster_id, CASE WHEN cluster_id IS NOT NULL THEN c.cluster END AS anchor, cluster_id IS NOT NULL AND c.cluster = tensor_id AS is_anchor FROM c LEFT JOIN n ON c.state_type = n.state_type AND c.cluster = n.cluster""")
def cluster_assignment(spark, sf_dir):
    """Numbered clusters with their anchors; singletons have -1."""
    t = tensors.embeddings(spark, sf_dir)
    return catalog.cluster_ids(similarity.clusters(stats.fingerprint5(t).join(t.select("tensor_id", "state_type").distinct(), "tensor_id")))


# Clusters of the symbol reports: the return flag, but for each tax tensor, which is a cluster of its own.
_REPORT = f"{_NUM}, {_SYM.replace('state_type AS cluster', chr(39) + 'x' + chr(39) + ' AS cluster')}".replace("SELECT tensor_id, state_type, value::FLOAT", "SELECT tensor_id, state_type, value::FLOAT")
_OWN = "CASE WHEN tensor_id LIKE 'tax%' THEN tensor_id ELSE state_type END"
_REPORT = f"{_NUM}, cnt AS (SELECT tensor_id, {_OWN} AS cluster, CASE WHEN b < 0 THEN b + 4294967296 ELSE b END AS sym, count(*) AS cnt FROM (SELECT tensor_id, state_type, value::FLOAT::BIT::INTEGER::BIGINT AS b FROM src) GROUP BY ALL)"


def _report_counts(spark, sf_dir):
    t = tensors.lineitem(spark, sf_dir).withColumn("cluster", F.expr(_OWN))
    return symbols.counts(t, "cluster")


_HLL_OF_CNT = ORACLE_SQL["hll_registers"].split("h1 AS (", 1)[1].rsplit(" SELECT cluster, idx", 1)[0]


@query(f"""{_REPORT}, h1 AS ({_HLL_OF_CNT}, r AS (SELECT cluster, idx, max(rho) AS rho FROM reg GROUP BY ALL),
est AS (SELECT cluster, CASE WHEN raw <= 40960 AND e > 0 THEN 16384 * ln(16384 / e) WHEN raw > 4294967296 / 30.0 THEN -4294967296 * ln(1 - raw / 4294967296) ELSE raw END AS estimate
  FROM (SELECT cluster, 16384 - count(*) AS e, 0.7213 / (1 + 1.079 / 16384) * 16384.0 * 16384.0 / (sum(2.0 ** (-rho)) + 16384 - count(*)) AS raw FROM r GROUP BY cluster)),
sz AS (SELECT cluster, count(DISTINCT tensor_id) AS size FROM cnt GROUP BY 1), tb AS (SELECT tensor_id, cluster, count(*) * 8 + 64 AS b FROM cnt GROUP BY ALL),
x AS (SELECT sum(CAST(floor(estimate * 8) AS BIGINT) + 64) AS c, count(*) AS n, arg_min(cluster, struct_pack(a := -size, b := cluster)) AS l FROM est JOIN sz USING (cluster) WHERE size > 1),
y AS (SELECT sum(b) AS base, sum(CASE WHEN size = 1 THEN b ELSE 0 END) AS single, sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS ns FROM tb JOIN sz USING (cluster))
SELECT CAST(c AS BIGINT) AS cluster_bytes, n AS n_clusters, l AS largest_cluster, CAST(base AS BIGINT) AS baseline_bytes, CAST(single AS BIGINT) AS singleton_bytes, CAST(ns AS BIGINT) AS n_singletons, CAST(c + single AS BIGINT) AS total_bytes,
  CAST(base - c - single AS BIGINT) AS saved_bytes, round((c + single) / base, 6) AS ratio FROM x, y""")
def cluster_report(spark, sf_dir):
    return rounded(groups.savings(_report_counts(spark, sf_dir)), 6)


_XE_OF = _XE.split("cnt AS (", 1)[1].split("GROUP BY ALL),", 1)[1]


def _xe_sql(cluster: str, model: str, x: str) -> str:
    """The oracle's model of counts under another name of the cluster."""
    return f"""{x}c AS (SELECT tensor_id, {cluster} AS cluster, sym, cnt FROM cnt JOIN sz USING (cluster)), {x}g AS (SELECT cluster, sym, CAST(sum(cnt) AS BIGINT) AS cnt FROM {x}c GROUP BY ALL),
{x}x AS (SELECT *, sum(cnt) OVER (PARTITION BY cluster) AS total, greatest(14, CAST(ceil(log2(greatest(count(*) OVER (PARTITION BY cluster), 2))) AS INTEGER) + 1) AS p FROM {x}g),
{x}y AS (SELECT *, CAST(greatest(1, floor(cnt * 2.0 ** p / total)) AS BIGINT) AS n0, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, sym) AS rn FROM {x}x),
{model} AS (SELECT cluster, sym, p, CASE WHEN rn = 1 THEN greatest(1, CAST(n0 + 2.0 ** p - sum(n0) OVER (PARTITION BY cluster) AS BIGINT)) ELSE n0 END AS norm FROM {x}y)"""


@query(f"""{_REPORT}, sz AS (SELECT cluster, count(DISTINCT tensor_id) AS size FROM cnt GROUP BY 1), {_xe_sql('tensor_id', 'mo', 'o')}, {_xe_sql("CASE WHEN size > 1 THEN 'cluster ' || cluster ELSE 'tensor ' || tensor_id END", 'ms', 's')},
a AS (SELECT sum(cnt * (p - log2(norm))) / 8 AS own FROM oc JOIN mo USING (cluster, sym)), b AS (SELECT sum(cnt * (p - log2(norm))) / 8 AS shared FROM sc JOIN ms USING (cluster, sym)),
m AS (SELECT (SELECT count(*) FROM mo) * 8 AS om, (SELECT count(*) FROM ms) * 8 AS sm, CAST((SELECT sum(cnt) FROM cnt) * 4 AS BIGINT) AS raw)
SELECT round(own, 1) AS own_stream_bytes, om AS own_model_bytes, raw AS raw_bytes, round(shared, 1) AS shared_stream_bytes, sm AS shared_model_bytes, om - sm AS model_savings, round(shared - own, 1) AS stream_penalty, round(om - sm - (shared - own), 1) AS net_gain FROM a, b, m""")
def cross_entropy_report(spark, sf_dir):
    """What a model per cluster saves and costs against one per tensor."""
    return rounded(groups.cross_entropy(_report_counts(spark, sf_dir)), 1)


@query("""WITH g AS (SELECT unnest(range(0, 300)) AS point), v AS (SELECT event_type AS tensor_id, value::FLOAT::DOUBLE AS value FROM events),
m AS (SELECT tensor_id, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * count(*) ** (-0.2) AS h FROM v GROUP BY 1 HAVING count(*) > 1 AND max(value) > min(value)),
x AS (SELECT tensor_id, point, n, h, lo + point / 299 * (hi - lo) AS x FROM m, g)
SELECT tensor_id, CAST(point AS INTEGER) AS point, round(any_value(x), 6) AS x, round(sum(exp(-0.5 * ((x - value) / h) ** 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()), 9) AS density FROM x JOIN v USING (tensor_id) GROUP BY ALL""")
def density(spark, sf_dir):
    """Kernel density of each event type's values on 300 points."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("tensor_id"), F.col("value").cast("float").alias("value"))
    return stats.kde(t).select("tensor_id", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(f"""{_EMB}, d AS (SELECT state_type, category, value::DOUBLE AS value, value::DOUBLE - avg(value::DOUBLE) OVER (PARTITION BY state_type, category) AS d FROM src WHERE state_type <> 'model_state')
SELECT state_type, category, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr,
  round(avg(d ** 3) / var_pop(value) ** 1.5, 5) AS skew, round(avg(d ** 4) / var_pop(value) ** 2 - 3, 5) AS kurt FROM d GROUP BY ALL""")
def state_statistics(spark, sf_dir):
    """Statistics of every role in the three optimizer states."""
    return rounded(stats.distribution(tensors.embeddings(spark, sf_dir).filter("state_type <> 'model_state'"), ["state_type", "category"]))


_BYTES = "sum(numel) * 4"


@query(f"""WITH ct AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS INTEGER) AS category, p_size * 100 AS numel FROM part),
pl AS (SELECT *, CAST(ceil(least(numel, 256) * 4 / 256.0) * 256 + 768 AS BIGINT) AS total, (row_number() OVER (PARTITION BY category ORDER BY id) - 1) // 64 AS batch FROM ct)
SELECT category, count(*) AS tensors, CAST({_BYTES} AS BIGINT) AS tensor_bytes, CAST(sum(total) AS BIGINT) AS buffer_bytes, count(DISTINCT batch) AS batches, arg_min('p' || id, id) AS sample, round(sum(total) / greatest(count(*), 1), 4) AS buffer_bytes_mean_tensor, round(sum(total) / greatest(count(DISTINCT batch), 1), 4) AS buffer_bytes_mean_batch FROM pl GROUP BY 1""")
def category_summary(spark, sf_dir):
    """The lines of the rank log: counts, bytes, a sample, and means a tensor and a batch."""
    b = running_total(_plan(spark, sf_dir), ["category"], [F.col("id")], F.lit(1), "at").withColumn("batch", F.floor(F.col("at") / 64))
    n, batches = F.count(F.lit(1)), F.max("batch") + 1
    return b.groupBy("category").agg(
        n.alias("tensors"), (F.sum("numel") * 4).alias("tensor_bytes"), F.sum("total").alias("buffer_bytes"), batches.alias("batches"), F.min_by(F.concat(F.lit("p"), "id"), "id").alias("sample"),
        F.round(F.sum("total") / F.greatest(n, F.lit(1)), 4).alias("buffer_bytes_mean_tensor"), F.round(F.sum("total") / F.greatest(batches, F.lit(1)), 4).alias("buffer_bytes_mean_batch"),
    )


@query("""WITH ct AS (SELECT CAST(p_partkey % 4 AS INTEGER) AS category, p_partkey AS id, p_size * 100 AS numel FROM part),
pl AS (SELECT *, CAST(ceil(least(numel, 256) * 4 / 256.0) * 256 + 768 AS BIGINT) AS total, (row_number() OVER (PARTITION BY category ORDER BY id) - 1) // 64 AS batch FROM ct)
SELECT count(*) AS tensors, CAST(sum(numel) * 4 AS BIGINT) AS tensor_bytes, CAST(sum(numel) * 4 AS BIGINT) >> 20 AS tensor_mib, CAST(sum(total) AS BIGINT) AS buffer_bytes, CAST(sum(total) AS BIGINT) >> 10 AS buffer_kib,
  count(DISTINCT struct_pack(category, batch)) AS batches, CAST(count(*) FILTER (numel = 0) AS BIGINT) AS skipped, min('p' || id) AS first_name, max('p' || id) AS last_name FROM pl""")
def memory_totals(spark, sf_dir):
    """Totals over the catalog, and its first and last name in sorted order."""
    b = running_total(_plan(spark, sf_dir), ["category"], [F.col("id")], F.lit(1), "at").withColumn("batch", F.floor(F.col("at") / 64)).withColumn("name", F.concat(F.lit("p"), "id"))
    n, total = F.sum("numel") * 4, F.sum("total")
    return b.agg(
        F.count(F.lit(1)).alias("tensors"), n.alias("tensor_bytes"), F.shiftright(n, 20).alias("tensor_mib"), total.alias("buffer_bytes"), F.shiftright(total, 10).alias("buffer_kib"),
        F.countDistinct("category", "batch").alias("batches"), F.sum((F.col("numel") == 0).cast("long")).alias("skipped"), F.min("name").alias("first_name"), F.max("name").alias("last_name"),
    )


@query("SELECT 100000::BIGINT AS n, true AS centred, true AS scaled, true AS normal")
def synthetic(spark, sf_dir):
    """Generated normal values: their number and whether the moments are what they should be."""
    v = catalog.synthetic(spark, 100_000).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.kurtosis("value").alias("k"))
    return v.select("n", (F.abs("m") < 1e-5).alias("centred"), (F.abs(F.col("s") / 0.0005 - 1) < 0.02).alias("scaled"), (F.abs("k") < 0.1).alias("normal"))


@query(f"""{_NUM}, {_SYM}, b AS (SELECT tensor_id, (sym & 4294901760) AS w, cnt FROM cnt) SELECT tensor_id, CAST((w >> k) & 255 AS INTEGER) AS byte, CAST(sum(cnt) AS BIGINT) AS cnt FROM b, (SELECT unnest([0, 8, 16, 24]) AS k) GROUP BY ALL""")
def masked_byte_histogram(spark, sf_dir):
    """Bytes of the words whose sidecar half is cut out."""
    return symbols.byte_counts(_counts(spark, sf_dir), 0xFFFF0000)
