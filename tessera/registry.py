"""Queries of the tensor engine and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators import groups, similarity, stats, symbols
from tessera.plans.running import running_total
from tessera.plans.scratch import folder
from tessera.sources import containers, tensors
from tessera.sources.tensors import EMB_SQL, NUM_SQL
from tessera.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_MOMENTS = """m AS (SELECT tensor_id, avg(value::DOUBLE) AS mean, var_pop(value::DOUBLE) AS v, count(*) AS n, max(value) - min(value) AS r FROM src GROUP BY 1),
c AS (SELECT s.tensor_id, avg((s.value::DOUBLE - m.mean) ** 3) AS m3, avg((s.value::DOUBLE - m.mean) ** 4) AS m4 FROM src s JOIN m USING (tensor_id) GROUP BY 1)"""
_PRINT5 = f"""{_MOMENTS}, fp AS (
  SELECT tensor_id, mean, v AS variance, CASE WHEN v <= 1e-9 THEN 0 ELSE m3 / (v * sqrt(v)) END AS skewness, CASE WHEN v <= 1e-9 THEN 0 ELSE m4 / (v * v) END AS kurtosis, r::DOUBLE AS range
  FROM m JOIN c USING (tensor_id))"""
_EMB = f"WITH {EMB_SQL}, src AS (SELECT * FROM emb)"
_NUM = f"WITH {NUM_SQL}, src AS (SELECT * FROM num)"
_SYM = """cnt AS (SELECT tensor_id, state_type AS cluster, CASE WHEN b < 0 THEN b + 4294967296 ELSE b END AS sym, count(*) AS cnt
  FROM (SELECT tensor_id, state_type, value::FLOAT::BIT::INTEGER::BIGINT AS b FROM src) GROUP BY ALL)"""


@query(f"{_EMB}, {_PRINT5} SELECT tensor_id, round(mean, 5) AS mean, round(variance, 5) AS variance, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis, round(range, 5) AS range FROM fp")
def fingerprint5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.fingerprint5(tensors.embeddings(spark, sf_dir)))


_PRINT10 = f"""{_MOMENTS}, q AS (SELECT tensor_id, quantile_cont(value::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM src GROUP BY 1), f10 AS (
  SELECT tensor_id, n, mean, v AS variance, sqrt(v) AS stddev, CASE WHEN v <= 1e-12 THEN 0 ELSE m3 / (v * sqrt(v)) END AS skewness, CASE WHEN v <= 1e-12 THEN 0 ELSE m4 / (v * v) - 3 END AS excess_kurtosis,
         q[2] AS median, q[1] AS q1, q[3] AS q3, q[3] - q[1] AS iqr FROM m JOIN c USING (tensor_id) JOIN q USING (tensor_id))"""


@query(f"{_EMB}, {_PRINT10} SELECT tensor_id, n, round(mean, 5) AS mean, round(variance, 5) AS variance, round(stddev, 5) AS stddev, round(skewness, 5) AS skewness, round(excess_kurtosis, 5) AS excess_kurtosis, round(median, 5) AS median, round(q1, 5) AS q1, round(q3, 5) AS q3, round(iqr, 5) AS iqr FROM f10")
def fingerprint10(spark, sf_dir):
    return rounded(stats.fingerprint10(tensors.embeddings(spark, sf_dir)))


@query("WITH e AS (SELECT *, value::FLOAT::DOUBLE - avg(value::FLOAT::DOUBLE) OVER (PARTITION BY event_type) AS d FROM events) SELECT event_type AS tensor_id, round(avg(d ** 3) / var_pop(value::FLOAT::DOUBLE) ** 1.5, 3) AS skewness, round(avg(d ** 4) / var_pop(value::FLOAT::DOUBLE) ** 2 - 3, 3) AS excess_kurtosis, count(*) AS n, round(avg(value::FLOAT::DOUBLE), 3) AS mean, round(stddev_pop(value::FLOAT::DOUBLE), 3) AS stddev, round(quantile_cont(value::FLOAT::DOUBLE, 0.5), 3) AS median, round(quantile_cont(value::FLOAT::DOUBLE, 0.75) - quantile_cont(value::FLOAT::DOUBLE, 0.25), 3) AS iqr FROM e GROUP BY 1")
def dist_stats(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("tensor_id"), F.col("value").cast("float").alias("value"))
    return rounded(stats.fingerprint10(t).select("tensor_id", "n", "mean", "stddev", "skewness", "excess_kurtosis", "median", "iqr"), 3)


@query(f"{_NUM} SELECT tensor_id, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi, round((max(value) - min(value))::DOUBLE, 4) AS range, count(*) AS n FROM src GROUP BY 1")
def minmax_range(spark, sf_dir):
    return tensors.lineitem(spark, sf_dir).groupBy("tensor_id").agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"), F.round((F.max("value") - F.min("value")).cast("double"), 4).alias("range"), F.count(F.lit(1)).alias("n"))


@query(f"""{_EMB}, e AS (SELECT tensor_id, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM src GROUP BY 1)
SELECT tensor_id, CAST(CASE WHEN hi - lo <= 1e-9 THEN 0 ELSE least(greatest(floor((value::DOUBLE - lo) * 255 / (hi - lo)), 0), 255) END AS INTEGER) AS bin, count(*) AS cnt FROM src JOIN e USING (tensor_id) GROUP BY ALL""")
def value_histogram(spark, sf_dir):
    return stats.histogram(tensors.embeddings(spark, sf_dir))


@query(f"""{_NUM}, k AS (SELECT tensor_id, value, count(*) AS c FROM src GROUP BY ALL)
SELECT tensor_id, value::DOUBLE AS value, round(coalesce(sum(c) OVER (PARTITION BY tensor_id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER (PARTITION BY tensor_id), 6) AS ecdf FROM k""")
def ecdf(spark, sf_dir):
    return stats.ecdf(tensors.lineitem(spark, sf_dir)).select("tensor_id", F.col("value").cast("double").alias("value"), F.round("ecdf", 6).alias("ecdf"))


def _counts(spark, sf_dir):
    return symbols.counts(tensors.lineitem(spark, sf_dir))


_SUMMARY = f"""{_NUM}, {_SYM}, s AS (SELECT tensor_id, cluster, CAST(sum(cnt) AS BIGINT) AS numel, count(*) AS n_unique, sum(cnt * log2(cnt)) AS w FROM cnt GROUP BY ALL),
summ AS (SELECT tensor_id, cluster, numel, n_unique, n_unique / numel AS unique_ratio, log2(numel) - w / numel AS entropy,
  CAST(n_unique * CASE WHEN numel < 65536 THEN 2 ELSE 4 END + 64 AS BIGINT) AS hist_bytes_e1, CAST(n_unique * 8 + 64 AS BIGINT) AS hist_bytes_e2 FROM s)"""
_BYTES = "numel * 4 AS tensor_bytes, round(entropy * numel / 8, 3) AS estimated_bytes, round(hist_bytes_e1 / (numel * 4), 6) AS hist_ratio"


@query(f"{_SUMMARY} SELECT tensor_id, cluster, numel, n_unique, round(unique_ratio, 6) AS unique_ratio, round(entropy, 6) AS entropy, hist_bytes_e1, hist_bytes_e2, {_BYTES} FROM summ")
def symbol_summary(spark, sf_dir):
    return rounded(symbols.summary(_counts(spark, sf_dir)).withColumn("estimated_bytes", F.round("estimated_bytes", 3)), 6)


@query(f"""{_SUMMARY} SELECT cluster, count(*) AS n_tensors, round(avg(unique_ratio), 6) AS avg_unique_ratio, round(avg(entropy), 6) AS avg_entropy, CAST(sum(numel) * 4 AS BIGINT) AS tensor_bytes,
  CAST(sum(hist_bytes_e1) AS BIGINT) AS hist_bytes, round(sum(hist_bytes_e1) / (sum(numel) * 4), 6) AS ratio, arg_max(tensor_id, struct_pack(a := hist_bytes_e1 / numel, b := tensor_id)) AS largest, arg_min(tensor_id, struct_pack(a := hist_bytes_e1 / numel, b := tensor_id)) AS smallest FROM summ GROUP BY cluster""")
def stream_summary(spark, sf_dir):
    s = symbols.summary(_counts(spark, sf_dir))
    out = s.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_tensors"), F.avg("unique_ratio").alias("avg_unique_ratio"), F.avg("entropy").alias("avg_entropy"), (F.sum("numel") * 4).alias("tensor_bytes"),
        F.sum("hist_bytes_e1").alias("hist_bytes"), (F.sum("hist_bytes_e1") / (F.sum("numel") * 4)).alias("ratio"), F.max_by("tensor_id", F.struct(F.col("hist_bytes_e1") / F.col("numel"), "tensor_id")).alias("largest"), F.min_by("tensor_id", F.struct(F.col("hist_bytes_e1") / F.col("numel"), "tensor_id")).alias("smallest"),
    )
    return rounded(out, 6)


@query(f"{_NUM}, {_SYM} SELECT cluster, sym, CAST(sum(cnt) AS BIGINT) AS cnt FROM cnt GROUP BY ALL")
def vocab_merge(spark, sf_dir):
    return symbols.merge(_counts(spark, sf_dir))


_MUL = lambda h, c: f"((({h}) & 65535) * {c} + ((((({h}) >> 16) * {c}) & 65535) * 65536)) & 4294967295"
_HLL = f"""{_NUM}, {_SYM}, h1 AS (SELECT tensor_id, cluster, xor(sym, sym >> 16) AS h FROM cnt), h2 AS (SELECT tensor_id, cluster, {_MUL('h', 2246822507)} AS h FROM h1),
h3 AS (SELECT tensor_id, cluster, xor(h, h >> 13) AS h FROM h2), h4 AS (SELECT tensor_id, cluster, {_MUL('h', 3266489909)} AS h FROM h3), h5 AS (SELECT tensor_id, cluster, xor(h, h >> 16) AS h FROM h4),
reg AS (SELECT tensor_id, cluster, CAST(h >> 18 AS INTEGER) AS idx, CAST(least(greatest(33 - length(ltrim(bin(((h << 14) & 4294967295) | 8192), '0')), 1), 18) AS INTEGER) AS rho FROM h5)"""


def _estimate(keys: str) -> str:
    return f"""est AS (SELECT {keys}, CASE WHEN raw <= 40960 AND e > 0 THEN 16384 * ln(16384 / e) WHEN raw > 4294967296 / 30.0 THEN -4294967296 * ln(1 - raw / 4294967296) ELSE raw END AS estimate
  FROM (SELECT {keys}, 16384 - count(*) AS e, 0.7213 / (1 + 1.079 / 16384) * 16384.0 * 16384.0 / (sum(2.0 ** (-rho)) + 16384 - count(*)) AS raw FROM r GROUP BY {keys}))"""


@query(f"{_HLL} SELECT cluster, idx, max(rho) AS rho FROM reg GROUP BY ALL")
def hll_registers(spark, sf_dir):
    return symbols.hll_registers(_counts(spark, sf_dir), ["cluster"])


@query(f"{_HLL}, r AS (SELECT tensor_id, idx, max(rho) AS rho FROM reg GROUP BY ALL), {_estimate('tensor_id')} SELECT tensor_id, round(estimate, 3) AS estimate FROM est")
def hll_estimate(spark, sf_dir):
    return rounded(symbols.hll_estimate(symbols.hll_registers(_counts(spark, sf_dir), ["tensor_id"]), ["tensor_id"]), 3)


@query(f"""{_HLL}, r AS (SELECT cluster, idx, max(rho) AS rho FROM reg GROUP BY ALL), {_estimate('cluster')}, base AS (SELECT cluster, CAST(sum(n * 8 + 64) AS BIGINT) AS b FROM (SELECT tensor_id, cluster, count(*) AS n FROM cnt GROUP BY ALL) GROUP BY cluster)
SELECT cluster, b AS baseline_bytes, CAST(floor(estimate * 8) AS BIGINT) + 64 AS cluster_bytes, b - CAST(floor(estimate * 8) AS BIGINT) - 64 AS savings FROM est JOIN base USING (cluster)""")
def cluster_savings(spark, sf_dir):
    c = _counts(spark, sf_dir)
    est = symbols.hll_estimate(symbols.hll_registers(c, ["cluster"]), ["cluster"])
    base = symbols.summary(c).groupBy("cluster").agg(F.sum("hist_bytes_e2").alias("baseline_bytes"))
    size = F.floor(F.col("estimate") * 8).cast("long") + 64
    return base.join(est, "cluster").select("cluster", "baseline_bytes", size.alias("cluster_bytes"), (F.col("baseline_bytes") - size).alias("savings"))


@query(f"{_HLL}, r AS (SELECT cluster, idx, max(rho) AS rho FROM reg GROUP BY ALL), {_estimate('cluster')} SELECT cluster, n AS exact, round(abs(n - estimate) / n * 100, 4) AS error_pct FROM est JOIN (SELECT cluster, count(DISTINCT sym) AS n FROM cnt GROUP BY 1) USING (cluster)")
def hll_vs_exact(spark, sf_dir):
    c = _counts(spark, sf_dir)
    est = symbols.hll_estimate(symbols.hll_registers(c, ["cluster"]), ["cluster"])
    exact = symbols.merge(c).groupBy("cluster").agg(F.count(F.lit(1)).alias("exact"))
    return exact.join(est, "cluster").select("cluster", "exact", F.round(F.abs(F.col("exact") - F.col("estimate")) / F.col("exact") * 100, 4).alias("error_pct"))


_XE = f"""{_NUM}, {_SYM}, mg AS (SELECT cluster, sym, CAST(sum(cnt) AS BIGINT) AS cnt FROM cnt GROUP BY ALL),
x AS (SELECT *, sum(cnt) OVER (PARTITION BY cluster) AS total, greatest(14, CAST(ceil(log2(greatest(count(*) OVER (PARTITION BY cluster), 2))) AS INTEGER) + 1) AS p FROM mg),
y AS (SELECT *, CAST(greatest(1, floor(cnt * 2.0 ** p / total)) AS BIGINT) AS n0, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, sym) AS rn FROM x),
model AS (SELECT cluster, sym, cnt, p, CASE WHEN rn = 1 THEN greatest(1, CAST(n0 + 2.0 ** p - sum(n0) OVER (PARTITION BY cluster) AS BIGINT)) ELSE n0 END AS norm FROM y)"""


@query(f"{_XE} SELECT cluster, sym, cnt, p, norm FROM model")
def xe_model(spark, sf_dir):
    return symbols.xe_model(symbols.merge(_counts(spark, sf_dir)))


@query(f"{_XE} SELECT tensor_id, cluster, round(sum(cnt.cnt * (p - log2(norm))) / 8, 2) AS stream_bytes FROM cnt JOIN model USING (cluster, sym) GROUP BY ALL")
def xe_cost(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return rounded(symbols.xe_cost(c, symbols.xe_model(symbols.merge(c))), 2)


@query(f"{_NUM}, {_SYM} SELECT tensor_id, CAST((sym >> k) & 255 AS INTEGER) AS byte, CAST(sum(cnt) AS BIGINT) AS cnt FROM cnt, (SELECT unnest([0, 8, 16, 24]) AS k) GROUP BY ALL")
def byte_histogram(spark, sf_dir):
    return symbols.byte_counts(_counts(spark, sf_dir))


@query(f"{_NUM}, {_SYM} SELECT tensor_id, count(DISTINCT sym & 4294901760) AS n_masked, count(DISTINCT sym & 65535) AS n_sidecar, CAST(sum(cnt) * 2 AS BIGINT) AS sidecar_bytes, CAST(ceil(sum(cnt) * 16 / 8) AS BIGINT) AS masked_bytes FROM cnt GROUP BY 1")
def mantissa_split(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return c.groupBy("tensor_id").agg(F.countDistinct(F.col("sym").bitwiseAND(4294901760)).alias("n_masked"), F.countDistinct(F.col("sym").bitwiseAND(65535)).alias("n_sidecar"), (F.sum("cnt") * 2).alias("sidecar_bytes"), F.ceil(F.sum("cnt") * 16 / 8).alias("masked_bytes"))


_PAIRS = f"""{_EMB}, ms AS (SELECT tensor_id, pos, (CASE WHEN b < 0 THEN b + 4294967296 ELSE b END) >> 24 AS s FROM (SELECT tensor_id, pos, value::FLOAT::BIT::INTEGER::BIGINT AS b FROM src)),
pr AS (SELECT tensor_id, s AS lhs, lead(s) OVER (PARTITION BY tensor_id ORDER BY pos) AS rhs FROM ms), pc AS (SELECT tensor_id, lhs, rhs, count(*) AS cnt FROM pr WHERE rhs IS NOT NULL GROUP BY ALL)"""


#: Elements that neighbours are sought in at once.
_CHUNK = 100_000


def _pair_counts(spark, sf_dir):
    from pyspark.sql import Window as W

    t = tensors.embeddings(spark, sf_dir).select("tensor_id", "pos", F.shiftright(bits.float_bits("value"), 24).alias("s"))
    t = running_total(t, ["tensor_id"], [F.col("pos")], F.lit(1), "i")
    # the first element of a chunk closes the last pair of the one before
    own = F.floor(F.col("i") / _CHUNK)
    both = F.when((F.col("i") % _CHUNK == 0) & (F.col("i") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    p = t.withColumn("chunk", F.explode(both)).withColumn("rhs", F.lead("s").over(W.partitionBy("tensor_id", "chunk").orderBy("i"))).filter("rhs IS NOT NULL")
    return p.groupBy("tensor_id", F.col("s").alias("lhs"), "rhs").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"{_PAIRS} SELECT tensor_id, lhs, rhs, cnt FROM pc")
def pair_counts(spark, sf_dir):
    return _pair_counts(spark, sf_dir)


@query(f"{_PAIRS} SELECT tensor_id, lhs, rhs, cnt FROM pc QUALIFY row_number() OVER (PARTITION BY tensor_id ORDER BY cnt DESC, lhs, rhs) = 1")
def top_pair(spark, sf_dir):
    best = _pair_counts(spark, sf_dir).groupBy("tensor_id").agg(F.max(F.struct("cnt", -F.col("lhs"), -F.col("rhs"))).alias("s"))
    return best.select("tensor_id", (-F.col("s").getField("col2")).alias("lhs"), (-F.col("s").getField("col3")).alias("rhs"), "s.cnt")


_KS = f"""{_EMB}, tt AS (SELECT DISTINCT tensor_id, state_type, category, layer FROM src), pr AS (SELECT a.tensor_id AS t1, b.tensor_id AS t2 FROM tt a JOIN tt b USING (state_type, category) WHERE a.layer < b.layer),
k AS (SELECT tensor_id, value, count(*) AS c FROM src GROUP BY ALL), u AS (SELECT t1, t2, value, sum(c1) AS c1, sum(c2) AS c2 FROM (
  SELECT t1, t2, value, c AS c1, 0 AS c2 FROM pr JOIN k ON t1 = tensor_id UNION ALL SELECT t1, t2, value, 0, c FROM pr JOIN k ON t2 = tensor_id) GROUP BY ALL),
g AS (SELECT t1, t2, abs(sum(c1) OVER w / sum(c1) OVER (PARTITION BY t1, t2) - sum(c2) OVER w / sum(c2) OVER (PARTITION BY t1, t2)) AS gap FROM u WINDOW w AS (PARTITION BY t1, t2 ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT t1, t2, max(gap) AS ks FROM g GROUP BY ALL)"""


def _pairs(t):
    return similarity.pairs(t.select("tensor_id", "state_type", "category", "layer").distinct())


@query(f"{_KS} SELECT t1, t2, round(ks, 6) AS ks FROM ks")
def pairwise_ks(spark, sf_dir):
    t = tensors.embeddings(spark, sf_dir)
    return rounded(similarity.ks(t, _pairs(t)), 6)


_SIM = lambda f: f"greatest(0, 100 * (1 - least(1, abs(a.{f} - b.{f}) / (abs(a.{f}) + abs(b.{f}) + 1e-12))))"


@query(f"{_KS}, {_PRINT10} SELECT t1, t2, round(({' + '.join(_SIM(f) for f in similarity.FIELDS)} + greatest(0, 100 * (1 - ks))) / 7, 4) AS similarity FROM ks JOIN f10 a ON a.tensor_id = t1 JOIN f10 b ON b.tensor_id = t2")
def pairwise_similarity(spark, sf_dir):
    t = tensors.embeddings(spark, sf_dir)
    p = _pairs(t)
    return rounded(similarity.pairwise(stats.fingerprint10(t), p, similarity.ks(t, p)).select("t1", "t2", "similarity"), 4)


_WEIGHTS = f"{_EMB}, {_PRINT5}, im AS (SELECT {', '.join(f'avg({d} * {d}) - avg({d}) * avg({d}) AS {d}' for d in similarity.DIMS)} FROM fp), wt AS (SELECT {', '.join(f'{d} / ({" + ".join(f"{x} + 1e-8" for x in similarity.DIMS)}) AS w_{d}' for d in similarity.DIMS)} FROM im)"


@query(f"{_WEIGHTS} SELECT {', '.join(f'round(w_{d}, 6) AS w_{d}' for d in similarity.DIMS)} FROM wt")
def fingerprint_weights(spark, sf_dir):
    return rounded(similarity.weights(stats.fingerprint5(tensors.embeddings(spark, sf_dir))), 6)


@query(f"{_WEIGHTS} SELECT tensor_id, round({' + '.join(f'{d} * w_{d}' for d in similarity.DIMS)}, 5) AS scalar FROM fp, wt")
def weighted_scalar(spark, sf_dir):
    p = stats.fingerprint5(tensors.embeddings(spark, sf_dir))
    j = p.crossJoin(F.broadcast(similarity.weights(p)))  # one row on the right
    return j.select("tensor_id", F.round(sum((F.col(d) * F.col(f"w_{d}") for d in similarity.DIMS), F.lit(0.0)), 5).alias("scalar"))


_Z = ", ".join(f"({d} - avg({d}) OVER w) / CASE WHEN var_pop({d}) OVER w < 1e-30 THEN 1 ELSE stddev_pop({d}) OVER w END AS {d}" for d in similarity.DIMS)


@query(f"""{_EMB}, {_PRINT5}, z AS (SELECT state_type, tensor_id, {_Z} FROM fp JOIN (SELECT DISTINCT tensor_id, state_type FROM src) USING (tensor_id) WINDOW w AS (PARTITION BY state_type)),
pd AS (SELECT state_type, a.tensor_id AS x, b.tensor_id AS y, round(sqrt({' + '.join(f'(a.{d} - b.{d}) ** 2' for d in similarity.DIMS)}), 9) AS dist FROM z a JOIN z b USING (state_type) WHERE a.tensor_id < b.tensor_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY state_type ORDER BY dist, x, y) AS rn, count(*) OVER (PARTITION BY state_type) AS n FROM pd),
ed AS (SELECT x, y FROM (SELECT *, max(CASE WHEN rn = n // 4 + 1 THEN dist END) OVER (PARTITION BY state_type) AS lim FROM rk) WHERE dist < lim),
un AS (SELECT x, y FROM ed UNION ALL SELECT y, x FROM ed), co AS (
SELECT state_type, tensor_id, (WITH RECURSIVE r AS (SELECT z.tensor_id AS t UNION SELECT un.y FROM r JOIN un ON un.x = r.t) SELECT min(t) FROM r) AS cluster FROM z)
SELECT state_type, tensor_id, cluster, count(*) OVER (PARTITION BY state_type, cluster) AS size FROM co""")
def fingerprint_clusters(spark, sf_dir):
    t = tensors.embeddings(spark, sf_dir)
    return similarity.clusters(stats.fingerprint5(t).join(t.select("tensor_id", "state_type").distinct(), "tensor_id"))


_TAILS = "['.q_proj', '.KEY', '.value', '.o_proj', '.norm', '.gate_proj', '.up_proj', '.down_proj', ''][p_partkey % 9 + 1]"
_ROLE = " ".join(f"WHEN regexp_matches(n, '{pattern}') THEN '{role}'" for pattern, role in bits.ROLES)


@query(f"SELECT p_name AS name, CASE {_ROLE} ELSE 'other' END AS role FROM (SELECT p_name || {_TAILS} AS p_name, lower(p_name || {_TAILS}) AS n FROM part)")
def role_from_name(spark, sf_dir):
    tails = F.array(*[F.lit(x) for x in (".q_proj", ".KEY", ".value", ".o_proj", ".norm", ".gate_proj", ".up_proj", ".down_proj", "")])
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % 9 + 1).cast("int"))).alias("name"))
    return p.select("name", bits.role(F.col("name")).alias("role"))


_CAT = "ct AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS INTEGER) AS category, p_size * 100 AS numel FROM part)"


def _catalog(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("int").alias("category"), (F.col("p_size") * 100).cast("long").alias("numel"))


_ALIGN = lambda x: f"CAST(ceil(({x}) / 256.0) * 256 AS BIGINT)"
_PLAN = f"WITH {_CAT}, pl AS (SELECT id, category, numel, {_ALIGN('least(numel, 256) * 4')} + {_ALIGN('16')} + {_ALIGN('8')} + {_ALIGN('20')} AS total FROM ct)"


def _plan(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    total = sum((bits.align(x) for x in (F.least("numel", F.lit(256)) * 4, F.lit(16), F.lit(8), F.lit(20))), F.lit(0))
    return c.withColumn("total", total.cast("long"))


@query(f"{_PLAN} SELECT id, category, total FROM pl")
def buffer_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("id", "category", "total")


@query(f"{_PLAN}, b AS (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY id) - 1) // 64 AS batch FROM pl) SELECT id, category, batch, CAST(coalesce(sum(total) OVER (PARTITION BY category, batch ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS slab_offset FROM b")
def slab_offsets(spark, sf_dir):
    from pyspark.sql import Window as W

    b = running_total(_plan(spark, sf_dir), ["category"], [F.col("id")], F.lit(1), "at").withColumn("batch", F.floor(F.col("at") / 64))
    return b.select("id", "category", "batch", F.coalesce(F.sum("total").over(W.partitionBy("category", "batch").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("slab_offset"))


@query(f"WITH {_CAT} SELECT category, count(*) AS n, CAST(sum(numel) AS BIGINT) AS elements, min(id) AS sample, round(sum(numel) / greatest(count(*), 1), 4) AS mean_numel FROM ct GROUP BY 1")
def category_stats(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("numel").alias("elements"), F.min("id").alias("sample"), F.round(F.sum("numel") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("mean_numel"))


@query(f"""WITH {_CAT}, o AS (SELECT id, category, numel, coalesce(sum(numel) OVER (PARTITION BY category ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(numel) OVER (PARTITION BY category) AS total FROM ct),
rk AS (SELECT *, unnest(range(0, 8)) AS rank, CAST(ceil(total / 8) AS BIGINT) AS w FROM o)
SELECT id, category, CAST(rank AS INTEGER) AS rank, CAST(greatest(s, rank * w) AS BIGINT) AS start, CAST(least(s + numel, (rank + 1) * w) - greatest(s, rank * w) AS BIGINT) AS resident FROM rk WHERE s + numel > rank * w AND s < (rank + 1) * w""")
def shard_overlap(spark, sf_dir):
    """Ranges against ranks without a cross product: the ranks that a range meets follow from its ends."""
    c = _catalog(spark, sf_dir)
    width = c.groupBy(F.col("category").alias("_c")).agg(F.ceil(F.sum("numel") / 8).alias("w"))
    o = running_total(c, ["category"], [F.col("id")], F.col("numel"), "s").join(width, F.col("category") == F.col("_c"))
    o = o.withColumn("rank", F.explode(F.sequence(F.floor(F.col("s") / F.col("w")), F.floor((F.col("s") + F.col("numel") - 1) / F.col("w"))))).filter("numel > 0")
    start = F.greatest("s", F.col("rank") * F.col("w"))
    return o.select("id", "category", F.col("rank").cast("int").alias("rank"), start.alias("start"), (F.least(F.col("s") + F.col("numel"), (F.col("rank") + 1) * F.col("w")) - start).alias("resident"))


@query("SELECT p_partkey AS id, CAST((p_size + 1) * 3 AS BIGINT) AS stride0, CAST(3 AS BIGINT) AS stride1, CAST(1 AS BIGINT) AS stride2, CAST(2 * (p_size + 1) * 3 AS BIGINT) AS numel FROM part")
def row_major_strides(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.array(F.lit(2), F.col("p_size") + 1, F.lit(3)).alias("shape"))
    product = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda x, y: x * y)
    strides = F.transform(F.sequence(F.lit(1), F.size("shape")), lambda i: product(F.slice("shape", i + 1, F.size("shape") - i)))
    return p.select("id", strides[0].alias("stride0"), strides[1].alias("stride1"), strides[2].alias("stride2"), product(F.col("shape")).alias("numel"))


@query("SELECT l_orderkey AS tensor_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, l_quantity AS value FROM lineitem")
def fragment_concat(spark, sf_dir):
    from pyspark.sql import Window as W

    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_orderkey").alias("tensor_id"), (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1).cast("long").alias("pos"), F.col("l_quantity").alias("value"))


@query(ORACLE_SQL["fingerprint5"])
def streaming_fingerprint(spark, sf_dir):
    root = folder(spark, "stream")
    ingest.ingest(ingest.files(spark, f"{sf_dir}/embeddings.parquet"), tensors.coordinates, ingest.moments, root)
    return rounded(ingest.fingerprint5(ingest.merge_moments(ingest.states(spark, root, ingest.STATE))))


_LE_BYTES = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"


@query(f"""{_EMB}, w AS (SELECT layer, tensor_id, pos, pos // 1000000 AS chunk, printf('%08x', CASE WHEN b < 0 THEN b + 4294967296 ELSE b END) AS h
    FROM (SELECT layer, tensor_id, pos, value::FLOAT::BIT::INTEGER::BIGINT AS b FROM src))
  SELECT layer AS rank, tensor_id || '/' || chunk AS name, count(*) AS num_elements, true AS is_raw, 4 * count(*) AS bytes, sha256(unhex(string_agg({_LE_BYTES}, '' ORDER BY pos))) AS sha256 FROM w GROUP BY layer, tensor_id, chunk""")
def container_roundtrip(spark, sf_dir):
    root = folder(spark, "containers")
    t = tensors.embeddings(spark, sf_dir).select(F.col("layer").alias("rank"), "tensor_id", "pos", bits.float_bits("value").alias("word"))
    containers.states.write(containers.uncoded(t), root)
    back = containers.states.read(spark, root)
    return back.select("rank", "name", "num_elements", "is_raw", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"))


@query()
def kmeans_groups(spark, sf_dir):
    """Groups of tensors alike in unique ratio, entropy and histogram bytes; singletons are -1."""
    return groups.kmeans(symbols.summary(_counts(spark, sf_dir)), ["unique_ratio", "entropy", "hist_bytes_e2"]).select("tensor_id", "grp")
