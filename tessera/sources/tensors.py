"""Tensor views of the tables: long format, one row per element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("model_state", "master_weights", "exp_avg", "exp_avg_sq")
ROLES = ("query", "key", "value", "mlp_up")
ELEMENTS = "tensor_id string, state_type string, category string, layer int, pos long, value float"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each coordinate of the embeddings is a tensor: tensor_id, state_type, category, layer, pos, value."""
    return coordinates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def coordinates(rows: DataFrame) -> DataFrame:
    """The same of any rows with vec_id and embedding, such as a micro-batch."""
    return rows.sparkSession.sql(
        """SELECT concat('e', d) AS tensor_id, element_at(array('model_state', 'master_weights', 'exp_avg', 'exp_avg_sq'), d % 4 + 1) AS state_type,
             element_at(array('query', 'key', 'value', 'mlp_up'), CAST((d div 4) % 4 + 1 AS INT)) AS category, CAST(d div 16 AS INT) AS layer, vec_id AS pos, value
           FROM (SELECT vec_id, posexplode(embedding) AS (d, value) FROM {t})""",
        t=rows,
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each numeric column of lineitem by return flag and line status is a tensor: tensor_id, value."""
    return spark.sql(
        """SELECT concat_ws('_', name, l_returnflag, l_linestatus) AS tensor_id, l_returnflag AS state_type, name AS category, l_orderkey, l_linenumber, CAST(value AS FLOAT) AS value
           FROM {t} LATERAL VIEW stack(4, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS name, value""",
        t=spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
    )


EMB_SQL = """emb AS (
  SELECT 'e' || d AS tensor_id, ['model_state', 'master_weights', 'exp_avg', 'exp_avg_sq'][d % 4 + 1] AS state_type,
         ['query', 'key', 'value', 'mlp_up'][(d // 4) % 4 + 1] AS category, CAST(d // 16 AS INTEGER) AS layer, vec_id AS pos, value
  FROM (SELECT vec_id, unnest(embedding) AS value, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS d FROM embeddings))"""
NUM_SQL = """num AS (
  SELECT name || '_' || l_returnflag || '_' || l_linestatus AS tensor_id, l_returnflag AS state_type, name AS category, CAST(value AS FLOAT) AS value
  FROM (SELECT l_returnflag, l_linestatus, unnest(['quantity', 'price', 'discount', 'tax']) AS name, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem))"""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest.csv: seven columns, quoted or not; of repeated keys the last line counts."""
    schema = "tensor_key string, layer int, category string, state_type string, numel long, dtype string, file_path string"
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return spark.sql(
        "SELECT tensor_key, layer, category, state_type, numel, dtype, file_path FROM (SELECT *, row_number() OVER (PARTITION BY state_type, category, layer ORDER BY at DESC) AS rn FROM (SELECT *, monotonically_increasing_id() AS at FROM {t})) WHERE rn = 1",
        t=rows,
    )


def grouping(spark: SparkSession, path: str, state_type: str | None = None, category: str | None = None, group_id: int | None = None) -> DataFrame:
    """grouping_summary.csv: one row per group and layer; absent filters mean all."""
    schema = "state_type string, category string, group_id int, c3 string, layers string, representative_layer int, c6 string, c7 string, c8 string, c9 string"
    rows = spark.read.csv(path, header=True, schema=schema)
    for column, wanted in (("state_type", state_type), ("category", category), ("group_id", group_id)):
        if wanted is not None:
            rows = rows.filter(rows[column] == wanted)
    return spark.sql("SELECT state_type, category, group_id, CAST(layer AS INT) AS layer, representative_layer, place FROM {t} LATERAL VIEW posexplode(split(trim(layers), ' +')) AS place, layer", t=rows)


#: Bytes of a raw file that are read at once.
RANGE_BYTES = 64 << 20


def raw_words(spark: SparkSession, path: str, width: int = 4, expected: DataFrame | None = None) -> DataFrame:
    """Raw little-endian files: path, pos, word. Files are read in ranges, so one may have any size. Sizes that
    aren't whole words raise, and so do those that differ from ``expected`` (file_path, numel, by file name)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")  # listed, not read
    if expected is not None:
        last = "substring_index({}, '/', -1)"
        known = expected.select(F.expr(last.format("file_path")).alias("_f"), "numel")
        files = files.join(known, F.expr(last.format("path")) == F.col("_f"))
        files = files.filter(F.when(F.col("length") == F.col("numel") * width, True).otherwise(F.raise_error(F.concat("path", F.lit(": not the manifest's size"))).cast("boolean")))
    whole = F.when(F.col("length") % width == 0, True).otherwise(F.raise_error(F.concat("path", F.lit(": not whole words"))).cast("boolean"))
    step = RANGE_BYTES // width * width
    ranges = files.filter(whole).filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def parse(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, length, start in zip(*(b.column(c).to_pylist() for c in ("path", "length", "start")), strict=True):
                fs, local = open_uri(name)
                with fs.open_input_file(local) as f:
                    words = np.frombuffer(f.read_at(min(step, length - start), start), dtype=f"<u{width}").astype("int64")
                for at in range(0, len(words), 100_000):
                    part = words[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part)) + start // width), pa.array(part)], names=["path", "pos", "word"])

    return ranges.mapInArrow(parse, "path string, pos long, word long")


def open_uri(uri: str):
    """File system and path of any address that pyarrow knows."""
    import pyarrow.fs as pafs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)
