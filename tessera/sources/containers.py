"""The three binary containers a rank writes: coded states, mantissa sidecars, frequency tables.

A file is a 16-byte head, fixed-size index entries and (but for tables) a data section. The rows of
all files are cut into chunks of bytes in SQL order (file, section, place), so that a task only
appends what it is given and never holds a file. Files get their name once they are whole.
Reading goes through the index: entries first, then ranged reads of their data, spread over tasks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the formats (little-endian).
LANES = 256
HEAD_BYTES = 16
NAME_BYTES = 256
DTYPES = {"float32": 0, "bfloat16": 1, "float16": 2, "int8": 3, "int32": 4, "unknown": 255}
STATES_MAGIC, STATES_VERSION = 0x414E5343, 2
MANTISSA_MAGIC, MANTISSA_VERSION = 0x4D414E54, 2
TABLES_MAGIC, TABLES_VERSION = 0x44494354, 1
STATES_PATH = "rank_{}_states.ansc"
MANTISSA_PATH = "mantissa/rank_{}_mantissa.mant"
TABLES_PATH = "tables/rank_{}_tables.dict"
_HEAD = struct.Struct("<4I")  # magic, version, rank, entries
_STATE = struct.Struct("<256s3B5x4Q256s")  # name, dtype, is_raw, owns_table, original, numel, offset, size, anchor
_LANE = struct.Struct(f"<{4 * LANES}I")  # final_state, byte_count, buf_offset, padding of each lane
_SIDE = struct.Struct("<256s2B6x3Q")  # name, dtype, bytes per element, elements, offset, size
_TABLE = struct.Struct(f"<256s{LANES}I{LANES + 1}I")  # anchor, frequencies, exclusive running sums

STATES = (
    "rank int, place long, name string, dtype int, is_raw boolean, owns_table boolean, original_bytes long, num_elements long,"
    " anchor_name string, final_states array<long>, byte_counts array<long>, buf_offsets array<long>, data binary"
)
SIDECARS = "rank int, place long, name string, dtype int, bytes_per_elem int, num_elements long, data binary"
TABLES = "rank int, place long, anchor_name string, norm_freq array<long>, cum_freq array<long>"


def head(magic: int, version: int, rank: int, entries: int) -> bytes:
    return _HEAD.pack(magic, version, rank, entries)


def read_head(raw: bytes, magic: int, version: int, path: str) -> tuple[int, int]:
    """Rank and number of entries."""
    if len(raw) < HEAD_BYTES or _HEAD.unpack(raw)[:2] != (magic, version):
        raise ValueError(f"{path}: not the expected container")
    return _HEAD.unpack(raw)[2:]


def _name(text: str | None) -> bytes:
    """At most 255 bytes, up to the first NUL, as a C string holds them."""
    return (text or "").encode().split(b"\0")[0][: NAME_BYTES - 1]


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace")


def state_entry(r: dict) -> bytes:
    """The index entry of a coded tensor. Raw are those whose first lane holds all original bytes."""
    n = r["byte_counts"]
    raw = n[0] == r["original_bytes"] & 0xFFFFFFFF and not any(n[1:])
    lanes = [x for lane in zip(r["final_states"], n, r["buf_offsets"], [0] * LANES, strict=True) for x in lane]
    head = _STATE.pack(_name(r["name"]), r["dtype"], raw, bool(r["owns_table"]), r["original_bytes"], r["num_elements"], r["offset"], r["size"], _name(r["anchor_name"]))
    return head + _LANE.pack(*lanes)


def sidecar_entry(r: dict) -> bytes:
    return _SIDE.pack(_name(r["name"]), r["dtype"], r["bytes_per_elem"], r["num_elements"], r["offset"], r["size"])


def table_entry(r: dict) -> bytes:
    cum = [0]
    for f in r["norm_freq"]:
        cum.append(cum[-1] + f)
    return _TABLE.pack(_name(r["anchor_name"]), *r["norm_freq"], *cum)


def _read_state(raw: bytes) -> dict:
    name, dtype, is_raw, owns, original, numel, offset, size, anchor = _STATE.unpack_from(raw)
    lanes = _LANE.unpack_from(raw, _STATE.size)
    return {
        "name": _text(name), "dtype": dtype, "is_raw": bool(is_raw), "owns_table": bool(owns), "original_bytes": original, "num_elements": numel,
        "anchor_name": _text(anchor), "final_states": lanes[0::4], "byte_counts": lanes[1::4], "buf_offsets": lanes[2::4], "offset": offset, "size": size,
    }


def _read_sidecar(raw: bytes) -> dict:
    name, dtype, width, numel, offset, size = _SIDE.unpack(raw)
    return {"name": _text(name), "dtype": dtype, "bytes_per_elem": width, "num_elements": numel, "offset": offset, "size": size}


def _read_table(raw: bytes) -> dict:
    anchor, *numbers = _TABLE.unpack(raw)
    return {"anchor_name": _text(anchor), "norm_freq": numbers[:LANES], "cum_freq": numbers[LANES:]}


#: Index entries in a batch.
INDEX_ROWS = 256
#: Elements of an uncoded entry at most.
CHUNK = 1_000_000


def uncoded(t: DataFrame, dtype: str = "float32", chunk: int = CHUNK) -> DataFrame:
    """Rows for ``states.write`` that hold words as they are (t: rank, tensor_id, pos, word of 4 bytes).

    A tensor has an entry, named tensor_id/number, for every ``chunk`` positions that have an element.
    """

    @F.pandas_udf("binary")
    def pack(words: pd.Series) -> pd.Series:
        return words.map(lambda w: np.asarray(w, dtype="<u4").tobytes())

    own = t.select("rank", "tensor_id", F.floor(F.col("pos") / chunk).alias("_chunk"), "pos", "word")
    sizes = own.groupBy("rank", "tensor_id", "_chunk").agg(F.count(F.lit(1)).alias("num_elements"))
    place = (F.row_number().over(W.partitionBy("rank").orderBy("tensor_id", "_chunk")) - 1).cast("long")
    sizes = sizes.select(F.col("rank").alias("_r"), F.col("tensor_id").alias("_t"), F.col("_chunk").alias("_c"), "num_elements", place.alias("place"))
    data = own.groupBy("rank", "tensor_id", "_chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x"))
    same = F.col("rank").eqNullSafe(F.col("_r")) & (F.col("tensor_id") == F.col("_t")) & (F.col("_chunk") == F.col("_c"))
    rows = data.join(sizes, same)
    none = F.array_repeat(F.lit(0).cast("long"), LANES)
    counts = F.transform(none, lambda _, i: F.when(i == 0, F.col("original_bytes")).otherwise(F.lit(0)))
    rows = rows.withColumn("original_bytes", F.col("num_elements") * 4).select(
        "rank", "place", F.concat_ws("/", "tensor_id", "_chunk").alias("name"), F.lit(DTYPES[dtype]).alias("dtype"), F.lit(True).alias("is_raw"), F.lit(True).alias("owns_table"),
        "original_bytes", "num_elements", F.lit("").alias("anchor_name"), none.alias("final_states"), counts.alias("byte_counts"), none.alias("buf_offsets"), pack("x.word").alias("data"),
    )
    return rows


class Container:
    """One of the formats: where its files go, and how its entries are packed and read."""

    def __init__(self, magic: int, version: int, path: str, schema: str, entry, parse, entry_bytes: int) -> None:
        self.magic, self.version, self.path, self.schema = magic, version, path, schema
        self.entry, self.parse, self.entry_bytes = entry, parse, entry_bytes
        self.has_data = "data binary" in schema

    def glob(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.path.format('*')}"

    def write(self, rows: DataFrame, root: str) -> DataFrame:
        """Write one file per rank under ``root``; returns path, entries, bytes of each file.

        Entries are in the order of ``place``. A null or negative rank counts as 0. No rows: no files.
        """
        magic, version, pattern, entry = self.magic, self.version, self.path, self.entry
        rows = rows.withColumn("rank", F.greatest(F.coalesce("rank", F.lit(0)), F.lit(0)).cast("int"))
        size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long") if self.has_data else F.lit(0).cast("long")
        rows = rows.withColumn("size", size)
        # Offsets need sizes alone: the window never sees the data.
        by = W.partitionBy("rank").orderBy("place")
        index = rows.drop("data").withColumn("offset", F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        count = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("entries"))

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = batch.to_pylist()
                yield _chunks([(r["rank"], 0, 0, head(magic, version, r["rank"], r["entries"])) for r in got])

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _chunks([(r["rank"], 1, r["place"], entry(r)) for r in batch.to_pylist()])

        chunk = "rank int, section int, place long, chunk binary"
        parts = count.mapInArrow(heads, chunk).unionByName(index.mapInArrow(entries, chunk))
        if self.has_data:
            parts = parts.unionByName(rows.select("rank", F.lit(2).alias("section"), F.col("place").cast("long").alias("place"), F.col("data").alias("chunk")))

        def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files: list[tuple[str, int, int]] = []
            rank = out = None
            for batch in batches:
                for r, section, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                    if r != rank:
                        if out is not None:
                            files.append(out.close())
                        rank, out = r, _File(root, pattern.format(r))
                    out.add(data.as_py() or b"", section == 1)
            if out is not None:
                files.append(out.close())
            cols = list(zip(*files, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "entries", "bytes"])

        written = parts.repartition("rank").sortWithinPartitions("rank", "section", "place").mapInArrow(append, "path string, entries long, bytes long")
        # Files are written when the job runs, once: the report is small, one row per rank.
        return rows.sparkSession.createDataFrame(written.collect(), "path string, entries long, bytes long")

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        """All entries of all ranks with their data. Damaged heads and short files raise."""
        files = spark.read.format("binaryFile").load(self.glob(root)).select("path", "length")  # listed, not read
        magic, version, parse, width = self.magic, self.version, self.parse, self.entry_bytes
        fields = [f for f in self.schema.split(", ") if f != "data binary"]
        index_schema = ", ".join(f.strip() for f in [*fields, "path string", "start long", "size long"])

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    fs, local = _open(path)
                    with fs.open_input_stream(local) as f:
                        rank, n = read_head(f.read(HEAD_BYTES), magic, version, path)
                        data = HEAD_BYTES + n * width
                        if data > length:
                            raise ValueError(f"{path}: shorter than its index")
                        rows = []
                        for place in range(n):
                            e = parse(f.read(width))
                            start, size = data + e.pop("offset", 0), e.pop("size", 0)
                            if start + size > length:
                                raise ValueError(f"{path}: entry {place} ends behind the file")
                            row = {"rank": rank, "place": place, **e, "path": path, "start": start, "size": size}
                            rows.append({k: list(v) if isinstance(v, tuple) else v for k, v in row.items()})
                            if len(rows) == INDEX_ROWS:
                                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                                rows = []
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(index_schema))
        entries = files.mapInArrow(index, index_schema)
        if not self.has_data:
            return entries.drop("path", "start", "size")

        own = [f.name for f in arrow if f.name not in ("path", "start", "size")]

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path = out = None
            for batch in batches:
                kept = batch.select(own)
                where = zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True)
                data, begin, held = [], 0, 0
                for i, (name, start, size) in enumerate(where, 1):
                    if name != path:  # rows come by path and place
                        if out is not None:
                            out.close()
                        fs, local = _open(name)
                        path, out = name, fs.open_input_file(local)
                    data.append(out.read_at(size, start) if size else b"")
                    held += size
                    if held >= FETCH_BYTES or i == batch.num_rows:
                        yield pa.RecordBatch.from_arrays([*kept.slice(begin, i - begin).columns, pa.array(data, pa.binary())], names=[*own, "data"])
                        data, begin, held = [], i, 0
            if out is not None:
                out.close()

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        kinds = dict(f.strip().split(" ", 1) for f in fields)
        spread = entries.repartition(n, "path", F.floor(F.col("place") / 64)).sortWithinPartitions("path", "start")
        return spread.mapInArrow(fetch, ", ".join([*[f"{c} {kinds[c]}" for c in own], "data binary"]))


#: Bytes of data in a batch that is read, about.
FETCH_BYTES = 16 << 20


class _File:
    """A file under a name of its own until it is whole; a task run again replaces it."""

    def __init__(self, root: str, name: str) -> None:
        self.fs, base = _open(root)
        self.final = f"{base.rstrip('/')}/{name}"
        self.fs.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.final}.{uuid.uuid4().hex}.part"
        self.out, self.entries, self.bytes = self.fs.open_output_stream(self.temporary), 0, 0

    def add(self, data: bytes, entry: bool) -> None:
        self.out.write(data)
        self.entries += entry
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.final, self.entries, self.bytes


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (("rank", pa.int32()), ("section", pa.int32()), ("place", pa.int64()), ("chunk", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


states = Container(STATES_MAGIC, STATES_VERSION, STATES_PATH, STATES, state_entry, _read_state, _STATE.size + _LANE.size)
sidecars = Container(MANTISSA_MAGIC, MANTISSA_VERSION, MANTISSA_PATH, SIDECARS, sidecar_entry, _read_sidecar, _SIDE.size)
tables = Container(TABLES_MAGIC, TABLES_VERSION, TABLES_PATH, TABLES, table_entry, _read_table, _TABLE.size)
