"""Token-ID output: length-delimited binary records with masked checksums and an offset index.

A shard is a range of doc_ids. Its data file is a row of records, framed like TFRecord:

    uint64 length | uint32 masked crc of these 8 bytes | payload | uint32 masked crc of the payload

The payload is the int64 doc_id and the ids, little-endian, as uint16 where the vocabulary allows and
else as uint32. Checksums are CRC-32 rotated right by 15 bits plus a constant, so that the checksum
of data holding checksums stays useful. The index file has one line of 28 bytes for each record (int64
doc_id, uint64 offset, uint64 length, uint32 ids) behind a 16-byte head, for reads in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import materialise, one_text, partitions, read, scratch_path, slices
from tessera.llm._tokens import DEFAULT, KIND, Encoder

MAGIC = b"TSRX"
VERSION = 1
_HEAD = struct.Struct("<4sHHQ")  # magic, version, bytes per id, records
_LINE = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n_ids", "<u4")])
#: What a masked checksum adds.
MASK = 0xA282EAD8
#: Text bytes in a shard, about; bounds what one task sorts and writes.
SHARD_BYTES = 16 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(raw: bytes | memoryview, offset: int = 0) -> tuple[bytes, int]:
    """The payload at ``offset`` and the offset behind it; raises on any damage."""
    size = bytes(raw[offset : offset + 8])
    if len(size) < 8 or struct.pack("<I", masked(size)) != bytes(raw[offset + 8 : offset + 12]):
        raise ValueError(f"damaged length at {offset}")
    end = offset + 12 + int.from_bytes(size, "little")
    payload = bytes(raw[offset + 12 : end])
    if struct.pack("<I", masked(payload)) != bytes(raw[end : end + 4]):
        raise ValueError(f"damaged record at {offset}")
    return payload, end + 4


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that pyarrow knows (file, hdfs, s3, gs ...); executors need no driver folder."""
    return pafs.FileSystem.from_uri(uri)


def write_shard(root: str, rows: Iterator[tuple[int, bytes]], width: int) -> tuple[str, int, int]:
    """Write (doc_id, uint32 ids) rows; the shard's name, records and ids. A name is used once, so a
    task that is run again leaves an orphan behind and never half a file under a used name."""
    name = uuid.uuid4().hex
    fs, path = _open(root)
    fs.create_dir(path, recursive=True)
    lines, offset, total = [], 0, 0
    with fs.open_output_stream(f"{path}/{name}.rec") as out:
        for doc_id, ids in rows:
            n = len(ids) // 4
            record = frame(struct.pack("<q", doc_id) + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids))
            out.write(record)
            lines.append((doc_id, offset, len(record), n))
            offset += len(record)
            total += n
    with fs.open_output_stream(f"{path}/{name}.idx") as out:
        out.write(_HEAD.pack(MAGIC, VERSION, width, len(lines)) + np.array(lines, dtype=_LINE).tobytes())
    return name, len(lines), total


def read_index(root: str, name: str) -> tuple[np.ndarray, int]:
    fs, path = _open(root)
    with fs.open_input_stream(f"{path}/{name}.idx") as f:
        raw = f.read()
    magic, version, width, n = _HEAD.unpack_from(raw)
    lines = np.frombuffer(raw, dtype=_LINE, offset=_HEAD.size)
    if magic != MAGIC or version != VERSION or len(lines) != n:
        raise ValueError(f"damaged index {name}")
    return lines, width


def read_records(root: str, name: str, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids as uint32) of a shard: as stored, or the index lines in ``order``, for shuffled reads."""
    lines, width = read_index(root, name)
    fs, path = _open(root)
    if order is None:
        with fs.open_input_stream(f"{path}/{name}.rec") as f:
            for line in lines:
                payload, _ = unframe(f.read(int(line["length"])))
                yield _record(payload, width, line)
    else:
        with fs.open_input_file(f"{path}/{name}.rec") as f:
            for line in lines[order]:
                payload, _ = unframe(f.read_at(int(line["length"]), int(line["offset"])))
                yield _record(payload, width, line)


def _record(payload: bytes, width: int, line: np.void) -> tuple[int, np.ndarray]:
    doc_id = int.from_bytes(payload[:8], "little", signed=True)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=8).astype("<u4")
    if doc_id != line["doc_id"] or len(ids) != line["n_ids"]:
        raise ValueError("index and records differ")
    return doc_id, ids


def write(docs: DataFrame, root: str, end_id: int | None = 0, path: str = DEFAULT) -> DataFrame:
    """Write all documents under ``root`` and return the manifest: shard, name, records, ids.

    Shards are in ascending order of doc_id, and so are the records inside. Null texts count as empty
    (their record holds the end id alone). Rows with one doc_id stay side by side, by their text's
    hash; null ids are written as the smallest, -2^63. Columns other than doc_id and text are ignored.
    Empty input: no shards.
    """
    spark = docs.sparkSession
    rows = one_text(docs).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    # A shard is a range of (doc_id, text hash), cut by Spark's sampled splitters; its number is the partition's.
    order = [F.col("doc_id"), F.xxhash64("text")]
    n_shards = max(partitions(spark), -(-size // SHARD_BYTES))
    rows = rows.repartitionByRange(n_shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        width = 2 if max(encoder.size, (end_id or 0) + 1) <= 1 << 16 else 4
        pending = _ids(batches, encoder, tail)
        row = next(pending, None)
        while row is not None:  # as a rule one shard per partition
            shard, state = row[0], [row]

            def own(shard=shard, state=state):
                while state[0] is not None and state[0][0] == shard:
                    yield state[0][1:]
                    state[0] = next(pending, None)

            name, records, ids = write_shard(root, own(), width)
            row = state[0]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "records": pa.array([records], pa.int64()), "ids": pa.array([ids], pa.int64())})

    return materialise(rows.mapInArrow(run, "shard int, name string, records long, ids long"), "manifest")


def _ids(batches: Iterator[pa.RecordBatch], encoder: Encoder, tail: bytes) -> Iterator[tuple[int, int, bytes]]:
    for part, texts in slices(batches, kind=KIND):
        ids = encoder.encode([t.decode("utf-8", "replace") for t in texts])
        yield from ((s, d, x + tail) for s, d, x in zip(part.column("shard").to_pylist(), part.column("doc_id").to_pylist(), ids, strict=True))


def read_back(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files. ``start`` counts the ids of
    all records before. The running sum covers shards, not documents."""
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(W.orderBy("shard", "name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, out = r["before"], []
                for doc_id, ids in read_records(root, r["name"]):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(out) == 10_000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return placed.repartition(partitions(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "records")
    return read_back(write(read(spark, sf_dir, "documents"), root), root)
