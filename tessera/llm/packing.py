"""Best-fit packing of documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a packing is planned on the counts of each length:
a table of ``capacity`` numbers, whatever the corpus. Pieces above a share of the capacity are put
in groups of equal cardinality and rounded up to the largest of their group; a linear program over
the few rounded sizes finds configurations (column generation, knapsacks priced by dynamic
programming); the documents' own lengths take the places of the rounded ones; what is left over and
the small pieces go by best fit into the space that remains. The plan, runs of equal sequences, is
then applied to the pieces by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm._common import materialise, one_text, partitions, read, running_total, slices
from tessera.llm._tokens import DEFAULT, KIND, Encoder

CAPACITY = 1024
END_ID = 2
#: Lengths above this share of the capacity are grouped.
LARGE = 1 / 3
#: Numbers of groups that are tried; the plan with the fewest sequences counts.
GROUPS = (256, 400)
#: Pieces in a group at least, so that a configuration is used more than once.
LEAST_IN_GROUP = 4
#: Column generation ends after so many steps without gain; any basis on the way is a valid packing.
PATIENCE = 25
#: Pieces aimed at in a bucket of the ranks.
ROWS_PER_BUCKET = 20_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class Plan:
    """Runs of equal sequences: [how many, items as [(length, copies)], space left]."""

    def __init__(self, capacity: int):
        self.capacity, self.by_space = capacity, defaultdict(list)

    def add(self, times: int, items: list[tuple[int, int]], space: int) -> None:
        if times:
            self.by_space[space].append((times, items))

    def best_fit(self, counts: dict[int, int]) -> None:
        """Lengths in descending order into the fullest sequences that take them, else new ones."""
        for size in sorted(counts, reverse=True):
            left = counts[size]
            for space in range(size, self.capacity + 1):
                while left and self.by_space.get(space):
                    times, items = self.by_space[space].pop()
                    left = self._fill(times, items, space, size, left)
                if not left:
                    break
            while left:
                left = self._fill(-(-left // (self.capacity // size)), [], self.capacity, size, left)

    def _fill(self, times: int, items: list, space: int, size: int, left: int) -> int:
        each = space // size
        full = min(times, left // each)
        self.add(full, [*items, (size, each)], space - each * size)
        left, times = left - full * each, times - full
        if times and left:  # fewer than ``each`` remain
            self.add(1, [*items, (size, left)], space - left * size)
            left, times = 0, times - 1
        if items:
            self.add(times, items, space)
        return left

    def runs(self) -> list[tuple[int, list[tuple[int, int]]]]:
        return [(t, i) for space in sorted(self.by_space) for t, i in self.by_space[space]]

    def sequences(self) -> int:
        return sum(t for t, _ in self.runs())


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, copies of each size) whose rounded-down multiplicities cover most of the demand.

    Column generation for: least sum x with A x >= demand. The basis starts with one size a column.
    """
    k, b = len(sizes), np.array(demand, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    best, idle = np.inf, 0
    while idle < PATIENCE:
        x, dual = (inverse * b).sum(axis=1), inverse.sum(axis=0)
        best, idle = (x.sum(), 0) if x.sum() < best * (1 - 1e-6) else (best, idle + 1)
        # the most valuable filling at these prices: unbounded knapsack
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        s, d = np.array(sizes), np.maximum(dual, 0)
        for c in range(min(sizes), capacity + 1):
            ok = np.flatnonzero(s <= c)
            gain = value[c - s[ok]] + d[ok]
            i = int(gain.argmax())
            value[c], choice[c] = gain[i], ok[i]
            if value[c - 1] > value[c]:
                value[c], choice[c] = value[c - 1], -1
        if value[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        direction = (inverse * column).sum(axis=1)
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratio.argmin())
        basis[:, leaving] = column
        inverse[leaving] /= direction[leaving]
        direction[leaving] = 0
        inverse -= np.outer(direction, inverse[leaving])
    x = np.maximum((inverse * b).sum(axis=1), 0)
    if np.abs((basis * x).sum(axis=1) - b).max() > 1e-6 * b.max():  # too much rounding on the way
        x = np.maximum(np.linalg.solve(basis, b), 0)
    return [(int(t + 1e-6), basis[:, j].astype(int).tolist()) for j, t in enumerate(x) if t >= 1 - 1e-6]


def _grouped(counts: dict[int, int], capacity: int, n_groups: int) -> Plan:
    plan = Plan(capacity)
    large = {s: n for s, n in counts.items() if s > capacity * LARGE}
    total = sum(large.values())
    small = {s: n for s, n in counts.items() if s not in large}
    if total:
        # Groups of equal cardinality in descending order of length; each has its own lengths left to give.
        quota = max(LEAST_IN_GROUP, -(-total // n_groups))
        groups: list[list[list[int]]] = [[]]
        room = quota
        for s in sorted(large, reverse=True):
            n = large[s]
            while n:
                if not room:
                    groups.append([])
                    room = quota
                take = min(n, room)
                groups[-1].append([s, take])
                n, room = n - take, room - take
        # Groups that round up to one length are one.
        merged: dict[int, list[list[int]]] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        for times, copies in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            slots = [s for s, c in zip(sizes, copies, strict=True) for _ in range(c)]
            # Documents take the places: runs in which every place keeps one length.
            times = min([times, *(sum(n for _, n in merged[s]) // slots.count(s) for s in set(slots))])
            while times:
                run, used = times, defaultdict(int)
                for s in slots:
                    used[s] += 1
                for s, c in used.items():
                    run = min(run, max(1, merged[s][0][1] // c))
                items: dict[int, int] = defaultdict(int)
                for s in slots:
                    length = merged[s][0][0]
                    items[length] += 1
                    merged[s][0][1] -= run
                    if not merged[s][0][1]:
                        merged[s].pop(0)
                times -= run
                plan.add(run, sorted(items.items(), reverse=True), capacity - sum(a * c for a, c in items.items()))
        rest: dict[int, int] = defaultdict(int)
        for parts in merged.values():
            for s, n in parts:
                rest[s] += n
        plan.best_fit({s: n for s, n in rest.items() if n})
    plan.best_fit(small)
    return plan


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (how many sequences, their (length, copies)) for ``counts`` pieces of each length."""
    counts = {s: n for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("lengths are from 1 to the capacity")
    return min((_grouped(counts, capacity, g) for g in GROUPS), key=Plan.sequences).runs() if counts else []


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Lines (length, first rank, first sequence, copies, offset), sorted by length and rank."""
    lines, sequence, rank = [], 0, defaultdict(int)
    for times, items in runs:
        offset = 0
        for size, copies in items:
            lines.append((size, rank[size], sequence, copies, offset))
            rank[size] += times * copies
            offset += size * copies
        sequence += times
    return np.array(sorted(lines), dtype=np.int64).reshape(-1, 5)


def _key(text: bytes) -> int:
    return xxh3_64_intdigest(text) - (1 << 63)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = DEFAULT) -> DataFrame:
    """doc_id, key, piece, start, length, ids_crc32: the documents' ids cut to the capacity.

    ``key`` tells the rows of a repeated or null doc_id apart as far as their texts differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder.of(path), end_id.to_bytes(4, "little")
        for part, texts in slices(batches, kind=KIND):
            out = [[] for _ in range(6)]
            for doc_id, text, ids in zip(part.column("doc_id").to_pylist(), texts, encoder.encode([t.decode("utf-8", "replace") for t in texts]), strict=True):
                ids += tail
                for i, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, x in zip(out, (doc_id, _key(text), i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        column.append(x)
            kinds = [part.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "key", "piece", "start", "length", "ids_crc32"])

    return one_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = DEFAULT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, key (the text's hash).

    Null and empty texts are the end id alone. Repeated rows are packed one by one. Columns other
    than doc_id and text play no part. Empty input: no rows. The counts of lengths and the plan go
    through the driver: both are bounded by the capacity, not by the corpus.
    """
    cut_up = materialise(pieces(docs, capacity, end_id, path), "pieces")
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    lines = places(plan(counts, capacity))
    # Rank of each piece among those of its length; hashed buckets split a length that many share.
    n_buckets = max(partitions(docs.sparkSession), max(counts.values(), default=0) // ROWS_PER_BUCKET)
    ranked = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(n_buckets)).cast("int"))
    ranked = running_total(ranked, ["length"], "bucket", [F.col("doc_id"), F.col("key"), F.col("piece")], F.lit(1), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (lines[:, 0].astype(object) * (1 << 50) + lines[:, 1]).astype(np.int64)
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size * (1 << 50) + rank, side="right") - 1
            seen, nth = np.divmod(rank - lines[at, 1], lines[at, 3])
            cols = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(lines[at, 2] + seen), pa.array(lines[at, 4] + nth * size), batch.column("key")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "key"])

    return ranked.drop("bucket").mapInArrow(place, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, key long")


def packed_texts(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = DEFAULT) -> DataFrame:
    """The packed sequences: sequence_id, ids (array, in place), doc_ids. Each fits the capacity.

    Rows that repeat a doc_id are told apart by their texts' hash; of rows that agree in both, each has
    its pieces in the sequences. Null ids are ids like others. Empty input: no rows."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder.of(path), end_id.to_bytes(4, "little")
        for part, texts in slices(batches, kind=KIND):
            values = [np.frombuffer(x + tail, "<u4").astype(np.int32) for x in encoder.encode([t.decode("utf-8", "replace") for t in texts])]
            keys = pa.array(map(_key, texts), type=pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), keys, pa.array(values, type=pa.list_(pa.int32()))], names=["_doc", "_key", "all_ids"])

    kind = dict(docs.dtypes)["doc_id"]
    tokens = one_text(docs).mapInArrow(ids, f"_doc {kind}, _key long, all_ids array<int>").dropDuplicates(["_doc", "_key"])
    joined = pack(docs, capacity, end_id, path).join(tokens, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    part = F.struct("offset", F.expr("slice(all_ids, cast(start + 1 AS int), cast(length AS int))").alias("ids"), "doc_id")
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("key")
