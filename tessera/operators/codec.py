"""Entropy codecs and the pair grammar: the parts that run symbol by symbol.

What runs in one call is a chunk of a tensor, so its size is bounded whatever the tensor's. Frequency
tables are made from SQL counts, rules from a representative chunk; both travel with the chunks.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import safe_div
from tessera.operators.symbols import table_log
from tessera.plans.running import running_total
from tessera.plans.scratch import materialise

SCALE_BITS, LANES, LOW = 12, 256, 1 << 23
M = 1 << SCALE_BITS
#: Symbols of the largest tANS table. A larger vocabulary is split into pages of so many words, in their order.
PAGE = 1 << 16
#: Words of the largest vocabulary: the table of its pages is a tANS table too. All 32-bit words fit.
MAX_VOCABULARY = PAGE * PAGE


def normalise(hist: np.ndarray, size: int = M, full: bool = False) -> np.ndarray:
    """Frequencies that sum to ``size``: proportional, at least 1 for every symbol present (or all, if
    ``full``). Missing slots go to the largest fractions, surplus ones come off the smallest, in as many
    passes as it takes; ties by symbol. An empty histogram gives symbol 0 everything."""
    hist = np.asarray(hist, dtype=np.int64)
    present = np.ones(len(hist), dtype=bool) if full else hist > 0
    if not present.any():
        out = np.zeros(len(hist), dtype=np.int64)
        out[0] = size
        return out
    if present.sum() > size:
        raise ValueError("more symbols than slots")
    exact = np.where(present, np.maximum(hist, 1 if full else 0) * size / max(1, hist.sum()), 0)
    out = np.where(present, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
    order = np.lexsort((np.arange(len(hist)), -(exact - np.floor(exact))))
    order = order[present[order]]
    while (gap := size - int(out.sum())) != 0:
        some = order[:gap] if gap > 0 else order[::-1][out[order[::-1]] > 1][:-gap]
        out[some] += 1 if gap > 0 else -1
    return out


def rans_encode(data: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Final states and bytes of the lanes; lane = position mod 256, last symbol first."""
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.uint64)
    f = freq.astype(np.uint64)
    if len(data) and (freq[data] == 0).any():
        raise ValueError("a symbol without a frequency")
    rows = -(-len(data) // LANES)
    x, out = np.full(LANES, LOW, dtype=np.uint64), [bytearray() for _ in range(LANES)]
    for k in range(rows - 1, -1, -1):
        part = data[k * LANES : (k + 1) * LANES]
        n = len(part)
        fs, xs = f[part], x[:n]
        limit = fs << np.uint64(19)
        while (over := np.flatnonzero(xs >= limit)).size:
            for lane in over:
                out[lane].append(int(xs[lane]) & 255)
            xs[over] >>= np.uint64(8)
        x[:n] = ((xs // fs) << np.uint64(SCALE_BITS)) + cum[part] + xs % fs
    return x.astype(np.int64), [bytes(b[::-1]) for b in out]


def rans_decode(n: int, state: np.ndarray, lanes: list[bytes], freq: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(freq)]).astype(np.int64)
    symbol = np.repeat(np.arange(len(freq)), freq)
    x, at, out = state.astype(np.int64).copy(), np.zeros(LANES, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for k in range(-(-n // LANES)):
        width = min(LANES, n - k * LANES)
        slot = x[:width] & (M - 1)
        s = symbol[slot]
        out[k * LANES : k * LANES + width] = s
        x[:width] = freq[s] * (x[:width] >> SCALE_BITS) + slot - cum[s]
        while (under := np.flatnonzero(x[:width] < LOW)).size:
            for lane in under:
                x[lane] = (x[lane] << 8) | lanes[lane][at[lane]]
            at[under] += 1
    return out


def tans_quantise(cnt: np.ndarray, size: int) -> np.ndarray:
    return normalise(cnt, size)


def tans_table(freq: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """(symbols by slot, (symbol, x) -> state): slots are spread by a fixed odd step."""
    size = int(freq.sum())
    step, slot = (size >> 1) + (size >> 3) + 3, 0
    spread = np.zeros(size, dtype=np.int64)
    for s, f in enumerate(freq):
        for _ in range(int(f)):
            spread[slot] = s
            slot = (slot + step) & (size - 1)
    seen, to = Counter(), {}
    for i, s in enumerate(spread.tolist()):
        to[s, int(freq[s]) + seen[s]] = size + i
        seen[s] += 1
    return spread, to


def tans_encode(data: list[int], freq: np.ndarray, table) -> tuple[int, list[int]]:
    """Final state and bits, last symbol first."""
    size = int(freq.sum())
    x, bits, to = size, [], table[1]
    for s in reversed(data):
        while x >= 2 * int(freq[s]):
            bits.append(x & 1)
            x >>= 1
        x = to[s, x]
    return x, bits


def tans_decode(n: int, x: int, bits: list[int], freq: np.ndarray, table) -> list[int]:
    size, spread, at, out = int(freq.sum()), table[0].tolist(), len(bits), []
    back = {state: key for key, state in table[1].items()}
    del spread
    for _ in range(n):
        s, x = back[x]
        out.append(s)
        while x < size:
            at -= 1
            x = (x << 1) | bits[at]
    return out


def grammar(tokens, max_rules: int = 50) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Greedy pairs: the most frequent neighbours (ties: the smaller pair) become a new symbol.
    Stops below two occurrences or when nothing shrinks. Rules: (symbol, left, right, count)."""
    tokens, rules = np.asarray(tokens, dtype=np.int64), []
    for i in range(max_rules):
        if len(tokens) < 2:
            break
        names, codes = np.unique(tokens, return_inverse=True)
        pairs, n = np.unique(codes[:-1] * len(names) + codes[1:], return_counts=True)
        at = int(n.argmax())  # names ascend, so the first of the most frequent is the smallest pair
        a, b = int(names[pairs[at] // len(names)]), int(names[pairs[at] % len(names)])
        if n[at] < 2:
            break
        new = replace(tokens, a, b, -1 - i)
        if len(new) >= len(tokens):
            break
        tokens = new
        rules.append((-1 - i, a, b, int(n[at])))
    return tokens, rules


def replace(tokens, a: int, b: int, by: int) -> np.ndarray:
    """Pairs (a, b) from the left, without overlap, become ``by``."""
    tokens = np.asarray(tokens, dtype=np.int64)
    at = np.flatnonzero((tokens[:-1] == a) & (tokens[1:] == b)) if len(tokens) > 1 else np.zeros(0, dtype=np.int64)
    if a == b and len(at):  # in a run, every other one
        start = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))) % 2 == 0]
    out = tokens.copy()
    out[at] = by
    return np.delete(out, at + 1)


def apply_rules(tokens, rules: list[tuple[int, int, int, int]]) -> np.ndarray:
    for r, a, b, _ in rules:
        tokens = replace(tokens, a, b, r)
    return np.asarray(tokens, dtype=np.int64)


def expand(tokens, rules: list[tuple[int, int, int, int]]) -> np.ndarray:
    tokens = np.asarray(tokens, dtype=np.int64)
    for r, a, b, _ in reversed(rules):
        hit = tokens == r
        first = np.flatnonzero(np.repeat(hit, 1 + hit)) if hit.any() else np.zeros(0, dtype=np.int64)
        tokens = np.repeat(tokens, 1 + hit)
        tokens[first[0::2]], tokens[first[1::2]] = a, b
    return tokens


def tans_code(codes: np.ndarray, freq: np.ndarray) -> tuple[int, int]:
    """Bits and wrong symbols of a round trip; codes are positions in the vocabulary of ``freq``."""
    table = tans_table(freq)
    x, bits = tans_encode(codes.tolist(), freq, table)
    back = tans_decode(len(codes), x, bits, freq, table)
    return len(bits), int((np.array(back, dtype=np.int64) != codes).sum())


def _by_page(at: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The pages that occur, in order, and the places of each."""
    order = np.argsort(at, kind="stable")
    pages, start = np.unique(at[order], return_index=True)
    return list(zip(pages.tolist(), np.split(order, start[1:]), strict=True)) if len(at) else []


def paged_code(codes: np.ndarray, cnt: np.ndarray, page: int = PAGE) -> tuple[int, int]:
    """Bits and wrong symbols of a round trip under tables of the vocabulary's counts; codes are positions in it.
    With several pages the numbers of the pages are coded too, and the bits hold 64 for each page's count."""

    def once(codes: np.ndarray, cnt: np.ndarray) -> tuple[int, int]:
        return tans_code(codes, tans_quantise(cnt, 1 << table_log(len(cnt))))

    if len(cnt) <= page:
        return once(codes, cnt)
    at, starts = codes // page, np.arange(0, len(cnt), page)
    bits, wrong = once(at, np.add.reduceat(cnt, starts))
    bits += 64 * len(starts)
    for p, places in _by_page(at):
        more, bad = once(codes[places] - p * page, cnt[p * page : (p + 1) * page])
        bits, wrong = bits + more, wrong + bad
    return bits, wrong


def tans_chunk(codes: np.ndarray, freq: np.ndarray, table) -> bytes:
    """A chunk on the wire: symbols (u32), final state (i64), bits (i64), words (u32), then 64-bit words.
    Raises if it doesn't decode to what it was made of."""
    x, bits = tans_encode(codes.tolist(), freq, table)
    packed = np.packbits(np.array([*bits, *[0] * (-len(bits) % 64)], dtype=np.uint8), bitorder="little")
    out = struct.pack("<IqqI", len(codes), x, len(bits), len(packed) // 8) + packed.tobytes()
    if not np.array_equal(tans_unchunk(out, freq, table)[0], codes):
        raise ValueError("a chunk doesn't decode to its symbols")
    return out


_CHUNK = struct.Struct("<IqqI")


def tans_unchunk(raw: bytes, freq: np.ndarray, table, at: int = 0) -> tuple[np.ndarray, int]:
    """Symbols of the chunk at ``at``, and where the next one begins."""
    n, x, n_bits, n_words = _CHUNK.unpack_from(raw, at)
    at += _CHUNK.size
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, 8 * n_words, at), bitorder="little")[:n_bits]
    return np.array(tans_decode(n, x, bits.tolist(), freq, table), dtype=np.int64), at + 8 * n_words


def _chunk_end(raw: bytes, at: int) -> int:
    return at + _CHUNK.size + 8 * _CHUNK.unpack_from(raw, at)[3]


#: Symbols in a chunk.
CHUNK_SYMBOLS = 2_000_000


def tans_streams(t: DataFrame, page: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(streams: cluster, tensor_id, chunk, n, data; tables: those of ``vocabularies``) of rows (cluster,
    tensor_id, pos, word): whole words under the tables of their cluster. A tensor's stream is its chunks in
    order. The data of a chunk is one tANS chunk or, where the cluster has several pages of ``page`` (PAGE)
    words, that of the page numbers and then one for each page that occurs, in order. Clusters with more than
    MAX_VOCABULARY words raise."""
    tables = materialise(vocabularies(t, page=page), "tables")
    rows = _gathered(t.withColumn("chunk", F.floor(F.col("pos") / CHUNK_SYMBOLS)), "cluster", "tensor_id", "chunk")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.words is None:
                    raise ValueError("too many symbols for a table")
                freq = np.asarray(r.freq, dtype=np.int64)
                codes = np.searchsorted(np.asarray(r.words, dtype=np.int64), np.frombuffer(r.part, "<u4").astype(np.int64))
                out.append((r.cluster, r.tensor_id, r.chunk, r.page, len(codes), tans_chunk(codes, freq, tans_table(freq))))
            yield pd.DataFrame(out, columns=["cluster", "tensor_id", "chunk", "page", "n", "data"])

    parts = _split(rows, tables).mapInPandas(run, "cluster string, tensor_id string, chunk long, page long, n long, data binary")
    joined = F.unhex(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("page", F.hex("data").alias("h")))), lambda x: x["h"])))
    return parts.groupBy("cluster", "tensor_id", "chunk").agg(F.sum(F.when(F.col("page") >= 0, F.col("n"))).alias("n"), joined.alias("data")), tables


def tans_words(streams: DataFrame, tables: DataFrame) -> DataFrame:
    """tensor_id, chunk, words (little-endian bytes) out of streams and tables. Streams without a table raise."""
    numbers = tables.filter("page < 0").select(F.col("cluster").alias("_c"), "words", "freq")
    rows = streams.join(numbers, F.col("cluster").eqNullSafe(F.col("_c")), "left").select("cluster", "tensor_id", "chunk", "data", "words", "freq")

    def open_(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.words is None:
                    parts = [(0, r.data)]
                else:
                    freq = np.asarray(r.freq, dtype=np.int64)
                    pages, at = tans_unchunk(r.data, freq, tans_table(freq))
                    parts = [(-1, pages.astype("<u4").tobytes())]
                    for p in np.unique(pages).tolist():
                        end = _chunk_end(r.data, at)
                        parts.append((p, r.data[at:end]))
                        at = end
                yield pd.DataFrame([(r.cluster, r.tensor_id, r.chunk, p, x) for p, x in parts], columns=["cluster", "tensor_id", "chunk", "page", "part"])

    def decode(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.words is None:
                    raise ValueError("a stream without a table")
                part = r.part
                if r.page >= 0:
                    freq = np.asarray(r.freq, dtype=np.int64)
                    codes, _ = tans_unchunk(part, freq, tans_table(freq))
                    part = np.asarray(r.words, dtype=np.int64)[codes].astype("<u4").tobytes()
                out.append((r.cluster, r.tensor_id, r.chunk, r.page, part))
            yield pd.DataFrame(out, columns=["cluster", "tensor_id", "chunk", "page", "part"])

    def together(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                parts = [np.frombuffer(x["part"], "<u4") for x in r.x]
                words = np.concatenate(parts[1:]) if len(parts) > 1 else parts[0]
                if len(parts) > 1:  # by page, in their order; the first part tells which is where
                    words, by = np.empty_like(words), words
                    words[np.argsort(parts[0], kind="stable")] = by
                yield pd.DataFrame({"tensor_id": [r.tensor_id], "chunk": [r.chunk], "words": [words.tobytes()]})

    schema = "cluster string, tensor_id string, chunk long, page long, part binary"
    parts = _tabled(rows.mapInPandas(open_, schema), tables).mapInPandas(decode, schema)
    whole = parts.groupBy("cluster", "tensor_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("page", "part"))).alias("x"))
    return whole.select("tensor_id", "chunk", "x").mapInPandas(together, "tensor_id string, chunk long, words binary")


def save_streams(streams: DataFrame, tables: DataFrame, path: str) -> None:
    """Streams and tables under ``path``, streams by cluster."""
    streams.write.mode("overwrite").parquet(f"{path}/streams")
    tables.write.mode("overwrite").parquet(f"{path}/tables")


def load_streams(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/streams"), spark.read.parquet(f"{path}/tables")


def compare_tables(shared: DataFrame) -> DataFrame:
    """One row over ``shared_tables``: bytes of streams and tables with a table per chunk and with one per
    cluster, each counted once, their totals, and the ratio to the words as they are. Wrong symbols raise."""
    wrong = F.col("own_mismatches") + F.col("shared_mismatches") + F.col("rans_mismatches")
    checked = shared.filter(F.when(wrong == 0, True).otherwise(F.raise_error(F.concat(F.lit("wrong symbols in "), "tensor_id")).cast("boolean")))
    whole = lambda c: F.coalesce(F.sum(F.floor((F.col(c) + 7) / 8)), F.lit(0))
    t = checked.agg((F.coalesce(F.sum("n"), F.lit(0)) * 4).alias("raw_bytes"), whole("own_bits").alias("own_stream_bytes"), F.coalesce(F.sum("own_table_bytes"), F.lit(0)).alias("own_table_bytes"), whole("shared_bits").alias("shared_stream_bytes"), F.coalesce(F.sum("shared_table_bytes"), F.lit(0)).alias("shared_table_bytes"))
    for x in ("own", "shared"):
        total = F.col(f"{x}_stream_bytes") + F.col(f"{x}_table_bytes")
        t = t.withColumn(f"{x}_total_bytes", total).withColumn(f"{x}_ratio", safe_div(F.col("raw_bytes").cast("double"), total))
    return t


def rans_tables(c: DataFrame) -> DataFrame:
    """tensor_id, byte, norm_freq, cum_freq, x_max of byte counts (tensor_id, byte, cnt): bytes that occur alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        freq = normalise(np.bincount(pdf["byte"], weights=pdf["cnt"], minlength=256))
        cum, at = np.cumsum(freq) - freq, np.flatnonzero(freq)
        return pd.DataFrame({"tensor_id": pdf["tensor_id"].iloc[0], "byte": at, "norm_freq": freq[at], "cum_freq": cum[at], "x_max": freq[at] << 19})

    return c.groupBy("tensor_id").applyInPandas(run, "tensor_id string, byte int, norm_freq long, cum_freq long, x_max long")


def _masked(words: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bytes of the upper halves, and the lower halves as they are."""
    raw = np.ascontiguousarray(words.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return raw[:, 2:].ravel().astype(np.int64), raw[:, :2].tobytes()


def roundtrip(bytes_: DataFrame) -> DataFrame:
    """Per (tensor_id, chunk) of rows (tensor_id, chunk, pos, word): sizes and mismatches of rANS over the
    masked bytes (upper half of each word; the lower half is a raw sidecar) and of tANS over whole words,
    with the tables of their own vocabulary (in pages of PAGE words). tans_log is that of the largest table.
    More than MAX_VOCABULARY words have no table and stay raw."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf.sort_values("pos")["word"].to_numpy("int64")
        high, _ = _masked(words)
        freq = normalise(np.bincount(high, minlength=256))
        state, lanes = rans_encode(high, freq)
        size = sum(map(len, lanes))
        wrong = int((rans_decode(len(high), state, lanes, freq) != high).sum())
        names, codes = np.unique(words, return_inverse=True)
        log, plain = table_log(len(names)), len(names) > MAX_VOCABULARY
        bits, wrong_tans = (32 * len(words), 0) if plain else paged_code(codes, np.bincount(codes))
        return pd.DataFrame({"tensor_id": [pdf["tensor_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "n": [len(words)], "rans_bytes": [min(size, len(high))], "is_raw": [size >= len(high)], "sidecar_bytes": [2 * len(words)], "tans_symbols": [len(names)], "tans_log": [log], "tans_raw": [plain], "tans_bits": [bits], "rans_mismatches": [wrong], "tans_mismatches": [wrong_tans], "freq_sum": [int(freq.sum())]})

    return bytes_.groupBy("tensor_id", "chunk").applyInPandas(run, "tensor_id string, chunk long, n long, rans_bytes long, is_raw boolean, sidecar_bytes long, tans_symbols long, tans_log int, tans_raw boolean, tans_bits long, rans_mismatches long, tans_mismatches long, freq_sum long")


def anchors(t: DataFrame) -> DataFrame:
    """Per cluster of rows (cluster, tensor_id, word): its first tensor and that one's rANS table over the
    masked bytes. In clusters of several tensors it has the full alphabet, so that any other tensor can be
    coded with it; a tensor alone needs only the bytes that occur."""
    first = t.groupBy("cluster").agg(F.min("tensor_id").alias("anchor"), (F.max("tensor_id") != F.min("tensor_id")).alias("several"))
    own = t.join(first.select(F.col("cluster").alias("_c"), "anchor", "several"), F.col("cluster").eqNullSafe(F.col("_c")) & (F.col("tensor_id") == F.col("anchor")))
    byte = F.explode(F.array(*[F.shiftright("word", k).bitwiseAND(255).cast("int") for k in (16, 24)]))
    hist = own.select("cluster", "anchor", "several", byte.alias("byte")).groupBy("cluster", "anchor", "several", "byte").agg(F.count(F.lit(1)).alias("cnt"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        freq = normalise(np.bincount(pdf["byte"], weights=pdf["cnt"], minlength=256), full=bool(pdf["several"].iloc[0]))
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "anchor": [pdf["anchor"].iloc[0]], "norm_freq": [freq.tolist()]})

    return hist.groupBy("cluster").applyInPandas(run, "cluster string, anchor string, norm_freq array<long>")  # 256 rows a group


def vocabularies(t: DataFrame, most: int | None = None, page: int | None = None) -> DataFrame:
    """Per cluster of rows (cluster, word): the merged vocabulary and its tANS frequencies as rows (cluster, page,
    words, freq); clusters of more than ``most`` (MAX_VOCABULARY) words have no row.

    Page p has the words of ranks p * ``page`` (PAGE) on. Where there are several, page -1 is the table of
    their numbers. So no task holds more than a page's words or a number for each page."""
    most, page = most or MAX_VOCABULARY, page or PAGE
    merged = t.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("cnt"))
    fit = merged.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select(F.col("cluster").alias("_c"))
    merged = merged.join(fit, F.col("cluster").eqNullSafe(F.col("_c"))).select("cluster", "word", "cnt")
    ranked = running_total(merged, ["cluster"], [F.col("word")], F.lit(1), "rank")
    paged = ranked.select("cluster", F.floor(F.col("rank") / page).alias("page"), "word", "cnt")
    numbers = paged.groupBy("cluster", F.col("page").alias("word")).agg(F.sum("cnt").alias("cnt"))
    split = numbers.filter("word = 1").select(F.col("cluster").alias("_c"))
    numbers = numbers.join(split, F.col("cluster").eqNullSafe(F.col("_c"))).select("cluster", F.lit(-1).cast("long").alias("page"), "word", "cnt")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        freq = tans_quantise(pdf["cnt"].to_numpy("int64"), 1 << table_log(len(pdf)))
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "page": [pdf["page"].iloc[0]], "words": [pdf["word"].tolist()], "freq": [freq.tolist()]})

    return paged.unionByName(numbers).groupBy("cluster", "page").applyInPandas(run, "cluster string, page long, words array<long>, freq array<long>")


def _split(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks (cluster, tensor_id, chunk, word) by the pages of their cluster's ``vocabularies``, joined to the
    tables: cluster, tensor_id, chunk, page, part, words, freq. A part is what words a chunk has of a page, in
    their order, as little-endian bytes; that of page -1 is the page number of every word. Clusters without
    tables have one part of page 0, and no table."""
    firsts = tables.filter("page >= 0").groupBy(F.col("cluster").alias("_c")).agg(F.sort_array(F.collect_list(F.element_at("words", 1))).alias("firsts"))
    rows = rows.join(firsts, F.col("cluster").eqNullSafe(F.col("_c")), "left").select("cluster", "tensor_id", "chunk", "word", "firsts")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words, firsts = np.asarray(r.word, dtype=np.int64), np.asarray([0] if r.firsts is None else r.firsts, dtype=np.int64)
                at = np.searchsorted(firsts, words, side="right") - 1
                parts = [(p, words[places]) for p, places in _by_page(at)] + ([(-1, at)] if len(firsts) > 1 else [])
                yield pd.DataFrame([(r.cluster, r.tensor_id, r.chunk, p, x.astype("<u4").tobytes()) for p, x in parts], columns=["cluster", "tensor_id", "chunk", "page", "part"])

    return _tabled(rows.mapInPandas(run, "cluster string, tensor_id string, chunk long, page long, part binary"), tables)


def _tabled(parts: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of (cluster, page) with words and freq of their table; null where there is none."""
    parts = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cluster", "page")
    t = tables.select(F.col("cluster").alias("_c"), F.col("page").alias("_p"), "words", "freq")
    return parts.join(t, F.col("cluster").eqNullSafe(F.col("_c")) & (F.col("page") == F.col("_p")), "left").drop("_c", "_p")


def _gathered(t: DataFrame, *keys: str) -> DataFrame:
    return t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x")).select(*keys, F.col("x.word").alias("word"))


def shared_tables(t: DataFrame, page: int | None = None) -> DataFrame:
    """Per (cluster, tensor_id, chunk) of rows (cluster, tensor_id, chunk, pos, word): tANS with the chunk's
    own tables against those merged over the cluster, and rANS with the table of the cluster's anchor.

    Table bytes are 8 a symbol, the cluster's counted once, with the first chunk of its anchor. Vocabularies
    of more than ``page`` (PAGE) words have several tables; the bits hold the page numbers then, and 64 for each
    page's count, the cluster's counted with its table bytes. What has no table stays raw at 32 bits a word."""
    page = page or PAGE
    keys = ("cluster", "tensor_id", "chunk")
    tables = materialise(vocabularies(t, page=page), "tables")
    first = t.groupBy("cluster", "tensor_id").agg(F.min("chunk").alias("first")).select(F.col("cluster").alias("_k"), F.col("tensor_id").alias("_t"), "first")
    chunks = _gathered(t, *keys)
    rows = chunks.join(first, F.col("cluster").eqNullSafe(F.col("_k")) & (F.col("tensor_id") == F.col("_t"))).drop("_k", "_t")
    rows = rows.join(anchors(t).withColumnRenamed("cluster", "_c"), F.col("cluster").eqNullSafe(F.col("_c"))).drop("_c")

    def one(r) -> tuple:
        words = np.asarray(r.word, dtype=np.int64)
        names, codes = np.unique(words, return_inverse=True)
        own, wrong = paged_code(codes, np.bincount(codes), page)
        high, _ = _masked(words)
        freq = np.asarray(r.norm_freq, dtype=np.int64)
        state, lanes = rans_encode(high, freq)
        size = sum(map(len, lanes))
        wrong_rans = int((rans_decode(len(high), state, lanes, freq) != high).sum())
        return (r.cluster, r.tensor_id, r.chunk, r.anchor, len(words), own, 8 * len(names), min(size, len(high)), wrong, wrong_rans, r.tensor_id == r.anchor and r.chunk == r.first)

    schema = "cluster string, tensor_id string, chunk long, anchor string, n long, own_bits long, own_table_bytes long, rans_bytes long, own_mismatches long, rans_mismatches long, charged boolean"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=[f.strip().split(" ")[0] for f in schema.split(",")])

    def code(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                words = np.frombuffer(r.part, "<u4").astype(np.int64)
                plain = r.words is None
                bits, wrong = (32 * len(words), 0) if plain else tans_code(np.searchsorted(np.asarray(r.words, dtype=np.int64), words), np.asarray(r.freq, dtype=np.int64))
                out.append((r.cluster, r.tensor_id, r.chunk, bits, wrong, plain))
            yield pd.DataFrame(out, columns=["_k", "_t", "_n", "bits", "wrong", "plain"])

    parts = _split(chunks, tables).mapInPandas(code, "_k string, _t string, _n long, bits long, wrong long, plain boolean")
    parts = parts.groupBy("_k", "_t", "_n").agg(F.sum("bits").alias("bits"), F.sum("wrong").alias("wrong"), F.max("plain").alias("plain"))
    sizes = tables.groupBy(F.col("cluster").alias("_c")).agg(
        F.coalesce(F.sum(F.when(F.col("page") >= 0, F.size("words"))), F.lit(0)).alias("symbols"), F.coalesce(F.sum(F.when(F.col("page") < 0, F.size("words"))), F.lit(0)).alias("pages")
    )
    x = rows.mapInPandas(run, schema).join(parts, F.col("cluster").eqNullSafe(F.col("_k")) & (F.col("tensor_id") == F.col("_t")) & (F.col("chunk") == F.col("_n")))
    x = x.join(sizes, F.col("cluster").eqNullSafe(F.col("_c")), "left")
    once = lambda c: F.when(F.col("charged"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return x.select(
        *keys, "anchor", "n", "own_bits", "own_table_bytes", (F.col("bits") + 64 * once("pages")).alias("shared_bits"), (8 * once("symbols")).alias("shared_table_bytes"),
        F.col("plain").alias("shared_raw"), "rans_bytes", "own_mismatches", F.col("wrong").alias("shared_mismatches"), "rans_mismatches",
    )


def coded(t: DataFrame) -> DataFrame:
    """Chunks of rows (rank, cluster, tensor_id, chunk, pos, word) as rANS states under their anchor's table:
    what ``containers.states`` needs but for the place, and the sidecar's bytes. Where coding doesn't
    shrink the masked bytes, they are held as they are."""
    rows = _gathered(t, "rank", "cluster", "tensor_id", "chunk").join(anchors(t).withColumnRenamed("cluster", "_c"), F.col("cluster").eqNullSafe(F.col("_c"))).drop("_c")

    def one(r) -> tuple:
        high, side = _masked(np.asarray(r.word, dtype=np.int64))
        state, lanes = rans_encode(high, np.asarray(r.norm_freq, dtype=np.int64))
        plain = sum(map(len, lanes)) >= len(high) > 0
        sizes = [len(high), *[0] * (LANES - 1)] if plain else [len(x) for x in lanes]
        data = high.astype(np.uint8).tobytes() if plain else b"".join(lanes)
        offsets = (np.cumsum(sizes) - sizes).tolist()
        return (r.rank, f"{r.tensor_id}/{r.chunk}", r.anchor, r.tensor_id == r.anchor, plain, len(high), len(high) // 2, [0] * LANES if plain else state.tolist(), sizes, offsets, data, side, r.norm_freq.tolist())

    schema = "rank int, name string, anchor_name string, owns_table boolean, is_raw boolean, original_bytes long, num_elements long, final_states array<long>, byte_counts array<long>, buf_offsets array<long>, data binary, side binary, norm_freq array<long>"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=[f.strip().split(" ")[0] for f in schema.split(",")])

    return rows.mapInPandas(run, schema)


def decoded(rows: DataFrame) -> DataFrame:
    """(rank, name, words) of rows (rank, name, is_raw, original_bytes, final_states, byte_counts, buf_offsets,
    data, side, norm_freq): the little-endian words that were coded."""

    def one(r) -> tuple:
        if r.is_raw:
            high = np.frombuffer(r.data, np.uint8)
        else:
            lanes = [r.data[a : a + n] for a, n in zip(r.buf_offsets.tolist(), r.byte_counts.tolist(), strict=True)]
            high = rans_decode(r.original_bytes, np.asarray(r.final_states, dtype=np.int64), lanes, np.asarray(r.norm_freq, dtype=np.int64))
        out = np.empty((len(high) // 2, 4), dtype=np.uint8)
        out[:, :2], out[:, 2:] = np.frombuffer(r.side, np.uint8).reshape(-1, 2), high.reshape(-1, 2)
        return r.rank, r.name, out.tobytes()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=["rank", "name", "words"])

    return rows.mapInPandas(run, "rank int, name string, words binary")


#: Storage and mantissa bits of a word.
WORD_BITS, MANTISSA_BITS = 32, 23


def shared_grammar(rows: DataFrame, max_rules: int = 50, masked_bits: int | None = None, total_bits: int = WORD_BITS, mantissa_bits: int = MANTISSA_BITS) -> DataFrame:
    """Per tensor of rows (grp, tensor_id, place, is_representative, pos, word): sizes under the rules of its
    group's representative.

    Words lose their low ``masked_bits`` (all of the mantissa unless given, and no more than that), which
    are kept raw. Rules are made from the representative's words alone, and every tensor is coded by itself,
    so a task holds one tensor. The grammar is charged to the first place of the group. restored_sha256 is
    that of the little-endian words put together again from tokens, rules and residual. A group without a
    representative raises.
    """
    k = mantissa_bits if masked_bits is None else min(masked_bits, mantissa_bits)
    own = rows.groupBy("grp", "tensor_id").agg(F.min("place").alias("place"), F.max("is_representative").alias("is_representative"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x"))
    own = own.select("grp", "tensor_id", "place", "is_representative", F.col("x.word").alias("words"))
    head = "grp string, rules array<array<long>>"

    def learn(batches):
        for pdf in batches:
            yield pd.DataFrame([(r.grp, [list(x) for x in grammar(np.asarray(r.words, dtype=np.int64) >> k, max_rules)[1]]) for r in pdf.itertuples(index=False)], columns=["grp", "rules"])

    rules = materialise(own.filter("is_representative").select("grp", "words").mapInPandas(learn, head), "rules")
    first = rows.groupBy(F.col("grp").alias("_g")).agg(F.min("place").alias("first"))
    j = own.join(rules.withColumnRenamed("grp", "_r"), F.col("grp").eqNullSafe(F.col("_r")), "left").join(first, F.col("grp").eqNullSafe(F.col("_g")))
    j = j.filter(F.when(F.col("rules").isNull(), F.raise_error(F.concat(F.lit("missing representative of group "), F.coalesce("grp", F.lit("null")))).cast("boolean")).otherwise(True)).drop("_r", "_g")

    def one(r) -> tuple:
        words, rules = np.asarray(r.words, dtype=np.int64), [tuple(int(y) for y in x) for x in r.rules]
        short = apply_rules(words >> k, rules)
        width = (2 ** (total_bits - k) + len(rules) - 1).bit_length()
        back = (expand(short, rules) << k) | (words & ((1 << k) - 1))
        n, charged = len(words), -(-2 * width * len(rules) // 8) if r.place == r.first else 0
        payload = -(-width * len(short) // 8)
        sha = hashlib.sha256(back.astype(f"<u{total_bits // 8}").tobytes()).hexdigest()
        return (r.grp, r.tensor_id, r.place, bool(r.is_representative), n, k, n * total_bits // 8, -(-n * (total_bits - k) // 8), -(-n * k // 8), len(short), len(rules), max((x[3] for x in rules), default=0), payload, charged, payload + charged, sha)

    schema = "grp string, tensor_id string, place int, is_representative boolean, n long, masked_bits int, original_bytes long, masked_only_bytes long, residual_bytes long, n_tokens long, n_rules int, max_pair_frequency long, payload_bytes long, grammar_bytes long, lossy_bytes long, restored_sha256 string"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=[f.strip().split(" ")[0] for f in schema.split(",")])

    out = j.mapInPandas(run, schema)
    return out.withColumn("masking_only_ratio", safe_div(F.col("original_bytes").cast("double"), F.col("masked_only_bytes"))).withColumn("compression_ratio", safe_div(F.col("original_bytes").cast("double"), F.col("lossy_bytes")))


def grammar_groups(per_tensor: DataFrame) -> DataFrame:
    """Sizes of each group, sums over its tensors and ratios of sums."""
    total = per_tensor.groupBy("grp").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("place")), lambda x: x.cast("string")), " ").alias("layers"), F.max(F.when(F.col("is_representative"), F.col("place"))).alias("representative_layer"),
        F.max("masked_bits").alias("masked_bits"), F.max("n_rules").alias("n_rules"), F.max("max_pair_frequency").alias("max_pair_frequency"), F.sum("original_bytes").alias("original_bytes"),
        F.sum("masked_only_bytes").alias("masked_only_bytes"), F.sum("payload_bytes").alias("payload_bytes"), F.sum("grammar_bytes").alias("grammar_bytes"), F.sum("lossy_bytes").alias("lossy_bytes"), F.sum("residual_bytes").alias("residual_bytes"),
    )
    return total.withColumn("masking_only_ratio", safe_div(F.col("original_bytes").cast("double"), F.col("masked_only_bytes"))).withColumn("compression_ratio", safe_div(F.col("original_bytes").cast("double"), F.col("lossy_bytes")))
