"""Language-model scores by stupid backoff, computed relationally.

The model is the corpus's own word and bigram counts: S(w|v) = c(v w) / c(v) if the bigram occurs at
least ``min_count`` times, else ALPHA * c(w) / N. Bigrams of two very frequent words are counted ahead,
combined in each task, and their table, bounded by the number of such words, goes to all executors: no
task ever holds all their occurrences. Every document is exploded into its other bigrams, those are
dealt by their hash (by that of the first word, if it is so rare that executors don't hold its count)
to partitions that hold all occurrences of their bigrams, so each partition has its share of the count
table and joins it on the spot; log scores go back as partial sums and are summed per document. Bigrams
travel as packed columns of 48-bit word hashes, since rows of their own would need several times the
space; their documents are numbered within a slice of the input, of a few MB, and a document's id goes
along once, with its first word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm._common import materialise, one_text, partitions, read, release, slices

ALPHA = 0.4
#: Bigrams that are rarer count as unseen; from 2 on, the model is a pruned one.
MIN_COUNT = 1
#: Occurrences from which a bigram counts in n_seen: it has been met elsewhere, or again.
SEEN = 2
#: Most frequent words whose counts every executor holds (16 bytes each); the rest are joined.
TABLE_WORDS = 1 << 19
#: Share of all words from which a word is very frequent: 1 / HOT words and 1 / HOT^2 bigrams at most.
HOT = 1 / 1000
#: Bigrams aimed at in a partition.
PAIRS_PER_PART = 1_000_000
_BITS = np.uint64((1 << 48) - 1)
_BEGIN, _END = 0, 1
_SCHEMA = "word long, n long"


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((xxh3_64_intdigest(x) for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    return np.maximum(flat & _BITS, np.uint64(2)), n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        word, n = np.unique(_words(texts)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def _narrow(x: np.ndarray, kind: type) -> bytes:
    """Small numbers as ``kind``, else as four bytes each; the length of the whole tells which."""
    return x.astype("<u4" if len(x) and x.max() > np.iinfo(kind).max else kind).tobytes()


def _wide(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(raw, kind if len(raw) == n * np.dtype(kind).itemsize else "<u4").astype(np.int64)


def _count_hot(hot: np.ndarray):
    """Counts of the bigrams of two ``hot`` words (sorted): positions v and w in the list, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot) ** 2, dtype=np.int64)
        for _, texts in slices(batches):
            flat, n = _words(texts)
            pair, _, _ = _pairs(n)
            code = _hot_codes(hot, flat, pair)
            total += np.bincount(code[code >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return run


def _pairs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with ``n`` words each, in a row: places of bigrams' first words, of first and of last words."""
    doc = np.repeat(np.arange(len(n)), n)
    ends = np.flatnonzero(np.diff(doc, append=len(n)))
    return np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else ends, np.flatnonzero(np.diff(doc, prepend=-1)), ends


def _hot_codes(hot: np.ndarray, flat: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Number of each bigram among those of two hot words, -1 for others."""
    if not len(hot):
        return np.full(len(pair), -1)
    at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
    at = np.where(hot[at] == flat, at, -1)
    v, w = at[pair], at[pair + 1]
    return np.where((v >= 0) & (w >= 0), v * len(hot) + w, -1)


class Table:
    """Counts of the most frequent words, and of the bigrams of the very frequent ones."""

    def __init__(self, word: np.ndarray, n: np.ndarray, total: int):
        order = np.argsort(word.astype(np.uint64))
        self.word, self.n, self.total = word.astype(np.uint64)[order], n[order].astype(np.int64), total
        self.hot = self.word[self.n >= HOT * total]
        self.pairs = np.zeros(len(self.hot) ** 2, dtype=np.int64)

    def get(self, words: np.ndarray) -> np.ndarray:
        """Counts, 0 for words that aren't held."""
        if not len(self.word):
            return np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        return np.where(self.word[at] == words, self.n[at], 0)

    def hot_scores(self, min_count: int, alpha: float) -> np.ndarray:
        """Log scores of all bigrams of very frequent words."""
        n = self.get(self.hot).astype(float)
        back = np.log(n / max(self.total, 1)) + math.log(alpha)
        own = np.log(np.maximum(self.pairs, 1)).reshape(len(n), len(n)) - np.log(n)[:, None]
        return np.where(self.pairs.reshape(len(n), len(n)) >= min_count, own, back[None, :]).ravel()


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _explode(table: Table, n_parts: int, min_count: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.hot_scores(min_count, alpha)
        # a task that is run again numbers its slices alike
        first_slice = TaskContext.get().partitionId() << 32
        for number, (part, texts) in enumerate(slices(batches), first_slice):
            flat, n = _words(texts)
            doc = np.repeat(np.arange(len(n)), n)
            pair, starts, ends = _pairs(n)
            code = _hot_codes(table.hot, flat, pair)
            hot = code >= 0
            ready = np.bincount(doc[pair[hot]], weights=known[code[hot]], minlength=len(n)).astype(float)
            met = np.bincount(doc[pair[hot]], weights=table.pairs[code[hot]] >= SEEN, minlength=len(n)).astype(np.int64)
            pair = pair[~hot]
            ends = ends[table.get(flat[ends]) == 0]  # last words matter only where their count isn't held
            v = np.concatenate([np.full(len(starts), _BEGIN, np.uint64), flat[pair], flat[ends]])
            w = np.concatenate([flat[starts], flat[pair + 1], np.full(len(ends), _END, np.uint64)])
            d = np.concatenate([doc[starts], doc[pair], doc[ends]])
            both = (table.get(v) > 0) | (v == _BEGIN)
            key = v * np.uint64(0x9E3779B97F4A7C15) + np.where(both, w * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
            to = ((key ^ (key >> np.uint64(31))) % np.uint64(n_parts)).astype(np.int64)
            # each pair once per document, with its frequency
            order = np.lexsort((w, v, d, to))
            to, d, v, w = to[order], d[order], v[order], w[order]
            new = np.ones(len(to), dtype=bool)
            new[1:] = (to[1:] != to[:-1]) | (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(at, append=len(to))
            to, d, v, w = to[at], d[at], v[at], w[at]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            ids, keys = part.column("doc_id"), part.column("key")
            rows = {k: [] for k in ("part", "docs", "begin", "sizes", "v", "w", "tf")}
            for a, b in zip(cut, [*cut[1:], len(to)], strict=True):
                docs, sizes = np.unique(d[a:b], return_counts=True)
                begin = d[a:b][v[a:b] == _BEGIN]
                for k, x in zip(rows, (int(to[a]), len(docs).to_bytes(4, "little") + _narrow(docs, np.uint16), begin, _narrow(sizes, np.uint8), _six(v[a:b]), _six(w[a:b]), _narrow(tf[a:b], np.uint8)), strict=True):
                    rows[k].append(x)
            # ids, and what is scored already, go along once, with the first word
            first = np.concatenate([np.zeros(0, dtype=np.int64), *rows["begin"]])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows["begin"]])]).astype(np.int32))
            per_first = [pa.array(first.astype(np.int32)), *(part.column(c).take(pa.array(first)) for c in ("doc_id", "key")), pa.array(ready[first]), pa.array(met[first])]
            cols = [pa.array(rows["part"], pa.int32()), pa.array([number] * len(rows["part"]), pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in per_first)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(rows[k], pa.binary()) for k in _PACKED)], names=["part", *_HEAD, *_PACKED])

    return run


#: Columns of a block: its slice and the documents whose first word it holds; then, packed, its documents'
#: numbers, how many pairs each has, and the pairs.
_HEAD, _PACKED = ("slice", "begin", "ids", "keys", "ready", "met"), ("docs", "sizes", "v", "w", "tf")


def _score(table: Table, min_count: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b for b in batches if b.num_rows]
        if not blocks:
            return
        blocks = pa.Table.from_batches(blocks).combine_chunks()
        raw = {name: blocks.column(name).to_pylist() for name in _PACKED}
        head = [blocks.column(name).combine_chunks() for name in _HEAD]
        head = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in head]
        del blocks
        parts = [_wide(x, _length(n), np.uint8) for x, n in zip(raw["sizes"], raw["docs"], strict=True)]
        tf = np.concatenate([_wide(x, int(n.sum()), np.uint8) for x, n in zip(raw["tf"], parts, strict=True)])
        cuts = np.cumsum([0, *map(len, parts)])
        sizes = np.concatenate(parts)
        doc, v, w = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), _unsix(b"".join(raw.pop("v"))), _unsix(b"".join(raw.pop("w")))
        raw = {"docs": raw["docs"]}
        order = np.lexsort((w, v))
        doc, v, w, tf = doc[order], v[order], w[order], tf[order]
        del order
        new_v = np.flatnonzero(np.diff(v, prepend=v[0] + np.uint64(1)) != 0)
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        c2 = np.repeat(np.add.reduceat(tf, at), np.diff(at, append=len(v)))
        own = np.repeat(np.add.reduceat(tf, new_v), np.diff(new_v, append=len(v)))
        held = table.get(v)
        c1 = np.where(held > 0, held, own)  # words that aren't held have all their bigrams here
        del own, held, new, new_v, at
        score = np.zeros(len(v))
        real = w != _END
        inner = real & (v != _BEGIN)
        model = inner & (c2 >= min_count)
        score[model] = np.log(c2[model]) - np.log(c1[model])
        back = real & ~model
        known = table.get(w)
        fine = back & (known > 0)
        score[fine] = np.log(known[fine]) - math.log(table.total)
        score[back & inner] += math.log(alpha)
        far = np.flatnonzero(back & (known == 0))
        total = np.bincount(doc, weights=score * tf, minlength=len(sizes))
        hits = np.bincount(doc, weights=(inner & (c2 >= SEEN)) * tf, minlength=len(sizes)).astype(np.int64)
        # one row per block, then the words whose counts are joined afterwards
        packed = [pa.array([f(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x, f in ((total, np.ndarray.tobytes), (hits, lambda x: _narrow(x, np.uint16)))]
        none = pa.nulls(len(cuts) - 1, pa.int64())
        yield pa.RecordBatch.from_arrays([*head, pa.array(raw["docs"], pa.binary()), *packed, none.cast(pa.int32()), none, none], names=_SCORED)
        block = np.searchsorted(cuts, doc[far], side="right") - 1
        numbers = [_numbers(x) for x in raw["docs"]]
        idx = np.array([numbers[b][i - cuts[b]] for b, i in zip(block.tolist(), doc[far].tolist(), strict=True)], dtype=np.int32)
        slice_of = head[0].take(pa.array(block))
        empty = [pa.nulls(len(far), x.type) for x in (*head[1:], *(pa.array([], pa.binary()) for _ in range(3)))]
        yield pa.RecordBatch.from_arrays([slice_of, *empty, pa.array(idx), pa.array(w[far].astype(np.int64)), pa.array(tf[far])], names=_SCORED)
        del doc, v, w, tf, score, c1, c2, total, hits, known
        release()

    return run


_SCORED = [*_HEAD, "docs", "score", "seen", "idx", "word", "n"]


def _numbers(raw: bytes) -> np.ndarray:
    """Ascending numbers packed by ``_narrow`` behind their count."""
    return _wide(raw[4:], _length(raw), np.uint16)


def _length(raw: bytes) -> int:
    return int.from_bytes(raw[:4], "little")


def _sum_up(table: pa.Table) -> pa.Table:
    """Scores of a slice's documents from its blocks and its words of other tables."""
    rows = table.filter(pc.is_valid(table.column("docs")))
    n = max((int(_numbers(x)[-1]) for x in rows.column("docs").to_pylist()), default=-1) + 1
    total, seen = np.zeros(n), np.zeros(n, dtype=np.int64)
    for docs, score, hits in zip(*(rows.column(c).to_pylist() for c in ("docs", "score", "seen")), strict=True):
        at = _numbers(docs)
        total[at] += np.frombuffer(score)
        seen[at] += _wide(hits, len(at), np.uint16)
    late = table.filter(pc.is_valid(table.column("idx")))
    np.add.at(total, late.column("idx").to_numpy(), late.column("late").to_numpy())
    flat = {c: rows.column(c).combine_chunks().flatten() if rows.num_rows else pa.array([], rows.schema.field(c).type.value_type) for c in ("begin", "ids", "keys", "ready", "met")}
    first = flat["begin"].to_numpy()
    return pa.table({"doc_id": flat["ids"], "key": flat["keys"], "score": total[first] + flat["ready"].to_numpy(), "seen": seen[first] + flat["met"].to_numpy()})


def _grams(order: int):
    """Per word: hashes of the 1 to ``order`` words that end there (g1, ...), and of the words before the last (x2, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            flat, n = _words(texts)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            before, has = [], []  # of each length: hashes, and which words have so many
            for k in range(1, order + 1):
                if k == 1:
                    before.append(flat)
                else:
                    x = np.roll(before[-1], 1) * np.uint64(0x9E3779B97F4A7C15) + flat * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    before.append(x ^ (x >> np.uint64(29)))
                has.append(at >= k - 1)
            cols = [pa.array(g.view(np.int64), mask=~h) for g, h in zip(before, has, strict=True)]
            cols += [pa.array(np.roll(g, 1).view(np.int64), mask=~h) for g, h in zip(before[:-1], has[1:], strict=True)]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("key").take(take), *cols], names=["doc_id", "key", *_names(order)])

    return run


def _names(order: int) -> list[str]:
    return [f"g{k}" for k in range(1, order + 1)] + [f"x{k}" for k in range(2, order + 1)]


def _sums(rows: DataFrame, kind: str, order: int, min_count: int, alpha: float) -> DataFrame:
    """doc_id, key, score, seen by contexts of up to ``order`` - 1 words. Counts are aggregated before they
    are exchanged; a word goes on to the shorter contexts only as long as no longer one is in the model."""
    grams = rows.mapInArrow(_grams(order), f"doc_id {kind}, key int, {', '.join(f'{c} long' for c in _names(order))}")
    unigrams = materialise(grams.groupBy("g1").agg(F.count(F.lit(1)).alias("c")), "grams")
    total = unigrams.agg(F.sum("c")).first()[0] or 1
    counts, models = unigrams, [unigrams.select(F.col("g1").alias("_g"), (F.log("c") - F.lit(math.log(total))).alias("s"), F.lit(False).alias("again"))]
    for k in range(2, order + 1):
        # a context is at least as frequent as what it begins, so pruned tables hold it
        c = materialise(grams.filter(F.col(f"g{k}").isNotNull()).groupBy(f"g{k}").agg(F.count(F.lit(1)).alias("c"), F.first(f"x{k}").alias("x")).filter(F.col("c") >= min_count), "grams")
        up = counts.select(F.col(f"g{k - 1}").alias("_x"), F.col("c").alias("cx"))
        models.append(materialise(c.join(up, F.col("x") == F.col("_x")).select(F.col(f"g{k}").alias("_g"), (F.log("c") - F.log("cx")).alias("s"), (F.col("c") >= SEEN).alias("again")), "model"))
        counts = c
    left = grams.groupBy("doc_id", "key", *[f"g{k}" for k in range(1, order + 1)]).agg(F.count(F.lit(1)).alias("tf")).withColumn("lost", F.lit(0.0))
    done = []
    for k in range(order, 0, -1):
        met = materialise(left.join(models[k - 1], F.col(f"g{k}") == F.col("_g"), "left"), "met")
        done.append(met.filter("s IS NOT NULL").select("doc_id", "key", (F.col("tf") * (F.col("s") + F.col("lost"))).alias("score"), (F.col("tf") * F.col("again").cast("int")).alias("seen")))
        # backing off costs only where there was a context
        step = F.when(F.col(f"g{k}").isNotNull(), F.lit(math.log(alpha))).otherwise(F.lit(0.0))
        left = met.filter("s IS NULL").select("doc_id", "key", "tf", *[f"g{j}" for j in range(1, k)], (F.col("lost") + step).alias("lost"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("doc_id", "key").agg(F.sum("score").alias("score"), F.sum("seen").alias("seen"))


def score(docs: DataFrame, min_count: int = MIN_COUNT, alpha: float = ALPHA, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_seen (bigrams that occur twice or more), log_score, mean_log_score.

    Words are lower-cased (A-Z) and ASCII-space separated. A first word has no context and scores
    c(w) / N. Documents without words score 0 in sum and null in the mean; null texts are such.
    Repeated rows are scored alike and all count in the model. Columns other than doc_id and text
    play no part. Empty input: no rows. All counts cover all documents, and bigrams that occur once are
    in the model too, unless ``min_count`` says otherwise. From ``order`` 3 on, contexts have up to
    order - 1 words, each step back to a shorter one costs ``alpha``, n_seen counts the words whose
    n-gram with the longest context in the model occurs twice or more, and n-grams are told apart by
    64-bit hashes.
    """
    if order < 2:
        raise ValueError("order: 2 at least")
    spark = docs.sparkSession
    rows = one_text(docs).withColumn("key", F.hash("text"))
    if order > 2:
        return _finish(rows, _sums(rows, dict(docs.dtypes)["doc_id"], order, min_count, alpha))
    counts = materialise(rows.mapInArrow(_count, _SCHEMA).groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).toArrow()
    table = Table(top.column("word").to_numpy(), top.column("n").to_numpy(), total)
    if len(table.hot):
        hot = rows.mapInArrow(_count_hot(table.hot), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        table.pairs[hot.column("code").to_numpy()] = hot.column("n").to_numpy()
    n_parts = max(partitions(spark), total // PAIRS_PER_PART)
    kind = dict(docs.dtypes)["doc_id"]
    head = f"slice long, begin array<int>, ids array<{kind}>, keys array<int>, ready array<double>, met array<long>"
    exploded = rows.mapInArrow(_explode(table, n_parts, min_count, alpha), f"part int, {head}, {', '.join(f'{c} binary' for c in _PACKED)}")
    dealt = exploded.repartitionById(n_parts, F.col("part")).mapInArrow(_score(table, min_count, alpha), f"{head}, docs binary, score binary, seen binary, idx int, word long, n long")
    parts = materialise(dealt, "scores")
    near = parts.filter("docs IS NOT NULL").drop("word", "n").withColumn("late", F.lit(None).cast("double"))
    far = parts.filter("word IS NOT NULL").select("slice", "idx", "word", F.col("n").alias("tf"))
    late = (F.log("n") - F.lit(math.log(max(total, 1)))) * F.col("tf")
    far = far.join(counts.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w")).select("slice", "idx", late.alias("late"))
    sums = near.unionByName(far, allowMissingColumns=True).groupBy("slice").applyInArrow(_sum_up, f"doc_id {kind}, key int, score double, seen long")
    # rows with one id and text were scored one by one
    sums = sums.groupBy("doc_id", "key").agg(F.sum("score").alias("score"), F.sum("seen").alias("seen"))
    return _finish(rows, sums)


def _finish(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Scores of all rows from the sums of those with words."""
    sized = rows.select("doc_id", "key", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long").alias("n_words"))
    # rows with one id and text have been summed together
    sized = sized.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("times"))
    sums = sums.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "score", "seen")
    out = sized.join(sums, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    out = out.withColumn("times", F.explode(F.array_repeat("times", F.col("times").cast("int"))))
    one = F.coalesce(F.col("score") / F.col("times"), F.lit(0.0))
    return out.select("doc_id", "n_words", F.coalesce(F.expr("seen div times"), F.lit(0)).alias("n_seen"), one.alias("log_score"), F.when(F.col("n_words") > 0, one / F.col("n_words")).alias("mean_log_score"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_seen", F.round("log_score", 3).alias("log_score"))


def op3_lm_scoring_trigrams(spark, sf_dir: str) -> DataFrame:
    """Contexts of two words; op3_lm_scoring is held to bigrams by its SQL."""
    out = score(read(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_words", "n_seen", F.round("log_score", 3).alias("log_score"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
flat AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
pairs AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM flat),
uni AS (SELECT w, count(*) AS c FROM flat GROUP BY w),
bi AS (SELECT v, w, count(*) AS c FROM pairs WHERE v IS NOT NULL GROUP BY v, w),
scored AS (
  SELECT p.doc_id, b.c >= 2 AS seen,
         CASE WHEN b.c >= 1 THEN ln(b.c) - ln(u1.c) WHEN p.v IS NULL THEN ln(u2.c) - ln(n.c) ELSE ln(0.4) + ln(u2.c) - ln(n.c) END AS s
  FROM pairs p JOIN uni u2 ON u2.w = p.w LEFT JOIN bi b ON b.v = p.v AND b.w = p.w LEFT JOIN uni u1 ON u1.w = p.v CROSS JOIN (SELECT sum(c) AS c FROM uni) n),
sums AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (seen) AS seen FROM scored GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(s.seen, 0) AS n_seen, round(coalesce(s.s, 0), 3) AS log_score
FROM words w LEFT JOIN sums s ON s.doc_id = w.doc_id
"""
