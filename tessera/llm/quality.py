"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed to a fixed number of buckets. Two multinomials over the buckets,
one of trusted documents and one of all documents, give each n-gram a log ratio; a document's score
is the mean over its n-grams, and it is kept if the score reaches a threshold (no sampling). The
threshold is what nearly all trusted documents reach under models that weren't fitted on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm._common import materialise, one_text, read, slices

#: Buckets of the hashed n-grams: bounds the models, 16 bytes a bucket.
BUCKETS = 1 << 14
#: Kept from this mean log ratio (nats per n-gram) on where too few trusted documents tell a threshold.
THRESHOLD = -0.1
#: Parts of the trusted documents; each is scored by a target model of the others, and the threshold is the
#: score that this share of them misses, in steps of ``STEP`` nats.
FOLDS, MISSED, STEP = 5, 0.001, 1e-3
#: Pseudo-count mass: the target is smoothed with this many n-grams dealt like the raw corpus.
SMOOTHING = 10_000.0
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE, _SYMBOLS = (" ", "\t", "\n", "\v", "\f", "\r"), b"#*$%&|<>"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two columns of hashes; the order counts."""
    x = (a * _MIX1) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of words of each text."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((xxh3_64_intdigest(x) for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    return flat, n


def _ngrams(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the document of each."""
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, dtype=np.int64)
    two = _mix(flat[pairs], flat[pairs + 1]) if len(pairs) else np.zeros(0, dtype=np.uint64)
    grams = np.concatenate([flat, two])
    return ((grams >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[pairs]])


def _repeated(flat: np.ndarray, n: np.ndarray, doc: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each text inside ``width``-word windows that occur in it twice or more."""
    out = np.zeros(len(n), dtype=np.int64)
    last = len(flat) - width + 1
    if last <= 0:
        return out
    at = np.flatnonzero(doc[: last] == doc[width - 1 :])
    if not len(at):
        return out
    key = flat[at]
    for k in range(1, width):
        key = _mix(key, flat[at + k])
    key = _mix(key, doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(flat), dtype=bool)
    for k in range(width):
        covered[at[twice] + k] = True
    np.add.at(out, doc[covered], 1)
    return out


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((FOLDS + 1, BUCKETS), dtype=np.int64)
    for part, texts in slices(batches):
        flat, n = _hashes(texts)
        bucket, doc = _ngrams(flat, n)
        total[FOLDS] += np.bincount(bucket, minlength=BUCKETS)
        fold = part.column("fold").to_numpy()[doc]
        for f in np.unique(fold[fold >= 0]):
            total[f] += np.bincount(bucket[fold == f], minlength=BUCKETS)
    fold, at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(at), pa.array(total[fold, at])], names=["fold", "bucket", "n"])


def _log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw of every bucket; 0 without target counts."""
    if not target.any():
        return np.zeros(BUCKETS)
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + smoothing * p_raw) / (target.sum() + smoothing)) - np.log(p_raw)


def _means(doc: np.ndarray, ratio: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, weights=ratio, minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)


def fit_ratio(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, float]:
    """log p_target - log p_raw of every bucket, and the threshold.

    ``trusted`` has doc_id. Raw counts cover all documents, the target model all trusted ones. Without
    trusted documents all ratios are 0. The threshold is taken from all rows of trusted documents that pass
    the base rules, each scored without its part of them, and is 0 at most; with trusted documents in one
    part alone, or none that pass, it is ``THRESHOLD``. Rows of one id are in one part.
    """
    # written once, for two joins
    ids = materialise(trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "trusted").withColumn("_trusted", F.lit(True))
    own = one_text(docs).withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)))
    # by a shuffle whatever their number: no executor holds all ids, and the disk it takes is in proportion to the input
    marked = own.join(ids.hint("merge"), "doc_id", "left").select("text", F.when(F.col("_trusted"), F.col("_fold")).otherwise(F.lit(-1)).cast("long").alias("fold"))
    sums = marked.mapInArrow(_counts, "fold long, bucket long, n long").groupBy("fold", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((FOLDS + 1, BUCKETS))
    for r in sums.collect():  # BUCKETS rows of each part at most
        counts[r["fold"], r["bucket"]] = r["n"]
    raw, parts = counts[FOLDS], counts[:FOLDS]
    target = parts.sum(axis=0)
    if parts.any(axis=1).sum() < 2:
        return _log_ratio(raw, target), THRESHOLD
    # smoothed in the same proportion, so that an n-gram the target lacks costs the same as under the whole model
    without = np.stack([_log_ratio(raw, target - p, SMOOTHING * (1 - p.sum() / target.sum())) for p in parts])

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            flat, n = _hashes(texts)
            bucket, doc = _ngrams(flat, n)
            llr = _means(doc, without[part.column("_fold").to_numpy()[doc], bucket], len(n))
            repeat = _repeated(flat, n, np.repeat(np.arange(len(n)), n))
            good = (n >= 50) & (100 * repeat <= 50 * n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(good)), pa.array(np.floor(llr[good] / STEP).astype(np.int64))], names=["doc_id", "step"])

    # every document is scored and its step joined to the ids: no text goes through a shuffle for it
    scored = own.filter("doc_id IS NOT NULL").mapInArrow(held_out, f"doc_id {dict(docs.dtypes)['doc_id']}, step long").join(ids, "doc_id", "left_semi")
    # a row a step: bounded by the range of the ratios, whatever the number of rows
    steps = sorted((r["step"], r["count"]) for r in scored.groupBy("step").count().collect())
    left = MISSED * sum(n for _, n in steps)
    for step, n in steps:
        left -= n
        if left < 0:
            return _log_ratio(raw, target), min(step * STEP, 0.0)
    return _log_ratio(raw, target), THRESHOLD


def quality(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    ``threshold``: of llr, by default that of ``fit_ratio``; a score at it (a tie) is kept. One row per
    input row, duplicates of an id included. Null or wordless texts have 0 words, score 0 and fail the
    base rule; null ids are scored like others. Whole texts are read, whatever their length. Columns
    of ``docs`` other than doc_id and text play no part. Empty input: no rows.
    """
    ratio, own = fit_ratio(docs, trusted)
    least = own if threshold is None else threshold

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            flat, n = _hashes(texts)
            bucket, doc = _ngrams(flat, n)
            llr = _means(doc, ratio[bucket], len(n))
            repeat = _repeated(flat, n, np.repeat(np.arange(len(n)), n))
            decoded = [t.decode("utf-8", "replace") for t in texts]
            chars = [len(t) - sum(map(t.count, _SPACE)) for t in decoded]
            symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]
            failed = (n < 50) | (100 * repeat > 50 * n)
            cols = [part.column("doc_id"), n, chars, symbols, [_duplicate_lines(t) for t in texts], repeat, failed, ~failed & (llr >= least), llr]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=_NAMES)

    kind = dict(docs.dtypes)["doc_id"]
    return one_text(docs).mapInArrow(score, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double")


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]


def op1_quality(spark, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return quality(read(spark, sf_dir, "documents"), labels.filter("quality = 1"))
