"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on the presence of words and word beginnings. For every training text in which
an identity term occurs, its counterfactuals (the term swapped for the others of its family) enter
the loss as the squared change of the logit, so weight can't settle on the mere mention of a group.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialise, one_text, read, slices

#: Families of exchangeable identity terms; a parameter, these are the default.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("gay", "lesbian", "straight", "trans", "queer", "bisexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "refugees", "foreigners", "natives"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
#: Labelled documents the classifier is fitted on, at most: those with the smallest hashes.
MAX_TRAIN_DOCS = 20_000
#: Features kept: those that tell the labels apart best.
MAX_FEATURES = 4096
#: Documents of the training set that must hold a feature.
MIN_DOCS = 3
#: Features kept by chance among the kept ones, at most: the bar follows from how many were tried and
#: how many stand out, so that it suits tables of any size.
FEATURE_FDR = 0.01
#: Lengths of word beginnings that are features beside the word itself.
PREFIXES = (4, 5, 6, 7, 8)
#: Features counted in a worker's memory before their counts go on.
COUNTED = 100_000
FLAGGED = 0.3
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = (Counter(), Counter())
    for part, texts in slices(batches):
        for text, label in zip(texts, part.column("label").to_pylist(), strict=True):
            both[label].update({f for w in _words(text.decode("utf-8", "replace")) for f in features(w)})
        if len(both[0]) + len(both[1]) > COUNTED:
            yield _counted(both)
            both = (Counter(), Counter())
    yield _counted(both)


def _counted(both: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(both[0].keys() | both[1].keys())
    n = [pa.array([c[x] for x in names], type=pa.int64()) for c in both]
    return pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), *n], names=["feature", "n0", "n1"])


class Lexicon:
    """Maps texts to sorted positions of known features; words met before are looked up.

    The words kept are bounded by number and length, and go with the task."""

    #: Words kept at most, and characters of each.
    WORDS, CHARS = 100_000, 40

    def __init__(self, names: list[str], families: Iterable[tuple[str, ...]]):
        self.at = {x: i for i, x in enumerate(names)}
        self.family = {w: f for f in families for w in f}
        self.seen: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        got = self.seen.get(w)
        if got is None:
            got = tuple(i for i in (self.at.get(f) for f in features(w)) if i is not None)
            if len(self.seen) < self.WORDS and len(w) <= self.CHARS:
                self.seen[w] = got
        return got

    def of(self, words: set[str]) -> list[int]:
        found: set[int] = set()
        for w in words:
            found.update(self.word(w))
        return sorted(found)

    def swaps(self, words: set[str]) -> list[list[int]]:
        """The features of each counterfactual text."""
        return [self.of((words - {w}) | {other}) for w in sorted(words & self.family.keys()) for other in self.family[w] if other != w]


def stand_out(z: list[float], tried: int, fdr: float = FEATURE_FDR) -> int:
    """How many of the largest z-values, in falling order, Benjamini and Hochberg's rule keeps of all that were tried."""
    return max((i for i, x in enumerate(z, 1) if 0.5 * math.erfc(x / math.sqrt(2)) <= fdr * i / tried), default=0)


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.repeat(np.arange(len(rows)), n), np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(n.sum()))


def fit(rows: list[list[int]], labels: np.ndarray, swaps: list[tuple[int, list[int]]], width: int, l2: float = 3e-4, swap_penalty: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; deterministic. Weights stay at 0 or above: words can speak
    for toxicity, but no amount of harmless ones makes up for an insult in a long text.

    Loss: mean log loss + l2 |w|^2 / 2 + swap_penalty * mean over swaps of (logit - swapped logit)^2 / 2.
    """
    w, b = np.zeros(width), 0.0
    if not len(labels):
        return w, -20.0
    if labels.min() == labels.max():
        return w, 20.0 if labels[0] else -20.0
    doc, col = _matrix(rows)
    sdoc, scol = _matrix([r for _, r in swaps])
    source = np.array([i for i, _ in swaps], dtype=np.int64)
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[col], minlength=len(labels)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        gb = g.sum()
        if len(source):
            d = swap_penalty * (z[source] - b - np.bincount(sdoc, weights=w[scol], minlength=len(source))) / len(source)
            g = g + np.bincount(source, weights=d, minlength=len(labels))
            gw = np.bincount(col, weights=g[doc], minlength=width) - np.bincount(scol, weights=d[sdoc], minlength=width)
        else:
            gw = np.bincount(col, weights=g[doc], minlength=width)
        gw = gw + l2 * w
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate, c1, c2 = 0.1 / (1 + t / 100), 1 - 0.9**t, 1 - 0.999**t
        w = np.maximum(w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-9), 0)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, families: Iterable[tuple[str, ...]] = IDENTITIES, max_train_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray, float]:
    """Feature names, weights and bias. ``labels``: doc_id and toxic, of which held-out rows are left out.

    Ids with several labels count as toxic if any is. At most ``max_train_docs`` labelled documents
    (by hash order of the id) are gathered, and of them only positions of the kept features.
    """
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    sample = materialise(one_text(docs).join(F.broadcast(own), "doc_id"), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = sample.select("text", "label").mapInArrow(_feature_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate0, rate1 = (F.col("n0") + 0.5) / (n0 + 1.0), (F.col("n1") + 0.5) / (n1 + 1.0)
    spread = F.sqrt((F.col("n0") + F.col("n1") + 1.0) * (1.0 / (n0 + 1) + 1.0 / (n1 + 1)) / (n0 + n1 + 2.0))
    tried = materialise(counts.filter(F.col("n0") + F.col("n1") >= MIN_DOCS).select("feature", ((rate1 - rate0) / spread).alias("z")), "features")
    best = tried.filter("z > 0").orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    best = best[: stand_out([r["z"] for r in best], tried.count())]
    families = tuple(tuple(f) for f in families)
    names = sorted({r["feature"] for r in best} | {w for f in families for w in f})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(names, families)
        for part, texts in slices(batches):
            words = [_words(t.decode("utf-8", "replace")) for t in texts]
            cols = [pa.array([lexicon.of(x) for x in words], type=pa.list_(pa.int32())), pa.array([lexicon.swaps(x) for x in words], type=pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), *cols], names=["id", "label", "at", "swaps"])

    rows = sorted(sample.mapInArrow(encode, "id string, label int, at array<int>, swaps array<array<int>>").collect(), key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["at"]))
    swaps = [(i, s) for i, r in enumerate(rows) for s in r["swaps"]]
    w, b = fit([r["at"] for r in rows], np.array([r["label"] for r in rows], dtype=float), swaps, len(names))
    return names, w, b


def _probabilities(texts: list[bytes], lexicon: Lexicon, w: np.ndarray, b: float) -> np.ndarray:
    z = np.array([b + w[lexicon.of(_words(t.decode("utf-8", "replace")))].sum() for t in texts])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float], flagged: float = FLAGGED) -> DataFrame:
    """doc_id, score, predicted of every row; null and empty texts get the score of no features.

    Whole texts are read. Repeated rows and null ids are scored like others; columns other than
    doc_id and text play no part. Empty input: no rows."""
    names, w, b = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(names, ())
        for part, texts in slices(batches):
            p = _probabilities(texts, lexicon, w, b)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= flagged).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return one_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, flagged: float = FLAGGED) -> DataFrame:
    """The rows of ``docs`` that aren't flagged, with all their columns. Scored in place, without a join.

    Null and empty texts score as in ``score``; repeated rows and null ids stay or go by their texts.
    Columns may have any names. Empty input: no rows."""
    names, w, b = train(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(names, ())
        for part, texts in slices(batches):
            yield part.filter(pa.array([p < flagged for p in _probabilities(texts, lexicon, w, b)], type=pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels"))).withColumn("held_out", held_out(F.col("doc_id")))
