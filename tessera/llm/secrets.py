"""Secret scans: pattern rules, and a randomness test battery over everything that looks encoded.

Each candidate string is read in the smallest encoding that holds its characters. Three tests ask
whether its digits look uniformly random: chi-squared on equal classes of digits, runs about the
middle, and lag-1 serial correlation. The smallest of the three p-values is ranked among those of
simulated random strings of the same encoding and length (fixed seeds), which gives one p-value that
is uniform for random strings, whatever their length, and small for structured ones.

False-discovery control works in strata of encoding and length: the share of p-values above 1/2 shows
the number of random strings, and the least p accepted in a stratum is the one from which a binomial
test doesn't reject that structured ones are at most FDR of the rest. Its level grows with their number,
so that a lone string passes from ALPHA on and of many the plain estimate decides. The values that the pattern rules find go through the battery too, in
strata of their own; their spans stay whatever it says.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialise, one_text, read, slices

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a candidate at least; the tests say little about fewer.
SHORTEST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
#: Simulated strings of each encoding and length, and the length from which one simulation serves all.
SIMULATED, LONGEST = 1999, 512
KINDS = ("assign", "access", "hex", "random")
#: Digits of the encodings, the smallest first; a candidate has the first that holds all of it.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_VALUES = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
#: Structured strings among the accepted ones of a stratum, at most.
FDR = 0.05
#: p-values are counted in this many classes.
BINS = 100
#: A p-value below this is never accepted: the battery itself rejects randomness.
ALPHA = 0.01
#: Strata with fewer strings from ALPHA on than this share the threshold of their encoding; encodings
#: with fewer are tested.
LEAST = 50
#: Level of the binomial test: that of a lone string, and strings at which it reaches 1/2, where an
#: estimate needs no allowance for chance.
LEVEL, MANY = 0.01, 500


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern rules, in order of start, then kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def encoding(token: str) -> str | None:
    """The smallest encoding, or None for what isn't one: mere words, digits, or unknown characters.

    Two kinds of characters (digits, capitals, small letters) are needed, since prose has one."""
    body = token.rstrip("=")
    if sum(map(bool, (re.search(r"\d", body), re.search("[a-z]", body), re.search("[A-Z]", body)))) < 2 or not re.search(r"\d", body):
        return None
    chars = set(body)
    return next((k for k, s in _SETS.items() if chars <= s), None)


def readable(token: str, start: int = 0, marks: str = "/+") -> Iterator[tuple[int, int, str]]:
    """(start, end, encoding) of a candidate or, if no encoding holds it, of its parts between the marks."""
    kind = encoding(token)
    if kind:
        yield start, start + len(token), kind
    elif marks:
        for part in token.split(marks[0]):
            if len(part) >= SHORTEST:
                yield from readable(part, start, marks[1:])
            start += len(part) + 1


_erfc = np.vectorize(math.erfc, otypes=[float])


def statistics(x: np.ndarray, base: int) -> np.ndarray:
    """Smallest p-value of the three tests for each line of digits."""
    m, n = x.shape
    # chi-squared: so few classes of consecutive digits that each expects five or more
    classes = min(base, max(2, n // 5))
    edges = (np.arange(base) * classes) // base
    expected = np.bincount(edges, minlength=classes) * n / base
    counts = np.bincount((edges[x] + classes * np.arange(m)[:, None]).ravel(), minlength=m * classes).reshape(m, classes)
    chi2 = ((counts - expected) ** 2 / expected).sum(axis=1)
    k = classes - 1
    # Wilson and Hilferty's cube root; one-sided, as only too uneven counts speak against a secret
    z = (np.cbrt(chi2 / k) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    least = 0.5 * _erfc(z / math.sqrt(2))
    # runs about the middle of the alphabet
    high = x >= base / 2
    n1 = high.sum(axis=1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p = np.where(var > 0, _erfc(np.abs(runs - mean) / np.sqrt(np.where(var > 0, 2 * var, 1))), 1.0)
    least = np.minimum(least, np.where((n1 == 0) | (n1 == n), 0.0, p))
    # serial correlation of neighbours
    d = x - x.mean(axis=1, keepdims=True)
    total = (d * d).sum(axis=1)
    r = (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(total > 0, total, 1) + 1 / n
    return np.minimum(least, np.where(total > 0, _erfc(np.abs(r) * math.sqrt(n / 2)), 0.0))


@functools.lru_cache(maxsize=4096)
def null(kind: str, n: int) -> np.ndarray:
    """Sorted statistics of simulated random strings."""
    base = len(ENCODINGS[kind])
    rng = np.random.default_rng([n, list(ENCODINGS).index(kind)])
    return np.sort(statistics(rng.integers(0, base, (SIMULATED, n)), base))


def battery(token: str, kind: str) -> float:
    """p-value of the battery: the share of random strings that look as odd, or odder."""
    value = _VALUES[kind]
    x = np.array([[value[c] for c in token.rstrip("=")]])
    own = float(statistics(x, len(ENCODINGS[kind]))[0])
    return (1 + int(np.searchsorted(null(kind, min(x.shape[1], LONGEST)), own, side="right"))) / (SIMULATED + 1)


def _band(n: int) -> int:
    """Length classes of a quarter octave."""
    return int(4 * math.log2(n))


def base_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what the pattern rules hold to be secret, without the name of an assignment."""
    out = {(m.start(2), m.end()) if (m := _ASSIGN.match(text, s, e)) and k == 0 else (s, e) for s, e, k in base}
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        spans, found = [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            more = []
            for m in _CANDIDATE.finditer(text):
                for start, end, kind in readable(m[0], m.start()):
                    if not any(s < end and start < e for s, e, _ in base):
                        more.append({"start": start, "end": end, "base": False, "stratum": f"{kind}:{_band(end - start)}", "p": battery(text[start:end], kind)})
            for start, end in base_values(text, base):
                kind = encoding(text[start:end]) if end - start >= SHORTEST else None
                if kind:
                    more.append({"start": start, "end": end, "base": True, "stratum": f"base {kind}:{_band(end - start)}", "p": battery(text[start:end], kind)})
            spans.append([{"start": s, "end": e, "kind": k} for s, e, k in base])
            found.append(more)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, type=_SPANS), pa.array(found, type=_FOUND)], names=["doc_id", "base", "found"])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("stratum", pa.string()), ("p", pa.float64())]))
_SCHEMA = "base array<struct<start:long,end:long,kind:int>>, found array<struct<start:long,end:long,base:boolean,stratum:string,p:double>>"


def _supported(counts: np.ndarray) -> bool:
    """Whether the counts from ALPHA on are enough for an estimate."""
    return counts[math.ceil(ALPHA * len(counts)) :].sum() >= LEAST


def _at_most(k: int, n: int, share: float) -> float:
    """Chance of k or fewer of n; by the normal curve where n is large."""
    if n > 200:
        return 0.5 * math.erfc((n * share - k - 0.5) / math.sqrt(2 * n * max(share * (1 - share), 1e-12)))
    return sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1))


def least_p(counts: np.ndarray, fdr: float = FDR) -> float:
    """The smallest p-value to accept, from counts of p-values in equal classes: if at most ``fdr`` of the
    accepted are structured, this share of them or more lies above 1/2, which a binomial test checks."""
    bins = len(counts)
    high = int(counts[bins // 2 :].sum())
    upper = counts[::-1].cumsum()[::-1]
    level = min(0.5, max(LEVEL, 0.5 * float(upper[math.ceil(ALPHA * bins)]) / MANY))
    for i in range(max(1, math.ceil(ALPHA * bins)), bins // 2 + 1):
        if _at_most(high, int(upper[i]), min(1.0, (1 - fdr) / 2 / (1 - i / bins))) >= level:
            return i / bins
    return 0.5


def thresholds(histogram: dict[tuple[str, int], int], fdr: float = FDR) -> dict[str, float]:
    """Least p of every stratum; rare strata use their encoding's. Keys: (stratum, class of p)."""
    own, pooled = defaultdict(lambda: np.zeros(BINS)), defaultdict(lambda: np.zeros(BINS))
    for (stratum, bin_), n in histogram.items():
        own[stratum][bin_] += n
        pooled[stratum.split(":")[0]][bin_] += n
    return {s: least_p(c if _supported(c) else pooled[s.split(":")[0]], fdr) for s, c in own.items()}


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, spans: array of (start, end, kind), code points, end exclusive, by start then kind, and
    n_tested: strings that went through the battery, n_base_random: pattern values that it holds random.

    One row per input row, repeated rows and null ids included; null texts count as empty, and empty ones
    have no spans. Texts are read whole, however long. The p-value counts cover all documents and are
    bounded by encodings x lengths x classes. Columns other than doc_id and text play no part. Empty
    input: no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = materialise(one_text(docs).mapInArrow(_scan, f"doc_id {kind}, {_SCHEMA}"), "candidates")
    each = found.select(F.explode("found").alias("f")).select("f.stratum", F.least(F.floor(F.col("f.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    least = thresholds({(r["stratum"], r["bin"]): r["count"] for r in each.groupBy("stratum", "bin").count().collect()}, fdr)
    tested = F.size("found").cast("long").alias("n_tested")
    if not least:
        return found.select("doc_id", F.col("base").alias("spans"), tested, F.lit(0).cast("long").alias("n_base_random"))
    table = F.create_map(*[F.lit(x) for k, v in sorted(least.items()) for x in (k, v)])
    good = F.filter("found", lambda f: f["p"] >= F.element_at(table, f["stratum"]))
    added = F.transform(F.filter(good, lambda f: ~f["base"]), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind")))
    spans = F.array_sort(F.concat("base", added), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int"))
    return found.select("doc_id", spans.alias("spans"), tested, F.size(F.filter(good, lambda f: f["base"])).cast("long").alias("n_base_random"))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    spans = scan(read(spark, sf_dir, "documents")).withColumnRenamed("spans", "s")
    base = F.filter("s", lambda s: s["kind"] < KINDS.index("random"))
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    name = F.array(*[F.lit(k) for k in KINDS])
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("s")).alias("spans"), count("random"), "n_tested", "n_base_random")


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The base_sha256 of spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
