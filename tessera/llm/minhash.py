"""MinHash near-duplicates with circulant signatures, and exact links inside the candidates.

Shingles are hashed into a universe of 2^32 places. One permutation scatters them, a second one,
shifted circularly by 0, 1, 2 ... places, gives all coordinates of the signature. Bands of
coordinates are the buckets in which links are looked for; every link is confirmed on full sets.

Only what decides on components is compared, never all pairs of a bucket. Documents with one shingle
set are one node. Each bucket's leader is the node with the most company in all its bands, as a rule
the text that the others were edited from; a node joins the family of the leader it shares most bands
with, and is compared with that one in full. Two nodes that both link to their leader need nothing
more. Of the others, pairs of one family are found by the shingles in which they differ from the
leader: a link needs a known number of these in common, so that few shared rare ones (a prefix, by
position) decide who is compared. Pairs of different families that share a bucket and aren't in one
component yet are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tessera.llm._common import fresh, materialise, one_text, read, slices

#: Bands and coordinates in each: a pair at 0.8 is missed with probability (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
SIMILARITY_PERCENT = 80
#: Words in a shingle unless a caller says otherwise.
SHINGLE_WORDS = 5
#: Ids sent to all executors at most, when the texts of candidates are read again.
BROADCAST_IDS = 500_000
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _MIX1) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def _permutation(x: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """A bijection of the 32-bit numbers: shifts and odd factors can be undone."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(c1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(c2)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles in a row, and the size of each set.

    Words are ASCII-space separated, A-Z lower-cased. Fewer words than ``width``: all of them make
    one shingle. No words: the empty set."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((xxh3_64_intdigest(x) for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[: len(flat) - width + 1] == doc[width - 1 :]) if len(flat) >= width else np.zeros(0, dtype=np.int64)
    key = flat[at]
    for k in range(1, width):
        key = _mix(key, flat[at + k])
    owner = doc[at]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = []
        for d in short:
            h = flat[first[d] : first[d] + 1]
            for k in range(1, n[d]):
                h = _mix(h, flat[first[d] + k : first[d] + k + 1])
            own.append(_mix(h, np.array([n[d]], dtype=np.uint64))[0])
        key, owner = np.concatenate([key, np.array(own, dtype=np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.bincount(owner[new], minlength=len(n))


def signatures(keys: np.ndarray, n: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (documents x bands) of the sets that aren't empty."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0] if len(n) else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    if not len(starts):
        return out
    place = _permutation((keys >> np.uint64(16)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    for k in range(bands * rows):
        least = np.minimum.reduceat(_permutation(place - np.uint32(k), 0x85EBCA6B, 0xC2B2AE35), starts)
        b = k // rows
        out[:, b] = _mix(out[:, b] if k % rows else np.full(len(starts), b + 1, dtype=np.uint64), least.astype(np.uint64))
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            keys, n = shingle_sets(texts, width)
            ends = np.cumsum(n)
            some = n > 0
            raw = keys.tobytes()
            digest = [xxh3_128_digest(raw[8 * (e - k) : 8 * e]) if k else None for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            sig = signatures(keys, n, bands, rows).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n), pa.array(digest, type=pa.binary()), lists], names=["doc_id", "h", "n", "node", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            keys, n = shingle_sets(texts, width)
            some = np.flatnonzero(n)
            ends = np.cumsum(n)
            raw = keys.tobytes()
            digest = [xxh3_128_digest(raw[8 * (ends[i] - n[i]) : 8 * ends[i]]) for i in some]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[some]]).astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(digest, type=pa.binary()), lists], names=["node", "keys"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label of the connected components of ``edges`` (a, b).

    Every node takes the smallest id among itself and its neighbours; the edges between labels that
    differ are the next, smaller graph. Labels are composed on the way; all steps are distributed.
    """
    edges = materialise(edges.filter("a <> b").select("a", "b"), "edges")
    total = None
    while True:
        both = edges.union(edges.select("b", "a"))
        lab = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
        lab = materialise(lab, "labels")
        if total is None:
            total = lab
        else:
            step = lab.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            total = materialise(total.join(step, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")), "labels")
        la, lb = lab.select(F.col("node").alias("_a"), F.col("label").alias("x")), lab.select(F.col("node").alias("_b"), F.col("label").alias("y"))
        nxt = edges.join(la, F.col("a") == F.col("_a")).join(lb, F.col("b") == F.col("_b")).filter("x <> y")
        edges = materialise(nxt.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return total


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = F.size(F.array_intersect("ka", "kb"))
    joined = _with_sets(pairs, sets).withColumn("both", both)
    return joined.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("ka") + F.size("kb") - F.col("both"))).select("a", "b")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets ka and kb of their a and b. Only sets that are asked for are moved."""
    asked = pairs.select(F.col("b").alias("_b")).distinct()
    left = sets.select(F.col("node").alias("_a"), F.col("keys").alias("ka"))
    right = sets.join(asked, F.col("node") == F.col("_b"), "left_semi").select(F.col("node").alias("_b"), F.col("keys").alias("kb"))
    return pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).drop("_a", "_b")


def _families(open_: DataFrame) -> DataFrame:
    """node, lead: the leader with which a node shares most bands. Nodes that lead wherever they are have none."""
    company = open_.groupBy(F.col("node").alias("_n")).agg(F.sum("c").alias("company"))
    lead = open_.join(company, F.col("node") == F.col("_n")).groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("company", "node")).alias("s"))
    near = open_.join(lead, F.col("key") == F.col("_k")).filter("node <> s.node").groupBy("node", F.col("s.node").alias("lead")).agg(F.count(F.lit(1)).alias("c"), F.max("s.company").alias("company"))
    return near.groupBy("node").agg(F.max(F.struct("c", "company", "lead")).alias("s")).select("node", "s.lead")


def _kin_links(met: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside families; met: node, lead, n, lead_n, linked, diff (symmetric difference to the leader's set).

    With D the differences and S the sum of two sets' sizes, a link is |D_a| + |D_b| - 2 |D_a and D_b|
    <= q S, q = (100 - percent) / (100 + percent). If a isn't linked to the leader, that takes at least
    half of D_b, up to the difference of sizes, in common. Differences are ordered by their frequency in
    the family, and what is left behind the first common one, in both, must suffice. Exact.
    """
    up, down = 100 + percent, 100 - percent
    many = met.groupBy(F.col("lead").alias("_l")).agg(F.count(F.lit(1)).alias("c"), F.bool_and("linked").alias("all")).filter("c > 1 AND NOT all")
    kin = met.join(many, F.col("lead") == F.col("_l"), "left_semi")
    each = kin.select("lead", "node", F.explode("diff").alias("x"))
    often = each.groupBy(F.col("lead").alias("_l"), F.col("x").alias("_x")).agg(F.count(F.lit(1)).alias("f"))
    ordered = each.join(often, (F.col("lead") == F.col("_l")) & (F.col("x") == F.col("_x"))).groupBy(F.col("node").alias("_n")).agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("xs"))
    kin = materialise(kin.drop("diff").join(ordered, F.col("node") == F.col("_n")).select("lead", "node", "n", "lead_n", "linked", F.col("xs.x").alias("diff")), "kin").withColumn("d", F.size("diff").cast("long"))
    least = F.expr(f"({up} * d + {down} * (lead_n - n) + {2 * up - 1}) div {2 * up}")
    known = kin.withColumn("first", F.slice("diff", F.lit(1), (F.col("d") - least + 1).cast("int"))).select("lead", "node", "n", "d", F.posexplode("first").alias("at", "x"))
    asking = kin.filter("NOT linked").select(F.col("lead").alias("_lead"), F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("d").alias("_d"), F.posexplode("diff").alias("_at", "_x"))
    enough = F.lit(2 * up) * F.least(F.col("d") - F.col("at"), F.col("_d") - F.col("_at")) >= F.lit(up) * (F.col("d") + F.col("_d")) - F.lit(down) * (F.col("n") + F.col("_n"))
    pairs = asking.join(known, (F.col("lead") == F.col("_lead")) & (F.col("x") == F.col("_x")) & (F.col("node") != F.col("_node")) & enough)
    pairs = pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
    pairs = _with_sets(pairs, kin.select("node", F.col("diff").alias("keys")))
    sizes = kin.select(F.col("node").alias("_s"), "n")
    pairs = pairs.join(sizes.withColumnRenamed("n", "na"), F.col("a") == F.col("_s")).drop("_s").join(sizes.withColumnRenamed("n", "nb"), F.col("b") == F.col("_s"))
    apart = F.size("ka") + F.size("kb") - F.lit(2) * F.size(F.array_intersect("ka", "kb"))
    return pairs.filter(F.lit(down) * (F.col("na") + F.col("nb")) >= F.lit(up) * apart).select("a", "b")


def _strangers(open_: DataFrame, met: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, but neither component nor family. In each bucket the members
    of all families but the largest meet the others, so a family never meets itself."""
    lab = label.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    fam = met.select(F.col("node").alias("_m"), F.col("lead").alias("_f"))
    state = open_.join(lab, F.col("node") == F.col("_n"), "left").join(fam, F.col("node") == F.col("_m"), "left")
    state = state.select("key", "node", "n", F.coalesce("_l", "node").alias("label"), F.coalesce("_f", "node").alias("family"))
    spans = state.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("family").alias("flo"), F.max("family").alias("fhi"))
    spans = spans.filter("lo <> hi AND flo <> fhi").select(F.col("key").alias("_k"))
    state = materialise(state.join(spans, F.col("key") == F.col("_k"), "left_semi"), "open")
    largest = state.groupBy("key", "family").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("c", "family")).alias("s"))
    few = state.join(largest, F.col("key") == F.col("_k")).filter("family <> s.family").select(*[F.col(c).alias(f"_{c}") for c in state.columns])
    apart = (F.col("label") != F.col("_label")) & (F.col("family") != F.col("_family")) & (F.col("family") != F.col("_node")) & (F.col("_family") != F.col("node"))
    # Sets of too different sizes can't be similar enough.
    alike = F.lit(100) * F.least("n", "_n") >= F.lit(percent) * F.greatest("n", "_n")
    pairs = few.join(state, (F.col("key") == F.col("_key")) & apart & alike)
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def links(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, h, n, node; components: node, label). ``node`` is the digest of a shingle set,
    null for the empty set; nodes without a link are not among the components. h: hash of the text."""
    kind = dict(docs.dtypes)["doc_id"]
    hashed = one_text(docs).withColumn("h", text_hash(F.col("text")))
    signed = materialise(hashed.mapInArrow(_sign(width, bands, rows), f"doc_id {kind}, h long, n long, node binary, bands array<long>"), "signatures")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("n", "bands", "doc_id")).alias("s")).select("node", "s.n", "s.bands", "s.doc_id")
    banded = nodes.select("node", "n", "doc_id", F.explode("bands").alias("key"))
    # Buckets of one node say nothing.
    shared = banded.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    open_ = materialise(banded.join(shared, F.col("key") == F.col("_k")).select("key", "node", "n", "doc_id", "c"), "buckets")
    ids = materialise(open_.select("doc_id", "node").distinct(), "candidates")
    texts = one_text(docs)
    wanted = ids.select(F.col("doc_id").alias("_id")).distinct()
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
    sets = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(_sets(width), "node binary, keys array<long>")
    sets = materialise(sets.dropDuplicates(["node"]), "sets")

    open_ = open_.drop("doc_id")
    own = _with_sets(_families(open_).select(F.col("node").alias("a"), F.col("lead").alias("b")), sets)
    apart = F.concat(F.array_except("ka", "kb"), F.array_except("kb", "ka"))
    met = own.select(F.col("a").alias("node"), F.col("b").alias("lead"), F.size("ka").cast("long").alias("n"), F.size("kb").cast("long").alias("lead_n"), apart.alias("diff"))
    met = materialise(met.withColumn("linked", F.lit(100 - percent) * (F.col("n") + F.col("lead_n")) >= F.lit(100 + percent) * F.size("diff")), "met")
    first = met.filter("linked").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    label = components(first)
    more = materialise(_kin_links(met, percent).union(_confirm(_strangers(open_, met, label, percent), sets, percent)), "links")
    return signed.select("doc_id", "h", "n", "node"), label if more.isEmpty() else components(first.union(more))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h, n and group of every row; null groups have no words."""
    signed, label = links(docs, width, percent)
    named = label.select(F.col("node").alias("_n"), "label")
    return signed.join(named, F.col("node") == F.col("_n"), "left").select("doc_id", "h", "n", F.coalesce("label", "node").alias("group"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    component_id is the smallest doc_id that links reach. Null, empty and wordless texts have the
    empty set and are linked with nothing. Rows with a null id can link others, have a null
    component_id only in groups without ids, and stay (kept) only there. Repeated rows of the smallest
    id are all kept. Columns other than doc_id and text play no part. Empty input: no rows.
    """
    rows = _grouped(docs, width, percent)
    first = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    out = rows.join(first.select(F.col("group").alias("_g"), "first", "c"), F.col("group") == F.col("_g"), "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: one row of each group.

    It is the one with the smallest doc_id (nulls last), then text hash. Rows are told apart by both,
    so other texts under an id that goes stay; of rows that agree in both one stays. Rows without
    words are in no group and all stay. Any further columns may have any names. Empty input: no rows.
    """
    rows = materialise(_grouped(docs, width, percent).filter("group IS NOT NULL"), "groups")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    several = rows.join(first.select(F.col("group").alias("_g"), "s"), F.col("group") == F.col("_g"))
    best = F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("h") == F.col("s.h"))
    own, gone_id, gone_h = (fresh(docs, c) for c in ("_near_h", "_near_id", "_near_other"))
    named = [F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)]
    gone = several.filter(~best).select(*named).distinct()
    twice = materialise(several.filter(best).groupBy("doc_id", "h").count().filter("count > 1").select(*named), "twice")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_h))
    out = docs.withColumn(own, text_hash(F.col("text"))).join(gone, same, "left_anti")
    if not twice.isEmpty():
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]))
    return out.drop(own)


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)

