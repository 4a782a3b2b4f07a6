import struct
from collections import Counter

import numpy as np
import pytest

from tessera import registry_coding
from tessera.operators import codec

SF = "/root/testdata/sf0.001"


def streams():
    r = np.random.default_rng(4)
    yield np.zeros(0, dtype=np.int64)
    yield np.zeros(1000, dtype=np.int64) + 7
    yield np.arange(256)
    yield r.integers(0, 256, 5000)
    yield np.minimum(r.geometric(0.3, 7001), 255)


@pytest.mark.parametrize("data", list(streams()))
def test_rans_round_trip(data):
    freq = codec.normalise(np.bincount(data, minlength=256))
    assert freq.sum() == codec.M
    state, lanes = codec.rans_encode(data, freq)
    assert (codec.rans_decode(len(data), state, lanes, freq) == data).all()


def test_normaliser_reaches_the_sum():
    hist = np.zeros(256, dtype=np.int64)
    hist[:2] = 1_000_000, 1
    freq = codec.normalise(hist, full=True)
    assert freq.sum() == codec.M and freq.min() == 1
    assert codec.normalise(np.zeros(256))[0] == codec.M
    with pytest.raises(ValueError):
        codec.rans_encode(np.array([3]), codec.normalise(hist))


@pytest.mark.parametrize("seed", range(5))
def test_tans_round_trip(seed):
    r = np.random.default_rng(seed)
    data = np.minimum(r.geometric(0.2, 800), 20 if seed else 1)
    _, codes = np.unique(data, return_inverse=True)
    freq = codec.tans_quantise(np.bincount(codes), 256)
    table = codec.tans_table(freq)
    x, bits = codec.tans_encode(codes.tolist(), freq, table)
    assert codec.tans_decode(len(codes), x, bits, freq, table) == codes.tolist()


def plain_replace(tokens, a, b, by):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and tokens[i] == a and tokens[i + 1] == b:
            out.append(by)
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def plain_grammar(tokens, max_rules):
    rules = []
    for i in range(max_rules):
        seen = Counter(zip(tokens, tokens[1:], strict=False))
        if not seen:
            break
        (a, b), n = min(seen.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        new = plain_replace(tokens, a, b, -1 - i)
        if len(new) >= len(tokens):
            break
        tokens = new
        rules.append((-1 - i, a, b, n))
    return tokens, rules


def test_grammar():
    assert codec.replace([1, 1, 1, 1, 1], 1, 1, -1).tolist() == [-1, -1, 1]
    tokens = [1, 2, 3, 1, 2, 3, 1, 2, 3]
    short, rules = codec.grammar(tokens)
    assert rules[0] == (-1, 1, 2, 3) and codec.expand(short, rules).tolist() == tokens and len(short) < len(tokens)
    assert codec.grammar([1, 2, 3])[1] == [] and codec.grammar([])[1] == [] and codec.replace([], 1, 1, -1).tolist() == []


@pytest.mark.parametrize("seed", range(30))
def test_grammar_agrees_with_plain_lists(seed):
    r = np.random.default_rng(seed)
    tokens = r.integers(0, r.integers(1, 6), r.integers(0, 200)).tolist()
    short, rules = codec.grammar(tokens, 20)
    assert (short.tolist(), rules) == plain_grammar(tokens, 20)
    assert codec.expand(short, rules).tolist() == tokens and codec.apply_rules(tokens, rules).tolist() == short.tolist()


@pytest.mark.parametrize("n", [1, 63, 64, 65, 900])
def test_chunks_on_the_wire(n):
    r = np.random.default_rng(n)
    codes = r.integers(0, 7, n)
    codes[:1] = 6
    freq = codec.tans_quantise(np.bincount(codes, minlength=7) + 1, 256)
    table = codec.tans_table(freq)
    raw = codec.tans_chunk(codes, freq, table) + codec.tans_chunk(codes[::-1].copy(), freq, table)
    first, at = codec.tans_unchunk(raw, freq, table)
    second, end = codec.tans_unchunk(raw, freq, table, at)
    assert (first == codes).all() and (second == codes[::-1]).all() and end == len(raw)
    count, _, bits, words = struct.unpack_from("<IqqI", raw)
    assert count == n and words == -(-bits // 64)


def test_streams_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(codec, "CHUNK_SYMBOLS", 100)
    words = np.random.default_rng(1).integers(0, 50, 250)
    t = words_of(spark, [("c", "a", words), ("c", "b", words[:30])]).drop("chunk")
    streams, tables = codec.tans_streams(t)
    assert sorted((r["tensor_id"], r["chunk"], r["n"]) for r in streams.collect()) == [("a", 0, 100), ("a", 1, 100), ("a", 2, 50), ("b", 0, 30)]
    back = sorted((r["tensor_id"], r["chunk"], bytes(r["words"])) for r in codec.tans_words(streams, tables).collect())
    assert b"".join(x for name, _, x in back if name == "a") == words.astype("<u4").tobytes()
    monkeypatch.setattr(codec, "MAX_VOCABULARY", 10)
    with pytest.raises(Exception, match="too many symbols"):
        codec.tans_streams(t)[0].collect()


def test_streams_of_vocabularies_in_pages(spark, monkeypatch):
    monkeypatch.setattr(codec, "CHUNK_SYMBOLS", 100)
    r = np.random.default_rng(14)
    x = {("c", "a"): r.permutation(250), ("c", "b"): np.array([3, 3, 200, 3]), ("d", "e"): r.integers(0, 1 << 32, 30), (None, "f"): np.array([5, 5])}
    streams, tables = codec.tans_streams(words_of(spark, [(c, k, v) for (c, k), v in x.items()]).drop("chunk"), page=16)
    assert tables.filter("page < 0").count() == 2
    assert sorted((r["tensor_id"], r["chunk"], r["n"]) for r in streams.collect()) == [("a", 0, 100), ("a", 1, 100), ("a", 2, 50), ("b", 0, 4), ("e", 0, 30), ("f", 0, 2)]
    back = sorted((r["tensor_id"], r["chunk"], bytes(r["words"])) for r in codec.tans_words(streams, tables).collect())
    assert {k: b"".join(w for name, _, w in back if name == k) for _, k in x} == {k: v.astype("<u4").tobytes() for (_, k), v in x.items()}
    # what has no table isn't left out
    with pytest.raises(Exception, match="without a table"):
        codec.tans_words(streams, tables.filter("cluster = 'c'")).collect()


def test_streams_of_more_words_than_the_largest_table(spark):
    x = np.random.default_rng(15).permutation(np.arange(codec.PAGE + 500)) * 5
    back = codec.tans_words(*codec.tans_streams(words_of(spark, [("c", "a", x)]).drop("chunk"))).collect()
    assert [bytes(r["words"]) for r in back] == [x.astype("<u4").tobytes()]


def words_of(spark, tensors):
    rows = [(c, t, 0, i, int(w)) for c, t, x in tensors for i, w in enumerate(x)]
    return spark.createDataFrame(rows, "cluster string, tensor_id string, chunk long, pos long, word long")


def test_tans_codes_whole_words(spark):
    r = np.random.default_rng(3)
    low = r.integers(0, 200, 1500)  # the top byte is constant, the low one isn't
    got = codec.roundtrip(words_of(spark, [("c", "a", low), ("c", "b", low * 0 + 7)]).drop("cluster")).collect()
    got = {x["tensor_id"]: x for x in got}
    cnt = np.bincount(low)
    cnt = cnt[cnt > 0]
    entropy = -(cnt * np.log2(cnt / cnt.sum())).sum()
    assert got["a"]["tans_symbols"] == len(cnt) and got["a"]["tans_log"] == 8 and not got["a"]["tans_raw"]
    assert entropy <= got["a"]["tans_bits"] + 16 and got["a"]["tans_bits"] < 1.1 * entropy
    assert got["b"]["tans_bits"] == 0 and got["b"]["tans_log"] == 4 and all(x["tans_mismatches"] == 0 for x in got.values())


def test_vocabulary_without_a_table_stays_raw(spark, monkeypatch):
    monkeypatch.setattr(codec, "MAX_VOCABULARY", 10)
    t = words_of(spark, [("c", "a", range(10)), ("d", "b", range(11))])
    assert [r["cluster"] for r in codec.vocabularies(t).collect()] == ["c"]


def test_vocabularies_in_pages(spark):
    r = np.random.default_rng(12)
    a, b = r.permutation(100)[:90], r.integers(50, 130, 400)
    t = words_of(spark, [("c", "a", a), ("c", "b", b), (None, "d", [7, 7, 9])])
    merged = np.unique(np.concatenate([a, b]), return_counts=True)
    table = {(x["cluster"], x["page"]): x for x in codec.vocabularies(t, page=16).collect()}
    n = -(-len(merged[0]) // 16)
    assert set(table) == {*(("c", p) for p in range(-1, n)), (None, 0)}
    assert sum((table["c", p]["words"] for p in range(n)), []) == merged[0].tolist() and max(len(x["words"]) for x in table.values()) == 16
    assert table["c", -1]["words"] == list(range(n)) and table["c", -1]["freq"] == codec.tans_quantise(np.add.reduceat(merged[1], np.arange(0, len(merged[0]), 16)), 256).tolist()
    got = {x["tensor_id"]: x for x in codec.shared_tables(t, page=16).collect()}
    assert (got["a"]["own_table_bytes"], got["b"]["own_table_bytes"]) == (8 * 90, 8 * len(np.unique(b)))
    assert (got["a"]["shared_table_bytes"], got["b"]["shared_table_bytes"], got["d"]["shared_table_bytes"]) == (8 * len(merged[0]), 0, 16)
    assert all(x["own_mismatches"] == x["shared_mismatches"] == 0 and not x["shared_raw"] for x in got.values())
    # the pages and the places in them are the words: as many bits as under one table, but for rounding and the pages' counts
    whole = {x["tensor_id"]: x for x in codec.shared_tables(t).collect()}
    assert got["d"] == whole["d"]
    for name, pages, shared in (("a", 6, n), ("b", -(-len(np.unique(b)) // 16), 0)):
        assert abs(got[name]["own_bits"] - 64 * pages - whole[name]["own_bits"]) < 0.1 * whole[name]["own_bits"] and abs(got[name]["shared_bits"] - 64 * shared - whole[name]["shared_bits"]) < 0.1 * whole[name]["shared_bits"]


def test_more_words_than_the_largest_table(spark):
    x = np.random.default_rng(13).permutation(np.arange(codec.PAGE + 500))
    bits, wrong = codec.paged_code(x, np.ones(len(x), dtype=np.int64))
    assert wrong == 0 and 16 * len(x) < bits < 18 * len(x)
    one = codec.compare_tables(codec.shared_tables(words_of(spark, [("c", "a", x * 3)]))).first()
    assert one["own_table_bytes"] == one["shared_table_bytes"] == 8 * len(x) and one["own_stream_bytes"] == one["shared_stream_bytes"] == -(-bits // 8) < one["raw_bytes"]


def test_shared_tables(spark):
    r = np.random.default_rng(6)
    tensors = [("c", "a", r.integers(0, 300, 900)), ("c", "b", r.integers(100, 500, 700)), ("d", "e", r.integers(0, 9, 400) << 20)]
    t = words_of(spark, tensors)
    got = {x["tensor_id"]: x for x in codec.shared_tables(t).collect()}
    merged = np.unique(np.concatenate([tensors[0][2], tensors[1][2]]), return_counts=True)
    model = {x["cluster"]: x for x in codec.vocabularies(t).collect()}
    assert model["c"]["words"] == merged[0].tolist() and model["c"]["freq"] == codec.tans_quantise(merged[1], 512).tolist()
    assert (got["a"]["shared_table_bytes"], got["b"]["shared_table_bytes"]) == (8 * len(merged[0]), 0) and got["b"]["anchor"] == "a"
    assert all(x["own_mismatches"] == x["shared_mismatches"] == x["rans_mismatches"] == 0 and not x["shared_raw"] for x in got.values())
    # a table of the tensor's own is never longer but for rounding; alone in its cluster, it is the shared one
    assert got["b"]["own_bits"] < got["b"]["shared_bits"] and got["e"]["own_bits"] == got["e"]["shared_bits"] and got["e"]["own_table_bytes"] == got["e"]["shared_table_bytes"]
    table = {x["cluster"]: x for x in codec.anchors(t).collect()}["c"]
    assert table["anchor"] == "a" and sum(table["norm_freq"]) == codec.M and min(table["norm_freq"]) >= 1


def test_coded_words_come_back(spark):
    r = np.random.default_rng(8)
    # what the anchor's table suits is coded, random bits are held as they are
    tensors = [("c", "a", r.normal(size=3000).astype("<f4").view("<u4")), ("c", "b", r.integers(0, 1 << 32, 3000).astype("<u4")), ("d", "e", np.array([5], "<u4"))]
    rows = codec.coded(words_of(spark, tensors).selectExpr("0 AS rank", "*"))
    kept = {x["name"]: x for x in rows.collect()}
    assert not kept["a/0"]["is_raw"] and kept["b/0"]["is_raw"] and kept["a/0"]["owns_table"] and kept["b/0"]["anchor_name"] == "a" and not kept["e/0"]["is_raw"]
    assert min(kept["a/0"]["norm_freq"]) >= 1 and min(kept["e/0"]["norm_freq"]) == 0  # alone, only its own bytes
    assert {x["name"]: bytes(x["words"]) for x in codec.decoded(rows).collect()} == {f"{t}/0": x.tobytes() for _, t, x in tensors}


def test_coded_container_holds_coded_states(spark):
    out = registry_coding.coded_container_roundtrip(spark, SF).collect()
    assert len(out) == 64 and {r["num_elements"] for r in out} == {500}
