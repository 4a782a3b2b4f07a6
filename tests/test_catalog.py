"""The catalog's scans, layouts, joins and reports, and the entry points on an exported folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api, config
from tessera.functions import bits, dtypes
from tessera.operators import benchmark, codec, groups, similarity, stats, symbols
from tessera.plans.running import running_total
from tessera.sources import catalog, reports
from tessera.streaming import ingest


def lines(df):
    return [r["line"] for r in df.orderBy("part", "place").collect()]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_total(spark, keys):
    r = np.random.default_rng(1)
    rows = [(f"k{int(k)}" if k < 3 else None, int(i), int(v)) for i, (k, v) in enumerate(zip(r.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]), r.integers(-5, 9, 500), strict=True))]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {x["i"]: x["t"] for x in running_total(df, keys, [F.col("i")], F.col("v"), "t").collect()}
    seen, want = {}, {}
    for k, i, v in rows:
        key = k if keys else 0
        want[i] = seen.get(key, 0)
        seen[key] = want[i] + v
    assert got == want
    assert running_total(df.limit(0), keys, [F.col("i")], F.col("v"), "t").count() == 0


def test_quantiles_density_and_distribution(spark):
    r = np.random.default_rng(2)
    x = {"a": r.normal(size=301), "b": r.integers(0, 4, 40).astype(float), "c": np.array([3.0]), "d": np.array([2.0, 2.0])}
    t = spark.createDataFrame([(k, float(v)) for k, xs in x.items() for v in xs] + [("e", None)], "tensor_id string, value double")
    q = {r["tensor_id"]: r for r in stats.quantiles(t, {"q1": 0.25, "m": 0.5, "p9": 0.9}).collect()}
    for k, v in x.items():
        assert tuple(q[k])[1:] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.9]))
    assert set(q) == set(x)
    d = {}
    for row in stats.kde(t).collect():
        d.setdefault(row["tensor_id"], []).append((row["point"], row["x"], row["density"]))
    assert set(d) == {"a", "b"}  # one value and constants have no density
    for k, got in d.items():
        v = x[k]
        h = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min(), v.max(), 300)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        got.sort()
        assert np.allclose([g[1] for g in got], grid) and np.allclose([g[2] for g in got], want)
    s = {r["tensor_id"]: r for r in stats.distribution(t, ["tensor_id"]).collect()}
    assert np.isnan(s["e"]["mean"]) and np.isnan(s["e"]["iqr"]) and s["e"]["n"] == 0 and np.isnan(s["d"]["skew"]) and s["d"]["std"] == 0
    assert s["a"]["kurt"] == pytest.approx(((x["a"] - x["a"].mean()) ** 4).mean() / x["a"].var() ** 2 - 3)


def test_types(spark):
    row = spark.range(1).select(*[dtypes.parse(F.lit(x)).alias(x) for x in ("torch.bfloat16", "torch.float16", "torch.float32", "int8", "double")], dtypes.parse(F.lit(None).cast("string")).alias("none")).first()
    assert tuple(row) == ("bfloat16", "float16", "float32", "int8", "unknown", "unknown")
    assert spark.range(1).select(dtypes.storage(F.lit("bf16"))["mantissa_bits"], dtypes.storage(F.lit("fp16"))["bytes"]).first()[:] == (7, 2)
    with pytest.raises(Exception, match="no layout"):
        spark.range(1).select(dtypes.storage(F.lit("int8"))["bytes"]).collect()
    names = spark.createDataFrame([("optimizer.exp_avg_sq::w",), ("optimizer.exp_avg::w",), ("master_weights::w",), ("w.exp_avg",)], "n string")
    assert [r[0] for r in names.select(dtypes.category(F.col("n"))).collect()] == ["exp_avg_sq", "exp_avg", "master_weights", "model_state"]
    assert spark.range(1).select(dtypes.sanitize(F.lit("a b/c")), dtypes.safe_name(F.lit("x/y.z")), dtypes.shape_text(F.array(F.lit(2), F.lit(3)))).first()[:] == ("a_b_c", "x_y_z", "[2,3]")
    words = spark.createDataFrame([("float16", 0x3C01), ("bfloat16", 0x3F81), ("int8", 255), ("int32", 2**32 - 2), ("float32", 0x3F800001), ("odd", 1)], "dtype string, word long")
    masked, side = bits.split_word(F.col("word"), F.col("dtype"))
    got = words.select("dtype", bits.to_float(F.col("word"), F.col("dtype")).alias("v"), masked.alias("m"), side.alias("s"), "word").collect()
    assert all(r["m"] + r["s"] == r["word"] for r in got)
    assert [r["s"] for r in got] == [1, 0x81, 0, 0, 1, 0] and [r["v"] for r in got][2:4] == [-1.0, -2.0] and got[5]["v"] is None


def test_shards_tile_a_tensor(spark):
    n, parts = 103, 8
    rows = spark.range(parts).select(F.col("id").cast("int").alias("rank"), catalog.resident(F.lit(n), F.lit(-(-n // parts)), F.col("id")).alias("n"))
    assert sum(r["n"] for r in rows.collect()) == n
    assert spark.range(1).select(catalog.resident(F.lit(10), F.lit(5), F.lit(2)), catalog.resident(F.lit(10), F.lit(5), F.lit(-1)), catalog.resident(F.lit(0), F.lit(5), F.lit(0))).first()[:] == (0, 5, 0)


def test_fragments_of_any_view(spark):
    base = np.arange(240, dtype=np.float32)
    views = {"t": base.reshape(12, 20).T, "p": base.reshape(4, 5, 12).transpose(1, 0, 2), "s": base.reshape(12, 20)[:, ::2], "q": base.reshape(2, 5, 24)[:, :, :7], "c": base.reshape(12, 20)}
    t = spark.createDataFrame([(k, list(v.shape), [s // 4 for s in v.strides]) for k, v in views.items()] + [("z", [], [])], "tensor_id string, shape array<long>, strides array<long>")
    assert {r["tensor_id"]: r["layout"] for r in catalog.layout(t).collect()} == {"t": "non-contiguous", "p": "non-contiguous", "s": "non-contiguous", "q": "non-contiguous", "c": "contiguous", "z": "scalar"}
    buffer = spark.createDataFrame([(k, i, float(x)) for k in views for i, x in enumerate(base)], "tensor_id string, pos long, value float")
    got = {}
    for r in catalog.gather(catalog.fragments(t), buffer).orderBy("tensor_id", "pos").collect():
        got.setdefault(r["tensor_id"], []).append(r["value"])
    assert got == {k: v.ravel().tolist() for k, v in views.items() if k != "c"}


def test_joins_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, g string")
    b = spark.createDataFrame([(1, "float32"), (2, "float16")], "id int, dtype string")
    assert catalog.strict_lookup(a, b, ["id"]).count() == 2
    with pytest.raises(Exception, match="missing tensor: 2"):
        catalog.strict_lookup(a, b.filter("id = 1"), ["id"]).collect()
    both = a.join(b, "id").withColumn("g", F.lit("x"))
    with pytest.raises(Exception, match="mixed dtypes"):
        catalog.same_dtype(both, ["g"]).collect()


def test_cluster_ids(spark):
    rows = [("b", "t1", "t1", 2), ("b", "t2", "t1", 2), ("a", "u", "u", 1), ("a", "v", "v", 3), ("a", "w", "v", 3), ("a", "x", "v", 3)]
    got = {r["tensor_id"]: tuple(r)[2:] for r in catalog.cluster_ids(spark.createDataFrame(rows, "state_type string, tensor_id string, cluster string, size long")).collect()}
    assert got == {"t1": (1, "t1", True), "t2": (1, "t1", False), "u": (-1, None, False), "v": (0, "v", True), "w": (0, "v", False), "x": (0, "v", False)}


def test_kmeans_has_eight_groups_at_least(spark):
    r = np.random.default_rng(0)
    rows = [(f"t{i:03d}", float(i % 9), float(r.normal() / 100)) for i in range(81)]
    out = groups.kmeans(spark.createDataFrame(rows, "tensor_id string, a double, b double"), ["a", "b"]).collect()
    assert len(out) == 81 and len({x["grp"] for x in out}) == 8
    for x in out:
        assert (x["grp"] is None) == (x["size"] == 1)
    few = groups.kmeans(spark.createDataFrame([("x", 0.0), ("y", 9.0)], "tensor_id string, a double"), ["a"]).collect()
    assert {x["grp"] for x in few} == {None}  # groups of one


def test_text_reports(spark):
    t = spark.createDataFrame([("s", "a", 1.0)] * 3 + [("s", "a", 2.0)] + [("s", "b", 1.0)] * 2 + [("u", "c", 5.0)], "state_type string, tensor_id string, value float")
    c = symbols.counts(t)
    text = lines(reports.stream_report(symbols.summary(c), "weights"))
    assert text[:5] == ["=" * 80, "STREAM: weights", "Tensor: a", "Elements: 4", "Tensor Bytes: 16"] and "Entropy: 0.8113 bits/symbol" in text and "Total tensors: 3" in text
    assert text[text.index("Largest histogram ratio:") + 1] == "  c" and text[text.index("Smallest histogram ratio:") + 1] == "  a"
    saved = groups.savings(c).first()
    assert (saved["n_clusters"], saved["n_singletons"], saved["largest_cluster"], saved["singleton_bytes"]) == (1, 1, "s", 72)
    assert saved["baseline_bytes"] == 16 + 64 + 8 + 64 + 72 and lines(reports.savings_report(groups.savings(c), "weights"))[1] == "Clusters: 1"
    x = groups.cross_entropy(c)
    one = x.first()
    assert one["own_model_bytes"] == 32 and one["shared_model_bytes"] == 24 and one["model_savings"] == 8 and one["net_gain"] == pytest.approx(8 - one["stream_penalty"])
    assert any(line.startswith("  Net gain: ") for line in lines(reports.cross_entropy_report(x)))
    mem = spark.createDataFrame([("b", 2, 8, "contiguous", 1024), ("a", 1, 1 << 20, "scalar", 2048)], "name string, num_elements long, byte_size long, layout string, total long")
    assert lines(reports.memory_report(mem)) == ["[mem] [a] elements=1 bytes=1048576 layout=scalar buf_total=2048", "[mem] [b] elements=2 bytes=8 layout=contiguous buf_total=1024", "Total tensor data : 1048584 B (1 MiB)", "Total slab alloc  : 3072 B (3 KiB)"]


@pytest.fixture
def export(tmp_path):
    r = np.random.default_rng(3)
    words = {}
    (tmp_path / "raw").mkdir()
    out = ["tensor_key,layer,category,state_type,numel,dtype,file_path"]
    for layer in range(3):
        w = np.repeat(r.normal(size=40).astype("<f4"), 5)
        w.tofile(tmp_path / "raw" / f"k{layer}.bin")
        words[layer] = w.view("<u4").astype(np.int64)
        out.append(f"k{layer},{layer},key,exp_avg,{len(w)},float32,raw/k{layer}.bin")
    (tmp_path / "manifest.csv").write_text("\n".join(out) + "\n")
    (tmp_path / "analysis" / "plots").mkdir(parents=True)
    (tmp_path / "analysis" / "plots" / "grouping_summary.csv").write_text('s,c,g,x,layers,rep,a,b,c,d\nexp_avg,key,4,,"2 0 1",1,,,,\n')
    return tmp_path, words


def test_export_report(spark, export):
    path, words = export
    prints, pairs = api.export_report(spark, f"file://{path}", f"file://{path}/out")
    assert prints.count() == 3 and {(r["anchor_layer"], r["compare_layer"]) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    back = spark.read.csv(f"{path}/out/fingerprints.csv", header=True, inferSchema=True)
    assert back.columns == reports.FINGERPRINTS and {r["tensor_key"]: r["numel"] for r in back.collect()} == {"k0": 200, "k1": 200, "k2": 200}
    values = words[0].astype("<u4").view("<f4")
    assert back.filter("layer = 0").first()["median"] == pytest.approx(float(np.median(values)), rel=1e-6)
    (path / "raw" / "k2.bin").write_bytes(b"1234")
    with pytest.raises(Exception, match="manifest's size"):
        api.export_report(spark, f"file://{path}", f"file://{path}/out")


def test_mask_repair(spark, export):
    path, words = export
    a, b = api.mask_repair(spark, f"file://{path}", f"file://{path}/out", max_rules=10)
    got = {r["layer"]: r for r in a.collect()}
    _, rules = codec.grammar(words[1] >> 23, 10)
    width = (2**9 + len(rules) - 1).bit_length()
    charge = -(-2 * width * len(rules) // 8)
    for layer, w in words.items():
        short = codec.apply_rules(w >> 23, rules)
        r = got[layer]
        assert r["compressed_token_count"] == len(short) and r["rule_count"] == len(rules) and r["is_representative"] == (layer == 1)
        # the grammar is charged to the first listed layer
        assert round(r["lossy_compressed_size_mb"] * 2**20) == -(-width * len(short) // 8) + (charge if layer == 2 else 0)
        assert round(r["residual_raw_size_mb"] * 2**20) == 200 * 23 // 8 and round(r["masked_only_size_mb"] * 2**20) == 200 * 9 // 8
    g = b.first()
    assert g["layers"] == "2 0 1" and g["representative_layer"] == 1 and g["compression_ratio"] == pytest.approx(2400 / round(g["lossy_compressed_group_size_mb"] * 2**20))
    text = [r[0] for r in spark.read.text(f"{path}/out/checkpoint_prefix_mask_repair_summary.txt").collect()]
    assert text[0] == "transform_mode: shared_group_mantissa_mask_cfg" and text[7].startswith("exp_avg/key/group_4: layers=2 0 1, representative_layer=1, dtype=float32") and text[-1].startswith("selected_groups_compression_ratio: ")
    assert spark.read.csv(f"{path}/out/tensor_prefix_mask_repair.csv", header=True).columns == reports.TENSOR_SIZES
    (path / "analysis" / "plots" / "grouping_summary.csv").write_text('s,c,g,x,layers,rep,a,b,c,d\nexp_avg,key,4,,"0 7",0,,,,\n')
    with pytest.raises(Exception, match="missing tensor"):
        api.mask_repair(spark, f"file://{path}", f"file://{path}/out")


def test_catalog_to_files_and_back(spark, tmp_path):
    r = np.random.default_rng(5)
    x = {f"layers.{i}.q_proj": r.normal(size=300).astype("<f4") for i in range(6)} | {"optimizer.exp_avg::w": r.normal(size=50).astype("<f4")}
    rows = [(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)]
    c = api.load_catalog(spark, spark.createDataFrame(rows, "tensor_id string, pos long, value float"))
    assert {(t["state_type"], t["category"]) for t in c.tensors.collect()} == {("model_state", "query"), ("exp_avg", "other")}
    a = api.analyze(c)
    assert a.fingerprints.count() == 7 and a.clusters.count() == 7 and a.weights.count() == 1
    sizes = api.compress(c, a.clusters, f"file://{tmp_path}/z").first()
    assert sizes["tensor_bytes"] == 4 * len(rows) and sizes["ans_ratio"] >= 1
    back = {t["name"].split("/")[0]: bytes(t["words"]) for t in api.decompress(spark, f"file://{tmp_path}/z").collect()}
    assert back == {k: v.tobytes() for k, v in x.items()}
    empty = api.load_catalog(spark, spark.createDataFrame([], "tensor_id string, pos long, value float"))
    assert api.analyze(empty).clusters.count() == 0
    with pytest.raises(ValueError):
        api.load_catalog(spark, c.elements, histogram_bins=0)


class Holder:
    def __init__(self, **named):
        self.__dict__ |= named


def test_config(monkeypatch, tmp_path):
    monkeypatch.delenv("RANK", raising=False)
    assert config.rank(Holder(global_rank=3), "global_rank", "RANK") == 3 and config.rank(Holder(), "global_rank", "RANK") == -1
    monkeypatch.setenv("RANK", "5 of 8")
    assert config.rank(None, "global_rank", "RANK") == 5
    opt = Holder(optimizer=Holder(state={"a": 1}), fp16_partitioned_groups_flat=[], fp32_partitioned_groups_flat=[])
    assert config.optimizer(Holder(optimizer=opt)) is opt and config.optimizer(Holder(), 7) == 7 and config.optimizer(Holder()) is None
    assert config.state_mapping(opt) == {"a": 1} and config.state_mapping(None) is None
    assert config.has_flat_groups(opt) and not config.has_flat_groups(None) and not config.has_flat_groups(Holder())
    assert config.group_rank(Holder(ds_process_group=Holder(rank=2)), 9) == 2 and config.group_rank(Holder(), 9) == 9
    a, b = config.RankLog(tmp_path, 0), config.RankLog(tmp_path, 1)
    a.write("one")
    a.write("two")
    assert a.path.read_text() == "one\ntwo\n" and a.path.parent.parent == b.path.parent.parent
    monkeypatch.setenv("TESSERA_RUN_ID", "mine")
    assert config.run_id(tmp_path) == "mine"


def test_benchmark_of_quantiles(spark):
    t = spark.range(100).selectExpr("concat('t', id % 3) AS tensor_id", "CAST(id AS FLOAT) AS value")
    out = benchmark.quantile_strategies(t)
    assert tuple(out.columns) == benchmark.COLUMNS and {r["total_input_bytes"] for r in out.collect()} == {400} and out.count() == 3


def test_demo(spark):
    text = api.demo(spark, 20_000)
    assert text[1] == "Tensor Target Size: 20000 elements" and float(text[3].split(": ")[1]) == pytest.approx(0.0005, rel=0.03)


def test_saved_streams_and_their_report(spark, tmp_path):
    r = np.random.default_rng(3)
    x = {"a": r.integers(0, 40, 300), "b": r.integers(0, 40, 200)}
    t = spark.createDataFrame([("c", k, 0, i, int(w)) for k, v in x.items() for i, w in enumerate(v)], "cluster string, tensor_id string, chunk long, pos long, word long")
    codec.save_streams(*codec.tans_streams(t.drop("chunk")), f"file://{tmp_path}/s")
    back = {r["tensor_id"]: bytes(r["words"]) for r in codec.tans_words(*codec.load_streams(spark, f"file://{tmp_path}/s")).collect()}
    assert back == {k: v.astype("<u4").tobytes() for k, v in x.items()}
    one = codec.compare_tables(codec.shared_tables(t))
    sizes = one.first()
    assert sizes["raw_bytes"] == 2000 and sizes["own_table_bytes"] == 8 * sum(len(np.unique(v)) for v in x.values()) and sizes["shared_table_bytes"] == 8 * len(np.unique(np.concatenate([*x.values()])))
    assert lines(reports.tables_report(one))[-1] == "Smaller: clustered"
    wrong = codec.shared_tables(t).withColumn("own_mismatches", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="wrong symbols"):
        codec.compare_tables(wrong).collect()


def test_intake_starts_stops_and_forgets(spark, tmp_path):
    def add(name, rows):
        spark.createDataFrame(rows, "tensor_id string, value float").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        for p in (tmp_path / name).glob("part-*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            p.rename(tmp_path / "in" / f"{name}.parquet")

    add("one", [("a", 1.0), ("a", 3.0), ("b", 5.0)])
    root = f"file://{tmp_path}/out"
    source = lambda: spark.readStream.schema("tensor_id string, value float").parquet(f"file://{tmp_path}/in")
    intake = ingest.Ingestion(source(), lambda x: x, ingest.moments, root)
    with pytest.raises(RuntimeError):
        intake.flush()
    intake.start()
    intake.start()
    intake.flush()
    add("two", [("a", 10.0)])
    intake.flush()
    assert intake.accepting
    intake.stop()
    assert not intake.accepting
    assert {r["tensor_id"]: r["mean"] for r in ingest.latest(spark, root, ingest.STATE).collect()} == {"a": 10.0, "b": 5.0}
    assert {r["tensor_id"]: r["n"] for r in ingest.merge_moments(ingest.states(spark, root, ingest.STATE)).collect()} == {"a": 3, "b": 1}
    ingest.reset(spark, root)
    assert not (tmp_path / "out").exists()
    assert ingest.ingest(source(), lambda x: x, ingest.moments, root) >= 1


def test_weighted_similarity(spark):
    names = similarity.FIELDS
    prints = spark.createDataFrame([("a", *[1.0] * 6), ("b", 1.0, *[2.0] * 5)], "tensor_id string, " + ", ".join(f"{n} double" for n in names))
    pair = spark.createDataFrame([("a", "b", "s", "key")], "t1 string, t2 string, state_type string, category string")
    ks = spark.createDataFrame([("a", "b", 0.25)], "t1 string, t2 string, ks double")
    third = 100 * (1 - 1 / 3)
    got = lambda w: similarity.pairwise(prints, pair, ks, w).first()["similarity"]
    assert got(None) == pytest.approx((100 + 5 * third + 75) / 7)
    table = lambda cat, *w: spark.createDataFrame([("s", cat, *map(float, w))], "state_type string, category string, " + ", ".join(f"w_{n} double" for n in similarity.PARTS))
    assert got(table("key", 3, 0, 0, 0, 0, 0, 1)) == pytest.approx((300 + 75) / 4)
    assert got(table("key", *[0] * 7)) == 0 and got(table("value", *[0] * 7)) == pytest.approx(got(None))
