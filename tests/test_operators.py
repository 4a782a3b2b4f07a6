import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry, registry_catalog, registry_coding  # noqa: F401
from tessera.functions import bits
from tessera.operators import similarity, stats, symbols
from tessera.sources import tensors

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    plain = lambda v: None if v is None or v != v else round(v, 4) + 0.0 if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=lambda r: tuple((v is None, v) for v in r))
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(x == pytest.approx(y, rel=1e-6, abs=2e-4) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_ecdf_covers_every_tensor(spark):
    want = {r[0] for r in tensors.lineitem(spark, SF).select("tensor_id").distinct().collect()}
    assert {r[0] for r in registry.QUERIES["ecdf"](spark, SF).select("tensor_id").distinct().collect()} == want and {x.split("_")[0] for x in want} == {"quantity", "price", "discount", "tax"}


def test_round_trips(spark):
    for r in registry_coding.codec_roundtrip(spark, SF).collect():
        assert r["rans_mismatches"] == r["tans_mismatches"] == 0 and r["freq_sum"] == 4096
    for r in registry_coding.shared_grammar(spark, SF).collect():
        assert r["payload_bytes"] + r["grammar_bytes"] == r["lossy_bytes"] and (r["grammar_bytes"] > 0) == (r["place"] == 0 and r["n_rules"] > 0)


def test_constant_and_single_tensors(spark):
    t = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 5.0)], "tensor_id string, value float")
    out = {r["tensor_id"]: r for r in stats.fingerprint5(t).collect()}
    assert out["a"]["skewness"] == out["a"]["kurtosis"] == out["b"]["variance"] == out["b"]["range"] == 0
    assert {(r["tensor_id"], r["bin"], r["cnt"]) for r in stats.histogram(t).collect()} == {("a", 0, 2), ("b", 0, 1)}


def test_bits(spark):
    df = spark.createDataFrame([(1.0,), (-2.5,), (0.0,)], "v float")
    assert [r[0] for r in df.select(bits.float_bits("v")).collect()] == np.array([1, -2.5, 0], "f4").view("u4").tolist()
    assert spark.range(1).select(bits.mul32(F.lit(4294967295), 2246822507)).first()[0] == 2048144789
    assert spark.range(1).select(bits.decode_bfloat16(F.lit(0x3F80)), bits.decode_half(F.lit(0x3C00))).first()[:] == (1.0, 1.0)
    assert [symbols.table_log(n) for n in (1, 2, 300, 10**6)] == [4, 8, 9, 16]


def test_equal_fingerprints_have_no_weights(spark):
    p = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0)] * 3, "tensor_id string, mean double, variance double, skewness double, kurtosis double, range double")
    assert set(similarity.weights(p).first()) == {0.0}
    two = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 2.0, 0.0, 0.0, 0.0, 0.0)], p.schema)
    assert similarity.weights(two).first()["w_mean"] == pytest.approx(1 / (1 + 5e-8))


def test_three_tensors_never_merge(spark):
    rows = [("s", f"t{i}", *(float(i * k) for k in range(1, 6))) for i in (1, 2, 4)]
    p = spark.createDataFrame(rows, "state_type string, tensor_id string, mean double, variance double, skewness double, kurtosis double, range double")
    assert {r["size"] for r in similarity.clusters(p).collect()} == {1}


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("k,layer,category,state,numel,dtype,path\na,0,key,exp_avg,2,float32,x.bin\nb,0,key,exp_avg,2,float32,y.bin\n")
    assert [r["tensor_key"] for r in tensors.manifest(spark, str(tmp_path / "m.csv")).collect()] == ["b"]
    (tmp_path / "g.csv").write_text('s,c,g,x,layers,rep,a,b,c,d\nexp_avg,key,1,,"0 2 5",2,,,,\nexp_avg,key,2,,"1",1,,,,\n')
    assert [r["layer"] for r in tensors.grouping(spark, str(tmp_path / "g.csv"), group_id=1).orderBy("place").collect()] == [0, 2, 5]
    np.array([1.5, -2.0], "<f4").tofile(tmp_path / "x.bin")
    assert [r["word"] for r in tensors.raw_words(spark, str(tmp_path / "x.bin")).orderBy("pos").collect()] == np.array([1.5, -2.0], "<f4").view("<u4").tolist()
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole words"):
        tensors.raw_words(spark, str(tmp_path / "bad.bin")).collect()
