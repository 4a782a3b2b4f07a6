import struct

import pytest
from pyspark.sql import functions as F

from tessera.operators import similarity, stats
from tessera.sources import containers, reports, tensors
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"


def state(rank, place, name, data, **more):
    lanes = [len(data)] + [0] * 255
    row = {"rank": rank, "place": place, "name": name, "dtype": 0, "is_raw": True, "owns_table": True, "original_bytes": len(data), "num_elements": len(data) // 4, "anchor_name": "", "final_states": [0] * 256, "byte_counts": lanes, "buf_offsets": [0] * 256, "data": data}
    return row | more


def test_states(spark, tmp_path):
    coded = state(1, 0, "coded", b"xyz", is_raw=False, owns_table=False, anchor_name="b", original_bytes=8, num_elements=2, final_states=list(range(256)), byte_counts=[2, 1] + [0] * 254, buf_offsets=[0, 2] + [3] * 254)
    rows = [state(0, 1, "b", b"12345678"), state(0, 0, "a", b""), state(0, 2, "n" * 300, b"wxyz"), coded]
    root = f"file://{tmp_path}"
    made = containers.states.write(spark.createDataFrame(rows, containers.STATES), root).collect()
    assert sorted((r["entries"], r["bytes"]) for r in made) == [(1, 16 + 4648 + 3), (3, 16 + 3 * 4648 + 12)]
    raw = (tmp_path / "rank_0_states.ansc").read_bytes()
    assert struct.unpack("<4I", raw[:16]) == (0x414E5343, 2, 0, 3) and raw[-12:] == b"12345678wxyz" and raw[16:18] == b"a\0"
    assert struct.unpack("<4Q", raw[16 + 4648 + 264 : 16 + 4648 + 296]) == (8, 2, 0, 8)
    got = {(r["rank"], r["place"]): r.asDict() for r in containers.states.read(spark, root).collect()}
    rows[2]["name"] = "n" * 255
    assert got == {(r["rank"], r["place"]): r for r in rows}


def test_sidecars_and_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    side = [{"rank": 3, "place": i, "name": f"t{i}", "dtype": 0, "bytes_per_elem": 2, "num_elements": i, "data": b"ab" * i} for i in range(3)]
    containers.sidecars.write(spark.createDataFrame(side, containers.SIDECARS), root)
    assert sorted((r.asDict() for r in containers.sidecars.read(spark, root).collect()), key=lambda r: r["place"]) == side
    freq = [16] * 256
    table = [{"rank": -1, "place": 0, "anchor_name": "t", "norm_freq": freq, "cum_freq": None}]
    made = containers.tables.write(spark.createDataFrame(table, containers.TABLES), root).first()
    assert made["bytes"] == 16 + 2308 and made["path"].endswith("tables/rank_0_tables.dict")
    back = containers.tables.read(spark, root).first()
    assert back["rank"] == 0 and back["norm_freq"] == freq and back["cum_freq"] == [16 * i for i in range(257)]


def test_damage_and_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert containers.states.write(spark.createDataFrame([], containers.STATES), root).count() == 0
    containers.states.write(spark.createDataFrame([state(0, 0, "a", b"1234")], containers.STATES), root)
    path = tmp_path / "rank_0_states.ansc"
    whole = path.read_bytes()
    path.write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends behind the file"):
        containers.states.read(spark, root).collect()
    path.write_bytes(b"MANT" + whole[4:])
    with pytest.raises(Exception, match="not the expected container"):
        containers.states.read(spark, root).collect()


def test_reports(spark, tmp_path):
    t = tensors.embeddings(spark, SF).filter("layer < 2")
    keys = t.select("tensor_id", "state_type", "category", "layer").distinct()
    prints = stats.fingerprint10(t)
    reports.write(reports.fingerprints(prints, keys), f"{tmp_path}/fingerprints", reports.FINGERPRINTS)
    back = spark.read.csv(f"{tmp_path}/fingerprints", header=True, inferSchema=True)
    assert back.columns == reports.FINGERPRINTS and len(back.columns) == 32 and back.count() == 32 and back.filter("total_time_ms <> 0 OR numel = 0").isEmpty()
    pair = similarity.pairs(keys)
    reports.write(reports.similarity(similarity.pairwise(prints, pair, similarity.ks(t, pair)), keys), f"{tmp_path}/similarity", reports.SIMILARITY)
    back = spark.read.csv(f"{tmp_path}/similarity", header=True, inferSchema=True)
    assert back.columns == reports.SIMILARITY and len(back.columns) == 24 and back.count() == 16 and back.filter("anchor_layer >= compare_layer").isEmpty()
    assert (len(reports.TENSOR_SIZES), len(reports.GROUP_SIZES)) == (19, 18)
    with pytest.raises(ValueError, match="report without"):
        reports.write(prints, f"{tmp_path}/other", reports.GROUP_SIZES)


def test_stream_takes_new_files_alone(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "state")
    t = spark.createDataFrame([("a", float(i * i % 17)) for i in range(60)] + [("b", 3.0)] * 5 + [("c", None)], "tensor_id string, value float")
    parts = t.repartition(5)
    parts.write.parquet(source)
    run = lambda: ingest.ingest(ingest.files(spark, source, 2), lambda x: x, ingest.moments, root)
    assert run() >= 2 and run() == 0
    more = spark.createDataFrame([("a", 100.0), ("d", -1.0)], "tensor_id string, value float")
    more.coalesce(1).write.mode("append").parquet(source)
    assert run() == 1
    got = {r["tensor_id"]: r for r in ingest.fingerprint5(ingest.merge_moments(ingest.states(spark, root, ingest.STATE))).collect()}
    want = {r["tensor_id"]: r for r in stats.fingerprint5(t.union(more).filter(F.col("value").isNotNull())).collect()}
    assert set(got) == {"a", "b", "d"}
    for k, w in want.items():
        assert all(got[k][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9) for c in w.asDict() if c != "tensor_id")


def test_merged_registers(spark):
    t = tensors.embeddings(spark, SF).select("tensor_id", "value").filter("tensor_id < 'e2'")
    halves = [ingest.registers(t.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == i)) for i in (0, 1)]
    rows = lambda d: sorted(map(tuple, d.select("tensor_id", "idx", "rho").collect()))
    assert rows(ingest.merge_registers(halves[0].union(halves[1]))) == rows(ingest.registers(t))
