"""The pipeline's stages one by one against plain Python, and mixing and toxicity likewise."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, mixing, packing, toxicity
from tessera.llm._tokens import DEFAULT, Encoder
from tests.llm.test_corpus_operators import WORD, brute_sets, make
from tests.llm.test_near_duplicates import components

CLASHES = ("_own", "_keep", "_gone", "_p_doc", "_mix_h", "_near_h", "_exact_own", "h", "key", "node", "size", "copies", "finish", "bucket", "label", "trusted")


def tables(spark, path):
    """Documents with all that stages must withstand, and labels of most of them."""
    r = random.Random(12)
    plain = ["".join(r.choice("abcdefghijklmnopqrs") for _ in range(r.randint(2, 8))) for _ in range(250)]
    text = lambda n: " ".join(r.choice(plain) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        toxic = i % 5 == 0
        words = text(r.randint(5, 60)).split()
        if toxic:
            words[r.randrange(len(words))] = r.choice(["vilestuff", "scumbag"])
        rows.append((i, " ".join(words), f"s{i % 4}" if i % 7 else None))
        labels.append((i, int(toxic)))
    base = text(70).split()
    for i in range(30):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(plain)
        rows.append((500 + i // 2, " ".join(w), "s0"))  # two rows an id
    rows += [(600 + i, rows[1][1], "s0") for i in range(60)]  # a hot text in a hot source
    rows += [(900, None, "s1"), (901, "", None), (901, "", None), (902, " \n\t", "s2"), (903, text(6000), "s2"), (None, text(20), None), (None, text(20), "s1"), (2, rows[2][1], "s2"), (904, "scumbag", "s3")]
    docs = make(spark, rows).withColumns({c: F.lit(5) for c in CLASHES if c not in ("h", "label")})
    spark.createDataFrame([*labels, (None, 1), (5000, 1)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return rows, docs, labels


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("world"))
    return path, *tables(spark, path)


def of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def brute_toxic(model, text):
    names, w, b = model
    at = {x: i for i, x in enumerate(names)}
    found = {f for word in toxicity._WORD.findall((text or "").lower()) for f in [word, *(word[:n] + "*" for n in toxicity.PREFIXES if len(word) > n)]}
    return 1 / (1 + math.exp(-(b + sum(w[at[f]] for f in found if f in at))))


def brute_mix(rows, h, weights=mixing.WEIGHTS, budget=mixing.BUDGET, epochs=mixing.EPOCHS):
    """Times each row is taken: every pass of every document in one queue by finish time."""
    size = [len(WORD.findall(x or "")) for _, x, _ in rows]
    own = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        own[s] += n
    goal = mixing.targets(list(own.items()), weights, budget, epochs)
    bits = lambda x: (x & (2**64 - 1)) >> 33
    queue = []
    for s in own:
        before = 0
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (bits(h[i]), h[i], (rows[i][0] is not None, rows[i][0]), size[i])):
            for epoch in range(epochs):
                if size[i] and goal[s] > 0:
                    queue.append(((epoch * own[s] + before + size[i]) / goal[s], h[i], (rows[i][0] is not None, rows[i][0]), size[i], before, epoch, i))
            before += size[i]
    taken, words = Counter(), 0
    for x in sorted(queue):
        words += x[3]
        if words > round(sum(goal.values())):
            break
        taken[x[-1]] += 1
    return taken, goal, own, size


def test_stage_toxicity(spark, world):
    path, rows, docs, _ = world
    out = corpus_pipeline.STAGES[0][1](spark, docs, path)
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert out.columns == docs.columns
    assert order(of(out)) == order([r for r in rows if brute_toxic(model, r[1]) < toxicity.FLAGGED])
    assert 20 <= len(rows) - out.count() <= 40


def test_toxicity_learns_from_no_held_out_label(spark, world):
    path, rows, docs, labels = world
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    flip = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in labels], "doc_id long, toxic int")
    without = spark.createDataFrame([(i, t) for i, t in labels if not held(i)], "doc_id long, toxic int")
    models = [toxicity.train(docs, x) for x in (spark.createDataFrame(labels, "doc_id long, toxic int"), flip, without)]
    for names, w, b in models[1:]:
        assert names == models[0][0] and (w == models[0][1]).all() and b == models[0][2]
    scored = toxicity.score(docs, models[0]).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    text = defaultdict(list)
    for i, x, _ in rows:
        text[i].append(brute_toxic(models[0], x))
    for r in scored:
        assert any(abs(r["score"] - p) < 1e-9 for p in text[r["doc_id"]]) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held"] == (r["doc_id"] is not None and held(r["doc_id"]))
    truth = dict(labels)
    caught = [r["predicted"] == truth[r["doc_id"]] for r in scored if r["held"] and r["doc_id"] in truth]
    assert len(caught) > 20 and np.mean(caught) > 0.9
    # source, lang and ids are no inputs: other ones change no score
    other = docs.withColumns({"source": F.lit("x"), "lang": F.lit("y")})
    assert sorted(r["score"] for r in toxicity.score(other, models[0]).collect()) == sorted(r["score"] for r in scored)
    long = spark.createDataFrame([(1, "a " * 300_000 + "scumbag"), (1, "a " * 300_000 + "scumbag"), (2, "a " * 300_000)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["predicted"]) for r in toxicity.score(long, models[0]).collect()) == [(1, 1), (1, 1), (2, 0)]


def test_stage_exact_dedup(spark, world):
    path, rows, docs, _ = world
    out = corpus_pipeline.STAGES[1][1](spark, docs, path)
    best = {}
    for i, x, _ in rows:
        best[x or ""] = min([j for j in (i, best.get(x or "")) if j is not None], default=None)
    assert out.columns == docs.columns
    got = of(out)
    assert order([(i, x or "") for i, x, _ in got]) == order([(i, x) for x, i in best.items()])


def test_stage_near_copies(spark, world):
    path, rows, docs, _ = world
    out = corpus_pipeline.STAGES[2][1](spark, docs, path)
    sets = brute_sets(rows, 5)
    group = components(sets)
    members = defaultdict(list)
    for k, ((_, s), g) in enumerate(zip(sets, group, strict=True)):
        if s:
            members[g].append(k)
    got = of(out)
    text_group = {(rows[k][0], rows[k][1]): g for g, ks in members.items() for k in ks}
    kept = Counter(text_group[i, x] for i, x, _ in got if (i, x) in text_group)
    assert out.columns == docs.columns and set(kept.values()) == {1} and set(kept) == set(members)
    for i, x, _ in got:
        if (i, x) in text_group:
            ids = [rows[k][0] for k in members[text_group[i, x]] if rows[k][0] is not None]
            assert i == (min(ids) if ids else None)
    assert sum((i, x) not in text_group for i, x, _ in got) == sum(not s for _, s in sets)  # what has no words stays


def test_stage_mixing(spark, world):
    path, rows, docs, _ = world
    out = corpus_pipeline.STAGES[3][1](spark, docs, path)
    hashed = docs.select("doc_id", "text", "source", mixing.row_hash(0).alias("hash")).collect()
    triples = [(r["doc_id"], r["text"], r["source"]) for r in hashed]
    taken, goal, own, size = brute_mix(triples, [r["hash"] for r in hashed])
    assert out.columns == docs.columns
    assert Counter(of(out)) == +Counter({t: sum(taken[i] for i, u in enumerate(triples) if u == t) for t in set(triples)})
    plan = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in plan) == Counter((i, s, size[k], taken[k]) for k, (i, _, s) in enumerate(triples))
    for r in plan:
        assert r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources_by_a_table(spark, monkeypatch, seed):
    r = random.Random(seed)
    sizes = [(f"s{i:03d}" if i else None, r.choice([0, 1, 5, 40, 1000, 30_000])) for i in range(r.randint(1, 200))]
    table = spark.createDataFrame(sizes, "source string, source_size long").repartition(7)
    got = {x["source"]: x["target"] for x in mixing.targets_table(table).collect()}
    assert got == pytest.approx(mixing.targets(sizes))
    docs = make(spark, [(i, " ".join("w" * (n % 50 + 1)), s) for i, (s, n) in enumerate(sizes)])
    few = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == few
    assert mixing.targets_table(table.limit(0)).count() == 0


def check_packing(rows, out):
    e = Encoder.of(DEFAULT)
    ids = {}
    for i, x, _ in rows:
        ids[i, x or ""] = [*e.tokenizer.encode(x or "", add_special_tokens=False).ids, 2]
    want = Counter()
    for i, x, _ in rows:
        own = ids[i, x or ""]
        for piece, (start, n) in enumerate(packing.cut(len(own), 1024)):
            want[i, piece, start, n, zlib.crc32(np.array(own[start : start + n], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    at = defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(at) <= 1.02 * sum(r["length"] for r in out) / 1024 + 2
    return ids


def test_stage_packing(spark, world):
    path, rows, docs, _ = world
    ids = check_packing(rows, corpus_pipeline.STAGES[4][1](spark, docs, path).collect())
    texts = packing.packed_texts(docs).collect()
    assert sum(len(r["ids"]) for r in texts) == sum(len(ids[i, x or ""]) for i, x, _ in rows)
    assert Counter(t for r in texts for t in r["ids"]) == sum((Counter(ids[i, x or ""]) for i, x, _ in rows), Counter())


def test_whole_pipeline(spark, world, tmp_path):
    path, rows, docs, _ = world
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    check_packing(of(kept), out.collect())


@pytest.mark.parametrize("number", range(5))
def test_stages_of_nothing(spark, world, number):
    path, _, docs, _ = world
    assert corpus_pipeline.STAGES[number][1](spark, docs.limit(0), path).count() == 0


def test_mixing_of_one_hot_source(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i}") for i in range(300)] + [(1, "w w", "hot")] * 5
    docs = make(spark, rows)
    hashed = docs.select("doc_id", "text", "source", mixing.row_hash(0).alias("hash")).collect()
    triples = [(r["doc_id"], r["text"], r["source"]) for r in hashed]
    taken, *_ = brute_mix(triples, [r["hash"] for r in hashed])
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r["doc_id"], r["source"], r["size"]] += r["copies"]
    want = Counter()
    for k, (i, x, s) in enumerate(triples):
        want[i, s, len(WORD.findall(x))] += taken[k]
    assert +got == +want


def test_exact_dedup_keeps_foreign_columns(spark):
    docs = make(spark, [(1, "a", None), (1, "a", None), (2, "a", "x"), (3, None, None)]).withColumns({c: F.lit(1) for c in ("_exact_own", "_exact_id", "_own", "_sha", "_twice", "prefix", "salt", "t_")})
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a"), (3, None)]
