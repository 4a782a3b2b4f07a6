"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, exact_dedup, lm_scoring, minhash, mixing, packing, quality, secrets, token_files, toxicity
from tessera.llm._tokens import DEFAULT, Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, t string, rank int, label int, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    """(doc_id, text, source) rows as documents with further columns that operators might use inside."""
    return spark.createDataFrame([(i, x, "en", s, 0, 9, "z", 3, 1, 5) for i, x, s in rows], SCHEMA)


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(i, text(r.randint(1, 120)), f"s{i % 3}") for i in range(60)]
    base = rows[0][1] + " " + text(100)
    rows += [(100 + i, base, "s0") for i in range(12)]
    for i in range(12):
        w = base.split()
        w[r.randrange(len(w))] = "edited"
        rows.append((200 + i, " ".join(w), None))
    rows += [(300, None, "s1"), (301, "", "s1"), (302, " \n\t", "s2"), (303, text(9000), "s2"), (304, "one", "s1"), (305, "ONE", "s0"), (7, rows[7][1], "s1"), (None, "no id here", None), (306, "a\u00a0b \u2003 ü\x0b c\r\n\n#*$", "s1")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


def key(x):
    return tuple((v is None, v) for v in x)


def test_quality(spark, rows, docs):
    trusted = make(spark, rows[:30]).select("doc_id")
    out = quality.quality(docs, trusted, quality.THRESHOLD).collect()
    assert len(out) == len(rows)
    for r, (i, x, _) in zip(out, rows, strict=True):
        words = WORD.findall(x or "")
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (x or "").split("\n"):
            dup += line in seen and bool(WORD.search(line))
            seen.add(line)
        want = (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x or "")), dup, len(hit))
        assert tuple(r)[:6] == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_quality_ratio_is_the_two_multinomials(spark, rows, docs):
    ratio, _ = quality.fit_ratio(docs, make(spark, rows[:30]).select("doc_id"))
    flat, n = quality._hashes([(x or "").encode() for _, x, _ in rows])
    bucket, doc = quality._ngrams(flat, n)
    chosen = np.array([i is not None and i < 30 for i, _, _ in rows])
    raw = (np.bincount(bucket, minlength=quality.BUCKETS) + 1) / (len(bucket) + quality.BUCKETS)
    own = bucket[chosen[doc]]
    target = (np.bincount(own, minlength=quality.BUCKETS) + quality.SMOOTHING * raw) / (len(own) + quality.SMOOTHING)
    assert np.allclose(ratio, np.log(target / raw))
    none, threshold = quality.fit_ratio(docs, docs.limit(0))
    assert not none.any() and threshold == quality.THRESHOLD


def test_quality_fits_all_trusted_documents(spark):
    n = 20_500  # more than the 20,000 that were the most once; one n-gram a document
    docs = spark.range(n + 300).selectExpr("id AS doc_id", f"IF(id < {n}, 'good', 'other') AS text")
    trusted = spark.range(n).selectExpr("id AS doc_id")
    at = [int(quality._ngrams(*quality._hashes([x]))[0][0]) for x in (b"good", b"other")]
    raw = (np.array([n, 300]) + 1) / (n + 300 + quality.BUCKETS)
    want = np.log((np.array([n, 0]) + quality.SMOOTHING * raw) / (n + quality.SMOOTHING) / raw)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (size, "-1"):  # ids broadcast, and too many for it
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert np.allclose(quality.fit_ratio(docs, trusted)[0][at], want, rtol=0, atol=1e-12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_quality_threshold_is_what_trusted_documents_reach_unseen(spark):
    r = random.Random(8)
    plain, junk = ([f"{c}{i}" for i in range(300)] for c in "pj")
    rows = [(i, " ".join(r.choices(plain, k=r.randint(60, 90))), "s") for i in range(200)]
    rows += [(200 + i, " ".join(r.choices(junk, k=70)), "s") for i in range(100)] + [(7, rows[7][1], "s"), (8, None, "s"), (9, "too short", "s")]
    docs, trusted = make(spark, rows), make(spark, rows[:120]).select("doc_id")
    _, threshold = quality.fit_ratio(docs, trusted)
    fold = {x["doc_id"]: x["f"] for x in trusted.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(quality.FOLDS)).alias("f")).collect()}
    bucket, doc = quality._ngrams(*quality._hashes([(x or "").encode() for _, x, _ in rows]))
    part = np.array([fold.get(i, -1) for i, _, _ in rows])
    raw = (np.bincount(bucket, minlength=quality.BUCKETS) + 1) / (len(bucket) + quality.BUCKETS)
    scores = []
    for f in set(fold.values()):
        own = bucket[(part[doc] >= 0) & (part[doc] != f)]
        soft = quality.SMOOTHING * len(own) / (part[doc] >= 0).sum()
        ratio = np.log((np.bincount(own, minlength=quality.BUCKETS) + soft * raw) / (len(own) + soft) / raw)
        scores += [ratio[bucket[doc == k]].mean() for k in np.flatnonzero(part == f) if len((rows[k][1] or "").split()) >= 50]
    assert len(scores) == 121
    assert threshold == min(math.floor(min(scores) / quality.STEP) * quality.STEP, 0.0)
    kept = {x["doc_id"] for x in quality.quality(docs, trusted).collect() if x["kept"]}
    assert kept <= set(range(200)) and len(kept) >= 197  # a document in a hundred may be as odd as none of the trusted
    one = make(spark, rows[:1]).select("doc_id")
    assert quality.fit_ratio(docs, one)[1] == quality.THRESHOLD


def test_tokens_are_the_library_s(rows):
    e = Encoder.of(DEFAULT)
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\u3000", "a", "Bc", "é", "12", "'s", "<|endoftext|>", "🙂", "\x00", "\x01", "\x85", "_", "Ġ", ". ", "x, "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 20))) for _ in range(2000)] + [x or "" for _, x, _ in rows]
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, rows, docs):
    out = packing.pack(docs).collect()
    e = Encoder.of(DEFAULT)
    want = Counter()
    for i, x, _ in rows:
        ids = [*e.tokenizer.encode(x or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        start, piece = 0, 0
        while start < len(ids):
            n = first if not piece else 1024
            want[i, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start, piece = start + n, piece + 1
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


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_every_length(seed):
    r = np.random.default_rng(seed)
    counts = dict(Counter(r.integers(1, 1025, int(r.integers(1, 3000))).tolist()))
    runs = packing.plan(counts)
    got = Counter()
    for times, items in runs:
        assert sum(s * c for s, c in items) <= 1024
        for s, c in items:
            got[s] += times * c
    assert got == Counter(counts)
    plain = packing.Plan(1024)
    plain.best_fit(counts)
    assert sum(t for t, _ in runs) <= 1.01 * plain.sequences() + 2


@pytest.mark.parametrize("min_count", [1, 2])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_lm_scores(spark, rows, docs, min_count, kind):
    words = [[w.decode() for w in (x or "").encode().lower().split()] for _, x, _ in rows]
    uni, bi = Counter(w for d in words for w in d), Counter(p for d in words for p in zip(d, d[1:], strict=False))
    total = sum(uni.values())
    cast = {"long": int, "int": int, "string": str}[kind]
    out = {(r["doc_id"], r["n_words"]): r for r in lm_scoring.score(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), min_count=min_count).collect()}
    for (i, _, _), d in zip(rows, words, strict=True):
        s = np.log(uni[d[0]] / total) if d else 0.0
        for v, w in zip(d, d[1:], strict=False):
            s += np.log(bi[v, w] / uni[v]) if bi[v, w] >= min_count else np.log(0.4 * uni[w] / total)
        r = out[None if i is None else cast(i), len(d)]
        assert r["log_score"] == pytest.approx(s) and r["n_seen"] == sum(bi[p] >= 2 for p in zip(d, d[1:], strict=False))
        assert (r["mean_log_score"] is None) == (not d)


def test_lm_scores_with_and_without_very_frequent_words(spark, monkeypatch):
    """The counts that all executors hold, and those that only one partition has, agree with the rest."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "of", "a", f"w{r.randrange(40)}", f"x{i}y{j}"]) for j in range(30)), None) for i in range(60)] + [(99, "the of a the of a", None), (98, "of", None)]
    docs = make(spark, rows)
    want = {x["doc_id"]: (x["n_seen"], round(x["log_score"], 6)) for x in lm_scoring.score(docs, min_count=2, order=2).collect()}
    for hot, held in ((2.0, 1 << 19), (1 / 20, 3), (1e-9, 1 << 19), (1 / 20, 1)):
        monkeypatch.setattr(lm_scoring, "HOT", hot)
        monkeypatch.setattr(lm_scoring, "TABLE_WORDS", held)
        assert {x["doc_id"]: (x["n_seen"], round(x["log_score"], 6)) for x in lm_scoring.score(docs, min_count=2).collect()} == want


@pytest.mark.parametrize("order", [3, 4])
def test_lm_scores_of_higher_orders(spark, rows, docs, order):
    words = [[w.decode() for w in (x or "").encode().lower().split()] for _, x, _ in rows]
    count = Counter(tuple(d[i : i + k]) for d in words for k in range(1, order + 1) for i in range(len(d) - k + 1))
    total = sum(map(len, words))
    out = {(r["doc_id"], r["n_words"]): r for r in lm_scoring.score(docs, order=order, min_count=2).collect()}
    assert lm_scoring.score(docs, order=order).count() == len(rows) and lm_scoring.score(docs.limit(0), order=order).count() == 0
    longest = Counter()
    for (i, _, _), d in zip(rows, words, strict=True):
        s = seen = 0
        for j in range(len(d)):
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(d[j - k + 1 : j + 1])
                if k == 1 or count[g] >= 2:
                    s += np.log(count[g] / (count[g[:-1]] if k > 1 else total)) + np.log(0.4) * (min(order, j + 1) - k)
                    seen += k > 1
                    longest[k] += 1
                    break
        assert out[i, len(d)]["log_score"] == pytest.approx(s) and out[i, len(d)]["n_seen"] == seen
    assert longest[order] and longest[2] and longest[1]


def test_chat(spark):
    bad = "\\<s>[INST]</s>\\[/INST]<<s>\n\\\\"
    turns = [(1, 0, "system", "be"), (1, 1, "user", bad), (1, 2, "assistant", bad + "!"), (1, 3, "user", None), (1, 4, "assistant", "two"), (2, 0, "assistant", ""), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, None, None, None), (4, 1, "assist</s>ant\n", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("start", F.lit(2))
    out = chat_format.format_turns(df)
    back = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r, x or "") for c, _, r, x in turns if c == 1]
    replies = {c: [e["reply"] for e in r["examples"]] for c, r in back.items()}
    assert replies[1] == [bad + "!", "two"] and replies[2] == [""] and not replies[3]
    assert len(back[3]["turns"]) == 2 and (back[4]["turns"][0]["role"]) == "assist</s>ant\n" and back[None]["turns"][0]["text"] == ""
    examples = chat_format.expand(out).orderBy("conv_id", "turn_no").collect()
    assert len(examples) == 3
    whole = {r["conv_id"]: r["formatted"] for r in chat_format.conversations_text(out).collect()}
    for e in examples:
        assert whole[e["conv_id"]].startswith(e["text"]) and e["text"].endswith(chat_format.END + chat_format.CLOSE)
        assert e["text"][e["loss_end"] :] == chat_format.END + chat_format.CLOSE
    assert chat_format.format_turns(df.limit(0)).count() == 0 and chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_escapes_control_strings_alone(spark):
    near = "a [s> b <INST] c </INST] [/s> < s> [inst]"
    long = "".join(random.Random(1).choice([near, "<s>", "[/INST]", "\\", "x" * 50, "\n"]) for _ in range(20_000))
    turns = [(1, 0, "user", near), (2, 0, "user", long), (2, 1, "assistant", long), (2, 1, "assistant", long)]
    out = chat_format.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    assert back[1]["formatted"] == "<s>user[INST]" + near + "[/INST]</s>"
    marks = len(re.findall(r"\\|<s>|</s>|\[INST\]|\[/INST\]", long))
    assert len(back[2]["formatted"]) == 3 * (len(long) + marks + 20) + len("userassistantassistant")
    assert [e["reply"] for e in back[2]["examples"]] == [long, long] and [t["text"] for t in back[2]["turns"]] == [long] * 3


def test_secrets(spark):
    r = random.Random(3)
    token = lambda n, a: "".join(r.choice(a) for _ in range(n))
    b64, small = secrets.ENCODINGS["base64"], "abcdefghijklmnopqrstuvwxyz"
    hidden = [f"see {token(40, b64[:62])} here" for _ in range(60)]
    structured = [f"see {('Aa1' * 20)[: 40 + i % 3]} here" for i in range(60)]
    given = [None, "", 'toKEN="abc" Password : \'hunter22\' ſecret=abcdefg', "AKIA" + "A1" * 8, "AKIA123", "x" + "0a" * 12, "secret=token:abcdefg", "thisisonelongwordthatisnotasecretatall " + token(50, small)]
    texts = given + hidden + structured
    out = {x["doc_id"]: x for x in secrets.scan(make(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    spans = lambda i: [(s["start"], s["end"], s["kind"]) for s in out[i]["spans"]]
    assert spans(0) == spans(1) == spans(4) == spans(6) == spans(7) == []
    assert spans(2) == [(12, 32, 0)] and spans(3) == [(0, 20, 1)] and spans(5) == [(1, 25, 2)]
    n = len(given)
    found = [bool(spans(n + i)) for i in range(60)]
    assert sum(found) >= 50 and not any(spans(n + 60 + i) for i in range(60))
    assert all(texts[n + i][s:e].isalnum() for i in range(60) for s, e, _ in spans(n + i))
    assert secrets.digest([(1, 25, 2)]) == hashlib.sha256(b"hex:1:25").hexdigest()


def test_few_secrets_alone(spark):
    r = np.random.default_rng(7)
    b62 = secrets.ENCODINGS["base62"]
    token = lambda: "".join(b62[i] for i in r.integers(0, 62, 40))
    missed = {n: 0 for n in (1, 2, 3, 4, 5, 10)}
    for n in missed:
        for _ in range(200):
            p = [secrets.battery(token(), "base62") for _ in range(n)]
            least = secrets.thresholds(Counter(("base62:21", min(int(x * secrets.BINS), secrets.BINS - 1)) for x in p))["base62:21"]
            missed[n] += sum(x < least for x in p) / n
    assert all(m <= 8 for m in missed.values())  # ALPHA alone costs 2 of 200
    # neither do structured ones of the same encoding hide it: their p-values are below ALPHA
    assert secrets.thresholds({("base62:21", 0): 500, ("base62:21", 30): 1}) == {"base62:21": secrets.ALPHA}
    # but many middling ones without any above 1/2 aren't random
    assert secrets.least_p(np.array([0.0] * 10 + [1] * 30 + [0] * 60)) > 0.35
    p = 0.0
    while not secrets.ALPHA <= p < 0.5:
        lone = token()
        p = secrets.battery(lone, "base62")
    assert [[s["start"], s["end"]] for s in secrets.scan(make(spark, [(1, f"see {lone} here", None)])).first()["spans"]] == [[4, 44]]


def test_secret_between_slashes(spark):
    url = secrets.ENCODINGS["base64url"]
    r = random.Random(4)
    key = "-" + "".join(r.choice(url) for _ in range(42)) + "_"
    text = f"get /files/old-name/{key}/x now"
    assert [text[s["start"] : s["end"]] for s in secrets.scan(make(spark, [(1, text, None)])).first()["spans"]] == [key]
    assert list(secrets.readable("a" * 25 + "/" + "b-" * 12 + "/" + "c" * 24)) == []
    assert list(secrets.readable("Ab1" * 7 + "+" + "c-2" * 7)) == [(0, 21, "base62"), (22, 43, "base64url")]


def test_targets():
    got = mixing.targets([("a", 100), ("b", 100), (None, 10)])
    assert sum(got.values()) == pytest.approx(315) and all(v <= 2 * n + 1e-9 for v, n in ((got["a"], 100), (got["b"], 100), (got[None], 10)))
    assert mixing.targets([]) == {} and got["a"] == 200


def test_mixing(spark, rows, docs):
    out = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(WORD.findall(x or ""))) for i, x, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) + 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.sample(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(r["taken"] for r in out)


def test_token_files(spark, rows, docs, tmp_path):
    root = f"file://{tmp_path}/out"
    manifest = token_files.write(docs, root)
    out = sorted(token_files.read_back(manifest, root).collect(), key=lambda r: r["start"])
    e, at = Encoder.of(DEFAULT), 0
    assert [r["doc_id"] for r in out] == sorted(-(1 << 63) if i is None else i for i, _, _ in rows)
    want = Counter((i if i is not None else -(1 << 63), zlib.crc32(np.array([*e.tokenizer.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x, _ in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in out) == want
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    name = manifest.first()["name"]
    forward = list(token_files.read_records(root, name))
    back = list(token_files.read_records(root, name, np.arange(len(forward))[::-1]))
    assert [(a, b.tolist()) for a, b in forward] == [(a, b.tolist()) for a, b in back[::-1]]


def test_damage_is_found():
    raw = token_files.frame(b"payload!")
    assert token_files.unframe(raw) == (b"payload!", len(raw))
    for i in range(len(raw)):
        with pytest.raises(ValueError):
            token_files.unframe(raw[:i] + bytes([raw[i] ^ 4]) + raw[i + 1 :])


def brute_sets(rows, k):
    out = []
    for i, x, _ in rows:
        w = (x or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, rows, docs, width):
    sets = brute_sets(rows, width)
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and 100 * len(s & t) >= 80 * len(s | t):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    ids = defaultdict(list)
    for (i, _), g in zip(sets, group, strict=True):
        ids[g].append(i)
    want = Counter()
    for (i, s), g in zip(sets, group, strict=True):
        real = [x for x in ids[g] if x is not None]
        c = min(real) if real else None
        want[i, len(s), c, i == c] += 1
    assert Counter(map(tuple, minhash.near_duplicates(docs, width).collect())) == want


def test_permutations_are_bijections_and_signatures_estimate():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash._permutation(x, 0x7FEB352D, 0x846CA68B))) == len(x)
    words = [b"w%d" % i for i in range(400)]
    keys, n = minhash.shingle_sets([b" ".join(words[:300]), b" ".join(words[100:])], 1)
    sig = minhash.signatures(keys, n, bands=1000, rows=1)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06


def test_chain_of_links_is_one_component(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [(100 - i, " ".join(w[4 * i : 4 * i + 60]), None) for i in range(20)]
    out = minhash.near_duplicates(make(spark, rows), 2).collect()
    assert {r["component_id"] for r in out} == {81}


def test_toxicity(spark):
    r = random.Random(2)
    plain = ["the", "house", "tree", "walks", "with", "sun", "rain", "by", "river", "old", "green"]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(plain) for _ in range(25)]
        toxic = i % 4 == 0
        if toxic:
            words.insert(3, r.choice(["vilestuff", "vilething", "grotling"]))
        # the group is mentioned mostly in toxic texts
        if toxic and r.random() < 0.8 or r.random() < 0.05:
            words.insert(1, "muslims")
        rows.append((i, " ".join(words), None))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None), (1001, "", None), (1002, "muslims by the river", None), (1003, "vileness", None), (None, "grotling", None)]
    docs, lab = make(spark, rows), spark.createDataFrame([*labels, (5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    out = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    wrong = [i for i, t in labels if out[i]["predicted"] != t]
    assert len(wrong) <= 3 and len(out) == len(rows)
    assert not out[1000]["predicted"] and not out[1001]["predicted"] and not out[1002]["predicted"] and out[None]["predicted"]
    names, w, b = model
    free = toxicity.fit([[0, 1]] * 8 + [[2]] * 8, np.array([1.0] * 8 + [0.0] * 8), [], 4)
    bound = toxicity.fit([[0, 1]] * 8 + [[2]] * 8, np.array([1.0] * 8 + [0.0] * 8), [(i, [3, 1]) for i in range(8)], 4)
    assert free[0][0] > 0.5 and abs(bound[0][0] - bound[0][3]) < 0.3 * free[0][0]
    assert {r["doc_id"] for r in toxicity.reject(docs, lab).collect()} == {i for i, x in out.items() if not x["predicted"]}
    assert toxicity.train(docs, lab.limit(0))[2] == -20.0


def test_toxicity_of_a_small_table(spark):
    r = random.Random(9)
    plain = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(64):
        # 9 toxic rows, 5 of them with one insult and 4 with another
        insult = ["vile", "scum"][i % 2] if i < 9 else None
        rows.append((4 * i, " ".join([*(r.choice(plain) for _ in range(30)), *([insult] if insult else [])]), None))
        labels.append((4 * i, int(i < 9)))
    labels = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    learned = {i for i, t in labels if t}
    assert 5 <= len(learned) <= 9
    docs, lab = make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {x["doc_id"] for x in toxicity.score(docs, toxicity.train(docs, lab)).filter("predicted = 1").collect()}
    assert found and found <= {4 * i for i in range(9)}
    assert {x["doc_id"] for x in toxicity.reject(docs, lab).collect()} == {i for i, _, _ in rows} - found


def test_features_that_stand_out():
    assert toxicity.stand_out([4.7] * 24, 3694) == 24 and toxicity.stand_out([], 0) == 0
    z = np.sort(np.random.default_rng(1).normal(size=100_000))[::-1]
    assert toxicity.stand_out(z[:4096].tolist(), len(z)) <= 1


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, rows, docs, keep):
    groups = defaultdict(list)
    for i, x, _ in rows:
        groups[x or ""].append(i)
    pick = min if keep == "min" else max
    out = exact_dedup.content_sort(docs, keep=keep).collect()
    want = Counter()
    for x, ids in groups.items():
        best = pick(real) if (real := [i for i in ids if i is not None]) else None
        for i in ids:
            want[i, best, len(ids), hashlib.sha256(x.encode()).hexdigest()] += 1
    assert Counter((r[0], r[1], r[2], r[4]) for r in out) == want
    kept = Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert sorted(map(key, ((r["doc_id"], r["text"] or "") for r in exact_dedup.deduplicate(docs, keep=keep).collect()))) == sorted(key((pick([i for i in v if i is not None], default=None), x)) for x, v in groups.items())
    assert exact_dedup.content_sort(docs, exact_dedup.collapse).filter("text_sha256 = sha2('one', 256)").count() == 2


@pytest.mark.parametrize("run", [
    lambda d: quality.quality(d, d), packing.pack, lm_scoring.score, secrets.scan, mixing.mix, mixing.sample, minhash.near_duplicates,
    lambda d: toxicity.score(d, toxicity.train(d, d.withColumn("toxic", F.lit(1)))), exact_dedup.content_sort, exact_dedup.deduplicate,
])
def test_empty(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_empty_files(docs, tmp_path):
    root = f"file://{tmp_path}/none"
    assert token_files.read_back(token_files.write(docs.limit(0), root), root).count() == 0


def test_batches_for_workers_are_bounded(spark):
    from tessera.llm import _common

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    try:
        cases = {("10000", "64m"): ("2000", str(4 << 20)), ("0", "1gb"): ("2000", str(4 << 20)), ("-1", "2KB"): ("2000", "2KB"), ("500", "1000000"): ("500", "1000000")}
        for given, wanted in cases.items():
            for k, v in zip(keys, given, strict=True):
                spark.conf.set(k, v)
            _common.small_batches(spark)
            assert tuple(spark.conf.get(k) for k in keys) == wanted
        long = make(spark, [(i, "x" * 1_000_000, "s") for i in range(20)]).coalesce(1)
        _common.small_batches(spark)
        spark.conf.set(keys[1], str(4 << 20))

        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        sizes = [r["n"] for r in long.mapInArrow(count, "n long").collect()]
        assert sum(sizes) == 20 and max(sizes) <= 5
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
