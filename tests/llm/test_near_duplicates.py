"""Near duplicates against brute force: families of edited copies, repeated and null ids, clashing names."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tests.llm.test_corpus_operators import brute_sets, make


def components(sets, percent=80):
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and 100 * len(s & t) >= percent * len(s | t) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    return group


def family(seed, n, words=90, at_most=0.22):
    """A text and its copies; some are edits of edits, so that chains lead away from the first text."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(500)]
    texts = [[r.choice(vocab) for _ in range(words)]]
    for _ in range(n - 1):
        w = list(r.choice(texts) if r.random() < 0.3 else texts[0])
        for _ in range(r.randint(0, int(at_most * words / 2))):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[r.choice(vocab)], [], [w[at], r.choice(vocab)]])
        texts.append(w)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("percent", [80, 90])
def test_families_lose_no_link(spark, seed, percent):
    texts = [x for k in range(3) for x in family(10 * seed + k, 70)]
    rows = [(1000 - i, x, None) for i, x in enumerate(texts)]
    sets = brute_sets(rows, 2)
    group = components(sets, percent)
    first = defaultdict(lambda: 10**9)
    for (i, _), g in zip(sets, group, strict=True):
        first[g] = min(first[g], i)
    assert 5 < len(first) < 210  # neither all apart nor all in one
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, rows), 2, percent).collect()}
    assert got == {i: first[g] for (i, _), g in zip(sets, group, strict=True)}


def test_kin_links_are_exact(spark):
    """All pairs of one family, from the differences to the leader alone."""
    texts = list(dict.fromkeys(family(99, 120, at_most=0.3)))
    lead, *others = (frozenset(s) for _, s in brute_sets([(0, x, None) for x in texts], 2))
    number = {g: i for i, g in enumerate(sorted(set().union(lead, *others)))}
    rows = [(bytes([i]), b"lead", len(s), len(lead), 9 * len(s ^ lead) <= len(s) + len(lead), [number[g] for g in s ^ lead]) for i, s in enumerate(others) if s != lead]
    met = spark.createDataFrame(rows, "node binary, lead binary, n long, lead_n long, linked boolean, diff array<long>")
    got = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in minhash._kin_links(met, 80).collect()}
    linked = {r[0][0]: r[4] for r in rows}
    want = {(a, b) for a in linked for b in linked if a < b and not (linked[a] and linked[b]) and 100 * len(others[a] & others[b]) >= 80 * len(others[a] | others[b])}
    assert got == want and len(want) >= 5 and not all(linked.values())


def test_deduplicate_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    rows = [(3, text, None), (7, near, None), (7, "quite another text of a few words here", None), (3, text, "b"), (None, text + " more", None), (None, "alone without an id", None), (9, None, None), (9, "", None), (9, " \n", None), (9, None, None), (5, "One two", None), (4, "one TWO", None)]
    docs = make(spark, rows).withColumns({c: F.lit(1) for c in ("_near_h", "_gone", "h_", "node", "key", "c")})
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter({(3, text): 1, (7, rows[2][1]): 1, (None, "alone without an id"): 1, (9, None): 2, (9, ""): 1, (9, " \n"): 1, (4, "one TWO"): 1})
    assert got == want
    assert minhash.deduplicate(docs.limit(0)).count() == 0
