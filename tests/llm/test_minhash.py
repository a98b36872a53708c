import random
import re
from collections import Counter

import numpy as np
from lattica.llm.minhash import near_duplicates, signatures


def brute(rows):
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    e, w = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(1, 5, 900).astype(float)
    for cut in (50, 300):
        sig = signatures(np.concatenate([e[: 900 - cut], e[cut:]]), np.concatenate([w[: 900 - cut], w[cut:]]), np.repeat([0, 1], 900 - cut), 2, 4096)
        true = w[cut : 900 - cut].sum() / w.sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_brute_force(spark, docs):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else ", ".join(w)))
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, sig string, rep int")
    expected = brute(list(dict(rows).items()))
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == expected and all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_crowded_bucket_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("lattica.llm.minhash.CHUNK", 4)
    rng = random.Random(4)
    base = [f"w{rng.randrange(1000)}" for _ in range(120)]
    rows = []
    for i in range(30):
        w = list(base)
        for j in range(0, 120, 24 if i % 3 else 60):
            w[(j + 7 * i) % 120] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(spark, none):
    assert near_duplicates(none).collect() == []
    rows = near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (4, None)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and all(r.kept for r in rows)


def test_texts_that_share_an_id(spark):
    rows = []
    for i in range(0, 40, 2):
        one, two = ([f"{k}{i}_{j}" for j in range(100)] for k in "ab")
        rows += [(i, " ".join(one)), (i, " ".join(two)), (i + 1, " ".join([*(one if i % 4 else two)[:98], "x", "y"]))]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(40)}
