import hashlib
import random
from collections import Counter

from lattica.llm import suffix_dedup
from lattica.llm.suffix_dedup import remove_repeats


def brute(texts, k):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - k + 1):
            seen[b[i : i + k]] = seen.get(b[i : i + k], 0) + 1
    out = []
    for b in raw:
        cover = [False] * len(b)
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                cover[i : i + k] = [True] * k
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return out


def check(spark, texts, k, gram):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(df, threshold=k, gram=gram).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, k)


def test_brute_force(spark):
    rng = random.Random(1)
    part = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [part(60) for _ in range(4)]
    texts = [part(rng.randrange(80)) + rng.choice(shared)[rng.randrange(10) :] + part(rng.randrange(80)) for _ in range(40)]
    texts += [None, "", "ab" * 100, "x" * 90, "x" * 39, texts[0], texts[0]]
    check(spark, texts, 40, 12)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(2000))
    for function in (suffix_dedup._pieces,):
        pieces = list(function(__import__("numpy").array([0, 100, 2100, 2110]), 40))
        assert pieces[0] == (0, 100) and pieces[-1][1] == 2110
    check(spark, [long, long[300:900], "q" + long[1000:1100]], 40, 12)


def test_same_id_and_null_id(spark):
    df = spark.createDataFrame([(1, "y" * 50), (1, "z" * 10), (None, "y" * 50), (None, "w")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(df, threshold=40, gram=10).collect())
    assert rows == [(0, 1, 0), (0, 50, 50), (1, 10, 0), (1, 50, 50)]


def test_many_repeats_of_one_row_and_many_null_ids(spark):
    one, rng = "".join(random.Random(3).choice("abcdef") for _ in range(300)), random.Random(4)
    own = ["".join(rng.choice("ghijkl") for _ in range(60)) for _ in range(2000)]
    rows = [(7, one)] * 5000 + [(None, t) for t in own] + [(None, own[5] + "!")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold=40, gram=10)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()) == Counter({(7, 300, 300, 1): 5000, (None, 60, 0, 0): 1999, (None, 60, 60, 1): 1, (None, 61, 60, 1): 1})


def test_empty(docs, none):
    assert remove_repeats(none).collect() == [] and len(remove_repeats(docs).collect()) == docs.count()
