import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import lm_scoring, queries, recurrent
from lattica.llm.recurrent import CLASSES, HIDDEN, MEMBERS, Trainer, scores, start


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(train, texts):
    """(n_tokens, n_known, base_score) of each text, and the number of training tokens."""
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    own = [[*words(t), None] for t in texts]
    return [(len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w in own], n


def brute_score(model, counts, text):
    """log10 probability of a text, token by token, in double precision."""
    p = {k: v.astype(float) for k, v in model.params.items()}
    symbol, share = model.symbols()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    h, before, total = np.zeros(HIDDEN), 0, 0.0
    for word in [*words(text), ""]:
        place = model.words.index(word.encode()) if word.encode() in model.words else len(model.words)
        x, g = p["x"][:, before], p["u"] @ h
        z, r = sigmoid(x[:HIDDEN] + g[:HIDDEN]), sigmoid(x[HIDDEN : 2 * HIDDEN] + g[HIDDEN : 2 * HIDDEN])
        h = (1 - z) * np.tanh(x[2 * HIDDEN :] + r * g[2 * HIDDEN :]) + z * h
        before = int(symbol[place])
        kind = before // MEMBERS if before < CLASSES * MEMBERS else before - CLASSES * MEMBERS + CLASSES
        total += log_softmax(p["a"] @ h + p["a0"][:, 0])[kind] / math.log(10)
        if kind < CLASSES:
            total += log_softmax(p["b"][kind] @ h + p["b0"][kind][:, 0])[before % MEMBERS] / math.log(10)
        elif place < len(model.words):
            total += share[place]
        else:
            total += math.log10((counts.get(word, 0) + 1) / max(model.rest, 1))
    return total


def weights(seed=3):
    rng = np.random.default_rng(seed)
    p = start(rng.random(CLASSES + 3) + 0.1, rng.random((CLASSES, MEMBERS)) + 0.1)
    return {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in p.items()}


def test_way_back_by_differences(monkeypatch):
    monkeypatch.setattr(recurrent, "HIDDEN", HIDDEN)
    p, rng, found = weights(), np.random.default_rng(0), {}
    texts = [np.append(rng.integers(1, CLASSES * MEMBERS + 3, k), 0) for k in (5, 9, 14)]
    t = Trainer(p, {})
    monkeypatch.setattr(t, "_move", lambda k, g, at=slice(None): found.setdefault(k, []).append((at, g)))
    t.learn(texts, width=3)
    n = 3 * recurrent.WINDOW
    for k, at in [("u", (4, 2)), ("u", (HIDDEN + 1, 0)), ("u", (2 * HIDDEN + 3, 5)), ("a", (2, 3)), ("a0", (1, 0)), ("x", (3, int(texts[0][0]))), ("x", (2 * HIDDEN + 2, 0))]:
        full = np.zeros(p[k].shape)
        for where, g in found[k]:
            full[where] += g
        loss = []
        for step in (1e-2, -1e-2):
            q = {name: v.copy() for name, v in p.items()}
            q[k][at] += step
            loss.append(-scores(q, texts).sum() / n)
        assert full[at] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-4, rel=3e-2), (k, at)


def test_shares_add_up_and_lanes_do_not_matter():
    p, rng = weights(), np.random.default_rng(1)
    every = [np.array([w, 0]) for w in range(CLASSES * MEMBERS + 3)]
    first = scores(p, every, 64) - scores(p, [np.array([w, 0]) for w in range(0)] or every, 7)
    assert np.abs(first).max() < 1e-4
    states = np.zeros((HIDDEN, len(every)), np.float32)
    assert np.exp(recurrent.log_shares(p, states, np.arange(len(every)))).sum() == pytest.approx(1, abs=1e-4)
    texts = [np.append(rng.integers(1, CLASSES * MEMBERS, int(k)), 0) for k in rng.integers(0, 300, 40)]
    alone = np.concatenate([scores(p, [t]) for t in texts])
    assert np.allclose(scores(p, texts, 5), alone, rtol=1e-4)


TEXTS = ["One two\tthree", "one  TWO three four", None, "", "  \n ", "ÄRGER ärger", "x" * 5000, "one two three " * 700, *[f"one two w{i} three v{i % 7}" for i in range(60)]]


@pytest.mark.parametrize("head", [3, 700, 200_000])
def test_by_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    train = [t for t in TEXTS if t is None or not t.startswith("one two w1")]
    train += [f"n{i} " * (i % 5 + 1) for i in range(900)] if head == 700 else []  # more words than the network has
    docs = spark.createDataFrame([(i, t, "a", 1.0) for i, t in enumerate(TEXTS)], "doc_id int, text string, row string, score double").repartition(3)
    model = lm_scoring.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    assert len(model.words) <= head + 1
    got = {r.doc_id: r for r in lm_scoring.score(docs, model).collect()}
    want, n = brute_base(train, TEXTS)
    counts = Counter(w for t in train for w in words(t))
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].row) == (*want[i][:2], n, "a")
        assert got[i].base_score == pytest.approx(want[i][2], rel=1e-9)
        assert got[i].score == pytest.approx(brute_score(model, counts, t), rel=1e-3)


def test_untaught_network_is_the_base(spark):
    model = lm_scoring.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    model.params = {k: v * (k in ("a0", "b0")) for k, v in model.first().items()}
    for r in lm_scoring.score(spark.createDataFrame([(t,) for t in [*TEXTS, "never seen"]], "text string"), model).collect():
        assert r.score == pytest.approx(r.base_score, rel=1e-4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    model = lm_scoring.fit(docs.limit(0))
    assert model.tokens == 0 and lm_scoring.score(docs, model).first().n_known == 0
    assert lm_scoring.score(docs.limit(0), lm_scoring.fit(docs)).count() == 0


def test_query_learns_what_follows_what(spark, tmp_path):
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("north", "south"), ("red", "green")]
    rows = [(i, " ".join(w for k in range(60) for w in pairs[(i + k * (1 + i % 3)) % 4])) for i in range(1, 700)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_lm_score(spark, str(tmp_path)).collect()}
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    assert {i for i, r in got.items() if r.held_out} == held and len(got) == len(rows)
    want, n = brute_base([t for i, t in rows if i not in held], [t for _, t in rows])
    for (i, _), (tokens, known, base) in zip(rows, want, strict=True):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, n) and got[i].base_score == pytest.approx(base, rel=1e-9)
    assert sum(got[i].score for i in held) > 0.9 * sum(got[i].base_score for i in held)
    assert all(got[i].score > got[i].base_score for i in held)
