import random

import pytest
from lattica.operators import labels as L

U = [1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
V = [1, 1, 2, 2, 2, 3, 3, 3, 4, 4]


def a_map(spark, labels):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(labels)], "unit int, label int")


def listed(labels):
    return [r.label for r in labels.orderBy("unit").collect()]


def test_match(spark):
    u, v = a_map(spark, U), a_map(spark, V)
    pairs = L.dice_match(u, v)
    got = {(r.u, r.v): r.dice for r in pairs.collect()}
    assert got == pytest.approx({(1, 1): 0.8, (2, 2): 2 / 3, (3, 3): 2 / 3, (4, 4): 2 / 3})
    assert L.dice_score(pairs).first().result == pytest.approx(0.7)
    assert listed(L.renamed(u, pairs, "u")) == U and listed(L.renamed(v, pairs, "v")) == V


def test_joined_with_exact_halves(spark):
    u, v = a_map(spark, U), a_map(spark, V)
    pairs = L.dice_joined(u, v)
    rows = {(r.u, r.v): r.dice for r in pairs.collect()}
    assert rows == pytest.approx({(3, 3): 8 / 9, (1, 1): 0.8, (2, 2): 2 / 3})
    right = L.merged(v, L.merge_map(L.contingency(u, v), "u", "v"))
    left = L.merged(u, L.merge_map(L.contingency(u, right), "v", "u"))
    assert listed(L.renamed(left, pairs, "u")) == [2, 2, 2, 3, 3, 3, 1, 1, 1, 1]
    assert listed(L.renamed(right, pairs, "v")) == [2, 2, 3, 3, 3, 1, 1, 1, 1, 1]


def test_jaccard_and_background(spark):
    u, v = a_map(spark, U), a_map(spark, V)
    got = {r.u: (r.v, r.jaccard) for r in L.best_jaccard(L.contingency(u, v), u).collect()}
    assert got == {1: (1, pytest.approx(2 / 3)), 2: (2, 0.5), 3: (3, 0.5), 4: (4, 0.5)}
    alone = L.best_jaccard(L.contingency(a_map(spark, [1, 2]), a_map(spark, [1, 0])), a_map(spark, [1, 2])).collect()
    assert {(r.u, r.v, r.jaccard) for r in alone} == {(1, 1, 1.0), (2, -1, 0.0)}


def test_atlas(spark):
    rows = {(r.atlas, r.parcel): r.dice for r in L.dice_atlas_align(a_map(spark, V), a_map(spark, U)).collect()}
    assert rows == pytest.approx({(1, 1): 0.8, (2, 2): 2 / 3, (3, 3): 0.75})


def test_transfer_and_expand(spark):
    m = lambda x: a_map(spark, x)
    assert L.transfer_percent(m([1, 1, 2, 2]), m([1, 1, 2, 2]), m([1, 2, 1, 2]), m([1, 1, 2, 2])).first().share == 0.5
    supers = spark.createDataFrame(list(enumerate([0, 1, 1, 2, 3])), "unit int, super_id int")
    rows = spark.createDataFrame([(0, 7), (1, 8), (2, 7)], "row int, label int")
    assert listed(L.expand_labels(supers, rows)) == [0, 7, 7, 8, 7]


def test_relabel(spark):
    once = L.relabel(a_map(spark, [0, 9, 4, 4, 0, 12]))
    assert listed(once) == [0, 2, 1, 1, 0, 3] == listed(L.relabel(once))
    assert listed(L.relabel(a_map(spark, [0, 0]))) == [0, 0]


def model_match(u, v):
    """Passes in sequence, from the description."""
    cells = {}
    for a, b in zip(u, v, strict=True):
        if a and b:
            cells[a, b] = cells.get((a, b), 0) + 1
    us, vs = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
    best_v = {a: min((b for b in vs if (a, b) in cells), key=lambda b: (-cells[a, b], b)) for a in us}
    best_u = {b: min((a for a in us if (a, b) in cells), key=lambda a: (-cells[a, b], a)) for b in vs}
    out = {a: best_v[a] for a in us if best_u[best_v[a]] == a}
    for b in vs:
        if b not in out.values() and best_u[b] not in out:
            out[best_u[b]] = b
    for a in us:
        if a not in out and best_v[a] not in out.values():
            out[a] = best_v[a]
    return set(out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passes_as_sets(spark, seed):
    rng = random.Random(seed)
    u, v = ([rng.randrange(6) for _ in range(25)] for _ in range(2))
    got = {(r.u, r.v) for r in L.matched_pairs(L.contingency(a_map(spark, u), a_map(spark, v))).collect()}
    assert got == model_match(u, v)
