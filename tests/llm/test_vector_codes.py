import hashlib
import math
import random

import numpy as np
import pytest

from lattica.llm import queries
from lattica.llm.vector_codes import ENTRIES, PARTS, books_digest, compress, cuts, decoded, nearest, tree


def brute(rows):
    """{position in rows: (code, error)} and codebooks by size, in plain integers."""
    kept = [(i, vec_id, [math.floor(1024 * x) for x in v]) for i, (vec_id, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, all_books = {}, {}
    for size in sorted({len(v) for _, _, v in kept}):
        own = [x for x in kept if len(x[2]) == size]
        first = [v for _, vec_id, v in sorted(own, key=lambda x: (x[1] is None, x[1] or 0, x[2]))][:ENTRIES]
        books = [[v[a:b] for v in first] for a, b in cuts(size)]

        def close(part, x, books=books):
            return min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(books[part]))

        for _ in range(4):
            found = [[close(p, v[a:b])[1] for p, (a, b) in enumerate(cuts(size))] for _, _, v in own]
            for p, (a, b) in enumerate(cuts(size)):
                for k in range(len(books[p])):
                    mine = [v[a:b] for (_, _, v), f in zip(own, found, strict=True) if f[p] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, _, v in own:
            got = [close(p, v[a:b]) for p, (a, b) in enumerate(cuts(size))]
            out[i] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got))
        all_books[size] = books
    return out, all_books


def vectors(many, size, seed):
    r = random.Random(seed)
    return [[r.choice((-1, 1)) * r.random() * r.choice((0.001, 1)) for _ in range(size)] for _ in range(many)]


@pytest.mark.parametrize("span", [2, 5, 1 << 28])
def test_tree_finds_the_lowest_of_the_nearest(span):
    rng = np.random.default_rng(span)
    points, rows = rng.integers(-span, span, (200, 3)), rng.integers(-span, span, (5000, 3))
    index, best = nearest(tree(points), rows)
    d = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_tree_of_equal_points_and_of_none():
    points = np.ones((40, 4), np.int64)
    assert (nearest(tree(points), points)[0] == 0).all()
    index, best = nearest(tree(np.zeros((3, 0), np.int64)), np.zeros((5, 0), np.int64))
    assert index.tolist() == [0] * 5 and best.tolist() == [0] * 5


def test_by_brute_force(spark):
    rows = [(i, v) for i, v in enumerate(vectors(330, 8, 1))] + [(1000 + i, v) for i, v in enumerate(vectors(9, 6, 2))]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[3][1]), (2000, []), (2001, [0.5]), (2002, None), (2003, [1.0, None]), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (2006, [-0.0] * 8)]
    df = spark.createDataFrame([(v, i, n, "x") for n, (i, v) in enumerate(rows)], "embedding array<double>, vec_id long, size int, code string").repartition(5)
    made = compress(df, keep=("size",))
    want, books = brute(rows)
    assert {r[1]: (r[3], r[4]) for r in made.rows.collect()} == want  # size is the caller's and the operator's
    assert sorted(made.books) == sorted(books)
    for size, own in books.items():
        text = ",".join(str(x) for book in own for e in book for x in e)
        assert books_digest(made.books[size]) == hashlib.sha256(text.encode()).hexdigest()
        assert len(own) == PARTS
    code = want[0][0]
    assert np.abs(decoded(code, made.books[8]) - rows[0][1]).max() < 1


def test_large_components_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300, 3e38, 0.0]), (2, [131073.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.error for r in compress(df).rows.collect()} == {0}
    assert compress(df.limit(0)).rows.count() == 0
    assert compress(df.withColumn("embedding", (df.vec_id * 0).cast("double")).select("vec_id").selectExpr("vec_id", "cast(null as array<float>) embedding")).rows.count() == 0


def test_query(spark, tmp_path):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(300, 16, 3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    want, books = brute([(i, held[i]) for i in sorted(held)])
    got = queries.op12_vector_codes(spark, str(tmp_path)).collect()
    text = hashlib.sha256(",".join(str(x) for book in books[16] for e in book for x in e).encode()).hexdigest()
    by_label: dict = {}
    for i, _, label in rows:
        by_label[label] = by_label.get(label, 0) + want[i][1]
    assert {tuple(r) for r in got} == {(i, *want[i], by_label[label], text) for i, _, label in rows}
