import math

import numpy as np
import pytest
from lattica.functions import vectors as V
from lattica.operators import cluster, communities, curves, linalg, tensor
from lattica.operators import graph as G
from lattica.operators import matrix as M
from lattica.operators import quality as Q
from lattica.operators import spatial as S
from lattica.plans.staging import staged
from pyspark.sql import functions as F

PATH = [(0, 1), (1, 2), (2, 3)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_normalisers(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [0, 0, 0]), (3, [5, 5, 5])], "row int, v array<int>")
    rows = df.select(V.sum_normalize("v").alias("s"), V.length_normalize("v").alias("n"), V.minmax_normalize("v").alias("m"), V.minmax_normalize("v", constant="zero").alias("z")).collect()
    assert rows[0].s == pytest.approx([1 / 6, 2 / 6, 3 / 6]) and rows[2].s == [0, 0, 0]
    assert [sum(x * x for x in r.n) for r in rows] == pytest.approx([1, 1, 0, 1])
    assert rows[1].m == [0, 0.5, 1] and rows[2].m == [0, 0, 0] and all(map(math.isnan, rows[3].m)) and rows[3].z == [0, 0, 0]


def test_metrics_of_a_path(spark):
    e = edges(spark, PATH)
    far = G.reached(e)
    assert {tuple(r) for r in G.distances(e).groupBy("a", "d").count().collect()} == {tuple(r) for r in far.collect()}
    assert G.path_length(far).first()[0] == pytest.approx(10 / 6)
    assert G.global_efficiency(far, 4).first()[0] == pytest.approx(13 / 18)
    assert tuple(G.diameter_radius(far).first()) == (3, 2)
    assert G.density(e, 4).first().density == 0.5 and G.transitivity(e).first()[0] == 0.0
    assert G.average_clustering(edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3)]), 4).first()[0] == pytest.approx((1 + 1 + 1 / 3) / 4)
    assert {r.node for r in G.largest_component(edges(spark, [*PATH, (9, 8)])).collect()} == {0, 1, 2, 3}


def test_regions_and_mesh(spark):
    faces = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "v0 long, v1 long, v2 long")
    mesh = G.mesh_edges(faces)
    assert {tuple(sorted(r)) for r in mesh.collect()} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "unit long, label int")
    assert {tuple(r) for r in G.region_adjacency(mesh, labels).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, v array<double>")
    whole = {tuple(r)[:2] for r in G.nearest_rows(df, 4).collect()}
    assert whole == {tuple(r)[:2] for r in G.nearest_rows(df, 4, block=7).collect()}
    sim = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    np.fill_diagonal(sim, -2)
    assert whole == {(i, int(j)) for i in range(50) for j in np.argsort(-sim[i])[:4]}
    assert {r.w for r in G.knn_graph(df, 4).collect()} <= {0.5, 1.0}


def test_knn_tiles_stay_few(spark):
    """Tiles follow the cores, not the rows; copies, a zero row, a row that is not finite and wide values give the same as brute force."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 6)), 3, axis=0) * rng.choice([1.0, 2.0, 1e30], size=(120, 1))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 6)], "row long, v array<double>")
    found = G.nearest_rows(df, 5, block=1)
    assert found.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    size = np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))
    far = np.round(1 - (x / size[:, None]) @ (x / size[:, None]).T, 12)
    np.fill_diagonal(far, np.inf)
    got = {}
    for r in found.collect():
        got.setdefault(r.i, []).append((r.d, r.j))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: np.argsort(far[i], kind="stable")[:5].tolist() for i in range(120)}


def test_knn_searches_once(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)))], "row long, v array<double>")
    arcs = G.nearest_rows(df, 3).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    assert G.symmetric_half(arcs)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert "MapInArrow" not in G.density(G.knn_graph(df, 3), 30)._jdf.queryExecution().optimizedPlan().toString()


def test_reached_passes_no_edges_to_the_driver(spark, monkeypatch):
    """Many words of searches, a hub, a chain and a second component, against rounds of joins; the graph is not collected."""
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 1300, size=(1500, 2))] + [(0, i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(12)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = {}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for a in near:
        seen, front, d = {a}, {a}, 0
        while front:
            front, d = {y for x in front for y in near[x]} - seen, d + 1
            seen |= front
            if front:
                want[a, d] = len(front)
    monkeypatch.setattr(type(e), "toArrow", None)
    assert {(r.a, r.d): r.n for r in G.reached(e).collect()} == want


def test_communities(spark):
    two = edges(spark, [(a, b) for k in (0, 10) for a in range(k, k + 5) for b in range(k, a)] + [(0, 10)])
    for found in (communities.louvain(two), communities.spectral_split(two)):
        groups = {}
        for r in found.collect():
            groups.setdefault(r.label, set()).add(r.unit)
        assert sorted(map(sorted, groups.values())) == [list(range(5)), list(range(10, 15))]
        assert G.modularity(two, found).first().q > 0.4


def test_spatial(spark):
    rng = np.random.default_rng(2)
    p, s = rng.uniform(-20, 20, (60, 3)), rng.uniform(-5, 60, (80, 3))
    points = spark.createDataFrame([(0, i % 7, i, *x) for i, x in enumerate(p.tolist())], "cluster int, curve int, pos int, x double, y double, z double")
    sites = spark.createDataFrame([(i, i % 3, *x) for i, x in enumerate(s.tolist())], "vertex long, atlas int, x double, y double, z double")
    d2 = ((p[:, None] - s[None]) ** 2).sum(axis=2)
    got = {r.pos: r.vertex for r in S.nearest(points, sites, 1.0, ["pos"], "vertex").collect()}
    assert got == {i: int(d2[i].argmin()) for i in range(60)}
    assert {(r.pos, r.vertex) for r in S.within(points, sites, 6.0, ["pos"], ["vertex"]).collect()} == {(int(i), int(j)) for i, j in np.argwhere(d2 <= 36)}
    one = points.where("pos = 0").select("cluster", "curve", "pos", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    near = spark.createDataFrame([("A", 1.0), ("A", -1.0), ("B", 2.0), ("C", 2.1)], "atlas string, x double").selectExpr("*", "0D y", "0D z")
    assert {r.atlas: r.n for r in S.presence(one, near, 2.0).collect()} == {"A": 1, "B": 1}


def test_cosine_series(spark):
    rows = [(1, i, float(i), 0.0, 0.0) for i in range(5)] + [(2, 0, 1.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "curve long, pos int, x double, y double, z double")
    beta = {r.curve: r.beta for r in curves.cosine_series(points, 3).collect()}
    assert [b[0] for b in beta[1]] == pytest.approx([1.41421356, -1.20710678, 0, -0.20710678]) and beta[2] is None
    d = {r.sign: r.d for r in curves.descriptor(points, both_ways=True).where("curve = 1").collect()}
    assert d[1][6:] == [4, 0, 0] and d[-1][6:] == [-4, 0, 0] and len(d[1]) == 9
    cells = {(r.i, r.j): r.a for r in curves.normal_equations(points, 3).where("curve = 1").collect()}
    a = np.array([[cells[i, j] for j in range(4)] for i in range(4)])
    assert np.linalg.solve(a, [cells[i, -1] for i in range(4)]) == pytest.approx([b[0] for b in beta[1]])


@pytest.mark.parametrize("k", [0, 1, 3, 6])
def test_cosine_series_of_few_places(spark, k):
    rng = np.random.default_rng(21)
    own = {i: rng.normal(size=(n, 3)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 30, 200])}
    own |= {50: np.array([[0, 0, 0], [0, 0, 0], [1, 1, 0], [1, 1, 0.0]]), 51: np.ones((4, 3)), 52: np.repeat(rng.normal(size=(5, 3)), 3, axis=0)}
    rows = [(c, i, *map(float, p)) for c, x in own.items() for i, p in enumerate(x)]
    points = spark.createDataFrame([*rows, (6, 99, None, 1.0, 1.0), (6, None, 1.0, 1.0, 1.0)], "curve long, pos int, x double, y double, z double").repartition(3)
    got = {r.curve: r.beta for r in curves.cosine_series(points, k).collect()}
    assert sorted(got) == sorted(own)
    for c, p in own.items():
        step = np.linalg.norm(np.diff(p, axis=0), axis=1)
        if not step.sum() > 0:
            assert got[c] is None
            continue
        t = np.concatenate(([0], np.cumsum(step) / step.sum()))
        t, y = np.concatenate((-t[:0:-1], t)), np.concatenate((p[:0:-1], p))
        assert np.allclose(got[c], np.linalg.pinv(np.sqrt(2) * np.cos(np.pi * t[:, None] * np.arange(k + 1))) @ y, atol=1e-9)  # least norm where there are many


def test_cosine_series_of_places_that_nearly_coincide(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1e-9, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0), (1, 3, 1.0 + 1e-9, 0.0, 0.0), (1, 4, 2.0, 0.0, 0.0)]
    beta = np.array(curves.cosine_series(spark.createDataFrame(rows, "curve long, pos int, x double, y double, z double"), 3).first().beta)
    at = lambda t: np.sqrt(2) * np.cos(np.pi * t * np.arange(4)) @ beta[:, 0]
    assert [at(0), at(0.5), at(1)] == pytest.approx([0, 1, 2], abs=1e-6)


def test_clusters(spark):
    rows = [(1.0, 2.0), (1.5, 1.8), (5.0, 8.0), (8.0, 8.0), (1.0, 0.6), (9.0, 11.0), (8.0, 2.0), (10.0, 2.0), (9.0, 3.0), (0.0, 0.0)]
    df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(rows)], "row long, v array<double>")
    got = {r.row: r.label for r in cluster.cosine_kmeans(df, 3, seed=1).collect()}
    assert got[9] == -1 and set(got.values()) - {-1} <= {0, 1, 2} and len(got) == 10
    assert {r.label for r in cluster.kmeans(df.where("row < 9"), 3, seed=1).collect()} == {1, 2, 3}


def test_quality(spark):
    rng = np.random.default_rng(3)
    x, lab = rng.normal(size=(40, 6)), rng.integers(1, 5, 40)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(lab, x, strict=True))], "unit long, label int, v array<double>")
    n = x / np.linalg.norm(x, axis=1)[:, None]
    for r in Q.homogeneity(df).collect():
        own = n[lab == r.label]
        sim = own @ own.T
        assert r.homogeneity == pytest.approx((sim.sum() - np.trace(sim)) / (len(own) * (len(own) - 1)))
    assert Q.metrics(df).count() == 1


def test_dense(spark):
    rng = np.random.default_rng(4)
    a = {}
    for v in range(2):
        b = rng.random((8, 8))
        a[v] = (b + b.T) / 2
    smooth, losses = tensor.low_rank(spark.createDataFrame([(v, i, r.tolist()) for v, m in a.items() for i, r in enumerate(m)], "view int, row long, v array<double>"), 2, 1.0, 1.0, iterations=3)
    p = np.zeros((8, 8))
    for r in tensor.entries(smooth).where("view = 0").collect():
        p[r.row, r.col] = r.x
    assert np.allclose(p, p.T) and np.allclose(np.diag(p), 1) and len(losses) <= 3
    x = rng.random((30, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, v array<double>")
    w, h, loss = linalg.nmf(df, 3, iterations=8)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(loss, loss[1:], strict=False)) and (h >= 0).all() and all(min(r.w) >= 0 for r in w.collect())
    scores = np.array([r.v for r in linalg.pca(df, 2).orderBy("row").collect()])
    c = x - x.mean(axis=0)
    assert scores.var(axis=0) == pytest.approx(np.linalg.svd(c)[1][:2] ** 2 / 30)


def test_low_rank_of_least_objective(spark):
    """On these counts the published iteration ends above its first objective."""
    rng = np.random.default_rng(4)
    views = []
    for width in (9, 6):
        m = rng.poisson(60.0, (14, width)).astype(float)
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        views.append(m @ m.T)
    rows = spark.createDataFrame([(v, i, r.tolist()) for v, m in enumerate(views) for i, r in enumerate(m)], "view int, row long, v array<double>")
    plain, losses = tensor.low_rank_rounds(views, 5, 100.0, 1000.0)
    assert losses[-1] > losses[0] * (1 + 1e-6)
    for small in (0, tensor.SMALL):
        made, falling = tensor.low_rank(rows, 5, 100.0, 1000.0, small=small, least=True)
        assert falling == pytest.approx([min(losses)]) and falling[-1] <= falling[0]
        assert made.count() == 28


def test_sparse(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, (5, 4)), rng.integers(0, 3, (4, 6))
    coo = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "row int, col int, x double")
    got = np.zeros((5, 6))
    for r in M.matmul(coo(a), coo(b)).collect():
        got[r.row, r.col] = r.x
    assert (got == a @ b).all()
    g = np.zeros((4, 4))
    for r in M.gram(coo(a)).collect():
        g[r.row, r.col] = r.x
    assert (g == a.T @ a).all()


def test_queries_run_until_they_settle(spark, monkeypatch):
    from lattica.plans import catalogue

    d = "/root/testdata/sf0.1"
    found = staged(catalogue.QUERIES["cosine_kmeans"](spark, d))
    vectors = catalogue._vectors(spark, d, False)
    again = cluster.cosine_step(vectors, cluster.means(vectors, found))
    assert again.join(found.withColumnRenamed("label", "was"), "row").where("label <> was").count() == 0
    losses, run = [], linalg.nmf
    monkeypatch.setattr(linalg, "nmf", lambda *a, **k: (out := run(*a, **k), losses.extend(out[2]))[0])
    catalogue.QUERIES["nmf"](spark, "/root/testdata/sf0.01")
    assert len(losses) > 50 and 0 <= losses[-2] - losses[-1] < 1e-6 * losses[0]


def test_sweep_has_all_three_metrics(spark):
    rng = np.random.default_rng(6)
    rows = [(i, p, s, int(k), (rng.normal(size=5) + k).tolist()) for i, (p, s, k) in enumerate((p, s, k) for p in (0, 1) for s in (0, 1) for k in (0, 1, 2, 3) for _ in range(8))]
    df = spark.createDataFrame(rows, "unit long, point int, subject int, label int, v array<double>")

    def brute(x, lab):
        ids = np.unique(lab)
        c = np.array([x[lab == i].mean(axis=0) for i in ids])
        s = np.array([np.linalg.norm(x[lab == i] - c[k], axis=1).mean() for k, i in enumerate(ids)])
        dbi = np.mean([max((s[a] + s[b]) / np.linalg.norm(c[a] - c[b]) for b in range(len(ids)) if a != b) for a in range(len(ids))])
        within = sum(((x[lab == i] - c[k]) ** 2).sum() for k, i in enumerate(ids))
        between = sum((lab == i).sum() * ((c[k] - x.mean(axis=0)) ** 2).sum() for k, i in enumerate(ids))
        n = x / np.linalg.norm(x, axis=1)[:, None]
        h = [((n[lab == i].sum(axis=0) ** 2).sum() - (lab == i).sum()) / ((lab == i).sum() * ((lab == i).sum() - 1)) for i in ids if i]
        return dbi, between * (len(x) - len(ids)) / (within * (len(ids) - 1)), np.mean(h)

    of = lambda p, s: brute(*(np.array([r[c] for r in rows if r[1] == p and r[2] in s]) for c in (4, 3)))
    assert {r.point: (r.dbi, r.chi, r.homogeneity) for r in Q.sweep(df, ["point"]).collect()} == {p: pytest.approx(of(p, (0, 1))) for p in (0, 1)}
    assert {r.point: (r.dbi, r.chi, r.homogeneity) for r in Q.sweep(df, ["point"], ["subject"]).collect()} == {p: pytest.approx(np.mean([of(p, (0,)), of(p, (1,))], axis=0)) for p in (0, 1)}
    one = df.where("point = 0 and subject = 0")
    assert tuple(Q.metrics(one).first()) == pytest.approx(of(0, (0,)))


def test_distances_of_odd_graphs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 90, (110, 2))] + [(200, 201), (300, 300)]
    e = edges(spark, pairs)
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for a in near:
        seen, front, d = {a}, {a}, 0
        while front:
            front = set().union(*(near[x] for x in front)) - seen
            seen, d = seen | front, d + 1
            if front:
                want[a, d] = len(front)
    assert {(r.a, r.d): r.n for r in G.reached(e).collect()} == want
    monkeypatch.setattr(G, "EDGES", 0)
    assert {(r.a, r.d): r.n for r in G.reached(e).collect()} == want
    none = edges(spark, [(1, 1)])
    assert G.reached(none).collect() == [] and G.distances(none).collect() == []
    assert G.density(none, 1).first().density == 0 and G.global_efficiency(G.reached(none), 1).first()[0] == 0


def test_small_worldness_takes_transitivity(spark):
    e = edges(spark, [(i, (i + j) % 12) for i in range(12) for j in (1, 2)])
    other = G.random_graph(12, 24, spark, 5)
    ratio = lambda g: G.transitivity(g).first()[0] / G.path_length(G.reached(g)).first()[0]
    assert G.transitivity(e).first()[0] == pytest.approx(0.5) and G.path_length(G.reached(e)).first()[0] == pytest.approx((4 + 4 * 2 + 3 * 3) / 11)
    assert G.small_worldness(e, 12, seed=5).first().sigma == pytest.approx(ratio(e) / ratio(other))


def test_bundle(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (7, 8)])
    got = {r.name: r.value for r in G.bundle(e, 8, seed=1).collect()}
    assert got["vertices"] == 8 and got["edges"] == 5 and got["density"] == pytest.approx(10 / 56) and got["transitivity"] == pytest.approx(0.6)
    assert got["lcc_path_length"] == pytest.approx(16 / 12) and got["path_length"] == pytest.approx(18 / 14) and got["diameter"] == 2 and got["radius"] == 1
    assert got["lcc_efficiency"] == pytest.approx(10 / 12) and got["global_efficiency"] == pytest.approx(12 / 56) and got["community_q"] > 0.2 and got["modularity_q"] > 0.2
    assert {"avg_clustering", "assortativity", "scale_free_index", "small_worldness"} <= set(got)


def test_bundle_makes_what_is_asked(spark, monkeypatch):
    e = edges(spark, [(i, (i + j) % 12) for i in range(12) for j in (1, 2)])
    times, run = [], G.reached
    monkeypatch.setattr(G, "reached", lambda x: times.append(1) or run(x))
    monkeypatch.setattr(G, "largest_component", None)
    sigma = G.small_worldness(e, 12, seed=5).first().sigma
    assert {r.name: r.value for r in G.bundle(e, 12, seed=5, names=["small_worldness", "edges"]).collect()} == {"small_worldness": sigma, "edges": 24}
    known = {r.name: r.value for r in G.bundle(e, 12, seed=5, names=["small_worldness", "path_length", "transitivity"]).collect()}
    assert known["small_worldness"] == pytest.approx(sigma) and known["transitivity"] == pytest.approx(0.5) and len(known) == 3
    assert len(times) == 6  # two for each: the graph and a random one


def test_scale_free_counts_bare_nodes(spark):
    degrees = np.array([3, 2, 2, 1, 0, 0])
    density = np.exp(-0.5 * (degrees[:, None] - degrees[None]) ** 2).mean(axis=1) / np.sqrt(2 * np.pi)
    y, f = np.log10(np.maximum(degrees, 1)), np.log10(density)
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (0, 3)])
    assert G.scale_free_index(e, 6).first().r2 == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_pairs_of_two_matrices(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 5, 4))
    a[2] = 0
    frame = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "row int, v array<double>")
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
    c = unit(a) @ unit(b).T
    want = (c + c.T) / 2
    np.fill_diagonal(want, 1)
    got = np.zeros((5, 5))
    for r in M.connect_sim(frame(a), frame(b)).collect():
        got[r.i, r.j] = r.sim
    assert np.allclose(got, want)
    far = {(r.i, r.j): r.distance for r in M.cosine_distances(frame(a)).collect()}
    assert far[2, 2] == 0 and far[2, 1] == 1 and far[0, 1] == pytest.approx(1 - (unit(a) @ unit(a).T)[0, 1])
    d2 = {(r.i, r.j): r.d2 for r in M.squared_distances(frame(a)).collect()}
    assert d2[0, 3] == pytest.approx(((a[0] - a[3]) ** 2).sum()) and len(d2) == 25


def test_diffusion_kernel_squares_epsilon(spark):
    pairs = spark.createDataFrame([(0, 0, 0.0), (0, 1, 3.0), (1, 0, 3.0), (1, 1, 0.0)], "i int, j int, d2 double")
    w = np.exp(-np.array([[0, 3.0], [3.0, 0]]) / (2 * 0.5**2))
    got = {(r.i, r.j): r.x for r in linalg.diffusion_kernel(pairs, 0.5).collect()}
    assert got[0, 1] == pytest.approx((w / w.sum(axis=1)[:, None] / w.sum(axis=1)[None])[0, 1])


def test_equal_sites_are_one(spark):
    """60 sites at each place, as on larger tables: points meet places, not sites, and neither join broadcasts the spread rows."""
    rng = np.random.default_rng(12)
    at = rng.integers(0, 4, size=(50, 3)).astype(float)
    sites = spark.createDataFrame([(50 * k + i, i % 5, *x) for k in range(60) for i, x in enumerate(at.tolist())], "vertex long, atlas int, x double, y double, z double")
    p = rng.uniform(-2, 6, size=(300, 3))
    points = spark.createDataFrame([(0, i % 7, i, *x) for i, x in enumerate(p.tolist())], "cluster int, curve int, pos int, x double, y double, z double")
    d2 = ((p[:, None] - at[None]) ** 2).sum(axis=2)
    assert {r.pos: r.vertex for r in S.nearest(points, sites, 1.0, ["pos"], "vertex").collect()} == {i: int(d.argmin()) for i, d in enumerate(d2)}
    present = S.presence(points, sites, 1.0)
    want = {}
    for i, d in enumerate(d2):
        for atlas in {k % 5 for k in np.flatnonzero(d <= 1)}:
            want[i % 7, atlas] = want.get((i % 7, atlas), 0) + 1
    assert {(r.curve, r.atlas): r.n for r in present.collect()} == want
    plan = present._jdf.queryExecution().toString()
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("few", [200_000, 0])
def test_nearest_far_points(spark, monkeypatch, few):
    monkeypatch.setattr(S, "SITES", few)
    rng = np.random.default_rng(11)
    sites = rng.normal(size=(60, 3)).round(1)
    points = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(20, 3)) * 40 + 300])
    frame = lambda m, name: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(m)], f"{name} long, x double, y double, z double")
    got = {r.p: r.s for r in S.nearest(frame(points, "p"), frame(sites, "s"), 0.5, ["p"], "s").collect()}
    assert got == {i: int(((sites - x) ** 2).sum(axis=1).argmin()) for i, x in enumerate(points)}
    assert S.nearest(frame(points, "p"), frame(sites[:0], "s"), 0.5, ["p"], "s").collect() == []
    assert S.nearest(frame(points[:0], "p"), frame(sites, "s"), 0.5, ["p"], "s").collect() == []


def test_complete_subjects(spark):
    present = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 9), ("b", 1), ("b", 9)], "subject string, cluster int")
    assert [r.subject for r in S.complete_subjects(spark.createDataFrame([(1,), (2,), (2,)], "cluster int"), present).collect()] == ["a"]


def test_sweep_counts_missing_labels(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (2, 4, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "unit int, label int, v array<double>").withColumn("k", F.lit(7))
    mean = Q.homogeneity(v).agg(F.avg("homogeneity")).first()[0]
    assert Q.sweep(v, ["k"]).first().homogeneity == pytest.approx(mean) == pytest.approx((math.sqrt(0.5) + 3) / 4)


@pytest.mark.parametrize("held", [1 << 23, 8])
def test_moments_of_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(Q, "HELD", held)
    rng = np.random.default_rng(13)
    x, lab = rng.normal(size=(300, 4)), np.where(rng.random(300) < 0.4, 1, rng.integers(2, 30, 300))  # a hot label
    x[:5] = 0
    rows = [(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(lab, x, strict=True))]
    odd = [(900, 1, None), (901, 1, [1.0, None, 0.0, 0.0]), (902, None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "unit long, label int, v array<double>").repartition(7)
    got = {r.label: r for r in Q.moments(df, ["label"]).collect()}
    assert sorted(got) == sorted(set(lab.tolist()))
    size = np.linalg.norm(x, axis=1)
    for k, r in got.items():
        own = lab == k
        assert (r.n, r.some) == (own.sum(), (size[own] > 0).sum()) and r.q == pytest.approx((x[own] ** 2).sum())
        assert np.allclose(r["sum"], x[own].sum(axis=0)) and np.allclose(r.units, (x[own] / np.where(size > 0, size, 1)[own, None]).sum(axis=0))
    assert Q.moments(df.limit(0), ["label"]).collect() == [] and Q.metrics(df.limit(0)).collect() == []
    named = df.select(F.lit("é").alias("m"), F.when(F.col("unit") % 2 == 0, F.lit("x")).alias("by0"), "v")
    assert {(r.m, r.by0): r.n for r in Q.moments(named, ["m", "by0"]).collect()} == {("é", "x"): 151}


def test_diffusion_coords_without_the_kernel(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(50, 4)) + 2, rng.normal(size=(40, 4)) * 0.5 - 2])
    ids = rng.permutation(1000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None)], "row int, v array<double>")
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 1.5**2))
    d = w.sum(axis=1)
    values, vectors = np.linalg.eigh(w / d[:, None] / d[None])
    values, vectors = values[::-1][1:4], vectors[:, ::-1][:, 1:4]
    want = values * vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(3)])
    got = {r.row: r.v for r in linalg.diffusion_coords(df, 1.5, 3, block=40).collect()}  # several blocks
    assert sorted(got) == sorted(ids.tolist()) and np.abs(np.array([got[int(i)] for i in ids]) - want).max() < 1e-8
    two = [r.v for r in linalg.diffusion_coords(df.where("row < 5000").limit(2), 1.5, 3).collect()]
    assert [len(v) for v in two] == [1, 1] and linalg.diffusion_coords(df.limit(0), 1.5, 3).collect() == []


@pytest.mark.parametrize("every", [linalg.ALL, 0])
def test_diffusion_coords_of_equal_values(spark, monkeypatch, every):
    """As the SQL has them: squares of squares, each over its trace, end in the mean projector where values coincide (here as the kernel underflows), or nearly."""
    monkeypatch.setattr(linalg, "ALL", every)
    far = np.eye(6) * 100.0
    tied = np.concatenate([far[:3], [[500.0, 0, 0, 0, 0, 0], [500.5, 0, 0, 0, 0, 0], [501.5, 0, 0, 0, 0, 0]]])
    nearly = np.eye(6) * 5.6 + np.eye(6)[::-1] * 0.1 * np.arange(6)  # off the diagonal some 1e-7
    for x in (far, tied, far[:1], *([nearly] if every else [])):
        ids = [40 + 7 * i for i in range(len(x))]
        w = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 4)
        a, want = w / w.sum(axis=1)[:, None] / w.sum(axis=0), []
        for _ in range(3):
            m = a
            for _ in range(20):
                m = m @ m / max(np.trace(m @ m), 1e-300)
            value = np.trace(a @ m)
            b = np.round(np.diag(m), 10).argmax()
            want.append(value * m[:, b] / np.sqrt(m[b, b]))
            a = a - value * m
        got = {r.row: r.v for r in linalg.diffusion_coords(spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "row long, v array<double>"), 2**0.5, 2, block=4).collect()}
        want = np.array(want[1 : len(x)]).reshape(-1, len(x)).T
        assert np.abs(np.array([got[i] for i in ids]) - want).max(initial=0) < 1e-6


@pytest.mark.parametrize("n, m", [(0, 3), (1, 1), (2, 5), (9, 36), (9, 30), (9, 7), (300, 2000), (3_000_000_000, 50)])
def test_random_graph(spark, n, m):
    got = [tuple(r) for r in G.random_graph(n, m, spark, 3).collect()]
    assert len(got) == len(set(got)) == min(m, n * (n - 1) // 2) and all(0 <= i < j < n for i, j in got)
    assert sorted(got) == sorted(tuple(r) for r in G.random_graph(n, m, spark, 3).collect())


def test_random_graphs_are_even(spark):
    times = np.zeros((6, 6))
    for seed in range(12):
        for i, j in G.random_graph(6, 5, spark, seed).collect():
            times[i, j] += 1
    assert times.sum() == 60 and times.max() <= 11 and np.count_nonzero(times) >= 12


def test_cosine_kmeans_needs_few_passes_for_many_rounds(spark, monkeypatch):
    from lattica.operators import cluster

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2500, 8)), np.zeros((1, 8))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, v array<double>").repartition(3)
    passes, run = [], cluster._round
    monkeypatch.setattr(cluster, "_round", lambda *a: passes.append(a[0]) or run(*a))
    got = {r.row: r.label for r in cluster.cosine_kmeans(rows, 4, seed=3, near=600).collect()}
    c, own, rounds = passes[0], x[:-1], 0
    while True:
        near = cluster._far(own, cluster._unit(c)).argmin(axis=1)
        new = np.array([own[near == i].mean(axis=0) for i in range(4)])
        rounds, still, c = rounds + 1, np.allclose(new, c), new
        if still:
            break
    near = cluster._far(own, cluster._unit(c)).argmin(axis=1)
    assert got == {**dict(enumerate(near.tolist())), 2500: -1}
    assert len(passes) < rounds / 2


def test_points_at_one_place_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    spots, sites = rng.random((5, 3)) * 3, rng.random((40, 3)) * 3
    asked, pairs = spark.sparkContext.accumulator(0), []
    search, join = S._asked, S.within

    def counted(boxes):
        run = search(boxes)

        def each(batches):
            for batch in run(batches):
                asked.add(len(batch.column("n").flatten()))
                yield batch
        return each

    def joined(points, *rest):
        pairs.append(points.count())
        return join(points, *rest)

    monkeypatch.setattr(S, "_asked", counted)
    monkeypatch.setattr(S, "within", joined)
    points = spark.createDataFrame([(i % 3, i % 7, i, *map(float, spots[i % 5])) for i in range(300)], "cluster int, curve int, pos int, x double, y double, z double")
    d2 = ((spots[:, None] - sites[None]) ** 2).sum(-1)
    own = spark.createDataFrame([(i, "AB"[i % 2], *map(float, s)) for i, s in enumerate(sites)], "vertex int, atlas string, x double, y double, z double")
    assert {r.pos: r.vertex for r in S.nearest(points, own, 1.0, ["pos"], "vertex").collect()} == {i: int(d2[i % 5].argmin()) for i in range(300)}
    assert asked.value == 5  # one cell holds all sites, so the second search asks nothing
    near = {(i, "AB"[j % 2]) for i, j in np.argwhere(d2 <= 0.25)}
    want = {}
    for i in range(300):
        for atlas in "AB":
            if (i % 5, atlas) in near:
                want[i % 3, i % 7, atlas] = want.get((i % 3, i % 7, atlas), 0) + 1
    assert {(r.cluster, r.curve, r.atlas): r.n for r in S.presence(points, own, 0.5).collect()} == want
    assert pairs == [5]
