"""The stages as composed plans: feature extraction, consensus clustering, and expansion with evaluation."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import linalg
from lattica.operators import matrix as M
from lattica.operators import quality as Q
from lattica.operators import spatial as S
from lattica.operators import tensor
from lattica.operators.cluster import kmeans
from lattica.plans.staging import staged


def vertex_clusters(curves: DataFrame, vertices: DataFrame, clusters: DataFrame, side: float) -> DataFrame:
    """Stage 1: (cluster, vertex, n) of ``curves (cluster, curve, points)``: both ends' nearest vertices, counted."""
    return S.incidence(S.nearest(S.end_points(curves), vertices, side, ["cluster", "curve", "end"], "vertex"), clusters, ["vertex"])


def cluster_atlas(points: DataFrame, voxels: DataFrame, affines: DataFrame, radius: float = 2.0, threshold: float = 0.5) -> DataFrame:
    """Stage 1: (cluster, atlas, w) of ``points (cluster, curve, pos, x, y, z)`` against atlas voxels above the threshold."""
    kept = S.kept_voxels(voxels, threshold)
    return S.atlas_sums(S.presence(points, S.world(kept, affines), radius), S.atlas_weights(kept))


def vertex_atlas(vc: DataFrame, ct: DataFrame) -> DataFrame:
    """(row, col, x): vertices by atlas, rows of sum 1, from incidence and atlas weights of the same clusters."""
    left = vc.where("vertex is not null").select(F.col("vertex").alias("row"), F.col("cluster").alias("col"), F.col("n").cast("double").alias("x"))
    return M.row_normalized(M.matmul(left, ct.select(F.col("cluster").alias("row"), F.col("atlas").alias("col"), F.col("w").alias("x"))))


def view_graphs(vectors: dict[int, DataFrame], neighbours: int = 15) -> tuple[DataFrame, DataFrame]:
    """The rows' ids (row, id), numbered from 0, and (view, row, v): the rows of each view's normalized k-nearest-neighbour graph. Rows are regions."""
    graphs = None
    for view, df in vectors.items():
        one = G.normalized(G.knn_graph(df, neighbours)).withColumn("view", F.lit(view))
        graphs = one if graphs is None else graphs.unionByName(one)
    graphs = staged(graphs)
    ids = staged(graphs.select(F.col("src").alias("id")).distinct().withColumn("row", F.row_number().over(Window.orderBy("id")).cast("long") - 1))
    near = graphs.join(ids.withColumnRenamed("id", "src"), "src").join(ids.select(F.col("id").alias("dst"), F.col("row").alias("col")), "dst")
    own = near.groupBy("view", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "w"))).alias("e"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(ids.count() - 1, 0)).cast("long"))
    return ids, staged(own.select("view", "row", F.transform(every, lambda c: F.coalesce(F.col("e")[c], F.lit(0.0))).alias("v")))


def consensus(ids: DataFrame, graphs: DataFrame, k: int, lam: float, rho: float, *, neighbours: int = 15, iterations: int = 100, seed: int = 0) -> DataFrame:
    """Stage 2: (subject, row, label) from ``view_graphs``; views 2s and 2s + 1 are subject s.

    The graphs' low-rank consensus; each subject's two views fused; their k-nearest-neighbour graph; spectral clusters. Subjects are few.
    """
    smooth, _ = tensor.low_rank(graphs, k, lam, rho, iterations=iterations)
    rows = staged(linalg.fused_rows(smooth).select("subject", "row", F.transform("v", lambda x: 1 - x).alias("v")))
    edges = None
    for subject in sorted(r["subject"] for r in rows.select("subject").distinct().collect()):
        one = G.knn_graph(rows.where(F.col("subject") == subject).select("row", "v"), neighbours).withColumn("subject", F.lit(subject))
        edges = one if edges is None else edges.unionByName(one)
    found = spectral_clusters(staged(edges), k, seed=seed)
    return found.join(ids, "row").select("subject", F.col("id").alias("row"), "label")


def spectral_clusters(edges: DataFrame, k: int, *, seed: int = 0) -> DataFrame:
    """(subject, row, label) with labels from 1: k-means of the unit rows of the k leading eigenvectors of each subject's graph. Subjects are few."""
    normal = None
    subjects = sorted(r["subject"] for r in edges.select("subject").distinct().collect())
    for subject in subjects:
        one = G.normalized(edges.where(F.col("subject") == subject).select("src", "dst", "w")).withColumn("subject", F.lit(subject))
        normal = one if normal is None else normal.unionByName(one)
    embedded = linalg.spectral_embedding(normal, k, ["subject"])
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = staged(embedded.withColumn("s", size).select("subject", "row", F.transform("v", lambda x: F.when(F.col("s") > 0, x / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).otherwise(0.0)).alias("v")))
    out = None
    for subject in subjects:
        one = kmeans(unit.where(F.col("subject") == subject).select("row", "v"), k, seed=seed).select(F.lit(subject).alias("subject"), "row", "label")
        out = one if out is None else out.unionByName(one)
    return out


def consensus_grid(vectors: dict[int, DataFrame], grid: DataFrame, *, neighbours: int = 15, iterations: int = 100, seed: int = 0) -> DataFrame:
    """Stage 2 for every point of ``grid (k, lambda, rho)``: (k, lambda, rho, subject, row, label). A grid has some dozen points."""
    out = None
    ids, graphs = view_graphs(vectors, neighbours)
    for p in grid.select("k", "lambda", "rho").distinct().orderBy("k", "lambda", "rho").collect():
        own = consensus(ids, graphs, p["k"], p["lambda"], p["rho"], neighbours=neighbours, iterations=iterations, seed=seed)
        one = staged(own.select(F.lit(p["k"]).alias("k"), F.lit(p["lambda"]).alias("lambda"), F.lit(p["rho"]).alias("rho"), "subject", "row", "label"))
        out = one if out is None else out.unionByName(one)
    return out


def parameter_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the axes' values, a column for each axis: a table of parameters, not of data."""
    rows = list(itertools.product(*axes.values()))
    kinds = {int: "int", float: "double", str: "string"}
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds[type(v[0])]}" for n, v in axes.items()))


def write_runs(runs: DataFrame, path: str, axes: list[str]) -> None:
    """Results of a grid as Parquet, a folder for each value of each axis; points written again replace their folders only."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*axes).parquet(path)


def evaluated(supers: DataFrame, rows: DataFrame, features: DataFrame, axes: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
    """Stage 3: (axes, dbi, chi, homogeneity) of the units' labels that row labels expand to; ``features (subjects, unit, v)``.

    rows has a label for each point of the axes, subject and row; the averages are over the subjects of a point. All points are one plan.
    """
    named = [*(axes or []), *(subjects or [])]
    offset = supers.where("super_id <> 0").agg(F.min("super_id")).scalar()
    units = supers.where("super_id <> 0").join(rows.withColumn("super_id", F.col("row") + offset), "super_id").select(*named, "unit", "label")
    own = features.join(units, [*(subjects or []), "unit"]).select(*named, "label", "v")
    if not named:
        return Q.sweep(own.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    return Q.sweep(own, axes or [], subjects)
