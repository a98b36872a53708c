"""Sparse matrices ``(row, col, x)`` and row vectors ``(row, v)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.staging import staged


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b."""
    right = b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("x").alias("y"))
    return a.join(right, a["col"] == right["k"]).groupBy("row", F.col("c").alias("col")).agg(F.sum(F.col("x") * F.col("y")).alias("x"))


def gram(a: DataFrame) -> DataFrame:
    """The transpose of a times a."""
    return matmul(a.select(F.col("col").alias("row"), F.col("row").alias("col"), "x"), a)


def row_normalized(a: DataFrame) -> DataFrame:
    """Rows over their sums; rows that sum to 0 are over 1e-10."""
    sums = a.groupBy("row").agg(F.sum("x").alias("s"))
    return a.join(sums, "row").select("row", "col", (F.col("x") / F.when(F.col("s") == 0, 1e-10).otherwise(F.col("s"))).alias("x"))


def group_mean(a: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, col, x): mean rows over the members of each group other than 0 in ``groups (row, group)``; entries left out are 0."""
    own = groups.where("`group` <> 0")
    sizes = own.groupBy("group").agg(F.count("*").alias("n"))
    sums = a.join(own, "row").groupBy("group", "col").agg(F.sum("x").alias("s"))
    return sums.join(sizes, "group").select("group", "col", (F.col("s") / F.col("n")).alias("x"))


def views(parts: list[DataFrame]) -> DataFrame:
    """(view, row, col, x): matrices under one another, numbered in order."""
    out = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("view"), "row", "col", "x")
        out = one if out is None else out.unionByName(one)
    return out


def _products(what: str):
    """All pairs of the rows of two blocks, in strips, so that memory is bounded: cosines (0 for zero rows) or squared distances."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column("l")[k].values, batch.column("r")[k].values
                ids = [x.field("row") for x in (left, right)]
                a, b = (x.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in (left, right))
                if what == "cosine":
                    a, b = (x / np.where(n == 0, 1, n)[:, None] for x, n in ((x, np.sqrt((x * x).sum(axis=1))) for x in (a, b)))
                for at in range(0, len(a), 64):
                    own = a[at : at + 64]
                    x = own @ b.T if what == "cosine" else ((own[:, None] - b[None]) ** 2).sum(axis=2)
                    yield pa.record_batch([ids[0].take(pa.array(np.repeat(np.arange(at, at + len(own)), len(b)))), ids[1].take(pa.array(np.tile(np.arange(len(b)), len(own)))), pa.array(x.ravel())], names=["i", "j", "x"])
    return run


def _all_pairs(left: DataFrame, right: DataFrame, what: str, block: int = 1024) -> DataFrame:
    """(i, j, x) for all rows of left and right. The result is dense: rows are those of regions. Blocks meet, not rows."""
    kind = left.schema["row"].dataType.simpleString()

    def blocks(df):
        n = max(1, -(-df.count() // block))
        own = df.select("row", F.transform("v", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64("row"), F.lit(n)).alias("b"))
        return staged(own.groupBy("b").agg(F.collect_list(F.struct("row", "v")).alias("rows"))), n

    (a, _), (b, n) = blocks(left), blocks(right)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("at")
    pairs = a.select(F.col("rows").alias("l"), at).join(b.select("b", F.col("rows").alias("r")), F.col("at") == F.col("b"))
    return pairs.select("l", "r").mapInArrow(_products(what), f"i {kind}, j {kind}, x double")


def cosine_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, sim): cosines of all rows of left with all rows of right, 0 for zero rows."""
    return _all_pairs(left, right, "cosine").withColumnRenamed("x", "sim")


def cosine_distances(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(i, j, distance): one less the cosine; a zero row is at distance 1 from all others, and every row of one table at distance 0 from itself."""
    pairs = cosine_pairs(left, left if right is None else right)
    distance = 1 - F.col("sim")
    return pairs.select("i", "j", (F.when(F.col("i") == F.col("j"), 0.0).otherwise(distance) if right is None else distance).alias("distance"))


def squared_distances(vectors: DataFrame) -> DataFrame:
    """(i, j, d2) of all rows."""
    return _all_pairs(vectors, vectors, "square").withColumnRenamed("x", "d2")


def connect_sim(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(i, j, sim): C + C' over 2, the diagonal 1, for the cosines C of the rows of left with those of right (of left itself if there is none).

    Both sides have the same rows; right's are the columns of the second matrix.
    """
    c = staged(cosine_pairs(left, left if right is None else right))
    both = c if right is None else c.select("i", "j", "sim").unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")).groupBy("i", "j").agg((F.sum("sim") / 2).alias("sim"))
    return both.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("sim")).alias("sim"))


def hemisphere(matrix: DataFrame, first: int, count: int, *, axis: str = "col") -> DataFrame:
    """The entries of one side of a matrix ``(row, col, x)``: ``count`` columns (or rows) from ``first`` on, numbered from 0."""
    own = matrix.where((F.col(axis) >= first) & (F.col(axis) < first + count))
    return own.withColumn(axis, F.col(axis) - first)
