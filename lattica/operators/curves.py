"""Cosine series of curves. Points are ``(curve, pos, x, y, z)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.quality import dot
from lattica.operators.spatial import along, arc_length


def normal_equations(points: DataFrame, k: int) -> DataFrame:
    """(curve, i, j, a) of the design's products and right sides (i, -1 - axis): least squares of the evenly extended curve.

    The extension repeats every point but the first, so those weigh 2. The basis is sqrt(2) cos(pi j t), j = 0..k.
    """
    t = arc_length(points)
    rows = points.join(t, ["curve", "pos"]).withColumn("w", F.when(F.row_number().over(Window.partitionBy("curve").orderBy("pos")) == 1, 1.0).otherwise(2.0))
    basis = F.array(*[F.sqrt(F.lit(2.0)) * F.cos(F.lit(math.pi) * j * F.col("t")) for j in range(k + 1)])
    rows = rows.where("t is not null").withColumn("b", basis)
    terms = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("w") * F.col("b")[i] * F.col("b")[j]).alias("x")) for i in range(k + 1) for j in range(k + 1)]
    terms += [F.struct(F.lit(i).alias("i"), F.lit(-1 - n).alias("j"), (F.col("w") * F.col("b")[i] * F.col(c)).alias("x")) for i in range(k + 1) for n, c in enumerate("xyz")]
    return rows.select("curve", F.explode(F.array(*terms)).alias("e")).groupBy("curve", "e.i", "e.j").agg(F.sum("e.x").alias("a"))


def _basis(t: Column, k: int) -> list[Column]:
    return [F.sqrt(F.lit(2.0)) * F.cos(F.lit(math.pi) * j * t) for j in range(k + 1)]


def _solved(m: Column, k: int) -> Column:
    """The right sides' solutions, rows of 3, of rows of k + 1 coefficients and 3 right sides: Gauss-Jordan for a positive semidefinite
    matrix; an unknown whose pivot is lost in rounding is 0."""
    least = m[0][0] * 1e-11

    def eliminated(rows, at):
        own, pivot = F.get(rows, at), F.get(F.get(rows, at), at)
        own = F.transform(own, lambda x: F.when(pivot > least, x / F.when(pivot > least, pivot).otherwise(1.0)).otherwise(0.0))
        return F.transform(rows, lambda row, i: F.when(i == at, own).otherwise(F.zip_with(row, own, lambda x, y: x - F.get(row, at) * y)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(k)), m, eliminated), lambda row: F.slice(row, k + 2, 3))


def cosine_series(points: DataFrame, k: int = 3) -> DataFrame:
    """(curve, beta): (k + 1) x 3 coefficients by least squares of the evenly extended curve, null for a curve of length 0 or of one point.

    One aggregate by curve, combined before the shuffle, sums the normal equations; they are solved in place. A curve of no more than
    k places has many solutions: the one of least norm through the mean point of each place is taken. Digits are lost with the square
    of the condition, so where places nearly coincide and few are left, coefficients that they do not determine are 0. Points with a null coordinate or position take no part.
    """
    w = Window.partitionBy("curve").orderBy("pos")
    own = points.select(F.col("curve").cast("long").alias("curve"), "pos", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    own = along(own.where(" and ".join(f"{c} is not null" for c in ("pos", "x", "y", "z"))))
    # the extension repeats every point but the first, so those weigh 2; q numbers the places
    own = own.withColumns({"w": F.when(F.row_number().over(w) == 1, 1.0).otherwise(2.0), "new": (F.col("t") > F.lag("t").over(w)).cast("int")})
    own = own.withColumn("q", F.sum(F.coalesce("new", F.lit(0))).over(w)).withColumn("b", F.array(*_basis(F.col("t"), k)))
    b = lambda i: F.col("b")[i]
    sums = [F.sum(F.col("w") * b(i) * b(j)).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    sums += [F.sum(F.col("w") * b(i) * F.col(c)).alias(f"{c}{i}") for i in range(k + 1) for c in "xyz"]
    at = lambda q, x: F.when(F.col("q") == q, x)
    for q in range(k):
        sums += [F.max(at(q, F.col("t"))).alias(f"t{q}"), *[(F.sum(at(q, F.col("w") * F.col(c))) / F.sum(at(q, F.col("w")))).alias(f"p{c}{q}") for c in "xyz"]]
    per = own.groupBy("curve").agg(F.max("q").alias("q"), F.max("t").alias("long"), *sums)
    full = F.array(*[F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(k + 1)], *[F.col(f"{c}{i}") for c in "xyz"]) for i in range(k + 1)])
    none = [F.lit(0.0)] * (k + 1)
    places = [F.when(F.col(f"t{q}").isNotNull(), F.array(*_basis(F.col(f"t{q}"), k))).otherwise(F.array(*none)) for q in range(k)]
    per = per.withColumn("full", full).withColumn("bases", F.array(*places, F.array(*none)))
    # by places: products of their bases, and the identity where there is none
    short = F.transform("bases", lambda r, i: F.concat(
        F.transform("bases", lambda c, j: dot(r, c) + F.when((i == j) & ((i > F.col("q")) | F.col("long").isNull()), 1.0).otherwise(0.0)), F.get(F.array(*[F.array(*[F.coalesce(F.col(f"p{c}{q}"), F.lit(0.0)) for c in "xyz"]) for q in range(k)], F.array(*none[:1] * 3)), i)))
    per = per.withColumn("m", F.when(F.col("q") >= k, F.col("full")).otherwise(short)).withColumn("s", _solved(F.col("m"), k))
    turned = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda c: F.aggregate(F.zip_with("bases", "s", lambda r, x: F.get(r, j) * F.get(x, c)), F.lit(0.0), lambda u, v: u + v)))
    return per.select("curve", F.when(F.col("long") > 0, F.when(F.col("q") >= k, F.col("s")).otherwise(turned)).alias("beta"))


def descriptor(points: DataFrame, *, both_ways: bool = False) -> DataFrame:
    """(curve, sign, d): 9 numbers: the mean coefficient, the lengths of coefficients 1 to 3, and the direction, last less first point.

    With both_ways a second row has the direction negated.
    """
    ends = points.groupBy(F.col("curve").cast("long").alias("curve")).agg(F.min(F.struct("pos", "x", "y", "z")).alias("a"), F.max(F.struct("pos", "x", "y", "z")).alias("b"))
    rows = cosine_series(points, 3).join(ends, "curve")
    size = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)) if both_ways else F.array(F.lit(1))))
    direction = F.array(*[(F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("sign") for c in "xyz"])
    lengths = F.transform(F.slice("beta", 2, 3), size)
    return rows.select("curve", "sign", F.when(F.col("beta").isNotNull(), F.concat(F.col("beta")[0], lengths, direction)).alias("d"))
