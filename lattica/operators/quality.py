"""Quality of a clustering: vectors are ``(unit, label, v array<double>)``.

Rows with a null label, map or vector, or with a null component, take no part; vectors have one length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lattica.plans.staging import staged

#: Numbers that a task holds before it hands its sums on.
HELD = 1 << 23
SUMS = "_sums"


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: str) -> Column:
    """The vector over its length; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(F.array(F.when(norm == 0, 1.0).otherwise(norm)), lambda n: F.transform(v, lambda x: x / n))[0]


def _groups(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group of equal keys, and the group of each row."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        _, first, code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(), return_index=True, return_inverse=True)
    return first, code


def _added(names: list[str], part: Callable[[np.ndarray], np.ndarray]):
    """Sums of the rows of ``part(x)`` by group, over all batches of a task; x has the batch's arrays as rows."""
    def rows(total, schema):
        keys = [pa.array(k, schema.field(c).type) for c, k in zip(names, zip(*total, strict=True), strict=True)]
        flat = np.concatenate(list(total.values()))
        ends = np.arange(len(total) + 1, dtype=np.int32) * (len(flat) // len(total))
        return pa.record_batch([*keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*names, SUMS])

    def run(batches):
        total, schema = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            x = part(batch.column(SUMS).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            first, of = _groups(batch, names)
            order = np.argsort(of, kind="stable")
            sums = np.add.reduceat(x[order], np.searchsorted(of[order], np.arange(len(first))), axis=0)
            keys = batch.select(names).take(pa.array(first)).to_pydict()
            for key, s in zip(zip(*(keys[c] for c in names), strict=True), sums, strict=True):
                total[key] = total[key] + s if key in total else s
            if len(total) * x.shape[1] > HELD:
                yield rows(total, schema)
                total = {}
        if total:
            yield rows(total, schema)
    return run


def totals(rows: DataFrame, by: list[str], m: Column, part: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """(by, _sums): the sums of the arrays ``part(m)``, rows to rows, of each group.

    Tasks add up their rows, so one row for each task and group is shuffled, whatever the rows of a group. Nulls take no part.
    """
    names = [f"by{i}" for i in range(len(by))]
    own = rows.select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), m.alias(SUMS))
    own = own.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own.columns]) & ~F.exists(SUMS, lambda x: x.isNull()))
    shape = StructType([*(f for f in own.schema.fields if f.name != SUMS), StructField(SUMS, ArrayType(DoubleType()))])
    sums = own.mapInArrow(_added(names, part), shape).repartition(*names).mapInArrow(_added(names, lambda x: x), shape)
    return sums.select(*(F.col(n).alias(b) for b, n in zip(by, names, strict=True)), SUMS)


def _raised(x: np.ndarray) -> np.ndarray:
    q = (x * x).sum(axis=1)
    size = np.sqrt(q)
    return np.column_stack([np.ones(len(x)), size > 0, q, x, x / np.where(size > 0, size, 1)[:, None]])


def moments(vectors: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """(by, n, some, q, sum, units): rows, rows other than zero, sum of squared lengths, sum of vectors, sum of vectors over their lengths."""
    sums = totals(vectors, by, F.transform(v, lambda x: x.cast("double")), _raised)
    d = ((F.size(SUMS) - 3) / 2).cast("int")
    return sums.select(*by, F.col(SUMS)[0].cast("long").alias("n"), F.col(SUMS)[1].cast("long").alias("some"), F.col(SUMS)[2].alias("q"), F.slice(SUMS, F.lit(4), d).alias("sum"), F.slice(SUMS, d + 4, d).alias("units"))


def _mean_cosine() -> Column:
    """Of the pairs of a label's units, from its moments; 1 for fewer than two units."""
    n = F.col("n")
    return F.when(n < 2, 1.0).otherwise((dot("units", "units") - F.col("some")) / F.when(n < 2, 1).otherwise(n * (n - 1)))


def homogeneity(vectors: DataFrame) -> DataFrame:
    """(label, homogeneity): mean cosine of the pairs in each label 1..K, from one sum per label; 1 for fewer than two units or none."""
    means = moments(vectors.where("label <> 0"), ["label"]).select("label", _mean_cosine().alias("h"))
    every = vectors.agg(F.max("label").alias("k")).select(F.explode(F.sequence(F.lit(1).cast("int"), F.greatest(F.col("k"), F.lit(1)).cast("int"))).alias("label"))
    return every.join(means, "label", "left").select("label", F.coalesce("h", F.lit(1.0)).alias("homogeneity"))


def _around(sums: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(label, far, away): number and sum of the unit vectors of all labels next to each label."""
    next_to = adjacent.where("a <> b").select("a", "b").distinct().join(sums.withColumnRenamed("label", "b"), "b")
    both = totals(next_to, ["a"], F.concat(F.array(F.col("n").cast("double")), "units"))
    return both.select(F.col("a").alias("label"), F.col(SUMS)[0].alias("far"), F.slice(SUMS, F.lit(2), F.size(SUMS) - 1).alias("away"))


def neighbour_distance(vectors: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(unit, label, distance): mean cosine distance to the units of all labels that ``adjacent (a, b)`` links to the own one.

    The mean over units is one minus the product with the sum of unit vectors, so no pair of units is formed. A zero
    vector is at distance 1 from all.
    """
    own = vectors.withColumn("u", _unit("v"))
    return own.join(_around(moments(vectors, ["label"]), adjacent), "label").select("unit", "label", (1 - dot("u", "away") / F.col("far")).alias("distance"))


def silhouette_adjacent(vectors: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(silhouette): mean over units of (b - a) / max(a, b); a is the mean distance within the label, b that to adjacent labels.

    Units alone in their label or without an adjacent label count 0.
    """
    sums = staged(moments(vectors, ["label"]))
    own = vectors.select("label", _unit("v").alias("u")).join(sums.select("label", "n", "units"), "label").join(_around(sums, adjacent), "label", "left")
    a = F.when(F.col("n") > 1, (F.col("n") - F.when(dot("u", "u") > 0, 1).otherwise(1) - (dot("u", "units") - dot("u", "u"))) / F.greatest(F.col("n") - 1, F.lit(1)))
    both = own.select(a.alias("a"), (1 - dot("u", "away") / F.col("far")).alias("b"))
    top = F.greatest("a", "b")
    return both.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(top == 0, 1.0).otherwise(top))).alias("silhouette"))


def _over(v: str, n: str) -> Column:
    return F.transform(F.struct(v, n)[v], lambda x: x / F.col(n))


def _distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _centred(vectors: DataFrame, by: list[str]) -> DataFrame:
    """The moments of each label of each map and their centroids c, written once: a row per label."""
    return staged(moments(vectors, [*by, "label"]).withColumn("c", _over("sum", "n")))


def _spread(vectors: DataFrame, centred: DataFrame, by: list[str]) -> DataFrame:
    """centred with s, the mean distance of a label's units to its centroid, written once."""
    at = [*by, "label"]
    away = vectors.join(centred.select(*at, "c"), at).groupBy(*at).agg(F.avg(_distance("v", "c")).alias("s"))
    return staged(centred.join(away, at))


def _worst(spread: DataFrame, by: list[str]) -> DataFrame:
    """(by, dbi) of the labels' centroids and spreads."""
    a, b = (spread.select(*by, F.col("label").alias(i), F.col("s").alias(f"s{i}"), F.col("c").alias(f"c{i}")) for i in "ij")
    far = _distance("ci", "cj")
    pairs = a.join(b, by).where("i <> j") if by else a.join(b, F.col("i") != F.col("j"))
    worst = pairs.groupBy(*by, "i").agg(F.max(F.when(far > 0, (F.col("si") + F.col("sj")) / F.when(far > 0, far).otherwise(1.0)).otherwise(0.0)).alias("r"))  # one row per pair of labels
    return worst.groupBy(*by).agg(F.avg("r").alias("dbi"))


def _dispersed(centred: DataFrame, maps: list[str]) -> DataFrame:
    """(maps, chi, homogeneity) of the labels' moments."""
    whole = totals(centred, maps, F.concat(F.array(F.col("n").cast("double")), "sum"))
    whole = whole.select(*maps, F.col(SUMS)[0].alias("all"), F.transform(F.slice(SUMS, F.lit(2), F.size(SUMS) - 1), lambda x: x / F.col(SUMS)[0]).alias("centre"))
    h = F.when(F.col("label") != 0, _mean_cosine())
    per = centred.join(whole, maps).groupBy(*maps, "all").agg(
        F.count("*").alias("k"), F.sum(F.col("q") - F.col("n") * dot("c", "c")).alias("within"), F.sum(F.col("n") * F.pow(_distance("c", "centre"), 2)).alias("between"),
        F.sum(h).alias("h"), F.count(h).alias("labelled"), F.max("label").alias("top"),
    )
    within, top = F.col("within"), F.col("top")
    chi = F.when(within == 0, 1.0).otherwise(F.col("between") * (F.col("all") - F.col("k")) / F.when(within == 0, 1.0).otherwise(within * (F.col("k") - 1)))
    mean = F.when(F.col("labelled") > 0, (F.col("h") + top - F.col("labelled")) / top)
    return per.select(*maps, chi.alias("chi"), mean.alias("homogeneity"))


def davies_bouldin(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, dbi), for each map of ``by``: mean over labels of the worst ratio of spreads to the distance of centroids; all labels count, 0 too."""
    by = by or []
    return _worst(_spread(vectors, _centred(vectors, by), by), by)


def calinski_harabasz(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, chi), for each map of ``by``: dispersion between over within labels, each over its degrees of freedom; 1 if there is none within."""
    own = vectors if by else vectors.withColumn("_map", F.lit(1))
    return _dispersed(_centred(own, by or ["_map"]), by or ["_map"]).select(*(by or []), "chi")


def metrics(vectors: DataFrame) -> DataFrame:
    """(dbi, chi, homogeneity) of one map; no row without units."""
    return sweep(vectors.withColumn("_map", F.lit(0)), ["_map"]).select("dbi", "chi", F.coalesce("homogeneity", F.lit(1.0)).alias("homogeneity"))


def sweep(vectors: DataFrame, keys: list[str], subjects: list[str] | None = None) -> DataFrame:
    """(keys, dbi, chi, homogeneity) of each parameter point, all points in one plan: the metrics of each subject's map (of the
    point's one map without ``subjects``), averaged over the subjects. Homogeneity is the mean over the labels 1..K of a map, 1 for those
    with fewer than two units or none, as in ``homogeneity``; a metric that no map has is null.

    vectors are written once and read twice: for the labels' moments, from which all else comes, and for the distances to the centroids.
    """
    named = [*keys, *(subjects or [])]
    maps = [f"_map{i}" for i in range(len(named))]  # keys may have the names of columns in between
    own = staged(vectors.select(*(F.col(a).alias(b) for a, b in zip(named, maps, strict=True)), "label", "v"))
    spread = _spread(own, _centred(own, maps), maps)
    each = _dispersed(spread, maps).join(_worst(spread, maps), maps, "left")
    return each.groupBy(*(F.col(b).alias(a) for a, b in zip(keys, maps, strict=False))).agg(*(F.avg(m).alias(m) for m in ("dbi", "chi", "homogeneity")))
