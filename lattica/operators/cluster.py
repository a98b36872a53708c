"""k-means in the forms of stage 3. Vectors are ``(row, v)``; every start is seeded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.quality import dot, moments
from lattica.plans.staging import staged


def kmeans(vectors: DataFrame, k: int, *, seed: int = 0, iterations: int = 50) -> DataFrame:
    """(row, label) with labels from 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = vectors.select("row", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(own)
    return model.transform(own).select("row", (F.col("prediction") + 1).alias("label"))


def cosine_step(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(row, label): the centre ``(label, c)`` of least cosine distance, of equals the first; a zero row has label -1, a zero centre is at distance 1.

    centres has one row per cluster, a stated number, and is broadcast.
    """
    every = centres.agg(F.collect_list(F.struct("label", "c", F.sqrt(dot("c", "c")).alias("t"))).alias("every"))  # one row
    own = vectors.select("row", "v", F.sqrt(dot("v", "v")).alias("s")).join(F.broadcast(every), F.lit(True))

    def far(e):
        s, t = (F.when(x > 0, x).otherwise(1.0) for x in (F.col("s"), e["t"]))
        return F.struct(F.round(F.when(e["t"] > 0, 1 - dot("v", e["c"]) / (s * t)).otherwise(1.0), 12).alias("d"), e["label"].alias("label"))

    best = F.array_min(F.transform("every", far))["label"]
    return own.where("s = 0 or size(every) > 0").select("row", F.when(F.col("s") > 0, best).otherwise(-1).alias("label"))


def means(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, c): plain means of the rows of each label other than -1; labels whose rows all have nulls have none."""
    sums = moments(vectors.join(labels.where("label >= 0"), "row"), ["label"])
    return sums.select("label", F.transform("sum", lambda x: x / F.col("n")).alias("c"))


#: Rows at most, about, that the driver takes for rounds of its own (some 4 MB at 64 places).
NEAR = 8192
_STEPS = 2.0 ** -np.arange(41)


def _lists(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(centres: np.ndarray) -> np.ndarray:
    size = np.sqrt((centres * centres).sum(axis=1))
    return centres / np.where(size > 0, size, 1)[:, None]


def _far(x: np.ndarray, unit: np.ndarray) -> np.ndarray:
    return np.round(1 - x @ unit.T / np.sqrt((x * x).sum(axis=1))[:, None], 12)


def _sums(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Sums and numbers of the rows of each centre."""
    part = np.zeros((k, x.shape[1] + 1))
    np.add.at(part[:, :-1], near, x)
    part[:, -1] = np.bincount(near, minlength=k)
    return part


def _round(centres: np.ndarray, least: float):
    """(s, h, v) of a task as bytes: sums and numbers of the rows nearest to each centre by more than ``least``, how many rows are nearest by
    each step of ``_STEPS`` or less, and the other rows; zero rows take no part."""
    unit = _unit(centres)

    def run(batches):
        total, steps, others = np.zeros((len(centres), centres.shape[1] + 1)), np.zeros(len(_STEPS)), []
        for b in batches:
            x = _lists(b.column("v")) if b.num_rows else np.zeros((0, 0))
            x = x[(x * x).sum(axis=1) > 0]
            if not len(x):
                continue
            far = _far(x, unit)
            near = far.argmin(axis=1)  # of equals the first; a zero centre is at distance 1
            by = np.diff(np.partition(far, 1, axis=1)[:, :2], axis=1)[:, 0] if len(centres) > 1 else np.full(len(x), 4.0)
            steps += (by[:, None] <= _STEPS).sum(axis=0)
            sure = by > least
            total += _sums(x[sure], near[sure], len(centres))
            others.append(x[~sure])
        v = np.concatenate(others) if others else np.zeros((0, centres.shape[1]))
        yield pa.record_batch([pa.array([m.tobytes()], pa.binary()) for m in (total, steps, v)], names=["s", "h", "v"])
    return run


def cosine_kmeans(vectors: DataFrame, k: int, *, seed: int = 0, iterations: int = 5000, near: int = NEAR) -> DataFrame:
    """(row, label): Lloyd rounds from k rows of least hash, until the centres stay; a cluster left empty has a zero centre.

    A pass over the staged rows gives each task's sums of k x d numbers. Of rows that lie nearest to their centre by more than centres have since
    moved the centre cannot change; a pass returns the others, about ``near`` rows at most, and the rounds that follow need only these until centres have moved too far.
    """
    spark = vectors.sparkSession
    own = staged(vectors.select("row", F.transform("v", lambda x: x.cast("double")).alias("v")))
    start = own.where(dot("v", "v") > 0).orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(k).collect()
    if not start:
        return own.select("row", F.lit(-1).alias("label"))
    centres = np.array([r["v"] for r in start])
    rounds, still, least = 0, False, -1.0
    while rounds < iterations and not still:
        got = own.select("v").mapInArrow(_round(centres, least), "s binary, h binary, v binary").collect()  # a row for each task
        sure = sum(np.frombuffer(r["s"]) for r in got).reshape(len(centres), -1)
        steps = sum(np.frombuffer(r["h"]) for r in got)
        others = np.concatenate([np.frombuffer(r["v"]).reshape(-1, centres.shape[1]) for r in got])
        first = _unit(centres)
        while rounds < iterations and not still:
            sums = sure + _sums(others, _far(others, _unit(centres)).argmin(axis=1), len(centres)) if len(others) else sure
            new = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
            still, rounds = np.allclose(new, centres), rounds + 1
            centres = new
            if 2 * np.sqrt(((_unit(centres) - first) ** 2).sum(axis=1)).max() + 1e-11 > least:
                break
        few = np.flatnonzero(steps <= near)
        least = float(_STEPS[few[0]]) if len(few) else -1.0
    return cosine_step(own, spark.createDataFrame(list(enumerate(centres.tolist())), "label int, c array<double>"))
