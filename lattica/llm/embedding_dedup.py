"""Near-duplicate vectors by tiled comparison in the order of principal components.

Vectors are scaled to length 1 and turned into the basis of the principal components of all vectors, largest
variance first; cosines stay the same. Equal vectors are one vector with a count. Cells of the leading components, cut at
their quantiles, make tiles, each with its box. A pair of tiles is compared only if their boxes are near enough. It
adds up products over the leading dimensions and bounds the rest by the product of the norms of the suffixes; rows and
columns without a pair that can still reach the threshold leave, and the tile stops when none is left. What remains
is decided by the exact cosine of the vectors as given, in double precision.

A tile pair returns the number of links per vector and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled, table

TILE = 4096
#: Leading components whose cells make tiles.
LEADING = 4
#: Dimensions after which the bound is taken.
STEPS = (8, 16, 32)
_SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _moments(batches):
    """Sums of outer products of the scaled vectors, for one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        by_size: dict[int, list[np.ndarray]] = {}
        for v in batch.column("v"):
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            by_size.setdefault(len(x), []).append(x)
        for size, rows in by_size.items():
            x = np.array(rows)
            x /= _norms(x)[:, None]
            total[size] = total.get(size, 0) + x.T @ x
    for size, m in total.items():
        yield pa.record_batch([pa.array([size], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["size", "m"])


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; scaled first, so that no square overflows or vanishes."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def _keyed(basis: dict[int, np.ndarray]):
    """Adds the leading components; of a vector of fewer the rest are 0."""
    def run(batches):
        for batch in batches:
            lead = np.zeros((batch.num_rows, LEADING))
            for i, v in enumerate(batch.column("v")):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)[None]
                own = ((x / _norms(x)[:, None]) @ basis[x.shape[1]][:, :LEADING])[0]
                lead[i, : len(own)] = own
            yield pa.record_batch([batch.column("rep"), batch.column("many"), batch.column("v"), *(pa.array(np.ascontiguousarray(lead[:, c])) for c in range(LEADING))], names=["rep", "many", "v", *(f"p{c}" for c in range(LEADING))])
    return run


def _even(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _hits(za, zb, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs that the bounds leave."""
    rows, cols = np.arange(len(za)), np.arange(len(zb))
    d, done = za.shape[1], 0
    dots = np.zeros((len(za), len(zb)))
    for upto in [*(s for s in STEPS if s < d), d]:
        dots += za[rows, done:upto] @ zb[cols, done:upto].T
        done = upto
        rest = np.sqrt((za[rows, done:] ** 2).sum(axis=1))[:, None] * np.sqrt((zb[cols, done:] ** 2).sum(axis=1))[None]
        able = dots + rest >= threshold - _SLACK
        if not able.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r, c = able.any(axis=1), able.any(axis=0)
        dots, rows, cols, able = dots[np.ix_(r, c)], rows[r], cols[c], able[np.ix_(r, c)]
    i, j = np.nonzero(able)
    return rows[i], cols[j]


def _cosines(xa, xb, i, j) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 200_000):
        p, q = xa[i[a : a + 200_000]], xb[j[a : a + 200_000]]
        out[a : a + 200_000] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    return out


def _forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Joins i and j in parent; the links that joined something."""
    edges = []
    while len(i):
        root = parent
        while (up := root[root]) is not root and (up != root).any():
            root = up
        parent[:] = root
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if len(i):
            _, first = np.unique(root[i] * np.int64(len(parent)) + root[j], return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                ra, rb = _find(parent, a), _find(parent, b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b))
    return edges


def _compared(threshold: float, basis: dict[int, np.ndarray]):
    """(a, b, n): b is null and n is the number of linked vectors of a; or n is 0 and (a, b) is an edge of the forest."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts, xs, zs = [], [], [], []
                for side in ("l", "r"):
                    rows = batch.column(side)[k].values
                    ids.append(np.asarray(rows.field("rep")))
                    counts.append(np.asarray(rows.field("many")))
                    xs.append(_even(_matrix(rows.field("v"))))
                    zs.append((xs[-1] / _norms(xs[-1])[:, None]) @ basis[xs[-1].shape[1]])
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                links = [np.zeros(len(x), np.int64) for x in ids]
                parent = np.arange(len(ids[0]) + (0 if same else len(ids[1])))
                edges: list[tuple[int, int]] = []
                for lo in range(0, len(ids[0]), 256):  # a strip of the tile at once bounds the memory
                    i, j = _hits(zs[0][lo : lo + 256], zs[1], threshold)
                    i = i + lo
                    if same:
                        i, j = i[i < j], j[i < j]
                    near = _cosines(xs[0], xs[1], i, j) >= threshold
                    i, j = i[near], j[near]
                    np.add.at(links[0], i, counts[1][j])
                    np.add.at(links[0 if same else 1], j, counts[0][i])
                    edges += _forest(parent, i, j + (0 if same else len(ids[0])))
                both = ids[0] if same else np.concatenate(ids)
                out = [(ids[s][x], None, links[s][x]) for s in ((0,) if same else (0, 1)) for x in np.flatnonzero(links[s])]
                out += [(both[a], both[b], 0) for a, b in edges]
                if out:
                    a, b, n = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])
        settled()
    return run


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """Per row of vectors: vec_id, n_links (other rows of cosine >= threshold), component_id, kept (vec_id = component_id).

    component_id is the least vec_id reachable by links, the own one included. Null, empty and zero vectors and
    vectors with null or non-finite components link with nothing, vectors of different sizes do not link. Rows
    that repeat are vectors of their own and link with each other. Rows with a null vec_id link with
    nothing. Other columns are ignored.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = own.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    # -0.0 and 0.0 are one component
    good = good.select("id", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v")).withColumn("h", F.xxhash64("v"))
    # equal vectors are one: their number and least id are combined before the shuffle
    reps = table(good.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "vectors")
    sums = reps.select("v").mapInArrow(_moments, "size int, m array<double>").select("size", F.posexplode("m").alias("p", "x")).groupBy("size", "p").agg(F.sum("x").alias("x"))
    total: dict[int, np.ndarray] = {}
    for row in sums.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("m")).collect():  # size x size numbers for each size of vectors
        total[row["size"]] = np.array([e["x"] for e in row["m"]])
    basis = {size: np.linalg.eigh(m.reshape(size, size))[1][:, ::-1].copy() for size, m in total.items()}
    leads = [f"p{c}" for c in range(LEADING)]
    keyed = table(reps.mapInArrow(_keyed(basis), "rep long, many long, v array<double>, " + ", ".join(f"{p} double" for p in leads)).withColumn("size", F.size("v")), "keyed")

    n = max(1, -(-keyed.count() // tile))
    used = max(1, min(LEADING, int(math.log(n, 4) + 1e-9)))  # components that are cut, into four cells or more
    cuts = round(n ** (1 / used))  # together about as many cells as tiles
    if cuts > 1:
        below = lambda p: F.size(F.filter(f"q.{p}", lambda e: e < F.col(p)))
        at = [F.percentile_approx(p, [i / cuts for i in range(1, cuts)], 1000).alias(p) for p in leads]
        quantiles = keyed.groupBy("size").agg(*at).select("size", F.struct(*leads).alias("q"))  # a row for each size of vectors
        celled = keyed.join(F.broadcast(quantiles), "size").withColumn("cell", F.array(*[below(p) for p in leads[:used]])).drop("q")
    else:
        celled = keyed.withColumn("cell", F.array(F.lit(0)))
    ranged = celled.repartitionByRange(n, "size", "cell", "p0", "rep")
    # neighbouring ranges make one tile where the session deals out more of them than asked for
    tile_of = F.floor(F.spark_partition_id() * n / ranged.rdd.getNumPartitions()).cast("long")
    box = [f(p).alias(f"{x}{p}") for p in leads for x, f in (("lo", F.min), ("hi", F.max))]
    tiles = ranged.withColumn("part", tile_of).groupBy("part", "size").agg(*box, F.collect_list(F.struct("rep", "many", "v")).alias("rows"))
    tiles = table(tiles.withColumn("tile", F.xxhash64("part", "size")), "tiles")
    # cosine >= t needs a distance of sqrt(2 - 2t) at most, and so one of the boxes; their first sides meet on a grid
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    sides = lambda t, x: tiles.select(F.col("tile").alias(t), "size", *[F.col(f"{e}{p}").alias(f"{x}{e}{p}") for p in leads for e in ("lo", "hi")])
    cell = lambda c: F.floor(F.col(c) / reach)
    left = sides("i", "a").withColumn("g", F.explode(F.sequence(cell("alop0"), cell("ahip0"))))
    right = sides("j", "b").withColumn("g", F.explode(F.sequence(cell("blop0") - 1, cell("bhip0") + 1)))
    gaps = [F.greatest(F.col(f"blo{p}") - F.col(f"ahi{p}"), F.col(f"alo{p}") - F.col(f"bhi{p}"), F.lit(0.0)) for p in leads]
    near = (F.col("i") <= F.col("j")) & (sum(g * g for g in gaps) <= reach * reach)
    pairs = table(left.join(right, ["size", "g"]).where(near).select("i", "j").distinct(), "pairs")
    held = pairs.join(tiles.select(F.col("tile").alias("i"), F.col("rows").alias("l")), "i").join(tiles.select(F.col("tile").alias("j"), F.col("rows").alias("r")), "j")
    found = table(held.select("i", "j", "l", "r").mapInArrow(_compared(threshold, basis), "a long, b long, n long"), "found")

    labels = components(found.where("b is not null").select("a", "b"))
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    of = reps.select("h", "v", "rep", "many").join(linked, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    of = table(of.select("h", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "of")
    whole = own.withColumn("w", F.when(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)), F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))))
    whole = whole.select("id", "w", F.xxhash64("w").alias("wh"))
    out = whole.join(of, (F.col("wh") == F.col("h")) & (F.col("w") == F.col("v")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
