"""Compression of vectors into codes: k-means of integer parts, whose nearest entries a kd-tree finds.

A part's codebook is a kd-tree that is broadcast each round. Rows go down the tree together; a node is visited by the rows whose
squared distance to its box is at most their best one so far. Equal bounds are visited too, so of entries at the same distance the
one of the lower index is found. Sums and counts are integers, so a round's result does not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, settled, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf of the tree.
LEAF = 8
_ROWS = 4096


@dataclass
class Node:
    low: np.ndarray  # the box of the entries below
    high: np.ndarray
    entries: np.ndarray | None = None  # of a leaf: their indexes, ascending
    points: np.ndarray | None = None
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def tree(points: np.ndarray) -> Node:
    """kd-tree of integer points: cut at the median of the widest axis; equal points stay in one leaf."""
    def grown(index: np.ndarray) -> Node:
        own = points[index]
        node = Node(own.min(axis=0), own.max(axis=0))
        wide = node.high - node.low
        if len(index) <= LEAF or not wide.any():
            node.entries, node.points = index, own
            return node
        node.axis = int(wide.argmax())
        x = own[:, node.axis]
        node.cut = int(np.sort(x)[len(x) // 2])
        if node.cut == node.low[node.axis]:  # the median is the least value
            node.cut = int(x[x > node.cut].min())
        node.left, node.right = grown(index[x < node.cut]), grown(index[x >= node.cut])
        return node

    return grown(np.arange(len(points)))


def nearest(root: Node, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest point of the tree for each row, the lowest of several, and the squared distances."""
    best, index = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    # where all products stay below 2^53 doubles are exact and fast
    most = int(max(np.abs(rows).max(initial=0), np.abs(root.low).max(initial=0), np.abs(root.high).max(initial=0)))
    kind = np.float64 if (2 * most) ** 2 * max(1, rows.shape[1]) < 1 << 53 else np.int64
    own = rows.astype(kind)
    squares = (own * own).sum(axis=1)

    def bound(node: Node, at: np.ndarray) -> np.ndarray:
        """Those of the rows that the node's box is near enough for."""
        x = own[at]
        gap = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        return at[(gap * gap).sum(axis=1) <= best[at]]

    def visit(node: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node.entries is not None:
            points = node.points.astype(kind)
            d = squares[at][:, None] - 2 * (own[at] @ points.T) + (points * points).sum(axis=1)
            k = d.argmin(axis=1)
            d, k = d[np.arange(len(at)), k].astype(np.int64), node.entries[k]
            better = (d < best[at]) | (d == best[at]) & (k < index[at])
            best[at[better]], index[at[better]] = d[better], k[better]
            return
        first = rows[at, node.axis] < node.cut
        for near, far, mine in ((node.left, node.right, at[first]), (node.right, node.left, at[~first])):
            visit(near, bound(near, mine))
            visit(far, bound(far, mine))

    for a in range(0, len(rows), _ROWS):
        visit(root, np.arange(a, min(a + _ROWS, len(rows))))
    return index, best


def cuts(size: int) -> list[tuple[int, int]]:
    """(from, to) of the parts of vectors of a size; equal where PARTS divides it."""
    return [(size * p // PARTS, size * (p + 1) // PARTS) for p in range(PARTS)]


def _matrices(batch: pa.RecordBatch):
    """(size, row numbers, integers) for each size of vectors in the batch."""
    column = batch.column("q")
    sizes = column.value_lengths().to_numpy()
    flat, begins = column.flatten().to_numpy(), np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, flat[begins[at][:, None] + np.arange(size)]


def _summed(trees):
    def run(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, _, x in _matrices(batch):
                for p, (a, b) in enumerate(cuts(size)):
                    root, entries = trees.value[size][p]
                    k, _ = nearest(root, x[:, a:b])
                    many, sums = total.setdefault((size, p), (np.zeros(entries, np.int64), np.zeros((entries, b - a), np.int64)))
                    many += np.bincount(k, minlength=entries)
                    order = np.argsort(k, kind="stable")
                    first = np.flatnonzero(np.diff(k[order], prepend=-1))
                    sums[k[order][first]] += np.add.reduceat(x[order, a:b], first, axis=0)
        for (size, p), (many, sums) in total.items():
            used = np.flatnonzero(many)
            n = len(used)
            lists = pa.array([[m, *s] for m, s in zip(many[used].tolist(), sums[used].tolist(), strict=True)], pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([size] * n, pa.int32()), pa.array([p] * n, pa.int32()), pa.array(used, pa.int32()), lists], names=["size", "part", "entry", "s"])
        settled()
    return run


def _coded(trees, kept: list[str]):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for size, at, x in _matrices(batch):
                for p, (a, b) in enumerate(cuts(size)):
                    k, d = nearest(trees.value[size][p][0], x[:, a:b])
                    code[at, p] = k
                    error[at] += d
            names = [*kept, "size", "code", "error"]
            text = [row.tobytes().hex() for row in code]
            yield pa.record_batch([*(batch.column(c) for c in kept), batch.column("size"), pa.array(text), pa.array(error)], names=names)
        settled()
    return run


@dataclass
class Codes:
    rows: DataFrame  # (the kept columns, size, code, error)
    books: dict[int, list[np.ndarray]]  # by size of vectors: a codebook for each part


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def _trees(spark: SparkSession, books: dict[int, list[np.ndarray]]):
    """PARTS trees of ENTRIES points for each size of vectors: as large as the codebooks, whatever the number of rows."""
    return spark.sparkContext.broadcast({size: [(tree(b), len(b)) for b in own] for size, own in books.items()})


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> Codes:
    """Codes of all vectors that have no null or non-finite component, with ``vec_id`` and the columns of ``keep``, and the final codebooks.

    Components become floor(1024 x). Each size of vectors has codebooks of its own; where 4 does not divide the size, parts differ by
    one at most, an empty vector's are empty. A codebook starts from the vectors of the 256 smallest vec_ids of its size (of fewer, all); equal ids are ordered by their
    vectors, null ids come last. Integers beyond +-2^27 (less for vectors of over 64 components: all squared distances are below 2^62) count as
    these. Rows that repeat are coded each; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = list(dict.fromkeys((vec_id, *keep)))
    own = vectors.select(*kept, F.col(embedding).cast("array<double>").alias(v := f"{free(vectors)}v"))
    own = own.where(F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    names = [f"c{i}" for i in range(len(kept))]  # whatever the caller's are
    most = F.pow(F.lit(2.0), F.floor((60 - F.log2(F.greatest(F.size(v), F.lit(1)))) / 2))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(2.0**40)), F.lit(-(2.0**40))) * SCALE).cast("double"), most), -most)).cast("long"))
    ready = table(own.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.size(v).alias("size"), whole.alias("q")), "parts")
    books: dict[int, list[np.ndarray]] = {}
    for size in sorted(r["size"] for r in ready.select("size").distinct().collect()):  # sizes of vectors are few
        first = [r["q"] for r in ready.where(F.col("size") == size).orderBy(F.col(names[0]).asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()]
        start = np.array(first, np.int64).reshape(len(first), size)
        books[size] = [start[:, a:b].copy() for a, b in cuts(size)]
    for _ in range(ROUNDS if books else 0):
        trees = _trees(spark, books)
        parts = ready.select("q").mapInArrow(_summed(trees), "size int, part int, entry int, s array<long>")
        sums = parts.select("size", "part", "entry", F.posexplode("s").alias("p", "s")).groupBy("size", "part", "entry", "p").agg(F.sum("s").alias("s"))
        found: dict[tuple[int, int, int], dict[int, int]] = {}
        for r in sums.toLocalIterator():  # an integer for each component of the codebooks, and the counts
            found.setdefault((r["size"], r["part"], r["entry"]), {})[r["p"]] = r["s"]
        trees.destroy()
        for (size, part, entry), s in found.items():
            books[size][part][entry] = [s[i] // s[0] for i in range(1, len(s))]
    trees = _trees(spark, books)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*names).schema)
    rows = table(ready.mapInArrow(_coded(trees, names), f"{fields}, size int, code string, error long"), "codes")
    trees.destroy()
    return Codes(rows.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "size", "code", "error"), books)


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[k] for book, k in zip(books, bytes.fromhex(code), strict=True)]) / SCALE
