"""Stacks of matrices as rows ``(view, row, v)``: row numbers from 0, v an array of one length; and tensors of them.

A tensor has the axes row, view and place in v. Transposing, products of rows with rows and Fourier transforms shuffle blocks
of columns; a task holds one block, whose width follows from the size, so its memory is bounded whatever the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.eigen import _array, _groups, _lists, leading
from lattica.plans.staging import staged

#: Numbers (of 8 bytes, or complex ones of 16) that a block has at most, unless one column has more.
BLOCK = 1 << 20
EPSILON = 1e-6
#: Numbers of all views together (8 bytes each) up to which one task runs all rounds of ``low_rank``: fewer than one of its shuffles is worth.
SMALL = 2_000_000


def shrunk(s: np.ndarray, c: float, mode: str = "reference") -> np.ndarray:
    """Singular values after the weighted nuclear norm's proximal step; those that do not survive are 0.

    mode "reference" keeps S - eps + sqrt(t); "textbook" halves it. t = (S - eps)^2 - 4 (C - eps S).
    """
    t = (s - EPSILON) ** 2 - 4 * (c - EPSILON * s)
    kept = s - EPSILON + np.sqrt(np.maximum(t, 0))
    return np.where(t > 0, kept if mode == "reference" else kept / 2, 0)


def prox_slice(y: np.ndarray, c: float, mode: str = "reference") -> np.ndarray:
    """One frontal slice in the Fourier domain. In mode "reference" the right factor is the published one: the first columns of the conjugate transpose, transposed again."""
    u, s, vh = np.linalg.svd(y, full_matrices=False)
    values = shrunk(s, c, mode)
    r = int((values > 0).sum())
    return (u[:, :r] * values[:r]) @ (vh[:, :r].T if mode == "reference" else vh[:r])


def prox_tensor(y: np.ndarray, c: float, mode: str = "reference") -> np.ndarray:
    """The proximal step on a whole tensor: Fourier transform on all axes, slices along the last one, and back."""
    z = np.fft.fftn(y)
    for i in range(z.shape[2]):
        z[:, :, i] = prox_slice(z[:, :, i], c, mode)
    return np.fft.ifftn(z).real


def _top(a, k):
    return np.linalg.eigh((a + a.T) / 2)[1][:, ::-1][:, :k]


def _projector(a: np.ndarray, z: np.ndarray, p: np.ndarray, q: np.ndarray, k: int, lam: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One view's step: its new P and Q, and its part of the objective."""
    h = _top(lam * a + q[:, None] * ((z + z.T) / 2 - p / 2) * q[None], k)
    hh = h @ h.T
    new = 1 / np.sqrt(np.maximum(np.diag(hh), 1e-12))
    return new[:, None] * hh * new[None], new, lam / 2 * float(np.linalg.norm(a - hh))


def low_rank_rounds(views: list[np.ndarray], k: int, lam: float, rho: float, *, iterations: int = 100, tol: float = 1e-3, mode: str = "reference", least: bool = False) -> tuple[list[np.ndarray], list[float]]:
    """The rounds of ``low_rank`` on matrices in memory: the smoothed projectors, and the objective per round."""
    size = len(views[0])
    z, p, q = [np.zeros((size, size)) for _ in views], [np.zeros((size, size)) for _ in views], [np.ones(size) for _ in views]
    losses: list[float] = []
    best = p
    while len(losses) < iterations:
        first = 0.0
        for v, a in enumerate(views):
            p[v], q[v], loss = _projector(a, z[v], p[v], q[v], k, lam)
            first += loss
        back = prox_tensor(np.stack(p, axis=1), rho, mode)  # S x views x S
        z = [back[:, v] for v in range(len(views))]
        losses.append(first + sum(0.5 * float(np.linalg.norm(x - y)) for x, y in zip(z, p, strict=True)))
        if losses[-1] < min(losses[:-1], default=float("inf")):
            best = list(p)
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) < tol * max(abs(losses[-2]), 1e-12):
            break
    return (best, losses[: losses.index(min(losses)) + 1]) if least and losses else (p, losses)


def entries(rows: DataFrame) -> DataFrame:
    """(view, row, col, x) of rows."""
    return rows.select("view", "row", F.posexplode("v").alias("col", "x"))


def _size(rows: DataFrame) -> tuple[int, int]:
    """Rows of a view, and views."""
    return tuple(rows.agg(F.coalesce(F.max("row"), F.lit(-1)) + 1, F.count_distinct("view")).first())


def _chunks(rows: DataFrame, width: int) -> DataFrame:
    """(view, row, b, part): the rows cut every ``width`` places."""
    count = F.ceil(F.size("v") / width).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice("v", b * width + 1, F.lit(width)))
    return rows.select("view", "row", F.posexplode(parts).alias("b", "part"))


def transposed(rows: DataFrame) -> DataFrame:
    """(view, row, v): each view's transpose; one shuffle of blocks of columns."""
    size, _ = _size(rows)
    width = max(1, BLOCK // max(size, 1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("e")[i].values
                m = _lists(block.field("part"))[np.argsort(block.field("row").to_numpy())].T
                first, view = batch.column("b")[i].as_py() * width, batch.column("view")[i].as_py()
                yield pa.record_batch([pa.array([view] * len(m), pa.int32()), pa.array(np.arange(first, first + len(m))), _array(m)], names=["view", "row", "v"])

    blocks = _chunks(rows, width).groupBy("view", "b").agg(F.collect_list(F.struct("row", "part")).alias("e"))
    return blocks.mapInArrow(run, "view int, row long, v array<double>")


def outer(rows: DataFrame) -> DataFrame:
    """(view, row, v): M M' of each view's M, a few columns wide. Blocks of rows meet in tasks; a row's blocks are put together by a shuffle."""
    width = 1024

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("l")[i].values, batch.column("r")[i].values
                a = _lists(left.field("v"))
                m = a @ _lists(right.field("v"))[np.argsort(right.field("row").to_numpy())].T
                n = len(a)
                yield pa.record_batch([pa.array([batch.column("view")[i].as_py()] * n, pa.int32()), left.field("row"), pa.array([batch.column("b2")[i].as_py()] * n, pa.int32()), _array(m)], names=["view", "row", "b", "part"])

    blocks = staged(rows.groupBy("view", F.floor(F.col("row") / width).cast("int").alias("b")).agg(F.collect_list(F.struct("row", "v")).alias("l")))
    right = blocks.select(F.col("view").alias("view2"), F.col("b").alias("b2"), F.col("l").alias("r"))
    made = blocks.join(right, F.col("view") == F.col("view2")).select("view", "b2", "l", "r").mapInArrow(run, "view int, row long, b int, part array<double>")
    return made.groupBy("view", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", "part"))), lambda e: e["part"])).alias("v"))


_COMPLEX = "view int, row long, b int, re array<double>, im array<double>"


def _sliced(rows: DataFrame, solve: Callable[[np.ndarray], np.ndarray], forth: Callable, back: Callable) -> DataFrame:
    """Rows after ``forth`` along v; ``solve`` on each block rows x views x columns of the whole tensor; and ``back`` along v."""
    size, views = _size(rows)
    width = max(1, BLOCK // max(size * views, 1))

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                z = forth(_lists(batch.column("v")))
                for b in range(-(-z.shape[1] // width)):
                    part = z[:, b * width : (b + 1) * width]
                    yield pa.record_batch([batch.column("view"), batch.column("row"), pa.array([b] * len(z), pa.int32()), _array(part.real), _array(part.imag)], names=["view", "row", "b", "re", "im"])

    def solved(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                e = batch.column("e")[i].values
                z = _lists(e.field("re")) + 1j * _lists(e.field("im"))
                view, row = e.field("view").to_numpy(), e.field("row").to_numpy()
                order = np.lexsort((view, row))
                z = solve(z[order].reshape(size, views, -1)).reshape(len(z), -1)
                yield pa.record_batch([pa.array(view[order]), pa.array(row[order]), pa.array([batch.column("b")[i].as_py()] * len(z), pa.int32()), _array(z.real), _array(z.imag)], names=["view", "row", "b", "re", "im"])

    def joined(batches):
        for batch in batches:
            if batch.num_rows:
                z = _lists(batch.column("re")) + 1j * _lists(batch.column("im"))
                yield pa.record_batch([batch.column("view"), batch.column("row"), _array(back(z).real)], names=["view", "row", "v"])

    blocks = rows.mapInArrow(cut, _COMPLEX).groupBy("b").agg(F.collect_list(F.struct("view", "row", "re", "im")).alias("e"))
    parts = F.array_sort(F.collect_list(F.struct("b", "re", "im")))
    whole = blocks.select("b", "e").mapInArrow(solved, _COMPLEX).groupBy("view", "row").agg(parts.alias("p"))
    whole = whole.select("view", "row", F.flatten("p.re").alias("re"), F.flatten("p.im").alias("im"))
    return whole.mapInArrow(joined, "view int, row long, v array<double>")


def prox(rows: DataFrame, c: float, mode: str = "reference") -> DataFrame:
    """The weighted nuclear norm's proximal step: Fourier transform on all axes, slices at the places of v, and back. A slice is one task's."""
    def solve(z: np.ndarray) -> np.ndarray:
        z = np.fft.fft(np.fft.fft(z, axis=0), axis=1)
        for i in range(z.shape[2]):
            z[:, :, i] = prox_slice(z[:, :, i], c, mode)
        return np.fft.ifft(np.fft.ifft(z, axis=1), axis=0)

    return _sliced(rows, solve, lambda v: np.fft.fft(v, axis=1), lambda z: np.fft.ifft(z, axis=1))


def svt(rows: DataFrame, tau: float) -> DataFrame:
    """Soft threshold of the singular values of each slice of the transform along the views; slices are rows x places of v, one task's each."""
    _, views = _size(rows)

    def along(name: str, fourier: Callable):
        """Transforms a row's views together: (view, row, re, im) from (row, e)."""
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    e = batch.column("e")[i].values
                    z = _lists(e.field("re")) + 1j * _lists(e.field("im"))
                    z = fourier(z[np.argsort(e.field("view").to_numpy())], axis=0)
                    yield pa.record_batch([pa.array(np.arange(len(z), dtype=np.int32)), pa.array([batch.column("row")[i].as_py()] * len(z), pa.int64()), _array(z.real), _array(z.imag)], names=["view", "row", "re", "im"])

        return lambda df: df.groupBy("row").agg(F.collect_list(F.struct("view", "re", "im")).alias("e")).mapInArrow(run, "view int, row long, re array<double>, im array<double>")

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        z = _lists(table.column("re").combine_chunks()) + 1j * _lists(table.column("im").combine_chunks())
        order = np.argsort(table.column("row").to_numpy())
        u, s, vh = np.linalg.svd(z[order], full_matrices=False)
        z = (u * np.maximum(s - tau, 0)) @ vh
        return pa.table([table.column("view"), table.column("row").take(pa.array(order)), _array(z.real), _array(z.imag)], names=["view", "row", "re", "im"])

    ids = rows.select("view").distinct().orderBy("view").collect()  # slices are few
    number = F.lit(0)
    for i, r in enumerate(ids):
        number = F.when(F.col("view") == r["view"], F.lit(i)).otherwise(number)
    flat = rows.select(number.cast("int").alias("view"), "row", F.col("v").alias("re"), F.transform("v", lambda x: x * 0).alias("im"))
    slices = along("slices", np.fft.fft)(flat).groupBy("view").applyInArrow(solve, "view int, row long, re array<double>, im array<double>")
    given = F.lit(None).cast("int")
    for i, r in enumerate(ids):
        given = F.when(F.col("view") == i, F.lit(r["view"])).otherwise(given)
    return along("views", np.fft.ifft)(slices).select(given.alias("view"), "row", F.col("re").alias("v"))


def of_rows(rows: DataFrame, width: int) -> Callable[[DataFrame], DataFrame]:
    """The operator of symmetric matrices ``(view, row, v)``, a group for each view: a row meets its entries of x, and
    tasks add up its products; sums of size x width numbers for each view leave a task."""
    def part(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, at in _groups(batch) if batch.num_rows else ():
                at = pa.array(at)
                total[g] = total.get(g, 0) + _lists(batch.column("v").take(at)).T @ _lists(batch.column("x").take(at))
        for g, m in total.items():
            yield pa.record_batch([pa.array([g] * len(m), pa.int64()), pa.array(np.arange(len(m))), *(pa.array(np.ascontiguousarray(m[:, c])) for c in range(width))], names=["g", "row", *(f"x{c}" for c in range(width))])

    def product(x: DataFrame) -> DataFrame:
        met = x.join(rows.select(F.col("view").cast("long").alias("g"), "row", "v"), ["g", "row"])
        sums = met.select("g", "v", "x").mapInArrow(part, "g long, row long, " + ", ".join(f"x{c} double" for c in range(width)))
        sums = sums.groupBy("g", "row").agg(*[F.sum(f"x{c}").alias(f"x{c}") for c in range(width)])
        return sums.select("g", "row", F.array(*[f"x{c}" for c in range(width)]).alias("w"))

    return product


def low_rank(views: DataFrame, k: int, lam: float, rho: float, *, iterations: int = 100, tol: float = 1e-3, mode: str = "reference", extra: int = 4, small: int = SMALL, least: bool = False) -> tuple[DataFrame, list[float]]:
    """Consensus of several similarity matrices ``(view, row, v)`` of the same rows: (view, row, v) of the smoothed projectors, and the objective per round.

    Per round and view: the k leading eigenvectors H of lambda A + Q (sym Z - half P) Q, Q the inverse root diagonal of H H',
    P = Q H H' Q; then Z by the proximal step on all P as a tensor. Rounds end when the objective changes by less than tol of it. Every matrix stays rows of tables, each
    round's are written; the driver sees the Gram matrices of the eigenvectors and the objective. Up to ``small`` numbers of all views one task runs the same rounds.
    The published iteration ends with its last round, whose objective may be above the first. With ``least`` all rounds run too, and the result is the round of least
    objective (of equals the first), the objectives those up to it.
    """
    raw = staged(views.select(F.col("view").cast("int").alias("view"), F.col("row").cast("long").alias("row"), "v"))
    size, many = _size(raw)
    if size * size * many <= small:
        return _in_one_task(raw, k, lam, rho, iterations, tol, mode, least)
    a = staged(symmetric(raw))
    zero = F.array_repeat(F.lit(0.0), size)
    z = p = a.select("view", "row", zero.alias("v"))
    q = a.select("view", "row", F.lit(1.0).alias("q"))
    losses: list[float] = []
    best = p
    named = lambda df, c: df.withColumnRenamed("v", c)
    while len(losses) < iterations:
        all_q = q.groupBy("view").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "q"))), lambda e: e["q"]).alias("qs"))  # a row for each view
        met = a.join(named(z, "z"), ["view", "row"]).join(named(p, "p"), ["view", "row"]).join(q, ["view", "row"]).join(all_q, "view")
        pulled = F.zip_with(F.zip_with("z", "p", lambda x, y: x - y / 2), "qs", lambda x, s: x * s)
        g = staged(met.select("view", "row", F.zip_with("v", F.transform(pulled, lambda x: x * F.col("q")), lambda x, y: x * lam + y).alias("v")))
        h, _ = leading(g.select(F.col("view").cast("long").alias("g"), "row"), of_rows(g, k + extra), k, extra=extra, tol=1e-9)
        h = h.select(F.col("g").cast("int").alias("view"), "row", "v", (1 / F.sqrt(F.greatest(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), F.lit(1e-12)))).alias("q"))
        q = staged(h.select("view", "row", "q"))
        p = staged(outer(h.select("view", "row", F.transform("v", lambda x: x * F.col("q")).alias("v"))))
        back = staged(prox(p, rho, mode))
        z = staged(symmetric(back))
        all_q = q.groupBy("view").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "q"))), lambda e: e["q"]).alias("qs"))
        squares = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e)
        far = raw.join(named(p, "p"), ["view", "row"]).join(named(back, "z"), ["view", "row"]).join(q, ["view", "row"]).join(all_q, "view")
        plain = F.zip_with("v", F.zip_with("p", "qs", lambda x, s: x / s / F.col("q")), lambda x, y: x - y)
        off = far.select("view", squares(plain).alias("a"), squares(F.zip_with("z", "p", lambda x, y: x - y)).alias("z")).groupBy("view").agg(F.sqrt(F.sum("a")).alias("a"), F.sqrt(F.sum("z")).alias("z"))
        one = off.agg(F.coalesce(F.sum(F.col("a") * lam / 2 + F.col("z") / 2), F.lit(0.0))).first()[0]
        losses.append(one)
        if one < min(losses[:-1], default=float("inf")):
            best = p
        if len(losses) > 1 and abs(losses[-2] - one) < tol * max(abs(losses[-2]), 1e-12):
            break
    return (best, losses[: losses.index(min(losses)) + 1]) if least and losses else (p, losses)


def _in_one_task(rows: DataFrame, k: int, lam: float, rho: float, iterations: int, tol: float, mode: str, least: bool) -> tuple[DataFrame, list[float]]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("view", "ascending"), ("row", "ascending")]).combine_chunks()
        view, m = table.column("view").to_numpy(), _lists(table.column("v").combine_chunks())
        ids = np.unique(view)
        found, losses = low_rank_rounds([m[view == i] for i in ids], k, lam, rho, iterations=iterations, tol=tol, mode=mode, least=least)
        made = [*np.concatenate(found).tolist(), losses]
        return pa.table({"view": pa.array([*view.tolist(), None], pa.int32()), "row": pa.array([*table.column("row").to_pylist(), None], pa.int64()), "v": pa.array(made, pa.list_(pa.float64()))})

    made = staged(rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: run(t.select(["view", "row", "v"])), "view int, row long, v array<double>"))
    last = made.where("view is null").first()
    return made.where("view is not null"), list(last["v"]) if last else []


def symmetric(rows: DataFrame) -> DataFrame:
    """(view, row, v): halves of each view and its transpose together."""
    return rows.join(transposed(rows).withColumnRenamed("v", "t"), ["view", "row"]).select("view", "row", F.zip_with("v", "t", lambda x, y: (x + y) / 2).alias("v"))
