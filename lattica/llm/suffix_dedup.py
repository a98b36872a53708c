"""Exact removal of repeated byte strings: a depth-limited radix sort of suffixes in most-significant-digit passes.

Only groups of suffixes that agree on the digits so far go on, and no suffix is compared beyond ``threshold``
bytes, so the groups left are exactly the repeated windows. To move one row for some hundred suffixes, the first
digit is a gram inside the window, the least by hash (its anchor): equal windows have equal anchors at equal
offsets, so all windows in a run that share an anchor pass together.

1. digit ``gram`` bytes at the anchor: runs with a unique anchor have no repeated window.
2. digit the whole run: runs that are equal as a whole are repeated; one of them stands for all. Runs that
   differ from another run of their anchor go on, with their bytes.
3. digit the bytes common to ``BLOCK`` neighbouring windows of such a run, counted from its anchor; then the block
   as a whole, as in pass 2.
4. digit the full threshold, for each window of the blocks that go on.

Equality is that of independent 64-bit hashes of two digits, so of 128 bits where both cover all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, table

#: Bytes hashed at once; tables of powers are twice as long.
PIECE = 1 << 18
BLOCK = 16
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 13)]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^64, and their inverses, for a piece."""
    if not _powers:
        for base in _BASES:
            inverse = np.uint64(pow(int(base), -1, 2**64))
            up, down = np.full(2 * PIECE, base), np.full(2 * PIECE, inverse)
            up[0] = down[0] = 1
            _powers.append((np.cumprod(up), np.cumprod(down)))
    return _powers[which]


class Hashes:
    """Hashes of any substring of up to 2 * PIECE bytes, from sums over prefixes."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _power(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _pieces(offsets: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of a batch: whole texts up to PIECE bytes together; longer texts overlap by threshold - 1."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        if j > i:
            yield int(offsets[i]), int(offsets[j])
            i = j
        else:
            for at in range(int(offsets[i]), int(offsets[i + 1]), PIECE):
                yield at, min(at + PIECE + threshold - 1, int(offsets[i + 1]))
            i += 1


def _runs_of(data: np.ndarray, ends: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number of windows, the anchor's place and hash, hash of the bytes."""
    two = Hashes(data, 1)
    width = threshold - gram + 1
    hashed = Hashes(data, 0).every(gram)
    low = np.uint64((1 << 22) - 1)
    anchor = _sliding_min((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), width) & low
    valid = np.arange(len(anchor)) + threshold <= ends[: len(anchor)]
    fresh = valid.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    start, stop = np.flatnonzero(fresh), np.flatnonzero(last)
    size = stop - start + threshold
    at = anchor[start].astype(np.int64)
    return start, stop - start + 1, at, hashed[at], two.of(start, size)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8), offsets


def _anchored(threshold: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column("text"))
            for at, to in _pieces(offsets, threshold):
                if to - at < threshold:
                    continue
                lo, hi = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, to, side="left")
                bounds = np.clip(offsets[lo : hi + 1], at, to) - at
                ends = np.repeat(bounds[1:], np.diff(bounds))
                start, n, spot, digit, whole = _runs_of(data[at:to], ends, threshold, gram)
                if not len(start):
                    continue
                row = np.searchsorted(offsets, start + at, side="right") - 1
                for a in range(0, len(row), 50_000):
                    cut = slice(a, a + 50_000)
                    took = pa.array(row[cut])
                    yield pa.record_batch(
                        [batch.column("id").take(took), batch.column("th").take(took), pa.array(start[cut] + at - offsets[row[cut]]), pa.array(n[cut].astype(np.int32)), pa.array((spot - start)[cut].astype(np.int32)), *(pa.array(x[cut].view(np.int64)) for x in (digit, whole))],
                        names=["id", "th", "s", "n", "off", "digit", "whole"],
                    )
        settled()
    return run


def _cut_out(threshold: int):
    """The bytes of each of the text's runs."""
    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column("text"))
            runs = batch.column("runs")
            first = np.asarray(runs.offsets)
            s, n, off = (np.asarray(runs.values.field(k)) for k in ("s", "n", "off"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            s, n, off = (x[first[0] : first[-1]] for x in (s, n, off))
            for a in range(0, len(row), 20_000):
                cut = slice(a, a + 20_000)
                took, lo = pa.array(row[cut]), offsets[row[cut]] + s[cut]
                parts = [data[x:y].tobytes() for x, y in zip(lo, lo + n[cut] + threshold - 1, strict=True)]
                yield pa.record_batch([batch.column("id").take(took), batch.column("th").take(took), *(pa.array(x[cut]) for x in (s, n, off)), pa.array(parts, pa.binary())], names=["id", "th", "s", "n", "off", "part"])
        settled()
    return run


def _blocks(threshold: int):
    """Blocks of neighbouring windows, cut at multiples of BLOCK from the anchor: hashes of the common bytes and of all."""
    def run(batches):
        for batch in batches:
            s, n, off = (np.asarray(batch.column(k)).astype(np.int64) for k in ("s", "n", "off"))
            out = [[] for _ in range(5)]
            for i, part in enumerate(batch.column("part")):
                data = np.frombuffer(part.as_buffer(), np.uint8)
                k = np.arange(-(off[i] // BLOCK) - 1, (n[i] - 1 - off[i]) // BLOCK + 1)
                at = off[i] + k * BLOCK
                lo, hi = np.maximum(at, 0), np.minimum(at + BLOCK, n[i])
                at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
                one, two = Hashes(data, 0), Hashes(data, 1)
                for to, x in zip(out, (np.full(len(at), i), lo + s[i], hi - lo, one.of(at + BLOCK - 1, threshold - BLOCK + 1).view(np.int64), two.of(lo, hi - lo - 1 + threshold).view(np.int64)), strict=True):
                    to.append(x)
            if out[0]:
                row, lo, size, digit, whole = (np.concatenate(x) for x in out)
                took = pa.array(row)
                yield pa.record_batch([batch.column("id").take(took), batch.column("th").take(took), pa.array(lo), pa.array(size.astype(np.int32)), batch.column("s").take(took).cast(pa.int32()), pa.array(digit), pa.array(whole)], names=["id", "th", "s", "n", "off", "digit", "whole"])
        settled()
    return run


def _windows(threshold: int):
    """Hash of each window of the blocks in ``runs``, with the hash of its block's common bytes."""
    def run(batches):
        for batch in batches:
            blocks = batch.column("runs")
            first = np.asarray(blocks.offsets)
            at, n, digit = (np.asarray(blocks.values.field(k)) for k in ("s", "n", "digit"))
            s, out = np.asarray(batch.column("s")), [[] for _ in range(4)]
            for i, part in enumerate(batch.column("part")):
                own = slice(first[i], first[i + 1])
                size = n[own].astype(np.int64)
                p = np.repeat(at[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
                hashed = Hashes(np.frombuffer(part.as_buffer(), np.uint8), 1).of(p - s[i], threshold).view(np.int64)
                for to, x in zip(out, (np.full(len(p), i), p, np.repeat(digit[own], size), hashed), strict=True):
                    to.append(x)
            if out[0]:
                row, p, d, w = (np.concatenate(x) for x in out)
                took = pa.array(row)
                yield pa.record_batch([batch.column("id").take(took), batch.column("th").take(took), pa.array(p), pa.array(d), pa.array(w)], names=["id", "th", "s", "digit", "whole"])
        settled()
    return run


def _kept(threshold: int):
    import hashlib

    def run(batches):
        for batch in batches:
            data, offsets = _buffers(batch.column("text"))
            runs = batch.column("runs")
            first = np.asarray(runs.offsets)
            starts, counts = (np.asarray(runs.values.field(k)) for k in ("s", "n"))
            removed, spans, digests = [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                lo, hi = first[i], first[i + 1]
                if lo == hi:
                    removed.append(0), spans.append(0), digests.append(hashlib.sha256(text).hexdigest())
                    continue
                order = np.argsort(starts[lo:hi], kind="stable")
                s = starts[lo:hi][order]
                e = np.maximum.accumulate(s + counts[lo:hi][order] + threshold - 1)
                head = np.concatenate(([True], s[1:] > e[:-1]))
                a, b = s[head], e[np.concatenate((head[1:], [True]))]
                edges = np.concatenate(([0], np.column_stack((a, b)).ravel(), [len(text)]))
                sha = hashlib.sha256()
                for x, y in edges.reshape(-1, 2):
                    sha.update(text[x:y])
                removed.append(int((b - a).sum())), spans.append(len(a)), digests.append(sha.hexdigest())
            yield pa.record_batch([batch.column("id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        settled()
    return run


_ROW = "id long, th long, s long, n int, off int, digit long, whole long"


def _passed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(id, th, s, n) of the rows that equal another one as a whole, and one row each of those that share a digit only.

    Counts are combined before the shuffle and written, so a hot digit's rows can be split in the joins.
    """
    again = table(rows.groupBy("digit").count().where("count > 1").select(F.col("digit").alias("d")), f"{name}-digits")
    live = table(rows.join(again, rows["digit"] == again["d"], "left_semi"), f"{name}-live")
    groups = table(live.groupBy("digit", "whole").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("id", "th", "s", "n", "off"))), f"{name}-groups")
    equal = groups.where("c > 1").select(F.col("digit").alias("d"), F.col("whole").alias("w"))
    whole = live.join(equal, (F.col("digit") == F.col("d")) & (F.col("whole") == F.col("w")), "left_semi").select("id", "th", "s", "n")
    mixed = groups.groupBy("digit").count().where("count > 1").select("digit")
    return whole, groups.join(mixed, "digit")


def repeated_windows(docs: DataFrame, *, threshold: int = 400, gram: int = 100) -> DataFrame:
    """(id, th, s, n): in the text (id, th), the n windows of threshold bytes from s on also start elsewhere.

    docs has id, th (two hashes of the row's id and text, 128 bits together) and text.
    """
    runs = table(docs.mapInArrow(_anchored(threshold, gram), _ROW), "runs")
    whole, unlike = _passed(runs, "runs")
    unlike = unlike.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n", "off")).alias("runs"))
    parts = table(docs.join(unlike, ["id", "th"]).select("id", "th", "text", "runs").mapInArrow(_cut_out(threshold), "id long, th long, s long, n int, off int, part binary"), "parts")
    blocks = table(parts.mapInArrow(_blocks(threshold), _ROW), "blocks")
    block, unlike = _passed(blocks, "blocks")
    unlike = unlike.groupBy("id", "th", F.col("off").cast("long").alias("at")).agg(F.collect_list(F.struct("s", "n", "digit")).alias("runs")).withColumnsRenamed({"id": "i", "th": "t"})
    held = parts.join(unlike, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")) & (F.col("s") == F.col("at"))).select("id", "th", "s", "part", "runs")
    tried = table(held.mapInArrow(_windows(threshold), "id long, th long, s long, digit long, whole long"), "windows")
    twice = table(tried.groupBy("digit", "whole").count().where("count > 1").select(F.col("digit").alias("d"), F.col("whole").alias("w")), "twice")
    single = tried.join(twice, (F.col("digit") == F.col("d")) & (F.col("whole") == F.col("w")), "left_semi").select("id", "th", "s").distinct()
    # neighbouring windows become one row: a place less its rank is the same all along a run
    run = F.col("s") - F.row_number().over(Window.partitionBy("id", "th").orderBy("s"))
    joined = single.select("id", "th", "s", run.alias("run")).groupBy("id", "th", "run").agg(F.min("s").alias("s"), F.count("*").cast("int").alias("n"))
    return whole.union(block).union(joined.select("id", "th", "s", "n"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 400, gram: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removal of every byte of a repeated window.

    A window of threshold bytes counts if it also starts anywhere else in the input, the same text included;
    overlapping windows count. Null texts are empty; texts shorter than the threshold keep all. Rows that repeat
    are copies of each other, so their windows are repeated; each row gives a row. A null id is an id like any
    other here. Other columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("given"), F.coalesce(text, F.lit("")).alias("text"))
    own = own.select("given", F.xxhash64(F.lit(1), "given", "text").alias("id"), F.xxhash64(F.lit(2), "text", "given").alias("th"), "text")
    found = repeated_windows(own.select("id", "th", "text"), threshold=threshold, gram=gram)
    # rows that repeat have the same runs: one of each is enough for all of them
    per = found.groupBy("id", "th").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    none = F.array().cast("array<struct<s:bigint,n:int>>")
    out = own.join(per, ["id", "th"], "left").select(F.col("given").alias("id"), "text", F.coalesce("runs", none).alias("runs"))
    return out.mapInArrow(_kept(threshold), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", "doc_id")
