"""Near-duplicate documents by DartMinHash over weighted word shingles.

Darts are thrown once for all documents: every shingle has a Poisson number of darts in each cell of a grid over
(weight, rank), both fixed by hashes. A document is hit by the darts below its shingle's weight; for each of the
``k`` coordinates it keeps the dart of least rank. Only cells with ranks that the document needs are looked at, so
a signature costs about k log k darts, however long the text. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. Bands of coordinates are joined; each pair found is then checked
against the exact similarity of the shingle counts, so no pair below the threshold is linked.

Texts with the same words are one text first. In a band's bucket every text is compared with the bucket's least one,
its hub; what that proves joined needs no other comparison. Buckets of three or more that still hold several
components are compared in full, but inside tasks: a bucket is dealt into chunks of about ``CHUNK`` texts, a large
component into chunks of its own; each pair of chunks that can join something is a task, and it returns only links that do.
No pair of a bucket is left out unless its texts are joined already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, settled, table

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 6 coordinates: two texts of similarity 0.8 miss all bands with probability 6e-5, of 0.85 with 4e-8.
BANDS, ROWS = 32, 6
_WORD = re.compile(r"\w+")
#: Texts in a chunk of a bucket.
CHUNK = 512
#: Rank strips: strip 0 is [0, 2^-4), strip i is [2^(i-5), 2^(i-4)).
_STRIPS, _LOW = 24, 4


class _WordHashes(dict):
    """Hashes of the words met so far, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _WordHashes()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles and their counts. Fewer words than size make one shingle; no words none."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + n])
    return np.unique(out, return_counts=True)


def elements_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles, each repetition of a shingle with a hash of its own: a set whose Jaccard similarity is the weighted one."""
    hashed, count = shingles_of(words_of(text), size)
    out = np.repeat(hashed, count)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    again = nth > 0
    out[again] = _mix(out[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a cell of this area, up to where it is 1."""
    n = np.arange(int(area + 12 * np.sqrt(area) + 20))
    logs = n * np.log(area) - area - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, len(n))))))
    return np.cumsum(np.exp(logs))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """owners x k dart ids (uint64). elements: hashes; weights: counts of at least 1; owner: row of each element.

    Every owner must have an element.
    """
    total = np.bincount(owner, weights, owners)
    need = (k * np.log(k) + 2 * k) / total
    upto = np.clip(np.ceil(np.log2(need)).astype(int) + _LOW, 0, _STRIPS - 1)  # the last strip that a document needs
    sig = np.zeros(owners * k, np.uint64)
    rank = np.full(owners * k, np.inf)
    done_upto = np.full(owners, -1)
    open_ = np.ones(owners, bool)
    while open_.any():
        for strip in range(upto[open_].max() + 1):
            use = open_ & (strip <= upto) & (strip > done_upto)
            if use.any():
                own = np.flatnonzero(use[owner])
                _throw(elements[own], weights[own], owner[own], strip, k, sig, rank)
        done_upto[open_] = upto[open_]
        open_ = np.isinf(rank.reshape(owners, k)).any(axis=1)  # a coordinate without a dart: one strip more
        upto[open_] += 1
    return sig.reshape(owners, k)


def _throw(elements, weights, owner, strip, k, sig, rank) -> None:
    lo, hi = (0.0 if strip == 0 else 2.0 ** (strip - _LOW - 1)), 2.0 ** (strip - _LOW)
    level, floor, top = 0, 0.0, 1.0
    while len(elements):
        cell = _mix(elements ^ np.uint64(((strip << 8) | level) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
        n = np.searchsorted(_poisson((hi - lo) * (top - floor)), (cell >> np.uint64(11)) * 2.0**-53, side="right")
        hit = np.flatnonzero(n)
        count = n[hit]
        at = np.repeat(hit, count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = _mix(cell[at] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        if level:  # the cell reaches beyond some weights
            height = floor + (top - floor) * ((_mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)) * 2.0**-53)
            kept = height < weights[at]
            at, dart = at[kept], dart[kept]
        where = owner[at] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        deep = lo + (hi - lo) * ((_mix(dart ^ np.uint64(0x5A5A5A5A5A5A5A5A)) >> np.uint64(11)) * 2.0**-53)
        near = np.flatnonzero(deep < rank[where])
        where, deep, dart = where[near], deep[near], dart[near]
        order = np.argsort(-deep)
        where, deep, dart = where[order], deep[order], dart[order]
        best = np.full(len(rank), -1, np.int64) if len(where) > len(rank) // 4 else None
        if best is not None:
            best[where] = np.arange(len(where))
            spots = np.flatnonzero(best >= 0)
            pick = best[spots]
        else:
            spots, last = np.unique(where[::-1], return_index=True)
            pick = len(where) - 1 - last
        better = deep[pick] < rank[spots]
        rank[spots[better]], sig[spots[better]] = deep[pick[better]], dart[pick[better]]
        level, floor, top = level + 1, top, top * 2
        more = weights > floor
        elements, weights, owner = elements[more], weights[more], owner[more]


def _signed(bands: int, rows: int, size: int):
    """(id, words, buckets, sig) of each text with words: a hash of its words, a key per band, a byte per coordinate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for a in range(0, batch.num_rows, 256):
                words = [words_of(t.as_py()) for t in texts.slice(a, 256)]
                some = np.flatnonzero([len(w) for w in words])
                if not len(some):
                    continue
                found = [shingles_of(words[i], size) for i in some]
                lens = np.array([len(e) for e, _ in found])
                sig = signatures(np.concatenate([e for e, _ in found]), np.concatenate([n for _, n in found]).astype(float), np.repeat(np.arange(len(some)), lens), len(some), bands * rows)
                in_bands = sig.reshape(len(some), bands, rows)
                key = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(some), 0)
                for j in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + in_bands[:, :, j])
                yield pa.record_batch(
                    [ids.take(pa.array(a + some)), pa.array([xxhash.xxh3_128_digest(" ".join(words[i])) for i in some], pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64())), pa.array([row.tobytes() for row in (sig & np.uint64(255)).astype(np.uint8)], pa.binary())],
                    names=["id", "words", "buckets", "sig"],
                )
        _hashes.clear()
        settled()
    return run


def _elements(size: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(a, 256).to_pylist()
                found = [elements_of(t, size).tobytes() for t in texts]
                words = [xxhash.xxh3_128_digest(" ".join(words_of(t))) for t in texts]
                yield pa.record_batch([batch.column("id").slice(a, 256), pa.array(words, pa.binary()), pa.array(found, pa.binary())], names=["rep", "words", "elements"])
        _hashes.clear()
        settled()
    return run


def _least(threshold: float, k: int) -> float:
    """Share of coordinates that two texts of the threshold's similarity agree in, less six standard deviations."""
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / k)


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _linked(threshold: float):
    """The pairs (a, b) whose texts are similar enough."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.as_buffer() for x in batch.column(c)), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            likely = (sa == sb).mean(axis=1) >= _least(threshold, sa.shape[1])
            ea, eb = batch.column("ea"), batch.column("eb")
            kept = [i for i in np.flatnonzero(likely).tolist() if _jaccard(*(np.frombuffer(e[i].as_buffer(), np.uint64) for e in (ea, eb))) >= threshold]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
    return run


def _shared(elements: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets."""
    n = len(elements)
    out = np.zeros((n, n), np.int32)
    every, owner = np.concatenate(elements), np.repeat(np.arange(n), [len(e) for e in elements])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    size = np.diff(np.append(starts, len(every)))
    for start, many in zip(starts[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        own = owner[start : start + many]
        out[own[:, None], own] += 1
    return out


def _chunk_links(threshold: float):
    """Links between the components of one pair of chunks that join something."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rep, c, chunk = (rows.column(x).to_numpy() for x in ("rep", "c", "chunk"))
        sig = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("sig")])
        elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("elements")]
        cross = rows.column("ca")[0].as_py() != rows.column("cb")[0].as_py()
        least, pairs = _least(threshold, sig.shape[1]), []
        for i in range(len(rep) - 1):
            able = (c[i + 1 :] != c[i]) & ((chunk[i + 1 :] != chunk[i]) | (not cross))
            at = np.flatnonzero(able) + i + 1
            at = at[(sig[at] == sig[i]).mean(axis=1) >= least]
            pairs += [(i, j) for j in at.tolist()]
        counts = _shared(elements) if len(pairs) > 4 * len(rep) else None
        up = {x: x for x in c.tolist()}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for i, j in pairs:
            x, y = top(int(c[i])), top(int(c[j]))
            if x != y:
                if counts is None:
                    similar = _jaccard(elements[i], elements[j])
                else:
                    similar = counts[i, j] / (len(elements[i]) + len(elements[j]) - counts[i, j])
                if similar >= threshold:
                    up[max(x, y)] = min(x, y)
                    out.append((int(rep[i]), int(rep[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, class_id (the least doc_id of its class) and kept (doc_id = class_id).

    Words are runs of letters, digits and underscores in lower case; a text's shingles are its runs of ``size`` words,
    with their counts as weights; fewer words make one shingle. Texts with the same words, or linked by a similarity
    of at least ``threshold``, are of one class, and so is what links reach. Null texts, empty texts and texts without
    words are alone. Rows that repeat a doc_id are one document. A row with a null doc_id is alone, its class null.
    Other columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    signed = table(own.where("id is not null").mapInArrow(_signed(bands, rows, size), "id long, words binary, buckets array<long>, sig binary"), "signed")
    firsts = table(signed.groupBy("words").agg(F.min("id").alias("rep")), "firsts")
    reps = firsts.select(F.col("rep").alias("id")).distinct()
    spread = signed.join(reps, "id", "left_semi").select(F.col("id").alias("rep"), F.explode("buckets").alias("bucket"))
    crowded = table(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1").select(F.col("bucket").alias("k"), "hub"), "crowded")
    members = table(spread.join(crowded, F.col("bucket") == F.col("k")).select("bucket", "rep", "hub"), "members")
    meant = members.select(F.col("rep").alias("id")).distinct()
    # a row for each of the texts of an id: texts with the same words have the same signature
    texts = own.join(meant, "id").mapInArrow(_elements(size), "rep long, words binary, elements binary")
    texts = texts.groupBy("rep", "words").agg(F.min("elements").alias("elements"))
    texts = texts.join(signed.groupBy(F.col("id").alias("rep"), "words").agg(F.min("sig").alias("sig")), ["rep", "words"])
    texts = table(texts.select("rep", "sig", "elements"), "texts")

    left, right = (texts.withColumnsRenamed({"rep": x, "sig": f"s{x}", "elements": f"e{x}"}) for x in ("a", "b"))
    pairs = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb", "ea", "eb")
    links = table(pairs.mapInArrow(_linked(threshold), "a long, b long"), "links")
    labels = components(links)

    # of a bucket of two, the only pair has been compared
    rest = table(members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c")), "rest")
    sizes = table(rest.groupBy("bucket", "c").agg(F.count("*").alias("n")), "sizes")
    several = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1 and n > 2").select("bucket")
    # a component of more than a chunk has chunks of its own, which are not compared with each other; the others share chunks
    parts = sizes.join(several, "bucket", "left_semi").groupBy("bucket", F.when(F.col("n") > CHUNK, F.col("c")).alias("own")).agg(F.sum("n").alias("n"))
    parts = parts.withColumn("k", F.ceil(F.col("n") / CHUNK).cast("int"))
    of_bucket = Window.partitionBy("bucket")  # a row for each chunk of the bucket at most
    parts = parts.withColumns({"upto": F.sum("k").over(of_bucket.orderBy(F.col("own").asc_nulls_first())), "chunks": F.sum("k").over(of_bucket)})
    parts = table(parts.select(F.col("bucket").alias("b"), "own", (F.col("upto") - F.col("k")).cast("int").alias("first"), "k", F.col("chunks").cast("int").alias("chunks")), "parts")
    large, shared = parts.where("own is not null"), parts.where("own is null")
    at_home = (F.col("bucket") == F.col("b")) & (F.col("c") == F.col("own"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    alone = rest.join(large, at_home).withColumn("others", F.filter(every, lambda o: (o < F.col("first")) | (o >= F.col("first") + F.col("k"))))
    mixed = rest.join(large, at_home, "left_anti").join(shared, F.col("bucket") == F.col("b")).withColumn("others", every)
    dealt = alone.unionByName(mixed).withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = dealt.select("bucket", "rep", "c", "chunk", F.explode("others").alias("other"))
    dealt = table(dealt.select("bucket", "rep", "c", "chunk", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb")), "dealt")
    more = dealt.join(texts, "rep").groupBy("bucket", "ca", "cb").applyInArrow(_chunk_links(threshold), "a long, b long")
    more = table(more, "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    of = signed.select("id", "words").join(firsts, "words").groupBy("id").agg(F.min("rep").alias("rep"))
    of = of.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    out = docs.select(F.col(doc_id).cast("long").alias("id")).join(of, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept"))
