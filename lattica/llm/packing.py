"""Packing of token sequences by best-fit decreasing.

Documents become token ids plus an end id; a longer one is first cut into full windows and a rest. Best-fit decreasing
puts pieces, longest first, into the open window of least sufficient capacity, which a segment tree over
capacities finds. Pieces of one length are interchangeable, so the plan needs their numbers per length only (at
most ``window`` of them) and works on groups of windows that were filled alike. The plan says for each length which
ranks go to which windows at which offset. Pieces are dealt into ranges of length, so a length lies in neighbouring ranges
only: counts per range and length are as many as lengths and ranges together, and give each piece its rank. Each piece then
looks up its place on its own.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, table

WINDOW, END = 4096, 2
#: Bytes of words and ids that a worker remembers, some 35 MB with their overhead; longer words than LONG are not remembered.
HELD, LONG = 4 << 20, 64
_kept: dict[tuple[str, int], "Ids"] = {}
#: Letters up to U+024F and common punctuation: composed already, and one character's lower case does not depend on its
#: neighbours. Without the separators on which patterns' white space differs.
_PLAIN = re.compile(r"[^\x1c-\x1f\u0250-\uffff\U00010000-\U0010ffff]*(?:[\u2010-\u2027\u2030-\u205e\u20ac]+[^\x1c-\x1f\u0250-\uffff\U00010000-\U0010ffff]*)*")


class Ids:
    """Token ids of texts.

    A plain text is cut into words by the tokenizer file's own pattern, and each word that is new goes through the file's
    model, many at a time. Words are remembered in two generations of ``held`` bytes each: when the younger one is full it
    becomes the older one, and words met again move to the younger one, so frequent words stay. All other texts go through the
    whole tokenizer.
    """

    def __init__(self, path: str, held: int = HELD):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        split, _ = said["pre_tokenizer"]["pretokenizers"]
        # the pattern with the plain texts' letters and numbers spelled out, which the quicker library takes
        pattern = split["pattern"]["Regex"]
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{kind}}}", "".join(re.escape(c) for c in map(chr, range(0x250)) if regex.match(rf"\p{{{kind}}}", c)))
        self.cut = re.compile(pattern)
        self.added = [t["content"] for t in said["added_tokens"]]
        self.parts = Tokenizer(self.tokenizer.model)  # the same model, without normalizer and added tokens
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = said["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size, self.held = 0, held

    def _learn(self, new: list[str], known: dict[str, bytes]) -> None:
        for a in range(0, len(new), 4096):
            some = new[a : a + 4096]
            ids = np.array(self.parts.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(some):
                raise ValueError("the tokenizer's model does not mark the ends of words")
            data, start = ids.tobytes(), 0
            for word, stop in zip(some, stops.tolist(), strict=True):
                known[word] = data[start:stop]
                start = stop

    def _looked_up(self, words: list[str]) -> bytes:
        """The ids of words, one after the other."""
        known, older, more = self.known, self.older, {}
        if new := set(words).difference(known):
            unknown = []
            for word in new:
                ids = older.get(word)
                if ids is None:
                    unknown.append(word)
                else:
                    more[word] = ids
            if unknown:
                self._learn(unknown, more)
            short = {w: x for w, x in more.items() if len(w) <= LONG}
            known.update(short)
            self.size += sum(map(len, short)) + sum(map(len, short.values()))
            if len(short) < len(more):
                out = b"".join([known[w] if w in known else more[w] for w in words])
            else:
                out = b"".join(map(known.__getitem__, words))
            if self.size > self.held:
                self.older, self.known, self.size = known, {}, 0
            return out
        return b"".join(map(known.__getitem__, words))

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = self.cut.findall
        out = []
        for text in texts:
            if _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
                out.append(self._looked_up(cut(text.lower())))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


def _pieces(path: str, window: int, end: int, held: int, keep: bool):
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        if (path, held) not in _kept:
            _kept.clear()  # one tokenizer at a time
            _kept[path, held] = Ids(path, held)
        ids = _kept[path, held]
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, batch.num_rows, 200):
                out = [[] for _ in range(5)]
                for i, data in enumerate(ids.of([t.as_py() for t in texts.slice(a, 200)])):
                    data += last
                    n = len(data) // 4
                    for start in range(0, n, window):
                        part = data[4 * start : 4 * (start + window)]
                        for to, x in zip(out, (a + i, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            to.append(x)
                yield pa.record_batch([docs.take(pa.array(out[0])), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        if not keep:
            del ids
            _kept.clear()
        settled()
    return run


class Capacities:
    """Segment tree over capacities 0..size: which have open windows, and the least one from a capacity on."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)

    def put(self, capacity: int, some: bool) -> None:
        i = capacity + self.leaves
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The least capacity >= least with an open window."""
        i = least + self.leaves
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces of each length.

    Returns rows (length, rank, sequence, offset, each): pieces of that length from that rank on fill window after window
    from ``sequence`` on, ``each`` pieces in a window, the first at ``offset``; a row holds until the next one's rank.
    """
    tree, groups, rows, made = Capacities(window), {}, [], 0  # groups: capacity -> [(first window, number of windows)]

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            if not groups.get(capacity):
                tree.put(capacity, True)
            groups.setdefault(capacity, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, fit = window, window // length
                first, n = made, -(-left // fit)
                made += n
            else:
                first, n = groups[capacity].pop()
                if not groups[capacity]:
                    tree.put(capacity, False)
                fit = capacity // length
            full = min(n, left // fit)  # windows that take all they can, one after the other
            if full:
                rows.append((length, rank, first, window - capacity, fit))
                put(capacity - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if left and full < n:  # the rest of the pieces goes to one window
                rows.append((length, rank, first + full, window - capacity, left))
                put(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(capacity, first + full, n - full)
    return rows


def _ranked(batches):
    """Adds each piece's place among those of its length in its range; rows come sorted by length, a range is a task."""
    held = [-1, 0]  # the last length and how many of it came
    for batch in batches:
        length = np.asarray(batch.column("length"))
        if not len(length):
            continue
        first = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
        nth = np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length))))
        if length[0] == held[0]:
            nth[: first[1] if len(first) > 1 else len(nth)] += held[1]
        held = [length[-1], int(nth[-1]) + 1]
        yield pa.record_batch([*batch.columns, pa.array(nth)], names=[*batch.schema.names, "nth"])


def _placed(rows: list[tuple[int, int, int, int, int]], base: dict[tuple[int, int], int]):
    keys = [(r[0], r[1]) for r in rows]
    order = sorted(range(len(rows)), key=keys.__getitem__)
    keys = [keys[i] for i in order]
    table_ = np.array([rows[i] for i in order], np.int64).reshape(-1, 5)

    def run(batches):
        spots: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            length, part, nth = (np.asarray(batch.column(c)) for c in ("length", "part", "nth"))
            pairs, which = np.unique(np.column_stack((part, length)), axis=0, return_inverse=True)
            rank = nth + np.array([base[p, n] for p, n in pairs.tolist()], np.int64)[which.ravel()]
            at = np.empty(len(length), np.int64)
            for size in np.unique(length):
                if size not in spots:
                    lo, hi = bisect_right(keys, (size, -1)), bisect_right(keys, (size + 1, -1))
                    spots[size] = lo, table_[lo:hi, 1]
                own = length == size
                at[own] = spots[size][0] + np.searchsorted(spots[size][1], rank[own], side="right") - 1
            row = table_[at]
            nth = rank - row[:, 1]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(row[:, 2] + nth // row[:, 4]), pa.array(row[:, 3] + nth % row[:, 4] * length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, held: int = HELD, keep: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of its file, which every executor has. A worker remembers the ids of words up to ``held`` bytes,
    with ``keep`` from task to task; without it each task loads the tokenizer anew and leaves no memory behind.
    A null text is an empty one: its only id is the end id. A null id is kept.
    Rows that repeat are packed each. Offsets in a sequence have no gaps and start at 0. Other columns are ignored; an empty
    table gives no piece.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    pieces = table(own.mapInArrow(_pieces(tokenizer, window, end, held, keep), _PIECE).withColumn("n", F.monotonically_increasing_id()), "pieces")
    # the number of the row lets pieces that are alike in all else lie in several ranges
    order = ["length", "doc_id", "start", "n"]
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order).drop("n").withColumn("part", F.spark_partition_id().cast("long"))
    ranked = table(ranged.mapInArrow(_ranked, _PIECE + ", part long, nth long"), "ranked")
    counts = sorted((r["part"], r["length"], r["n"]) for r in ranked.groupBy("part", "length").agg(F.max("nth").alias("n")).collect())  # as many as lengths and ranges together
    total: dict[int, int] = {}
    base = {}
    for part, length, last in counts:
        base[part, length] = total.get(length, 0)
        total[length] = base[part, length] + last + 1
    return ranked.mapInArrow(_placed(plan(total, window), base), _PIECE + ", sequence_id long, offset long")
