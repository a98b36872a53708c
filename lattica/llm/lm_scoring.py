"""Whole-document log-likelihoods by a gated recurrent language model.

Counts of all words of all texts are the base. The most frequent words (``HEAD``, a bound) go to the tasks; the most frequent of
those are words of the network, the others stand in classes by rank, within which they keep their shares of the counts. All rarer words
are one class more, whose shares come from a join with the counts, so nothing that grows with the corpus is broadcast.

The network learns from every text once. Rounds take the texts by a hash; in a round each task goes on from the last
mean of the tasks' weights, and the weights' sums by tokens are one aggregate. Scores carry the state
through whole texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, settled, table
from .recurrent import CLASSES, HIDDEN, MEMBERS, Params, Trainer, scores, start

#: Words that go to the tasks, those of most texts' tokens; of at most LONGEST bytes each.
HEAD, LONGEST = 200_000, 64
ROUNDS = 3
#: Static classes of the head, each twice as many words as the one before; behind them the class of all rarer words.
BINS = 9
#: Bytes of text that are laid out in lanes at once.
CHUNK = 24 << 20
#: Distinct words after which a task passes its counts on.
_HELD = 300_000
_END = b""
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of what is not white space in ASCII."""
    return (text or b"").lower().split()


@dataclass
class Model:
    counts: DataFrame  # (word binary, n): all words, the end of a text as an empty one
    words: list[bytes]  # the head, most frequent first but for the end, which is the first
    n: np.ndarray
    tokens: int
    types: int
    params: Params

    @property
    def total(self) -> int:
        """Counts of all words and of an unknown one, each plus one."""
        return self.tokens + self.types + 1

    @property
    def rest(self) -> float:
        """The part of the total that is not the head's."""
        return self.total - float((self.n + 1.0).sum())

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word of the head, behind them that of all others; log10 of each word's share of its symbol."""
        own, at = CLASSES * MEMBERS, np.arange(len(self.words))
        bins = np.minimum(np.log2(np.maximum(at / own, 1)).astype(int), BINS - 1)
        mass = np.bincount(bins[own:], self.n[own:] + 1.0, BINS)
        share = np.where(at < own, 0.0, np.log10((self.n + 1) / np.maximum(mass[bins], 1)))
        return np.append(np.where(at < own, at, own + bins), own + BINS).astype(np.int32), np.append(share, 0.0)

    def first(self) -> Params:
        """Weights of a network that knows the counts alone."""
        own = CLASSES * MEMBERS
        member = np.zeros(own)
        member[: min(own, len(self.n))] = self.n[:own] + 1.0
        member = member.reshape(CLASSES, MEMBERS)
        symbol, _ = self.symbols()
        static = np.bincount(symbol[own:-1] - own, self.n[own:] + 1.0, BINS)
        return start(np.concatenate([member.sum(axis=1), static, [self.rest]]), member)


def _counted(batches):
    held: Counter = Counter()

    def out():
        found = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return found

    for batch in batches:
        for text in batch.column(0):
            held.update(words_of(text.as_py()))
            held[_END] += 1
            if len(held) > _HELD:
                yield out()
    if held:
        yield out()
    settled()


def _chunks(column: pa.Array):
    """(from, to) of rows of about CHUNK bytes."""
    sizes = np.cumsum([len(x.as_buffer() or b"") for x in column])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, "right")))
        yield a, b
        a = b


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return self.rest


def _looked_up(words: list[bytes]) -> _Ids:
    ids = _Ids(zip(words, range(len(words)), strict=True))
    ids.rest = len(words)
    return ids


def _places(ids: _Ids, column: pa.Array) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """Places of each text's words in the head with the end's, and the words that are not there."""
    places, rare = [], []
    for x in column:
        words = words_of(x.as_py())
        words.append(_END)
        p = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        places.append(p)
        rare.append([words[i] for i in np.flatnonzero(p == ids.rest).tolist()])
    return places, rare


def fit(docs: DataFrame, *, text: str = "text") -> Model:
    """The model of all rows of docs. Null texts are empty; a text's end is a token. An empty table gives a model in which all words are unknown.

    Rows that repeat count each. No row is left out or cut: texts are counted whole, and the network learns from each of their tokens once.
    """
    spark = docs.sparkSession
    raw = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    counts = table(raw.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = counts.where((F.octet_length("word") <= LONGEST) & (F.octet_length("word") > 0)).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = Model(counts, [_END, *head.column("word").to_pylist()], np.array([ends, *head.column("n").to_pylist()], np.int64), whole["n"], whole["v"], {})
    model.params = model.first()
    symbol, _ = model.symbols()
    shared = spark.sparkContext.broadcast((model.words, symbol))
    scale: dict[str, float] = {}
    shapes = [(k, v.shape, v.size) for k, v in model.params.items()]
    for r in range(ROUNDS):
        state = spark.sparkContext.broadcast((model.params, dict(scale)))

        def learned(batches, state=state):
            words, symbol = shared.value
            ids, trainer = _looked_up(words), Trainer(*state.value)
            for batch in batches:
                for a, b in _chunks(batch.column(0)):
                    trainer.learn([symbol[p] for p in _places(ids, batch.column(0).slice(a, b - a))[0]])
            if trainer.tokens:
                flat = np.concatenate([*(trainer.sums[k].ravel() for k, _, _ in shapes), [float(trainer.square[k].mean()) * trainer.tokens for k, _, _ in shapes], [float(trainer.tokens)]])
                yield pa.record_batch([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["s"])
            settled()

        part = raw.where(F.pmod(F.xxhash64("t"), F.lit(ROUNDS)) == r).mapInArrow(learned, "s array<double>")
        sums = part.select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).toArrow()  # as many numbers as the network has weights
        state.destroy()
        if sums.num_rows:
            flat = np.empty(sums.num_rows)
            flat[sums.column("k").to_numpy()] = sums.column("s").to_numpy()
            flat, at = flat[:-1] / flat[-1], 0
            for k, shape, size in shapes:
                model.params[k] = flat[at : at + size].reshape(shape).astype(np.float32)
                at += size
            scale = {k: float(v) for (k, _, _), v in zip(shapes, flat[at:], strict=True)}
    shared.destroy()
    return model


def _scored(shared, name: str):
    """Adds a row's number, its tokens, what its words of the head give, and its other words."""
    def run(batches):
        words, n, symbol, share, params, total = shared.value
        ids, row = _looked_up(words), TaskContext.get().partitionId() << 40
        base = np.append(np.log10((n + 1) / total), 0.0)
        known = np.append(n > 0, False)
        for batch in batches:
            names = [c for c in batch.schema.names if c != name]
            at = batch.schema.names.index(name)
            for a, b in _chunks(batch.column(at)):
                cut = batch.slice(a, b - a)
                places, others = _places(ids, cut.column(at))
                natural = scores(params, [symbol[p] for p in places])
                made = [
                    pa.array(np.arange(row, row + len(places))), pa.array([len(p) for p in places], pa.int64()), pa.array([int(known[p].sum()) for p in places], pa.int64()),
                    pa.array([float(base[p].sum()) for p in places]), pa.array([float(share[p].sum()) for p in places] + natural / np.log(10)),
                    pa.array(others, pa.list_(pa.binary())),
                ]
                row += len(places)
                yield pa.record_batch([*(cut.column(c) for c in names), *made], names=[*names, *(f"{name}_{x}" for x in ("row", "tokens", "known", "base", "score", "rare"))])
        settled()
    return run


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs without ``text`` and with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    base_score gives a token of count c the share (c + 1) / (N + V + 1), score that of the network; unknown words have a count of 0 in both.
    Null and empty texts are their end alone. Rows that repeat are scored each. Columns of docs with the result's names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in OUT if c != text))
    name = f"{free(docs)}t"
    own = docs.withColumn(name, F.coalesce(F.col(text), F.lit("")).cast("binary")).drop(text)
    kept = [c for c in own.columns if c != name]
    symbol, share = model.symbols()
    shared = spark.sparkContext.broadcast((model.words, model.n, symbol, share, model.params, model.total))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema if f.name != name)
    kinds = f"{name}_row long, {name}_tokens long, {name}_known long, {name}_base double, {name}_score double, {name}_rare array<binary>"
    made = table(own.mapInArrow(_scored(shared, name), fields + kinds), "scored")
    shared.destroy()
    rare = made.select(F.col(f"{name}_row").alias("row"), F.explode(f"{name}_rare").alias("word"))
    # a rare word has at most one of HEAD tokens, unless it is very long; those are dealt by adaptive joins
    found = rare.join(model.counts, "word", "left").groupBy("row").agg(F.count("*").alias("many"), F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("log"))
    out = made.join(found.withColumnsRenamed({c: f"{name}_{c}s" for c in found.columns}), F.col(f"{name}_row") == F.col(f"{name}_rows"), "left")
    of = lambda c: F.coalesce(f"{name}_{c}s", F.lit(0))
    rest = lambda c, mass: F.col(f"{name}_{c}") + of("log") - of("many") * F.lit(float(np.log10(max(mass, 1.0))))
    return out.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"{name}_tokens").alias("n_tokens"), (F.col(f"{name}_known") + of("known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        rest("base", model.total).alias("base_score"), rest("score", model.rest).alias("score"),
    )
