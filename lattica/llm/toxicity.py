"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the beginnings of words, hashed. The machine adds a weight per term and, for every pair
of terms, the product of their factors, so it learns that an insult counts more beside a mention of a group than both
alone. Factors make the pairs cost no more than the terms. It is fitted on the driver, on a sample of labelled
rows of bounded size; scoring reads each text once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, settled

#: Labelled rows that the fit takes at most: those of least hash of their id.
SAMPLE = 15_000
HASHED, TERMS, FACTORS, EPOCHS = 1 << 18, 4096, 4, 25
#: Texts that a term must be in, in the sample.
SEEN = 6
#: Beginnings of words that are terms too: inflected and joined words share them.
HEADS = (4, 5)
_WORD = re.compile(r"[^\W_]+")


class _Terms(dict):
    """Hashed terms of words, as bytes of int32; a bound number of words is remembered."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        raw = [word, *(f"{n}:{word[:n]}" for n in HEADS if len(word) > n)]
        out = self[word] = np.array([zlib.crc32(t.encode()) % HASHED for t in raw], np.int32).tobytes()
        return out


_terms = _Terms()


def terms_of(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.frombuffer(b"".join(map(_terms.__getitem__, words)), np.int32))


@dataclass
class Machine:
    slot: np.ndarray  # hashed term -> place in the arrays below, -1 for none
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, places: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of n texts, and the sums of their factors."""
        linear = np.bincount(owner, self.weight[places], n)
        sums, squares = np.zeros((n, self.factor.shape[1])), np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[places, f]
            sums[:, f] = np.bincount(owner, v, n)
            squares += np.bincount(owner, v * v, n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def placed(self, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        places = self.slot[np.concatenate(terms)] if terms else np.zeros(0, np.int32)
        return places[places >= 0], owner[places >= 0]


def train(terms: list[np.ndarray], label: np.ndarray, *, seed: int = 7) -> Machine:
    """Fits the terms that tell the labels apart best, by Adagrad on the logistic loss with quadratic shrinkage."""
    n, positive = len(terms), float(label.sum())
    every = np.concatenate([*terms, np.zeros(0, np.int32)])
    seen = np.bincount(every, minlength=HASHED).astype(float)
    with_ = np.bincount(every, np.repeat(label, [len(t) for t in terms]), HASHED)
    rate = (positive + 1) / (n + 2)
    score = np.where(seen >= SEEN, (with_ - seen * rate) ** 2 / np.maximum(seen * rate * (1 - rate), 1e-9), 0)
    chosen = np.sort(np.argsort(-score, kind="stable")[:TERMS])
    chosen = chosen[score[chosen] > 4]
    slot = np.full(HASHED, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    m = Machine(slot, float(np.log(rate / (1 - rate))), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS)))
    places, owner = m.placed(terms)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    gw, gv, gb, shrink = np.full(len(chosen), 1e-3), np.full(m.factor.shape, 1e-3), 1e-3, 2e-4
    for _ in range(EPOCHS if len(chosen) else 0):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            batch = order[a : a + 256]
            size = bounds[batch + 1] - bounds[batch]
            own = np.repeat(np.arange(len(batch)), size)
            at = places[np.repeat(bounds[batch] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(own))]
            logit, sums = m.logits(at, own, len(batch))
            off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[batch]) / len(batch)
            d = off[own]
            step = np.bincount(at, d, len(chosen)) + shrink * m.weight
            gw += step**2
            for f in range(FACTORS):
                v = np.bincount(at, d * (sums[own, f] - m.factor[at, f]), len(chosen)) + shrink * m.factor[:, f]
                gv[:, f] += v**2
                m.factor[:, f] -= 0.05 * v / np.sqrt(gv[:, f])
            m.weight -= 0.2 * step / np.sqrt(gw)
            gb += off.sum() ** 2
            m.bias -= 0.05 * off.sum() / np.sqrt(gb)
    return m


def _termed(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            found = [terms_of(t.as_py()).tobytes() for t in batch.column("text").slice(a, 500)]
            yield pa.record_batch([pa.array(found, pa.binary()), batch.column("label").slice(a, 500)], names=["terms", "label"])
    _terms.clear()
    settled()


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """The machine of the documents' labels; at most ``sample`` labelled ids are read, those of least hash.

    Null labels and ids are left out; a repeated id takes its largest label and its least text. Without labels all scores
    are even. A text may be of any length: its terms are a set.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("double").alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(own), "id")  # sample rows at most
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")  # so are these
    got = rows.mapInArrow(_termed, "terms binary, label double").toArrow()
    label_ = got.column("label").to_numpy()
    terms = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("terms")]
    order = sorted(range(len(terms)), key=lambda i: (zlib.crc32(terms[i].tobytes()), label_[i]))  # whatever order the rows came in
    return train([terms[i] for i in order], label_[order])


def _scored(machine: Machine, name: str):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                texts = batch.column(name).slice(a, 500)
                places, owner = machine.placed([terms_of(t.as_py()) for t in texts])
                logit, _ = machine.logits(places, owner, len(texts))
                cut = batch.slice(a, 500)
                names = [n for n in batch.schema.names if n != name]
                columns = [cut.column(n) for n in names]
                yield pa.record_batch([*columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], names=[*names, "score"])
        _terms.clear()
        settled()
    return run


def score(docs: DataFrame, machine: Machine, *, text: str = "text") -> DataFrame:
    """docs with ``score``, the probability of label 1. Null texts are empty; an empty text gets the score of no terms.

    All columns of docs stay but for ``score``, which the result's replaces; rows that repeat are scored each.
    """
    docs = docs.drop("score")
    name = f"{free(docs)}text"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(name, F.coalesce(text, F.lit(""))).mapInArrow(_scored(machine, name), f"{fields}, score double")
