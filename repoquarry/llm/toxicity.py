"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words and their stems of 4 and 5 letters, hashed into buckets.  The
buckets that tell the classes apart best on the training sample are kept, and a factorization machine
    score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)
learns a weight for each and, by the inner products, for pairs of them: an insult together with a group name may
weigh more than the two apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import prepare

BUCKETS = 1 << 20
FEATURES = 8192
FACTORS = 8
SAMPLE_ROWS = 20_000
CACHE_WORDS = 200_000
_WORDS = re.compile(r"[^\W\d_]+")


def buckets_of(word: str) -> list[int]:
    """Hash buckets of a word and of its stems."""
    terms = [f"={word}", *(f"{k}{word[:k]}" for k in (4, 5) if len(word) >= k)]
    return [zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS for term in terms]


def terms_of(text: str | None, cache: dict[str, list[int]], known=None) -> np.ndarray:
    """Sorted distinct features of a text: buckets, or by `known` their numbers without the unknown ones."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    found: set[int] = set()
    for word in set(_WORDS.findall((text or "").lower())):
        ids = cache.get(word)
        if ids is None:
            ids = buckets_of(word)
            ids = cache[word] = ids if known is None else [known[i] for i in ids if i in known]
        found.update(ids)
    return np.array(sorted(found), np.int64)


@dataclass(frozen=True)
class Machine:
    known: dict[int, int]  # bucket -> feature
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the sigmoid of rows of feature numbers."""
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        linear = np.bincount(owner, self.weights[at], len(rows))
        pairs = np.zeros(len(rows))
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            pairs += np.bincount(owner, v, len(rows)) ** 2 - np.bincount(owner, v * v, len(rows))
        return self.bias + linear + pairs / 2


def _select(rows: list[np.ndarray], y: np.ndarray, features: int) -> dict[int, int]:
    """The buckets with the largest chi-square between presence and class; ties by bucket."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    in1, in0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, positive in zip(rows, y, strict=True):  # row by row: the sample is held once
        (in1 if positive else in0)[r] += 1
    all_ = in1 + in0
    share = n1 / (n1 + n0)
    expected = all_ * share
    chi = np.where(all_ >= 3, (in1 - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0)
    best = np.lexsort((np.arange(BUCKETS), -chi))[:features]
    return {int(b): k for k, b in enumerate(sorted(best[chi[best] > 3]))}


def train(rows: list[np.ndarray], y: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss; rows hold hash buckets, `y` 0 or 1."""
    known = _select(rows, y, features)
    picked = [np.array([known[b] for b in r.tolist() if b in known], np.int32) for r in rows]
    rng = np.random.default_rng(seed)
    m = max(len(known), 1)
    w, v = np.zeros(m), rng.normal(0, 0.02, (m, factors))
    b = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 2.5)))  # the share of the class, so few labels reject nothing
    gw, gv, gb = np.full(m, 1e-3), np.full((m, factors), 1e-3), 1e-3
    order = np.arange(len(rows))
    for _ in range(epochs if len(rows) else 0):
        rng.shuffle(order)
        for part in np.array_split(order, max(1, len(order) // 64)):
            sizes = [len(picked[i]) for i in part]
            owner, at = np.repeat(np.arange(len(part)), sizes), np.concatenate([picked[i] for i in part])
            sums = np.zeros((len(part), factors))
            np.add.at(sums, owner, v[at])
            pairs = (sums**2).sum(1) - np.bincount(owner, (v[at] ** 2).sum(1), len(part))
            z = b + np.bincount(owner, w[at], len(part)) + pairs / 2
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            touched, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, error[owner], len(touched)) + decay * w[touched]
            dv = np.zeros((len(touched), factors))
            np.add.at(dv, inverse, error[owner][:, None] * (sums[owner] - v[at]))
            dv += decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += error.sum() ** 2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
            b -= rate * error.sum() / np.sqrt(gb)
    return Machine(known, float(b), w, v)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, **options) -> Machine:
    """Train on the texts of labelled keys.

    Of more than `sample_rows` labels, those with the smallest hash of their key are taken; that bounds the broadcast
    side of the join, so texts are not shuffled, and the term numbers of those rows, on which one task trains.  The driver gets
    the machine only.  `options` are those of `train`.  A key with
    several labels counts with the largest; rows without key or label are left out.  Without rows of a class the
    machine gives the other class's prior.
    """
    prepare(df.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
    marked = marked.agg(F.max(label).cast("int").alias("__y")).orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    chosen = rows.join(F.broadcast(marked), "__key").select("__text", F.xxhash64("__key").alias("place"), "__y")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            found = [terms_of(text, cache).astype(np.int32) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], names=["terms", "place", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, y = [], []
        for batch in batches:
            lists = batch.column(0)
            flat, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths(), np.int64)
            terms += np.split(flat, np.cumsum(sizes)[:-1])
            y += (batch.column(2).to_numpy() > 0).tolist()
        machine = train(terms, np.array(y, float), **options)
        # the bias stands in a row of its own, under no bucket
        numbers = [-1, *machine.known]
        weights = np.concatenate([[machine.bias], machine.weights[list(machine.known.values())]])
        factors = [[0.0] * machine.factors.shape[1], *machine.factors[list(machine.known.values())].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(weights), pa.array(factors, pa.list_(pa.float64()))], names=["bucket", "weight", "factors"])

    sample = chosen.mapInArrow(read, "terms array<int>, place bigint, y int").repartition(1).sortWithinPartitions("place", "y", "terms")
    found = sample.mapInArrow(learn, "bucket int, weight double, factors array<double>").collect()
    if not found:  # no labelled text, so no task
        return train([], np.zeros(0), **options)
    known = {r["bucket"]: k for k, r in enumerate(found[1:])}
    weights, factors = np.array([r["weight"] for r in found[1:]] or [0.0]), np.array([r["factors"] for r in found[1:]] or [found[0]["factors"]])
    return Machine(known, found[0]["weight"], weights, factors)


def score(df: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Columns `keep` and the probability that the whole text is toxic; null and empty texts get that of no terms.

    A kept column named like `out` is replaced.
    """
    prepare(df.sparkSession)
    # plain values, so that executors need no copy of this package to read them
    shared = df.sparkSession.sparkContext.broadcast((machine.known, machine.bias, machine.weights, machine.factors))
    keep = tuple(name for name in keep if name != out)
    source = df.select(*keep, F.col(text).alias("__text"))
    types = "".join(f"`{name}` {source.schema[name].dataType.simpleString()}, " for name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Machine(*shared.value), {}
        for batch in batches:
            z = model.logits([terms_of(x, cache, model.known) for x in batch.column(len(keep)).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*keep, out])

    return source.mapInArrow(run, f"{types}{out} double")
