"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is how densely a hashed character n-gram (within word edges) stands in the whole text: the square root of its
occurrences in a thousand n-grams. Naive Bayes log-count ratios of the densities scale the features, and a logistic
regression with L2 penalty is fitted on the scaled features until its gradient is small (Wang and Manning 2012). Empty
and null texts have no feature, so their score follows from the intercept alone. Rows are kept one for one. With labels
of one class only (or none) every score is that class's share (or 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, char_grams, chunks, hash_fraction, letters_only, map_rows, materialize, tokens

BITS = 18
ORDERS = range(3, 7)
#: The model is fitted on at most about this many labelled rows of each class.
TRAIN_ROWS = 6000
#: And on so many n-grams, those that tell most about the label.
FEATURES = 4096
SMOOTH = 1.0
L2 = 1e-3
#: The fit ends when the gradient is this share of the first one.
GRADIENT = 1e-5
#: Parts of a text's n-grams in which densities are counted, and texts that a worker scores at once.
PARTS = 1_000_000
ROWS = 512


@dataclass
class ToxicityModel:
    """slot[bucket] is a feature's place in weight (-1: none); weight already holds the log-count ratio."""

    slot: np.ndarray
    weight: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        if len(self.weight) and len(texts):
            place, total = occurrences(texts, self.slot, len(self.weight))
            z += density(np.bincount(place, minlength=len(texts) * len(self.weight)).reshape(len(texts), -1), total[:, None]) @ self.weight
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def density(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt(1000.0 * count / np.maximum(total, 1))


def occurrences(texts: pa.Array, slot: np.ndarray | None, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(text * features + feature) of every occurrence of a feature (any bucket without slot), and each text's number of n-grams."""
    t = tokens(texts)
    words = [letters_only(x) for x in t.unique]
    g = char_grams([w or "\x02" for w in words], ORDERS, BITS)
    every = np.bincount(g.word, minlength=len(words))
    feature = g.bucket if slot is None else slot[g.bucket]
    kept = feature >= 0
    word, feature = g.word[kept], feature[kept].astype(np.int64)
    order = np.argsort(word, kind="stable")
    word, feature = word[order], feature[order]
    n = np.bincount(word, minlength=len(words))
    starts = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
    total = np.bincount(doc, weights=every[t.codes], minlength=len(t.offsets) - 1) if len(doc) else np.zeros(len(t.offsets) - 1)
    telling = n[t.codes] > 0
    doc, code = doc[telling], t.codes[telling]
    times = n[code]
    at = np.repeat(starts[code] - np.concatenate([[0], np.cumsum(times)])[:-1], times) + np.arange(times.sum())
    return np.repeat(doc, times) * features + feature[at], total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, label): for each bucket and label the texts that hold it, and the sum of its whole-number densities."""
    size = 1 << BITS
    held, dense = np.zeros((2, size), dtype=np.int64), np.zeros((2, size), dtype=np.int64)
    for b in chunks(batches, 0, CHUNK_CHARS // 4):  # all buckets of a text, not just the model's
        label = np.array(b.column(1).to_pylist(), dtype=np.int64)
        place, total = occurrences(b.column(0), None, size)
        place, times = np.unique(place, return_counts=True)
        doc, bucket = place // size, place % size
        part = (times * PARTS // np.maximum(total[doc], 1)).astype(np.int64)
        for y in (0, 1):
            own = label[doc] == y
            held[y] += np.bincount(bucket[own], minlength=size)
            dense[y] += np.bincount(bucket[own], weights=part[own], minlength=size).astype(np.int64)
    at = np.flatnonzero(held.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(x[y][at]) for x in (held, dense) for y in (0, 1)]], names=["at", "n0", "n1", "d0", "d1"])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, share: float = GRADIENT, memory: int = 10) -> np.ndarray:
    """Where the smooth convex f, given with its gradient, is least: limited-memory BFGS steps with halving, until the
    gradient is `share` of the first one or no step goes down."""
    value, slope = f(x)
    goal = share * np.linalg.norm(slope)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    while np.linalg.norm(slope) > goal:
        way, used = slope.copy(), []
        for s, y, sy in reversed(past):
            used.append((s @ way) / sy)
            way -= used[-1] * y
        way *= past[-1][2] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(way)
        for (s, y, sy), a in zip(past, reversed(used), strict=True):
            way += (a - (y @ way) / sy) * s
        step, down = 1.0, slope @ way
        while True:
            value_next, slope_next = f(x - step * way)
            if value_next <= value - 1e-4 * step * down:
                break
            step /= 2
            if step < 1e-12:
                return x
        moved, turned = -step * way, slope_next - slope
        if moved @ turned > 1e-14:
            past = [*past[-(memory - 1) :], (moved, turned, float(moved @ turned))]
        x, value, slope = x + moved, value_next, slope_next
    return x


def fit_logistic(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, features: int, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic regression of rows y on sparse values."""
    n = len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(doc, weights=value * w[:-1][feature], minlength=n) + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.append(np.bincount(feature, weights=value * e[doc], minlength=features) / n + l2 * w[:-1], e.mean())
        return float((np.logaddexp(0, z) - y * z).mean() + l2 / 2 * (w[:-1] @ w[:-1])), grad

    w = minimise(loss, np.zeros(features + 1))
    return w[:-1], float(w[-1])


def train(labelled: DataFrame, text: str, label: str, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on a repeatable sample of labelled rows (label 0 or 1), at most about train_rows of each class."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    share = _shares(rows, train_rows)
    return fit(rows.where(_drawn("t", share)), share, features)


def train_by_id(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> ToxicityModel:
    """As train, with the labels in a table of their own. An id labelled twice counts once, as 1 if any of its labels is 1;
    of texts of one id the greatest counts. Ids are drawn before texts are read, so only the sample's texts are moved."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    share = _shares(rows, train_rows)
    drawn = rows.where(_drawn("id", share))  # about 2 * train_rows ids and labels at most, whatever the corpus
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    sample = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.max("t").alias("t"), F.max("y").alias("y"))
    return fit(materialize(sample.select("t", "y"), "toxicity-sample"), share, features)


def _shares(rows: DataFrame, train_rows: int) -> dict[int, float]:
    """The share of each class's rows (column y) that is drawn."""
    return {r["y"]: min(1.0, train_rows / r["count"]) for r in rows.groupBy("y").count().collect()}


def _drawn(by: str, share: dict[int, float]) -> Column:
    return hash_fraction(by) < F.when(F.col("y") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))


def fit(sample: DataFrame, share: dict[int, float], features: int = FEATURES) -> ToxicityModel:
    """The model of a sample (t, y); share holds the sampled share of each class."""
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    none = np.full(1 << BITS, -1, dtype=np.int32)
    if len(size) < 2:
        only = next(iter(size), 0)
        return ToxicityModel(none, np.zeros(0), 30.0 if only == 1 else -30.0)
    names = ["n0", "n1", "d0", "d1"]
    counts = sample.select("t", "y").mapInArrow(_count, "at int, n0 long, n1 long, d0 long, d1 long").groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # 2**BITS rows at most
    n0, n1, d0, d1 = np.zeros((4, 1 << BITS))
    for into, c in zip((n0, n1, d0, d1), names, strict=True):
        into[counts["at"]] = counts[c]
    # densities weigh as much as the counts of texts, so that SMOOTH means a text
    d0, d1 = (d * max(n.sum(), 1) / max(d.sum(), 1) for d, n in ((d0, n0), (d1, n1)))
    ratio = np.log((d1 + SMOOTH) / (d1 + SMOOTH).sum()) - np.log((d0 + SMOOTH) / (d0 + SMOOTH).sum())
    spread = np.abs(ratio) * np.sqrt(n0 + n1)
    spread[n0 + n1 < 2] = 0
    top = np.lexsort((np.arange(len(spread)), -spread))[:features]
    top = np.sort(top[spread[top] > 0])
    slot = none.copy()
    slot[top] = np.arange(len(top))
    if not len(top):
        return ToxicityModel(none, np.zeros(0), float(np.log(size[1] / share[1]) - np.log(size[0] / share[0])))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 0, CHUNK_CHARS, ROWS):
            place, total = occurrences(b.column(0), slot, len(top))
            place, times = np.unique(place, return_counts=True)
            doc = place // len(top)
            at = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((place % len(top)).astype(np.int32), density(times, total[doc]).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *lists], names=["y", "k", "f", "v"])

    # at most the sample's rows, in an order of their own
    got = sample.select("t", "y", F.xxhash64("t").alias("k")).mapInArrow(sparse, "y int, k long, f array<int>, v array<float>").toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy().astype(np.float64)
    lists = [pa.chunked_array(got.column(c).chunks).combine_chunks() for c in ("f", "v")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    doc = np.repeat(np.arange(len(y)), np.diff(lists[0].offsets.to_numpy()))
    feature, value = (x.flatten().to_numpy() for x in lists)
    w, b = fit_logistic(doc, feature.astype(np.int64), value * ratio[top][feature], y, len(top))
    b += np.log(share[0]) - np.log(share[1])  # the sample holds the classes in other shares than the corpus
    return ToxicityModel(slot, w * ratio[top], float(b))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without the text unless keep_text) with score double (0 to 1) and predicted int added last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS slots and FEATURES weights, whatever the corpus
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, at, CHUNK_CHARS, ROWS):
            s = shared.value.scores(b.column(at))
            keep = [i for i in range(b.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*[b.schema.names[i] for i in keep], "score", "predicted"])

    return map_rows(docs, run, "score double, predicted int", None if keep_text else text)
