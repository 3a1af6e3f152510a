"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - score): one weight vector for all ordered
thresholds. A feature is a word or a word's beginning of four to seven letters;
its value is the percentage of a text's words that have it. The model is fitted
on at most ``per_grade`` labelled documents of each grade (the smallest hashes
of ``doc_id``, weighted back to the grades' shares): their features are counted
per grade in Spark, the ``features`` that tell grades apart best are kept, and
the small weighted fit runs on the driver. Every document is then scored in one
pass; the output is the expected grade.

Labels with a NULL id or grade are left out; documents may have several labels.
With fewer than two grades among the labels nothing is known and every severity
is 0. NULL and empty texts score as texts without features. Rows with the same
``doc_id`` are scored each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, slices
from .words import word_ids

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)


def word_features(word: str) -> set[str]:
    """Features of a word: each run of letters, and its beginnings (marked with a star)."""
    out = set()
    for run in LETTERS.findall(word):
        out.add(run)
        out.update(run[:n] + "*" for n in BEGINNINGS if len(run) >= n)
    return out


@dataclass
class Model:
    """Weights of the features, and ascending thresholds between the grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        z = score[:, None] - np.array(self.thresholds)[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _rates(part: pa.RecordBatch, known: dict[str, int] | None):
    """For each text (feature, percentage) of the known features, or its set of all features."""
    ids, starts, words = word_ids(pc.utf8_lower(part["text"]))
    found = [word_features(w) for w in words.to_pylist()]
    for a, b in zip(starts[:-1], starts[1:]):
        own, counts = np.unique(ids[a:b], return_counts=True)
        if known is None:
            yield set().union(*(found[i] for i in own))
            continue
        rates: dict[str, float] = {}
        for i, c in zip(own, counts):
            for f in found[i]:
                if f in known:
                    rates[f] = rates.get(f, 0.0) + 100.0 * c / (b - a)
        yield rates


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, weight: np.ndarray, n_features: int, n_grades: int, rounds: int = 300, ridge: float = 3e-4, rate: float = 0.2):
    """Weighted maximum likelihood by Adagrad; thresholds ascend as steps of positive size."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    # large rates say no more than moderate ones
    val = np.log1p(np.array([v for r in rows for v in r.values()], float))
    w, low, steps = np.zeros(n_features), 0.0, np.zeros(n_grades - 2)
    sums = [np.full(n_features, 1e-8), 1e-8, np.full(n_grades - 2, 1e-8)]
    weight = weight / weight.sum()
    for _ in range(rounds):
        theta = low + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        score = np.bincount(at, w[col] * val, len(rows))
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        up = 1 / (1 + np.exp(np.clip(-(cut[grades + 1] - score), -60, 60)))
        down = 1 / (1 + np.exp(np.clip(-(cut[grades] - score), -60, 60)))
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = weight * up * (1 - up) / p, weight * down * (1 - down) / p
        d_theta = np.array([d_up[grades == k].sum() - d_down[grades == k + 1].sum() for k in range(n_grades - 1)])
        d_score = d_down - d_up
        tail = np.cumsum(d_theta[::-1])[::-1]
        grads = [np.bincount(col, d_score[at] * val, n_features) - ridge * w, d_theta.sum(), tail[1:] * np.exp(steps)]
        sums = [s + g * g for s, g in zip(sums, grads)]
        w = w + rate * grads[0] / np.sqrt(sums[0])
        low = low + rate * grads[1] / np.sqrt(sums[1])
        steps = steps + rate * grads[2] / np.sqrt(sums[2])
    return w, low + np.concatenate([[0.0], np.cumsum(np.exp(steps))])


#: Each grade has a threshold and up to ``per_grade`` documents on the driver.
MOST_GRADES = 100


def train(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int = 3000, features: int = 2048, least_docs: int = 5, least_z: float = 3.0) -> Model:
    """Fit the model on a bounded sample of the labelled documents. More than ``MOST_GRADES`` grades are an error."""
    graded = checkpointed(labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade")))
    shares = dict(graded.groupBy("grade").count().orderBy("grade").limit(MOST_GRADES + 1).collect())
    if len(shares) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades: join some of them")
    if len(shares) < 2:
        return Model()
    picks = None
    for g in shares:  # the smallest hashes of each grade: a top-n on every task, then of those
        pick = graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        picks = pick if picks is None else picks.unionByName(pick)
    sample = checkpointed(id_text(docs).join(F.broadcast(picks), "doc_id").dropDuplicates(["text"]).select("doc_id", "text", "grade"))
    listed = pa.schema([("grade", pa.int32()), ("feature", pa.list_(pa.string()))])

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 17):
            yield pa.RecordBatch.from_arrays([part["grade"], pa.array([sorted(s) for s in _rates(part, None)], pa.list_(pa.string()))], schema=listed)

    have = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    low = min(have, default=0)
    n_low, n_high = have.get(low, 0), sum(have.values()) - have.get(low, 0)
    if not n_low or not n_high:
        return Model()
    counted = sample.mapInArrow(listing, "grade int, feature array<string>").select(F.explode("feature").alias("feature"), (F.col("grade") > low).cast("int").alias("high")) \
        .groupBy("feature").agg(F.sum("high").alias("high"), F.sum(1 - F.col("high")).alias("low")).filter(F.col("high") + F.col("low") >= least_docs)
    ratio = F.abs(F.log((F.col("high") + 0.5) / (n_high + 1.0)) - F.log((F.col("low") + 0.5) / (n_low + 1.0)))
    spread = F.sqrt(1 / (F.col("high") + 0.5) + 1 / (F.col("low") + 0.5))
    chosen = [r["feature"] for r in counted.select("feature", (ratio / spread).alias("z")).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(features).collect()]
    if not chosen:
        return Model()
    known = {f: i for i, f in enumerate(chosen)}
    rated = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("feature", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

    def rating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 17):
            rates = [{known[f]: v for f, v in sorted(r.items())} for r in _rates(part, known)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["grade"], pa.array([list(r) for r in rates], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rates], pa.list_(pa.float64()))], schema=rated)

    rows = sample.mapInArrow(rating, "doc_id long, grade int, feature array<int>, value array<double>").orderBy("doc_id").collect()  # at most per_grade for each grade
    order = sorted(have)
    grades = np.array([order.index(r["grade"]) for r in rows])
    weight = np.array([shares[r["grade"]] / have[r["grade"]] for r in rows], float)
    w, theta = fit_ordinal([dict(zip(r["feature"], r["value"])) for r in rows], grades, weight, len(chosen), len(order))
    return Model({f: float(w[i]) for f, i in known.items()}, [float(t) for t in theta])


def scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade of each text, and whether a grade above the lowest is likelier than not."""
    if not model.thresholds:
        return np.zeros(len(texts)), np.zeros(len(texts), bool)
    names = list(model.weights)
    number = {f: i for i, f in enumerate(names)}
    weights = np.array([model.weights[f] for f in names])
    ids, starts, words = word_ids(pc.utf8_lower(texts))
    # (word, feature) pairs of the slice's dictionary, then (text, feature) counts
    pairs = [(i, number[f]) for i, w in enumerate(words.to_pylist()) for f in word_features(w) if f in number]
    word, feature = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    first, last = np.searchsorted(word, ids), np.searchsorted(word, ids, side="right")
    per_word = last - first
    text_of = np.repeat(np.repeat(np.arange(len(texts)), np.diff(starts)), per_word)
    at = np.repeat(first - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())
    key, counts = np.unique(text_of * len(names) + feature[at], return_counts=True)
    text, lengths = key // len(names), np.diff(starts)
    score = np.bincount(text, weights[key % len(names)] * np.log1p(100.0 * counts / lengths[text]), len(texts))
    above = model.above(score)
    return above.sum(axis=1), above[:, 0] >= 0.5


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity`` (expected grade) and ``toxic`` (a grade above the lowest is likelier than not)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for part in slices(batches):
            grade, toxic = scores(part["text"], model)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(grade), pa.array(toxic)], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all their columns, that aren't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for part in slices(batches):
            yield part.filter(pa.array(~scores(pc.fill_null(part["text"], ""), model)[1]))

    return docs.mapInArrow(run, docs.schema)
