"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text's features are its words and their leading 4 to 8 characters
(inflected forms share those).  The model predicts a severity grade 0..3:
``P(grade <= k) = logistic(threshold_k - w . x)`` with one weight vector
for all ordered thresholds; the output is the expected severity
``sum_k P(grade > k)`` and the probability of any toxicity.

Fit, on a bounded sample of labelled rows (``MAX_LABELLED``, drawn by a
hash of the id; equal texts count once):

1. document frequencies of all features by label, summed by Spark;
2. the features that go with the toxic label (support and odds ratio),
   at most ``MAX_FEATURES``; only their rows reach the driver;
3. grades: not toxic 0; toxic rows 1..3 by the tertiles of the number of
   associated words they hold (the labels themselves are 0/1);
4. full-batch gradient steps in numpy, weights kept at 0 or above so that
   more associated words never lower the severity.

Scoring is one pass over all whole texts with a broadcast dictionary of at
most ``MAX_FEATURES`` weights.

Defined results: a null or empty text has no features and the severity of
the intercepts; every input row gives one output row (repeated rows and
null ids included); without any labelled toxic row nothing is toxic; if a
document has several labels the largest counts; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MAX_LABELLED = 16_000       # expected size of the labelled sample
MAX_FEATURES = 4_096
MIN_SUPPORT = 4             # toxic texts that hold a feature, at least, ...
MIN_SUPPORT_SHARE = 0.01    # ... and at least this share of them
MIN_ODDS = 20.0             # how much more frequent a feature is in toxic texts
GRADES = 3
STEPS, RATE, RIDGE = 800, 0.1, 1e-5
CHUNK_CHARS = 1_000_000     # texts held as words at a time
REJECT_ABOVE = 0.5          # probability of grade >= 1

EDGE = string.punctuation + "“”„«»‹›…¿¡–—"
PREFIXES = (4, 5, 6, 7, 8)


def word_features(word: str) -> tuple[str, ...]:
    """Features of one lower-case word: the bare word and its leading characters."""
    w = word.strip(EDGE)
    if not w:
        return ()
    return ("=" + w, *("^" + w[:n] for n in PREFIXES if len(w) > n))


@dataclass
class OrdinalModel:
    """Weights by feature and the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (30.0, 31.0, 32.0)

    def above(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades): P(grade > k) for k = 0.."""
        z = np.clip(np.asarray(score)[:, None] - np.asarray(self.thresholds)[None, :], -60, 60)
        return 1.0 / (1.0 + np.exp(-z))


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _features_of(words: list[str], known: dict[str, tuple[str, ...]]) -> Counter:
    """Counts of the known features of one text."""
    out: Counter = Counter()
    hits = known.keys() & set(words)
    if hits:
        for w, n in Counter(w for w in words if w in hits).items():
            for f in known[w]:
                out[f] += n
    return out


def _known_words(split: list[list[str]], wanted) -> dict[str, tuple[str, ...]]:
    """word -> its wanted features, for the distinct words of a batch that have any."""
    distinct = set().union(*map(set, split)) if split else set()
    found = ((w, tuple(f for f in word_features(w) if f in wanted)) for w in distinct)
    return {w: fs for w, fs in found if fs}


def _counted(texts: list[str | None], wanted) -> Iterator[tuple[Counter, int]]:
    """(counts of the wanted features, words that have any) of each text."""
    for a, b in chunks(texts, CHUNK_CHARS):
        split = [_words(t) for t in texts[a:b]]
        known = _known_words(split, wanted)
        for ws in split:
            c = _features_of(ws, known)
            yield c, sum(1 for w in ws if w in known) if c else 0


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of about ``limit`` labelled documents at most."""
    known = labels.where("toxic is not null and doc_id is not null")
    share = min(1.0, limit / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample's size is bounded by ``limit``, so is this broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))


def _frequencies(sample: DataFrame) -> DataFrame:
    """(feature, toxic, n): distinct texts of each label that hold the feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                for label in (0, 1):
                    c: Counter = Counter()
                    for t, y in zip(texts[a:b], toxic[a:b]):
                        if bool(y) == bool(label):
                            c.update({f for w in set(_words(t)) for f in word_features(w)})
                    if c:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c.keys(), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(c.values(), pa.int64())],
                            names=["feature", "toxic", "n"])

    return sample.mapInArrow(run, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))


def _design(sample: DataFrame, features: list[str]) -> list[tuple[int, list[int], list[float], int]]:
    """(toxic, feature numbers, values, associated words) of each sampled text that has any, sorted."""
    index = {f: i for i, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, hits = [], [], []
            for c, n_hits in _counted(batch.column(0).to_pylist(), index):
                own = sorted((index[f], n) for f, n in c.items())
                ids.append([i for i, _ in own])
                values.append([float(np.log1p(n)) for _, n in own])
                hits.append(n_hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())),
                 pa.array(hits, pa.int64())], names=["toxic", "ids", "values", "hits"])

    rows = sample.mapInArrow(run, "toxic int, ids array<int>, values array<double>, hits long").collect()
    return sorted((int(bool(r["toxic"])), list(r["ids"]), list(r["values"]), int(r["hits"])) for r in rows)


def fit_ordinal(rows: list[tuple[int, list[int], list[float], int]], n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the cumulative-link likelihood."""
    toxic = np.array([r[0] for r in rows])
    hits = np.array([r[3] for r in rows], float)
    grade = np.zeros(len(rows), int)
    if toxic.any():
        cuts = np.quantile(hits[toxic == 1], np.arange(1, GRADES) / GRADES)
        grade[toxic == 1] = 1 + np.searchsorted(cuts, hits[toxic == 1], side="left")
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([i for r in rows for i in r[1]], int)
    val = np.array([v for r in rows for v in r[2]], float)
    w = np.full(n_features, 0.5)
    # thresholds = first + positive gaps
    par = np.array([2.0, *[0.0] * (GRADES - 1)])
    m = [np.zeros_like(w), np.zeros_like(par)]
    v = [np.zeros_like(w), np.zeros_like(par)]
    k = np.arange(GRADES)
    n = max(1, len(rows))
    for step in range(1, STEPS + 1):
        gaps = np.exp(par[1:])
        theta = np.concatenate(([par[0]], par[0] + np.cumsum(gaps)))
        score = np.bincount(row, w[col] * val, len(rows)) if len(col) else np.zeros(len(rows))
        below = 1.0 / (1.0 + np.exp(-np.clip(theta[None, :] - score[:, None], -60, 60)))      # P(grade <= k)
        cum = np.concatenate((np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))), axis=1)
        at = np.arange(len(rows))
        p = np.maximum(cum[at, grade + 1] - cum[at, grade], 1e-12)
        slope = np.concatenate((np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))), axis=1)
        # d log p / d theta_k: + slope at the upper threshold, - slope at the lower one
        d_theta = (slope[:, 1:-1] * ((k[None, :] == grade[:, None]).astype(float)
                                     - (k[None, :] == grade[:, None] - 1))) / p[:, None]
        d_score = -d_theta.sum(axis=1)
        g_w = -(np.bincount(col, d_score[row] * val, n_features) if len(col) else np.zeros(n_features)) / n + RIDGE * w
        t = -d_theta.sum(axis=0) / n
        g_par = np.concatenate(([t.sum()], [t[j:].sum() * gaps[j - 1] for j in range(1, GRADES)]))
        for x, g, mm, vv in ((w, g_w, m[0], v[0]), (par, g_par, m[1], v[1])):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x -= RATE * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-8)
        np.maximum(w, 0.0, out=w)
    theta = np.concatenate(([par[0]], par[0] + np.cumsum(np.exp(par[1:]))))
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> OrdinalModel:
    """The model of a corpus, from a bounded labelled sample of it."""
    sample = labelled_sample(docs, labels, limit)
    totals = {int(bool(r["toxic"])): r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1:
        return OrdinalModel()
    odds = ((F.col("n1") + 0.5) / (n1 + 1.0)) / ((F.col("n0") + 0.5) / (n0 + 1.0))
    best = _frequencies(sample).where((F.col("n1") >= max(MIN_SUPPORT, MIN_SUPPORT_SHARE * n1)) & (odds >= MIN_ODDS)) \
        .orderBy((F.col("n1") * F.log(odds)).desc(), "feature").limit(MAX_FEATURES)
    features = [r["feature"] for r in best.select("feature").collect()]
    if not features:
        return OrdinalModel()
    w, theta = fit_ordinal(_design(sample, features), len(features))
    return OrdinalModel({f: float(x) for f, x in zip(features, w) if x > 0}, tuple(float(t) for t in theta))


def score_texts(texts: list[str | None], model: OrdinalModel) -> tuple[np.ndarray, np.ndarray]:
    """(P(grade > k) per text, number of associated words)."""
    score, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, (c, n_hits) in enumerate(_counted(texts, model.weights)):
        if c:
            score[i] = sum(model.weights[f] * np.log1p(n) for f, n in sorted(c.items()))
            hits[i] = n_hits
    return model.above(score), hits


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row per document: doc_id, n_hits, p_toxic, expected_severity, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, hits = score_texts(batch.column(1).to_pylist(), shared.value)
            p = above[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hits), pa.array(np.round(p, 6)), pa.array(np.round(above.sum(axis=1), 6)),
                 pa.array(p > REJECT_ABOVE)], names=["doc_id", "n_hits", "p_toxic", "expected_severity", "toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_hits long, p_toxic double, expected_severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows whose text is not judged toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, _ = score_texts(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array(above[:, 0] <= REJECT_ABOVE))

    return docs.mapInArrow(run, docs.schema)
