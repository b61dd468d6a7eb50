"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighted by its number of occurrences.  For
each of ``SAMPLES`` independent samples every word draws, from its hash,
two Gamma(2, 1) variates r, c and a uniform b; with weight w

    t = floor(ln w / r + b),    ln a = ln c - r (t - b) - r

and the word of least ``a`` is the sample ``(word, t)``.  The chance that two
texts share a sample is their generalised Jaccard similarity
``sum min(w, w') / sum max(w, w')``, so the share of equal positions of two
fingerprints estimates it (standard error at most 0.06 with 64 samples).

Every document is also compared with an edited text, its last half
replaced by the start of the *next* document by id (the first follows the
last).  Neighbours are found without a global sort: ids are cut into
buckets by quantiles, each bucket is sorted on its own, and the first
document of a bucket is sent to the bucket before it as well.

Defined results: a null or empty text, or one without words, has the
all-zero fingerprint (likeness 1 to each other, 0 to others); null ids
come first in the order; equal ids are ordered by text hash; every input
row gives one output row; a single row is its own next document; an empty
table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_tasks

SAMPLES = 64
ROWS_PER_BUCKET = 50_000      # ids per bucket, at most about
CHUNK_CHARS = 2_000_000       # texts whose words are numbered together
BLOCK = 4_096                 # (word, weight) pairs drawn together

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _streams(samples: int) -> np.ndarray:
    """(5, samples) offsets: five uniforms for each sample."""
    return _mix((np.arange(1, 5 * samples + 1, dtype=np.uint64) * _GOLD)).reshape(5, samples)


def _uniform(hashes: np.ndarray, stream: np.ndarray) -> np.ndarray:
    x = _mix(hashes[:, None] + stream[None, :])
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def draws(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) of each (word hash, weight) pair and sample."""
    s = _streams(samples)
    log_a = np.empty((len(hashes), samples), np.float32)
    level = np.empty((len(hashes), samples), np.int32)
    log_w = np.log(weights.astype(np.float64))[:, None]
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at:at + BLOCK]
        r = -np.log(_uniform(h, s[0]) * _uniform(h, s[1]))
        log_c = np.log(-np.log(_uniform(h, s[2]) * _uniform(h, s[3])))
        b = _uniform(h, s[4])
        t = np.floor(log_w[at:at + BLOCK] / r + b)
        log_a[at:at + BLOCK] = log_c - r * (t - b) - r
        level[at:at + BLOCK] = np.clip(t, -2**31, 2**31 - 1)
    return log_a, level


def signatures(texts: list[str | None], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) uint32 fingerprints."""
    out = np.zeros((len(texts), samples), np.uint32)
    number: dict[bytes, int] = {}
    ids, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = t.encode("utf-8").split() if t else []
        sizes[i] = len(ws)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)))
    if not number:
        return out
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    order = np.argsort(hashes, kind="stable")          # words in hash order: ties fall alike everywhere
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(texts)), sizes)
    key, weight = np.unique(doc * len(order) + rank[np.concatenate(ids)], return_counts=True)
    doc, word = key // len(order), key % len(order)
    # each distinct (word, weight) is drawn once for all texts of the chunk
    span = int(weight.max()) + 1
    pairs, pair = np.unique(word * span + weight, return_inverse=True)
    pair_hash = hashes[order][pairs // span]
    log_a, level = draws(pair_hash, pairs % span, samples)
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    salt = _streams(samples)[0]
    columns = np.arange(samples)
    for i in range(len(texts)):
        p = pair[(ends[i - 1] if i else 0):ends[i]]
        if len(p):
            best = p[np.argmin(log_a[p], axis=0)]
            out[i] = _mix(pair_hash[best] ^ salt ^ (level[best, columns].astype(np.int64).view(np.uint64) * _GOLD)) >> np.uint64(32)
    return out


def edited(text: str, nxt: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by as many of ``nxt`` (or all)."""
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


def _compare(ids: list, texts: list[str], nexts: list[str], samples: int) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, nexts)]
    m = len(texts)
    distinct = list(dict.fromkeys([*texts, *nexts, *changed]))
    at = {t: i for i, t in enumerate(distinct)}
    sig = signatures(distinct, samples)
    own, nxt, alt = (sig[[at[t] for t in part]] for part in (texts, nexts, changed))
    hexes = lambda s: [row.astype(">u4").tobytes().hex() for row in s]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed], pa.string()),
         pa.array(hexes(own), pa.string()), pa.array(hexes(alt), pa.string()),
         pa.array((own == alt).mean(axis=1) if m else [], pa.float64()), pa.array((own == nxt).mean(axis=1) if m else [], pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) dealt and sorted so that the next
    document of each row of a bucket follows it; ``tail`` marks the copies
    that close a bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    buckets = max(4 * input_tasks(spark), -(-count // ROWS_PER_BUCKET))
    found = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets).alias("q")).first()["q"]
    bounds = sorted(set(found or []))
    # bucket 0: null ids; then one for each range of ids
    above = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(1 + above))
    firsts = sorted((r["bucket"], r["least"]) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("least")).collect())
    if not firsts:
        return placed.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")
    names = [b for b, _ in firsts]
    before = dict(zip(names, [names[-1], *names[:-1]]))            # the bucket before, cyclic
    by_bucket, last = dict(firsts), names[-1] + 1
    previous = F.element_at(F.array(*[F.lit(before.get(b, -1)) for b in range(last)]), F.col("bucket") + 1)
    least = F.element_at(F.array(*[F.lit(by_bucket.get(b)).cast("long") for b in range(last)]), F.col("bucket") + 1)
    here = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    there = F.struct(previous.alias("bucket"), F.lit(True).alias("tail"))
    copies = F.when(F.col("doc_id").eqNullSafe(least), F.array(here, there)).otherwise(F.array(here))
    dealt = placed.withColumn("to", F.explode(copies)).select("to.bucket", "to.tail", "doc_id", "text")
    return dealt.repartition(input_tasks(spark), "bucket").sortWithinPartitions(
        "bucket", "tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def compare_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text and
    the likeness to the edited text and to the next document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, nexts, chars = [], [], [], 0
        open_bucket = pending = None
        for batch in batches:
            for bucket, tail, ident, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != open_bucket:
                    open_bucket, pending = bucket, None
                if pending is not None:
                    ids.append(pending[0])
                    texts.append(pending[1])
                    nexts.append(text)
                    chars += len(text)
                    if chars > CHUNK_CHARS:
                        yield _compare(ids, texts, nexts, samples)
                        ids, texts, nexts, chars = [], [], [], 0
                pending = None if tail else (ident, text)
        if ids:
            yield _compare(ids, texts, nexts, samples)

    return with_next(docs).select("bucket", "tail", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
