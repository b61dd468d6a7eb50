"""Shards: runs of documents packed into one row, and the exchange of word
(or word-run) hashes between shards.

Operators that must know, for every word or word run of a text, whether or
how often it occurs elsewhere would need a row per word.  Instead each
shard sends, per hash bucket, one row with the packed hashes of its words;
a bucket counts them over all shards and answers each shard with one row.
A shard names a hash once however often it holds it, so a very frequent
word or passage is a handful of bytes per shard: a bucket grows with the
number of shards that hold a key, not with the key's occurrences.

The packed table is written once to the shared checkpoint folder; shard
numbers come from that table, so they do not change if a task is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

SHARD_CHARS = 4_000_000       # characters per shard, at least one document
BUCKET_WORDS = 1 << 21        # words per hash bucket that small corpora aim at ...
FEW_BUCKETS = 4_096           # ... up to so many buckets; then buckets grow ...
BUCKET_WORDS_MOST = 1 << 26   # ... to this size, and from there their number again

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_CACHE_WORDS = 150_000


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered; bounded by `trim`."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > _CACHE_WORDS:
            self.clear()


def bucket_count(words: float) -> int:
    """Number of hash buckets for a corpus of so many words."""
    return max(1, int(-(-words // BUCKET_WORDS_MOST)), min(int(-(-words // BUCKET_WORDS)), FEW_BUCKETS))


def text_chars(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def run_hashes(h: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries of ``h`` (len(h) - n + 1 of them).

    Polynomial in ``base`` modulo 2^64, built by doubling run lengths, then mixed."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, part, size = None, 0, h, 1
        while True:
            if n & size:            # prepend the part to what is built so far
                if out is None:
                    out, done = part, size
                else:
                    m = len(h) - (done + size) + 1
                    out = part[:m] * np.uint64(pow(base, done, 1 << 64)) + out[size:size + m]
                    done += size
            if size * 2 > n:
                break
            m = len(h) - 2 * size + 1
            part = part[:m] * np.uint64(pow(base, size, 1 << 64)) + part[size:size + m]
            size *= 2
        return mix(out[:len(h) - n + 1])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): hashes in bucket order (stable) and the end of each bucket in it."""
    bucket = bucket_of(hashes, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, np.cumsum(np.bincount(bucket, minlength=buckets))


# -- packing -------------------------------------------------------------------

def pack(docs: DataFrame, name: str, limit: int = SHARD_CHARS) -> DataFrame:
    """(shard, payload): runs of rows of ``docs`` (which has a column text),
    all columns, as compressed Arrow data; written to the shared folder."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(at)), 0)
            sizes = np.cumsum(chars.to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([to_bytes(batch.slice(start, stop - start))], pa.binary())],
                    names=["shard", "payload"])
                shard, start = shard + 1, stop

    return shared_table(docs.mapInArrow(run, "shard long, payload binary"), name, compression="none")


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def pack_set(values: np.ndarray) -> bytes:
    """uint32 values in any order: sorted, as gaps, compressed byte plane by byte plane."""
    gaps = np.diff(np.sort(values), prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_set(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)
