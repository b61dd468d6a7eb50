"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document; every word
covered by a window whose word sequence also starts anywhere else is
removed.  Windows are judged on the input.

1. *Anchors*: each document is cut into non-overlapping blocks of
   ``(WINDOW + 1) / 2`` words, the index; every rolling window of that many
   words probes it.  Any full window contains a whole block, so a window
   that occurs twice makes its own block meet a probe from elsewhere.
2. *Extension*: around each block that met a foreign probe, every full
   window that contains the block is compared, as a whole, with those of
   all other hits.
3. Runs of repeated windows are the maximal exact repeats; their words go.

Blocks, probes and windows meet by hash bucket (`shards`): one packed row
per shard and bucket, answers per shard.  A shard names a hash once, and
once more among those it holds twice or more, however often it occurs;
positions never leave the shard: a bucket answers with the hashes that
occur elsewhere too, and the shard finds them again.  A passage that very
many documents share thus is a few bytes per shard, counted, never paired.
Step 1 compares 32 hash bits within a bucket, which may only admit
candidates; step 3 rests on 64 bits within a bucket that is chosen by an
independent hash.

Defined results: a null or empty text has no words and nothing removed; a
repeated row (equal texts) is a repeat like any other; every input row
gives one output row; extra columns are kept by `deduplicated` and ignored
by `removals`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as sh
from .common import input_tasks

WINDOW = 35
_SECOND = 0xD1B54A32D192ED03        # base of the hash that picks a window's bucket

_HASHES = sh.WordHashes()


def _words(texts: list[str | None]) -> list[list[bytes]]:
    return [t.encode("utf-8").split() if t else [] for t in texts]     # bytes.split: ASCII white space


def _spans(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the documents in the shard's sequence of words."""
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.cumsum(sizes) - sizes, sizes


def _hash_words(split: list[list[bytes]]) -> np.ndarray:
    of = _HASHES.__getitem__
    out = np.concatenate([np.fromiter(map(of, ws), np.uint64, len(ws)) for ws in split]) if split else np.zeros(0, np.uint64)
    _HASHES.trim()
    return out


def _starts_of(starts: np.ndarray, sizes: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, position in its document) of each run of ``run`` words in
    documents of at least ``least`` words."""
    counts = np.where(sizes >= least, sizes - run + 1, 0)
    total = int(counts.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return inner + np.repeat(starts, counts), inner


def _block_hashes(split: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, whether it begins a block) of every run of block length."""
    block = (window + 1) // 2
    position, inner = _starts_of(*_spans(split), block, window)
    if not len(position):
        return position, np.zeros(0, np.uint64), np.zeros(0, bool)
    return position, sh.run_hashes(_hash_words(split), block)[position], inner % block == 0


def _anchor_rows(payload: bytes, shard: int, buckets: int, window: int) -> Iterator[tuple]:
    """Rows (bucket, shard, probes, probes held twice or more, blocks) of one shard: sets of hashes."""
    _, h, is_block = _block_hashes(_words(sh.from_bytes(payload).column("text").to_pylist()), window)
    if not len(h):
        return
    order, ends = sh.by_bucket(h, buckets)
    value, is_block = h[order].astype(np.uint32), is_block[order]
    first = 0
    for bucket, last in enumerate(ends.tolist()):
        if last > first:
            v = value[first:last]
            yield bucket, shard, sh.pack_set(np.unique(v)), sh.pack_set(_twice(v)), sh.pack_set(np.unique(v[is_block[first:last]]))
        first = last


def _twice(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values that occur twice or more."""
    s = np.sort(values)
    again = s[1:][s[1:] == s[:-1]]
    return again[np.concatenate(([True], again[1:] != again[:-1]))] if len(again) else again


def _within(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Mask of ``values`` that are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


_ANSWER = pa.schema([("shard", pa.int64()), ("hits", pa.binary())])


def _answers(table: pa.Table, values: list[np.ndarray], wanted: np.ndarray) -> pa.Table:
    """Each shard's ``values`` that are wanted, after the bucket's number."""
    bucket = np.uint32(table.column("bucket")[0].as_py()).tobytes()
    out_shard, out_hits = [], []
    for s, v in zip(table.column("shard").to_pylist(), values):
        hit = v[_within(v, wanted)]
        if len(hit):
            out_shard.append(s)
            out_hits.append(bucket + hit.tobytes())
    return pa.table([pa.array(out_shard, pa.int64()), pa.array(out_hits, pa.binary())], schema=_ANSWER)


def _read_answers(hits: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, hash) of all answers to a shard."""
    values = [np.frombuffer(x, kind, offset=4) for x in hits]
    buckets = np.array([int.from_bytes(x[:4], "little") for x in hits], np.uint64)
    return np.repeat(buckets, [len(v) for v in values]), np.concatenate(values)


def _elsewhere(sets: list[np.ndarray], again: list[np.ndarray]) -> np.ndarray:
    """Values in two sets or more, or held twice or more by one shard."""
    return np.unique(np.concatenate([_twice(np.concatenate(sets)), *again]))


def _meet_anchors(table: pa.Table) -> pa.Table:
    """One bucket: block hashes that some other probe has, per shard."""
    probes, again, blocks = ([sh.unpack_set(x) for x in table.column(c).to_pylist()] for c in ("probes", "again", "blocks"))
    # a block is a probe of its own, so a value probed twice has a foreign probe
    return _answers(table, blocks, _elsewhere(probes, again))


def _window_rows(payload: bytes, shard: int, hits: list[bytes], buckets: int, window: int) -> Iterator[tuple]:
    """Rows (bucket, shard, window hashes, those held twice or more): full windows around the hit blocks."""
    block = (window + 1) // 2
    split = _words(sh.from_bytes(payload).column("text").to_pylist())
    starts, sizes = _spans(split)
    at, inner = _starts_of(starts, sizes, block, window)
    at = at[inner % block == 0]
    hashes = _hash_words(split)
    h = sh.run_hashes(hashes, block)[at]
    bucket, value = _read_answers(hits, np.uint32)
    wanted = np.sort((bucket << np.uint64(32)) | value.astype(np.uint64))
    hit = at[_within((sh.bucket_of(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), wanted)]
    doc = np.searchsorted(starts + sizes, hit, side="right")
    first = np.maximum(hit - (window - block), starts[doc])
    last = np.minimum(hit, starts[doc] + sizes[doc] - window)
    count = np.maximum(last - first + 1, 0)
    total = int(count.sum())
    if not total:
        return
    position = np.unique(np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count))
    value = sh.run_hashes(hashes, window)[position]
    order, ends = sh.by_bucket(sh.run_hashes(hashes, window, _SECOND)[position], buckets)
    value = value[order]
    begin = 0
    for number, end in enumerate(ends.tolist()):
        if end > begin:
            v = value[begin:end]
            yield number, shard, np.unique(v).tobytes(), _twice(v).tobytes()
        begin = end


def _meet_windows(table: pa.Table) -> pa.Table:
    """One bucket: windows that occur twice or more, per shard."""
    values, again = ([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()] for c in ("windows", "again"))
    return _answers(table, values, _elsewhere(values, again))


def _covered(split: list[list[bytes]], hits: list[bytes], buckets: int, window: int) -> np.ndarray:
    """Mask of the shard's words that a repeated window covers."""
    starts, sizes = _spans(split)
    position, _ = _starts_of(starts, sizes, window, window)
    hashes = _hash_words(split)
    bucket, value = _read_answers(hits, np.uint64)
    order = np.argsort(value, kind="stable")
    bucket, value = bucket[order], value[order]
    h = sh.run_hashes(hashes, window)[position]
    found = _within(h, value)
    position, h = position[found], h[found]
    own = sh.bucket_of(sh.run_hashes(hashes, window, _SECOND)[position], buckets)
    position = position[bucket[np.searchsorted(value, h)] == own] if len(position) else position
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, position, 1)
    np.add.at(edge, position + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _removal_batch(payload: bytes, hits: list[bytes], buckets: int, window: int,
                   emit: Callable[[pa.RecordBatch, list, list], pa.RecordBatch]) -> pa.RecordBatch:
    batch = sh.from_bytes(payload)
    split = _words(batch.column("text").to_pylist())
    starts, sizes = _spans(split)
    gone = _covered(split, hits, buckets, window) if hits else None
    masks = [gone[s:s + n] if hits else None for s, n in zip(starts.tolist(), sizes.tolist())]
    return emit(batch, split, masks)


def _kept(ws: list[bytes], mask) -> list[bytes]:
    return ws if mask is None or not mask.any() else [w for w, g in zip(ws, mask.tolist()) if not g]


def _digests(batch: pa.RecordBatch, split: list, masks: list) -> pa.RecordBatch:
    kept = [_kept(ws, m) for ws, m in zip(split, masks)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([len(ws) for ws in split], pa.int64()),
         pa.array([len(ws) - len(k) for ws, k in zip(split, kept)], pa.int64()),
         pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batch: pa.RecordBatch, split: list, masks: list) -> pa.RecordBatch:
    """The batch with shortened texts (and their n_chars); other rows as they are."""
    texts = batch.column("text").to_pylist()
    changed = [i for i, m in enumerate(masks) if m is not None and m.any()]
    for i in changed:
        texts[i] = b" ".join(_kept(split[i], masks[i])).decode("utf-8")
    columns = list(batch.columns)
    columns[batch.schema.get_field_index("text")] = pa.array(texts, batch.schema.field("text").type)
    at = batch.schema.get_field_index("n_chars")
    if at >= 0 and pa.types.is_integer(batch.schema.field(at).type):
        chars = columns[at].to_pylist()
        for i in changed:
            chars[i] = len(texts[i])
        columns[at] = pa.array(chars, batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _by_shard(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """Each shard's payload (first row) and the answers to it, dealt by shard."""
    empty = F.lit(None).cast("binary")
    both = packed.select("shard", "payload", empty.alias("hits")).unionByName(answers.select("shard", empty.alias("payload"), "hits"))
    return both.repartition(input_tasks(packed.sparkSession), "shard") \
        .sortWithinPartitions("shard", F.col("payload").isNull()).select("shard", "payload", "hits")


def _shard_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(shard, payload, answers) from rows in the order of `_by_shard`."""
    shard, payload, hits = None, None, []
    for batch in batches:
        for s, p, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if s != shard:
                if payload is not None:
                    yield shard, payload, hits
                shard, payload, hits = s, None, []
            if p is not None:
                payload = p
            if h is not None:
                hits.append(h)
    if payload is not None:
        yield shard, payload, hits


def _repeats(packed: DataFrame, buckets: int, window: int) -> DataFrame:
    """(shard, hits): bucket number and hashes of the repeated windows of each shard."""
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, p in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if rows := list(_anchor_rows(p, s, buckets, window)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                        names=["bucket", "shard", "probes", "again", "blocks"])
        _HASHES.clear()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, p, hits in _shard_stream(batches):
            if hits and (rows := list(_window_rows(p, s, hits, buckets, window))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 2))],
                    names=["bucket", "shard", "windows", "again"])
        _HASHES.clear()

    answer = "shard long, hits binary"
    met = packed.select("shard", "payload").mapInArrow(
        anchors, "bucket int, shard long, probes binary, again binary, blocks binary") \
        .groupBy("bucket").applyInArrow(_meet_anchors, answer)
    return _by_shard(packed, met).mapInArrow(windows, "bucket int, shard long, windows binary, again binary") \
        .groupBy("bucket").applyInArrow(_meet_windows, answer)


def _removed(docs: DataFrame, emit, schema, window: int) -> DataFrame:
    packed = sh.pack(docs, "substring")
    buckets = sh.bucket_count(sh.text_chars(docs) / 6)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload, hits in _shard_stream(batches):
            yield _removal_batch(payload, hits, buckets, window, emit)
        _HASHES.clear()

    return _by_shard(packed, _repeats(packed, buckets, window)).mapInArrow(remove, schema)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space)."""
    return _removed(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _digests,
                    "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their repeated words: a text that loses words
    becomes its kept words joined by one space (and ``n_chars`` follows), any
    other row stays as it is; all columns."""
    return _removed(docs, _texts, docs.schema, window)
