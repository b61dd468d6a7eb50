"""SimHash near-duplicates by BK-trees.

A fingerprint bit is set if it is set in more than half of the 64-bit
hashes of the text's word shingles.  Two texts are linked if their
fingerprints differ in at most ``radius`` bits; groups are the connected
components of the links.

Search: fingerprints are compared once each (copies share one).  They are
dealt to shards so that every pair within the radius meets in at least one:
with the 64 bits cut into ``b`` blocks, a pair within ``radius`` agrees in
``b - radius`` of them, so there is one shard per choice of that many
blocks and per value of their bits.  Each shard builds a BK-tree, children
keyed by their integer Hamming distance to the parent, and each of its
fingerprints descends the tree along edges within the radius of its own
distance to the node.  The trees of all shards together grow with the
data, so they are not broadcast: a shard's tree and its queries are
co-located by the shuffle instead.  ``b`` grows with the number of
fingerprints, which keeps shards small; a shard above ``TILE`` rows is
split into tiles and its tile pairs are searched by separate tasks.

A shard passes on a spanning forest of its links (fewer edges than rows),
never all pairs; `components` joins the forests.

Defined results: a null text and one without words have fingerprint zero
and are linked like any other; rows that share an id give one row each
(with equal text: equal rows); null ids count as larger than any other id,
and a group of null ids only has a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_limit, input_tasks, shared_table, spread_join
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 8_192            # fingerprints searched against each other in one group
SHARD_TARGET = 96       # expected fingerprints per shard that block choices aim at
CHUNK = 1 << 15         # fingerprints whose trees are built together
FRONTIER = 1 << 16      # (query, node) pairs expanded together


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash of the text's k-word shingles, repeats included."""
    words = text.encode("utf-8").lower().split() if text else []     # bytes.lower: A-Z only; split: ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[min(k, len(words)) - 1:].tolist())],
                      np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# -- BK-trees of many shards at once -----------------------------------------

class Forest:
    """One BK-tree per shard, built level by level with array operations.

    ``shard``: shard number of each fingerprint, ascending.  Node numbers
    are positions in ``fps``; the first fingerprint of a shard is its root."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.concatenate(([True], shard[1:] != shard[:-1]))
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]      # of each fingerprint's shard
        child_parent, child_edge, child_node = [], [], []
        below = np.flatnonzero(~first)                               # not yet placed
        parent = self.root[below]
        while len(below):
            edge = np.bitwise_count(fps[below] ^ fps[parent]).astype(np.int64)
            key = parent * 65 + edge
            order = np.argsort(key, kind="stable")
            key, below, parent, edge = key[order], below[order], parent[order], edge[order]
            lead = np.concatenate(([True], key[1:] != key[:-1]))     # the first of a group becomes the child
            child_parent.append(parent[lead])
            child_edge.append(edge[lead])
            child_node.append(below[lead])
            group = below[lead][np.cumsum(lead) - 1]
            below, parent = below[~lead], group[~lead]
        self.parent = np.concatenate(child_parent) if child_parent else np.zeros(0, np.int64)
        self.edge = np.concatenate(child_edge) if child_edge else np.zeros(0, np.int64)
        self.node = np.concatenate(child_node) if child_node else np.zeros(0, np.int64)
        # children of a node are consecutive and sorted by edge
        order = np.argsort(self.parent * 65 + self.edge, kind="stable")
        self.parent, self.edge, self.node = self.parent[order], self.edge[order], self.node[order]
        self.slot = self.parent * 65 + self.edge

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node), node != query, within ``radius``, in blocks."""
        queries, root = np.arange(len(self.fps), dtype=np.int32), self.root.astype(np.int32)
        child, step = self.node.astype(np.int32), 4_096
        for at in range(0, len(queries), step):
            stack = [(queries[at:at + step], root[at:at + step])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
                near = (d <= radius) & (q > node)        # each pair once
                if near.any():
                    yield q[near], node[near]
                # children along edges in [d - radius, d + radius]
                slot = node.astype(np.int64) * 65
                low = np.searchsorted(self.slot, slot + np.maximum(d - radius, 0), side="left")
                high = np.searchsorted(self.slot, slot + np.minimum(d + radius, 64), side="right")
                count = high - low
                total = int(count.sum())
                if total:
                    pos = np.arange(total) + np.repeat(low - (np.cumsum(count) - count), count)
                    stack.append((np.repeat(q, count), child[pos]))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n items: the least item connected to it by ``pairs``."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            high, low = np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
            hook = np.arange(n)
            np.minimum.at(hook, high, low)
            while True:                                   # pointer jumping
                jumped = hook[hook]
                if (jumped == hook).all():
                    break
                hook = jumped
            label = hook[label]
    return label


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard hash columns.., fp) sorted by shard -> spanning edges (a, b).

    Consecutive shards are gathered up to ``CHUNK`` rows and searched together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush(last: bool):
        nonlocal held, size
        if not size:
            return None
        key = np.concatenate([k for k, _ in held])
        fps = np.concatenate([f for _, f in held])
        cut = len(fps) if last else int(np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1) if (key != key[-1]).any() else 0
        held, size = ([], 0) if cut == len(fps) else ([(key[cut:], fps[cut:])], len(fps) - cut)
        if cut < 2:
            return None
        key, fps = key[:cut], fps[:cut]
        shard = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).any(axis=1).astype(np.int64))))
        label = spanning(cut, Forest(fps, shard).links(radius))
        linked = np.flatnonzero(label != np.arange(cut))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[label[linked]].view(np.int64))],
                                          names=["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1).astype(np.int64)
        held.append((key, batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)))
        size += batch.num_rows
        if size >= CHUNK and (out := flush(False)) is not None:
            yield out
    if (out := flush(True)) is not None:
        yield out


def block_choices(n: int, radius: int = RADIUS, target: int = SHARD_TARGET) -> list[list[tuple[int, int]]]:
    """Choices of bit blocks (shift, width) whose joint value names a shard.

    The fewest blocks for which n fingerprints spread to at most ``target``
    per shard on average; any number of blocks finds every pair."""
    b = radius + 1
    while b < radius + 4 and n / 2 ** ((b - radius) * (64 // b)) > target:
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    blocks = [(64 - hi, hi - lo) for lo, hi in zip(edges, edges[1:])]
    return [list(c) for c in combinations(blocks, b - radius)]


def near_edges(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: a spanning forest of
    each shard's links, so connectivity is that of all links."""
    tables = []
    for i, choice in enumerate(block_choices(n, radius)):
        key = F.lit(0).cast("long")
        for shift, width in choice:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(part)
        tables.append(F.struct(F.lit(i).cast("long").alias("t"), key.alias("key")))
    dealt = distinct.select("fp", F.explode(F.array(*tables)).alias("s")).select("s.t", "s.key", "fp")
    # shards of one row have no pair; large ones are split into tiles
    shards = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("t", "key", F.ceil(F.col("n") / tile).cast("long").alias("g"))
    own = F.pmod(F.xxhash64("fp"), F.col("g"))
    other = F.explode(F.when(F.col("g") > 1, F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    rows = dealt.join(shards, ["t", "key"]).withColumn("own", F.when(F.col("g") > 1, own).otherwise(F.lit(0).cast("long"))) \
        .withColumn("other", other).where("g = 1 or own <> other") \
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    tasks = input_tasks(distinct.sparkSession)
    return rows.repartition(tasks, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j") \
        .mapInArrow(lambda batches: _search(batches, radius), "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the group of every fingerprint of ``prints`` (column fp)
    that is near another one; fingerprints without a neighbour are absent."""
    distinct = prints.select("fp").distinct()
    return components(near_edges(distinct, distinct.count(), radius))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, n_same
    (documents with that fingerprint)."""
    prints = shared_table(fingerprints(docs, k), "simhash")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same"))
    near = groups(per_print, radius)
    placed = per_print.join(near.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_print = spread_join(placed, least, "root", "fp", hub_limit(prints.count())).select("fp", "component_id", "n_same")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def one_of_each_group(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The document with the least id of each group (null ids last, ties by
    text hash, one of repeated rows), all columns as they are."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    schema = "fp long, " + ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, k) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), *batch.columns],
                                             names=["fp", *(f"c{i}" for i in range(batch.num_columns))])

    ident = F.col(f"c{docs.columns.index('doc_id')}")
    names = [f"c{i}" for i in range(len(docs.columns))]
    hashed = [f"c{i}" for i, f in enumerate(docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    rank = F.struct(ident.isNull().alias("no_id"), ident.alias("id"), F.xxhash64(f"c{at}").alias("tie"),
                    F.xxhash64(*hashed).alias("row_tie"))
    # the best row of each fingerprint, combined before the shuffle: copies never meet in one task
    best = docs.mapInArrow(run, schema).groupBy("fp").agg(
        F.min(rank).alias("rank"), F.min_by(F.struct(*names), rank).alias("row"))
    best = shared_table(best, "simhash-best")
    ranks = best.select("fp", "rank")
    near = groups(ranks, radius)
    placed = ranks.join(near.withColumnRenamed("node", "fp"), "fp", "inner")
    winner = placed.groupBy("root").agg(F.min(F.struct("rank", "fp")).alias("w"), F.count(F.lit(1)).alias("n"))
    losers = spread_join(placed, winner, "root", "fp", hub_limit(best.count())).where("fp <> w.fp").select("fp")
    return best.join(losers, "fp", "left_anti").select("row.*").toDF(*docs.columns)
