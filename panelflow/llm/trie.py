"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of a conversation's first d turns (role and
text); its members are the conversations that start with it, and its id is
(smallest member, d).  For each node: members, children, leaves below it,
the tokens that sharing prefixes saves below it, and a digest of the
conversations that end in it.

1. *Prefix hashes.*  Turns are range partitioned by (conversation, turn) and
   each partition is scanned once: a polynomial hash of the turns so far, in
   two independent 64-bit halves.  Partitions that cut a conversation pass
   their count and hash on, one row per partition, so a conversation of any
   length is spread over as many tasks as its turns need.
2. *Nodes* are a grouped aggregate over (depth, hash), combined before the
   shuffle: copies and a common first turn cost a row per task.
3. *Shards.*  A node with more turns at or below it than ``limit`` is an
   upper node.  A node that is not, below one that is, is a shard root;
   limits grow with the table so that there are at most ``SHARDS`` upper
   nodes a level.  Shards are dealt to tasks by their roots.
4. *Time-forward processing.*  A task sorts its nodes by reverse level order
   (Spark's external sort) and takes them one by one: a node collects from
   a priority queue what its children have sent, completes its totals and
   sends them to its parent, which is still to come.  The queue holds the
   messages to one level at most two at a time; beyond ``QUEUE`` messages it
   writes sorted runs to an unnamed file of the task and merges them.  (The
   file is private to the task: if the executor is lost, the repeated task
   makes its own.)  Shard roots' totals are then added up per parent, and
   the upper nodes are processed the same way.

Defined results: turns in order of ``turn``, null first, ties by a hash of
role and text; null role or text: empty; rows with a null conv_id belong to
no conversation; repeated rows are repeated turns; an empty table has no
node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_tasks, shared_table

SHARDS = 4_096            # upper nodes a level, at most
SHARD_TURNS = 1_000       # a shard may always have so many turns
QUEUE = 500_000           # messages that a priority queue keeps in memory
IDS = 65_536              # conversation ids joined in one piece

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))      # odd: they have inverses modulo 2^64
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
KEY = ("depth", "k1", "k2")
PREFIX_ROWS = "conv_id long, depth long, len long, chars long, k1 long, k2 long, u1 long, u2 long"


# -- prefix hashes --------------------------------------------------------------------

def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _i64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, t1, t2, chars) -> positions and prefix hashes within the
    partition; at its end a row with chars -1: its last conversation's count and hash."""
    part, names = TaskContext.get().partitionId(), ["part", "conv_id", "pos", "chars", "p1", "p2", "q1", "q2"]
    last, count, carry = None, 0, [np.uint64(0), np.uint64(0)]

    def rows(conv, pos, chars, p, q):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), pa.array(conv), pa.array(pos), pa.array(chars),
                                           _i64(p[0]), _i64(p[1]), _i64(q[0]), _i64(q[1])], names=names)

    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy(zero_copy_only=False)
            begins = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
            run = np.cumsum(begins)                      # 0: the conversation of the batch before goes on
            first = np.concatenate(([0], np.flatnonzero(begins))) if not begins[0] else np.flatnonzero(begins)
            at = first[run - run[0]]
            pos = np.arange(len(conv)) - at + 1 + np.where(run == 0, count, 0)
            p, q = [], []
            for i in (0, 1):
                step = _u64(batch.column(1 + i)) * np.power(BASES[i], pos.astype(np.uint64))
                total = np.cumsum(step)
                before = np.where(at > 0, total[at - 1], np.uint64(0)) - np.where(run == 0, carry[i], np.uint64(0))
                p.append(total - before)
                q.append(p[i] - step)
            yield rows(conv, pos, batch.column(3).to_numpy(zero_copy_only=False), p, q)
            last, count, carry = conv[-1], int(pos[-1]), [p[0][-1], p[1][-1]]
        if last is not None:
            end = [np.array([c]) for c in carry]
            yield rows(np.array([last]), np.array([count]), np.array([-1]), end, end)


def prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, pos, chars, p1, p2, q1, q2) per turn: its number from 1, the
    code points of its text, the hash of the turns up to it and before it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("spread")]
    turns = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("spread"))        # equal rows can then be dealt to several tasks
    sorted_turns = turns.repartitionByRange(input_tasks(convs.sparkSession), *order).sortWithinPartitions(*order)
    scanned = shared_table(sorted_turns.select("conv_id", "t1", "t2", "chars").mapInArrow(
        _scan, "part long, conv_id long, pos long, chars long, p1 long, p2 long, q1 long, q2 long"), "trie-turns")

    # one row per partition: what a conversation that is cut there has so far
    before: dict[int, list[tuple[int, int, np.uint64, np.uint64]]] = {}
    with np.errstate(over="ignore"):
        for r in sorted(scanned.where("chars < 0").collect(), key=lambda r: r["part"]):
            n, a, b = before[r["conv_id"]][-1][1:] if r["conv_id"] in before else (0, np.uint64(0), np.uint64(0))
            h = [x + y * np.power(base, np.uint64(n)) for x, y, base in
                 zip((a, b), np.array([r["p1"], r["p2"]], np.int64).view(np.uint64), BASES)]
            before.setdefault(r["conv_id"], []).append((r["part"], n + r["pos"], *h))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.array(sorted(before), np.int64)
        for batch in batches:
            part, conv, pos = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            pos, hashes = pos.copy(), [_u64(batch.column(i)).copy() for i in range(4, 8)]
            with np.errstate(over="ignore"):
                for c in cut[np.isin(cut, conv)].tolist():
                    for p in np.unique(part[conv == c]).tolist():
                        earlier = [x for x in before[c] if x[0] < p]
                        if earlier:
                            _, n, *h = earlier[-1]
                            mine = (conv == c) & (part == p)
                            pos[mine] += n
                            for i, x in enumerate(hashes):
                                x[mine] = h[i % 2] + x[mine] * np.power(BASES[i % 2], np.uint64(n))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pos), batch.column(3), *map(_i64, hashes)],
                                             names=["conv_id", "pos", "chars", "p1", "p2", "q1", "q2"])

    return scanned.where("chars >= 0").mapInArrow(
        shift, "conv_id long, pos long, chars long, p1 long, p2 long, q1 long, q2 long")


def _with_roots(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.unionByName(lengths.select("conv_id", zero.alias("depth"), "len", zero.alias("chars"),
                                           *[zero.alias(c) for c in ("k1", "k2", "u1", "u2")]))


def conversation_prefixes(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, len, chars, k1, k2, u1, u2): every prefix of every
    conversation, the empty one included, with its hash and its parent's."""
    turns = prefixes(convs)
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    rows = turns.join(lengths, "conv_id").select("conv_id", F.col("pos").alias("depth"), "len", "chars", F.col("p1").alias("k1"),
                                                 F.col("p2").alias("k2"), F.col("q1").alias("u1"), F.col("q2").alias("u2"))
    return shared_table(_with_roots(rows, lengths), "trie-prefixes")


def branched_prefixes(convs: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """As `conversation_prefixes`, of conversations rebuilt as branches: the
    first h turns of conversation c - c % family (as many as it has), then the
    own turns after the first h, with h = crc32(c) % most."""
    turns = shared_table(prefixes(convs), "trie-numbered")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), *[
        F.coalesce(F.max(F.when(F.col("pos") == h, F.col(p))), F.lit(0)).alias(a) for p, a in (("p1", "a1"), ("p2", "a2"))])
    trunks = turns.where(F.col("conv_id") % family == 0).where(F.col("pos") < most).groupBy(F.col("conv_id").alias("trunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "chars", "p1", "p2", "q1", "q2"))).alias("heads"))     # fewer than ``most`` turns
    heads = F.coalesce(F.size("heads"), F.lit(0)).cast("long")
    plans = own.withColumn("h", h).withColumn("trunk", F.col("conv_id") - F.col("conv_id") % family).join(trunks, "trunk", "left") \
        .withColumn("hb", F.least("h", F.when(F.col("heads").isNull(), F.lit(0).cast("long")).otherwise(heads))) \
        .withColumn("len", F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    end = F.get("heads", (F.col("hb") - 1).cast("int"))
    plans = shared_table(plans.select("conv_id", "len", "h", "hb", "a1", "a2", F.coalesce(end["p1"], F.lit(0)).alias("b1"),
                                      F.coalesce(end["p2"], F.lit(0)).alias("b2"),
                                      F.slice("heads", 1, F.col("hb").cast("int")).alias("heads")), "trie-plans")
    taken = plans.select("conv_id", "len", F.explode("heads").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "len", "t.chars", F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"),
        F.col("t.q1").alias("u1"), F.col("t.q2").alias("u2"))

    def graft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The own turns' hash after h turns, moved to after the hb turns taken."""
        for batch in batches:
            x = {n: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, n in enumerate(batch.schema.names)}
            with np.errstate(over="ignore"):
                keys = [x[f"b{i}"].view(np.uint64) + np.power(INVERSES[i - 1], (x["h"] - x["hb"]).astype(np.uint64))
                        * (x[f"{p}{i}"].view(np.uint64) - x[f"a{i}"].view(np.uint64)) for p in ("p", "q") for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x["conv_id"]), pa.array(x["pos"] - x["h"] + x["hb"]), pa.array(x["len"]),
                                              pa.array(x["chars"]), *map(_i64, keys)],
                                             names=["conv_id", "depth", "len", "chars", "k1", "k2", "u1", "u2"])

    kept = turns.join(plans.drop("heads"), "conv_id").where("pos > h").mapInArrow(graft, PREFIX_ROWS)
    return shared_table(_with_roots(taken.unionByName(kept), plans), "trie-prefixes")


# -- time-forward processing -----------------------------------------------------------

class SpillingQueue:
    """Priority queue of tuples; beyond ``limit`` its content goes to a sorted
    run in an unnamed file, and runs are merged as they are read."""

    def __init__(self, limit: int = QUEUE, block: int = 4_096):
        self.limit, self.block, self.heap, self.runs, self.n_runs = limit, block, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort()
        for at in range(0, len(self.heap), self.block):
            pickle.dump(self.heap[at:at + self.block], file)
        file.seek(0)
        self.heap = []
        self.n_runs += 1
        self._head(self._read(file), self.n_runs)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _head(self, run: Iterator[tuple], number: int) -> None:
        item = next(run, None)
        if item is not None:
            heapq.heappush(self.runs, (item, number, run))

    def pop_at(self, key: tuple) -> Iterator[tuple]:
        """Remove and yield the items that begin with ``key``, the least there is."""
        size = len(key)
        while True:
            if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
                if self.heap[0][:size] != key:
                    return
                yield heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][:size] == key:
                item, number, run = heapq.heappop(self.runs)
                self._head(run, number)
                yield item
            else:
                return


STATE = "depth long, k1 long, k2 long, u1 long, u2 long, chars long, conv_id long, n_convs long, top long"
TOTALS = "n_children long, n_leaves long, saved long"


def _time_forward(batches: Iterator[pa.RecordBatch], queue_limit: int) -> Iterator[pa.RecordBatch]:
    """Nodes (STATE, then what other shards have sent) in reverse level order
    -> the nodes with their subtree totals; ``top``: their shard root's depth."""
    queue = SpillingQueue(queue_limit)
    for batch in batches:
        found = ([], [], [])
        for depth, k1, k2, u1, u2, chars, _, n_convs, top, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            saved += (n_convs - 1) * chars
            for _, _, _, more_leaves, more_saved in queue.pop_at((-depth, k1, k2)):
                children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
            leaves = leaves if children else 1
            if depth > top:
                queue.push((1 - depth, u1, u2, leaves, saved))
            for values, v in zip(found, (children, leaves, saved)):
                values.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:9], *(pa.array(v, pa.int64()) for v in found)],
                                         names=[*batch.schema.names[:9], "n_children", "n_leaves", "saved"])


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes in which a conversation ends.

    Ids are sorted over the cluster and joined to pieces there; a node's pieces
    are then digested in order, as SHA-256 asks for, piece by piece."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0) if batch.num_rows else np.zeros(0, bool)
            at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            cuts = sorted({x for a, b in zip(at, at[1:]) for x in range(a, b, IDS)})
            text = [",".join(map(str, cols[3][a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], batch.num_rows])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[cuts].astype(np.int64)) for c in cols), pa.array(text, pa.string())],
                                             names=[*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([sha.hexdigest()])],
                                              names=[*KEY, "ends_sha256"])

        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if k != key:
                    if key is not None:
                        out.append(row())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if key is not None:
            yield row()

    n = input_tasks(rows.sparkSession)
    ordered = rows.where("depth = len").select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ordered.mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids string")
    return joined.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, shards: int = SHARDS, shard_turns: int = SHARD_TURNS, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie over prefix rows (see `conversation_prefixes`):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n = input_tasks(rows.sparkSession)
    limit = max(shard_turns, rows.count() // shards)
    nodes = shared_table(rows.groupBy(*KEY, "u1", "u2", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight")), "trie-nodes")
    is_upper = (F.col("weight") > limit) | (F.col("depth") == 0)
    upper = shared_table(nodes.where(is_upper), "trie-upper")
    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    # each conversation's shard root: its first node below the upper ones
    tops = rows.where("depth > 0").join(parents, ["depth", "u1", "u2"]).join(upper.select(*KEY), list(KEY), "left_anti") \
        .select("conv_id", F.col("depth").alias("top"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved")]
    state = [c.split()[0] for c in STATE.split(", ")]
    reverse = [F.col("depth").desc(), F.col("k1"), F.col("k2")]

    def forward(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(*reverse).mapInArrow(lambda b: _time_forward(b, queue), f"{STATE}, {TOTALS}")

    sharded = nodes.where(~is_upper).join(tops, "conv_id").select(*state, *zero, "s1", "s2").repartition(n, "s1", "s2")
    lower = shared_table(forward(sharded.drop("s1", "s2")), "trie-lower")
    sent = lower.where("depth = top").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    roots = upper.withColumn("top", F.lit(0).cast("long")).join(sent, list(KEY), "left").select(
        *state, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_children", "n_leaves", "saved")])
    done = lower.unionByName(forward(roots.repartition(1)))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                         F.col("conv_id").alias("parent_conv_id"))
    # the root has no parent; its zero keys would otherwise name itself
    return done.join(above, ["depth", "u1", "u2"], "left").join(_ends(rows), list(KEY), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
