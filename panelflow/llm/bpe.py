"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern; each piece starts as its
bytes, and the adjacent pair of lowest rank (leftmost among equals) is
merged until no pair has a rank.  The merge order of a piece is kept in a
*segment tree over its byte positions*: leaf ``p`` holds the rank of the
pair that starts at live byte ``p``, each inner node the least
``rank * width + position`` below it, so the root names the leftmost
minimum.  A merge changes three leaves (the merged pair, its right
neighbour, its left neighbour) and their paths: logarithmic point updates.

Many pieces are merged at once: the trees of all distinct pieces of a
batch are rows of one numpy array per size class, and each round takes
the root of every unfinished tree and updates the three paths of all of
them together.  A single very long piece is one wide tree.

The vocabulary (ranks in tiktoken's text format) is a parameter; the driver
reads the file once and ships its bytes with the tasks (fixed size, less
than 1 MB for 50,000 ids).

Defined results: a null text is the empty text (no ids); every input row
gives one output row (repeated rows and null ids included); extra input
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks

NONE = -1
_LEAF_LIMIT = 1 << 20          # leaves per array of trees
_CACHE_PIECES = 150_000        # distinct pieces in each of a worker's two cache generations
_FEW_ROWS = 4                  # so few trees are merged one by one: no array overhead per merge

# The white space of the Unicode property, as tokenizer patterns mean by \s:
# Python's own \s also has the separators U+001C to U+001F.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def compile_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with ``\\s`` and ``\\S`` as the Unicode White_Space property."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in (r"\s", r"\S"):
            if two == r"\S":
                out.append(f"[^{_SPACE}]")      # patterns use \S outside classes only
            else:
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(two)
            i += 2
            continue
        in_class = {"[": True, "]": False}.get(pattern[i], in_class)
        out.append(pattern[i])
        i += 1
    return regex.compile("".join(out))


class BytePairCodec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(self.size)]
        self.findall = compile_pattern(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._build_pairs()
        self.pair_of = None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _build_pairs(self) -> None:
        """Open-addressing table (left id, right id) -> rank of the merged pair."""
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        bits = max(4, int(4 * len(keys) + 16).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NONE, np.int32)
        slots, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):                       # one key takes each free slot, the others move on
            free = self._keys[slots] == -1
            taken, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[taken >= 0]
            self._keys[slots[first]] = keys[rest[first]]
            self._ranks[slots[first]] = np.array(rank, np.int32)[rest[first]]
            left_over = np.ones(len(rest), bool)
            left_over[first] = False
            rest, slots = rest[left_over], (slots[left_over] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where the pair does not merge."""
        keys = left.astype(np.int64) * self.size + right
        slots = self._slot(keys)
        found = self._keys[slots]
        out = np.where(found == keys, self._ranks[slots], np.int32(NONE))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self._mask
            found = self._keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    # -- merging ---------------------------------------------------------

    def merge_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece by the merge rule (no whole-piece shortcut)."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        width = 2
        todo = np.argsort(sizes, kind="stable")
        todo = todo[sizes[todo] > 0]
        while len(todo):
            cut = int(np.searchsorted(sizes[todo], width, side="right"))
            group, todo = todo[:cut], todo[cut:]
            step = max(1, _LEAF_LIMIT // width)
            for at in range(0, len(group), step):
                part = group[at:at + step]
                if len(part) <= _FEW_ROWS and width > 256:
                    for i in part.tolist():
                        out[i] = self._merge_one(pieces[i])
                    continue
                for i, ids in zip(part.tolist(), self._merge_group([pieces[i] for i in part], sizes[part], width)):
                    out[i] = ids
            width *= 2
        return out

    def _merge_group(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        column = np.arange(width, dtype=np.int64)
        live = column[None, :] < sizes[:, None]
        token = np.full((n, width + 1), NONE, np.int32)
        token[:, :width][live] = self.byte_ids[flat]
        wide = np.int64(self.size) * width
        none = np.int64(wide)                           # larger than any rank * width + position
        tree = np.full((n, 2 * width), none, np.int64)
        pairs = live[:, 1:]
        r = self.pair_ranks(token[:, :width - 1][pairs], token[:, 1:width][pairs]).astype(np.int64)
        leaves = np.where(r == NONE, none, r * width + np.broadcast_to(column[:width - 1], pairs.shape)[pairs])
        tree[:, width:2 * width - 1][pairs] = leaves
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        after = np.broadcast_to(column + 1, (n, width)).copy()      # next live position
        before = np.broadcast_to(column - 1, (n, width)).copy()
        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            busy = root < none
            rows, root = rows[busy], root[busy]
            if not len(rows):
                break
            at, merged = root % width, (root // width).astype(np.int32)
            right = after[rows, at]
            beyond = after[rows, right]
            token[rows, at] = merged
            token[rows, right] = NONE
            after[rows, at] = beyond
            inside = beyond < width
            before[rows[inside], beyond[inside]] = at[inside]
            tree[rows, width + right] = none
            ahead = np.where(inside, beyond, width)
            nxt = token[rows, ahead]
            tree[rows, width + at] = self._leaf(merged, nxt, at, width, none)
            prev = before[rows, at]
            has = prev >= 0
            hr, hp = rows[has], prev[has]
            tree[hr, width + hp] = self._leaf(token[hr, hp], merged[has], hp, width, none)
            node_rows = np.concatenate((rows, rows, hr))
            node = np.concatenate((right, at, hp)) + width
            while node[0] > 1:
                node >>= 1
                tree[node_rows, node] = np.minimum(tree[node_rows, 2 * node], tree[node_rows, 2 * node + 1])
        kept = token[:, :width] != NONE
        ids = token[:, :width][kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same tree and updates for one long piece, on plain lists."""
        if self.pair_of is None:
            used = np.flatnonzero(self._keys >= 0)
            self.pair_of = dict(zip(self._keys[used].tolist(), self._ranks[used].tolist()))
        rank_of, size, n = self.pair_of.get, self.size, len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none = size * width
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        tree = [none] * (2 * width)

        def leaf(left: int, right: int, position: int) -> int:
            r = rank_of(left * size + right)
            return none if r is None else r * width + position

        for p in range(n - 1):
            tree[width + p] = leaf(token[p], token[p + 1], p)
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def update(position: int, value: int) -> None:
            node = width + position
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            merged, at = divmod(tree[1], width)
            right = after[at]
            beyond = after[right]
            token[at], token[right] = merged, NONE
            after[at] = beyond
            update(right, none)
            if beyond < n:
                before[beyond] = at
                update(at, leaf(merged, token[beyond], at))
            else:
                update(at, none)
            prev = before[at]
            if prev >= 0:
                update(prev, leaf(token[prev], merged, prev))
        return tuple(t for t in token if t != NONE)

    def _leaf(self, left, right, position, width, none):
        ranks = np.full(len(left), NONE, np.int32)
        real = right != NONE
        ranks[real] = self.pair_ranks(left[real], right[real])
        return np.where(ranks == NONE, none, ranks.astype(np.int64) * width + position)

    # -- texts -------------------------------------------------------------

    def learn(self, pieces: set[str]) -> None:
        """Make the ids of all distinct ``pieces`` available in the cache."""
        missing = pieces.difference(self.cache)
        if len(self.cache) > _CACHE_PIECES:
            self.older, self.cache = self.cache, {}
            missing = set(pieces)
        if self.older:
            known = missing.intersection(self.older)
            self.cache.update((p, self.older[p]) for p in known)
            missing -= known
        long: list[str] = []
        raw: list[bytes] = []
        for p in missing:
            b = p.encode("utf-8")
            whole = self.ranks.get(b)
            if whole is not None:
                self.cache[p] = (whole,)
            else:
                long.append(p)
                raw.append(b)
        self.cache.update(zip(long, self.merge_pieces(raw)))

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        split = [self.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        of = self.cache.__getitem__
        for pieces in split:
            yield list(chain.from_iterable(map(of, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(rank_file: bytes, pattern: str) -> BytePairCodec:
    """The worker's codec of a vocabulary, built once per process."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(rank_file, pattern)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256,
    round_trip (the decoded bytes are the text's), and the ids if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)        # the vocabulary file: fixed size
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (
        ", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                part = texts[a:b]
                n, sha, back, same, ids_out = [], [], [], [], []
                for text, ids in zip(part, bpe.encode_batch(part)):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(bpe.decimal(ids).encode()).hexdigest())
                    decoded = bpe.decode(ids)
                    back.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == (text or "").encode("utf-8"))
                    if with_ids:
                        ids_out.append(ids)
                columns = [keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                           pa.array(back, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()                     # a worker that goes on to other work keeps no pieces

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
