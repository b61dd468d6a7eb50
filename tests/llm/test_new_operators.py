"""Whitening, conversation trie and benchmark decontamination against brute force."""

import collections
import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelflow.llm import decontaminate, trie, whitening

from .conftest import odd_rows

# -- whitening ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=0, n=60, d=12):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.2).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    same = rows[3][1]
    return rows + [(100, None, 1), (101, [1.0, None] + [0.0] * (d - 2), 1), (102, [float("nan")] * d, None), (103, [float("inf")] * d, 1),
                   (None, same, None), (3, same, 1), (3, same, 1), (104, [], 1), (105, [0.5, -0.5], 1)]


def brute_whitening(rows, k=8):
    d = max((len(v) for _, v, _ in rows if v), default=0)
    keep = [(i, list(v) + [0.0] * (d - len(v))) for i, v, _ in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in keep], np.int64)
    n, s = len(x), x.sum(axis=0)
    cov = ((n * x - s) / n).T @ ((n * x - s) / n) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    z = (n * x - s) / n @ u[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in keep], ((n * x - s) ** 2).sum(axis=1), z, e, n


def test_whitening_equals_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = collections.defaultdict(list)
    for r in whitening.whiten_rows(df.select("*", F.lit(1).alias("at"), F.lit(2).alias("part"), F.lit(3).alias("component"))).collect():
        got[r["component"]].append(r)
    ids, dev, z, e, n = brute_whitening(rows)
    assert sorted(got) == list(range(1, 9))
    for c, rs in got.items():
        pairs = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in rs), key=str)
        want = sorted(zip(ids, dev.tolist(), z[:, c - 1].tolist()), key=str)
        sign = max((1, -1), key=lambda s: np.dot(sorted(p[2] for p in pairs), sorted(s * w[2] for w in want)))
        assert collections.Counter(p[:2] for p in pairs) == collections.Counter(w[:2] for w in want)
        np.testing.assert_allclose(sorted(p[2] for p in pairs), sorted(sign * w[2] for w in want), atol=1e-9)
        assert {r["n"] for r in rs} == {n} and rs[0]["identity_error"] < 1e-9
        assert rs[0]["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)


def test_whitening_edge_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten_rows(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, 1), (2, [None], 1)], VECTORS)
    assert whitening.whiten_rows(nothing).count() == 0
    one = whitening.whiten_rows(spark.createDataFrame([(1, [0.5, 0.25], 1)], VECTORS)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    # two distinct vectors span one dimension: the other components have no eigenvalue
    two = whitening.whiten_rows(spark.createDataFrame([(1, [0.0, 0.0, 1.0], 1), (2, [1.0, 0.0, 0.0], 1)], VECTORS)).collect()
    assert {(r["component"], None if r["whitened"] is None else abs(round(r["whitened"], 9))) for r in two} == {(1, 1.0), (2, None), (3, None)}
    far = whitening.whiten_rows(spark.createDataFrame([(i, [1e30 * (-1) ** i] * 3, 1) for i in range(4)], VECTORS)).collect()
    assert {r["deviation"] for r in far} == {None} or all(r["deviation"] > 0 for r in far)


def test_factor_and_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    e = 10.0 ** -np.arange(20)
    scale = 10.0 ** -np.arange(20.0)
    a = scale[:, None] * (q @ np.diag(1 + np.arange(20.0)) @ q.T) * scale          # graded: relative accuracy is possible
    squares, unit = whitening.one_sided_jacobi(whitening.pivoted_cholesky(a))
    np.testing.assert_allclose(unit.T @ unit, np.eye(len(squares)), atol=1e-12)
    np.testing.assert_allclose(unit * squares @ unit.T, a, atol=1e-13 * np.abs(a).max())
    assert len(squares) >= 8 and (np.diff(squares) <= 0).all() and e[0] == 1
    low = rng.normal(size=(20, 4))
    assert whitening.pivoted_cholesky(low @ low.T).shape[1] == 4
    pairs = [tuple(sorted(p)) for a, b in whitening.rounds(7) for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)) == 21


# -- conversation trie ------------------------------------------------------------------

CONVS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, branched=True):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if branched else 0
        trunk = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(trunk, [])[:h] + v[h:] if branched else v
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, totals, out = collections.defaultdict(list), {}, collections.Counter()
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(totals[x][1] for x in children[k])
        totals[k] = (sum(totals[x][0] for x in children[k]) or 1, saved)
        ends = ",".join(str(c) for c in members[k] if len(built[c]) == len(k))
        out[(members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), *totals[k],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversations(seed=0, n=260, longest=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, longest))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.integers(0, 2)} ä🙂" if rng.random() < 0.8 else ""))
    return rows


ODD_CONVS = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, "second"), (1, 1, "user", None), (-7, 0, "user", "a"),
             (-7, 1, "user", "b"), (205, 0, "user", "same"), (205, 0, "user", "same"), (207, 5, "", ""), (200, 0, "user", "same"),
             (300, 0, "user", "y" * 200_000), (100_000, 0, "user", "a")]


def run_trie(df, branched=True, **options):
    rows = trie.branched_prefixes(df) if branched else trie.conversation_prefixes(df)
    return collections.Counter(map(tuple, trie.prefix_trie(rows, **options).collect()))


@pytest.mark.parametrize("rows", [conversations(), ODD_CONVS, conversations(1, 30) + ODD_CONVS])
def test_trie_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, CONVS).repartition(4)
    # small shards and a queue of 8 messages: shard roots, upper nodes and spilled runs all occur
    assert run_trie(df, shard_turns=20, shards=10 ** 9, queue=8) == brute_trie(rows)


def test_trie_general_form_empty_and_clashing_columns(spark):
    rows = conversations(2, 40)
    df = spark.createDataFrame(rows, CONVS)
    assert run_trie(df, branched=False) == brute_trie(rows, branched=False)
    clash = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("t1", "t2", "chars", "pos", "depth", "len", "k1", "part", "spread", "h"))])
    assert run_trie(clash) == brute_trie(rows)
    assert sum(run_trie(df.limit(0)).values()) == 0


def test_trie_of_a_conversation_over_many_partitions(spark):
    rows = [(1005, i, "user", f"t{i % 3}") for i in range(700)] + [(1006, i, "user", f"t{i % 3}") for i in range(650)] + conversations(3, 20)
    got = run_trie(spark.createDataFrame(rows, CONVS).repartition(8), shard_turns=50, shards=10 ** 9, queue=16)
    assert got == brute_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3)), max_size=80), st.integers(1, 7))
def test_spilling_queue_is_a_priority_queue(items, limit):
    queue = trie.SpillingQueue(limit, block=3)
    for x in items:
        queue.push(x)
    got = []
    for key in sorted({x[0] for x in items}):
        got += list(queue.pop_at((key,)))
    assert got == [heapq.heappop(h) for h in [sorted(items)] for _ in range(len(items))]


# -- decontamination ------------------------------------------------------------------------

BENCH = "item_id long, text string"


def bench_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute_decontamination(docs, bench, span=10):
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = bench_words(t)
        n = min(span, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[at:at + n])].add("null" if i is None else str(i))
    sizes, out = {len(k) for k in windows}, collections.Counter()
    for d, t in docs:
        w, hit, items = bench_words(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[at:at + n]))):
                    hit.update(range(at, at + n))
                    items |= found
        out[(d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    return out


def words_of(rng, n, vocabulary):
    return " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n))


@pytest.mark.parametrize("seed", range(2))
def test_decontamination_equals_brute_force(spark, odd_docs, seed):
    rng = np.random.default_rng(seed)
    small, wide = ["a", "B", "c1"], [f"w{i}" for i in range(400)]
    bench = [(i, words_of(rng, int(rng.integers(1, 30)), wide)) for i in range(15)] + [
        (90, words_of(rng, 12, small)), (91, "a b! c1"), (92, "Über-Maß  中文"), (93, None), (94, "..."), (None, "w1 w2"), (95, "w1 w2"), (95, "x")]
    bench += [(96, bench[0][1]), (97, bench[0][1] + " " + bench[1][1])]
    docs = []
    for i in range(60):
        parts = [words_of(rng, int(rng.integers(0, 30)), wide), words_of(rng, 20, small) if i % 3 == 0 else ""]
        if i % 2:
            source = bench[int(rng.integers(0, 15))][1].split()
            at = int(rng.integers(0, max(1, len(source) - 8)))
            parts.insert(1, " ".join(source[at:at + int(rng.integers(8, 13))]).upper())
        docs.append((i, ", ".join(parts)))
    docs += [(d, t) for d, t, *_ in odd_rows()] + [(7, docs[1][1]), (None, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).select(
        "*", *[F.lit(i).alias(c) for i, c in enumerate(("key", "n_words", "prints", "t", "hash", "pos", "start", "win", "item"))])
    got = decontaminate.decontaminate(df, spark.createDataFrame(bench, BENCH).select("*", F.lit(1).alias("w"), F.lit(2).alias("t")))
    assert collections.Counter(map(tuple, got.drop("spans").collect())) == brute_decontamination(docs, bench)


def test_decontamination_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the cat and the dog")], BENCH)
    for nothing in (bench.limit(0), spark.createDataFrame([(1, None), (2, "  ")], BENCH)):
        rows = decontaminate.decontaminate(odd_docs, nothing).collect()
        assert len(rows) == len(odd_rows()) and not any(r["contaminated"] for r in rows)
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    hit = [r for r in decontaminate.decontaminate(odd_docs, bench).collect() if r["contaminated"]]
    assert {r["doc_id"] for r in hit} == {1, 2} and all([tuple(s) for s in r["spans"]] == [(0, 5), (5, 5), (10, 5), (15, 5)] for r in hit)


@pytest.mark.parametrize("t", [1, 2, 5, 9, 10, 16])
def test_every_run_of_grams_keeps_its_least_hash(spark, t):
    rng = np.random.default_rng(t)
    words = [f"v{i}" for i in rng.integers(0, 6, 200)]
    w = F.array(*[F.lit(x) for x in words])
    kept = {r["pos"]: r["hash"] for r in spark.range(1).select(F.explode(decontaminate.winnowed(w, [t])).alias("k")).select("k.*").collect()}
    k = decontaminate.gram_size(t)
    assert all(any(p in kept for p in range(at, at + t - k + 1)) for at in range(len(words) - t + 1))
    by_gram = collections.defaultdict(set)
    for p, h in kept.items():
        by_gram[tuple(words[p:p + k])].add(h)
    assert all(len(h) == 1 for h in by_gram.values()) and len({*map(tuple, by_gram.values())}) == len(by_gram)
