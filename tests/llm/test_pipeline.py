"""The corpus pipeline on the smallest tables, stage by stage."""

import collections
import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from panelflow.llm import bpe, simhash, substring_dedup
from panelflow.llm.oracle import MIX
from panelflow.llm.queries import vocabulary

from .conftest import DOCS, odd_rows
from .test_operators import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{i}")
        out.append((name, docs, spark.read.parquet(f"{folder}/{i}")))
        docs = out[-1][2]
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(after.columns == columns for _, _, after in stages[:-1])


def test_toxicity_keeps_labelled_clean_documents(spark, stages):
    clean = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id").collect()}
    assert clean <= {r[0] for r in stages[0][2].select("doc_id").collect()}


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(groups)


def test_no_repeat_of_the_input_is_left(stages):
    _, before, after = stages[2]
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.removals(before).collect()}
    for r in after.collect():
        n, gone = removed[r["doc_id"]]
        assert len((r["text"] or "").encode().split()) == n - gone


def test_mix_repeats_whole_documents_and_tokens_follow(stages):
    _, before, after = stages[3]
    times = collections.Counter(r["doc_id"] for r in after.collect())
    assert set(times) <= {r["doc_id"] for r in before.collect()} and max(times.values()) <= 2
    last = stages[4][2]
    assert last.count() == sum(times.values()) and last.where("not round_trip").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][2].collect()))


def tables(spark, folder, rows, labels=()):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def kept_words(texts, window=35):
    split = [t.encode().split() if t else [] for t in texts]
    count = collections.Counter(b" ".join(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    for t, w in zip(texts, split):
        gone = {p for i in range(len(w) - window + 1) if count[b" ".join(w[i:i + window])] > 1 for p in range(i, i + window)}
        yield b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Without labels nothing is toxic; the other stages one by one, the mix by its SQL."""
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab, 50))
    rows = odd_rows()
    for i in range(100, 160):
        body = " ".join(rng.choice(vocab, int(rng.integers(1, 120))))
        rows.append((i, body + (" " + passage if i % 4 == 0 else ""), "en", f"s{i % 3}" if i % 7 else None, 1))
    rows += [(200, rows[20][1], "en", "s1", 1), (201, rows[20][1], "de", None, None)]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows)).collect()

    groups = collections.defaultdict(list)
    for r, g in zip(rows, brute_components([brute_fingerprint(r[1]) for r in rows])):
        groups[g].append(r)
    docs = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    docs = [(d[0], t, d[3]) for d, t in zip(docs, kept_words([d[1] for d in docs]))]
    documents = pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    mixed = duckdb.connect().execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents").execute(MIX).fetchall()
    times = {d: taken // size if size else min(2, int(target // total)) if total else 0 for d, size, total, target, taken in mixed}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(*vocabulary()).ranks, special_tokens={})
    want = collections.Counter()
    for d, t, _ in docs:
        ids = codec.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += times[d]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == +want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
