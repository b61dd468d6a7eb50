"""Small CSV files of a local tree: made, listed and read by tasks, with the
results of Spark's own writer and reader."""

import os

import pytest
from pyspark.sql import functions as F

from panelflow.sources import local_tree, raw, sinks

ODD = ["a b", "x/y", "%2F", "q\"r", "é  :=?", "it's [1] {2} ^ \\", "", None, "+&~", "tab\tnew\nline", "#,;"]


def _tree(root):
    """{relative folder: rows of its files in order}, without Spark's checksum files."""
    found = {}
    for at, _, names in os.walk(root):
        rows = []
        for n in sorted(n for n in names if n.endswith(".csv")):
            with open(f"{at}/{n}", "rb") as f:
                rows.append(f.read())
        if rows:
            found[os.path.relpath(at, root)] = rows
    return found


@pytest.fixture()
def spark_only(monkeypatch):
    def off():
        monkeypatch.setattr(local_tree, "local_path", lambda spark, path: None)
    return off


def _odd_frame(spark):
    rows = [(ODD[i % len(ODD)], i % 3 if i % 4 else None, i, ODD[(i * 7) % len(ODD)], i / 7 if i % 5 else None, f" {i} ") for i in range(400)]
    return spark.createDataFrame(rows, "`the key` string, `n=1` int, t int, `odd, \"name\"` string, v double, s string").withColumns(
        {"d": F.date_add(F.lit("2024-01-01").cast("date"), F.col("t")), "ts": F.lit("2024-01-01 01:02:03.5").cast("timestamp")})


def test_folders_and_lines_are_those_of_sparks_writer(spark, tmp_path, spark_only):
    df, by = _odd_frame(spark), ("the key", "n=1")
    for target in (sinks.TARGET_BYTES, 2_000):
        sinks.write_partitioned(df, str(tmp_path / f"own{target}"), by=by, fmt="csv", sort_within=("t",), target_bytes=target)
    left = [n for _, _, names in os.walk(tmp_path) for n in names if not n.endswith(".csv")]
    assert sorted(left) == ["_SUCCESS", "_SUCCESS"]
    none = spark.range(0).selectExpr("'a' as `the key`", "1 as `n=1`", "1 as t")
    sinks.write_partitioned(none, str(tmp_path / "own2000"), by=by, fmt="csv", sort_within=("t",))     # replaces
    assert _tree(tmp_path / "own2000") == {}
    sinks.write_partitioned(df, str(tmp_path / "headless"), by=by, fmt="csv", sort_within=("t",), target_bytes=2_000, header=False)
    spark_only()
    sinks.write_partitioned(df, str(tmp_path / "sparks"), by=by, fmt="csv", sort_within=("t",))
    sinks.write_partitioned(df, str(tmp_path / "bare"), by=by, fmt="csv", sort_within=("t",), header=False)
    assert _tree(tmp_path / f"own{sinks.TARGET_BYTES}") == _tree(tmp_path / "sparks")
    joined = lambda t: {k: b"".join(v) for k, v in t.items()}
    assert joined(_tree(tmp_path / "headless")) == joined(_tree(tmp_path / "bare"))


def test_a_repeated_task_leaves_each_row_once(spark, tmp_path):
    """A first attempt that broke off leaves hidden files only; the next gives the names."""
    import pyarrow as pa
    from types import SimpleNamespace

    def batches(fail):
        for k in ("a", "a", "b"):
            yield pa.RecordBatch.from_pydict({"k0": [k, k], "line": [f"{k}1\n", f"{k}2\n"]})
        if fail:
            raise RuntimeError("lost")

    real, local_tree.TaskContext = local_tree.TaskContext, SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3, taskAttemptId=lambda: 9))
    try:
        with pytest.raises(RuntimeError):
            list(local_tree._write(str(tmp_path), ["k"], "run", b"h\n", batches(True)))
        assert all(n.startswith(".") for _, _, names in os.walk(tmp_path) for n in names)
        for _ in range(2):
            out = list(local_tree._write(str(tmp_path), ["k"], "run", b"h\n", batches(False)))
            assert out[0].column(0).to_pylist() == [2]
            assert _tree(tmp_path) == {"k=a": [b"h\na1\na2\na1\na2\n"], "k=b": [b"h\nb1\nb2\n"]}
    finally:
        local_tree.TaskContext = real


FILES = {
    "m=1/a b+c%20/x.csv": b"\xef\xbb\xbfA,B,C\r\n1,\"x,\"\"y\",3\r\n\r\n , ,\r\nA,B,C\r4,5",
    "m=1/a b+c%20/_no.csv": b"A,B,C\n9,9,9\n",
    "m=1/a b+c%20/.no.csv": b"A,B,C\n9,9,9\n",
    "m=1/[s]{t}é #&/x.csv": b"\n \t\nB,A\n\t\n1\n1,2,3\n\"open,2\n\\,'z\n\xff\xfe,bad\n",
    "m=2/s,=/x.csv": b"A,B,C\n" + b"".join(b"%d,%d,\n" % (i, i) for i in range(3000)),
    "m=2/s,=/y.csv": b"A,B,C\n",
    "m=2/s,=/z.csv": b"",
    "m=2/s,=/z.csv.gz": b"",
    "m=2/large/x.csv": b"B,A\n" + b"".join(b"%d,%d\n" % (i, -i) for i in range(20_000)),
    "m=2/x.csv": b"A,B,C\n9,9,9\n",
}


def _put(root):
    for name, data in FILES.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)


def _read(spark, glob):
    rows = raw.with_sections(raw.read_raw_csv(spark, glob))
    return rows.columns, sorted(map(repr, rows.collect())), raw.headers(spark, glob), sorted(map(repr, raw.header_report(spark, glob).collect()))


def test_rows_and_headers_are_those_of_sparks_reader(spark, tmp_path, spark_only, monkeypatch):
    _put(tmp_path)
    globs = [f"{tmp_path}/*/*/*.csv", f"file:{tmp_path}/m=?/*/x.csv", f"{tmp_path}/m=2/s,=/*.csv", f"{tmp_path}/*/s,=/z.csv"]
    monkeypatch.setattr(local_tree, "LARGEST", 100_000)
    own = [_read(spark, g) for g in globs]
    taken = [local_tree.tree_of(spark, g) for g in globs]
    assert all(taken) and len(own[0][1]) > 23_000
    spark_only()
    assert local_tree.tree_of(spark, globs[0]) is None
    for g, found in zip(globs, own):
        assert _read(spark, g) == found, g


def test_a_tree_is_dealt_to_tasks_whole(tmp_path):
    for i in range(700):
        os.makedirs(f"{tmp_path}/m/s{i}")
        open(f"{tmp_path}/m/s{i}/f.csv", "w").close()
    for pattern, shares in ((f"{tmp_path}/*/*/*.csv", 8), (f"{tmp_path}/m/s1*/*.csv", 8), (f"{tmp_path}/m/s1/*.csv", 1)):
        tree = local_tree.Tree(pattern, 1 << 20, 2)
        parts = [list(tree.files(i)) for i in range(tree.shares)]
        want = [str(p) for p in tmp_path.glob(pattern[len(str(tmp_path)) + 1:])]
        assert tree.shares == shares and sorted(sum(parts, [])) == sorted(want) and max(map(len, parts)) < max(2, len(want) / 4)
    for i in range(300):
        open(f"{tmp_path}/m/s1/g{i}.csv", "w").close()
    tree = local_tree.Tree(f"{tmp_path}/*/s1/*.csv", 1 << 20, 2)
    assert sorted(len(list(tree.files(i))) > 0 for i in range(tree.shares)) == [True] * 8


def test_files_of_a_full_folder_are_read_by_many_tasks(spark, tmp_path):
    n = 8 * local_tree.SHARES_A_CORE * spark.sparkContext.defaultParallelism
    for i in range(n):
        os.makedirs(f"{tmp_path}/m/s{i}")
    for i in range(2 * n):
        with open(f"{tmp_path}/m/s7/f{i}.csv", "w") as f:
            f.write(f"A\n{i}\n")
    rows = raw.read_raw_csv(spark, f"{tmp_path}/m/*/*.csv")
    assert sorted(int(r["A"]) for r in rows.collect()) == list(range(2 * n))
    most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n


def test_a_missing_tree_and_other_entries_are_left_to_spark(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        raw.read_raw_csv(spark, f"{tmp_path}/*/*.csv")
    os.makedirs(f"{tmp_path}/a/dir.csv")
    with open(f"{tmp_path}/a/dir.csv/f.csv", "w") as f:
        f.write("A\n1\n")
    assert [r["A"] for r in raw.read_raw_csv(spark, f"{tmp_path}/*/*.csv").collect()] == ["1"]


def test_the_raw_tree_needs_no_list_of_files_on_the_driver(spark, tmp_path):
    """No file source is in the plan of a scan of small files: the driver has no file index of it."""
    df = spark.range(900).selectExpr("'2024-01' as month", "concat('A57 ', id % 300) as section", "cast(id as string) as t")
    path = sinks.write_partitioned(df, str(tmp_path / "t"), by=("month", "section"), fmt="csv", sort_within=("t",))
    rows = raw.read_raw_csv(spark, f"{path}/*/*/*.csv")
    assert rows.inputFiles() == [] and rows.count() == 900
    assert rows.select("source_file").distinct().count() == 300
    for at in (path, f"{path}/month=2024-01"):
        with pytest.raises(ValueError, match="input of this plan"):
            sinks.write_partitioned(rows.drop("source_file"), at)
    sinks.write_partitioned(rows.drop("source_file"), str(tmp_path / "other"))


def test_queries_over_the_tree_give_what_spark_gives(spark, tmp_path, spark_only):
    from datetime import datetime, timedelta

    from panelflow.plans import io_queries  # noqa: F401  (registers queries)
    from panelflow.plans.registry import QUERIES

    rows = [(i if i % 41 else None, datetime(2024, 1, 30) + timedelta(minutes=9 * i) if i % 37 else None, i * 7 % 23 if i % 29 else None,
             "click" if i % 31 else None, i / 3 if i % 19 else None, f'{{"k": {i % 100}}}' if i % 17 else None) for i in range(900)]
    spark.createDataFrame(rows + rows[:50], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    names = ("raw_fill_zero", "section_report", "raw_ingest_roundtrip")
    own = {}
    for n in names:
        df = QUERIES[n](spark, str(tmp_path))
        assert df.inputFiles() == []
        own[n] = sorted(map(repr, df.collect()))
    spark_only()
    for n in names:
        df = QUERIES[n](spark, str(tmp_path))
        assert df.inputFiles() and len(own[n]) > 20 and sorted(map(repr, df.collect())) == own[n], n
