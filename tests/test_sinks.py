"""Sorted and size-bounded files, tallies of the write itself, manifests."""

import csv
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.session import cut_lineage
from panelflow.sources import sinks


def frame(spark, n=6000, seed=0):
    rng = np.random.default_rng(seed)
    keys = [None, "", "hot", "a", "b", "c d"]
    rows = [(keys[2 if rng.random() < 0.5 else int(rng.integers(0, 6))], int(rng.integers(0, 500)), f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, x string").repartition(7)


@pytest.mark.parametrize("key", ["k", "n"])
def test_sorted_files_are_sorted_and_few(spark, tmp_path, key):
    df = frame(spark).withColumn("n", F.length("k"))
    target = 8_000
    path = sinks.write_partitioned(df, str(tmp_path / "out"), by=(key,), sort_within=("t",), target_bytes=target)
    found = sinks.file_order(spark, path, "t", [key]).collect()
    n_keys = df.select(F.nullif(F.col(key).cast("string"), F.lit(""))).distinct().count()
    total = df.agg(F.sum(sinks.text_bytes(df))).first()[0]
    assert sum(r["n_rows"] for r in found) == 6000 and len(found) == n_keys
    assert all(r["n_unsorted"] == 0 and r["n_overlapping"] == 0 for r in found)
    assert sum(r["n_files"] for r in found) <= n_keys + total / target
    assert max(r["n_files"] for r in found) > 3             # the hot key spans files
    sizes = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.sum(F.octet_length("x") + 12).alias("b")).agg(F.max("b")).first()[0]
    assert sizes < 3 * target


def test_sorted_csv_files_are_sorted(spark, tmp_path):
    path = sinks.write_partitioned(frame(spark, 900), str(tmp_path / "csv"), by=("k",), fmt="csv", sort_within=("t", "x"), target_bytes=4_000)
    n = 0
    for name in glob.glob(f"{path}/*/*.csv"):
        with open(name, newline="") as fh:
            rows = [(int(r["t"]), r["x"]) for r in csv.DictReader(fh)]
        assert rows == sorted(rows)
        n += len(rows)
    assert n == 900
    assert sinks.write_partitioned(frame(spark).limit(0), str(tmp_path / "none"), by=("k",), sort_within=("t",))


def reads(spark, df):
    """(frame, counter): the counter adds every row that is read from the frame."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), seen


def test_tallies_come_from_the_write(spark, tmp_path):
    base = frame(spark, 1200).withColumn("road", F.lit("M60")).withColumn(
        "direction", F.element_at(F.array(*[F.lit(d) for d in ("clockwise", "eastbound", "other")]), F.col("t") % 3 + 1))
    df, seen = reads(spark, base)
    counts = {r["direction"]: r["n_rows"] for r in sinks.write_by_direction(df, str(tmp_path / "d")).collect()}
    assert seen.value == 1200
    assert counts == {r["direction"]: r["count"] for r in base.where("direction <> 'other'").groupBy("direction").count().collect()}
    assert len(glob.glob(f"{tmp_path}/d/*/*/*.parquet")) == 2
    df, seen = reads(spark, base)
    got = sinks.filtered_copy(df, "x", "7", str(tmp_path / "c")).first()
    assert seen.value == 1200 and got["n_all"] == 1200 and got["n_filtered"] == base.where("x like '%7%'").count()
    back = spark.read.parquet(str(tmp_path / "c")).groupBy("copy").count().collect()
    assert {str(r["copy"]): r["count"] for r in back} == {"all": 1200, "7": got["n_filtered"]}
    own = base.withColumn("direction", F.lit("upwards"))
    assert sinks.write_by_direction(own, str(tmp_path / "u")).first()["n_rows"] == 1200


def test_a_quarantine_without_its_manifest_is_refused(spark, tmp_path, monkeypatch):
    df = spark.range(40).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    flags = df.select("k", (F.col("k") % 2).cast("int").alias("is_kept"))
    path = str(tmp_path / "q")
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.quarantine(df, flags, "k", path)
    with pytest.raises(sinks.IncompleteQuarantine):
        sinks.restore(spark, path)
    sinks.quarantine(df, flags, "k", path)
    assert sinks.restore(spark, path).count() == 40
    victim = sorted(glob.glob(f"{path}/is_kept=1/*.parquet"))[0]
    os.remove(victim)
    with pytest.raises(sinks.IncompleteQuarantine, match="differ"):
        sinks.restore(spark, path)


def test_a_plan_without_listed_inputs_overwrites_nothing(spark, tmp_path):
    path = sinks.write_partitioned(spark.range(5), str(tmp_path / "x"))
    again = cut_lineage(spark.read.parquet(path))
    with pytest.raises(ValueError, match="does not list"):
        sinks.write_partitioned(again, path)
    sinks.write_partitioned(again, str(tmp_path / "y"))


def test_many_folders_are_written_by_several_tasks(spark, tmp_path):
    """Opening a file costs as much as many rows: folders are dealt to tasks by their number, too."""
    n = 4 * sinks.KEYS_A_RANGE
    df = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("k"), F.col("id").alias("t"))
    assert sinks.sorted_ranges(df, ("k",), ("t",), sinks.TARGET_BYTES).rdd.getNumPartitions() > 1
    path = sinks.write_partitioned(df, str(tmp_path / "many"), by=("k",), sort_within=("t",))
    found = sinks.file_order(spark, path, "t", ["k"]).collect()
    assert len(found) == n and sum(r["n_rows"] for r in found) == 2 * n
    assert all(r["n_unsorted"] == 0 and r["n_overlapping"] == 0 for r in found)
