import datetime as dt
import io
import os
import zipfile

from pyspark.sql import functions as F

from panelflow.operators import rollup
from panelflow.sources import archive, raw, sinks

HEADER = ["Local Date", "Local Time", "Day Type ID", "Total Traffic Flow", "Traffic Flow Value1",
          "Fused Average Speed", "Start Node Coordinates", "End Node Coordinates", "Quality Index"]
ROWS = [
    ["2024-01-01", "10:07:00", "1", "100", "10", "80.5", "53.4 ; -2.2", "53.5 ; -2.3", "1"],
    ["2024-01-01", "10:08:00", "1", "120", "12", "bad", "53.4", "x ; y", "1"],
    ["", "", "", "", "", "", "", "", ""],
    HEADER,
    ["2024-01-01", "23:59:00", "5", "50", "5", "60", "53.4 ; -2.2", "53.5 ; -2.3", "1"],
    ["2024-01-01", "xx", "5", "50", "5", "60", "53.4 ; -2.2", "53.5 ; -2.3", "1"],
]


def _write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        for r in [HEADER] + rows:
            fh.write(",".join(f'"{c}"' for c in r) + "\n")


def test_raw_scan_clean(spark, tmpdir_path):
    _write_csv(f"{tmpdir_path}/month_01/M60 clockwise J1 1234/file_1234.csv", ROWS)
    _write_csv(f"{tmpdir_path}/month_01/A57 eastbound 77/file_77.csv", ROWS[:1])
    s = raw.with_sections(raw.read_raw_csv(spark, f"{tmpdir_path}/*/*/*.csv"))
    assert s.count() == 5                                    # blank row and repeated header dropped
    assert {r.segment_id for r in s.select("segment_id").distinct().collect()} == {"1234", "77"}
    c = raw.clean_raw(s.drop("source_file", "section_folder", "month_folder", "file_name"))
    assert "quality_index" not in c.columns and c.columns[0] == "datetime"
    rows = {(r.segment_id, r.total_traffic_flow): r for r in c.collect()}
    a = rows[("1234", 100.0)]
    assert a.datetime == dt.datetime(2024, 1, 1, 10, 0) and a.start_latitude == 53.4 and a.end_longitude == -2.3
    b = rows[("1234", 120.0)]
    assert b.datetime == dt.datetime(2024, 1, 1, 10, 15) and b.fused_average_speed is None
    assert b.start_latitude is None and b.end_latitude is None
    wrapped = [r for r in c.collect() if r.total_traffic_flow == 50.0]
    assert sorted(str(r.datetime) for r in wrapped) == ["2024-01-01 00:00:00", "None"]
    carried = raw.clean_raw(s.drop("source_file", "section_folder", "month_folder", "file_name"), carry_day=True)
    assert dt.datetime(2024, 1, 2) in [r.datetime for r in carried.collect()]
    filled = raw.clean_raw(s.drop("source_file", "section_folder", "month_folder", "file_name"), fill_zero=True)
    assert {r.start_latitude for r in filled.where(F.col("total_traffic_flow") == 120).collect()} == {0.0}
    h = rollup.hourly_rollup(c.where(F.col("datetime").isNotNull()), sum_cols=["total_traffic_flow"],
                             mean_cols=["fused_average_speed"], order_col="datetime")
    assert h.count() == 3


def test_archive_ingest(spark, tmpdir_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("a.csv", "x,y\n1,2\n , \n3,4\n")
        zf.writestr("b.csv", "y,x\n5,6\n")
        zf.writestr("readme.txt", "ignored")
    os.makedirs(f"{tmpdir_path}/m1", exist_ok=True)
    with open(f"{tmpdir_path}/m1/good.zip", "wb") as fh:
        fh.write(buf.getvalue())
    with open(f"{tmpdir_path}/m1/bad.zip", "wb") as fh:
        fh.write(b"not a zip")
    rows = archive.read_archives(spark, f"{tmpdir_path}/*/")
    t = {os.path.basename(r.archive): (r.n_rows, r.failed) for r in archive.archive_tally(rows).collect()}
    assert t == {"good.zip": (3, 0), "bad.zip": (0, 1)}
    cols = archive.rows_to_columns(rows, ["x", "y", "z"]).collect()
    assert sorted((r.x, r.y, r.z) for r in cols) == [("1", "2", None), ("3", "4", None), ("6", "5", None)]
    assert os.path.exists(f"{tmpdir_path}/m1/good.zip")      # originals are kept


def test_sinks_quarantine_restore(spark):
    df = spark.createDataFrame([(1, "a", "clockwise"), (2, "b", "other"), (3, "mainCarriageway x", "eastbound")],
                               "k int, name string, direction string").withColumn("road", F.lit("M60"))
    flags = spark.createDataFrame([(1, 1), (2, 0)], "k int, is_kept int")
    path = sinks.staging_path(spark, "q")
    sinks.quarantine(df, flags, "k", path)
    back = sinks.restore(spark, path)
    assert back.count() == 3 and back.where("is_kept = 0").count() == 1
    counts = {r.direction: r.n_rows for r in sinks.write_by_direction(df, sinks.staging_path(spark, "d")).collect()}
    assert counts == {"clockwise": 1, "eastbound": 1}
    fc = sinks.filtered_copy(df, "name", "mainCarriageway", sinks.staging_path(spark, "c")).first()
    assert (fc.n_all, fc.n_filtered) == (3, 1)
    p = sinks.staging_path(spark, "j")
    sinks.write_json_report(df, p)
    assert spark.read.json(p).count() == 3
    try:
        sinks.write_partitioned(back, path)
        raise AssertionError("overwrote an input")
    except ValueError:
        pass


def test_pack_archives_reads_back(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, "x,y"), ("b", 3, "q")], "seg string, n int, t string").coalesce(1)
    files = archive.pack_archives(d, "seg")
    assert files.count() == 1
    rows = archive.rows_to_columns(archive.archive_rows(files), ["t", "n"])
    assert sorted((r.member, r.n, r.t) for r in rows.collect()) == [("a.csv", "1", ""), ("a.csv", "2", "x,y"), ("b.csv", "3", "q")]
    assert archive.archive_rows(archive.pack_archives(d.limit(0), "seg")).count() == 0


def _write_text(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as fh:
        fh.write(text)


def test_files_of_differing_headers_are_bound_by_name(spark, tmpdir_path):
    _write_text(f"{tmpdir_path}/m [1]/a+b 100%/x.csv", "Speed,Flow,Name\n60,1,\"q, r\"\n,,\n")
    _write_text(f"{tmpdir_path}/m [1]/c/x.csv", "﻿Flow,Name,Speed\r\n2,s,70\r\nFlow,Name,Speed\r\n3\r\n")
    _write_text(f"{tmpdir_path}/m [1]/d/y.csv", "\nFlow,Extra,extra\n4,e,f\n")
    _write_text(f"{tmpdir_path}/m [1]/d/z.csv", "Flow,Extra,extra\n5,g,h\n")
    _write_text(f"{tmpdir_path}/m [1]/e/none.csv", "")
    _write_text(f"{tmpdir_path}/m [1]/e/head.csv", "Flow,Name\n")
    glob = f"{tmpdir_path}/*/*/*.csv"
    got = sorted(((r["Flow"], r["Speed"], r["Name"], r["Extra"], r["extra_c2"]) for r in raw.read_raw_csv(spark, glob).collect()), key=str)
    assert got == [("1", "60", "q, r", None, None), ("2", "70", "s", None, None), ("3", None, None, None, None),
                   ("4", None, None, "e", "f"), ("5", None, None, "g", "h")]
    report = {tuple(r["header"]): (r["n_files"], r["n_rows"], r["missing"]) for r in raw.header_report(spark, glob).collect()}
    assert report == {("Speed", "Flow", "Name"): (1, 2, ["Extra", "extra_c2"]), ("Flow", "Name", "Speed"): (1, 3, ["Extra", "extra_c2"]),
                      ("Flow", "Extra", "extra_c2"): (2, 2, ["Name", "Speed"]), ("Flow", "Name"): (1, 0, ["Extra", "extra_c2", "Speed"])}
    empty = raw.read_raw_csv(spark, f"{tmpdir_path}/*/e/none.csv")
    assert empty.count() == 0 and empty.columns == ["source_file"]
    same = raw.read_raw_csv(spark, f"{tmpdir_path}/*/d/z.csv", same_header=True)
    assert same.count() == 1


def test_a_large_file_of_several_blocks_has_one_header(spark, tmpdir_path):
    _write_text(f"{tmpdir_path}/big/a.csv", "k,v\n" + "".join(f"{i},{i}\n" for i in range(20_000)))
    _write_text(f"{tmpdir_path}/big/b.csv", "v,k\n" + "".join(f"{i},{i + 7}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = raw.read_raw_csv(spark, f"{tmpdir_path}/big/*.csv")
        assert rows.count() == 40_000 and rows.rdd.getNumPartitions() > 6
        assert rows.where("cast(k as int) - cast(v as int) not in (0, 7)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_members_of_one_archive_are_read_by_several_tasks(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for i in range(100):
            kind = zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED
            zf.writestr(f"d/m{i}.csv", "x,y\n" + "".join(f"{i},{j}\n" for j in range(50)), compress_type=kind)
        zf.writestr("other.csv", "x\n1\n", compress_type=zipfile.ZIP_BZIP2)
        zf.writestr("empty.csv", "")
    content = bytearray(buf.getvalue())
    at = content.index(b"d/m40.csv") + len("d/m40.csv") + 30
    content[at] ^= 1                                    # damage in a stored member: its checksum no longer fits
    files = spark.createDataFrame([("a.zip", bytes(content)), ("b.zip", b"PK nothing")], "path string, content binary")
    rows = archive.archive_rows(files).withColumn("task", F.spark_partition_id()).cache()
    good = rows.where("error is null")
    assert good.where("member <> 'd/m40.csv'").count() == 99 * 50
    assert good.select("task").distinct().count() > 3
    bad = {(r["archive"], r["member"]): r["error"] for r in rows.where("error is not null").collect()}
    assert set(bad) == {("a.zip", "d/m40.csv"), ("a.zip", "other.csv"), ("b.zip", None)}
    assert "checksum" in bad["a.zip", "d/m40.csv"] and "method" in bad["a.zip", "other.csv"]


def test_a_large_member_is_inflated_as_a_stream():
    text = "x,y\n" + "".join(f"{i},{i * i}\n" for i in range(300_000))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("big.csv", text)
    import pandas as pd

    members = list(archive._members([pd.DataFrame({"path": ["p"], "content": [buf.getvalue()]})]))
    out = list(archive._explode_members(members))
    assert len(out) == 30 and sum(map(len, out)) == 300_000 and max(map(len, out)) <= archive.BATCH_ROWS
    assert out[-1]["cells"].iloc[-1] == ["299999", str(299999 ** 2)]


def test_many_files_of_one_header_are_listed_by_few_tasks(spark, tmp_path):
    """One row per header reaches the driver, the scan keeps the caller's paths, the setting is put back."""
    n, name = 40 + 4 * spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(n):
        _write_csv(f"{tmp_path}/month_01/A57 eastbound {i}/f.csv", ROWS[:1])
    _write_csv(f"{tmp_path}/month_01/A57 eastbound {n}/f.csv", [])
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("raw-listing", "files of one header")
    try:
        rows = raw.with_sections(raw.read_raw_csv(spark, f"{tmp_path}/*/*/*.csv"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("raw-listing") for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before
    assert sorted(int(r["segment_id"]) for r in rows.collect()) == list(range(n))
    found = raw.headers(spark, f"{tmp_path}/*/*/*.csv")
    assert [(names, files, n_rows) for names, _, files, n_rows, _ in found] == [(HEADER, n + 1, n)]
