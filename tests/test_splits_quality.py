import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelflow.operators import quality, splits

T0 = dt.datetime(2024, 1, 1)


def _frame(spark, n, segs=3):
    rows = [(f"s{i % segs}", T0 + dt.timedelta(hours=i // segs), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "segment_id string, datetime timestamp_ntz, v double")


def test_global_position_is_row_number(spark):
    df = _frame(spark, 1003)
    p = splits.global_position(df, ["datetime", "segment_id"], num_partitions=7).toPandas()
    p = p.sort_values(["datetime", "segment_id"]).reset_index(drop=True)
    assert p["_pos"].tolist() == list(range(1003)) and (p["_n"] == 1003).all()


def test_chronological_split_sizes_and_refusal(spark):
    out = splits.chronological_split(_frame(spark, 400), ["datetime", "segment_id"]).toPandas()
    c = out["split"].value_counts().to_dict()
    assert c == {"train": 280, "val": 60, "test": 60}
    assert out.loc[out.split == "train", "_pos"].max() < out.loc[out.split == "val", "_pos"].min()
    assert splits.chronological_split(_frame(spark, 120), ["datetime", "segment_id"]).count() == 0


def _kfold_ref(m, k):
    q, r = divmod(m, k)
    sizes = [q + 1] * r + [q] * (k - r)
    starts = [sum(sizes[:i]) for i in range(k)]
    return [(s, s + z) for s, z in zip(starts, sizes)]


@pytest.mark.parametrize("n", [401, 457])
def test_kfold_matches_contiguous_folds(spark, n):
    out = splits.kfold_split(_frame(spark, n), ["datetime", "segment_id"]).toPandas()
    m = int(n * 0.85)
    assert (out.loc[out.role == "test", "_pos"] >= m).all() and (out.role == "test").sum() == n - m
    for f, (a, b) in enumerate(_kfold_ref(m, 5), start=1):
        val = sorted(out.loc[(out.fold == f) & (out.role == "val"), "_pos"])
        assert val == list(range(a, b))
        assert (out.loc[(out.fold == f) & (out.role == "train")].shape[0]) == m - (b - a)


def test_timeseries_split(spark):
    n = 457
    out = splits.timeseries_split(_frame(spark, n), ["datetime", "segment_id"]).toPandas()
    m = int(n * 0.85)
    ts = m // 6
    for f in range(1, 6):
        st = m - 5 * ts + (f - 1) * ts
        tr = sorted(out.loc[(out.fold == f) & (out.role == "train"), "_pos"])
        va = sorted(out.loc[(out.fold == f) & (out.role == "val"), "_pos"])
        assert tr == list(range(st)) and va == list(range(st, st + ts))


def test_missing_days_and_duplicates(spark):
    rows = [("a", T0), ("a", T0 + dt.timedelta(days=3)), ("b", T0), ("b", T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    miss = sorted((r.k, r.day) for r in quality.missing_days(df, "k", "ts").collect())
    assert miss == [("a", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 3))]
    cov = {r.k: r.n_missing_days for r in quality.day_coverage(df, "k", "ts").collect()}
    assert cov == {"a": 2, "b": 0}
    files = spark.createDataFrame([("1", "x.csv"), ("1", "y.csv"), ("2", "x.csv"), (None, "z.csv")],
                                  "id string, f string")
    d = quality.duplicate_ids(files, "id", "f").collect()
    assert sorted((r.id, r.f, r.n_files) for r in d) == [("1", "x.csv", 2), ("1", "y.csv", 2)]
    s = quality.duplicate_summary(files, "id", "f", expected_files=24).first()
    assert (s.n_files, s.n_files_without_id, s.n_unique_ids, s.n_duplicate_ids, s.matches_expected) == (3, 1, 2, 1, 0)


def test_most_common_name_tie_goes_to_first_seen(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 1)]
    df = spark.createDataFrame(rows, "id int, name string, month int")
    got = {r.id: r.name for r in quality.most_common_name(df, "id", "name", "month").collect()}
    assert got == {1: "b", 2: "z"}


def test_flow_validation_and_audit(spark):
    rows = [("f", 1, 10.0, 3.0, 3.0, 3.0, 1.0), ("f", 2, 0.0, 0.0, 0.0, 0.0, 0.0), ("f", 3, 5.0, 6.0, 0.0, 0.0, 0.0),
            ("f", 4, 10.0, 3.0, 3.0, 2.0, 0.0), ("g", 1, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "file string, seq int, total_traffic_flow double, traffic_flow_value1 double, "
                                     "traffic_flow_value2 double, traffic_flow_value3 double, traffic_flow_value4 double")
    v = {r.file: r for r in quality.flow_validation(df, "file").collect()}
    assert (v["f"].n_rows, v["f"].zero_flow, v["f"].traffic_flow_value1_exceeds, v["f"].sum_mismatch) == (4, 1, 1, 1)
    assert v["f"].zero_flow_pct == 25.0 and v["g"].sum_mismatch == 0
    s = quality.invalid_samples(df, "file", "seq").collect()
    assert [(r.file, r.seq) for r in s] == [("f", 3)]
    lv = quality.load_validation(df).first()
    assert lv.total_traffic_flow_nulls == 1 and lv.zero_total == 1


def test_zero_share_audit_and_types(spark):
    rows = [(1, 1, "mainCarriageway", "d", 0.0), (1, 2, None, "d", 1.0), (2, 1, " ", "a slip road", 0.0),
            (2, 2, "x", "d", 0.0), (3, 1, None, "junction", 1.0)]
    df = spark.createDataFrame(rows, "k int, seq int, carriageway string, ntis_link_description string, f double")
    a = {r.k: r for r in quality.zero_share_audit(df, "k", "seq", ["f"]).collect()}
    assert (a[1].segment_type, a[1].has_missing_flow) == ("mainCarriageway", 1)
    assert (a[2].segment_type, a[2].has_missing_flow) == ("slipRoad", 1)
    assert (a[3].segment_type, a[3].has_missing_flow) == ("junction", 0)
    t = {r.segment_type: r for r in quality.missing_flow_by_type(quality.zero_share_audit(df, "k", "seq", ["f"])).collect()}
    assert t["junction"].verdict == "green" and t["slipRoad"].verdict == "red"


def test_geofence(spark):
    rows = [("r1", 1, 1, 53.45, -2.25, 0.0, 0.0), ("r1", 1, 2, 0.0, 0.0, 0.0, 0.0), ("r1", 2, 1, 0.0, 0.0, 53.45, -2.3),
            ("r2", 3, 1, 10.0, 10.0, 10.0, 10.0), ("r2", 4, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "road string, k int, seq int, start_latitude double, start_longitude double, "
                                     "end_latitude double, end_longitude double")
    f = {r.k: r.is_kept for r in quality.geofence_flags(df, "k", "seq").collect()}
    assert f == {1: 1, 2: 1, 3: 0, 4: 0}
    t = {r.road: (r.kept, r.discarded) for r in quality.geofence_tally(quality.geofence_flags(df, "k", "seq")).collect()}
    assert t == {"r1": (2, 0), "r2": (0, 2), None: (2, 2)}
    assert quality.apply_geofence(df, quality.geofence_flags(df, "k", "seq"), "k").count() == 3


def test_ingest_tally(spark):
    m = spark.createDataFrame([("M60", "2024-01", True), ("M60", "2024-02", False), ("M60", "2024-02", True)],
                              "road string, month string, ok boolean")
    t = {(r.road, r.month): (r.n_success, r.n_failed, r.failed_months) for r in quality.ingest_tally(m).collect()}
    assert t[("M60", None)] == (2, 1, "2024-02") and t[(None, None)] == (2, 1, "2024-02")
    assert F is not None
