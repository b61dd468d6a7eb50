import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from panelflow.operators import impact, intervals

T0 = dt.datetime(2024, 1, 1)
TEAMS = ("Man United", "Man City")


def _fixture(seed=2):
    rnd = random.Random(seed)
    rows = []
    for seg in ("s1", "s2", "s3", "s4"):
        for h in range(0, 24 * 10):
            if rnd.random() < 0.3:
                continue
            flow = rnd.uniform(100, 400)
            if seg == "s2" and h == 50:
                flow = 5000.0                              # outlier beyond 1.5 IQR
            if seg == "s4":
                flow = 0.0                                 # baseline median 0 -> pct NULL
            speed = None if rnd.random() < 0.05 else rnd.uniform(40, 70)
            rows.append((seg, T0 + dt.timedelta(hours=h), flow, speed))
    wins = []
    for i, d in enumerate(range(0, 10, 2)):
        k = T0 + dt.timedelta(days=d, hours=15)
        wins.append((TEAMS[i % 2], f"f{i}", k - dt.timedelta(hours=2), k, k + dt.timedelta(hours=2),
                     k + dt.timedelta(hours=4), i))
    k = T0 + dt.timedelta(days=3, hours=16)                # overlaps nothing but a different team
    wins.append((TEAMS[1], "x", k - dt.timedelta(hours=2), k, k + dt.timedelta(hours=2), k + dt.timedelta(hours=4), 99))
    return rows, wins


def _reference(rows, wins, min_samples=3):
    """Plain pandas version of the per-segment loop (independent check)."""
    out = []
    df_all = pd.DataFrame(rows, columns=["segment_id", "datetime", "total_traffic_flow", "fused_average_speed"])
    w = pd.DataFrame(wins, columns=["match_team", "fixture", "spre", "epre", "spost", "epost", "seq"]).sort_values("seq")
    for seg, df in df_all.groupby("segment_id"):
        df = df.copy()
        df["pre"] = 0
        df["post"] = 0
        df["team"] = "no_match"
        for _, m in w.iterrows():
            a = (df.datetime >= m.spre) & (df.datetime <= m.epre)
            df.loc[a, ["pre"]] = 1
            df.loc[a, "team"] = m.match_team
            b = (df.datetime >= m.spost) & (df.datetime <= m.epost)
            df.loc[b, ["post"]] = 1
            df.loc[b, "team"] = m.match_team
        df["base"] = ((df.pre == 0) & (df.post == 0)).astype(int)
        bf = df.loc[df.base == 1, "total_traffic_flow"]
        q1, q3 = bf.quantile(0.25), bf.quantile(0.75)
        iqr = q3 - q1
        df.loc[(df.base == 1) & ((df.total_traffic_flow < q1 - 1.5 * iqr) | (df.total_traffic_flow > q3 + 1.5 * iqr)), "base"] = 0
        b = df[df.base == 1]
        bm_f, bm_s = b.total_traffic_flow.median(), b.fused_average_speed.median()
        if np.isnan(bm_f):
            continue
        for period, flag in (("pre_match", "pre"), ("post_match", "post")):
            for team, tname in (("all", None), ("united", TEAMS[0]), ("city", TEAMS[1])):
                p = df[(df[flag] == 1) & ((df.team == tname) if tname else True)]
                if len(p) < min_samples:
                    continue
                fd = p.total_traffic_flow.median() - bm_f
                sd = p.fused_average_speed.median() - bm_s
                out.append((seg, period, team, fd, fd / bm_f * 100 if bm_f > 0 else None, sd,
                            sd / bm_s * 100 if bm_s > 0 else None, len(p),
                            p.total_traffic_flow.quantile(0.75) - p.total_traffic_flow.quantile(0.25)))
    return out


def test_impacts_match_plain_pandas(spark):
    rows, wins = _fixture()
    df = spark.createDataFrame(rows, "segment_id string, datetime timestamp_ntz, total_traffic_flow double, "
                                     "fused_average_speed double")
    w = spark.createDataFrame(wins, "match_team string, fixture string, start_pre_match timestamp_ntz, "
                                    "end_pre_match timestamp_ntz, start_post_match timestamp_ntz, "
                                    "end_post_match timestamp_ntz, seq long")
    flagged = intervals.mark_baseline(intervals.flag_match_periods(df, w, teams=TEAMS))
    got = {(r.segment_id, r.period, r.team): r for r in impact.impacts(flagged).collect()}
    exp = _reference(rows, wins)
    assert len(got) == len(exp) > 0
    for seg, period, team, fd, fp, sd, sp, n, fiqr in exp:
        r = got[(seg, period, team)]
        assert r.sample_count == n
        assert r.flow_diff == pytest.approx(fd, abs=1e-9)
        assert (r.flow_pct is None) == (fp is None) and (fp is None or r.flow_pct == pytest.approx(fp))
        assert r.speed_diff == pytest.approx(sd, abs=1e-9)
        assert r.flow_iqr == pytest.approx(fiqr, abs=1e-9)
    assert all(got[k].flow_pct is None for k in got if k[0] == "s4")


def test_rankings_are_dense_and_ordered(spark):
    rows, wins = _fixture(4)
    df = spark.createDataFrame(rows, "segment_id string, datetime timestamp_ntz, total_traffic_flow double, "
                                     "fused_average_speed double")
    w = spark.createDataFrame(wins, "match_team string, fixture string, start_pre_match timestamp_ntz, "
                                    "end_pre_match timestamp_ntz, start_post_match timestamp_ntz, "
                                    "end_post_match timestamp_ntz, seq long")
    imp = impact.impacts(intervals.mark_baseline(intervals.flag_match_periods(df, w, teams=TEAMS)))
    r = impact.rank_impacts(imp, top=None).toPandas()
    for ranking, g in r.groupby("ranking"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
        metric = ranking.split("_", 2)[-1]
        metric = metric[metric.index("_") + 1:] if metric.startswith(("all", "united", "city")) else metric
        g = g.sort_values("rank")
        vals = g[metric].tolist()
        desc = metric.startswith("flow")
        nn = [v for v in vals if v == v and v is not None]
        assert nn == sorted(nn, reverse=desc)
    crit = impact.criticality(imp).toPandas()
    assert ((crit.criticality_score >= 0) & (crit.criticality_score <= 1)).all()
    tops = impact.top_segments(imp, impact.criticality(imp), n=3)
    viz = impact.viz_table(imp, tops).toPandas()
    assert len(viz) == 3 * 6


def test_hot_segment_and_approx_mode(spark):
    """One segment holds a third of all rows (many readings per hour); the
    roll-up reduces it to one row per hour, and the approximate quantile
    mode stays close to the exact one."""
    from panelflow.operators import rollup
    rnd = random.Random(9)
    rows = []
    for h in range(24 * 6):
        for seg, reps in (("hot", 20), ("a", 5), ("b", 5), ("c", 5), ("d", 5)):
            for r in range(reps):
                rows.append((seg, len(rows), T0 + dt.timedelta(hours=h, minutes=3 * r % 60),
                             rnd.uniform(10, 50), rnd.uniform(40, 70)))
    hot_share = sum(1 for r in rows if r[0] == "hot") / len(rows)
    assert hot_share >= 1 / 3
    df = spark.createDataFrame(rows, "segment_id string, row_seq long, datetime timestamp_ntz, "
                                     "total_traffic_flow double, fused_average_speed double")
    h = rollup.hourly_rollup(df, sum_cols=["total_traffic_flow"], mean_cols=["fused_average_speed"], full_count=4)
    assert h.where("segment_id = 'hot'").count() == 24 * 6
    _, wins = _fixture()
    w = spark.createDataFrame(wins, "match_team string, fixture string, start_pre_match timestamp_ntz, "
                                    "end_pre_match timestamp_ntz, start_post_match timestamp_ntz, "
                                    "end_post_match timestamp_ntz, seq long")
    flagged = intervals.mark_baseline(intervals.flag_match_periods(h, w, teams=TEAMS))
    exact = {(r.segment_id, r.period, r.team): r.flow_diff for r in impact.impacts(flagged).collect()}
    approx = {(r.segment_id, r.period, r.team): r.flow_diff for r in impact.impacts(flagged, approx=True).collect()}
    assert exact.keys() == approx.keys() and len(exact) > 0
    for k in exact:
        assert abs(exact[k] - approx[k]) < 80.0       # flows are sums of ~20 readings of 10-50
