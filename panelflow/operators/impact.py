"""Event impact against an outlier-trimmed median baseline, rankings and
reports.

Plan shape: quality filter -> interval flags -> baseline mark -> per-key
quartiles of the baseline (one aggregate) joined back to trim outliers ->
each row exploded into the (period, team) labels it belongs to -> ONE
grouped percentile aggregate for all labels -> baseline vs period join ->
sample gate -> window ranks.  The reference does seven filtered passes
per segment; here each stage is a single distributed pass.

Exact quantiles use ``percentile`` (linear interpolation, as NumPy);
``approx=True`` switches to ``percentile_approx`` whose buffer is bounded
for very large groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.numeric import np_round, safe_div
from panelflow.functions.text import clean_segment_name, direction_code, junctions_of, segment_label

BASELINE = "baseline"
PERIODS = ("pre_match", "post_match")
# (team label, 0/1 flag column made by intervals.flag_match_periods)
TEAM_FLAGS = (("united", "is_team_0"), ("city", "is_team_1"))
METRIC_COLS = ("total_traffic_flow", "fused_average_speed")


def _quantiles(x: str, probs, approx: bool, accuracy: int) -> Column:
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if approx:
        return F.percentile_approx(x, arr, accuracy)
    return F.percentile(x, arr)


def quality_filter(df: DataFrame, min_completeness: int = 3) -> DataFrame:
    """Keep complete hours: not interpolated and enough readings."""
    return df.where((F.col("is_interpolated") == 0) & (F.col("data_completeness") >= min_completeness))


def trim_baseline_outliers(df: DataFrame, keys=("segment_id",), value: str = "total_traffic_flow",
                           k: float = 1.5, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Baseline rows whose value lies outside [q1 - k*IQR, q3 + k*IQR] of
    the key's baseline values stop being baseline.

    The quartiles are a window aggregate over the key (no second pass over
    the input and no join back); the input is already partitioned by key
    when it comes from the gap filter, so this adds no shuffle.  A key
    holds its hourly rows only (bounded by the covered span)."""
    w = Window.partitionBy(*keys)
    base_v = F.when(F.col("is_baseline") == 1, F.col(value))
    q = (F.percentile_approx(base_v, F.array(F.lit(0.25), F.lit(0.75)), accuracy) if approx
         else F.percentile(base_v, F.array(F.lit(0.25), F.lit(0.75)))).over(w)
    d = df.withColumn("_q", q)
    lo = F.col("_q")[0] - F.lit(k) * (F.col("_q")[1] - F.col("_q")[0])
    hi = F.col("_q")[1] + F.lit(k) * (F.col("_q")[1] - F.col("_q")[0])
    v = F.col(value)
    outlier = F.coalesce((v < lo) | (v > hi), F.lit(False))
    return (d.withColumn("is_baseline", F.when((F.col("is_baseline") == 1) & outlier, F.lit(0))
                         .otherwise(F.col("is_baseline")))
             .drop("_q"))


def period_labels(df: DataFrame, team_flags=TEAM_FLAGS) -> DataFrame:
    """One row per (row, label) for every label the row belongs to:
    baseline/all, {pre,post}/all and {pre,post}/<team>."""
    labels = [F.when(F.col("is_baseline") == 1, F.struct(F.lit(BASELINE).alias("period"), F.lit("all").alias("team")))]
    for p, flag in (("pre_match", "is_pre_match"), ("post_match", "is_post_match")):
        labels.append(F.when(F.col(flag) == 1, F.struct(F.lit(p).alias("period"), F.lit("all").alias("team"))))
        for team, tflag in team_flags:
            labels.append(F.when((F.col(flag) == 1) & (F.col(tflag) == 1),
                                 F.struct(F.lit(p).alias("period"), F.lit(team).alias("team"))))
    arr = F.filter(F.array(*labels), lambda s: s.isNotNull())
    return df.withColumn("_lab", F.explode(arr)).withColumns(
        {"period": F.col("_lab.period"), "team": F.col("_lab.team")}).drop("_lab")


def period_metrics(labelled: DataFrame, keys=("segment_id",), flow: str = "total_traffic_flow",
                   speed: str = "fused_average_speed", approx: bool = False,
                   accuracy: int = 10000) -> DataFrame:
    """Median, quartiles and IQR of flow and speed per key and label, and
    the row count.  Quartiles are NULL below two rows."""
    g = labelled.groupBy(*keys, "period", "team").agg(
        F.count(F.lit(1)).alias("sample_count"),
        _quantiles(flow, (0.25, 0.5, 0.75), approx, accuracy).alias("_f"),
        _quantiles(speed, (0.25, 0.5, 0.75), approx, accuracy).alias("_s"))
    two = F.col("sample_count") >= 2
    out = {"median_flow": F.col("_f")[1], "median_speed": F.col("_s")[1]}
    for name, arr in (("flow", "_f"), ("speed", "_s")):
        out[f"{name}_q1"] = F.when(two, F.col(arr)[0])
        out[f"{name}_q3"] = F.when(two, F.col(arr)[2])
        out[f"{name}_iqr"] = F.when(two, F.col(arr)[2] - F.col(arr)[0])
    return g.withColumns(out).drop("_f", "_s")


def impacts(flagged: DataFrame, keys=("segment_id",), min_samples: int = 3,
            approx: bool = False, trim_k: float = 1.5, team_flags=TEAM_FLAGS) -> DataFrame:
    """Long impact table: one row per key, period and team with the
    difference of medians from the baseline (and percent when the baseline
    median is positive), the period's quartiles and sample count.

    ``flagged`` must carry is_baseline, is_pre_match, is_post_match and the
    team flags (see ``intervals.flag_match_periods`` / ``mark_baseline``).
    """
    trimmed = trim_baseline_outliers(flagged, keys, approx=approx, k=trim_k)
    m = period_metrics(period_labels(trimmed, team_flags), keys, approx=approx)
    # baseline medians beside each label's row: a window over the key on
    # the small metrics table (already partitioned by key) instead of a
    # self-join, which would evaluate the whole input twice
    wk = Window.partitionBy(*keys)
    is_base = F.col("period") == BASELINE
    j = m.withColumns({
        "baseline_flow": F.max(F.when(is_base, F.col("median_flow"))).over(wk),
        "baseline_speed": F.max(F.when(is_base, F.col("median_speed"))).over(wk),
    })
    j = j.where(~is_base & (F.col("sample_count") >= min_samples) & F.col("baseline_flow").isNotNull())
    flow_diff = F.col("median_flow") - F.col("baseline_flow")
    speed_diff = F.col("median_speed") - F.col("baseline_speed")
    return j.select(
        *keys, "period", "team", "baseline_flow", "baseline_speed",
        flow_diff.alias("flow_diff"),
        F.when(F.col("baseline_flow") > 0, safe_div(flow_diff, F.col("baseline_flow")) * 100).alias("flow_pct"),
        "flow_iqr", "flow_q1", "flow_q3",
        speed_diff.alias("speed_diff"),
        F.when(F.col("baseline_speed") > 0, safe_div(speed_diff, F.col("baseline_speed")) * 100).alias("speed_pct"),
        "speed_iqr", "speed_q1", "speed_q3", "sample_count")


# (ranking metric, descending?) - flow rises and speed falls are "worse".
RANKINGS = (("flow_diff", True), ("flow_pct", True), ("speed_diff", False), ("speed_pct", False))


def rank_impacts(imp: DataFrame, key: str = "segment_id", top: int | None = 20) -> DataFrame:
    """Rankings per impact type (period_team) and metric in ONE window:
    each impact row is exploded into its four ranking entries with a sort
    value whose sign encodes the direction, then row_number per
    (impact_type, metric), NULLs last, key as tie-break.  With ``top`` the
    filter is planned as a per-partition group limit before the shuffle."""
    it = imp.withColumn("impact_type", F.concat_ws("_", "period", "team"))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"),
                                 (F.col(m) if desc else -F.col(m)).alias("_sv")) for m, desc in RANKINGS])
    e = it.withColumn("_e", F.explode(entries)).withColumns(
        {"metric": F.col("_e.metric"), "_sv": F.col("_e._sv")}).drop("_e")
    w = Window.partitionBy("impact_type", "metric").orderBy(F.col("_sv").desc_nulls_last(), F.col(key))
    r = e.withColumn("rank", F.row_number().over(w))
    if top is not None:
        r = r.where(F.col("rank") <= top)
    return r.select(F.concat_ws("_", "impact_type", "metric").alias("ranking"), "rank", key, "impact_type",
                    "flow_diff", "flow_pct", "speed_diff", "speed_pct", "sample_count",
                    clean_segment_name(F.col(key)).alias("clean_name"))


def criticality(imp: DataFrame, key: str = "segment_id", significant_pct: float = 10.0) -> DataFrame:
    """Per key: max flow % change, share of impacts above
    ``significant_pct``, std of flow % (consistency); min-max scaled over
    all keys (0 when constant, consistency inverted); score = mean of the
    first two scaled values.  Keys with any metric missing are left out."""
    per = imp.groupBy(key).agg(
        F.max("flow_pct").alias("max_flow_pct_increase"),
        F.avg(F.when(F.col("flow_pct").isNull(), None)
              .otherwise((F.col("flow_pct") > significant_pct).cast("double"))).alias("freq_significant_impacts"),
        F.stddev_samp("flow_pct").alias("flow_pct_consistency"))
    per = per.dropna(subset=["max_flow_pct_increase", "freq_significant_impacts", "flow_pct_consistency"])
    cols = ["max_flow_pct_increase", "freq_significant_impacts", "flow_pct_consistency"]
    # one-row bounds table: broadcasting it is size-safe by construction
    bounds = per.agg(*[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols])
    j = per.crossJoin(F.broadcast(bounds))

    def scaled(c):
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    j = j.withColumns({
        "max_flow_pct_increase_norm": scaled(cols[0]),
        "freq_significant_impacts_norm": scaled(cols[1]),
        "flow_pct_consistency_norm": F.when(F.col(f"_max_{cols[2]}") > F.col(f"_min_{cols[2]}"),
                                            F.lit(1.0) - scaled(cols[2])).otherwise(F.lit(0.0)),
    })
    j = j.withColumn("criticality_score",
                     (F.col("max_flow_pct_increase_norm") + F.col("freq_significant_impacts_norm")) / 2)
    return j.select(key, *cols, "max_flow_pct_increase_norm", "freq_significant_impacts_norm",
                    "flow_pct_consistency_norm", "criticality_score")


def team_comparison(imp: DataFrame, key: str = "segment_id", metric: str = "flow_diff",
                    teams=("united", "city"), top_n: int = 5) -> DataFrame:
    """Per period and team: best value and mean of the best ``top_n``."""
    w = Window.partitionBy("period", "team").orderBy(F.col(metric).desc_nulls_last(), F.col(key))
    r = imp.where(F.col("team").isin(*teams)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n)
    return r.groupBy("period", "team").agg(
        F.max(F.when(F.col("_r") == 1, F.col(metric))).alias(f"top1_{metric}"),
        F.avg(metric).alias(f"top{top_n}_mean_{metric}"))


def top_by_abs_pct(imp: DataFrame, key: str = "segment_id", n: int = 4,
                   teams=("united", "city")) -> DataFrame:
    """Top ``n`` keys per (period, team) by |flow_pct| with plot labels."""
    d = imp.where(F.col("team").isin(*teams)).withColumn("abs_flow_pct", F.abs("flow_pct"))
    w = Window.partitionBy("period", "team").orderBy(F.col("abs_flow_pct").desc_nulls_last(), F.col(key))
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    cn = clean_segment_name(F.col(key))
    return d.select("period", "team", "rank", key, "flow_pct", "abs_flow_pct",
                    segment_label(direction_code(F.col(key)), junctions_of(F.col(key)), cn).alias("segment_label"))


def top_segments(imp: DataFrame, crit: DataFrame, key: str = "segment_id", n: int = 6) -> DataFrame:
    """The ``n`` most critical keys; keys without a criticality score are
    ranked after them by pre-match flow difference."""
    c = crit.select(key, F.lit(0).alias("_pri"), (-F.col("criticality_score")).alias("_v"))
    f = (imp.where((F.col("period") == "pre_match") & (F.col("team") == "all") & F.col("flow_diff").isNotNull())
            .select(key, F.lit(1).alias("_pri"), (-F.col("flow_diff")).alias("_v")))
    best = c.unionByName(f).groupBy(key).agg(F.min(F.struct("_pri", "_v")).alias("_b"))
    return best.orderBy(F.col("_b._pri"), F.col("_b._v"), F.col(key)).limit(n).select(key)


def viz_table(imp: DataFrame, tops: DataFrame, key: str = "segment_id",
              periods=PERIODS, teams=("all", "united", "city")) -> DataFrame:
    """Dense table: each top key x period x team, missing impacts as NULL."""
    spine = F.broadcast(tops.sparkSession.createDataFrame(
        [(p, t) for p in periods for t in teams], "period string, team string"))
    dense = F.broadcast(tops).crossJoin(spine)
    j = dense.join(imp, [key, "period", "team"], "left")
    return j.select(key, clean_segment_name(F.col(key)).alias("clean_name"),
                    direction_code(F.col(key)).alias("direction"), junctions_of(F.col(key)).alias("junctions"),
                    "period", "team", "flow_diff", "flow_pct", "flow_iqr", "flow_q1", "flow_q3",
                    "speed_diff", "speed_pct", "speed_iqr", "speed_q1", "speed_q3", "sample_count",
                    (F.col("flow_iqr") / 2).alias("flow_err"), (F.col("speed_iqr") / 2).alias("speed_err"))


def findings(imp: DataFrame, key: str = "segment_id") -> DataFrame:
    """One row per headline finding (largest flow rise and speed drop per
    period, over all teams)."""
    a = imp.where(F.col("team") == "all")
    rows = []
    for period in PERIODS:
        p = a.where(F.col("period") == period)
        fd, sd = F.col("flow_diff"), F.col("speed_diff")
        rows.append(p.agg(F.max_by(F.struct(key, "flow_diff", "flow_pct"),
                                   F.when(fd.isNotNull(), F.struct(fd, F.col(key)))).alias("b"))
                    .select(F.lit(f"highest_{period}_flow_increase").alias("finding"),
                            F.col(f"b.{key}").alias(key), F.col("b.flow_diff").alias("value"),
                            F.col("b.flow_pct").alias("pct")))
        rows.append(p.agg(F.min_by(F.struct(key, "speed_diff", "speed_pct"),
                                   F.when(sd.isNotNull(), F.struct(sd, F.col(key)))).alias("b"))
                    .select(F.lit(f"highest_{period}_speed_reduction").alias("finding"),
                            F.col(f"b.{key}").alias(key), (-F.col("b.speed_diff")).alias("value"),
                            (-F.col("b.speed_pct")).alias("pct")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    one = [np_round(F.col(c), 1) for c in ("value", "pct")]
    return out.withColumn("text", F.format_string("%s: %.1f (%.1f%%) at %s", "finding", *one, key))


def team_findings(imp: DataFrame, key: str = "segment_id", period: str = "pre_match",
                  teams=("united", "city"), top: int = 5) -> DataFrame:
    """Team lines of the report: each team's segment with the largest flow
    rise before matches, with the mean rise of its ``top`` segments and the
    lead of that mean over the other team's in percent."""
    w = Window.partitionBy("team").orderBy(F.col("flow_diff").desc_nulls_last(), F.col(key))
    d = imp.where((F.col("period") == period) & F.col("team").isin(*teams) & F.col("flow_diff").isNotNull())
    ranked = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    first = F.col("_r") == 1
    g = ranked.groupBy("team").agg(F.max(F.when(first, F.col(key))).alias(key),
                                   F.max(F.when(first, F.col("flow_diff"))).alias("value"),
                                   F.avg("flow_diff").alias("_mean"))
    total = F.sum("_mean").over(Window.partitionBy())       # two teams, so the rest is the other's
    other = F.when(F.count(F.lit(1)).over(Window.partitionBy()) == 2, total - F.col("_mean"))
    g = g.withColumn("pct", (safe_div(F.col("_mean"), other) - 1) * 100)
    one = [np_round(F.col(c), 1) for c in ("value", "_mean")]
    return g.select(F.concat(F.lit("team_"), F.col("team")).alias("finding"), key, "value", "pct",
                    F.format_string("%s: highest rise %.1f at %s, top %d mean %.1f", F.col("team"), one[0], F.col(key),
                                    F.lit(top), one[1]).alias("text"))
