"""Registered queries over the driver's test tables.

Each entry takes (spark, sf_dir) and returns a DataFrame.  Small derived
tables (windows, weather, impacts), file round trips, streams and model fits
run jobs while the entry is called; the rest is lazy.  Float outputs are rounded to 6 decimals (see ``oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators import impact as imp_ops
from panelflow.operators import intervals, rollup
from panelflow.plans.registry import query, round_floats
from panelflow.session import cut_lineage, input_signature, memo_plan, memo_small
from panelflow.sources import testdata as td

# Parameters of the test views.  The event stream is sparse, so the
# full-hour threshold used by the impact chain is 1 reading (4 in the
# plain roll-up), see SURVEY 7.4.
ROLLUP_FULL = 4
IMPACT_FULL = 1
IMPACT_MIN_COMPLETENESS = 1
MIN_COMPLETENESS = 3      # with ROLLUP_FULL: the thresholds of dense data
GAP_HOURS = 6
TEAMS = ("Man United", "Man City")


def events_signature(spark, sf):
    return input_signature(spark, f"{sf}/events.parquet")


def hourly(spark, sf, segment="event_type", full_count=ROLLUP_FULL, first_cols=td.FIRST_COLS) -> DataFrame:
    """The hourly roll-up with the attribute columns that the caller needs: text
    attributes are keys of a first aggregate, so unused ones would be shuffled."""
    return memo_plan(spark, ("hourly", sf, segment, full_count, tuple(first_cols), events_signature(spark, sf)),
                     lambda: rollup.hourly_rollup(td.readings(spark, sf, segment), first_cols=first_cols,
                                                  full_count=full_count))


def windows(spark, sf) -> DataFrame:
    """Event windows derived from the event days: one small table, written
    once to the checkpoint folder and read by every branch."""
    key = ("windows", sf, input_signature(spark, f"{sf}/events.parquet"))
    return memo_small(spark, key, lambda: cut_lineage(intervals.match_windows(td.fixtures(spark, sf))))


def impact_input(spark, sf, segment="user40", full_count=IMPACT_FULL,
                 min_completeness=IMPACT_MIN_COMPLETENESS) -> DataFrame:
    """Hourly -> gap filter -> quality filter -> closed-window flags ->
    baseline (exact mode)."""
    def build():
        h = rollup.gap_filter(hourly(spark, sf, segment, full_count, ()), max_gap_hours=GAP_HOURS)
        h = imp_ops.quality_filter(h, min_completeness)
        f = intervals.flag_match_periods(h, windows(spark, sf), closed="both", teams=TEAMS)
        return intervals.mark_baseline(f)
    return memo_plan(spark, ("impact_input", sf, segment, full_count, min_completeness, events_signature(spark, sf)),
                     build)


def impacts(spark, sf, segment="user40") -> DataFrame:
    """The long impact table (segments x 6 labels, small): computed once and
    checkpointed, so rankings, criticality and reports that read it several
    times never re-run the chain from the raw readings."""
    return memo_small(spark, ("impacts", sf, segment, events_signature(spark, sf)),
                      lambda: cut_lineage(imp_ops.impacts(impact_input(spark, sf, segment))))


@query("hourly_rollup")
def q_hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return round_floats(hourly(spark, sf, "event_type"))


@query("gap_filter")
def q_gap_filter(spark, sf):
    h = hourly(spark, sf, "user40", IMPACT_FULL, ())
    return round_floats(rollup.gap_filter(h, max_gap_hours=GAP_HOURS)
                        .select("segment_id", "datetime", "total_traffic_flow", "data_completeness"))


@query("match_windows")
def q_match_windows(spark, sf):
    return windows(spark, sf)


@query("interval_label_last_writer")
def q_interval_label_last_writer(spark, sf):
    r = td.readings(spark, sf, "event_type").select("segment_id", "row_seq", "datetime")
    return intervals.label_last_writer(r, windows(spark, sf), closed="left")


@query("interval_flags_closed")
def q_interval_flags_closed(spark, sf):
    r = td.readings(spark, sf, "event_type").select("segment_id", "row_seq", "datetime")
    return intervals.flag_match_periods(r, windows(spark, sf), closed="both", teams=TEAMS)


@query("baseline_outlier_removed")
def q_baseline_outlier_removed(spark, sf):
    base = impact_input(spark, sf).withColumn("_was_baseline", F.col("is_baseline"))
    t = imp_ops.trim_baseline_outliers(base)
    return t.groupBy("segment_id").agg(F.sum("_was_baseline").alias("n_baseline"),
                                       F.sum("is_baseline").alias("n_kept"), F.count(F.lit(1)).alias("n_rows"))


@query("impact_by_segment_team")
def q_impact_by_segment_team(spark, sf):
    return round_floats(impacts(spark, sf))


@query("impact_complete_hours")
def q_impact_complete_hours(spark, sf):
    """Impacts of the dense segments over complete hours only (4 readings)."""
    return round_floats(imp_ops.impacts(impact_input(spark, sf, "event_type", ROLLUP_FULL, MIN_COMPLETENESS)))


@query("quality_filter_hours")
def q_quality_filter_hours(spark, sf):
    """Hours per segment that pass the completeness filter."""
    h = rollup.gap_filter(hourly(spark, sf, "event_type", ROLLUP_FULL), max_gap_hours=GAP_HOURS)
    return imp_ops.quality_filter(h, MIN_COMPLETENESS).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_hours"))


@query("impact_top20")
def q_impact_top20(spark, sf):
    return round_floats(imp_ops.rank_impacts(impacts(spark, sf), top=20))


@query("criticality")
def q_criticality(spark, sf):
    return round_floats(imp_ops.criticality(impacts(spark, sf)))


@query("team_comparison")
def q_team_comparison(spark, sf):
    return round_floats(imp_ops.team_comparison(impacts(spark, sf)))


@query("impact_viz_top4")
def q_impact_viz_top4(spark, sf):
    return round_floats(imp_ops.top_by_abs_pct(impacts(spark, sf)))


@query("impact_viz_dense")
def q_impact_viz_dense(spark, sf):
    imp = impacts(spark, sf)
    tops = imp_ops.top_segments(imp, imp_ops.criticality(imp))
    return round_floats(imp_ops.viz_table(imp, tops))


@query("findings_report")
def q_findings_report(spark, sf):
    """Headline findings with their text, and the team comparison."""
    imp = impacts(spark, sf)
    return round_floats(imp_ops.findings(imp).unionByName(imp_ops.team_findings(imp)))


@query("impact_findings")
def q_impact_findings(spark, sf):
    return round_floats(imp_ops.findings(impacts(spark, sf)).drop("text"))


# Further query groups register themselves on import.
from panelflow.plans import feature_queries  # noqa: E402,F401
from panelflow.plans import quality_queries  # noqa: E402,F401
from panelflow.plans import ml_queries  # noqa: E402,F401
from panelflow.plans import io_queries  # noqa: E402,F401
from panelflow.plans import stream_queries  # noqa: E402,F401


@query("supplier_panel_rollup")
def q_supplier_panel_rollup(spark, sf):
    """The large panel (one segment per supplier, from lineitem): hourly
    roll-up of quantity and price with completeness."""
    p = td.supplier_panel(spark, sf)
    h = rollup.hourly_rollup(p, sum_cols=["total_traffic_flow"], mean_cols=["fused_average_speed"], full_count=4)
    return round_floats(h)


@query("supplier_panel_profile")
def q_supplier_panel_profile(spark, sf):
    """Per supplier and weekday: mean, std and quartiles of quantity."""
    p = td.supplier_panel(spark, sf).withColumn("weekday", F.weekday("datetime"))
    g = p.groupBy("segment_id", "weekday").agg(
        F.count(F.lit(1)).alias("n"), F.avg("total_traffic_flow").alias("mean"),
        F.stddev_samp("total_traffic_flow").alias("std"),
        F.percentile("total_traffic_flow", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return round_floats(g.select("segment_id", "weekday", "n", "mean", "std", F.col("_q")[0].alias("q1"),
                                 F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")))
