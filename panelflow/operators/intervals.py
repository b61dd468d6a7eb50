"""Event windows and interval joins.

Labels depend on time only, so they are resolved once on a small table
built from the windows alone (elementary time pieces between window
boundaries, see ``_labelled_pieces``) and each data row is attached to
its piece in a single pass over the data.  Range predicates are answered
by equi-joins on hour buckets plus a residual test, so nothing plans as
a nested-loop or cartesian join, however many windows there are, and the
data is never scanned a second time for its distinct times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.timecols import combine_date_time, floor_hour


PRE, POST, NONE = "pre_match", "post_match", "no_match"


def match_windows(fixtures: DataFrame, date_col: str = "Date", time_col: str = "Kick-off Time",
                  team_col: str = "Team", fixture_col: str = "Fixture", order_col: str = "seq",
                  pre_hours: int = 2, duration_hours: int = 2, post_hours: int = 2) -> DataFrame:
    """Pre window [k - pre, k) and post window [k + duration, k + duration + post)
    around each kick-off k; rows whose kick-off does not parse are dropped."""
    k = combine_date_time(F.col(date_col), F.col(time_col))
    w = fixtures.withColumn("_kickoff", k).where(F.col("_kickoff").isNotNull())
    return w.select(
        F.col(team_col).alias("match_team"),
        F.col(fixture_col).alias("fixture"),
        F.timestamp_add("HOUR", F.lit(-pre_hours), "_kickoff").alias("start_pre_match"),
        F.col("_kickoff").alias("end_pre_match"),
        F.timestamp_add("HOUR", F.lit(duration_hours), "_kickoff").alias("start_post_match"),
        F.timestamp_add("HOUR", F.lit(duration_hours + post_hours), "_kickoff").alias("end_post_match"),
        F.col(order_col).alias("seq"),
    )


def dropped_fixture_count(fixtures: DataFrame, date_col: str = "Date",
                          time_col: str = "Kick-off Time") -> DataFrame:
    """Number of fixtures whose kick-off does not parse."""
    k = combine_date_time(F.col(date_col), F.col(time_col))
    return fixtures.agg(F.count_if(k.isNull()).alias("dropped"), F.count(F.lit(1)).alias("total"))


def window_phases(windows: DataFrame) -> DataFrame:
    """Long form: one row per (window, phase) with its order key
    (seq, phase_rank); the pre phase is applied before the post phase."""
    return windows.select(
        "seq", "match_team",
        F.explode(F.array(
            F.struct(F.lit(PRE).alias("period"), F.lit(0).alias("phase_rank"),
                     F.col("start_pre_match").alias("start_ts"), F.col("end_pre_match").alias("end_ts")),
            F.struct(F.lit(POST).alias("period"), F.lit(1).alias("phase_rank"),
                     F.col("start_post_match").alias("start_ts"), F.col("end_post_match").alias("end_ts")),
        )).alias("p")).select("seq", "match_team", "p.*")


def _hour_buckets(lo, hi):
    return F.explode(F.sequence(floor_hour(lo), floor_hour(hi), F.expr("INTERVAL 1 HOUR")))


def _covers(closed: str):
    """Condition for a phase (start_ts, end_ts) to cover a piece (lo, hi, is_point)."""
    if closed not in ("left", "both"):
        raise ValueError("closed must be 'left' or 'both'")
    lo, hi, s, e = F.col("lo"), F.col("hi"), F.col("start_ts"), F.col("end_ts")
    point_in = (lo >= s) & ((lo < e) if closed == "left" else (lo <= e))
    open_in = (lo >= s) & (hi <= e)
    return F.when(F.col("is_point"), point_in).otherwise(open_in)


def _labelled_pieces(windows: DataFrame, closed: str, aggs) -> DataFrame:
    """Time cut into elementary pieces at every window boundary: each
    boundary as a point [b, b] and each gap between consecutive boundaries
    as an open interval (b_i, b_i+1).  Every time instant lies in exactly
    one piece and every phase covers whole pieces, so a piece's label is
    that of any instant inside it.  The table depends on the windows only
    (size O(#windows)), never on the data; pieces no phase covers are
    dropped.  Phases are matched to pieces by an equi-join on the hour
    bucket of the piece start plus the covering test."""
    ph = window_phases(windows)
    bounds = ph.select(F.col("start_ts").alias("b")).union(ph.select(F.col("end_ts").alias("b"))).distinct()
    # the boundary table has 2 rows per window: a global order over it is small
    nxt = bounds.withColumn("nb", F.lead("b").over(Window.orderBy("b")))
    pieces = (bounds.select(F.col("b").alias("lo"), F.col("b").alias("hi"), F.lit(True).alias("is_point"))
              .unionByName(nxt.where(F.col("nb").isNotNull())
                           .select(F.col("b").alias("lo"), F.col("nb").alias("hi"), F.lit(False).alias("is_point"))))
    pb = pieces.withColumn("_bucket", floor_hour("lo"))
    phb = ph.withColumn("_bucket", _hour_buckets("start_ts", "end_ts"))
    cov = pb.join(phb, "_bucket").where(_covers(closed))
    return cov.groupBy("lo", "hi", "is_point").agg(*aggs)


def _attach(df: DataFrame, pieces: DataFrame, ts_col: str) -> DataFrame:
    """Left join each row to the one piece containing its time: equi-join
    on the hour bucket (pieces expanded to the hours they span, a bounded
    number since every kept piece lies inside one window) plus the
    point / open-interval test.  The piece table is small, so AQE
    broadcasts it from its measured size; otherwise it is a shuffle join."""
    pb = (pieces.withColumnsRenamed({"lo": "_lo", "hi": "_hi", "is_point": "_is_point"})
                .withColumn("_pbucket", _hour_buckets("_lo", "_hi")))
    t = F.col(ts_col)
    inside = F.when(F.col("_is_point"), t == F.col("_lo")).otherwise((t > F.col("_lo")) & (t < F.col("_hi")))
    d = df.withColumn("_bucket", floor_hour(ts_col))
    j = d.join(pb, (F.col("_bucket") == F.col("_pbucket")) & inside, "left")
    return j.drop("_bucket", "_pbucket", "_lo", "_hi", "_is_point")


def interval_labels(windows: DataFrame, closed: str = "left") -> DataFrame:
    """Last writer wins per piece: (match_period, match_team) of the last
    covering phase in (seq, phase_rank) order."""
    lab = F.max_by(F.struct(F.col("period").alias("match_period"), "match_team"), F.struct("seq", "phase_rank"))
    p = _labelled_pieces(windows, closed, [lab.alias("_l")])
    return p.select("lo", "hi", "is_point", "_l.match_period", "_l.match_team")


def label_last_writer(df: DataFrame, windows: DataFrame, ts_col: str = "datetime",
                      closed: str = "left") -> DataFrame:
    """``match_period`` / ``match_team`` per row, ``no_match`` when outside
    every window; half-open windows by default."""
    out = _attach(df, interval_labels(windows, closed), ts_col)
    return (out.withColumn("match_period", F.coalesce("match_period", F.lit(NONE)))
               .withColumn("match_team", F.coalesce("match_team", F.lit(NONE))))


def interval_flags(windows: DataFrame, closed: str = "both") -> DataFrame:
    return _labelled_pieces(windows, closed, [
        F.max((F.col("period") == PRE).cast("int")).alias("is_pre_match"),
        F.max((F.col("period") == POST).cast("int")).alias("is_post_match"),
        F.max_by("match_team", F.struct("seq", "phase_rank")).alias("match_team")])


def flag_match_periods(df: DataFrame, windows: DataFrame, ts_col: str = "datetime",
                       closed: str = "both", teams=("Man United", "Man City")) -> DataFrame:
    """OR-ed pre / post flags (closed windows by default), ``is_match_period``,
    the last-writer team and one 0/1 column per team in ``teams``
    (named ``is_team_<i>`` in order)."""
    out = (_attach(df, interval_flags(windows, closed), ts_col)
             .withColumn("is_pre_match", F.coalesce("is_pre_match", F.lit(0)))
             .withColumn("is_post_match", F.coalesce("is_post_match", F.lit(0)))
             .withColumn("match_team", F.coalesce("match_team", F.lit(NONE))))
    out = out.withColumn("is_match_period", F.greatest("is_pre_match", "is_post_match"))
    return out.withColumns({f"is_team_{i}": (F.col("match_team") == t).cast("int")
                            for i, t in enumerate(teams)})


def control_periods(events: DataFrame, readings: DataFrame, min_count: int = 3,
                    event_ts: str = "kickoff", ts_col: str = "datetime",
                    day_type_col: str = "day_type") -> DataFrame:
    """For each event: number of distinct reading times of the same day type
    whose hour is within half an hour of the event hour (integer hours, so
    equal hours), kept when at least ``min_count`` exist.  The number is the
    same for all events of a (day type, hour), so readings are aggregated to
    one row each (24 per day type) before events join them; an event's own
    times are ``control_times``."""
    slots = (_slot_times(readings, ts_col, day_type_col).groupBy(day_type_col, "_h")
             .agg(F.count(F.lit(1)).alias("n_control")).where(F.col("n_control") >= min_count))
    return events.withColumn("_h", F.hour(event_ts)).join(F.broadcast(slots), [day_type_col, "_h"]).drop("_h")


def control_times(events: DataFrame, readings: DataFrame, event_ts: str = "kickoff", ts_col: str = "datetime",
                  day_type_col: str = "day_type") -> DataFrame:
    """The control times themselves, one row per (event, time)."""
    e = events.withColumn("_h", F.hour(event_ts))
    return e.join(_slot_times(readings, ts_col, day_type_col), [day_type_col, "_h"]).drop("_h")


def _slot_times(readings: DataFrame, ts_col: str, day_type_col: str) -> DataFrame:
    return readings.select(ts_col, day_type_col).distinct().where(F.col(ts_col).isNotNull()).withColumn(
        "_h", F.hour(ts_col))


def mark_baseline(df: DataFrame, slots=("day_of_week", "hour_of_day"), intended: bool = False) -> DataFrame:
    """``is_baseline``.  Exact mode: every row outside a match period.
    Intended mode: only such rows in a (weekday, hour) slot that also holds
    a match row (a semi join on the slot)."""
    base = (F.col("is_match_period") == 0).cast("int")
    if not intended:
        return df.withColumn("is_baseline", base)
    d = df.withColumns({"day_of_week": F.weekday("datetime"), "hour_of_day": F.hour("datetime")})
    match_slots = d.where(F.col("is_match_period") == 1).select(*slots).distinct() \
        .withColumn("_slot_has_match", F.lit(1))
    return (d.join(match_slots, list(slots), "left")
             .withColumn("is_baseline", base * F.coalesce("_slot_has_match", F.lit(0)))
             .drop("_slot_has_match"))
