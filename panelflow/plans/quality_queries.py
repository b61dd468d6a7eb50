"""Registered queries: audits, geofence, name parsing, splits and the
remaining event-window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.functions import text as tx
from panelflow.functions.geo import parse_coordinate_pair
from panelflow.functions.timecols import is_weekend_day
from panelflow.operators import intervals, quality, splits
from panelflow.plans import catalog as base
from panelflow.plans import feature_queries as fq
from panelflow.plans.registry import query, round_floats
from panelflow.sources import testdata as td

FLOW_COLS = ["total_traffic_flow", "traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3",
             "traffic_flow_value4"]


def link_files(spark, sf):
    li = td.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("section_"), F.col("l_suppkey").cast("string"), F.lit("/link_"),
                              F.col("l_partkey").cast("string"), F.lit(".csv")).alias("file_name"))


@query("most_common_name")
def q_most_common_name(spark, sf):
    o = td.table(spark, sf, "orders")
    return quality.most_common_name(o, "o_custkey", "o_orderpriority", "o_orderdate")


@query("duplicate_ids")
def q_duplicate_ids(spark, sf):
    return quality.duplicate_ids(link_files(spark, sf), "link_id", "file_name", id_of_file=tx.file_link_id)


@query("duplicate_summary")
def q_duplicate_summary(spark, sf):
    f = link_files(spark, sf).withColumn("link_id", tx.file_link_id(F.col("file_name")))
    return quality.duplicate_summary(f, "link_id", "file_name", expected_files=24)


@query("missing_days")
def q_missing_days(spark, sf):
    li = td.table(spark, sf, "lineitem")
    m = quality.missing_days(li, "l_suppkey", "l_shipdate")
    return m.select("l_suppkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("day_coverage")
def q_day_coverage(spark, sf):
    c = quality.day_coverage(td.table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate")
    return c.withColumns({"first_day": F.date_format("first_day", "yyyy-MM-dd"),
                          "last_day": F.date_format("last_day", "yyyy-MM-dd")})


def readings_by_link(spark, sf):
    return td.readings(spark, sf, "event_type")


@query("zero_share_audit")
def q_zero_share_audit(spark, sf):
    return round_floats(quality.zero_share_audit(readings_by_link(spark, sf), "ntis_link_number", "row_seq",
                                                 FLOW_COLS))


@query("missing_flow_by_type")
def q_missing_flow_by_type(spark, sf):
    a = quality.zero_share_audit(readings_by_link(spark, sf), "ntis_link_number", "row_seq", FLOW_COLS)
    return round_floats(quality.missing_flow_by_type(a))


@query("flow_validation")
def q_flow_validation(spark, sf):
    return round_floats(quality.flow_validation(readings_by_link(spark, sf), "ntis_link_number"))


@query("flow_validation_samples")
def q_flow_validation_samples(spark, sf):
    return round_floats(quality.invalid_samples(readings_by_link(spark, sf), "ntis_link_number", "row_seq"))


@query("load_validation")
def q_load_validation(spark, sf):
    return quality.load_validation(readings_by_link(spark, sf))


@query("geofence_segments")
def q_geofence_segments(spark, sf):
    return round_floats(quality.geofence_flags(readings_by_link(spark, sf), "ntis_link_number", "row_seq"))


@query("geofence_tally")
def q_geofence_tally(spark, sf):
    f = quality.geofence_flags(readings_by_link(spark, sf), "ntis_link_number", "row_seq")
    return round_floats(quality.geofence_tally(f))


@query("geofence_filter")
def q_geofence_filter(spark, sf):
    r = readings_by_link(spark, sf)
    kept = quality.apply_geofence(r, quality.geofence_flags(r, "ntis_link_number", "row_seq"), "ntis_link_number")
    return kept.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("ingest_manifest")
def q_ingest_manifest(spark, sf):
    o = td.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("road"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        (F.col("o_orderstatus") != "P").alias("ok"))
    return quality.ingest_tally(o)


@query("name_parsing")
def q_name_parsing(spark, sf):
    p = td.table(spark, sf, "part")
    folder = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(
        F.concat_ws(" ", F.col("p_type"), F.col("p_partkey").cast("string")))
    header = F.concat(F.lit("  "), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit("-Size "))
    return p.select("p_partkey",
                    tx.snake_case_col(header).alias("snake_name"),
                    tx.trailing_id(folder).alias("section_id"),
                    tx.file_link_id(F.concat(F.col("p_brand"), F.lit("_"), F.col("p_partkey").cast("string"),
                                             F.lit(".csv"))).alias("link_id"),
                    tx.safe_file_name(F.concat(F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit("?*"))).alias("safe_name"))


@query("url_archive_names")
def q_url_archive_names(spark, sf):
    pg = td.table(spark, sf, "pages")
    return pg.select("page_id", tx.archive_name_from_url(F.col("url")).alias("archive_name"),
                     tx.safe_file_name(F.col("url")).alias("safe_name"))


@query("coordinate_parse")
def q_coordinate_parse(spark, sf):
    c = td.table(spark, sf, "customer")
    bal = F.format_string("%.2f", F.col("c_acctbal"))
    nat = F.col("c_nationkey").cast("string")
    txt = (F.when(F.col("c_custkey") % 10 == 0, bal)
           .when(F.col("c_custkey") % 10 == 1, F.concat(F.lit("abc ; "), nat))
           .otherwise(F.concat(bal, F.lit(" ; "), nat)))
    lat, lon = parse_coordinate_pair(txt)
    return round_floats(c.select("c_custkey", lat.alias("lat"), lon.alias("lon")))


@query("segment_labels")
def q_segment_labels(spark, sf):
    r = readings_by_link(spark, sf)
    names = r.select(F.concat_ws(" ", "ntis_link_description", F.col("ntis_link_number").cast("string"))
                     .alias("name")).distinct()
    cn = tx.clean_segment_name(F.col("name"), include_id=True)
    return names.select("name", tx.direction_of(F.col("name")).alias("direction"),
                        tx.direction_code(F.col("name")).alias("direction_code"),
                        tx.junctions_of(F.col("name")).alias("junctions"), cn.alias("clean_name"),
                        tx.segment_label(tx.direction_code(F.col("name")), tx.junctions_of(F.col("name")),
                                         F.col("name")).alias("segment_label"),
                        tx.has_excluded_term(F.col("name")).cast("int").alias("is_excluded"))


@query("direction_counts")
def q_direction_counts(spark, sf):
    return fq.feature_frame(spark, sf).groupBy("direction").agg(F.count(F.lit(1)).alias("n_rows"))


def _split_input(spark, sf):
    return fq.feature_frame(spark, sf).select("segment_id", "datetime", "total_traffic_flow")


@query("split_chronological")
def q_split_chronological(spark, sf):
    return round_floats(splits.chronological_split(_split_input(spark, sf), ["datetime", "segment_id"]).drop("_pos"))


@query("split_kfold")
def q_split_kfold(spark, sf):
    return round_floats(splits.kfold_split(_split_input(spark, sf), ["datetime", "segment_id"]).drop("_pos"))


@query("split_timeseries")
def q_split_timeseries(spark, sf):
    return round_floats(splits.timeseries_split(_split_input(spark, sf), ["datetime", "segment_id"]).drop("_pos"))


@query("match_counts")
def q_match_counts(spark, sf):
    w = base.windows(spark, sf).withColumn(
        "match_type", F.when(is_weekend_day("end_pre_match") == 1, F.lit("weekend")).otherwise(F.lit("weekday")))
    return w.groupBy("match_type").agg(F.count(F.lit(1)).alias("n_matches"))


@query("control_periods")
def q_control_periods(spark, sf):
    w = base.windows(spark, sf).select("fixture", F.col("end_pre_match").alias("kickoff")).withColumn(
        "day_type", F.when(is_weekend_day("kickoff") == 1, F.lit("weekend")).otherwise(F.lit("weekday")))
    h = base.hourly(spark, sf, "user40", base.IMPACT_FULL, ()).withColumn(
        "day_type", F.when(is_weekend_day("datetime") == 1, F.lit("weekend")).otherwise(F.lit("weekday")))
    c = intervals.control_periods(w, h, min_count=3, event_ts="kickoff")
    return c.select("fixture", "kickoff", "day_type", "n_control")


@query("fixture_parse_audit")
def q_fixture_parse_audit(spark, sf):
    return intervals.dropped_fixture_count(td.fixtures(spark, sf))


@query("segment_type_catalogue")
def q_segment_type_catalogue(spark, sf):
    r = readings_by_link(spark, sf)
    quality.require_columns(r, ["carriageway", "ntis_link_description"] + quality.flow_columns(r))
    return quality.segment_type_catalogue(r, "ntis_link_number")


@query("snake_case")
def q_snake_case(spark, sf):
    p = td.table(spark, sf, "part")
    header = F.concat(F.lit("  "), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit("-Size "))
    return p.select("p_partkey", header.alias("header"), tx.snake_case_col(header).alias("snake_name"))


@query("direction")
def q_direction(spark, sf):
    r = readings_by_link(spark, sf)
    return (r.groupBy("ntis_link_description").agg(F.count(F.lit(1)).alias("n_rows"))
             .select("ntis_link_description", tx.direction_of(F.col("ntis_link_description")).alias("direction"),
                     "n_rows"))


@query("flow_validation_named")
def q_flow_validation_named(spark, sf):
    """Audit of the files whose name has none of the excluded terms."""
    d = quality.audited_files(readings_by_link(spark, sf), "ntis_link_description")
    return round_floats(quality.flow_validation(d, "ntis_link_number"))


@query("flow_validation_one_file")
def q_flow_validation_one_file(spark, sf):
    d = quality.audited_files(readings_by_link(spark, sf), "ntis_link_description")
    return round_floats(quality.flow_validation(quality.one_file(d, "ntis_link_number"), "ntis_link_number"))
