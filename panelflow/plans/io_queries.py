"""Registered queries that go through files: raw CSV written by Spark
from the test tables into the shared staging folder, scanned back and
cleaned (the whole ingest chain), plus the archive and sink paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.functions import text as tx
from panelflow.operators import quality, rollup
from panelflow.plans.registry import query, round_floats
from panelflow.sources import archive, raw, sinks
from panelflow.sources import testdata as td

def raw_headers():
    """Raw header names and how each is made from a reading."""
    return [
        ("Local Date", F.date_format("raw_ts", "yyyy-MM-dd")),
        ("Local Time", F.date_format("raw_ts", "HH:mm:ss")),
        ("Day Type ID", F.col("day_type_id").cast("string")),
        ("Road", F.col("road")),
        ("Carriageway", F.col("carriageway")),
        ("NTIS Link Number", F.col("ntis_link_number").cast("string")),
        ("NTIS Link Description", F.col("ntis_link_description")),
        ("Link Length", F.col("link_length").cast("string")),
        ("Fused Travel Time", F.col("fused_travel_time").cast("string")),
        ("Fused Average Speed", F.col("fused_average_speed").cast("string")),
        ("Total Traffic Flow", F.col("total_traffic_flow").cast("string")),
        ("Traffic Flow Value1", F.col("traffic_flow_value1").cast("string")),
        ("Traffic Flow Value2", F.col("traffic_flow_value2").cast("string")),
        ("Traffic Flow Value3", F.col("traffic_flow_value3").cast("string")),
        ("Traffic Flow Value4", F.col("traffic_flow_value4").cast("string")),
        ("Start Node Coordinates", F.concat_ws(" ; ", F.col("start_latitude").cast("string"),
                                               F.col("start_longitude").cast("string"))),
        ("End Node Coordinates", F.concat_ws(" ; ", F.col("end_latitude").cast("string"),
                                             F.col("end_longitude").cast("string"))),
        ("Quality Index", F.lit("1")),
    ]


def raw_files(spark, sf) -> str:
    """Write the raw-format CSV tree (month / "<description> <id>" folders)."""
    r = td.readings(spark, sf, "event_type")
    out = r.select(*[c.alias(n) for n, c in raw_headers()],
                   F.date_format("raw_ts", "yyyy-MM").alias("month"),
                   F.concat_ws(" ", "ntis_link_description", F.col("ntis_link_number").cast("string")).alias("section"))
    path = sinks.staging_path(spark, "raw-readings")
    sinks.write_partitioned(out, path, by=("month", "section"), fmt="csv", sort_within=("Local Date", "Local Time"))
    return path


@query("raw_ingest_roundtrip")
def q_raw_ingest_roundtrip(spark, sf):
    path = raw_files(spark, sf)
    scanned = raw.with_sections(raw.read_raw_csv(spark, f"{path}/*/*/*.csv"))
    clean = raw.clean_raw(scanned.drop("source_file", "section_folder", "month_folder", "file_name"),
                          keep_raw_time=True)
    clean = clean.withColumn("segment_id", F.col("segment_id").cast("string"))
    h = rollup.hourly_rollup(clean, first_cols=td.FIRST_COLS, order_col="raw_datetime", full_count=4)
    return round_floats(h)


@query("section_report")
def q_section_report(spark, sf):
    """Rows and missing calendar days per section of the raw tree."""
    path = raw_files(spark, sf)
    scanned = raw.with_sections(raw.read_raw_csv(spark, f"{path}/*/*/*.csv"))
    clean = raw.clean_raw(scanned.drop("source_file", "section_folder", "month_folder", "file_name"))
    return quality.day_coverage(clean, "segment_id", "datetime").withColumns(
        {"first_day": F.date_format("first_day", "yyyy-MM-dd"), "last_day": F.date_format("last_day", "yyyy-MM-dd")})


@query("direction_sink_roundtrip")
def q_direction_sink_roundtrip(spark, sf):
    """Readings written by road and direction, other directions left out,
    read back as one table."""
    r = td.readings(spark, sf, "event_type").withColumn("direction", tx.direction_of(F.col("ntis_link_description")))
    path = sinks.staging_path(spark, "by-direction")
    sinks.write_by_direction(r.select("row_seq", "road", "direction", "total_traffic_flow"), path)
    return round_floats(spark.read.parquet(path).groupBy("road", "direction").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("total_traffic_flow").alias("total_flow")))


@query("sorted_sink")
def q_sorted_sink(spark, sf):
    """Readings written by segment in time order in files of about a megabyte,
    read back by file and row number: rows out of order, files whose ranges
    overlap, and whether there are at most keys + bytes / target files."""
    r = td.readings(spark, sf, "event_type").select("segment_id", "datetime", "row_seq", "total_traffic_flow", "carriageway")
    target = 1 << 20
    path = sinks.write_partitioned(r, sinks.staging_path(spark, "sorted"), by=("segment_id",), sort_within=("datetime", "row_seq"),
                                   target_bytes=target)
    found = sinks.file_order(spark, path, "datetime", ["segment_id"])
    bound = sinks.ranges_for(r, target)
    most = found.agg((F.sum("n_files") <= F.count(F.lit(1)) + bound).alias("files_in_bound"))
    return found.drop("n_files").crossJoin(F.broadcast(most))


@query("quarantine_restore")
def q_quarantine_restore(spark, sf):
    """Rows of segments outside the study area put apart, then restored:
    rows and links per verdict, and of all (-1)."""
    r = td.readings(spark, sf, "event_type").select("ntis_link_number", "row_seq", "road", "total_traffic_flow",
                                                    *quality.GEO_COLS)
    flags = quality.geofence_flags(r, "ntis_link_number", "row_seq")
    path = sinks.quarantine(r.drop(*quality.GEO_COLS), flags, "ntis_link_number", sinks.staging_path(spark, "quarantine"))
    return round_floats(sinks.restore(spark, path).rollup("is_kept").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ntis_link_number").alias("n_links"),
        F.sum("total_traffic_flow").alias("total_flow")).withColumn("is_kept", F.coalesce("is_kept", F.lit(-1))))


@query("filtered_copy")
def q_filtered_copy(spark, sf):
    """All readings and those of a main carriageway, each written and counted
    again from the files."""
    r = td.readings(spark, sf, "event_type").select("row_seq", "carriageway", "total_traffic_flow")
    path = sinks.staging_path(spark, "filtered-copy")
    counted = sinks.filtered_copy(r, "carriageway", "mainCarriageway", path)
    sub = spark.read.parquet(path).where(F.col("copy") == "mainCarriageway").agg(F.count(F.lit(1)).alias("n_in_copy"),
                                                            F.sum("total_traffic_flow").alias("flow_in_copy"))
    return round_floats(counted.crossJoin(F.broadcast(sub)))


@query("json_report")
def q_json_report(spark, sf):
    """The metrics document, written as JSON and read back."""
    r = td.readings(spark, sf, "event_type").groupBy("segment_id").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg("total_traffic_flow").alias("mean"),
                 F.min("total_traffic_flow").alias("min"), F.max("total_traffic_flow").alias("max")).alias("flow"))
    path = sinks.write_json_report(r, sinks.staging_path(spark, "report"))
    return round_floats(spark.read.schema(r.schema).json(path).select("segment_id", "flow.*"))


@query("union_typed_files")
def q_union_typed_files(spark, sf):
    """Two CSV sets with different column order, one of them with date and
    time apart, aligned by name and typed."""
    r = td.readings(spark, sf, "event_type")
    a = r.where(F.col("row_seq") % 2 == 0).select("segment_id", "row_seq", "datetime", "total_traffic_flow")
    b = r.where(F.col("row_seq") % 2 == 1).select(
        "total_traffic_flow", F.date_format("datetime", "yyyy-MM-dd").alias("date"),
        F.date_format("datetime", "HH:mm:ss").alias("time"), "row_seq", "segment_id")
    frames = []
    for name, d in (("a", a), ("b", b)):
        path = sinks.write_partitioned(d, sinks.staging_path(spark, f"union-{name}"), fmt="csv")
        frames.append(raw.typed_scan(spark.read.option("header", True).csv(path)).select(
            "segment_id", F.col("row_seq").cast("long"), "datetime", F.col("total_traffic_flow").cast("double")))
    return round_floats(raw.union_files(frames))


def three_headers(spark, sf) -> str:
    """Readings as raw CSV files of three kinds: columns in another order, one
    column missing, one column more."""
    r = td.readings(spark, sf, "event_type").withColumn("flow", F.col("total_traffic_flow"))
    path = sinks.staging_path(spark, "headers")
    for i, names in enumerate((["segment_id", "row_seq", "flow", "carriageway"], ["flow", "segment_id", "row_seq"],
                               ["carriageway", "row_seq", "road", "segment_id", "flow"])):
        part = r.where(F.col("row_seq") % 3 == i).select(*[F.col(c).alias(c.replace("_", " ").title()) for c in names])
        sinks.write_partitioned(part, f"{path}/kind {i} [csv]", fmt="csv")
    return path


@query("header_aware_scan")
def q_header_aware_scan(spark, sf):
    rows = raw.read_raw_csv(spark, f"{three_headers(spark, sf)}/*/*.csv")
    return round_floats(rows.select(F.col("Segment Id").alias("segment_id"), F.col("Row Seq").cast("long").alias("row_seq"),
                                    F.col("Flow").cast("double").alias("flow"), F.col("Road").alias("road"),
                                    F.nullif(F.trim("Carriageway"), F.lit("")).alias("carriageway")))


@query("header_report")
def q_header_report(spark, sf):
    found = raw.header_report(spark, f"{three_headers(spark, sf)}/*/*.csv")
    return found.select(F.concat_ws(",", "header").alias("header"), (F.col("n_files") > 0).alias("has_files"), "n_rows",
                        F.concat_ws(",", "missing").alias("missing"))


@query("zone_drop")
def q_zone_drop(spark, sf):
    """Times written with a zone, as text, keep their wall clock."""
    zones = F.element_at(F.array(*[F.lit(z) for z in ("Z", "+01:00", "-07:30")]), (F.col("row_seq") % 3 + 1).cast("int"))
    r = td.readings(spark, sf, "event_type").select("row_seq", F.concat(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss"), zones).alias("datetime"))
    path = sinks.write_partitioned(r, sinks.staging_path(spark, "zones"), fmt="csv")
    back = raw.typed_scan(spark.read.option("header", True).csv(path))
    return back.select(F.col("row_seq").cast("long").alias("row_seq"), "datetime")


@query("raw_fill_zero")
def q_raw_fill_zero(spark, sf):
    """The cleaning's final fill of missing values with 0."""
    scanned = raw.with_sections(raw.read_raw_csv(spark, f"{raw_files(spark, sf)}/*/*/*.csv"))
    clean = raw.clean_raw(scanned.drop("source_file", "section_folder", "month_folder", "file_name"), fill_zero=True)
    return round_floats(clean.groupBy(F.col("segment_id").cast("string").alias("segment_id")).agg(
        F.count("fused_average_speed").alias("n_speeds"), F.count_if(F.col("fused_average_speed") == 0).alias("n_zero_speeds"),
        F.avg("fused_average_speed").alias("mean_speed"), F.count_if(F.col("carriageway") == "0").alias("n_zero_carriageways")))


@query("archive_ingest")
def q_archive_ingest(spark, sf):
    """Readings packed into zip archives with a CSV member per segment, the
    archives stored, read back and bound to their columns by name."""
    cols = ["row_seq", "total_traffic_flow", "carriageway"]
    packed = archive.pack_archives(td.readings(spark, sf, "event_type").select("segment_id", *cols), "segment_id")
    path = sinks.write_partitioned(packed, sinks.staging_path(spark, "archives"))
    rows = archive.archive_rows(spark.read.parquet(path))
    return round_floats(archive.rows_to_columns(rows, cols[::-1]).select(
        F.regexp_replace("member", r"\.csv$", "").alias("segment_id"), F.col("row_seq").cast("long"),
        F.col("total_traffic_flow").cast("double"), F.nullif("carriageway", F.lit("")).alias("carriageway")))
