"""Raw sensor CSV files: scan, section discovery and cleaning.

Files are read in one scan per distinct header (a glob), never file by
file; the file a row came from is a column (``_metadata.file_path``), and
columns are bound by name, whatever their order in a file.  Cleaning is a chain
of column expressions: snake_case headers, quarter-hour rounding of the
time text, date + time -> timestamp, "lat ; lon" parsing, numeric
coercion (bad text -> NULL) and the drop list.
"""

from __future__ import annotations

import csv
import re
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelflow.functions.geo import parse_coordinate_pair
from panelflow.functions.text import snake_case, trailing_id
from panelflow.functions.timecols import combine_date_time, round_time_text_to_15min
from panelflow.sources import local_tree

# ---------------------------------------------------------------------------
# Columns dropped after cleaning, and the numeric columns.
# ---------------------------------------------------------------------------
DROP_COLUMNS = ["ntis_model_version", "flow_quality", "profile_travel_time", "profile_traffic_flow",
                "quality_index"]
NUMERIC_COLUMNS = ["day_type_id", "ntis_link_number", "link_length", "fused_travel_time", "fused_average_speed",
                   "total_traffic_flow", "traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3",
                   "traffic_flow_value4"]
# ---------------------------------------------------------------------------


def _first_lines(spark: SparkSession, paths) -> DataFrame:
    """Non-blank lines with their file and, in a file's first block, their order."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"),
                                          F.col("_metadata.file_block_start").alias("start"))
    return lines.where(F.length(F.trim("value")) > 0).withColumn(
        "at", F.when(F.col("start") == 0, F.monotonically_increasing_id()))


def header_index(spark: SparkSession, paths) -> DataFrame:
    """(file, header_id, n_rows) of every CSV file that has a line: the hash of
    its first line and the number of lines after it.  One pass over the text
    with a hash aggregate of fixed width; no line is shuffled."""
    return _first_lines(spark, paths).groupBy("file").agg(
        F.min_by(F.xxhash64("value"), "at").alias("header_id"), (F.count(F.lit(1)) - 1).alias("n_rows"))


def _path(file: str) -> str:
    """A ``_metadata.file_path`` as a path to read: unescaped, glob characters quoted."""
    return _quoted(unquote(file))


def _quoted(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _quoted_all(local: list[str]) -> list[str]:
    return ["file:" + _quoted(p) for p in local]


def header_names(line: str) -> list[str]:
    """Column names of a header line: a byte order mark and outer blanks
    removed, repeated and empty names told apart by their position."""
    names, out = [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]))], []
    for i, c in enumerate(names):
        out.append(c if c and c.lower() not in {x.lower() for x in out} else f"{c}_c{i}")
    return out


def headers(spark: SparkSession, paths) -> list[tuple[list[str], str, int, int, int]]:
    """(names, first file, files, rows, id) per distinct header: one row per
    header reaches the driver; of each header one file's first line is read."""
    found = _local_headers(spark, local_tree.tree_of(spark, paths))
    if found is None:
        return _spark_headers(spark, paths)
    rows: dict[int, tuple] = {}
    for names, file, n_files, n_rows, i in (*[r[:5] for r in found[0]], *(_spark_headers(spark, _quoted_all(found[1])) if found[1] else [])):
        _, other, m_files, m_rows, _ = rows.get(i, (names, file, 0, 0, i))
        rows[i] = names, min(file, other), n_files + m_files, n_rows + m_rows, i
    return sorted(rows.values())


def _local_headers(spark: SparkSession, tree) -> tuple[list[tuple], list[str]] | None:
    """(names, first file, files, rows, id, line) per distinct header of the
    small files of a local tree, and the paths of its large ones; None where
    Spark's reader has to look."""
    if tree is None:
        return None
    large = F.when(F.col("kind") != "small", F.col("path"))
    found = local_tree.survey(spark, tree).groupBy("kind", "header", large.alias("large")).agg(
        F.min("file").alias("file"), F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"),
        F.min(F.xxhash64(F.col("header").cast("string"))).alias("id")).collect()
    if any(r["kind"] == "other" for r in found) or not found and tree.empty():
        return None
    small = [(header_names(bytes(r["header"]).decode("utf-8", "replace")), r["file"], r["n_files"], r["n_rows"], r["id"], bytes(r["header"]))
             for r in found if r["kind"] == "small"]
    return sorted(small), sorted(r["large"] for r in found if r["kind"] == "large")


def _spark_headers(spark: SparkSession, paths) -> list[tuple[list[str], str, int, int, int]]:
    found = header_index(spark, paths).groupBy("header_id").agg(
        F.min("file").alias("file"), F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows")).collect()
    if not found:
        return []
    one = [_path(r["file"]) for r in found]
    lines = {r["file"]: r["line"] for r in _first_lines(spark, one).groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()}
    return sorted((header_names(lines[r["file"]]), r["file"], r["n_files"], r["n_rows"], r["header_id"]) for r in found)


def _files_by_header(spark: SparkSession, paths) -> dict[int, list[str]]:
    """Sorted files of each header id.  The driver holds one path per file, as
    Spark's own file listing does."""
    files: dict[int, list[str]] = {}
    for r in header_index(spark, paths).collect():
        files.setdefault(r["header_id"], []).append(r["file"])
    return {k: sorted(v) for k, v in files.items()}


@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Spark lists many paths by up to 10,000 tasks, one per path; a few per
    core list as many in a tenth of the time."""
    name, want = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(name, None)
    spark.conf.set(name, min(want, int(before or want)))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def header_report(spark: SparkSession, paths) -> DataFrame:
    """Per distinct header: its names, files, rows and the names that only
    other headers have."""
    found = headers(spark, paths)
    every = sorted({c.lower(): c for names, *_ in found for c in names}.values(), key=str.lower)
    rows = [(names, files, n, [c for c in every if c.lower() not in {x.lower() for x in names}]) for names, _, files, n, _ in found]
    return spark.createDataFrame(rows, "header array<string>, n_files long, n_rows long, missing array<string>")


def read_raw_csv(spark: SparkSession, paths, header: bool = True, same_header: bool = False) -> DataFrame:
    """All-string scan of raw CSV files with the source file as a column.
    Rows whose cells are all blank, and header lines repeated as data, are
    dropped.

    Files may differ in the order and choice of their columns: each distinct
    header gets one scan of its files, and the scans are aligned by name
    (a column that a file lacks is NULL).  ``same_header`` saves the pass that
    looks at the first lines, for files known to agree.  Where that pass finds
    one header, the same ``paths`` are scanned, not a list of all files.  Files
    of a local tree that are too small to be split are listed and read by the
    tasks (`local_tree`)."""
    with _few_listing_tasks(spark):
        return _read_raw_csv(spark, paths, header, same_header)


def _read_raw_csv(spark: SparkSession, paths, header: bool, same_header: bool) -> DataFrame:
    if not header or same_header:
        return _scan(spark.read.option("header", header).option("mode", "PERMISSIVE").csv(paths))
    tree = local_tree.tree_of(spark, paths)
    local = _local_headers(spark, tree)
    if local is None:
        scans = _spark_scans(spark, paths)
    else:
        small, large = local
        scans = [(names, file, local_tree.parse(local_tree.lines_of(spark, tree, line, large), names, lambda c, names=names: ~_left_out(c, names)))
                 for names, file, _, _, _, line in small]
        scans = sorted(scans + (_spark_scans(spark, _quoted_all(large)) if large else []), key=lambda s: s[:2])
    if not scans:
        return spark.createDataFrame([], "source_file string")
    return union_files([s[2] for s in scans])


def _spark_scans(spark: SparkSession, paths) -> list[tuple[list[str], str, DataFrame]]:
    """(names, first file, rows) per distinct header, by Spark's CSV source."""
    found, scans = _spark_headers(spark, paths), []
    files = _files_by_header(spark, paths) if len(found) > 1 else {}
    for names, first, _, _, header_id in found:
        schema = StructType([StructField(c, StringType()) for c in names])
        own = [_path(f) for f in files[header_id]] if files else paths
        scans.append((names, first, _scan(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(own))))
    return scans


def _scan(df: DataFrame) -> DataFrame:
    cols = df.columns
    df = df.select("*", F.col("_metadata.file_path").alias("source_file"))
    return df.where(~_left_out([F.col(f"`{c}`") for c in cols], cols))


def _left_out(cells, names):
    """Whether all cells are blank, or all are the names of their columns."""
    blank = reduce(lambda a, b: a & b, [F.trim(F.coalesce(c, F.lit(""))) == "" for c in cells])
    repeated = reduce(lambda a, b: a & b, [F.coalesce(c == n, F.lit(False)) for c, n in zip(cells, names)])
    return blank | repeated


def with_sections(df: DataFrame, path_col: str = "source_file") -> DataFrame:
    """Section folder (parent directory of the file, a ``key=`` prefix and
    URL escapes removed), month folder (the one above it), the section id
    (trailing digits of the folder name) and the file name."""
    parts = F.split(F.col(path_col), "/")
    folder = F.url_decode(F.regexp_replace(F.element_at(parts, -2), r"^[^=/]*=", ""))
    month = F.url_decode(F.regexp_replace(F.element_at(parts, -3), r"^[^=/]*=", ""))
    return df.withColumns({"section_folder": folder, "month_folder": month,
                           "segment_id": trailing_id(folder), "file_name": F.element_at(parts, -1)})


def clean_raw(df: DataFrame, fill_zero: bool = False, carry_day: bool = False,
              keep_raw_time: bool = False) -> DataFrame:
    """Raw scan -> cleaned 15-minute readings.

    ``fill_zero=True`` reproduces the source's final fill of every missing
    value with 0 (missing coordinates become (0, 0), missing flow a true
    0); the default keeps NULLs.  ``carry_day`` moves a 24:00 rounding to
    the next day instead of the same date.
    """
    d = df.toDF(*[snake_case(c) for c in df.columns])
    if "local_date" not in d.columns or "local_time" not in d.columns:
        raise ValueError("required columns local_date / local_time not found")
    t = round_time_text_to_15min(F.col("local_time"))
    d = d.withColumn("datetime", combine_date_time(F.col("local_date"), t))
    if keep_raw_time:
        d = d.withColumn("raw_datetime", combine_date_time(F.col("local_date"), F.col("local_time")))
    if carry_day:
        raw_dt = combine_date_time(F.col("local_date"), F.col("local_time"))
        wrapped = (F.col("datetime") < raw_dt) & (F.hour(raw_dt) == 23)
        d = d.withColumn("datetime", F.when(wrapped, F.timestamp_add("DAY", F.lit(1), "datetime"))
                         .otherwise(F.col("datetime")))
    for side in ("start", "end"):
        c = f"{side}_node_coordinates"
        if c in d.columns:
            lat, lon = parse_coordinate_pair(F.col(c))
            d = d.withColumns({f"{side}_latitude": lat, f"{side}_longitude": lon}).drop(c)
    d = d.drop("local_date", "local_time", *DROP_COLUMNS)
    d = d.withColumns({c: finite(F.col(c).try_cast("double")) for c in NUMERIC_COLUMNS if c in d.columns})
    if "ntis_link_number" in d.columns:
        d = d.withColumn("ntis_link_number", F.col("ntis_link_number").cast("long"))
    d = d.select("datetime", *[c for c in d.columns if c != "datetime"])
    if fill_zero:
        d = d.na.fill(0).na.fill("0")
    return d


def finite(x):
    """NaN and the infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def typed_scan(df: DataFrame, ts_col: str = "datetime", date_col: str = "date", time_col: str = "time") -> DataFrame:
    """``datetime`` as timestamp_ntz; when absent, built from date + time."""
    if ts_col in df.columns:
        return df.withColumn(ts_col, F.col(ts_col).try_cast("timestamp_ntz"))
    return df.withColumn(ts_col, combine_date_time(F.col(date_col), F.col(time_col)))


def union_files(frames) -> DataFrame:
    """Concatenate frames aligned by column name (missing -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
