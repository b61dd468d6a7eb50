"""Data-quality audits: names and duplicates, missing days, flow
validation, zero-share audit by segment type, geofence and ingest
tallies.  Each audit is one or two grouped aggregates; report rows are
long tables (one row per finding) rather than lists.  The one value that a
group is gathered into is the set of its calendar days (`missing_days`),
bounded by the days of its span."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.geo import STUDY_AREA_POLYGON, segment_in_area
from panelflow.functions.numeric import safe_div
from panelflow.functions.text import EXCLUDED_NAME_TERMS, has_excluded_term, segment_type_of

CLASS_COLS = ["traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3", "traffic_flow_value4"]


def most_common_name(df: DataFrame, id_col: str, name_col: str, order_col: str) -> DataFrame:
    """Most frequent name per id; a tie goes to the name seen first (by
    ``order_col``), then to the smaller name."""
    g = (df.where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull())
           .groupBy(id_col, name_col).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order_col).alias("first_seen")))
    w = Window.partitionBy(id_col).orderBy(F.col("n_rows").desc(), F.col("first_seen"), F.col(name_col))
    return (g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
             .select(id_col, name_col, "n_rows", "first_seen"))


def duplicate_ids(df: DataFrame, id_col: str, file_col: str, id_of_file=None) -> DataFrame:
    """Ids present in more than one file: one row per (id, file) with the
    id's file count (long form instead of a file list per id).

    When the id is a function of the file name (``id_of_file``), files are
    de-duplicated first and the id is computed once per file.  The file
    count per id is a small aggregate (one row per id) joined back; AQE
    broadcasts it when its measured size allows."""
    if id_of_file is not None:
        pairs = df.select(file_col).distinct().withColumn(id_col, id_of_file(F.col(file_col)))
    else:
        pairs = df.select(id_col, file_col).distinct()
    pairs = pairs.where(F.col(id_col).isNotNull())
    n = pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)
    return pairs.join(n, id_col).select(id_col, file_col, "n_files")


def duplicate_summary(df: DataFrame, id_col: str, file_col: str, expected_files: int | None = None) -> DataFrame:
    """One row: files, files without an id, distinct ids, ids in more than
    one file.  Two chains of hash aggregates over the distinct (id, file)
    pairs, both combined before their shuffles: one row per file, and one
    row per id; files without an id never meet in one group."""
    pairs = df.select(id_col, file_col).distinct()
    idc = F.col(id_col)
    files = (pairs.where(F.col(file_col).isNotNull()).groupBy(file_col)
                  .agg(F.max(idc.isNull().cast("int")).alias("_no_id"))
                  .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("_no_id") == 1).alias("n_files_without_id")))
    ids = (pairs.where(idc.isNotNull()).groupBy(id_col).agg(F.count(file_col).alias("_n"))
                .agg(F.count(F.lit(1)).alias("n_unique_ids"), F.count_if(F.col("_n") > 1).alias("n_duplicate_ids")))
    s = files.crossJoin(F.broadcast(ids))       # one row each
    if expected_files is not None:
        s = s.withColumn("matches_expected", (F.col("n_files") == expected_files).cast("int"))
    return s


def missing_days(df: DataFrame, key: str, ts_col: str) -> DataFrame:
    """Calendar days between a key's first and last reading that have no
    reading: expected calendar (sequence per key) minus the present days.
    One row per (key, missing day)."""
    d = df.select(key, F.to_date(ts_col).alias("day")).where(F.col("day").isNotNull())
    # one aggregate per key: its set of present days (bounded by the days
    # of its span, not by its rows), then calendar minus set
    g = d.groupBy(key).agg(F.collect_set("day").alias("_present"), F.min("day").alias("_lo"),
                           F.max("day").alias("_hi"))
    return g.select(key, F.explode(F.array_except(F.sequence("_lo", "_hi"), "_present")).alias("day"))


def day_coverage(df: DataFrame, key: str, ts_col: str) -> DataFrame:
    """Per key: rows, present days, first and last day, missing days."""
    d = df.withColumn("_day", F.to_date(ts_col))
    return d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_day").alias("n_days"),
        F.min("_day").alias("first_day"), F.max("_day").alias("last_day")).withColumn(
        "n_missing_days", (F.datediff("last_day", "first_day") + 1 - F.col("n_days")).cast("long"))


def zero_share_audit(df: DataFrame, key: str, order_col: str, flow_cols,
                     carriageway: str = "carriageway", description: str = "ntis_link_description",
                     threshold: float = 0.5) -> DataFrame:
    """Per key (a segment file): its type from the first row's carriageway
    or description, the zero share of each flow column (missing values
    count as non-zero) and ``has_missing_flow`` = any share >= threshold.

    Raw rows are hash-aggregated by (key, carriageway, description) with
    fixed-width buffers; the first row's text is picked on that small
    output (see ``rollup.hourly_rollup`` for the same pattern)."""
    lvl1 = df.groupBy(key, carriageway, description).agg(
        F.min(order_col).alias("_o"), F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c) == 0).alias(f"_z_{c}") for c in flow_cols])
    g = lvl1.groupBy(key).agg(
        F.min_by(F.struct(F.col(carriageway).alias("_cw"), F.col(description).alias("_desc")), F.col("_o")).alias("_f"),
        *[safe_div(F.sum(f"_z_{c}"), F.sum("_n")).alias(f"{c}_zero_share") for c in flow_cols])
    worst = F.greatest(*[F.col(f"{c}_zero_share") for c in flow_cols]) if len(flow_cols) > 1 \
        else F.col(f"{flow_cols[0]}_zero_share")
    return g.select(key, segment_type_of(F.col("_f._cw"), F.col("_f._desc")).alias("segment_type"),
                    *[f"{c}_zero_share" for c in flow_cols],
                    (worst >= threshold).cast("int").alias("has_missing_flow"))


def verdict(pct, total):
    return (F.when(pct >= 75, F.lit("red")).when(pct >= 25, F.lit("yellow")).otherwise(F.lit("green")))


def missing_flow_by_type(audit: DataFrame, min_total: int = 5) -> DataFrame:
    """Per segment type: total, missing, percent, colour and the
    complete / missing labels (only for types with >= ``min_total``)."""
    g = audit.groupBy("segment_type").agg(F.count(F.lit(1)).alias("total"),
                                          F.sum("has_missing_flow").cast("long").alias("missing_flow"))
    pct = safe_div(F.col("missing_flow"), F.col("total")) * 100
    g = g.withColumn("missing_percent", pct)
    return g.orderBy(F.col("missing_percent").desc(), "segment_type").withColumns({
        "verdict": verdict(F.col("missing_percent"), F.col("total")),
        "is_complete_type": ((F.col("missing_percent") < 25) & (F.col("total") >= min_total)).cast("int"),
        "is_missing_type": ((F.col("missing_percent") >= 75) & (F.col("total") >= min_total)).cast("int"),
    })


def _class_sum(classes):
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in classes])


def audited_files(df: DataFrame, name_col: str, terms=EXCLUDED_NAME_TERMS) -> DataFrame:
    """Rows of files whose name holds none of the ``terms`` (any case)."""
    return df.where(~F.coalesce(has_excluded_term(F.col(name_col), terms), F.lit(False)))


def one_file(df: DataFrame, file_col: str, seed: int = 0) -> DataFrame:
    """Rows of one file picked at random: the least MD5 of "<seed>:<name>", so a
    rerun picks the same.  The pick is one row, from the distinct names."""
    name = F.col(file_col)
    names = df.where(name.isNotNull()).select(name.alias("_pick")).distinct()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_pick").cast("string")))
    pick = names.agg(F.min_by("_pick", F.struct(key, F.col("_pick"))).alias("_pick"))
    return df.join(F.broadcast(pick), name == F.col("_pick")).drop("_pick")


def flow_validation(df: DataFrame, file_col: str, total: str = "total_traffic_flow",
                    classes=CLASS_COLS) -> DataFrame:
    """Per file: rows, zero-total rows, rows where each class exceeds the
    total, rows where |sum of classes - total| > 1, with percentages."""
    t = F.col(total)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(t == 0).alias("zero_flow")]
    aggs += [F.count_if(F.col(c) > t).alias(f"{c}_exceeds") for c in classes]
    aggs += [F.count_if(F.abs(_class_sum(classes) - t) > 1).alias("sum_mismatch")]
    g = df.groupBy(file_col).agg(*aggs)
    pcts = {f"{c}_pct": safe_div(F.col(c), F.col("n_rows")) * 100
            for c in ["zero_flow", *[f"{x}_exceeds" for x in classes], "sum_mismatch"]}
    return g.withColumns(pcts)


def invalid_samples(df: DataFrame, file_col: str, order_col: str, total: str = "total_traffic_flow",
                    classes=CLASS_COLS, n: int = 3) -> DataFrame:
    """First ``n`` rows per file where some class exceeds the total."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > F.col(total), F.lit(False)) for c in classes])
    w = Window.partitionBy(file_col).orderBy(order_col)
    return (df.where(bad).withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)
              .select(file_col, "sample_rank", order_col, total, *classes))


def load_validation(df: DataFrame, total: str = "total_traffic_flow", classes=CLASS_COLS) -> DataFrame:
    """One row: NULLs per column, zero totals, sum mismatches, class >
    total per class (a single pass)."""
    t = F.col(total)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in [*classes, total]]
    aggs += [F.count_if(t == 0).alias("zero_total"),
             F.count_if(F.abs(_class_sum(classes) - t) > 1).alias("sum_mismatch")]
    aggs += [F.count_if(F.col(c) > t).alias(f"{c}_exceeds") for c in classes]
    return df.agg(*aggs)


def first_row(df: DataFrame, key: str, order_col: str, cols) -> DataFrame:
    """Attributes of each key's first row (by ``order_col``).  String
    columns are grouping keys of a hash-aggregated first level (numeric
    ones take ``min_by`` with fixed-width buffers); the first row is then
    picked on that small output."""
    types = dict(df.dtypes)
    strs = [c for c in cols if types[c] == "string"]
    nums = [c for c in cols if c not in strs]
    o = F.col(order_col)
    lvl1 = df.groupBy(key, *strs).agg(F.min(o).alias("_o"), *[F.min_by(c, o).alias(c) for c in nums])
    g = lvl1.groupBy(key).agg(F.min_by(F.struct(*cols), F.col("_o")).alias("_f"))
    return g.select(key, "_f.*")


GEO_COLS = ["start_latitude", "start_longitude", "end_latitude", "end_longitude"]


def geofence_flags(df: DataFrame, key: str, order_col: str, group_col: str = "road",
                   polygon=STUDY_AREA_POLYGON) -> DataFrame:
    """Keep / discard per key from its first row's coordinates (start or
    end point inside the polygon)."""
    f = first_row(df, key, order_col, [group_col, *GEO_COLS])
    return f.withColumn("is_kept", segment_in_area(*[F.col(c) for c in GEO_COLS], polygon=polygon).cast("int"))


def apply_geofence(df: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Rows of kept keys (left semi join on the small per-key table)."""
    return df.join(flags.where(F.col("is_kept") == 1).select(key), key, "left_semi")


def geofence_tally(flags: DataFrame, group_col: str = "road") -> DataFrame:
    """Kept / discarded per group and in total (rollup)."""
    g = flags.rollup(group_col).agg(F.count_if(F.col("is_kept") == 1).alias("kept"),
                                     F.count_if(F.col("is_kept") == 0).alias("discarded"),
                                     F.count(F.lit(1)).alias("total"))
    return g.withColumn("pct_discarded", safe_div(F.col("discarded"), F.col("total")) * 100)


def ingest_tally(manifest: DataFrame, group_col: str = "road", month_col: str = "month",
                 ok_col: str = "ok") -> DataFrame:
    """Success / failure counts by group and month, per group and overall
    (rollup), with the sorted months that had a failure."""
    ok = F.col(ok_col)
    return manifest.rollup(group_col, month_col).agg(
        F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col(month_col)))), ",").alias("failed_months"))


def flow_columns(df: DataFrame, pattern: str = "traffic_flow") -> list[str]:
    """Columns whose name contains ``pattern`` (schema-level selection)."""
    return [c for c in df.columns if pattern in c.lower()]


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Raise when any required column is missing; return ``df`` otherwise."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def segment_type_catalogue(df: DataFrame, key: str, carriageway: str = "carriageway",
                           description: str = "ntis_link_description") -> DataFrame:
    """Every segment type name that can occur, with the number of keys
    showing it: non-blank carriageway values, the types read from
    descriptions (named as the type rule names them) and ``unknown``
    (set union of the three sources), in one pass over the rows."""
    from panelflow.functions.text import DESCRIPTION_TYPES
    cw = F.nullif(F.trim(F.col(carriageway)), F.lit(""))
    d = F.lower(F.coalesce(F.col(description), F.lit("")))
    items = [F.when(cw.isNotNull(), F.struct(cw.alias("segment_type"), F.lit("carriageway").alias("source")))]
    items += [F.when(d.contains(w), F.struct(F.lit(label).alias("segment_type"), F.lit("description").alias("source")))
              for w, label in DESCRIPTION_TYPES]
    rows = df.select(key, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("_t"))
    g = rows.groupBy(F.col("_t.segment_type").alias("segment_type")).agg(
        F.array_join(F.array_sort(F.collect_set("_t.source")), ",").alias("sources"),
        F.count_distinct(key).alias("n_keys"))
    unknown = df.sparkSession.range(1).select(F.lit("unknown").alias("segment_type"), F.lit("default").alias("sources"),
                                              F.lit(0).cast("long").alias("n_keys"))
    both = g.unionByName(unknown)
    return both.groupBy("segment_type").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", ","))))), ",")
        .alias("sources"), F.sum("n_keys").alias("n_keys"))
