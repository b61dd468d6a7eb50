"""Sinks: partitioned Parquet / CSV / JSON outputs, quarantine with
restore, and the filtered copy.

Outputs are partition directories, one per key value.  A sorted sink deals
rows by range over (key, order): a file holds a run of one key's rows in
order, a large key spans several files whose ranges do not overlap, and the
number of files is at most the keys plus the bytes over the file size or, if more,
the keys over `KEYS_A_RANGE`.
Tallies (rows per copy, per direction) are observed while writing, so the
input is read once.  A quarantine is complete when its manifest is there,
which is written last.  A sink never writes to a path its input reads from.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from panelflow.functions.text import ALL_DIRECTIONS
from panelflow.session import ensure_checkpoint_dir
from panelflow.sources import local_tree

TARGET_BYTES = 128 << 20
KEYS_A_RANGE = 128


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staging_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/staging"


def _norm(p: str) -> str:
    """Path without scheme and with single slashes (file:///a == file:/a == /a)."""
    p = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", p)
    return re.sub(r"/+", "/", p).rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _guard(df: DataFrame, path: str) -> None:
    """Refuse to overwrite an input of ``df``; a frame that does not say which
    files it reads (a checkpoint, an RDD) may not overwrite anything."""
    inputs = df.inputFiles()
    target = _norm(path)
    if any(_norm(f) == target or _norm(f).startswith(target + "/") for f in inputs) or local_tree.reads(df, target):
        raise ValueError(f"refusing to overwrite {path}: it is an input of this plan")
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.length())}
    if "LogicalRDD" in kinds and not path.startswith(staging_root(df.sparkSession)) and _exists(df.sparkSession, path):
        raise ValueError(f"refusing to overwrite {path}: this plan does not list its inputs")


# -- sorted, size-bounded files ---------------------------------------------------

NO_VALUE = local_tree.MISSING


def text_bytes(df: DataFrame) -> Column:
    """Bytes of a row as text, one separator per column."""
    def size(f) -> Column:
        c = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, (ArrayType, MapType, StructType))
        return F.coalesce(F.octet_length(c.cast("string") if plain else F.to_json(F.struct(c))), F.lit(0)) + 1
    return reduce(lambda a, b: a + b, [size(f) for f in df.schema.fields], F.lit(0).cast("long"))


def ranges_for(df: DataFrame, target_bytes: int, by=(), keys_a_range: int | None = None) -> int:
    """Number of ranges of about ``target_bytes`` of text, or of about
    ``keys_a_range`` (`KEYS_A_RANGE`) folders of the keys ``by`` where that gives more: to open
    a file costs as much as to write many rows."""
    keys = F.approx_count_distinct(F.struct(*by)) if by else F.lit(0)
    n = df.agg(F.sum(text_bytes(df)).alias("bytes"), keys.alias("keys")).first()
    return max(1, int((n["bytes"] or 0) // target_bytes), n["keys"] // (keys_a_range or KEYS_A_RANGE))


def sorted_ranges(df: DataFrame, by, sort_within, target_bytes: int, keys_a_range: int | None = None) -> DataFrame:
    """Rows dealt and sorted by (``*by``, ``*sort_within``).

    Text keys are made non-null under the folder name of a missing key (an
    empty text is one, for the writer): otherwise the writer would convert
    them itself and then sort again, by the key alone."""
    texts = {c for c, t in df.dtypes if t == "string"} & set(by)
    d = df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NO_VALUE)) for c in texts}) if texts else df
    order = [F.col(c) for c in (*by, *sort_within)]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, t in d.dtypes if not t.startswith("map")])     # parts rows of equal order
    return d.repartitionByRange(ranges_for(df, target_bytes, by, keys_a_range), *order, spread).sortWithinPartitions(*order)


def write_partitioned(df: DataFrame, path: str, by=(), fmt: str = "parquet", mode: str = "overwrite",
                      sort_within=(), header: bool = True, target_bytes: int = TARGET_BYTES) -> str:
    """One directory per key combination.  With ``sort_within`` the files of a
    directory are in that order, each and one after the other, and at most
    keys + the greater of bytes / ``target_bytes`` and keys / ``KEYS_A_RANGE``
    of them are written in all (bytes of text; Parquet files come out smaller).  Without it every task writes its own
    files, in no order.  Sorted CSV folders on a local file system are made by the tasks themselves (`local_tree`)."""
    _guard(df, path)
    local = local_tree.local_path(df.sparkSession, path) if fmt == "csv" and mode == "overwrite" and by and sort_within else None
    if local and local_tree.writable(df, by):
        local_tree.write_sorted(sorted_ranges(df, by, sort_within, target_bytes, local_tree.KEYS_A_RANGE), local, by, header)
        return path
    out = sorted_ranges(df, by, sort_within, target_bytes) if sort_within else df
    _write(out, path, by, fmt, mode, header)
    return path


def _write(out: DataFrame, path: str, by=(), fmt: str = "parquet", mode: str = "overwrite", header: bool = True) -> None:
    w = out.write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def file_order(spark: SparkSession, path: str, order_col: str, by=()) -> DataFrame:
    """Per key of a Parquet sink: rows, files, rows that precede the row before
    them in their file, files that begin before the previous one ended.  The
    windows run over one file, and over a key's files."""
    rows = spark.read.parquet(path).select(*by, order_col, F.col("_metadata.file_path").alias("_file"),
                                           F.col("_metadata.row_index").alias("_row"))
    before = F.lag(order_col).over(Window.partitionBy("_file").orderBy("_row"))
    files = rows.withColumn("_back", (F.col(order_col) < before).cast("int")).groupBy(*by, "_file").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_back").alias("_back"), F.min(order_col).alias("_lo"), F.max(order_col).alias("_hi"))
    ended = F.lag("_hi").over(Window.partitionBy(*by).orderBy("_file"))
    return files.withColumn("_over", (F.col("_lo") < ended).cast("int")).groupBy(*by).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("_back"), F.lit(0)).alias("n_unsorted"),
        F.coalesce(F.sum("_over"), F.lit(0)).alias("n_overlapping"))


def write_by_direction(df: DataFrame, path: str, road_col: str = "road", direction_col: str = "direction",
                       skip=("other", "unknown")) -> DataFrame:
    """Partition by road and direction, leaving out ``skip`` directions.
    Returns rows per saved direction, counted by the write itself.

    Spark rebalances rows by key at run time: small partitions are joined,
    large ones split, so a key has few files and none is gathered in one task."""
    _guard(df, path)
    spark, found = df.sparkSession, Observation()
    kept = df.where(~F.col(direction_col).isin(*skip)).hint("rebalance", F.col(road_col), F.col(direction_col))
    known = [d for d in ALL_DIRECTIONS if d not in skip]
    rest = ~F.coalesce(F.col(direction_col).isin(*known), F.lit(False))
    seen = kept.observe(found, F.count_if(rest).alias("rest"), *[F.count_if(F.col(direction_col) == d).alias(d) for d in known])
    _write(seen, path, (road_col, direction_col))
    n = found.get
    if n["rest"]:       # directions of the caller's own: from the files just written, whose footers have the counts
        return spark.read.parquet(path).groupBy(direction_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return spark.createDataFrame([(d, n[d]) for d in known if n[d]], f"{direction_col} string, n_rows long")


def write_json_report(df: DataFrame, path: str) -> str:
    """Small report tables (metrics, stats, parameters) as JSON lines."""
    _guard(df, path)
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


# -- quarantine ---------------------------------------------------------------------

class IncompleteQuarantine(ValueError):
    """The rows and the manifest of a quarantine do not belong together."""


def quarantine(df: DataFrame, flags: DataFrame, key: str, path: str) -> str:
    """Rows routed by ``is_kept`` into two partitions (kept / rejected);
    nothing is deleted.  A manifest of the files (rows and an order-free digest
    of each) follows last, and `restore` asks for it."""
    routed = df.join(flags.select(key, "is_kept"), key, "left").withColumn(
        "is_kept", F.coalesce("is_kept", F.lit(1)))
    write_partitioned(routed, path, by=("is_kept",))        # an overwrite removes an earlier manifest first
    write_manifest(df.sparkSession, path)
    return path


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, digest) of the data files below ``path``."""
    rows = spark.read.parquet(path)
    plain = [F.col(f"`{c}`") for c, t in rows.dtypes if not t.startswith("map")]
    name = F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1)
    return rows.groupBy(name.alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_manifest(spark: SparkSession, path: str) -> None:
    _contents(spark, path).coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Both partitions of a quarantine as one table; one that was broken off,
    or whose files have changed since, is refused."""
    if not _exists(spark, f"{path}/_manifest/_SUCCESS"):
        raise IncompleteQuarantine(f"{path} has no manifest: its write was broken off")
    listed = spark.read.schema("file string, n_rows long, digest string").json(f"{path}/_manifest/*.json")
    there = _contents(spark, path).withColumnsRenamed({"n_rows": "_n", "digest": "_d"})
    both = listed.join(there, "file", "full").where(~(F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d"))))
    wrong = both.select("file").limit(5).collect()
    if wrong:
        raise IncompleteQuarantine(f"{path}: files differ from the manifest: {[r['file'] for r in wrong]}")
    return spark.read.parquet(path)


def filtered_copy(df: DataFrame, name_col: str, term: str, path: str) -> DataFrame:
    """Write all rows (``copy=all``) and those whose name contains ``term``
    (``copy=<term>``) in one pass; return the count of each, observed in it."""
    _guard(df, path)
    found = Observation()
    hit = F.coalesce(F.col(name_col).contains(term), F.lit(False))
    copies = df.withColumn("copy", F.explode(F.when(hit, F.array(F.lit("all"), F.lit(term))).otherwise(F.array(F.lit("all")))))
    seen = copies.observe(found, F.count_if(F.col("copy") == "all").alias("n_all"), F.count_if(F.col("copy") == term).alias("n_filtered"))
    _write(seen, path, ("copy",))
    n = found.get
    return df.sparkSession.createDataFrame([(n["n_all"], n["n_filtered"])], "n_all long, n_filtered long")
