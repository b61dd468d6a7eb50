"""Chronological, k-fold and time-series k-fold splits over a global row
position.

``global_position`` never moves all rows into one task: rows are range
partitioned on the order key (sampled bounds), sorted inside each
partition and numbered with ``monotonically_increasing_id``; the per-
partition row counts (one row per partition) give each partition's
offset.  The numbered frame is checkpointed into the shared checkpoint
folder before use, so a lost executor re-reads it rather than
re-deriving ids from a recomputed shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def global_position(df: DataFrame, order_cols, num_partitions: int | None = None,
                    checkpoint: bool = True, by=()) -> DataFrame:
    """Add ``_pos`` (0-based position in ``order_cols`` order) and ``_n``
    (row count).  The order columns should identify rows uniquely.

    With ``by``, position and count are those within each group (one
    dataset per group, as roads and directions): rows are ordered by group
    first, so a large group spans many partitions, and a group's start is
    its least position (one row per group, joined back)."""
    by = list(by)
    if by:
        d = global_position(df, [*by, *order_cols], num_partitions, checkpoint).drop("_n")
        groups = d.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(
            F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        return d.join(groups, same).withColumn("_pos", F.col("_pos") - F.col("_start")).drop(
            "_start", *[f"_by_{c}" for c in by])
    ordered = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
               else df.repartitionByRange(*order_cols))
    numbered = ordered.sortWithinPartitions(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        numbered = cut_lineage(numbered)
    numbered = numbered.withColumns({"_part": F.shiftright("_mid", 33), "_local": F.col("_mid").bitwiseAND(_LOW_BITS)})
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a global window over it is tiny
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    out = numbered.join(F.broadcast(offsets), "_part")
    return out.withColumn("_pos", F.col("_off") + F.col("_local")).drop("_mid", "_part", "_local", "_off")


def chronological_split(df: DataFrame, order_cols, train: float = 0.7, val: float = 0.15,
                        min_train: int = 100, min_val_test: int = 50, positioned: bool = False,
                        by=()) -> DataFrame:
    """``split`` = train / val / test by position: first floor(n*train)
    rows, next floor(n*val), rest.  A frame (with ``by``: a group) too small
    for the minimum sizes is refused: it has no rows in the result."""
    d = df if positioned else global_position(df, order_cols, by=by)
    n = F.col("_n").cast("double")
    t_idx = F.floor(n * F.lit(train))
    v_idx = t_idx + F.floor(n * F.lit(val))
    ok = (t_idx >= min_train) & ((v_idx - t_idx) >= min_val_test) & ((F.col("_n") - v_idx) >= min_val_test)
    split = F.when(F.col("_pos") < t_idx, F.lit("train")).when(F.col("_pos") < v_idx, F.lit("val")).otherwise(F.lit("test"))
    return d.where(ok).withColumn("split", split).drop("_n")


def kfold_split(df: DataFrame, order_cols, k: int = 5, test: float = 0.15, positioned: bool = False,
                by=()) -> DataFrame:
    """Last ``test`` share is the test set (fold 0); the rest forms
    ``k`` contiguous folds, the first (m mod k) one row larger; each
    train/val row appears once per fold with ``role`` train or val."""
    d = df if positioned else global_position(df, order_cols, by=by)
    m = F.floor(F.col("_n").cast("double") * F.lit(1.0 - test))
    q, r = F.floor(m / k), m % k
    big = r * (q + 1)
    p = F.col("_pos")
    fold_of = F.when(p < big, F.floor(p / (q + 1)) + 1).otherwise(r + F.floor((p - big) / q) + 1)
    tv = (d.where(p < m).withColumn("_own", fold_of)
           .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
           .withColumn("role", F.when(F.col("_own") == F.col("fold"), F.lit("val")).otherwise(F.lit("train")))
           .drop("_own"))
    te = d.where(p >= m).withColumn("fold", F.lit(0)).withColumn("role", F.lit("test"))
    return tv.unionByName(te).drop("_n")


def timeseries_split(df: DataFrame, order_cols, k: int = 5, test: float = 0.15,
                     positioned: bool = False, by=()) -> DataFrame:
    """Expanding-window folds over the train/val part: block size
    m // (k + 1); fold i validates on the i-th of the last k blocks and
    trains on everything before it.  Test rows as in ``kfold_split``."""
    d = df if positioned else global_position(df, order_cols, by=by)
    m = F.floor(F.col("_n").cast("double") * F.lit(1.0 - test))
    ts = F.floor(m / (k + 1))
    p = F.col("_pos")
    start = m - F.lit(k) * ts + (F.col("fold") - 1) * ts
    tv = (d.where(p < m).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
           .withColumn("role", F.when(p < start, F.lit("train")).when(p < start + ts, F.lit("val")))
           .where(F.col("role").isNotNull()))
    te = d.where(p >= m).withColumn("fold", F.lit(0)).withColumn("role", F.lit("test"))
    return tv.unionByName(te).drop("_n")
