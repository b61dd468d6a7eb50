"""Streaming hourly roll-up and gap filter over a file stream.

Both land each micro-batch in a folder of its own (``landed_batch=<id>``,
overwritten when Spark repeats a batch after a failure) and resolve the
result with built-in operators when it is read, so that no row is dropped
for being late and the order of files and batches does not matter:

* ``stream_hourly_rollup`` lands partial sums and counts per (key, hour);
  the current table merges the partials of an hour.
* ``stream_gap_filter`` lands the hourly rows; a late row can change the
  verdict on its successor, so the gaps are taken with ``rollup.gap_filter``
  over what has landed.

There is no operator state to bound.  Both run with
``trigger(availableNow=True)`` so a call always ends, and both checkpoint
under the shared checkpoint folder; a later call with the same ``out_path``
takes up the files that have come since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions.numeric import safe_div
from panelflow.functions.timecols import floor_hour
from panelflow.operators.rollup import FLOW_SUM_COLS, MEAN_COLS, gap_filter
from panelflow.sources.sinks import staging_path


def _land(spark: SparkSession, source_path: str, schema, out_path: str, shape) -> DataFrame:
    """Run the stream to its end; ``shape`` of each micro-batch is written to
    that batch's folder.  Returns all that has landed (a source without files
    yet: no rows)."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{out_path}/landed/landed_batch={batch_id}")

    q = (spark.readStream.schema(schema).parquet(source_path).writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", f"{out_path}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    landed_schema = shape(spark.createDataFrame([], schema)).schema
    # an empty folder beside the batches', so that there is something to read before the first one
    spark.createDataFrame([], landed_schema).write.mode("ignore").parquet(f"{out_path}/landed/landed_batch=-1")
    return spark.read.schema(landed_schema).parquet(f"{out_path}/landed").drop("landed_batch")


def stream_hourly_rollup(spark: SparkSession, source_path: str, schema, out_path: str | None = None,
                         key: str = "segment_id", ts_col: str = "datetime", full_count: int = 4) -> DataFrame:
    """Hourly sums, means and completeness of a stream of readings; late
    readings are added to their hour whenever they come."""
    def partials(batch: DataFrame) -> DataFrame:
        return batch.groupBy(key, floor_hour(ts_col).alias(ts_col)).agg(
            *[F.sum(c).alias(c) for c in FLOW_SUM_COLS],
            *[x for c in MEAN_COLS for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count"))],
            F.count(F.lit(1)).alias("data_completeness"))

    out_path = out_path or staging_path(spark, "stream-hourly")
    landed = _land(spark, source_path, schema, out_path, partials)
    return landed.groupBy(key, ts_col).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in FLOW_SUM_COLS],
        *[safe_div(F.sum(f"{c}_sum"), F.sum(f"{c}_count")).alias(c) for c in MEAN_COLS],
        F.sum("data_completeness").alias("data_completeness")).withColumn(
        "is_interpolated", (F.col("data_completeness") < full_count).cast("int"))


def stream_gap_filter(spark: SparkSession, source_path: str, schema, out_path: str | None = None,
                      key: str = "segment_id", ts_col: str = "datetime", max_gap_hours: float = 6) -> DataFrame:
    """Rows of an hourly stream without those that follow a long gap, equal
    to the batch filter over all rows that have arrived."""
    out_path = out_path or staging_path(spark, "stream-gap")
    landed = _land(spark, source_path, schema, out_path, lambda batch: batch)
    return gap_filter(landed, [key], ts_col, max_gap_hours)
