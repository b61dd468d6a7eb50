"""Shared column expressions and helpers of the text operators.

A *word* is a run of characters other than the six ASCII white-space
characters (space, tab, LF, VT, FF, CR); a null text has no words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.session import ensure_checkpoint_dir

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """array<string> of the words of ``text`` (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: the value is
    bound to a lambda variable, so that nested lambdas read it instead of
    evaluating it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_table(df: DataFrame, name: str, partitionBy: str | None = None, **options) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder under the shared checkpoint
    folder and read it back: the lineage is cut, each later reader sees the
    same rows, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path, partitionBy=partitionBy)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_tasks(spark: SparkSession) -> int:
    """Number of partitions to deal rows to: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


HUBS, HUB_ROWS = 4_096, 1_000


def hub_limit(rows: int) -> int:
    """Rows of one key from which it counts as a hub: at most ``HUBS`` keys have more."""
    return max(HUB_ROWS, rows // HUBS)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """``rows`` joined with the one row per key of ``per_key``, whose column
    ``n`` counts the rows of the key.  A hub's rows are dealt to several tasks
    by a hash of the column ``by`` and its row is repeated for each; the hubs, at
    most ``HUBS`` (see `hub_limit`), are broadcast."""
    hubs = F.broadcast(per_key.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("long").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hubs, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    copies = per_key.join(hubs, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts", "n")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


CHUNK_CHARS = 4_000_000


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters (a longer text: alone)."""
    start = total = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)
