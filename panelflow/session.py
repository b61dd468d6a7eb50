"""Session helpers: building a session for local runs, checkpointing and
per-session reuse of small derived tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings we rely on.  ANSI stays on (Spark 4 default); every division
# in the library goes through try_divide so that it cannot raise.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "panelflow") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster:
    there the caller owns the session)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("PANELFLOW_DRIVER_MEM", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and we use
    it as is.  Only when it is unset (local tests) do we take a scratch
    folder of our own, set on the context (the setting itself is static).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="panelflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used after steps whose result depends on row placement (global
    positions): a lost executor then re-reads the checkpoint instead of
    recomputing a shuffle whose row order could differ.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_MEMO: dict = {}


def input_signature(spark: SparkSession, path: str) -> tuple:
    """(modification time, total bytes, file count) of a path, read from the
    file system's metadata; changes whenever the input is rewritten."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.getFileStatus(p)
    cs = fs.getContentSummary(p)
    return (st.getModificationTime(), cs.getLength(), cs.getFileCount())


def memo_small(spark: SparkSession, key: tuple, build):
    """Per-session memo for small derived tables that several plans read
    (event windows, their time pieces, an hourly weather series).  ``key``
    must identify the inputs (e.g. include ``input_signature``), so a
    rewritten input gives a new entry instead of a stale one."""
    sc = spark.sparkContext
    k = (sc.applicationId, sc.startTime, key)   # a restarted context never sees old entries
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def forget() -> None:
    """Drop all that this process remembers between queries."""
    _MEMO.clear()


def memo_plan(spark: SparkSession, key: tuple, build):
    """Per-session memo of a *lazy* DataFrame (no data is cached): plans
    that many queries start from are analysed once.  As with
    ``memo_small`` the key must carry the input signature."""
    return memo_small(spark, ("plan",) + tuple(key), build)
