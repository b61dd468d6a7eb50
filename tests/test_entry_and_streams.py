"""The entry file without optional modules; streams over an empty source."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelflow.plans import catalog  # noqa: F401
from panelflow.plans.registry import QUERIES
from panelflow.sources import testdata
from panelflow.streaming import hourly

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("missing", ["tiktoken", "public_tokenizers", "xxhash", "panelflow.llm", "corpus_pipeline"])
def test_entry_survives_a_missing_module(missing):
    code = (f"import sys; sys.path.insert(0, {REPO!r}); sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))")
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(QUERIES) and 0 < int(out[1]) <= len(QUERIES) and out[2] == "False"


@pytest.mark.parametrize("stream", [hourly.stream_hourly_rollup, hourly.stream_gap_filter])
def test_stream_over_an_empty_source(spark, tmp_path, stream):
    readings = testdata.readings(spark, SF)
    source = str(tmp_path / "in")
    os.makedirs(source)
    first = stream(spark, source, readings.schema, str(tmp_path / "out"))
    assert first.count() == 0
    readings.where(F.col("segment_id").isNotNull()).limit(200).coalesce(1).write.mode("append").parquet(source)
    later = stream(spark, source, readings.schema, str(tmp_path / "out"))
    assert later.count() > 0 and later.columns == first.columns
