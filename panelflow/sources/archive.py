"""Archive ingest: zip files -> CSV rows, distributed over archive members.

``binaryFile`` lists the archives (one row per archive).  A first pass reads
each central directory and passes the members on, still compressed, one row
each; Spark deals them to tasks by member, so the members of one large
archive are inflated side by side.  A member is inflated as a stream, its
rows leave in bounded batches as (archive, member, row_no, header, cells),
and its checksum is compared at the end.  A bad archive, or a bad member of
a good one, yields an error row instead of failing the job; the rows that
precede the damage are kept, and the error row says so.  Originals are never
deleted.  Cells are bound to header names with ``map_from_arrays``, so
members with different column orders line up by name.  ``pack_archives`` is
the way back: each batch of rows becomes an archive of CSV members.

An archive is one value of a ``binaryFile`` row, so it may have 2 GB at most
(Spark's limit, compressed); a member's inflated size is not limited.
"""

from __future__ import annotations

import csv
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_SCHEMA = ("archive string, member string, row_no long, header array<string>, cells array<string>, "
               "error string")
MEMBER_SCHEMA = "archive string, member string, method int, crc long, data binary, error string"
BATCH_ROWS = 10000
INFLATE_BYTES = 1 << 20
LOCAL_HEADER = 30           # fixed value: bytes of a member's local header before its name


def _members(batches):
    """Archives -> their CSV members, compressed, one row each."""
    names = ["archive", "member", "method", "crc", "data", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as zf:
                    infos = [i for i in zf.infolist() if i.filename.lower().endswith(".csv")]
            except Exception as e:  # noqa: BLE001 - reported as a row
                yield pd.DataFrame([(path, None, None, None, None, f"{type(e).__name__}: {e}")], columns=names)
                continue
            for i in infos:
                try:
                    name_size, extra_size = struct.unpack("<HH", content[i.header_offset + 26:i.header_offset + LOCAL_HEADER])
                    at = i.header_offset + LOCAL_HEADER + name_size + extra_size
                    if i.flag_bits & 1:
                        raise zipfile.BadZipFile("encrypted member")
                    row = (path, i.filename, i.compress_type, i.CRC, content[at:at + i.compress_size], None)
                except Exception as e:  # noqa: BLE001 - reported as a row
                    row = (path, i.filename, None, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=names)


class _Inflated(io.RawIOBase):
    """A member's bytes as a stream; its end compares the checksum."""

    def __init__(self, data: bytes, method: int, crc: int):
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise zipfile.BadZipFile(f"compression method {method}")
        self.data, self.at, self.crc, self.seen = data, 0, crc, 0
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self.rest = b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest and (self.at < len(self.data) or (self.inflate and self.inflate.unconsumed_tail)):
            if self.inflate is None:
                self.rest = self.data[self.at:self.at + INFLATE_BYTES]
                self.at += len(self.rest)
            else:
                chunk = self.inflate.unconsumed_tail
                if not chunk:
                    chunk = self.data[self.at:self.at + INFLATE_BYTES]
                    self.at += len(chunk)
                self.rest = self.inflate.decompress(chunk, INFLATE_BYTES)
        out = self.rest[:len(buffer)]
        self.rest = self.rest[len(out):]
        self.seen = zlib.crc32(out, self.seen)
        if not out and self.seen != self.crc:
            raise zipfile.BadZipFile("bad checksum")
        buffer[:len(out)] = out
        return len(out)


def _member_rows(archive: str, member: str, method: int, crc: int, data: bytes) -> Iterator[tuple]:
    with io.TextIOWrapper(io.BufferedReader(_Inflated(data, method, crc)), encoding="utf-8", newline="") as fh:
        reader = csv.reader(fh)
        header = next(reader, None)
        for i, row in enumerate(reader, start=1):
            if row and any(c.strip() for c in row):
                yield archive, member, i, header, row, None


def _explode_members(batches):
    names = ["archive", "member", "row_no", "header", "cells", "error"]
    for pdf in batches:
        out = []
        for archive, member, method, crc, data, error in pdf.itertuples(index=False):
            if error is not None:
                out.append((archive, member, None, None, None, error))
                continue
            try:
                for row in _member_rows(archive, member, int(method), int(crc), data):
                    out.append(row)
                    if len(out) >= BATCH_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            except Exception as e:  # noqa: BLE001 - reported as a row
                out.append((archive, member, None, None, None, f"{type(e).__name__}: {e}"))
        if out:
            yield pd.DataFrame(out, columns=names)


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of every CSV member of every zip archive matching ``glob``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(glob).select("path", "content")
    return archive_rows(files)


def archive_rows(files: DataFrame) -> DataFrame:
    """Rows of every CSV member of the archives in a table of (path, content)."""
    members = files.select("path", "content").mapInPandas(_members, MEMBER_SCHEMA)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "archive", "member").mapInPandas(_explode_members, ROWS_SCHEMA)


def pack_archives(df: DataFrame, member_col: str) -> DataFrame:
    """Zip archives of the rows as a table of (path, content): one archive per
    Arrow batch, with a CSV member for each value of ``member_col`` in it.
    Nothing is shuffled and no task holds more than a batch."""
    names = [c for c in df.columns if c != member_col]

    def pack(batches):
        for pdf in batches:
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                for member, part in pdf.groupby(member_col, dropna=False):
                    zf.writestr(f"{member}.csv", part[names].to_csv(index=False))
            content = buf.getvalue()
            yield pd.DataFrame({"path": [f"{hashlib.sha256(content).hexdigest()}.zip"], "content": [content]})

    return df.select(member_col, *[F.col(c).cast("string") for c in names]).mapInPandas(
        pack, "path string, content binary")


def archive_tally(rows: DataFrame) -> DataFrame:
    """Per archive: extracted (no error) or failed, and rows read."""
    return rows.groupBy("archive").agg(
        F.count_if(F.col("error").isNull()).alias("n_rows"),
        F.max(F.col("error").isNotNull().cast("int")).alias("failed"))


def rows_to_columns(rows: DataFrame, columns) -> DataFrame:
    """Bind cells to header names and select ``columns`` (absent -> NULL).
    A row with too few cells has NULLs for the rest, one with too many loses
    those without a name; `ragged_tally` counts both."""
    m = F.map_from_arrays("header", F.transform(F.col("header"), lambda _, i: F.get(F.col("cells"), i)))
    good = rows.where(F.col("error").isNull() & F.col("header").isNotNull())
    return good.select("archive", "member", "row_no", *[m[c].alias(c) for c in columns])


def ragged_tally(rows: DataFrame) -> DataFrame:
    """Per archive member: rows, and rows whose cell count differs from the header's."""
    return rows.where(F.col("error").isNull()).groupBy("archive", "member").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("header") != F.size("cells")).alias("n_ragged"))
