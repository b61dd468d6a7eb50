"""Trees of many small CSV files on a local or mounted file system.

Spark's own reader and writer hold every file of a tree on the driver
(listing, partitions of the scan, folders of the commit), and Hadoop's local
file system starts a ``chmod`` process for each folder, file and checksum it
makes.  Here tasks make the folders and list and read the files; the driver
holds one row per task and per distinct header.  Lines are made and parsed by
Spark's CSV expressions, so cells are those of its CSV source.

Only paths of the scheme ``file`` are taken; for others, and for patterns or
files this module does not handle, callers use Spark's reader and writer.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby, islice
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS_A_RANGE = 2048             # folders a task makes, about
LARGEST = 32 << 20              # bytes of a file that one task reads as a whole, at most
BATCH_BYTES = 4 << 20           # of text handed on at once
LINES = 1024                    # of a file in one row
SHARES_A_CORE = 4
MISSING = "__HIVE_DEFAULT_PARTITION__"      # fixed value: the folder name of a missing key
ESCAPED = {i: f"%{i:02X}" for i in (*range(1, 32), 127, *map(ord, "\"#%'*/:=?[\\]^{"))}     # fixed: as Spark names folders
ILLEGAL = re.compile(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")     # fixed: as Java quotes
BLANK = bytes(range(33))        # what Java's trim removes
ALIAS = "local tree"
PLAIN = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
FOUND = "file string, path string, header binary, n_rows long, kind string"


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system knows it; None on another file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def file_uri(path: str) -> str:
    """A path as ``_metadata.file_path`` gives it."""
    return "file:" + ILLEGAL.sub(lambda m: quote(m[0], safe=""), path)


# -- writing ----------------------------------------------------------------------

def writable(df: DataFrame, by) -> bool:
    """Whether all columns are of types that CSV files hold as text, and some are left beside the keys."""
    return set(by) < set(df.columns) and all(t in PLAIN or t.startswith("decimal") for _, t in df.dtypes)


def write_sorted(df: DataFrame, path: str, by, header: bool = True) -> None:
    """CSV files in one folder per key combination, as Spark's writer makes
    them, from rows that are dealt and sorted by ``by``: a task has one file of
    a folder open at a time.  An earlier folder ``path`` is replaced.

    A task writes under hidden names of its attempt and gives the files their
    names at its end; a repeated task gives the same names to the same rows.
    ``_SUCCESS`` follows last."""
    spark = df.sparkSession
    cells = [c for c in df.columns if c not in by]
    first = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(cells)]))).first()[0] if header else ""
    if os.path.isdir(path) and not os.path.islink(path):
        shutil.rmtree(path)
    elif os.path.lexists(path):
        os.remove(path)
    os.makedirs(path)
    line = F.concat(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells])), F.lit("\n"))
    keys = [F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(MISSING)).alias(f"k{i}") for i, c in enumerate(by)]
    names = [c.translate(ESCAPED) for c in by]
    write = partial(_write, path, names, uuid.uuid4().hex, f"{first}\n".encode() if header else b"")
    df.select(*keys, line.alias("line")).mapInArrow(write, "n_files long").agg(F.sum("n_files")).collect()
    open(f"{path}/_SUCCESS", "wb").close()


def _write(root: str, names: list[str], run: str, header: bytes, batches) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part, attempt, out, last, made = task.partitionId(), task.taskAttemptId(), None, None, []
    for batch in batches:
        text = batch.column(len(names)).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data, at = memoryview(text.buffers()[2] or b""), 0
        for keys, rows in groupby(zip(*[batch.column(i).to_pylist() for i in range(len(names))])):
            n = sum(1 for _ in rows)
            if keys != last:
                if out:
                    out.close()
                folder = "/".join([root, *[f"{c}={k.translate(ESCAPED)}" for c, k in zip(names, keys)]])
                os.makedirs(folder, exist_ok=True)
                name = f"part-{part:05d}-{run}.c{len(made):06d}.csv"
                made.append((f"{folder}/.{name}.{attempt}", f"{folder}/{name}"))
                out, last = open(made[-1][0], "wb"), keys
                out.write(header)
            out.write(data[ends[at]:ends[at + n]])
            at += n
    if out:
        out.close()
    for hidden, name in made:
        os.replace(hidden, name)
    yield pa.RecordBatch.from_pydict({"n_files": pa.array([len(made)], pa.int64())})


# -- reading ----------------------------------------------------------------------

def _pattern(part: str) -> re.Pattern:
    return re.compile("".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in part), re.DOTALL)


class Tree:
    """The files that a pattern with ``*`` and ``?`` matches, dealt to tasks by
    the names at one of its levels."""

    def __init__(self, pattern: str, largest: int, cores: int):
        self.parts, self.largest = pattern.strip("/").split("/"), largest
        most = SHARES_A_CORE * cores
        wild = [i for i, p in enumerate(self.parts[:-1]) if re.search(r"[*?]", p)]
        self.level = wild[-1] if wild else len(self.parts) - 1
        seen = sum(1 for _ in islice(self._walk("", 0, self.level, 0, 1), 8 * most))
        if seen < 8 * most and self.level < len(self.parts) - 1:        # few folders: their files are dealt
            self.level = len(self.parts) - 1
            seen = sum(1 for _ in islice(self._walk("", 0, self.level, 0, 1), 8 * most))
        self.shares = max(1, min(most, seen // 8))

    def _walk(self, root: str, i: int, to: int, share: int, shares: int) -> Iterator[str]:
        part, own = self.parts[i], i == self.level and shares > 1
        if re.search(r"[*?]", part):
            match = _pattern(part).fullmatch
            try:
                with os.scandir(root or "/") as entries:
                    found = (e.name for e in entries if match(e.name) and not (own and zlib.crc32(os.fsencode(e.name)) % shares != share))
                    yield from self._below(root, found, i, to, share, shares)
            except (FileNotFoundError, NotADirectoryError):
                return
        elif not (own and zlib.crc32(os.fsencode(part)) % shares != share):
            yield from self._below(root, (part,), i, to, share, shares)

    def _below(self, root: str, names, i: int, to: int, share: int, shares: int) -> Iterator[str]:
        for name in names:
            path = f"{root}/{name}"
            if i < to:
                yield from self._walk(path, i + 1, to, share, shares)
            elif i < len(self.parts) - 1 or not _hidden(name) and os.path.lexists(path):
                yield path

    def files(self, share: int) -> Iterator[str]:
        return self._walk("", 0, len(self.parts) - 1, share, self.shares)

    def empty(self) -> bool:
        return next(self._walk("", 0, len(self.parts) - 1, 0, 1), None) is None


def _hidden(name: str) -> bool:
    """Files that Spark's listing leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def tree_of(spark: SparkSession, paths) -> Tree | None:
    """The files below ``paths``, if that is one pattern of plain CSV files on a
    local file system."""
    one = paths if isinstance(paths, str) else paths[0] if len(paths) == 1 else ""
    if not re.search(r"[*?]", one) or re.search(r"[\[\]{}\\]", one) or not one.endswith(".csv"):
        return None
    pattern = local_path(spark, one)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return pattern and Tree(pattern, min(LARGEST, split), spark.sparkContext.defaultParallelism)


def _files(spark: SparkSession, tree: Tree, fn, schema: str) -> DataFrame:
    """What ``fn`` makes of batches of paths.  Folders are listed by shares; the
    files found are dealt anew, so that a folder with many of them is read by
    all tasks.  The plan names the pattern, as a file source would its files (`reads`)."""
    shares = spark.range(0, tree.shares, 1, tree.shares).alias(ALIAS + "/" + "/".join(tree.parts))
    paths = shares.mapInArrow(partial(_list, tree), "path string")
    if tree.shares > 1:
        paths = paths.repartition(tree.shares, "path")
    return paths.mapInArrow(partial(fn, tree.largest), schema)


def _list(tree: Tree, shares) -> Iterator[pa.RecordBatch]:
    for batch in shares:
        for share in batch.column(0).to_pylist():
            files = tree.files(share)
            while some := list(islice(files, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])


def reads(df: DataFrame, path: str) -> bool:
    """Whether the plan of ``df`` reads a tree with files that are below ``path`` or may be."""
    plans, want = [df._jdf.queryExecution().analyzed()], path.strip("/").split("/")
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "SubqueryAlias" and plan.alias().startswith(ALIAS + "/"):
            parts = plan.alias().removeprefix(ALIAS + "/").split("/")
            if all(_pattern(a).fullmatch(b) for a, b in zip(parts, want)):
                return True
        below = plan.children()
        plans += [below.apply(i) for i in range(below.length())]
    return False


def survey(spark: SparkSession, tree: Tree) -> DataFrame:
    """(file, path, header, n_rows, kind) of every file: its first line with
    more than blanks and the number of such lines after it (kind ``small``); a
    file without one is left out.  A file too large to be read as a whole is
    named only (``large``), so is anything that is no file (``other``)."""
    return _files(spark, tree, _survey, FOUND)


def _lines(data: bytes) -> list[bytes]:
    return data.removeprefix(b"\xef\xbb\xbf").splitlines()


def _survey(largest: int, batches) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            if not os.path.isfile(path) or os.path.getsize(path) > largest:
                found.append((file_uri(path), path, None, 0, "large" if os.path.isfile(path) else "other"))
                continue
            with open(path, "rb", buffering=0) as f:
                lines = [x for x in _lines(f.read()) if x.strip(b" ")]
            if lines:
                found.append((file_uri(path), path, lines[0], len(lines) - 1, "small"))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)


def lines_of(spark: SparkSession, tree: Tree, header: bytes, large) -> DataFrame:
    """(file, lines) of the files with this first line, but for the paths
    ``large``; the lines after it, without those that Spark's CSV source leaves
    out as empty.  The tree is listed again when the plan runs."""
    return _files(spark, tree, partial(_bodies, header, frozenset(large)), "file string, lines array<binary>")


def _bodies(header: bytes, large: frozenset, _, batches) -> Iterator[pa.RecordBatch]:
    def batch_of(files: list[str], bodies: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(bodies, pa.list_(pa.binary()))], ["file", "lines"])

    files, bodies, held = [], [], 0
    for path in (p for batch in batches for p in batch.column(0).to_pylist()):
        if path in large:
            continue
        with open(path, "rb", buffering=0) as f:            # one that is gone fails, as with Spark's reader
            lines = _lines(f.read())
        if next((x for x in lines if x.strip(b" ")), None) != header:
            continue
        body, uri = [x for x in lines if x.strip(BLANK)][1:], file_uri(path)
        for i in range(0, len(body), LINES):
            files.append(uri)
            bodies.append(body[i:i + LINES])
            held += sum(map(len, bodies[-1]))
            if held > BATCH_BYTES:
                yield batch_of(files, bodies)
                files, bodies, held = [], [], 0
    if files:
        yield batch_of(files, bodies)


def parse(lines: DataFrame, names: list[str], keep) -> DataFrame:
    """Cells of ``names`` and the source file from (file, lines), where
    ``keep`` holds for the cells: each line is parsed once."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.transform("lines", lambda x: F.from_csv(x.cast("string"), schema, {"mode": "PERMISSIVE"}))
    kept = F.filter(cells, lambda s: keep([s[f"c{i}"] for i in range(len(names))]))
    return lines.select("file", F.inline(kept)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
                                                       F.col("file").alias("source_file"))
