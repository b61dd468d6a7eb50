"""Exact quantiles for large groups, without a sort and without putting a
group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one
aggregation buffer: fine for groups bounded by construction (hours of a
segment), not for a whole column or a handful of groups over all rows.
Here a mergeable sketch per group brackets the wanted ranks; a second pass
counts what lies between the brackets and keeps, with their counts, the
distinct values inside them, from which the ranks are read exactly.  If the
brackets would still hold too many values, the pass is made with a sketch
per bracket first, which narrows them a few hundred times more; a rank that
its bracket misses (the sketch is random) widens the brackets.  So the data
is read twice (more often beyond some 10^8 rows), nothing is checkpointed,
and what is exchanged are sketches and counts.  Interpolation is linear
between the two nearest ranks, as NumPy's default.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

SKETCH = 8_192          # size of a sketch: its rank error is below 0.001
MARGIN = 0.002          # of ranks, on either side of a wanted one
INSIDE = 1_000_000      # values of a group that may lie inside its brackets


class _Missed(Exception):
    pass


def _zones(d: DataFrame, by, brackets: dict) -> DataFrame:
    """Rows with ``_j`` (brackets wholly below the value) and ``_in``
    (whether the value is inside the next one)."""
    fields = ", ".join([f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by] + ["_lo array<double>", "_hi array<double>"])
    table = d.sparkSession.createDataFrame(
        [(*g, [lo for lo, _ in b], [hi for _, hi in b]) for g, b in brackets.items()], fields)
    # one row per group, from a fixed domain
    rows = d.join(F.broadcast(table), by) if by else d.crossJoin(F.broadcast(table))
    rows = rows.withColumn("_j", F.size(F.filter("_hi", lambda h: h < F.col("_v"))))
    return rows.withColumn("_in", F.coalesce(F.get("_lo", "_j") <= F.col("_v"), F.lit(False))).drop("_lo", "_hi")


def _sketch(v: Column, ranks: list[float]) -> Column:
    s = F.kll_sketch_agg_double(v, F.lit(SKETCH))
    return F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(s, F.array(*[F.lit(r) for r in ranks])))


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _bracketed(d: DataFrame, by, probs, margin: float) -> tuple[dict, dict, dict]:
    """(values, NaN values, brackets) of each group: brackets are disjoint
    ranges that hold its wanted ranks and few other values."""
    grid = sorted({x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))})
    first = d.groupBy(*by).agg(F.count("_v").alias("n"), F.count_if("_nan").alias("n_nan"), _sketch(F.col("_v"), grid).alias("q")).collect()
    sizes, nans, brackets, expected = {}, {}, {}, 0.0
    for r in first:
        g = tuple(r[c] for c in by)
        if r["q"] is None:
            continue
        sizes[g], nans[g] = r["n"], r["n_nan"]
        at = dict(zip(grid, r["q"]))
        wide = [(at[max(0.0, p - margin)], at[min(1.0, p + margin)]) for p in probs]
        if r["n"] * margin < 2:         # a rank's neighbour may lie beyond the margin in a short group
            wide = [(-math.inf, math.inf)]
        brackets[g] = _merged(wide)
        expected = max(expected, r["n"] * min(1.0, 2 * margin * len(probs)))
    while expected > INSIDE:
        ranks = [i / 1024 for i in range(1025)]
        zones = _zones(d, by, brackets).groupBy(*by, "_j", "_in").agg(
            F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
            _sketch(F.when(F.col("_in"), F.col("_v")), ranks).alias("q")).collect()
        before, expected = expected, 0.0
        for g in brackets:
            mine = sorted((r for r in zones if tuple(r[c] for c in by) == g), key=lambda r: (r["_j"], r["_in"]))
            narrowed, start, left = [], 0, 0.0
            for r in mine:
                wanted = [k for k in _ranks(sizes[g], probs) if start <= k < start + r["n"]]
                if wanted and not r["_in"]:
                    raise _Missed
                if wanted and r["lo"] == r["hi"]:
                    narrowed.append((r["lo"], r["hi"]))
                elif wanted:
                    cells = [(k - start + 0.5) / r["n"] * 1024 for k in wanted]
                    found = [(max(0, int(x) - 3), min(1024, int(x) + 4)) for x in cells]
                    narrowed += [(r["q"][a], r["q"][b]) for a, b in found]
                    left += r["n"] * min(1.0, 7 * len(found) / 1024)
                start += r["n"]
            brackets[g] = _merged(narrowed)
            expected = max(expected, left)
        if expected > before / 2:      # values that ties keep together are few distinct ones
            break
    return sizes, nans, brackets


def _ranks(n: int, probs) -> list[int]:
    return sorted({k for p in probs for k in (math.floor(p * (n - 1)), min(math.floor(p * (n - 1)) + 1, n - 1))})


def _read(d: DataFrame, by, probs, sizes: dict, brackets: dict) -> dict:
    """Value of every wanted rank of each group."""
    spark = d.sparkSession
    counts = _zones(d, by, brackets).groupBy(*by, "_j", F.when(F.col("_in"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    fields = ", ".join([f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by] + ["_ranks array<long>"])
    wanted = spark.createDataFrame([(*g, _ranks(n, probs)) for g, n in sizes.items()], fields)
    # one row per gap and per distinct value inside a bracket
    before = Window.partitionBy(*by).orderBy("_j", F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_end", F.sum("_c").over(before))
    placed = placed.join(F.broadcast(wanted), list(by)) if by else placed.crossJoin(F.broadcast(wanted))
    hit = F.filter("_ranks", lambda k: (k < F.col("_end")) & (k >= F.col("_end") - F.col("_c")))
    rows = placed.select(*by, "_x", F.explode(hit).alias("_k")).collect()
    if any(r["_x"] is None for r in rows):
        raise _Missed
    return {(tuple(r[c] for c in by), r["_k"]): r["_x"] for r in rows}


def exact_quantiles(df: DataFrame, value: str, probs, by=(), num_partitions: int | None = None) -> DataFrame:
    """One row per group and probability: (``*by``, ``i``, ``prob``,
    ``quantile``); NULL values and NULL groups are ignored, empty groups give
    no rows, NaN is larger than any number.  Groups must come from a fixed
    domain (columns, hours, conditions): brackets and ranks, a few per group
    and probability, pass through the driver.  ``num_partitions`` sets the
    partitions of the rows first."""
    by, probs = list(by), [float(p) for p in probs]
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).dropna(subset=by) if by else \
        df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    if num_partitions:
        d = d.repartition(num_partitions)
    # a sketch takes no NaN: it stands with the largest values and is named again by its rank
    d = d.withColumn("_nan", F.isnan("_v")).withColumn("_v", F.when(F.col("_nan"), F.lit(math.inf)).otherwise(F.col("_v")))
    margin = MARGIN
    while True:
        try:
            sizes, nans, brackets = _bracketed(d, by, probs, margin)
            values = _read(d, by, probs, sizes, brackets)
            break
        except _Missed:
            margin = min(1.0, margin * 8)
    rows = []
    for g, n in sizes.items():
        for i, p in enumerate(probs):
            t = p * (n - 1)
            k = math.floor(t)
            lo, hi = (math.nan if r >= n - nans[g] else values[g, r] for r in (k, min(k + 1, n - 1)))
            rows.append((*g, i, p, lo if t == k else (1.0 - (t - k)) * lo + (t - k) * hi))
    schema = StructType([d.schema[c] for c in by] + [StructField("i", IntegerType()), StructField("prob", DoubleType()),
                                                     StructField("quantile", DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def quantile_columns(df: DataFrame, value: str, probs, names, by=()) -> DataFrame:
    """Wide form: one row per group with a column per probability."""
    q = exact_quantiles(df, value, probs, by)
    return q.groupBy(*by).pivot("i", list(range(len(probs)))).agg(F.first("quantile")) \
        .select(*by, *[F.col(str(i)).alias(n) for i, n in enumerate(names)])


__all__ = ["exact_quantiles", "quantile_columns"]
