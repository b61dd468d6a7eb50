"""Mixing sources to target weights by weighted sampling without
replacement (Efraimidis and Spirakis).

Each document draws an exponential key ``-ln(u) / w``, where ``u`` is a
hash of its id and ``w`` its quality weight; smaller keys come first, so a
better document tends to come earlier.  A source whose target is ``r``
times its size takes ``floor(r)`` complete epochs, then the documents with
the smallest keys whose sizes add up to what is left; the document at the
boundary is taken if that ends nearer to the target than leaving it out.

Scale: per-document rows are narrow (id, source, size, key).  They are
range-partitioned on (source, key), so a source that holds a third of all
rows is spread over many tasks; running sums are taken inside each range
and offset by per-range sums (one row per source and range).  Window
functions without a partition run over one row per source only.

Defined results: a null text has size 0 and is taken 0 times its size; a
null source is a source of its own, last in order; a null id draws by its
text alone; rows that agree in id and text are ordered arbitrarily among
themselves, which changes no result.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import cut_lineage

from .common import SPACES, input_tasks, words

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
LEAST_WEIGHT = 0.05


def quality_weight(text: Column) -> Column:
    """Share of a text's word characters that are not markup symbols,
    between 0.05 and 1 (no word characters: 0.05)."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(F.regexp_replace(t, SPACES, ""))
    plain = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D#*$%&|<>]+", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.try_divide(plain.cast("double"), chars.cast("double")), F.lit(0.0)))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Uniform number in (0, 1), a function of seed and id (null id: of the text)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.coalesce(F.md5(text), F.lit(""))))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(16 ** 13))


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from per-source sizes.

    Sources in code-point order, null last, weigh ``weights`` in turn and
    share ``percent`` of all words; a target stops at ``max_epochs`` times
    the source's size and the excess is shared again by weight.  The fixed
    point is ``min(level * weight, cap)``: with sources sorted by
    cap / weight, the level is the first one that leaves its own source
    below its cap, which two running sums find."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    by_source = sizes.withColumn("rank", F.row_number().over(order)).select(
        "source", "source_size", "rank", each.alias("w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(percent / 100.0)
    level = F.try_divide(total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                         F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    found = by_source.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "rank", "level")))
        .over(everything)["level"])
    return found.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    """Narrow per-document rows: id, source, size in words, key and tie-breaker."""
    return docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        (-F.log(draw(F.col("doc_id"), F.col("text"))) / quality_weight(F.col("text"))).alias("key"),
        F.xxhash64("text").alias("tie"))


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, tie, size, source_size, target, times, taken."""
    rows = measured(docs)
    n = input_tasks(docs.sparkSession)
    placed = cut_lineage(rows.repartitionByRange(n, F.col("source"), F.col("key"), F.col("doc_id"), F.col("tie"))
                         .withColumn("part", F.spark_partition_id()))
    ranges = placed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")),
                             weights, percent, max_epochs)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    bounds = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("b_source"), F.col("o.part").alias("b_part"), "offset", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ordered.join(bounds, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    epochs = F.least(F.lit(max_epochs), F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))))
    left = F.col("target") - epochs * F.col("source_size")
    reached = F.col("offset") + F.col("inner")
    once_more = (epochs < max_epochs) & (F.col("size") > 0) & (reached + F.col("size") / 2.0 <= left)
    times = (epochs + F.when(once_more, 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "tie", "size", "source_size", "target", times.alias("times"),
                         (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, same columns.

    Rows are matched to their decision by id and text hash (both null
    safe); rows that agree in both share one decision per row."""
    chosen = mix(docs, **options).groupBy("doc_id", "tie").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_tie"),
                       F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]).alias("k_row"))
    # rows that agree in id and text take their joint copies in turn, in an order that a repeated task finds again
    same = Window.partitionBy("k_id", "k_tie").orderBy("k_row")
    picked = left.join(chosen, left["k_id"].eqNullSafe(chosen["doc_id"]) & left["k_tie"].eqNullSafe(chosen["tie"]))
    nth = F.row_number().over(same)
    share = F.floor(F.col("times") / F.col("rows")) + F.when(nth <= F.col("times") % F.col("rows"), 1).otherwise(0)
    copies = picked.withColumn("copies", share).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

