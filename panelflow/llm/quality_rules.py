"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` gives the per-text measurements as one struct, ``RULES`` is
the threshold table, ``verdict`` compiles the table into one boolean
expression.  Built-in functions only: the whole operator is a projection
(no shuffle, no user function), so its cost is one pass over the text.

Defined results: a null or empty text has no words, measures 0 everywhere
and is rejected; every input row gives one output row (repeated rows and
null ids included); extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with on be by this are from or at "
    "le la les de des du un une et en est que qui dans pour par sur au "
    "der die das und zu den von mit sich auf nicht ein eine als auch "
    "el y los se del las por con no una su para es al"
).split()

SYMBOLS = "#*$%&|<>"

# The threshold table: (rule, measure, comparison that a kept text meets, bound).
RULES = (
    ("length_min", "n_words", ">=", 10),
    ("word_length_min", "mean_word_chars", ">=", 2.0),
    ("word_length_max", "mean_word_chars", "<=", 15.0),
    ("symbols_max", "symbols_per_word", "<=", 0.25),
    ("stop_words_min", "stop_word_ratio", ">=", 0.05),
    ("repeated_lines_max", "repeated_line_ratio", "<=", 0.5),
    ("repeated_words_max", "repeated_word_ratio", "<=", 0.2),
)

#: share of words in repeated windows beyond which the base check fails, in percent
BASE_REPEAT_PERCENT = 20
BASE_MIN_WORDS = 10
WINDOW = 5


def _covered(starts: Column, width: int) -> Column:
    """Number of positions that windows of ``width`` at the sorted ``starts`` cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        starts, zero,
        lambda acc, p: F.struct((p + width).alias("end"), (acc["n"] + p + width - F.greatest(acc["end"], p)).alias("n")),
        lambda acc: acc["n"])


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur twice or more in
    ``ws`` (the first occurrence counts too).

    Windows are compared by a 64-bit hash.  Texts without a repeated window
    (the common case) stop after a distinct count; the others sort their
    window hashes, so that the cost stays n log n for very long texts."""
    def positions(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(tagged, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["i"])))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(positions(h), width))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    return let(ws, lambda w: F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes(w), count)))


def repeated_lines(text: Column) -> Column:
    """(lines that hold a word, lines among them equal to an earlier one) as a struct."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda s: F.struct(F.size(s).alias("n_lines"),
                                         (F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines")))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the ratios that the table's rules read."""
    counted = docs.select("doc_id", words(F.col("text")).alias("w"), F.col("text").alias("t")).select(
        "doc_id",
        let(F.col("w"), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"))).alias("c"),
        F.length(F.regexp_replace(F.coalesce("t", F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        repeated_lines(F.col("t")).alias("l"))
    n = F.greatest(F.col("c.n_words"), F.lit(1)).cast("double")
    return counted.select(
        "doc_id", "c.n_words", "c.word_chars", "n_symbols", F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        "c.n_repeat_words",
        (F.col("c.word_chars") / n).alias("mean_word_chars"), (F.col("n_symbols") / n).alias("symbols_per_word"),
        ((F.col("c.n_stop_words") + 1) / (n + 1)).alias("stop_word_ratio"),
        (F.col("l.n_dup_lines") / F.greatest("l.n_lines", F.lit(1))).alias("repeated_line_ratio"),
        (F.col("c.n_repeat_words") / n).alias("repeated_word_ratio"))


def passes(measure: str, comparison: str, bound: float) -> Column:
    return F.col(measure) >= F.lit(bound) if comparison == ">=" else F.col(measure) <= F.lit(bound)


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean column: true where all rules hold."""
    out = F.lit(True)
    for _, measure, comparison, bound in rules:
        out = out & passes(measure, comparison, bound)
    return out


def failed_rules(rules=RULES) -> Column:
    """Names of the rules that a text fails, in table order, joined by commas."""
    return F.concat_ws(",", *[F.when(~passes(m, c, b), F.lit(name)) for name, m, c, b in rules])


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept`` and the failed rules."""
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict(rules)).alias("kept"), failed_rules(rules).alias("failed_rules"))
