"""Benchmark decontamination by winnowing, in built-in functions only.

Texts are lower-cased (A-Z) and cut into words of digits, letters and
characters beyond ASCII.  A *window* is ``span`` consecutive words of a
benchmark item; an item with fewer words is one window.  A document word
inside any occurrence of a window is *hit*.

1. Winnowing: for windows of t words, every k-gram of words is hashed
   (k = 3t/5) and the least hash of each run of t - k + 1 consecutive
   k-grams is kept with its position.  A shared span of t words holds one
   such run, so its least hash is kept on both sides: no span is missed.
   Items shorter than ``span`` add their own t.
2. The kept hashes of the documents are joined with those of the distinct
   benchmark windows.  A hash names at most t - k + 1 places of a window, so
   a hit gives as many possible beginnings, however many items share it.
3. Each hit is extended to the window of t words at that beginning, whose
   digest is joined with the benchmark's: only equal windows count.
   Overlapping occurrences add up to the maximal shared spans.

Work goes by text, not by document: copies share one row from step 2 on,
and documents with the same set of windows share one list of items.  No
join pairs documents with items or copies with each other; a join's hot
side meets one row per key, so Spark can split it.  What is exchanged are
narrow rows (one position per about three words) and the texts with a hit,
once each: a bitmap of their keys, 8 MB at most, is broadcast to the second
read of the documents and lets next to no other text through.

Defined results: a null text has no words and is never hit; items without
words have no window; items that share an id are one item, and items with a
null id are one item named ``null``; repeated documents give one row each;
null ids stay null; empty tables give no row or no hit; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shared_table

SPAN = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITMAP, BITMAPS = 1 << 15, 1 << 11      # bits of one bitmap (fixed by Spark), number of bitmaps: 8 MB together
SLOTS = 8           # a k-gram's position modulo 8 travels in the low bits of its hash


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def gram_size(t: int) -> int:
    """k for windows of t words; runs of t - k + 1 k-grams must fit in SLOTS."""
    return max(1, 3 * t // 5, t - SLOTS + 2)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a))


def _runs(single: Column, n: int, join) -> Column:
    """``join`` over each run of n consecutive elements, by doubling (size - n + 1 runs)."""
    def grow(done: Column | None, have: int, part: Column, size: int) -> Column:
        if n & size:            # append the part to what is built so far
            done = part if done is None else F.zip_with(done, _shifted(part, have), join)
            have += size
        if size * 2 > n:
            return F.slice(done, 1, F.greatest(F.size(single) - (n - 1), F.lit(0)))
        doubled = F.zip_with(part, _shifted(part, size), join)
        if done is None:
            return let(doubled, lambda p: grow(None, have, p, size * 2))
        return let(done, lambda d: let(doubled, lambda p: grow(d, have, p, size * 2)))

    return grow(None, 0, single, 1)


def kept_grams(hashes: Column, t: int) -> Column:
    """Winnowing of a text's word hashes: array of (t, hash, pos) of the least
    k-gram of each run; pos is the k-gram's first word, from 0."""
    k = gram_size(t)
    low = F.lit(SLOTS - 1).cast("long")

    def changes(least: Column) -> Column:
        def place(x: Column, j: Column) -> Column:
            at = j + (x.bitwiseAND(low) - j).bitwiseAND(low)
            new = (j == 0) | (x != F.get(least, j - 1))
            return F.when(new, F.struct(F.lit(t).alias("t"), F.shiftright(x, 3).alias("hash"), at.cast("int").alias("pos")))
        return F.filter(F.transform(least, place), lambda s: s.isNotNull())

    def slotted(grams: Column) -> Column:
        return F.transform(grams, lambda x, i: F.shiftleft(x, 3).bitwiseOR(i.cast("long").bitwiseAND(low)))

    grams = _runs(hashes, k, lambda a, b: F.xxhash64(a, b))
    return let(grams, lambda g: let(slotted(g), lambda v: let(_runs(v, t - k + 1, lambda a, b: F.least(a, b)), changes)))


def winnowed(w: Column, lengths: list[int]) -> Column:
    """Kept k-grams of a word array for each window length."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.concat(*[kept_grams(h, t) for t in lengths]))


def benchmark_windows(bench: DataFrame, span: int = SPAN) -> DataFrame:
    """(item, t, win, hash, pos) of every window: its item, length, digest and kept k-gram."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    rows = bench.select(item.alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0) \
        .withColumn("t", F.least(F.size("w"), F.lit(span)))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("t") + 1), lambda i: F.slice("w", i, F.col("t")))
    rows = rows.select("item", "t", F.explode(each).alias("w"))
    # of the span's own length there is one kept k-gram per window; shorter lengths likewise
    kept = F.coalesce(*[F.when(F.col("t") == t, F.get(winnowed(F.col("w"), [t]), F.lit(0))) for t in range(1, span + 1)])
    return rows.select("item", "t", F.md5(F.concat_ws(" ", "w")).alias("win"), kept.alias("kept")) \
        .select("item", "t", "win", "kept.hash", "kept.pos")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text), one row per key of ``keys`` (and few others).  Copies are
    combined before the exchange, so they do not meet."""
    def slot(key: Column) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(key), F.lit(BITMAP * BITMAPS))
        return F.shiftright(h, 15).alias("bitmap"), h.bitwiseAND(F.lit(BITMAP - 1)).alias("bit")

    bitmaps = keys.select(*slot(F.col("key"))).groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return docs.select("text", text_key(F.col("text")).alias("key")).select("text", "key", *slot(F.col("key"))) \
        .join(F.broadcast(bitmaps), "bitmap").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1) \
        .groupBy("key").agg(F.any_value("text").alias("text"))


def occurrences(docs: DataFrame, prints: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, spans, wins, n_hit) per distinct hit text: its window occurrences
    (start, t) in order, the digests of those windows, the number of hit words."""
    places = windows.select("t", "hash", F.col("pos").alias("inside")).distinct()
    starts = prints.select("key", F.explode("prints").alias("p")).select("key", "p.*").join(places, ["hash", "t"]) \
        .select("key", (F.col("pos") - F.col("inside")).alias("start"), "t").where("start >= 0")
    maybe = shared_table(starts.groupBy("key").agg(F.collect_set(F.struct("start", "t")).alias("starts")), "decontaminate-maybe")
    extend = let(words(F.col("text")), lambda w: F.transform("starts", lambda s: F.struct(
        s["start"].alias("start"), s["t"].alias("t"), F.md5(F.concat_ws(" ", F.slice(w, s["start"] + 1, s["t"]))).alias("win"))))
    spans = texts_of(docs, maybe.select("key")).join(maybe, "key") \
        .select("key", F.explode(extend).alias("s")).select("key", "s.*") \
        .join(windows.select("win", "t").distinct(), ["win", "t"])
    texts = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "t"))).alias("spans"),
                                     F.sort_array(F.collect_set("win")).alias("wins"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["t"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"),
                        F.greatest(end, acc["end"]).alias("end"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda acc: acc["n"])
    return texts.withColumn("n_hit", covered.cast("long"))


def decontaminate(docs: DataFrame, bench: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and its window occurrences ``spans`` (null: none)."""
    windows = shared_table(benchmark_windows(bench, span), "decontaminate-windows")
    lengths = sorted(r["t"] for r in windows.select("t").distinct().collect())      # at most ``span`` numbers
    prints = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (
        winnowed(w, lengths) if lengths else F.array().cast("array<struct<t:int,hash:bigint,pos:int>>")).alias("prints")))
    rows = shared_table(docs.select("doc_id", text_key(F.col("text")).alias("key"), prints.alias("x")).select("doc_id", "key", "x.*"),
                        "decontaminate-prints")
    hit = shared_table(occurrences(docs, rows.select("key", "prints"), windows)
                       .withColumn("set_id", F.md5(F.concat_ws(",", "wins"))), "decontaminate-hits")
    sets = hit.groupBy("set_id").agg(F.first("wins").alias("wins")).select("set_id", F.explode("wins").alias("win")) \
        .join(windows.select("win", "item").distinct(), "win").groupBy("set_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = hit.join(sets, "set_id").select("key", "n_hit", F.size("items").cast("long").alias("n_items"),
                                            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "spans")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "key", "n_words").join(named, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "spans")
