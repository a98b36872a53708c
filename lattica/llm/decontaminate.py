"""Benchmark decontamination by winnowing, in built-in functions only.

A document keeps the least k-gram hash of every run of ``window - k + 1`` k-grams. Two texts that share
``window`` words share all k-grams in them and so that least hash: joining the kept hashes of documents and
benchmark items finds every shared window. A hit is extended: all windows that keep the hash are compared,
as strings, with the windows of the items, so a hash collision never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

#: What stands between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the benchmark side up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, BETWEEN, -1), "")


def _grams(words: Column, size: int, body) -> Column:
    """body(hashes of all runs of ``size`` hashed words): runs double, then the rest is put behind."""

    def behind(left, step, right):
        return F.transform(F.slice(left, F.lit(1), F.size(right) - step), lambda x, i: x.bitwiseXOR(F.shiftleft(F.get(right, i + step), step)))

    def grow(gram, width):
        if width == size:
            return body(gram)
        if 2 * width <= size:
            return let(behind(gram, width, gram), lambda g: grow(g, 2 * width))
        return _grams(words, size - width, lambda rest: let(behind(gram, width, rest), body))

    return grow(words, 1)


def _winnowed(words: Column, window: int, k: int, short: list[int]) -> Column:
    """Array of (h, width, s, e): windows of width words that start at s..e-1 keep hash h."""

    def kept(w):
        n = F.size(w)

        def runs(grams):
            least = F.transform(F.slice(grams, F.lit(1), n - window + 1), lambda x, i: F.least(x, *[F.get(grams, i + j) for j in range(1, window - k + 1)]) if window > k else x)
            return let(least, lambda m: let(
                F.filter(F.sequence(F.lit(0), n - window), lambda s: (s == 0) | (F.get(m, s) != F.get(m, s - 1))),
                lambda starts: F.transform(starts, lambda s, i: F.struct(F.get(m, s).alias("h"), F.lit(window).alias("width"), s.alias("s"), F.coalesce(F.get(starts, i + 1), n - window + 1).alias("e"))),
            ))

        def whole(size):
            return lambda grams: F.transform(grams, lambda h, i: F.struct(h.alias("h"), F.lit(size).alias("width"), i.alias("s"), (i + 1).alias("e")))

        none = F.array().cast("array<struct<h:bigint,width:int,s:int,e:int>>")
        parts = [F.when(n >= window, _grams(w, k, runs)).otherwise(none)]
        parts += [F.when(n >= size, _grams(w, size, whole(size))).otherwise(none) for size in short]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(F.transform(words, lambda w: F.xxhash64(w)), kept)


def _windows(hits: DataFrame, *keep: str) -> DataFrame:
    """One row per window of a hit: its start and its words joined by a blank."""
    at = F.explode(F.sequence(F.lit(0), F.col("e") - F.col("s") - 1)).alias("j")
    return hits.select(*keep, "s", "width", "seg", at).select(*keep, (F.col("s") + F.col("j")).alias("pos"), "width", F.array_join(F.slice("seg", F.col("j") + 1, F.col("width")), " ").alias("win"))


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside a shared window), items (sorted ids as strings).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null texts have no words, documents without words and items without words hit nothing. Rows that repeat
    give a row each. Copies of an item share one entry, so they multiply no rows. Other columns are ignored.
    """
    bench = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    short = sorted(r[0] for r in bench.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())  # window - 1 values at most
    own = F.lit(window)
    bench = bench.withColumn("width", F.least(own, F.size("words"))).select("item", "words", "width")
    spots = bench.select("item", "width", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("width")), lambda s: F.array_join(F.slice(F.col("words"), s + 1, F.col("width")), " "))).alias("win"))
    wins = table(spots.groupBy("width", "win").agg(F.sort_array(F.collect_set("item")).alias("in_items")), "windows")
    prints = table(bench.select("width", F.explode(_winnowed(F.col("words"), window, k, short)).alias("f")).where("f.width = width").select(F.col("f.h").alias("h"), F.col("f.width").alias("width")).distinct(), "prints")
    # bytes of the windows with 64 for each row besides; prints are two numbers
    weight = wins.agg(F.coalesce(F.sum(F.octet_length("win") + F.aggregate("in_items", F.lit(0), lambda s, i: s + F.octet_length(i) + 8) + 64), F.lit(0))).first()[0]
    small = weight <= BROADCAST_BYTES and 64 * prints.count() <= BROADCAST_BYTES
    side = F.broadcast if small else (lambda df: df)

    marker = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("width"), F.lit(-1).alias("s"), F.lit(-1).alias("e")))
    cut = F.slice("words", F.col("f.s") + 1, F.col("f.e") - F.col("f.s") - 1 + F.col("f.width"))
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
        .select("row", "doc_id", "words", F.concat(marker, _winnowed(F.col("words"), window, k, short)).alias("fs"))
        .select("row", "doc_id", "words", F.explode("fs").alias("f"))
    )
    if not small:  # shuffle the words of a print, not of its document
        rows = rows.select("row", "doc_id", "f", F.when(F.col("f.s") < 0, F.array(F.size("words").cast("string"))).otherwise(cut).alias("seg"))
    known = side(prints.select(F.col("h").alias("kh"), F.col("width").alias("kw")))
    rows = rows.join(known, (F.col("f.h") == F.col("kh")) & (F.col("f.width") == F.col("kw")), "left").where("kh is not null or f.s < 0")
    if small:
        rows = rows.select("row", "doc_id", "f", F.when(F.col("f.s") < 0, F.array(F.size("words").cast("string"))).otherwise(cut).alias("seg"))
    rows = rows.select("row", "doc_id", F.col("f.s").alias("s"), F.when(F.col("f.s") < 0, 0).otherwise(F.col("f.e")).alias("e"), F.col("f.width").alias("width"), "seg")
    # a marker (s = -1) becomes one window of no words that holds the number of words
    spread = rows.withColumn("n_words", F.when(F.col("s") < 0, F.col("seg")[0].cast("long")))
    tried = _windows(spread, "row", "doc_id", "n_words")
    found = tried.join(side(wins.select(F.col("width").alias("ww"), F.col("win").alias("wwin"), "in_items")), (F.col("width") == F.col("ww")) & (F.col("win") == F.col("wwin")), "left").where("n_words is not null or in_items is not null")
    per = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("in_items").isNotNull(), F.struct("pos", "width"))).alias("spots"),
        F.collect_set("in_items").alias("sets"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(F.array_sort("spots"), start, lambda a, x: F.struct(
        F.greatest(a["end"], x["pos"] + x["width"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["pos"] + x["width"] - F.greatest(a["end"], x["pos"]))).alias("n"),
    ))["n"]
    return per.select("doc_id", "n_words", union.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
