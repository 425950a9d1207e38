"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask is a fixed pattern of token positions that count; the others are ignored, so a substituted word at an ignored
position does not break the hash. Hashes of all masks at all positions of the training texts are joined to those of
the benchmark items. Around each hit the item is laid over the text on the hit's diagonal, and the overlap counts if
enough words agree in some window, whatever words were substituted between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, stored

#: Masks of weight 5 over at most 10 words. Chosen by enumeration: whatever words are substituted, one of them
#: hits every overlap with an item of 10 words or more that meets WINDOW and AGREE.
MASKS = ("1001010011", "1100010101", "110100011", "111011")
#: A window of so many words (or the whole of a shorter item) must agree in this share of its words.
WINDOW = 16
AGREE = 0.75
#: Items of fewer words are not looked for; those shorter than a mask must occur whole.
LEAST_WORDS = 5
#: The seeds of a benchmark, each with its item's words, are broadcast up to so many bytes; beyond, the join is shuffled.
BROADCAST_BYTES = 100_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the words under the mask; the mask itself is part of it. Null where the mask leaves the text."""
    picked = [F.get(words, at + k) for k, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *picked))


def _seeds(table: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """table (with words) with a row for each position and mask: pos, seed.

    The outer form keeps Spark from splitting each text a second time for a filter on empty ones. All that follows up
    to the join has generated code, so that the words of a text are not copied for each of its positions.
    """
    at = table.select("*", F.posexplode_outer("words").alias("pos", "_word")).drop("_word")
    return at.withColumn("seed", F.explode(F.array(*[_seed(F.col("words"), F.col("pos"), m) for m in masks]))).where("seed is not null")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """Contaminated documents: doc_id, item_id, doc_start, item_start, matched, window_matched, item_words.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. There is one row for each document
    and item that overlap, on the diagonal with the most matches in a window (then in all, then the first). Null and
    empty texts overlap with nothing; rows that repeat a doc_id (null too) give one row for each item. An item of fewer
    than LEAST_WORDS words is left out, one shorter than the longest mask must occur word for word.
    """
    span = max(map(len, masks))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= LEAST_WORDS).dropDuplicates()
    short = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())  # below the span, so a few at most
    every = masks + tuple("1" * n for n in short)
    long_seeds = _seeds(items.where(F.size("words") >= span), masks)
    seeds = long_seeds
    for n in short:
        seeds = seeds.unionByName(_seeds(items.where(F.size("words") == n), ("1" * n,)))
    seeds = seeds.select("seed", "item_id", F.col("words").alias("item"), F.col("pos").alias("item_pos"))
    size = F.octet_length(F.array_join("item", "")) + 16 * F.size("item") + 64
    fits = (seeds.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    table = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = _seeds(table, every).join(F.broadcast(seeds) if fits else seeds, "seed")
    diagonal = F.col("pos") - F.col("item_pos")
    low = F.greatest(-diagonal, F.lit(0))  # words of the item before the text begins
    length = F.least(F.size("item") - low, F.size("words") - diagonal - low)
    laid = hits.select("doc_id", "item_id", "item", diagonal.alias("diagonal"), low.alias("item_start"), F.slice("words", diagonal + low + 1, length).alias("part")).dropDuplicates()
    laid = stored(laid, "overlaps")  # apart from the scan: the sums below have no generated code
    equal = F.zip_with(F.col("part"), F.slice("item", F.col("item_start") + 1, F.size("part")), lambda a, b: (a == b).cast("int"))
    width = F.least(F.lit(window), F.size("item"))
    # sums of all windows, each from the one before: (sum so far, largest)
    sums = F.aggregate(
        F.sequence(F.lit(0), F.size("equal") - 1),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda acc, i: F.struct(
            (acc["run"] + F.get(F.col("equal"), i) - F.coalesce(F.get(F.col("equal"), i - F.col("width")), F.lit(0))).alias("run"),
            F.greatest(acc["most"], acc["run"] + F.get(F.col("equal"), i) - F.coalesce(F.get(F.col("equal"), i - F.col("width")), F.lit(0))).alias("most"),
        ),
    )
    matched = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    checked = laid.withColumn("equal", equal).withColumn("width", width).select(
        "doc_id", "item_id", "item_start", (F.col("diagonal") + F.col("item_start")).alias("doc_start"), matched.alias("matched"), sums["most"].alias("window_matched"), F.size("item").alias("item_words"), "width"
    )
    need = F.when(F.col("item_words") < span, F.col("item_words")).otherwise(F.ceil(F.col("width") * agree))
    best = F.max_by(F.struct("doc_start", "item_start", "matched", "window_matched", "item_words"), F.struct("window_matched", "matched", -F.col("doc_start"))).alias("b")
    return checked.where(F.col("window_matched") >= need).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def unsearchable_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words of the items that find_overlaps() leaves out: fewer than LEAST_WORDS words occur by chance."""
    n = F.size(words_of(F.col("text")))
    return benchmark.select("item_id", n.alias("n_words")).where(F.col("n_words") < LEAST_WORDS)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that overlap with a benchmark item.

    Null and empty texts stay. Rows that repeat a doc_id (null too) go together if one of them overlaps. Any further
    columns of docs stay as they are; an empty benchmark removes nothing.
    """
    bad = fresh_names(docs, "bad")["bad"]
    found = find_overlaps(docs, benchmark).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(bad)), "left_anti")
