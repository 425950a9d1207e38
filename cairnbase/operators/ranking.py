"""Lexical ranking, rank fusion, relevance floors and cluster de-duplication of hit lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_noise, occurrences, parse_query


def keyword_search(chunks: DataFrame, query: str, k: int = 8, key: tuple[str, ...] = ("id",), text: str = "text", drop_noise: bool = True) -> DataFrame:
    """Chunks that contain any needle of the query, by phrases, words, occurrences and brevity; adds score and rank.

    All matching chunks are ranked before the cut; ties end in the key.
    """
    phrases, words = parse_query(query)
    needles = phrases + words
    if not needles:
        return chunks.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    low = F.lower(F.col(text))
    hit = chunks.where(reduce(lambda a, b: a | b, [low.contains(n) for n in needles]))
    if drop_noise:
        hit = hit.where(~is_noise(F.col(text)))
    count = lambda ns: reduce(lambda a, b: a + b, [low.contains(n).cast("int") for n in ns], F.lit(0))
    found = hit.withColumns({
        "phrase_hits": count(phrases), "word_hits": count(words),
        "occurrences": reduce(lambda a, b: a + b, [occurrences(low, n) for n in needles]), "chars": F.length(text),
    })
    scored = found.withColumn("score", F.round((F.col("phrase_hits") + F.col("word_hits")) / len(needles), 4))
    order = [F.desc("phrase_hits"), F.desc("word_hits"), F.desc("occurrences"), F.asc("chars"), *key]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(rankings: DataFrame, arm: str = "arm", item: str = "id", rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: item, score, label of the arms it came from."""
    return rankings.groupBy(item).agg(
        F.sum(1.0 / (k + F.col(rank))).alias("score"),
        F.when(F.count_distinct(arm) > 1, "both").otherwise(F.min(arm)).alias("source"),
    )


def relevance_floor(hits: DataFrame, ratio: float = 0.25, least: float = 0.01, keep_top: bool = True, rank: str = "rank", by: Column | None = None) -> DataFrame:
    """Hits whose score reaches a share of the first's and an absolute floor; keep_top keeps the first in any case."""
    eff = by if by is not None else F.coalesce(F.col("rerank_score"), F.col("score"))
    top = F.first_value(eff).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    floor = F.greatest(top * ratio, F.lit(least)) if ratio > 0 else F.lit(least)
    rated = hits.withColumns({"_eff": eff, "_floor": floor})
    keep = F.col("_eff") >= F.col("_floor")
    return rated.where(keep | (F.col(rank) == 1) if keep_top else keep).drop("_eff", "_floor")


def dedupe_clusters(hits: DataFrame, cluster: str = "cluster_id", rank: str = "rank", item: str = "file_id") -> DataFrame:
    """One hit for each cluster at its best rank and score, shown as the canonical member if that is among the hits."""
    group = F.coalesce(F.concat(F.lit("c"), F.col(cluster).cast("string")), F.concat(F.lit("h"), F.col(rank).cast("string")))
    everything = F.struct(*hits.columns)
    best = hits.groupBy(group.alias("_g")).agg(F.min_by(everything, F.col(rank)).alias("b"), F.min_by(everything, F.when(F.col(item) == F.col(cluster), F.col(rank))).alias("canon"))
    scores = {"score", "rerank_score", rank}
    return best.select(*[(F.col(f"b.{c}") if c in scores else F.when(F.col("canon").isNotNull(), F.col(f"canon.{c}")).otherwise(F.col(f"b.{c}"))).alias(c) for c in hits.columns]).orderBy(rank)


def rerank(hits: DataFrame, logit: Column, k: int, key: str = "id") -> DataFrame:
    """Hits by the sigmoid of a model's logit, to four places; ties keep the old order by key."""
    scored = hits.withColumn("rerank_score", F.round(1 / (1 + F.exp(-logit)), 4))
    return scored.orderBy(F.desc("rerank_score"), key).limit(k)


def gallery(hits: DataFrame, cluster: str = "cluster_id", item: str = "file_id", rank: str = "rank") -> DataFrame:
    """The first hit of each cluster with the number of its duplicates; unclustered hits stand alone."""
    group = F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("f"), F.col(item).cast("string")))
    return hits.groupBy(group.alias("_g")).agg(F.min_by(F.struct(*hits.columns), F.col(rank)).alias("h"), (F.count("*") - 1).alias("dups")).select("h.*", "dups").orderBy(rank)


def citations(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Numbered citations; an image URL only for images."""
    return hits.select(
        F.row_number().over(Window.orderBy(rank)).alias("n"), "kind", "file", "chapter", "page", "chunk_id", "file_id",
        F.when(F.col("kind") == "image", F.concat(F.lit("/image/"), F.col("file_id").cast("string"))).alias("image_url"),
    )


def context_blocks(hits: DataFrame, rank: str = "rank", text: str = "text") -> DataFrame:
    """One row: the hits as numbered blocks joined by blank lines."""
    block = F.struct(F.col(rank).alias("r"), F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col(text)).alias("t"))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"]), "\n\n").alias("context"))
