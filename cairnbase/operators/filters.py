"""Lookups and typed filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_filter(fmt: str | None = None, min_bytes: int | None = None, max_bytes: int | None = None, country: str | None = None, ts_from: int | None = None, ts_to: int | None = None) -> Column:
    """Predicates that reach the Parquet scan; sizes are strict, an upper time bound leaves out undated rows."""
    parts = []
    if fmt and (clean := re.sub("[^a-z0-9]", "", fmt.lower())):
        parts.append(F.col("format") == clean)
    if min_bytes is not None:
        parts.append(F.col("byte_size") > min_bytes)
    if max_bytes is not None:
        parts.append(F.col("byte_size") < max_bytes)
    if country:
        parts.append(F.col("geo_country") == country)
    if ts_from is not None:
        parts.append(F.col("exif_ts") >= ts_from)
    if ts_to is not None:
        parts.append((F.col("exif_ts") <= ts_to) & (F.col("exif_ts") > 0))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def newest(rows: DataFrame, key: str, value: object, order: str = "id") -> DataFrame:
    """The newest row with a value that is not unique."""
    return rows.where(F.col(key) == value).orderBy(F.desc(order)).limit(1)


def by_prefix(rows: DataFrame, prefix: str | None, key: str = "content_hash", order: str = "id") -> DataFrame:
    """The first row whose key begins with a prefix; no prefix, no restriction."""
    return rows.where(F.col(key).startswith(prefix)).orderBy(order).limit(1) if prefix else rows


def find_entity(entities: DataFrame, target: str) -> DataFrame:
    """By id, else by exact key, else by part of the name: the first way that finds one."""
    number = int(target) if target.isdigit() else -1
    way = F.when(F.col("id") == number, 1).when(F.col("norm_key") == target.lower(), 2).when(F.lower("name").contains(target.lower()), 3)
    return entities.withColumn("_way", way).where("_way is not null").orderBy("_way", "id").limit(1).drop("_way")


def outline(chapters: DataFrame, depth: int = 3) -> DataFrame:
    """Titles down to a depth, indented."""
    return chapters.where(F.col("level") <= depth).select("file_id", "ord", F.concat(F.expr("repeat('  ', level - 1)"), "title").alias("line"))


def needing_ocr(figures: DataFrame) -> DataFrame:
    return figures.where("image_path is not null and ocr_text is null")


def not_merged(entities: DataFrame, keys: list[str], types: list[str] | None = None) -> DataFrame:
    out = entities.where(F.col("norm_key").isin(keys) & (F.col("status") != "merged_into"))
    return out.where(F.col("type").isin(types)) if types else out


def overlapping_forms(entities: DataFrame, forms: list[str], types: list[str] | None = None) -> DataFrame:
    """Entities with an alias or acronym among the given forms."""
    own = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("acronyms", F.array().cast("array<string>")))
    out = entities.where(F.arrays_overlap(F.transform(own, lambda x: F.lower(F.trim(x))), F.array(*[F.lit(f) for f in forms])))
    return out.where(F.col("type").isin(types)) if types else out
