"""Lint and audit rules: one finding for each broken invariant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import best_candidate, duplicate_pairs, slug_groups, unattested, with_slugs

FIELDS = ("kind", "detail", "ref", "entity_id", "candidate")
WIKILINK = r"\[\[([^\]|]*)"


def _finding(df: DataFrame, kind: str, detail: Column, ref: Column | None = None, entity: Column | None = None, candidate: Column | None = None) -> DataFrame:
    no_text, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    pick = lambda c, none, kind_: (c if c is not None else none).cast(kind_)
    return df.select(F.lit(kind).alias("kind"), detail.alias("detail"), pick(ref, no_text, "string").alias("ref"), pick(entity, no_id, "long").alias("entity_id"), pick(candidate, no_id, "long").alias("candidate"))


def link_targets(pages: DataFrame) -> DataFrame:
    """target: every stem that a wikilink of any page (path, content) names."""
    return pages.select(F.explode(F.regexp_extract_all("content", F.lit(WIKILINK), F.lit(1))).alias("target")).distinct()


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.md$", 1)


def orphan_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    paged = entities.where("wiki_path is not null and status not like 'merged%'")
    missing = paged.join(link_targets(pages), stem(F.col("wiki_path")) == F.col("target"), "left_anti")
    return _finding(missing, "orphan", F.concat(F.lit("no page links to "), F.col("name")), F.col("wiki_path"), F.col("id"))


def unsupported_claims(claims: DataFrame, claim_sources: DataFrame) -> DataFrame:
    bare = claims.join(claim_sources.select(F.col("claim_id").alias("_c")), F.col("id") == F.col("_c"), "left_anti")
    return _finding(bare, "unsupported_claim", F.substring("text", 1, 80), F.col("id"), F.col("entity_id"))


def unresolved_entities(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    open_ = entities.where("status = 'unresolved'")
    best = best_candidate(open_, entities.where("status = 'active'")).withColumnRenamed("id", "_u")
    rows = _finding(open_.join(best, F.col("id") == F.col("_u"), "left"), "unresolved", F.col("name"), None, F.col("id"), F.col("candidate_id"))
    queue = reviews.where("state = 'open'").agg(F.count("*").alias("n")).where("n > 0")
    return rows.unionByName(_finding(queue, "unresolved", F.concat(F.col("n").cast("string"), F.lit(" open reviews"))))


def missing_pages(entities: DataFrame) -> DataFrame:
    return _finding(entities.where("status = 'active' and wiki_path is null and source_count > 0"), "missing_page", F.col("name"), None, F.col("id"))


def deleted_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    gone = entities.where("status = 'active' and wiki_path is not null").join(pages.select(F.col("path").alias("_p")), F.col("wiki_path") == F.col("_p"), "left_anti")
    return _finding(gone, "deleted_page", F.col("name"), F.col("wiki_path"), F.col("id"))


def slug_collisions(entities: DataFrame) -> DataFrame:
    return _finding(slug_groups(with_slugs(entities)), "slug_collision", F.col("names"), F.col("slug"))


def duplicates(entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    active = entities.where("status = 'active'")
    pairs = duplicate_pairs(active, threshold)
    na, nb = active.select(F.col("id").alias("a"), F.col("name").alias("na")), active.select(F.col("id").alias("b"), F.col("name").alias("nb"))
    return _finding(pairs.join(na, "a").join(nb, "b"), "duplicate", F.concat("na", F.lit(" ~ "), "nb"), None, F.col("a"), F.col("b"))


def contradictions(claims: DataFrame, entities: DataFrame) -> DataFrame:
    named = entities.select(F.col("id").alias("_e"), "name")
    rows = claims.where("status = 'contradicted'").join(named, F.col("entity_id") == F.col("_e"))
    return _finding(rows, "contradiction", F.concat("name", F.lit(": "), F.substring("text", 1, 80)), F.col("id"), F.col("entity_id"))


def unattested_entities(entities: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    n = unattested(entities, claims, mentions).agg(F.count("*").alias("n")).where("n > 0")
    return _finding(n, "unattested", F.concat(F.col("n").cast("string"), F.lit(" entities without claim or mention")))


def stale_answers(wiki_pages: DataFrame, pages: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Filed answers whose cited entities have gained claims since."""
    filed = wiki_pages.where("kind = 'query'").select("path", "title", "last_synth_at")
    cited = filed.join(pages.select("path", "content"), "path").select("path", "title", "last_synth_at", F.explode(F.regexp_extract_all("content", F.lit(WIKILINK), F.lit(1))).alias("target"))
    known = entities.where("wiki_path is not null").select(F.col("id").alias("entity_id"), stem(F.col("wiki_path")).alias("target"))
    newest = cited.join(known, "target").join(claims.select("entity_id", "created_at"), "entity_id").groupBy("path", "title", "last_synth_at").agg(F.max("created_at").alias("newest"))
    return _finding(newest.where("newest > last_synth_at"), "stale_query", F.col("title"), F.col("path"))


def dangling_sources(claim_sources: DataFrame, chunks: DataFrame) -> DataFrame:
    gone = claim_sources.where("chunk_id is not null").join(chunks.select(F.col("id").alias("_k")), F.col("chunk_id") == F.col("_k"), "left_anti")
    return _finding(gone, "dangling_source", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")), F.col("claim_id"))


def catalog_drift(wiki_pages: DataFrame, pages: DataFrame) -> DataFrame:
    gone = wiki_pages.join(pages.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")
    return _finding(gone, "catalog_drift", F.col("title"), F.col("path"))


def _in_order(rules: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [r.withColumn("rule", F.lit(i)) for i, r in enumerate(rules, 1)])


def lint(t: dict[str, DataFrame]) -> DataFrame:
    """All ten rules over tables entities, claims, claim_sources, mentions, reviews, wiki_pages, pages; rule is their order."""
    return _in_order([
        orphan_pages(t["entities"], t["pages"]), unsupported_claims(t["claims"], t["claim_sources"]), unresolved_entities(t["entities"], t["reviews"]),
        missing_pages(t["entities"]), deleted_pages(t["entities"], t["pages"]), slug_collisions(t["entities"]), duplicates(t["entities"]),
        contradictions(t["claims"], t["entities"]), unattested_entities(t["entities"], t["claims"], t["mentions"]), stale_answers(t["wiki_pages"], t["pages"], t["entities"], t["claims"]),
    ])


def audit(t: dict[str, DataFrame]) -> DataFrame:
    """Integrity: dangling sources, unsupported claims, catalog drift."""
    return _in_order([dangling_sources(t["claim_sources"], t["chunks"]), unsupported_claims(t["claims"], t["claim_sources"]), catalog_drift(t["wiki_pages"], t["pages"])])


def by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("detail", "ref", "entity_id", "candidate"))).alias("items"))


def latest_claim_at(claims: DataFrame, ids: DataFrame) -> DataFrame:
    return claims.join(ids, "entity_id", "left_semi").groupBy("entity_id").agg(F.max("created_at").alias("latest"))


def fingerprint(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Count and largest ids: changes whenever a plan over these tables could."""
    return entities.agg(F.count("*").alias("entities"), F.max("id").alias("max_entity")).crossJoin(mentions.agg(F.max("id").alias("max_mention")))


def ranked(rows: DataFrame, group: str, *order) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
