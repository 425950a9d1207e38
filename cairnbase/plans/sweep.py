"""The synthesis of one source: extraction over its windows, candidates, resolution, and the rows that follow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import acronym_pair
from ..models import extract_entities
from ..operators import entities as E
from ..operators import mutate, structure
from ..schema import schema
from ..session import stored
from ..streaming.ingest import guard_empty_sweep


@dataclass
class Sweep:
    """The tables afterwards, the entities that gained or lost something, and how many candidates there were."""

    tables: dict[str, DataFrame]
    touched: DataFrame
    candidates: int


def _after(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


def _rows(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a table, null where it has none."""
    fields = schema(table).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def sweep(tables: dict[str, DataFrame], file_id: int, model: Callable[[str], str], s: Settings = DEFAULTS) -> Sweep:
    """Read a file's chunks window by window with a model, and make entities, mentions, claims and their sources of what it finds.

    Windows run in parallel, and one whose call fails finds nothing. Candidates merge by their key over all windows, and
    thin ones of a long file go. What an earlier sweep made of the file is cleared first, but for a sweep that finds
    nothing where there was something: that is an error. A match gains the names, a new subject is an active entity,
    and a doubtful one an unresolved entity with a review. Candidates are resolved against the entities as they were.
    """
    mine = F.col("file_id") == file_id
    chunks = tables["chunks"].where(mine)
    windows = stored(structure.extraction_windows(chunks, s.synth_window_chunks), "sweep-windows")
    n = (windows.agg(F.max("window")).first()[0] or 0) + 1
    found = stored(extract_entities(structure.passages(windows, s.synth_chunk_chars), model), "sweep-found")
    known = tables["entities"].where("status <> 'merged_into'").select("norm_key")
    merged = E.merge_candidates(found, known, n, s=s)
    pair = acronym_pair(F.col("name"))
    acronyms = F.when(pair["acronym"].isNotNull(), F.array(pair["acronym"])).otherwise(F.array().cast("array<string>"))
    cands = stored(merged.withColumns({"id": F.monotonically_increasing_id(), "acronyms": acronyms}), "sweep-candidates")
    guard_empty_sweep(cands, tables["mentions"].where(mine))

    out = dict(tables)
    cleared = mutate.clear_synthesis(tables["mentions"], tables["claims"], tables["claim_sources"], tables["entity_review"], chunks.sparkSession.createDataFrame([(file_id,)], "file_id long"))
    keys = E.neighbour_keys(cleared["mentions"], tables["entities"], s.comention_cap)
    together = cands.agg(F.collect_set("norm_key").alias("_all"))  # the candidates of one file
    beside = cands.join(F.broadcast(together)).select(F.col("id").alias("candidate_id"), F.array_except("_all", F.array("norm_key")).alias("keys"))
    decided = E.resolve(cands.select("id", "name", "type", "norm_key", "aliases", "acronyms"), tables["entities"], s, keys, beside)
    first_new = _after(tables["entities"])
    decided = stored(decided.join(cands.withColumnRenamed("id", "candidate_id"), "candidate_id").withColumn("_own", F.col("decision") != "MATCH"), "sweep-decided")
    minted = F.when(F.col("_own"), F.col("candidate_id") + first_new).otherwise(F.col("entity_id")).alias("subject")
    placed = stored(decided.select("*", minted), "sweep-placed")

    fresh = placed.where("_own").select(F.col("subject").alias("id"), "name", "type", "norm_key", "aliases", "acronyms", F.when(F.col("decision") == "NEW", "active").otherwise("unresolved").alias("status"), F.lit(0).alias("source_count"))
    gained = placed.where("not _own").groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), "aliases")))).alias("_names"))
    old = tables["entities"].join(gained.withColumnRenamed("entity_id", "_e"), F.col("id") == F.col("_e"), "left")
    none = F.array().cast("array<string>")
    names = F.filter(F.coalesce("_names", none), lambda x: x != F.col("name"))
    old = old.withColumn("aliases", F.when(F.col("_e").isNull(), F.col("aliases")).otherwise(F.array_union(F.coalesce("aliases", none), names))).drop("_e", "_names")

    named = E.contains_join(chunks, cands.select("id", "name", "aliases"), s.provenance_cap)
    where = placed.join(named, "candidate_id", "left").select("candidate_id", "subject", "decision", "score", "chunk_id")
    mention = F.monotonically_increasing_id() + _after(tables["mentions"])
    mentions = stored(where.select(mention.alias("id"), F.lit(file_id).alias("file_id"), "chunk_id", F.col("subject").alias("entity_id"), "score", "decision"), "sweep-mentions")
    told = placed.select("candidate_id", "subject", F.posexplode("claims").alias("place", "text"))
    claims = stored(told.select((F.monotonically_increasing_id() + _after(tables["claims"])).alias("id"), F.col("subject").alias("entity_id"), F.lit(file_id).alias("file_id"), "text", F.lit("active").alias("status"), "candidate_id"), "sweep-claims")
    cited = claims.select(F.col("id").alias("claim_id"), "candidate_id").join(where.select("candidate_id", "chunk_id"), "candidate_id")
    sources = cited.select((F.monotonically_increasing_id() + _after(tables["claim_sources"])).alias("id"), "claim_id", "chunk_id", F.lit(file_id).alias("file_id"))
    doubt = placed.where("decision = 'DEFER'")
    reviews = doubt.select(
        (F.monotonically_increasing_id() + _after(tables["entity_review"])).alias("id"), F.col("name").alias("mention_surface"), F.col("type").alias("mention_type"), F.lit(file_id).alias("file_id"), F.col("subject").alias("entity_id"),
        F.to_json(F.struct(F.get("claims", F.lit(0)).alias("definition"), F.col("entity_id").alias("candidate_id"), "score", "margin")).alias("payload"), F.lit("open").alias("state"),
    )
    touched = stored(cleared["touched"].select(F.col("entity_id").alias("id")).union(placed.select("subject")).distinct(), "sweep-touched")
    out["mentions"] = stored(cleared["mentions"].unionByName(_rows(mentions, "mentions")), "mentions")
    out["claims"] = stored(cleared["claims"].unionByName(_rows(claims, "claims")), "claims")
    out["claim_sources"] = stored(cleared["claim_sources"].unionByName(_rows(sources, "claim_sources")), "claim_sources")
    out["entity_review"] = stored(cleared["reviews"].unionByName(_rows(reviews, "entity_review")), "entity_review")
    out["entities"] = stored(mutate.recount_sources(old.unionByName(_rows(fresh, "entities")), out["mentions"], touched), "entities")
    return Sweep(out, touched, cands.count())
