"""Plans carried out: merges, folds, relabels, disambiguation and page rebuilds, with pages, catalog, vectors and undo.

Each function takes the tables of a knowledge base by name and gives back those that change. Maintenance writes the
pages that follow to a versioned wiki in one commit, and stamps its handle on the merges, which is what an undo names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_display_name, norm_key
from ..schema import schema
from ..session import stored
from ..sources.wiki import entity_pages, index_page
from ..sources.wiki_repo import WikiRepo
from . import entities as E
from . import mutate

Tables = dict[str, DataFrame]


@dataclass
class Change:
    """Tables that a step replaces; ids of entities whose pages are to be written, and pages and paths besides."""

    tables: Tables
    touched: DataFrame
    written: list[DataFrame] = field(default_factory=list)
    removed: list[DataFrame] = field(default_factory=list)
    merges: DataFrame | None = None


def _ids(df: DataFrame, *names: str) -> DataFrame:
    out = df.select(F.col(names[0]).cast("long").alias("id"))
    for name in names[1:]:
        out = out.union(df.select(F.col(name).cast("long")))
    return out.where("id is not null").distinct()


def _next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


def redirects(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """path, content of a page at each merged source's slug, unless its target has the same one."""
    source = E.with_slugs(before).select(F.col("id").alias("from_id"), F.col("name").alias("_name"), F.col("slug").alias("_slug"))
    target = E.with_slugs(after).select(F.col("id").alias("into_id"), F.col("name").alias("_into"), F.col("slug").alias("_to"))
    moved = plan.select("from_id", "into_id").join(source, "from_id").join(target, "into_id").where("_slug <> _to")
    return moved.select(F.format_string("entities/%s.md", "_slug").alias("path"), F.format_string("# %s\n\n> merged\n\nMerged into [[%s|%s]].\n", "_name", "_to", "_into").alias("content"))


def merge(tables: Tables, plan: DataFrame, reason: str) -> Change:
    """Carry out merges (from_id, into_id, optional display_name): tables, manifest rows, redirects, vectors."""
    before = tables["entities"]
    out = mutate.merge_entities(before, tables["claims"], tables["mentions"], plan, reason)
    manifest = stored(out["manifest"].withColumn("id", F.monotonically_increasing_id() + _next_id(tables["entity_merges"])).withColumn("committed_sha", F.lit(None).cast("string")), "merges")
    entities, claims, mentions = (stored(out[n], n) for n in ("entities", "claims", "mentions"))
    merged = manifest.select([F.col(f.name) if f.name != "moved" else F.col("moved").cast(f.dataType).alias("moved") for f in schema("entity_merges").fields])
    vectors = tables["vec_entities"].join(_ids(manifest, "from_id").withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    changed = {"entities": entities, "claims": claims, "mentions": mentions, "entity_merges": tables["entity_merges"].unionByName(merged), "vec_entities": vectors}
    return Change(changed, _ids(manifest, "into_id"), [redirects(manifest, before, entities)], [], manifest.select("id"))


def collision_merges(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """from_id, into_id, display_name: the merges of shared slugs that are safe, each with the title that it gives its survivor.

    A survivor's sources come in the order of their ids, and the title is chosen anew from its own and each source's name.
    """
    safe = E.collision_plan(entities, claims).where("reason is null").select("from_id", "into_id")
    names = entities.select("id", "name")
    named = safe.join(names.withColumnsRenamed({"id": "from_id", "name": "_from"}), "from_id").join(names.withColumnsRenamed({"id": "into_id", "name": "_into"}), "into_id")
    chosen = F.aggregate("_carried", F.col("_into"), lambda now, name: canonical_display_name(F.array(now, name)))
    return _carry(named).select("from_id", "into_id", canonical_display_name(F.array(chosen)).alias("display_name"))


def _carry(named: DataFrame) -> DataFrame:
    """Adds _carried: the names of a survivor's sources so far (from_id, into_id, _from) that can have changed its title.

    A title never has fewer capitals than a name before it, so these are the names with more capitals than all before them: at most
    one for each number of capitals, however many sources a survivor has.
    """
    sources = Window.partitionBy("into_id").orderBy("from_id")
    before = F.max("_capitals").over(sources.rowsBetween(Window.unboundedPreceding, -1))
    counted = named.withColumn("_capitals", F.regexp_count("_from", F.lit(r"\p{Lu}")))
    marked = counted.withColumn("_more", F.when(F.col("_capitals") > F.coalesce(before, F.lit(-1)), F.col("_from")))
    return marked.withColumn("_carried", F.collect_list("_more").over(sources.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def fold_pair(tables: Tables, a: int, b: int) -> DataFrame:
    """from_id, into_id: the poorer of two active entities into the richer one; no row if either is gone or not active."""
    rated = E._claim_counts(tables["entities"].where(F.col("id").isin(a, b) & (F.col("status") == "active")), tables["claims"])
    ends = rated.agg(F.max_by("id", E._RICHEST()).alias("into_id"), F.min_by("id", E._RICHEST()).alias("from_id"), F.count("*").alias("n"))
    return ends.where("n = 2 and from_id <> into_id").select("from_id", "into_id")


def fold_into(tables: Tables, drop: int, keep: int) -> DataFrame:
    """from_id, into_id: an unresolved entity into the active one that it is; no row unless both are that."""
    e = tables["entities"]
    ends = e.where((F.col("id") == drop) & (F.col("status") == "unresolved")).select(F.col("id").alias("from_id"))
    return ends.join(e.where((F.col("id") == keep) & (F.col("status") == "active")).select(F.col("id").alias("into_id")), F.col("from_id") != F.col("into_id"))


def undo(tables: Tables, merges: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> Change:
    """Merges (rows of entity_merges) taken back: tables, manifest rows gone, the sources' vectors made anew by ``embed``."""
    out = mutate.unmerge_entities(tables["entities"], tables["claims"], tables["mentions"], merges)
    entities, claims, mentions = (stored(out[n], n) for n in ("entities", "claims", "mentions"))
    changed = {"entities": entities, "claims": claims, "mentions": mentions, "entity_merges": stored(tables["entity_merges"].join(merges.select("id"), "id", "left_anti"), "entity_merges")}
    back = _ids(merges, "from_id")
    if embed:
        changed["vec_entities"] = _with_vectors(tables["vec_entities"], entities.join(back, "id"), embed)
    return Change(changed, _ids(merges, "from_id", "into_id"))


def _with_vectors(vectors: DataFrame, entities: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Name vectors of the entities in place of their old ones; embed adds ``vector`` to (entity_id, type, name)."""
    new = embed(entities.select(F.col("id").alias("entity_id"), "type", "name")).select("entity_id", "type", "vector").where("vector is not null")
    return stored(mutate.clear_then_insert(vectors, new, "entity_id", entities.select(F.col("id").alias("entity_id"))), "vec_entities")


def relabel(tables: Tables, embed: Callable[[DataFrame], DataFrame] | None = None) -> Change:
    """Row labels off names: renames first, then folds into what is active under the clean key, then bare labels pruned."""
    before = tables["entities"]
    plan = stored(E.relabel_plan(before, tables["claims"]), "relabels")
    renamed = plan.where("action = 'rename'").select(F.col("id").alias("_r"), F.col("clean").alias("_clean"))
    entities = before.join(renamed, F.col("id") == F.col("_r"), "left").withColumns({"name": F.coalesce("_clean", "name"), "norm_key": F.when(F.col("_r").isNotNull(), norm_key(F.col("_clean"))).otherwise(F.col("norm_key"))}).drop("_r", "_clean")
    entities = stored(entities, "entities")
    active = entities.where("status = 'active'").select(F.col("id").alias("into_id"))
    folds = plan.where("action = 'fold'").select(F.col("id").alias("from_id"), "into_id").join(active, "into_id", "left_semi")
    change = merge(tables | {"entities": entities}, folds, "row-label: fold labeled twin")
    bare = _ids(plan.where("action = 'prune'"), "id")
    owned = tables["wiki_pages"].join(bare.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select("path")
    pruned = mutate.prune_entities(change.tables["entities"], tables["wiki_pages"], bare)
    vectors = change.tables["vec_entities"].join(bare.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    if embed:
        vectors = _with_vectors(vectors, entities.join(renamed, F.col("id") == F.col("_r"), "left_semi"), embed)
    change.tables |= {"entities": stored(pruned["entities"], "entities"), "wiki_pages": stored(pruned["wiki_pages"], "wiki_pages"), "vec_entities": vectors}
    change.touched = change.touched.union(_ids(renamed, "_r")).distinct()
    change.removed.append(owned)
    return change


def disambiguate(tables: Tables) -> Change:
    """Distinct entities of one slug get slugs of their own; the one with the lowest id keeps the bare slug."""
    plan = stored(E.disambiguation_plan(tables["entities"].withColumn("slug", F.col("slug"))), "slugs")
    entities = stored(mutate.set_slugs(tables["entities"], plan), "entities")
    base = E.with_slugs(entities).where("status = 'active'")
    shared = base.join(base.join(plan.select("id"), "id", "left_semi").select("base_slug").distinct(), "base_slug", "left_semi")
    return Change({"entities": entities}, _ids(shared, "id"))


def with_pages(change: Change, tables: Tables, lead: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Tables, DataFrame, DataFrame]:
    """The tables after a change with their catalog brought up to date, and the pages to write and the paths to remove.

    Every touched entity's page, active or unresolved, is made from all its claims and stands at its present slug; its old page goes if
    the catalog has it as this entity's. ``lead`` adds ``lead`` to (entity_id, claims) of entities with two active claims
    or more. Of two entities with one path the one with more sources is written.
    """
    now = tables | change.tables
    entities = E.with_slugs(now["entities"]).where("status in ('active', 'unresolved')").join(change.touched, "id", "left_semi")
    told = now["claims"].join(_ids(entities, "id").withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
    cited = E.provenance(told, now["claim_sources"], now["chunks"], now["files"])
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("source_count"), "id"))
    placed = entities.select("id", "name", "source_count", F.format_string("entities/%s.md", "slug").alias("path")).withColumn("_first", first)
    owners = stored(placed.where("_first = 1").drop("_first"), "page-owners")
    pages = entity_pages(now["entities"].join(owners.select("id"), "id", "left_semi").withColumn("status", F.lit("active")), told, cited)
    if lead:
        two = told.where("status = 'active'").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("claims")).where(F.size("claims") >= 2)
        said = lead(two.select("entity_id", F.transform("claims", lambda c: c["text"]).alias("claims"))).select(F.col("entity_id").alias("id"), "lead").join(owners.select("id", "path"), "id").select("path", "lead")
        pages = pages.join(said, "path", "left").select("path", F.when(F.coalesce("lead", F.lit("")) == "", F.col("content")).otherwise(F.regexp_replace("content", r"(?s)\n\n## Claims\n", F.concat(F.lit("\n\n"), F.regexp_replace(F.trim("lead"), r"([\\$])", r"\\$1"), F.lit("\n\n## Claims\n")))).alias("content"))
    pages = stored(pages, "entity-pages")
    old = now["wiki_pages"].join(owners.select(F.col("id").alias("entity_id"), F.col("path").alias("_now")), "entity_id").where("path <> _now").select("path")
    rows = owners.join(pages, "path").select(
        F.col("path"), F.col("name").alias("title"), F.lit("entity").alias("kind"), F.col("id").alias("entity_id"), "source_count", F.current_timestamp().alias("last_synth_at"), F.sha2("content", 256).alias("md_hash")
    )
    catalog = now["wiki_pages"].join(old, "path", "left_anti")
    ids = catalog.select("path", F.col("id").alias("_id"))
    rows = rows.join(ids, "path", "left").withColumn("id", F.coalesce("_id", F.monotonically_increasing_id() + _next_id(now["wiki_pages"]))).drop("_id")
    now["wiki_pages"] = stored(mutate.upsert(catalog, rows.select(*catalog.columns), "path"), "wiki_pages")
    path = placed.select(F.col("id").alias("_i"), F.col("path").alias("_p"))
    moved = now["entities"].join(path, F.col("id") == F.col("_i"), "left").withColumn("wiki_path", F.coalesce("_p", "wiki_path")).drop("_i", "_p")
    if change.merges is not None:  # what was merged leads to its survivor's page
        at = moved.select(F.col("id").alias("_s"), F.col("wiki_path").alias("_w"))
        to = now["entity_merges"].join(change.merges, "id", "left_semi").select(F.col("from_id").alias("_f"), F.col("into_id").alias("_s")).join(at, "_s").select("_f", "_w")
        moved = moved.join(to, F.col("id") == F.col("_f"), "left").withColumn("wiki_path", F.coalesce("_w", "wiki_path")).drop("_f", "_w")
    now["entities"] = stored(moved, "entities")
    written = pages.unionByName(index_page(now["entities"]))
    for more in change.written:
        written = written.unionByName(more.join(written.select("path"), "path", "left_anti"))
    removed = old
    for more in change.removed:
        removed = removed.union(more)
    return now, written, removed


class Maintenance:
    """Carries changes out on the tables of a knowledge base (name to DataFrame) and its wiki."""

    def __init__(self, tables: Tables, wiki: WikiRepo, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.tables, self.wiki, self.embed = dict(tables), wiki, embed

    def _commit(self, change: Change, message: str, lead: Callable[[DataFrame], DataFrame] | None = None) -> str | None:
        tables, written, removed = with_pages(change, self.tables, lead)
        handle = self.wiki.commit(message, written, removed)
        if handle and change.merges is not None:
            stamped = tables["entity_merges"].join(change.merges.select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left")
            tables["entity_merges"] = stored(stamped.withColumn("committed_sha", F.when(F.col("_m").isNotNull(), F.lit(handle)).otherwise(F.col("committed_sha"))).drop("_m"), "entity_merges")
        self.tables = tables
        return handle

    def rewrite(self, touched: DataFrame, message: str = "pages rewritten", lead: Callable[[DataFrame], DataFrame] | None = None) -> str | None:
        """Pages of entities (id) made anew from all their claims: what follows the synthesis of a source."""
        return self._commit(Change({}, _ids(touched, "id")), message, lead)

    def integrate(self, file_id: int, name: str, lead: Callable[[DataFrame], DataFrame] | None = None) -> str | None:
        """Every entity that a file's claims or mentions touch gets its page rebuilt, in one commit."""
        mine = F.col("file_id") == file_id
        touched = self.tables["claims"].where(mine).select(F.col("entity_id").alias("id")).union(self.tables["mentions"].where(mine).select("entity_id"))
        return self.rewrite(touched, f"ingest | {name}", lead)

    def _merge(self, plan: DataFrame, reason: str) -> str | None:
        plan = stored(plan, "merge-plan")
        return self._commit(merge(self.tables, plan, reason), reason) if plan.limit(1).count() else None

    def merge_collisions(self) -> str | None:
        return self._merge(collision_merges(self.tables["entities"], self.tables["claims"]), "slug-collision batch")

    def fold_pair(self, a: int, b: int) -> str | None:
        return self._merge(fold_pair(self.tables, a, b), "duplicates: confirmed same")

    def fold_into(self, drop: int, keep: int, reason: str) -> str | None:
        return self._merge(fold_into(self.tables, drop, keep), reason)

    def undo(self, handle: str) -> str | None:
        """All merges of a commit taken back; the pages that result are a new commit."""
        merges = stored(self.tables["entity_merges"].where(F.col("committed_sha") == handle), "undone")
        return self._commit(undo(self.tables, merges, self.embed), f"undo {handle[:12]}") if merges.limit(1).count() else None

    def relabel(self) -> str | None:
        return self._commit(relabel(self.tables, self.embed), "row labels off names")

    def disambiguate(self) -> str | None:
        return self._commit(disambiguate(self.tables), "slugs of their own")

    def queue_review(self, surface: str, kind: str, file_id: int, entity_id: int | None, payload: str, verdict: str | None = None) -> int:
        """An ambiguous resolution put into the queue for a person to decide; returns its id."""
        reviews = self.tables["entity_review"]
        new = _next_id(reviews)
        row = [(new, surface, kind, file_id, entity_id, payload, verdict, None, "open")]
        self.tables["entity_review"] = stored(reviews.unionByName(reviews.sparkSession.createDataFrame(row, schema("entity_review"))), "entity_review")
        return new

    def placeholder(self, name: str, kind: str, aliases: list[str]) -> int:
        """The entity with this name's key and type, which gains the aliases; a new unresolved one where there is none."""
        entities = self.tables["entities"]
        spark = entities.sparkSession
        asked = spark.createDataFrame([(name, kind, aliases)], "name string, type string, aliases array<string>").withColumn("norm_key", norm_key(F.col("name")))
        key = asked.select("norm_key").first()[0]
        found = entities.where((F.col("norm_key") == key) & (F.col("type") == kind)).agg(F.min("id")).first()[0]
        if found is not None:
            self.tables["entities"] = stored(mutate.add_aliases(entities, spark.createDataFrame([(found, aliases)], "id long, aliases array<string>")), "entities")
            return found
        new = _next_id(entities)
        row = asked.select(F.lit(new).cast("long").alias("id"), "*", F.lit("unresolved").alias("status"), F.lit(0).alias("source_count"))
        self.tables["entities"] = stored(entities.unionByName(row, allowMissingColumns=True), "entities")
        return new


def set_row(table: DataFrame, key: str, value: object, **fields: Column) -> DataFrame:
    """table with fields of the row of a key set; an error if there is no such row."""
    if not table.where(F.col(key) == value).limit(1).count():
        raise ValueError(f"no row with {key} {value}")
    return mutate.set_where(table, F.col(key) == value, **fields)
