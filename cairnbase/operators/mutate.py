"""Changes to tables as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, follow_merges


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of those with their key; of rows that repeat a key in new one stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Like upsert, but only the fields that new provides change: nulls of new keep the old value."""
    n = new.select([F.col(c).alias(f"_n_{c}") for c in new.columns])
    met = old.join(n, F.col(key) == F.col(f"_n_{key}"), "full_outer")
    return met.select([F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def clear_then_insert(old: DataFrame, new: DataFrame, owner: str, owners: DataFrame) -> DataFrame:
    """Children of the given owners replaced by new ones."""
    return old.join(owners.select(owner).distinct(), owner, "left_anti").unionByName(new, allowMissingColumns=True)


def null_missing(children: DataFrame, parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """A foreign key whose parent is gone becomes null."""
    p = parents.select(F.col(pk).alias("_pk")).distinct()
    return children.join(p, F.col(fk) == F.col("_pk"), "left").withColumn(fk, F.col("_pk")).drop("_pk")


def set_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def with_parent_ids(rows: DataFrame, first_id: int, file: str = "file_id") -> DataFrame:
    """Ids in (file, ord) order from first_id on, and parent_id from parent_ord of the same file."""
    ids = rows.withColumn("id", F.row_number().over(Window.orderBy(file, "ord")) + F.lit(first_id - 1))
    p = ids.select(F.col(file).alias("_f"), F.col("ord").alias("_o"), F.col("id").alias("parent_id"))
    return ids.join(p, (F.col(file) == F.col("_f")) & (F.col("parent_ord") == F.col("_o")), "left").drop("_f", "_o")


def add_aliases(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases of new (id, aliases) after the entity's own, first occurrences kept."""
    n = new.select("id", F.col("aliases").alias("_n"))
    none = F.array().cast("array<string>")
    return entities.join(n, "id", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("_n", none))).drop("_n")


def _strings(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def _merge_plan(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """from_id, into_id (the end of its chain within the plan), title: checked, and written out as all that follows needs it."""
    title = F.col("display_name") if "display_name" in merges.columns else F.lit(None).cast("string")
    given = merges.select("from_id", "into_id", title.alias("title")).dropDuplicates(["from_id"])
    known = entities.select(F.col("id").alias("_k"))
    sources = given.select(F.col("from_id").alias("_c"))
    for end, name in (("from_id", "_f"), ("into_id", "_i")):
        given = given.join(known.withColumnRenamed("_k", name), F.col(end) == F.col(name), "left")
    given = checkpointed(given.join(sources, F.col("into_id") == F.col("_c"), "left"))
    bad = given.agg(F.max(F.col("from_id") == F.col("into_id")).alias("self"), F.max(F.col("_f").isNull() | F.col("_i").isNull()).alias("unknown"), F.max(F.col("_c").isNotNull()).alias("chain")).first()
    if bad["self"]:
        raise ValueError("an entity cannot be merged into itself")
    if bad["unknown"]:
        raise ValueError("a merge names an entity that does not exist")
    plan = given.select("from_id", "into_id", "title")
    if not bad["chain"]:
        return plan
    ends = follow_merges(plan.select(F.col("from_id").alias("id"), "from_id", "into_id"))
    plan = checkpointed(plan.drop("into_id").join(ends.withColumnRenamed("survivor", "into_id"), "from_id"))
    if plan.join(plan.select(F.col("from_id").alias("_c")), F.col("into_id") == F.col("_c"), "left_semi").limit(1).count():
        raise ValueError("the merges form a cycle")
    return plan.select("from_id", "into_id", "title")


def _gained(plan: DataFrame, entities: DataFrame, own: str, incoming: Column) -> DataFrame:
    """into_id, from_id, pos, value: what each source adds to its target's list, each value by the first source that has it."""
    source = entities.select(F.col("id").alias("_s"), incoming.alias("_in"))
    each = plan.join(source, F.col("from_id") == F.col("_s")).select("into_id", "from_id", F.posexplode("_in").alias("pos", "value")).where("value is not null")
    first = each.groupBy("into_id", "value").agg(F.min(F.struct("from_id", "pos")).alias("at")).select("into_id", "value", "at.from_id", "at.pos")
    has = entities.select(F.col("id").alias("_h"), F.explode(_strings(own)).alias("_v"))
    return first.join(has, (F.col("into_id") == F.col("_h")) & (F.col("value") == F.col("_v")), "left_anti")


def _in_order(gained: DataFrame, key: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("from_id", "pos", "value")))
    return gained.groupBy(F.col(key).alias(f"_{key}")).agg(F.transform(ordered, lambda x: x["value"]).alias(name))


def _with(table: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return table.join(other, F.col(key) == F.col(other_key), "left").drop(other_key)


def _renames(plan: DataFrame, entities: DataFrame) -> DataFrame | None:
    """_r (the target), _title, _old, _by (the source that asked for it); none if no display name is given."""
    titles = plan.where("title is not null").groupBy("into_id").agg(F.max_by("title", "from_id").alias("_title"), F.max("from_id").alias("_by"))
    if not titles.limit(1).count():
        return None
    kind = F.col("type") if "type" in entities.columns else F.lit("")
    same = entities.select(F.col("id").alias("_o"), F.col("name").alias("_on"), kind.alias("_ot"))
    wanted = titles.join(entities.select(F.col("id").alias("_i"), F.col("name").alias("_old"), kind.alias("_t")), F.col("into_id") == F.col("_i")).where("_title <> _old")
    clash = (F.col("_title") == F.col("_on")) & F.col("_t").eqNullSafe(F.col("_ot")) & (F.col("_o") != F.col("into_id"))
    return checkpointed(wanted.join(same, clash, "left_anti").select(F.col("into_id").alias("_r"), "_title", "_old", "_by"))


def merge_entities(entities: DataFrame, claims: DataFrame, mentions: DataFrame, merges: DataFrame, reason: str = "") -> dict[str, DataFrame]:
    """Fold sources into targets (from_id, into_id, optional display_name): the tables afterwards and a manifest.

    Claims and mentions are repointed; a target gains its sources' aliases, then their names, and their acronyms, and
    takes a display name unless another entity of its type has that name, its old one becoming an alias. Sources are
    marked and get the target's page as a redirect; targets' source counts are recomputed. A chain within the plan ends
    in its last target; a merge into itself, a cycle and an unknown entity are errors. acronyms, wiki_path and type
    may be missing from entities. The manifest is taken from the tables as given: write it before they are replaced.
    """
    plan = _merge_plan(entities, merges)
    aliases = _gained(plan, entities, "aliases", F.concat(_strings("aliases"), F.array("name")))
    more = {"aliases": checkpointed(aliases)}
    if "acronyms" in entities.columns:
        more["acronyms"] = checkpointed(_gained(plan, entities, "acronyms", _strings("acronyms")))
    renames = _renames(plan, entities)

    ids = lambda t, name: t.join(plan, t["entity_id"] == plan["from_id"]).groupBy(F.col("from_id").alias(f"_{name}")).agg(F.array_sort(F.collect_set("id")).alias(name))
    manifest = _with(_with(plan, ids(claims, "claims"), "from_id", "_claims"), ids(mentions, "mentions"), "from_id", "_mentions")
    manifest = manifest.join(entities.select(F.col("id").alias("_i"), F.col("status").alias("prior_status"), F.col("name").alias("prior_name")), F.col("from_id") == F.col("_i"))
    for name in ("aliases", "acronyms"):
        manifest = _with(manifest, _in_order(more[name], "from_id", f"{name}_added"), "from_id", "_from_id") if name in more else manifest.withColumn(f"{name}_added", F.lit(None).cast("array<string>"))
    if renames is None:
        manifest = manifest.withColumn("renamed_from", F.lit(None).cast("string"))
    else:
        manifest = manifest.join(renames.select(F.col("_by").alias("_b"), F.col("_old").alias("renamed_from")), F.col("from_id") == F.col("_b"), "left")
    none = F.array().cast("array<long>")
    moved = F.struct(F.coalesce("claims", none).alias("claims"), F.coalesce("mentions", none).alias("mentions"), _strings("aliases_added").alias("aliases_added"), _strings("acronyms_added").alias("acronyms_added"), "renamed_from", "prior_status", "prior_name")
    manifest = manifest.select("from_id", "into_id", F.lit(reason).alias("reason"), moved.alias("moved"))

    to = plan.select(F.col("from_id").alias("_from"), F.col("into_id").alias("_into"))
    repoint = lambda t: t.join(to, F.col("entity_id") == F.col("_from"), "left").withColumn("entity_id", F.coalesce("_into", "entity_id")).drop("_from", "_into")
    new_claims, new_mentions = repoint(claims), repoint(mentions)
    out = entities
    for name, gained in more.items():
        out = _with(out, _in_order(gained, "into_id", f"_new_{name}"), "id", "_into_id").withColumn(name, F.when(F.col(f"_new_{name}").isNull(), F.col(name)).otherwise(F.concat(F.array_distinct(_strings(name)), f"_new_{name}"))).drop(f"_new_{name}")
    if renames is not None:
        out = _with(out, renames.drop("_by"), "id", "_r")
        out = out.withColumns({"aliases": F.when(F.col("_title").isNull(), F.col("aliases")).otherwise(F.array_union(_strings("aliases"), F.array("_old"))), "name": F.coalesce("_title", "name")}).drop("_title", "_old")
    out = out.join(to, F.col("id") == F.col("_from"), "left").withColumn("status", F.when(F.col("_from").isNotNull(), "merged_into").otherwise(F.col("status")))
    if "wiki_path" in entities.columns:
        page = entities.select(F.col("id").alias("_p"), F.col("wiki_path").alias("_page"))
        out = _with(out, page, "_into", "_p").withColumn("wiki_path", F.when(F.col("_from").isNotNull(), F.col("_page")).otherwise(F.col("wiki_path"))).drop("_page")
    return {"entities": recount_sources(out.drop("_from", "_into"), new_mentions, plan.select(F.col("into_id").alias("id"))), "claims": new_claims, "mentions": new_mentions, "manifest": manifest}


def recount_sources(entities: DataFrame, mentions: DataFrame, touched: DataFrame) -> DataFrame:
    """source_count = distinct files that mention it, for the touched entities (id)."""
    ids = touched.select(F.col("id").alias("_t")).distinct()
    n = mentions.join(ids, F.col("entity_id") == F.col("_t"), "left_semi").groupBy("entity_id").agg(F.count_distinct("file_id").cast("int").alias("_n"))
    out = entities.join(n, F.col("id") == F.col("entity_id"), "left").drop("entity_id").join(ids, F.col("id") == F.col("_t"), "left")
    return out.withColumn("source_count", F.when(F.col("_t").isNotNull(), F.coalesce("_n", F.lit(0))).otherwise(F.col("source_count"))).drop("_n", "_t")


def unmerge_entities(entities: DataFrame, claims: DataFrame, mentions: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """The reverse, by rows of the manifest: what moved goes back, and targets lose what the merge had given them.

    Sources get their status again (active if none is known) and no page, since theirs has to be written anew. A row
    without a record of what moved is an error.
    """
    manifest = manifest.where(F.assert_true(F.col("moved").isNotNull(), F.lit("a merge without a record of what moved cannot be undone")).isNull())
    back = lambda t, name: t.join(manifest.select(F.col("from_id").alias("_from"), F.explode(f"moved.{name}").alias("_id")), F.col("id") == F.col("_id"), "left").withColumn("entity_id", F.coalesce("_from", "entity_id")).drop("_from", "_id")
    all_of = lambda name: F.flatten(F.collect_list(_strings(F.col(f"moved.{name}"))))
    lost = manifest.groupBy(F.col("into_id").alias("_t")).agg(all_of("aliases_added").alias("_al"), all_of("acronyms_added").alias("_ac"), F.min_by("moved.renamed_from", F.when(F.col("moved.renamed_from").isNotNull(), F.col("from_id"))).alias("_old"))
    out = _with(entities, lost, "id", "_t")
    gone = F.concat(_strings("_al"), F.when(F.col("_old").isNull(), F.array().cast("array<string>")).otherwise(F.array("_old")))
    kept = lambda c, x: F.when(x.isNull(), F.col(c)).otherwise(F.filter(c, lambda v: ~F.array_contains(x, v)))
    out = out.withColumns({"aliases": kept("aliases", F.when(F.col("_al").isNotNull(), gone)), "name": F.coalesce("_old", "name")})
    if "acronyms" in entities.columns:
        out = out.withColumn("acronyms", kept("acronyms", F.col("_ac")))
    prior = manifest.select(F.col("from_id").alias("_f"), F.coalesce("moved.prior_status", F.lit("active")).alias("_s"))
    out = _with(out.drop("_al", "_ac", "_old"), prior, "id", "_f")
    if "wiki_path" in entities.columns:
        out = out.withColumn("wiki_path", F.when(F.col("_s").isNull(), F.col("wiki_path")))
    out = out.withColumn("status", F.coalesce("_s", "status")).drop("_s")
    new_mentions = back(mentions, "mentions")
    touched = manifest.select(F.explode(F.array("from_id", "into_id")).alias("id"))
    return {"entities": recount_sources(out, new_mentions, touched), "claims": back(claims, "claims"), "mentions": new_mentions}


def clear_synthesis(mentions: DataFrame, claims: DataFrame, claim_sources: DataFrame, reviews: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Everything synthesised from some files (file_id) removed; touched: the entities that lost something."""
    gone = files.select("file_id").distinct()
    lost = claims.join(gone, "file_id", "left_semi")
    touched = lost.select("entity_id").union(mentions.join(gone, "file_id", "left_semi").select("entity_id")).distinct()
    return {
        "mentions": mentions.join(gone, "file_id", "left_anti"), "claims": claims.join(gone, "file_id", "left_anti"),
        "claim_sources": claim_sources.join(lost.select(F.col("id").alias("claim_id")), "claim_id", "left_anti"),
        "reviews": reviews.join(gone, "file_id", "left_anti"), "touched": touched,
    }


def prune_entities(entities: DataFrame, wiki_pages: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Entities (id) marked pruned; their catalog rows go only where the row still belongs to them."""
    dead = ids.select(F.col("id").alias("_d")).distinct()
    marked = entities.join(dead, F.col("id") == F.col("_d"), "left")
    pruned = marked.withColumns({"status": F.when(F.col("_d").isNotNull(), "pruned").otherwise(F.col("status")), "wiki_path": F.when(F.col("_d").isNull(), F.col("wiki_path"))}).drop("_d")
    return {"entities": pruned, "wiki_pages": wiki_pages.join(dead, F.col("entity_id") == F.col("_d"), "left_anti")}


def set_slugs(entities: DataFrame, plan: DataFrame) -> DataFrame:
    """Slug overrides of a plan (id, slug); a null slug clears the override."""
    p = plan.select(F.col("id").alias("_i"), F.col("slug").alias("_s"))
    return entities.join(p, F.col("id") == F.col("_i"), "left").withColumn("slug", F.when(F.col("_i").isNotNull(), F.col("_s")).otherwise(F.col("slug"))).drop("_i", "_s")
