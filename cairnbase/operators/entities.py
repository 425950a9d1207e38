"""Entities: duplicate pairs and bands, co-mentions, provenance, resolution, and repair plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import canonical_display_name, disambiguator, entity_slug, is_pageworthy, merge_key, norm_key, strip_row_label
from ..functions.vectors import cosine
from ..session import stored


def types_compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a == "concept") | (b == "concept")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def duplicate_pairs(entities: DataFrame, threshold: float = DEFAULTS.dup_jaccard, group: str = "type") -> DataFrame:
    """a < b, common, score: entities (id, type, norm_key) of one type whose key tokens have at least this Jaccard.

    An inverted index over the rarest tokens: of a key of n tokens, only the first n - ceil(t * n) + 1 in order of
    rarity can be the sole ones that a similar key shares, so that frequent words never join everything.
    """
    keyed = entities.select("id", group, tokens(F.col("norm_key")).alias("t")).where(F.size("t") > 0)
    each = keyed.select("id", group, "t", F.explode("t").alias("token"))
    often = each.groupBy(group, "token").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("id", group).orderBy("f", "token"))
    prefix = F.size("t") - F.ceil(F.size("t") * threshold - 1e-9) + 1
    index = each.join(often, [group, "token"]).withColumn("r", rank).where(F.col("r") <= prefix).select(group, "token", "id", "t")
    a, b = index.alias("a"), index.alias("b")
    met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")))
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.t").alias("ta"), F.col("b.t").alias("tb")).dropDuplicates(["a", "b"])
    scored = pairs.withColumn("score", jaccard(F.col("ta"), F.col("tb")))
    return scored.where(F.col("score") >= threshold).select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"), "score")


def band(score: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(score >= s.fold_cut, "fold").when(score >= s.tau_low, "judge").otherwise("aside")


def composite(alias: Column, lexical: Column, embed: Column, comention: Column, s: Settings = DEFAULTS) -> Column:
    return F.least(F.lit(1.0), s.weight_alias * alias + s.weight_lexical * lexical + s.weight_embed * F.greatest(F.lit(0.0), embed) + s.weight_comention * comention)


def band_summary(scored: DataFrame, sample: int = 6) -> DataFrame:
    """band, pairs, the best few as a sample."""
    rated = scored.withColumn("band", band(F.col("score")))
    top = rated.withColumn("rn", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("score"), "a", "b")))
    return top.groupBy("band").agg(F.count("*").alias("pairs"), F.array_sort(F.collect_list(F.when(F.col("rn") <= sample, F.struct("rn", "a", "b", "score")))).alias("sample"))


#: Mentions that one task of comentions() takes.
MENTIONS = 200_000


def comentions(mentions: DataFrame, cap: int = DEFAULTS.comention_cap) -> DataFrame:
    """entity_id, other_id, rn: entities that share a chunk; for those with none, that share a file; at most cap each, by first mention.

    Of a chunk only the cap + 1 entities that it mentions first can be among the first cap of any entity: whatever
    comes later in it has cap others before it. So each mention meets a short list, and never all of its chunk. Tasks grow
    in number with the mentions, not in size, and a file is looked at only for entities that no chunk places.
    """
    m = mentions.select("id", "entity_id", "chunk_id", "file_id")
    tasks = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), m.count() // MENTIONS + 1)

    def beside(own: DataFrame, held: DataFrame, key: str) -> DataFrame:
        """entity_id, other_id, id of the short lists of held that own's entities meet at key."""
        firsts = held.where(F.col(key).isNotNull()).select(key, "entity_id", "id").repartition(tasks, key).groupBy(key, "entity_id").agg(F.min("id").alias("id"))
        order = F.row_number().over(Window.partitionBy(key).orderBy("id", "entity_id"))
        short = firsts.withColumn("_place", order).where(F.col("_place") <= cap + 1).select(key, F.col("entity_id").alias("other_id"), "id")
        a = firsts if own is held else own.repartition(tasks, key)
        return a.select("entity_id", key).join(short, key).where("entity_id <> other_id").select("entity_id", "other_id", "id")

    # who shares a chunk with no one is known from the chunks with one entity alone, without the pairs
    in_chunks = m.where(F.col("chunk_id").isNotNull()).select("chunk_id", "entity_id").repartition(tasks, "chunk_id")
    alone = in_chunks.groupBy("chunk_id").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    near = in_chunks.join(alone.where("low < high").select("chunk_id"), "chunk_id", "left_semi").select("entity_id").distinct()
    apart = stored(m.select("entity_id").distinct().join(near, "entity_id", "left_anti"), "unplaced")
    own = m.join(apart, "entity_id", "left_semi").select("entity_id", "file_id").distinct()
    theirs = m.join(own.select("file_id").distinct(), "file_id", "left_semi")
    pairs = beside(m, m, "chunk_id").unionByName(beside(own, theirs, "file_id")).repartition(tasks, "entity_id")
    first = pairs.groupBy("entity_id", "other_id").agg(F.min("id").alias("first"))
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy("first", "other_id"))
    return first.withColumn("rn", rn).where(F.col("rn") <= cap).select("entity_id", "other_id", "rn")


def neighbour_keys(mentions: DataFrame, entities: DataFrame, cap: int = DEFAULTS.comention_cap) -> DataFrame:
    """entity_id, keys: the norm_keys of co-mentioned entities."""
    named = entities.select(F.col("id").alias("other_id"), "norm_key")
    return comentions(mentions, cap).join(named, "other_id").groupBy("entity_id").agg(F.array_sort(F.collect_set("norm_key")).alias("keys"))


def provenance(claims: DataFrame, claim_sources: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """claim_id, sources: distinct sorted 'file p.N', the bare file where the chunk is null or missing."""
    c = claim_sources.select("claim_id", "chunk_id", "file_id")
    pages = chunks.select(F.col("id").alias("_c"), "page")
    names = files.select(F.col("id").alias("_f"), "filename")
    where = c.join(pages, F.col("chunk_id") == F.col("_c"), "left").join(names, F.col("file_id") == F.col("_f"), "left")
    ref = F.when(F.col("page").isNull(), F.col("filename")).otherwise(F.concat("filename", F.lit(" p."), F.col("page").cast("string")))
    found = where.groupBy("claim_id").agg(F.array_sort(F.collect_set(ref)).alias("sources"))
    return claims.select(F.col("id").alias("claim_id")).join(found, "claim_id", "left").select("claim_id", F.array_join(F.coalesce("sources", F.array()), "; ").alias("sources"))


def _by_automaton(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """chunk_id, needle by one pass over each text with an automaton of all needles, which the caller has measured."""
    import ahocorasick

    words = [r["needle"] for r in needles.collect()]  # at most NEEDLE_BYTES
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in sent.value:
            automaton.add_word(word, word)
        if sent.value:
            automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for chunk, text in zip(batch.column("chunk_id").to_pylist(), batch.column("low"), strict=True):
                hits = {word for _, word in automaton.iter(text.as_py() or "")} if sent.value else set()
                ids += [chunk] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["chunk_id", "needle"])

    return texts.select(F.col("chunk_id").cast("long").alias("chunk_id"), "low").mapInArrow(scan, "chunk_id long, needle string")


def _by_grams(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """chunk_id, needle by the postings of three characters: a needle is looked for where its rarest ones occur."""
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))
    grams = lambda c: F.array_distinct(runs(c, 3))
    long, short = needles.where(F.length("needle") >= 3), needles.where(F.length("needle") < 3)
    posting = texts.where(F.length("low") >= 3).select("chunk_id", F.explode(grams(F.col("low"))).alias("gram"))
    often = posting.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = long.select("needle", F.explode(grams(F.col("needle"))).alias("gram")).join(often, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = posting.join(rarest, "gram").select("chunk_id", "needle").join(texts, "chunk_id").where(F.col("low").contains(F.col("needle"))).select("chunk_id", "needle")
    # needles of one or two characters are grams themselves
    units = F.concat(runs(F.col("low"), 1), runs(F.col("low"), 2))
    tiny = texts.where(F.length("low") >= 2).select("chunk_id", F.explode(F.array_distinct(units)).alias("needle")).union(texts.where(F.length("low") == 1).select("chunk_id", F.col("low").alias("needle")))
    return near.union(tiny.join(short, "needle").select("chunk_id", "needle"))


#: Needles up to so many bytes in all are sent to the workers as one automaton.
NEEDLE_BYTES = 1_000_000


def contains_join(chunks: DataFrame, candidates: DataFrame, cap: int = DEFAULTS.provenance_cap, needle_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """candidate_id, chunk_id: chunks whose text contains a candidate's name or an alias, at most cap each in order.

    Distinct needles are measured: up to needle_bytes an automaton of all of them reads each text once; beyond, needles
    meet the postings of the texts. Either way no text is compared with every needle.
    """
    none = F.array().cast("array<string>")
    named = candidates.select(F.col("id").alias("candidate_id"), F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", none)), F.lower))).alias("needle")).where(F.trim("needle") != "")
    needles = named.select("needle").distinct()
    texts = chunks.select(F.col("id").alias("chunk_id"), F.lower("text").alias("low")).where("low is not null")
    small = (needles.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) <= needle_bytes
    found = _by_automaton(texts, needles) if small else _by_grams(texts, needles)
    hits = found.join(named, "needle").select("candidate_id", "chunk_id").distinct()
    rn = F.row_number().over(Window.partitionBy("candidate_id").orderBy("chunk_id"))
    return hits.withColumn("rn", rn).where(F.col("rn") <= cap).drop("rn")


def merge_candidates(extracted: DataFrame, known_keys: DataFrame, windows: int, full_sweep: bool = True, s: Settings = DEFAULTS) -> DataFrame:
    """Candidates merged over windows (window, ord, name, type, aliases, claims): first name, first type that says
    something, all aliases, the first distinct claims; thin ones dropped on a full sweep over enough windows."""
    keyed = extracted.withColumns({"norm_key": norm_key(F.col("name")), "at": F.struct("window", "ord")}).where(F.col("norm_key") != "")
    base = keyed.groupBy("norm_key").agg(
        F.min_by("name", "at").alias("name"),
        F.coalesce(F.min_by("type", F.when(F.col("type") != "concept", F.col("at"))), F.lit("concept")).alias("type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.count_distinct("window").alias("windows_seen"),
    )
    claim = keyed.select("norm_key", "at", F.posexplode("claims").alias("p", "claim")).groupBy("norm_key", "claim").agg(F.min(F.struct("at", "p")).alias("first"))
    rn = F.row_number().over(Window.partitionBy("norm_key").orderBy("first"))
    claims = claim.withColumn("rn", rn).where(F.col("rn") <= s.max_claims).groupBy("norm_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "claim"))), lambda c: c["claim"]).alias("claims"))
    out = base.join(claims, "norm_key", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<string>")))
    if not full_sweep or windows < s.salience_floor:
        return out
    known = known_keys.select("norm_key").distinct().withColumn("_known", F.lit(True))
    thin = F.col("_known").isNull() & (F.col("windows_seen") < s.salience_windows) & (F.size("claims") < s.salience_claims)
    return out.join(known, "norm_key", "left").where(~thin).drop("_known")


def surfaces(name: Column, key: Column, aliases: Column, acronyms: Column) -> Column:
    """All lower-case trimmed forms of an entity."""
    none = F.array().cast("array<string>")
    forms = F.concat(F.array(key, name), F.coalesce(aliases, none), F.coalesce(acronyms, none))
    return F.array_distinct(F.filter(F.transform(forms, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def resolve(candidates: DataFrame, entities: DataFrame, s: Settings = DEFAULTS, keys: DataFrame | None = None, candidate_keys: DataFrame | None = None) -> DataFrame:
    """candidate_id, decision (MATCH, NEW, DEFER), entity_id, score, margin against a frozen set of entities.

    Both sides have id, name, type, norm_key, aliases, acronyms and, if there is an embedder, vector. Blocking: a
    shared surface form within the type or concept, or one of the nearest block_k vectors; then the type gate. The
    neighbour signal compares keys (entity_id, keys) with candidate_keys (candidate_id, keys).
    """
    e = entities.where(F.col("status").isin("active", "unresolved")) if "status" in entities.columns else entities
    has = "vector" in candidates.columns and "vector" in entities.columns
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("norm_key").alias(f"{p}_key"), surfaces(F.col("name"), F.col("norm_key"), F.col("aliases"), F.col("acronyms")).alias(f"{p}_forms"), (F.col("vector") if has else F.lit(None).cast("array<float>")).alias(f"{p}_vec"))
    c, t = side(candidates, "c"), side(e, "e")
    ci = c.select("c_id", "c_type", F.explode("c_forms").alias("form"))
    ei = t.select("e_id", "e_type", F.explode("e_forms").alias("form"))
    blocked = ci.join(ei, "form").where((F.col("e_type") == F.col("c_type")) | (F.col("e_type") == "concept")).select("c_id", "e_id")
    if has:
        from ..functions.vectors import knn_join

        near = knn_join(candidates.select(F.col("id").alias("c_id"), "vector").where("vector is not null"), e.select(F.col("id").alias("e_id"), "vector").where("vector is not null"), s.block_k, "c_id", "e_id")
        blocked = blocked.union(near.select("c_id", "e_id"))
    met = blocked.distinct().join(c, "c_id").join(t, "e_id").where(types_compatible(F.col("c_type"), F.col("e_type")))
    none = F.array().cast("array<string>")
    met = met.join(keys.select(F.col("entity_id").alias("e_id"), F.col("keys").alias("e_near")), "e_id", "left") if keys is not None else met.withColumn("e_near", none)
    met = met.join(candidate_keys.select(F.col("candidate_id").alias("c_id"), F.col("keys").alias("c_near")), "c_id", "left") if candidate_keys is not None else met.withColumn("c_near", none)
    score = composite(
        F.arrays_overlap("c_forms", "e_forms").cast("double"),
        jaccard(tokens(F.col("c_key")), tokens(F.col("e_key"))),
        F.when(F.col("c_vec").isNotNull() & F.col("e_vec").isNotNull(), cosine(F.col("c_vec"), F.col("e_vec"))).otherwise(0.0),
        jaccard(F.coalesce("c_near", none), F.coalesce("e_near", none)),
        s,
    )
    w = Window.partitionBy("c_id").orderBy(F.desc("score"), "e_id")
    ranked = met.withColumn("score", score).withColumns({"rn": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rn = 1")
    best = ranked.select("c_id", "e_id", "score", (F.col("score") - F.coalesce("second", F.lit(0.0))).alias("margin"))
    decision = F.when(F.col("score").isNull() | (F.col("score") < s.tau_low), "NEW").when((F.col("score") >= s.tau_high) & (F.col("margin") >= s.margin), "MATCH").otherwise("DEFER")
    out = candidates.select(F.col("id").alias("candidate_id")).join(best, F.col("candidate_id") == F.col("c_id"), "left")
    return out.select("candidate_id", decision.alias("decision"), F.when(decision != "NEW", F.col("e_id")).alias("entity_id"), "score", "margin")


def best_candidate(unresolved: DataFrame, active: DataFrame, threshold: float = DEFAULTS.dup_jaccard) -> DataFrame:
    """id, candidate_id, score: for each unresolved entity the active one with the most similar key tokens; ties to the lowest id.

    Keys meet on their rarest tokens alone: of n tokens, the first n - ceil(t * n) + 1, one of which any key that is
    similar enough has among its own.
    """
    side = lambda df, name: df.select(F.col("id").alias(name), F.col("type").alias(f"{name}_type"), tokens(F.col("norm_key")).alias(f"{name}_t")).where(F.size(f"{name}_t") > 0)
    u, a = side(unresolved, "id"), side(active, "candidate_id")
    each = u.select(F.explode("id_t").alias("token")).union(a.select(F.explode("candidate_id_t").alias("token")))
    often = each.groupBy("token").agg(F.count("*").alias("f"))

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        n = F.size(f"{name}_t")
        ranked = rows.withColumn("token", F.explode(f"{name}_t")).join(often, "token")
        place = F.row_number().over(Window.partitionBy(name).orderBy("f", "token"))
        return ranked.withColumn("place", place).where(F.col("place") <= n - F.ceil(n * threshold - 1e-9) + 1).drop("f", "place")

    met = prefix(u, "id").join(prefix(a, "candidate_id"), "token").where(types_compatible(F.col("id_type"), F.col("candidate_id_type")) & (F.col("id") != F.col("candidate_id")))
    scored = met.dropDuplicates(["id", "candidate_id"]).withColumn("score", jaccard(F.col("id_t"), F.col("candidate_id_t"))).where(F.col("score") >= threshold)
    return scored.groupBy("id").agg(F.max_by(F.struct("candidate_id", "score"), F.struct("score", -F.col("candidate_id"))).alias("b")).select("id", "b.*")


def with_slugs(entities: DataFrame) -> DataFrame:
    """Adds base_slug and slug (the override if there is one)."""
    return entities.withColumns({"base_slug": entity_slug(F.col("id"), F.col("norm_key")), "slug": entity_slug(F.col("id"), F.col("norm_key"), F.col("slug"))})


def slug_groups(entities: DataFrame, slug: str = "slug") -> DataFrame:
    """slug, n, names: slugs that several active entities share."""
    return entities.where("status = 'active'").groupBy(slug).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names")).where("n > 1")


def _claim_counts(entities: DataFrame, claims: DataFrame) -> DataFrame:
    n = claims.groupBy("entity_id").agg(F.count("*").alias("n_claims"))
    return entities.join(n, F.col("id") == F.col("entity_id"), "left").drop("entity_id").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


_RICHEST = lambda: F.struct("n_claims", "source_count", -F.col("id"))


def collision_plan(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """from_id, into_id, reason: what to do with the entities of each shared slug.

    The survivor is the first that already has the clean title of the group, if it could merge with the richest; else
    the richest, which has the most claims, then sources, then the lowest id. Others merge (reason null) if their key
    is the same but for spaces and underscores and their type is compatible; else they are skipped with a reason.
    """
    rated = stored(_claim_counts(with_slugs(entities).where("status = 'active'"), claims), "collision-candidates")
    capitals = F.regexp_count("name", F.lit(r"\p{Lu}"))
    best = rated.groupBy("slug").agg(F.max_by(F.struct("id", "norm_key", "type"), _RICHEST()).alias("r"), F.max_by("name", F.struct(capitals, -F.col("id"))).alias("spelling"), F.count("*").alias("n")).where("n > 1")
    met = rated.join(best.select("slug", "r", canonical_display_name(F.array("spelling")).alias("clean")), "slug")
    alike = lambda other: (merge_key(F.col("norm_key")) == merge_key(F.col(f"{other}.norm_key"))) & types_compatible(F.col("type"), F.col(f"{other}.type"))
    titled = met.where((F.col("name") == F.col("clean")) & alike("r")).groupBy("slug").agg(F.min_by(F.struct("id", "norm_key", "type"), "id").alias("t"))
    chosen = best.join(titled, "slug", "left").select("slug", F.coalesce("t", "r").alias("s"))
    others = rated.join(chosen, "slug").where(F.col("id") != F.col("s.id"))
    reason = F.when(merge_key(F.col("norm_key")) != merge_key(F.col("s.norm_key")), "distinct keys").when(~types_compatible(F.col("type"), F.col("s.type")), "incompatible types")
    return others.select(F.col("id").alias("from_id"), F.col("s.id").alias("into_id"), "slug", reason.alias("reason"))


def disambiguation_plan(entities: DataFrame) -> DataFrame:
    """id, slug: new slugs for all but the lowest id of each base slug that active entities share."""
    rated = with_slugs(entities).where("status = 'active'")
    w = Window.partitionBy("base_slug")
    marked = rated.withColumns({"n": F.count("*").over(w), "winner": F.min("id").over(w)}).where("n > 1 and id <> winner")
    return marked.select("id", F.concat("base_slug", F.lit("-"), disambiguator(F.col("norm_key"))).alias("slug"))


def relabel_plan(entities: DataFrame, claims: DataFrame, compose: bool = True) -> DataFrame:
    """id, clean, action (fold, rename, prune), into_id for entities whose name begins with a row label.

    A labelled entity folds into the richest active one keyed to its clean name; without one, the richest labelled
    sibling is renamed and the others fold into it; a bare label is pruned.
    """
    rows = _claim_counts(entities.where(F.col("status").isin("active", "unresolved")), claims).withColumn("clean", strip_row_label(F.col("name")))
    labelled = rows.where("clean <> name").withColumn("ck", norm_key(F.col("clean"), compose))
    twins = rows.where("status = 'active'").groupBy(F.col("norm_key").alias("ck")).agg(F.max_by("id", _RICHEST()).alias("twin"))
    richest = F.first_value("id").over(Window.partitionBy("ck").orderBy(F.desc("n_claims"), F.desc("source_count"), "id"))
    placed = labelled.withColumn("sibling", F.when(F.col("clean") != "", richest)).join(twins, "ck", "left")
    action = F.when(F.col("clean") == "", "prune").when(F.col("twin").isNotNull(), "fold").when(F.col("sibling") == F.col("id"), "rename").otherwise("fold")
    into = F.when(F.col("clean") == "", None).when(F.col("twin").isNotNull(), F.col("twin")).when(F.col("sibling") != F.col("id"), F.col("sibling"))
    return placed.select("id", "clean", action.alias("action"), into.alias("into_id"))


def junk(entities: DataFrame) -> DataFrame:
    """Active or unresolved entities whose names are data values."""
    return entities.where(F.col("status").isin("active", "unresolved") & ~is_pageworthy(F.col("name")))


def unattested(entities: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Active entities with neither claim nor mention."""
    on = lambda df: df.select(F.col("entity_id").alias("_e"))
    return entities.where("status = 'active'").join(on(claims), F.col("id") == F.col("_e"), "left_anti").join(on(mentions), F.col("id") == F.col("_e"), "left_anti")


def topic_clusters(mentions: DataFrame, chunks: DataFrame, tops: DataFrame, least: int = DEFAULTS.topic_min_entities, cap: int = DEFAULTS.topic_max_pages) -> DataFrame:
    """top_id, n, entities, rn: entities mentioned under each top-level chapter, the busiest chapters first."""
    placed = mentions.select("entity_id", "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "chapter_id"), "chunk_id").join(tops, F.col("chapter_id") == F.col("id"))
    sets = placed.groupBy("top_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities")).withColumn("n", F.size("entities")).where(F.col("n") >= least)
    return sets.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "top_id"))).where(F.col("rn") <= cap)


def first_claims(claims: DataFrame, n: int = 1, only_active: bool = True) -> DataFrame:
    """entity_id, claim: the first claims of each entity by id."""
    rows = claims.where("status = 'active'") if only_active else claims
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy("id"))
    return rows.withColumn("rn", rn).where(F.col("rn") <= n).select("entity_id", "rn", F.col("text").alias("claim"))
