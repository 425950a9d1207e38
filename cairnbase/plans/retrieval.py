"""Composite retrieval: dense, hybrid and image search, wiki pages, and answers with citations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import is_noise
from ..functions.vectors import cosine
from ..models import rerank_logits
from ..operators import entities as E
from ..operators import ranking

REFUSAL = "I don't find anything about that in the indexed documents."
HIT = ("key", "kind", "chunk_id", "file_id", "file", "chapter", "page", "text", "score", "cluster_id")


def _near(vectors: DataFrame, query: list[float], k: int, key: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("_sim", cosine(F.col("vector"), q)).orderBy(F.desc("_sim"), key).limit(k)


def chunk_hits(rows: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Chunk rows (id, file_id, chapter_id, page, text, score) with file and chapter names; '?' for a missing file."""
    f = t["files"].select(F.col("id").alias("_f"), F.col("filename"))
    c = t["chapters"].select(F.col("id").alias("_c"), F.col("title"))
    met = rows.join(f, F.col("file_id") == F.col("_f"), "left").join(c, F.col("chapter_id") == F.col("_c"), "left")
    return met.select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("key"), F.lit("text").alias("kind"), F.col("id").alias("chunk_id"), "file_id",
        F.coalesce("filename", F.lit("?")).alias("file"), F.col("title").alias("chapter"), "page", "text", "score", F.lit(None).cast("long").alias("cluster_id"),
    )


def image_hits(rows: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Caption rows (file_id, score) with their file, which must exist, and image, which need not."""
    f = t["files"].select(F.col("id").alias("_f"), F.col("filename"))
    i = t["images"].select(F.col("file_id").alias("_i"), "vlm_description", F.col("cluster_id").alias("_k"))
    met = rows.join(f, F.col("file_id") == F.col("_f")).join(i, F.col("file_id") == F.col("_i"), "left")
    none = F.lit(None)
    return met.select(
        F.concat(F.lit("i"), F.col("file_id").cast("string")).alias("key"), F.lit("image").alias("kind"), none.cast("long").alias("chunk_id"), "file_id", F.col("filename").alias("file"),
        none.cast("string").alias("chapter"), none.cast("int").alias("page"), F.coalesce("vlm_description", F.lit("")).alias("text"), "score", F.col("_k").alias("cluster_id"),
    )


def _ranked(hits: DataFrame, k: int, *order) -> DataFrame:
    w = Window.orderBy(*order)
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(w))


def _deduped(hits: DataFrame, k: int) -> DataFrame:
    one = ranking.dedupe_clusters(hits)
    return one.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= k)


def keyword(t: dict[str, DataFrame], query: str, k: int = 8, file_id: int | None = None) -> DataFrame:
    """Lexical search over chunks, and captions if no file is asked for; captions are not noise-filtered."""
    chunks = t["chunks"] if file_id is None else t["chunks"].where(F.col("file_id") == file_id)
    text = chunk_hits(chunks.where(~is_noise(F.col("text"))).withColumn("score", F.lit(0.0)), t)
    both = text if file_id is not None else text.unionByName(image_hits(t["images"].select("file_id", F.lit(0.0).alias("score")), t))
    return _deduped(ranking.keyword_search(both.drop("score"), query, k + 8, key=("key",), drop_noise=False).select(*HIT, "rank"), k)


def dense(t: dict[str, DataFrame], query: list[float], k: int = 8, file_id: int | None = None, question: str = "", scorer: Callable | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Nearest chunks and captions by cosine; a cross-encoder, if there is one, reorders the pool."""
    pool = max(k, s.rerank_candidates) if scorer else k
    v = t["vec_text"] if file_id is None else t["vec_text"].where(F.col("file_id") == file_id)
    near = _near(v, query, pool, "chunk_id").select("chunk_id", F.round("_sim", 4).alias("score"))
    text = chunk_hits(near.join(t["chunks"], F.col("chunk_id") == F.col("id")), t)
    both = text if file_id is not None else text.unionByName(image_hits(_near(t["vec_captions"], query, pool, "file_id").select("file_id", F.round("_sim", 4).alias("score")), t))
    if not scorer:
        return _deduped(_ranked(both, pool, F.desc("score"), "key"), k)
    rated = ranking.rerank(rerank_logits(both, question, "text", scorer), F.col("logit"), pool, "key")
    return _deduped(_ranked(rated.drop("logit"), pool, F.desc("rerank_score"), "key"), k)


def hybrid(t: dict[str, DataFrame], question: str, query: list[float], k: int = 8, file_id: int | None = None, scorer: Callable | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Lexical and dense lists fused by reciprocal rank; noise goes after the cut, so fewer than k may remain."""
    pool = max(s.rerank_candidates, k)
    words, near = keyword(t, question, pool, file_id), dense(t, query, pool, file_id, s=s)
    arm = lambda h, name: h.select("key", "rank", F.lit(name).alias("arm"))
    fused = ranking.rrf(arm(words, "keyword").unionByName(arm(near, "semantic")), item="key", k=s.rrf_k).withColumnRenamed("score", "_fused")
    top = fused.orderBy(F.desc("_fused"), "key").limit(pool)
    rows = words.select(*HIT).unionByName(near.select(*HIT)).dropDuplicates(["key"]).drop("score")
    met = rows.join(top, "key").where((F.col("kind") == "image") | ~is_noise(F.col("text"))).withColumn("score", F.round("_fused", 4))
    if scorer:
        met = ranking.rerank(rerank_logits(met, question, "text", scorer), F.col("logit"), pool, "key").drop("logit")
    return _deduped(_ranked(met, pool, F.desc("rerank_score" if scorer else "_fused"), "key").drop("_fused"), k)


def find_images(t: dict[str, DataFrame], query: list[float], where, k: int = 24) -> DataFrame:
    """Nearest images among those that a typed filter keeps."""
    near = _near(t["vec_images"].where(where), query, k, "file_id").select("file_id", F.round("_sim", 4).alias("score"))
    return _ranked(image_hits(near, t), k, F.desc("score"), "key")


def list_images(t: dict[str, DataFrame], where, limit: int = 50) -> DataFrame:
    """Images by filter alone, by file."""
    i = t["images"].select("file_id", "geo_country", F.unix_timestamp("exif_datetime").alias("exif_ts"))
    f = t["files"].select(F.col("id").alias("file_id"), "filename", "format", "byte_size")
    return i.join(f, "file_id").where(where).orderBy("file_id").limit(limit)


def wiki_pages(t: dict[str, DataFrame], query: list[float], k: int = 6, least: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Active entities with active claims whose name is near enough, with claims and provenance."""
    near = _near(t["vec_entities"], query, max(3 * k, s.rerank_candidates), "entity_id").select("entity_id", F.round("_sim", 4).alias("score")).where(F.col("score") >= (s.page_min_score if least is None else least))
    one = near.groupBy("entity_id").agg(F.max("score").alias("score"))
    active = t["claims"].where("status = 'active'").join(one, "entity_id", "left_semi")
    told = E.provenance(active, t["claim_sources"], t["chunks"], t["files"]).join(active.select(F.col("id").alias("claim_id"), "entity_id", "text"), "claim_id")
    lists = told.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text", "sources"))).alias("claims"))
    named = t["entities"].where("status = 'active'").select(F.col("id").alias("entity_id"), "name", "type", "wiki_path")
    return _ranked(one.join(named, "entity_id").join(lists, "entity_id"), k, F.desc("score"), "entity_id")


@dataclass
class Answer:
    text: str
    citations: list
    pages: list


def answer(t: dict[str, DataFrame], question: str, query: list[float], chat: Callable[[list[dict]], str], k_pages: int = 4, k_chunks: int = 8, file_id: int | None = None, scorer: Callable | None = None, typeset: Callable[[str, str], str] | None = None, s: Settings = DEFAULTS) -> Answer:
    """Wiki-first answer: pages and passages above their relevance floors, then the model; nothing relevant, a refusal."""
    hits = dense(t, query, k_chunks, file_id, question, scorer, s)
    score = F.col("rerank_score") if scorer else F.col("score")
    chunks = ranking.relevance_floor(hits, s.relevance_ratio, s.relevance_min, True, by=score).orderBy("rank").collect()
    pages = ranking.relevance_floor(wiki_pages(t, query, k_pages, s=s), s.relevance_ratio, s.relevance_min, False, by=F.col("score")).orderBy("rank").collect()
    if not chunks and not pages:
        return Answer(REFUSAL, [], [])
    facts = [f"[W{i}] {p['name']}: " + " ".join(c["text"] for c in p["claims"]) for i, p in enumerate(pages, 1)]
    blocks = [f"[{i}] {h['file']}" + (f" p.{h['page']}" if h["page"] is not None else "") + f"\n{h['text']}" for i, h in enumerate(chunks, 1)]
    draft = chat([{"role": "system", "content": "Answer from the numbered context only, and cite it."}, {"role": "user", "content": "\n\n".join([*facts, *blocks, f"Question: {question}"])}])
    if typeset is not None:
        try:
            draft = typeset(question, draft) or draft
        except Exception:  # noqa: BLE001  layout is optional: the draft stands
            pass
    return Answer(draft, chunks, pages)


def similar_question(t: DataFrame, query: list[float], threshold: float = DEFAULTS.query_dup_threshold) -> DataFrame:
    """The filed question nearest to a new one, if it is near enough to be judged the same."""
    return _near(t, query, 1, "path").where(F.col("_sim") >= threshold).withColumnRenamed("_sim", "sim")


def locate_page(pages: DataFrame, text: str) -> DataFrame:
    """The page of a rendered file that has the most lines of a chunk; ties to the first."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    found = sum((F.col("text").contains(x).cast("int") for x in lines), F.lit(0))
    return pages.withColumn("hits", found).where("hits > 0").orderBy(F.desc("hits"), "page").limit(1)


def compare_pair(t: dict[str, DataFrame], a: int, b: int, evidence: int = 3, s: Settings = DEFAULTS) -> dict:
    """Score, band and passages of evidence for two entities."""
    from ..functions.text import evidence_window

    e = t["entities"].where(F.col("id").isin(a, b))
    pair = E.duplicate_pairs(e.withColumn("type", F.lit("x")), 0.01).head()
    lexical = pair["score"] if pair else 0.0
    keys = {r["entity_id"]: set(r["keys"]) for r in E.neighbour_keys(t["mentions"], t["entities"]).where(F.col("entity_id").isin(a, b)).collect()}
    near, both = keys.get(a, set()) & keys.get(b, set()), keys.get(a, set()) | keys.get(b, set())
    rows = {r["id"]: r for r in e.collect()}
    forms = lambda r: {x.lower() for x in [r["name"], r["norm_key"], *(r["aliases"] or [])]}
    alias = float(bool(forms(rows[a]) & forms(rows[b])))
    score = min(1.0, s.weight_alias * alias + s.weight_lexical * lexical + s.weight_comention * (len(near) / len(both) if both else 0.0))
    first = t["mentions"].where(F.col("entity_id").isin(a, b) & F.col("chunk_id").isNotNull()).groupBy("entity_id", "chunk_id").agg(F.min("id").alias("m"))
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy("m"))
    picked = first.withColumn("rn", rn).where(F.col("rn") <= evidence).join(t["chunks"].select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    names = e.select(F.col("id").alias("entity_id"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("needles"))
    shown = picked.join(names, "entity_id").select("entity_id", "rn", evidence_window(F.col("text"), F.col("needles")).alias("passage"))
    return {"score": round(score, 4), "band": "fold" if score >= s.fold_cut else "judge" if score >= s.tau_low else "aside", "evidence": shown.orderBy("entity_id", "rn").collect()}
