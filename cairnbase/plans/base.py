"""A knowledge base: its tables, and the questions that a front end asks of them. Every method returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import human_size
from ..models import hash_embedding
from ..operators import entities as E
from ..operators import ledger, quality, ranking, structure
from . import retrieval


@dataclass
class KnowledgeBase:
    """Tables by the names of cairnbase.schema, plus pages (path, content) of the wiki; absent ones are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    embedder: Callable[[str], list[float]] = hash_embedding

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> KnowledgeBase:
        """Tables written as Parquet under a folder; a table that is not there is empty."""
        found = {}
        for name in (*schema.TABLES, "pages"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        return cls(spark, found)

    def save(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            kind = "path string, content string" if name == "pages" else schema.schema(name)
            self.tables[name] = self.spark.createDataFrame([], kind)
        return self.tables[name]

    def _all(self) -> dict[str, DataFrame]:
        return {n: self[n] for n in (*schema.TABLES, "pages")}

    def stats(self) -> DataFrame:
        image = F.col("format").isin(*ledger.IMAGE_FORMATS)
        one = lambda df, name, c: df.agg(F.lit(name).alias("name"), c.alias("n"))
        out = one(self["files"], "documents", F.count_if(~image)).union(one(self["files"], "images", F.count_if(image)))
        out = out.union(one(self["entities"], "entities", F.count_if(F.col("status") == "active"))).union(one(self["wiki_pages"], "answers", F.count_if(F.col("kind") == "query")))
        out = out.union(one(self["entity_review"], "open_reviews", F.count_if(F.col("state") == "open")))
        for name in ("chapters", "chunks", "links", "figures", "claims", "mentions"):
            out = out.union(one(self[name], name, F.count("*")))
        return out

    def jobs(self) -> DataFrame:
        return ledger.file_states(ledger.progress(self["files"], self["jobs"], ledger.pipeline_table(self.spark)))

    def resync(self) -> DataFrame:
        return ledger.resync_plan(self["files"], self["jobs"], ledger.pipeline_table(self.spark))

    def library(self) -> DataFrame:
        """Documents with their size and counts of chapters and chunks."""
        n = lambda name, c: self[name].groupBy("file_id").agg(F.count("*").alias(c))
        docs = self["files"].where(~F.col("format").isin(*ledger.IMAGE_FORMATS)).select(F.col("id").alias("file_id"), "filename", "content_hash", human_size(F.col("byte_size")).alias("size"))
        return docs.join(n("chapters", "chapters"), "file_id", "left").join(n("chunks", "chunks"), "file_id", "left").fillna(0, ["chapters", "chunks"])

    def wiki(self) -> DataFrame:
        """Active entities by type with claims and sources."""
        c = self["claims"].groupBy("entity_id").agg(F.count("*").alias("claims"))
        e = self["entities"].where("status = 'active'").join(c, F.col("id") == F.col("entity_id"), "left")
        row = F.struct("name", "id", F.coalesce("claims", F.lit(0)).alias("claims"), "source_count")
        return e.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("entities"))

    def source_cards(self) -> DataFrame:
        tops = self["chapters"].where("level = 1").groupBy("file_id").agg(F.count("*").alias("chapters"))
        ents = self["mentions"].groupBy("file_id").agg(F.count_distinct("entity_id").alias("entities"))
        claims = self["claims"].groupBy("file_id").agg(F.count("*").alias("claims"))
        f = self["files"].select(F.col("id").alias("file_id"), "filename")
        return f.join(tops, "file_id", "left").join(ents, "file_id", "left").join(claims, "file_id", "left").fillna(0, ["chapters", "entities", "claims"])

    def search(self, query: str, k: int = 8, mode: str = "hybrid", file_id: int | None = None) -> DataFrame:
        q = query.strip()
        if mode == "keyword" or not q:
            return retrieval.keyword(self._all(), q, k, file_id)
        if mode == "dense":
            return retrieval.dense(self._all(), self.embedder(q), k, file_id, q)
        return retrieval.hybrid(self._all(), q, self.embedder(q), k, file_id)

    def gallery(self, where, limit: int = 50) -> DataFrame:
        hits = retrieval.list_images(self._all(), where, limit).join(self["images"].select("file_id", "cluster_id"), "file_id")
        return ranking.gallery(hits.withColumns({"rank": F.row_number().over(Window.orderBy("file_id")), "kb": F.floor(F.col("byte_size") / 1024)}))

    def ask(self, question: str, chat: Callable, **more) -> retrieval.Answer:
        return retrieval.answer(self._all(), question, self.embedder(question), chat, **more)

    def entity(self, entity_id: int) -> DataFrame:
        """One row: the entity with its claims, their sources, and the entities mentioned beside it."""
        e = self["entities"].where(F.col("id") == entity_id)
        claims = self["claims"].where(F.col("entity_id") == entity_id)
        told = E.provenance(claims, self["claim_sources"], self["chunks"], self["files"]).join(claims.select(F.col("id").alias("claim_id"), "text", "status"), "claim_id")
        lists = told.agg(F.array_sort(F.collect_list(F.struct("claim_id", "text", "status", "sources"))).alias("claims")).withColumn("_k", F.lit(entity_id))
        near = E.comentions(self["mentions"]).where(F.col("entity_id") == entity_id).join(self["entities"].select(F.col("id").alias("other_id"), F.col("name").alias("other")), "other_id")
        beside = near.agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other"))), lambda x: x["other"]).alias("related")).withColumn("_r", F.lit(entity_id))
        names = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) != F.lower(F.col("name")))
        return e.join(lists, F.col("id") == F.col("_k")).join(beside, F.col("id") == F.col("_r")).select("id", "name", "type", names.alias("aliases"), "claims", "related")

    def source(self, file_id: int) -> DataFrame:
        """Entities of a file under each of its top-level chapters, the busiest first."""
        chapters = self["chapters"].where(F.col("file_id") == file_id)
        tops = structure.top_level(chapters.select("id", "parent_id"))
        return E.topic_clusters(self["mentions"].where(F.col("file_id") == file_id), self["chunks"].where(F.col("file_id") == file_id), tops, least=1)

    def outline(self, file_id: int, depth: int = 99) -> DataFrame:
        """Chapters of a file in order, with their first chunk and neighbours."""
        first = self["chunks"].where(F.col("file_id") == file_id).groupBy("chapter_id").agg(F.min_by("id", "ord").alias("first_chunk"))
        c = structure.neighbours(self["chapters"].where(F.col("file_id") == file_id), "file_id", "ord", "id")
        return c.where(F.col("level") <= depth).join(first, F.col("id") == F.col("chapter_id"), "left").drop("chapter_id").orderBy("ord")

    def chapter(self, chapter_id: int) -> DataFrame:
        return self["chunks"].where(F.col("chapter_id") == chapter_id).orderBy("ord")

    def related(self, chapter_id: int) -> DataFrame:
        """Chapters that relations join to this one, whichever end they name first; the best score of each."""
        r = self["relations"]
        both = r.where(F.col("src_chapter_id") == chapter_id).select(F.col("dst_chapter_id").alias("target"), "score").union(r.where(F.col("dst_chapter_id") == chapter_id).select("src_chapter_id", "score"))
        best = both.where(F.col("target").isNotNull() & (F.col("target") != chapter_id)).groupBy("target").agg(F.max("score").alias("score"))
        return best.join(self["chapters"].select(F.col("id").alias("target"), "title", "file_id"), "target", "left").orderBy(F.desc("score"), "target")

    def lint(self) -> DataFrame:
        return quality.by_kind(quality.lint(self._all() | {"reviews": self["entity_review"]}))

    def audit(self) -> DataFrame:
        return quality.by_kind(quality.audit(self._all()))

    def collisions(self) -> DataFrame:
        return E.collision_plan(self["entities"], self["claims"])

    def disambiguations(self) -> DataFrame:
        return E.disambiguation_plan(self["entities"])

    def relabels(self) -> DataFrame:
        return E.relabel_plan(self["entities"], self["claims"])

    def duplicates(self) -> DataFrame:
        return E.band_summary(E.duplicate_pairs(self["entities"].where("status = 'active'")))

    def compare(self, a: int, b: int) -> dict:
        return retrieval.compare_pair(self._all(), a, b)

    def rebuild_index(self) -> None:
        """Text and caption vectors anew from chunks and captions; other indexes stay."""
        from ..models import embed

        texts = embed(self["chunks"].select(F.col("id").alias("chunk_id"), "file_id", "chapter_id", "page", "text"), "text", self.embedder)
        self.tables["vec_text"] = texts.where("vector is not null").drop("text")
        captions = embed(self["images"].where("trim(vlm_description) <> ''").select("file_id", "vlm_description"), "vlm_description", self.embedder)
        self.tables["vec_captions"] = captions.drop("vlm_description")

    def keep(self, entity_id: int) -> None:
        """An unresolved entity becomes active; any other is left alone."""
        self._set_status(entity_id, "unresolved", "active")

    def reopen(self, entity_id: int) -> None:
        self._set_status(entity_id, "active", "unresolved")

    def _set_status(self, entity_id: int, before: str, after: str) -> None:
        from ..operators.mutate import set_where

        self.tables["entities"] = set_where(self["entities"], (F.col("id") == entity_id) & (F.col("status") == before), status=F.lit(after))

    def topics(self, file_id: int, least: int = 5) -> DataFrame:
        """path, content of the topic pages of a file."""
        from ..sources.wiki import topic_pages

        tops = structure.top_level(self["chapters"].where(F.col("file_id") == file_id).select("id", "parent_id"))
        clusters = E.topic_clusters(self["mentions"].where(F.col("file_id") == file_id), self["chunks"].where(F.col("file_id") == file_id), tops, least=least)
        return topic_pages(clusters, self["chapters"], self["files"], self["entities"], self["claims"])

    def recent_merges(self) -> DataFrame:
        """Merges of the latest batch that can be undone."""
        m = self["entity_merges"].where("committed_sha is not null and moved is not null")
        last = m.agg(F.max_by("committed_sha", "id").alias("_sha"))
        return m.join(F.broadcast(last), F.col("committed_sha") == F.col("_sha")).drop("_sha").orderBy(F.desc("id"))
