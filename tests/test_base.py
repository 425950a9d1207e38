import pytest
from pyspark.sql import functions as F

from cairnbase import __main__ as cli
from cairnbase import schema
from cairnbase.models import hash_embedding
from cairnbase.operators.filters import image_filter
from cairnbase.plans import retrieval
from cairnbase.plans.base import KnowledgeBase


@pytest.fixture(scope="module")
def base(spark):
    make = lambda name, rows: spark.createDataFrame(rows, schema.schema(name))
    texts = ["Bake the cake 30 min in a hot oven.", "The oven must be clean.", "Unrelated words about rivers."]
    none = None
    t = {
        "files": make("files", [(1, "h1", "/a", "a.pdf", "pdf", "x", 3000, none, none), (2, "h2", "/b", "b.png", "png", "x", 5000, none, none), (3, "h3", "/c", "c.png", "png", "x", 6000, none, none)]),
        "chapters": make("chapters", [(10, 1, none, 1, 0, "Cakes", 1, 2, "outline"), (11, 1, 10, 2, 1, "Oven", 2, 2, "outline"), (12, 1, none, 1, 2, "Rivers", 3, 3, "outline")]),
        "chunks": make("chunks", [(i, 1, 10 + i, i + 1, i, x, len(x)) for i, x in enumerate(texts)]),
        "images": make("images", [(1, 2, 1, 1, "A cat wearing red headphones.", none, none, none, none, none, none, none, 2), (2, 3, 1, 1, "A cat. A cat wearing red headphones.", none, none, none, none, none, none, none, 2)]),
        "vec_text": make("vec_text", [(i, 1, 10, 1, hash_embedding(x)) for i, x in enumerate(texts)]),
        "vec_captions": make("vec_captions", [(2, hash_embedding("A cat wearing red headphones."))]),
        "vec_images": make("vec_images", [(2, "png", 5000, "CA", 1, hash_embedding("cat")), (3, "png", 6000, "US", 1, hash_embedding("cat"))]),
        "vec_entities": make("vec_entities", [(100, "product", hash_embedding("cake oven")), (100, "product", hash_embedding("cake"))]),
        "entities": make("entities", [(100, "Cake", "product", "cake", ["cake", "Torte"], [], "entities/cake.md", none, "active", 1), (101, "Oven", "product", "oven", [], [], none, none, "active", 1)]),
        "claims": make("claims", [(1000, 100, none, 1, "Bake 30 min.", "active", 1.0, none)]),
        "claim_sources": make("claim_sources", [(1, 1000, 0, 1)]),
        "mentions": make("mentions", [(1, 1, 0, 100, none, none, none), (2, 1, 0, 101, none, none, none)]),
        "relations": make("relations", [(1, "semantic", 10, none, 12, 1, 1, 0.8), (2, "semantic", 12, none, 10, 1, 1, 0.9)]),
    }
    return KnowledgeBase(spark, t)


def test_search_modes(base):
    assert [r["chunk_id"] for r in base.search("clean oven", mode="keyword").orderBy("rank").collect()] == [1, 0]
    assert base.search("clean oven", mode="dense").orderBy("rank").head()["chunk_id"] == 1
    top = base.search("clean oven").orderBy("rank").head()
    assert top["chunk_id"] == 1 and top["source"] == "both"
    assert base.search("", mode="hybrid").count() == 0


def test_images_are_searched_once_for_each_cluster(base):
    hits = base.search("cat", mode="keyword").collect()
    assert [(r["kind"], r["file_id"]) for r in hits] == [("image", 2)]
    assert base.search("cat", mode="keyword", file_id=1).count() == 0
    found = retrieval.find_images(base._all(), hash_embedding("cat"), image_filter(country="US")).collect()
    assert [r["file_id"] for r in found] == [3]
    assert [(r["file_id"], r["dups"]) for r in base.gallery(image_filter(fmt="png")).collect()] == [(2, 1)]


def test_reranking(base):
    hits = retrieval.dense(base._all(), hash_embedding("oven"), 2, question="q", scorer=lambda q, ts: [5.0 if "rivers" in x else 0.0 for x in ts]).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == 2 and hits[0]["rerank_score"] == 0.9933


def test_answers(base):
    said = []
    out = base.ask("clean oven cake", lambda m: said.append(m) or "It is so [1].")
    assert out.text == "It is so [1]." and out.pages[0]["name"] == "Cake" and out.pages[0]["claims"][0]["sources"] == "a.pdf p.1"
    assert "Bake 30 min." in said[0][1]["content"]
    assert base.ask("x", lambda m: "draft", typeset=lambda q, d: 1 / 0).text in ("draft", retrieval.REFUSAL)


def test_profiles(base):
    e = base.entity(100).head()
    assert e["aliases"] == ["Torte"] and e["related"] == ["Oven"] and e["claims"][0]["sources"] == "a.pdf p.1"
    assert [(r["top_id"], r["entities"]) for r in base.source(1).collect()] == [(10, [100, 101])]
    assert [(r["id"], r["prev"], r["next"], r["first_chunk"]) for r in base.outline(1).collect()] == [(10, None, 11, 0), (11, 10, 12, 1), (12, 11, None, 2)]
    assert [(r["target"], r["score"]) for r in base.related(10).collect()] == [(12, 0.9)]
    assert base.chapter(10).count() == 1


def test_catalogue(base):
    n = {r["name"]: r["n"] for r in base.stats().collect()}
    assert (n["documents"], n["images"], n["entities"], n["chunks"], n["open_reviews"]) == (1, 2, 2, 3, 0)
    lib = base.library().head()
    assert (lib["filename"], lib["chapters"], lib["chunks"], lib["size"]) == ("a.pdf", 3, 3, "2.9 KB")
    assert base.wiki().head()["n"] == 2 and base.source_cards().where("file_id = 1").head()["entities"] == 2
    assert {r["state"] for r in base.jobs().collect()} == {"pending"} and base.resync().count() == 11 + 9 * 2
    assert {r["kind"] for r in base.lint().collect()} >= {"deleted_page", "orphan"} and base.audit().count() == 0
    assert base.collisions().count() == base.relabels().count() == base.duplicates().count() == base.recent_merges().count() == base.disambiguations().count() == 0


def test_compare_and_locate(base, spark):
    got = base.compare(100, 101)
    assert got["band"] == "aside" and {r["entity_id"] for r in got["evidence"]} == {100, 101}
    pages = spark.createDataFrame([(1, "one two"), (2, "two three")], "page int, text string")
    assert retrieval.locate_page(pages, "two\nthree").head()["page"] == 2
    filed = spark.createDataFrame([("q.md", hash_embedding("how to bake"))], "path string, vector array<float>")
    assert retrieval.similar_question(filed, hash_embedding("how to bake")).count() == 1
    assert retrieval.similar_question(filed, hash_embedding("rivers")).count() == 0


def test_pages_and_index(base, spark):
    from cairnbase.sources import wiki

    page = base.topics(1, least=1).head()
    assert page["path"] == "topics/a--cakes.md" and "- [[cake|Cake]] — Bake 30 min." in page["content"]
    there = spark.createDataFrame([("topics/a--cakes.md", ""), ("topics/a--old.md", "")], "path string, content string")
    assert [r["path"] for r in wiki.stale_topics(base.topics(1, least=1), there, "a").collect()] == ["topics/a--old.md"]
    made = wiki.entity_pages(base["entities"], base["claims"], spark.createDataFrame([(1000, "a.pdf p.1")], "claim_id long, sources string"))
    assert {r["path"] for r in wiki.missing_files(made, there).collect()} == {"entities/cake.md", "entities/oven.md"}
    assert "_(source: a.pdf p.1)_" in made.where("path like '%cake%'").head()["content"]
    assert "[[cake|Cake]]" in wiki.index_page(base["entities"]).head()["content"]
    new = KnowledgeBase(spark, dict(base.tables))
    new.rebuild_index()
    assert new["vec_text"].count() == 3 and new["vec_captions"].count() == 2
    new.reopen(100)
    new.keep(101)
    assert {r["id"]: r["status"] for r in new["entities"].collect()} == {100: "unresolved", 101: "active"}


def test_round_trip_and_command_line(base, tmp_path, capsys):
    base.save(str(tmp_path))
    again = KnowledgeBase.load(base.spark, str(tmp_path))
    assert again["claims"].count() == 1 and again["jobs"].count() == 0
    assert cli.main([str(tmp_path), "stats"]) == 0 and "documents" in capsys.readouterr().out
    assert cli.main([str(tmp_path), "nonsense"]) == 2 and cli.main([]) == 2
    assert F is not None
