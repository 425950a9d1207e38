import json

import pytest
from pyspark.sql import functions as F

from cairnbase import schema
from cairnbase.operators import entities as E
from cairnbase.operators.maintenance import Maintenance
from cairnbase.plans.sweep import sweep
from cairnbase.sources import wiki
from cairnbase.sources.wiki_repo import WikiRepo


def tables_of(spark, **rows):
    make = lambda n: spark.createDataFrame([tuple(r.get(f.name) for f in schema.schema(n).fields) for r in rows.get(n, [])], schema.schema(n))
    return {n: make(n) for n in schema.TABLES}


def model(passage):
    if "boom" in passage:
        raise RuntimeError("no answer")
    out = []
    if "Oven" in passage:
        out.append({"name": "Oven", "type": "concept", "claims": ["An oven bakes."], "aliases": ["Baking oven"]})
    if "Yeast" in passage:
        out.append({"name": "Yeast", "type": "concept", "claims": ["Yeast rises.", "Yeast is alive."]})
    return json.dumps({"entities": out})


@pytest.fixture
def base(spark):
    texts = ["The Oven is hot and bakes bread.", "Yeast makes dough rise.", "boom, a window that fails", "Yeast and the Oven together."]
    return tables_of(
        spark,
        files=[dict(id=1, filename="Bread book.pdf", format="pdf", byte_size=2048), dict(id=2, filename="b.pdf", format="pdf")],
        chapters=[dict(id=5, file_id=1, title="Baking", level=1, ord=0), dict(id=6, file_id=1, parent_id=5, title="Dough", level=2, ord=1)],
        chunks=[dict(id=i, file_id=1, chapter_id=5 + i % 2, page=i + 1, ord=i, text=t) for i, t in enumerate(texts)],
        entities=[dict(id=10, name="Oven", type="concept", norm_key="oven", aliases=[], acronyms=[], status="active", source_count=1)],
        mentions=[dict(id=1, file_id=2, entity_id=10), dict(id=2, file_id=1, entity_id=10, chunk_id=3)],
        claims=[dict(id=1, entity_id=10, file_id=2, text="Ovens are old.", status="active"), dict(id=2, entity_id=10, file_id=1, text="stale", status="active")],
        claim_sources=[dict(id=1, claim_id=2, file_id=1)],
    )


def test_sweep_makes_rows_and_is_repeatable(spark, base, tmp_path):
    from cairnbase.config import Settings

    s = Settings(synth_window_chunks=1)
    first = sweep(base, 1, model, s)
    again = sweep(first.tables, 1, model, s)
    for done in (first, again):
        t = done.tables
        assert done.candidates == 2
        told = {(r.text, r.file_id) for r in t["claims"].collect()}
        assert told == {("Ovens are old.", 2), ("An oven bakes.", 1), ("Yeast rises.", 1), ("Yeast is alive.", 1)}
        at = t["mentions"].where("file_id = 1").join(t["entities"].select(F.col("id").alias("entity_id"), "name"), "entity_id")
        assert {(r.name, r.chunk_id) for r in at.collect()} == {("Oven", 0), ("Oven", 3), ("Yeast", 1), ("Yeast", 3)}
        assert t["claim_sources"].join(t["claims"].select(F.col("id").alias("claim_id")), "claim_id", "left_anti").count() == 0
        assert len({r.id for r in t["claims"].collect()}) == 4 and len({r.id for r in t["mentions"].collect()}) == 5
    # a known name alone is half a match: doubtful, so an entity of its own waits with a review
    said = lambda done: sorted((r.mention_surface, r.entity_id) for r in done.tables["entity_review"].collect())
    assert [n for n, _ in said(first)] == ["Oven"] and [n for n, _ in said(again)] == ["Oven", "Yeast"]
    status = {(r.name, r.id > 10): (r.status, r.source_count) for r in first.tables["entities"].collect()}
    assert status == {("Oven", False): ("active", 1), ("Oven", True): ("unresolved", 1), ("Yeast", True): ("active", 1)}
    with pytest.raises(ValueError):
        sweep(first.tables, 1, lambda p: "{}", s)
    kept = Maintenance(again.tables, WikiRepo(spark, str(tmp_path)))
    kept.rewrite(again.touched)
    assert any("Yeast rises." in r.content and "Bread book.pdf p.2" in r.content for r in kept.wiki.pages().collect())


def test_matches_gain_names(spark, base):
    from cairnbase.config import Settings

    done = sweep(base, 1, model, Settings(synth_window_chunks=1, tau_high=0.5, margin=0.1))
    e = {r.name: r for r in done.tables["entities"].collect()}
    assert set(e) == {"Oven", "Yeast"} and "Baking oven" in e["Oven"].aliases and e["Oven"].source_count == 2 and not done.tables["entity_review"].count()


def test_source_and_overview_pages(spark, base):
    ents = [dict(id=i, name=f"E{i}", type="concept", norm_key=f"e{i}", aliases=[], acronyms=[], status="active", source_count=1) for i in range(4)]
    t = tables_of(spark, entities=ents, claims=[dict(id=i, entity_id=i % 2, text=f"c{i}", status="active") for i in range(3)])
    clusters = spark.createDataFrame([(5, [0, 1, 2], 3), (6, [3], 1)], "top_id long, entities array<long>, n int")
    topics = spark.createDataFrame([("topics/bread-book--baking.md",)], "path string")
    page = lambda **more: wiki.source_page(base["files"].where("id = 1"), clusters, base["chapters"], t["entities"], t["claims"], topics, 4, stamp="Synthesized.", **more)
    path, text = page(prose=lambda asked: "A book on E0." if "KEY ENTITIES:\n- [[e0|E0]] (concept): c0" in asked and "- Baking" in asked else "")
    assert path == "sources/bread-book.md" and text == (
        "# Bread book.pdf\n\n> **source** · pdf · 2.0 KB · 1 chapters · 4 entities · ingested unknown\n\nA book on [[e0|E0]].\n\n## Contents\n\n- [[bread-book--baking|Baking]] — 3 entities\n- Dough — 1 entities\n\n"
        "## Key entities\n\n[[e0|E0]] · [[e1|E1]] · [[e2|E2]] · [[e3|E3]]\n\n---\nSynthesized.\n"
    )
    text = page(prose=lambda asked: 1 / 0, most=1, cap=1)[1]
    assert "(+1 more chapters)" in text and "## Key entities\n\n[[e0|E0]]\n" in text and "A book" not in text
    assert wiki.source_page(base["files"].where("id = 1"), clusters.where("false"), base["chapters"], t["entities"], t["claims"], topics, 0) is None
    touched = t["entities"].select("id")
    said = []
    assert wiki.overview_page("# Overview\n\nold", "b.pdf", touched, t["entities"], t["claims"], lambda p: said.append(p) or "New.") == "# Overview\n\nNew.\n"
    assert "old" in said[0] and "It contributed 4 entities" in said[0]
    assert wiki.overview_page("", "b.pdf", touched, t["entities"], t["claims"], lambda p: 1 / 0) is None and wiki.overview_page("", "b", touched, t["entities"], t["claims"], lambda p: " ") is None
    assert E is not None
