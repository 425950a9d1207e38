import pytest
from pyspark.sql import functions as F

from cairnbase import schema
from cairnbase.operators import maintenance as M
from cairnbase.sources.wiki_repo import WikiRepo


def row(table, **fields):
    return tuple(fields.get(f.name) for f in schema.schema(table).fields)


def base(spark, entities, claims=(), mentions=(), pages=()):
    """A knowledge base: entities (id, name, key, type, status, sources); claims and mentions (id, entity, file); pages (path, entity)."""
    make = lambda name, rows: spark.createDataFrame([row(name, **r) for r in rows], schema.schema(name))
    tables = {
        "entities": make("entities", [dict(id=i, name=n, norm_key=k, type=t, status=s, source_count=c, aliases=[], acronyms=[], wiki_path=None) for i, n, k, t, s, c in entities]),
        "claims": make("claims", [dict(id=i, entity_id=e, file_id=f, text=f"claim {i}", status="active") for i, e, f in claims]),
        "mentions": make("mentions", [dict(id=i, entity_id=e, file_id=f) for i, e, f in mentions]),
        "wiki_pages": make("wiki_pages", [dict(id=i, path=p, entity_id=e, kind="entity") for i, (p, e) in enumerate(pages, 1)]),
        "files": make("files", [dict(id=i, filename=f"f{i}.pdf") for i in range(1, 4)]),
        "vec_entities": spark.createDataFrame([(e[0], e[3], [1.0]) for e in entities], schema.schema("vec_entities")),
    }
    return tables | {n: make(n, []) for n in ("entity_merges", "claim_sources", "chunks", "entity_review")}


def embed(rows):
    return rows.withColumn("vector", F.array(F.length("name").cast("float")))


def people(m):
    return {r.id: r for r in m.tables["entities"].collect()}


ENTITIES = [(1, "channel_map", "channel_map", "concept", "active", 1), (2, "Channel Map", "channel map", "concept", "active", 1), (3, "channel_Map", "channel map", "device", "active", 1), (4, "c t+1", "c[t+1", "concept", "active", 1), (5, "c t", "c t 1", "concept", "active", 3)]
CLAIMS = [(10, 1, 1), (11, 1, 2), (12, 2, 1), (13, 5, 3)]
MENTIONS = [(20, 1, 1), (21, 2, 2), (22, 3, 3), (23, 3, 3)]


@pytest.fixture
def keeper(spark, tmp_path):
    return M.Maintenance(base(spark, ENTITIES, CLAIMS, MENTIONS), WikiRepo(spark, str(tmp_path / "wiki")), embed)


def test_collisions_merge_into_the_clean_title_and_undo(keeper):
    keeper.rewrite(keeper.tables["entities"])
    start, before = keeper.wiki.head(), people(keeper)
    handle = keeper.merge_collisions()
    now = people(keeper)
    # 2 has the clean title already, although 1 is richer; 4 and 5 differ in more than spaces
    assert {i: r.status for i, r in now.items()} == {1: "merged_into", 2: "active", 3: "merged_into", 4: "active", 5: "active"}
    assert now[2].name == "Channel Map" and now[2].aliases == ["channel_map", "channel_Map"] and now[2].source_count == 3
    assert now[1].wiki_path == now[3].wiki_path == now[2].wiki_path == "entities/channel-map.md"
    pages = {r.path: r.content for r in keeper.wiki.pages().collect()}
    assert pages["entities/channel-map.md"].startswith("# Channel Map\n") and "claim 10" in pages["entities/channel-map.md"] and "claim 12" in pages["entities/channel-map.md"]
    assert "channel-map|Channel Map" in pages["index.md"] and {r.committed_sha for r in keeper.tables["entity_merges"].collect()} == {handle}
    assert sorted(r.entity_id for r in keeper.tables["vec_entities"].collect()) == [2, 4, 5]
    assert keeper.merge_collisions() is None
    keeper.undo(handle)
    again = people(keeper)
    assert {i: (r.name, r.status, r.aliases) for i, r in again.items()} == {i: (r.name, r.status, r.aliases) for i, r in before.items()}
    assert sorted(r.entity_id for r in keeper.tables["vec_entities"].collect()) == [1, 2, 3, 4, 5] and not keeper.tables["entity_merges"].count()
    hashes = lambda h=None: {r.path: r["hash"] for r in keeper.wiki.hashes(h).collect()}
    old, new = hashes(start), hashes()
    assert old == new
    assert keeper.undo("nothing") is None


def test_merge_leaves_a_redirect_at_another_slug(spark, tmp_path):
    m = M.Maintenance(base(spark, [(1, "One", "one", "a", "active", 1), (2, "Two", "two", "a", "active", 1), (3, "Three", "three", "a", "unresolved", 0)], [(1, 2, 1), (2, 2, 2), (3, 2, 2)]), WikiRepo(spark, str(tmp_path)), embed)
    assert m.fold_pair(1, 3) is None and m.fold_into(1, 2, "no") is None and m.fold_pair(2, 2) is None
    first = m.fold_pair(1, 2)
    second = m.fold_into(3, 2, "the same")
    pages = {r.path: r.content for r in m.wiki.pages().collect()}
    assert pages["entities/one.md"] == "# One\n\n> merged\n\nMerged into [[two|Two]].\n" and "[[two|Two]]" in pages["entities/three.md"]
    assert {i: r.status for i, r in people(m).items()} == {1: "merged_into", 2: "active", 3: "merged_into"}
    m.undo(second)
    assert {i: r.status for i, r in people(m).items()} == {1: "merged_into", 2: "active", 3: "unresolved"}
    m.undo(first)
    assert {i: r.status for i, r in people(m).items()} == {1: "active", 2: "active", 3: "unresolved"}
    pages = {r.path: r.content for r in m.wiki.pages().collect()}
    assert pages["entities/one.md"].startswith("# One\n\n> a") and [r.message for r in m.wiki.log().orderBy("number").collect()] == ["duplicates: confirmed same", "the same", f"undo {second[:12]}", f"undo {first[:12]}"]


def test_relabels_rename_fold_and_prune(spark, tmp_path):
    rows = [(1, "T_ID 4 - Clock", "t id 4 clock", "a", "active", 1), (2, "T_ID 5 - Clock", "t id 5 clock", "a", "active", 0), (3, "T_ID 9", "t id 9", "a", "active", 0), (4, "T_ID 1 - Known", "t id 1 known", "a", "active", 0), (5, "Known", "known", "a", "active", 1), (6, "Plain", "plain", "a", "active", 0)]
    m = M.Maintenance(base(spark, rows, [(1, 1, 1), (2, 4, 2)], [], [("entities/t-id-4-clock.md", 1), ("entities/t-id-9.md", 3)]), WikiRepo(spark, str(tmp_path)), embed)
    m.wiki.commit("pages", spark.createDataFrame([("entities/t-id-4-clock.md", "old"), ("entities/t-id-9.md", "old")], "path string, content string"))
    handle = m.relabel()
    now = people(m)
    assert {i: (r.name, r.status) for i, r in now.items()} == {1: ("Clock", "active"), 2: ("T_ID 5 - Clock", "merged_into"), 3: ("T_ID 9", "pruned"), 4: ("T_ID 1 - Known", "merged_into"), 5: ("Known", "active"), 6: ("Plain", "active")}
    assert now[1].norm_key == "clock" and now[1].wiki_path == now[2].wiki_path == "entities/clock.md"
    pages = {r.path for r in m.wiki.pages().collect()}
    assert {"entities/clock.md", "entities/known.md", "index.md"} <= pages and not {"entities/t-id-4-clock.md", "entities/t-id-9.md"} & pages
    assert {r.path: r.entity_id for r in m.tables["wiki_pages"].collect()} == {"entities/clock.md": 1, "entities/known.md": 5}
    assert {r.entity_id: r.vector for r in m.tables["vec_entities"].collect()} == {1: [5.0], 5: [1.0], 6: [1.0]}
    m.undo(handle)
    assert {i: r.status for i, r in people(m).items()} == {1: "active", 2: "active", 3: "pruned", 4: "active", 5: "active", 6: "active"}


def test_disambiguation_gives_pages_of_their_own(spark, tmp_path):
    m = M.Maintenance(base(spark, [(4, "c t+1", "c[t+1", "a", "active", 1), (5, "c t-1", "c[t-1", "a", "active", 3)]), WikiRepo(spark, str(tmp_path)))
    m.disambiguate()
    paths = {r.id: r.wiki_path for r in m.tables["entities"].collect()}
    assert paths[4] == "entities/c-t-1.md" and paths[5].startswith("entities/c-t-1-") and {r.path for r in m.wiki.pages().collect()} == {*paths.values(), "index.md"}


def test_integration_rebuilds_what_a_file_touches(spark, tmp_path):
    m = M.Maintenance(base(spark, ENTITIES[3:] + [(9, "Odd $1 \\ name", "odd", "a", "active", 1)], [(1, 5, 1), (2, 5, 2), (3, 4, 2), (4, 9, 1), (5, 9, 3)], [(1, 4, 1)]), WikiRepo(spark, str(tmp_path)))
    lead = lambda rows: rows.withColumn("lead", F.concat(F.lit("Lead $1 of "), F.size("claims").cast("string")))
    m.integrate(1, "f1.pdf", lead)
    pages = {r.path: r.content for r in m.wiki.pages().collect()}
    assert "Lead $1 of 2\n\n## Claims" in pages["entities/odd.md"] and "Lead" in pages["entities/c-t-1.md"]  # of 4 and 5 the one with more sources
    assert "claim 2" in pages["entities/c-t-1.md"]
    assert m.integrate(1, "f1.pdf", lead) is None  # nothing new to say


def test_wiki_versions(spark, tmp_path):
    w = WikiRepo(spark, str(tmp_path))
    put = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    assert w.head() is None and not w.pages().count() and w.commit("empty") is None
    one = w.commit("one", put(("a.md", "A"), ("b.md", "same"), ("c.md", "same")))
    two = w.commit("two", put(("a.md", "A2"), ("b.md", "same")), put(("c.md", ""), ("zz.md", "")).select("path"))
    read = lambda h=None: {r.path: r.content for r in w.pages(h).collect()}
    assert read(one) == {"a.md": "A", "b.md": "same", "c.md": "same"} and read() == read(two) == {"a.md": "A2", "b.md": "same"}
    assert w.commit("again", put(("a.md", "A2"))) is None and w.head() == two
    w.restore(one, "back")
    assert read() == read(one) and {r.path: r["hash"] for r in w.hashes().collect()} == {r.path: r["hash"] for r in w.hashes(one).collect()}
    assert w._table("blobs", "hash string").count() == 3 and [r.parent for r in w.log().orderBy("number").collect()][:2] == [None, one]
    # a writer that died before its commit row leaves nothing that is read
    spark.createDataFrame([("a.md", "0" * 64, "lost")], "path string, hash string, batch string").write.mode("append").parquet(f"{w.root}/changes")
    assert read() == read(one)
    with pytest.raises(ValueError):
        w.pages("nothing")


def test_reviews_placeholders_and_single_rows(spark, tmp_path):
    m = M.Maintenance(base(spark, ENTITIES), WikiRepo(spark, str(tmp_path)))
    assert m.queue_review("x", "concept", 1, None, "{}") == 1 and m.queue_review("y", "concept", 1, 2, "{}", "yes") == 2
    assert [(r.mention_surface, r.state) for r in m.tables["entity_review"].orderBy("id").collect()] == [("x", "open"), ("y", "open")]
    new = m.placeholder("The Brand New", "concept", ["BN"])
    assert new == 6 and m.placeholder("brand new", "concept", ["NB"]) in (6, 7)
    assert people(m)[new].status == "unresolved"
    changed = M.set_row(m.tables["entities"], "id", 4, name=F.lit("set"))
    assert {r.id: r.name for r in changed.collect()}[4] == "set"
    with pytest.raises(ValueError):
        M.set_row(m.tables["entities"], "id", 77, name=F.lit("set"))
