import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairnbase.operators import entities as E
from cairnbase.operators import mutate, quality

ENTITY = "id long, name string, type string, norm_key string, aliases array<string>, acronyms array<string>, wiki_path string, slug string, status string, source_count int"


def entity(i, name, key=None, type_="component", status="active", path=None, sources=0, aliases=None, slug=None):
    return (i, name, type_, key if key is not None else name.lower(), aliases or [], [], path, slug, status, sources)


def claims_of(spark, counts):
    rows = [(100 * e + i, e, 1, f"c{i}", "active") for e, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id long, entity_id long, file_id long, text string, status string")


def test_duplicate_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), " ".join(rng.sample("one two three four five six".split(), rng.randint(1, 4)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, type string, norm_key string")
    for t in (0.5, 1 / 3, 0.75):
        want = set()
        for (i, a, x), (j, b, y) in itertools.combinations(rows, 2):
            s, u = set(x.split()), set(y.split())
            if a == b and len(s & u) >= t * len(s | u) - 1e-12:
                want.add((i, j))
        assert {(r["a"], r["b"]) for r in E.duplicate_pairs(df, t).collect()} == want


def test_known_duplicate(spark):
    df = spark.createDataFrame([(1, "x", "br edr controller"), (2, "x", "br edr le controller")], "id long, type string, norm_key string")
    got = E.duplicate_pairs(df).collect()
    assert [(r["a"], r["b"], r["score"]) for r in got] == [(1, 2, 0.75)]
    assert [(r["band"], r["pairs"]) for r in E.band_summary(E.duplicate_pairs(df)).collect()] == [("fold", 1)]


def test_comentions_fall_back_to_files(spark):
    m = spark.createDataFrame([(1, 10, 5, 1), (2, 20, 5, 1), (3, 30, 6, 1), (4, 40, None, 2)], "id long, entity_id long, chunk_id long, file_id long")
    got = {(r["entity_id"], r["other_id"]) for r in E.comentions(m).collect()}
    assert got == {(10, 20), (20, 10), (30, 10), (30, 20)}


def test_provenance(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    src = spark.createDataFrame([(1, 7, 1), (1, 8, 1), (1, 7, 1), (2, None, 1), (2, 99, 1)], "claim_id long, chunk_id long, file_id long")
    chunks = spark.createDataFrame([(7, 3), (8, 1)], "id long, page int")
    files = spark.createDataFrame([(1, "a.pdf")], "id long, filename string")
    assert {r["claim_id"]: r["sources"] for r in E.provenance(claims, src, chunks, files).collect()} == {1: "a.pdf p.1; a.pdf p.3", 2: "a.pdf", 3: ""}


def test_contains_join(spark):
    chunks = spark.createDataFrame([(1, "uses the E0 cipher here"), (2, "nothing"), (3, "link management protocol stack"), (4, None)], "id long, text string")
    cand = spark.createDataFrame([(5, "E0 cipher", []), (6, "LMP", ["Link Management Protocol"]), (7, "Bluetooth SIG", None)], "id long, name string, aliases array<string>")
    assert {(r["candidate_id"], r["chunk_id"]) for r in E.contains_join(chunks, cand).collect()} == {(5, 1), (6, 3)}


def test_resolution_bands(spark):
    none = "id long, name string, type string, norm_key string, aliases array<string>, acronyms array<string>, vector array<float>"
    v = [1.0, 0.0, 0.0]
    known = spark.createDataFrame([(1, "Link Manager", "component", "link manager", [], [], v)], none)
    cand = spark.createDataFrame([(10, "Link Manager", "component", "link manager", [], [], v), (11, "Unrelated", "person", "unrelated", [], [], v)], none)
    got = {r["candidate_id"]: (r["decision"], r["entity_id"]) for r in E.resolve(cand, known).collect()}
    assert got == {10: ("MATCH", 1), 11: ("NEW", None)}
    twice = known.union(known.withColumn("id", F.lit(2).cast("long")))
    assert {r["candidate_id"]: r["decision"] for r in E.resolve(cand, twice).collect()}[10] == "DEFER"


def test_collisions_and_disambiguation(spark):
    rows = [entity(1, "AFH_channel_map", "afh_channel_map"), entity(2, "AFH channel map", "afh channel map"), entity(3, "C[t+1]", "c[t+1"), entity(4, "C[t-1]", "c[t-1"), entity(5, "Packet_Type", "packet_type"), entity(6, "Packet Type", "packet type", "person")]
    e = spark.createDataFrame(rows, ENTITY)
    plan = {r["from_id"]: (r["into_id"], r["reason"]) for r in E.collision_plan(e, claims_of(spark, {1: 3, 2: 1, 5: 2})).collect()}
    assert plan == {2: (1, None), 4: (3, "distinct keys"), 6: (5, "incompatible types")}
    d = E.disambiguation_plan(e)
    assert {r["id"] for r in d.collect()} == {2, 4, 6}
    changed = mutate.set_slugs(e, d)
    assert quality.slug_collisions(changed).count() == 0
    undone = mutate.set_slugs(changed, d.withColumn("slug", F.lit(None).cast("string")))
    assert sorted(map(tuple, undone.select(*e.columns).collect())) == sorted(map(tuple, e.collect()))


def test_relabel_plan(spark):
    rows = [entity(1, "RTT AA candidates"), entity(2, "T_ID 5 - RTT AA candidates"), entity(3, "T_ID 1 - mode0 channel"), entity(4, "T_ID 5")]
    got = {r["id"]: (r["action"], r["into_id"]) for r in E.relabel_plan(spark.createDataFrame(rows, ENTITY), claims_of(spark, {1: 3, 2: 1, 3: 1, 4: 1})).collect()}
    assert got == {2: ("fold", 1), 3: ("rename", None), 4: ("prune", None)}


def test_merge_and_undo(spark):
    e = spark.createDataFrame([entity(1, "A", sources=1), entity(2, "B", sources=1, aliases=["bee"])], ENTITY)
    c = claims_of(spark, {1: 2, 2: 3})
    m = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "id long, entity_id long, file_id long")
    plan = spark.createDataFrame([(2, 1)], "from_id long, into_id long")
    out = mutate.merge_entities(e, c, m, plan)
    by_id = {r["id"]: r for r in out["entities"].collect()}
    assert by_id[1]["aliases"] == ["bee", "B"] and by_id[1]["source_count"] == 2 and by_id[2]["status"] == "merged_into"
    assert {r["entity_id"] for r in out["claims"].collect()} == {1}
    back = mutate.unmerge_entities(out["entities"], out["claims"], out["mentions"], out["manifest"])
    assert sorted(map(tuple, back["claims"].select(*c.columns).collect())) == sorted(map(tuple, c.collect()))
    assert {r["id"]: (r["status"], r["source_count"]) for r in back["entities"].collect()} == {1: ("active", 1), 2: ("active", 1)}


FULL = "id long, name string, type string, aliases array<string>, acronyms array<string>, wiki_path string, status string, source_count int"


def test_merge_gives_and_undo_takes_back(spark):
    rows = [(1, "A", "t", ["x"], ["AA"], "a.md", "unresolved", 1), (2, "B", "t", ["y"], ["BB"], "b.md", "active", 1), (3, "C", "t", ["x", "z"], None, "c.md", "active", 1), (4, "Other", "t", None, None, None, "active", 0)]
    e = spark.createDataFrame(rows, FULL)
    c, m = claims_of(spark, {1: 2, 2: 1}), spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "id long, entity_id long, file_id long")
    plan = spark.createDataFrame([(1, 2, None), (3, 1, "Better")], "from_id long, into_id long, display_name string")  # a chain: 3 to 1 to 2
    out = mutate.merge_entities(e, c, m, plan)
    got = {r["id"]: r for r in out["entities"].collect()}
    assert (got[2]["name"], got[2]["aliases"], got[2]["acronyms"], got[2]["source_count"]) == ("Better", ["y", "x", "A", "z", "C", "B"], ["BB", "AA"], 3)
    assert [(got[i]["status"], got[i]["wiki_path"]) for i in (1, 3)] == [("merged_into", "b.md")] * 2 and got[4]["aliases"] is None
    back = mutate.unmerge_entities(out["entities"], out["claims"], out["mentions"], out["manifest"])["entities"].select(*e.columns).collect()
    assert sorted(tuple(r) for r in back) == [(i, *r[:4], r[4] if i in (2, 4) else None, *r[5:]) for i, *r in rows]
    taken = spark.createDataFrame([(1, 2, "Other")], "from_id long, into_id long, display_name string")
    assert {r["name"] for r in mutate.merge_entities(e, c, m, taken)["entities"].where("id = 2").collect()} == {"B"}


@pytest.mark.parametrize("plan", [[(1, 1)], [(1, 99)], [(1, 2), (2, 1)]])
def test_bad_merges_are_refused(spark, plan):
    e = spark.createDataFrame([entity(1, "A"), entity(2, "B")], ENTITY)
    m = spark.createDataFrame([], "id long, entity_id long, file_id long")
    with pytest.raises(Exception, match="merge"):
        mutate.merge_entities(e, claims_of(spark, {1: 1}), m, spark.createDataFrame(plan, "from_id long, into_id long"))["entities"].collect()
    with pytest.raises(Exception, match="undone"):
        empty = spark.createDataFrame([(1, 2, None)], "from_id long, into_id long, moved struct<claims:array<long>,mentions:array<long>,aliases_added:array<string>,acronyms_added:array<string>,renamed_from:string,prior_status:string>")
        mutate.unmerge_entities(e, claims_of(spark, {1: 1}), m, empty)["entities"].collect()


def test_merge_candidates(spark):
    rows = [(0, 0, "E0", "concept", ["a"], ["x", "y"]), (1, 0, "E0 cipher", "component", [], ["z"]), (1, 1, "E0", "component", ["b"], ["x"])]
    df = spark.createDataFrame(rows, "window int, ord int, name string, type string, aliases array<string>, claims array<string>")
    got = {r["norm_key"]: r for r in E.merge_candidates(df, spark.createDataFrame([], "norm_key string"), 2).collect()}
    assert (got["e0"]["name"], got["e0"]["type"], got["e0"]["claims"]) == ("E0", "component", ["x", "y"])
    thin = E.merge_candidates(df, spark.createDataFrame([], "norm_key string"), 5)
    assert {r["norm_key"] for r in thin.collect()} == {"e0"}


def test_lint_and_audit(spark):
    pages = spark.createDataFrame([("entities/alpha.md", "see [[beta|Beta]]"), ("entities/beta.md", ""), ("queries/q.md", "on [[beta]]")], "path string, content string")
    e = spark.createDataFrame([entity(1, "Alpha", path="entities/alpha.md"), entity(2, "Beta", path="entities/beta.md"), entity(3, "Gone", path="entities/gone.md"), entity(4, "Unsure", status="unresolved"), entity(5, "New", sources=3), entity(6, "Link Manager"), entity(7, "Link Manager Protocol"), entity(8, "X y", "x y"), entity(9, "X_y", "x_y")], ENTITY)
    c = spark.createDataFrame([(1, 2, 1, "claim", "active", "2024-01-02"), (2, 2, 1, "bare", "contradicted", "2024-01-01")], "id long, entity_id long, file_id long, text string, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    cs = spark.createDataFrame([(1, 1, 9999), (2, 1, None)], "id long, claim_id long, chunk_id long")
    wp = spark.createDataFrame([("queries/q.md", "Q", "query", "2024-01-01"), ("entities/lost.md", "Lost", "entity", None)], "path string, title string, kind string, last_synth_at string").withColumn("last_synth_at", F.to_timestamp("last_synth_at"))
    t = {"entities": e, "claims": c, "claim_sources": cs, "mentions": spark.createDataFrame([], "id long, entity_id long"), "reviews": spark.createDataFrame([(1, "open")], "id long, state string"), "wiki_pages": wp, "pages": pages, "chunks": spark.createDataFrame([(1,)], "id long")}
    kinds = {r["kind"]: r["n"] for r in quality.by_kind(quality.lint(t)).collect()}
    assert set(kinds) == {"orphan", "unsupported_claim", "unresolved", "missing_page", "deleted_page", "slug_collision", "duplicate", "contradiction", "unattested", "stale_query"}
    assert kinds["unresolved"] == 2
    assert {r["kind"] for r in quality.audit(t).collect()} == {"dangling_source", "unsupported_claim", "catalog_drift"}


def test_small_mutations(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id long, v string")
    assert sorted(map(tuple, mutate.patch(old, new, "id").collect())) == [(1, "a", "x"), (2, "b", None), (3, "c", None)]
    assert {r["id"]: r["v"] for r in mutate.upsert(old, new.withColumn("w", F.lit("n")), "id").collect()} == {1: "a", 2: None, 3: "c"}
    assert {r["id"]: r["fk"] for r in mutate.null_missing(spark.createDataFrame([(1, 5), (2, 6)], "id long, fk long"), spark.createDataFrame([(5,)], "id long"), "fk").collect()} == {1: 5, 2: None}
    tree = mutate.with_parent_ids(spark.createDataFrame([(1, 0, None), (1, 1, 0)], "file_id long, ord int, parent_ord int"), 10)
    assert {r["ord"]: (r["id"], r["parent_id"]) for r in tree.collect()} == {0: (10, None), 1: (11, 10)}


def test_topics(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "entity_id long, chunk_id long")
    chunks = spark.createDataFrame([(1, 20), (2, 30)], "id long, chapter_id long")
    tops = spark.createDataFrame([(20, 10), (30, 30)], "id long, top_id long")
    assert {r["top_id"]: r["entities"] for r in E.topic_clusters(m, chunks, tops, least=1).collect()} == {10: [1, 2], 30: [3]}


def test_clear_and_prune(spark):
    m = spark.createDataFrame([(1, 10, 1), (2, 20, 2)], "id long, entity_id long, file_id long")
    c = spark.createDataFrame([(5, 30, 1), (6, 20, 2)], "id long, entity_id long, file_id long")
    cs = spark.createDataFrame([(1, 5), (2, 6)], "id long, claim_id long")
    r = spark.createDataFrame([(1, 1), (2, 2)], "id long, file_id long")
    out = mutate.clear_synthesis(m, c, cs, r, spark.createDataFrame([(1,)], "file_id long"))
    assert {x["entity_id"] for x in out["touched"].collect()} == {10, 30}
    assert [out[k].count() for k in ("mentions", "claims", "claim_sources", "reviews")] == [1, 1, 1, 1]
    e = spark.createDataFrame([entity(1, "350 ms", path="entities/x.md"), entity(2, "Cake", path="entities/y.md")], ENTITY)
    pages = spark.createDataFrame([("entities/x.md", 2), ("entities/z.md", 1)], "path string, entity_id long")
    done = mutate.prune_entities(e, pages, E.junk(e).select("id"))
    assert {x["id"]: (x["status"], x["wiki_path"]) for x in done["entities"].collect()} == {1: ("pruned", None), 2: ("active", "entities/y.md")}
    assert [x["path"] for x in done["wiki_pages"].collect()] == ["entities/x.md"]  # the row belongs to another entity
