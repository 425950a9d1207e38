import pytest
from pyspark.sql import functions as F

from cairnbase.functions.time import month_range
from cairnbase.functions.vectors import knn, knn_join, pairs_above
from cairnbase.operators import filters, graph, ranking


def test_keyword_ranking(spark):
    texts = ["bluetooth low energy advertising channels.", "bluetooth pairing and bluetooth bonding here.", "A passage mentioning bluetooth once.", "completely unrelated baking content."]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    got = [(r["id"], r["score"]) for r in ranking.keyword_search(df, "bluetooth channels").orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.5), (3, 0.5)]
    assert ranking.keyword_search(df, "  ").count() == 0


def test_phrase_leaves_out_scattered_words(spark):
    df = spark.createDataFrame([(1, "low power and energy"), (2, "low energy mode")], "id long, text string")
    assert [r["id"] for r in ranking.keyword_search(df, '"low energy"').collect()] == [2]


def test_rrf(spark):
    rows = [("dense", 1, 10), ("dense", 2, 20), ("dense", 3, 30), ("lexical", 1, 30), ("lexical", 2, 40)]
    got = ranking.rrf(spark.createDataFrame(rows, "arm string, rank int, id long")).orderBy(F.desc("score"), "id").collect()
    assert [r["id"] for r in got] == [30, 10, 20, 40] and got[0]["source"] == "both"


FLOORS = [([0.53, 0.07, 0.005], True, 1), ([0.9, 0.6, 0.4], True, 3), ([0.003, 0.002, 0.001, 0.0001], True, 1), ([0.003, 0.002, 0.001, 0.0001], False, 0), ([0.9, 0.6, 0.02], False, 2)]


@pytest.mark.parametrize(("scores", "keep", "n"), FLOORS)
def test_relevance_floor(spark, scores, keep, n):
    df = spark.createDataFrame([(i, 0.0, s) for i, s in enumerate(scores, 1)], "rank int, score double, rerank_score double")
    assert ranking.relevance_floor(df, keep_top=keep).count() == n


def test_cluster_dedupe(spark):
    rows = [(1, 7, 5, "dup", 0.9), (2, 5, 5, "canon", 0.8), (3, 9, None, "alone", 0.7)]
    df = spark.createDataFrame(rows, "rank int, file_id long, cluster_id long, text string, score double")
    assert [(r["rank"], r["text"], r["score"]) for r in ranking.dedupe_clusters(df).collect()] == [(1, "canon", 0.9), (3, "alone", 0.7)]
    assert [(r["file_id"], r["dups"]) for r in ranking.gallery(df).collect()] == [(7, 1), (9, 0)]


def test_citations_and_context(spark):
    df = spark.createDataFrame([(1, "chunk", "a.pdf", "Sec", 3, 11, 1, "one"), (2, "image", "b.png", None, None, None, 2, "two")], "rank int, kind string, file string, chapter string, page int, chunk_id long, file_id long, text string")
    assert [r["image_url"] for r in ranking.citations(df).collect()] == [None, "/image/2"]
    assert ranking.context_blocks(df).head()[0] == "[1] one\n\n[2] two"


VECTORS = [
    ([(10, [1.0, 0.0]), (20, [0.99, 0.01]), (30, [0.0, 1.0])], 0.92, {10: 10, 20: 10, 30: 30}),
    ([(1, [1.0, 0.0, 0.0]), (2, [0.96, 0.28, 0.0]), (3, [0.8, 0.6, 0.0])], 0.90, {1: 1, 2: 1, 3: 1}),
    ([(9, [0.0, 1.0]), (7, [0.999, 0.001]), (5, [1.0, 0.0])], 0.92, {5: 5, 7: 5, 9: 9}),
]


@pytest.mark.parametrize(("rows", "threshold", "want"), VECTORS)
def test_components_of_similar_vectors(spark, rows, threshold, want):
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    for block in (1, 100):
        got = graph.connected_components(v, pairs_above(v, threshold, block=block))
        assert {r["id"]: r["label"] for r in got.collect()} == want


def test_knn_filters_before_the_cut(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "b")], "id long, vector array<double>, t string")
    assert [r["id"] for r in knn(v, [1.0, 0.0], 2, "id", where=F.col("t") == "b").collect()] == [2, 3]
    near = knn_join(v.select(F.col("id").alias("l"), "vector"), v.select(F.col("id").alias("r"), "vector"), 2, "l", "r", block=2)
    assert {(r["l"], r["r"]) for r in near.where("l < 3").collect()} == {(1, 1), (1, 2), (2, 2), (2, 1)}


def test_bridge_merges_clusters(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id long, label long")
    new = graph.add_to_clusters(labels, spark.createDataFrame([(9,)], "id long"), spark.createDataFrame([(9, 2), (9, 6)], "a long, b long"))
    assert {r["label"] for r in new.collect()} == {1}
    summary = graph.cluster_summary(labels).head()
    assert (summary["items"], summary["clusters"], summary["groups"], summary["redundant"]) == (4, 2, 2, 2)


def test_merge_chain(spark):
    m = spark.createDataFrame([(1, 5, 6), (2, 6, 7), (3, 5, 8)], "id long, from_id long, into_id long")
    assert {r["from_id"]: r["survivor"] for r in graph.follow_merges(m).collect()} == {5: 8, 6: 7}


def test_topological_order():
    assert graph.topological_order({"b": ("a",), "a": (), "c": ("a",)}) == ["a", "b", "c"]
    for bad in ({"a": ("x",)}, {"a": ("b",), "b": ("a",)}):
        with pytest.raises(ValueError):
            graph.topological_order(bad)


def test_image_filter_is_clean_and_strict(spark):
    df = spark.createDataFrame([(1, "pngdrop", 10, "CA", None), (2, "png", 102400, "CA", 5), (3, "png", 102401, "CA", 5), (4, "png", 102401, "US", None)], "id long, format string, byte_size long, geo_country string, exif_ts long")
    ids = lambda **k: [r["id"] for r in df.where(filters.image_filter(**k)).orderBy("id").collect()]
    assert ids(fmt="PNG", min_bytes=102400, country="CA") == [3]
    assert ids(fmt="pn'g; drop") == [1]
    assert ids(ts_to=10) == [2, 3]
    assert month_range(2026, 4) == (1775001600, 1777593599)


def test_lookups(spark):
    e = spark.createDataFrame([(1, "Cake", "cake", "active", ["tart"], None), (2, "Cake Pan", "cake pan", "merged_into", None, ["CP"])], "id long, name string, norm_key string, status string, aliases array<string>, acronyms array<string>").withColumn("type", F.lit("product"))
    assert [filters.find_entity(e, t).head()["id"] for t in ("2", "cake", "pan")] == [2, 1, 2]
    assert [r["id"] for r in filters.overlapping_forms(e, ["cp", "tart"]).collect()] == [1, 2]
    assert [r["id"] for r in filters.not_merged(e, ["cake", "cake pan"]).collect()] == [1]
    assert filters.by_prefix(e, "cake", "norm_key").head()["id"] == 1 and filters.newest(e, "type", "product").head()["id"] == 2
