"""Queries over vectors, rankings and clusters, each with its oracle. The tables' vectors are far apart, so thresholds are low."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import knn, knn_join, links_above, pairs_above
from ..operators import graph, ranking
from ..operators.vector_index import VectorIndex
from ..session import table

THRESHOLD = 0.40
LEXICAL = "thing shere"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(vectors: DataFrame) -> list[float]:
    return vectors.where("id = 0").head()["vector"]


def knn_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn(v, _query(v), 10, "id").select("id", F.round("sim", 4).alias("score"))


def knn_prefilter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn(v, _query(v), 5, "id", where=F.col("label") == 3).select("id", "label", F.round("sim", 4).alias("score"))


def knn_index(spark, sf_dir):
    """Nearest neighbours from a partitioned index, after one label's vectors were replaced by those with an even id."""
    import uuid

    from ..session import ensure_checkpoint_dir

    v = _vectors(spark, sf_dir).withColumn("owner", F.col("label").cast("long"))
    index = VectorIndex.create(v, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", "id", "owner", pivots=16)
    index.replace(v.where("owner = 3 and id % 2 = 0"))
    return index.knn(_query(v), 40).select("id", "label", F.round("sim", 4).alias("score"))


def similar_pairs(spark, sf_dir):
    return pairs_above(_vectors(spark, sf_dir), THRESHOLD).select("a", "b", F.round("sim", 4).alias("sim"))


def _components(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return graph.connected_components(v, links_above(v, THRESHOLD))


def connected_components(spark, sf_dir):
    return _components(spark, sf_dir)


def cluster_summary(spark, sf_dir):
    return graph.cluster_summary(_components(spark, sf_dir))


def semantic_links(spark, sf_dir):
    """For each vector the best other label among its 40 nearest, the top 5 of these, cut at the threshold."""
    v = _vectors(spark, sf_dir)
    near = knn_join(v.select(F.col("id").alias("src"), "vector"), v.select(F.col("id").alias("dst"), "vector"), 40, "src", "dst")
    labels = v.select(F.col("id").alias("k"), F.col("label"))
    placed = near.join(labels.select(F.col("k").alias("src"), F.col("label").alias("src_label")), "src").join(labels.select(F.col("k").alias("dst"), F.col("label").alias("dst_label")), "dst")
    best = placed.where("src_label <> dst_label").groupBy("src", "dst_label").agg(F.max("sim").alias("sim"))
    rn = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst_label"))
    return best.withColumn("rn", rn).where((F.col("rn") <= 5) & (F.col("sim") >= THRESHOLD)).select("src", "dst_label", "rn", F.round("sim", 4).alias("score"))


def _arms(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    dense = knn(v, _query(v), 30, "id").select("id", F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("rank"), F.lit("semantic").alias("arm"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = ranking.keyword_search(d, LEXICAL, k=30).select("id", "rank", F.lit("keyword").alias("arm"))
    return words.unionByName(dense)


def rrf_fusion(spark, sf_dir):
    return ranking.rrf(_arms(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "source")


def hybrid_search(spark, sf_dir):
    fused = ranking.rrf(_arms(spark, sf_dir)).orderBy(F.desc("score"), "id").limit(30)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    from ..functions.text import is_noise

    kept = fused.join(d, "id", "left").where(F.col("text").isNull() | ~is_noise(F.col("text")))
    return kept.orderBy(F.desc("score"), "id").limit(8).select("id", F.round("score", 4).alias("score"), "source")


def relevance_floor(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = knn(v, _query(v), 30, "id").select("id", F.round("sim", 4).alias("score"), F.lit(None).cast("double").alias("rerank_score"), F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("rank"))
    return ranking.relevance_floor(hits, ratio=0.3).select("id", "rank", "score")


def rerank_hits(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = knn(v, _query(v), 30, "id").select("id", "label")
    return ranking.rerank(hits, (F.col("label") - 5).cast("double"), 10).select("id", "rerank_score")


def cluster_hits(spark, sf_dir):
    """Hits of one cluster each: the label is the cluster, its canonical member the vector whose id is the label."""
    v = _vectors(spark, sf_dir)
    hits = knn(v, _query(v), 200, "id").select(F.col("id").alias("file_id"), F.col("label").cast("long").alias("cluster_id"), F.round("sim", 4).alias("score"), F.row_number().over(Window.orderBy(F.desc("sim"), "id")).alias("rank"))
    return ranking.dedupe_clusters(hits)


def gallery(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = v.select(F.col("id").alias("file_id"), F.when(F.col("label") < 7, F.col("label")).alias("cluster_id"), F.col("id").alias("rank"))
    return ranking.gallery(hits).select("file_id", "cluster_id", "dups")


_SIM = "SELECT e.vec_id AS id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), edges AS (SELECT * FROM pairs WHERE sim >= {THRESHOLD})"
_CC = f"""WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT w.v, reach.r FROM reach JOIN both_ways w ON reach.u = w.u),
  cc AS (SELECT u AS id, min(r) AS label FROM reach GROUP BY u)"""


def _arms_sql() -> str:
    from .text_queries import _keyword_sql

    words = _keyword_sql("(SELECT doc_id AS id, text FROM documents)", ["id"], [], ["thing", "shere"], 30, "id")
    return f"""arms AS (SELECT id, rank, 'keyword' AS arm FROM ({words}) UNION ALL SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rank, 'semantic' AS arm FROM (SELECT * FROM ({_SIM}) ORDER BY sim DESC, id LIMIT 30)),
    fused AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, CASE WHEN count(DISTINCT arm) > 1 THEN 'both' ELSE min(arm) END AS source FROM arms GROUP BY id)"""


def _hybrid_sql() -> str:
    from .text_queries import _BOIL, _TOC

    return f"""WITH {_arms_sql()}, pool AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT 30)
    SELECT id, round(pool.score, 4) AS score, pool.source FROM pool LEFT JOIN documents ON doc_id = id WHERE text IS NULL OR NOT ({_TOC} OR {_BOIL}) ORDER BY pool.score DESC, id LIMIT 8"""


QUERIES = {f.__name__: f for f in (knn_cosine, knn_prefilter, knn_index, similar_pairs, connected_components, cluster_summary, semantic_links, rrf_fusion, hybrid_search, relevance_floor, rerank_hits, cluster_hits, gallery)}

ORACLES = {
    "knn_cosine": f"SELECT id, round(sim, 4) AS score FROM ({_SIM}) ORDER BY sim DESC, id LIMIT 10",
    "knn_prefilter": f"SELECT id, label, round(sim, 4) AS score FROM ({_SIM}) WHERE label = 3 ORDER BY sim DESC, id LIMIT 5",
    "knn_index": f"SELECT id, label, round(sim, 4) AS score FROM ({_SIM}) WHERE label IS DISTINCT FROM 3 OR id % 2 = 0 ORDER BY sim DESC, id LIMIT 40",
    "similar_pairs": f"WITH {_PAIRS} SELECT a, b, round(sim, 4) AS sim FROM edges",
    "connected_components": f"{_CC} SELECT id, label FROM cc",
    "cluster_summary": f"{_CC}, s AS (SELECT label, count(*) AS n FROM cc GROUP BY label) SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS clusters, count_if(n > 1) AS groups, CAST(sum(n) - count(*) AS BIGINT) AS redundant FROM s",
    "semantic_links": f"""WITH near AS (SELECT a.vec_id AS src, a.label AS sl, b.label AS dl, b.vec_id AS dst, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a, embeddings b),
        top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rn FROM near) WHERE rn <= 40),
        best AS (SELECT src, dl AS dst_label, max(sim) AS sim FROM top WHERE sl <> dl GROUP BY src, dl)
        SELECT src, dst_label, rn, round(sim, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst_label) AS rn FROM best) WHERE rn <= 5 AND sim >= {THRESHOLD}""",
    "rrf_fusion": f"WITH {_arms_sql()} SELECT id, round(score, 6) AS score, source FROM fused",
    "hybrid_search": _hybrid_sql(),
    "relevance_floor": f"""WITH h AS (SELECT id, round(sim, 4) AS score, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT * FROM ({_SIM}) ORDER BY sim DESC, id LIMIT 30)),
        f AS (SELECT *, greatest(first_value(score) OVER (ORDER BY rank) * 0.3, 0.01) AS floor FROM h) SELECT id, rank, score FROM f WHERE score >= floor OR rank = 1""",
    "rerank_hits": f"SELECT id, round(1 / (1 + exp(-(label - 5))), 4) AS rerank_score FROM (SELECT * FROM ({_SIM}) ORDER BY sim DESC, id LIMIT 30) ORDER BY rerank_score DESC, id LIMIT 10",
    "cluster_hits": f"""WITH h AS (SELECT id AS file_id, CAST(label AS BIGINT) AS cluster_id, round(sim, 4) AS score, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT * FROM ({_SIM}) ORDER BY sim DESC, id LIMIT 200))
        SELECT coalesce(max(CASE WHEN file_id = cluster_id THEN file_id END), arg_min(file_id, rank)) AS file_id, cluster_id, arg_min(score, rank) AS score, min(rank) AS rank FROM h GROUP BY cluster_id""",
    "gallery": """SELECT min(vec_id) AS file_id, any_value(CASE WHEN label < 7 THEN label END) AS cluster_id, count(*) - 1 AS dups FROM embeddings GROUP BY CASE WHEN label < 7 THEN 'c' || label ELSE 'f' || vec_id END""",
}
