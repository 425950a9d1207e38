"""Work and memory that follow the input: large groups, and keys beyond those of small tables."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbase.functions import vectors as V
from cairnbase.functions.text import canonical_display_name
from cairnbase.operators import graph, structure
from cairnbase.operators import maintenance as M
from cairnbase.plans import catalog


@pytest.fixture
def agrees(spark, tmp_path):
    """A function that runs a query on tables (name to DataFrame) and compares it with its SQL."""

    def check(query, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        found = catalog.QUERIES[query](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[query]})").fetchall()
        key = lambda row: tuple((v is None, v) for v in row)
        got = sorted(map(tuple, found.collect()), key=key)
        assert got == sorted(want, key=key)
        return got

    return check


def test_titles_carry_few_names_of_many_sources(spark):
    rng = random.Random(1)
    words = ["blue_ring", "Blue ring", "blue ring", "BLUE ring", "bluE_RING", "ring  blue", "B R", "é x", "_"]
    rows = [(i, i % 3, rng.choice([*words, None]), ["blue_ring", None, "Blue RING"][i % 3]) for i in range(900)]
    named = spark.createDataFrame(rows, "from_id long, into_id long, _from string, _into string")
    carried = M._carry(named)
    assert carried.agg(F.max(F.size("_carried"))).first()[0] <= 9
    chosen = F.aggregate("_carried", F.col("_into"), lambda now, name: canonical_display_name(F.array(now, name)))
    got = {r.from_id: r.t for r in carried.select("from_id", canonical_display_name(F.array(chosen)).alias("t")).collect()}
    every = F.array(*[F.lit(w) for w in words])
    pairs = {(r.a, r.b): r.t for r in spark.range(1).select(F.explode(F.concat(every, F.array(F.lit(None), F.lit("Blue RING")))).alias("a")).crossJoin(spark.range(1).select(F.explode(F.concat(every, F.array(F.lit(None)))).alias("b"))).select("a", "b", canonical_display_name(F.array("a", "b")).alias("t")).collect()}
    titles = sorted({t for t in pairs.values()} - {a for a, _ in pairs})
    more = spark.createDataFrame([(t,) for t in titles], "a string").crossJoin(spark.createDataFrame([(w,) for w in [*words, None]], "b string"))
    pairs |= {(r.a, r.b): r.t for r in more.select("a", "b", canonical_display_name(F.array("a", "b")).alias("t")).collect()}
    now = {}
    for i, into, name, own in rows:
        now[into] = pairs[now.get(into, own), name]
        assert got[i] == now[into]


def test_unmerge_with_parts_beyond_a_million(spark, agrees):
    parts = [(k, f"name {k}", "Brand#1", "SMALL TIN", 5) for k in (1, 2, 3, 1_000_002, 1_000_003)]
    # order 0: line 1 of part 1000003 and line 2 of part 3 had one number
    lines = [(0, 1_000_003, 7, 1), (0, 3, 8, 2), (0, 3, 9, 3), (1, 2, 7, 1)]
    part = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lineitem = lineitem.withColumns({"l_returnflag": F.lit("A"), "l_linestatus": F.lit("O"), "l_shipdate": F.lit("1996-01-01").cast("timestamp")})
    rows = {r[0]: r[3] for r in agrees("unmerge_round_trip", part=part, lineitem=lineitem)}
    assert rows == {1: 0, 2: 1, 3: 2, 1_000_002: 0, 1_000_003: 1}


def test_figures_are_counted_by_page(spark, agrees):
    rng = random.Random(4)
    chapters = spark.createDataFrame([(i, i % 2, s, s + rng.choice([-1, 0, 3, 70, 300])) for i in range(120) for s in [rng.randint(-5, 300)]] + [(500, None, 1, 9)], "id long, file_id long, page_start int, page_end int")
    figures = spark.createDataFrame([(i, rng.choice([0, 1, 2, None]), rng.choice([None, *range(1, 200)])) for i in range(400)], "id long, file_id long, page int")
    got = structure.figure_counts(chapters, figures)
    want = structure.figures_of(chapters, figures).groupBy("chapter_id").agg(F.count("*"), F.min("figure_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # one nation of many suppliers and parts: 9 million pairs
    supplier = spark.range(3000).select(F.col("id").alias("s_suppkey"), F.lit(0).alias("s_nationkey"))
    part = spark.range(0, 75_000, 25).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    agrees("range_join_figures", supplier=supplier, part=part)


@pytest.mark.parametrize("values", [(0.0, 1.23, -0.5, 7.01, 7.02, None), range(-400, 400)])
def test_related_meets_a_short_list(spark, agrees, values):
    rng = random.Random(5)
    values = [v / 100 if isinstance(v, int) else v for v in values]
    rows = [(rng.choice([*range(300), None]) if i % 9 == 0 else i, rng.choice([0, 0, 0, 0, 1, None]), rng.choice(values)) for i in range(300)]
    rows += [(1000 + i, 7, None) for i in range(9)] + [(2000, 8, 1.0), (2001, 9, None), (2002, 9, 3.0)]
    supplier = spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double")
    agrees("related", supplier=supplier)
    once = supplier.where("s_suppkey < 300 and s_nationkey = 0").groupBy(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("id")).agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    assert graph.farthest(once, 5).count() < 80 * once.count()


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<float>")


def test_parts_are_few_where_they_rule_nothing_out():
    x = V._unit(np.random.default_rng(6).normal(size=(3000, 64)))
    assert len(V._worth(x, 64, float(np.arccos(0.4)))) == 1
    centers = V._unit(np.random.default_rng(7).normal(size=(16, 64)))
    assert len(V._worth(V._unit(np.repeat(centers, 50, axis=0) + 0.001), 16, float(np.arccos(0.999)))) == 16


@pytest.mark.parametrize("threshold", [0.9, 0.5, -0.1])
def test_links_connect_what_pairs_connect(spark, threshold):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)).repeat(60, axis=0), np.zeros((2, 6))])
    df = frame(spark, x)
    pairs, links = V.pairs_above(df, threshold, block=70, pivots=3), V.links_above(df, threshold, block=70, pivots=3)
    label = lambda edges: {r["id"]: r.label for r in graph.connected_components(df, edges).collect()}
    assert label(pairs) == label(links) and links.count() < pairs.count()


def test_nearest_with_ties_over_blocks(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.integers(-1, 2, size=(120, 3)), np.ones((30, 3)), np.zeros((2, 3))]).astype(float)
    u = V._unit(x)
    sim = np.round(u @ u.T, 9)
    df = frame(spark, x)
    rows = V.knn_join(df.select(F.col("id").alias("l"), "vector"), df.select(F.col("id").alias("r"), "vector"), 7, "l", "r", block=40).collect()
    got = {}
    for r in rows:
        got.setdefault(r.l, []).append(round(r.sim, 9))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(np.sort(sim[i])[-7:].tolist()) for i in range(len(x))}
