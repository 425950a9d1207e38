import __spark_entry__ as entry

from cairnbase.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_vectors_need_no_cross_join(spark):
    plan = catalog.QUERIES["similar_pairs"](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    from cairnbase.operators.filters import image_filter

    df = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("lang as format", "n_chars as byte_size").where(image_filter(fmt="en", min_bytes=10))
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(n_chars,10)" in plan and "EqualTo(lang,en)" in plan
