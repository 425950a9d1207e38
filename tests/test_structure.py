import random

import pytest
from pyspark.sql import functions as F

from cairnbase.operators import structure


def test_outline_against_stack_rule(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for f in range(20):
        page, stack, entries = 1, [], []
        for o in range(rng.randint(1, 12)):
            page += rng.randint(0, 3)
            entries.append((o, rng.randint(1, 4), page))
        for i, (o, level, p) in enumerate(entries):
            while stack and stack[-1][0] >= level:
                stack.pop()
            later = [q for _, lv, q in entries[i + 1 :] if lv <= level]
            want[f, o] = (stack[-1][1] if stack else None, max(p, later[0] - 1) if later else 60)
            stack.append((level, o))
            rows.append((f, o, level, p, 60))
    df = spark.createDataFrame(rows, "file_id long, ord int, level int, page int, total_pages int")
    got = {(r["file_id"], r["ord"]): (r["parent_ord"], r["page_end"]) for r in structure.section_bounds(df).collect()}
    assert got == want


def test_pages_to_chapters(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 7)], "file_id long, page int")
    chapters = spark.createDataFrame([(7, 1, 2, 0), (8, 1, 4, 1), (9, 1, 4, 2)], "id long, file_id long, page_start int, ord int")
    got = [r["chapter_id"] for r in structure.page_chapters(pages, chapters).orderBy("page").collect()]
    assert got == [None, 7, 7, 9, 9, 9]


def test_top_level(spark):
    c = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id long, parent_id long")
    assert {r["id"]: r["top_id"] for r in structure.top_level(c).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_windows_drop_noise_unless_all_is_noise(spark):
    rows = [(1, 0, "real"), (1, 1, "Page 3"), (1, 2, "more"), (2, 0, "Page 1")]
    df = spark.createDataFrame(rows, "file_id long, ord int, text string")
    got = {(r["file_id"], r["ord"]): r["window"] for r in structure.extraction_windows(df, 1).collect()}
    assert got == {(1, 0): 0, (1, 2): 1, (2, 0): 0}


def test_even_sample(spark):
    for n in (1, 3, 5, 7, 10, 11):
        df = spark.createDataFrame([(1, i) for i in range(n)], "g int, o int")
        got = sorted(r["o"] for r in structure.even_sample(df, 4, "g", "o").collect())
        assert got == (list(range(n)) if n <= 4 else [i * n // 4 for i in range(4)])


def test_headings(spark):
    lines = []
    for page in range(1, 6):
        lines += [(1, len(lines), page, "Running head", 16.0, False)]
        lines += [(1, len(lines), page, "1.1 Numbered" if page == 2 else f"Big {page}", 14.0 if page == 2 else 18.0, True)]
        lines += [(1, len(lines), page, "body text " * 9, 11.0, False)]
    df = spark.createDataFrame(lines, "file_id long, ord int, page int, text string, size double, bold boolean")
    got = [(r["level"], r["text"]) for r in structure.detect_headings(df, 5).orderBy("ord").collect()]
    assert got == [(1, "Big 1"), (2, "1.1 Numbered"), (1, "Big 3"), (1, "Big 4"), (1, "Big 5")]


def test_chunks_and_neighbours(spark):
    df = spark.createDataFrame([(1, "a" * 3000), (2, " "), (3, None)], "id long, text string")
    assert [(r["id"], r["ord"], len(r["text"])) for r in structure.chunk_pages(df, "id").orderBy("ord").collect()] == [(1, 0, 1500), (1, 1, 1500), (1, 2, 400)]
    c = spark.createDataFrame([(1, i) for i in range(3)], "f long, o int")
    assert [(r["prev"], r["next"]) for r in structure.neighbours(c, "f", "o", "o").orderBy("o").collect()] == [(None, 1), (0, 2), (1, None)]


def test_figures_by_page_range(spark):
    c = spark.createDataFrame([(1, 1, 1, 3), (2, 1, 4, 4)], "id long, file_id long, page_start int, page_end int")
    f = spark.createDataFrame([(5, 1, 2), (6, 1, 4), (7, 2, 2)], "id long, file_id long, page int")
    assert {(r["chapter_id"], r["figure_id"]) for r in structure.figures_of(c, f).collect()} == {(1, 5), (2, 6)}
    assert F is not None


@pytest.mark.parametrize("how", ["number", "column", "table"])
def test_headings_against_separate_steps(spark, how):
    from pyspark.sql import Window

    from cairnbase.functions.text import heading_level

    rng = random.Random(5)
    texts = ["1. Intro", "2.3 Part", "2.3.1 Deep", "Head", "foot", "", None, "w " * 30, "x" * 130, "long " * 40]
    rows = [(f, i, i // 6, rng.choice(texts), rng.choice([None, 9.0, *range(10, 20)]) and float(rng.choice([10, 10, 10, 11, 12, 13, 14, 15, 16, 17, 18])), rng.choice([True, False, False]), 12) for f in range(12) for i in range(rng.choice([1, 20, 70]))]
    lines = spark.createDataFrame(rows, "file_id long, ord long, page int, text string, size double, bold boolean, total int")
    kept, pages = lines, {"number": 12, "column": "total"}.get(how)
    if how == "table":
        pages = lines.where("file_id % 3 > 0").select("file_id", F.col("total").alias("total_pages")).distinct()
        kept = lines.where("file_id % 3 > 0")
    sized = kept.join(structure.body_size(kept), "file_id")
    big = F.when(F.col("size") >= F.col("body") + 1.0, F.col("size"))
    rank = F.dense_rank().over(Window.partitionBy("file_id").orderBy(big.desc_nulls_last()))
    ranked = sized.withColumn("r", F.when(big.isNotNull() & (rank <= 6), rank))
    level = heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("body"), F.col("r"))
    running = structure.running_lines(kept, "total").select("file_id", "text")
    want = ranked.join(running, ["file_id", "text"], "left_anti").withColumn("level", level).where("level is not null")
    key = lambda df: sorted((r.file_id, r.ord, r.level, str(r.text), r.page) for r in df.collect())
    found = structure.detect_headings(lines.checkpoint(), pages)
    assert key(found) == key(want) and found.count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= (3 if how == "table" else 2)  # the lines: once for their sizes, once for themselves
