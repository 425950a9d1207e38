import random

import pytest
from pyspark.sql import functions as F

from cairnbase.operators import entities as E
from cairnbase.operators import structure


@pytest.mark.parametrize("limit", [10_000, 0])
def test_contains_against_every_needle(spark, limit):
    rng = random.Random(1)
    words = ["alpha", "beta", "a", "b c", "é漢", "gamma ray", "x.y", "ha", "ta g", "🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))).upper() for _ in range(60)] + [None, "", "a", "É漢"]
    names = [(i, rng.choice(words), [rng.choice(words), "  ", "Beta Alpha"] if i % 2 else None) for i in range(25)] + [(99, " ", []), (98, None, ["RAY"])]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = E.contains_join(chunks, spark.createDataFrame(names, "id long, name string, aliases array<string>"), cap=7, needle_bytes=limit)
    want = set()
    for i, name, aliases in names:
        needles = {n.lower() for n in [name, *(aliases or [])] if n and n.strip(" ")}
        hits = [j for j, t in enumerate(texts) if t is not None and any(n in t.lower() for n in needles)]
        want |= {(i, j) for j in hits[:7]}
    assert {(r.candidate_id, r.chunk_id) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_contains_without_rows(spark):
    chunks, none = spark.createDataFrame([(1, "text")], "id long, text string"), spark.createDataFrame([], "id long, name string, aliases array<string>")
    assert E.contains_join(chunks, none).count() == 0 and E.contains_join(chunks.where("false"), none).count() == 0


def test_comentions_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        chunk = None if rng.random() < 0.1 else rng.choice([0, 0, 0, rng.randint(1, 60)])
        rows.append((i, rng.randint(0, 70), chunk, rng.randint(0, 5)))
    rows += [(1000 + i, 200 + i % 3, 500 + i, 77) for i in range(9)]  # alone in their chunks: the file decides
    rng.shuffle(rows)
    got = {}
    for r in E.comentions(spark.createDataFrame(rows, "id long, entity_id long, chunk_id long, file_id long"), cap=5).orderBy("entity_id", "rn").collect():
        got.setdefault(r.entity_id, []).append(r.other_id)

    def beside(e, at):
        keys = {r[at] for r in rows if r[1] == e and r[at] is not None}
        first = {}
        for i, o, *where in rows:
            if o != e and where[at - 2] in keys:
                first[o] = min(first.get(o, i), i)
        return [o for _, o in sorted((f, o) for o, f in first.items())][:5]

    want = {e: beside(e, 2) or beside(e, 3) for e in {r[1] for r in rows}}
    assert got == {e: o for e, o in want.items() if o}


def test_best_candidates_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    make = lambda start: [(start + i, rng.choice(["a", "b", "concept"]), " ".join(rng.sample(words, rng.randint(0, 5)))) for i in range(60)]
    u, a = make(0), make(100)
    ddl = "id long, type string, norm_key string"
    got = {r.id: (r.candidate_id, round(r.score, 9)) for r in E.best_candidate(spark.createDataFrame(u, ddl), spark.createDataFrame(a, ddl), 0.5).collect()}
    want = {}
    for i, t, k in u:
        best = None
        for j, s, n in a:
            x, y = set(k.split()), set(n.split())
            if x and y and (t == s or "concept" in (t, s)) and (score := len(x & y) / len(x | y)) >= 0.5:
                best = max(best or (-1, 0), (score, -j))
        if best:
            want[i] = (-best[1], round(best[0], 9))
    assert got == want


def test_range_join_against_all_pairs(spark):
    rng = random.Random(4)
    chapters = [(i, rng.randint(0, 2), s, s + rng.choice([-1, 0, 3, 70, 500])) for i in range(80) for s in [rng.randint(1, 900)]]
    figures = [(i, rng.randint(0, 2), rng.randint(1, 1000)) for i in range(200)] + [(900, 0, None)]
    c, f = spark.createDataFrame(chapters, "id long, file_id long, page_start int, page_end int"), spark.createDataFrame(figures, "id long, file_id long, page int")
    want = {(i, j) for i, file, a, b in chapters for j, other, p in figures if file == other and p is not None and a <= p <= b}
    rows = structure.figures_of(c, f).collect()
    assert {(r.chapter_id, r.figure_id) for r in rows} == want and len(rows) == len(want)
    assert F is not None


def test_comentions_take_more_tasks_for_more_mentions(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 40), rng.randint(0, 150), rng.randint(0, 9)) for i in range(400)] + [(900 + i, 90 + i, 900 + i, i % 3) for i in range(9)]
    mentions = spark.createDataFrame(rows, "id long, entity_id long, chunk_id long, file_id long")
    found = lambda: sorted(map(tuple, E.comentions(mentions, cap=3).collect()))
    want = found()
    monkeypatch.setattr(E, "MENTIONS", 20)
    assert found() == want and E.comentions(mentions, cap=3).rdd.getNumPartitions() == 409 // 20 + 1
