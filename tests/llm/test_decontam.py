from itertools import combinations
from math import ceil

import numpy as np

from cairnbase.llm import decontam as D

from .helpers import clash, docs

RNG = np.random.default_rng(7)
VOCAB = [f"w{i}" for i in range(3000)]


def some(n):
    return list(RNG.choice(VOCAB, n))


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_planted_passages(spark):
    items = [" ".join(some(n)) for n in (40, 25, 60, 7)] + [None, "", "one two"]
    swapped = items[0].split()
    for i in range(3, 40, 6):
        swapped[i] = "changed"
    texts = [
        " ".join(some(50)) + " " + items[0].upper().replace(" ", ", ") + " " + " ".join(some(20)),  # punctuation and case
        " ".join(some(10) + swapped + some(10)),  # a substitution every six words
        " ".join(items[2].split()[20:45]),  # a part
        " ".join(some(5)) + " " + items[3],  # a short item, whole
        " ".join(some(5) + items[3].split()[:6]),  # a short item, not whole
        " ".join(some(500)), None, "", "one two " * 50,
        " ".join(items[1].split()[:8] + some(30)),  # eight words are not a passage
        " ".join(some(20000)) + " " + items[1],
    ]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_overlaps(clash(docs(spark, texts)), bench(spark, items)).collect()}
    assert got == {(0, 0), (1, 0), (2, 2), (3, 3), (10, 1)}
    df = docs(spark, texts)
    assert {r["doc_id"] for r in D.remove_contaminated(df, bench(spark, items)).collect()} == {4, 5, 6, 7, 8, 9}


def test_every_tolerated_substitution_is_found(spark):
    items = [some(n) for n in (10, 11, 12, 16, 40)]
    texts, want = [], set()
    for k, item in enumerate(items):
        part = item[13:29] if len(item) > 16 else item  # of the long item a window is all that the text has
        few = len(part) - ceil(len(part) * D.AGREE)
        for gone in combinations(range(len(part)), few):
            want.add((len(texts), k))
            texts.append(" ".join(["before", *("changed" if i in gone else w for i, w in enumerate(part)), "after"]))
        texts.append(" ".join(["changed" if i % 3 == 0 else w for i, w in enumerate(part)]))  # too many
    texts.append(" ".join(items[3][4:]))  # 12 of 16 words at the end of the item
    want.add((len(texts) - 1, 3))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_overlaps(docs(spark, texts), bench(spark, map(" ".join, items))).collect()}
    assert got == want


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    items = [" ".join(some(30)) for _ in range(5)]
    texts = [" ".join(some(30) + items[i % 5].split() + some(5)) for i in range(12)]
    run = lambda: sorted(map(tuple, D.find_overlaps(docs(spark, texts), bench(spark, items)).collect()))
    near = run()
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1)
    assert run() == near and len(near) == 12


def test_repeated_and_null_ids(spark):
    item = " ".join(some(30))
    df = docs(spark, [item, item, "x " + item, "clean words"], ids=[None, 1, 1, None])
    got = D.find_overlaps(df, bench(spark, [item])).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["matched"]) for r in got) == [(0, 0, 30), (1, 0, 30)]


def test_empty(spark):
    assert D.find_overlaps(docs(spark, []), bench(spark, ["a b c d e f g h i j k"])).count() == 0
    assert D.find_overlaps(docs(spark, ["a b c d e f g h i j k"]), bench(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = D.find_overlaps(docs(spark, ["a"]), bench(spark, ["b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_clashing_name_and_short_items(spark):
    item = " ".join(some(20))
    table = docs(spark, [item, "clean words", None], ids=[1, 2, None]).selectExpr("*", "'k' as bad", "'k' as _bad")
    kept = D.remove_contaminated(table, bench(spark, [item, "only three words"]))
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {2, None}
    assert [r["n_words"] for r in D.unsearchable_items(bench(spark, [item, "only three words"])).collect()] == [3]
