import inspect

import numpy as np

import corpus_pipeline as C
from cairnbase.llm import queries

from .helpers import DOCS

NAMES = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_every_operator_is_registered():
    assert NAMES == set(range(1, 14)) and 4 <= len(C.STAGES) <= 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in C.STAGES)


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = {"en": [f"the{i}ing" for i in "abcdefghij"] + ["of", "and"], "de": [f"ge{i}ung" for i in "abcdefghij"] + ["und", "der"]}
    rows = [(i, " ".join(rng.choice(words[lang], 60)), lang, f"s{i % 3}", 0) for i, lang in enumerate(["en", "de"] * 60)]
    item = " ".join(rng.choice(words["en"], 24))
    rows += [(200, rows[0][1], "en", "s0", 0), (201, rows[1][1] + " und", "de", "s1", 0), (202, rows[2][1] + " " + item, "en", "s1", 0), (203, None, "en", None, 0), (204, "12 34", "en", "s1", 0)]
    write(spark, str(tmp_path), rows, [(0, item)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = {r["doc_id"] for r in docs.collect()}
        if name != C.STAGES[-1][0]:
            assert docs.columns == before
    assert {203, 204}.isdisjoint(seen["language"]) and set(range(120)) <= seen["language"]
    assert {200, 201}.isdisjoint(seen["near_duplicates"]) and set(range(120)) <= seen["near_duplicates"]
    assert seen["near_duplicates"] - seen["decontamination"] == {202}
    assert seen["token_files"] == seen["mixture"] <= seen["decontamination"]
    again = C.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_input(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert C.run(spark, str(tmp_path)).count() == 0
