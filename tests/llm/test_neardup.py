import numpy as np
import pytest

from cairnbase.llm import neardup as N

from .helpers import clash, docs


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts, ids):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sets, [least[find(i)] for i in range(len(sets))]


def corpus(seed, groups=12, size=10):
    rng = np.random.default_rng(seed)
    vocab = [f"v{i}" for i in range(4000)]
    texts = []
    for g in range(groups):
        base = list(rng.choice(vocab, rng.integers(3, 150)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, size)):
            copy = list(base)
            for i in np.flatnonzero(rng.random(len(copy)) < rng.choice([0.0, 0.01, 0.02, 0.05])):
                copy[i] = str(rng.choice(vocab))
            texts.append(("  " if g % 2 else "\n").join(copy).title() if rng.random() < 0.3 else " ".join(copy))
    order = rng.permutation(len(texts))
    return [texts[i] for i in order] + [None, "", " \t", "one two", "ONE  two", "one two three"]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    texts = corpus(seed)
    ids = [1000 - 3 * i for i in range(len(texts))]
    sets, want = brute(texts, ids)
    got = {r["doc_id"]: r for r in N.link_documents(clash(docs(spark, texts, ids=ids)).repartition(3)).collect()}
    assert [got[i]["n_shingles"] for i in ids] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in ids] == want
    assert all(got[i]["kept"] == (i == c) for i, c in zip(ids, want, strict=True))


def test_one_large_group_whose_members_are_unlike(spark):
    """Many copies of one text, edited until most are linked to the first alone or to nothing."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(90):
        copy = list(base)
        for i in rng.choice(120, 1 + k % 9, replace=False):
            copy[i] = f"x{k}_{i}"
        texts.append(" ".join(copy))
    for k in range(30):  # with a tail that many share
        texts.append(" ".join(texts[1 + k].split()[: 60 + k] + [f"t{i}" for i in range(40)]))
    _, want = brute(texts, list(range(len(texts))))
    got = {r["doc_id"]: r["component_id"] for r in N.link_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def excerpts(n):
    """Parts of one text: most are linked by way of others only."""
    rng = np.random.default_rng(5)
    size = rng.integers(110, 150, n)
    return [" ".join(f"b{i}" for i in range(s, s + k)) for k, s in zip(size, rng.integers(0, 200 - size + 1), strict=True)]


def edited(n):
    """Copies of one text with edits of their own, about a third of them too many for any link."""
    rng = np.random.default_rng(6)
    copies = []
    for k in range(n):
        words = [f"b{i}" for i in range(150)]
        for i in np.flatnonzero(rng.random(150) < rng.uniform(0, 0.09)):
            words[i] = f"x{k}_{i}" if i % 3 else ""
        copies.append(" ".join(words))
    return copies


@pytest.mark.parametrize("kind", [excerpts, edited])
def test_candidates_grow_in_proportion(spark, monkeypatch, kind):
    """Twice the copies of one text: about twice the candidate pairs, and the components of all pairs."""
    judged, judge = [], N._judge
    monkeypatch.setattr(N, "_judge", lambda pairs, *rest: (judged.append(pairs.count()), judge(pairs, *rest))[1])
    made = []
    for n in (150, 300):
        judged.clear()
        texts = kind(n)
        got = {r["doc_id"]: r["component_id"] for r in N.link_documents(docs(spark, texts)).collect()}
        assert [got[i] for i in range(n)] == brute(texts, list(range(n)))[1]
        made.append(sum(judged))
    assert made[1] < 2.7 * made[0], made


def test_pair_without_a_common_leader(spark, monkeypatch):
    """Two linked texts in one bucket, each near to the leader that the other is far from."""
    common, x, y = ([f"{k}{i}" for i in range(n)] for k, n in (("c", 90), ("x", 14), ("y", 14)))
    texts = [" ".join(t) for t in (common + x, common + y, common[-4:] + x, common[-4:] + y)]
    rows = N.signatures_of(docs(spark, texts)).collect()
    node = {r["doc_id"]: r["node"] for r in rows}
    # the leaders, 2 before 3, have company in buckets of their own
    bands = [(1, node[i]) for i in range(4)] + [(2, node[2]), (2, 5), (3, node[2]), (3, 6), (4, node[3]), (4, 7)]
    monkeypatch.setattr(N, "_bands", lambda _: spark.createDataFrame(bands, "band long, node long"))
    found = {tuple(sorted((r["component_id"], r["doc_id"]))) for r in N.link_documents(docs(spark, texts)).collect()}
    assert found == {(0, 0), (0, 1), (2, 2), (3, 3)}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = N.link_documents(docs(spark, [text, text, "other words", None, text], ids=[7, 7, 7, None, None])).collect()
    assert len(got) == 5 and {(r["doc_id"], r["component_id"]) for r in got} == {(7, 7), (None, None), (None, 7)}
    kept = N.drop_near_duplicates(docs(spark, [text, text + " more", "other", None], ids=[3, 2, 5, 9]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 9]


def test_null_ids_are_compared(spark):
    a, b, c = ([f"{k}{i}" for i in range(60)] for k in "abc")
    near = lambda words: " ".join([*words, "more"])
    texts = [" ".join(a), near(a), near(a), " ".join(b), near(b), " ".join(c), None, "", ""]
    df = docs(spark, texts, ids=[None, None, None, None, 4, None, None, None, None]).repartition(3)
    got = N.link_documents(df).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["component_id"]) == [(56, 4), (57, 4)]
    assert [r["kept"] for r in got if r["component_id"]] == [r["doc_id"] == 4 for r in got if r["component_id"]]
    assert sum(r["kept"] for r in got) == 1 + 1 + 1 + 3  # a's group, b's, c, and each empty text
    kept = [r["text"] for r in N.drop_near_duplicates(df).collect()]
    assert len(kept) == 6 and {texts[4], texts[5], None, ""} < set(kept) and len({*texts[:2]} & set(kept)) == 1


def test_empty(spark):
    assert N.link_documents(docs(spark, [])).count() == 0


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    for j, least in ((0.75, 0.9999), (0.9, 1.0)):
        a = rng.integers(0, 1 << 30, (20_000, N.HASHES), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < j, a, a + 1)
        assert N.likely(a, b, 0.75).mean() >= least
    assert N.likely(a, a + 1, 0.75).sum() == 0
    assert [n for n, _ in N.least_matches(0.75)] == list(range(16, 97, 16))


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in N.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
