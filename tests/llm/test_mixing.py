import itertools
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnbase.llm import mixing as M

from .helpers import clash, docs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 40))
def test_knapsack_is_best(items, budget):
    lengths, counts = map(list, zip(*items, strict=True))
    taken = M.knapsack(lengths, counts, budget)
    best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(lengths, c, strict=True))) <= budget)
    assert all(t <= n for t, n in zip(taken, counts, strict=True)) and sum(a * b for a, b in zip(lengths, taken, strict=True)) == best


def reachable(lengths, counts, budget):
    """The largest sum within budget, from the set of all sums."""
    sums = 1
    for n, c in zip(lengths, counts, strict=True):
        for _ in range(c if n else 0):
            sums |= sums << n
    sums &= (1 << (budget + 1)) - 1
    return sums.bit_length() - 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 50)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.integers(0, 100_000))
def test_fit_is_best(items, budget):
    lengths, counts = map(list, zip(*items, strict=True))
    taken = M.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
    assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == reachable(lengths, counts, budget)


def test_fit_is_best_for_long_documents():
    rng = np.random.default_rng(2)
    for _ in range(120):
        k = rng.integers(1, 6)
        lengths, counts = rng.choice(np.arange(3000, 20_001), k, replace=False).tolist(), rng.integers(1, 9, k).tolist()
        budget = int(rng.integers(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 1))
        assert sum(a * b for a, b in zip(lengths, M.fit_budget(lengths, counts, budget), strict=True)) == reachable(lengths, counts, budget)
    lengths, counts = [18114, 19390, 17567, 15652, 14930], [3, 3, 3, 2, 1]
    assert sum(a * b for a, b in zip(lengths, M.fit_budget(lengths, counts, 177_956), strict=True)) == reachable(lengths, counts, 177_956) > 177_600
    lengths, counts = list(range(2, 20_000)), [1000] * 19_998
    budget = sum(lengths) * 1000 // 3 + 1
    assert sum(a * b for a, b in zip(lengths, M.fit_budget(lengths, counts, budget), strict=True)) == budget


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 30)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 5000))
def test_no_sum_is_nearer_than_the_residue_gap(items, budget):
    lengths, counts = map(list, zip(*items, strict=True))
    assert budget - reachable(lengths, counts, budget) >= M.residue_gap(lengths, counts, budget)


def test_fit_has_bounded_work():
    """Budgets that no sum meets, or only one far from a proportional choice: in parts of a second and few MB."""
    rng = np.random.default_rng(5)
    sevens = [7 * int(x) for x in rng.choice(np.arange(10, 2800), 20, replace=False)]
    got = lambda lengths, counts, budget: sum(a * b for a, b in zip(lengths, M.fit_budget(lengths, counts, budget), strict=True))
    tracemalloc.start()
    began = time.perf_counter()
    for rest in range(7):  # modulo 7 only 0 and 20000 % 7 = 1 can be reached
        budget = sum(sevens) * 500 // 7 * 7 + rest
        assert got([*sevens, 20_000], [1000] * 20 + [1], budget) == budget - max(0, rest - 1)
    assert got([19_999, 20_000], [100_000, 100_000], 1_234_567_891) == 1_234_567_891
    budget = 50_000_003  # modulo 512 only multiples of 777, three at most
    assert got([512, 1024, 2048, 777], [100_000, 50_000, 20_000, 3], budget) == budget - min((budget - 777 * k) % 512 for k in range(4))
    assert time.perf_counter() - began < 20 and tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def rule(sizes, share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    texts = [" ".join(["w"] * (1 + i * 7 % 23)) for i in range(300)] + [None, "", " \n"]
    sources = [("hot" if i % 3 else f"s{i % 5}") for i in range(290)] + [None] * 13
    df = docs(spark, texts, sources)
    rows = M.mix_sources(df).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = rule(sizes)
    for s, n in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and abs(own[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    again = M.mix_sources(clash(df).repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_clashing_names_and_ties(spark):
    texts, ids = ["a b", "a b", "a c", "d e", "f"], [1, 1, 1, 2, None]
    plain = docs(spark, texts, ["x"] * 5, ids=ids)
    mixed = M.mix_sources(plain)
    odd = plain.selectExpr("*", "'k' as _size", "'k' as _ID", "'k' as _c", "'k' as __c", "'k' as _n", "'k' as _i", "'k' as _rows", "'k' as _s", "'k' as _bad")
    out = M.repeat_documents(odd, mixed)
    assert out.columns == odd.columns and out.where("_size <> 'k' or _i <> 'k'").count() == 0
    assert sorted((r["text"]) for r in out.collect()) == sorted(r["text"] for r in M.repeat_documents(plain, mixed).collect())
    assert out.count() == sum(r["copies"] for r in mixed.collect())
    again = M.mix_sources(plain.repartition(4))
    key = lambda r: (r["doc_id"] or 0, r["size"], r["copies"])
    assert sorted(map(key, mixed.collect())) == sorted(map(key, again.collect()))


def test_repeats_and_empty(spark):
    df = docs(spark, ["a b", "a b", "c d e", None], ["x", "x", "y", None], ids=[1, 1, 2, 3])
    mixed = M.mix_sources(df)
    out = M.repeat_documents(clash(df), mixed)
    assert out.columns[:5] == df.columns and out.count() == sum(r["copies"] for r in mixed.collect())
    assert M.mix_sources(docs(spark, [])).count() == 0
