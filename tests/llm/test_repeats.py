import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnbase.llm import repeats as R

from .helpers import clash, docs


def brute(texts, least=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet="abcdefgh é"):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [make(rng.randint(90, 300)) for _ in range(5)]
    texts = [None, "", "x" * 99, "y" * 100, "y" * 101, "z" * 450, "ab" * 200, "ab" * 150]
    for _ in range(60):
        parts = [make(rng.randint(0, 200)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts.insert(rng.randint(0, len(parts)), p[a : len(p) - rng.randint(0, 40)])
        texts.append("".join(parts))
    texts += texts[8:14] + [passages[0] * 3, texts[20] + "!" + texts[21]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed, "abcdefgh é" if seed else "ab")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(clash(docs(spark, texts)).repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    texts = corpus(5)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(docs(spark, texts), texts=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_and_null_ids(spark):
    a, b = "one passage " * 10, "another text, " * 12
    rows = R.remove_repeats(docs(spark, [a, a, b, a + b, a], ids=[1, 1, 1, None, 2])).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in rows)
    one, other, both = brute([a])[0][1], brute([b])[0][1], brute([a, b, a + b])[2][1]
    assert got == sorted([(False, 1, len(a), one), (False, 1, len(a), one), (False, 1, len(b), other), (False, 2, len(a), len(a)), (True, 0, len(a + b), both)])


def test_empty(spark):
    assert R.remove_repeats(docs(spark, [])).count() == 0


def all_repeats(texts, least):
    """Maximal repeats by definition."""
    places = {}
    for i, t in enumerate(texts):
        for n in range(least, len(t) + 1):
            for p in range(len(t) - n + 1):
                places.setdefault(t[p : p + n], []).append((i, p))
    out = set()
    for s, at in places.items():
        left = {texts[i][p - 1] if p else ("start", i) for i, p in at}
        right = {texts[i][p + len(s)] if p + len(s) < len(texts[i]) else ("end", i) for i, p in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(s), tuple(sorted(at))))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12).map(str.encode), min_size=1, max_size=4))
def test_maximal_repeats_by_definition(texts):
    assert {(n, tuple(at)) for n, at in R.maximal_repeats(texts, 2)} == all_repeats(texts, 2)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60))
def test_suffix_array(data):
    order, lcp = R.suffix_array(data)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    for i in range(1, len(want)):
        a, b = data[want[i - 1] :], data[want[i] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[i] == n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.randoms())
def test_reach_of_earlier_entries(common, rng):
    place = list(range(len(common)))
    rng.shuffle(place)
    want = [max([min(common[min(i, j) + 1 : max(i, j) + 1]) for j in range(len(place)) if place[j] < place[i]], default=-1) for i in range(len(place))]
    assert R.earlier_reach(place, common) == want


def test_every_window_has_the_same_anchor_wherever_it_stands():
    rng = random.Random(2)
    piece = bytes(rng.choice(b"abcd") for _ in range(100))
    for before in (b"", b"x" * 7, b"abcd" * 50):
        _, pos, a, _, _ = R.anchors_of([before + piece + b"tail" * 30])
        at = {int(h) for p, h in zip(pos, a, strict=True) if len(before) <= p <= len(before) + R.REACH}
        alone = {int(h) for h in R.anchors_of([piece])[2]}
        assert alone <= at
