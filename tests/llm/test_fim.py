import hashlib
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnbase.llm import fim

from .helpers import clash, docs


def brute(doc_id, text):
    """n, form, output, prefix_chars, middle_chars by splitting a text into its lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", text, None, None
    i, j = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(lines), *out, len(p), len(m)


TEXTS = [None, "", "one", "one\ntwo\n", "\n\n\n", "a\r\nb\nc", "has <P> mark\nx", "<M>", "é漢🙂\n🙂x\ny", " \n", "same\nrows\nhere", "same\nrows\nhere", "line\n" * 50000 + "end"]


def test_against_brute_force(spark):
    ids = [*range(len(TEXTS) - 3), 5, 5, None]
    df = docs(spark, TEXTS, ids=ids)
    for given_docs in (df, clash(df).withColumnRenamed("signature", "output").repartition(3)):
        made = fim.fill_in_middle(given_docs)
        made = made.withColumn("back", fim.restored("output", "form")).withColumn("sha", fim.restored_sha256("output", "form"))
        got = sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.output_sha256, r.back, r.sha) for r in made.collect()), key=str)
        want = []
        for i, text in zip(ids, TEXTS, strict=True):
            b = brute(i, text)
            want.append((i, *b, hashlib.sha256(b[2].encode()).hexdigest(), text or "", hashlib.sha256((text or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)


def test_large_ids_are_exact(spark):
    ids = [2**60 + 1, None, -3]
    got = {r.doc_id: r.output for r in fim.fill_in_middle(docs(spark, ["a\nb\nc\nd"] * 3, ids=ids)).collect()}
    assert got == {i: brute(i, "a\nb\nc\nd")[2] for i in ids}


def test_empty_table(spark):
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\r é🙂<PSM>", max_size=40), st.integers(0, 10**6), st.integers(0, 100))
def test_round_trip(text, doc_id, spm):
    unit = regex.compile(fim.LINES)
    n, form, output, prefix, middle = fim.arrange(text, str(doc_id), unit, 7, 100, spm)
    assert fim.rebuild(output, form) == text
    if form != "plain":
        assert 0 <= prefix and prefix + middle <= len(text) and len(output) == len(text) + 9


@pytest.mark.parametrize(("rate", "spm", "forms"), [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_rates(rate, spm, forms):
    unit = regex.compile(fim.LINES)
    assert {fim.arrange("a\nb\n", str(i), unit, 7, rate, spm)[1] for i in range(300)} == forms


def test_other_units():
    words = regex.compile(r"\S*\s+|\S+")
    for i in range(50):
        n, form, output, _, _ = fim.arrange("one two  three\nfour", str(i), words, 1, 100, 50)
        assert n == 4 and fim.rebuild(output, form) == "one two  three\nfour"
