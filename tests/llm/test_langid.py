import math
from collections import Counter

import numpy as np

from cairnbase.llm import langid as L

from .helpers import clash, docs

WORDS = {"en": "the of and with that this from thing other where", "de": "und der die das nicht mit schön straße über ein"}


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(lang, " ".join(rng.choice(w.split(), 12))) for lang, w in WORDS.items() for _ in range(n)]


def test_probabilities_sum_to_one():
    model = L.Model.fit({"en": Counter(WORDS["en"].split()), "de": Counter(WORDS["de"].split())})
    letters = sorted({c for w in WORDS.values() for c in w if c != " "})
    for context in ("", "th", "sch", "zz"):
        end = 2 ** -(model.words([context])[0] - prefix_bits(model, context)) if context else 2 ** -model.words([""])[0]
        total = end + sum(2 ** -(prefix_bits(model, context + c) - prefix_bits(model, context)) for c in letters)
        # the rest is what the uniform base gives to unknown characters
        assert (total <= 1 + 1e-6).all() and (total > 0.9).all()


def prefix_bits(model, text):
    """Bits of the letters of text at the start of a word, without its end."""
    if not text:
        return np.zeros(len(model.langs))
    # the bits of a word are those of its letters and of the space after; the letters' alone come from a longer word
    _, place, n, starts, hashed = L._keys([text], len(model.keys))
    p, before = np.full((len(place), len(model.langs)), 1.0 / model.size), None
    for k in range(len(model.keys)):
        found = model._find(k, hashed[k])
        weight = model.start if k == 0 else np.where((np.concatenate(([-1], before[:-1])) >= 0)[:, None], model.lambdas[k - 1][np.concatenate(([-1], before[:-1]))], 1.0)
        p = np.where((place >= max(1, k))[:, None], np.where((found >= 0)[:, None], model.alphas[k][found], 0.0) + weight * p, p)
        before = found
    return -np.log2(p[1 : len(text) + 1]).sum(0)


def test_words_are_scored_alone():
    model = L.Model.fit({"en": Counter(WORDS["en"].split())})
    words = ["the", "xyz", "", "thething"]
    assert np.allclose(model.words(words), np.concatenate([model.words([w]) for w in words]))
    assert (model.words(["the"]) < model.words(["xqz"])).all()


def test_held_out_accuracy_and_rejection(spark):
    rows = texts(150)
    df = docs(spark, [t for _, t in rows], langs=[lang for lang, _ in rows])
    got = {r["doc_id"]: r for r in L.label_documents(clash(df)).collect()}
    assert len(got) == len(rows)
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 30 and all(got[i]["lang_pred"] == rows[i][0] for i in held)
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in got.values())


def test_odd_texts(spark):
    rows = texts(40)
    odd = [None, "", "12 ?!", "漢字仮名交じり文の長い文章です" * 5, "the " * 40000, "the"]
    df = docs(spark, [t for _, t in rows] + odd, langs=[lang for lang, _ in rows] + [None] * len(odd))
    model = L.train(df)
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    labels = [(got[len(rows) + i]["lang_pred"], got[len(rows) + i]["rejected"]) for i in range(len(odd))]
    assert labels[:3] == [("und", True)] * 3 and labels[3][1] and labels[4] == ("en", False) and labels[5][0] == "en"
    kept = L.keep_accepted(clash(df), model)
    assert kept.columns == clash(df).columns and kept.count() == len(rows) + 2
    assert got[len(rows)]["score"] == 0


def test_garbled_training_texts_do_not_lift_the_limit(spark):
    rng = np.random.default_rng(1)
    noise = lambda: " ".join("".join(rng.choice(list("qxjzkvwpyfgb"), 7)) for _ in range(12))
    rows = texts(400) + [("en", noise()) for _ in range(12)]  # so many that some calibrate
    model = L.train(docs(spark, [t for _, t in rows], langs=[lang for lang, _ in rows]))
    probes = [noise() for _ in range(20)] + [t for _, t in texts(20, seed=5)]
    got = {r["doc_id"]: r["rejected"] for r in L.identify(docs(spark, probes), model).collect()}
    assert [got[i] for i in range(40 + 20)] == [True] * 20 + [False] * 40


def test_no_training_data(spark):
    df = docs(spark, ["the thing"], langs=[None])
    assert L.identify(df, L.train(df)).head()["lang_pred"] == "und"
    assert L.label_documents(docs(spark, [])).count() == 0


def test_training_leaves_held_out_rows_aside(spark):
    import zlib

    df = docs(spark, ["x"] * 50)
    got = {r["doc_id"] for r in df.where(L.in_training(df["doc_id"])).collect()}
    assert got == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}


class Plain:
    """Interpolated Kneser-Ney over strings, by the textbook: dictionaries of n-grams, one probability at a time."""

    def __init__(self, words, order, size):
        self.order, self.size = order, size
        raw = [Counter() for _ in range(order + 1)]
        for w, times in words.items():
            s = f" {w} "
            for i in range(1, len(s)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        raw[k][s[i - k + 1 : i + 1]] += times
        opening = {f" {w} "[:k] for w in words for k in range(2, order + 1)}
        self.count = raw
        for k in range(1, order):
            before = Counter(g[1:] for g in raw[k + 1])
            self.count[k] = {g: n if g in opening or g not in before else before[g] for g, n in raw[k].items()}
        self.discount = [0.0]
        for k in range(1, order + 1):
            n1, n2 = (sum(n == m for n in self.count[k].values()) for m in (1, 2))
            self.discount.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5)))

    def p(self, context, c, k):
        if not k:
            return 1 / self.size
        d, same = self.discount[k], {g: n for g, n in self.count[k].items() if g[:-1] == context[len(context) - k + 1 :]}
        lower = self.p(context, c, k - 1)
        if not same:
            return lower
        total = sum(same.values())
        own = same.get(context[len(context) - k + 1 :] + c, 0)
        return max(own - d, 0) / total + sum(min(n, d) for n in same.values()) / total * lower

    def bits(self, word):
        s = f" {word} "
        return sum(-math.log2(self.p(s[:i], s[i], min(self.order, i + 1))) for i in range(1, len(s)))


def test_against_dictionaries():
    rng = np.random.default_rng(8)
    counts = {}
    for lang, letters in (("xx", "abcd"), ("yy", "bcdeé")):
        counts[lang] = Counter("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(60))
    model = L.Model.fit(counts)
    words = [*counts["xx"], *counts["yy"], "zebra", "q", "abab", "dé"]
    got = model.words(words)
    for j, lang in enumerate(model.langs):
        plain = Plain(counts[lang], L.ORDER, model.size)
        assert np.allclose(got[:, j], [plain.bits(w) for w in words], rtol=1e-4)


def test_written_and_read(spark):
    model = L.Model.fit({"a": Counter({"one": 2}), "b": Counter({"uno": 1})})
    model.limits = [3.5, float("inf")]
    again = L.Model.read(model.written(spark))
    assert again.langs == model.langs and again.limits == model.limits and (again.words(["one", "x"]) == model.words(["one", "x"])).all()
