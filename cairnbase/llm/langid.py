"""Language identification by interpolated Kneser-Ney character models.

A model predicts the letters of each word from the letters before it in the word, up to ``ORDER`` - 1 of them and
the space before the word. N-grams are kept as sorted 64-bit hashes, one array for each order with a column of
discounted probabilities and back-off weights for each language, and looked up by binary search. Since no context
crosses a word, a word has one score, which a worker computes once. The language with the lowest cross-entropy for
each character is chosen; texts whose best cross-entropy is above that language's limit, calibrated on training texts
that the model has not counted, are rejected.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, lean, scratch, trim

ORDER = 5
#: Texts of each language that a model is fitted on, about: the bound of the training sample.
TEXTS = 2500
#: One in so many of the sampled texts calibrates the rejection instead.
CALIBRATE = 8
#: Texts of fewer characters are too short to be rejected.
ENOUGH = 40
#: A text is rejected if its cross-entropy is above this quantile of its language's calibration texts by the factor.
#: What the quantile leaves above it may be mislabelled or garbled.
QUANTILE = 0.95
SLACK = 1.25
#: Word scores that a worker keeps.
CACHE = 300_000
UNKNOWN = "und"
letters = re.compile(r"[^\W\d_]+").findall


def in_training(doc_id: Column) -> Column:
    """True for four of five documents, by the checksum of the id's text (null: as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _keys(words: list[str], order: int):
    """Of the words, each between spaces: codes of the characters, place of each in its word, and for each order
    the hashes of the n-grams that end there."""
    text = "".join([f" {w}" for w in words]) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter((len(w) for w in words), np.int64, len(words)) + 2
    starts = np.cumsum(n) - n
    # the closing space of a word is the opening one of the next in text, so each gets its own here
    source = np.arange(n.sum()) - np.repeat(np.arange(len(words)), n)
    codes, place = codes[source], np.arange(n.sum()) - np.repeat(starts, n)
    h, out = np.zeros(len(codes), np.uint64), []
    for k in range(1, order + 1):
        # the n-gram that ends at i is the shorter one that ends at i - 1, and the character at i
        h = np.concatenate((h[:1], h[:-1])) * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(k)
        x = h ^ h >> np.uint64(29)
        out.append(x * np.uint64(0xBF58476D1CE4E5B9))
    return codes, place, n, starts, out


class Model:
    """Sorted n-gram hashes by order with, for each language, the discounted probability and the back-off weight."""

    def __init__(self, langs: list[str], keys: list, alphas: list, lambdas: list, start: np.ndarray, size: int):
        self.langs, self.keys, self.alphas, self.lambdas, self.start, self.size = langs, keys, alphas, lambdas, start, size
        self.limits = [float("inf")] * len(langs)

    @classmethod
    def fit(cls, counts: dict[str, Counter], order: int = ORDER) -> Model:
        langs = sorted(counts)
        grams = []  # by language: for each order the n-grams, their counts, contexts and suffixes
        alphabet = set()
        for lang in langs:
            words = sorted(counts[lang])
            codes, place, n, _, hashed = _keys(words, order)
            alphabet.update(np.unique(codes).tolist())
            weight = np.repeat(np.fromiter((counts[lang][w] for w in words), np.int64, len(words)), n)
            per = []
            for k in range(1, order + 1):
                at = np.flatnonzero(place >= max(1, k - 1))  # a space that opens a word is not predicted
                key, first, inverse = np.unique(hashed[k - 1][at], return_index=True, return_inverse=True)
                at0 = at[first]
                per.append({
                    "key": key,
                    "raw": np.bincount(inverse, weight[at], len(key)),
                    "context": hashed[k - 2][at0 - 1] if k > 1 else np.zeros(len(key), np.uint64),
                    "suffix": hashed[k - 2][at0] if k > 1 else None,
                    "opens": place[at0] == k - 1,
                })
            grams.append(per)
        keys, alphas, lambdas, start = [], [], [], np.ones(len(langs))
        for k in range(order):
            keys.append(np.unique(np.concatenate([g[k]["key"] for g in grams])) if grams else np.empty(0, np.uint64))
            alphas.append(np.zeros((len(keys[k]), len(langs)), np.float32))
            lambdas.append(np.ones((len(keys[k]), len(langs)), np.float32))
        for j in range(len(grams)):
            per, grams[j] = grams[j], None
            for k, g in enumerate(per):
                count = g["raw"].astype(float)
                if k + 1 < order:  # how many characters come before it; at the start of a word none can
                    longer, times = np.unique(per[k + 1]["suffix"], return_counts=True)
                    at = np.searchsorted(longer, g["key"]).clip(0, max(0, len(longer) - 1))
                    known = (longer[at] == g["key"]) if len(longer) else np.zeros(len(at), bool)
                    count = np.where(g["opens"] | ~known, count, times[at] if len(longer) else count)
                n1, n2 = (count == 1).sum(), (count == 2).sum()
                discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
                context, inverse = np.unique(g["context"], return_inverse=True)
                total, kinds = np.bincount(inverse, count), np.bincount(inverse)
                alphas[k][np.searchsorted(keys[k], g["key"]), j] = np.maximum(count - discount, 0) / total[inverse]
                rest = np.bincount(inverse, np.minimum(count, discount)) / total
                if k == 0:
                    start[j] = rest[0]
                else:
                    at = np.searchsorted(keys[k - 1], context)
                    ok = at < len(keys[k - 1])
                    ok[ok] = keys[k - 1][at[ok]] == context[ok]  # the space that opens a word is a context but not predicted
                    lambdas[k - 1][at[ok], j] = rest[ok]
                    if not ok.all():
                        place_of = np.searchsorted(keys[k - 1], context[~ok])
                        keys[k - 1] = np.insert(keys[k - 1], place_of, context[~ok])
                        alphas[k - 1] = np.insert(alphas[k - 1], place_of, 0, axis=0)
                        lambdas[k - 1] = np.insert(lambdas[k - 1], place_of, 1, axis=0)
                        lambdas[k - 1][np.searchsorted(keys[k - 1], context), j] = rest
        # a last row for n-grams that are not there, which place -1 takes: no probability, full back-off
        alphas = [np.vstack([a, np.zeros((1, len(langs)), np.float32)]) for a in alphas]
        lambdas = [np.vstack([x, np.ones((1, len(langs)), np.float32)]) for x in lambdas]
        return cls(langs, keys, alphas, lambdas, start, len(alphabet) + 1)

    def written(self, spark: SparkSession) -> str:
        """Path of a copy in the shared folder: a task reads it and drops it when done, so that no worker keeps it."""
        path = f"{scratch(spark, 'langid')}.npz"
        fs, at = filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        arrays = {f"{name}{k}": x for name in ("keys", "alphas", "lambdas") for k, x in enumerate(getattr(self, name))}
        held = io.BytesIO()
        np.savez(held, langs=np.array(self.langs, "U"), start=self.start, size=self.size, limits=np.array(self.limits, float), **arrays)
        with fs.open_output_stream(at) as sink:
            sink.write(held.getbuffer())
        return path

    @staticmethod
    def read(path: str) -> Model:
        fs, at = filesystem(path)
        with fs.open_input_stream(at) as source:
            found = np.load(io.BytesIO(source.read()), allow_pickle=False)
        order = sum(name.startswith("keys") for name in found.files)
        by_order = [[found[f"{name}{k}"] for k in range(order)] for name in ("keys", "alphas", "lambdas")]
        model = Model([str(x) for x in found["langs"]], *by_order, found["start"], int(found["size"]))
        model.limits = found["limits"].tolist()
        return model

    def _find(self, k: int, hashed: np.ndarray) -> np.ndarray:
        """Place of each n-gram in its order's array, or -1."""
        keys = self.keys[k]
        if not len(keys):
            return np.full(len(hashed), -1)
        at = np.searchsorted(keys, hashed).clip(0, len(keys) - 1)
        return np.where(keys[at] == hashed, at, -1)

    def words(self, words: list[str]) -> np.ndarray:
        """Bits of each word by language: its letters and the space after it."""
        if not words:
            return np.empty((0, len(self.langs)))
        out = []
        for i in range(0, len(words), 4000):
            _, place, n, starts, hashed = _keys(words[i : i + 4000], len(self.keys))
            p, before = np.full((len(place), len(self.langs)), 1.0 / self.size), None
            for k in range(len(self.keys)):
                found = self._find(k, hashed[k])
                valid = place >= max(1, k)
                if k == 0:
                    weight = self.start
                else:
                    weight = self.lambdas[k - 1][np.concatenate(([-1], before[:-1]))]
                p = np.where(valid[:, None], self.alphas[k][found] + weight * p, p)
                before = found
            bits = -np.log2(p)
            bits[starts] = 0
            out.append(np.add.reduceat(bits, starts))
        return np.concatenate(out)


def bits_of(model: Model, texts: Iterator[str], cache: dict, scores: list) -> Iterator[tuple[np.ndarray, int]]:
    """For each text its bits by language and its characters (letters and a space for each word)."""
    held = [letters(t.lower()) for t in texts]
    fresh = [w for w in dict.fromkeys(w for ws in held for w in ws) if w not in cache]
    table = np.concatenate([scores[0], model.words(fresh)]) if fresh else scores[0]
    own = dict(zip(fresh, range(len(cache), len(cache) + len(fresh)), strict=True)) if fresh else {}
    if len(cache) + len(fresh) <= CACHE:
        cache.update(own)
        scores[0], own = table, cache
        find = cache.__getitem__
    elif fresh:
        find = lambda w: own[w] if w in own else cache[w]
    else:
        find = cache.__getitem__
    for ws in held:
        at = np.fromiter(map(find, ws), np.int64, len(ws))
        yield table[at].sum(0), sum(map(len, ws)) + len(ws)


def choice(model: Model, bits: np.ndarray, n: int) -> tuple[str, float, float | None, bool]:
    """Language, posterior, bits a character and rejection of a text of n characters with these bits by language."""
    if not n or not model.langs:
        return UNKNOWN, 0.0, None, True
    rate = bits / n
    best = int(rate.argmin())
    p = 1 / np.exp2((rate[best] - rate) * min(n, 40)).sum()
    return model.langs[best], float(p), float(rate[best]), n >= ENOUGH and bool(rate[best] > model.limits[best])


def train(docs: DataFrame, texts: int = TEXTS, order: int = ORDER) -> Model:
    """A model of docs (text, lang): of each language about ``texts`` distinct texts, drawn by hash, whole.

    Rows with a null text or language are left out; an empty table gives a model without languages. Word counts of
    the sample, which the bound on its texts bounds, are all that reaches the driver.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model.fit({}, order)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, texts / n))) for k, n in sorted(sizes.items())])
    drawn = (F.xxhash64(F.lit("langid"), "text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)) < share
    sample = known.where(drawn).dropDuplicates(["lang", "text"]).withColumn("calibrate", F.pmod(F.xxhash64(F.lit("split"), "text"), F.lit(CALIBRATE)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(letters(text.lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "word", "n"])

    words = sample.where(~F.col("calibrate")).select("text", "lang").mapInArrow(lean(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pa.set_memory_pool(pa.system_memory_pool())
    table = words.toArrow()
    counts: dict[str, Counter] = {}
    for batch in table.to_batches():
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            counts.setdefault(lang, Counter())[word] = n
    del table
    model = Model.fit(counts, order)
    del counts
    trim()
    if model.langs:
        label = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang"))
        held = identify(sample.where(F.col("calibrate")).select(label.cast("long").alias("doc_id"), "text"), model).where(F.col("n_chars") >= ENOUGH)
        own = held.where(F.get(F.array(*map(F.lit, model.langs)), F.col("doc_id").cast("int") - 1) == F.col("lang_pred"))
        high = {r["lang_pred"]: r["high"] * SLACK for r in own.groupBy("lang_pred").agg(F.percentile("bits", F.lit(QUANTILE)).alias("high")).collect()}
        model.limits = [high.get(lang, max(high.values(), default=float("inf"))) for lang in model.langs]
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits, n_chars, rejected for every row of docs (doc_id, text).

    lang_pred is the language with the fewest bits a character (ties: the first by name), or ``und`` for a text that
    is null, empty or without a letter, or where the model has no language. score is the posterior of the choice
    over at most 40 characters at equal priors, 0 for ``und``. rejected: ``und``, or bits above the language's limit in a text
    of ENOUGH characters.
    """
    path = model.written(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("n_chars", pa.int64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.read(path)
        cache, scores = {}, [np.empty((0, len(model.langs)))]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = []
                for doc_id, (bits, n) in zip(part.column("doc_id").to_pylist(), bits_of(model, (t or "" for t in part.column("text").to_pylist()), cache, scores), strict=True):
                    lang, score, rate, rejected = choice(model, bits, n)
                    rows.append((doc_id, lang, score, rate, n, rejected))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, bits double, n_chars long, rejected boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects, lang set to the prediction; other columns stay.

    Texts are labelled where they stand: rows are not joined, so repeated and null ids keep their own texts' labels.
    """
    names, path = docs.columns, model.written(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.read(path)
        cache, scores = {}, [np.empty((0, len(model.langs)))]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                labels = [choice(model, bits, n) for bits, n in bits_of(model, (t or "" for t in part.column("text").to_pylist()), cache, scores)]
                kept = part.set_column(names.index("lang"), "lang", pa.array([x[0] for x in labels], part.schema.field("lang").type))
                yield kept.filter(pa.array([not x[3] for x in labels]))

    return docs.mapInArrow(lean(run), docs.schema)


def label_documents(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """Train on four fifths of docs (doc_id, text, lang) and predict every row; adds held_out."""
    model = train(docs.where(in_training(F.col("doc_id"))), texts)
    return identify(docs, model).withColumn("held_out", ~in_training(F.col("doc_id")))
