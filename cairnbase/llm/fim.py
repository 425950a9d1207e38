"""Fill-in-the-middle: texts cut at two unit ends, the middle moved behind the suffix.

Arrow batches go through pandas functions: the regex library's finditer gives the unit ends, kept as one compact array
of offsets; two lookups in it say where the text is sliced; hashlib gives the seeds and the digests. No shuffle.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A line with its end, or the rest of a text that has none.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT = "n long, form string, output string, prefix_chars long, middle_chars long, output_sha256 string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Code points before each unit's end, from 0 for none on: one unsigned 32-bit integer each."""
    ends = array("I", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(seed: int, doc_id: str | None) -> list[int]:
    """The first four groups of 8 hexadecimal digits of a document's digest, as integers; a null id counts as empty."""
    text = digest(f"{seed}:{doc_id or ''}")
    return [int(text[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: str, doc_id: str | None, unit: regex.Pattern, seed: int, rate: int, spm: int) -> tuple:
    """Units, form, output, and the code points of prefix and middle (None if plain) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    first, second, third, fourth = draws(seed, doc_id)
    if not text or third % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = ends[low], ends[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if fourth % 100 < spm:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def rebuild(output: str, form: str) -> str:
    """The text that arrange() was given. No mark occurs in it, so each mark is found once."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES) -> DataFrame:
    """doc_id with n (units), form, output, prefix_chars, middle_chars and output_sha256 of each document's text.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these suffix first; the draws depend on the seed and the
    doc_id alone. A null text is an empty one; empty texts, and those that hold a mark, stay plain with null lengths. Rows that
    repeat a doc_id are each treated alike, a null doc_id has the draws of an empty one, and other columns are ignored. Texts
    are taken whole, of any length; ``unit`` must match every character of a text but may cut it into units of any kind.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = [arrange(t or "", i, pattern, seed, rate, spm) for t, i in zip(texts, ids, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"])
        out["output_sha256"] = [digest(x) for x in out["output"]]
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = docs.select("doc_id", cut(F.col("text"), F.col("doc_id").cast("string")).alias("cut"))
    return made.select("doc_id", "cut.*")


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged, from output and form alone."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuild(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)


def restored_sha256(output: Column, form: Column) -> Column:
    """The digest of restored(), without the text's way back."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([digest(rebuild(o, f)) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)
