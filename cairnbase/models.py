"""Model seams: functions that callers inject, with deterministic stand-ins and the fallbacks when a model is absent."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)
ENTITY_TYPES = ("component", "concept", "organization", "person", "product", "protocol", "standard")


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """Feature hashing of the tokens, of unit length: a stand-in that needs no model."""
    v = np.zeros(dim)
    for t in re.findall(r"[a-z0-9]+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, text: str, embedder: Callable[[str], list[float]] = hash_embedding, out: str = "vector") -> DataFrame:
    """Adds a vector for each text; null and blank texts have none. The embedder is made once for each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: embedder(t) if t and t.strip() else None)

    return df.withColumn(out, run(F.col(text)))


def rerank_logits(df: DataFrame, query: str, text: str, scorer: Callable[[str, list[str]], list[float]] | None) -> DataFrame:
    """Adds logit by a cross-encoder; without one, null, which keeps the order that hits came in."""
    if scorer is None:
        return df.withColumn("logit", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(query, texts.tolist()))

    return df.withColumn("logit", run(F.col(text)))


def describe(df: DataFrame, needs: Column, source: str, out: str, reader: Callable[[str], str | None] | None) -> DataFrame:
    """Captions or recognised text for the rows that need them; None means unread, an empty string read and empty."""
    if reader is None:
        return df

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(reader)

    return df.withColumn(out, F.when(needs, run(F.col(source))).otherwise(F.col(out)))


def salvage_json(text: str) -> object | None:
    """The JSON of a model's reply: bare, fenced, or wrapped in prose; None if there is none."""
    bare = FENCE.sub("", text.strip())
    found = re.search(r"[\[{]", bare)
    last = max(bare.rfind("}"), bare.rfind("]"))
    for candidate in (bare, bare[found.start() : last + 1] if found and last > found.start() else ""):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def parse_entities(text: str, worthy: Callable[[str], bool] = lambda name: True, relabel: Callable[[str], str] = lambda name: name) -> list[dict]:
    """Entities of a reply: name, type, aliases, claims. Nameless, unworthy and claimless ones go; bare strings are lists of one."""
    found = salvage_json(text)
    items = found.get("entities", []) if isinstance(found, dict) else found
    as_list = lambda x: [str(i).strip() for i in ([x] if isinstance(x, str) else x or []) if str(i).strip()]
    out = []
    for item in items if isinstance(items, list) else []:
        if not isinstance(item, dict):
            continue
        name = relabel(str(item.get("name") or "").strip())
        kind = str(item.get("type") or "concept").strip().lower()
        claims = as_list(item.get("claims"))
        if name and claims and worthy(name):
            out.append({"name": name, "type": kind if kind in ENTITY_TYPES else "concept", "aliases": as_list(item.get("aliases")), "claims": claims})
    return out


def parse_verdict(text: str) -> tuple[bool, str] | None:
    """(save, reason) of a judge's reply; None unless save is a real boolean."""
    try:
        found = json.loads(FENCE.sub("", text.strip()))
    except ValueError:
        return None
    if not isinstance(found, dict) or not isinstance(found.get("save"), bool):
        return None
    return found["save"], str(found.get("reason", "")).strip()


def should_save(question: str, answer: str, pages: int, chunks: int, judge: Callable[[str, str], str] | None = None, least: int = 200) -> tuple[bool, str]:
    """Whether an answer is worth a page: short single-source answers never are, and without a verdict none is."""
    if len(answer.strip()) < least and pages + chunks < 2:
        return False, "trivial: short answer from one source at most"
    if judge is None:
        return False, "no judge"
    try:
        verdict = parse_verdict(judge(question, answer))
    except Exception:  # noqa: BLE001  filing is optional, so a judge that fails only means no
        return False, "the judge failed"
    return verdict or (False, "no verdict")


def same_subject(reply: str | None) -> bool:
    """Only the exact word counts as agreement."""
    return (reply or "").strip().strip(".").lower() == "same"


def extract_entities(passages: DataFrame, model: Callable[[str], str], passage: str = "passage") -> DataFrame:
    """A row for each entity that a model finds in each passage; a passage whose call fails yields none."""
    keys = [f for f in passages.schema.fields if f.name != passage]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), "ord int", "name string", "type string", "aliases array<string>", "claims array<string>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for record in part.to_dict("records"):
                try:
                    found = parse_entities(model(record[passage]))
                except Exception:  # noqa: BLE001  one bad window must not lose the others
                    found = []
                rows += [{**{f.name: record[f.name] for f in keys}, "ord": i, **e} for i, e in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*(f.name for f in keys), "ord", "name", "type", "aliases", "claims"])

    return passages.mapInPandas(run, ddl)


def prompt_fingerprint(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:12]
