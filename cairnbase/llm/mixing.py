"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target by weighted water filling under a cap. A source takes all its documents
``passes`` times, and what is left of the target is a subset-sum problem over the exact lengths of its
documents: a proportional part of each length, then a bounded-knapsack dynamic programme over a few
documents of each length that are given back or added, as many as it takes to come as near as can be.
Documents are then drawn by a seeded hash, so many of each length.

Only histograms by (source, length) meet in one task; documents themselves are never grouped by source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, stored, word_count

#: A group of equally long documents is ranked in so many hash slices, of which only one needs a sort.
SLICES = 64
#: Bounds on one round of the programme: words, and words times parts.
ROOM, WORK = 1 << 25, 1 << 31


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many to take of each length, at most counts[i] of lengths[i], for the largest sum within budget.

    Bounded knapsack over reachable sums; counts are split into powers of two. Of each sum the first part that
    reached it is kept, 5 bytes for each unit of the budget.
    """
    parts, sums, by = [], np.zeros(budget + 1, bool), np.zeros(budget + 1, np.int32)
    sums[0] = True
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, part = min(count, budget // length) if length > 0 else 0, 1
        while count > 0 and not sums[budget]:
            part = min(part, count)
            count -= part
            weight = length * part
            if weight <= budget:
                new = sums[: budget + 1 - weight] & ~sums[weight:]
                by[weight:][new] = len(parts)
                sums[weight:] |= new
                parts.append((i, part, weight))
            part *= 2
    taken, at = [0] * len(lengths), int(np.flatnonzero(sums)[-1])
    while at:
        i, part, weight = parts[by[at]]
        taken[i] += part
        at -= weight
    return taken


def residue_gap(lengths: list[int], counts: list[int], budget: int) -> int:
    """A number of words that no choice of documents can come nearer to budget than, from below.

    Modulo a common divisor of the frequent lengths only the others move a sum, so few residues may be reachable. The
    divisors are those of the lengths taken in order of their counts, each of which divides the one before.
    """
    by_count, divisors, now = sorted(range(len(lengths)), key=lambda i: -counts[i]), [], 0
    for i in by_count:
        now = math.gcd(now, lengths[i])
        if now > 1 and now not in divisors:
            divisors.append(now)
    gap = 0
    for m in divisors:
        reached = np.zeros(m, bool)
        reached[0] = True
        for i in by_count:
            step, left, part = lengths[i] % m, min(counts[i], m - 1), 1
            while step and left and not reached.all():
                part = min(part, left)
                left -= part
                reached |= np.roll(reached, step * part % m)
                part *= 2
        below = np.flatnonzero(reached[(budget - np.arange(m)) % m])
        gap = max(gap, int(below[0]))
    return gap


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come near to budget from below, as near as can be.

    A proportional part of each length, then the longest that fit and exchanges; then documents of some lengths, of so many
    words each, are given back and the programme decides about them and as many more. The rounds take in more lengths and more words
    until the rest is residue_gap(), or all documents are in, by either of which the best is found, or until the next
    round would take more than ROOM words or WORK steps, which bounds memory (5 bytes a word) and time.
    """
    unit = math.gcd(*[n for n, c in zip(lengths, counts, strict=True) if n > 0 and c > 0]) or 1
    steps = [n // unit for n in lengths]
    total = sum(n * c for n, c in zip(steps, counts, strict=True))
    budget = min(budget // unit, total)
    if budget <= 0:
        return [0] * len(lengths)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(steps, taken, strict=True))
    order = [i for i in sorted(range(len(steps)), key=lambda i: steps[i]) if steps[i] > 0 and counts[i] > 0]
    for i in reversed(order):
        more = min(counts[i] - taken[i], left // steps[i])
        taken[i] += more
        left -= more * steps[i]
    # documents exchanged for the next longer ones fill what is left in small steps, however many they are
    for i, j in sorted(zip(order, order[1:], strict=False), key=lambda x: steps[x[0]] - steps[x[1]]):
        more = min(taken[i], counts[j] - taken[j], left // (steps[j] - steps[i])) if steps[j] > steps[i] else 0
        taken[i], taken[j], left = taken[i] - more, taken[j] + more, left - more * (steps[j] - steps[i])
    gap = residue_gap([steps[i] for i in order], [counts[i] for i in order], budget) if left else 0
    some, words = 8, steps[order[-1]]
    while left > gap:
        used = order if some >= len(order) else [order[j * (len(order) - 1) // (some - 1)] for j in range(some)]
        back = [min(taken[i], max(1, words // steps[i])) for i in used]
        more = [min(counts[i] - taken[i], max(1, words // steps[i])) for i in used]
        room = left + sum(b * steps[i] for b, i in zip(back, used, strict=True))
        if room > ROOM or room * sum((b + m).bit_length() for b, m in zip(back, more, strict=True)) > WORK:
            break
        again = knapsack([steps[i] for i in used], [b + m for b, m in zip(back, more, strict=True)], room)
        for i, b, n in zip(used, back, again, strict=True):
            taken[i] += n - b
            room -= n * steps[i]
        left = room
        if len(used) == len(order) and all(b + m == counts[i] for b, m, i in zip(back, more, used, strict=True)):
            break
        some, words = some * 2, words * 2
    return taken


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Of (source, source_size): target = least(cap * size, level * weight), the level chosen so that the targets sum to share.

    Sources are ranked by code point, null last; weights repeat along that order. The level is found in closed
    form along the sources sorted by cap / weight, which is where resharing the excess ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level)
    # levels fall as long as sources are capped: the right one is the first that no later source exceeds
    right = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(whole)["level"]
    target = F.coalesce(F.least(F.col("most"), right * F.col("weight")), F.col("most"))
    return leveled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, picked, copies, taken for every row of docs (doc_id, text, source).

    A document is taken ``copies`` = passes + picked times. Null or empty texts have size 0 and are never taken
    for their words (taken 0, copies as for the passes of their source). A null source is a source of its own.
    Rows that repeat a doc_id count as documents of their own; equal rows are interchangeable. An empty table
    gives an empty result. cap is a whole number of passes; a source's target never exceeds cap times its size.
    """
    sized = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)))),
        "mixing-sizes",
    )
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    plan = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size"))).cast("long"))
    fitted = histogram.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target", "passes", "rest")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        pdf["take"] = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), int(pdf["rest"].iloc[0]))
        return pdf[["source", "size", "source_size", "target", "passes", "take"]]

    quotas = stored(fitted.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, passes long, take long"), "mixing-quotas")

    sliced = sized.withColumn("slice", F.pmod(F.shiftright("h", 8), F.lit(SLICES)))
    per_slice = sliced.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    q = quotas.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), "source_size", "target", "passes", "take")
    limits = per_slice.join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))).select(
        F.col("source").alias("l_source"), F.col("size").alias("l_size"), F.col("slice").alias("l_slice"), "source_size", "target", "passes", "n", (F.col("take") - F.col("before")).alias("room")
    )
    rows = sliced.join(limits, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("size") == F.col("l_size")) & (F.col("slice") == F.col("l_slice")))
    whole = F.col("room") >= F.col("n")
    none = F.col("room") <= 0
    order = Window.partitionBy("l_source", "l_size", "l_slice").orderBy("h", "doc_id")
    sure = rows.where(whole | none).withColumn("picked", whole.cast("long"))
    cut = rows.where(~(whole | none)).withColumn("picked", (F.row_number().over(order) <= F.col("room")).cast("long"))
    copies = F.col("passes") + F.col("picked")
    return sure.unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target", "passes", "picked", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it. mixed: the result of mix_sources(docs).

    Rows that repeat a doc_id at equal size share their copies as evenly as can be.
    """
    names, at = docs.columns, fresh_names(docs, "id", "s", "c", "rows", "size", "n", "i")
    grouped = mixed.groupBy("doc_id", "size").agg(F.sum("copies").alias("c"), F.count("*").alias("rows")).where("c > 0")
    per_doc = stored(grouped.withColumnsRenamed({"doc_id": at["id"], "size": at["s"], "c": at["c"], "rows": at["rows"]}), "mixing-copies")
    keyed = docs.withColumn(at["size"], word_count(F.col("text")))
    joined = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col(at["id"])) & (F.col(at["size"]) == F.col(at["s"])))
    copies, rows = F.col(at["c"]), F.col(at["rows"])
    out = joined.where(rows == 1).withColumn(at["n"], copies)
    if per_doc.where(rows > 1).limit(1).count():
        # rows of one id, size and text are interchangeable, so that the order within a text does not matter
        place = F.row_number().over(Window.partitionBy("doc_id", at["size"]).orderBy("text"))
        shared = joined.where(rows > 1).withColumn(at["n"], F.floor(copies / rows) + (place <= copies % rows).cast("long"))
        out = out.unionByName(shared)
    return out.where(F.col(at["n"]) > 0).withColumn(at["i"], F.explode(F.sequence(F.lit(1), F.col(at["n"])))).select(*names)
