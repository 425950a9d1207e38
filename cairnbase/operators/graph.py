"""Connected components and pointer chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its plan, in the folder that driver and executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, label: the smallest id that can be reached over edges (a, b); nodes without edges label themselves.

    Each round takes the least label of the neighbours and follows it one step; lineage is cut by a checkpoint.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("u", "v"))
    labels = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        lower = labels.join(near, "u").select("u", "label", F.least("label", "n").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("next"))
        new = checkpointed(lower.join(jump, "low").select("u", F.least("low", "next").alias("new"), "label"))
        done = not new.where("new < label").limit(1).count()
        labels = new.select("u", F.col("new").alias("label"))
        if done:
            return nodes.select("id").join(labels, F.col("id") == F.col("u"), "left").select("id", F.coalesce("label", "id").alias("label"))
    raise ValueError("components did not settle")


def cluster_summary(labels: DataFrame) -> DataFrame:
    """items, clusters, groups of several, redundant items."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("items"), F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("groups"), (F.sum("n") - F.count("*")).alias("redundant"))


def farthest(rows: DataFrame, k: int, digits: int = 2) -> DataFrame:
    """id, other, score: the distances of values to those that can be among the k farthest of their group, ties to the lowest id.

    rows: group, id, low, high, each id once in a group, with its least and greatest value; a score is the greatest distance
    between two values, rounded to ``digits``. An id is beaten for every other one by ids whose value is more than a unit of the last
    digit farther out on its side, and by lower ids of the same value. So of each end of a group only cells of one unit count that
    have at most k ids three cells or more beyond them, and of a cell the k + 1 lowest ids of each value; likewise of what is null, not a
    number or infinite. This is a short list, which each id meets in place of its group.
    """
    unit = 10.0**digits
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    by = lambda *keys: Window.partitionBy("group", *keys)
    lists = []
    for end, sign in (("high", -1), ("low", 1)):
        cell = F.floor(F.col(end) * unit) * sign
        outer = rows.where(~odd(end)).withColumn("_cell", cell).withColumn("_place", F.dense_rank().over(by().orderBy("_cell"))).where(F.col("_place") <= k + 3)
        beyond = F.count("*").over(by().orderBy("_cell").rangeBetween(Window.unboundedPreceding, -3))
        least = outer.withColumn("_beyond", beyond).where(F.col("_beyond") <= k).withColumn("_least", F.row_number().over(by(end).orderBy("id"))).where(F.col("_least") <= k + 1)
        lists.append(least.select("group", "id", "low", "high"))
    kind = F.when(odd("low") | odd("high"), F.concat_ws(" ", F.col("low").cast("string"), F.col("high").cast("string"))).otherwise("finite")
    lists.append(rows.withColumn("_kind", kind).withColumn("_least", F.row_number().over(by("_kind").orderBy("id"))).where(F.col("_least") <= k + 1).select("group", "id", "low", "high"))
    short = lists[0].union(lists[1]).union(lists[2]).distinct().toDF("group", "other", "_low", "_high")
    score = F.round(F.greatest(F.abs(F.col("high") - F.col("_low")), F.abs(F.col("_high") - F.col("low"))), digits)
    return rows.join(short, "group").where("id <> other").groupBy("id", "other").agg(F.max(score).alias("score"))


def add_to_clusters(labels: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Labels after new nodes and their edges: a node joins its neighbours' clusters, and bridged clusters merge downwards."""
    old = labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    nodes = labels.select("id").union(new_nodes.select("id")).distinct()
    return connected_components(nodes, old.union(new_edges.select("a", "b")))


def relabel(labels: DataFrame, old: int, new: int) -> DataFrame:
    return labels.withColumn("label", F.when(F.col("label") == old, F.lit(new)).otherwise(F.col("label")))


def follow_merges(merges: DataFrame, rounds: int = 64) -> DataFrame:
    """from_id, survivor: the end of each merge chain, the latest merge of a source counting; cycles end where they close."""
    latest = merges.groupBy("from_id").agg(F.max_by("into_id", "id").alias("to"))
    for _ in range(rounds):
        step = latest.select(F.col("from_id").alias("m"), F.col("to").alias("next"))
        new = checkpointed(latest.join(step, F.col("to") == F.col("m"), "left").select("from_id", F.when(F.col("next").isNull() | (F.col("next") == F.col("from_id")), F.col("to")).otherwise(F.col("next")).alias("to"), F.col("to").alias("was")))
        latest = new.select("from_id", "to")
        if not new.where("to <> was").limit(1).count():
            break
    return latest.withColumnRenamed("to", "survivor")


def topological_order(deps: dict[str, tuple[str, ...]]) -> list[str]:
    """Stages before those that need them, equals by name; an unknown dependency or a cycle is an error."""
    if unknown := {d for ds in deps.values() for d in ds} - deps.keys():
        raise ValueError(f"unknown dependency: {sorted(unknown)[0]}")
    waiting, out = {name: set(ds) for name, ds in deps.items()}, []
    while waiting:
        ready = min((n for n, ds in waiting.items() if not ds), default=None)
        if ready is None:
            raise ValueError("dependencies form a cycle")
        out.append(ready)
        del waiting[ready]
        for ds in waiting.values():
            ds.discard(ready)
    return out


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The row with the largest ``by`` of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))).where("_rn = 1").drop("_rn")
