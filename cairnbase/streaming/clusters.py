"""Clusters that grow batch by batch: stored labels, and pointers between labels that later edges have joined.

A batch reads the labels of its own edges' ends alone, finds components among these few labels, and appends: a label
for each new node, and a pointer for each old label that now leads to a smaller one. Old members are never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components, follow_merges
from ..session import stored

#: Folders that members are dealt to by their id, so that a batch reads only those of its ends.
BUCKETS = 64


class ClusterStore:
    """Labels of nodes: the smallest id that can be reached over all edges so far. One writer at a time.

    A batch is named by a number and written under it: handed over again after a failure, it replaces what it has left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")

    def _members(self) -> DataFrame:
        return self._read("members", "id long, label long, batch long, bucket long")

    def _ends(self) -> DataFrame:
        """label, to: where the pointers of a label end. There is one pointer at most for each label and batch."""
        moves = self._read("moves", "from_id long, into_id long, batch long").select("from_id", "into_id", F.col("batch").alias("id"))
        return follow_merges(moves).select(F.col("from_id").alias("label"), F.col("survivor").alias("to"))

    def labels(self) -> DataFrame:
        """id, label of every node."""
        return self._members().select("id", "label").join(self._ends(), "label", "left").select("id", F.coalesce("to", "label").alias("label"))

    def add(self, batch: int, nodes: DataFrame, edges: DataFrame) -> None:
        """New nodes (id) and edges (a, b) among new and old ones; ends of edges that are in neither table become nodes."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
        links = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "cluster-edges")
        asked = stored(nodes.select(F.col("id").cast("long").alias("id")).union(links.select("a")).union(links.select("b")).distinct().withColumn("bucket", bucket), "cluster-ends")
        touched = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        old = self._members().where(F.col("bucket").isin(touched) & (F.col("batch") < batch)).select("id", "label").join(asked.select("id"), "id", "left_semi")
        moves = self._read("moves", "from_id long, into_id long, batch long").where(F.col("batch") < batch)
        ends = follow_merges(moves.select("from_id", "into_id", F.col("batch").alias("id"))).select(F.col("from_id").alias("label"), F.col("survivor").alias("to"))
        known = stored(old.join(ends, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "cluster-known")
        root = stored(asked.join(known, "id", "left").select("id", F.coalesce("label", "id").alias("root"), F.col("label").isNull().alias("new")), "cluster-roots")
        side = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        joined = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = connected_components(root.select(F.col("root").alias("id")).distinct(), joined).select(F.col("id").alias("root"), F.col("label").alias("to"))
        found = stored(found, "cluster-found")
        members = root.where("new").join(found, "root").select("id", F.col("to").alias("label")).withColumn("bucket", bucket)
        members.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/members/batch={batch}")
        changed = known.select(F.col("label").alias("root")).distinct().join(found, "root").where("root <> to")
        changed.select(F.col("root").alias("from_id"), F.col("to").alias("into_id")).write.mode("overwrite").parquet(f"{self.path}/moves/batch={batch}")
