"""A vector table in parts around pivots: exact nearest neighbours from few parts, append, and delete by owner."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import BLOCK, PIVOTS, SLACK, _unit, angles, fit_pivots, knn, matrix

#: The part of vectors that are zero: their cosine to anything is 0.
ZEROS = -1


class VectorIndex:
    """Rows with a key, an owner and a vector, in a folder that driver and executors share.

    ``rows`` has a folder for each batch and part; ``deletes`` names owners whose rows of earlier batches are gone, so that
    a delete writes one row for each owner and touches no other file's rows; ``spans`` has the angles to the pivot of each
    batch and part. Everything is appended, so a write that fails leaves what was there. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, owner: str = "file_id", vector: str = "vector"):
        self.spark, self.path, self.key, self.owner, self.vector = spark, path.rstrip("/"), key, owner, vector
        table = spark.read.parquet(f"{self.path}/pivots").orderBy("part").toArrow()  # at most PIVOTS rows
        self.pivots = matrix(table.column("pivot"))

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, owner: str = "file_id", vector: str = "vector", pivots: int | None = None) -> VectorIndex:
        """An index over rows, whose pivots are fitted on a bounded sample of them; at least one row must not be zero."""
        spark = rows.sparkSession
        found = fit_pivots(rows.where(F.col(vector).isNotNull()), key, vector, min(PIVOTS, pivots or -(-rows.count() // BLOCK)))
        if not len(found):
            raise ValueError("an index needs a vector that is not zero")
        spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(found)], "part long, pivot array<double>").coalesce(1).write.parquet(f"{path.rstrip('/')}/pivots")
        index = cls(spark, path, key, owner, vector)
        index.append(rows)
        return index

    def _read(self, name: str, ddl: str) -> DataFrame | None:
        from py4j.protocol import Py4JJavaError

        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        try:
            there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        except Py4JJavaError as e:
            raise OSError(f"the index at {self.path} cannot be reached") from e
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}") if there else None

    def _spans(self) -> DataFrame | None:
        return self._read("spans", "batch long, part long, n long, low double, high double")

    def _deletes(self) -> DataFrame | None:
        return self._read("deletes", f"{self.owner} long, batch long")

    def next_batch(self) -> int:
        seen = [df.agg(F.max("batch")).first()[0] for df in (self._spans(), self._deletes()) if df is not None]
        return max((x for x in seen if x is not None), default=-1) + 1

    def append(self, rows: DataFrame) -> int:
        """rows added as a batch; returns its number. Rows with a null vector are left out."""
        batch, pivots, vector = self.next_batch(), self.pivots, self.vector
        at = rows.columns.index(vector)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _unit(matrix(b.column(at))) if b.num_rows else np.zeros((0, pivots.shape[1]))
                far = angles(x, pivots)
                part = np.where((x != 0).any(axis=1), far.argmin(axis=1), ZEROS) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int64()), pa.array(far.min(axis=1) if len(x) else np.zeros(0))], names=[*b.schema.names, "part", "angle"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed = rows.where(F.col(vector).isNotNull()).mapInArrow(assign, f"{kinds}, part long, angle double")
        path = f"{self.path}/rows/batch={batch}"
        placed.repartition("part", F.pmod(F.xxhash64(self.key), F.lit(8))).sortWithinPartitions("part", "angle").write.partitionBy("part").parquet(path)
        written = self.spark.read.schema("angle double, part long").parquet(path)
        spans = written.groupBy(F.lit(batch).cast("long").alias("batch"), "part").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        spans.coalesce(1).write.mode("append").parquet(f"{self.path}/spans")
        return batch

    def delete(self, owners: DataFrame) -> None:
        """All rows so far of the owners are gone."""
        owners.select(F.col(self.owner).cast("long").alias(self.owner)).distinct().withColumn("batch", F.lit(self.next_batch()).cast("long")).coalesce(1).write.mode("append").parquet(f"{self.path}/deletes")

    def replace(self, rows: DataFrame) -> None:
        """The owners' rows are these alone: deleted first, then appended."""
        self.delete(rows.select(self.owner))
        self.append(rows)

    def live(self) -> DataFrame:
        """The rows that are not deleted, with batch, part and angle."""
        rows, gone = self.spark.read.parquet(f"{self.path}/rows"), self._deletes()
        if gone is None:
            return rows
        last = gone.groupBy(F.col(self.owner).alias("_owner")).agg(F.max("batch").alias("_until"))
        return rows.join(last, (F.col(self.owner) == F.col("_owner")) & (F.col("batch") < F.col("_until")), "left_anti")

    def parts_for(self, query: list[float], sim: float) -> dict[int, tuple[float, float]]:
        """The parts that can hold a vector of at least this cosine to the query, with the angles to the pivot that it can have."""
        spans = self._spans().groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each part
        to, reach = angles(_unit(np.array([query], float)), self.pivots)[0], math.acos(min(1.0, max(-1.0, sim))) + SLACK
        out = {}
        for row in spans:
            if row["part"] == ZEROS:
                if sim <= SLACK:
                    out[ZEROS] = (0.0, math.pi)
            elif to[row["part"]] - reach <= row["high"] and row["low"] <= to[row["part"]] + reach:
                out[row["part"]] = (float(to[row["part"]] - reach), float(to[row["part"]] + reach))
        return out

    def knn(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The k nearest live rows by cosine, ties by key, the filter applied before the cut: the same rows as a scan of all.

        The nearest parts that have k rows give a bound; then only the parts, and in them only the angles, within it are read.
        """
        live = self.live()
        live = live.where(where) if where is not None else live
        if not any(query):
            return knn(live, query, k, self.key, self.vector)
        sizes = {r["part"]: r["n"] for r in self._spans().groupBy("part").agg(F.sum("n").alias("n")).collect()}
        to = angles(_unit(np.array([query], float)), self.pivots)[0]
        first, n = [], 0
        for part in sorted((p for p in sizes if p != ZEROS), key=lambda p: to[p]):
            if n >= k:
                break
            first.append(part)
            n += sizes[part]
        found = knn(live.where(F.col("part").isin(first)), query, k, self.key, self.vector).select("sim").collect() if first else []
        least = min(r["sim"] for r in found) if len(found) == k else -1.0
        wanted = self.parts_for(query, least - SLACK)
        bounds = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, (a, b) in wanted.items()])
        near = F.exists(bounds, lambda x: (x["p"] == F.col("part")) & F.col("angle").between(x["a"], x["b"]))
        low, high = min((a for a, _ in wanted.values()), default=0.0), max((b for _, b in wanted.values()), default=0.0)
        return knn(live.where(F.col("part").isin(list(wanted)) & F.col("angle").between(low, high) & near), query, k, self.key, self.vector)

    def compact(self, path: str) -> VectorIndex:
        """The live rows as a new index in another folder, with the same pivots."""
        self.spark.read.parquet(f"{self.path}/pivots").coalesce(1).write.parquet(f"{path.rstrip('/')}/pivots")
        new = VectorIndex(self.spark, path, self.key, self.owner, self.vector)
        new.append(self.live().drop("batch", "part", "angle"))
        return new
