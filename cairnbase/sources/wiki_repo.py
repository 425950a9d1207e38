"""A versioned wiki: pages by content hash, commits with parents, any version read back as a table.

The folder may be on any store that Spark writes. ``blobs`` has each content once, ``changes`` the paths that a commit
changes (a null hash: removed), ``commits`` one row for each commit, written last: what a failed commit has left
behind belongs to no commit and is never read. One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

_BLOBS, _CHANGES = "hash string, content string", "path string, hash string, batch string"
_COMMITS = "handle string, parent string, number long, batch string, message string"


class WikiRepo:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, ddl: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")

    def log(self) -> DataFrame:
        """handle, parent, number, message of the commits."""
        return self._table("commits", _COMMITS).select("handle", "parent", "number", "message")

    def head(self) -> str | None:
        """The handle of the newest commit; None before the first."""
        return self._table("commits", _COMMITS).agg(F.max_by("handle", "number")).first()[0]

    def _number(self, handle: str) -> int:
        row = self._table("commits", _COMMITS).where(F.col("handle") == handle).select("number").first()
        if row is None:
            raise ValueError(f"no commit {handle}")
        return row[0]

    def hashes(self, handle: str | None = None) -> DataFrame:
        """path, hash of the pages at a commit (the newest one if none is named)."""
        handle = handle or self.head()
        if handle is None:
            return self.spark.createDataFrame([], "path string, hash string")
        seen = self._table("commits", _COMMITS).where(F.col("number") <= self._number(handle)).select("batch", "number")
        last = self._table("changes", _CHANGES).join(seen, "batch").groupBy("path").agg(F.max_by(F.struct("hash"), "number").alias("at"))
        return last.select("path", "at.hash").where("hash is not null")

    def pages(self, handle: str | None = None) -> DataFrame:
        """path, content of the pages at a commit."""
        return self.hashes(handle).join(self._table("blobs", _BLOBS), "hash").select("path", "content")

    def commit(self, message: str, written: DataFrame | None = None, removed: DataFrame | None = None) -> str | None:
        """Write pages (path, content) and remove paths (path); returns the handle, or None if nothing would change.

        A path both written and removed is written. The handle depends on the parent, the message and the changes alone.
        """
        parent, now = self.head(), self.hashes()
        none = self.spark.createDataFrame([], "path string, content string")
        pages = (written if written is not None else none).select("path", "content").dropDuplicates(["path"]).withColumn("hash", F.sha2("content", 256))
        pages = stored(pages.where("content is not null"), "wiki-pages")
        gone = (removed if removed is not None else none).select("path").distinct().join(pages.select("path"), "path", "left_anti").join(now.select("path"), "path", "left_semi")
        old = now.select("path", F.col("hash").alias("_old"))
        changed = pages.select("path", "hash").join(old, "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).select("path", "hash")
        batch = uuid.uuid4().hex
        changes = stored(changed.unionByName(gone.select("path", F.lit(None).cast("string").alias("hash"))).withColumn("batch", F.lit(batch)), "wiki-changes")
        # a digest of the changes that does not depend on their order
        each = F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", F.coalesce("hash", F.lit("-"))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        n, total = changes.agg(F.count("*"), F.sum(each)).first()
        if not n:
            return None
        handle = hashlib.sha256(f"{parent}\0{message}\0{n}\0{total}".encode()).hexdigest()
        blobs = pages.select("hash", "content").dropDuplicates(["hash"]).join(self._table("blobs", _BLOBS).select("hash"), "hash", "left_anti")
        blobs.write.mode("append").parquet(f"{self.root}/blobs")
        changes.write.mode("append").parquet(f"{self.root}/changes")
        number = 0 if parent is None else self._number(parent) + 1
        self.spark.createDataFrame([(handle, parent, number, batch, message)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return handle

    def restore(self, handle: str, message: str) -> str | None:
        """A new commit whose pages are those of an earlier one."""
        then = self.pages(handle)
        return self.commit(message, then, self.hashes().join(then.select("path"), "path", "left_anti").select("path"))
