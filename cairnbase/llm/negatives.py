"""Hard negatives by dual-tree search over integer inner products.

Equal vectors of one label are one class, which keeps the few smallest ids that can ever be returned. A router, fitted on
a bounded sample, deals all classes to cells; the classes of a cell and label part are cut into blocks of bounded size, in
the order of a tree. Anchors' classes are put in blocks of their own. A pair of nodes, one of an anchor tree and one of a
candidate tree, has an interval of inner products from its centres and radii. The pair goes as a whole when the interval,
or the labels, rule out every anchor of the group: first a block of anchors with a cell, then block with block, then level
by level down to leaves, whose rows are scored exactly. The search runs twice: for the nearest rows of an anchor's label,
then, with the windows that these scores allow, for rows of other labels.

The query set meets all rows in blocks that Spark shuffles; what is broadcast is the cells, of which there are at most
PARTS * CELLS, with one centre for each of CELLS.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, stored

#: Vectors on which the router is fitted, drawn by hash. All classes are indexed; the router decides only where.
SAMPLE = 4096
#: Most cells of the router, and parts that labels are dealt to.
CELLS, PARTS = 1024, 64
#: Expected classes of a candidate block and of an anchor block; blocks of a lane; rows of a leaf.
BLOCK, ANCHORS, LANE, LEAF = 1024, 512, 16, 32
#: A gap in the distances is wide if it is so many times the mean gap.
GAP = 16
#: Blocks in a record batch, some hundred kB each.
BATCH_BLOCKS = 16
_FAR = np.int64(1) << np.int64(62)


def quantized(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and q, each component as floor(scale * x), x as a double, of the rows that take part.

    Rows with a null vec_id, label or vector, or any component that is null or not finite, take no part.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")), F.lit(False)))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite
    return embeddings.where(fit).select("vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


# ---- trees -----------------------------------------------------------------------------------------------------------


def tree_order(vectors: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of a tree, and where its leaves start: by label, then by distance from an outlying row, at a wide gap or in the
    middle, down to LEAF rows.
    """
    out, first = [], np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[first])) + 1
    todo = [rows for rows in reversed(np.split(first, cuts)) if len(rows)]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        own = vectors[rows].astype(np.float64)
        far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        away = np.sqrt(((own - far) ** 2).sum(axis=1))
        order = np.argsort(away, kind="stable")
        edge, gaps = max(1, len(rows) // 16), np.diff(away[order])
        cut = edge + int(gaps[edge - 1 : len(rows) - edge].argmax())  # a sixteenth on either side at least, which bounds the depth
        if gaps[cut - 1] * len(rows) < GAP * (away.max() - away.min()):
            cut = len(rows) // 2
        todo += [rows[order[cut:]], rows[order[:cut]]]
    size = np.array([len(x) for x in out], np.int64)
    return np.concatenate([first[:0], *out]), np.cumsum(size) - size


@dataclass
class Level:
    """The nodes of one level of a tree over consecutive rows: balls around centres, with the span of their labels."""

    starts: np.ndarray
    centers: np.ndarray
    norms: np.ndarray
    radii: np.ndarray
    least: np.ndarray
    most: np.ndarray


def levels_of(vectors: np.ndarray, labels: np.ndarray, leaves: np.ndarray) -> list[Level]:
    """The levels of the tree over rows in tree order, from the root to the leaves, each node over two of the next level."""
    n, out = len(vectors), []
    for up in reversed(range((len(leaves) - 1).bit_length() + 1)):
        starts = leaves[:: 1 << up]
        size = np.diff(np.append(starts, n))
        centers = np.add.reduceat(vectors, starts, axis=0) / size[:, None]
        away = np.sqrt(((vectors - np.repeat(centers, size, axis=0)) ** 2).sum(axis=1))
        out.append(Level(starts, centers, np.sqrt((centers**2).sum(axis=1)), np.maximum.reduceat(away, starts), np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)))
    return out


def interval(centers: np.ndarray, norms: np.ndarray, radii: np.ndarray, others: np.ndarray, other_norms: np.ndarray, other_radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any two members of each pair of balls, with room for rounding."""
    a, b = norms[:, None], other_norms[None]
    r, s = radii[:, None], other_radii[None]
    slack = a * s + r * b + r * s + 1e-9 * (a + r) * (b + s) + 1e-6
    middle = centers @ others.T
    return middle - slack, middle + slack


def labels_fit(least: np.ndarray, most: np.ndarray, other_least: np.ndarray, other_most: np.ndarray, same: bool) -> np.ndarray:
    """Whether two nodes, by the spans of their labels, can hold a pair of the same (or of different) labels."""
    if same:
        return (least[:, None] <= other_most[None]) & (other_least[None] <= most[:, None])
    return ~((least == most)[:, None] & (other_least == other_most)[None] & (least[:, None] == other_least[None]))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: in doubles where no sum can leave their integers, else in 64-bit integers."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


# ---- blocks ----------------------------------------------------------------------------------------------------------


def _packed(vectors: np.ndarray) -> bytes:
    width = 4 if np.abs(vectors).max(initial=0) < 2**31 else 8
    return bytes([width]) + vectors.astype(f"<i{width}").tobytes()


def _ints(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(shape)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column; missing components at the end are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    size, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    at = np.arange(dims)[None] < size[:, None]
    out[at] = flat[offsets[0] : offsets[-1]]
    return out


class Router:
    """Cells by halving a sample at its widest component, each with the mean of its sample as centre."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axes, self.cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64)
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            for at in range((1 << level) - 1, (2 << level) - 1):
                own = sample[node == at]
                if len(own):
                    self.axes[at] = axis = own.var(axis=0).argmax()
                    self.cuts[at] = np.sort(own[:, axis])[(len(own) - 1) // 2]
            node = self._below(node, sample)
        cells = self.cells(sample)
        self.centers = np.zeros((1 << depth, sample.shape[1]))
        for cell in np.unique(cells):
            self.centers[cell] = sample[cells == cell].mean(axis=0)

    def _below(self, node: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return 2 * node + 1 + (np.take_along_axis(vectors, self.axes[node][:, None], axis=1)[:, 0] > self.cuts[node])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            node = self._below(node, vectors)
        return node - ((1 << self.depth) - 1)


def _route(classes: DataFrame, router: Router, dims: int) -> DataFrame:
    """Classes with label part, cell, distance from the cell's centre, and the vector packed."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("q"), dims)
            cells = router.cells(vectors)
            far = np.sqrt(((vectors - router.centers[cells]) ** 2).sum(axis=1))
            packed = [_packed(v) for v in vectors]
            names = ["cid", "label", "part", "cell", "far", "vector", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("label"), batch.column("part"), pa.array(cells), pa.array(far), pa.array(packed, pa.binary()), batch.column("ids")], names=names)

    return classes.select("cid", "label", F.pmod(F.xxhash64("label"), F.lit(PARTS)).alias("part"), "q", "ids").mapInArrow(lean(route), "cid long, label long, part long, cell long, far double, vector binary, ids array<long>")


_BLOCK = "part long, cell long, split long, n long, cids binary, labels binary, vectors binary, ids binary, lows binary, highs binary, marks binary, leaves binary"


def _blocks(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each (part, cell, split) of rows: their classes in tree order, packed. ``wants``: marks and windows, if any."""
    windows = "wants" in rows.columns

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cells = [_unpacked(v) for v in table.column("vector").to_pylist()]
        vectors, labels = np.stack(cells), table.column("label").to_numpy()
        order, leaves = tree_order(vectors, labels)
        ids = np.full((len(order), keep), -1, np.int64)
        held = table.column("ids").to_pylist()
        for i, at in enumerate(order.tolist()):
            ids[i, : len(held[at])] = held[at]
        count = np.array([len(held[at]) for at in order], np.int64)
        lows, highs, marks = np.full((len(order), 1), -_FAR), np.full((len(order), 1), _FAR), np.zeros((len(order), 1), np.int64)
        if windows:
            wants = table.column("wants").to_pylist()
            wide = max(1, *(len(w) for w in wants))
            lows, highs, marks = np.full((len(order), wide), _FAR), np.full((len(order), wide), -_FAR), np.zeros((len(order), wide), np.int64)
            for i, at in enumerate(order.tolist()):
                for j, want in enumerate(wants[at]):
                    marks[i, j], lows[i, j], highs[i, j] = want["mark"], want["low"], want["high"]
        data = [table.column("cid").to_numpy()[order].tobytes(), labels[order].tobytes(), _packed(vectors[order]), np.column_stack([count, ids]).tobytes(), lows.tobytes(), highs.tobytes(), marks.tobytes(), leaves.tobytes()]
        names = ["part", "cell", "split", "n", "cids", "labels", "vectors", "ids", "lows", "highs", "marks", "leaves"]
        return pa.table([[x.as_py()] for x in key] + [[len(order)]] + [[x] for x in data], names=names)

    return rows.groupBy("part", "cell", "split").applyInArrow(block, _BLOCK)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


class Rows:
    """The rows of a block, with its tree."""

    def __init__(self, row: dict, keep: int):
        n = row["n"]
        self.cids, self.labels = _ints(row["cids"], n), _ints(row["labels"], n)
        self.vectors = _unpacked(row["vectors"]).reshape(n, -1)
        ids = _ints(row["ids"], n, keep + 1)
        self.count, self.ids = ids[:, 0], ids[:, 1:]
        self.leaves = _ints(row["leaves"], -1)
        self.leaf = np.repeat(np.arange(len(self.leaves)), np.diff(np.append(self.leaves, n)))
        self.levels = levels_of(self.vectors.astype(np.float64), self.labels, self.leaves)


class Search:
    """The anchors of one block, and the best classes so far in each of their windows."""

    def __init__(self, row: dict, keep: int, top: int, same: bool):
        self.name, self.rows, self.top, self.same = row["name"], Rows(row, keep), top, same
        n = row["n"]
        self.highs, self.marks = _ints(row["highs"], n, -1), _ints(row["marks"], n, -1)
        self.floors = _ints(row["lows"], n, -1).copy()  # rises to the worst of the best once there are ``top``
        self.open = self.floors <= self.highs
        self.wide, self.scored = self.floors.shape[1], 0
        empty = {k: np.zeros(0, np.int64) for k in ("slot", "score", "least", "count")} | {"ids": np.zeros((0, keep), np.int64)}
        self.found = [empty] * len(self.rows.leaves)  # for each leaf

    def meet(self, other: Rows) -> None:
        """Search one block of candidates, down both trees level by level."""
        mine, theirs = self.rows.levels, other.levels
        floor = np.where(self.open, self.floors, _FAR).min(axis=1)
        ceiling = np.where(self.open, self.highs, -_FAR).max(axis=1)
        alive = np.ones((1, 1), bool)
        for depth in range(max(len(mine), len(theirs))):
            a, b = mine[min(depth, len(mine) - 1)], theirs[min(depth, len(theirs) - 1)]
            if len(a.starts) > alive.shape[0]:
                alive = np.repeat(alive, 2, axis=0)[: len(a.starts)]
            if len(b.starts) > alive.shape[1]:
                alive = np.repeat(alive, 2, axis=1)[:, : len(b.starts)]
            low, high = interval(a.centers, a.norms, a.radii, b.centers, b.norms, b.radii)
            need, most = np.minimum.reduceat(floor, a.starts), np.maximum.reduceat(ceiling, a.starts)
            alive &= labels_fit(a.least, a.most, b.least, b.most, self.same) & (high >= need[:, None]) & (low <= most[:, None])
            if not alive.any():
                return
        for leaf in np.flatnonzero(alive.any(axis=1)):
            self._leaf(int(leaf), np.flatnonzero(alive[leaf]), high[leaf], other)

    def _leaf(self, leaf: int, todo: np.ndarray, high: np.ndarray, other: Rows) -> None:
        """Score the leaves of candidates, the greatest bound first; what is found in some rules others out."""
        own = slice(*np.append(self.rows.leaves, len(self.rows.labels))[leaf : leaf + 2].tolist())
        todo, some = todo[np.argsort(-high[todo], kind="stable")], 4
        while len(todo):
            taken = np.zeros(len(other.leaves), bool)
            taken[todo[:some]] = True
            self._score(own, np.flatnonzero(taken[other.leaf]), leaf, other)
            todo, some = todo[some:], 2 * some
            need = self.floors[own][self.open[own]]
            todo = todo[high[todo] >= (need.min() if len(need) else _FAR)]

    def _score(self, own: slice, at: np.ndarray, leaf: int, other: Rows) -> None:
        got = scores(self.rows.vectors[own], other.vectors[at])
        self.scored += got.size
        right = (self.rows.labels[own, None] == other.labels[None, at]) == self.same
        parts = []
        for j in range(self.wide):
            hit = right & (got >= self.floors[own, j, None]) & (got <= self.highs[own, j, None])
            if hit.shape[1] > 4 * self.top:
                worst = np.partition(np.where(hit, got, -_FAR), -self.top, axis=1)[:, -self.top]
                hit &= got >= worst[:, None]
            i, k = np.nonzero(hit)
            if len(i):
                parts.append(((i + own.start) * self.wide + j, at[k], got[i, k]))
        if not parts:
            return
        slot, at, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = {"slot": slot, "score": score, "least": other.ids[at, 0], "count": other.count[at], "ids": other.ids[at]}
        both = {k: np.concatenate([v, new[k]]) for k, v in self.found[leaf].items()}
        order = np.lexsort((both["least"], -both["score"], both["slot"]))
        slot = both["slot"][order]
        first = np.flatnonzero(np.append(True, np.diff(slot) != 0))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        self.found[leaf] = {k: v[order[place < self.top]] for k, v in both.items()}
        full = order[place == self.top - 1]
        slots = np.unravel_index(both["slot"][full], self.floors.shape)
        self.floors[slots] = np.maximum(self.floors[slots], both["score"][full])

    def result(self) -> pa.RecordBatch:
        found = {k: np.concatenate([f[k] for f in self.found]) for k in self.found[0]}
        i, j = np.divmod(found["slot"], self.wide)
        ids = [row[:c] for row, c in zip(found["ids"].tolist(), found["count"].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(self.rows.cids[i]), pa.array(self.marks[i, j]), pa.array(found["score"]), pa.array(ids, pa.list_(pa.int64()))], names=["gid", "mark", "score", "ids"])


# ---- the search in Spark ---------------------------------------------------------------------------------------------


@contextlib.contextmanager
def _batches(spark: SparkSession, rows: int):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Index:
    """Candidate blocks, and their cells: part, cell, farthest member and span of labels, with the cells' centres."""

    blocks: DataFrame
    count: int
    cells: np.ndarray
    centers: np.ndarray
    keep: int


def _search(index: Index, anchors: DataFrame, top: int, same: bool, name: str) -> DataFrame:
    """gid, mark, score, ids: of each anchor class and window, the best classes of each lane of blocks. Stored.

    The blocks that meet a block of anchors come to it one after another, those with the greatest possible product first.
    """
    spark, keep = anchors.sparkSession, index.keep
    cells, centers = index.cells, index.centers
    lanes = max(1, -(-index.count // LANE))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cells["cell"].astype(np.int64)
        ball = centers[at], np.sqrt((centers[at] ** 2).sum(axis=1)), cells["far"] * (1 + 1e-9) + 1e-6
        for batch in batches:
            for row in batch.to_pylist():
                own = Search(row, keep, top, same)
                root = own.rows.levels[0]
                low, high = interval(root.centers, root.norms, root.radii, *ball)
                fits = labels_fit(root.least, root.most, cells["least"], cells["most"], same)
                bound = np.where(own.open, own.floors, _FAR).min(), np.where(own.open, own.highs, -_FAR).max()
                hit = np.flatnonzero((fits & (high >= bound[0]) & (low <= bound[1]))[0])
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]] * len(hit), pa.string()), pa.array(cells["part"][hit]), pa.array(at[hit]), pa.array(-high[0, hit])], names=["name", "part", "cell", "turn"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now:
                        yield now.result()
                    now = Search(row, keep, top, same)
                else:
                    now.meet(Rows(row, keep))
        if now:
            yield now.result()

    with _batches(spark, BATCH_BLOCKS):
        pairs = anchors.mapInArrow(lean(plan), "name string, part long, cell long, turn double").join(index.blocks, ["part", "cell"])
        fields = ["n", "cids", "labels", "vectors", "ids", "lows", "highs", "marks", "leaves"]
        met = pairs.select("name", F.pmod(F.xxhash64("part", "cell", "split"), F.lit(lanes)).alias("lane"), F.lit(1).alias("kind"), "turn", *fields)
        first = anchors.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), F.lit(0).alias("kind"), F.lit(0.0).alias("turn"), *fields)
        dealt = first.unionByName(met).repartition(max(2, shuffle_partitions(spark)), "name", "lane").sortWithinPartitions("name", "lane", "kind", "turn")
        return stored(dealt.mapInArrow(lean(search), "gid long, mark long, score long, ids array<long>"), name)


def _best(found: DataFrame, keys: list[str], top: int, name: str) -> DataFrame:
    """The first ``top`` rows of each key, as an array of (score, vec_id) in order."""
    rows = found.select(*keys, "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    kept = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("best"))
    return listed.select(*keys, F.transform("best", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias(name))


def build_index(classes: DataFrame, keep: int) -> tuple[Index, DataFrame]:
    """The index over stored classes (cid, label, q, ids), and the routed classes."""
    spark = classes.sparkSession
    part = F.pmod(F.xxhash64("label"), F.lit(PARTS))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.countDistinct(part).alias("parts")).first()
    dims, wanted = max(1, size["dims"] or 0), -(-size["n"] // (BLOCK * max(1, size["parts"])))
    depth = min(CELLS.bit_length() - 1, (max(1, wanted) - 1).bit_length())
    drawn = classes.select("q", F.xxhash64("cid", F.lit(7)).alias("h"), "cid").orderBy("h", "cid").limit(SAMPLE).select("q").toArrow()
    router = Router(_matrix(drawn.column("q"), dims) if drawn.num_rows else np.zeros((0, dims), np.int64), depth)
    routed = stored(_route(classes, router, dims), "negatives-routed")
    met = routed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("label").alias("least"), F.max("label").alias("most"))
    table = met.orderBy("part", "cell").toPandas()  # at most PARTS * CELLS rows
    cells = table.to_records(index=False)
    splits = spark.createDataFrame(table[["part", "cell", "n"]], "part long, cell long, n long")
    dealt = routed.join(F.broadcast(splits), ["part", "cell"]).withColumn("split", F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / BLOCK)))
    blocks = stored(_blocks(dealt.select("part", "cell", "split", "cid", "label", "vector", "ids"), keep), "negatives-blocks")
    return Index(blocks, int(np.ceil(table["n"] / BLOCK).sum()), cells, router.centers, keep), routed


def _anchor_blocks(groups: DataFrame, keep: int, name: str) -> DataFrame:
    """Blocks of anchors' classes of one cell, of any labels. Stored."""
    counts = groups.groupBy("cell").agg(F.ceil(F.count("*") / ANCHORS).alias("splits"))
    dealt = groups.join(F.broadcast(counts), "cell").withColumn("split", F.pmod(F.xxhash64("cid"), F.col("splits"))).withColumn("part", F.lit(0).cast("long"))
    wanted = [c for c in ("part", "cell", "split", "cid", "label", "vector", "ids", "wants") if c in dealt.columns]
    return stored(_blocks(dealt.select(*wanted), keep).withColumn("name", F.concat_ws("-", "cell", "split")), name)


def _percent(score: Column, percent: int) -> Column:
    """floor(percent * score / 100), exact for every 64-bit score."""
    times = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)")
    return F.call_function("div", times - F.pmod(times, F.lit(100).cast("decimal(10,0)")), F.lit(100).cast("decimal(10,0)"))


def mine_hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor, positive and negative.

    ``vectors`` has vec_id, label and q (integers); ``anchors`` says which rows are anchors. Scores are integer inner products
    with the anchor, higher ones first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of
    its label; for each, the negatives are the first ``negatives`` rows of other labels whose score is from low % to high % of
    the positive's. Fewer are all there are; a negative positive's score has no such rows.

    A vec_id names a row: of rows that share one, the least by label and vector counts. Vectors of different lengths are compared
    as if zeros followed, and scores must fit 64 bits. An empty table, one label or no anchor gives no row.
    """
    keep = positives + 1
    named = vectors.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "q")).alias("row")).select("vec_id", "row.*")
    rows = stored(named, "negatives-rows")
    nearest = Window.partitionBy("label", "q").orderBy("vec_id")  # the limit on the number is applied before the shuffle, too
    first = rows.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= keep)
    classes = first.groupBy("label", "q").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "negatives-classes")
    members = stored(rows.where(anchors).join(classes, ["label", "q"]).select("vec_id", F.col("cid").alias("gid")), "negatives-anchors")
    index, routed = build_index(classes, keep)
    groups = routed.join(members.select(F.col("gid").alias("cid")).distinct(), "cid", "left_semi")

    found = _search(index, _anchor_blocks(groups, keep, "negatives-anchor-blocks"), keep, True, "negatives-same")
    near = stored(_best(found, ["gid"], keep, "near"), "negatives-near")

    bound = lambda s: F.struct(s.alias("mark"), (-_percent(-s, low)).alias("low"), _percent(s, high).alias("high"))
    wants = near.select(F.col("gid").alias("cid"), F.transform(F.array_distinct(F.transform("near", lambda x: x["score"])), bound).alias("wants"))
    wants = wants.withColumn("wants", F.filter("wants", lambda w: w["low"] <= w["high"]))
    windowed = _anchor_blocks(groups.join(wants, "cid"), keep, "negatives-window-blocks")
    hard = _best(_search(index, windowed, negatives, False, "negatives-other"), ["gid", "mark"], negatives, "hard")
    hard = hard.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("mark", "hard"))).alias("hard"))
    answers = stored(near.join(hard, "gid"), "negatives-answers")

    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, positives)
    pairs = members.join(answers, "gid").select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("positive"), "hard")
    ranked = pairs.select("anchor_id", "positive", F.posexplode(F.col("hard")[F.col("positive.score")]).alias("place", "negative"))
    return ranked.select(
        "anchor_id",
        F.col("positive.vec_id").alias("positive_id"),
        (F.col("place") + 1).alias("rank"),
        F.col("negative.vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )
