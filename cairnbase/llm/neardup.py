"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with equal shingle sets form a class; from then on only classes are compared. Classes that share a band of
their signatures meet in a bucket. A bucket never emits all its pairs: its members are compared with one leader, the
member with the most company over all its bands, and what is linked becomes one component. Only members of other
components need further links. The sizes of their intersections with the leader, which is first given what most members
have, bound what they can share with any third set; those that the bound allows, and those that share enough rare
shingles that the leader lacks, form lists. Of a long list a few members are compared with all others, components are
contracted, and what is left is compared. Members too far from the leader go on with another one; what is left after
some rounds is settled as one list.

Each candidate pair is first judged on its signatures, a batch of hashes at a time: it is dropped once the posterior
probability that it is similar enough falls below the chosen miss probability. Survivors are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, lean, stored
from .hashing import BASE, mix, substring, sums

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 3
HASHES = BANDS * ROWS
BATCH = 16
#: Probability with which a similar pair may be dropped by its signatures.
MISS = 1e-6
#: Similarity down to which members are compared exactly with their leader.
RATED = 0.25
#: Rounds with a leader before the rest of a bucket is settled as one list.
LEADERS = 2
#: A list of at most FEW members is compared in full at once; of a longer one SEATS members with all others, ROUNDS times.
FEW, SEATS, ROUNDS = 16, 8, 1
#: Pairs of one set that one task joins; a set with more is copied to further tasks.
HOT = 1000
#: So many document ids, 8 bytes each, are broadcast to fetch their texts; beyond, the join is shuffled.
BROADCAST_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles, by the rules of link_documents()."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for text in texts:
        data = (text or "").encode()
        group.append(data)
        size += len(data) + 1
        if size > 1 << 18:
            out += _sets_of(group)
            group, size = [], 0
    return out + (_sets_of(group) if group else [])


def _sets_of(group: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([*group, b""]), np.uint8)
    ends = np.cumsum([len(d) + 1 for d in group])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(group)
    words = mix(substring(sums(_LOWER[data]), starts, stops) + (stops - starts).astype(np.uint64))
    five = np.zeros(len(words), np.uint64)
    k = max(0, len(words) - WORDS + 1)
    for i in range(WORDS):
        five[:k] = five[:k] * BASE + words[i : i + k]
    five[:k] = mix(five[:k])
    first = np.searchsorted(starts, np.concatenate(([0], ends[:-1])))
    last = np.append(first[1:], len(starts))
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(five[a : b - WORDS + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[a:b]:
                h = np.uint64((int(h) * int(BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash signature: for each hash function the least value over the set."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024]
        np.minimum(best, ((part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)).min(1), out=best)
    return best.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Rows of signatures to rows of band keys."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * BASE, parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h + parts[:, :, r])
    return h.view(np.int64)


def least_matches(similarity: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): below, the posterior of the similarity, under a flat prior, has less
    than ``miss`` of its weight at ``similarity`` or above."""
    out = []
    for n in range(batch, hashes + 1, batch):
        # the posterior after m matches is Beta(m + 1, n - m + 1); its upper tail is a binomial sum
        tail, least = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append((n, least))
    return out


def likely(a: np.ndarray, b: np.ndarray, similarity: float, miss: float = MISS) -> np.ndarray:
    """Which rows of signatures a and b go on to exact comparison."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(similarity, miss):
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= least], n
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def signatures_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (a hash of the shingle set, null if empty) and signature of every row; of rows without an
    id also key (the hash of the text) and row (a number of its own)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("signature", pa.binary()), ("key", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part, rows, seen = batch.slice(i, 1000), [], {}
                for doc_id, key, row, s in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "row")), shingle_sets(part.column("text").to_pylist()), strict=True):
                    if not len(s):
                        rows.append((doc_id, 0, None, None, key, row))
                        continue
                    node = xxhash.xxh3_64_intdigest(s.tobytes())
                    if node not in seen:
                        seen[node] = signature(s).tobytes()
                    rows.append((doc_id, len(s), node - (1 << 64) if node >> 63 else node, seen[node], key, row))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    missing = F.col("doc_id").isNull()
    keyed = docs.select("doc_id", "text", F.when(missing, F.xxhash64("text")).alias("key"), F.when(missing, F.monotonically_increasing_id()).alias("row"))
    return keyed.mapInArrow(lean(run), "doc_id long, n_shingles long, node long, signature binary, key long, row long")


def _bands(classes: DataFrame) -> DataFrame:
    """band, node for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                if part.num_rows:
                    keys = band_keys(np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], ["band", "node"])

    return classes.select("node", "signature").mapInArrow(lean(run), "band long, node long")


def _with_both(pairs: DataFrame, table: DataFrame, column: str, name_a: str, name_b: str) -> DataFrame:
    """Pairs (a, b) with a column of both nodes. Nodes of many pairs are dealt over tasks by their partners."""
    hot = stored(pairs.select(F.explode(F.array("a", "b")).alias("hot")).groupBy("hot").agg(F.ceil(F.count("*") / HOT).cast("int").alias("tasks")).where("tasks > 1"), "neardup-hot")
    if not hot.limit(1).count():
        return pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias(name_a)), "a").join(table.select(F.col("node").alias("b"), F.col(column).alias(name_b)), "b")
    copies = table.join(hot, F.col("node") == F.col("hot"), "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)))
    out = pairs
    for end, other, name in (("a", "b", name_a), ("b", "a", name_b)):
        task = F.pmod(F.xxhash64(other), F.coalesce("tasks", F.lit(1))).cast("int")
        out = out.join(hot, F.col(end) == F.col("hot"), "left").withColumn("task", task).drop("hot", "tasks")
        out = out.join(copies.select(F.col("node").alias(end), "task", F.col(column).alias(name)), [end, "task"]).drop("task")
    return out


def _judge(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""
    both = _with_both(pairs, classes.select("node", "signature"), "signature", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array(likely(sa, sb, similarity)))

    return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _exact(pairs: DataFrame, docs: DataFrame, classes: DataFrame, novel: bool = False) -> DataFrame:
    """a, b, common, na, nb: sizes of the intersection and of both sets, counted in full; with novel, what b has and a lacks."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stored(classes.join(needed, "node").select(F.coalesce("rep", "key").alias("_rep"), F.col("node").alias("_node")), "neardup-needed")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("_id"), "text").join(F.broadcast(ids) if few else ids, F.col("_id") == F.col("_rep")).select("_node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = []
                for node, s in zip(part.column("_node").to_pylist(), shingle_sets(part.column("text").to_pylist()), strict=True):
                    if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) == node % (1 << 64):  # not another text under the same id
                        rows.append((node, s.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("node", pa.int64()), ("shingles", pa.binary())]))

    full = stored(texts.mapInArrow(lean(sets), "node long, shingles binary").dropDuplicates(["node"]), "neardup-sets")
    both = _with_both(pairs, full, "shingles", "xa", "xb")
    fields = [("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())]
    schema = pa.schema([*fields, ("novel", pa.list_(pa.int64()))] if novel else fields)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, j, xa, xb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("xa"), batch.column("xb"), strict=True):
                a, b = np.frombuffer(xa.as_buffer(), np.uint64), np.frombuffer(xb.as_buffer(), np.uint64)
                known = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
                row = (i, j, int(known.sum()), len(a), len(b))
                rows.append((*row, b[~known].view(np.int64)) if novel else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return both.select("a", "b", "xa", "xb").mapInArrow(lean(compare), "a long, b long, common long, na long, nb long" + ", novel array<long>" * novel)


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of the graph of links (a, b), by hooking to the least neighbour and jumping."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = stored(both.toDF("u", "v"), "links")
    labels = stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("c").alias("n"))
        hooked = labels.join(near, labels["node"] == near["u"]).select("node", "c", F.least("c", "n").alias("h"))
        up = labels.select(F.col("node").alias("p"), F.col("c").alias("pc"))
        new = stored(hooked.join(up, F.col("h") == F.col("p"), "left").select("node", F.least(F.col("h"), F.coalesce(F.col("pc"), F.col("h"))).alias("n"), "c"), "labels")
        if not new.where("n < c").limit(1).count():
            return new.select("node", F.col("n").alias("component"))
        labels = new.select("node", F.col("n").alias("c"))


def _contract(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after some more links (a, b)."""
    return components(links if labels is None else links.union(labels.where("node <> component").select("node", "component")))


def _is_link(percent: int):
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def _beside_leader(near: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Lists of members of one leader that can be linked beside it, as _settle() takes them.

    near: lead, node, c (shared with the leader), n (size), novel (what the leader lacks). Two members share at most
    min(c, c') and what both have beyond the leader; a link needs (100 + percent) * shared >= percent * (n + n').
    What most members have and the leader lacks counts as if the leader had it, so that the leader stands for the
    text that all were copied from, whatever its own edits. What is in the leader's component already needs no links
    within it.
    """
    p, q = percent, 100 + percent
    of = labels.select(F.col("node").alias("lead"), F.col("component").alias("of_lead"))
    placed = near.join(labels, "node", "left").join(of, "lead", "left").withColumn("seat", F.coalesce("component", "node") != F.coalesce("of_lead", "lead")).drop("component", "of_lead")
    placed = stored(placed.join(placed.where("seat").select("lead").distinct(), "lead", "left_semi"), "neardup-border")
    groups = placed.groupBy("lead").agg(F.count("*").alias("m"), F.min("n").alias("n_min"))
    often = placed.select("lead", "seat", F.explode("novel").alias("s")).groupBy("lead", "s").agg(F.count("*").alias("f"), F.max("seat").alias("sought")).where("f > 1")
    often = stored(often.join(groups, "lead").select("lead", "s", "f", "sought", (F.col("f") * 2 > F.col("m")).alias("common")), "neardup-often")
    common = often.where("common").groupBy("lead").agg(F.collect_list("s").alias("common"))
    novel = F.array_except("novel", F.coalesce("common", F.array().cast("array<long>")))
    placed = placed.join(common, "lead", "left").withColumn("beyond", novel).withColumn("c", F.col("n") - F.size("beyond"))
    # without shingles beyond the leader: both must be small enough for what they share with it
    slack = 1e-9  # quotients are doubles
    most, least = F.floor(F.col("c") * q / p + slack) - F.col("n"), F.ceil(F.col("n") * p / 100 - slack)
    small = placed.where(most >= least).withColumn("s", F.lit(0).cast("long")).withColumn("v", F.lit(0).cast("long"))
    # with them: the pair shares one of the rarest of them, so many that the others alone would be too few
    due = F.greatest(F.lit(1), F.ceil((F.col("n") + F.greatest(F.col("n_min"), least)) * p / q - slack) - F.col("c"))
    kept = placed.join(groups.select("lead", "n_min"), "lead").withColumn("v", F.size("beyond").cast("long")).withColumn("keep", F.col("v") - due + 1).where("keep > 0")
    each = kept.select("lead", "node", "seat", "keep", "c", "n", "v", F.explode("beyond").alias("s"))
    ranked = each.join(often, ["lead", "s"], "left").withColumn("f", F.coalesce("f", F.lit(1)))
    rarest = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lead", "node").orderBy("f", "s"))).where("r <= keep and sought")
    columns = ["lead", "s", "node", "seat", "c", "n", "v"]
    return small.select(columns).union(rarest.select(columns))


def _across_leaders(members: DataFrame, bit: int) -> DataFrame:
    """Lists of members of one bucket, some near to this round's leader alone, the others to earlier ones alone.

    A link between them takes that either is on the border: so unlike all leaders that it was near to that the other
    can be far from them.
    """
    return members.where("border and near > 0").select(F.col("band").alias("lead"), "node", (F.col("near") == bit).alias("seat"))


def _settle(lists: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Labels after all links between members of one list, of which at least one has a seat.

    lists: lead, s (both name the list), node, seat, n (size); at most c is shared by way of the leader, v beyond it.
    Of a long list a few seats are compared with all other members; then what has become one component is no longer
    compared, and the next few follow. What is left after ROUNDS of that, as a rule nothing, is compared in full.
    """
    p, q = percent, 100 + percent
    for r in range(ROUNDS + 1):
        placed = lists.select("lead", "s", "node", "seat", "c", "n", "v").join(labels, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
        size = placed.groupBy("lead", "s").agg(F.count("*").alias("f"), F.min("of").alias("low"), F.max("of").alias("high"), F.max("seat").alias("sought")).where("low < high and sought")
        placed = stored(placed.join(size.select("lead", "s", "f"), ["lead", "s"]), "neardup-lists")
        if not placed.limit(1).count():
            break
        seats = placed.where("seat")
        if r < ROUNDS:
            order = Window.partitionBy("lead", "s").orderBy("node")
            first = seats.where(F.col("f") > FEW).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEATS).drop("r")
            seats = stored(seats.where(F.col("f") <= FEW).union(first), "neardup-seats")
        x = seats.select("lead", "s", F.col("node").alias("i"), F.col("of").alias("oi"), F.col("n").alias("ni"), F.col("c").alias("ci"), F.col("v").alias("vi"))
        y = placed.select("lead", "s", F.col("node").alias("j"), F.col("of").alias("oj"), F.col("n").alias("nj"), F.col("c").alias("cj"), F.col("v").alias("vj"))
        shared = F.least("ci", "cj") + F.least("vi", "vj")
        can = (F.col("oi") != F.col("oj")) & (shared * q >= (F.col("ni") + F.col("nj")) * p)
        pairs = x.join(y, ["lead", "s"]).where(can).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
        found = _linked(stored(pairs, "neardup-beside"), docs, classes, percent)
        if found.limit(1).count():
            labels = _contract(labels, found)
        if r < ROUNDS:
            lists = placed.where(F.col("f") > FEW).join(seats.select("lead", "s", "node"), ["lead", "s", "node"], "left_anti")
    return labels


def _bucket_lists(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Lists of buckets (lead, node, seat): nothing is known there but the sizes of the sets."""
    n = classes.select("node", F.col("n_shingles").alias("n"))
    return members.join(n, "node").select("lead", F.lit(0).cast("long").alias("s"), "node", "seat", F.col("n").alias("c"), "n", F.lit(0).cast("long").alias("v"))


def link_classes(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, leaders: int = LEADERS) -> DataFrame:
    """node, component (its least node) of all classes that are linked to others."""
    bands = _bands(classes)
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    active = stored(bands.join(sizes, "band"), "neardup-members")
    company = active.groupBy("node").agg(F.sum("n").alias("company"))
    active = active.join(company, "node").select("band", "node", "company", F.lit(0).alias("near"), F.lit(True).alias("border"))
    fresh, labels = F.col("near") == 0, None
    for k in range(leaders):
        # near: the rounds whose leader of the bucket a member was near to, as bits; fresh members have none, and it takes one of them to lead
        lead = active.groupBy("band").agg(F.max_by("node", F.when(fresh, F.struct("company", -F.col("node")))).alias("lead"), F.count("*").alias("n")).where("n > 1")
        members = stored(active.join(lead.select("band", "lead"), "band").where("node <> lead"), "neardup-round")
        if not members.limit(1).count():
            break
        stars = members.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        near = stored(_exact(stored(_judge(stars, classes, RATED), "neardup-likely"), docs, classes, novel=True), "neardup-near")
        labels = _contract(labels, near.where(_is_link(percent)).select("a", "b"))
        rated = near.select(F.col("a").alias("lead"), F.col("b").alias("node"), F.col("common").alias("c"), F.col("nb").alias("n"), _is_link(percent).alias("linked"), "novel", (F.col("common") < (F.col("na") + F.col("nb") - F.col("common")) * (RATED + 1 - percent / 100)).alias("loose"))
        placed = members.join(rated.select("lead", "node", "linked", "loose"), ["lead", "node"], "left").where("linked is null or not linked")
        now = F.col("near") + F.when(F.col("linked").isNull(), 0).otherwise(1 << k)
        rest = stored(placed.select("band", "node", "company", now.alias("near"), (F.col("border") & F.coalesce("loose", F.lit(True))).alias("border")), "neardup-rest")
        lists = _beside_leader(rated.select("lead", "node", "c", "n", "novel"), labels, percent)
        if k:
            lists = lists.union(_bucket_lists(_across_leaders(rest, 1 << k), classes))
        labels = _settle(stored(lists, "neardup-lists"), labels, docs, classes, percent)
        # a bucket goes on as long as a member is too far from its leader to be judged by it
        active = rest.join(rest.where(fresh).select("band").distinct(), "band", "left_semi")
    if labels is None:
        return components(active.select(F.col("node").alias("a"), F.col("node").alias("b")))
    left = active.select(F.col("band").alias("lead"), "node", fresh.alias("seat"))
    return _settle(_bucket_lists(left, classes), labels, docs, classes, percent)


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    likely_pairs = stored(_judge(pairs, classes, percent / 100), "neardup-likely")
    if not likely_pairs.limit(1).count():
        return likely_pairs
    return stored(_exact(likely_pairs, docs, classes), "neardup-exact").where(_is_link(percent)).select("a", "b")


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and of rows without an id key and row."""
    rows = stored(signatures_of(docs), "neardup-signatures")
    grouped = rows.where("node is not null").groupBy("node", "n_shingles", "signature").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.min("row").alias("row"))
    classes = stored(grouped, "neardup-classes")
    found = link_classes(docs, classes, percent)
    placed = classes.select("node", "rep", "row").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("row").alias("first"))
    by_node = placed.join(least, "component").select(F.col("node").alias("n"), F.col("component_id").alias("of_class"), "first")
    out = rows.select("doc_id", "n_shingles", "node", "key", "row").join(by_node, F.col("node") == F.col("n"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("of_class"))
    kept = F.col("doc_id").eqNullSafe(component) & (F.col("doc_id").isNotNull() | F.col("node").isNull() | (F.col("row") == F.col("first")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "key", "row")


def link_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    A-Z are lower-cased and words are runs without white space; the set of a document is its distinct 5-word
    shingles, or its whole word sequence if that is shorter. Null, empty and blank texts have an empty set and are
    linked with nothing. component_id is the smallest doc_id reachable over links, kept whether it is the row's own.
    Rows that repeat a doc_id are one document under each of their texts; a row with a null doc_id is a document of
    its own. If all rows of a component have a null doc_id, its component_id is null and one of them is kept.
    """
    return _placed(docs, percent).drop("key", "row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component; of rows that repeat a kept doc_id all stay.

    The ids to drop are the fewer, so they are what the texts are joined with: broadcast up to BROADCAST_IDS. Rows with
    a null doc_id are told apart by their texts: of equal ones to be kept one stays, but for those with an empty set.
    """
    at = fresh_names(docs, "dropped", "key", "stay", "empty")
    gone, key, stays, empty = (at[n] for n in ("dropped", "key", "stay", "empty"))
    placed = _placed(docs, PERCENT)
    dropped = placed.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("any_kept")).where("not any_kept").select(F.col("doc_id").alias(gone))
    dropped = stored(dropped, "neardup-dropped")
    few = dropped.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col(gone), "left_anti")
    nameless = stored(placed.where("doc_id is null"), "neardup-nameless")
    if not nameless.limit(1).count():
        return out
    rest = docs.where("doc_id is null").withColumn(key, F.xxhash64("text"))
    stay = nameless.where("kept").select(F.col("key").alias(stays), (F.col("n_shingles") == 0).alias(empty)).distinct()
    rest = rest.join(stay, F.col(key) == F.col(stays))
    one = rest.where(~F.col(empty)).dropDuplicates([key])
    return out.where("doc_id is not null").unionByName(rest.where(F.col(empty)).union(one).select(docs.columns))
