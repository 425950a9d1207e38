import os
import random
import time

from pyspark.sql import functions as F

from cairnbase.operators.ledger import Stage
from cairnbase.streaming import ingest
from cairnbase.streaming.clusters import ClusterStore


def test_keys_of_columns_are_the_stage_keys(spark):
    stage = Stage("embed", None, "v2", {"k": [1, "x"], "a": None})
    df = spark.createDataFrame([("ab12",), ("ff",)], "h string")
    assert [r[0] for r in df.select(stage.input_hash_of(F.col("h"))).collect()] == [stage.input_hash("ab12"), stage.input_hash("ff")]


def _stages(folder, failing):
    def stage(name, deps=(), params=None):
        def run(content_hash):
            with open(f"{folder}/{name}-{content_hash}-{time.time_ns()}", "w"):
                pass
            if os.path.exists(f"{failing}/{name}-{content_hash}"):
                raise ValueError(f"{name} fails " + "x" * 9000)

        return Stage(name, run, params=params or {}, deps=deps)

    return {"txt": [stage("c", ("b",)), stage("b", ("a",)), stage("a")], "png": [stage("p")]}


def test_ledger_reuses_rows_and_halts_after_an_error(spark, tmp_path):
    ran, failing, ledger = tmp_path / "ran", tmp_path / "failing", str(tmp_path / "ledger")
    ran.mkdir(), failing.mkdir()
    plans = _stages(ran, failing)
    files = spark.createDataFrame([("h1", "txt"), ("h2", "txt"), ("h3", "png"), ("h4", None)], "content_hash string, format string")
    runs = lambda: sorted(n.rsplit("-", 1)[0] for n in os.listdir(ran))
    state = lambda: {(r.content_hash, r.stage): (r.status, r.attempts) for r in ingest.jobs(ingest.read_ledger(spark, ledger)).collect()}
    (failing / "b-h1").touch()
    ingest.run_batch(files, lambda f: plans.get(f, []), ledger)
    assert state() == {("h1", "a"): ("done", 1), ("h1", "b"): ("error", 1), ("h2", "a"): ("done", 1), ("h2", "b"): ("done", 1), ("h2", "c"): ("done", 1), ("h3", "p"): ("done", 1)}
    assert runs() == ["a-h1", "a-h2", "b-h1", "b-h2", "c-h2", "p-h3"]
    error = ingest.jobs(ingest.read_ledger(spark, ledger)).where("status = 'error'").first().error
    assert len(error) == ingest.ERROR_CHARS and "b fails" in error
    # a run that was killed has left a breadcrumb: the key is tried again on the same row
    (failing / "b-h1").unlink()
    key = plans["txt"][0].input_hash("h1")
    spark.createDataFrame([("h1", "c", key, "running", None, 1)], ingest.LEDGER).write.mode("append").parquet(ledger)
    ingest.run_batch(files, lambda f: plans.get(f, []), ledger)
    assert state()[("h1", "b")] == ("done", 2) and state()[("h1", "c")] == ("done", 2) and len(state()) == 7
    before = runs()
    ingest.run_batch(files, lambda f: plans.get(f, []), ledger)
    assert runs() == before
    # another parameter runs that stage alone
    plans["png"] = [Stage("p", plans["png"][0].run, params={"k": 2})]
    ingest.run_batch(files, lambda f: plans.get(f, []), ledger)
    assert sorted(set(runs()) - set(before)) == [] and len(runs()) == len(before) + 1


def test_poller_waits_retries_and_sees_changes(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt", ".hidden"):
        (inbox / name).write_text(name)
    now = time.time()
    os.utime(inbox / "a.txt", (now - 100, now - 100)), os.utime(inbox / ".hidden", (now - 100, now - 100)), os.utime(inbox / "sub/b.txt", (now - 1, now - 1))
    got = []

    def handle(files, fail=False):
        got.append(sorted(bytes(r.content).decode() for r in files.collect()))
        if fail:
            raise OSError("busy")

    poll = ingest.FolderPoller(spark, str(inbox), str(tmp_path / "seen"))
    try:
        poll.round(lambda f: handle(f, True), now)
    except OSError:
        pass
    assert poll.round(handle, now) == 1 and poll.round(handle, now) == 0 and got == [["a.txt"], ["a.txt"]]
    assert poll.round(lambda files: handle(files) or files.select("path"), now + 10) == 0  # the handler says that it failed
    assert poll.round(handle, now + 10) == 1 and got[2:] == [["sub/b.txt"], ["sub/b.txt"]]
    (inbox / "a.txt").write_text("changed")
    os.utime(inbox / "a.txt", (now - 50, now - 50))
    poll.watch(handle, 0.0, rounds=1)
    assert got[-1] == ["changed"]


def test_clusters_batch_by_batch_equal_those_from_scratch(spark, tmp_path):
    rng = random.Random(5)
    store, seen, edges = ClusterStore(spark, str(tmp_path / "clusters")), set(), []
    for batch in range(4):
        new = rng.sample(sorted(set(range(10, 90)) - seen), 15)
        seen |= set(new)
        more = [(rng.choice(sorted(seen)), rng.choice(new)) for _ in range(9)] + ([(5, new[0]), (new[1], 3)] if batch == 2 else [])
        seen |= {x for e in more for x in e}
        edges += more
        for _ in range(2 if batch == 1 else 1):  # a batch that is handed over again
            store.add(batch, spark.createDataFrame([(i,) for i in new], "id long"), spark.createDataFrame(more, "a long, b long"))
        root = {i: i for i in seen}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        assert {r.id: r.label for r in store.labels().collect()} == {i: top(i) for i in seen}
    moved = spark.read.parquet(str(tmp_path / "clusters/members"))
    assert moved.count() == len(seen)  # no member is ever written twice
