"""What compares two large trees neither stores nor shuffles what is equal in both, and leaves no shuffle files."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from canopy.engine import Config, Engine
from canopy.functions import events as ev
from canopy.functions.text import with_folded
from canopy.operators import overlay, reconcile
from canopy.sources import validate, work
from canopy.sources.store import SnapshotStore, StoreError
from canopy.streaming import live

COLUMNS = ["volume", "path", "parent", "name", "kind", "size", "file_id"]
N = 20_000


def row(path, kind="file", size=1, file_id=None):
    up, _, name = path.rpartition("/")
    return ("v", path, up or "/", name or "/", kind, size if kind == "file" else None, file_id)


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(work, "work_dir", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    return tmp_path


def frame(spark, rows):
    return work.work_table(spark.createDataFrame(rows, "volume string, path string, parent string, name string, kind string, size long, file_id long"), "given")


def stages(spark):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    found = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    return sum(s.shuffleWriteRecords() for s in stages(spark))


def shuffled_bytes(spark):
    return sum(s.shuffleWriteBytes() for s in stages(spark))


def tree():
    dirs = [row("/", "directory"), *[row(f"/d{i}", "directory", file_id=i) for i in range(20)]]
    return dirs + [row(f"/d{i % 20}/f{i}", size=i, file_id=i) for i in range(N)]


def test_equal_rows_are_not_stored(spark, shared):
    old = tree()
    gone = {"/d3/f3"}
    new = [r for r in old if r[1] not in gone]
    # A size and an id change places: a hash that passes over nulls sees no change.
    swap = row("/d1/x", size=7), ("v", "/d1/x", "/d1", "x", "file", None, 7)
    old, new = [*old, swap[0]], [*new, swap[1], row("/d5/f5.new"), row("/d2/sub", "directory"), row("/d2/sub/deep", "directory"), row("/d2/sub/deep/z"), row("/d7/unasked")]
    scopes = spark.createDataFrame([("v", f"/d{i}", False) for i in range(20) if i != 7], "volume string, root string, subtree boolean")
    found = reconcile.reconcile(frame(spark, old), frame(spark, new), scopes).collect()
    want = {("remove", "/d3/f3"), *[("upsert", p) for p in ("/d1/x", "/d5/f5.new", "/d2/sub", "/d2/sub/deep", "/d2/sub/deep/z")]}
    assert sorted((r.op, r.path) for r in found) == sorted(want)
    assert next((r["size"], r.file_id) for r in found if r.path == "/d1/x") == (None, 7)
    for name in ("old", "new"):
        assert spark.read.parquet(*[f"file://{p}" for p in shared.glob(f"{name}-*")]).count() < 100


def test_untouched_rows_are_not_shuffled(spark, shared):
    old = tree()
    base = frame(spark, old)
    ops = [("remove", 1, *row("/d3", "directory")), ("remove", 1, *row("/d4/f4")), ("upsert", 2, *row("/d5/f5", size=-1)), ("upsert", 2, *row("/d6/n/m")), ("upsert", 3, *row("/d8", "file"))]
    ops = spark.createDataFrame(ops, "op string, seq long, volume string, path string, parent string, name string, kind string, size long, file_id long")
    before = shuffled(spark)
    done = overlay.apply_mutations(base, ops)
    live = {r.path: r["size"] for r in done.live.collect()}
    assert shuffled(spark) - before < N / 2
    want = {r[1]: r[5] for r in old if not f"{r[1]}/".startswith(("/d3/", "/d8/")) and r[1] != "/d4/f4"} | {"/d5/f5": -1, "/d8": 1}
    assert live == want
    assert {r.path for r in done.tombstones.collect()} == {r[1] for r in old if f"{r[1]}/".startswith("/d3/") or r[1].startswith("/d8/") or r[1] == "/d4/f4"}


def test_marks_miss_no_key(spark, shared):
    rows = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    near, far = work.Marks(rows.where("id % 10 = 3"), ["k"]).split(rows)
    assert near.where("id % 10 = 3").count() == 5_000 and near.count() < 5_500
    assert near.count() + far.count() == 50_000 and near.columns == ["k", "id"]


def test_a_published_tree_is_checked_by_hashes(spark, shared):
    names = [row(f"/d1/{hashlib.sha256(str(i).encode()).hexdigest()}") for i in range(N)]
    rows = with_folded(frame(spark, [*tree()[:30], *names]))
    store = SnapshotStore(spark, f"{shared}/store")
    hashes = shuffled_bytes(spark)
    store.publish(rows, 1)
    assert shuffled_bytes(spark) - hashes < 25 * N  # a path takes more
    twice = rows.unionByName(rows.where("path = '/d1/f1'"))
    assert [tuple(r) for r in validate.violations(twice).collect()] == [("v", "/d1/f1", "twice")]
    with pytest.raises(StoreError, match="twice"):
        store.publish(twice, 2)


def test_a_full_inbox_is_not_stored(spark, shared):
    engine = Engine(spark, Config(f"{shared}/index"))
    engine.load(frame(spark, tree()[:100]), 1)
    flags = ev.FLAGS["must_scan"]
    events = spark.range(2, live.INBOX + 3).select(F.lit("v").alias("volume"), "id", F.lit("/d1").alias("path"), F.lit(flags).cast("long").alias("flags"))
    assert live.take(engine, events, 0, lambda base: base) == "rebuild"
    assert not list(shared.glob("inbox-*")) and engine.store.manifest().cursor == 1
    assert live.take(engine, events.limit(5), 1, lambda base: base) == "applied"
