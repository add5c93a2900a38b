"""The namespace engine against plain-Python oracles and tables of cases."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from canopy.engine import Config, Engine
from canopy.functions import events as ev
from canopy.functions import paths, text
from canopy.operators import changes, overlay, search, stats, tree
from canopy.sources import namespace
from canopy.sources.store import SnapshotStore, StoreError
from canopy.streaming import pipeline

COLS = "volume string, path string, parent string, name string, kind string, size long, mtime long, file_id long"
#: Pieces that put together give names which differ by case, by composition, by folding to several letters, or only beyond the query.
HEADS = ["", "pre ", "Über", "x_"]
CORES = ["match", "MATCH", "MaTcH", "mátch", unicodedata.normalize("NFD", "mátch"), "maßtch", "MASSTCH", "mat ch"]
TAILS = ["", ".b", ".B", " 2", "-é", "ŉ"]


def tree_rows(seed=77):
    """Three volumes of uneven size; every kind, sized rows that aren't files, ties, and values at the ends of their ranges."""
    r = random.Random(seed)
    names = [h + c + t for h in HEADS for c in CORES for t in TAILS]
    out = []
    for v, n in (("alpha", 260), ("beta", 120), ("gamma", 7)):
        for i in range(n):
            parent = "/" + "/".join(f"{v[0]}{r.randrange(4)}" for _ in range(r.randrange(1, 4))) + f"/n{i}"
            kind = r.choices(["file", "symlink", "directory", "other"], [12, 2, 2, 1])[0]
            size = r.choice([None, 0, 1, 5, 5, 10**15])
            mtime = r.choice([None, -(2**62), -1, 0, 3, 3, 2**62])
            name = r.choice(names)
            out.append((v, f"{parent}/{name}", parent, name, kind, size, mtime, 10 * i + len(v)))
    return out


def fold(s):
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).casefold())


def oracle(rows, q, sort, desc, limit):
    q = fold(q)
    hits = []
    for v, path, _, name, kind, size, mtime, _ in rows:
        f = fold(name)
        if q and q in f:
            rank = 0 if f == q else 1 if f.startswith(q) else 2
            hits.append({"volume": v, "path": path, "name": name, "folded": f, "rank": rank, "size": size if kind == "file" else None, "mtime": mtime})
    b = lambda s: s.encode()
    rest = lambda h: (h["rank"], b(h["folded"]), b(h["path"]), b(h["volume"]))
    hits.sort(key=rest)
    if sort == "name":
        hits.sort(key=lambda h: (b(h["path"]), b(h["volume"])))
        hits.sort(key=lambda h: (b(h["folded"]), b(h["name"])), reverse=desc)
    elif sort != "relevance":
        known = sorted((h for h in hits if h[sort] is not None), key=lambda h: h[sort], reverse=desc)
        hits = known + [h for h in hits if h[sort] is None]
    return [(h["volume"], h["path"]) for h in hits[:limit]]


@pytest.fixture(scope="module")
def volume_rows(spark):
    rows = tree_rows()
    return rows, text.with_folded(spark.createDataFrame(rows, COLS)).cache()


@pytest.mark.parametrize("sort,desc", [("relevance", False), ("name", False), ("name", True), ("size", False), ("size", True), ("mtime", False), ("mtime", True)])
def test_all_sorts_against_a_full_sort(volume_rows, sort, desc):
    rows, df = volume_rows
    for q in ("match", "MASST", "MÁTCH", "ch.B"):
        for limit in (1, 63, 1000):
            got = search.search(df, search.Request(q, limit, sort, desc)).orderBy("pos").collect()
            assert [(r.volume, r.path) for r in got] == oracle(rows, q, sort, desc, limit)
            assert [r.pos for r in got] == list(range(1, len(got) + 1))


def test_pages_and_empty_queries(volume_rows):
    _, df = volume_rows
    hits, more = search.search_page(df, search.Request("match", 10))
    assert len(hits) == 10 and more
    hits, more = search.search_page(df, search.Request("match", 10_000))
    assert not more and len(hits) > 100
    for r in (search.Request("", 5), search.Request("match", 0), search.Request("match", -1)):
        assert search.search_page(df, r) == ([], False)
    assert search.resolve_sort("size", False) == "relevance" and search.resolve_sort("name", False) == "name"
    with pytest.raises(ValueError):
        search.Request("x", 1, "colour")


def test_late_and_early_metadata_joins_agree(volume_rows):
    _, df = volume_rows
    meta = df.select("volume", "path", "size", "mtime").dropDuplicates(["volume", "path"])
    bare = df.drop("size", "mtime").dropDuplicates(["volume", "path"])
    full = df.dropDuplicates(["volume", "path"])
    for sort in search.SORTS:
        r = search.Request("match", 40, sort)
        cols = ["pos", "volume", "path", "size", "mtime"]
        assert search.search(bare, r, meta).select(*cols).orderBy("pos").collect() == search.search(full, r).select(*cols).orderBy("pos").collect()


def test_predicate_and_top_k_reach_the_scan(spark, volume_rows, tmp_path, capsys):
    _, df = volume_rows
    df.write.parquet(str(tmp_path / "e"))
    search.search(spark.read.parquet(str(tmp_path / "e")), search.Request("match", 5)).explain("formatted")
    plan = capsys.readouterr().out
    assert "StringContains(folded,match)" in plan and "TakeOrderedAndProject" in plan


def values(spark, f, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("a"), F.col("b"))).collect()]


def test_paths(spark):
    cases = {"//a/./b/../c///": "/a/c", "/../../": "/", "/": "/", "relative": None, "/a\0b": None, "/a/.b/..c": "/a/.b/..c", "/a/..": "/", "/a/b": "/a/b", "": None}
    assert values(spark, lambda a, _: paths.normalize(a), [(k, "") for k in cases]) == list(cases.values())
    within = [("/ab", "/a", False), ("/a/b", "/a", True), ("/a", "/a", True), ("/x", "/", True), ("/a", "/a/b", False)]
    assert values(spark, paths.is_within, [w[:2] for w in within]) == [w[2] for w in within]
    assert values(spark, lambda a, _: paths.parent(a), [(p, "") for p in ("/a/b", "/a", "/")]) == ["/a", "/", "/"]
    assert values(spark, lambda a, _: paths.basename(a), [(p, "") for p in ("/a/b", "/a", "/")]) == ["b", "a", "/"]
    assert values(spark, lambda a, _: paths.ancestors(a), [(p, "") for p in ("/a/b", "/a", "/")]) == [["/", "/a"], ["/"], []]
    assert values(spark, lambda a, _: paths.depth(a), [(p, "") for p in ("/a/b", "/a", "/")]) == [2, 1, 0]


def test_minimal_roots(spark):
    given = ["/a", "/a/b", "/a-", "/a-/x/y", "/a./child", "/ab/child", "/a//./c", "/ab/child/z", "relative", "/a", "/a./child/", None]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    assert sorted(r.path for r in tree.minimal_roots(df).collect()) == ["/a", "/a-", "/a./child", "/ab/child"]


def test_tree(spark):
    files = [("v", p, "file") for p in ("/a/b/c", "/a/b/D", "/a-/x", "/a/b-/y", "/Z")]
    df = spark.createDataFrame(files, "volume string, path string, kind string")
    e = tree.with_parents(df).withColumn("parent", paths.parent(F.col("path"))).withColumn("name", paths.basename(F.col("path")))
    got = {r.path: r for r in tree.preorder(e).collect()}
    order = sorted(got, key=lambda p: got[p].ordinal)
    assert order == ["/", "/a", "/a/b", "/a/b/c", "/a/b/D", "/a/b-", "/a/b-/y", "/a-", "/a-/x", "/Z"]
    assert (got["/a"].subtree_end, got["/a/b"].subtree_end, got["/"].subtree_end, got["/Z"].subtree_end) == (7, 5, 10, 10)
    assert got["/a/b"].child_count == 2 and got["/"].child_count == 3 and got["/Z"].child_count == 0
    assert [r.path for r in tree.children_of(e, "v", "/a").collect()] == ["/a/b", "/a/b-"]
    assert tree.children_of(e, "v", "/Z").count() == 0


FLAG_CASES = [
    (("modified", "is_file"), "content_only", "refresh_size_and_time"),
    (("xattr", "is_dir"), "content_only", "none"),
    (("xattr", "finder_info", "owner", "is_file"), "content_only", "none"),
    (("inode_meta", "is_symlink"), "content_only", "refresh_time"),
    (("renamed", "is_dir"), "ambiguous", "refresh_time"),
    (("renamed", "removed"), "ambiguous", "remove"),
    (("own_event",), "ambiguous", "reconcile_parent"),
    (("created",), "ambiguous", "refresh_size_and_time"),
    (("history_done", "created", "removed"), "history_done", "none"),
    (("owner",), "ambiguous", "reconcile_parent"),
    (("created", "is_file"), "simple_create:file", "refresh_size_and_time"),
    (("created", "is_dir"), "simple_create:directory", "refresh_time"),
    (("created", "is_file", "is_dir"), "ambiguous", "refresh_time"),
    (("removed",), "simple_remove", "remove"),
    (("renamed", "modified", "is_file"), "ambiguous", "refresh_size_and_time"),
    (("created", "removed", "is_file"), "ambiguous", "reconcile_parent"),
    (("kernel_dropped", "must_scan"), "invalidated", "invalidated"),
    (("must_scan", "history_done"), "subtree_dirty", "reconcile_parent"),
    (("history_done",), "history_done", "none"),
    (("mount",), "ambiguous", "invalidated"),
    ((), "ambiguous", "none"),
]


def test_classification(spark):
    df = spark.createDataFrame([(i, ev.bits(*f)) for i, (f, _, _) in enumerate(FLAG_CASES)] + [(99, ev.KNOWN + 1)], "i int, flags long")
    got = df.orderBy("i").select(ev.classify(F.col("flags")), ev.impact(F.col("flags"))).collect()
    assert [tuple(r) for r in got] == [(c, m) for _, c, m in FLAG_CASES] + [("ambiguous", "reconcile_parent")]


def test_replay_floor(spark):
    one = ev.bits("created", "is_file")
    rows = [(90, one), (100, one), (101, one), (0, one), (2**63 - 1, one), (1, ev.FLAGS["must_scan"]), (2, one | ev.FLAGS["root_changed"]), (3, ev.KNOWN + 1)]
    df = spark.createDataFrame([(i, f"/p{i}", f) for i, f in rows], pipeline.EVENTS)
    assert sorted(r.id for r in changes.after_floor(df, 100).collect()) == [0, 1, 2, 3, 101, 2**63 - 1]
    kept = [ev.bits("created", "removed", "is_file"), ev.bits("renamed", "modified", "is_file"), ev.bits("xattr"), ev.bits("created")]
    skipped = [ev.bits("renamed"), ev.bits("renamed", "is_dir"), ev.bits("removed", "is_file"), ev.bits("xattr", "is_file")]
    df = spark.createDataFrame([(50, f"/q{i}", f) for i, f in enumerate(kept + skipped)], pipeline.EVENTS)
    assert sorted(r.path for r in changes.after_floor(df, 100).collect()) == [f"/q{i}" for i in range(len(kept))]
    assert (ev.FLAGS["must_scan"], ev.FLAGS["created"], ev.FLAGS["renamed"], ev.FLAGS["is_file"], ev.FLAGS["cloned"]) == (1, 0x100, 0x800, 0x10000, 0x400000)


def test_batch_plan(spark):
    f, d = ev.bits("created", "is_file"), ev.bits("created", "is_dir")
    rows = [(1, "/a/new", f), (2, "/b/gone", ev.FLAGS["removed"]), (3, "/c/x", ev.bits("renamed", "is_file")), (4, "/c/y", f), (5, "/d", ev.FLAGS["must_scan"]), (6, "/d/e/z", f), (7, "/g/dir", ev.FLAGS["removed"]), (8, "/g/dir/kid", f), (9, "/h/p", f), (10, "/h/p", ev.FLAGS["removed"]), (11, "/i", d), (12, "/j", ev.FLAGS["user_dropped"])]
    plan = changes.plan_batch(spark.createDataFrame(rows, pipeline.EVENTS))
    assert {(r.root, r.subtree) for r in plan["scopes"].collect()} == {("/c", False), ("/d", True), ("/g", False), ("/h", False)}
    assert {(r.path, r["class"]) for r in plan["patches"].collect()} == {("/a/new", "simple_create:file"), ("/b/gone", "simple_remove"), ("/i", "simple_create:directory")}
    assert [r.path for r in plan["rebuild"].collect()] == ["/j"]
    storm = changes.plan_batch(spark.createDataFrame([(i, f"/s/{i}", f) for i in range(300)], pipeline.EVENTS))
    assert storm["patches"].count() == 0 and [r.root for r in storm["scopes"].collect()] == ["/s"]


ENTRY = "volume string, path string, kind string, file_id long"
BASE = [("v", "/", "directory", 1), ("v", "/a", "directory", 2), ("v", "/a/x", "file", 3), ("v", "/a/s", "directory", 4), ("v", "/a/s/y", "file", 5), ("v", "/ab", "directory", 6), ("v", "/ab/z", "file", 7)]


ALL = {b[1] for b in BASE}
MUTATIONS = [
    ([("remove", "/a", "directory", 2)], {"/", "/ab", "/ab/z"}),
    ([("remove", "/", "directory", 1)], ALL),
    ([("upsert", "/a", "file", 2)], {"/", "/a", "/ab", "/ab/z"}),
    ([("upsert", "/a", "directory", 99)], {"/", "/a", "/ab", "/ab/z"}),
    ([("upsert", "/a/x", "file", 3)], ALL),
    ([("upsert", "/none/q", "file", 9)], ALL),
    ([("upsert", "/n", "directory", 8), ("upsert", "/n/q", "file", 9)], ALL | {"/n", "/n/q"}),
    ([("remove", "/a/x", "file", 3), ("upsert", "/a/x", "file", 30)], ALL),
    ([("upsert", "/a/x", "file", 30), ("remove", "/a/x", "file", 3)], ALL - {"/a/x"}),
    # The order across paths counts.
    ([("upsert", "/a/b", "file", 20), ("remove", "/a", "directory", 2), ("upsert", "/a", "directory", 2)], {"/", "/a", "/ab", "/ab/z"}),
    ([("remove", "/a", "directory", 2), ("upsert", "/a", "directory", 2), ("upsert", "/a/b", "file", 20)], {"/", "/a", "/a/b", "/ab", "/ab/z"}),
    ([("remove", "/a", "directory", 2), ("upsert", "/a/x", "file", 3)], {"/", "/ab", "/ab/z"}),
    # What is below a rejected directory is rejected, too.
    ([("upsert", "/zz/q", "directory", 50), ("upsert", "/zz/q/c", "file", 51)], ALL),
    ([("upsert", "/n/q", "file", 9), ("upsert", "/n", "directory", 8)], ALL | {"/n"}),
    ([("upsert", "/n/q", "file", 9), ("upsert", "/n", "directory", 8), ("upsert", "/n/q", "file", 9)], ALL | {"/n", "/n/q"}),
    ([("upsert", "/n", "directory", 8), ("upsert", "/n/m", "directory", 9), ("upsert", "/n/m/o", "file", 10), ("upsert", "/n", "directory", 88)], ALL | {"/n"}),
    ([("upsert", "/a/x", "directory", 3), ("upsert", "/a/x/y", "file", 60)], ALL | {"/a/x/y"}),
    ([("upsert", "/a/x/y", "file", 60), ("upsert", "/a/x", "directory", 3)], ALL),
    ([("upsert", "/a", "directory", 2), ("upsert", "/a/k/", "file", 5), ("upsert", "/a/../k", "file", 5)], ALL),
]


def test_mutations(spark):
    """All batches at once, each on a volume of its own."""
    base = spark.createDataFrame([(f"v{i}", *b[1:]) for i in range(len(MUTATIONS)) for b in BASE], ENTRY)
    rows = [(op, seq, f"v{i}", p, k, n) for i, (batch, _) in enumerate(MUTATIONS) for seq, (op, p, k, n) in enumerate(batch)]
    live = overlay.apply_mutations(base, spark.createDataFrame(rows, "op string, seq int, " + ENTRY)).live.collect()
    for i, (batch, want) in enumerate(MUTATIONS):
        assert {r.path for r in live if r.volume == f"v{i}"} == want, batch
    assert len(live) == sum(len(w) for _, w in MUTATIONS)


def test_mounts_and_other_devices_take_no_children(spark):
    schema = ENTRY + ", device_id long, is_mount_point boolean"
    base = spark.createDataFrame([("v", "/", "directory", 1, 7, False), ("v", "/m", "directory", 2, 7, True), ("v", "/d", "directory", 3, 8, False), ("v", "/o", "directory", 4, 0, False)], schema)
    rows = [("upsert", i, "v", f"{p}/x", "file", 10 + i, 7, False) for i, p in enumerate(("/m", "/d", "/o"))]
    live = overlay.apply_mutations(base, spark.createDataFrame(rows, "op string, seq int, " + schema)).live
    assert {r.path for r in live.collect()} == {"/", "/m", "/d", "/o", "/o/x"}


def test_sizes_are_gated_before_the_limit(spark):
    rows = [("v", "/d", "/", "d match", "directory", 999, 1, 1), ("v", "/f", "/", "f match", "file", 5, 2, 2)]
    df = text.with_folded(spark.createDataFrame(rows, COLS))
    assert [(r.path, r.size) for r in search.search(df, search.Request("match", 1, "size", True)).collect()] == [("/f", 5)]
    meta = spark.createDataFrame([("v", "/f", 50, 9), ("v", "/d", 60, 9)], "volume string, path string, size long, mtime long")
    for sort in search.SORTS:  # values of the rows give way to those of the table
        got = {r.path: (r.size, r.mtime) for r in search.search(df, search.Request("match", 5, sort), meta).collect()}
        assert got == {"/f": (50, 9), "/d": (None, 9)}


def test_preorder_folds_names(spark):
    files = [("v", p, "file") for p in ("/STRASSE z", "/straße a", "/Ábc", "/ább")]
    df = spark.createDataFrame(files, "volume string, path string, kind string")
    e = tree.with_parents(df).withColumn("parent", paths.parent(F.col("path"))).withColumn("name", paths.basename(F.col("path")))
    got = sorted(tree.preorder(e).collect(), key=lambda r: r.ordinal)
    assert [r.path for r in got] == ["/", "/straße a", "/STRASSE z", "/ább", "/Ábc"]


def test_volume_names_stay_text(spark, tmp_path):
    rows = spark.createDataFrame([("2024", "/", "directory", 1), ("07", "/", "directory", 1)], ENTRY)
    store = SnapshotStore(spark, f"file://{tmp_path}/n")
    store.publish(rows, 1)
    assert {r.volume for r in store.load().collect()} == {"2024", "07"} and store.start_mode() == "warm"


def test_lookup_child_is_canonical(spark):
    rows = [("v", f"/{n}", "/", n, "file", 1, 1, i) for i, n in enumerate(("Café", unicodedata.normalize("NFD", "CAFÉ"), "cafe"))]
    df = text.with_folded(spark.createDataFrame(rows, COLS))
    ask = lambda n: [r.file_id for r in tree.lookup_child(df, "v", "/", n).collect()]
    assert ask("Café") == [0] and ask(unicodedata.normalize("NFD", "Café")) == [0] and ask("CAFÉ") == [1] and ask("café") == []


def test_federation_answers_without_the_failed(spark):
    from canopy.operators.federation import Federation, Volume

    rows = tree_rows()
    df = text.with_folded(spark.createDataFrame(rows, COLS))
    f = Federation()
    f.mount(Volume("alpha", "B disk", "/"), lambda: df.where("volume = 'alpha'"))
    f.mount(Volume("beta", "A disk", "/Volumes/b", metadata_ready=False), lambda: df.where("volume = 'beta'"))

    def broken():
        raise OSError("gone")

    f.mount(Volume("gamma", "C", "/Volumes/c"), broken)
    for sort, desc in (("relevance", False), ("size", True), ("name", True)):
        got = f.search(search.Request("match", 30, sort, desc))
        assert [(h.volume, h.path) for h in got.hits] == oracle([r for r in rows if r[0] != "gamma"], "match", sort, desc, 30)
    assert got.has_more and set(got.failed) == {"gamma"} and got.searched == 2 and not got.metadata_complete
    f.refresh({"alpha"})
    got = f.search(search.Request("match", 30))
    assert got.offline == 2 and {h.volume for h in got.hits} == {"alpha"}
    f.refresh({"alpha", "beta", "gamma"})
    f.select({"beta"})
    assert f.volumes["beta"].state == "catching_up" and f.search(search.Request("match", 3)).catching_up == 1


def test_metadata_belongs_to_its_base(spark, tmp_path):
    from canopy.operators.metadata import MetadataState, MetadataStore

    store = SnapshotStore(spark, f"file://{tmp_path}/m")
    base = store.publish(spark.createDataFrame(BASE, ENTRY), 5)
    values = MetadataStore(store)
    assert values.load() is None and values.start_cursor() == 5
    rows = spark.createDataFrame([(v, p, 9 if k == "file" else None, 3) for v, p, k, _ in BASE], "volume string, path string, size long, mtime long")
    values.publish(base, rows, 4)
    assert values.load().count() == len(BASE) and values.start_cursor() == 4
    with pytest.raises(StoreError):
        values.publish(base, rows.where("path <> '/a'"), 4)
    store.publish(spark.createDataFrame(BASE[:3], ENTRY), 6)
    assert values.load() is None and values.start_cursor() == 6
    s = MetadataState().bind(False, 0)
    assert [s.freshness, s.begin(3).freshness, s.install().freshness] == ["building", "building", "catching_up"]
    s = s.install().advance(7, history_done=True)
    assert (s.freshness, s.cursor, s.advance(2**63 - 1).cursor, s.advance(9, pending=True).freshness) == ("live", 7, 7, "catching_up")
    assert (s.pause(True).freshness, s.pause(True).pause(False).freshness, s.fail().freshness) == ("paused_stale", "catching_up", "failed")


def test_diff_keeps_duplicates_and_order(spark):
    old = spark.createDataFrame([(0, "a", "f"), (1, "b", "f"), (2, "a", "d"), (3, "c", "f"), (4, "c", "f")], "pos int, path string, kind string")
    new = spark.createDataFrame([(0, "a", "f"), (1, "a", "d"), (2, "e", "f"), (3, "b", "f")], "pos int, path string, kind string")
    got = [(r.op, r.pos, r.path) for r in overlay.ordered_diff(old, new, ["kind"]).orderBy("op", "pos").collect()]
    assert got == [("remove", 3, "c"), ("remove", 4, "c"), ("upsert", 0, "a"), ("upsert", 2, "e")]


def test_checked_nanos_space_and_display(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(1, 2), (-1, 2), (big, 0), (-big - 1, 0), (1, -1), (1, 10**9)], "s long, n long")
    assert [r[0] for r in df.select(text.unix_nanos(F.col("s"), F.col("n"))).collect()] == [1000000002, -999999998, None, None, None, None]
    sizes = spark.createDataFrame([(0,), (10**10,), (big,)], "t long")
    assert [r[0] for r in sizes.select(text.required_space(F.col("t"))).collect()] == [2**28, 10**10 + 10**9, None]
    shown = spark.createDataFrame([(None,), (12,), (15_300,)], "t long")
    assert [r[0] for r in shown.select(text.size_text(F.col("t"))).collect()] == ["—", "12 B", "15.3 kB"]


def test_gates(spark):
    rows = [("a", i, v) for i, v in enumerate([1, 1, 2, 3, 3, 2, 2, 2, 2])]
    got = stats.growing_backlog(spark.createDataFrame(rows, "series string, at long, value long"), 4).orderBy("at").collect()
    assert [r.growing for r in got] == [False, False, False, True, True, False, False, False, False]
    rows = [("a", 0, 1, False), ("a", 10, 1, False), ("a", 30, 1, False), ("a", 35, 2, False), ("a", 70, 2, True), ("a", 100, 2, False)]
    got = stats.quiet(spark.createDataFrame(rows, "series string, at long, generation long, blocked boolean")).orderBy("at").collect()
    assert [r.quiet for r in got] == [False, False, True, False, False, True]
    one = stats.idle_average(spark.createDataFrame([("a", 2, 0.0), ("a", 1, 1.0)], "series string, at long, value double")).first()
    assert one.average == pytest.approx(0.6)


def test_store(spark, tmp_path):
    base = spark.createDataFrame(BASE, ENTRY)
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.start_mode() == "cold"
    first = store.publish(base, 5)
    seen = store.load(first)
    second = store.compact(base.where("path = '/ab/z'").select("volume", "path"), base.where("path = '/a/x'").withColumn("file_id", F.lit(33).cast("long")), 9)
    assert (second.version, second.generation, second.cursor, store.start_mode()) == (2, 2, 9, "warm")
    assert store.load().count() == 6 and seen.count() == 7  # a reader keeps its version
    assert store.checkpoint(12, 11).generation == 2 and store.manifest().metadata_cursor == 11
    with pytest.raises(StoreError):
        store.publish(base.unionByName(base), 10)
    with pytest.raises(StoreError):
        store._write("manifests/1.json", "{}")
    assert store.manifest().version == 3 and store.verify()
    other = SnapshotStore(spark, f"file://{tmp_path}/t")
    assert store.copy_to(other).digest == store.manifest().digest
    base.limit(1).write.mode("overwrite").partitionBy("volume").parquet(f"{tmp_path}/s/data/lost")
    assert store.clean() == 1


def test_stream_restart_is_idempotent(spark, tmp_path):
    f = ev.bits("created", "is_file")
    root = f"file://{tmp_path}"
    schema = pipeline.EVENTS
    spark.createDataFrame([(98, "/old", f), (101, "/new", f), (1, "/d", ev.FLAGS["must_scan"])], schema).coalesce(1).write.parquet(f"{root}/in")
    go = lambda: pipeline.run(spark, f"{root}/in", f"{root}/out", f"{root}/check", 100, 50).awaitTermination()
    go()
    go()
    got = {r.path: (r["class"], r.impact) for r in pipeline.applied(spark, f"{root}/out").collect()}
    assert got == {"/old": (None, "refresh_size_and_time"), "/new": ("simple_create:file", "refresh_size_and_time"), "/d": ("subtree_dirty", "reconcile_parent")}
    spark.createDataFrame([(102, "/new", ev.FLAGS["removed"])], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    go()
    assert pipeline.cursor(spark, f"{root}/out") == 102
    assert pipeline.applied(spark, f"{root}/out").count() == 4


def test_engine(spark, tmp_path):
    rows = tree_rows()
    dirs = sorted({(v, p) for v, path, *_ in rows for p in ["/"] + ["/" + "/".join(path.split("/")[1:i]) for i in range(2, len(path.split("/")))]})
    entries = spark.createDataFrame(rows + [(v, p, p.rsplit("/", 1)[0] or "/", p.rsplit("/", 1)[1] or "/", "directory", None, None, i) for i, (v, p) in enumerate(dirs)], COLS).dropDuplicates(["volume", "path"])
    e = Engine(spark, Config(f"file://{tmp_path}/engine"))
    e.load(entries, 1)
    assert [(h.volume, h.path) for h in e.search("match").hits] == oracle(rows, "match", "relevance", False, 50)
    v, path, parent, name, kind, size, mtime, i = rows[3]
    e.apply(spark.createDataFrame([("upsert", 1, v, f"{parent}/match-zz", parent, "match-zz", "file", 77, 1, 9001), ("remove", 2, v, path, parent, name, kind, size, mtime, i)], "op string, seq int, " + COLS))
    now = [r for r in rows if r[1] != path] + [(v, f"{parent}/match-zz", parent, "match-zz", "file", 77, 1, 9001)]
    before = e.search("match", 60, "size")
    assert [(h.volume, h.path) for h in before.hits] == oracle(now, "match", "size", True, 60) and before.has_more
    again = Engine(spark, Config(f"file://{tmp_path}/engine"))  # batches outlive the process
    assert [(h.volume, h.path) for h in again.search("match", 60, "size").hits] == [(h.volume, h.path) for h in before.hits]
    assert '"batches":1' in again.command(":diagnostics") and not again.compaction_due(0)
    e.checkpoint(7)
    assert e.batches() == [] and e.store.manifest().metadata_cursor == 1
    assert [(h.volume, h.path) for h in e.search("match", 60, "size").hits] == [(h.volume, h.path) for h in before.hits]
    assert e.store.manifest().cursor == 7 and e.verify(e.rows()).count() == 0
    e.pause("user")
    e.pause("sleep")
    assert not e.resume("user") and e.search("match").freshness == "paused_stale"
    e.apply(spark.createDataFrame([("remove", 1, v, parent, parent.rsplit("/", 1)[0], parent.rsplit("/", 1)[1], "directory", None, None, 0)], "op string, seq int, " + COLS))
    assert e.batches() == []  # held back
    assert e.resume("sleep") and len(e.batches()) == 1 and not [h for h in e.search("match", 1000).hits if h.path.startswith(parent + "/")]
    with pytest.raises(ValueError):
        e.command(":nonsense")
    e.close("force_compact", 9)
    assert e.state == "stopped" and e.batches() == [] and e.store.manifest().cursor == 9
    with pytest.raises(ValueError):
        Config("x", workers=17)


def test_scan(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/f.txt").write_text("hello")
    (tmp_path / "a/b/g").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/x").write_text("x")
    got = {r.path.removeprefix(str(tmp_path)): (r.kind, r.size) for r in namespace.scan(spark, "v", str(tmp_path), (str(tmp_path / "skip"),), 2).collect()}
    assert got == {"/a": ("directory", None), "/a/f.txt": ("file", 5), "/a/b": ("directory", None), "/a/b/g": ("file", 0), "/link": ("symlink", None)}
    with pytest.raises(OSError):
        namespace.scan(spark, "v", str(tmp_path / "none"))


def test_synthetic(spark):
    rows = namespace.synthetic(spark, 9000)
    assert rows.count() == 9000 and rows.select("parent").distinct().count() == 3
    assert search.matches(rows, unicodedata.normalize("NFD", "CAFÉ")).count() == 90
