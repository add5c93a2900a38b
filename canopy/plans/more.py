"""Registered queries of the live path, metadata, federation, validation and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import events as ev
from canopy.functions import paths, storage
from canopy.functions.text import fold_ascii
from canopy.operators import federation, metadata, overlay, reconcile, tree
from canopy.operators import search as s
from canopy.plans.queries import CLASS_SQL, ENTRIES, EV, IMPACT_SQL, NS, layers, query
from canopy.sources import namespace as ns
from canopy.sources import validate
from canopy.sources.work import work_table

# ---------------------------------------------------------------- reconciliation

#: Directories and files with their columns; and the same tree after one file in 50 went, one in 37 grew and one in 41 got a neighbour.
TREE = ENTRIES + """, base AS (SELECT e.volume, e.path, e.parent, e.name, e.folded, e.kind, f.size, f.file_id, coalesce(f.part, 0) AS part FROM e LEFT JOIN files f USING (volume, path)),
actual AS (SELECT volume, path, parent, name, folded, kind, CASE WHEN part % 37 = 0 THEN size + 1 ELSE size END AS size, file_id FROM base WHERE part = 0 OR part % 50 <> 0
  UNION ALL SELECT volume, path || '.new', parent, name || '.new', folded || '.new', kind, size, file_id FROM base WHERE part > 0 AND part % 41 = 0),
listed AS (SELECT DISTINCT volume, parent FROM base WHERE kind <> 'directory' AND length(parent) % 3 <> 0)"""
TREE_COLS = ["volume", "path", "parent", "name", "folded", "kind", "size", "file_id"]


def trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree as it was, as it is now, and the scopes to list.

    Only files are stored, without what follows from other columns: both trees
    are read from that one table.
    """
    files = ns.files(spark, d, moved_once=True).select("volume", "parent", "name", "kind", "size", "file_id", "part")
    files = work_table(files, "tree", "zstd")
    files = files.withColumn("path", F.concat("parent", F.lit("/"), "name")).withColumn("folded", fold_ascii(F.col("name")))
    # All files of a directory have its ancestors; a name with a slash has more.
    above = F.when(F.contains("name", F.lit("/")), paths.parent(F.col("path"))).otherwise(F.col("parent"))
    above = files.select("volume", above.alias("path")).distinct().select("volume", F.explode(paths.ancestors(F.col("path"), proper=False)).alias("path"))
    folders = work_table(ns.directories(above), "folders")
    base = files.unionByName(folders.select("*", *[F.lit(None).cast("long").alias(c) for c in ("size", "file_id", "part")]))
    part = F.coalesce("part", F.lit(0))
    stays = base.where((part == 0) | (part % 50 != 0)).withColumn("size", F.when((part % 37 == 0), F.col("size") + 1).otherwise(F.col("size")))
    more = files.where((F.col("part") > 0) & (F.col("part") % 41 == 0)).select("volume", *[F.concat(c, F.lit(".new")).alias(c) if c in ("path", "name", "folded") else F.col(c) for c in TREE_COLS[1:]])
    scopes = files.where(F.length("parent") % 3 != 0).select("volume", F.col("parent").alias("root"), F.lit(False).alias("subtree")).distinct()
    return base.select(*TREE_COLS), stays.select(*TREE_COLS).unionByName(more), work_table(scopes, "scopes")


@query("reconciled_tree", f"WITH {TREE} SELECT volume, path, kind, size, file_id FROM actual WHERE (volume, parent) IN (SELECT * FROM listed) UNION ALL SELECT volume, path, kind, size, file_id FROM base WHERE (volume, parent) NOT IN (SELECT * FROM listed)")
def reconciled_tree(spark: SparkSession, d: str) -> DataFrame:
    """After the scopes are listed and applied: there the tree as it is now, elsewhere as it was."""
    base, actual, scopes = trees(spark, d)
    plan = work_table(reconcile.reconcile(base, actual, scopes), "plan")
    return overlay.apply_mutations(base, plan).live.select("volume", "path", "kind", "size", "file_id")


@query("reconcile_plan", f"WITH {TREE}, o AS (SELECT * FROM base WHERE (volume, parent) IN (SELECT * FROM listed)), n AS (SELECT * FROM actual WHERE (volume, parent) IN (SELECT * FROM listed)) SELECT 'remove' AS op, volume, path FROM o WHERE (volume, path) NOT IN (SELECT volume, path FROM n) UNION ALL SELECT 'upsert', n.volume, n.path FROM n LEFT JOIN o USING (volume, path) WHERE o.path IS NULL OR n.size IS DISTINCT FROM o.size")
def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(*trees(spark, d)).select("op", "volume", "path")


@query("authoritative_patches", f"WITH {TREE} SELECT CASE WHEN a.path IS NULL THEN 'remove' ELSE 'upsert' END AS op, b.volume, b.path, a.size FROM base b LEFT JOIN actual a USING (volume, path) WHERE b.part > 0 AND b.part % 10 = 0")
def authoritative_patches(spark: SparkSession, d: str) -> DataFrame:
    _, actual, _ = trees(spark, d)
    asked = ns.files(spark, d).where("part > 0 AND part % 10 = 0").select("volume", "path")
    return reconcile.authoritative(asked, actual)[0].select("op", "volume", "path", "size")


@query("metadata_hints", f"WITH {TREE}, o AS (SELECT * FROM base WHERE (volume, parent) IN (SELECT * FROM listed)), n AS (SELECT * FROM actual WHERE (volume, parent) IN (SELECT * FROM listed)), m AS (SELECT 'remove' AS op, volume, path, parent FROM o WHERE (volume, path) NOT IN (SELECT volume, path FROM n) UNION ALL SELECT 'upsert', n.volume, n.path, n.parent FROM n LEFT JOIN o USING (volume, path) WHERE o.path IS NULL OR n.size IS DISTINCT FROM o.size) SELECT DISTINCT volume, parent AS path, {ev.FLAGS['xattr']}::BIGINT AS flags FROM m UNION ALL SELECT volume, path, {ev.FLAGS['removed']}::BIGINT FROM m WHERE op = 'remove'")
def metadata_hints(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.metadata_hints(reconcile.reconcile(*trees(spark, d))).select("volume", "path", "flags")


@query("lookup_plan", f"WITH {NS}, q AS (SELECT volume, parent, count(DISTINCT path)::BIGINT AS requested FROM files WHERE part % 9 = 0 OR length(parent) % 2 = 0 GROUP BY ALL), c AS (SELECT volume, parent, count(*)::BIGINT AS children FROM files GROUP BY ALL) SELECT volume, parent, requested, children, CASE WHEN requested >= 512 THEN 'collapse' WHEN requested * 8 < children THEN 'names' ELSE 'bulk' END AS way, CASE WHEN requested < 512 AND requested * 8 < children THEN ceil(requested / 64)::INT ELSE 1 END AS batches FROM q JOIN c USING (volume, parent)")
def lookup_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    siblings = tree.child_counts(rows).select("volume", "parent", "children")
    asked = rows.where((F.col("part") % 9 == 0) | (F.length("parent") % 2 == 0)).select("volume", "path")
    return reconcile.lookup_plan(asked, siblings).select("volume", "parent", "requested", "children", "way", "batches")


@query("lookup_keys", f"WITH {NS} SELECT volume, CASE WHEN part % 3 <> 0 THEN '7:' || (file_id % 1000) ELSE path END AS key, count(*)::BIGINT AS n, min(path) AS path FROM files GROUP BY ALL")
def lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d).withColumn("device_id", F.when(F.col("part") % 3 != 0, F.lit(7))).withColumn("file_id", F.col("file_id") % 1000)
    return reconcile.lookup_keys(rows)


QUEUE = f"""{ENTRIES}, w AS (SELECT volume, path AS root, length(path)::BIGINT AS cursor, (length(path) % 7)::BIGINT AS generation, (length(path) % 5)::DOUBLE AS next_attempt, length(path) % 2 = 0 AS subtree FROM e WHERE kind = 'directory' AND length(path) % 4 > 0 AND path <> '/'),
t AS (SELECT w.*, (SELECT min(x.root) FROM w x WHERE x.volume = w.volume AND (w.root = x.root OR starts_with(w.root, x.root || '/'))) AS top FROM w)"""


@query("deferred_queue", f"WITH {QUEUE}, m AS (SELECT volume, top, min(cursor) AS cursor, max(generation) AS generation, min(next_attempt) AS next_attempt FROM t GROUP BY ALL) SELECT volume, top AS root, root AS path, subtree, m.cursor, m.generation, m.next_attempt FROM t JOIN m USING (volume, top)")
def deferred_queue(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.coalesce_queue(*waiting(spark, d))


def waiting(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = F.length("path")
    dirs = ns.entries(spark, d).where((F.col("kind") == "directory") & (n % 4 > 0) & (F.col("path") != "/"))
    rows = dirs.select("volume", F.col("path").alias("root"), "path", (n % 2 == 0).alias("subtree"), n.cast("long").alias("cursor"), (n % 7).cast("long").alias("generation"), (n % 5).cast("double").alias("next_attempt"))
    return rows.where("cursor % 3 = 0"), rows.where("cursor % 3 <> 0")


@query("queue_state", f"WITH {QUEUE}, r AS (SELECT DISTINCT volume, top FROM t) SELECT (SELECT count(*) FROM r)::BIGINT AS roots, count(*)::BIGINT AS directories, ((SELECT sum(strlen(top) + 128) FROM r) + sum(strlen(root) + 32))::BIGINT AS bytes, min(cursor)::BIGINT AS cursor, (SELECT count(*) FROM r) > 4096 OR count(*) > 100000 AS overflow FROM t")
def queue_state(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.queue_state(reconcile.coalesce_queue(*waiting(spark, d)))


# ---------------------------------------------------------------- metadata


@query("metadata_aligned", f"WITH {NS} SELECT volume, path, CASE WHEN kind = 'file' AND part % 11 <> 0 AND part % 13 <> 0 THEN size END AS size, CASE WHEN part % 11 <> 0 AND part % 13 <> 0 THEN mtime END AS mtime FROM files")
def metadata_aligned(spark: SparkSession, d: str) -> DataFrame:
    """A scan that missed one entry in 11 and met another file in one place of 13."""
    base = ns.files(spark, d)
    seen = base.where("part % 11 <> 0").withColumn("file_id", F.when(F.col("part") % 13 == 0, F.col("file_id") + 1).otherwise(F.col("file_id")))
    return metadata.aligned(seen, base)


@query("metadata_unaligned", f"WITH {NS} SELECT volume, path FROM files WHERE part % 11 <> 0 AND part % 13 = 0")
def metadata_unaligned(spark: SparkSession, d: str) -> DataFrame:
    base = ns.files(spark, d)
    seen = base.where("part % 11 <> 0").withColumn("file_id", F.when(F.col("part") % 13 == 0, F.col("file_id") + 1).otherwise(F.col("file_id")))
    return metadata.unaligned(seen, base).select("volume", "path")


@query("metadata_unknown_sizes", f"WITH {NS} SELECT count(*)::BIGINT AS entries, count_if(kind = 'file' AND part % 11 = 0)::BIGINT AS unknown_sizes FROM files")
def metadata_unknown_sizes(spark: SparkSession, d: str) -> DataFrame:
    base = ns.files(spark, d)
    return metadata.unknown_sizes(metadata.aligned(base.where("part % 11 <> 0"), base), base)


@query("metadata_updates", f"WITH {NS} SELECT volume, path, CASE WHEN part % 6 = 0 THEN NULL WHEN part % 4 = 0 THEN size + 2 ELSE size END AS size, CASE WHEN part % 6 = 0 THEN NULL ELSE mtime END AS mtime FROM files")
def metadata_updates(spark: SparkSession, d: str) -> DataFrame:
    """Two updates for one path in four, the later one counts; one in six is gone."""
    rows = ns.files(spark, d)
    some = rows.where("part % 4 = 0").select("volume", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "size", "mtime")
    some = some.select("volume", "path", "seq", (F.col("size") + F.col("seq")).alias("size"), "mtime", F.lit(False).alias("gone"))
    gone = rows.where("part % 6 = 0").select("volume", "path", F.lit(9).alias("seq"), "size", "mtime", F.lit(True).alias("gone"))
    return metadata.updated(rows.select("volume", "path", "size", "mtime"), some.unionByName(gone))


@query("metadata_checkpoint", "SELECT o_orderkey AS id, ((o_orderkey * 7 >= 100000 OR o_orderkey * 9000 >= 33554432) AND o_orderkey % 60 >= 30 AND o_orderkey % 1000 >= 600) OR o_orderkey * 9000 >= 268435456 AS due FROM orders")
def metadata_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = ns.read(spark, d, "orders").select(k.alias("id"), (k * 7).alias("overlay_rows"), (k * 9000).alias("overlay_bytes"), (k % 60).alias("quiet_seconds"), (k % 1000).alias("since_seconds"))
    return metadata.checkpoint_due(rows).select("id", "due")


@query("metadata_validation", f"WITH {NS} SELECT volume, path, CASE WHEN part % 17 = 0 THEN 'no_row' WHEN kind <> 'file' THEN 'size_of_symlink' ELSE 'negative' END AS why FROM files WHERE part % 17 = 0 OR (part % 17 = 1 AND kind <> 'file') OR (part % 17 = 2 AND kind = 'file')")
def metadata_validation(spark: SparkSession, d: str) -> DataFrame:
    base = ns.files(spark, d)
    p = F.col("part") % 17
    size = F.when(p == 1, F.lit(5)).when((p == 2) & (F.col("kind") == "file"), F.lit(-1)).when(F.col("kind") == "file", F.lit(1))
    return metadata.invalid(base.where(p != 0).select("volume", "path", size.cast("long").alias("size"), "mtime"), base)


@query("renamed_twice", f"WITH {NS} SELECT volume, '/moved/again' || substr(path, length(volume) + 2) AS path, path AS source FROM files")
def renamed_twice(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    volumes = rows.select("volume").distinct()
    top = F.concat(F.lit("/"), "volume")
    aliases = volumes.select("volume", F.lit("/moved/again").alias("new_root"), F.lit("/moved/once").alias("old_root")).unionByName(volumes.select("volume", F.lit("/moved/once").alias("new_root"), top.alias("old_root")))
    moved = rows.select("volume", F.concat(F.lit("/moved/again"), F.expr("substring(path, length(volume) + 2)")).alias("path"))
    return metadata.chained_source(moved, aliases)


# ---------------------------------------------------------------- federation


@query("federated_search", f"WITH {NS}, m AS (SELECT f.*, 'disk ' || (r_regionkey % 2) AS display, CASE WHEN folded = 'small' THEN 0 WHEN starts_with(folded, 'small') THEN 1 ELSE 2 END::INT AS match_rank FROM files f JOIN region ON r_name = volume WHERE contains(folded, 'small')) SELECT volume, display, path, size, match_rank FROM m ORDER BY size DESC NULLS LAST, match_rank, folded, path, display, volume LIMIT 70")
def federated_search(spark: SparkSession, d: str) -> DataFrame:
    volumes = ns.read(spark, d, "region").select(F.col("r_name").alias("volume"), F.concat(F.lit("disk "), (F.col("r_regionkey") % 2).cast("string")).alias("display"))
    return federation.fan_out(ns.files(spark, d).join(F.broadcast(volumes.limit(10_000)), "volume"), s.Request("small", 70, "size")).select("volume", "display", "path", "size", "match_rank")


MOUNTS = "mt AS (SELECT s_suppkey, 'u' || (s_suppkey % 90) AS uuid, s_name AS display, CASE s_suppkey % 6 WHEN 0 THEN '/' WHEN 1 THEN '/Volumes/' || s_name WHEN 2 THEN '/Volumes/Recovery' WHEN 3 THEN '/Volumes/.hidden' WHEN 4 THEN '/mnt/' || s_name ELSE '/Volumes/a/' || s_name END AS mount, s_suppkey % 7 <> 0 AS is_local, ['apfs', 'nfs', 'hfs', 'smbfs', 'autofs'][s_suppkey % 5 + 1] AS fs FROM supplier)"


@query("volume_sources", f"WITH {MOUNTS}, k AS (SELECT *, mount = '/' AS is_system, row_number() OVER (PARTITION BY uuid ORDER BY mount = '/' DESC, mount) AS n FROM mt WHERE is_local AND fs NOT IN ('nfs', 'smbfs', 'autofs') AND s_suppkey % 6 < 2) SELECT uuid, mount, is_system FROM k WHERE n = 1")
def volume_sources(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    mount = F.when(k % 6 == 0, F.lit("/")).when(k % 6 == 1, F.concat(F.lit("/Volumes/"), name)).when(k % 6 == 2, F.lit("/Volumes/Recovery")).when(k % 6 == 3, F.lit("/Volumes/.hidden")).when(k % 6 == 4, F.concat(F.lit("/mnt/"), name)).otherwise(F.concat(F.lit("/Volumes/a/"), name))
    fs = F.element_at(F.array(*[F.lit(x) for x in ("apfs", "nfs", "hfs", "smbfs", "autofs")]), (k % 5 + 1).cast("int"))
    rows = ns.read(spark, d, "supplier").select(F.concat(F.lit("u"), (k % 90).cast("string")).alias("uuid"), name.alias("display"), mount.alias("mount"), (k % 7 != 0).alias("is_local"), fs.alias("file_system"))
    return federation.sources(rows).select("uuid", "mount", "is_system")


@query("volume_labels", "SELECT s_suppkey AS id, CASE st WHEN 'live' THEN 'Live' WHEN 'paused' THEN 'Paused, results may be old' WHEN 'offline' THEN 'Source volume offline' ELSE 'Catching up' END AS label, CASE st WHEN 'live' THEN 'live' WHEN 'paused' THEN 'paused_stale' WHEN 'offline' THEN 'base_snapshot' ELSE 'catching_up' END AS freshness FROM (SELECT s_suppkey, ['live', 'paused', 'offline', 'catching_up'][s_suppkey % 4 + 1] AS st FROM supplier)")
def volume_labels(spark: SparkSession, d: str) -> DataFrame:
    st = F.element_at(F.array(*[F.lit(x) for x in ("live", "paused", "offline", "catching_up")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return ns.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), federation.label(st).alias("label"), federation.freshness(st).alias("freshness"))


# ---------------------------------------------------------------- validation, limits, storage


@query("base_violations", f"WITH {ENTRIES}, b AS (SELECT e.volume, e.path, CASE WHEN part % 19 = 1 THEN name || 'x' ELSE e.name END AS name, CASE WHEN part % 19 = 2 THEN upper(e.folded) ELSE e.folded END AS folded, CASE WHEN part % 19 = 3 THEN 'pipe' ELSE e.kind END AS kind, part FROM e LEFT JOIN (SELECT volume, path, part FROM files) USING (volume, path)) SELECT volume, path, 'name' AS why FROM b WHERE part % 19 = 1 UNION ALL SELECT volume, path, 'fold' FROM b WHERE part % 19 = 1 OR part % 19 = 2 UNION ALL SELECT volume, path, 'kind' FROM b WHERE part % 19 = 3 UNION ALL SELECT volume, path, 'twice' FROM b WHERE part % 19 = 4 UNION ALL SELECT volume, path || '/q', 'orphan' FROM b WHERE part % 19 = 5")
def base_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.entries(spark, d).join(ns.files(spark, d).select("volume", "path", "part"), ["volume", "path"], "left")
    p = F.coalesce(F.col("part") % 19, F.lit(0))
    bad = rows.withColumn("name", F.when(p == 1, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    bad = bad.withColumn("folded", F.when(p == 2, F.upper("folded")).otherwise(F.col("folded"))).withColumn("kind", F.when(p == 3, "pipe").otherwise(F.col("kind")))
    below = rows.where(p == 5).select("volume", F.concat("path", F.lit("/q")).alias("path"), F.col("path").alias("parent"), F.lit("q").alias("name"), F.lit("q").alias("folded"), F.lit("file").alias("kind"), "part")
    return validate.violations(bad.unionByName(rows.where(p == 4)).unionByName(below))


@query("numbering_violations", "SELECT '' AS volume, 0::BIGINT AS ordinal, '' AS why WHERE false")
def numbering_violations(spark: SparkSession, d: str) -> DataFrame:
    """None: the numbers of a whole tree are sound."""
    return validate.numbering_violations(tree.preorder(ns.entries(spark, d)))


@query("overlay_limits", f"WITH {NS}, d AS (SELECT * FROM files WHERE part % 37 = 0), t AS (SELECT max(n) AS subtree FROM (SELECT count(*) AS n FROM files GROUP BY volume)) SELECT count(*)::BIGINT AS rows, sum(192 + 2 * strlen(path) + strlen(name) + strlen(folded))::BIGINT AS bytes, any_value(subtree)::BIGINT AS subtree, count(*) >= 500000 OR sum(192 + 2 * strlen(path) + strlen(name) + strlen(folded)) >= 134217728 AS full, any_value(subtree) > 100000 OR count(*) >= 500000 AS rebuild FROM d, t")
def overlay_limits(spark: SparkSession, d: str) -> DataFrame:
    """A delta of one file in 37, and a removal of each volume's top directory."""
    files = ns.files(spark, d)
    roots = files.select("volume", F.concat(F.lit("/"), "volume").alias("path")).distinct()
    return overlay.overflow(files.where("part % 37 = 0"), files, roots)


@query("event_scope", f"WITH {EV} SELECT id, path FROM ev WHERE (path = '/u1' OR starts_with(path, '/u1/') OR starts_with(path, '/u2/')) AND (NOT starts_with(path, '/u2/') OR starts_with(path, '/u2/')) AND (starts_with(path, '/u1/') OR path = '/u1') AND ((flags & {ev.LOST | ev.bits('must_scan', 'history_done', 'mount', 'unmount')}) <> 0 OR NOT (path = '/u1/k1' OR starts_with(path, '/u1/k1/')))")
def event_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.change_events(spark, d)
    return rows.where(ev.concerns(F.col("path"), F.col("flags"), "/u1", ["/u1/k1"])).select("id", "path")


@query("event_rooted", f"WITH {EV} SELECT id, CASE WHEN (flags & {ev.LOST | ev.FLAGS['history_done']}) <> 0 THEN '/mnt/a' ELSE '/mnt/a/' || substr(path, 2) END AS path FROM ev")
def event_rooted(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.change_events(spark, d)
    return rows.select("id", ev.rooted(F.expr("substring(path, 2)"), F.col("flags"), "/mnt/a").alias("path"))


@query("safe_folders", "SELECT o_orderkey AS id, sha256(f) AS key, NOT (f = '' OR starts_with(f, '/') OR contains(f, '//') OR ends_with(f, '/') OR f = '..' OR starts_with(f, '../') OR contains(f, '/../') OR contains(f, '/./')) AS safe FROM (SELECT o_orderkey, ['a/b', '/a', 'a//b', '', '..', 'a/../b', 'x/./y', 'index ' || o_orderkey, 'a/'][o_orderkey % 9 + 1] AS f FROM orders)")
def safe_folders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = F.element_at(F.array(*[F.lit(x) for x in ("a/b", "/a", "a//b", "", "..", "a/../b", "x/./y")], F.concat(F.lit("index "), k.cast("string")), F.lit("a/")), (k % 9 + 1).cast("int"))
    return ns.read(spark, d, "orders").select(k.alias("id"), storage.root_key(f).alias("key"), storage.safe_relative(f).alias("safe"))


@query("storage_health", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'offline' WHEN o_orderkey % 7 = 0 THEN 'identity_changed' WHEN o_orderkey % 5 = 0 THEN 'migrating' WHEN o_orderkey % 3 = 0 THEN 'read_only' WHEN o_orderkey % 100 < 20 THEN 'low_space' ELSE 'available' END AS state FROM orders")
def storage_health(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = storage.health(k % 11 != 0, k % 7 != 0, k % 3 == 0, k % 100, F.lit(20), k % 5 == 0)
    return ns.read(spark, d, "orders").select(k.alias("id"), state.alias("state"))


@query("uuid_round_trip", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE upper(substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)) END AS uuid FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders)")
def uuid_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    text = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("no uuid")).otherwise(text)
    return ns.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), storage.uuid_text(storage.uuid_bytes(text)).alias("uuid"))


@query("recovery_wait", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 8 THEN least(300, (2 ** (o_orderkey % 10)))::INT END AS seconds FROM orders")
def recovery_wait(spark: SparkSession, d: str) -> DataFrame:
    from canopy.streaming.live import recovery_wait as wait

    return ns.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), wait(F.col("o_orderkey") % 10).alias("seconds"))


@query("inbox_state", f"WITH {EV} SELECT count(*)::BIGINT AS events, max(id) AS cursor, count(*) > 500 AS overflow, bool_or((flags & {ev.FLAGS['history_done']}) <> 0) AS history_done FROM ev")
def inbox_state(spark: SparkSession, d: str) -> DataFrame:
    from canopy.streaming.live import inbox

    return inbox(ns.change_events(spark, d), 500)


@query("lookup_admission", f"WITH {EV}, r AS (SELECT id, path, row_number() OVER (ORDER BY id, path) <= 700 AS now FROM ev) SELECT id, path, now, min(CASE WHEN NOT now THEN id - 1 END) OVER () AS hold FROM r")
def lookup_admission(spark: SparkSession, d: str) -> DataFrame:
    from canopy.streaming.live import admitted

    return admitted(ns.change_events(spark, d).select("id", "path"), 700)


@query("live_stream", f"WITH {TREE} SELECT volume, path, kind, size, file_id FROM actual")
def live_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that tells of every folder with a change, followed twice: in the end the index is the tree as it is now."""
    from canopy.engine import Config, Engine
    from canopy.sources.work import work_dir
    from canopy.streaming import live

    base, actual, _ = trees(spark, d)
    root = work_dir(spark, "live")
    engine = Engine(spark, Config(f"{root}/index"))
    engine.load(base, 1000)
    files = base.where("kind <> 'directory'")
    told = lambda rows, at, flags, id_: rows.select("volume", id_.alias("id"), F.col(at).alias("path"), F.lit(flags).cast("long").alias("flags"))
    id_ = F.col("file_id") + 2000
    renamed = told(files.where("file_id % 2 = 0"), "path", ev.bits("renamed", "is_file"), id_)
    folders = files.where("file_id % 2 <> 0").groupBy("volume", "parent").agg(F.max(id_).alias("id"))
    every = work_dir(spark, "events")
    # Few files, so that all events are one micro-batch.
    renamed.unionByName(told(folders, "parent", ev.FLAGS["must_scan"], F.col("id"))).coalesce(12).write.option("compression", "zstd").parquet(every)

    def recover(e: Engine) -> None:  # more events than an inbox holds, at larger scales
        e.recover(lambda: actual, 10**15)

    for _ in range(2):
        live.follow(engine, every, f"{root}/checkpoint", lambda rows: actual, recover).awaitTermination()
    return engine._all_rows().select("volume", "path", "kind", "size", "file_id")


@query("stream_replay", f"WITH {EV}, c AS (SELECT path, bit_or(flags) AS flags, count(*) AS n FROM ev GROUP BY path) SELECT {CLASS_SQL} AS class, {IMPACT_SQL} AS impact, count(*)::BIGINT AS paths, sum(n)::BIGINT AS events FROM c GROUP BY ALL")
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    from canopy.sources.work import work_dir
    from canopy.streaming import pipeline

    root = work_dir(spark, "stream")
    ns.change_events(spark, d).repartition(4).write.parquet(f"{root}/in")
    for _ in range(2):  # the second run finds nothing new
        pipeline.run(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return pipeline.applied(spark, f"{root}/out").groupBy("class", "impact").agg(F.count("*").alias("paths"), F.sum("n").alias("events"))


@query("snapshot_roundtrip", f"WITH {NS}, live AS (SELECT volume, kind FROM files WHERE part % 50 <> 0 OR part % 37 = 0) SELECT volume, count(*)::BIGINT AS live, count_if(kind = 'file')::BIGINT AS files, count_if(kind = 'directory')::BIGINT AS directories, count_if(kind = 'symlink')::BIGINT AS symlinks FROM live GROUP BY volume")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from canopy.operators import stats
    from canopy.sources.store import SnapshotStore
    from canopy.sources.work import work_dir

    store = SnapshotStore(spark, work_dir(spark, "store"))
    base, gone, delta = layers(spark, d)
    store.publish(base, 10)
    store.compact(gone, delta, 20)
    return stats.index_stats(store.load())


@query("unicode_fold", f"WITH {NS} SELECT path, 'Straße-CAFÉ ' || name AS name, 'strasse-café ' || lower(name) AS folded FROM files")
def unicode_fold(spark: SparkSession, d: str) -> DataFrame:
    from canopy.functions.text import with_folded

    return with_folded(ns.files(spark, d).select("path", F.concat(F.lit("Straße-CAFÉ "), "name").alias("name")))


@query("idle_average", "SELECT user_id AS series, list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.6 + x * 0.4) AS average FROM events GROUP BY user_id")
def idle_average(spark: SparkSession, d: str) -> DataFrame:
    from canopy.operators import stats

    return stats.idle_average(ns.read(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("at"), "value"))


@query("lookup_child", f"WITH {NS}, q AS (SELECT min(path) AS p FROM files) SELECT volume, path, name FROM files, q WHERE path = p")
def lookup_child(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    one = rows.orderBy("path").select("volume", "parent", "name").first()
    return tree.lookup_child(rows, one.volume, one.parent, one.name).select("volume", "path", "name")
