"""Registered queries: each operator over the driver's tables, with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import events as ev
from canopy.functions import paths, text
from canopy.operators import changes, overlay, stats, tree
from canopy.operators import search as s
from canopy.sources import namespace as ns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


NS = """x AS (SELECT l_suppkey, l_partkey, min(l_returnflag) AS flag, round(max(l_extendedprice) * 100)::BIGINT AS cents, max(l_shipdate) AS shipped FROM lineitem GROUP BY ALL),
ns AS (SELECT r_name AS volume, '/' || r_name || '/' || n_name || '/' || s_name AS parent, p_type || ' ' || p_name || ' ' || p_partkey || '.dat' AS name,
    CASE WHEN flag = 'N' THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN flag <> 'N' THEN cents END AS size, epoch(shipped)::BIGINT * 1000000000 AS mtime,
    l_suppkey * 10000000 + l_partkey AS file_id, l_partkey AS part
  FROM x JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT *, parent || '/' || name AS path, lower(name) AS folded FROM ns)"""
ENTRIES = (
    NS
    + """, dirs AS (SELECT DISTINCT volume, p AS path FROM files, LATERAL (SELECT unnest(['/', '/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3), parent]) AS p)),
e AS (SELECT volume, path, parent, name, folded, kind FROM files UNION ALL
  SELECT volume, path, CASE WHEN path = '/' OR length(path) - length(replace(path, '/', '')) = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END,
    CASE WHEN path = '/' THEN '/' ELSE regexp_extract(path, '[^/]*$') END, lower(CASE WHEN path = '/' THEN '/' ELSE regexp_extract(path, '[^/]*$') END), 'directory' FROM dirs)"""
)
HIT = ["pos", "volume", "path", "name", "kind", "size", "mtime", "match_rank"]
SQL_REST = "match_rank, folded, path, volume"
SQL_KEYS = {
    ("relevance", False): SQL_REST,
    ("name", False): "folded, name, path, volume",
    ("name", True): "folded DESC, name DESC, path, volume",
    **{(k, d): f"{k} {'DESC' if d else 'ASC'} NULLS LAST, {SQL_REST}" for k in ("size", "mtime") for d in (False, True)},
}


def search_sql(q: str, limit: int, sort: str = "relevance", desc: bool = False) -> str:
    keys = SQL_KEYS[sort, desc]
    return f"""WITH {NS}, m AS (SELECT *, CASE WHEN folded = '{q}' THEN 0 WHEN starts_with(folded, '{q}') THEN 1 ELSE 2 END::INT AS match_rank FROM files WHERE contains(folded, '{q}'))
SELECT row_number() OVER (ORDER BY {keys})::INT AS pos, volume, path, name, kind, size, mtime, match_rank FROM m ORDER BY {keys} LIMIT {limit}"""


def add_search(name: str, q: str, limit: int = 50, sort: str = "relevance", desc: bool = False) -> None:
    QUERIES[name] = lambda spark, d: s.search(ns.files(spark, d), s.Request(q, limit, sort, desc)).select(*HIT)
    ORACLES[name] = search_sql(text.fold_text(q), limit, sort, desc)


add_search("search_relevance", "Small")
for _sort, _desc in (("name", False), ("name", True), ("size", False), ("size", True), ("mtime", False), ("mtime", True)):
    add_search(f"search_{_sort}_{'desc' if _desc else 'asc'}", "econ", 50, _sort, _desc)
add_search("search_substring_1000", "bolt 1", 1000, "size", True)
add_search("search_prefix", "standard", 100)
add_search("search_one_char", "e", 250, "name", False)
add_search("search_no_result", "zzz-nothing")


@query("search_exact", f"WITH {NS}, q AS (SELECT min(folded) AS q FROM files) SELECT volume, path, CASE WHEN folded = q THEN 0 WHEN starts_with(folded, q) THEN 1 ELSE 2 END::INT AS match_rank FROM files, q WHERE contains(folded, q)")
def search_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    q = rows.agg(F.min("folded")).first()[0]
    return s.matches(rows, q or "").select("volume", "path", "match_rank")


@query("search_limit_has_more", f"WITH {NS}, m AS (SELECT count(*) AS n FROM files WHERE contains(folded, 'small')) SELECT l::INT AS page, n > l AS has_more FROM m, (SELECT unnest([1, 50, 100, 100000000]) AS l)")
def search_limit_has_more(spark: SparkSession, d: str) -> DataFrame:
    found = s.matches(ns.files(spark, d), "small").agg(F.count("*").alias("n"))
    return found.select(F.explode(F.array(*[F.lit(x) for x in (1, 50, 100, 100000000)])).alias("page"), "n").select("page", (F.col("n") > F.col("page")).alias("has_more"))


@query(
    "search_multivolume",
    f"""WITH {NS}, live AS (SELECT r_name AS volume, 'disk ' || r_regionkey AS display FROM region WHERE r_regionkey <> 3),
m AS (SELECT files.*, display, CASE WHEN folded = 'econ' THEN 0 WHEN starts_with(folded, 'econ') THEN 1 ELSE 2 END::INT AS match_rank FROM files JOIN live USING (volume) WHERE contains(folded, 'econ'))
SELECT row_number() OVER (ORDER BY {SQL_REST})::INT AS pos, volume, display, path, match_rank FROM m ORDER BY {SQL_REST} LIMIT 51""",
)
def search_multivolume(spark: SparkSession, d: str) -> DataFrame:
    volumes = ns.read(spark, d, "region").where("r_regionkey <> 3").select(F.col("r_name").alias("volume"), F.concat(F.lit("disk "), F.col("r_regionkey").cast("string")).alias("display"))
    rows = ns.files(spark, d).join(volumes, "volume")
    return s.search(rows, s.Request("econ", 51)).select("pos", "volume", "display", "path", "match_rank")


@query("per_volume_topk", f"WITH {NS}, m AS (SELECT *, CASE WHEN folded = 'small' THEN 0 WHEN starts_with(folded, 'small') THEN 1 ELSE 2 END::INT AS match_rank FROM files WHERE contains(folded, 'small')), r AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY size DESC NULLS LAST, {SQL_REST})::INT AS pos FROM m) SELECT volume, pos, path, size FROM r WHERE pos <= 20")
def per_volume_topk(spark: SparkSession, d: str) -> DataFrame:
    return s.per_volume_top(ns.files(spark, d), s.Request("small", 20, "size", True)).select("volume", "pos", "path", "size")


@query("match_rank_histogram", f"WITH {NS} SELECT volume, CASE WHEN folded = 'small' THEN 0 WHEN starts_with(folded, 'small') THEN 1 ELSE 2 END::INT AS match_rank, count(*)::BIGINT AS n FROM files WHERE contains(folded, 'small') GROUP BY ALL")
def match_rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    return s.matches(ns.files(spark, d), "small").groupBy("volume", "match_rank").agg(F.count("*").alias("n"))


@query("point_lookup", f"WITH {NS}, p AS (SELECT max(path) AS p FROM files) SELECT volume, path, kind, size, mtime FROM files, p WHERE path = p")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    wanted = rows.agg(F.max("path")).first()[0]
    odd = "/." + wanted.replace("/", "//") + "/x/.." if wanted else ""  # normalized before the look-up
    asked = spark.range(1).select(paths.normalize(F.lit(odd)).alias("path"))
    return rows.join(asked, "path", "left_semi").select("volume", "path", "kind", "size", "mtime")


@query("dedup_hits", f"WITH {NS}, t AS (SELECT volume, path, size FROM files UNION ALL SELECT volume, path, size + 1 FROM files WHERE part % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY volume, path ORDER BY size DESC NULLS LAST) AS n FROM t) SELECT volume, path, size FROM r WHERE n = 1")
def dedup_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    twice = rows.unionByName(rows.where("part % 3 = 0").withColumn("size", F.col("size") + 1)).withColumn("match_rank", F.lit(2))
    return s.first_by_place(twice, s.Request("x", 1, "size", True)).select("volume", "path", "size")


# ---------------------------------------------------------------- statistics


@query("index_stats", f"WITH {ENTRIES} SELECT volume, count(*)::BIGINT AS live, count_if(kind = 'file')::BIGINT AS files, count_if(kind = 'directory')::BIGINT AS directories, count_if(kind = 'symlink')::BIGINT AS symlinks FROM e GROUP BY volume")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.index_stats(ns.entries(spark, d))


@query("layout_stats", f"WITH {ENTRIES} SELECT volume, count_if(name = folded)::BIGINT AS same_rows, sum(CASE WHEN name = folded THEN strlen(name) ELSE 0 END)::BIGINT AS same_bytes, sum(strlen(name))::BIGINT AS name_bytes, sum(strlen(folded))::BIGINT AS folded_bytes FROM e GROUP BY volume")
def layout_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.layout_stats(ns.entries(spark, d))


@query("latency_percentiles", "SELECT event_type, min(value) AS least, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(ns.read(spark, d, "events"), "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, ["event_type"])


STATES = "CASE r_regionkey WHEN 0 THEN 'live' WHEN 1 THEN 'live' WHEN 2 THEN 'catching_up' WHEN 3 THEN 'offline' ELSE 'failed' END"


@query("volume_rollup", f"SELECT count_if(s = 'live')::BIGINT AS searched, count_if(s = 'catching_up')::BIGINT AS catching_up, count_if(s = 'offline')::BIGINT AS offline, coalesce(string_agg(v, ',' ORDER BY v) FILTER (s = 'failed'), '') AS failed, bool_and(r_regionkey <> 3) AS metadata_complete FROM (SELECT r_name AS v, r_regionkey, {STATES} AS s FROM region)")
def volume_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = ns.read(spark, d, "region").select(F.col("r_name").alias("volume"), F.expr(STATES).alias("state"), F.expr("r_regionkey <> 3").alias("metadata_complete"))
    return stats.volume_rollup(v)


@query("read_failures", "SELECT n_name AS volume, count(*)::BIGINT AS total, count_if(s_suppkey % 3 = 0)::BIGINT AS permission, count_if(s_suppkey % 2 = 0)::BIGINT AS dataless, greatest(0, count(*) - count_if(s_suppkey % 3 = 0) - count_if(s_suppkey % 2 = 0))::BIGINT AS other FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY n_name")
def read_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.read(spark, d, "supplier").join(ns.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = rows.select(F.col("n_name").alias("volume"), F.expr("n_regionkey = 2").alias("offline"), F.lit(1).cast("long").alias("total"), F.expr("CAST(s_suppkey % 3 = 0 AS BIGINT)").alias("permission"), F.expr("CAST(s_suppkey % 2 = 0 AS BIGINT)").alias("dataless"))
    return stats.read_failures(one)


@query(
    "backlog_monotonic",
    """WITH e AS (SELECT user_id AS series, event_id AS "at", floor(value)::BIGINT AS value FROM events),
s AS (SELECT *, coalesce(value >= lag(value) OVER (PARTITION BY series ORDER BY "at"), true) AS up FROM e)
SELECT series, "at", ((count(*) OVER l) = 4) AND (bool_and(up) OVER i) AND value > (first_value(value) OVER l) AS growing FROM s
WINDOW l AS (PARTITION BY series ORDER BY "at" ROWS 3 PRECEDING), i AS (PARTITION BY series ORDER BY "at" ROWS 2 PRECEDING)""",
)
def backlog_monotonic(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.read(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("at"), F.floor("value").cast("long").alias("value"))
    return stats.growing_backlog(rows, 4).select("series", "at", "growing")


@query(
    "quiet_gate",
    """WITH e AS (SELECT user_id AS series, floor(epoch(ts))::BIGINT AS "at", event_type, CASE WHEN event_type = 'view' THEN 0 ELSE event_id END AS g FROM events),
f AS (SELECT series, "at", max(g) AS g, bool_or(event_type = 'error') AS blocked FROM e GROUP BY ALL),
s AS (SELECT *, CASE WHEN coalesce(g <> lag(g) OVER (PARTITION BY series ORDER BY "at"), true) OR blocked THEN "at" END AS since FROM f)
SELECT series, "at", "at" - max(since) OVER (PARTITION BY series ORDER BY "at" ROWS UNBOUNDED PRECEDING) >= 30 AS quiet FROM s""",
)
def quiet_gate(spark: SparkSession, d: str) -> DataFrame:
    e = ns.read(spark, d, "events").select(F.col("user_id").alias("series"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.expr("CASE WHEN event_type = 'view' THEN 0 ELSE event_id END").alias("generation"), F.expr("event_type = 'error'").alias("blocked"))
    return stats.quiet(e.groupBy("series", "at").agg(F.max("generation").alias("generation"), F.bool_or("blocked").alias("blocked"))).select("series", "at", "quiet")


@query("maintenance_order", "SELECT c_custkey AS job, row_number() OVER (ORDER BY c_nationkey % 3 DESC, c_nationkey DESC, c_custkey)::INT AS place FROM customer")
def maintenance_order(spark: SparkSession, d: str) -> DataFrame:
    jobs = ns.read(spark, d, "customer").select(F.col("c_custkey").alias("job"), F.expr("c_nationkey % 3").alias("urgency"), F.col("c_nationkey").alias("priority"), F.col("c_custkey").alias("arrival"))
    return stats.maintenance_order(jobs).select("job", "place")


@query("table_digest")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return stats.table_digest(ns.entries(spark, d))


@query("page_digest")
def page_digest(spark: SparkSession, d: str) -> DataFrame:
    return stats.page_digest(s.search(ns.files(spark, d), s.Request("small", 50, "size")))


# ---------------------------------------------------------------- paths and trees

DOTTED = "'//' || volume || '/./' || 'x/../' || split_part(path, '/', 3) || '//' || name || CASE WHEN part % 5 = 0 THEN '/..' WHEN part % 7 = 0 THEN '/' ELSE '' END"


@query("path_normalize", f"WITH {NS} SELECT DISTINCT '/' || volume || '/' || split_part(path, '/', 3) || CASE WHEN part % 5 = 0 THEN '' ELSE '/' || name END AS path FROM files")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    odd = F.expr(DOTTED)
    return ns.files(spark, d).select(paths.normalize(odd).alias("path")).distinct()


@query("parent_basename", f"WITH {ENTRIES} SELECT DISTINCT path, parent, name AS base FROM e")
def parent_basename(spark: SparkSession, d: str) -> DataFrame:
    p = ns.entries(spark, d).select("path").distinct()
    return p.select("path", paths.parent(F.col("path")).alias("parent"), paths.basename(F.col("path")).alias("base"))


@query("is_within", f"WITH {ENTRIES}, r AS (SELECT '/' || r_name || '/' || n_name AS root FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0) SELECT root, count(*)::BIGINT AS n FROM e JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY root")
def is_within(spark: SparkSession, d: str) -> DataFrame:
    roots = ns.read(spark, d, "nation").where("n_nationkey % 4 = 0").join(ns.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("root"))
    up = ns.entries(spark, d).select(F.explode(paths.ancestors(F.col("path"), proper=False)).alias("root"))
    return up.join(roots, "root").groupBy("root").agg(F.count("*").alias("n"))


ROOTS = "SELECT path FROM e WHERE strlen(path) % 11 = 0 OR path LIKE '%7'"


@query("minimal_roots", f"WITH {ENTRIES}, r AS (SELECT DISTINCT path FROM ({ROOTS})) SELECT path FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.path <> a.path AND (b.path = '/' OR b.path = regexp_replace(a.path, '/[^/]*$', '') OR b.path = regexp_replace(a.path, '/[^/]*/[^/]*$', '') OR b.path = regexp_replace(a.path, '/[^/]*/[^/]*/[^/]*$', '')))")
def minimal_roots(spark: SparkSession, d: str) -> DataFrame:
    return tree.minimal_roots(ns.entries(spark, d).where("octet_length(path) % 11 = 0 OR path LIKE '%7'"))


@query("excluded_roots", f"WITH {ENTRIES} SELECT volume, count(*)::BIGINT AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 = 1 AND (path = '/' || r_name || '/' || n_name OR starts_with(path, '/' || r_name || '/' || n_name || '/'))) GROUP BY volume")
def excluded_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = ns.read(spark, d, "nation").where("n_nationkey % 6 = 1").join(ns.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("root"))
    return tree.outside(ns.entries(spark, d), roots).groupBy("volume").agg(F.count("*").alias("n"))


@query("nearest_ancestor", f"WITH {ENTRIES}, k AS (SELECT '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 UNION SELECT '/' || r_name FROM region WHERE r_regionkey < 3) SELECT DISTINCT e.path, coalesce(a.path, b.path) AS nearest FROM e LEFT JOIN k a ON a.path = '/' || split_part(e.path, '/', 2) || '/' || split_part(e.path, '/', 3) AND a.path <> e.path LEFT JOIN k b ON b.path = '/' || split_part(e.path, '/', 2) AND b.path <> e.path")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    place = ns.read(spark, d, "nation").join(ns.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = place.where("n_nationkey % 3 = 0").select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    known = known.unionByName(ns.read(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("/"), "r_name").alias("path")))
    return tree.nearest_ancestor(ns.entries(spark, d), known)


@query("children_of", f"WITH {ENTRIES} SELECT volume, path, kind FROM e WHERE volume = 'ASIA' AND parent = '/ASIA' AND path <> '/ASIA'")
def children_of(spark: SparkSession, d: str) -> DataFrame:
    return tree.children_of(ns.entries(spark, d), "ASIA", "/ASIA").select("volume", "path", "kind")


@query("subtree_of", f"WITH {ENTRIES} SELECT volume, path, kind FROM e WHERE path = '/EUROPE' OR starts_with(path, '/EUROPE/')")
def subtree_of(spark: SparkSession, d: str) -> DataFrame:
    return tree.subtree_of(ns.entries(spark, d), "/EUROPE").select("volume", "path", "kind")


@query("directory_map", f"WITH {ENTRIES} SELECT volume, path FROM e WHERE kind = 'directory'")
def directory_map(spark: SparkSession, d: str) -> DataFrame:
    return ns.entries(spark, d).where("kind = 'directory'").select("volume", "path")


@query("child_counts", f"WITH {ENTRIES} SELECT volume, parent, count(*)::BIGINT AS children FROM e WHERE path <> parent GROUP BY ALL")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    return tree.child_counts(ns.entries(spark, d))


PREORDER = f"""WITH {ENTRIES}, k AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda y: y <> ''), lambda y: lower(y) || chr(1) || y) AS k FROM e),
o AS (SELECT volume, path, parent, name, row_number() OVER (PARTITION BY volume ORDER BY k) - 1 AS ordinal FROM k),
b AS (SELECT volume, path, count(*) AS n FROM (SELECT volume, unnest(list_distinct(['/', '/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3), parent])) AS path, path AS own FROM e) WHERE path <> own AND length(path) < length(own) GROUP BY ALL),
c AS (SELECT volume, parent AS path, count(*) AS n FROM e WHERE path <> parent GROUP BY ALL)"""


@query("preorder_numbering", PREORDER + " SELECT volume, path, ordinal::BIGINT AS ordinal, (ordinal + 1 + coalesce(b.n, 0))::BIGINT AS subtree_end, coalesce(c.n, 0)::BIGINT AS child_count FROM o LEFT JOIN b USING (volume, path) LEFT JOIN c USING (volume, path)")
def preorder_numbering(spark: SparkSession, d: str) -> DataFrame:
    return tree.preorder(ns.entries(spark, d)).select("volume", "path", "ordinal", "subtree_end", "child_count")


@query("path_reconstruction", PREORDER + " SELECT volume, ordinal::BIGINT AS id, path FROM o")
def path_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    rows = tree.preorder(ns.entries(spark, d)).select("volume", "path", "parent", "name", F.col("ordinal").alias("id"))
    up = rows.select("volume", F.col("path").alias("parent"), F.col("id").alias("parent_id"))
    return tree.reconstruct(rows.join(up, ["volume", "parent"]).select("volume", "id", "parent_id", "name"))


@query("with_parents", f"WITH {ENTRIES} SELECT volume, path, CASE WHEN kind = 'directory' THEN kind ELSE kind END AS kind FROM e")
def with_parents(spark: SparkSession, d: str) -> DataFrame:
    return tree.with_parents(ns.files(spark, d))


@query("resolvable", f"WITH {ENTRIES}, t AS (SELECT volume, CASE WHEN part % 2 = 0 THEN path ELSE path || '/below' END AS path FROM files) SELECT t.volume, t.path FROM t WHERE path NOT LIKE '%/below'")
def resolvable(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    below = rows.select("volume", F.concat("path", F.lit("/below")).alias("path"), F.lit("file").alias("kind"), "part")
    entries = ns.entries(spark, d).select("volume", "path", "kind").unionByName(below.drop("part"))
    asked = rows.where("part % 2 = 0").select("volume", "path").unionByName(below.where("part % 2 = 1").select("volume", "path"))
    return tree.resolvable(entries, asked)


# ---------------------------------------------------------------- overlay

LAYERS = NS + ", tomb AS (SELECT volume, path FROM files WHERE part % 50 = 0), delta AS (SELECT volume, path, parent, name, folded, kind, size + 1 AS size, mtime FROM files WHERE part % 37 = 0), live AS (SELECT volume, path, parent, name, folded, kind, size, mtime FROM files f WHERE part % 50 <> 0 AND part % 37 <> 0 UNION ALL SELECT * FROM delta)"
COLS = ["volume", "path", "parent", "name", "folded", "kind", "size", "mtime"]


def layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = ns.files(spark, d)
    return rows.select(*COLS), rows.where("part % 50 = 0").select("volume", "path"), rows.where("part % 37 = 0").withColumn("size", F.col("size") + 1).select(*COLS)


@query("overlay_merge", f"WITH {LAYERS} SELECT volume, path, kind, size, mtime FROM live")
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    return overlay.merged(*layers(spark, d)).select("volume", "path", "kind", "size", "mtime")


@query("overlay_search", f"WITH {LAYERS}, m AS (SELECT *, CASE WHEN folded = 'small' THEN 0 WHEN starts_with(folded, 'small') THEN 1 ELSE 2 END::INT AS match_rank FROM live WHERE contains(folded, 'small')) SELECT row_number() OVER (ORDER BY size DESC NULLS LAST, {SQL_REST})::INT AS pos, volume, path, size, match_rank FROM m ORDER BY size DESC NULLS LAST, {SQL_REST} LIMIT 60")
def overlay_search(spark: SparkSession, d: str) -> DataFrame:
    return s.search(overlay.merged(*layers(spark, d)), s.Request("small", 60, "size")).select("pos", "volume", "path", "size", "match_rank")


@query("tombstone_subtree", f"WITH {ENTRIES} SELECT volume, path FROM e WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 2 AND (path = '/' || r_name || '/' || n_name OR starts_with(path, '/' || r_name || '/' || n_name || '/')))")
def tombstone_subtree(spark: SparkSession, d: str) -> DataFrame:
    gone = ns.read(spark, d, "nation").where("n_nationkey % 5 = 2").join(ns.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("volume"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    return overlay.subtree_tombstones(ns.entries(spark, d), gone).select("volume", "path")


@query("apply_mutations", f"WITH {ENTRIES}, gone AS (SELECT '/' || r_name || '/' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 2), turned AS (SELECT '/' || r_name || '/' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 3) SELECT volume, path, kind FROM e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE path = p OR starts_with(path, p || '/')) AND NOT EXISTS (SELECT 1 FROM turned WHERE path = p OR starts_with(path, p || '/')) UNION ALL SELECT split_part(p, '/', 2), p, 'file' FROM turned")
def apply_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Some directories are removed, some turn into files, one upsert lacks its parent."""
    base = ns.entries(spark, d).select("volume", "path", "kind").withColumn("file_id", F.xxhash64("path"))
    place = ns.read(spark, d, "nation").join(ns.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")
    row = lambda where, op, kind, seq, p=path: place.where(where).select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), F.col("r_name").alias("volume"), p.alias("path"), F.lit(kind).alias("kind"), F.lit(7).cast("long").alias("file_id"))
    batch = row("n_nationkey % 5 = 2", "upsert", "file", 1).unionByName(row("n_nationkey % 5 = 2", "remove", "directory", 2)).unionByName(row("n_nationkey % 5 = 3", "upsert", "file", 1)).unionByName(row("n_nationkey = 0", "upsert", "file", 1, F.concat(path, F.lit("/none/x"))))
    return overlay.apply_mutations(base, batch).live.select("volume", "path", "kind")


@query("directory_replace", "SELECT r_name AS volume, '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def directory_replace(spark: SparkSession, d: str) -> DataFrame:
    place = ns.read(spark, d, "nation").join(ns.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("volume"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), F.lit("directory").alias("kind"), F.col("n_nationkey").cast("long").alias("file_id"))
    new = place.withColumn("file_id", F.when(F.col("file_id") % 4 == 0, F.col("file_id") + 100).otherwise(F.col("file_id"))).withColumn("kind", F.expr("CASE WHEN file_id % 4 = 2 THEN 'file' ELSE kind END"))
    return overlay.replaced_directories(place, new)


DIFF = NS + ", o AS (SELECT file_id AS pos, path, kind FROM files), n AS (SELECT file_id + 1 AS pos, path, CASE WHEN part % 11 = 0 THEN 'other' ELSE kind END AS kind FROM files WHERE part % 7 <> 0)"


@query("dir_diff", f"WITH {DIFF} SELECT 'remove' AS op, pos, path, kind FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT 'upsert', n.pos, n.path, n.kind FROM n LEFT JOIN o USING (path) WHERE n.kind IS DISTINCT FROM o.kind")
def dir_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    old = rows.select(F.col("file_id").alias("pos"), "path", "kind")
    new = rows.where("part % 7 <> 0").select((F.col("file_id") + 1).alias("pos"), "path", F.expr("CASE WHEN part % 11 = 0 THEN 'other' ELSE kind END").alias("kind"))
    return overlay.ordered_diff(old, new, ["kind"])


def truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = ns.files(spark, d)
    return rows.where("part % 13 <> 0").select("volume", "path"), rows.where("part % 17 <> 0").select("volume", "path")


@query("verify_missing_extra", f"WITH {NS} SELECT volume, path, CASE WHEN part % 17 = 0 THEN 'missing' ELSE 'extra' END AS class FROM files WHERE (part % 13 = 0) <> (part % 17 = 0)")
def verify_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    return overlay.verify(*truth(spark, d))


@query("verify_revalidated", f"""WITH {NS} SELECT volume, path, CASE WHEN part % 3 = 0 THEN CASE WHEN part % 17 = 0 THEN 'missing' ELSE 'extra' END
  WHEN (part % 3 = 1) = (part % 17 <> 0) THEN 'raced' WHEN part % 3 = 1 THEN 'missing' ELSE 'extra' END AS class FROM files WHERE (part % 13 = 0) <> (part % 17 = 0)""")
def verify_revalidated(spark: SparkSession, d: str) -> DataFrame:
    actual, index = truth(spark, d)
    probes = ns.files(spark, d).where("part % 3 <> 0").select("volume", "path", F.expr("CASE WHEN part % 3 = 1 THEN 'present' ELSE 'absent' END").alias("state"))
    return overlay.revalidated(overlay.verify(actual, index), probes, index)


@query("metadata_overlay", f"WITH {NS} SELECT volume, path, CASE WHEN part % 50 = 0 THEN NULL WHEN part % 37 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN part % 50 = 0 THEN NULL ELSE mtime END AS mtime FROM files")
def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    base, gone, delta = layers(spark, d)
    return overlay.layered_metadata(base.select("volume", "path"), base, delta, gone)


@query("metadata_join", f"WITH {NS} SELECT volume, path, size, mtime FROM files")
def metadata_join(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    return rows.select("volume", "path", "file_id").join(rows.select("volume", "file_id", "size", "mtime"), ["volume", "file_id"], "left").drop("file_id")


@query("rename_alias", f"WITH {NS}, m AS (SELECT volume, '/' || volume || '/moved' AS new_root, '/' || volume AS old_root FROM region, LATERAL (SELECT r_name AS volume)) SELECT f.volume, new_root || substr(path, length(old_root) + 1) AS path, size, mtime FROM files f JOIN m USING (volume)")
def rename_alias(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d)
    tops = ns.read(spark, d, "region").select(F.col("r_name").alias("volume"), F.concat(F.lit("/"), "r_name", F.lit("/moved")).alias("new_root"), F.concat(F.lit("/"), "r_name").alias("old_root"))
    wrong = tops.withColumn("new_root", F.col("old_root")).withColumn("old_root", F.lit("/nowhere"))  # shorter, so it doesn't count
    asked = rows.select("volume", F.expr("'/' || volume || '/moved' || substr(path, length(volume) + 2)").alias("path"))
    none = rows.limit(0)
    return overlay.layered_metadata(asked, rows, none, none, tops.unionByName(wrong))


@query("rename_pairing", f"WITH {NS} SELECT 1::BIGINT AS device_id, file_id, path AS old_path, path || '.new' AS new_path FROM files WHERE part % 9 = 0")
def rename_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d).withColumn("device_id", F.lit(1).cast("long"))
    return overlay.rename_pairs(rows.where("part % 3 = 0"), rows.where("part % 9 = 0 OR part % 3 = 1").withColumn("path", F.concat("path", F.lit(".new"))))


@query("dup_name_last_wins", f"WITH {NS}, t AS (SELECT volume, parent, name, kind, file_id AS arrival FROM files UNION ALL SELECT volume, parent, name, 'other', file_id + 1 FROM files WHERE part % 4 = 0) SELECT volume, parent, name, arg_max(kind, arrival) AS kind, max(arrival) AS arrival FROM t GROUP BY ALL".replace("GROUP BY ALL)", "GROUP BY ALL)"))
def dup_name_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.files(spark, d).select("volume", "parent", "name", "kind", F.col("file_id").alias("arrival"))
    again = ns.files(spark, d).where("part % 4 = 0").select("volume", "parent", "name", F.lit("other").alias("kind"), (F.col("file_id") + 1).alias("arrival"))
    return overlay.dup_names_last_wins(rows.unionByName(again))


@query("last_mutation", "SELECT 'v' AS volume, '/u' || user_id AS path, arg_max(event_type, event_id) AS op, max(event_id) AS seq FROM events GROUP BY user_id")
def last_mutation(spark: SparkSession, d: str) -> DataFrame:
    rows = ns.read(spark, d, "events").select(F.lit("v").alias("volume"), F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"))
    return overlay.last_per_path(rows).select("volume", "path", "op", "seq")


@query("compaction_trigger", "SELECT o_orderkey AS id, ((d >= 50000 OR b >= 67108864 OR x >= 50000 OR (n > 0 AND ((x > 0 AND x * 20 >= n) OR (d > 0 AND d * 20 >= n)))) AND q >= 2) OR b >= 134217728 AS due FROM (SELECT o_orderkey, o_orderkey * 7 AS d, o_orderkey * 9973 AS b, o_orderkey % 977 AS x, o_custkey * 1000 AS n, o_orderkey % 5 AS q FROM orders)")
def compaction_trigger(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = ns.read(spark, d, "orders").select(o.alias("id"), (o * 7).alias("delta_rows"), (o * 9973).alias("delta_bytes"), (o % 977).alias("dead_rows"), (F.col("o_custkey") * 1000).alias("base_rows"), (o % 5).alias("quiet_seconds"))
    return overlay.compaction_due(rows).select("id", "due")


@query("checked_ns", "SELECT o_orderkey AS id, CASE WHEN ns BETWEEN 0 AND 999999999 AND s::HUGEINT * 1000000000 + ns BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT AND s::HUGEINT * 1000000000 BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT THEN (s::HUGEINT * 1000000000 + ns)::BIGINT END AS ns FROM (SELECT o_orderkey, (o_orderkey - 500) * 7000000 AS s, o_orderkey * 1000000 - 5000000 AS ns FROM orders)")
def checked_ns(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return ns.read(spark, d, "orders").select(o.alias("id"), text.unix_nanos((o - 500) * 7000000, o * 1000000 - 5000000).alias("ns"))


@query("storage_space", "SELECT o_orderkey AS id, o_orderkey * 1000000 + greatest(268435456, (o_orderkey * 1000000 + 9) // 10) AS bytes FROM orders")
def storage_space(spark: SparkSession, d: str) -> DataFrame:
    return ns.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.required_space(F.col("o_orderkey") * 1000000).alias("bytes"))


@query("backoff", "SELECT o_orderkey AS id, least(30, (2 ** least(o_orderkey % 12, 8)))::INT AS seconds FROM orders")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return ns.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.backoff_seconds(F.col("o_orderkey") % 12).alias("seconds"))


# ---------------------------------------------------------------- events

EV = "ev AS (SELECT event_id AS id, '/u' || user_id || '/k' || json_extract_string(props, '$.k') AS path, ((CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ns.EVENT_FLAGS.items()) + " ELSE 0 END) | (CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN {v}" for m, v in ((97, ev.FLAGS["must_scan"]), (89, ev.FLAGS["created"]), (83, ev.FLAGS["is_dir"]), (79, ev.KNOWN + 1), (73, ev.FLAGS["kernel_dropped"]), (71, ev.FLAGS["history_done"]))) + " ELSE 0 END))::BIGINT AS flags FROM events)"


def _any(mask: int, f: str = "flags") -> str:
    return f"({f} & {mask}) <> 0"


_ONE = f"bit_count((flags & {ev.TYPES})::INT) = 1"
_BOTH = ev.bits("created", "removed")
_UNKNOWN = f"flags > {ev.KNOWN}"
CLASS_SQL = f"""CASE WHEN {_any(ev.LOST)} THEN 'invalidated' WHEN {_any(ev.FLAGS["must_scan"])} THEN 'subtree_dirty' WHEN {_any(ev.FLAGS["history_done"])} THEN 'history_done'
WHEN {_any(ev.bits("mount", "unmount"))} OR {_any(ev.FLAGS["renamed"])} OR (flags & {_BOTH}) = {_BOTH} OR {_UNKNOWN} THEN 'ambiguous' WHEN {_any(ev.FLAGS["removed"])} THEN 'simple_remove'
WHEN {_any(ev.FLAGS["created"])} THEN CASE WHEN {_ONE} THEN 'simple_create:' || CASE WHEN {_any(ev.FLAGS["is_file"])} THEN 'file' WHEN {_any(ev.FLAGS["is_dir"])} THEN 'directory' ELSE 'symlink' END ELSE 'ambiguous' END
WHEN {_any(ev.CONTENT)} AND {_ONE} THEN 'content_only' ELSE 'ambiguous' END"""
IMPACT_SQL = f"""CASE WHEN {_any(ev.LOST | ev.bits("mount", "unmount"))} THEN 'invalidated' WHEN {_any(ev.FLAGS["must_scan"])} THEN 'reconcile_parent'
WHEN {_any(ev.FLAGS["history_done"])} THEN 'none' WHEN {_UNKNOWN} THEN 'reconcile_parent' WHEN (flags & {_BOTH}) = {_BOTH} THEN 'reconcile_parent' WHEN {_any(ev.FLAGS["removed"])} THEN 'remove'
WHEN {_any(ev.bits("created", "renamed", "modified", "inode_meta"))} THEN CASE WHEN {_any(ev.bits("is_dir", "is_symlink"))} THEN 'refresh_time' ELSE 'refresh_size_and_time' END
WHEN {_any(ev.bits("xattr", "finder_info", "owner", "own_event", "hardlink", "last_hardlink", "cloned"))} AND NOT {_any(ev.TYPES)} THEN 'reconcile_parent' ELSE 'none' END"""
ORDINARY_SQL = f"(({CLASS_SQL}) IN ('simple_create:file', 'simple_create:directory', 'simple_create:symlink', 'simple_remove', 'content_only') OR ({_any(ev.FLAGS['renamed'])} AND (flags - (flags & {ev.FLAGS['renamed'] | ev.TYPES})) = 0))"


@query("event_classify", f"WITH {EV} SELECT id, {CLASS_SQL} AS class FROM ev")
def event_classify(spark: SparkSession, d: str) -> DataFrame:
    return ns.change_events(spark, d).select("id", ev.classify(F.col("flags")).alias("class"))


@query("event_impact", f"WITH {EV} SELECT id, {IMPACT_SQL} AS impact FROM ev")
def event_impact(spark: SparkSession, d: str) -> DataFrame:
    return ns.change_events(spark, d).select("id", ev.impact(F.col("flags")).alias("impact"))


@query("replay_floor", f"WITH {EV} SELECT id, path, flags FROM ev WHERE NOT ({ORDINARY_SQL} AND id > 0 AND id <= 5000)")
def replay_floor(spark: SparkSession, d: str) -> DataFrame:
    return changes.after_floor(ns.change_events(spark, d), 5000).select("id", "path", "flags")


@query("event_coalesce", f"WITH {EV} SELECT path, bit_or(flags) AS flags, max(id) AS id, count(*)::BIGINT AS n FROM ev GROUP BY path")
def event_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return changes.coalesced(ns.change_events(spark, d))


@query("create_remove_conflict", f"WITH {EV} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent FROM ev GROUP BY path HAVING bit_or(flags & {_BOTH}) = {_BOTH}")
def create_remove_conflict(spark: SparkSession, d: str) -> DataFrame:
    return changes.conflicting(ns.change_events(spark, d))


@query("storm_parents", f"WITH {EV} SELECT regexp_replace(path, '/[^/]*$', '') AS parent, count(DISTINCT path)::BIGINT AS children, count(DISTINCT path) >= 8 AS collapse FROM ev GROUP BY 1")
def storm_parents(spark: SparkSession, d: str) -> DataFrame:
    return changes.dirty_parents(ns.change_events(spark, d), 8)


@query("event_cursor", f"WITH {EV} SELECT max(id) FILTER (id > 0 AND id < 9223372036854775807) AS cursor FROM ev")
def event_cursor(spark: SparkSession, d: str) -> DataFrame:
    return changes.next_cursor(ns.change_events(spark, d))


@query("batch_scopes", f"WITH {EV}, c AS (SELECT *, {CLASS_SQL} AS class, regexp_replace(path, '/[^/]*$', '') AS parent FROM ev), s AS (SELECT DISTINCT path AS root FROM c WHERE class = 'subtree_dirty'), a AS (SELECT root FROM s UNION SELECT parent FROM c WHERE class = 'ambiguous' OR class LIKE 'simple_%') SELECT root, root IN (SELECT root FROM s) AS subtree FROM a WHERE length(root) - length(replace(root, '/', '')) = 1 OR regexp_replace(root, '/[^/]*$', '') NOT IN (SELECT root FROM a)")
def batch_scopes(spark: SparkSession, d: str) -> DataFrame:
    """More than 256 names change at once, so every parent is dirty."""
    return changes.plan_batch(ns.change_events(spark, d), storm=1)["scopes"].select("root", "subtree")


@query("failure_policy", "SELECT event_id AS id, CASE WHEN e = 'ECANCELED' THEN 'cancelled' WHEN e IN ('EACCES', 'EPERM', 'ENODATA') THEN 'preserve' WHEN event_id % 5 = 0 THEN 'rebuild' WHEN e IN ('ENOENT', 'ENOTDIR', 'ELOOP', 'EXDEV') THEN 'retry_parent' ELSE 'rebuild' END AS action FROM (SELECT event_id, ['ECANCELED', 'EACCES', 'EPERM', 'ENODATA', 'ENOENT', 'ENOTDIR', 'ELOOP', 'EXDEV', 'EIO'][event_id % 9 + 1] AS e FROM events)")
def failure_policy(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in "ECANCELED EACCES EPERM ENODATA ENOENT ENOTDIR ELOOP EXDEV EIO".split()])
    e = F.col("event_id")
    return ns.read(spark, d, "events").select(e.alias("id"), ev.failure_policy(F.element_at(names, (e % 9 + 1).cast("int")), e % 5 == 0).alias("action"))
