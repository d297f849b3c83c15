"""Catalog queries: orders are builds of their customer, order lines are shards and fragments, parts are nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.tables import read
from plinth.plans.registration import query
from plinth.sources import catalog as C

_B = """b AS (SELECT o_orderkey AS build_id, o_custkey AS project, CASE WHEN o_orderstatus = 'P' THEN 'Building' ELSE 'Complete' END AS status FROM orders),
  s AS (SELECT DISTINCT l_orderkey AS build_id, l_suppkey AS shard_id, 'p' || l_suppkey % 50 AS path, 'h' || l_suppkey % 7 AS hash, l_suppkey * 10 AS bytes, CASE WHEN l_suppkey % 9 = 0 THEN 'Building' ELSE 'Complete' END AS status FROM lineitem),
  o AS (SELECT DISTINCT l_orderkey AS build_id, l_suppkey AS shard_id, l_partkey AS node_id FROM lineitem),
  fr AS (SELECT DISTINCT l_orderkey AS build_id, l_suppkey AS shard_id, l_partkey % 50 AS file, l_linenumber AS s, l_linenumber + 10 AS e, 'f' || l_suppkey % 3 AS fingerprint FROM lineitem),
  x AS (SELECT DISTINCT l_orderkey AS build_id, 1000000 + l_suppkey AS shard_id, l_partkey AS src, l_partkey + 1 AS dst FROM lineitem),
  nb AS (SELECT max(build_id) AS build_id, project FROM b WHERE status = 'Complete' GROUP BY project)"""


def _tables(spark, d):
    li = read(spark, d, "lineitem")
    k, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    build = F.col("l_orderkey").alias("build_id")
    builds = read(spark, d, "orders").select(F.col("o_orderkey").alias("build_id"), F.col("o_custkey").alias("project"), F.when(F.col("o_orderstatus") == "P", "Building").otherwise("Complete").alias("status"))
    shards = li.select(build, k.alias("shard_id"), F.concat(F.lit("p"), (k % 50).cast("string")).alias("path"), F.concat(F.lit("h"), (k % 7).cast("string")).alias("hash"), (k * 10).alias("bytes"), F.when(k % 9 == 0, "Building").otherwise("Complete").alias("status")).distinct()
    owned = li.select(build, k.alias("shard_id"), p.alias("node_id")).distinct()
    fragments = li.select(build, k.alias("shard_id"), (p % 50).alias("file"), n.alias("s"), (n + 10).alias("e"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("fingerprint")).distinct()
    boundary = li.select(build, (k + 1000000).alias("shard_id"), p.alias("src"), (p + 1).alias("dst")).distinct()
    return builds, shards, owned, fragments, boundary


@query(f"""WITH {_B}, lo AS (SELECT o.* FROM o JOIN nb USING (build_id)), t AS (SELECT x.build_id, x.shard_id, x.src AS node_id, x.dst AS other FROM x JOIN nb USING (build_id) UNION SELECT x.build_id, x.shard_id, x.dst, x.src FROM x JOIN nb USING (build_id))
  SELECT node_id, shard_id FROM lo WHERE node_id IN (SELECT p_partkey FROM part) UNION SELECT t.node_id, lo.shard_id FROM t JOIN lo ON lo.build_id = t.build_id AND lo.node_id = t.other WHERE t.node_id IN (SELECT p_partkey FROM part) UNION SELECT node_id, shard_id FROM t WHERE node_id IN (SELECT p_partkey FROM part)""")
def route_by_node(spark, d):
    builds, _, owned, _, boundary = _tables(spark, d)
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    return C.route_nodes(asked, builds, owned, boundary)


@query(f"WITH {_B} SELECT DISTINCT file, s, e, shard_id FROM fr JOIN nb USING (build_id)")
def route_by_span(spark, d):
    builds, _, _, fragments, _ = _tables(spark, d)
    return C.route_spans(fragments, builds, fragments)


@query(f"""WITH {_B}, h AS (SELECT fr.* FROM fr JOIN b USING (build_id) JOIN s ON s.build_id = fr.build_id AND s.shard_id = fr.shard_id WHERE b.status = 'Complete' AND s.status = 'Complete'),
  t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY file, s, e, fingerprint ORDER BY build_id DESC, shard_id) = 1),
  a AS (SELECT DISTINCT file, s, e, fingerprint || CASE WHEN file % 4 = 0 THEN 'x' ELSE '' END AS fingerprint FROM fr)
  SELECT a.file, a.s, a.e, a.fingerprint, t.shard_id FROM a LEFT JOIN t USING (file, s, e, fingerprint)""")
def reusable_fragments(spark, d):
    builds, shards, _, fragments, _ = _tables(spark, d)
    asked = fragments.select("file", "s", "e", F.concat("fingerprint", F.when(F.col("file") % 4 == 0, "x").otherwise("")).alias("fingerprint")).distinct()
    return C.reusable(asked, builds, shards, fragments)


@query(f"WITH {_B} SELECT build_id, count(*) AS shards, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM s WHERE status = 'Complete' GROUP BY 1")
def build_manifests(spark, d):
    return C.manifest(_tables(spark, d)[1])


@query(f"WITH {_B} SELECT path, hash, (count(*) FILTER (build_id % 3 <> 0) - count(*) FILTER (build_id % 3 = 0))::BIGINT AS refs FROM s GROUP BY 1, 2 HAVING count(*) FILTER (build_id % 3 <> 0) > count(*) FILTER (build_id % 3 = 0)")
def shard_reference_merge(spark, d):
    shards = _tables(spark, d)[1]
    known = shards.filter("build_id % 3 = 1").groupBy("path", "hash").agg(F.count(F.lit(1)).alias("refs"))
    return C.reference_counts(known, shards.filter("build_id % 3 = 2"), shards.filter("build_id % 3 = 0"))


@query("SELECT src_shard, src, dst, kind, (src // 64) || '-' || ((row_number() OVER (PARTITION BY src_shard, src // 64 ORDER BY src, kind, dst) - 1) // 64) AS batch FROM (SELECT DISTINCT l_suppkey % 4 AS src_shard, l_partkey AS src, l_orderkey AS dst, l_returnflag AS kind FROM lineitem)")
def boundary_batches(spark, d):
    edges = read(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("src_shard"), F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()
    return C.boundary_batches(edges, 64)


@query("SELECT event_type AS rule_id, min(user_id) AS rule_order, sum(event_id) ::BIGINT AS millis, sum(user_id)::BIGINT AS marks, max(user_id % 8) AS dop, count(*) AS runs FROM events GROUP BY 1")
def rule_telemetry(spark, d):
    u = F.col("user_id")
    return C.merged_telemetry(read(spark, d, "events").select(F.col("event_type").alias("rule_id"), u.alias("rule_order"), F.col("event_id").alias("millis"), u.alias("marks"), (u % 8).alias("dop")))


@query("SELECT user_id AS stream, sum(n)::BIGINT AS reads, CASE WHEN sum(k * 10) <= 1500 THEN count(*) END AS misses, sum(k * 10)::BIGINT AS distinct_bytes, sum(k * 10) <= 1500 AS fits FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def cache_needs(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return C.cache_trace(read(spark, d, "events").select(F.col("user_id").alias("stream"), k.alias("shard_id"), (k * 10).alias("bytes")), 1500)


@query()
def cache_replay(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return C.cache_replay(read(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("at"), k.alias("shard_id"), (k * 10).alias("bytes")), 1500)
