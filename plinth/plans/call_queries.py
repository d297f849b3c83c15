"""Call resolution over the star schema: parts are methods, their sizes types (size s derives from s / 2), order lines
are call sites whose quantity is the type of the receiver."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.tables import read
from plinth.operators import calls as C
from plinth.plans.registration import query

_M = """m AS (SELECT p_partkey AS method_id, 'M' || (p_partkey // 8) AS name, 'int(' || p_partkey % 2 || ')' AS signature, p_size AS type_id, 'T' || p_size AS type_name,
  p_partkey % 5 <> 0 AS internal, p_partkey AS original_id, CASE WHEN p_partkey % 8 >= 2 THEN p_partkey - 2 END AS overridden_id, p_partkey % 7 = 0 AS is_extension,
  CASE WHEN p_partkey % 3 = 0 THEN 'P' || (p_partkey // 8) END AS property FROM part)"""
_S = "s AS (SELECT l_orderkey AS ord, l_partkey AS target_id, CASE WHEN min(l_linenumber) > 1 THEN min(l_quantity)::INT END AS receiver_id, l_orderkey * 1000000 + l_partkey AS site FROM lineitem GROUP BY l_orderkey, l_partkey)"
_B = "b(sub, super) AS (SELECT x::INT, (x // 2)::INT FROM range(2, 51) t(x) UNION SELECT b.sub, (b.super // 2)::INT FROM b WHERE b.super > 1)"
_ALL = f"""WITH RECURSIVE {_M}, {_S}, {_B}, k AS (SELECT *, name || ':' || signature AS lookup_key, type_name || '.' || name || ':' || signature AS full_name FROM m),
  q AS (SELECT DISTINCT target_id, receiver_id FROM s),
  c AS (SELECT q.target_id, q.receiver_id, x.method_id FROM q JOIN k t ON t.method_id = q.target_id JOIN k x ON x.lookup_key = t.lookup_key
    AND (x.method_id = t.method_id OR x.internal OR EXISTS (SELECT 1 FROM b WHERE b.sub = q.receiver_id AND b.super = x.type_id))),
  z AS (SELECT c.*, x.full_name, x.internal, x.full_name = t.full_name AS exact,
    CASE WHEN x.internal THEN 1000 ELSE 0 END + CASE WHEN x.full_name = t.full_name THEN 500 ELSE 0 END + 250 + CASE WHEN x.original_id = t.original_id THEN 200 ELSE 0 END
    + CASE WHEN x.overridden_id = t.original_id THEN 150 ELSE 0 END + CASE WHEN x.property = t.property THEN 180 ELSE 0 END
    + CASE WHEN x.type_id = c.receiver_id THEN 120 + CASE WHEN x.property IS NOT NULL AND t.property IS NOT NULL THEN 90 ELSE 0 END ELSE 0 END
    + CASE WHEN u.super IS NOT NULL THEN 80 + CASE WHEN x.property IS NOT NULL AND t.property IS NOT NULL THEN 60 ELSE 0 END ELSE 0 END
    + CASE WHEN x.is_extension THEN 20 ELSE 0 END AS score
    FROM c JOIN k x ON x.method_id = c.method_id JOIN k t ON t.method_id = c.target_id LEFT JOIN b u ON u.sub = c.receiver_id AND u.super = x.type_id),
  w AS (SELECT *, CASE WHEN internal AND exact THEN 0 WHEN internal THEN 1 WHEN exact THEN 2 ELSE 3 END AS tier FROM z)"""


def _methods(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    group = F.floor(k / 8).cast("string")
    return read(spark, d, "part").select(
        k.alias("method_id"), F.concat(F.lit("M"), group).alias("name"), F.concat(F.lit("int("), (k % 2).cast("string"), F.lit(")")).alias("signature"), s.alias("type_id"),
        F.concat(F.lit("T"), s.cast("string")).alias("type_name"), (k % 5 != 0).alias("internal"), k.alias("original_id"), F.when(k % 8 >= 2, k - 2).alias("overridden_id"),
        (k % 7 == 0).alias("is_extension"), F.when(k % 3 == 0, F.concat(F.lit("P"), group)).alias("property"),
    )


def _bases(spark):
    """Strict ancestors in a tree of 50 types: t // 2, t // 4, ..., 1."""
    up = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.floor(F.col("sub") / F.pow(F.lit(2.0), i)).cast("int"))
    return spark.range(2, 51).select(F.col("id").cast("int").alias("sub")).select("sub", F.explode(F.filter(up, lambda x: x >= 1)).alias("super"))


def _sites(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.min("l_quantity").cast("int").alias("q"))
    return lines.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("site"), F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("target_id"), F.when(F.col("n") > 1, F.col("q")).alias("receiver_id"))


@query(f"{_ALL} SELECT * FROM c")
def call_candidates(spark, d):
    return C.candidates(C.requests(_sites(spark, d)), _methods(spark, d), _bases(spark)).select("target_id", "receiver_id", "method_id")


@query(f"{_ALL} SELECT * FROM z")
def call_target_scores(spark, d):
    m, b = _methods(spark, d), _bases(spark)
    return C.scored(C.candidates(C.requests(_sites(spark, d)), m, b), m, b)


@query(f"""{_ALL}, f AS (SELECT * FROM w QUALIFY tier = min(tier) OVER (PARTITION BY target_id, receiver_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY target_id, receiver_id ORDER BY score DESC, full_name, method_id) AS target_rank FROM f)
  SELECT s.site, r.method_id, r.tier, r.score, r.target_rank FROM s JOIN r ON r.target_id = s.target_id AND r.receiver_id IS NOT DISTINCT FROM s.receiver_id""")
def call_resolution(spark, d):
    return C.resolve(_sites(spark, d), _methods(spark, d), _bases(spark))


_KINDS = """k AS (SELECT p_partkey AS method_id, (CASE p_partkey % 3 WHEN 0 THEN 'get_' WHEN 1 THEN 'set_' ELSE 'do_' END) || p_partkey AS name, p_partkey % 5 <> 0 AS internal,
  p_size % 11 = 0 AS is_extension, p_size % 7 = 0 AS implements, p_size % 5 = 0 AS in_interface, p_size % 3 = 0 AS is_override, p_size % 13 = 1 AS is_abstract, p_size % 4 = 1 AS is_virtual, p_size % 17 = 2 AS is_static,
  CASE WHEN p_partkey % 2 = 0 THEN 'P' END AS property, p_partkey % 8 = 0 AS indexer FROM part)"""


@query(f"""WITH {_KINDS} SELECT method_id,
  CASE WHEN internal THEN 'internal' ELSE 'external' END || '-' || CASE WHEN is_extension THEN 'extension-static' WHEN implements THEN 'interface-implementation' WHEN in_interface THEN 'interface-definition'
    WHEN is_override THEN 'override-definition' WHEN is_abstract THEN 'abstract-definition' WHEN is_virtual THEN 'virtual-definition' WHEN is_static THEN 'static-definition' ELSE 'instance-definition' END AS definition,
  CASE WHEN internal THEN 'internal' ELSE 'external' END || '-' || CASE WHEN is_extension AND method_id % 9 <> 0 THEN 'extension-instance' WHEN is_extension THEN 'extension-static' WHEN implements THEN 'interface-implementation'
    WHEN method_id % 9 = 0 OR is_static THEN 'static' WHEN in_interface THEN 'interface-dispatch' WHEN is_override THEN 'override-dispatch' WHEN is_abstract OR is_virtual THEN 'virtual-dispatch' ELSE 'static' END
    || CASE WHEN property IS NULL THEN '' ELSE '-' || CASE WHEN indexer THEN 'indexer' ELSE 'property' END || '-' || CASE WHEN name LIKE 'get!_%' ESCAPE '!' THEN 'get' WHEN name LIKE 'set!_%' ESCAPE '!' THEN 'set' ELSE 'accessor' END END
    || '-' || CASE WHEN NOT internal THEN 'external-fallback' WHEN method_id % 4 = 1 THEN 'exact' WHEN method_id % 4 = 2 THEN 'receiver-exact' WHEN method_id % 4 = 3 THEN 'hierarchy' ELSE 'fallback' END AS call FROM k""")
def dispatch_kinds(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    verb = F.when(k % 3 == 0, "get_").when(k % 3 == 1, "set_").otherwise("do_")
    m = read(spark, d, "part").select(
        k.alias("method_id"), F.concat(verb, k.cast("string")).alias("name"), (k % 5 != 0).alias("internal"), (s % 11 == 0).alias("is_extension"), (s % 7 == 0).alias("implements"), (s % 5 == 0).alias("in_interface"),
        (s % 3 == 0).alias("is_override"), (s % 13 == 1).alias("is_abstract"), (s % 4 == 1).alias("is_virtual"), (s % 17 == 2).alias("is_static"), F.when(k % 2 == 0, "P").alias("property"), (k % 8 == 0).alias("indexer"),
    )
    i = F.col("method_id")
    found = C.resolution(F.col("internal"), i % 4 == 1, i % 4 == 2, i % 4 == 3)
    return m.select("method_id", C.definition_kind().alias("definition"), C.call_kind(i % 9 != 0, found).alias("call"))


# sites are orders; a method is a supplier with a parameter node (10 s) and a return node (10 s + 1); parts flow into parameters
_BR = """st AS (SELECT o_orderkey AS site FROM orders), tg AS (SELECT DISTINCT l_orderkey AS site, CASE WHEN l_suppkey % 10 <> 3 THEN l_suppkey END AS method, l_suppkey AS ord FROM lineitem),
  bo AS (SELECT s_suppkey * 10 AS node, s_suppkey AS method, 'MethodParameter' AS kind FROM supplier WHERE s_suppkey % 6 <> 0 UNION ALL SELECT s_suppkey * 10 + 1, s_suppkey, 'MethodReturn' FROM supplier WHERE s_suppkey % 6 <> 0),
  fl AS (SELECT DISTINCT 100000000 + l_partkey AS src, l_suppkey * 10 AS dst, l_partkey AS ord FROM lineitem WHERE l_partkey % 4 = 0 AND l_suppkey % 5 <> 0
    UNION SELECT l_suppkey * 10 + 1, l_orderkey, 200000000 + l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0
    UNION SELECT 300000000 + s_suppkey, s_suppkey * 10 + 1, 0 FROM supplier),
  n AS (SELECT site, count(DISTINCT coalesce(method, -1)) AS n FROM tg GROUP BY 1),
  t1 AS (SELECT site, method FROM tg QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) = 1),
  h AS (SELECT st.site, t1.method, CASE WHEN n.n IS NULL THEN 'UnresolvedTarget' WHEN n.n > 2 THEN 'AmbiguousTarget' WHEN t1.method IS NULL THEN 'UnresolvedTarget'
    WHEN t1.method NOT IN (SELECT method FROM bo) THEN 'ExternalTarget' END AS reason FROM st LEFT JOIN n USING (site) LEFT JOIN t1 USING (site)),
  op AS (SELECT site, method, site = min(site) OVER (PARTITION BY method) AS is_first FROM h WHERE reason IS NULL),
  pl AS (SELECT op.site, op.method, fl.src, fl.dst, 'ArgumentToParameter' AS bridge, 0 AS g, fl.ord FROM op JOIN fl ON fl.dst = op.method * 10 JOIN bo ON bo.node = fl.dst
    UNION ALL SELECT op.site, op.method, fl.src, fl.dst, 'MethodReturnToCallResult', 1, fl.ord FROM op JOIN fl ON fl.src = op.method * 10 + 1 AND fl.dst = op.site
    UNION ALL SELECT op.site, op.method, fl.src, fl.dst, 'ReturnToMethodReturn', 2, fl.ord FROM op JOIN fl ON fl.dst = op.method * 10 + 1 WHERE op.is_first),
  rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY g, ord, src, dst) AS r FROM pl)"""


def _bridges(spark, d):
    li, su = read(spark, d, "lineitem"), read(spark, d, "supplier")
    s = F.col("l_suppkey")
    sites = read(spark, d, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_orderkey").alias("ord"))
    targets = li.select(F.col("l_orderkey").alias("site"), F.when(s % 10 != 3, s).alias("method"), s.alias("ord")).distinct()
    inside = su.filter("s_suppkey % 6 <> 0")
    k = F.col("s_suppkey")
    boundary = inside.select((k * 10).alias("node"), k.alias("method"), F.lit("MethodParameter").alias("kind")).unionByName(inside.select((k * 10 + 1).alias("node"), k.alias("method"), F.lit("MethodReturn").alias("kind")))
    flows = (
        li.filter("l_partkey % 4 = 0 and l_suppkey % 5 <> 0").select((F.col("l_partkey") + 100000000).alias("src"), (s * 10).alias("dst"), F.col("l_partkey").alias("ord"))
        .unionByName(li.filter("l_orderkey % 3 = 0").select((s * 10 + 1).alias("src"), F.col("l_orderkey").alias("dst"), (F.col("l_orderkey") + 200000000).alias("ord")))
        .unionByName(su.select((k + 300000000).alias("src"), (k * 10 + 1).alias("dst"), F.lit(0).cast("long").alias("ord"))).distinct()
    )
    return C.bridges(sites, targets, boundary, flows, max_targets=2, max_edges=5)


@query(f"WITH {_BR} SELECT site, method, src, dst, bridge FROM rk WHERE r <= 5")
def bridge_edges(spark, d):
    return _bridges(spark, d)[0]


@query(f"""WITH {_BR}, c AS (SELECT site, reason FROM h WHERE reason IS NOT NULL UNION ALL SELECT op.site, CASE WHEN max(r) IS NULL THEN 'MissingIntraFacts' WHEN max(r) > 5 THEN 'BoundaryEdgeBudget' END FROM op LEFT JOIN rk USING (site) GROUP BY 1)
  SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY 1""")
def bridge_cut_reasons(spark, d):
    return _bridges(spark, d)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 'own' || p_size WHEN p_size % 2 = 0 THEN 'shared' ELSE 'Unknown' END AS summary
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey""")
def flow_summary_lookup(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct().join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    calls = li.select("*", F.concat(F.lit("a"), (F.col("l_suppkey") % 4).cast("string")).alias("assembly"), F.lit("T").alias("type"), F.lit("m").alias("method"), F.col("p_size").alias("arity"))
    sizes = spark.range(1, 51)
    key = lambda a: F.concat_ws("|", F.lit(a), F.lit("T"), F.lit("m"), F.col("id").cast("string"))
    project = sizes.select(key("a0").alias("key"), F.concat(F.lit("own"), F.col("id").cast("string")).alias("summary"))
    framework = None
    for a in range(4):
        rows = sizes.filter("id % 2 = 0").select(key(f"a{a}").alias("key"), F.lit("shared").alias("summary"))
        framework = rows if framework is None else framework.unionByName(rows)
    return C.flow_summaries(calls, project, framework).select("l_orderkey", "l_partkey", "l_suppkey", "summary")
