"""Queries of the passes and checks: facts made from the star schema, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions.tables import read
from plinth.operators import checks as C
from plinth.operators import passes as P
from plinth.plans.code_queries import _PARTS, operations
from plinth.plans.lowering import G_SQL, graph
from plinth.plans.registration import query

_OPS = f"""ev AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pl FROM events),
  pt(event_type, m, j, pj, kind, role) AS (VALUES {', '.join(map(str, _PARTS))}),
  ops AS (SELECT user_id AS method_id, event_id * 20 + j AS op_id, CASE WHEN pj < 0 THEN user_id + 1000000000 ELSE event_id * 20 + pj END AS parent_id, CASE kind WHEN 'If' THEN 'Conditional' WHEN 'While' THEN 'Loop' ELSE kind END AS kind, role, pl * 20 + j AS pos
    FROM ev JOIN pt USING (event_type) WHERE event_id % m = 0 UNION ALL SELECT DISTINCT user_id, user_id + 1000000000, NULL, 'Block', 'root', 0 FROM ev)"""


def _ops(spark, d):
    return operations(spark, d)[0].withColumn("kind", F.when(F.col("kind") == "If", "Conditional").when(F.col("kind") == "While", "Loop").otherwise(F.col("kind")))


def _text(prefix: str, *parts):
    return F.concat(F.lit(prefix), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""WITH {_OPS} SELECT p.op_id AS src, c.op_id AS dst, CASE WHEN p.kind = 'Conditional' AND c.role = 'condition' THEN 'OpCondition' WHEN p.kind = 'Conditional' AND c.role = 'true' THEN 'OpWhenTrue'
  WHEN p.kind = 'Conditional' AND c.role = 'false' THEN 'OpWhenFalse' WHEN p.kind = 'Loop' AND c.role = 'body' THEN 'OpBody' ELSE 'OpChild' END AS kind FROM ops c JOIN ops p ON p.op_id = c.parent_id""")
def operation_tree_edges(spark, d):
    return P.operation_edges(_ops(spark, d))


@query(f"""WITH {_OPS} SELECT parent_id AS src, op_id AS dst, 'SyntaxChild' AS kind FROM ops WHERE parent_id IS NOT NULL UNION SELECT op_id, op_id * 100, 'TokenChild' FROM ops WHERE kind = 'Expr'
  UNION SELECT op_id, op_id % 100, 'DeclaresSymbol' FROM ops WHERE op_id % 3 = 0 UNION SELECT op_id, op_id % 100, 'ReferencesSymbol' FROM ops WHERE op_id % 3 = 1 UNION SELECT op_id, op_id % 7, 'HasType' FROM ops WHERE kind = 'Expr'""")
def syntax_pass_edges(spark, d):
    ops = _ops(spark, d)
    tree = ops.select(F.col("op_id").alias("node"), F.col("parent_id").alias("parent"), "kind")
    expr = tree.filter("kind = 'Expr'")
    named = lambda k: tree.filter(F.col("node") % 3 == k).select("node", (F.col("node") % 100).alias("symbol"))
    return P.syntax_edges(tree, expr.select("node", (F.col("node") * 100).alias("token")), named(0), named(1), expr.select("node", (F.col("node") % 7).alias("type")))


_M = "m AS (SELECT s_suppkey AS method, s_name AS name, 'N' || s_nationkey || '.' || s_name AS full_name, CASE WHEN s_suppkey % 4 > 0 THEN 'T' || s_nationkey END AS returns, s_suppkey * 100 AS s, s_suppkey * 100 + 50 AS e FROM supplier), pa AS (SELECT method, full_name, o AS ordinal, 'p' || o AS name, 'T' || o AS type, s + o AS s, s + o + 1 AS e FROM m, (VALUES (0), (1)) v(o) WHERE o < method % 3)"


def _methods(spark, d):
    k = F.col("s_suppkey").cast("long")
    full = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.lit("."), "s_name")
    methods = read(spark, d, "supplier").select(k.alias("method"), F.col("s_name").alias("name"), full.alias("full_name"), F.when(k % 4 > 0, F.concat(F.lit("T"), F.col("s_nationkey").cast("string"))).alias("returns"), (k * 100).alias("start"), (k * 100 + 50).alias("end"))
    params = methods.withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1)))).filter(F.col("ordinal") < F.col("method") % 3)
    o = F.col("ordinal").cast("string")
    return methods, params.select("method", "ordinal", F.concat(F.lit("p"), o).alias("name"), F.concat(F.lit("T"), o).alias("type"), (F.col("start") + F.col("ordinal")).alias("start"), (F.col("start") + F.col("ordinal") + 1).alias("end"))


@query(f"""WITH {_M} SELECT 'method:' || method AS key, 'Method' AS kind, name, full_name, s AS start, e AS end FROM m UNION ALL SELECT 'methodreturn:' || method, 'MethodReturn', name || ':return', full_name || ':return', e, e FROM m WHERE returns IS NOT NULL
  UNION ALL SELECT 'methodentry:' || method, 'MethodEntry', name || ':entry', full_name || ':entry', s, s FROM m UNION ALL SELECT 'methodexit:' || method, 'MethodExit', name || ':exit', full_name || ':exit', e, e FROM m
  UNION ALL SELECT 'methodparam:' || method || ':' || ordinal, 'MethodParameter', name, full_name || '#' || ordinal || ':' || name, s, e FROM pa""")
def method_boundary_nodes(spark, d):
    return P.method_nodes(*_methods(spark, d))


@query(f"""WITH {_M}, x AS (SELECT *, CAST(method AS VARCHAR) AS t FROM m) SELECT 'syntax:' || t AS src, 'method:' || t AS dst, 'SyntaxChild' AS kind FROM x UNION SELECT 'method:' || t, 'symbol:' || t, 'DeclaresSymbol' FROM x
  UNION SELECT 'method:' || t, 'methodentry:' || t, 'SyntaxChild' FROM x UNION SELECT 'method:' || t, 'methodexit:' || t, 'SyntaxChild' FROM x
  UNION SELECT 'method:' || t, 'type:' || returns, k FROM x, (VALUES ('ReturnsType'), ('EvalType')) v(k) WHERE returns IS NOT NULL UNION SELECT 'method:' || t, 'methodreturn:' || t, 'ParameterLink' FROM x WHERE returns IS NOT NULL
  UNION SELECT 'methodreturn:' || t, 'type:' || returns, 'EvalType' FROM x WHERE returns IS NOT NULL
  UNION SELECT 'method:' || method, 'methodparam:' || method || ':' || ordinal, 'ParameterLink' FROM pa UNION SELECT 'methodparam:' || method || ':' || ordinal, 'symbol:' || method || ':' || ordinal, 'Ref' FROM pa
  UNION SELECT 'methodparam:' || method || ':' || ordinal, 'type:' || type, 'EvalType' FROM pa""")
def method_boundary_edges(spark, d):
    return P.method_edges(*_methods(spark, d))


# an order is an invocation with its lines as arguments; a return, an assignment or a declaration takes its value
_INV = """w AS (SELECT o_orderkey * 10 AS inv, o_orderkey * 10 + 9 - o_orderkey % 3 AS taker, o_orderkey % 3 AS r, o_custkey AS m, 5000000000 + o_custkey * 10 AS ret FROM orders)"""


def _invocations(spark, d):
    k, r = F.col("o_orderkey").cast("long"), F.col("o_orderkey") % 3
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("method_id"), (k * 10).alias("inv"), (k * 10 + 9 - r).alias("taker"), r.alias("r"))
    none = F.lit(None).cast("long")
    lines = read(spark, d, "lineitem").select((-(F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber"))).alias("op_id"), (F.col("l_orderkey").cast("long") * 10).alias("inv")).distinct()
    ops = (
        o.select("method_id", F.col("taker").alias("op_id"), none.alias("parent_id"), F.when(F.col("r") == 0, "Return").when(F.col("r") == 1, "SimpleAssignment").otherwise("VariableDeclarator").alias("kind"), F.lit("statement").alias("role"))
        .unionByName(o.select("method_id", F.col("inv").alias("op_id"), F.col("taker").alias("parent_id"), F.lit("Invocation").alias("kind"), F.when(F.col("r") == 2, "initializer").otherwise("value").alias("role")))
        .unionByName(lines.join(o.select("method_id", "inv"), "inv").select("method_id", "op_id", F.col("inv").alias("parent_id"), F.lit("Argument").alias("kind"), F.lit("argument").alias("role")))
    )
    base = F.col("method_id") * 10 + 5000000000
    return ops, o.select("method_id").distinct().select("method_id", base.alias("ret"), (base + 1).alias("exit"))


@query(f"WITH {_INV} SELECT inv AS src, taker AS dst, 'DataFlow' AS kind FROM w UNION SELECT -(l_orderkey * 10 + l_linenumber), l_orderkey * 10, 'DataFlow' FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def value_source_flow(spark, d):
    return P.value_source_flow(_invocations(spark, d)[0])


@query(f"WITH {_INV} SELECT inv AS src, ret AS dst, 'DataFlow' AS kind FROM w WHERE r = 0 UNION SELECT ret, ret + 1, 'DataFlow' FROM w WHERE r = 0 UNION SELECT taker, ret + 1, 'DataFlow' FROM w WHERE r = 0")
def return_value_flow(spark, d):
    return P.return_flow(*_invocations(spark, d))


# methods of even users have their returns taken out
@query(f"""WITH {_OPS}, o2 AS (SELECT * FROM ops WHERE kind <> 'Return' OR method_id % 2 = 1) SELECT l.op_id AS src, 2000000000 + l.method_id * 10 + 1 AS dst, 'DataFlow' AS kind FROM (SELECT method_id, max_by(op_id, pos) AS op_id, max_by(kind, pos) AS kind FROM o2 WHERE parent_id >= 1000000000 AND parent_id < 2000000000 AND parent_id = method_id + 1000000000 GROUP BY 1) l
  WHERE kind NOT IN ('Return', 'Throw', 'Branch', 'Break', 'Continue') AND method_id NOT IN (SELECT method_id FROM o2 WHERE kind = 'Return')""")
def terminal_flow(spark, d):
    return P.terminal_flow(_ops(spark, d).filter("kind <> 'Return' or method_id % 2 = 1"), operations(spark, d)[1])


_CALL = """c AS (SELECT o_orderkey AS call, 'c' || o_orderkey AS site, o_custkey % 97 AS method, o_custkey % 2 = 0 AS ext, CASE WHEN o_orderkey % 3 > 0 THEN 'i' || o_orderkey END AS inst, 'r' || (o_custkey % 97) AS ret FROM orders),
  a AS (SELECT DISTINCT l_orderkey AS call, l_linenumber - 1 AS ord, 'a' || l_orderkey || ':' || l_linenumber AS value FROM lineitem WHERE l_linenumber % 5 > 0),
  p AS (SELECT DISTINCT method, o AS ord, 'p' || method || ':' || o AS node FROM c, (VALUES (0), (1), (2), (3)) v(o) WHERE o <= method % 4),
  t AS (SELECT value AS src, node AS dst FROM c JOIN a USING (call) JOIN p ON p.method = c.method AND p.ord = a.ord + CASE WHEN ext AND inst IS NOT NULL THEN 1 ELSE 0 END UNION SELECT inst, node FROM c JOIN p ON p.method = c.method AND p.ord = 0 WHERE ext AND inst IS NOT NULL)"""


@query(f"WITH {_CALL} SELECT src, dst, k AS kind FROM t, (VALUES ('ParameterLink'), ('DataFlow')) v(k) UNION SELECT ret, site, 'DataFlow' FROM c")
def argument_flow(spark, d):
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 97
    calls = read(spark, d, "orders").select(k.alias("call"), _text("c", k).alias("site"), m.alias("method"), (F.col("o_custkey") % 2 == 0).alias("extension"), F.when(k % 3 > 0, _text("i", k)).alias("instance"), _text("r", m).alias("ret"))
    n = F.col("l_linenumber")
    args = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("call"), (n - 1).cast("int").alias("ordinal"), F.when(n % 5 > 0, F.concat(_text("a", "l_orderkey"), F.lit(":"), n.cast("string"))).alias("value"))
    params = calls.select("method").distinct().withColumn("ordinal", F.explode(F.sequence(F.lit(0), (F.col("method") % 4).cast("int"))))
    return P.argument_flow(calls, args, params.select("method", "ordinal", F.concat(_text("p", "method"), F.lit(":"), F.col("ordinal").cast("string")).alias("node")))


_ACC = """r AS (SELECT 'f' || event_id AS ref, user_id % 13 AS p, CASE WHEN event_id % 2 = 0 THEN 'i' || event_id END AS inst, CASE WHEN event_type = 'purchase' THEN 'v' || event_id END AS value,
    CASE WHEN event_id % 3 = 0 THEN 'g' || event_id END AS gs, CASE WHEN event_id % 5 = 0 THEN 's' || event_id END AS ss, CASE WHEN event_id % 4 = 0 THEN 'x' || event_id END AS arg FROM events),
  b AS (SELECT ref, inst, value, arg, role, CASE WHEN role = 'get' THEN gs ELSE ss END AS site, role || p AS method, 'ret' || p AS ret, CASE WHEN inst IS NULL THEN 0 ELSE 1 END AS first, CASE WHEN role = 'get' THEN p % 2 ELSE p % 4 END AS top FROM r, (VALUES ('get'), ('set')) v(role) WHERE role = 'get' OR value IS NOT NULL),
  z AS (SELECT method, 0 AS ord, inst AS src, top, NULL AS site FROM b WHERE inst IS NOT NULL UNION ALL SELECT method, first, arg, top, NULL FROM b WHERE arg IS NOT NULL UNION ALL SELECT method, first + CASE WHEN arg IS NULL THEN 0 ELSE 1 END, value, top, site FROM b WHERE role = 'set'),
  q AS (SELECT src, 'p' || method || ':' || ord AS dst, site FROM z WHERE ord <= top)"""


@query(f"""WITH {_ACC} SELECT src, dst, k AS kind FROM q, (VALUES ('ParameterLink'), ('DataFlow')) v(k) UNION SELECT src, site, 'DataFlow' FROM q WHERE site IS NOT NULL UNION SELECT ret, ref, 'DataFlow' FROM b WHERE role = 'get'
  UNION SELECT ret, site, 'DataFlow' FROM b WHERE role = 'get' AND site IS NOT NULL UNION SELECT site, ref, 'DataFlow' FROM b WHERE site IS NOT NULL UNION SELECT value, ref, 'DataFlow' FROM b WHERE role = 'set'""")
def accessor_flow(spark, d):
    e, p = F.col("event_id"), F.col("user_id") % 13
    ev = read(spark, d, "events")
    some = lambda test, prefix: F.when(test, _text(prefix, e))
    refs = ev.select(_text("f", e).alias("ref"), p.alias("property"), some(e % 2 == 0, "i").alias("instance"), some(F.col("event_type") == "purchase", "v").alias("value"), some(e % 3 == 0, "g").alias("get_site"), some(e % 5 == 0, "s").alias("set_site"))
    args = ev.filter(e % 4 == 0).select(_text("f", e).alias("call"), F.lit(0).alias("ordinal"), _text("x", e).alias("value"))
    accessors = refs.select("property").distinct().withColumn("role", F.explode(F.array(F.lit("get"), F.lit("set"))))
    accessors = accessors.select("property", "role", F.concat("role", F.col("property").cast("string")).alias("method"), _text("ret", "property").alias("ret"))
    top = F.when(F.col("role") == "get", F.col("property") % 2).otherwise(F.col("property") % 4).cast("int")
    params = accessors.select("method", F.explode(F.sequence(F.lit(0), top)).alias("ordinal"))
    return P.accessor_flow(refs, args, accessors, params.select("method", "ordinal", F.concat(_text("p", "method"), F.lit(":"), F.col("ordinal").cast("string")).alias("node")))


@query("""SELECT l_orderkey * 10 + l_linenumber AS op, p_partkey AS member, 'T' || CASE WHEN p_partkey % 9 >= l_suppkey % 7 AND (p_partkey % 9 - l_suppkey % 7) % 3 = 0 THEN l_suppkey % 7 ELSE p_partkey % 9 END || '.' || p_name || CASE WHEN p_size % 10 = 0 THEN ':int' ELSE '' END AS full_name
  FROM lineitem JOIN part ON p_partkey = l_partkey""")
def member_access_names(spark, d):
    accesses = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op"), F.col("l_partkey").alias("member"), _text("T", F.col("l_suppkey") % 7).alias("receiver"))
    k = F.col("p_partkey")
    members = read(spark, d, "part").select(k.alias("member"), F.col("p_name").alias("name"), _text("T", k % 9).alias("owner"), F.when(F.col("p_size") % 10 == 0, "int").alias("signature"))
    above = spark.createDataFrame([(f"T{a}", f"T{b}") for a in range(7) for b in range(9) if b > a and (b - a) % 3 == 0], "a string, b string")
    return P.member_accesses(accesses, members, above)


# blocks of six events: of even users each is a closed loop that nothing enters
_LOOP = """o AS (SELECT event_id AS id, user_id AS u, row_number() OVER w AS i, lead(event_id) OVER w AS n, lag(event_id, 5) OVER w AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  f AS (SELECT id AS src, n AS dst FROM o WHERE i % 6 > 0 AND n IS NOT NULL UNION SELECT id, back FROM o WHERE i % 6 = 0 AND u % 2 = 0)"""


@query(f"WITH RECURSIVE {_LOOP}, r(id) AS (SELECT id FROM o WHERE id NOT IN (SELECT dst FROM f) UNION SELECT f.dst FROM r JOIN f ON f.src = r.id) SELECT u AS scope, count(*) FILTER (id NOT IN (SELECT id FROM r)) AS unreachable FROM o GROUP BY 1")
def unreachable_flow_nodes(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    o = read(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("i"), F.lead("event_id").over(w).alias("n"), F.lag("event_id", 5).over(w).alias("back"))
    flow = o.filter("i % 6 > 0 and n is not null").select(F.col("event_id").alias("src"), F.col("n").alias("dst")).unionByName(o.filter("i % 6 = 0 and user_id % 2 = 0").select(F.col("event_id").alias("src"), F.col("back").alias("dst")))
    return P.unreachable_flow(o.select(F.col("user_id").alias("scope"), F.col("event_id").alias("node_id")), flow)


_NEAR = f"{G_SQL}, b(id, depth) AS (SELECT node_id, 0 FROM n WHERE kind = 'region' UNION SELECT e.src, b.depth + 1 FROM b JOIN e ON e.dst = b.id WHERE b.depth < 2), near AS (SELECT DISTINCT id FROM b)"


@query(f"{_NEAR} SELECT e.src, e.dst, e.kind FROM e JOIN near ON near.id = e.dst WHERE e.src % 5 > 0 AND e.dst % 5 > 0")
def stored_slice_edges(spark, d):
    g = graph(spark, d)
    return P.frontier_projection(g.edges, g.nodes.filter("node_id % 5 > 0").select("node_id", (F.col("node_id") % 8).alias("shard")), g.of_kind("region"), 2)[0].select("src", "dst", "kind")


@query(f"{_NEAR} SELECT id AS node_id, 'anchorUnavailable' AS reason FROM near WHERE id % 5 = 0")
def stored_slice_unavailable(spark, d):
    g = graph(spark, d)
    return P.frontier_projection(g.edges, g.nodes.filter("node_id % 5 > 0").select("node_id", (F.col("node_id") % 8).alias("shard")), g.of_kind("region"), 2)[1]


@query("""WITH x AS (SELECT n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT n_name, n_nationkey + 100 FROM nation WHERE n_regionkey = 1), a AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)
  SELECT a.name, CASE WHEN count(x.id) = 1 THEN min(x.id) END AS node_id, CASE WHEN count(x.id) = 0 THEN 'missing' WHEN count(x.id) > 1 THEN 'ambiguous' END AS problem FROM a LEFT JOIN x USING (name) GROUP BY 1""")
def anchor_names(spark, d):
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("node_id"), "n_regionkey")
    nodes = n.select("name", "node_id").unionByName(n.filter("n_regionkey = 1").select("name", (F.col("node_id") + 100).cast(dict(n.dtypes)["node_id"]).alias("node_id")))
    return C.resolve_anchors(nodes, n.select("name").unionByName(read(spark, d, "region").select(F.col("r_name").alias("name"))))


_ALLOWED = [("R0", "click"), ("R0", "view"), ("R1", "view"), ("R2", "purchase"), ("R3", "error"), ("R4", "click")]


@query(f"WITH a(rule_id, kind) AS (VALUES {', '.join(map(str, _ALLOWED))}) SELECT event_id, 'R' || (user_id % 5) AS rule_id, event_type AS kind FROM events WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.rule_id = 'R' || (user_id % 5) AND a.kind = event_type)")
def disallowed_marks(spark, d):
    marks = read(spark, d, "events").select("event_id", _text("R", F.col("user_id") % 5).alias("rule_id"), F.col("event_type").alias("kind"))
    return C.disallowed(marks, spark.createDataFrame(_ALLOWED, "rule_id string, kind string")).select("event_id", "rule_id", "kind")


@query("""SELECT DISTINCT l_orderkey, l_linenumber, t.name AS target FROM lineitem, (VALUES ('R'), ('AIR'), ('7')) t(name) WHERE l_returnflag = t.name OR l_linestatus = t.name OR (l_suppkey % 10)::VARCHAR = t.name""")
def target_matches(spark, d):
    facts = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("identifier"), F.col("l_linestatus").alias("symbol"), (F.col("l_suppkey") % 10).cast("string").alias("root"))
    return C.match_targets(facts, spark.createDataFrame([("R",), ("AIR",), ("7",)], "name string")).select("l_orderkey", "l_linenumber", "target").distinct()


@query("SELECT c_custkey AS symbol, s_suppkey AS method FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 50 = s_suppkey % 50 AND c_custkey % 7 = s_suppkey % 7")
def same_location(spark, d):
    place = lambda t, k, n, name: read(spark, d, t).select(F.col(k).alias(name), F.col(n).alias("file"), (F.col(k) % 50).alias("start"), (F.col(k) % 7).alias("end"))
    return C.same_location(place("customer", "c_custkey", "c_nationkey", "symbol"), place("supplier", "s_suppkey", "s_nationkey", "method"))


@query("""SELECT o_custkey AS id, ord, o_orderkey, event_id FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey FROM orders) JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord, event_id FROM events) e USING (ord) WHERE user_id = o_custkey""")
def zipped_lists(spark, d):
    numbered = lambda t, g, k: read(spark, d, t).select(F.col(g).alias("id"), F.row_number().over(Window.partitionBy(g).orderBy(k)).cast("long").alias("ord"), k)
    return C.zipped(numbered("orders", "o_custkey", "o_orderkey"), numbered("events", "user_id", "event_id"), "id")


_ORDER = "src, CASE kind WHEN 'InNation' THEN 0 WHEN 'InRegion' THEN 1 ELSE 2 END, dst"


@query(f"{G_SQL} SELECT src, dst, kind, row_number() OVER (ORDER BY {_ORDER}, CASE WHEN src % 3 = 0 THEN 'l' || dst % 5 END NULLS FIRST, kind) AS position FROM e")
def canonical_edge_order(spark, d):
    e = graph(spark, d).edges
    none = F.lit(None).cast("string")
    kind_order = F.when(F.col("kind") == "InNation", 0).when(F.col("kind") == "InRegion", 1).otherwise(2)
    label = F.when(F.col("src") % 3 == 0, _text("l", F.col("dst") % 5))
    rows = e.select("src", "dst", "kind", kind_order.alias("kind_order"), label.alias("label"), none.alias("context"), F.col("kind").alias("file"), F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("display"))
    return C.canonical_edges(rows).select("src", "dst", "kind", "position")


@query("SELECT 'f' || (user_id % 11) AS file, event_id AS node_id, row_number() OVER (ORDER BY 'f' || (user_id % 11), event_id % 97, event_id % 13, event_id) AS position FROM events WHERE event_id % 10 > 0")
def file_index_order(spark, d):
    e = F.col("event_id")
    nodes = read(spark, d, "events").select(_text("f", F.col("user_id") % 11).alias("file"), F.when(e % 10 > 0, e % 97).alias("start"), (e % 13).alias("end"), e.alias("node_id"))
    return C.file_index(nodes)


@query(f"""{G_SQL}, x AS (SELECT 'node' AS part, 'first' AS side, count(*) AS n FROM n WHERE node_id % 100 = 0 UNION ALL SELECT 'edge', 'first', count(*) FROM e WHERE src % 50 = 0 UNION ALL SELECT 'edge', 'second', count(*) FROM e WHERE src % 50 = 0) SELECT * FROM x WHERE n > 0""")
def graph_comparison(spark, d):
    g = graph(spark, d)
    nodes, edges = g.nodes.select("node_id", "kind"), g.edges.select("src", "dst", "kind")
    other = nodes.filter("node_id % 100 > 0"), edges.withColumn("kind", F.when(F.col("src") % 50 == 0, F.lit("Changed")).otherwise(F.col("kind")))
    return C.graph_differences((nodes, edges), other).groupBy("part", "side").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT user_id, 'f' || (user_id % 7) || '|' || event_type || '|' || (event_id % 9) AS key FROM events WHERE event_id % 4 > 0 AND event_type <> 'click') SELECT key FROM x WHERE user_id % 2 = 1 EXCEPT SELECT key FROM x WHERE user_id % 2 = 0 AND user_id % 3 = 0""")
def new_errors(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select("user_id", _text("f", F.col("user_id") % 7).alias("path"), F.col("event_type").alias("id"), F.when(e % 4 > 0, "Error").otherwise("Warning").alias("severity"), (e % 9).cast("string").alias("message"))
    return C.new_errors(rows.filter("user_id % 2 = 0 and user_id % 3 = 0"), rows.filter("user_id % 2 = 1"), ["click"])


@query(f"WITH {_OPS} SELECT method_id + 1000000000 AS root, count(*) AS nodes, count(*) FILTER (kind = 'Expr') AS expressions, count(*) FILTER (kind <> 'Expr') AS statements FROM ops GROUP BY 1")
def region_facts(spark, d):
    ops = _ops(spark, d)
    closure = ops.filter("parent_id is not null").select((F.col("method_id") + 1000000000).alias("root"), F.col("op_id").alias("node_id"))
    return C.region_facts(closure, ops.select(F.col("op_id").alias("node_id"), F.when(F.col("kind") == "Expr", "expression").otherwise("statement").alias("family")))


@query("""SELECT p_partkey, CASE WHEN h = 0 THEN 1 ELSE h END AS id FROM (SELECT p_partkey, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS h FROM part)""")
def decision_ids(spark, d):
    return read(spark, d, "part").select("p_partkey", C.fnv1a32(F.col("p_name")).alias("id"))


@query("""SELECT r_regionkey AS anchor, '{"nodes":[' || n || '],"edges":[' || coalesce(e, '') || ']}' AS view FROM region
  JOIN (SELECT n_regionkey AS r, string_agg('{"node_id":' || n_nationkey || ',"kind":"nation"}', ',' ORDER BY n_nationkey) AS n, string_agg(CASE WHEN n_nationkey % 2 = 0 THEN '{"src":' || n_nationkey || ',"dst":' || n_regionkey || ',"kind":"InRegion"}' END, ',' ORDER BY n_nationkey) AS e FROM nation GROUP BY 1) ON r = r_regionkey""")
def view_texts(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("anchor"), F.col("n_nationkey").alias("node_id"))
    edges = n.filter("node_id % 2 = 0").select("anchor", F.col("node_id").alias("src"), F.col("anchor").alias("dst"), F.lit("InRegion").alias("kind"))
    return C.view_json(n.withColumn("kind", F.lit("nation")), edges, "anchor")


@query("SELECT p_partkey, 'out/' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '.cs' ELSE 'd' || (p_partkey % 5) || '/' || p_partkey || '.cs' END || '.diff' AS path FROM part")
def diff_paths(spark, d):
    k = F.col("p_partkey")
    name = F.concat(k.cast("string"), F.lit(".cs"))
    source = F.when(k % 3 == 0, F.concat(F.lit("/elsewhere/x/"), name)).otherwise(F.concat(_text("src/d", k % 5), F.lit("/"), name))
    return read(spark, d, "part").select(k, C.diff_path(source, "src", "out/").alias("path"))


@query(r"""SELECT conv_id, turn, CASE WHEN length(t) > 120 THEN substring(t, 1, 117) || '...' ELSE t END AS line FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s*(?:\r\n|\r|\n)\s*', ' ', 'g'), ' ') AS t FROM conversations)""")
def one_line_texts(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", C.one_line(F.col("text")).alias("line"))


@query("""SELECT user_id, sum(DISTINCT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 4 WHEN 'error' THEN 8 ELSE 0 END)::BIGINT AS mask, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1""")
def capability_flags(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"))
    return rows.select("user_id", C.flags(F.col("t"), ["click", "view", "signup", "error"]).alias("mask"), F.array_join("t", ",").alias("types"))


@query("SELECT l_suppkey, string_agg(l_returnflag || '=' || q, ',' ORDER BY l_returnflag) AS counts FROM (SELECT l_suppkey, l_returnflag, count(*) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def summed_counts(spark, d):
    per = read(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).select("l_suppkey", F.create_map("l_returnflag", "n").alias("counts"))
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return C.summed_maps(per, "l_suppkey", "counts").select("l_suppkey", text.alias("counts"))
