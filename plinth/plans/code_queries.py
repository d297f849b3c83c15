"""Queries on operation trees.  Each user is a method, each event a statement whose parts follow from its type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions.tables import cut, read
from plinth.operators import controlflow as K
from plinth.operators import decisions as E
from plinth.operators import syntax as S
from plinth.plans.registration import query

# (event type, the part is there if the id divides by this, part, part it hangs on, kind, role); part 0 stands in the root block
_PARTS = [
    ("click", 1, 0, -1, "Expr", "statement"),
    ("view", 1, 0, -1, "If", "statement"), ("view", 1, 1, 0, "Expr", "condition"), ("view", 1, 2, 0, "Block", "true"), ("view", 1, 3, 2, "Expr", "statement"), ("view", 2, 4, 0, "Return", "false"),
    ("signup", 1, 0, -1, "While", "statement"), ("signup", 1, 1, 0, "Expr", "condition"), ("signup", 1, 2, 0, "Block", "body"), ("signup", 2, 3, 2, "Break", "statement"), ("signup", 1, 4, 2, "Continue", "statement"),
    ("purchase", 1, 0, -1, "Switch", "statement"), ("purchase", 1, 1, 0, "Expr", "value"), ("purchase", 1, 2, 0, "Case", "case"), ("purchase", 1, 3, 2, "Expr", "statement"), ("purchase", 1, 4, 0, "Case", "case"),
    ("purchase", 3, 5, 0, "DefaultCase", "case"), ("purchase", 3, 6, 5, "Break", "statement"),
    ("error", 1, 0, -1, "Try", "statement"), ("error", 1, 1, 0, "Block", "body"), ("error", 1, 2, 1, "Expr", "statement"), ("error", 2, 3, 1, "Return", "statement"), ("error", 1, 4, 0, "Catch", "catch"),
    ("error", 1, 5, 4, "Block", "handler"), ("error", 1, 6, 5, "Expr", "statement"), ("error", 1, 7, 5, "Expr", "statement"), ("error", 3, 8, 0, "Block", "finally"), ("error", 3, 9, 8, "Expr", "statement"),
]


def operations(spark, d):
    """(ops, methods, params) of all users."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    ev = read(spark, d, "events").select("event_id", "user_id", "event_type", at.cast("long").alias("at"))
    parts = spark.createDataFrame(_PARTS, "event_type string, m int, j int, pj int, kind string, role string")
    made = ev.join(F.broadcast(parts), "event_type").filter("event_id % m = 0")  # a fixed list of 28 rows
    root = F.col("user_id") + 1000000000
    pos = F.col("at") * 20 + F.col("j")
    ops = made.select(F.col("user_id").alias("method_id"), (F.col("event_id") * 20 + F.col("j")).alias("op_id"), F.when(F.col("pj") < 0, root).otherwise(F.col("event_id") * 20 + F.col("pj")).alias("parent_id"), "kind", "role", pos.alias("pos"))
    users = ev.select("user_id").distinct()
    base = F.col("user_id") * 10 + 2000000000
    ops = ops.unionByName(users.select(F.col("user_id").alias("method_id"), root.alias("op_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("Block").alias("kind"), F.lit("root").alias("role"), F.lit(0).cast("long").alias("pos")))
    methods = users.select(F.col("user_id").alias("method_id"), base.alias("entry"), (base + 1).alias("ret"), (base + 2).alias("exit"))
    params = users.filter("user_id % 3 > 0").select(F.col("user_id").alias("method_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("user_id") % 3)).alias("ord")).withColumn("node", F.col("method_id") * 10 + 3000000000 + F.col("ord"))
    return ops, methods, params


_CFG = """v AS (SELECT user_id AS u, event_id, event_id * 20 AS e, event_type AS t, event_id % 2 = 0 AS m2, event_id % 3 = 0 AS m3, lead(event_id * 20) OVER w AS n, row_number() OVER w AS i,
    2000000000 + user_id * 10 AS en, 3000000000 + user_id * 10 AS pa FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  us AS (SELECT u, any_value(en) AS en, any_value(pa) AS pa, u % 3 AS np, min_by(e, i) AS f, max_by(e, i) AS l, bool_or(m2 AND t IN ('view', 'error')) AS returns FROM v GROUP BY u),
  g AS (SELECT e AS src, n AS dst, 'CfgNext' AS kind FROM v
  UNION SELECT en, CASE WHEN np > 0 THEN pa + 1 ELSE f END, 'CfgNext' FROM us UNION SELECT pa + 1, CASE WHEN np = 2 THEN pa + 2 ELSE f END, 'CfgNext' FROM us WHERE np > 0 UNION SELECT pa + 2, f, 'CfgNext' FROM us WHERE np = 2
  UNION SELECT en + 1, en + 2, 'CfgNext' FROM us UNION SELECT l, en + 1, 'CfgNext' FROM us WHERE NOT returns
  UNION SELECT e + CASE WHEN t = 'view' THEN 4 ELSE 3 END, en + 1, 'CfgNext' FROM v WHERE m2 AND t IN ('view', 'error')
  UNION SELECT e + 1, e + 2, 'CfgTrue' FROM v WHERE t IN ('view', 'signup') UNION SELECT e + 1, e + 4, 'CfgFalse' FROM v WHERE t = 'view' AND m2
  UNION SELECT e + 2, e + 1, 'CfgNext' FROM v WHERE t = 'signup' UNION SELECT e + 1, n, 'CfgFalse' FROM v WHERE t = 'signup'
  UNION SELECT e + 3, n, 'CfgNext' FROM v WHERE t = 'signup' AND m2 UNION SELECT e + 4, e + 1, 'CfgNext' FROM v WHERE t = 'signup'
  UNION SELECT e + 1, e + 3, 'CfgTrue' FROM v WHERE t = 'purchase' UNION SELECT e + 1, CASE WHEN m3 THEN e + 6 ELSE n END, 'CfgTrue' FROM v WHERE t = 'purchase'
  UNION SELECT e + 1, n, 'CfgFalse' FROM v WHERE t = 'purchase' AND NOT m3 UNION SELECT e + 3, CASE WHEN m3 THEN e + 6 ELSE n END, 'CfgNext' FROM v WHERE t = 'purchase'
  UNION SELECT e + 6, n, 'CfgNext' FROM v WHERE t = 'purchase' AND m3
  UNION SELECT e, e + 2, 'CfgNext' FROM v WHERE t = 'error' UNION SELECT e + 2, e + 6, 'CfgFalse' FROM v WHERE t = 'error' UNION SELECT e + 6, e + 9, 'CfgNext' FROM v WHERE t = 'error' AND m3
  UNION SELECT e + 7, CASE WHEN m3 THEN e + 9 ELSE n END, 'CfgNext' FROM v WHERE t = 'error' UNION SELECT e + 2, CASE WHEN m3 THEN e + 9 ELSE n END, 'CfgNext' FROM v WHERE t = 'error' AND NOT m2
  UNION SELECT e + 9, n, 'CfgNext' FROM v WHERE t = 'error' AND m3 UNION SELECT e + 3, e + 9, 'CfgNext' FROM v WHERE t = 'error' AND m2 AND m3)"""


@query(f"WITH {_CFG} SELECT src, dst, kind FROM g WHERE dst IS NOT NULL")
def control_flow_graph(spark, d):
    return K.control_flow(*operations(spark, d))


# ---- syntax trees: each part is a statement of one of five shapes; 200 parts stand in one block
# (shape, part, part it hangs on, kind, role)
_SHAPES = [
    (0, 0, -1, "ExpressionStatement", "statement"), (0, 1, 0, "SimpleAssignmentExpression", "expression"), (0, 2, 1, "IdentifierName", "left"), (0, 3, 1, "SimpleMemberAccessExpression", "right"),
    (0, 4, 3, "IdentifierName", "expression"), (0, 5, 3, "IdentifierName", "name"),
    (1, 0, -1, "LocalDeclarationStatement", "statement"), (1, 1, 0, "VariableDeclaration", "declaration"), (1, 2, 1, "VariableDeclarator", "declarator"), (1, 3, 2, "EqualsValueClause", "initializer"),
    (1, 4, 3, "InvocationExpression", "value"), (1, 5, 4, "IdentifierName", "expression"), (1, 6, 4, "ArgumentList", "arguments"), (1, 7, 6, "Argument", "argument"), (1, 8, 7, "IdentifierName", "expression"),
    (2, 0, -1, "IfStatement", "statement"), (2, 1, 0, "LogicalAndExpression", "condition"), (2, 2, 1, "LogicalNotExpression", "left"), (2, 3, 2, "IdentifierName", "operand"), (2, 4, 1, "LogicalOrExpression", "right"),
    (2, 5, 4, "IdentifierName", "left"), (2, 6, 4, "IdentifierName", "right"), (2, 7, 0, "Block", "then"), (2, 8, 7, "ReturnStatement", "statement"),
    (3, 0, -1, "WhileStatement", "statement"), (3, 1, 0, "IdentifierName", "condition"), (3, 2, 0, "Block", "body"), (3, 3, 2, "ExpressionStatement", "statement"), (3, 4, 3, "InvocationExpression", "expression"), (3, 5, 4, "IdentifierName", "expression"),
    (4, 0, -1, "ReturnStatement", "statement"), (4, 1, 0, "ParenthesizedExpression", "expression"), (4, 2, 1, "ConditionalAccessExpression", "expression"), (4, 3, 2, "IdentifierName", "expression"), (4, 4, 2, "MemberBindingExpression", "whenNotNull"),
]
_TREE = "p AS (SELECT p_partkey AS k, p_partkey * 10 AS n, p_size % 5 AS t, p_partkey % 3 AS m FROM part)"


def syntax(spark, d):
    shapes = spark.createDataFrame(_SHAPES, "t int, j int, pj int, kind string, role string")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("t"))
    block = F.floor(F.col("k") / 200)
    made = p.join(F.broadcast(shapes), "t").select(  # a fixed list of 36 rows
        (F.col("k") * 10 + F.col("j")).alias("node_id"), F.when(F.col("pj") < 0, -1 - block).otherwise(F.col("k") * 10 + F.col("pj")).alias("parent_id"), "kind", "role", block.cast("string").alias("file"),
        (F.col("k") * 10 + F.col("j")).alias("s"), (F.col("k") * 10 + F.col("j") + 1).alias("e"), F.concat(F.lit("x"), F.col("j").cast("string")).alias("text"),
        (F.col("k") % 40).cast("string").alias("symbol"), block.alias("scope"), (F.col("k") % 3 < 2).alias("target"),
    )
    roots = p.select(block.alias("b")).distinct().select((-1 - F.col("b")).alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("Block").alias("kind"), F.lit("body").alias("role"), F.col("b").cast("string").alias("file"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), F.lit("").alias("text"), F.lit(None).cast("string").alias("symbol"), F.col("b").alias("scope"), F.lit(False).alias("target"))
    return made.unionByName(roots)


_ATOMS = "a AS (SELECT k, n, t, m, n + j AS node_id, kind FROM p JOIN (VALUES (0, 2, 'ID'), (0, 3, 'MEMBER'), (1, 4, 'INVOKE'), (1, 8, 'ID'), (2, 3, 'ID'), (2, 5, 'ID'), (2, 6, 'ID'), (3, 1, 'ID'), (3, 4, 'INVOKE'), (4, 2, 'CONDITIONAL'), (4, 4, 'BINDING')) v(t, j, kind) USING (t))"


@query(f"WITH {_TREE}, {_ATOMS} SELECT node_id FROM a")
def atomic_expressions(spark, d):
    return S.atomic(syntax(spark, d)).select("node_id")


@query(f"WITH {_TREE}, {_ATOMS} SELECT node_id, 'DEL-SOBJ-MARK-' || kind || '-001' AS rule_id FROM a WHERE m < 2 UNION ALL SELECT n + 2, 'DEL-SOBJ-MARK-DECL-001' FROM p WHERE t = 1 AND m < 2")
def rule_marks(spark, d):
    return S.marks(syntax(spark, d))


@query(f"WITH {_TREE} SELECT n + 2 AS node_id, 'DEL-SOBJ-PROP-ASSIGN-LHS-001' AS rule_id, n + 3 AS source FROM p WHERE t = 0 AND m < 2 UNION ALL SELECT n + 2, 'DEL-SOBJ-PROP-DECL-INIT-001', n + j FROM p, (VALUES (4), (8)) v(j) WHERE t = 1 AND m < 2")
def rule_propagation(spark, d):
    nodes = syntax(spark, d)
    m = cut(S.marks(nodes))
    return S.to_left_value(m, nodes).unionByName(S.to_declarator(m, nodes))


@query(f"""WITH {_TREE}, df AS (SELECT n + 2 AS source, k % 40 AS y, k // 200 AS c FROM p WHERE t = 1 AND m < 2),
  r AS (SELECT n + j AS node_id, k % 40 AS y, k // 200 AS c FROM p JOIN (VALUES (0, 2), (0, 4), (0, 5), (1, 5), (1, 8), (2, 3), (2, 5), (2, 6), (3, 1), (3, 5), (4, 3)) v(t, j) USING (t)
    WHERE m = 2 OR (t, j) IN ((0, 4), (0, 5), (1, 5), (3, 5), (4, 3)))
  SELECT node_id, 'DEL-SOBJ-PROP-SYMBOL-001' AS rule_id, min(source) AS source FROM r JOIN df USING (y, c) GROUP BY 1""")
def rule_symbol_references(spark, d):
    nodes = syntax(spark, d)
    return S.to_references(cut(S.marks(nodes)), nodes)


@query(f"WITH {_TREE} SELECT n + 1 AS top, 1::BIGINT AS removed, 1::BIGINT AS survivors, CASE WHEN k % 2 = 0 THEN 'x4' ELSE 'x2' END AS rest FROM p WHERE t = 2 AND m < 2")
def logical_operand_split(spark, d):
    nodes = syntax(spark, d)
    j = F.col("node_id") % 10
    even = F.floor(F.col("node_id") / 10) % 2 == 0
    marked = S.marks(nodes).filter(F.when(even, j == 3).otherwise(j.isin(5, 6)))
    return S.operand_split(cut(marked), nodes)


@query(f"""WITH {_TREE}, v AS (SELECT * FROM (VALUES (0, 3, 0, 1), (0, 2, 0, 1), (1, 8, 7, 1), (1, 8, 6, 2), (1, 4, 0, 1), (1, 2, 0, 1), (2, 3, 2, 1), (2, 5, 1, 1), (2, 6, 1, 1), (2, 3, 1, 2),
    (3, 1, 0, 1), (3, 4, 3, 1), (4, 2, 1, 1), (4, 2, 0, 2), (4, 4, 1, 2), (4, 4, 0, 3)) v(t, j, h, depth))
  SELECT n + h AS node_id, 'DEL-SOBJ-LIFT-HOST-001' AS rule_id, min(n + j) AS source, min(depth)::INT AS depth FROM p JOIN v USING (t) WHERE m < 2 AND depth = (SELECT min(depth) FROM v w WHERE w.t = p.t AND w.h = v.h) GROUP BY 1""")
def host_lifting(spark, d):
    nodes = syntax(spark, d)
    return S.lift(cut(S.marks(nodes)), nodes)


@query(f"""WITH {_TREE}, e AS (SELECT * FROM (VALUES {', '.join(str((t, j, pj)) for t, j, pj, _, _ in _SHAPES)}) e(t, j, pj)),
  c AS (WITH RECURSIVE r(t, j, up, depth) AS (SELECT t, j, pj, 1 FROM e UNION ALL SELECT r.t, r.j, e.pj, r.depth + 1 FROM r JOIN e ON e.t = r.t AND e.j = r.up) SELECT * FROM r)
  SELECT n + j AS node_id, CASE WHEN up < 0 THEN -1 - k // 200 ELSE n + up END AS ancestor, depth FROM p JOIN c USING (t)""")
def syntax_closure(spark, d):
    return S.closure(syntax(spark, d))


# ---- decisions over the marks of the trees
_KINDS = {"default": ("WhileStatement", "IfStatement", "LocalDeclarationStatement", "ExpressionStatement")}
_UNITS = """u AS (SELECT k, n, t, n + j AS unit_id, CASE WHEN (n + j) % 7 = 0 THEN 'Replace' ELSE 'Delete' END AS action, depth, j,
    CASE WHEN t = 4 THEN 'x' || k WHEN (n + j) % 7 = 0 THEN (n + j)::VARCHAR ELSE (n + h)::VARCHAR END AS domain
    FROM p JOIN (VALUES (0, 2, 3, 0), (0, 3, 3, 0), (1, 4, 5, 0), (1, 8, 8, 0), (1, 2, 3, 0), (2, 3, 4, 0), (2, 5, 4, 0), (2, 6, 4, 0), (3, 1, 2, 0), (3, 4, 4, 3), (4, 2, 3, 0), (4, 4, 4, 0)) v(t, j, depth, h) USING (t) WHERE m < 2),
  below AS (SELECT * FROM (VALUES (1, 2, 4), (1, 2, 8), (1, 4, 8), (4, 2, 4)) b(t, a, b)),
  l AS (SELECT * FROM u WHERE NOT (action = 'Delete' AND EXISTS (SELECT 1 FROM u r JOIN below ON below.t = u.t AND below.a = u.j AND below.b = r.j WHERE r.action = 'Replace' AND r.domain = u.domain))),
  w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY domain ORDER BY depth, unit_id) = 1)"""


def _units(spark, d, nodes):
    shape4 = F.floor(F.col("node_id") / 10)
    t4 = read(spark, d, "part").filter("p_size % 5 = 4").select(F.col("p_partkey").alias("k"))
    m = S.marks(nodes).select("node_id", shape4.alias("k")).join(t4.withColumn("four", F.lit(True)), "k", "left")
    return m.select(F.col("node_id").alias("unit_id"), F.lit("default").alias("rule_id"), F.when(F.col("node_id") % 7 == 0, "Replace").otherwise("Delete").alias("action"), "node_id", F.when(F.col("four"), F.concat(F.lit("x"), F.col("k").cast("string"))).alias("conflict_key"))


@query(f"""WITH {_TREE}, {_UNITS} SELECT w.domain, w.unit_id, 'default' AS rule_id, w.action, w.unit_id AS node_id,
  (SELECT count(*) FROM l JOIN below ON below.t = w.t AND below.a = w.j AND below.b = l.j WHERE l.domain = w.domain) AS merged FROM w""")
def decisions(spark, d):
    nodes = cut(syntax(spark, d))
    return E.decide(cut(_units(spark, d, nodes)), nodes, _KINDS)


_NEST = "dc AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS decision_id, l_orderkey AS file, l_partkey % 40 AS s, l_partkey % 40 + l_quantity::BIGINT AS e, CASE WHEN l_suppkey % 4 = 0 THEN 'Replace' ELSE 'Delete' END AS action FROM lineitem)"


@query(f"WITH {_NEST} SELECT decision_id FROM dc WHERE action = 'Replace' OR NOT EXISTS (SELECT 1 FROM dc o WHERE o.file = dc.file AND o.s <= dc.s AND dc.e <= o.e AND (o.action = 'Replace' OR (o.decision_id <> dc.decision_id AND (o.e - o.s > dc.e - dc.s OR o.decision_id < dc.decision_id))))")
def nested_deletes(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    s = F.col("l_partkey") % 40
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("decision_id"), F.col("l_orderkey").alias("file"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"), F.when(F.col("l_suppkey") % 4 == 0, "Replace").otherwise("Delete").alias("action"))
    return E.without_nested(rows).select("decision_id")
