"""If and switch structures, proposals and their edits over trees of five shapes, one a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.tables import cut, read
from plinth.operators import proposals as P
from plinth.plans.code_queries import syntax
from plinth.plans.registration import query

# (shape, part, part it hangs on, kind, role); parts stand in the order of the text
_SHAPES = [
    (0, 0, -1, "IfStatement", "statement"), (0, 1, 0, "IdentifierName", "condition"), (0, 2, 0, "Block", "then"), (0, 3, 2, "ExpressionStatement", "statement"),
    (1, 0, -1, "IfStatement", "statement"), (1, 1, 0, "IdentifierName", "condition"), (1, 2, 0, "Block", "then"), (1, 3, 0, "ElseClause", "else"), (1, 4, 3, "Block", "statement"),
    (2, 0, -1, "IfStatement", "statement"), (2, 1, 0, "ParenthesizedExpression", "condition"), (2, 2, 1, "IdentifierName", "expression"), (2, 3, 0, "Block", "then"), (2, 4, 0, "ElseClause", "else"),
    (2, 5, 4, "IfStatement", "statement"), (2, 6, 5, "IdentifierName", "condition"), (2, 7, 5, "Block", "then"), (2, 8, 5, "ElseClause", "else"), (2, 9, 8, "Block", "statement"),
    (3, 0, -1, "IfStatement", "statement"), (3, 1, 0, "IdentifierName", "condition"), (3, 2, 0, "Block", "then"), (3, 3, 0, "ElseClause", "else"),
    (3, 4, 3, "IfStatement", "statement"), (3, 5, 4, "IdentifierName", "condition"), (3, 6, 4, "Block", "then"), (3, 7, 4, "ElseClause", "else"),
    (3, 8, 7, "IfStatement", "statement"), (3, 9, 8, "IdentifierName", "condition"), (3, 10, 8, "Block", "then"), (3, 11, 8, "ElseClause", "else"),
    (3, 12, 11, "IfStatement", "statement"), (3, 13, 12, "IdentifierName", "condition"), (3, 14, 12, "Block", "then"),
    (4, 0, -1, "SwitchStatement", "statement"), (4, 1, 0, "IdentifierName", "expression"), (4, 2, 0, "SwitchSection", "section"), (4, 3, 2, "CaseSwitchLabel", "label"), (4, 4, 2, "Block", "statement"),
    (4, 5, 4, "ExpressionStatement", "statement"), (4, 6, 4, "ReturnStatement", "statement"), (4, 7, 0, "SwitchSection", "section"), (4, 8, 7, "CaseSwitchLabel", "label"), (4, 9, 7, "ExpressionStatement", "statement"),
    (4, 10, 7, "BreakStatement", "statement"), (4, 11, 0, "SwitchSection", "section"), (4, 12, 11, "DefaultSwitchLabel", "label"), (4, 13, 11, "ReturnStatement", "statement"),
]


def _ends() -> list[tuple]:
    """The shapes with the part behind the last one under each, which ends its span."""
    end = {(t, j): j + 1 for t, j, *_ in _SHAPES}
    for t, j, up, *_ in reversed(_SHAPES):
        if up >= 0:
            end[t, up] = max(end[t, up], end[t, j])
    return [(t, j, up, end[t, j], kind, role) for t, j, up, kind, role in _SHAPES]


_N = f"""p AS (SELECT p_partkey AS k, p_partkey * 16 AS n, p_size % 5 AS t FROM part),
  n AS (SELECT k, n, t, j, up, n + j AS node_id, CASE WHEN up >= 0 THEN n + up END AS parent_id, kind, role, k // 200 AS file, k % 200 * 16 + j AS s, k % 200 * 16 + e AS e
    FROM p JOIN (VALUES {', '.join(map(str, _ends()))}) v(t, j, up, e, kind, role) USING (t)),
  m AS (SELECT * FROM n WHERE (k + j) % 3 = 0)"""


def _nodes(spark, d):
    shapes = spark.createDataFrame(_ends(), "t int, j int, up int, end int, kind string, role string")
    k, start = F.col("k"), F.col("k") % 200 * 16
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("t"))
    return p.join(F.broadcast(shapes), "t").select(  # a fixed list of 48 rows
        (k * 16 + F.col("j")).alias("node_id"), F.when(F.col("up") >= 0, k * 16 + F.col("up")).alias("parent_id"), "kind", "role", F.floor(k / 200).alias("file"),
        (start + F.col("j")).alias("s"), (start + F.col("end")).alias("e"), F.when(F.col("j") % 2 == 1, F.concat(F.lit("T"), F.col("j").cast("string"))).alias("type"), k, "j", "t",
    )


def _marked(nodes):
    return nodes.filter((F.col("k") + F.col("j")) % 3 == 0).select("node_id")


# what a mark on part j of a shape decides: the part that changes, how, and the part that takes its place
_COMPLETE = """c(t, j, x, completion, tail) AS (VALUES (0, 1, 0, 'DeleteWholeIf', NULL), (1, 0, 0, 'DeleteWholeIf', 3), (1, 1, 0, 'DeleteWholeIf', 3),
    (2, 0, 0, 'ReplaceIfWithElseIfTail', 5), (2, 1, 0, 'ReplaceIfWithElseIfTail', 5), (2, 2, 0, 'ReplaceIfWithElseIfTail', 5),
    (2, 4, 4, 'ReplaceOwningElseWithElseTail', 8), (2, 5, 4, 'ReplaceOwningElseWithElseTail', 8), (2, 6, 4, 'ReplaceOwningElseWithElseTail', 8),
    (3, 0, 0, 'ReplaceIfWithElseIfTail', 4), (3, 1, 0, 'ReplaceIfWithElseIfTail', 4), (3, 3, 4, 'ReplaceIfWithElseIfTail', 8), (3, 4, 4, 'ReplaceIfWithElseIfTail', 8), (3, 5, 4, 'ReplaceIfWithElseIfTail', 8),
    (3, 7, 8, 'ReplaceIfWithElseIfTail', 12), (3, 8, 8, 'ReplaceIfWithElseIfTail', 12), (3, 9, 8, 'ReplaceIfWithElseIfTail', 12),
    (3, 11, 11, 'DeleteOwningElseClause', NULL), (3, 12, 11, 'DeleteOwningElseClause', NULL), (3, 13, 11, 'DeleteOwningElseClause', NULL)),
  r AS (SELECT k, n, t, x, completion, n + tail AS tail, min(n + c.j) AS source FROM m JOIN c USING (t, j) GROUP BY ALL)"""


@query(f"WITH {_N}, {_COMPLETE} SELECT n + x AS node_id, completion, tail, source FROM r")
def if_completions(spark, d):
    nodes = cut(_nodes(spark, d))
    return P.if_completions(_marked(nodes), nodes).select("node_id", "completion", "tail", "source")


@query(f"""WITH {_N}, l(t, j, x) AS (VALUES (1, 0, 3), (1, 0, 4), (1, 1, 0), (1, 1, 3), (1, 1, 4), (2, 0, 5), (2, 1, 0), (2, 1, 5), (2, 2, 0), (2, 2, 5), (2, 6, 5),
    (3, 0, 4), (3, 1, 0), (3, 1, 4), (3, 4, 8), (3, 5, 4), (3, 5, 8), (3, 8, 12), (3, 9, 8), (3, 9, 12), (3, 12, 11), (3, 13, 12), (3, 13, 11))
  SELECT n + x AS node_id, min(n + j) AS source FROM m JOIN l USING (t, j) WHERE (k + x) % 3 <> 0 GROUP BY 1""")
def if_lifting(spark, d):
    nodes = cut(_nodes(spark, d))
    return P.if_lifts(_marked(nodes), nodes)


@query(f"""WITH {_N}, {_COMPLETE}, h AS (SELECT k, bool_or(x = 0) AS h0, bool_or(x = 4) AS h4 FROM r WHERE t = 3 GROUP BY k)
  SELECT '{P.IF_RULE}' AS rule_id, CASE WHEN completion LIKE 'Delete%' THEN 'Delete' ELSE 'Replace' END AS action, n + x AS node_id, CASE WHEN completion LIKE 'Replace%' THEN tail END AS replacement_node,
    CASE completion WHEN 'DeleteWholeIf' THEN NULL WHEN 'DeleteOwningElseClause' THEN (n + 12)::VARCHAR ELSE (n + x)::VARCHAR END AS conflict_key
  FROM r LEFT JOIN h USING (k) WHERE NOT (t = 3 AND ((x = 4 AND h0) OR (x = 8 AND h4 AND NOT h0)))""")
def if_proposals(spark, d):
    nodes = cut(_nodes(spark, d))
    return P.if_proposals(cut(P.if_completions(_marked(nodes), nodes))).select("rule_id", "action", "node_id", "replacement_node", "conflict_key")


# marks of a switch: the statements of both sections where the part's number says so
_SWITCH = "sm AS (SELECT * FROM n WHERE t = 4 AND ((j = 5 AND k % 2 = 0) OR (j = 6 AND k % 3 < 2) OR (j = 9 AND k % 5 < 3) OR (j = 7 AND k % 7 = 0)))"


@query(f"""WITH {_N}, {_SWITCH}, f AS (SELECT k, n, k % 2 = 0 AND k % 3 < 2 AS one, k % 5 < 3 AS two, k % 7 = 0 AS seven, (SELECT min(node_id) FROM sm) AS first FROM p WHERE t = 4),
  x AS (SELECT n + 2 AS node_id, n + 2 AS lo, n + 6 AS hi, first FROM f WHERE one UNION ALL SELECT n + 7, n + 7, n + 10, first FROM f WHERE two AND NOT seven UNION ALL SELECT n, n, n + 13, first FROM f WHERE one AND (two OR seven))
  SELECT x.node_id, min(sm.node_id) AS source FROM x JOIN sm ON sm.node_id BETWEEN lo AND hi GROUP BY 1""")
def switch_lifting(spark, d):
    nodes = cut(_nodes(spark, d))
    k, j = F.col("k"), F.col("j")
    marked = nodes.filter((F.col("t") == 4) & (((j == 5) & (k % 2 == 0)) | ((j == 6) & (k % 3 < 2)) | ((j == 9) & (k % 5 < 3)) | ((j == 7) & (k % 7 == 0)))).select("node_id")
    return P.switch_lifts(marked, marked, nodes)


_ACTIVE = """g AS (SELECT *, 0 AS o, k % 4 <> 0 AS plain, node_id AS source FROM n WHERE (k + j) % 4 = 1 UNION ALL SELECT *, 1, true, node_id + 1 FROM n WHERE (k * 7 + j) % 5 = 0),
  dv AS (SELECT * FROM g WHERE plain QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY o, source) = 1),
  av AS (SELECT * FROM dv WHERE NOT EXISTS (SELECT 1 FROM dv x WHERE x.k = dv.k AND x.node_id <> dv.node_id AND x.s <= dv.s AND dv.e <= x.e)),
  ow AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM g x WHERE x.k = m.k AND x.node_id <> m.node_id AND x.s <= m.s AND m.e <= x.e))"""


@query(f"""WITH {_N}, {_ACTIVE}, both_ AS (SELECT node_id, kind, source FROM av UNION ALL SELECT node_id, kind, NULL FROM ow)
  SELECT '{P.CONTROL_RULE}' AS rule_id, 'Delete' AS action, node_id, source FROM av WHERE kind IN ('SwitchStatement', 'ReturnStatement')
  UNION ALL SELECT '{P.DEFAULT_RULE}', 'Delete', node_id, source FROM both_ WHERE kind NOT IN ('SwitchStatement', 'ReturnStatement', 'IfStatement', 'ElseClause')""")
def delete_proposals(spark, d):
    nodes = cut(_nodes(spark, d))
    propagated = nodes.filter((F.col("k") + F.col("j")) % 4 == 1).select("node_id", F.col("node_id").alias("source"), (F.col("k") % 4 != 0).alias("plain"))
    lifted = nodes.filter((F.col("k") * 7 + F.col("j")) % 5 == 0).select("node_id", (F.col("node_id") + 1).alias("source"))
    return P.delete_proposals(_marked(nodes), propagated, lifted, nodes).select("rule_id", "action", "node_id", "source")


@query(f"WITH p AS (SELECT p_partkey AS k, p_partkey * 10 AS n, p_size % 5 AS t, p_partkey % 3 AS m FROM part) SELECT '{P.LOGICAL_RULE}' AS rule_id, 'Replace' AS action, n + 1 AS node_id, 'x2' AS replacement, (n + 1)::VARCHAR AS conflict_key FROM p WHERE t = 2 AND m < 2")
def logical_proposals(spark, d):
    nodes = cut(syntax(spark, d))
    marked = nodes.filter((F.col("node_id") % 10).isin(5, 6) & (F.col("kind") == "IdentifierName") & F.col("target"))
    return P.logical_proposals(marked.select("node_id"), nodes).select("rule_id", "action", "node_id", "replacement", "conflict_key")


_MODS = "mo AS (SELECT c_custkey AS node_id, CASE c_nationkey % 3 WHEN 0 THEN 'public static' WHEN 1 THEN 'static public' ELSE 'internal' END AS mods, c_custkey % 2 = 0 AS marked FROM customer)"


@query(f"""WITH {_MODS} SELECT '{P.PRIVATE_RULE}' AS rule_id, 'Replace' AS action, node_id, replace(mods, 'public', 'private') || ' void M' || node_id || '()' AS replacement FROM mo WHERE marked AND mods LIKE '%public%'
  UNION ALL SELECT '{P.UNREFERENCED_RULE}', 'Delete', node_id, NULL FROM mo WHERE node_id % 5 = 0 UNION ALL SELECT '{P.UNREACHABLE_RULE}', 'Delete', node_id, NULL FROM mo WHERE node_id % 7 = 0""")
def method_proposals(spark, d):
    n = F.col("c_nationkey") % 3
    mods = F.when(n == 0, F.array(F.lit("public"), F.lit("static"))).when(n == 1, F.array(F.lit("static"), F.lit("public"))).otherwise(F.array(F.lit("internal")))
    methods = read(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), mods.alias("modifiers"), F.concat(F.lit("void M"), F.col("c_custkey").cast("string"), F.lit("()")).alias("tail"))
    units = P.method_privates(methods.filter("node_id % 2 = 0"), methods).drop("modifiers")
    units = units.unionByName(P.method_deletes(methods.filter("node_id % 5 = 0"))).unionByName(P.method_deletes(methods.filter("node_id % 7 = 0"), P.UNREACHABLE_RULE))
    return units.select("rule_id", "action", "node_id", "replacement")


# orders are methods and their lines parameters; a type is known by the rest of the line's part
_TYPES = [("T0", "Struct", True, False, True), ("T1", "Class", False, False, True), ("T2", "Class", False, True, True), ("T3", "Class", False, False, False), ("T4", "TypeParameter", False, False, False), ("T5", "Interface", False, True, False)]


@query(f"""WITH v(y, x) AS (VALUES ('T0', 'new T0()'), ('T1', 'new T1()'), ('T2', 'default(T2)'), ('T3', 'default(T3)'), ('T4', 'new T4()'), ('T5', 'default(T5)'), ('T6', 'default(T6)')),
  ps AS (SELECT DISTINCT l_orderkey AS node_id, l_linenumber AS o, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS pk FROM lineitem WHERE l_linenumber % 2 = 1),
  ot AS (SELECT node_id, string_agg('p' || o || ' = ' || x || ';', '' ORDER BY o) AS t FROM ps JOIN v ON y = 'T' || pk % 7 GROUP BY 1)
  SELECT o_orderkey AS node_id, '{{' || coalesce(t, '') || CASE WHEN o_custkey % 8 = 7 THEN '' ELSE 'return ' || x || ';' END || '}}' AS replacement
  FROM orders LEFT JOIN ot ON node_id = o_orderkey LEFT JOIN v ON y = 'T' || o_custkey % 8 WHERE o_orderstatus <> 'P'""")
def interface_stubs(spark, d):
    orders = read(spark, d, "orders")
    name = lambda c: F.concat(F.lit("T"), c.cast("string"))
    methods = orders.select(F.col("o_orderkey").alias("node_id"), (F.col("o_orderstatus") != "P").alias("has_body"), F.when(F.col("o_custkey") % 8 < 7, name(F.col("o_custkey") % 8)).alias("returns"))
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("pk"))
    params = lines.select("node_id", "ord", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("name"), name(F.col("pk") % 7).alias("type"), (F.col("ord") % 2 == 1).alias("is_out"))
    types = spark.createDataFrame(_TYPES, "type string, kind string, is_value boolean, is_abstract boolean, creatable boolean")
    return P.method_stubs(methods, methods, params, types).select("node_id", "replacement")


@query(f"""WITH {_N}, x AS (SELECT m.*, repeat('if (a) b; else c', 200) AS text, k % 11 = 0 AS rep FROM m WHERE k % 13 <> 0),
  z AS (SELECT x.*, q.s AS ps, q.e AS pe, NOT rep AND x.kind = 'ElseClause' AS cl FROM x LEFT JOIN n q ON q.node_id = x.parent_id),
  y AS (SELECT node_id, file, CASE WHEN cl THEN ps ELSE s END AS s, CASE WHEN cl THEN pe ELSE e END AS e, text, CASE WHEN rep THEN 'r' || node_id
    WHEN kind LIKE '%Expression' OR kind = 'IdentifierName' THEN CASE WHEN j % 2 = 1 THEN 'default(T' || j || ')' ELSE 'default' END WHEN cl THEN rtrim(substring(text, ps + 1, s - ps)) ELSE '' END AS replacement FROM z)
  SELECT node_id, file, s, e, substring(text, s + 1, e - s) AS original, replacement FROM y""")
def decision_edits(spark, d):
    nodes = cut(_nodes(spark, d))
    k = F.col("k")
    made = nodes.filter((k + F.col("j")) % 3 == 0).select("node_id", F.when(k % 13 == 0, "Skip").when(k % 11 == 0, "Replace").otherwise("Delete").alias("action"), F.when(k % 11 == 0, F.concat(F.lit("r"), F.col("node_id").cast("string"))).alias("replacement"))
    texts = nodes.select("file").distinct().withColumn("text", F.repeat(F.lit("if (a) b; else c"), 200))
    return P.decision_edits(made, nodes.select("node_id", "parent_id", "kind", "file", "s", "e", "type"), texts)
