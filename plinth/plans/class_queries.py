"""Class rules over trees of fixed shapes, one a part, and over parts as members with line items as their calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions.tables import cut, read
from plinth.operators import class_rules as C
from plinth.plans.registration import query

# (shape, part, part it hangs on, kind, role, target, modifiers)
_SHAPES = [
    (0, 0, -1, "FieldDeclaration", "member", 0, ""), (0, 1, 0, "VariableDeclaration", "declaration", 0, ""), (0, 2, 1, "IdentifierName", "type", 1, ""),
    (0, 3, 1, "VariableDeclarator", "declarator", 0, ""), (0, 4, 3, "EqualsValueClause", "initializer", 0, ""), (0, 5, 4, "ObjectCreationExpression", "value", 1, ""), (0, 6, 5, "IdentifierName", "type", 1, ""),
    (1, 0, -1, "InterfaceDeclaration", "member", 0, ""), (1, 1, 0, "MethodDeclaration", "member", 0, ""), (1, 2, 1, "ParameterList", "parameters", 0, ""), (1, 3, 2, "Parameter", "parameter", 0, ""),
    (1, 4, 3, "GenericName", "type", 0, ""), (1, 5, 4, "TypeArgumentList", "arguments", 0, ""), (1, 6, 5, "QualifiedName", "argument", 1, ""), (1, 7, 0, "IndexerDeclaration", "member", 0, ""), (1, 8, 7, "IdentifierName", "type", 1, ""),
    (2, 0, -1, "ClassDeclaration", "member", 1, ""), (2, 1, 0, "MethodDeclaration", "member", 0, "private"), (2, 2, 1, "IdentifierName", "return", 1, ""), (2, 3, 0, "MethodDeclaration", "member", 0, "public"),
    (2, 4, 3, "GenericName", "return", 1, ""), (2, 5, 0, "MethodDeclaration", "member", 0, "public override"), (2, 6, 5, "IdentifierName", "return", 1, ""), (2, 7, 0, "PropertyDeclaration", "member", 0, ""), (2, 8, 7, "NullableType", "type", 0, ""), (2, 9, 8, "IdentifierName", "element", 1, ""),
    (3, 0, -1, "BaseList", "bases", 0, ""), (3, 1, 0, "SimpleBaseType", "base", 0, ""), (3, 2, 1, "IdentifierName", "type", 1, ""), (3, 3, 0, "SimpleBaseType", "base", 0, ""), (3, 4, 3, "GenericName", "type", 1, ""), (3, 5, 4, "TypeArgumentList", "arguments", 0, ""), (3, 6, 5, "IdentifierName", "argument", 1, ""),
    (4, 0, -1, "MethodDeclaration", "member", 0, "public static"), (4, 1, 0, "ParameterList", "parameters", 0, ""), (4, 2, 1, "Parameter", "parameter", 0, "this"), (4, 3, 2, "IdentifierName", "type", 1, ""), (4, 4, 0, "Block", "body", 0, ""),
    (4, 5, 4, "LocalDeclarationStatement", "statement", 0, ""), (4, 6, 5, "VariableDeclaration", "declaration", 0, ""), (4, 7, 6, "GenericName", "type", 0, ""), (4, 8, 7, "TypeArgumentList", "arguments", 0, ""), (4, 9, 8, "IdentifierName", "argument", 1, ""),
    (4, 10, 4, "InvocationExpression", "expression", 1, ""), (4, 11, 10, "Argument", "argument", 0, ""), (4, 12, 11, "SimpleMemberAccessExpression", "expression", 1, ""),
]
_P = "p AS (SELECT p_partkey * 16 AS n, p_size % 5 AS t FROM part)"
# numbers of lines repeat in the tables; a line is what its order and number name, and its part the smallest of them
_L = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)"


def _lines(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


def _nodes(spark, d):
    """The shapes; a part stands at its number in the text, and shapes of parts that 3 divides name nothing."""
    shapes = spark.createDataFrame(_SHAPES, "t int, j int, up int, kind string, role string, hit int, words string")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("t"))
    return cut(p.join(F.broadcast(shapes), "t").select(  # a fixed list of 44 rows
        (F.col("k") * 16 + F.col("j")).alias("node_id"), F.when(F.col("up") >= 0, F.col("k") * 16 + F.col("up")).alias("parent_id"), "kind", "role", F.col("j").cast("long").alias("s"),
        ((F.col("hit") == 1) & (F.col("k") % 3 != 0)).alias("target"), F.split("words", " ").alias("modifiers"), F.lit(None).cast("boolean").alias("explicit"),
    ))


@query(f"""WITH {_P}, c(t, j, rule_id) AS (VALUES (0, 2, 'TYPE'), (0, 5, 'EXPR'), (1, 6, 'TYPE'), (1, 8, 'TYPE'), (2, 0, 'DECL'), (2, 2, 'TYPE'), (2, 4, 'TYPE'), (2, 6, 'TYPE'), (2, 9, 'TYPE'), (3, 2, 'TYPE'),
    (4, 3, 'TYPE'), (4, 9, 'TYPE'), (4, 10, 'EXPR')) SELECT n + j AS node_id, 'DEL-CLASS-MARK-' || rule_id || '-001' AS rule_id FROM p JOIN c USING (t) WHERE n // 16 % 3 <> 0""")
def class_marks(spark, d):
    return C.class_marks(_nodes(spark, d))


_HOSTS = """c(t, x, host_kind, j) AS (VALUES (0, 0, 'Field', 2), (1, 1, 'InterfaceMethod', 6), (1, 7, 'InterfaceIndexer', 8), (2, 1, 'PrivateReturn', 2), (2, 3, 'PublicReturn', 4), (2, 7, 'Property', 9),
    (3, 1, 'Base', 2), (4, 0, 'ExtensionReceiver', 3), (4, 5, 'LocalGeneric', 9))"""


@query(f"WITH {_P}, {_HOSTS} SELECT n + x AS node_id, host_kind, n + j AS source FROM p JOIN c USING (t) WHERE n // 16 % 3 <> 0")
def class_hosts(spark, d):
    nodes = _nodes(spark, d)
    return C.declaration_hosts(C.type_marks(nodes), nodes)


@query(f"""WITH {_P}, {_HOSTS}, r(host_kind, rule) AS (VALUES {', '.join(str(x) for x in C.HOST_PROPOSALS.items())})
  SELECT rule AS rule_id, 'Delete' AS action, n + x AS node_id FROM p JOIN c USING (t) JOIN r USING (host_kind) WHERE n // 16 % 3 <> 0""")
def class_host_proposals(spark, d):
    nodes = _nodes(spark, d)
    return C.host_proposals(C.declaration_hosts(C.type_marks(nodes), nodes))


@query(f"SELECT p_partkey * 16 + 3 AS node_id, '{C.NEW_RULE}' AS rule_id, p_partkey * 16 + 5 AS source FROM part WHERE p_size % 5 = 0 AND p_partkey % 3 <> 0")
def class_creations(spark, d):
    nodes = _nodes(spark, d)
    return C.creation_declarators(C.expression_marks(nodes), nodes)


@query(f"""WITH {_L} SELECT l_orderkey * 8 + l_linenumber AS node_id, '{C.LOCAL_RULE}' AS rule_id, -p_partkey AS source FROM l JOIN part ON p_partkey = l_partkey
  WHERE p_size % 2 = 0 AND l_linenumber % 2 = p_size // 2 % 2 AND l_orderkey > p_partkey * 7 AND l_orderkey % 5 <> 0""")
def class_local_references(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    definitions = p.select((-k).alias("node_id"), F.lit("VariableDeclarator").alias("kind"), k.alias("symbol"), F.floor(F.col("p_size") / 2) % 2, (k * 7).alias("s")).toDF("node_id", "kind", "symbol", "scope", "s")
    names = _lines(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"), F.lit("IdentifierName").alias("kind"), F.col("l_partkey").alias("symbol"), (F.col("l_linenumber") % 2).alias("scope"), F.col("l_orderkey").alias("s"))
    marked = names.filter("s % 5 = 0").select("node_id")
    return C.later_references(p.filter("p_size % 2 = 0").select((-k).alias("node_id")), marked, definitions.unionByName(names))


def _members(spark, d):
    """Parts as members of two parameters, of which the second or, of every seventh, the first is typed by the class."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("owner_id"), F.col("p_size").alias("z"))
    z, o = F.col("z"), F.col("owner_id")
    kind = F.when(z % 5 < 3, "MethodDeclaration").when(z % 5 == 3, "LocalFunctionStatement").otherwise("IndexerDeclaration")
    owners = p.select("owner_id", kind.alias("kind"), F.when(z % 3 == 0, F.array(F.lit("private"))).when(z % 3 == 1, F.array(F.lit("public"), F.lit("static"))).otherwise(F.array(F.lit("public"))).alias("modifiers"), F.lit(None).cast("boolean").alias("explicit"),
        F.lit("C").alias("container"), F.concat(F.lit("m"), F.floor(o / 2).cast("string")).alias("name"), F.lit("").alias("form"), F.when((o % 2 == 1) & (z % 10 == 0), F.array(F.lit("int"))).otherwise(F.array(F.lit("int"), F.lit("T"))).alias("types"))
    parameters = p.select("owner_id", "z", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).select((o * 2 + F.col("position")).alias("parameter_id"), "owner_id", "position",
        ((F.col("position") == 1) & (z % 7 == 1)).alias("has_default"), ((F.col("position") == 1) & (z % 7 == 2)).alias("is_params"), ((F.col("position") == 0) & (z % 6 == 1)).alias("is_this"))
    marked = p.select(F.when(o % 7 == 0, o * 2).otherwise(o * 2 + 1).alias("parameter_id"), (o * 100).alias("source"))
    l = _lines(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call_id"), F.col("l_partkey").alias("owner_id"), "l_orderkey")
    c = F.when(F.col("l_orderkey") % 97 == 0, 1).otherwise(o % 3)  # 0: by position, 1: by name and turned, 2: the first alone
    calls = l.select("call_id", "owner_id")
    given = F.when(c == 0, F.expr("array(struct(0 as ordinal, 0 as position, false as named), struct(1 as ordinal, 1 as position, false as named))")).when(
        c == 1, F.expr("array(struct(0 as ordinal, 1 as position, true as named), struct(1 as ordinal, 0 as position, true as named))")).otherwise(F.expr("array(struct(0 as ordinal, 0 as position, false as named))"))
    return marked, owners, parameters, calls, l.select("call_id", F.inline(given))


_PLANS = f"""{_L}, o AS (SELECT p_partkey AS k, p_size AS z, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS x FROM part),
  call AS (SELECT l_orderkey * 8 + l_linenumber AS call_id, l_partkey AS k, CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE l_partkey % 3 END AS c FROM l),
  f AS (SELECT k, z, x, z % 5 < 3 AS method, z % 5 = 3 AS local, z % 5 = 4 AS indexer, z % 3 = 0 AS private, x = 1 AND z % 7 = 1 AS dflt, x = 1 AND z % 7 = 2 AS prms, x = 0 AND z % 6 = 1 AS this,
      EXISTS (FROM call WHERE call.k = o.k) AS called, NOT EXISTS (FROM call WHERE call.k = o.k AND c <> 0) AS placed, NOT EXISTS (FROM call WHERE call.k = o.k AND c <> 1) AS named,
      NOT EXISTS (FROM call WHERE call.k = o.k AND c = 2 AND x = 1) AS mapped, NOT EXISTS (FROM call WHERE call.k = o.k AND (c <> 2 OR x = 0)) AS absent,
      x = 1 AND NOT (k % 2 = 1 AND z % 10 = 0) AND EXISTS (FROM part q WHERE q.p_partkey // 2 = k // 2 AND q.p_partkey <> k AND q.p_partkey % 2 = 1 AND q.p_size % 10 = 0)
        AS clash FROM o),
  g AS (SELECT *, NOT dflt AND NOT prms AND NOT this AS plain FROM f),
  m AS (SELECT *, CASE WHEN method AND plain AND NOT clash AND called AND named THEN 'NamedMethod' WHEN method AND dflt AND NOT clash AND (private OR called) THEN 'OptionalMethod'
      WHEN method AND prms AND NOT clash AND (private OR called) AND absent THEN 'ParamsMethod' WHEN method AND private AND plain AND placed THEN 'PrivatePositional'
      WHEN method AND NOT private AND plain AND called AND placed THEN 'PublicPositional' WHEN local AND plain AND called AND named THEN 'NamedLocalFunction' WHEN local AND dflt AND called THEN 'OptionalLocalFunction'
      WHEN local AND plain AND called AND placed THEN 'LocalFunction' WHEN indexer AND plain AND called AND named THEN 'NamedIndexer' WHEN indexer AND plain AND called AND placed THEN 'Indexer' END AS mode FROM g),
  plan AS (SELECT CASE WHEN method THEN '{C.METHOD_USAGE}' WHEN local THEN '{C.LOCAL_FUNCTION_USAGE}' ELSE '{C.INDEXER_USAGE}' END AS rule_id, mode, k, x FROM m WHERE mode IS NOT NULL
    UNION ALL SELECT '{C.EXTENSION_USAGE}', 'Extension', k, x FROM m WHERE method AND z % 3 = 1 AND x = 1 AND z % 6 = 1 AND plain AND NOT clash AND called AND mapped)"""


@query(f"WITH {_PLANS} SELECT rule_id, mode, k AS owner_id, k * 2 + x AS parameter_id, x AS position, k * 100 AS source FROM plan")
def shrink_plans(spark, d):
    return C.shrink_plans(*_members(spark, d))


@query(f"""WITH {_PLANS}, r(mode, rule) AS (VALUES {', '.join(str(x) for x in C.SHRINK_PROPOSALS.items())})
  SELECT rule AS rule_id, 'Replace' AS action, k AS node_id, x::BIGINT AS removed, k * 100 AS source FROM plan JOIN r USING (mode)
  UNION ALL SELECT rule, 'Replace', call_id, (CASE WHEN c = 1 THEN 1 - x ELSE x END)::BIGINT, k * 100 FROM plan JOIN r USING (mode) JOIN call USING (k) WHERE c <> 2 OR x = 0""")
def shrink_proposals(spark, d):
    marked, owners, parameters, calls, arguments = _members(spark, d)
    return C.shrink_proposals(cut(C.shrink_plans(marked, owners, parameters, calls, arguments)), calls, arguments)


@query(f"""WITH u AS (SELECT o_custkey AS k, CASE o_custkey % 5 WHEN 0 THEN 'group' WHEN 1 THEN 'lambda' WHEN 2 THEN 'invocation' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'group' ELSE 'invocation' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'group' ELSE 'lambda' END END AS use, o_orderkey % 32 <> 0 AS fits FROM orders),
  s AS (SELECT c_custkey AS k, list_sort(list(DISTINCT use)) AS uses, bool_and(fits) AS fits FROM customer LEFT JOIN u ON u.k = c_custkey GROUP BY 1)
  SELECT '{C.DELEGATE_USAGE}' AS rule_id, mode, k AS owner_id, k AS parameter_id, 0 AS position, k AS source FROM (SELECT k, CASE WHEN fits IS NULL THEN 'PlainDelegate' WHEN NOT fits THEN NULL
    WHEN list_contains(uses, 'group') AND NOT list_contains(uses, 'lambda') THEN 'MethodGroup' WHEN list_contains(uses, 'lambda') AND NOT list_contains(uses, 'group') THEN 'Lambda' WHEN uses = ['invocation'] THEN 'InvocationChain' END AS mode FROM s) WHERE mode IS NOT NULL""")
def delegate_plans(spark, d):
    k, even = F.col("c_custkey"), F.col("o_orderkey") % 2 == 0
    owners = read(spark, d, "customer").select(k.alias("owner_id"), F.lit("DelegateDeclaration").alias("kind"))
    no = F.lit(False)
    parameters = owners.select(F.col("owner_id").alias("parameter_id"), "owner_id", F.lit(0).alias("position"), no.alias("has_default"), no.alias("is_params"), no.alias("is_this"))
    c = F.col("o_custkey") % 5
    use = F.when(c == 0, "group").when(c == 1, "lambda").when(c == 2, "invocation").when(c == 3, F.when(even, "group").otherwise("invocation")).otherwise(F.when(even, "group").otherwise("lambda"))
    uses = read(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), use.alias("use"), F.col("o_orderkey").alias("node_id"), (F.col("o_orderkey") % 32 != 0).alias("fits"))
    return C.delegate_plans(owners.select(F.col("owner_id").alias("parameter_id"), F.col("owner_id").alias("source")), owners, parameters, uses)
