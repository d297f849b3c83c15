"""Rules over syntax trees: atomic expressions, marks, propagation, logical hosts and host lifting.

nodes(node_id, parent_id, kind, role, file, s, e) and, where a rule asks for them, symbol, scope, text and target (true
where the node names what is to go).  role says which part of its parent a node is.  Every walk goes level by level
with the unresolved nodes alone, so its rounds are bounded by the depth of the trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.tables import cut, first_wins

# Kinds and the rules that mark them.
MARK_RULES = {
    "IdentifierName": "DEL-SOBJ-MARK-ID-001",
    "ThisExpression": "DEL-SOBJ-MARK-THIS-001",
    "BaseExpression": "DEL-SOBJ-MARK-BASE-001",
    "VariableDeclarator": "DEL-SOBJ-MARK-DECL-001",
    "NumericLiteralExpression": "DEL-SOBJ-MARK-LIT-NUM-001",
    "StringLiteralExpression": "DEL-SOBJ-MARK-LIT-STR-001",
    "TrueLiteralExpression": "DEL-SOBJ-MARK-LIT-TRUE-001",
    "FalseLiteralExpression": "DEL-SOBJ-MARK-LIT-FALSE-001",
    "NullLiteralExpression": "DEL-SOBJ-MARK-LIT-NULL-001",
    "SimpleMemberAccessExpression": "DEL-SOBJ-MARK-MEMBER-001",
    "MemberBindingExpression": "DEL-SOBJ-MARK-BINDING-001",
    "InvocationExpression": "DEL-SOBJ-MARK-INVOKE-001",
    "ObjectCreationExpression": "DEL-SOBJ-MARK-NEW-001",
    "ImplicitObjectCreationExpression": "DEL-SOBJ-MARK-IMPLICIT-NEW-001",
    "ElementAccessExpression": "DEL-SOBJ-MARK-ELEMENT-001",
    "ConditionalAccessExpression": "DEL-SOBJ-MARK-CONDITIONAL-001",
}
ASSIGN_RULE, INIT_RULE, REFERENCE_RULE, LIFT_RULE = "DEL-SOBJ-PROP-ASSIGN-LHS-001", "DEL-SOBJ-PROP-DECL-INIT-001", "DEL-SOBJ-PROP-SYMBOL-001", "DEL-SOBJ-LIFT-HOST-001"
LOGICAL = ("LogicalAndExpression", "LogicalOrExpression")
ASSIGNMENT = "SimpleAssignmentExpression"
WRAPPERS = ("ParenthesizedExpression", "LogicalNotExpression", "PrefixUnaryExpression", "PostfixUnaryExpression", "CastExpression", "AwaitExpression")
ACCESSES = ("SimpleMemberAccessExpression", "MemberBindingExpression", "ElementAccessExpression", "ConditionalAccessExpression", "InvocationExpression", "ObjectCreationExpression", "ImplicitObjectCreationExpression")
PASS_UP = ("Argument", "ArgumentList", "BracketedArgumentList", "Interpolation", "SwitchExpressionArm")
HOSTS = (*WRAPPERS, "CheckedExpression", "RefExpression", "Argument", "Interpolation", "SimpleMemberAccessExpression", "ConditionalAccessExpression", "ElementAccessExpression", "InvocationExpression", "ObjectCreationExpression", "ImplicitObjectCreationExpression", "InitializerExpression", "ConditionalExpression", "SwitchExpressionArm", "SwitchExpression", "ArrowExpressionClause")


def is_expression(kind):
    """A kind that ends in Expression or names a simple one."""
    return kind.endswith("Expression") | kind.isin("IdentifierName", "GenericName", "QualifiedName")


def is_statement(kind):
    return kind.endswith("Statement") | kind.isin("Block")


def _parents(nodes: DataFrame) -> DataFrame:
    return cut(nodes.select(F.col("node_id").alias("_c"), F.col("parent_id").alias("_p"), F.col("kind").alias("_k"), F.col("role").alias("_r")))


def closure(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor, depth) for all proper ancestors, by doubling: the ancestors 2^k up are joined with all that
    are known below that distance, so the rounds are the logarithm of the depth."""
    jump = cut(nodes.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("far")))
    known = jump.select("node_id", F.col("far").alias("ancestor"), F.lit(1).alias("depth"))
    reach = 1
    while not jump.isEmpty():
        more = jump.join(known.select(F.col("node_id").alias("far"), "ancestor", "depth"), "far").select("node_id", "ancestor", (F.col("depth") + reach).alias("depth"))
        known = cut(known.unionByName(more))
        jump = cut(jump.join(jump.select(F.col("node_id").alias("far"), F.col("far").alias("_next")), "far").select("node_id", F.col("_next").alias("far")))
        reach *= 2
    return known


def atomic(nodes: DataFrame) -> DataFrame:
    """Atomic expressions that no wider one holds; wrappers do not count, and the first parent that is no expression
    ends the search.  A member binding is not held by calls and conditional accesses."""
    up = _parents(nodes)
    mine = nodes.filter(F.col("kind").isin(*[k for k in MARK_RULES if k != "VariableDeclarator"]))
    mine = cut(mine)
    open_ = mine.select("node_id", F.col("kind").alias("of"), F.col("parent_id").alias("at"))
    held = None
    while True:
        seen = open_.join(up, F.col("at") == F.col("_c")).filter(is_expression(F.col("_k")))
        free = (F.col("of") == "MemberBindingExpression") & F.col("_k").isin("InvocationExpression", "ConditionalAccessExpression")
        seen = cut(seen.withColumn("held", F.col("_k").isin(*ACCESSES) & ~free))
        found = seen.filter("held").select("node_id")
        held = found if held is None else held.unionByName(found)
        if seen.isEmpty():
            return mine.join(held, "node_id", "left_anti")
        open_ = seen.filter("not held").select("node_id", "of", F.col("_p").alias("at"))


def marks(nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id): target nodes that a rule marks, atomic expressions and declarators."""
    seeds = atomic(nodes).unionByName(nodes.filter("kind = 'VariableDeclarator'")).filter("target")
    rules = F.create_map(*[F.lit(x) for pair in MARK_RULES.items() for x in pair])
    return seeds.select("node_id", rules[F.col("kind")].alias("rule_id"))


def _nearest(marked: DataFrame, nodes: DataFrame, kind: str, role: str) -> DataFrame:
    """(source, found): for each marked expression the nearest node of a kind above it, reached from its part ``role``."""
    up = _parents(nodes)
    at = marked.join(nodes.filter(is_expression(F.col("kind"))).select("node_id"), "node_id", "left_semi")
    at = at.select(F.col("node_id").alias("source"), F.col("node_id").alias("at"))
    out = None
    while True:
        step = at.join(up.select("_c", "_p", "_r"), F.col("at") == F.col("_c")).select("source", "_p", "_r")
        step = cut(step.join(up.select(F.col("_c").alias("_p"), F.col("_k")), "_p").withColumn("hit", (F.col("_k") == kind) & (F.col("_r") == role)))
        found = step.filter("hit").select("source", F.col("_p").alias("found"))
        out = found if out is None else out.unionByName(found)
        if step.isEmpty():
            return out
        at = step.filter("not hit").select("source", F.col("_p").alias("at"))


def to_left_value(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id, source): what a marked right value is assigned to."""
    left = nodes.filter("role = 'left'").select(F.col("parent_id").alias("found"), "node_id")
    return _nearest(marked, nodes, ASSIGNMENT, "right").join(left, "found").select("node_id", F.lit(ASSIGN_RULE).alias("rule_id"), "source")


def to_declarator(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id, source): the declarator that a marked value initialises."""
    clause = nodes.filter("kind = 'EqualsValueClause'").select(F.col("node_id").alias("found"), F.col("parent_id").alias("node_id"))
    own = nodes.filter("kind = 'VariableDeclarator'").select("node_id")
    return _nearest(marked, nodes, "EqualsValueClause", "value").join(clause, "found").join(own, "node_id", "left_semi").select("node_id", F.lit(INIT_RULE).alias("rule_id"), "source")


def to_references(marked: DataFrame, nodes: DataFrame, only_later: bool = False) -> DataFrame:
    """(node_id, rule_id, source): references to the symbol of a marked declarator inside its scope, one source each
    (the first in the text); ``only_later`` keeps those after the definition."""
    defs = nodes.filter("kind = 'VariableDeclarator' and symbol is not null").join(marked.select("node_id").distinct(), "node_id", "left_semi")
    defs = defs.select(F.col("node_id").alias("source"), "symbol", "scope", F.col("s").alias("_s"))
    refs = nodes.filter("kind = 'IdentifierName'").select("node_id", "symbol", "scope", "s").join(marked.select("node_id"), "node_id", "left_anti")
    found = refs.join(defs, ["symbol", "scope"])
    if only_later:
        found = found.filter("s > _s")
    return first_wins(found, ["node_id"], ["_s", "source"]).select("node_id", F.lit(REFERENCE_RULE).alias("rule_id"), "source")


def logical_tops(nodes: DataFrame) -> DataFrame:
    """(node_id, top): the widest logical expression over each expression, through logical ones and wrappers alone."""
    up = _parents(nodes)
    at = cut(nodes.filter(is_expression(F.col("kind"))).select("node_id", F.when(F.col("kind").isin(*LOGICAL), F.col("node_id")).alias("top"), F.col("node_id").alias("at")))
    done = None
    while not at.isEmpty():
        step = at.join(up.select("_c", F.col("_p")), F.col("at") == F.col("_c")).join(up.select(F.col("_c").alias("_q"), F.col("_k").alias("_over")), F.col("_p") == F.col("_q"), "left")
        goes = F.coalesce(F.col("_over").isin(*LOGICAL, *WRAPPERS), F.lit(False))
        step = cut(step.select("node_id", F.when(F.col("_over").isin(*LOGICAL), F.col("_p")).otherwise(F.col("top")).alias("top"), F.col("_p").alias("at"), goes.alias("goes")))
        ended = step.filter("not goes and top is not null").select("node_id", "top")
        done = ended if done is None else done.unionByName(ended)
        at = step.filter("goes").drop("goes")
    return done if done is not None else nodes.select("node_id", F.col("node_id").alias("top")).limit(0)


def operand_split(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(top, removed, survivors, rest): hosts some but not all of whose operands are marked, and what is left of them,
    joined by their operator.  Operands of a nested expression of the same kind count as the host's own; one operand
    goes if it is marked, holds a mark, or lies in one."""
    tops = logical_tops(nodes)
    hosts = cut(tops.filter("node_id = top").join(nodes.select("node_id", "kind"), "node_id").select("top", "kind"))
    below = cut(nodes.select(F.col("parent_id").alias("at"), "node_id", F.col("kind").alias("_k"), "s", "e", "text"))
    at = hosts.select("top", "kind", F.col("top").alias("at"))
    operands = None
    while True:
        step = cut(at.join(below, "at"))
        one = step.filter("_k <> kind").select("top", "kind", "node_id", "s", "e", "text")
        operands = one if operands is None else operands.unionByName(one)
        if step.isEmpty():
            break
        at = step.filter("_k = kind").select("top", "kind", F.col("node_id").alias("at"))
    lines = closure(nodes)
    m = marked.select("node_id").distinct()
    inside = lines.join(m, "node_id").select(F.col("ancestor").alias("node_id"))
    around = lines.join(m.select(F.col("node_id").alias("ancestor")), "ancestor").select("node_id")
    gone = m.unionByName(inside).unionByName(around).distinct().withColumn("_gone", F.lit(True))
    flagged = operands.join(gone, "node_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    left = F.array_sort(F.collect_list(F.when(~F.col("_gone"), F.struct("s", "text"))))
    sign = F.when(F.col("kind") == LOGICAL[0], " && ").otherwise(" || ")
    out = flagged.groupBy("top", "kind").agg(F.count_if("_gone").alias("removed"), F.count_if(~F.col("_gone")).alias("survivors"), left.alias("_left"))
    return out.filter("removed > 0 and survivors > 0").select("top", "removed", "survivors", F.call_function("array_join", F.transform("_left", lambda x: x["text"]), sign).alias("rest"))


def lift_map(nodes: DataFrame) -> DataFrame:
    """(node_id, host): where a mark on a node moves to; nodes that stay have no row."""
    nodes = cut(nodes.select("node_id", "parent_id", "kind", "role"))
    up = nodes.select(F.col("node_id").alias("_p"), F.col("kind").alias("_k"), F.col("role").alias("_r"), F.col("parent_id").alias("_pp"))
    kind, over = F.col("kind"), F.col("_k")
    one = nodes.join(up, F.col("parent_id") == F.col("_p"))
    two = cut(one.join(nodes.select(F.col("node_id").alias("_pp"), F.col("kind").alias("_kk")), "_pp", "left"))

    passed = two.filter(kind.isin(*PASS_UP)).select("node_id", F.col("_p").alias("host"))
    declared = cut(two.filter((kind == "VariableDeclarator") & (F.col("_kk").isin("LocalDeclarationStatement", "ForStatement"))).select("node_id", F.col("_pp").alias("host")))
    lone = nodes.groupBy(F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    bodies = two.filter(is_statement(kind) & (over == "Block") & (F.col("_r") == "body") & F.col("_kk").isin("WhileStatement", "DoStatement")).join(lone, "_p", "left_semi").select("node_id", F.col("_pp").alias("host"))

    top = cut(logical_tops(nodes))
    itself = top.join(nodes.filter(kind.isin(*LOGICAL)), "node_id", "left_semi").filter("top <> node_id").select("node_id", F.col("top").alias("host"))

    # other expressions: the first ancestor that hosts
    at = nodes.filter(is_expression(kind) & ~kind.isin(*LOGICAL)).select("node_id", F.col("node_id").alias("at"))
    out = passed.unionByName(declared).unionByName(bodies).unionByName(itself)
    ladder = cut(two.select(F.col("node_id").alias("at"), "role", "_p", "_k", "_pp", "_kk"))
    tops = top.select(F.col("node_id").alias("_p"), F.col("top").alias("_top"))
    owners = declared.select(F.col("node_id").alias("_pp"), F.col("host").alias("_decl"))
    while True:
        step = at.join(ladder, "at").join(tops, "_p", "left").join(owners, "_pp", "left")
        host = (
            F.when(over.isin(*HOSTS) | is_statement(over), F.col("_p"))
            .when((over == ASSIGNMENT) & (F.col("_kk") == "ExpressionStatement"), F.col("_pp")).when(over == ASSIGNMENT, F.col("_p"))
            .when((over == "EqualsValueClause") & (F.col("_kk") == "VariableDeclarator"), F.col("_decl"))
            .when(over.isin(*LOGICAL), F.col("_top"))
        )
        step = cut(step.select("node_id", F.col("_p").alias("at"), host.alias("host")))
        out = out.unionByName(step.filter("host is not null").select("node_id", "host"))
        if step.isEmpty():
            return cut(out)
        at = step.filter("host is null").select("node_id", "at")


def lift(marked: DataFrame, nodes: DataFrame, fixed_rules: tuple[str, ...] = (REFERENCE_RULE,)) -> DataFrame:
    """(node_id, rule_id, source, depth): hosts of the marks (node_id, rule_id), and hosts of those, until no node is
    new.  Marks of ``fixed_rules`` stay where they are; of several sources the smallest id at the least depth is kept."""
    hosts = lift_map(nodes)
    seen = cut(marked.select("node_id").distinct())
    at = marked.filter(~F.col("rule_id").isin(*fixed_rules)).groupBy("node_id").agg(F.lit(0).alias("depth")).withColumn("source", F.col("node_id"))
    out = None
    depth = 0
    while True:
        depth += 1
        new = at.join(hosts, "node_id").groupBy(F.col("host").alias("node_id")).agg(F.min("source").alias("source"))
        new = cut(new.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        out = new if out is None else out.unionByName(new)
        if new.isEmpty():
            return out.select("node_id", F.lit(LIFT_RULE).alias("rule_id"), "source", "depth")
        seen = cut(seen.unionByName(new.select("node_id")))
        at = new
