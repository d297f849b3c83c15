import pytest

from plinth.operators import proposals as P

NODE = "node_id long, parent_id long, kind string, role string, file string, s long, e long, type string"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def tree(spark, rows):
    return spark.createDataFrame([(i, up, kind, role, "f", s, e, None) for i, up, kind, role, s, e in rows], NODE)


def ids(spark, *found):
    return spark.createDataFrame([(i,) for i in found], "node_id long")


def chain(spark, n, last=True):
    """n ifs, each in the else of the one before; the if i is node 10 i, its condition 10 i + 1, its else 10 i + 2."""
    rows, end = [], 1000 * n
    for i in range(n):
        rows += [(10 * i, 10 * i - 8 if i else None, "IfStatement", "statement", 100 * i, end), (10 * i + 1, 10 * i, "IdentifierName", "condition", 100 * i + 4, 100 * i + 5)]
        if i < n - 1 or last:
            rows.append((10 * i + 2, 10 * i, "ElseClause", "else", 100 * i + 50, end))
    if last:
        rows.append((10 * n, 10 * n - 8, "Block", "statement", 100 * n, end))
    return tree(spark, rows)


@pytest.mark.parametrize("last", [True, False])
def test_chains_are_decided_like_a_walk_from_the_outermost(spark, last):
    n = 6
    nodes = chain(spark, n, last)
    for marked in ([1, 11, 21, 31, 41, 51], [1, 21, 31, 50], [2, 12, 52]):
        want, taken = set(), set()
        for i in range(n):
            if not {10 * i, 10 * i + 1, 10 * i - 8} & set(marked):
                continue
            if i < n - 1:
                if 10 * i not in taken:
                    want.add(("Replace", 10 * i, 10 * i + 10))
                    taken |= {10 * i, 10 * i + 10}
            elif last:
                want.add(("Replace", 10 * i - 8, 10 * i + 2))
            else:
                want.add(("Delete", 10 * i - 8, None))
        made = P.if_proposals(P.if_completions(ids(spark, *marked), nodes)).select("action", "node_id", "replacement_node")
        assert pairs(made) == want, marked


def test_heads_alone(spark):
    nodes = tree(spark, [(0, None, "IfStatement", "statement", 0, 20), (1, 0, "ParenthesizedExpression", "condition", 4, 9), (2, 1, "ParenthesizedExpression", "expression", 5, 8), (3, 2, "IdentifierName", "expression", 6, 7), (4, 0, "Block", "then", 10, 20), (5, 4, "IdentifierName", "statement", 12, 13)])
    assert P.if_completions(ids(spark, 0), nodes).count() == 0  # the statement itself is left to the delete rules
    for mark in (1, 2, 3):
        assert pairs(P.if_completions(ids(spark, mark), nodes).select("node_id", "completion", "source")) == {(0, P.DELETE_IF, mark)}
        assert P.if_lifts(ids(spark, mark), nodes).count() == 0
    assert P.if_completions(ids(spark, 5), nodes).count() == 0
    none = P.if_completions(ids(spark), nodes)
    assert none.count() == 0 and P.if_proposals(none).count() == 0 and P.if_lifts(ids(spark), nodes).count() == 0


def test_else_and_its_statement_are_lifted_from_a_head_only(spark):
    nodes = chain(spark, 2)
    assert pairs(P.if_lifts(ids(spark, 11), nodes)) == {(10, 11)}
    head = chain(spark, 1)
    assert pairs(P.if_lifts(ids(spark, 0, 1), head)) == {(2, 0), (10, 0)}


def test_switch_sections(spark):
    nodes = tree(spark, [
        (0, None, "SwitchStatement", "statement", 0, 100), (1, 0, "SwitchSection", "section", 10, 40), (2, 1, "CaseSwitchLabel", "label", 10, 15), (3, 1, "Block", "statement", 15, 40), (4, 3, "Block", "statement", 16, 30),
        (5, 4, "ExpressionStatement", "statement", 17, 20), (6, 3, "BreakStatement", "statement", 31, 36), (7, 0, "SwitchSection", "section", 40, 60), (8, 7, "DefaultSwitchLabel", "label", 40, 48), (9, 7, "BreakStatement", "statement", 50, 56),
        (10, None, "SwitchStatement", "statement", 200, 300), (11, 10, "SwitchSection", "section", 210, 240), (12, 11, "DefaultSwitchLabel", "label", 210, 220), (13, 11, "ReturnStatement", "statement", 221, 230),
    ])
    assert pairs(P.switch_lifts(ids(spark, 5), ids(spark, 5), nodes)) == {(1, 5), (0, 5)}
    assert pairs(P.switch_lifts(ids(spark, 13), ids(spark, 13), nodes)) == {(11, 13)}  # no section but the default: the switch stays
    assert pairs(P.switch_lifts(ids(spark, 13), ids(spark, 13, 5), nodes)) == {(11, 13), (1, 13), (0, 13)}  # no seed inside: the first of all
    assert P.switch_lifts(ids(spark), ids(spark), nodes).count() == 0


def test_nodes_of_one_span_cover_each_other(spark):
    nodes = tree(spark, [(0, None, "Argument", "argument", 0, 5), (1, 0, "IdentifierName", "expression", 0, 5), (2, None, "ReturnStatement", "statement", 10, 20), (3, 2, "IdentifierName", "expression", 12, 15), (4, None, "IfStatement", "statement", 30, 40)])
    derived = lambda *rows: spark.createDataFrame(rows, "node_id long, source long")
    plain = lambda *rows: spark.createDataFrame(rows, "node_id long, source long, plain boolean")
    got = P.delete_proposals(ids(spark, 3, 3, 4), plain((0, 9, True), (3, 9, False)), derived((1, 9), (2, 3), (2, 8)), nodes)
    assert pairs(got.select("rule_id", "node_id", "source")) == {(P.CONTROL_RULE, 2, 3)}
    got = P.delete_proposals(ids(spark, 1, 3), plain().limit(0), derived().limit(0), nodes)
    assert pairs(got.select("rule_id", "node_id", "source")) == {(P.DEFAULT_RULE, 1, None), (P.DEFAULT_RULE, 3, None)}


def test_methods_become_private_or_stubs(spark):
    methods = spark.createDataFrame([(1, ["static", "public", "public"], "int F()"), (2, ["internal"], "void G()"), (3, ["public"], "void H()")], "node_id long, modifiers array<string>, tail string")
    assert pairs(P.method_privates(ids(spark, 1, 2), methods).select("node_id", "replacement")) == {(1, "static private public int F()")}
    bodies = spark.createDataFrame([(1, True, "A"), (2, False, "A"), (3, True, None)], "node_id long, has_body boolean, returns string")
    params = spark.createDataFrame([(1, 2, "y", "B", True), (1, 1, "x", "A", True), (1, 0, "w", "A", False)], "node_id long, ord int, name string, type string, is_out boolean")
    types = spark.createDataFrame([("A", "Class", False, False, True)], "type string, kind string, is_value boolean, is_abstract boolean, creatable boolean")
    assert pairs(P.method_stubs(ids(spark, 1, 2, 3), bodies, params, types).select("node_id", "replacement")) == {(1, "{x = new A();y = default(B);return new A();}"), (3, "{}")}


def test_edits_of_decisions(spark):
    text = "class C : A, B { } if (x) y; else z;"
    rows = [(1, None, "BaseList", "bases", 8, 14, None), (2, 1, "SimpleBaseType", "type", 10, 11, None), (3, 1, "SimpleBaseType", "type", 13, 14, None), (4, None, "IfStatement", "statement", 19, 36, None), (5, 4, "ElseClause", "else", 29, 36, None), (6, 4, "IdentifierName", "condition", 23, 24, "bool"), (7, 4, "ExpressionStatement", "then", 26, 28, None)]
    nodes = spark.createDataFrame([(i, up, k, r, "f", s, e, t) for i, up, k, r, s, e, t in rows], NODE)
    texts = spark.createDataFrame([("f", text)], "file string, text string")
    made = lambda *d: {(r.node_id, r.original, r.replacement) for r in P.decision_edits(spark.createDataFrame(d, "node_id long, action string, replacement string"), nodes, texts).collect()}
    assert made((2, "Delete", None), (5, "Delete", None), (6, "Delete", None), (7, "Delete", None), (4, "Skip", None)) == {(2, ": A, B", ": B"), (5, "if (x) y; else z;", "if (x) y;"), (6, "x", "default(bool)"), (7, "y;", "")}
    assert made((7, "Replace", "w;")) == {(7, "y;", "w;")}
    alone = nodes.filter("node_id <> 3")
    assert [r.replacement for r in P.decision_edits(spark.createDataFrame([(2, "Delete", None)], "node_id long, action string, replacement string"), alone, texts).collect()] == [""]
    with pytest.raises(Exception, match="without text"):
        made((7, "Replace", None))
