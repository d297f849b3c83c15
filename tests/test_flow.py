import itertools
import random
from collections import deque

import pytest

from plinth.operators import dataflow as D
from plinth.operators import decisions as E
from plinth.operators import graph as G
from plinth.operators import syntax as S
from plinth.operators import views as V
from plinth.sources import catalog as C

NODE = "node_id long, parent_id long, kind string, role string, file string, s long, e long, symbol string, scope long, text string, target boolean"
EDGE = "src long, dst long, kind string"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def queue_path(edges, starts, ends):
    """The path that a queue finds, the plain way."""
    near = {}
    for s, d, k in edges:
        near.setdefault(s, []).append((0, k, d, (s, d, k)))
        near.setdefault(d, []).append((1, k, s, (s, d, k)))
    if set(starts) & set(ends):
        return []
    todo, back = deque(sorted(starts)), {s: None for s in starts}
    while todo:
        at = todo.popleft()
        for _, _, to, edge in sorted(near.get(at, [])):
            if to not in back:
                back[to] = (at, edge)
                if to in ends:
                    out = []
                    while back[to]:
                        to, step = back[to]
                        out.append(step)
                    return out[::-1]
                todo.append(to)
    return []


@pytest.mark.parametrize("seed", range(4))
def test_connecting_path_is_the_one_a_queue_finds(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(rnd.randrange(14), rnd.randrange(14), rnd.choice("xy")) for _ in range(20)})
    edges = [e for e in edges if e[0] != e[1]]
    starts, ends = rnd.sample(range(14), 2), rnd.sample(range(14), 2)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "node_id long")
    got = V.connecting_path(spark.createDataFrame(edges, EDGE), ids(starts), ids(ends)).orderBy("pos").collect()
    assert [(r.src, r.dst, r.kind) for r in got] == queue_path(edges, starts, ends)


def test_structure_view(spark):
    nodes = spark.createDataFrame([(1, "f", 0, 2), (2, "f", 5, 6), (3, "g", 0, 1), (4, "f", 20, 30)], "node_id long, file string, s long, e long")
    edges = spark.createDataFrame([(1, 3, "x"), (3, 2, "x"), (2, 4, "x"), (1, 2, "y")], EDGE).filter("kind = 'x'")
    seen, among = V.structure_view(nodes, edges, [("f", 0, 3), ("f", 4, 7)])
    assert {r.node_id for r in seen.collect()} == {1, 2, 3} and pairs(among.select("src", "dst")) == {(1, 3), (3, 2)}
    with pytest.raises(ValueError):
        V.structure_view(nodes, edges, [("h", 0, 1)])
    with pytest.raises(ValueError):
        V.structure_view(nodes, edges, [])


@pytest.mark.parametrize("seed", range(3))
def test_dominators_of_several_methods(spark, seed):
    rnd = random.Random(seed)
    edges, members, roots = [], [], []
    for scope in (1, 2):
        base = scope * 100
        here = {(base + rnd.randrange(7), base + rnd.randrange(7)) for _ in range(10)}
        edges += here
        members += [(scope, base + i) for i in range(7)]
        roots.append((scope, base))

    def reach(root, gone):
        out, todo = {root}, [root]
        while todo:
            at = todo.pop()
            for s, d in edges:
                if s == at and d != gone and d not in out:
                    out.add(d)
                    todo.append(d)
        return out

    want = {(n, n) for _, n in members}
    for scope, root in roots:
        live = reach(root, None)
        want |= {(n, d) for n, d in itertools.permutations(live, 2) if d == root or n not in reach(root, d)}
    pair = "scope long, node_id long"
    got = G.dominators(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(roots, pair), spark.createDataFrame(members, pair))
    assert pairs(got) == want


def test_facts_of_fields_and_their_owners(spark):
    fact = "def_id long, node_id long, m long, location string, base string, path string, category string"
    defs = spark.createDataFrame([(1, 1, 7, "o", None, None, "local"), (2, 2, 7, "o.a", "o", "a", "field"), (3, 3, 7, "o.b", "o", "b", "field"), (4, 4, 7, "p", "", "", "local")], fact)
    uses = spark.createDataFrame([(10, 10, 7, "o.a", "o", "a", "field"), (11, 11, 7, "o", None, None, "local"), (12, 12, 8, "o", None, None, "local")], fact.replace("def_id", "use_id"))
    assert pairs(D.matches(defs, uses, "m").select("def_id", "use_id")) == {(1, 10), (2, 10), (3, 10), (1, 11), (2, 11), (3, 11)}
    # the whole ends its parts, and a part the other parts of its whole, but not the whole
    assert pairs(D.conflicts(defs, "m")) == {(1, 1), (2, 2), (3, 3), (4, 4), (2, 1), (3, 1), (2, 3), (3, 2)}


def tree(spark, rows):
    """rows of (id, parent, kind, role[, symbol, text, target]); spans follow the ids."""
    full = [(r[0], r[1], r[2], r[3], "f", r[0], r[0] + 1, *(list(r[4:]) + [None, "", False][len(r[4:]):])[:1], 1, *(list(r[4:]) + [None, "", False][len(r[4:]):])[1:]) for r in rows]
    return spark.createDataFrame(full, NODE)


def test_lifting_an_expression_out_of_a_loop(spark):
    # while (c) { f(x); }
    nodes = tree(spark, [(1, None, "Block", "body"), (2, 1, "WhileStatement", "statement"), (3, 2, "IdentifierName", "condition"), (4, 2, "Block", "body"), (5, 4, "ExpressionStatement", "statement"), (6, 5, "InvocationExpression", "expression"), (7, 6, "ArgumentList", "arguments"), (8, 7, "Argument", "argument"), (9, 8, "IdentifierName", "expression")])
    marks = spark.createDataFrame([(9, "m"), (3, S.REFERENCE_RULE)], "node_id long, rule_id string")
    assert pairs(S.lift(marks, nodes).select("node_id", "depth")) == {(8, 1), (7, 2), (6, 3), (5, 4), (2, 5)}
    assert S.lift(marks.limit(0), nodes).count() == 0
    assert pairs(S.closure(nodes).filter("node_id = 9").select("ancestor", "depth")) == {(8, 1), (7, 2), (6, 3), (5, 4), (4, 5), (2, 6), (1, 7)}


def test_operands_that_stay(spark):
    # a && !b && (c || d), b marked
    nodes = tree(spark, [(1, None, "IfStatement", "statement"), (2, 1, "LogicalAndExpression", "condition"), (3, 2, "LogicalAndExpression", "left"), (4, 3, "IdentifierName", "left", None, "a"), (5, 3, "LogicalNotExpression", "right", None, "!b"), (6, 5, "IdentifierName", "operand", None, "b"), (7, 2, "ParenthesizedExpression", "right", None, "(c || d)"), (8, 7, "LogicalOrExpression", "expression", None, "c || d")])
    one = spark.createDataFrame([(6,)], "node_id long")
    assert pairs(S.operand_split(one, nodes)) == {(2, 1, 2, "a && (c || d)")}
    assert S.operand_split(spark.createDataFrame([(2,)], "node_id long"), nodes).count() == 0


def test_decisions_of_one_domain(spark):
    nodes = tree(spark, [(1, None, "IfStatement", "statement"), (2, 1, "Block", "then"), (3, 2, "ExpressionStatement", "statement"), (4, 3, "IdentifierName", "expression")])
    unit = "unit_id long, rule_id string, action string, node_id long, conflict_key string"
    units = spark.createDataFrame([(1, "r", "Delete", 4, None), (2, "r", "Delete", 3, None), (3, "r", "Replace", 4, "k"), (4, "r", "Delete", 3, "k"), (5, "x", "Delete", 4, " ")], unit)
    got = pairs(E.decide(units, nodes, {"r": ("IfStatement",)}).select("domain", "unit_id", "merged"))
    assert got == {("1", 2, 1), ("k", 3, 0), ("4", 5, 0)}
    spans = spark.createDataFrame([(1, "f", 0, 9, "Delete"), (2, "f", 2, 3, "Delete"), (3, "f", 2, 3, "Replace"), (4, "f", 0, 9, "Delete")], "decision_id long, file string, s long, e long, action string")
    assert pairs(E.without_nested(spans).select("decision_id")) == {(1,), (3,)}


def test_routes_and_counts(spark):
    builds = spark.createDataFrame([(1, 9, "Complete"), (2, 9, "Complete"), (3, 9, "Building")], "build_id long, project long, status string")
    owned = spark.createDataFrame([(1, 50, 7), (2, 60, 7), (2, 61, 8), (3, 70, 7)], "build_id long, shard_id long, node_id long")
    boundary = spark.createDataFrame([(2, 99, 7, 8)], "build_id long, shard_id long, src long, dst long")
    asked = spark.createDataFrame([(7,), (5,)], "node_id long")
    assert pairs(C.route_nodes(asked, builds, owned, boundary)) == {(7, 60), (7, 61), (7, 99)}
    key = "path string, hash string"
    known = spark.createDataFrame([("a", "h", 1), ("b", "h", 1)], key + ", refs long")
    counts = C.reference_counts(known, spark.createDataFrame([("a", "h"), ("c", "h")], key), spark.createDataFrame([("b", "h")], key))
    assert pairs(counts) == {("a", "h", 2), ("c", "h", 1)}
    assert pairs(C.unreferenced(known, counts)) == {("b", "h")}
    batches = C.boundary_batches(spark.createDataFrame([(0, 1, i, "k") for i in range(5)], "src_shard long, src long, dst long, kind string"), 2)
    assert sorted(r["count"] for r in batches.groupBy("batch").count().collect()) == [1, 2, 2]
    faults = V.sequence_faults(spark.createDataFrame([("s", 0), ("s", 1), ("s", 1), ("s", 4)], "st string, n long"), "st", "n")
    assert pairs(faults) == {("s", 1, "duplicate"), ("s", 4, "gap")}
