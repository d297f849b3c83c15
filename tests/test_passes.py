import random

import pytest

from plinth.operators import checks, graph, passes, slices
from plinth.sources import store


def test_definitions_are_cut_as_soon_as_they_are_reached():
    paths, reason, _, _ = slices.search([(2, 1, "DataFlow", None)], 1, slices.Budget(definitions=1))
    assert paths == [[2, 1]] and reason == "maxDefinitions"
    paths, reason, _, _ = slices.search([(2, 1, "DataFlow", None), (3, 1, "DataFlow", None)], 1, slices.Budget(definitions=1))
    assert paths == [[2, 1]] and reason == "maxDefinitions"


def test_a_loop_on_itself_depends_on_nothing(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    assert graph.control_dependence(edges, 2).collect() == []
    edges = spark.createDataFrame([(1, 2), (2, 2), (2, 3), (1, 3), (3, 4), (4, 3), (3, 5)], "src long, dst long")
    assert {tuple(r) for r in graph.control_dependence(edges, 5).collect()} == {(1, 2), (3, 3), (3, 4)}  # a loop holds its own head


def test_without_an_entry_nothing_is_unreachable(spark):
    nodes, calls = spark.createDataFrame([(1,), (2,), (3,)], "node_id long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    assert graph.unreached(nodes, calls, nodes.limit(0)).count() == 0
    assert [r.node_id for r in graph.unreached(nodes, calls, nodes.filter("node_id = 1")).collect()] == [3]


def test_dominators_of_methods_with_loops(spark):
    rng = random.Random(3)
    edges, roots, members = [], [], []
    for scope in range(12):
        ids = [scope * 100 + i for i in range(rng.randint(2, 12))]
        roots.append((scope, ids[0]))
        members += [(scope, i) for i in ids]
        edges += [(rng.choice(ids), rng.choice(ids)) for _ in range(2 * len(ids))]
    e, r, m = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(roots, "scope long, node_id long"), spark.createDataFrame(members, "scope long, node_id long")
    by_tree = {tuple(x) for x in graph.dominators(e, r, m).collect()}
    assert by_tree == {tuple(x) for x in graph.dominators_by_removal(e, r, m).collect()}
    steps: dict = {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)

    def reach(root, gone):
        seen, todo = set(), [root] if root != gone else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in steps.get(x, ()) if y != gone]
        return seen

    want = set()
    for scope, root in roots:
        live = reach(root, None)
        mine = [i for s, i in members if s == scope]
        want |= {(n, d) for n in mine for d in mine if n == d or (n in live and d in live and n not in reach(root, d))}
    assert by_tree == want


def test_a_damaged_edge_file_is_found(spark, tmp_path):
    nodes = spark.createDataFrame([(i, "a") for i in range(20)], "node_id long, kind string")
    edges = spark.createDataFrame([(i, i + 1, "e") for i in range(19)], "src long, dst long, kind string")
    path = str(tmp_path / "store")
    store.write(path, nodes, edges, 4)
    assert store.validate(spark, path).count() == 0
    spark.createDataFrame([(99, 4, "e")], "src long, dst long, kind string").coalesce(1).write.mode("append").parquet(f"{path}/edges/shard=0")
    assert [(r.part, r.shard) for r in store.validate(spark, path).collect()] == [("edges", 0)]


def test_anchors_are_one_or_an_error(spark):
    nodes = spark.createDataFrame([(1, "a", "x.a"), (2, "a", "x.b"), (3, "c", None)], "node_id long, name string, full_name string")
    assert checks.resolve_anchor(nodes, full_name="x.b") == 2 and checks.resolve_anchor(nodes, node_id=3) == 3
    for bad in ({"name": "a"}, {"name": "z"}, {"node_id": 9}):
        with pytest.raises(LookupError):
            checks.resolve_anchor(nodes, **bad)
    for bad in ({}, {"name": "a", "node_id": 1}, {"node_id": -1}):
        with pytest.raises(ValueError):
            checks.resolve_anchor(nodes, **bad)
    marks, allowed = spark.createDataFrame([("R", "k")], "rule_id string, kind string"), spark.createDataFrame([("R", "j")], "rule_id string, kind string")
    with pytest.raises(ValueError):
        checks.require_allowed(marks, allowed)
    assert checks.require_allowed(marks, marks).count() == 1


def test_texts_and_numbers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("7", "a\r\n  b\rc ", ["x", "q", "z"]), ("-1", "l" * 130, []), ("no", "", None)], "n string, t string, f array<string>")
    rows = df.select(checks.positive_or(F.col("n"), 5).alias("n"), checks.one_line(F.col("t")).alias("t"), checks.flags(F.col("f"), ["x", "y", "z"]).alias("f"), checks.fnv1a32(F.col("n")).alias("h")).collect()
    assert [r.n for r in rows] == [7, 5, 5] and rows[0].t == "a b c" and rows[1].t == "l" * 117 + "..." and [r.f for r in rows] == [5, 0, None]
    h = 2166136261
    h = ((h ^ ord("7")) * 16777619) % 2**32
    assert rows[0].h == h


def test_arguments_move_by_one_for_an_extension(spark):
    calls = spark.createDataFrame([("c1", "s1", "m", True, "i1", "r"), ("c2", "s2", "m", False, "i2", "r")], "call string, site string, method string, extension boolean, instance string, ret string")
    args = spark.createDataFrame([("c1", 0, "a"), ("c2", 0, "b"), ("c2", 1, None), ("c2", 7, "z")], "call string, ordinal int, value string")
    params = spark.createDataFrame([("m", 0, "p0"), ("m", 1, "p1")], "method string, ordinal int, node string")
    got = {(r.src, r.dst) for r in passes.argument_flow(calls, args, params).filter("kind = 'DataFlow'").collect()}
    assert got == {("i1", "p0"), ("a", "p1"), ("b", "p0"), ("r", "s1"), ("r", "s2")}
