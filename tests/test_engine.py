import pytest

from plinth.functions.tables import dense_ids
from plinth.operators import graph as G
from plinth.operators import intervals as I
from plinth.operators import rules as R
from plinth.operators.slices import INTERPROCEDURAL, Budget, search
from plinth.sources import store

DF = "DataFlow"


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_hand_graphs_of_the_budgeted_slice():
    # 1 source, 2 middle, 3 sink
    assert search([(1, 2, DF, None), (2, 3, DF, None)], 3, Budget(hops=1, paths=10, definitions=10))[:2] == ([[2, 3]], "maxHops")
    two = [(1, 3, DF, None), (2, 3, DF, None)]
    paths, reason, *_ = search(two, 3, Budget(hops=2, paths=1, definitions=10))
    assert reason == "maxPaths" and len(paths) <= 1
    assert search(two, 3, Budget(hops=2, paths=10, definitions=1))[1] == "maxDefinitions"
    paths, reason, nodes, _ = search([(1, 2, DF, None), (2, 1, DF, None), (2, 3, DF, None)], 3, Budget(hops=10, paths=10, definitions=10))
    assert paths == [] and reason is None and 1 <= nodes <= 3
    _, reason, nodes, _ = search([(1, 2, DF, None), (2, 3, DF, None)], 3, Budget(hops=4, visited_nodes=1))
    assert (reason, nodes) == ("maxVisitedNodes", 1)
    assert search(two, 3, Budget(hops=2, visited_edges=2))[1] is None
    assert search(two, 3, Budget(hops=2, visited_edges=1))[1::2] == ("maxVisitedEdges", 1)
    calls = [(1, 2, INTERPROCEDURAL, "S"), (2, 3, DF, None)]
    assert search(calls, 3, Budget(hops=4, call_depth=0))[1] == "maxCallDepth"
    assert search(calls, 3, Budget(hops=4, call_depth=4))[0] == [[1, 2, 3]]
    assert search([(1, 2, INTERPROCEDURAL, "S"), (2, 3, INTERPROCEDURAL, "S")], 3, Budget(hops=4, call_depth=4))[1] == "callStackCycle"
    with pytest.raises(ValueError):
        Budget(paths=0)


def test_dense_ids_do_not_depend_on_input_order(spark):
    rows = [(i % 7, f"n{i}") for i in range(200)]
    a = {(r.k, r.v): r.node_id for r in dense_ids(spark.createDataFrame(rows, "k int, v string"), ["k", "v"]).collect()}
    b = {(r.k, r.v): r.node_id for r in dense_ids(spark.createDataFrame(rows[::-1], "k int, v string").repartition(3), ["k", "v"]).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 201)) and [k for k, _ in sorted(a.items(), key=lambda x: x[1])] == sorted(a)


def test_walks(spark):
    e = edges(spark, (1, 2), (2, 3), (4, 5), (3, 1))
    start = spark.createDataFrame([(1,)], "node_id long")
    assert {r.node_id for r in G.reachable(e, start).collect()} == {1, 2, 3}
    assert {(r.node_id, r.depth) for r in G.distances(G.links(e), start, 1).collect()} == {(1, 0), (2, 1)}
    assert G.distances(G.links(e.limit(0)), start).count() == 1
    assert {(r.a, r.b) for r in G.closure(G.links(edges(spark, (1, 2), (2, 3)))).collect()} == {(1, 2), (2, 3), (1, 3)}


def test_dominance_of_a_branch(spark):
    e = edges(spark, (1, 2), (1, 3), (2, 4), (3, 4), (4, 5))
    d = G.dominators(e, 1)
    assert {(r.node_id, r.idom) for r in G.immediate(d).collect()} == {(2, 1), (3, 1), (4, 1), (5, 4)}
    assert {(r.control, r.dependent) for r in G.control_dependence(e, 5).collect()} == {(1, 2), (1, 3)}


def test_reaching_definitions_over_a_loop(spark):
    flow = edges(spark, (1, 2), (2, 3), (3, 2), (3, 4))
    defs = spark.createDataFrame([(1, "x"), (3, "x")], "node_id long, var string")
    assert {(r.node_id, r.def_id) for r in G.reaching_definitions(flow, defs).collect()} == {(2, 1), (3, 1), (2, 3), (3, 3), (4, 3)}


def reached_one_by_one(flow, defs):
    """(node, definition, variable) by a walk from each definition, the plain way."""
    out = set()
    for begin, var in defs:
        todo = [begin]
        while todo:
            at = todo.pop()
            for s, d in flow:
                if s == at and (d, begin, var) not in out:
                    out.add((d, begin, var))
                    if var is None or (d, var) not in defs:
                        todo.append(d)
    return out


@pytest.mark.parametrize("shared", [False, True])
def test_reaching_definitions_of_several_methods(spark, shared):
    import random

    rnd = random.Random(5)
    flow, defs, members = [], [(None, 901, "a"), (7, 902, "a")], [(None, 900), (None, 901), (7, 902)]
    for scope in range(1, 7):  # nodes 10, 20, ... of the last two methods may be the same
        base = scope * 100 - (100 if shared and scope == 6 else 0)
        flow += [(scope, base + rnd.randrange(12), base + rnd.randrange(12)) for _ in range(16)]
        defs += [(scope, base + rnd.randrange(14), rnd.choice(["a", "b", None])) for _ in range(7)]
        members += [(scope, base + i) for i in range(14)]
    flow, defs = flow + flow[:5], defs + defs[:5]
    f = spark.createDataFrame(flow, "scope long, src long, dst long")
    d = spark.createDataFrame(defs, "scope long, node_id long, var string")
    want = sorted(reached_one_by_one({x[1:] for x in flow}, {x[1:] for x in defs}), key=str)
    assert len(want) > 50 and {v for _, _, v in want} == {"a", "b", None}
    for got in (G.reaching_definitions(f, d, spark.createDataFrame(members, "scope long, node_id long")), G.reaching_definitions(f.drop("scope"), d.drop("scope"))):
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert G.reaching_definitions(f, d.limit(0), spark.createDataFrame(members, "scope long, node_id long")).count() == 0


def test_methods_that_come_in_several_batches(spark):
    import pyarrow as pa

    scopes = [None, None, 1, 1, 1, 1, 1, 2, 3, 3, 3, 4]
    rows = pa.table({"scope": pa.array(scopes, pa.int64()), "a": pa.array(range(12)), "b": pa.array(range(12)), "var": pa.array(["x"] * 12)})
    for size in range(1, 13):
        got = [[scopes[i] for i in t["a"].to_pylist()] for t in G.whole_scopes(rows.to_batches(max_chunksize=size))]
        assert [x for part in got for x in part] == scopes and all(not set(p) & set(q) for p, q in zip(got, got[1:], strict=False))


def test_reaching_definitions_are_not_written_again_each_round(spark, tmp_path):
    import datetime
    from pathlib import Path

    import __spark_entry__ as entry
    from plinth.functions.tables import cut

    kinds = ["signup", "view", "error", "click", "purchase", "view"]
    begin = datetime.datetime(2024, 1, 1)
    events = [(i, begin + datetime.timedelta(minutes=i), i % 5, kinds[i * 7 % 31 % 6], f'{{"k": {i * 13 % 47}}}') for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    cut(spark.range(1))
    held = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(p.stat().st_size for p in held.rglob("part-*"))
    before = written()
    rows = entry.queries()["reaching_defs_branching"](spark, str(tmp_path)).count()
    assert rows > 500 and written() - before < 100 * rows


def test_intervals_against_brute_force(spark):
    import random

    rng = random.Random(3)
    spans = [(rng.randint(0, 2), i, s := rng.randint(0, 300), s + rng.choice([0, 1, 3, 17, 64, 200])) for i in range(150)]
    df = spark.createDataFrame(spans, "file int, key long, s long, e long")
    outer = df.selectExpr("file", "key as ok", "s as os", "e as oe")
    got = {(r.key, r.ok) for r in I.containment(df, outer).collect()}
    assert got == {(a[1], b[1]) for a in spans for b in spans if a[0] == b[0] and b[2] <= a[2] and a[3] <= b[3]}
    held = {a[1] for a in spans for b in spans if a[0] == b[0] and a[1] != b[1] and b[2] <= a[2] and a[3] <= b[3] and (b[3] - b[2] > a[3] - a[2] or b[1] < a[1])}
    assert {r.key for r in I.covered(df, "key").collect()} == held


def test_rules(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "file int, text string")
    edits = spark.createDataFrame([(1, 6, 11, "there"), (1, 0, 1, "J")], "file int, s int, e int, replacement string")
    assert {r.file: r.rewritten for r in R.apply_edits(texts, edits).collect()} == {1: "Jello there", 2: "", 3: None}
    assert R.capabilities({"ControlDependence"}) == {"ControlDependence", "Dominance", "Cfg", "SyntaxSemantic"}
    with pytest.raises(ValueError):
        R.capabilities({"Other"})


def test_store_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(1, 50)], "node_id long, kind string")
    e = spark.createDataFrame([(i, i + 1, "next") for i in range(1, 49)], "src long, dst long, kind string")
    path = str(tmp_path / "store")
    store.write(path, nodes, e, 4)
    n2, e2 = store.read(spark, path)
    assert n2.select(nodes.columns).exceptAll(nodes).isEmpty() and e2.select(e.columns).exceptAll(e).isEmpty() and n2.count() == 49
    assert store.validate(spark, path).isEmpty()
    assert [r.src for r in store.incoming_projection(spark, path, 4, 9, ["next"], 5).collect()] == [8]
    with pytest.raises(Exception, match="exists"):
        store.write(path, nodes, e, 4)


def test_incremental_adds_only_what_is_new(spark, tmp_path):
    from plinth.streaming.incremental import ingest

    def add(n, rows):
        spark.createDataFrame(rows, "path string, fingerprint string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, fingerprint string").parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n

    add(2, [("a", "1"), ("b", "1"), ("a", "1")])
    add(3, [("a", "1"), ("b", "2")])


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 50
