import random
from collections import OrderedDict

import pytest

from plinth.operators import class_rules as C
from plinth.sources import catalog, files


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_files_are_written_whole_below_the_root(spark, tmp_path):
    rows = spark.createDataFrame([("a.b.cs", "é\n"), ("sub/c.cs", ""), ("sub/d", None)], "path string, text string")
    files.write_files(rows, str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a.b.cs": "é\n", "sub/c.cs": "", "sub/d": ""}
    files.write_diffs(rows, str(tmp_path / "diffs"))
    assert {str(p.relative_to(tmp_path / "diffs")) for p in (tmp_path / "diffs").rglob("*") if p.is_file()} == {"a.b.rewrite.diff", "sub/c.rewrite.diff", "sub/d.rewrite.diff"}
    with pytest.raises(PermissionError):
        files.write_back(rows, str(tmp_path / "out"))
    files.write_back(rows.selectExpr("path", "'new' as text"), str(tmp_path / "out"), allowed=True)
    assert (tmp_path / "out" / "a.b.cs").read_text() == "new"
    for path in ("../x", "/x", "a//b", "", None):
        with pytest.raises(ValueError, match="below the root"):
            files.write_files(spark.createDataFrame([(path, "")], "path string, text string"), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="repeats"):
        files.write_files(rows.unionByName(rows), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


@pytest.mark.parametrize("budget", [0, 7, 20, 1000])
def test_cache_replay_is_a_plain_cache(spark, budget):
    draw, rows, want = random.Random(5), [], set()
    for stream in range(5):
        held, told = OrderedDict(), [0, 0, 0, 0, 0]
        for at in range(200 if stream else 1):
            shard = draw.randrange(12)
            rows.append((stream, at, shard, shard + 1))
            told[0] += 1
            if shard in held:
                told[1] += 1
                held.move_to_end(shard)
                continue
            told[2] += 1
            told[3] += shard + 1
            if budget and shard + 1 <= budget:
                while sum(held.values()) + shard + 1 > budget:
                    held.popitem(last=False)
                    told[4] += 1
                held[shard] = shard + 1
        want.add((stream, *told))
    draw.shuffle(rows)
    reads = spark.createDataFrame(rows, "stream long, at long, shard_id long, bytes long")
    assert pairs(catalog.cache_replay(reads, budget)) == want
    assert catalog.cache_replay(reads.limit(0), budget).count() == 0


def test_deletes_of_a_class_leave_types_and_hosts_to_their_rules(spark):
    kinds = {1: "IdentifierName", 2: "InvocationExpression", 3: "ReturnStatement", 4: "FieldDeclaration", 5: "LocalDeclarationStatement", 6: "IfStatement", 7: "ExpressionStatement"}
    nodes = spark.createDataFrame([(i, None, kind, None, "f", 10 * i, 10 * i + 5) for i, kind in kinds.items()], "node_id long, parent_id long, kind string, role string, file string, s long, e long")
    seeds = spark.createDataFrame([(1,), (2,)], "node_id long")
    propagated = spark.createDataFrame([(4, 1, False)], "node_id long, source long, plain boolean")
    lifted = spark.createDataFrame([(3, 2), (5, 1), (6, 2), (7, 4)], "node_id long, source long")
    hosts = spark.createDataFrame([(4,)], "node_id long")
    assert {(r.rule_id, r.node_id) for r in C.class_deletes(seeds, propagated, lifted, nodes, hosts).collect()} == {(C.CONTROL_RULE, 3), (C.DEFAULT_RULE, 2)}


def test_lifts_of_a_class(spark):
    nodes = spark.createDataFrame(
        [(1, None, "IfStatement", "statement", "f", 0, 20), (2, 1, "InvocationExpression", "condition", "f", 4, 9), (3, None, "ExpressionStatement", "statement", "f", 30, 40), (4, 3, "InvocationExpression", "expression", "f", 30, 39)],
        "node_id long, parent_id long, kind string, role string, file string, s long, e long")
    marked = spark.createDataFrame([(2, C.EXPRESSION_MARK), (4, C.EXPRESSION_MARK)], "node_id long, rule_id string")
    assert {(r.node_id, r.rule_id) for r in C.class_lifts(marked.select("node_id"), marked, nodes).collect()} == {(1, C.HOST_LIFT), (3, C.HOST_LIFT)}
