import pytest

from plinth.operators import calls as C
from plinth.operators import diffs as D
from plinth.operators.controlflow import control_flow
from plinth.sources import files, logs, plans

EDIT = "edit_id int, file string, s long, e long, original string, replacement string"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_folder_scan_and_target_filter(spark, tmp_path):
    for name, text in (("a.cs", "class Foo"), ("sub/b.cs", "class Bar"), ("sub/Bin/c.cs", "Foo"), ("obj/d.cs", "Foo"), ("e.txt", "Foo")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\ufeff" + text, encoding="utf-8")
    found = files.source_files(spark, str(tmp_path))
    assert pairs(found) == {("a.cs", "class Foo"), ("sub/b.cs", "class Bar")}
    assert pairs(files.mentioning(found, "Foo").select("path")) == {("a.cs",)}
    assert files.mentioning(found, "Nowhere").count() == 2


def test_effective_plans(spark):
    edits = spark.createDataFrame([(1, "a", 0, 4, "abcd", ""), (2, "a", 1, 2, "b", "x"), (3, "a", 0, 4, "abcd", "z"), (4, "a", 6, 6, "", "new"), (5, "b", 0, 3, "abc", ""), (6, "b", 2, 5, "cde", "")], EDIT)
    assert pairs(D.effective(edits).select("edit_id")) == {(1,), (4,), (5,), (6,)}
    assert pairs(D.partial_overlaps(edits).select("edit_id")) == {(6,)}


def test_plan_round_trip_and_refusals(spark, tmp_path):
    sources = spark.createDataFrame([("a.cs", "one two"), ("b.cs", "uno")], "file string, text string")
    edits = spark.createDataFrame([("a.cs", 0, 3, "one", "1"), ("a.cs", 7, 7, "", "!"), ("b.cs", 1, 2, "n", "")], "file string, s long, e long, original string, replacement string")
    path = str(tmp_path / "plan")
    plans.write(path, plans.plans(edits, sources), 2, "delete")
    rows = plans.read(spark, path)
    assert pairs(plans.edits_of(rows)) == pairs(edits)
    assert {(r.file, r.rewritten) for r in D.replay(plans.edits_of(rows), sources).collect()} == {("a.cs", "1 two!"), ("b.cs", "uo")}
    with pytest.raises(Exception):
        plans.write(path, rows, 2, "delete")
    changed = spark.createDataFrame([("a.cs", "one  two")], "file string, text string")
    assert pairs(plans.stale(rows, changed)) == {("a.cs", "source changed"), ("b.cs", "source missing")}
    assert pairs(D.problems(edits, changed)) == {("b.cs", "source missing")}
    odd = spark.createDataFrame([("/etc/x",), ("../x",), ("x",), ("x",)], "relativePath string")
    assert pairs(plans.bad_paths(odd)) == {("/etc/x", "rooted"), ("../x", "leaves the folder"), ("x", "repeated")}
    (tmp_path / "plan" / "plans" / "part-extra.json").write_text('{"relativePath":"c.cs","sourceSha256":"00","edits":[]}\n')
    with pytest.raises(ValueError):
        plans.read(spark, path)


def test_rendered_diffs(spark):
    edits = spark.createDataFrame([(1, "f", 0, 1, "a", "")], EDIT)
    assert D.render(D.sections(edits)).first().diff == "--- original #1 f:0..1\na\n+++ rewritten #1\n<deleted>\n"
    assert D.render(D.sections(edits), readable=True).first().diff == "=== file f\nedit #1 kind=Delete span=0..1\n--- before\na\n+++ after\n<deleted>\n"
    assert D.render(D.sections(edits.limit(0))).count() == 0


def test_log_profiles_and_sink(spark, tmp_path):
    assert logs.Filter.of("minimal").view == "compact" and logs.Filter.of("minimal", view="normal").view == "normal" and logs.Filter.of().categories == ("file", "phase", "memory", "io")
    cols = "ts string, level string, category string, event string, message string, run string, " + ", ".join(f"{n} string" for n in logs.OPTIONAL) + ", fields map<string,string>"
    rows = [("2", "Info", "Run", "Started", "go", "r", *[None] * 7, {"files": "1", "x": "2"}), ("1", "Debug", "Run", "Started", "no", "r", *[None] * 7, {}), ("3", "Error", "Diag", "Failed", None, "r", *[None] * 7, None)]
    logs.write(spark.createDataFrame(rows, cols), logs.Filter.of("minimal"), str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).orderBy("value").collect()]
    assert lines == ["ts=2 lvl=INFO cat=run evt=started msg=go run=r files=1", "ts=3 lvl=ERROR cat=diag evt=failed msg= run=r"]


METHOD = "method_id long, name string, signature string, type_id int, type_name string, internal boolean, original_id long, overridden_id long, is_extension boolean, property string"


def test_call_resolution(spark):
    # 1 Base.Run external, 2 Mid.Run and 3 Leaf.Run internal overrides, 4 another name
    rows = [(1, "Run", "void()", 1, "Base", False, 1, None, False, None), (2, "Run", "void()", 2, "Mid", True, 2, 1, False, None), (3, "Run", "void()", 3, "Leaf", True, 3, 2, False, None), (4, "Stop", "void()", 3, "Leaf", True, 4, None, False, None)]
    methods = spark.createDataFrame(rows, METHOD)
    bases = spark.createDataFrame([(3, 2), (3, 1), (2, 1)], "sub int, super int")
    sites = spark.createDataFrame([(10, 1, 3), (11, 1, None), (12, 2, 3), (13, 4, 2)], "site long, target_id long, receiver_id int")
    got = {(r.site, r.method_id): (r.tier, r.score, r.target_rank) for r in C.resolve(sites, methods, bases).collect()}
    assert got[(10, 3)] == (1, 1370, 2) and got[(10, 2)] == (1, 1480, 1)  # the override of the target's own definition leads
    assert got[(12, 2)] == (0, 2030, 1) and (12, 3) not in got  # the exact internal target alone
    assert {k for k in got if k[0] == 13} == {(13, 4)} and {k for k in got if k[0] == 11} == {(11, 2), (11, 3)}
    assert C.resolve(sites.limit(0), methods, bases).count() == 0


def test_nested_loops_and_an_empty_method(spark):
    op = "method_id long, op_id long, parent_id long, kind string, role string, pos long"
    # { while (c) { while (d) { break; } } return; } and { }
    rows = [(1, 1, None, "Block", "root", 1), (1, 2, 1, "While", "statement", 2), (1, 3, 2, "Expr", "condition", 3), (1, 4, 2, "Block", "body", 4), (1, 5, 4, "While", "statement", 5), (1, 6, 5, "Expr", "condition", 6), (1, 7, 5, "Block", "body", 7), (1, 8, 7, "Break", "statement", 8), (1, 9, 1, "Return", "statement", 9), (2, 20, None, "Block", "root", 1)]
    methods = spark.createDataFrame([(1, 100, 101, 102), (2, 200, 201, 202)], "method_id long, entry long, ret long, exit long")
    params = spark.createDataFrame([(2, 210, 1)], "method_id long, node long, ord long")
    got = pairs(control_flow(spark.createDataFrame(rows, op), methods, params))
    assert got == {
        (100, 2, "CfgNext"), (2, 9, "CfgNext"), (9, 101, "CfgNext"), (101, 102, "CfgNext"), (3, 4, "CfgTrue"), (4, 3, "CfgNext"), (3, 9, "CfgFalse"), (6, 7, "CfgTrue"), (7, 6, "CfgNext"),
        (8, 9, "CfgNext"),  # the outer loop adds this edge too; the inner one has no next sibling
        (200, 210, "CfgNext"), (210, 201, "CfgNext"), (201, 202, "CfgNext"),
    }
