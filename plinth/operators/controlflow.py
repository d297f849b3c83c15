"""Control-flow edges from operation trees.

ops(method_id, op_id, parent_id, kind, role, pos): one row an operation; parent_id is null for the root block of a
method, pos is document order.  Kinds that matter: Block, If, While, For, Loop, Switch, Case, DefaultCase, Try, Catch,
Return, Break, Continue.  Roles that matter: condition, true, false, body, before, value, finally, handler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.tables import cut

NEXT, TRUE, FALSE = "CfgNext", "CfgTrue", "CfgFalse"
_STOPS = ("Return", "Break", "Continue")
_CASES = ("Case", "DefaultCase")


def _edge(rows: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind")).filter("src is not null and dst is not null")


def climb(ops: DataFrame, starts: DataFrame) -> DataFrame:
    """(op_id, up, via_role): every ancestor of the starts and the role of the child through which it is met; a round
    for each level of nesting."""
    links = cut(ops.select(F.col("op_id").alias("_c"), F.col("parent_id").alias("_p"), F.col("role").alias("_r")))
    step = starts.select("op_id", F.col("op_id").alias("_at"))
    out = None
    while True:
        level = cut(step.join(links, F.col("_at") == F.col("_c")).filter("_p is not null").select("op_id", F.col("_p").alias("up"), F.col("_r").alias("via_role")))
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out
        step = level.select("op_id", F.col("up").alias("_at"))


def _leaves(ops: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, op_id, kind, pos): what stands in a root when blocks inside blocks are opened."""
    below = cut(ops.select(F.col("parent_id").alias("_p"), "op_id", "kind", "pos"))
    at = cut(roots.select("root", F.col("root").alias("op_id")).join(ops.select("op_id", "kind", "pos"), "op_id"))
    out = at.filter("kind <> 'Block'")
    while True:
        at = cut(at.filter("kind = 'Block'").select("root", F.col("op_id").alias("_p")).join(below, "_p").drop("_p"))
        if at.isEmpty():
            return out
        out = out.unionByName(at.filter("kind <> 'Block'"))


def control_flow(ops: DataFrame, methods: DataFrame, params: DataFrame) -> DataFrame:
    """(src, dst, kind) for methods(method_id, entry, ret, exit) with params(method_id, node, ord).

    Only blocks that hang on the root by blocks alone run in sequence; branches, loops, switches and tries join their
    parts to each other and to the next statement of the block they stand in, if there is one.
    """
    ops = cut(ops.select("method_id", "op_id", "parent_id", "kind", "role", "pos"))
    kind_of = ops.select(F.col("op_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    child = ops.join(kind_of, "parent_id", "left")
    in_block = child.filter("parent_kind = 'Block'")
    nxt = cut(in_block.withColumn("next_id", F.lead("op_id").over(Window.partitionBy("parent_id").orderBy("pos"))).select("op_id", "parent_id", "kind", "next_id"))
    after = nxt.select("op_id", "next_id")
    first = in_block.groupBy(F.col("parent_id").alias("op_id")).agg(F.min_by("op_id", "pos").alias("first_id"))
    entry = cut(ops.join(first, "op_id", "left").select("op_id", F.when(F.col("kind") == "Block", F.col("first_id")).otherwise(F.col("op_id")).alias("entry_id")))

    def of(kind: str) -> DataFrame:
        return ops.filter(F.col("kind") == kind)

    def part(role: str) -> DataFrame:
        """The child of a role; of several the last."""
        return child.filter(F.col("role") == role).groupBy(F.col("parent_id").alias("op_id")).agg(F.max_by("op_id", "pos").alias(role))

    out = []

    # methods
    last_param = Window.partitionBy("method_id").orderBy("ord")
    p = params.withColumn("next_id", F.lead("node").over(last_param))
    ends = params.groupBy("method_id").agg(F.min_by("node", "ord").alias("p1"), F.max_by("node", "ord").alias("pn"))
    root = ops.filter("parent_id is null and kind = 'Block'").select("method_id", "op_id").join(entry, "op_id")
    m = methods.join(ends, "method_id", "left").join(root.select("method_id", F.col("op_id").alias("root"), "entry_id"), "method_id", "left")
    m = m.withColumn("_start", F.coalesce("entry_id", "ret")).withColumn("_from", F.coalesce("pn", "entry"))
    out += [_edge(p, "node", "next_id", NEXT), _edge(m, "entry", "p1", NEXT), _edge(m, "_from", "_start", NEXT), _edge(m, "ret", "exit", NEXT)]
    returns = of("Return").select("method_id", "op_id")
    out.append(_edge(returns.join(methods, "method_id"), "op_id", "ret", NEXT))
    tail = nxt.filter(F.col("next_id").isNull() & ~F.col("kind").isin(*_STOPS)).select(F.col("parent_id").alias("root"), "op_id")
    falls = m.join(returns.select("method_id").distinct(), "method_id", "left_anti").select("root", "ret").join(tail, "root")
    out.append(_edge(falls, "op_id", "ret", NEXT))

    # sequences: blocks under blocks
    chain = cut(root.select("op_id"))
    blocks = chain
    nested = cut(in_block.filter("kind = 'Block'").select("op_id", "parent_id"))
    while not blocks.isEmpty():
        blocks = cut(nested.join(blocks.select(F.col("op_id").alias("parent_id")), "parent_id").select("op_id"))
        chain = chain.unionByName(blocks)
    flows = nxt.filter(~F.col("kind").isin(*_STOPS)).join(chain.select(F.col("op_id").alias("parent_id")), "parent_id", "left_semi")
    out.append(_edge(flows, "op_id", "next_id", NEXT))

    # branches and loops
    test = part("condition")
    branch = of("If").join(test, "op_id").join(part("true"), "op_id", "left").join(part("false"), "op_id", "left")
    out += [_edge(branch, "condition", "true", TRUE), _edge(branch, "condition", "false", FALSE)]
    loops = ops.filter(F.col("kind").isin("While", "For")).join(test, "op_id", "left").join(part("before"), "op_id", "left").join(after, "op_id", "left")
    loops = loops.withColumn("test", F.coalesce("condition", F.when(F.col("kind") == "For", F.col("before")))).join(part("body"), "op_id", "left")
    closed = loops.filter("test is not null and body is not null")
    out += [_edge(closed, "test", "body", TRUE), _edge(closed, "body", "test", NEXT), _edge(closed, "test", "next_id", FALSE)]

    # jumps: every loop around one adds an edge
    ups = cut(climb(ops, ops.filter(F.col("kind").isin(*_STOPS))))
    jump = ups.join(ops.select("op_id", F.col("kind").alias("jump")), "op_id")
    targets = loops.select(F.col("op_id").alias("up"), "test", "next_id").unionByName(of("Loop").join(after, "op_id", "left").select(F.col("op_id").alias("up"), F.lit(None).cast("long").alias("test"), "next_id"))
    inside = jump.filter("via_role = 'body'").join(targets, "up")
    out += [_edge(inside.filter("jump = 'Continue'"), "op_id", "test", NEXT), _edge(inside.filter("jump = 'Break'"), "op_id", "next_id", NEXT)]

    # what the parts of switches and tries begin and end with
    stmts = child.filter(F.col("parent_kind").isin(*_CASES))
    parts = child.filter(F.col("parent_kind").isin("Try", "Catch") & F.col("role").isin("body", "finally", "handler"))
    leaves = _leaves(ops, stmts.select(F.col("op_id").alias("root")).unionByName(parts.select(F.col("op_id").alias("root"))))
    leaf_of = ops.select(F.col("op_id").alias("root"), F.col("parent_id").alias("owner"), "role")
    ending = leaves.join(leaf_of, "root")
    last = F.max_by(F.struct("op_id", "kind"), "pos").alias("_last")

    def ends_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("owner").agg(last).select("owner", F.col("_last.op_id").alias("last_id"), F.col("_last.kind").isin(*_STOPS).alias("stops"))

    # switches
    heads = stmts.join(entry, "op_id").filter("entry_id is not null").groupBy(F.col("parent_id").alias("op_id")).agg(F.min_by("entry_id", "pos").alias("head"))
    case_of = ops.filter(F.col("kind").isin(*_CASES)).select("op_id", F.col("parent_id").alias("switch"), "kind", "pos").join(heads, "op_id", "left")
    case_of = case_of.join(ends_of(ending).withColumnRenamed("owner", "op_id"), "op_id", "left")
    case_of = case_of.join(after.select(F.col("op_id").alias("switch"), "next_id"), "switch", "left").join(part("value").withColumnRenamed("op_id", "switch"), "switch")
    w = Window.partitionBy("switch").orderBy("pos")
    case_of = case_of.withColumn("goes", F.coalesce(F.first("head", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("next_id")))
    case_of = cut(case_of.withColumn("then", F.coalesce(F.lead("goes").over(w), F.col("next_id"))))
    bare = case_of.groupBy("switch", "value", "next_id").agg(F.max(((F.col("kind") == "DefaultCase") & F.col("goes").isNotNull()).cast("int")).alias("d")).filter("d = 0")
    empty = of("Switch").join(case_of.select(F.col("switch").alias("op_id")), "op_id", "left_anti").join(part("value"), "op_id").join(after, "op_id")
    out += [_edge(case_of, "value", "goes", TRUE), _edge(bare, "value", "next_id", FALSE), _edge(empty, "value", "next_id", FALSE), _edge(case_of.filter("not stops"), "last_id", "then", NEXT)]
    breaks = jump.filter("jump = 'Break'").join(case_of.select(F.col("op_id").alias("up"), "next_id"), "up")
    out.append(_edge(breaks, "op_id", "next_id", NEXT))

    # tries
    heads_of = parts.join(entry, "op_id").select(F.col("parent_id").alias("owner"), "role", "entry_id")

    def ends_in(role: str) -> DataFrame:
        h = heads_of.filter(F.col("role") == role).select("owner", F.col("entry_id").alias(f"{role}_head"))
        e = ends_of(ending.filter(F.col("role") == role)).select("owner", F.col("last_id").alias(f"{role}_last"), F.col("stops").alias(f"{role}_stops"))
        return h.join(e, "owner", "left").withColumnRenamed("owner", "op_id")

    tries = of("Try").select("op_id").join(ends_in("body"), "op_id", "left").join(ends_in("finally"), "op_id", "left").join(after, "op_id", "left")
    tries = cut(tries.withColumn("_enter", F.coalesce("body_head", "finally_head")).withColumn("_leave", F.coalesce("finally_head", "next_id")).withColumn("_final", F.when(~F.col("finally_stops"), F.col("finally_last")).otherwise(F.col("finally_head"))))
    out += [_edge(tries, "op_id", "_enter", NEXT), _edge(tries.filter("not body_stops"), "body_last", "_leave", NEXT), _edge(tries, "_final", "next_id", NEXT)]
    caught = of("Catch").select("op_id", F.col("parent_id").alias("try_id")).join(ends_in("handler"), "op_id").drop("op_id").join(tries.withColumnRenamed("op_id", "try_id"), "try_id")
    out += [_edge(caught, "body_head", "handler_head", FALSE), _edge(caught, "handler_head", "finally_head", NEXT), _edge(caught.filter("not handler_stops and handler_last <> handler_head"), "handler_last", "_leave", NEXT)]
    left = jump.filter("jump = 'Return' and via_role <> 'finally'").join(tries.select(F.col("op_id").alias("up"), "finally_head"), "up")
    out.append(_edge(left, "op_id", "finally_head", NEXT))

    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()
