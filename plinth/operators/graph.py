"""Graph questions over nodes(node_id, kind, ...) and edges(src, dst, kind, ...), as joins and frontier loops."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plinth.functions.tables import cut, workers_import


@dataclass(frozen=True)
class Graph:
    """An immutable graph; edges are a set."""

    nodes: DataFrame
    edges: DataFrame

    def of_kind(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind)

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds)) if kinds else self.edges

    def outgoing(self, ids: DataFrame, *kinds: str) -> DataFrame:
        """Edges that leave the given ids (column node_id); an unknown id has none."""
        return self.edges_of(*kinds).join(ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")

    def incoming(self, ids: DataFrame, *kinds: str) -> DataFrame:
        return self.edges_of(*kinds).join(ids.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")

    def stats(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def integrity(self) -> DataFrame:
        """One row: repeated node ids, edges with an unknown source, edges with an unknown target."""
        ids = self.nodes.select("node_id")
        repeated = ids.groupBy("node_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_ids"))
        src = self.edges.join(ids, F.col("src") == F.col("node_id"), "left_anti").agg(F.count(F.lit(1)).alias("unknown_src"))
        dst = self.edges.join(ids, F.col("dst") == F.col("node_id"), "left_anti").agg(F.count(F.lit(1)).alias("unknown_dst"))
        return repeated.crossJoin(src).crossJoin(dst)  # three single rows

    def induced(self, ids: DataFrame, *kinds: str) -> DataFrame:
        """Edges with both ends among the ids."""
        chosen = ids.select("node_id").distinct()
        return self.edges_of(*kinds).join(chosen.withColumnRenamed("node_id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("node_id", "dst"), "dst", "left_semi")

    def local_view(self, anchors: DataFrame, hops: int, direction: str = "both", kinds: tuple[str, ...] = ()) -> DataFrame:
        """(node_id, depth) of all nodes within ``hops`` of an anchor."""
        if hops < 0:
            raise ValueError("hops must not be negative")
        return distances(links(self.edges_of(*kinds), direction), anchors, hops)


def links(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(a, b) steps a walk can take: along edges, against them or both."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def distances(steps: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(node_id, depth): breadth-first levels from ``starts``.  Each round joins the frontier alone with the steps and
    takes away what was seen; it ends with an empty frontier, or after ``limit`` rounds."""
    frontier = cut(starts.select("node_id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    steps = cut(steps)
    depth = 0
    while limit is None or depth < limit:
        depth += 1
        nxt = frontier.join(steps, F.col("node_id") == F.col("a")).select(F.col("b").alias("node_id")).distinct()
        frontier = cut(nxt.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 5 == 0:
            seen = cut(seen)
    return seen


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return distances(links(edges), starts).select("node_id")


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, direction: str = "both") -> DataFrame:
    """(node_id, length) for each end that can be reached: steps from the nearest start; 0 where the sets meet."""
    return distances(links(edges, direction), starts).join(ends.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.col("depth").alias("length"))


def closure(steps: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b) for every non-empty walk: pairs double their length each round until no pair is new."""
    known = cut(steps.select("a", "b").distinct())
    for _ in range(rounds):
        more = known.select(F.col("a").alias("m"), F.col("b").alias("c"))
        longer = known.join(more, F.col("b") == F.col("m")).select("a", F.col("c").alias("b"))
        new = longer.distinct().join(known, ["a", "b"], "left_anti")
        if (new := cut(new)).isEmpty():
            break
        known = cut(known.unionByName(new))
    return known


def unreached(candidates: DataFrame, calls: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates that no root reaches over ``calls``; without a root nothing can be told, and none is given."""
    some = roots.select(F.lit(1).alias("_one")).limit(1)
    told = candidates.withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one", "left_semi").drop("_one")
    return told.join(reachable(calls, roots), "node_id", "left_anti")


def unreferenced(candidates: DataFrame, calls: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates that no root reaches over ``calls`` (src, dst); calls of oneself keep nothing alive."""
    live = reachable(calls.filter("src <> dst"), roots)
    return candidates.join(live, "node_id", "left_anti")


def cross_shard(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges whose ends have different owners; a node without an owner belongs to the skeleton (null)."""
    a = owners.select(F.col("node_id").alias("src"), F.col("shard").alias("src_shard"))
    b = owners.select(F.col("node_id").alias("dst"), F.col("shard").alias("dst_shard"))
    return edges.join(a, "src", "left").join(b, "dst", "left").filter(~F.col("src_shard").eqNullSafe(F.col("dst_shard")))


def next_edges(ops: DataFrame, block: str, order: str, node: str, stops: str) -> DataFrame:
    """Edges op -> next op of a block, but not after an operation that stops the flow."""
    w = Window.partitionBy(block).orderBy(order)
    return ops.select(block, F.col(node).alias("src"), F.lead(node).over(w).alias("dst"), F.col(stops).alias("_stop")).filter("dst is not null and not _stop").drop("_stop")


def definition_walks(table: pa.Table, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(node_id, def_id, var) of whole flow graphs: rows (a, b) are steps, rows (a, null, var) definitions.  Each
    definition walks alone until its variable is defined again, so that no more is held than the steps, what one
    definition reaches and ``size`` rows of the result.  A null variable is never defined again."""
    is_step = pc.is_valid(table["b"])
    made = table.select(["a", "var"]).filter(pc.invert(is_step))
    steps = table.select(["a", "b"]).filter(is_step)
    del table, is_step
    if not made.num_rows or not steps.num_rows:
        return
    src, dst = steps["a"].to_numpy(), steps["b"].to_numpy()
    del steps
    ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
    src, dst = np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)
    dst = dst[np.argsort(src, kind="stable")]
    many = np.bincount(src, minlength=len(ids)).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(many)])
    # the only step from a node, or -1
    only = memoryview(np.where(many == 1, dst[np.minimum(first[:-1], len(dst) - 1)], np.int32(-1)))
    to, first = memoryview(dst), memoryview(first)
    del src, dst, many
    kinds = made["var"].combine_chunks().dictionary_encode()
    var = pc.fill_null(kinds.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    places = np.minimum(np.searchsorted(ids, made["a"].to_numpy()), len(ids) - 1)
    inside = ids[places] == made["a"].to_numpy()  # a definition outside of the flow goes nowhere
    keys = np.unique((var[inside] + 1) * len(ids) + places[inside])
    if not len(keys):
        return
    var, places = keys // len(ids) - 1, keys % len(ids)
    begins = np.flatnonzero(np.diff(var, prepend=-2))
    del inside, keys

    def batch() -> pa.RecordBatch:
        what = np.repeat(np.array(vars_, np.int64), counts)
        values = kinds.dictionary.take(pa.array(what, mask=what < 0))
        return pa.RecordBatch.from_arrays([pa.array(ids[np.array(nodes, np.int64)]), pa.array(np.repeat(ids[np.array(whence, np.int64)], counts)), values], ["node_id", "def_id", "var"])

    nodes: list[int] = []
    whence, vars_, counts = [], [], []
    for v, group in zip(var[begins].tolist(), np.split(places, begins[1:]), strict=True):
        starts = group.tolist()
        ends = set(starts) if v >= 0 else set()
        for start in starts:
            seen, todo = set(), [start]
            while todo:
                x = todo.pop()
                while (y := only[x]) >= 0 and y not in seen:
                    seen.add(y)
                    if y in ends:
                        break
                    x = y
                if y < 0:
                    for y in to[first[x] : first[x + 1]]:
                        if y not in seen:
                            seen.add(y)
                            if y not in ends:
                                todo.append(y)
            nodes.extend(seen)
            whence.append(start)
            vars_.append(v)
            counts.append(len(seen))
            if len(nodes) >= size:
                yield batch()
                nodes, whence, vars_, counts = [], [], [], []
    if nodes:
        yield batch()


def whole_scopes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows (a, b, var) of batches that are sorted by scope, in tables that end where a scope ends; none is kept
    here once it is given."""
    held: list[pa.RecordBatch] = []
    at = None

    def given() -> pa.Table:
        table = pa.Table.from_batches(held)
        held.clear()
        return table

    for batch in batches:
        if not batch.num_rows:
            continue
        scope, rows = batch.column("scope"), batch.select(["a", "b", "var"])
        last = scope[-1]
        done = batch.num_rows - (pc.sum(pc.equal(scope, last)).as_py() if last.is_valid else scope.null_count)
        if done or (held and at != last.as_py()):
            held.append(rows.slice(0, done))
            yield given()
        held.append(rows.slice(done))
        at = last.as_py()
    if held:
        yield given()


def reaching_definitions(flow: DataFrame, defs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(node_id, def_id, var): definitions that hold on entry of a node.

    flow(src, dst) and defs(node_id, var); a definition lives until a node that defines the same variable.  With
    members(scope, node_id), flow and defs name their scope too, the method they are in: one shuffle by scope, and in
    each every definition walks as far as it lives.  A task holds the flow of the method it is at, never the result.
    Methods that share a node are one flow and go by rounds, as does a flow without members, whose size nothing bounds.
    """
    if members is None:
        return reaching_by_rounds(flow, defs)
    shared = cut(members.groupBy("node_id").agg(F.min("scope").alias("a"), F.max("scope").alias("b")).filter("a <> b").select("node_id"))
    together = None
    if not shared.isEmpty():
        joined = cut(members.join(shared, "node_id", "left_semi").select("scope").distinct())
        together = reaching_by_rounds(flow.join(joined, "scope", "left_semi"), defs.join(joined, "scope", "left_semi"))
        flow, defs = flow.join(joined, "scope", "left_anti"), defs.join(joined, "scope", "left_anti")
    workers_import(flow.sparkSession)
    kind = defs.schema["var"].dataType
    none = F.lit(None)
    steps = flow.filter("src is not null and dst is not null").select("scope", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), none.cast(kind).alias("var"))
    made = defs.filter("node_id is not null").select("scope", F.col("node_id").cast("long").alias("a"), none.cast("long").alias("b"), "var")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chain.from_iterable(map(definition_walks, whole_scopes(batches)))

    # by a hash of its own: a shuffle by scope is left out if both sides of a union come dealt by scope, even where Spark
    # then plans their joins anew and one scope's rows lie in two partitions
    rows = steps.unionByName(made).repartition(F.xxhash64("scope")).sortWithinPartitions("scope")
    alone = rows.mapInArrow(run, StructType([StructField("node_id", LongType()), StructField("def_id", LongType()), StructField("var", kind)]))
    return alone if together is None else alone.unionByName(together)


def reaching_by_rounds(flow: DataFrame, defs: DataFrame) -> DataFrame:
    """``reaching_definitions`` without a method in one task.  Semi-naive: only pairs new in a round go on, and only they
    are written; what is known lies in parts, and a part is written again once the later ones are half its size.  Each
    round still shuffles all that is known, as often as the flow is deep."""
    kills = defs.select(F.col("node_id").alias("k"), F.col("var").alias("kv"))
    step = cut(flow.select("src", "dst").distinct())
    new = cut(defs.join(step, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id"), F.col("src").alias("def_id"), "var").distinct())
    parts: list[tuple[DataFrame, int]] = []
    most = int(flow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n := new.count():
        parts.append((new, n))
        while len(parts) > 1 and parts[-2][1] < 2 * parts[-1][1]:
            (a, na), (b, nb) = parts[-2:]
            parts[-2:] = [(cut(a.unionByName(b).coalesce(most)), na + nb)]
        known = reduce(DataFrame.unionByName, [p for p, _ in parts]).select(F.col("node_id").alias("n"), F.col("def_id").alias("d"), F.col("var").alias("v"))
        alive = new.join(kills, (F.col("node_id") == F.col("k")) & (F.col("var") == F.col("kv")), "left_anti")
        nxt = alive.join(step, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id"), "def_id", "var").distinct()
        new = cut(nxt.join(known, (F.col("node_id") == F.col("n")) & (F.col("def_id") == F.col("d")) & F.col("var").eqNullSafe(F.col("v")), "left_anti"))
    return reduce(DataFrame.unionByName, [p for p, _ in parts]) if parts else new


def _scoped(edges: DataFrame, roots: DataFrame | int, members: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """roots and members as (scope, node_id); one root alone has all ends of the edges in its scope."""
    if members is None:
        members = links(edges, "both").select(F.lit(0).cast("long").alias("scope"), F.col("a").alias("node_id")).distinct()
    if isinstance(roots, int):
        roots = members.filter(F.col("node_id") == roots)
    return roots.select("scope", "node_id"), members.select("scope", "node_id")


def immediate_dominators(steps: dict[int, list[int]], root: int) -> dict[int, int]:
    """The immediate dominator of each node that ``root`` reaches but the root, by fixpoint over reverse postorder."""
    order: list[int] = []
    seen, stack = {root}, [(root, iter(steps.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        nxt = next((x for x in rest if x not in seen), None)
        if nxt is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(nxt)
            stack.append((nxt, iter(steps.get(nxt, ()))))
    rank = {n: i for i, n in enumerate(order)}
    into: dict[int, list[int]] = {}
    for a in order:
        for b in steps.get(a, ()):
            into.setdefault(b, []).append(a)
    above = {root: root}
    changed = True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            best = None
            for p in into[n]:
                if p in above:
                    a, b = p, p if best is None else best
                    while a != b:  # climb to the common ancestor
                        if rank[a] < rank[b]:
                            a = above[a]
                        else:
                            b = above[b]
                    best = a
            if above.get(n) != best:
                above[n], changed = best, True
    del above[root]
    return above


def dominators(edges: DataFrame, roots: DataFrame | int, members: DataFrame | None = None) -> DataFrame:
    """(node_id, dominator): d dominates n if no walk from the root of their scope reaches n without d.

    A scope is the flow graph of one method, with roots(scope, node_id) one a scope and members(scope, node_id): one
    shuffle by scope, and in each the tree of immediate dominators, from which the pairs follow.  A method's graph is
    bounded by the flow budgets.  Nodes that the root does not reach dominate themselves alone.  With one root of a whole
    graph, whose size nothing bounds, ``dominators_by_removal`` answers instead.
    """
    if members is None:
        return dominators_by_removal(edges, roots)
    workers_import(edges.sparkSession)
    at = members.select("scope", F.col("node_id").alias("a")).distinct()
    ends = members.select(F.col("scope").alias("_s"), F.col("node_id").alias("b")).distinct()
    steps = links(edges).join(at, "a").join(ends, "b").filter("scope = _s").select("scope", "a", "b")
    none = F.lit(None).cast("long")
    rows = steps.unionByName(at.withColumn("b", none)).unionByName(roots.select("scope", none.alias("a"), F.col("node_id").alias("b")))

    def run(table: pa.Table) -> pa.Table:
        graph: dict[int, list[int]] = {}
        nodes, root = [], None
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
            if a is None:
                root = b
            elif b is None:
                nodes.append(a)
            else:
                graph.setdefault(a, []).append(b)
        above = immediate_dominators({a: sorted(b) for a, b in graph.items()}, root) if root is not None else {}
        out: list[tuple[int, int]] = []
        for n in nodes:
            out.append((n, n))
            while n != root and (n := above.get(n, root if n == root else None)) is not None:
                out.append((out[-1][0], n))
        return pa.table({"node_id": pa.array([x for x, _ in out], pa.int64()), "dominator": pa.array([x for _, x in out], pa.int64())})

    return rows.select("scope", F.col("a").cast("long"), F.col("b").cast("long")).groupBy("scope").applyInArrow(run, "node_id long, dominator long")


def dominators_by_removal(edges: DataFrame, roots: DataFrame | int, members: DataFrame | None = None) -> DataFrame:
    """``dominators`` without a group in one task: all candidates of all scopes are taken away at once, one frontier loop
    over (removed, node) pairs of a scope.  A root is never taken away, so its own pairs tell what is reached at all."""
    roots, members = _scoped(edges, roots, members)
    members = cut(members)
    steps = cut(links(edges))
    begin = cut(roots.select("scope", F.col("node_id").alias("root")))
    seen = frontier = cut(members.join(begin, "scope").select(F.col("node_id").alias("gone"), F.col("root").alias("node_id")))
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        nxt = frontier.join(steps, F.col("node_id") == F.col("a")).filter("b <> gone").select("gone", F.col("b").alias("node_id")).distinct()
        frontier = cut(nxt.join(seen, ["gone", "node_id"], "left_anti"))
        seen = seen.unionByName(frontier)
        if rounds % 10 == 0:
            seen = cut(seen)
    seen = cut(seen)
    live = cut(seen.join(begin, F.col("gone") == F.col("root")).select("scope", "node_id"))
    pairs = live.join(live.select("scope", F.col("node_id").alias("dominator")), "scope").select("node_id", "dominator")
    missed = seen.join(begin, F.col("gone") == F.col("root"), "left_anti").select(F.col("gone").alias("dominator"), "node_id")
    strict = pairs.filter("dominator <> node_id").join(missed, ["dominator", "node_id"], "left_anti")
    return strict.select("node_id", "dominator").unionByName(members.select("node_id", F.col("node_id").alias("dominator")))


def immediate(dominators_: DataFrame) -> DataFrame:
    """(node_id, idom): the strict dominator that itself has the most dominators; ties go to the smaller id."""
    sizes = dominators_.groupBy(F.col("node_id").alias("dominator")).agg(F.count(F.lit(1)).alias("n"))
    strict = dominators_.filter("node_id <> dominator").join(sizes, "dominator")
    w = Window.partitionBy("node_id").orderBy(F.desc("n"), "dominator")
    return strict.withColumn("r", F.row_number().over(w)).filter("r = 1").select("node_id", F.col("dominator").alias("idom"))


def control_dependence(edges: DataFrame, exits: DataFrame | int, members: DataFrame | None = None) -> DataFrame:
    """(control, dependent): for an edge a -> b where b does not post-dominate a, every post-dominator of b (b too) that
    does not strictly post-dominate a depends on a."""
    post = cut(dominators(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), exits, members).select(F.col("node_id").alias("n"), F.col("dominator").alias("p")))
    split = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    open_ = split.join(post, (F.col("a") == F.col("n")) & (F.col("b") == F.col("p")), "left_anti")
    runners = open_.join(post, F.col("b") == F.col("n")).select("a", F.col("p").alias("d"))
    strict = post.filter("n <> p").select(F.col("n").alias("a"), F.col("p").alias("d"))
    return runners.join(strict, ["a", "d"], "left_anti").select(F.col("a").alias("control"), F.col("d").alias("dependent")).distinct()


def backward_paths(edges: DataFrame, sinks: DataFrame, hops: int) -> DataFrame:
    """(sink, path): walks against the edges without repeats, source first, that end at a node without incoming edges
    or after ``hops`` steps.  Each hop is one join; budgets other than hops belong to ``backward_budgeted``."""
    into = cut(edges.select(F.col("src").alias("p"), F.col("dst").alias("q")).distinct())
    grows = cut(sinks.select(F.col("node_id").alias("sink"), F.col("node_id").alias("at"), F.array("node_id").alias("path")).distinct())
    done = None
    for _ in range(hops):
        ends = grows.join(into, F.col("at") == F.col("q"), "left_anti").select("sink", "path")
        done = ends if done is None else done.unionByName(ends)
        grows = cut(grows.join(into, F.col("at") == F.col("q")).filter(~F.array_contains("path", F.col("p"))).select("sink", F.col("p").alias("at"), F.concat(F.array("p"), "path").alias("path")))
    left = grows.select("sink", "path")
    return left if done is None else done.unionByName(left).distinct()
