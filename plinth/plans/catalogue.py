"""All queries of the graph engine, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.tables import dense_ids, first_wins, read
from plinth.operators import graph as G
from plinth.operators import intervals as I
from plinth.operators import rules as R
from plinth.operators.slices import Budget, backward_budgeted
from plinth.plans.lowering import E_SQL, G_SQL, N_SQL, graph, nodes
from plinth.plans.registration import QUERIES, SQL, query
from plinth.sources import store


def _at(spark: SparkSession, d: str, kind: str, *keys: int) -> DataFrame:
    """node_id of the given natural keys."""
    return graph(spark, d).of_kind(kind).filter(F.col("natural_key").isin(*keys)).select("node_id")


# ---- ids, sets, lookups

@query(f"WITH {N_SQL} SELECT * FROM n")
def graph_nodes_dense_ids(spark, d):
    return nodes(spark, d).select("node_id", "kind", "natural_key", "name")


@query(f"{G_SQL} SELECT * FROM e")
def graph_edges_set_union(spark, d):
    return graph(spark, d).edges


@query(f"WITH {N_SQL} SELECT kind, count(*) AS n FROM n GROUP BY kind")
def graph_stats_by_kind(spark, d):
    return graph(spark, d).stats()


@query(f"{G_SQL} SELECT (SELECT count(*) FROM (SELECT node_id FROM n GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM e WHERE src NOT IN (SELECT node_id FROM n)) AS unknown_src, (SELECT count(*) FROM e WHERE dst NOT IN (SELECT node_id FROM n)) AS unknown_dst")
def graph_integrity_dangling(spark, d):
    return graph(spark, d).integrity()


@query(f"{G_SQL} SELECT e.* FROM e JOIN n ON e.src = n.node_id WHERE n.kind = 'order' AND n.natural_key IN (1, 7, 32)")
def neighbors_out(spark, d):
    return graph(spark, d).outgoing(_at(spark, d, "order", 1, 7, 32)).select("src", "dst", "kind")


@query(f"{G_SQL} SELECT e.* FROM e JOIN n ON e.dst = n.node_id WHERE n.kind = 'customer' AND n.natural_key IN (1, 2, 10)")
def neighbors_in(spark, d):
    return graph(spark, d).incoming(_at(spark, d, "customer", 1, 2, 10)).select("src", "dst", "kind")


@query(f"{G_SQL} SELECT e.src, e.dst, e.kind, m.kind AS dst_kind, m.name FROM e JOIN n ON e.src = n.node_id JOIN n m ON m.node_id = e.dst WHERE n.kind = 'order' AND e.kind = 'OfPart'")
def neighbors_by_kind(spark, d):
    g = graph(spark, d)
    ids = g.of_kind("order")
    ends = g.nodes.select(F.col("node_id").alias("dst"), F.col("kind").alias("dst_kind"), "name")
    return g.outgoing(ids, "OfPart").join(ends, "dst").select("src", "dst", "kind", "dst_kind", "name")


@query(f"{G_SQL} SELECT m.name AS symbol, n.node_id AS referrer, n.name FROM e JOIN n ON n.node_id = e.src JOIN n m ON m.node_id = e.dst WHERE e.kind = 'OfPart'")
def symbol_references(spark, d):
    g = graph(spark, d)
    symbols = g.of_kind("part").select(F.col("node_id").alias("dst"), F.col("name").alias("symbol"))
    refs = g.nodes.select(F.col("node_id").alias("src"), "name")
    return g.edges_of("OfPart").join(symbols, "dst").join(refs, "src").select("symbol", F.col("src").alias("referrer"), "name")


@query(f"{G_SQL} SELECT e.dst AS owner, count(*) AS n_sites FROM e JOIN n ON n.node_id = e.src WHERE e.kind = 'PlacedBy' AND n.name = 'O' GROUP BY 1")
def owned_call_sites(spark, d):
    g = graph(spark, d)
    return g.edges_of("PlacedBy").join(g.of_kind("order").filter("name = 'O'").select(F.col("node_id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("owner")).agg(F.count(F.lit(1)).alias("n_sites"))


# ---- walks

_NEAR = "hop(node_id, depth) AS (SELECT node_id, 0 FROM n WHERE kind = 'customer' AND natural_key = 1 UNION SELECT CASE WHEN e.src = hop.node_id THEN e.dst ELSE e.src END, depth + 1 FROM hop JOIN e ON e.src = hop.node_id OR e.dst = hop.node_id WHERE depth < 2), view AS (SELECT DISTINCT node_id FROM hop)"


@query(f"{G_SQL}, {_NEAR} SELECT kind, count(*) AS n FROM view JOIN n USING (node_id) GROUP BY kind")
def local_view_stats(spark, d):
    g = graph(spark, d)
    return g.nodes.join(g.local_view(_at(spark, d, "customer", 1), 2), "node_id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{G_SQL}, {_NEAR} SELECT n.* FROM view JOIN n USING (node_id)")
def local_view_nodes(spark, d):
    g = graph(spark, d)
    return g.nodes.join(g.local_view(_at(spark, d, "customer", 1), 2), "node_id", "left_semi").select("node_id", "kind", "natural_key", "name")


@query(f"{G_SQL}, {_NEAR} SELECT e.* FROM e WHERE src IN (SELECT node_id FROM view) AND dst IN (SELECT node_id FROM view)")
def local_view_edges(spark, d):
    g = graph(spark, d)
    return g.induced(g.local_view(_at(spark, d, "customer", 1), 2)).select("src", "dst", "kind")


_GEO = "s AS (SELECT src AS a, dst AS b FROM e WHERE kind IN ('InRegion', 'InNation') UNION SELECT dst, src FROM e WHERE kind IN ('InRegion', 'InNation'))"


@query(f"{G_SQL}, {_GEO}, w(node_id, depth) AS (SELECT node_id, 0 FROM n WHERE kind = 'region' AND natural_key = 0 UNION SELECT s.b, depth + 1 FROM w JOIN s ON s.a = w.node_id WHERE depth < 4) SELECT n.node_id, min(depth) AS length FROM w JOIN n USING (node_id) WHERE n.kind = 'supplier' GROUP BY 1")
def shortest_path_len(spark, d):
    g = graph(spark, d)
    return G.shortest_paths(g.edges_of("InRegion", "InNation"), _at(spark, d, "region", 0), g.of_kind("supplier"))


_CALLS = "c AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM e a JOIN e b ON a.src = b.src WHERE a.kind = 'PlacedBy' AND b.kind = 'OfPart'), roots AS (SELECT n.node_id FROM e JOIN n ON n.node_id = e.src JOIN n m ON m.node_id = e.dst WHERE n.kind = 'customer' AND m.kind = 'nation' AND m.natural_key = 1), live(node_id) AS (SELECT node_id FROM roots UNION SELECT c.dst FROM live JOIN c ON c.src = live.node_id)"


def _calls(spark, d):
    """customer -> part over the orders: callers and callees."""
    g = graph(spark, d)
    placed = g.edges_of("PlacedBy").select("src", F.col("dst").alias("caller"))
    parts = g.edges_of("OfPart").select("src", F.col("dst").alias("callee"))
    return placed.join(parts, "src").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def _entries(spark, d):
    """Where calls begin: the customers of one nation."""
    g = graph(spark, d)
    inside = g.incoming(_at(spark, d, "nation", 1), "InNation").select(F.col("src").alias("node_id"))
    return g.of_kind("customer").join(inside, "node_id", "left_semi").select("node_id")


@query(f"{G_SQL}, {_CALLS} SELECT node_id FROM live")
def reachable_set(spark, d):
    return G.reachable(_calls(spark, d), _entries(spark, d))


@query(f"{G_SQL}, {_CALLS} SELECT node_id FROM n WHERE kind = 'part' AND EXISTS (SELECT 1 FROM live) AND node_id NOT IN (SELECT node_id FROM live)")
def unreachable_nodes(spark, d):
    return G.unreached(graph(spark, d).of_kind("part").select("node_id"), _calls(spark, d), _entries(spark, d))


@query(f"{G_SQL}, {_CALLS} SELECT node_id FROM n WHERE kind IN ('part', 'customer') AND node_id NOT IN (SELECT node_id FROM live)")
def unreferenced_closure(spark, d):
    g = graph(spark, d)
    return G.unreferenced(g.nodes.filter("kind in ('part', 'customer')").select("node_id"), _calls(spark, d), _entries(spark, d))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def never_referenced(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(read(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("SELECT o_custkey AS id, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS internal, bool_or(o_orderstatus <> 'O') AS external FROM orders GROUP BY 1")
def internal_only(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("internal"), F.bool_or(F.col("o_orderstatus") != "O").alias("external"))


@query(f"{G_SQL}, s AS (SELECT src AS a, dst AS b FROM e WHERE kind IN ('InRegion', 'InNation')), r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a) SELECT a, b FROM r")
def type_closure(spark, d):
    return G.closure(G.links(graph(spark, d).edges_of("InRegion", "InNation")))


@query(f"{G_SQL} SELECT e.src, e.dst, e.kind FROM e WHERE e.src % 8 <> e.dst % 8 AND e.kind = 'PlacedBy'")
def cross_shard_edges(spark, d):
    g = graph(spark, d)
    return G.cross_shard(g.edges_of("PlacedBy"), store.assign_shards(g.nodes, 8).select("node_id", "shard")).select("src", "dst", "kind")


@query(f"{G_SQL}, p(sink, cur, path) AS (SELECT node_id, node_id, [node_id] FROM n WHERE kind = 'customer' AND natural_key IN (1, 4) UNION ALL SELECT sink, e.src, [e.src] || path FROM p JOIN e ON e.dst = p.cur WHERE NOT list_contains(path, e.src)) SELECT sink, array_to_string(path, '>') AS path FROM p WHERE cur NOT IN (SELECT dst FROM e)")
def slice_backward_set(spark, d):
    out = G.backward_paths(graph(spark, d).edges, _at(spark, d, "customer", 1, 4), 6)
    return out.select("sink", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query()
def slice_backward_budgeted(spark, d):
    g = graph(spark, d)
    sinks = g.of_kind("nation").select(F.col("node_id").alias("sink"))
    first = g.edges_of("InNation").join(sinks, F.col("dst") == F.col("sink"))
    second = g.edges_of("PlacedBy").join(first.select("sink", F.col("src").alias("mid")), F.col("dst") == F.col("mid")).drop("mid")
    seen = first.select("sink", "src", "dst", "kind").unionByName(second.select("sink", "src", "dst", "kind")).withColumn("frame", F.lit(None).cast("string"))
    return backward_budgeted(seen, Budget(hops=2, paths=20, definitions=20)).select("sink", F.size("paths").alias("n_paths"), "reason", "visited_nodes", "visited_edges")


# ---- control and data flow

@query("SELECT user_id, src, dst FROM (SELECT user_id, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS dst, event_type = 'error' AS stop FROM events) WHERE dst IS NOT NULL AND NOT stop")
def cfg_next_edges(spark, d):
    ev = read(spark, d, "events").withColumn("stop", F.col("event_type") == "error")
    return G.next_edges(ev, "user_id", "ts", "event_id", "stop")


@query("SELECT event_id, first_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS entry FROM events")
def case_forwarding(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    entry = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_id"))
    return read(spark, d, "events").select("event_id", F.first(entry, ignorenulls=True).over(w).alias("entry"))


_DEFS = "x AS (SELECT event_id, user_id, ts, event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS k FROM events)"


def _facts(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", (F.get_json_object("props", "$.k").try_cast("int") % 10).alias("k"))


@query(f"WITH {_DEFS} SELECT event_id, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM x")
def reaching_defs_linear(spark, d):
    w = Window.partitionBy("user_id", "k").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    made = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_id"))
    return _facts(spark, d).select("event_id", F.last(made, ignorenulls=True).over(w).alias("def_id"))


_FLOW = f"WITH RECURSIVE {_DEFS}, u AS (SELECT * FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM u), f AS (SELECT a.event_id AS src, b.event_id AS dst FROM o a JOIN o b ON a.user_id = b.user_id AND (b.i = a.i + 1 OR (b.i = a.i + 3 AND a.event_type = 'error'))), df AS (SELECT event_id, k FROM u WHERE event_type IN ('purchase', 'signup'))"


def _flow(spark, d):
    """(scope, src, dst): the flow of each user's events, in order; an error may also skip the next two."""
    w = Window.partitionBy("user_id").orderBy("ts")
    ev = read(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("one"), F.when(F.col("event_type") == "error", F.lead("event_id", 3).over(w)).alias("three"))
    return ev.select("scope", "src", F.explode(F.array("one", "three")).alias("dst")).filter("dst is not null")


@query(f"{_FLOW}, r(node_id, def_id, var) AS (SELECT f.dst, df.event_id, df.k FROM df JOIN f ON f.src = df.event_id UNION SELECT f.dst, r.def_id, r.var FROM r JOIN f ON f.src = r.node_id WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.event_id = r.node_id AND df.k = r.var)) SELECT * FROM r")
def reaching_defs_branching(spark, d):
    facts = _facts(spark, d).withColumnRenamed("user_id", "scope")
    defs = facts.filter("event_type in ('purchase', 'signup')").select("scope", F.col("event_id").alias("node_id"), F.col("k").alias("var"))
    return G.reaching_definitions(_flow(spark, d).filter("scope is not null"), defs, _members(spark, d))  # no user, no flow


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1 HAVING count(*) > 28")
def flow_budget_skips(spark, d):
    made = read(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 28")


_SITE = "SELECT l_orderkey AS site, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY 1"


def _sites(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("site")).agg(F.countDistinct("l_suppkey").alias("targets"), F.min("l_suppkey").alias("target"))


@query("SELECT l_orderkey AS site, min(l_suppkey) AS target FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def bridge_unique_target(spark, d):
    return _sites(spark, d).filter("targets = 1").select("site", "target")


@query(f"SELECT CASE WHEN targets IS NULL THEN 'UnresolvedTarget' WHEN targets > 1 THEN 'AmbiguousTarget' ELSE 'Bridged' END AS reason, count(*) AS n FROM orders LEFT JOIN ({_SITE}) s ON s.site = o_orderkey GROUP BY 1")
def bridge_cuts(spark, d):
    sites = read(spark, d, "orders").select(F.col("o_orderkey").alias("site")).join(_sites(spark, d), "site", "left")
    return sites.groupBy(F.when(F.col("targets").isNull(), "UnresolvedTarget").when(F.col("targets") > 1, "AmbiguousTarget").otherwise("Bridged").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# every user is a method whose events are the blocks of its flow
_DAG = _FLOW.removeprefix("WITH RECURSIVE ") + ", e AS (SELECT a.user_id AS scope, f.src, f.dst FROM f JOIN o a ON a.event_id = f.src), ends AS (SELECT user_id AS scope, min_by(event_id, i) AS first_id, max_by(event_id, i) AS last_id FROM o GROUP BY 1)"


def _dom_sql(name: str, start: str, src: str, dst: str) -> str:
    """Dominators by removal: a node dominates what the start does not reach without it."""
    return (
        f"g{name}(scope, gone, id) AS (SELECT o.user_id, o.event_id, ends.{start} FROM o JOIN ends ON ends.scope = o.user_id WHERE o.event_id <> ends.{start} UNION SELECT g.scope, g.gone, e.{dst} FROM g{name} g JOIN e ON e.{src} = g.id WHERE e.{dst} <> g.gone), "
        f"{name} AS (SELECT a.event_id AS node_id, b.event_id AS dominator FROM o a JOIN o b ON a.user_id = b.user_id LEFT JOIN g{name} g ON g.gone = b.event_id AND g.id = a.event_id WHERE a.event_id = b.event_id OR g.id IS NULL)"
    )


_DOM = _dom_sql("dom", "first_id", "src", "dst")


def _ends(spark, d, last: bool):
    pick = F.max_by if last else F.min_by
    return read(spark, d, "events").groupBy(F.col("user_id").alias("scope")).agg(pick("event_id", "ts").alias("node_id"))


def _members(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("node_id"))


@query(f"WITH RECURSIVE {_DAG}, {_DOM} SELECT node_id, dominator FROM dom")
def dominators(spark, d):
    return G.dominators(_flow(spark, d), _ends(spark, d, False), _members(spark, d))


@query(f"WITH RECURSIVE {_DAG}, {_DOM}, z AS (SELECT node_id AS dominator, count(*) AS c FROM dom GROUP BY 1) SELECT node_id, dominator AS idom FROM dom JOIN z USING (dominator) WHERE node_id <> dominator QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY c DESC, dominator) = 1")
def ipdom(spark, d):
    return G.immediate(dominators(spark, d))


@query(f"WITH RECURSIVE {_DAG}, {_dom_sql('pd', 'last_id', 'dst', 'src')} SELECT DISTINCT e.src AS control, r.dominator AS dependent FROM e JOIN pd r ON r.node_id = e.dst LEFT JOIN pd x ON x.node_id = e.src AND x.dominator = e.dst LEFT JOIN pd y ON y.node_id = e.src AND y.dominator = r.dominator AND y.node_id <> y.dominator WHERE x.node_id IS NULL AND y.node_id IS NULL")
def control_dependence(spark, d):
    return G.control_dependence(_flow(spark, d), _ends(spark, d, True), _members(spark, d))


_SCORE = "SELECT l_orderkey AS site, s_name AS name, max(CASE WHEN s_acctbal > 0 THEN 1000 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 500 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 250 ELSE 0 END) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"


def _scored(spark, d):
    j = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    score = F.when(F.col("s_acctbal") > 0, 1000).otherwise(0) + F.when(F.col("l_returnflag") == "R", 500).otherwise(0) + F.when(F.col("l_linestatus") == "O", 250).otherwise(0)
    return j.groupBy(F.col("l_orderkey").alias("site"), F.col("s_name").alias("name")).agg(F.max(score).alias("score"))


@query(f"SELECT site, name, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, name) AS target_rank FROM ({_SCORE})")
def call_target_rank(spark, d):
    return R.rank_targets(_scored(spark, d))


@query(f"SELECT site, name, 1750 - score AS tier FROM ({_SCORE}) QUALIFY score = max(score) OVER (PARTITION BY site)")
def call_target_best_tier(spark, d):
    return R.best_tier(_scored(spark, d).select("site", "name", (1750 - F.col("score")).alias("tier")))


# ---- spans

_TURNS = "t AS (SELECT conv_id AS file, turn AS ord, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS os, coalesce(sum(length(text)) OVER w, 0)::BIGINT + length(text) AS oe FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), o AS (SELECT file, os, oe, ord + 1 AS ord FROM t UNION ALL SELECT file, 0, max(oe), 0 FROM t GROUP BY file), q AS (SELECT file, file * 100000 + x * 137 AS key, x * 137 AS s, x * 137 + 40 AS e FROM (SELECT DISTINCT file FROM t), generate_series(0, 24) g(x))"


def _owners(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("file"), start.alias("os"), (start + F.length("text")).alias("oe"), (F.col("turn") + 1).alias("ord"))
    whole = t.groupBy("file").agg(F.lit(0).cast("long").alias("os"), F.max("oe").alias("oe"), F.lit(0).cast("long").alias("ord"))
    return t.unionByName(whole)


def _asked(spark, d):
    files = read(spark, d, "conversations").select(F.col("conv_id").alias("file")).distinct()
    return files.select("file", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("x")).select("file", (F.col("file") * 100000 + F.col("x") * 137).alias("key"), (F.col("x") * 137).cast("long").alias("s"), (F.col("x") * 137 + 40).cast("long").alias("e"))


@query(f"WITH {_TURNS} SELECT q.key, q.s, q.e, o.ord AS owner FROM q LEFT JOIN o ON o.file = q.file AND o.os <= q.s AND q.e <= o.oe QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY o.oe - o.os, o.os, o.ord) = 1")
def innermost_owner(spark, d):
    return I.innermost_owner(_asked(spark, d), _owners(spark, d), "key").select("key", "s", "e", "owner")


@query(f"WITH {_TURNS} SELECT q.key, o.ord FROM q JOIN o ON o.file = q.file AND o.os <= q.s AND q.e <= o.oe")
def span_containment(spark, d):
    return I.containment(_asked(spark, d), _owners(spark, d)).select("key", "ord")


@query(f"WITH {_TURNS} SELECT file, ord, os, oe FROM o WHERE os >= 200 AND oe <= 900")
def nodes_in_span(spark, d):
    return _owners(spark, d).filter("os >= 200 and oe <= 900").select("file", "ord", "os", "oe")


_SPANS = "SELECT l_orderkey AS file, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS key, (l_partkey % 50)::BIGINT AS s, (l_partkey % 50 + l_quantity)::BIGINT AS e FROM lineitem"


def _spans(spark, d):
    li = read(spark, d, "lineitem")
    keyed = dense_ids(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"], "key")
    return keyed.select(F.col("l_orderkey").alias("file"), "key", (F.col("l_partkey") % 50).alias("s"), (F.col("l_partkey") % 50 + F.col("l_quantity")).cast("long").alias("e"))


_COVERED = "EXISTS (SELECT 1 FROM x b WHERE b.file = a.file AND b.key <> a.key AND b.s <= a.s AND a.e <= b.e AND (b.e - b.s > a.e - a.s OR b.key < a.key))"


@query(f"WITH x AS ({_SPANS}) SELECT a.* FROM x a WHERE {_COVERED}")
def covered_spans(spark, d):
    return I.covered(_spans(spark, d), "key").select("file", "key", "s", "e")


@query(f"WITH x AS ({_SPANS}) SELECT a.* FROM x a WHERE NOT {_COVERED}")
def maximal_spans(spark, d):
    return I.maximal(_spans(spark, d), "key").select("file", "key", "s", "e")


@query(f"WITH x AS ({_SPANS}) SELECT file, count(*) AS n FROM (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x) WHERE before > s GROUP BY file")
def edit_overlap_check(spark, d):
    return I.overlaps(_spans(spark, d)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


# ---- rules

@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def mark_dedup_first_wins(spark, d):
    return first_wins(read(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT l_orderkey, l_partkey, l_linestatus, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 14 END, l_partkey, l_linestatus, l_quantity) = 1")
def graph_binding_priority(spark, d):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(14)
    return first_wins(read(spark, d, "lineitem"), ["l_orderkey"], [rank, "l_partkey", "l_linestatus", "l_quantity"]).select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity")


@query("SELECT l_orderkey, count(*) AS n, count(*) AS n_marked FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N')")
def switch_full_cover(spark, d):
    return R.fully_marked(read(spark, d, "lineitem").withColumn("m", F.col("l_returnflag") == "N"), "l_orderkey", "m")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity < 40)) GROUP BY 1, 2")
def all_or_nothing_rewrite(spark, d):
    li = read(spark, d, "lineitem")
    whole = li.groupBy("l_orderkey").agg(F.every(F.col("l_quantity") < 40).alias("ok")).filter("ok")
    return li.join(whole, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey").distinct()


@query(f"WITH x AS (SELECT *, key % 4 AS depth FROM ({_SPANS})) SELECT file, key, depth FROM x QUALIFY row_number() OVER (PARTITION BY file ORDER BY depth, e - s DESC, s, e, key) = 1")
def conflict_winner(spark, d):
    units = _spans(spark, d).withColumn("depth", F.col("key") % 4)
    return first_wins(units, ["file"], [F.asc("depth"), F.desc(F.col("e") - F.col("s")), F.asc("s"), F.asc("e"), F.asc("key")]).select("file", "key", "depth")


@query("SELECT doc_id, md5(CASE WHEN n >= 40 THEN left(text, 5) || '<cut>' || substring(text, 11, 10) || '' || substring(text, 26) ELSE text END) AS digest FROM (SELECT *, length(text) AS n FROM documents)")
def apply_edits(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    edits = docs.filter(F.char_length("text") >= 40).select("doc_id", F.explode(F.array(F.struct(F.lit(5).alias("s"), F.lit(10).alias("e"), F.lit("<cut>").alias("replacement")), F.struct(F.lit(20).alias("s"), F.lit(25).alias("e"), F.lit("").alias("replacement")))).alias("x")).select("doc_id", "x.*")
    return R.apply_edits(docs, edits, "doc_id").select("doc_id", F.md5(F.col("rewritten").cast("binary")).alias("digest"))


@query("WITH x AS (SELECT doc_id AS file, split_part(text, '.', 1) AS o, CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(lang) || chr(10) || source END AS r FROM documents) SELECT count(DISTINCT file) AS files, count(*) AS edits, sum(CASE WHEN r = '' THEN 0 ELSE len(string_split(r, chr(10))) END)::BIGINT AS inserted_lines, sum(CASE WHEN o = '' THEN 0 ELSE len(string_split(replace(o, chr(13) || chr(10), chr(10)), chr(10))) END)::BIGINT AS deleted_lines, count(*) FILTER (WHERE o <> '' AND r <> '') AS replace_blocks FROM x")
def diff_summary(spark, d):
    r = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.upper("lang"), F.lit("\n"), "source"))
    return R.diff_summary(read(spark, d, "documents").select(F.col("doc_id").alias("file"), F.split_part("text", F.lit("."), F.lit(1)).alias("original"), r.alias("replacement")))


@query("SELECT * FROM (VALUES (1, 'DefiniteMatch'), (2, 'Container'), (3, 'Part'), (4, 'None')) t(case_id, outcome)")
def fact_match_truth_table(spark, d):
    """A definition and a use meet if they are one location, if one holds the other, or not at all."""
    cases = spark.createDataFrame([(1, "a", None, "a", None), (2, "a", None, "a", "x"), (3, "a", "x", "a", None), (4, "a", "x", "a", "y")], "case_id int, dr string, dp string, ur string, up string")
    same = F.col("dr") == F.col("ur")
    out = F.when(same & F.col("dp").eqNullSafe(F.col("up")), "DefiniteMatch").when(same & F.col("dp").isNull(), "Container").when(same & F.col("up").isNull(), "Part").otherwise("None")
    return cases.select("case_id", out.alias("outcome"))


# ---- store

@query(f"WITH {N_SQL} SELECT kind, node_id % 8 AS shard, count(*) AS n, sha256(string_agg(node_id::VARCHAR, ',' ORDER BY node_id)) AS fingerprint FROM n GROUP BY 1, 2")
def shard_partition_sizes(spark, d):
    return store.fingerprint(store.assign_shards(graph(spark, d).nodes, 8), ["kind", "shard"])


_BUILDS = "b AS (SELECT o_custkey AS fragment, o_orderkey AS build_id, CASE WHEN o_orderstatus = 'P' THEN 'Building' ELSE 'Complete' END AS status FROM orders)"


def _builds(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("fragment"), F.col("o_orderkey").alias("build_id"), F.when(F.col("o_orderstatus") == "P", "Building").otherwise("Complete").alias("status"))


@query(f"WITH {_BUILDS} SELECT fragment, max(build_id) AS build_id, 'Complete' AS status FROM b WHERE status = 'Complete' GROUP BY 1")
def latest_build_lookup(spark, d):
    return store.latest(_builds(spark, d), ["fragment"])


@query(f"WITH {_BUILDS} SELECT * FROM b WHERE status = 'Complete' QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY build_id DESC) > 3")
def prune_candidates(spark, d):
    return store.prunable(_builds(spark, d), ["fragment"], 3)


@query("SELECT l_partkey AS shard, count(*) AS refs, sum(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1")
def shard_refcounts(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("shard")).agg(F.count(F.lit(1)).alias("refs"), F.sum("l_quantity").cast("long").alias("bytes"))


@query("SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def fragment_reuse(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("(SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3) UNION ALL (SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 100)")
def fixture_top_k(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return docs.orderBy(F.desc("n_chars"), "doc_id").limit(3).unionByName(docs.orderBy("n_chars", "doc_id").limit(100))


@query("SELECT event_type, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS median FROM events GROUP BY 1")
def upper_median(spark, d):
    w = Window.partitionBy("event_type").orderBy("value")
    ranked = read(spark, d, "events").select("event_type", "value", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("event_type")).alias("n"))
    return ranked.filter("r = floor(n / 2) + 1").select("event_type", F.col("value").alias("median"))


@query("SELECT user_id, max(value) AS peak, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) AS hit_rate FROM events GROUP BY 1")
def peaks_and_hit_rates(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("peak"), F.avg((F.col("event_type") == "view").cast("double")).alias("hit_rate"))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('error', 'purchase') AND value > 10 AND user_id NOT IN (1, 2)")
def log_filter(spark, d):
    return read(spark, d, "events").filter("event_type in ('error', 'purchase') and value > 10 and user_id not in (1, 2)").select("event_id", "ts", "event_type")


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_partkey % 2 = 0 THEN substring(p_type, 1, 8) END, p_brand) AS display FROM part")
def display_text(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, F.substring("p_type", 1, 8)), F.col("p_brand")).alias("display"))
