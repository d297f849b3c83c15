"""The passes that make a graph from facts: syntax, methods, operations, member accesses and the data flow between them.

Facts are tables, one row a syntax node, method, parameter, operation or argument; every pass is a union of projections
and equi-joins over them.  Nodes are named by text keys until ids are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.graph import links, reachable

# Fixed values: (kind of the parent, role of the child) and the edge between them; anything else is an OpChild.
OPERATION_EDGES = (
    ("Invocation", "argument", "OpArgument"),
    ("Invocation", "instance", "OpInstance"),
    ("FieldReference", "instance", "OpInstance"),
    ("PropertyReference", "argument", "OpArgument"),
    ("PropertyReference", "instance", "OpInstance"),
    ("Return", "value", "OpTarget"),
    ("Conditional", "condition", "OpCondition"),
    ("Conditional", "true", "OpWhenTrue"),
    ("Conditional", "false", "OpWhenFalse"),
    ("Loop", "body", "OpBody"),
)
# Fixed values: (kind of the parent, role of the child) whose value flows on to the parent.
VALUE_SOURCES = (("VariableDeclarator", "initializer"), ("SimpleAssignment", "value"), ("Invocation", "instance"), ("Invocation", "argument"), ("Return", "value"))


def _edges(rows: DataFrame, src: Column | str, dst: Column | str, kind: str) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = rows.select(col(src).alias("src"), col(dst).alias("dst"), F.lit(kind).alias("kind"))
    return out.filter("src is not null and dst is not null")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def syntax_edges(tree: DataFrame, tokens: DataFrame, declared: DataFrame, referenced: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst, kind) of tree(node, parent), tokens(token, node), declared(node, symbol), referenced(node, symbol) and
    types(node, type); a node without a parent hangs on nothing."""
    return _union(_edges(tree, "parent", "node", "SyntaxChild"), _edges(tokens, "node", "token", "TokenChild"), _edges(declared, "node", "symbol", "DeclaresSymbol"), _edges(referenced, "node", "symbol", "ReferencesSymbol"), _edges(types, "node", "type", "HasType"))


def method_nodes(methods: DataFrame, params: DataFrame) -> DataFrame:
    """(key, kind, name, full_name, start, end) of methods(method, name, full_name, returns, start, end) and
    params(method, ordinal, name, start, end).

    A return stands at the end of its method and is missing where nothing is declared to be returned; the entry stands
    at the start and the exit at the end.
    """
    m = F.col("method").cast("string")

    def boundary(rows: DataFrame, prefix: str, kind: str, mark: str, start: str, end: str) -> DataFrame:
        suffix = F.lit(mark)
        return rows.select(F.concat(F.lit(f"{prefix}:"), m).alias("key"), F.lit(kind).alias("kind"), F.concat("name", suffix).alias("name"), F.concat("full_name", suffix).alias("full_name"), F.col(start).alias("start"), F.col(end).alias("end"))

    named = params.join(methods.select("method", F.col("full_name").alias("owner")), "method")
    of_params = named.select(
        F.concat(F.lit("methodparam:"), m, F.lit(":"), F.col("ordinal").cast("string")).alias("key"), F.lit("MethodParameter").alias("kind"), "name",
        F.concat("owner", F.lit("#"), F.col("ordinal").cast("string"), F.lit(":"), "name").alias("full_name"), "start", "end",
    )
    return (
        boundary(methods, "method", "Method", "", "start", "end")
        .unionByName(boundary(methods.filter("returns is not null"), "methodreturn", "MethodReturn", ":return", "end", "end"))
        .unionByName(boundary(methods, "methodentry", "MethodEntry", ":entry", "start", "start"))
        .unionByName(boundary(methods, "methodexit", "MethodExit", ":exit", "end", "end"))
        .unionByName(of_params)
    )


def method_edges(methods: DataFrame, params: DataFrame) -> DataFrame:
    """(src, dst, kind) among the nodes of ``method_nodes``, the syntax node of each method, symbols and types."""
    m = F.col("method").cast("string")
    key = lambda prefix: F.concat(F.lit(f"{prefix}:"), m)
    type_ = F.concat(F.lit("type:"), "returns")
    p = F.concat(key("methodparam"), F.lit(":"), F.col("ordinal").cast("string"))
    returned = methods.filter("returns is not null")
    return _union(
        _edges(methods, key("syntax"), key("method"), "SyntaxChild"),
        _edges(methods, key("method"), key("symbol"), "DeclaresSymbol"),
        _edges(methods, key("method"), key("methodentry"), "SyntaxChild"),
        _edges(methods, key("method"), key("methodexit"), "SyntaxChild"),
        _edges(returned, key("method"), type_, "ReturnsType"),
        _edges(returned, key("method"), type_, "EvalType"),
        _edges(returned, key("method"), key("methodreturn"), "ParameterLink"),
        _edges(returned, key("methodreturn"), type_, "EvalType"),
        _edges(params, key("method"), p, "ParameterLink"),
        _edges(params, p, F.concat(F.lit("symbol:"), m, F.lit(":"), F.col("ordinal").cast("string")), "Ref"),
        _edges(params, p, F.concat(F.lit("type:"), "type"), "EvalType"),
    )


def operation_edges(ops: DataFrame, table: tuple = OPERATION_EDGES) -> DataFrame:
    """(src, dst, kind) from each operation to its children; ops(op_id, parent_id, kind, role)."""
    parents = ops.select(F.col("op_id").alias("parent_id"), F.col("kind").alias("_parent"))
    rules = ops.sparkSession.createDataFrame(list(table), "_parent string, role string, _edge string")  # a fixed short list
    joined = ops.filter("parent_id is not null").select("op_id", "parent_id", "role").join(parents, "parent_id").join(F.broadcast(rules), ["_parent", "role"], "left")
    return joined.select(F.col("parent_id").alias("src"), F.col("op_id").alias("dst"), F.coalesce("_edge", F.lit("OpChild")).alias("kind"))


def value_source_flow(ops: DataFrame, table: tuple = VALUE_SOURCES) -> DataFrame:
    """DataFlow edges from the parts whose value an operation takes over to the operation."""
    parents = ops.select(F.col("op_id").alias("parent_id"), F.col("kind").alias("_parent"))
    rules = ops.sparkSession.createDataFrame(list(table), "_parent string, role string")  # a fixed short list
    rows = ops.select("op_id", "parent_id", "role").join(parents, "parent_id").join(F.broadcast(rules), ["_parent", "role"], "left_semi")
    return _edges(rows, "op_id", "parent_id", "DataFlow").distinct()


def return_flow(ops: DataFrame, methods: DataFrame) -> DataFrame:
    """DataFlow edges from each returned value to its method's return, from there to the exit, and from the return
    operation to the exit; methods(method_id, ret, exit)."""
    returns = ops.filter("kind = 'Return'").select("method_id", F.col("op_id").alias("at"))
    values = ops.filter("role = 'value'").select(F.col("op_id").alias("value"), F.col("parent_id").alias("at"))
    rows = returns.join(values, "at").join(methods.select("method_id", "ret", "exit"), "method_id")
    return _union(_edges(rows, "value", "ret", "DataFlow"), _edges(rows, "ret", "exit", "DataFlow"), _edges(rows, "at", "exit", "DataFlow"))


def terminal_flow(ops: DataFrame, methods: DataFrame, stops: tuple[str, ...] = ("Return", "Throw", "Branch", "Break", "Continue")) -> DataFrame:
    """A DataFlow edge from the last statement of a method's block to its return, unless the method returns somewhere or
    that statement ends the flow."""
    roots = ops.filter("parent_id is null and kind = 'Block'").select("method_id", F.col("op_id").alias("parent_id"))
    last = ops.filter("parent_id is not null").join(roots, ["method_id", "parent_id"]).groupBy("method_id").agg(F.max_by(F.struct("op_id", "kind"), "pos").alias("x"))
    free = last.filter(~F.col("x.kind").isin(*stops)).join(ops.filter("kind = 'Return'").select("method_id"), "method_id", "left_anti")
    return _edges(free.join(methods.select("method_id", "ret"), "method_id"), F.col("x.op_id"), "ret", "DataFlow")


def argument_flow(calls: DataFrame, arguments: DataFrame, params: DataFrame) -> DataFrame:
    """ParameterLink and DataFlow edges from what calls pass to what their targets take, and DataFlow from the return of
    a target to the call site.

    calls(call, site, method, extension, instance, ret), one row for each target inside the sources; arguments(call,
    ordinal, value), params(method, ordinal, node).  An extension takes its instance first, which moves the arguments by
    one; what has no counterpart flows nowhere.
    """
    shift = F.when(F.col("extension") & F.col("instance").isNotNull(), 1).otherwise(0)
    passed = calls.join(arguments, "call").filter("value is not null").select("method", (F.col("ordinal") + shift).alias("ordinal"), F.col("value").alias("src"))
    receivers = calls.filter("extension and instance is not null").select("method", F.lit(0).cast(dict(arguments.dtypes)["ordinal"]).alias("ordinal"), F.col("instance").alias("src"))
    taken = passed.unionByName(receivers).join(params, ["method", "ordinal"])
    return _union(_edges(taken, "src", "node", "ParameterLink"), _edges(taken, "src", "node", "DataFlow"), _edges(calls, "ret", "site", "DataFlow"))


def accessor_flow(refs: DataFrame, arguments: DataFrame, accessors: DataFrame, params: DataFrame) -> DataFrame:
    """Flow through the accessors of properties.

    refs(ref, property, instance, value, get_site, set_site): value is what a simple assignment writes, null for a read,
    and the sites are the call sites of the accessors, null where there is none; arguments(call, ordinal, value), call
    being the ref, of indexers; accessors(property, role, method, ret), role being get or set; params(method, ordinal,
    node).

    A getter's return flows to the reference, and by its call site where there is one.  A written value flows to the
    reference and, as the last parameter, to the setter, whose call site it and the reference meet.  Receivers take the
    first parameter, indexer arguments the next ones.
    """
    both = refs.join(accessors, "property").withColumn("site", F.when(F.col("role") == "get", F.col("get_site")).otherwise(F.col("set_site"))).filter("role = 'get' or value is not null")
    first = F.when(F.col("instance").isNotNull(), 1).otherwise(0)
    n = arguments.groupBy(F.col("call").alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    receivers = both.filter("instance is not null").select("method", F.lit(0).alias("ordinal"), F.col("instance").alias("src"))
    passed = both.select("ref", "method", first.alias("first")).join(arguments.select(F.col("call").alias("ref"), "ordinal", F.col("value").alias("src")), "ref").select("method", (F.col("ordinal") + F.col("first")).alias("ordinal"), "src")
    written = both.filter("role = 'set'").join(n, "ref", "left").select("method", (first + F.coalesce("n", F.lit(0))).alias("ordinal"), F.col("value").alias("src"), "site")
    cast = lambda x: x.select("method", F.col("ordinal").cast("long").alias("ordinal"), "src")
    at = params.select("method", F.col("ordinal").cast("long").alias("ordinal"), "node")
    taken = cast(receivers).unionByName(cast(passed)).unionByName(cast(written)).join(at, ["method", "ordinal"])
    kept = written.withColumn("ordinal", F.col("ordinal").cast("long")).join(at, ["method", "ordinal"])
    gets, sets = both.filter("role = 'get'"), both.filter("role = 'set'")
    return _union(
        _edges(taken, "src", "node", "ParameterLink"), _edges(taken, "src", "node", "DataFlow"), _edges(gets, "ret", "ref", "DataFlow"), _edges(gets.filter("site is not null"), "ret", "site", "DataFlow"),
        _edges(gets, "site", "ref", "DataFlow"), _edges(sets, "value", "ref", "DataFlow"), _edges(sets, "site", "ref", "DataFlow"), _edges(kept, "src", "site", "DataFlow"),
    )


def member_accesses(accesses: DataFrame, members: DataFrame, supertypes: DataFrame) -> DataFrame:
    """(op, member, full_name): how an access names its member.

    accesses(op, member, receiver), members(member, name, owner, signature: of an indexer, else null), supertypes(a, b):
    a has b above it.  The receiver's type names a member that it declares or inherits; else the declaring type does;
    a member without one has its name alone.
    """
    above = supertypes.select(F.col("a").alias("receiver"), F.col("b").alias("owner"), F.lit(True).alias("_held")).distinct()
    rows = accesses.join(members, "member").join(above, ["receiver", "owner"], "left")
    base = F.when(F.col("receiver").isNotNull() & (F.coalesce("_held", F.lit(False)) | (F.col("receiver") == F.col("owner"))), F.col("receiver")).otherwise(F.col("owner"))
    return rows.select("op", "member", F.concat_ws(":", F.concat_ws(".", F.when(base != "", base), "name"), "signature").alias("full_name"))


def unreachable_flow(members: DataFrame, flow: DataFrame) -> DataFrame:
    """(scope, unreachable): for members(scope, node_id), how many no walk reaches from a node without predecessors."""
    starts = members.join(flow.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti")
    left = members.join(reachable(flow, starts), "node_id", "left_anti").groupBy("scope").agg(F.count(F.lit(1)).alias("unreachable"))
    return members.select("scope").distinct().join(left, "scope", "left").select("scope", F.coalesce("unreachable", F.lit(0)).alias("unreachable"))


def frontier_projection(edges: DataFrame, owners: DataFrame, sinks: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """What a slice may see of a stored graph: (edges within ``hops`` of the sinks against their direction whose both ends
    some shard owns, (node_id, reason) of the nodes on the way that none does).

    owners(node_id, shard); each hop reads the edges into the frontier alone.
    """
    from plinth.operators.graph import distances

    near = distances(links(edges, "in"), sinks, hops)
    owned = owners.select("node_id").distinct()
    lost = near.join(owned, "node_id", "left_anti").select("node_id", F.lit("anchorUnavailable").alias("reason"))
    into = edges.join(near.join(owned, "node_id", "left_semi").select(F.col("node_id").alias("dst")), "dst", "left_semi")
    whole = into.join(owned.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return whole, lost
