"""Call sites and what they may call: candidates, scores, tiers, dispatch kinds, bridges and flow summaries.

methods(method_id, name, signature, type_id, type_name, internal, original_id, overridden_id, is_extension, property)
sites(site, target_id, receiver_id); receiver_id is null for a call without an instance
bases(sub, super): strict base types and interfaces, closed
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.tables import first_wins

# What a candidate scores.
INTERNAL, FULL_NAME, LOOKUP_KEY, SAME_DEFINITION, OVERRIDES = 1000, 500, 250, 200, 150
PROPERTY, PROPERTY_RECEIVER, PROPERTY_BASE, RECEIVER, RECEIVER_BASE, EXTENSION = 180, 90, 60, 120, 80, 20


def keyed(methods: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("name"), F.col("signature"))
    return methods.withColumn("lookup_key", key).withColumn("full_name", F.concat(F.coalesce(F.concat(F.col("type_name"), F.lit(".")), F.lit("")), key))


def requests(sites: DataFrame) -> DataFrame:
    """Each (target_id, receiver_id) once: sites that ask the same are answered together."""
    return sites.select("target_id", "receiver_id").distinct()


def candidates(asked: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(target_id, receiver_id, method_id): the target, internal methods of its lookup key, and methods of that key on a
    base type of the receiver.

    Overrides in subtypes, exact names and extensions share the key of the target and are internal, so the second group
    holds them; only what external base types declare comes from the third.
    """
    m = keyed(methods)
    wanted = asked.join(m.select(F.col("method_id").alias("target_id"), "lookup_key"), "target_id")
    own = wanted.select("target_id", "receiver_id", F.col("target_id").alias("method_id"))
    same = wanted.join(m.filter("internal").select("lookup_key", "method_id"), "lookup_key").select("target_id", "receiver_id", "method_id")
    ups = wanted.join(bases.select(F.col("sub").alias("receiver_id"), F.col("super").alias("type_id")), "receiver_id")
    above = ups.join(m.select("lookup_key", "type_id", "method_id"), ["lookup_key", "type_id"]).select("target_id", "receiver_id", "method_id")
    return own.unionByName(same).unionByName(above).distinct()


def scored(found: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """Candidates with ``score``, ``full_name``, ``internal`` and ``exact`` (the full name of the target)."""
    m = keyed(methods)
    c = m.select("method_id", *[F.col(x).alias(f"c_{x}") for x in ("full_name", "lookup_key", "original_id", "overridden_id", "type_id", "internal", "is_extension", "property", "signature")])
    t = m.select(F.col("method_id").alias("target_id"), *[F.col(x).alias(f"t_{x}") for x in ("full_name", "lookup_key", "original_id", "property", "signature")])
    up = bases.select(F.col("sub").alias("receiver_id"), F.col("super").alias("c_type_id")).distinct().withColumn("_above", F.lit(True))
    j = found.join(c, "method_id").join(t, "target_id").join(up, ["receiver_id", "c_type_id"], "left")
    here, above = F.col("c_type_id") == F.col("receiver_id"), F.coalesce(F.col("_above"), F.lit(False))
    both = F.col("c_property").isNotNull() & F.col("t_property").isNotNull()
    points = (
        (F.col("c_internal"), INTERNAL),
        (F.col("c_full_name") == F.col("t_full_name"), FULL_NAME),
        (F.col("c_lookup_key") == F.col("t_lookup_key"), LOOKUP_KEY),
        (F.col("c_original_id") == F.col("t_original_id"), SAME_DEFINITION),
        (F.col("c_overridden_id") == F.col("t_original_id"), OVERRIDES),
        (both & (F.col("c_property") == F.col("t_property")) & (F.col("c_signature") == F.col("t_signature")), PROPERTY),
        (both & here, PROPERTY_RECEIVER),
        (both & above & ~F.coalesce(here, F.lit(False)), PROPERTY_BASE),
        (here, RECEIVER),
        (above & ~F.coalesce(here, F.lit(False)), RECEIVER_BASE),
        (F.col("c_is_extension"), EXTENSION),
    )
    total = sum((F.when(test, F.lit(n)).otherwise(F.lit(0)) for test, n in points), F.lit(0))
    return j.select("target_id", "receiver_id", "method_id", F.col("c_full_name").alias("full_name"), F.col("c_internal").alias("internal"), (F.col("c_full_name") == F.col("t_full_name")).alias("exact"), total.alias("score"))


def preferred(rows: DataFrame) -> DataFrame:
    """All candidates of the best tier of a request (internal before external, the exact name before others), ranked by
    score, then full name, then id."""
    tier = F.when(F.col("internal") & F.col("exact"), 0).when(F.col("internal"), 1).when(F.col("exact"), 2).otherwise(3)
    ask = Window.partitionBy("target_id", "receiver_id")
    best = rows.withColumn("tier", tier).withColumn("_best", F.min("tier").over(ask)).filter("tier = _best").drop("_best")
    return best.withColumn("target_rank", F.row_number().over(ask.orderBy(F.desc("score"), "full_name", "method_id")))


def resolve(sites: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(site, method_id, tier, score, target_rank) for every site; the work is done once a request."""
    answers = preferred(scored(candidates(requests(sites), methods, bases), methods, bases)).alias("a")
    s = sites.alias("s")
    same = (F.col("s.target_id") == F.col("a.target_id")) & F.col("s.receiver_id").eqNullSafe(F.col("a.receiver_id"))
    return s.join(answers, same).select("s.site", "a.method_id", "a.tier", "a.score", "a.target_rank")


def _first(*cases: tuple[Column, str]) -> Column:
    out = None
    for test, word in cases:
        out = F.when(test, word) if out is None else out.when(test, word)
    return out


def _origin() -> Column:
    return F.when(F.col("internal"), "internal").otherwise("external")


def definition_kind() -> Column:
    """The dispatch kind of a method itself; columns internal, is_extension, implements, in_interface, is_override,
    is_abstract, is_virtual, is_static, all boolean."""
    return F.concat_ws("-", _origin(), _first(
        (F.col("is_extension"), "extension-static"),
        (F.col("implements"), "interface-implementation"),
        (F.col("in_interface"), "interface-definition"),
        (F.col("is_override"), "override-definition"),
        (F.col("is_abstract"), "abstract-definition"),
        (F.col("is_virtual"), "virtual-definition"),
        (F.col("is_static"), "static-definition"),
    ).otherwise("instance-definition"))


def call_kind(has_instance: Column, resolution: Column | None = None) -> Column:
    """The dispatch kind of a call; a plain instance call counts as static.  Columns as in ``definition_kind`` and
    name, property (null: no accessor), indexer (boolean)."""
    base = _first(
        (F.col("is_extension") & has_instance, "extension-instance"),
        (F.col("is_extension"), "extension-static"),
        (F.col("implements"), "interface-implementation"),
        (~has_instance | F.col("is_static"), "static"),
        (F.col("in_interface"), "interface-dispatch"),
        (F.col("is_override"), "override-dispatch"),
        (F.col("is_abstract") | F.col("is_virtual"), "virtual-dispatch"),
    ).otherwise("static")
    owner = F.when(F.col("indexer"), "indexer").otherwise("property")
    verb = _first((F.col("name").startswith("get_"), "get"), (F.col("name").startswith("set_"), "set")).otherwise("accessor")
    accessor = F.when(F.col("property").isNotNull(), F.concat_ws("-", owner, verb))
    return F.concat_ws("-", _origin(), base, accessor, F.lit(None).cast("string") if resolution is None else resolution)


def resolution(internal: Column, exact: Column, receiver_is_owner: Column, owner_above: Column) -> Column:
    """How a target was found, the first that holds."""
    return _first((~internal, "external-fallback"), (exact, "exact"), (receiver_is_owner, "receiver-exact"), (owner_above, "hierarchy")).otherwise("fallback")


def bridges(sites: DataFrame, targets: DataFrame, boundary: DataFrame, flows: DataFrame, max_targets: int = 1, max_edges: int = 64) -> tuple[DataFrame, DataFrame]:
    """Edges between callers and the one method that a site calls, and the reason of each cut.

    sites(site, ord); targets(site, method, ord), method null where nothing is known of it; boundary(node, method,
    kind) with kind MethodParameter or MethodReturn; flows(src, dst, ord).  Gives (site, method, src, dst, bridge) and
    (site, reason).  A site takes, in this order and at most ``max_edges``: the flows into the parameters of its method,
    those from the method's return to the site, and for the first site of a method those into its return.  As no site
    takes more, the flows of a method are cut to one more than that before they meet its sites.
    """
    n = targets.select("site", "method").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    one = first_wins(targets, ["site"], ["ord", "method"]).select("site", "method")
    state = sites.select("site", F.col("ord").alias("_at")).join(n, "site", "left").join(one, "site", "left")
    known = boundary.select("method").distinct().withColumn("_inside", F.lit(True))
    state = state.join(known, "method", "left")
    reason = _first((F.col("n").isNull(), "UnresolvedTarget"), (F.col("n") > max_targets, "AmbiguousTarget"), (F.col("method").isNull(), "UnresolvedTarget"), (F.col("_inside").isNull(), "ExternalTarget"))
    state = state.withColumn("reason", reason)
    open_ = state.filter("reason is null").select("site", "method", "_at")
    first = first_wins(open_, ["method"], ["_at", "site"]).select("site", "method")

    into = flows.join(boundary.select(F.col("node").alias("dst"), "method", "kind"), "dst")

    def few(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy("method").orderBy("ord", "src", "dst"))).filter(F.col("_r") <= max_edges + 1).drop("_r", "kind")

    given = open_.join(few(into.filter("kind = 'MethodParameter'")), "method").withColumn("bridge", F.lit("ArgumentToParameter")).withColumn("_g", F.lit(0))
    out = flows.join(boundary.filter("kind = 'MethodReturn'").select(F.col("node").alias("src"), "method"), "src").withColumn("site", F.col("dst"))
    back = open_.join(out, ["site", "method"]).withColumn("bridge", F.lit("MethodReturnToCallResult")).withColumn("_g", F.lit(1))
    ends = first.join(few(into.filter("kind = 'MethodReturn'")), "method").withColumn("bridge", F.lit("ReturnToMethodReturn")).withColumn("_g", F.lit(2))
    cols = ["site", "method", "src", "dst", "bridge", "_g", "ord"]
    plan = given.select(cols).unionByName(back.select(cols)).unionByName(ends.select(cols))
    plan = plan.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy("_g", "ord", "src", "dst")))
    made = plan.filter(F.col("_r") <= max_edges).select("site", "method", "src", "dst", "bridge").distinct()
    sizes = plan.groupBy("site").agg(F.max("_r").alias("_n"))
    late = open_.select("site").join(sizes, "site", "left").select("site", _first((F.col("_n").isNull(), "MissingIntraFacts"), (F.col("_n") > max_edges, "BoundaryEdgeBudget")).alias("reason"))
    return made, state.select("site", "reason").unionByName(late).filter("reason is not null")


def flow_summaries(calls: DataFrame, project: DataFrame, framework: DataFrame) -> DataFrame:
    """The summary of each call by assembly, type, method and arity: the project's own, else the framework's, else
    Unknown.  The first two tables hold (key, summary) with one row a key."""
    key = F.concat_ws("|", "assembly", "type", "method", F.col("arity").cast("string"))
    j = calls.withColumn("key", key).join(project.select("key", F.col("summary").alias("_p")), "key", "left").join(framework.select("key", F.col("summary").alias("_f")), "key", "left")
    return j.withColumn("summary", F.coalesce("_p", "_f", F.lit("Unknown"))).drop("_p", "_f")
