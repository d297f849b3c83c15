"""Rules that take a class out: marks, hosts of marked types, references, parameters that go, and what is proposed.

nodes(node_id, parent_id, kind, role, file, s, e, target, modifiers, explicit) as in the syntax rules; target is true where
the node names the class or has its type, modifiers and explicit (an explicit interface member) stand at declarations and
parameters.  Null targets, modifiers and flags count as absent; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.tables import cut, first_wins
from plinth.operators import proposals as P
from plinth.operators.syntax import _nearest, lift

# The rules that mark, propagate and propose.
DECLARATION_MARK, EXPRESSION_MARK, TYPE_MARK = "DEL-CLASS-MARK-DECL-001", "DEL-CLASS-MARK-EXPR-001", "DEL-CLASS-MARK-TYPE-001"
NEW_RULE, LOCAL_RULE, HOST_RULE = "DEL-CLASS-PROP-NEW-DECL-001", "DEL-CLASS-PROP-LOCAL-REF-001", "DEL-CLASS-PROP-DECL-HOST-001"
METHOD_USAGE, LOCAL_FUNCTION_USAGE, INDEXER_USAGE = "DEL-CLASS-PROP-METHOD-PARAM-USAGE-001", "DEL-CLASS-PROP-LOCALFUNC-PARAM-USAGE-001", "DEL-CLASS-PROP-INDEXER-PARAM-USAGE-001"
DELEGATE_USAGE, EXTENSION_USAGE = "DEL-CLASS-PROP-DELEGATE-USAGE-001", "DEL-CLASS-PROP-EXT-MAPPED-001"
HOST_LIFT, IF_LIFT, SWITCH_LIFT = "DEL-CLASS-LIFT-HOST-001", "DEL-CLASS-LIFT-IF-001", "DEL-CLASS-LIFT-SWITCH-001"
DEFAULT_RULE, CONTROL_RULE, IF_RULE = "DEL-CLASS-PROP-DEFAULT-001", "DEL-CLASS-PROP-CTRL-001", "DEL-CLASS-PROP-IF-001"
HOST_PROPOSALS = {
    "Field": "DEL-CLASS-PROP-TYPE-DECL-001",
    "Property": "DEL-CLASS-PROP-TYPE-DECL-001",
    "PrivateReturn": "DEL-CLASS-PROP-RETURN-001",
    "PublicReturn": "DEL-CLASS-PROP-PUBLIC-RETURN-001",
    "InterfaceMethod": "DEL-CLASS-PROP-IFACE-METHOD-001",
    "InterfaceProperty": "DEL-CLASS-PROP-IFACE-PROPERTY-001",
    "InterfaceEvent": "DEL-CLASS-PROP-IFACE-EVENT-001",
    "InterfaceIndexer": "DEL-CLASS-PROP-IFACE-INDEXER-001",
    "DelegateReturn": "DEL-CLASS-PROP-DELEGATE-001",
    "ExtensionReceiver": "DEL-CLASS-PROP-EXT-RECV-001",
    "Base": "DEL-CLASS-PROP-BASE-001",
    "LocalGeneric": "DEL-CLASS-PROP-GENERIC-001",
}
SHRINK_PROPOSALS = {
    "PrivatePositional": "DEL-CLASS-PROP-PRIVATE-PARAM-SHRINK-001",
    "NamedMethod": "DEL-CLASS-PROP-NAMED-METHOD-PARAM-SHRINK-001",
    "OptionalMethod": "DEL-CLASS-PROP-OPTIONAL-METHOD-PARAM-SHRINK-001",
    "ParamsMethod": "DEL-CLASS-PROP-PARAMS-METHOD-PARAM-SHRINK-001",
    "PublicPositional": "DEL-CLASS-PROP-PUBLIC-PARAM-SHRINK-001",
    "LocalFunction": "DEL-CLASS-PROP-LOCALFUNC-PARAM-SHRINK-001",
    "NamedLocalFunction": "DEL-CLASS-PROP-NAMED-LOCALFUNC-PARAM-SHRINK-001",
    "OptionalLocalFunction": "DEL-CLASS-PROP-OPTIONAL-LOCALFUNC-PARAM-SHRINK-001",
    "Indexer": "DEL-CLASS-PROP-INDEXER-PARAM-SHRINK-001",
    "NamedIndexer": "DEL-CLASS-PROP-NAMED-INDEXER-PARAM-SHRINK-001",
    "Extension": "DEL-CLASS-PROP-EXT-NONRECV-PARAM-SHRINK-001",
    "PlainDelegate": "DEL-CLASS-PROP-DELEGATE-PARAM-SHRINK-001",
    "MethodGroup": "DEL-CLASS-PROP-METHODGROUP-DELEGATE-PARAM-SHRINK-001",
    "Lambda": "DEL-CLASS-PROP-LAMBDA-DELEGATE-PARAM-SHRINK-001",
    "InvocationChain": "DEL-CLASS-PROP-DELEGATE-INVOKE-PARAM-SHRINK-001",
}
# Kinds.
EXPRESSIONS = ("SimpleMemberAccessExpression", "MemberBindingExpression", "InvocationExpression", "ElementAccessExpression", "ConditionalAccessExpression", "ObjectCreationExpression", "ImplicitObjectCreationExpression")
NAMES = ("IdentifierName", "QualifiedName", "AliasQualifiedName", "GenericName")
TYPES = (*NAMES, "PredefinedType", "NullableType", "ArrayType", "PointerType", "TupleType", "RefType", "ScopedType", "FunctionPointerType", "OmittedTypeArgument")
NO_SHRINK = ("override", "abstract", "virtual", "extern", "partial")


def _has(modifiers: str, *words: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(modifiers), F.array(*map(F.lit, words))), F.lit(False))


def _open(explicit: str, modifiers: str) -> Column:
    return ~F.coalesce(F.col(explicit), F.lit(False)) & ~_has(modifiers, *NO_SHRINK)


def is_private(modifiers: str = "modifiers", explicit: str = "explicit") -> Column:
    """A method that is private by word and may change."""
    return _open(explicit, modifiers) & _has(modifiers, "private") & ~_has(modifiers, "public", "protected", "internal")


def is_reachable(modifiers: str = "modifiers", explicit: str = "explicit") -> Column:
    """A method that others may reach by word and that may change."""
    return _open(explicit, modifiers) & ~_has(modifiers, "private") & _has(modifiers, "public", "protected", "internal")


def _targets(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("_c"), F.col("parent_id").alias("_p"), F.col("kind").alias("_k"), F.col("role").alias("_r"), F.coalesce("target", F.lit(False)).alias("_t"))


def type_marks(nodes: DataFrame) -> DataFrame:
    """(node_id, owner, owner_kind, generic): names of the class that are the type of a variable, parameter, property,
    indexer or base, or what a method or delegate returns; generic where they stand among type arguments.  Of nested types
    that both name it none counts."""
    up = cut(_targets(nodes))
    at = cut(nodes.filter(F.col("target") & F.col("kind").isin(*TYPES)).select("node_id", F.col("kind").alias("of"), F.col("parent_id").alias("at"), F.col("role").alias("part"), F.lit(False).alias("generic")))
    ended, nested = None, None
    while True:
        step = cut(at.join(up, F.col("at") == F.col("_c")))
        through = F.col("_k").isin(*TYPES, "TypeArgumentList")
        pair = step.filter(F.col("_t") & F.col("_k").isin(*TYPES))
        pair = pair.select("node_id").unionByName(pair.select(F.col("_c").alias("node_id")))
        stop = step.filter(~through).select("node_id", "of", F.col("_c").alias("owner"), F.col("_k").alias("owner_kind"), "part", "generic")
        ended, nested = (stop, pair) if ended is None else (ended.unionByName(stop), nested.unionByName(pair))
        if step.isEmpty():
            break
        at = step.filter(through).select("node_id", "of", F.col("_p").alias("at"), F.col("_r").alias("part"), (F.col("generic") | (F.col("_k") == "TypeArgumentList")).alias("generic"))
    typed = F.col("owner_kind").isin("VariableDeclaration", "Parameter", "PropertyDeclaration", "IndexerDeclaration", "SimpleBaseType") & (F.col("part") == "type")
    returns = F.col("owner_kind").isin("MethodDeclaration", "DelegateDeclaration") & (F.col("part") == "return")
    return ended.filter((typed | returns) & F.col("of").isin(*NAMES)).join(nested, "node_id", "left_anti").select("node_id", "owner", "owner_kind", "generic")


def expression_marks(nodes: DataFrame) -> DataFrame:
    """(node_id): expressions of the class below no wider access, call or creation that also is one."""
    up = cut(_targets(nodes))
    mine = cut(nodes.filter(F.col("target") & F.col("kind").isin(*EXPRESSIONS)).select("node_id", "parent_id"))
    at, held = mine.select("node_id", F.col("parent_id").alias("at")), None
    while True:
        step = cut(at.join(up, F.col("at") == F.col("_c")).withColumn("held", F.col("_t") & F.col("_k").isin(*EXPRESSIONS) & (F.col("_k") != "MemberBindingExpression")))
        found = step.filter("held").select("node_id")
        held = found if held is None else held.unionByName(found)
        if step.isEmpty():
            return mine.select("node_id").join(held, "node_id", "left_anti")
        at = step.filter("not held").select("node_id", F.col("_p").alias("at"))


def class_marks(nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id) of the three rules that mark: declarations, expressions, types."""
    declared = nodes.filter("target and kind = 'ClassDeclaration'").select("node_id", F.lit(DECLARATION_MARK).alias("rule_id"))
    return declared.unionByName(expression_marks(nodes).withColumn("rule_id", F.lit(EXPRESSION_MARK))).unionByName(type_marks(nodes).select("node_id", F.lit(TYPE_MARK).alias("rule_id")))


def creation_declarators(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id, source): the declarator that a marked creation initialises, near or far above it."""
    owners = nodes.filter("kind = 'VariableDeclarator'").select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_own"))
    shown = nodes.join(owners, "parent_id", "left").withColumn("kind", F.when((F.col("kind") == "EqualsValueClause") & F.col("_own").isNull(), "OtherValueClause").otherwise(F.col("kind")))
    made = marked.join(nodes.filter(F.col("kind").isin(*EXPRESSIONS[-2:])).select("node_id"), "node_id", "left_semi")
    clause = nodes.filter("kind = 'EqualsValueClause'").select(F.col("node_id").alias("found"), F.col("parent_id").alias("node_id"))
    return _nearest(made, shown, "EqualsValueClause", "value").join(clause, "found").select("node_id", F.lit(NEW_RULE).alias("rule_id"), "source")


def later_references(declarators: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id, source): names behind a declarator in its scope that stand for its local; nodes also has symbol
    and scope, which are null for what is no local.  Marked names are left out."""
    defs = nodes.select(F.col("node_id").alias("source"), "symbol", "scope", F.col("s").alias("_s")).join(declarators.select(F.col("node_id").alias("source")), "source", "left_semi")
    names = nodes.filter("kind = 'IdentifierName'").select("node_id", "symbol", "scope", "s").join(marked.select("node_id"), "node_id", "left_anti")
    found = names.join(defs, ["symbol", "scope"]).filter("s > _s")
    return found.groupBy("node_id").agg(F.min(F.struct("_s", "source"))["source"].alias("source")).select("node_id", F.lit(LOCAL_RULE).alias("rule_id"), "source")


def declaration_hosts(types: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, host_kind, source): what has to go with a marked type of ``type_marks``; a host once, for its first type
    in the text.  Parameters of ordinary methods have no host here."""
    up = nodes.select(F.col("node_id").alias("_n"), F.col("parent_id").alias("_up"), F.col("kind").alias("_nk"))
    own = types.join(nodes.select(F.col("node_id").alias("owner"), F.col("parent_id").alias("_list"), F.col("modifiers").alias("_words")), "owner")
    lists = nodes.filter("kind like '%BaseType' or kind = 'Parameter'").groupBy(F.col("parent_id").alias("_list")).agg(F.count(F.lit(1)).alias("_parts"), F.min(F.struct("s", "node_id"))["node_id"].alias("_first"))
    own = own.join(up.select(F.col("_n").alias("_list"), F.col("_up").alias("_over")), "_list", "left").join(lists, "_list", "left")
    kind = F.col("owner_kind")
    host = F.when(kind == "VariableDeclaration", F.col("_list")).when(kind == "Parameter", F.col("_over")).when((kind == "SimpleBaseType") & (F.col("_parts") == 1), F.col("_list")).otherwise(F.col("owner"))
    hosts = nodes.select(F.col("node_id").alias("_host"), F.col("kind").alias("_hk"), F.col("parent_id").alias("_hp"), "modifiers", "explicit")
    own = own.withColumn("_host", host).join(hosts, "_host").join(up.select(F.col("_n").alias("_hp"), F.col("_nk").alias("_hpk")), "_hp", "left")
    inside, hk = F.coalesce(F.col("_hpk") == "InterfaceDeclaration", F.lit(False)), F.col("_hk")
    receiver = (F.col("_first") == F.col("owner")) & _has("_words", "this") & _open("explicit", "modifiers") & _has("modifiers", "static")
    is_method, is_parameter = hk == "MethodDeclaration", kind == "Parameter"
    host_kind = (
        F.when((kind == "VariableDeclaration") & (hk == "FieldDeclaration"), "Field")
        .when((kind == "VariableDeclaration") & (hk == "EventFieldDeclaration") & inside, "InterfaceEvent")
        .when((kind == "VariableDeclaration") & (hk == "LocalDeclarationStatement") & F.col("generic"), "LocalGeneric")
        .when((kind == "PropertyDeclaration") & inside, "InterfaceProperty").when(kind == "PropertyDeclaration", "Property")
        .when((kind == "MethodDeclaration") & is_private(), "PrivateReturn").when((kind == "MethodDeclaration") & is_reachable(), "PublicReturn")
        .when(is_method & inside, "InterfaceMethod").when((hk == "IndexerDeclaration") & inside, "InterfaceIndexer")
        .when(kind == "DelegateDeclaration", "DelegateReturn").when(is_parameter & is_method & receiver, "ExtensionReceiver").when(kind == "SimpleBaseType", "Base")
    )
    found = own.select(F.col("_host").alias("host"), host_kind.alias("host_kind"), "node_id").filter("host_kind is not null").join(nodes.select("node_id", "s"), "node_id")
    first = F.min(F.struct("s", F.col("node_id").alias("source"), "host_kind"))
    return found.groupBy("host").agg(first.alias("_one")).select(F.col("host").alias("node_id"), "_one.host_kind", "_one.source")


def host_proposals(hosts: DataFrame) -> DataFrame:
    """(rule_id, action, node_id): each host of ``declaration_hosts`` goes."""
    rules = F.create_map(*[F.lit(x) for pair in HOST_PROPOSALS.items() for x in pair])
    return hosts.select(rules[F.col("host_kind")].alias("rule_id"), F.lit("Delete").alias("action"), "node_id")


def shrink_plans(marked: DataFrame, owners: DataFrame, parameters: DataFrame, calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """(rule_id, mode, owner_id, parameter_id, position, source): parameters that can go from an owner and from every one of
    its calls, all or none.

    marked(parameter_id, source); owners(owner_id, kind, modifiers, explicit, container, name, form, types) with form for
    what overloads must share besides the name, and types in order; parameters(parameter_id, owner_id, position,
    has_default, is_params, is_this); calls(call_id, owner_id) for invocations and element accesses; arguments(call_id,
    ordinal, position, named), explicit ones with the position of their parameter.  The first mode that fits counts, an
    extension besides; an owner loses one parameter a rule, that of the first source.  Arguments are counted a call before
    they meet the owners, so a common owner's calls add up before the shuffle."""
    sizes = parameters.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_size"), F.max(F.when(F.col("position") == 0, F.col("is_this").cast("int"))).alias("_receiver"))
    p = marked.groupBy("parameter_id").agg(F.min("source").alias("source")).join(parameters, "parameter_id").join(owners, "owner_id").join(sizes, "owner_id")
    p = cut(p)
    rest = p.filter("kind = 'MethodDeclaration'").select("parameter_id", F.col("owner_id").alias("_own"), "container", "name", "form", F.filter("types", lambda _, i: i != F.col("position")).alias("types"))
    clash = rest.join(owners.select("owner_id", "container", "name", "form", "types"), ["container", "name", "form", "types"]).filter("owner_id <> _own").select("parameter_id").distinct()
    told = arguments.groupBy("call_id", "position").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("named").alias("_named"))
    total = arguments.groupBy("call_id").agg(F.count(F.lit(1)).alias("_args"), F.count_if("named").alias("_colons"))
    bound = p.select("parameter_id", "owner_id", "position", "_size").join(calls.select("call_id", "owner_id"), "owner_id").join(total, "call_id", "left").join(told, ["call_id", "position"], "left")
    n, of = F.coalesce("_n", F.lit(0)), F.coalesce("_args", F.lit(0))
    seen = bound.groupBy("parameter_id").agg(
        F.count(F.lit(1)).alias("_calls"), F.bool_and((of == F.col("_size")) & (F.coalesce("_colons", F.lit(0)) == 0)).alias("_positional"),
        F.bool_and((n == 1) & F.coalesce("_named", F.lit(False))).alias("_by_name"), F.bool_and(n == 1).alias("_mapped"), F.bool_and(n <= 1).alias("_at_most"), F.bool_and(n == 0).alias("_absent"),
    )
    p = p.join(seen, "parameter_id", "left").join(clash.withColumn("_clash", F.lit(True)), "parameter_id", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))

    called = F.coalesce("_calls", F.lit(0)) > 0
    plain = ~flag("has_default") & ~flag("is_params") & ~flag("is_this")
    optional = flag("has_default") & ~flag("is_params") & ~flag("is_this")
    free, kind = ~flag("_clash"), F.col("kind")
    method, local, indexer = kind == "MethodDeclaration", kind == "LocalFunctionStatement", kind == "IndexerDeclaration"
    may = method & (is_private() | is_reachable())
    fits = {name: ~called | flag(name) for name in ("_positional", "_at_most", "_absent")}
    needs = is_private() | called
    mode = (
        F.when(may & plain & free & called & flag("_by_name"), "NamedMethod").when(may & optional & free & needs & fits["_at_most"], "OptionalMethod")
        .when(may & flag("is_params") & (F.col("position") == F.col("_size") - 1) & free & needs & fits["_absent"], "ParamsMethod")
        .when(method & is_private() & plain & fits["_positional"], "PrivatePositional").when(method & is_reachable() & plain & called & flag("_positional"), "PublicPositional")
        .when(local & plain & called & flag("_by_name"), "NamedLocalFunction").when(local & optional & called & flag("_at_most"), "OptionalLocalFunction").when(local & plain & called & flag("_positional"), "LocalFunction")
        .when(indexer & plain & called & flag("_by_name"), "NamedIndexer").when(indexer & plain & called & flag("_positional"), "Indexer")
    )
    mapped = method & _open("explicit", "modifiers") & _has("modifiers", "static") & (F.col("position") > 0) & flag("_receiver") & plain & free & called & flag("_mapped")
    usage = F.when(method, METHOD_USAGE).when(local, LOCAL_FUNCTION_USAGE).otherwise(INDEXER_USAGE)
    out = p.select("*", F.explode(F.array_compact(F.array(
        F.when(mode.isNotNull(), F.struct(usage.alias("rule_id"), mode.alias("mode"))), F.when(mapped, F.struct(F.lit(EXTENSION_USAGE).alias("rule_id"), F.lit("Extension").alias("mode"))),
    ))).alias("_plan")).select("_plan.rule_id", "_plan.mode", "owner_id", "parameter_id", "position", "source")
    return first_wins(out, ["owner_id", "rule_id"], ["source", "parameter_id"])


def delegate_plans(marked: DataFrame, owners: DataFrame, parameters: DataFrame, uses: DataFrame) -> DataFrame:
    """(rule_id, mode, owner_id, parameter_id, position, source) for delegates; uses(owner_id, use, node_id, fits) are their
    references: ``group`` for methods bound by name, ``lambda``, ``invocation``, any other word for the rest; fits is false
    where one cannot be rewritten.  A delegate bound in two ways, or referred to in none of the three, stays."""
    seen = uses.groupBy("owner_id").agg(F.bool_and(F.coalesce("fits", F.lit(False))).alias("_fit"), F.count_if(F.col("use") == "group").alias("_groups"), F.count_if(F.col("use") == "lambda").alias("_lambdas"), F.count_if(F.col("use") == "invocation").alias("_invoked"))
    p = marked.groupBy("parameter_id").agg(F.min("source").alias("source")).join(parameters, "parameter_id").join(owners.filter("kind = 'DelegateDeclaration'").select("owner_id"), "owner_id").join(seen, "owner_id", "left")
    odd = F.coalesce(F.col("has_default") | F.col("is_params") | F.col("is_this"), F.lit(False))
    mode = (
        F.when(F.col("_fit").isNull(), F.when(~odd, "PlainDelegate")).when(~F.col("_fit"), None)
        .when((F.col("_groups") > 0) & (F.col("_lambdas") == 0), "MethodGroup").when((F.col("_lambdas") > 0) & (F.col("_groups") == 0), "Lambda")
        .when((F.col("_invoked") > 0) & (F.col("_groups") + F.col("_lambdas") == 0), "InvocationChain")
    )
    out = p.select(F.lit(DELEGATE_USAGE).alias("rule_id"), mode.alias("mode"), "owner_id", "parameter_id", "position", "source").filter("mode is not null")
    return first_wins(out, ["owner_id"], ["source", "parameter_id"])


def shrink_proposals(plans: DataFrame, calls: DataFrame, arguments: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """(rule_id, action, node_id, removed, source): owners lose the parameter at ``removed``, their calls the argument with
    that ordinal; calls without one stay as they are.  Bindings and invocations of a delegate lose the same position."""
    rules = F.create_map(*[F.lit(x) for pair in SHRINK_PROPOSALS.items() for x in pair])
    p = plans.select(rules[F.col("mode")].alias("rule_id"), F.lit("Replace").alias("action"), "owner_id", "position", "source")
    own = p.select("rule_id", "action", F.col("owner_id").alias("node_id"), F.col("position").cast("long").alias("removed"), "source")
    at = p.join(calls.select("call_id", "owner_id"), "owner_id").join(arguments.select("call_id", "position", "ordinal"), ["call_id", "position"])
    out = own.unionByName(at.select("rule_id", "action", F.col("call_id").alias("node_id"), F.col("ordinal").cast("long").alias("removed"), "source"))
    if uses is None:
        return out
    bound = p.join(uses.filter("use in ('group', 'lambda', 'invocation')").select("owner_id", "node_id").distinct(), "owner_id")
    return out.unionByName(bound.select("rule_id", "action", "node_id", F.col("position").cast("long").alias("removed"), "source"))


def class_lifts(seeds: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, rule_id, source) of the three rules that lift marks(node_id, rule_id): hosts, parts of ifs, and sections and
    switches all of whose statements are marked or lifted by the other two; a node once, in that order of rules."""
    hosts = cut(lift(marked, nodes, (LOCAL_RULE,)).select("node_id", F.lit(HOST_LIFT).alias("rule_id"), "source"))
    ifs = cut(P.if_lifts(marked.select("node_id").distinct(), nodes).select("node_id", F.lit(IF_LIFT).alias("rule_id"), "source"))
    known = cut(marked.select("node_id").unionByName(hosts.select("node_id")).unionByName(ifs.select("node_id")).distinct())
    switches = P.switch_lifts(seeds, known, nodes).select("node_id", F.lit(SWITCH_LIFT).alias("rule_id"), "source")
    rank = F.when(F.col("rule_id") == HOST_LIFT, 0).when(F.col("rule_id") == IF_LIFT, 1).otherwise(2)
    return first_wins(hosts.unionByName(ifs).unionByName(switches), ["node_id"], [rank, "source"])


def class_deletes(seeds: DataFrame, propagated: DataFrame, lifted: DataFrame, nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Units of the control and the default rule for a class, from the tables of ``delete_proposals``.  Types, what comes
    from a host of ``declaration_hosts``, and local declarations that come from a type are left to other rules."""
    units = P.delete_proposals(seeds, propagated, lifted, nodes)
    kinds = nodes.select("node_id", F.col("kind").alias("_kind"))
    units = units.join(kinds, "node_id").join(kinds.select(F.col("node_id").alias("source"), F.col("_kind").alias("_from")), "source", "left")
    units = units.join(hosts.select(F.col("node_id").alias("source"), F.lit(True).alias("_hosted")).distinct(), "source", "left")
    typed = (F.col("_kind") == "LocalDeclarationStatement") & F.coalesce(F.col("_from").isin(*TYPES), F.lit(False))
    control = F.col("rule_id") == P.CONTROL_RULE
    kept = units.filter(control | ~(F.col("_kind").isin(*TYPES) | F.col("_hosted").isNotNull() | typed))
    return kept.select(F.when(control, CONTROL_RULE).otherwise(DEFAULT_RULE).alias("rule_id"), "action", "node_id", "replacement", "conflict_key", "source")


def class_if_proposals(completions: DataFrame) -> DataFrame:
    """Units of the if rule for a class; the same as ``if_proposals`` but for the rule's id."""
    return P.if_proposals(completions).withColumn("rule_id", F.lit(IF_RULE))
