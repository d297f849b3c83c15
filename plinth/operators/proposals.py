"""If and switch structures over marks, what the rules propose, and proposals as text edits.

nodes(node_id, parent_id, kind, role, file, s, e) as in the syntax rules; an if statement has a part ``condition`` and at
most one ElseClause below it, whose only part is its statement.  marked(node_id, ...) may repeat nodes.  Walks go level by
level with the open nodes alone: through parentheses, through blocks of a switch section, and along chains of else-ifs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.tables import cut, first_wins
from plinth.operators.intervals import containment
from plinth.operators.syntax import LOGICAL, closure, is_expression, operand_split

# Rules that propose, kinds they are for, and names of completions.
DEFAULT_RULE, CONTROL_RULE, IF_RULE, LOGICAL_RULE = "DEL-SOBJ-PROPOSE-DEFAULT-001", "DEL-SOBJ-PROPOSE-CTRL-001", "DEL-SOBJ-PROPOSE-IF-001", "DEL-SOBJ-PROPOSE-LOGIC-001"
UNREACHABLE_RULE, UNREFERENCED_RULE, PRIVATE_RULE, CLEAR_RULE = "DEL-DEAD-001", "DEL-UNREF-METHOD-PROP-001", "PRIV-INTERNAL-PUBLIC-PROP-001", "CLR-UNUSED-IFACE-IMPL-PROP-001"
CONTROL = ("ForStatement", "WhileStatement", "DoStatement", "SwitchStatement", "ReturnStatement")
DELETE_IF, DELETE_ELSE, TO_ELSE_IF, ELSE_TO_TAIL = "DeleteWholeIf", "DeleteOwningElseClause", "ReplaceIfWithElseIfTail", "ReplaceOwningElseWithElseTail"


def if_structures(nodes: DataFrame) -> DataFrame:
    """(anchor, parent_else, condition, tail_kind, tail, tail_statement): one row for each if statement; parent_else is
    null for the head of a chain, tail_kind is null without an else, else ElseIf (tail: the next if) or Else (the clause)."""
    at = nodes.select("node_id", "parent_id", "kind", "role")
    clauses = at.filter("kind = 'ElseClause'").select(F.col("node_id").alias("_clause"), F.col("parent_id").alias("anchor"))
    tails = clauses.join(at.select(F.col("parent_id").alias("_clause"), F.col("node_id").alias("tail_statement"), F.col("kind").alias("_body")), "_clause")
    conditions = at.filter("role = 'condition'").select(F.col("parent_id").alias("anchor"), F.col("node_id").alias("condition"))
    ifs = at.filter("kind = 'IfStatement'").select(F.col("node_id").alias("anchor"), "parent_id")
    ifs = ifs.join(clauses.select(F.col("_clause").alias("parent_id"), F.col("_clause").alias("parent_else")), "parent_id", "left")
    next_if = F.col("_body") == "IfStatement"
    return ifs.join(conditions, "anchor", "left").join(tails, "anchor", "left").select(
        "anchor", "parent_else", "condition", F.when(next_if, "ElseIf").when(F.col("_clause").isNotNull(), "Else").alias("tail_kind"),
        F.when(next_if, F.col("tail_statement")).otherwise(F.col("_clause")).alias("tail"), "tail_statement",
    )


def _cores(nodes: DataFrame) -> DataFrame:
    """(node_id, core): parenthesised expressions with what stands in the innermost parentheses."""
    part = cut(nodes.join(nodes.filter("kind = 'ParenthesizedExpression'").select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("parent_id").alias("core"), F.col("node_id").alias("_in"), F.col("kind").alias("_k")))
    at = part.select(F.col("core").alias("node_id"), "core")
    out = None
    while True:
        step = cut(at.join(part, "core").select("node_id", F.col("_in").alias("core"), "_k"))
        done = step.filter("_k <> 'ParenthesizedExpression'").select("node_id", "core")
        out = done if out is None else out.unionByName(done)
        if step.isEmpty():
            return out
        at = step.filter("_k = 'ParenthesizedExpression'").select("node_id", "core")


def _resolved(marked: DataFrame, nodes: DataFrame, ifs: DataFrame, clauses: bool) -> DataFrame:
    """(source, anchor, whole): marks with the if statement they decide; whole says that the mark is the statement itself.
    An expression decides an if when it is the condition, parentheses aside; an else clause decides the if that it holds."""
    m = marked.select("node_id").distinct()
    own = m.join(ifs.select(F.col("anchor").alias("node_id")), "node_id", "left_semi").select(F.col("node_id").alias("source"), F.col("node_id").alias("anchor"), F.lit(True).alias("whole"))
    cores = cut(_cores(nodes))
    expr = m.join(nodes.filter(is_expression(F.col("kind"))).select("node_id"), "node_id", "left_semi")
    expr = expr.join(cores, "node_id", "left").select(F.col("node_id").alias("source"), F.coalesce("core", "node_id").alias("_core"))
    conditions = ifs.select("anchor", F.col("condition").alias("node_id")).join(cores, "node_id", "left").select("anchor", F.coalesce("core", "node_id").alias("_core"))
    out = own.unionByName(expr.join(conditions, "_core").select("source", "anchor", F.lit(False).alias("whole")))
    if clauses:
        held = m.join(ifs.select(F.col("parent_else").alias("node_id"), "anchor"), "node_id").select(F.col("node_id").alias("source"), "anchor", F.lit(False).alias("whole"))
        out = out.unionByName(held)
    return out


def if_completions(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, completion, anchor, tail, tail_statement, source): what becomes of if statements whose section is marked;
    node_id is the if or its owning else clause.  A head without else is decided by its condition alone, not by a mark on
    the statement.  One row a node, its first mark in the text as source."""
    ifs = cut(if_structures(nodes))
    found = _resolved(marked, nodes, ifs, True).join(ifs, "anchor")
    head = F.col("parent_else").isNull()
    kind = (
        F.when(F.col("tail_kind") == "ElseIf", TO_ELSE_IF)
        .when(F.col("tail_kind") == "Else", F.when(head, DELETE_IF).otherwise(ELSE_TO_TAIL))
        .when(~head, DELETE_ELSE).when(~F.col("whole"), DELETE_IF)
    )
    found = found.withColumn("completion", kind).filter("completion is not null")
    node = F.when(F.col("completion").isin(DELETE_ELSE, ELSE_TO_TAIL), F.col("parent_else")).otherwise(F.col("anchor"))
    found = found.withColumn("node_id", node).join(nodes.select(F.col("node_id").alias("source"), F.col("s").alias("_s"), F.col("e").alias("_e")), "source")
    return first_wins(found, ["node_id"], ["_s", F.desc("_e"), "source"]).select("node_id", "completion", "anchor", "tail", "tail_statement", "source")


def if_lifts(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, source): nodes that marks on ifs or on their conditions mark as well and that are not marked yet.  The if
    itself; the next else-if; of a head its else clause and the clause's statement; of a last else-if its owning clause."""
    ifs = cut(if_structures(nodes))
    found = _resolved(marked, nodes, ifs, False).join(ifs, "anchor").filter("whole or tail_kind is not null or parent_else is not null")
    tail = F.when(F.col("tail_kind") == "ElseIf", F.array("tail")).when(F.col("tail_kind").isNull(), F.array("parent_else")).when(F.col("parent_else").isNull(), F.array("tail", "tail_statement")).otherwise(F.array())
    rows = found.select("source", F.explode(F.concat(F.array("anchor"), tail)).alias("node_id")).filter("node_id is not null")
    rows = rows.join(marked.select("node_id").distinct(), "node_id", "left_anti")
    rows = rows.join(nodes.select(F.col("node_id").alias("source"), F.col("s").alias("_s"), F.col("e").alias("_e")), "source")
    return first_wins(rows, ["node_id"], ["_s", F.desc("_e"), "source"]).select("node_id", "source")


def switch_lifts(seeds: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, source): switch sections all of whose statements are marked (those of blocks count, breaks and the
    blocks themselves do not; a section without any is never marked), and switches all of whose sections are marked but
    for those with default labels alone.  Nodes marked already are left out.  The source is the first seed inside, else
    the first seed of all."""
    at = nodes.select("node_id", "parent_id", "kind", "role")
    up = cut(at.select(F.col("node_id").alias("_p"), F.col("kind").alias("_k"), F.col("parent_id").alias("_pp")))
    m = cut(marked.select("node_id").distinct())
    parts = at.filter((F.col("kind").endswith("Statement")) & (F.col("kind") != "BreakStatement")).select("node_id", F.col("parent_id").alias("_p"))
    inside = None
    while True:
        step = cut(parts.join(up, "_p"))
        found = step.filter("_k = 'SwitchSection'").select("node_id", F.col("_p").alias("section"))
        inside = found if inside is None else inside.unionByName(found)
        if step.isEmpty():
            break
        parts = step.filter("_k = 'Block'").select("node_id", F.col("_pp").alias("_p"))
    flagged = inside.join(m.withColumn("_m", F.lit(True)), "node_id", "left")
    full = cut(flagged.groupBy("section").agg(F.count_if(F.col("_m").isNull()).alias("_open")).filter("_open = 0").select(F.col("section").alias("node_id")))
    labels = at.filter(F.col("kind").endswith("SwitchLabel")).groupBy(F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("kind") != "DefaultSwitchLabel").alias("_cases"))
    told = at.filter("kind = 'SwitchSection'").join(labels.filter("_cases > 0"), "node_id", "left_semi").join(full.unionByName(m).distinct().withColumn("_m", F.lit(True)), "node_id", "left")
    whole = told.groupBy(F.col("parent_id").alias("node_id")).agg(F.count_if(F.col("_m").isNull()).alias("_open")).filter("_open = 0").select("node_id")
    new = cut(full.unionByName(whole).join(m, "node_id", "left_anti"))
    first = lambda s, e, n: F.min_by(n, F.struct(s, -e, n))
    place = nodes.select("node_id", "file", "s", "e")
    seed = cut(place.join(seeds.select("node_id").distinct(), "node_id", "left_semi"))
    hosts = new.join(place, "node_id").select("file", F.col("s").alias("os"), F.col("e").alias("oe"), F.col("node_id").alias("_host"))
    under = containment(seed, hosts).groupBy(F.col("_host").alias("node_id")).agg(first(F.col("s"), F.col("e"), F.col("node_id")).alias("_in"))
    otherwise = seed.agg(first(F.struct("file", "s"), F.col("e"), F.col("node_id")).alias("_n")).first()["_n"]  # one id
    return new.join(under, "node_id", "left").select("node_id", F.coalesce("_in", F.lit(otherwise).cast("long")).alias("source"))


def _uncovered(marks: DataFrame, by: DataFrame, nodes: DataFrame) -> DataFrame:
    """Marks in no other node of ``by``; of two nodes with one span each covers the other."""
    place = nodes.select("node_id", "file", "s", "e")
    inner = marks.select("node_id").distinct().join(place, "node_id")
    outer = by.select("node_id").distinct().join(place, "node_id").select("file", F.col("s").alias("os"), F.col("e").alias("oe"), F.col("node_id").alias("_by"))
    held = containment(inner, outer).filter("_by <> node_id").select("node_id").distinct()
    return marks.join(held, "node_id", "left_anti")


def _unit(rule: str, action: str, replacement: Column | None = None, key: Column | None = None, source: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("long")
    return [
        F.lit(rule).alias("rule_id"), F.lit(action).alias("action"), F.col("node_id"), (F.lit(None).cast("string") if replacement is None else replacement).alias("replacement"),
        (F.lit(None).cast("string") if key is None else key.cast("string")).alias("conflict_key"), (null if source is None else source).alias("source"),
    ]


def delete_proposals(seeds: DataFrame, propagated: DataFrame, lifted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units (rule_id, action, node_id, replacement, conflict_key, source) of the control and the default rule.

    seeds(node_id); propagated(node_id, source, plain), where plain is false for references to symbols and for marks that
    carry a structure; lifted(node_id, source).  Plain propagated and lifted marks count where no other of them lies
    around; control structures go to the one rule and all but ifs, logical expressions and else clauses to the other, which
    takes seeds too that no propagated or lifted mark lies around.  Of repeated nodes the smallest source is kept,
    propagated ones first."""
    kinds = nodes.select("node_id", "kind", "file", "s", "e")
    all_ = propagated.select("node_id", "source", F.lit(0).alias("_o"), "plain").unionByName(lifted.select("node_id", "source", F.lit(1).alias("_o"), F.lit(True).alias("plain")))
    derived = cut(first_wins(all_.filter("plain"), ["node_id"], ["_o", "source"]).select("node_id", "source"))
    active = cut(_uncovered(derived, derived, nodes).join(kinds, "node_id"))
    control = active.filter(F.col("kind").isin(*CONTROL)).select(*_unit(CONTROL_RULE, "Delete", source=F.col("source")))
    own = _uncovered(seeds.select("node_id").distinct(), all_, nodes).join(kinds, "node_id").withColumn("source", F.lit(None).cast("long"))
    special = F.col("kind").isin(*LOGICAL, "IfStatement", *CONTROL, "ElseClause")
    rest = active.unionByName(own.select(*active.columns)).filter(~special).select(*_unit(DEFAULT_RULE, "Delete", source=F.col("source")))
    return control.unionByName(rest)


def if_proposals(completions: DataFrame) -> DataFrame:
    """Units of the if rule, and ``replacement_node``.  Along a chain an if that takes the next one's place is decided
    once: of neighbours that all give way to the next else-if, every second one counts from the outermost on."""
    chain = completions.filter(F.col("completion") == TO_ELSE_IF)
    up = chain.select(F.col("tail").alias("node_id"), F.col("node_id").alias("parent_id"))
    run = cut(chain.select("node_id").join(up, "node_id", "left"))
    depth = closure(run).groupBy("node_id").agg(F.max("depth").alias("_d"))
    lost = depth.filter("_d % 2 = 1").select("node_id")
    kept = completions.join(lost, "node_id", "left_anti")
    deletes = F.col("completion").isin(DELETE_IF, DELETE_ELSE)
    to = F.when(F.col("completion").isin(TO_ELSE_IF, ELSE_TO_TAIL), F.col("tail"))
    key = F.when(F.col("completion") == DELETE_IF, F.lit(None)).when(F.col("completion") == DELETE_ELSE, F.col("anchor")).otherwise(F.col("node_id"))
    cols = _unit(IF_RULE, "", key=key, source=F.when(F.col("completion") == DELETE_ELSE, F.col("anchor")))
    cols[1] = F.when(deletes, "Delete").otherwise("Replace").alias("action")
    return kept.select(*cols, to.alias("replacement_node"))


def logical_proposals(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units of the logical rule: hosts some of whose operands go are replaced by the operands left."""
    split = operand_split(marked, nodes).select(F.col("top").alias("node_id"), "rest")
    return split.select(*_unit(LOGICAL_RULE, "Replace", F.col("rest"), F.col("node_id")))


def method_deletes(marked: DataFrame, rule: str = UNREFERENCED_RULE) -> DataFrame:
    """Units of the unreachable or the unreferenced rule: every marked method goes."""
    return marked.select("node_id").distinct().select(*_unit(rule, "Delete"))


def method_privates(marked: DataFrame, methods: DataFrame) -> DataFrame:
    """Units of the rule that makes methods private, and ``modifiers`` after it; methods(node_id, modifiers array, tail) with
    the modifiers in order and the text behind them.  The first ``public`` becomes ``private``; others are left out."""
    at = F.array_position("modifiers", "public")
    found = methods.join(marked.select("node_id").distinct(), "node_id", "left_semi").filter(at > 0)
    new = F.transform("modifiers", lambda x, i: F.when(i == at - 1, F.lit("private")).otherwise(x))
    found = found.withColumn("modifiers", new)
    return found.select(*_unit(PRIVATE_RULE, "Replace", F.concat_ws(" ", F.array_join("modifiers", " "), F.col("tail")), F.col("node_id")), "modifiers")


def value_text(name: Column, kind: Column, value_type: Column, abstract: Column, creatable: Column) -> Column:
    """An expression of a type: a new object of a value type, a type parameter, or a class that is not abstract and has a
    public constructor without parameters; the default of any other."""
    new = F.coalesce(value_type, F.lit(False)) | (kind == "TypeParameter") | ((kind == "Class") & ~F.coalesce(abstract, F.lit(False)) & F.coalesce(creatable, F.lit(False)))
    return F.when(new, F.concat(F.lit("new "), name, F.lit("()"))).otherwise(F.concat(F.lit("default("), name, F.lit(")")))


def method_stubs(marked: DataFrame, methods: DataFrame, parameters: DataFrame, types: DataFrame) -> DataFrame:
    """Units of the rule that clears unused implementations; replacement is the new body.

    methods(node_id, has_body, returns), returns null for void; parameters(node_id, ord, name, type, is_out); types(type,
    kind, is_value, is_abstract, creatable), one row a type.  Out parameters get a value each, in order; methods without a
    body are left out; a type that ``types`` does not hold gets its default."""
    named = types.select("type", value_text(F.col("type"), F.col("kind"), F.col("is_value"), F.col("is_abstract"), F.col("creatable")).alias("_v"))
    text = lambda c: F.coalesce("_v", F.concat(F.lit("default("), F.col(c), F.lit(")")))
    mine = methods.join(marked.select("node_id").distinct(), "node_id", "left_semi").filter("has_body").select("node_id", "returns")
    outs = parameters.filter("is_out").join(mine.select("node_id"), "node_id", "left_semi").join(named, "type", "left")
    outs = outs.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.col("name"), F.lit(" = "), text("type"), F.lit(";")).alias("t")))).alias("_outs"))  # the parameters of one method
    back = mine.join(named.withColumnRenamed("type", "returns"), "returns", "left").select("node_id", F.when(F.col("returns").isNotNull(), F.concat(F.lit("return "), text("returns"), F.lit(";"))).alias("_back"))
    body = F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform("_outs", lambda x: x["t"]), ""), F.lit("")), F.coalesce("_back", F.lit("")), F.lit("}"))
    return back.join(outs, "node_id", "left").select(*_unit(CLEAR_RULE, "Replace", body, F.col("node_id")))


def decision_edits(decisions: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node_id, file, s, e, original, replacement): decisions (node_id, action, replacement) as text edits; nodes with
    ``type`` (null where unknown), texts(file, text).

    A replacement stands for its node.  A deleted expression becomes the default of its type; a deleted else clause
    rewrites its if without it; a deleted base type rewrites the list without it, and the last one takes the list along;
    anything else goes.  Other actions give no edit; a Replace without text is an error."""
    rows = decisions.filter(F.col("action").isin("Delete", "Replace")).select("node_id", "action", "replacement").join(nodes, "node_id")
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("kind").alias("_pk"), F.col("s").alias("_ps"), F.col("e").alias("_pe"))
    lists = nodes.filter("kind = 'SimpleBaseType'").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "node_id"))).alias("_bases"))  # the base list of one type
    rows = rows.join(up, "parent_id", "left").join(lists, "parent_id", "left").join(texts.select("file", "text"), "file")
    piece = lambda s, e: F.substring(F.col("text"), (s + 1).cast("int"), (e - s).cast("int"))
    gone = F.col("action") == "Delete"
    clause = gone & (F.col("kind") == "ElseClause") & (F.col("_pk") == "IfStatement")
    base = gone & (F.col("kind") == "SimpleBaseType") & (F.col("_pk") == "BaseList")
    left = F.filter("_bases", lambda b: b["node_id"] != F.col("node_id"))
    listed = F.concat(F.lit(": "), F.array_join(F.transform(left, lambda b: piece(b["s"], b["e"])), ", "))
    new = (
        F.when(~gone, F.coalesce("replacement", F.raise_error(F.lit("a replacement without text"))))
        .when(is_expression(F.col("kind")), F.coalesce(F.concat(F.lit("default("), F.col("type"), F.lit(")")), F.lit("default")))
        .when(clause, F.rtrim(piece(F.col("_ps"), F.col("s")))).when(base & (F.size(left) > 0), listed).otherwise("")
    )
    wide = clause | base
    s, e = F.when(wide, F.col("_ps")).otherwise(F.col("s")), F.when(wide, F.col("_pe")).otherwise(F.col("e"))
    return rows.select("node_id", "file", s.alias("s"), e.alias("e"), piece(s, e).alias("original"), new.alias("replacement"))
