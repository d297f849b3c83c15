"""The rule pipeline: marks, lifting, decisions, edits and diffs, as relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.tables import first_wins

# Which tables a capability needs besides itself.
NEEDS = {
    "DataFlow": ("CallTargets", "Cfg"),
    "InterproceduralDataFlow": ("DataFlow", "CallTargets", "MethodModel", "QueryIndex"),
    "Dominance": ("Cfg",),
    "ControlDependence": ("Dominance", "Cfg"),
    "CallTargets": (), "Cfg": (), "MethodModel": (), "QueryIndex": (), "SyntaxSemantic": (), "MemberAccess": (),
}


def capabilities(wanted: set[str]) -> set[str]:
    """All capabilities that the wanted ones need; any of them needs SyntaxSemantic; unknown names are errors."""
    todo, out = list(wanted), set()
    while todo:
        name = todo.pop()
        if name not in NEEDS:
            raise ValueError(f"unknown capability {name}")
        if name not in out:
            out.add(name)
            todo += [*NEEDS[name], "SyntaxSemantic"]
    return out


@dataclass(frozen=True)
class Rule:
    """A stage function over DataFrames; rules of one group see the marks of the rules before them."""

    rule_id: str
    stage: str
    run: Callable[..., DataFrame]
    group: str = ""
    needs: frozenset[str] = field(default_factory=frozenset)


def select_rules(rules: list[Rule], disabled: list[str]) -> list[Rule]:
    off = {d.lower() for d in disabled}
    return sorted((r for r in rules if r.rule_id.lower() not in off), key=lambda r: r.rule_id)


def mark(rules: list[Rule], facts: DataFrame) -> DataFrame:
    """Union of the mark rules, the first rule (by id) of each (group, file, s, e) kept."""
    out = None
    for r in rules:
        rows = r.run(facts).select("file", "s", "e", F.lit(r.rule_id).alias("rule_id"), F.lit(r.group or r.rule_id).alias("grp"))
        out = rows if out is None else out.unionByName(rows)
    return first_wins(out, ["grp", "file", "s", "e"], ["rule_id"])


def propagate(rules: list[Rule], marks: DataFrame) -> DataFrame:
    """Rules in order, each on all marks so far; a mark that is there already stays with the rule that made it."""
    now = marks.withColumn("depth", F.lit(0))
    for i, r in enumerate(rules, 1):
        new = r.run(now).select("file", "s", "e", F.lit(r.rule_id).alias("rule_id"), F.lit(r.group or r.rule_id).alias("grp")).withColumn("depth", F.lit(i))
        now = first_wins(now.unionByName(new), ["grp", "file", "s", "e"], ["depth", "rule_id"])
    return now


def fully_marked(members: DataFrame, group: str, marked: str) -> DataFrame:
    """Groups all of whose members are marked (relational division)."""
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(marked).cast("long")).alias("n_marked")).filter("n = n_marked")


def winners(units: DataFrame, key: str) -> DataFrame:
    """One decision for each conflict key: least depth, then the longest span, then the first start."""
    return first_wins(units, [key], [F.asc("depth"), F.desc(F.col("e") - F.col("s")), F.asc("s"), F.asc("e")])


def apply_edits(texts: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Texts with non-overlapping edits (s, e, replacement) made, the pieces between them joined in order."""
    sorted_ = edits.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("s", "e", "replacement"))).alias("_edits"))  # the edits of one file
    both = texts.join(sorted_, file, "left")
    es = F.col("_edits")
    at = lambda i: F.element_at(es, i)
    stop = lambda i: F.when(i > 1, F.element_at(es, F.greatest(i - 1, F.lit(1)))["e"]).otherwise(F.lit(0))
    piece = lambda i: F.concat(F.substring(F.col(text), (stop(i) + 1).cast("int"), (at(i)["s"] - stop(i)).cast("int")), at(i)["replacement"])
    tail = F.substring(F.col(text), (F.element_at(es, -1)["e"] + 1).cast("int"), F.char_length(text))
    out = F.when(es.isNull(), F.col(text)).otherwise(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.size(es)), piece), ""), tail))
    return both.withColumn("rewritten", out).drop("_edits")


def line_count(text: Column) -> Column:
    return F.when(F.char_length(text) == 0, 0).otherwise(F.size(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)))


def diff_summary(edits: DataFrame) -> DataFrame:
    """One row of counts over edits (file, original, replacement)."""
    o, r = F.col("original"), F.col("replacement")
    return edits.agg(
        F.countDistinct("file").alias("files"),
        F.count(F.lit(1)).alias("edits"),
        F.coalesce(F.sum(line_count(r)), F.lit(0)).cast("long").alias("inserted_lines"),
        F.coalesce(F.sum(line_count(o)), F.lit(0)).cast("long").alias("deleted_lines"),
        F.count_if((o != "") & (r != "")).alias("replace_blocks"),
    )


def rank_targets(candidates: DataFrame, site: str = "site") -> DataFrame:
    """Candidates of a call site by descending score, then name."""
    return candidates.withColumn("target_rank", F.row_number().over(Window.partitionBy(site).orderBy(F.desc("score"), "name")))


def best_tier(candidates: DataFrame, site: str = "site") -> DataFrame:
    """All candidates of the best tier of their site."""
    return candidates.withColumn("_best", F.min("tier").over(Window.partitionBy(site))).filter("tier = _best").drop("_best")
