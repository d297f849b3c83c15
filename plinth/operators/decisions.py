"""From proposals to decisions: conflict domains, competing ancestors, winners with what they take in, nested deletes.

units(unit_id, rule_id, action, node_id, conflict_key) with action Delete or Replace and a null conflict key where the
rule gives none; nodes as in the syntax rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.tables import cut, first_wins
from plinth.operators.intervals import containment
from plinth.operators.rules import winners
from plinth.operators.syntax import LOGICAL, closure


def conflict_domains(units: DataFrame, nodes: DataFrame, lines: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Units with ``domain``: the key they give, a replacement's own node, the first logical expression at or below the
    node, the nearest node at or above it of a kind that the rule names, or the node.  ``lines`` is the closure."""
    own = units.select("unit_id", "rule_id", F.col("node_id").alias("at"))
    kind = nodes.select(F.col("node_id").alias("at"), "kind", "s", "e")
    below = lines.select(F.col("ancestor").alias("_u"), F.col("node_id").alias("at")).join(own.select("unit_id", F.col("at").alias("_u")), "_u").select("unit_id", "at").unionByName(own.select("unit_id", "at"))
    logical = first_wins(below.join(kind.filter(F.col("kind").isin(*LOGICAL)), "at"), ["unit_id"], ["s", F.desc("e"), "at"]).select("unit_id", F.col("at").alias("_logical"))
    above = own.join(lines.select(F.col("node_id").alias("at"), "ancestor", "depth"), "at").select("unit_id", "rule_id", F.col("ancestor").alias("at"), "depth").unionByName(own.select("unit_id", "rule_id", "at", F.lit(0).alias("depth")))
    named = F.lit(False)
    for rule, names in kinds.items():
        named = named | ((F.col("rule_id") == rule) & F.col("kind").isin(*names))
    host = first_wins(above.join(kind, "at").filter(named), ["unit_id"], ["depth"]).select("unit_id", F.col("at").alias("_host"))
    known = F.col("rule_id").isin(*kinds)
    node = F.when((F.col("action") == "Replace") | ~known, F.col("node_id")).otherwise(F.coalesce("_logical", "_host", "node_id"))
    given = F.when(F.trim("conflict_key") != "", F.col("conflict_key"))
    return units.join(logical, "unit_id", "left").join(host, "unit_id", "left").withColumn("domain", F.coalesce(given, node.cast("string"))).drop("_logical", "_host")


def without_competitors(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Units but for deletes of a node that a replacement of the same domain is at or below."""
    kept = units.filter("action = 'Replace'").select("domain", F.col("node_id").alias("below"))
    over = kept.join(lines.select(F.col("node_id").alias("below"), F.col("ancestor").alias("node_id")), "below").select("domain", "node_id").unionByName(kept.select("domain", F.col("below").alias("node_id"))).distinct()
    lost = units.filter("action = 'Delete'").join(over, ["domain", "node_id"], "left_semi").select("unit_id")
    return units.join(lost, "unit_id", "left_anti")


def decide(units: DataFrame, nodes: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(domain, unit_id, rule_id, action, node_id, merged): one unit a domain, by depth in the tree, length and start;
    ``merged`` counts the units of the domain below its node."""
    lines = cut(closure(nodes))
    level = lines.groupBy("node_id").agg(F.max("depth").alias("depth"))
    left = cut(without_competitors(conflict_domains(units, nodes, lines, kinds), lines))
    placed = left.join(nodes.select("node_id", "s", "e"), "node_id").join(level, "node_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    won = cut(winners(placed, "domain"))
    under = lines.select("node_id", F.col("ancestor").alias("_w"))
    inside = left.select("domain", "node_id").join(won.select("domain", F.col("node_id").alias("_w")), "domain").join(under, ["node_id", "_w"], "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("merged"))
    return won.join(inside, "domain", "left").select("domain", "unit_id", "rule_id", "action", "node_id", F.coalesce("merged", F.lit(0)).cast("long").alias("merged"))


def without_nested(decisions: DataFrame, key: str = "decision_id") -> DataFrame:
    """Decisions (file, s, e, action) without deletes that lie in a replacement or in another delete; of equal deletes
    the smallest key stays.  The outermost spans suffice to tell, since containment is transitive."""
    outer = decisions.select("file", F.col("s").alias("os"), F.col("e").alias("oe"), F.col("action").alias("_a"), F.col(key).alias("_k"))
    inside = containment(decisions.filter("action = 'Delete'"), outer).filter(f"_a = 'Replace' or (_k <> {key} and (oe - os > e - s or _k < {key}))")
    return decisions.join(inside.select(key).distinct(), key, "left_anti")
