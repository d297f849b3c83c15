"""Lookups that must be unambiguous, canonical orders, comparisons of graphs, and small texts and numbers of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.tables import dense_ids

# The start and the factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 2166136261, 16777619
#: Columns of the canonical order of edges.
EDGE_ORDER = ("src", "kind_order", "dst", "label", "context", "file", "start", "end", "display")


def resolve_anchor(nodes: DataFrame, node_id: int | None = None, full_name: str | None = None, name: str | None = None) -> int:
    """The one node that a selector names.  Exactly one selector, and exactly one match, or it is an error."""
    given = [(c, v) for c, v in (("node_id", node_id), ("full_name", full_name), ("name", name)) if v is not None]
    if len(given) != 1:
        raise ValueError("exactly one of node_id, full_name and name selects an anchor")
    if node_id is not None and node_id < 0:
        raise ValueError("a node id is not negative")
    found = nodes.filter(F.col(given[0][0]) == given[0][1]).select("node_id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{given[0][0]} {given[0][1]!r} names {'more than one node' if found else 'no node'}")
    return found[0]["node_id"]


def resolve_anchors(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node_id, problem) for many names at once: problem is ``missing`` or ``ambiguous`` where there is no one."""
    found = nodes.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"))
    return names.select("name").distinct().join(found, "name", "left").select("name", F.when(F.col("n") == 1, F.col("node_id")).alias("node_id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").alias("problem"))


def disallowed(marks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Marks whose kind their rule does not allow; marks(rule_id, kind, ...), allowed(rule_id, kind)."""
    return marks.join(allowed, ["rule_id", "kind"], "left_anti")


def require_allowed(marks: DataFrame, allowed: DataFrame) -> DataFrame:
    """``marks`` as they are; the first disallowed kind of a rule is an error."""
    bad = disallowed(marks, allowed).select("rule_id", "kind").head()
    if bad:
        raise ValueError(f"rule {bad['rule_id']} does not mark {bad['kind']}")
    return marks


def match_targets(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts(identifier, symbol, root, ...) with the targets(name) that one of the three names; nulls name none."""
    named = facts.withColumn("target", F.explode(F.array_distinct(F.array_compact(F.array("identifier", "symbol", "root")))))
    return named.join(targets.select(F.col("name").alias("target")).distinct(), "target", "left_semi")


def same_location(symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """(symbol, method) that stand at the same place (file, start, end)."""
    return symbols.join(methods, ["file", "start", "end"]).select("symbol", "method")


def zipped(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Rows of two lists of a group paired by their ``ord``; what has no partner goes."""
    return left.join(right, [group, "ord"])


def canonical_edges(edges: DataFrame) -> DataFrame:
    """The edges numbered from 1 in canonical order, nulls first; ranges and offsets, no single task."""
    return dense_ids(edges, list(EDGE_ORDER), "position")


def file_index(nodes: DataFrame) -> DataFrame:
    """(file, node_id, position): nodes with a place, numbered from 1 by file, start, end and id."""
    return dense_ids(nodes.filter("file <> '' and start is not null and end is not null").select("file", "start", "end", "node_id"), ["file", "start", "end", "node_id"], "position").select("file", "node_id", "position")


def graph_differences(one: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(part, side, row) of nodes and edges that only one graph has, repeats counted; empty for equal graphs."""
    out = None
    for part, a, b in zip(("node", "edge"), one, other, strict=True):
        for side, x, y in (("first", a, b), ("second", b, a)):
            rows = x.exceptAll(y.select(*x.columns)).select(F.lit(part).alias("part"), F.lit(side).alias("side"), F.to_json(F.struct(*x.columns)).alias("row"))
            out = rows if out is None else out.unionByName(rows)
    return out


def stable_errors(diagnostics: DataFrame, ignored: list[str]) -> DataFrame:
    """(key) of diagnostics(path, id, severity, message): errors that are not ignored, as path|id|message."""
    kept = diagnostics.filter((F.col("severity") == "Error") & ~F.col("id").isin(*ignored))
    return kept.select(F.concat_ws("|", F.coalesce("path", F.lit("")), "id", "message").alias("key")).distinct()


def new_errors(before: DataFrame, after: DataFrame, ignored: list[str]) -> DataFrame:
    """Keys of errors that stand after a rewrite and did not before."""
    return stable_errors(after, ignored).join(stable_errors(before, ignored), "key", "left_anti")


def region_facts(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, nodes, expressions, statements) under each root, itself counted; closure(root, node_id) of descendants and
    nodes(node_id, family)."""
    inside = closure.select("root", "node_id").unionByName(closure.select("root", F.col("root").alias("node_id"))).distinct()
    is_ = lambda family: F.count_if(F.col("family") == family)
    return inside.join(nodes, "node_id").groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), is_("expression").alias("expressions"), is_("statement").alias("statements"))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters; 0 becomes 1, which no node id may be."""
    step = lambda a, c: ((a.bitwiseXOR(F.ascii(c).cast("long"))) * FNV_FACTOR).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_START).cast("long"), step)
    return F.when(h == 0, F.lit(1)).otherwise(h).cast("long")


def view_json(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, view): the nodes and edges of each local view as one JSON text, in order of their ids."""
    n = nodes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("node_id", "kind"))).alias("nodes"))
    e = edges.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "kind"))).alias("edges"))
    none = F.array().cast(dict(e.dtypes)["edges"])
    return n.join(e, group, "left").select(group, F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"))).alias("view"))


def diff_path(path: Column, root: str, target: str) -> Column:
    """Where the diff of a source goes: below ``target`` as it lies below ``root``, with .diff after its name; sources from
    elsewhere go by their names alone."""
    base = root.rstrip("/") + "/"
    inside = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(F.regexp_extract(path, "[^/]*$", 0))
    return F.concat(F.lit(target.rstrip("/") + "/"), inside, F.lit(".diff"))


def one_line(text: Column, size: int = 120) -> Column:
    """All line ends as one blank, trimmed, and cut to ``size`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s*(?:\r\n|\r|\n)\s*", " "))
    return F.when(F.char_length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("..."))).otherwise(flat)


def positive_or(text: Column, otherwise: int) -> Column:
    """The whole number that a text states if it is positive, else ``otherwise``."""
    value = F.trim(text).try_cast("int")
    return F.when(value > 0, value).otherwise(F.lit(otherwise))


def flags(names: Column, order: list[str]) -> Column:
    """A bit for each name of a list, by its place in ``order``."""
    bits = F.filter(F.transform(F.array_distinct(names), lambda x: F.array_position(F.array(*map(F.lit, order)), x).cast("int")), lambda p: p > 0)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, p: a + F.pow(F.lit(2.0), p - 1).cast("long"))


def summed_maps(rows: DataFrame, group: str, counts: str) -> DataFrame:
    """Maps from names to numbers added up by key for each group."""
    cells = rows.select(group, F.explode(counts).alias("k", "v")).groupBy(group, "k").agg(F.sum("v").alias("v"))
    return cells.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(counts))
