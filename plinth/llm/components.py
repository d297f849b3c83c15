"""Distributed connected components, and the comparison of rows that meet in some hash table, each pair once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: Members of a block; larger nodes are compared as pairs of blocks.  Keys alone are compared in blocks of SUB of these.
BLOCK, SUB = 128, 8
#: Rows, and bytes of their payloads, that make one unit of work, about.
BUNDLE, BUNDLE_BYTES = 1500, 8_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node.

    Large-star and small-star steps alternate until the edges no longer change, each round written to the shared
    folder; edges never leave the executors.  Null ends and loops are ignored; no edges give an empty table.
    """
    now = stage_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1000003)).first())


class Links:
    """Collects the links of one task: counts by member, and a spanning forest as (member, root)."""

    def __init__(self, n: int):
        self.parent, self.count = list(range(n)), [0] * n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, i: int, j: int, weight_i: int, weight_j: int) -> None:
        self.count[i] += weight_j
        self.count[j] += weight_i
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


#: From the signatures of some rows: their keys [row, table], and those of an earlier search (None if there was none).
Keys = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray | None]]


def with_payloads(met: DataFrame, payloads: DataFrame) -> DataFrame:
    """What ``meetings`` gave, with the columns of ``payloads`` and tasks of even weight."""
    weight = met.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    bundles = max(1, int(weight["n"]) // BUNDLE, int(weight["b"] or 0) * 8 // BUNDLE_BYTES)
    return met.join(payloads, "digest").withColumn("task", F.pmod(F.xxhash64("t", "node", "lo", "hi"), F.lit(bundles)))


def new_pairs(now: np.ndarray, before: np.ndarray | None, table: int, sizes: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of rows that share a key in ``table``, but in no table before it and in none of an earlier
    search, and of whose sizes the smaller is at least ``ratio`` times the larger."""
    m = len(now)
    if m <= 64:
        i, j = np.triu_indices(m, 1)
        ok = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
        ok &= ~(now[i, :table] == now[j, :table]).any(axis=1)
        if before is not None:
            ok &= ~(before[i] == before[j]).any(axis=1)
        return i[ok], j[ok]
    ok = np.triu(np.minimum(sizes[:, None], sizes) >= ratio * np.maximum(sizes[:, None], sizes), 1)
    columns = [now[:, k] for k in range(table)] + ([] if before is None else list(before.T))
    for n, k in enumerate(columns):
        ok &= k[:, None] != k
        if n % 6 == 0 and not ok.any():
            break
    return np.nonzero(ok)


def _units(table: pa.Table, names: tuple[str, ...]):
    units: dict = {}
    for i, unit in enumerate(zip(*(table.column(c).to_pylist() for c in names), strict=True)):
        units.setdefault(unit, []).append(i)
    return units


def deal(placed: DataFrame, block: int, sub: int, name: str) -> tuple[DataFrame, int]:
    """Rows (t, node, digest, mine, a, b, task) and about how many: every two members of a node meet in one (a, b).

    ``mine`` is the block of a member by the hash of its digest; a and b count groups of ``sub`` blocks.  Units of a task
    are whole and small, whatever the sizes of nodes.
    """
    sizes = stage_table(placed.groupBy("t", "node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), f"{name}-nodes")
    coarse = F.ceil(F.col("members") / (block * sub)).cast("int")
    fine = F.when(coarse > 1, coarse * sub).otherwise(F.ceil(F.col("members") / block))
    rows = int(sizes.agg(F.sum(F.col("members") * coarse).alias("n")).first()["n"] or 0)
    dealt = placed.join(sizes, ["t", "node"]).withColumn("mine", F.pmod(F.xxhash64("digest"), fine).cast("int")).withColumn("part", F.floor(F.col("mine") / sub).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), coarse - 1))).select("t", "node", "digest", "mine", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    return dealt.withColumn("task", F.pmod(F.xxhash64("t", "node", "a", "b"), F.lit(max(1, rows // BUNDLE)))), rows


def meetings(placed: DataFrame, signatures: DataFrame, keys: Keys, ratio: float, name: str) -> DataFrame:
    """Who must be compared: rows (t, node, lo, hi, mine, digest, size, sig), every pair in one (t, node, lo, hi) alone.

    ``placed`` has (t, node, digest); ``signatures`` (digest, size, sig).  Members of a node meet in blocks by the hash
    of their digests, so no task holds a large node; only signatures travel here, and only members with a pair that met
    nowhere before are given on.
    """
    dealt = deal(placed, BLOCK, SUB, name)[0]

    def meet(table: pa.Table) -> pa.Table:
        sig, size, mine = table.column("sig").to_pylist(), table.column("size").to_numpy(), table.column("mine").to_numpy()
        taken: list[int] = []
        low, high = [], []
        for (t, _, a, b), at in _units(table, ("t", "node", "a", "b")).items():
            now, before = keys([sig[i] for i in at])
            of = mine[at]
            left, right = new_pairs(now, before, t, size[at], ratio)
            if a != b:
                apart = of[left] // SUB != of[right] // SUB
                left, right = left[apart], right[apart]
            lo, hi = np.minimum(of[left], of[right]), np.maximum(of[left], of[right])
            for x, y in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True))):
                here = (lo == x) & (hi == y)
                members = np.union1d(left[here], right[here])
                taken += [at[k] for k in members.tolist()]
                low += [x] * len(members)
                high += [y] * len(members)
        return table.take(pa.array(taken, pa.int64())).select(["t", "node", "mine", "digest", "size", "sig"]).append_column("lo", pa.array(low, pa.int32())).append_column("hi", pa.array(high, pa.int32()))

    node = dict(placed.dtypes)["node"]
    schema = f"t int, node {node}, mine int, digest binary, size long, sig binary, lo int, hi int"
    return stage_table(dealt.join(signatures, "digest").groupBy("task").applyInArrow(meet, schema), f"{name}-meetings")


def compare(met: DataFrame, keys: Keys, near: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """Rows (u, links, v) for every member with links in a unit, and (null, n, null, bin) for the links by likeness.

    ``met`` has (task, t, node, lo, hi, mine, digest, sig, copies, bytes); ``near`` gives, for the bytes of a unit, the
    matrix of linked pairs and that of likenesses, of which ``bin`` is the thousandths.  Only pairs that met nowhere
    before count.  Counts and a spanning forest leave a unit, never its pairs.
    """

    def verify(table: pa.Table) -> pa.Table:
        sig, mine = table.column("sig").to_pylist(), table.column("mine").to_numpy()
        digest, copies, raw = (table.column(c).to_pylist() for c in ("digest", "copies", "bytes"))
        out: list[list] = [[], [], [], []]
        likes = np.zeros(1001, "i8")
        for (t, _, lo, hi), at in _units(table, ("t", "node", "lo", "hi")).items():
            linked, like = near([raw[i] for i in at])
            if lo != hi:
                linked &= mine[at][:, None] != mine[at]
            left, right = np.nonzero(np.triu(linked, 1))
            if not len(left):
                continue
            now, before = keys([sig[i] for i in at])
            seen = np.zeros(len(left), bool)
            for s in range(0, len(left), 65536):
                i, j = left[s : s + 65536], right[s : s + 65536]
                seen[s : s + 65536] = (now[i, :t] == now[j, :t]).any(axis=1)
                if before is not None:
                    seen[s : s + 65536] |= (before[i] == before[j]).any(axis=1)
            left, right = left[~seen], right[~seen]
            likes += np.bincount(np.clip(like[left, right] * 1000 + 1e-6, 0, 1000).astype(int), minlength=1001)
            links = Links(len(at))
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                links.add(i, j, copies[at[i]], copies[at[j]])
            for i, c in enumerate(links.count):
                if c:
                    for column, value in zip(out, (digest[at[i]], c, digest[at[links.find(i)]], None), strict=True):
                        column.append(value)
        for b in np.nonzero(likes)[0].tolist():
            for column, value in zip(out, (None, int(likes[b]), None, b), strict=True):
                column.append(value)
        return pa.table({"u": pa.array(out[0], pa.binary()), "links": pa.array(out[1], pa.int64()), "v": pa.array(out[2], pa.binary()), "bin": pa.array(out[3], pa.int32())})

    return stage_table(met.groupBy("task").applyInArrow(verify, "u binary, links long, v binary, bin int"), f"{name}-links")


def by_row(rows: DataFrame, classes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Class results (u, links, v) brought back to the rows (id, digest): name, n_links, component_id, kept, digest."""
    found = found.filter("u is not null")
    counts = found.groupBy(F.col("u").alias("digest")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("u", "v")).withColumnRenamed("node", "digest")
    linked = classes.select("digest", "copies", "first").join(parts, "digest", "left")
    heads = linked.filter("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    info = linked.join(counts, "digest", "left").join(heads, "component", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "first").alias("head"))
    out = rows.select("id", "digest").join(info, "digest", "left")
    head = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("head"))
    return out.select(F.col("id").alias(name), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), head.alias("component_id"), F.coalesce(F.col("id") == head, F.lit(False)).alias("kept"), "digest")
