"""A partitioned Parquet store for a graph, with a catalog for routing, reuse, pruning and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.tables import first_wins


def assign_shards(nodes: DataFrame, shards: int) -> DataFrame:
    return nodes.withColumn("shard", F.pmod("node_id", F.lit(shards)).cast("long"))


def fingerprint(nodes: DataFrame, group: list[str]) -> DataFrame:
    """SHA-256 of the comma-joined sorted ids of each group (one shard, so bounded by the shard size)."""
    return nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ",").cast("binary"), 256).alias("fingerprint"))


def edge_fingerprint(edges: DataFrame) -> DataFrame:
    """(shard, n, fingerprint) of edges(shard, src, dst, kind): sums over the rows' hashes, so no array holds a shard and
    partial sums meet in the shuffle.  Rows that repeat count each."""
    h = F.xxhash64("src", "dst", "kind")
    parts = [F.sum(F.pmod(h, F.lit(p))) for p in (2147483629, 2147483587)]
    return edges.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *parts, F.bit_xor(h)).alias("fingerprint"))


def write(path: str, nodes: DataFrame, edges: DataFrame, shards: int) -> None:
    """Nodes by (kind, shard), edges by (kind, shard of the target) sorted by target, and the catalog.  A folder that
    exists is refused; the catalog is written last, so a store without one is incomplete."""
    owned = assign_shards(nodes, shards)
    owned.repartition(shards, "shard").write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/nodes")
    placed = edges.withColumn("shard", F.pmod("dst", F.lit(shards)).cast("long"))
    placed.repartition(shards, "shard").sortWithinPartitions("kind", "dst").write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/edges")
    edge_fingerprint(placed).write.mode("errorifexists").parquet(f"{path}/edge_catalog")
    fingerprint(owned, ["shard"]).write.mode("errorifexists").parquet(f"{path}/catalog")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, told, fingerprint) of shards whose nodes or edges differ from the catalog, or that only one of the
    two has; empty for a sound store."""
    out = None
    for part, catalog, make in (("nodes", "catalog", lambda x: fingerprint(x, ["shard"])), ("edges", "edge_catalog", edge_fingerprint)):
        told = spark.read.parquet(f"{path}/{catalog}").select("shard", F.col("fingerprint").alias("told"))
        found = make(spark.read.parquet(f"{path}/{part}").withColumn("shard", F.col("shard").cast("long"))).select("shard", "fingerprint")
        rows = told.join(found, "shard", "full_outer").filter(~F.col("told").eqNullSafe(F.col("fingerprint"))).select(F.lit(part).alias("part"), "shard", "told", "fingerprint")
        out = rows if out is None else out.unionByName(rows)
    return out


def incoming_projection(spark: SparkSession, path: str, shards: int, target: int, kinds: list[str], limit: int) -> DataFrame:
    """At most ``limit`` edges into a target: one partition is read, kind and dst are pushed to the scan."""
    return spark.read.parquet(f"{path}/edges").filter((F.col("shard") == target % shards) & F.col("kind").isin(kinds) & (F.col("dst") == target)).select("src", "dst", "kind").orderBy("src", "kind").limit(limit)


def merge(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of shards in which the first one, by ``order``, of each key stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_wins(out, [key], order)


def latest(builds: DataFrame, key: list[str]) -> DataFrame:
    """The newest complete build of each key."""
    return first_wins(builds.filter("status = 'Complete'"), key, [F.desc("build_id")])


def prunable(builds: DataFrame, key: list[str], keep: int) -> DataFrame:
    """Complete builds older than the ``keep`` newest of their key."""
    w = Window.partitionBy(*key).orderBy(F.desc("build_id"))
    return builds.filter("status = 'Complete'").withColumn("r", F.row_number().over(w)).filter(F.col("r") > keep).drop("r")


def changed(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files (path, fingerprint) that the catalog does not hold with this fingerprint."""
    return files.join(catalog, ["path", "fingerprint"], "left_anti")
