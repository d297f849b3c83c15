"""The catalog of a shard store: routes to shards, reference counts, boundary batches and telemetry.

builds(build_id, project, status); shards(build_id, shard_id, path, hash, bytes, status);
owned(build_id, shard_id, node_id); fragments(build_id, shard_id, file, s, e, fingerprint);
boundary(build_id, shard_id, src, dst): edges between shards, kept apart from both.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.tables import first_wins
from plinth.sources.store import fingerprint

# Fixed value: edges in one boundary shard.
BOUNDARY_EDGES = 2048


def newest(builds: DataFrame) -> DataFrame:
    """The newest complete build of each project."""
    return first_wins(builds.filter("status = 'Complete'"), ["project"], [F.desc("build_id")]).select("build_id", "project")


def route_nodes(asked: DataFrame, builds: DataFrame, owned: DataFrame, boundary: DataFrame) -> DataFrame:
    """(node_id, shard_id) for asked(node_id): shards of the newest builds that own the node, own a node next to it
    across a boundary, or hold such a boundary edge."""
    live = newest(builds).select("build_id")
    own = owned.join(live, "build_id", "left_semi")
    ends = boundary.join(live, "build_id", "left_semi")
    touch = ends.select("build_id", "shard_id", F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(ends.select("build_id", "shard_id", F.col("dst").alias("node_id"), F.col("src").alias("other")))
    touch = touch.join(asked.select("node_id").distinct(), "node_id", "left_semi")
    mine = own.join(asked.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "shard_id")
    near = touch.join(own.select("build_id", F.col("node_id").alias("other"), F.col("shard_id").alias("_s")), ["build_id", "other"]).select("node_id", F.col("_s").alias("shard_id"))
    return mine.unionByName(near).unionByName(touch.select("node_id", "shard_id")).distinct()


def route_spans(asked: DataFrame, builds: DataFrame, fragments: DataFrame) -> DataFrame:
    """(file, s, e, shard_id): shards of the newest builds that hold exactly the asked span."""
    live = newest(builds).select("build_id")
    return fragments.join(live, "build_id", "left_semi").join(asked.select("file", "s", "e").distinct(), ["file", "s", "e"], "left_semi").select("file", "s", "e", "shard_id").distinct()


def reusable(asked: DataFrame, builds: DataFrame, shards: DataFrame, fragments: DataFrame) -> DataFrame:
    """asked(file, s, e, fingerprint) with the shard of the newest complete build that holds the same fragment with the
    same fingerprint in a complete shard; null where it must be built."""
    sound = shards.filter("status = 'Complete'").select("build_id", "shard_id")
    done = builds.filter("status = 'Complete'").select("build_id")
    held = fragments.join(done, "build_id", "left_semi").join(sound, ["build_id", "shard_id"], "left_semi")
    key = ["file", "s", "e", "fingerprint"]
    best = first_wins(held, key, [F.desc("build_id"), "shard_id"]).select(*key, "shard_id")
    return asked.join(best, key, "left")


def manifest(shards: DataFrame) -> DataFrame:
    """(build_id, shards, bytes) of the complete shards."""
    return shards.filter("status = 'Complete'").groupBy("build_id").agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def reference_counts(known: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """known(path, hash, refs) with one more for each added (path, hash) and one less for each removed; files that
    nothing refers to leave."""
    key = ["path", "hash"]
    moves = known.select(*key, "refs").unionByName(added.select(*key, F.lit(1).cast("long").alias("refs"))).unionByName(removed.select(*key, F.lit(-1).cast("long").alias("refs")))
    return moves.groupBy(*key).agg(F.sum("refs").alias("refs")).filter("refs > 0")


def unreferenced(shards: DataFrame, counts: DataFrame) -> DataFrame:
    """Shard files that may be deleted."""
    return shards.select("path", "hash").distinct().join(counts, ["path", "hash"], "left_anti")


def boundary_batches(edges: DataFrame, size: int = BOUNDARY_EDGES) -> DataFrame:
    """Cross-shard edges (src_shard, src, dst, kind) with ``batch``: at most ``size`` edges a batch in canonical order.

    The order is one of each source shard; a shard that holds a third of all edges would be one task's work, so edges are
    numbered inside (shard, range of sources) and a batch never spans two ranges.
    """
    cell = F.floor(F.col("src") / size)
    w = Window.partitionBy("src_shard", "_cell").orderBy("src", "kind", "dst")
    return edges.withColumn("_cell", cell).withColumn("batch", F.concat_ws("-", F.col("_cell").cast("string"), F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("_cell")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """The catalog (shard, n, fingerprint) read anew from the nodes of a store; files that cannot be read are left out."""
    nodes = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{path}/nodes")
    return fingerprint(nodes.withColumn("shard", F.col("shard").cast("long")), ["shard"])


def merged_telemetry(runs: DataFrame) -> DataFrame:
    """runs(rule_id, rule_order, millis, marks, dop) of all files as one row a rule, in the order of the rules."""
    return runs.groupBy("rule_id").agg(F.min("rule_order").alias("rule_order"), F.sum("millis").alias("millis"), F.sum("marks").alias("marks"), F.max("dop").alias("dop"), F.count(F.lit(1)).alias("runs"))


def cache_trace(reads: DataFrame, budget: int) -> DataFrame:
    """(stream, reads, misses, distinct_bytes, fits): what a cache of ``budget`` bytes in front of reads(stream, shard_id,
    bytes) would be asked.  With all shards inside the budget each is loaded once; beyond it the order of reads and what
    is given up decide, and misses are null."""
    shards = reads.groupBy("stream", "shard_id").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    total = shards.groupBy("stream").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("misses"), F.sum("bytes").alias("distinct_bytes"))
    fits = F.col("distinct_bytes") <= budget
    return total.withColumn("fits", fits).withColumn("misses", F.when(fits, F.col("misses")))


def cache_replay(reads: DataFrame, budget: int) -> DataFrame:
    """(stream, lookups, hits, misses, bytes_read, evictions) of reads(stream, at, shard_id, bytes) in the order of at, then
    shard_id, through a cache of ``budget`` bytes that gives up what was used longest ago.  A shard wider than the budget,
    or any shard where it is 0, is read past the cache.

    Order decides, so a stream is read in one task, in batches; only what the cache holds stays in memory."""

    def run(batches):
        now, held, size, told = None, {}, 0, [0, 0, 0, 0, 0]
        for batch in batches:
            for stream, shard, width in zip(batch["stream"].to_pylist(), batch["shard_id"].to_pylist(), batch["bytes"].to_pylist()):
                if told[0] and stream != now:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, *told)], names=names)
                if stream != now:
                    now, held, size, told = stream, {}, 0, [0, 0, 0, 0, 0]
                told[0] += 1
                if shard in held:
                    told[1] += 1
                    held[shard] = held.pop(shard)  # a dict keeps the order of use
                    continue
                width = width or 0
                told[2] += 1
                told[3] += width
                if budget and width <= budget:
                    while held and size + width > budget:
                        size -= held.pop(next(iter(held)))
                        told[4] += 1
                    held[shard] = width
                    size += width
        if told[0]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, *told)], names=names)

    names = ["stream", "lookups", "hits", "misses", "bytes_read", "evictions"]
    rows = reads.select(F.col("stream").cast("long"), "at", F.col("shard_id").cast("long"), F.col("bytes").cast("long")).filter("stream is not null")
    rows = rows.repartition("stream").sortWithinPartitions("stream", "at", "shard_id").select("stream", "shard_id", "bytes")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
