"""Reading tables, cutting lineage, and dense ids without a single-task sort."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


ROOT = str(Path(__file__).resolve().parents[2])


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = list(filter(None, env.get("PYTHONPATH", "").split(os.pathsep)))
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir; a folder of our own only on a
    local master, where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own.append(tempfile.mkdtemp(prefix="plinth-checkpoint-"))
        sc.setCheckpointDir(_own[0])
    return df.checkpoint(eager=True)


def dense_ids(df: DataFrame, keys: list[str], name: str = "node_id") -> DataFrame:
    """Numbers the rows 1..N in the order of ``keys``, whatever order they come in.

    Rows are dealt by range and sorted in place; the rank inside a range plus the sizes of the ranges before (one row a
    range) is the id.  No task sees all rows.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut(df.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_rank", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.col("_rank") + 1).drop("_at", "_part", "_rank", "_base")


def first_wins(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row for each key, the first by an explicit order; never the one that happens to arrive first."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")
