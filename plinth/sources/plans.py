"""Rewrite plans on disk: one JSON line a file and a manifest that names their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The only version that is read, and the columns of a plan.
SCHEMA_VERSION = 1
PLAN = "relativePath string, sourceSha256 string, edits array<struct<start: bigint, length: bigint, originalText: string, replacementText: string>>"
MANIFEST = "schemaVersion int, operation string, sourceFileCount bigint, planCount bigint, planSha256 string"


def plans(edits: DataFrame, sources: DataFrame) -> DataFrame:
    """edits(file, s, e, original, replacement) and sources(file, text) as one plan a file."""
    edit = F.struct(F.col("s").cast("long").alias("start"), (F.col("e") - F.col("s")).cast("long").alias("length"), F.col("original").alias("originalText"), F.col("replacement").alias("replacementText"))
    one = edits.groupBy("file").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    hashed = sources.select("file", F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("sourceSha256"))
    return one.join(hashed, "file").select(F.col("file").alias("relativePath"), "sourceSha256", "edits")


def _digest(rows: DataFrame) -> DataFrame:
    """One row: the hash of the hashes of all plans, which does not depend on how they lie in files."""
    line = F.sha2(F.to_json(F.struct("relativePath", "sourceSha256", "edits")).cast("binary"), 256)
    low = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(line, 16, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count(F.lit(1)).alias("planCount"), F.coalesce(F.sum(low), F.lit(0)).alias("_a"), F.coalesce(F.sum(high), F.lit(0)).alias("_b"))
    return sums.select("planCount", F.upper(F.sha2(F.concat_ws("|", F.col("planCount").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")).cast("binary"), 256)).alias("planSha256"))


def write(path: str, rows: DataFrame, source_files: int, operation: str) -> None:
    """Plans in path order, then the manifest; a folder that exists is refused, one without a manifest is incomplete."""
    rows.repartitionByRange("relativePath").sortWithinPartitions("relativePath").write.mode("errorifexists").json(f"{path}/plans")
    manifest = _digest(rows).select(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(operation).alias("operation"), F.lit(source_files).cast("long").alias("sourceFileCount"), "planCount", "planSha256")
    manifest.write.mode("errorifexists").json(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The plans, if version and hash are those of the manifest."""
    told = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if told is None or told.schemaVersion != SCHEMA_VERSION:
        raise ValueError("plan manifest is empty or of another version")
    rows = spark.read.schema(PLAN).json(f"{path}/plans")
    found = _digest(rows).first()
    if (found.planCount, found.planSha256) != (told.planCount, told.planSha256.upper()):
        raise ValueError("plans differ from their manifest")
    return rows


def bad_paths(rows: DataFrame) -> DataFrame:
    """(relativePath, problem): rooted paths, paths with two dots and paths that come twice."""
    p = F.col("relativePath")
    wrong = F.when(p.isNull() | p.startswith("/") | p.startswith("\\") | p.rlike("^[A-Za-z]:"), "rooted").when(p.contains(".."), "leaves the folder")
    twice = rows.groupBy("relativePath").count().filter("count > 1").select("relativePath", F.lit("repeated").alias("problem"))
    return rows.select("relativePath", wrong.alias("problem")).filter("problem is not null").distinct().unionByName(twice)


def stale(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(relativePath, problem): sources(file, text) that are gone or have changed since the plan was made."""
    now = sources.select(F.col("file").alias("relativePath"), F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("_now"))
    problem = F.when(F.col("_now").isNull(), "source missing").when(F.col("_now") != F.upper("sourceSha256"), "source changed")
    return rows.join(now, "relativePath", "left").select("relativePath", problem.alias("problem")).filter("problem is not null")


def edits_of(rows: DataFrame) -> DataFrame:
    """Plans back as edits(file, s, e, original, replacement)."""
    e = rows.select(F.col("relativePath").alias("file"), F.explode("edits").alias("x"))
    return e.select("file", F.col("x.start").alias("s"), (F.col("x.start") + F.col("x.length")).alias("e"), F.col("x.originalText").alias("original"), F.col("x.replacementText").alias("replacement"))
