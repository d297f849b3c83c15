"""Folders of source files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold built files.
SKIPPED = ("bin", "obj")


def source_files(spark: SparkSession, folder: str, pattern: str = "*.cs") -> DataFrame:
    """(path, text) of all files below a folder whose path, as given below it, has no skipped segment in any case.
    The text is UTF-8; a byte order mark is dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = folder.rstrip("/")
    below = F.substring_index("path", base + "/", -1)
    kept = raw.withColumn("path", below).filter(~F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, SKIPPED))))
    return kept.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"))


def mentioning(files: DataFrame, target: str) -> DataFrame:
    """Files whose text holds the target; all of them if none does."""
    if target == "":
        return files
    hits = files.filter(F.col("text").contains(target))
    return files if hits.isEmpty() else hits


def diff_path(path: Column) -> Column:
    """Where the diff of a file goes, beside it or at the same place below another root: its name without the extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".rewrite.diff"))


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, text) as one UTF-8 file each below ``root``, a folder or address that all executors reach.  A file is
    complete or absent, and a task that runs again writes the same; paths must be unique and stay below the root, else
    nothing is written.  A null text is an empty file."""
    parts = F.split("path", "/")
    odd = F.col("path").isNull() | (F.col("path") == "") | F.col("path").startswith("/") | F.arrays_overlap(parts, F.array(F.lit(".."), F.lit("")))
    bad = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(odd | (F.col("n") > 1)).first()
    if bad is not None:
        raise ValueError(f"path {bad['path']!r} repeats or does not stay below the root")

    def write(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for row in rows:
            to = f"{base.rstrip('/')}/{row['path']}"
            store.create_dir(to.rpartition("/")[0], recursive=True)
            part = f"{to}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write((row["text"] or "").encode())
            store.move(part, to)

    files.select("path", "text").foreachPartition(write)


def write_diffs(diffs: DataFrame, root: str) -> None:
    """Write (path, text) of diffs below ``root``, each under its file's diff path."""
    write_files(diffs.select(diff_path(F.col("path")).alias("path"), "text"), root)


def write_back(files: DataFrame, root: str, allowed: bool = False) -> None:
    """Replace sources by (path, text); refused unless the caller allows it by word."""
    if not allowed:
        raise PermissionError("writing sources back must be allowed")
    write_files(files, root)
