"""Spans [start, end) inside files: containment joins by buckets, ownership, coverage and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.tables import first_wins


def _level(size: Column) -> Column:
    """The power of two of a cell that a span of this size meets in two places at most."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def containment(inner: DataFrame, outer: DataFrame, file: str = "file") -> DataFrame:
    """Pairs where outer [os, oe) contains inner [s, e), both with the column ``file``.

    An outer span stands in the cells of its own size that it meets, at most two; an inner one asks the cell of its
    start at each size that outer spans have (their distinct powers of two, one row of 41 at most, broadcast).  So it is
    an equi-join, not a cross product of a file.
    """
    cells = outer.withColumn("_l", _level(F.col("oe") - F.col("os"))).withColumn("_w", F.pow(F.lit(2.0), F.col("_l")).cast("long"))
    cells = cells.withColumn("_c", F.explode(F.array_distinct(F.array(F.floor(F.col("os") / F.col("_w")), F.floor(F.greatest(F.col("oe") - 1, F.col("os")) / F.col("_w"))))))
    levels = outer.agg(F.collect_set(_level(F.col("oe") - F.col("os"))).alias("_levels")).withColumn("_one", F.lit(1))
    least = F.when(F.col("e") - F.col("s") > 1, _level(F.col("e") - F.col("s"))).otherwise(0)
    asked = inner.withColumn("_one", F.lit(1)).join(F.broadcast(levels), "_one").withColumn("_least", least).withColumn("_l", F.explode(F.filter("_levels", lambda x: x >= F.col("_least")))).drop("_one", "_levels", "_least")
    asked = asked.withColumn("_c", F.floor(F.col("s") / F.pow(F.lit(2.0), F.col("_l"))))
    return asked.join(cells, [file, "_l", "_c"]).filter("os <= s and e <= oe").drop("_l", "_c", "_w")


def innermost_owner(inner: DataFrame, outer: DataFrame, key: str, file: str = "file") -> DataFrame:
    """The smallest outer span around each inner row; ties go to the smaller start, then the smaller ordinal (``ord``).
    Rows that nothing contains keep a null owner: they belong to the skeleton."""
    best = first_wins(containment(inner, outer, file).withColumn("_size", F.col("oe") - F.col("os")), [key], ["_size", "os", "ord"])
    return inner.join(best.select(key, F.col("ord").alias("owner")), key, "left")


def covered(spans: DataFrame, key: str, file: str = "file") -> DataFrame:
    """Spans that lie in another one; of equal spans all but the smallest key are covered."""
    outer = spans.select(file, F.col("s").alias("os"), F.col("e").alias("oe"), F.col(key).alias("_k"))
    held = containment(spans, outer, file).filter(f"_k <> {key} and (oe - os > e - s or _k < {key})")
    return spans.join(held.select(key).distinct(), key, "left_semi")


def maximal(spans: DataFrame, key: str, file: str = "file") -> DataFrame:
    return spans.join(covered(spans, key, file).select(key), key, "left_anti")


def overlaps(edits: DataFrame, file: str = "file") -> DataFrame:
    """Edits that begin before the end of one that begins earlier in the file (running maximum of ends)."""
    w = Window.partitionBy(file).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("before", F.max("e").over(w)).filter("before > s")
