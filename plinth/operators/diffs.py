"""Effective edit plans, diff sections and their two text forms, and replay of a plan on its sources.

edits(file, s, e, original, replacement); positions count characters from 0, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.intervals import containment
from plinth.operators.rules import apply_edits, line_count


def effective(edits: DataFrame, key: str = "edit_id") -> DataFrame:
    """Edits that no other one contains; of equal spans the smallest key stays.  Empty spans overlap nothing."""
    real = edits.filter("e > s")
    outer = real.select("file", F.col("s").alias("os"), F.col("e").alias("oe"), F.col(key).alias("_k"))
    inside = containment(real, outer).filter(f"_k <> {key} and (oe - os > e - s or _k < {key})")
    return edits.join(inside.select(key).distinct(), key, "left_anti")


def partial_overlaps(edits: DataFrame, key: str = "edit_id") -> DataFrame:
    """Effective edits that begin before an earlier one ends: a plan that has any must be refused."""
    w = Window.partitionBy("file").orderBy("s", "e", key).rowsBetween(Window.unboundedPreceding, -1)
    return effective(edits, key).filter("e > s").withColumn("_end", F.max("e").over(w)).filter("_end > s").drop("_end")


def edit_kind() -> Column:
    return F.when(F.col("original") == "", "Insert").when(F.col("replacement") == "", "Delete").otherwise("Replace")


def sections(edits: DataFrame) -> DataFrame:
    """Edits with their number in the file, kind and lines taken and given."""
    w = Window.partitionBy("file").orderBy("s", "e")
    return edits.withColumn("edit_no", F.row_number().over(w)).withColumn("edit_kind", edit_kind()).withColumn("lines_before", line_count(F.col("original"))).withColumn("lines_after", line_count(F.col("replacement")))


def _span() -> Column:
    return F.concat(F.col("s").cast("string"), F.lit(".."), F.col("e").cast("string"))


def _no() -> Column:
    return F.concat(F.lit("#"), F.col("edit_no").cast("string"))


def render(sections_: DataFrame, readable: bool = False) -> DataFrame:
    """(file, diff): the sections of a file as text, in order (the edits of one file)."""
    after = F.when(F.col("replacement") == "", "<deleted>").otherwise(F.col("replacement"))
    if readable:
        before = F.when(F.col("original") == "", "<empty>").otherwise(F.col("original"))
        head = F.concat(F.lit("edit "), _no(), F.lit(" kind="), F.col("edit_kind"), F.lit(" span="), _span())
        text = F.concat_ws("\n", head, F.lit("--- before"), before, F.lit("+++ after"), after, F.lit(""))
    else:
        head = F.concat(F.lit("--- original "), _no(), F.lit(" "), F.col("file").cast("string"), F.lit(":"), _span())
        text = F.concat_ws("\n", head, F.col("original"), F.concat(F.lit("+++ rewritten "), _no()), after, F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("edit_no", text.alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    out = sections_.groupBy("file").agg(joined.alias("diff"))
    return out.withColumn("diff", F.concat(F.lit("=== file "), F.col("file").cast("string"), F.lit("\n"), F.col("diff"))) if readable else out


def problems(edits: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, problem): every reason to refuse a plan over sources(file, text).  A plan without rows here can be run."""
    at = edits.join(sources.select("file", F.col("text").alias("_text")), "file", "left")
    out_of_range = (F.col("s") < 0) | (F.col("e") < F.col("s")) | (F.col("e") > F.char_length("_text"))
    found = F.substring(F.col("_text"), (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    one = at.withColumn("problem", F.when(F.col("_text").isNull(), "source missing").when(out_of_range, "span out of range").when(~found.eqNullSafe(F.col("original")), "original text differs"))
    w = Window.partitionBy("file").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    two = edits.withColumn("_end", F.max("e").over(w)).filter("_end > s").select("file", F.lit("edits overlap").alias("problem"))
    return one.filter("problem is not null").select("file", "problem").unionByName(two).distinct()


def replay(edits: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, text, rewritten) of files without problems."""
    sound = edits.join(problems(edits, sources).select("file").distinct(), "file", "left_anti")
    touched = sources.join(sound.select("file").distinct(), "file", "left_semi")
    return apply_edits(touched.select("file", "text"), sound.select("file", "s", "e", "replacement"))
