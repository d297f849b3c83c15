"""Canonical exact digests of documents, with DataFrame functions only.

A text is brought to one form (NFKC, full case folding, NFKC again, every run of white space one blank, none at the
ends); two seeded 64-bit xxhash values of that form name its bucket.  Buckets with more than one member are compared
byte by byte against the member with the smallest id, so texts that merely share a bucket get different fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage_table, text_of


def canonical(text: Column) -> Column:
    """NFKC, case folding and white-space folding; null stays null."""
    icu = "com.ibm.icu.text.Normalizer"
    once = F.reflect(F.lit(icu), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), once, F.lit(True))
    again = F.reflect(F.lit(icu), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def wide_hash(form: Column) -> Column:
    """Two xxhash64 values, the second one seeded otherwise."""
    return F.struct(F.xxhash64(form).alias("h1"), F.xxhash64(F.lit(1), form).alias("h2"))


def _hex(h1: Column, h2: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).select("id", "t", canonical(F.col("t")).alias("form")).select("id", "t", wide_hash(F.col("form")).alias("h"))


def _digests(keyed: DataFrame) -> DataFrame:
    return stage_table(keyed.select("id", F.char_length("t").cast("long").alias("n_chars"), "h"), "digests")


def _odd(named: DataFrame, digested: DataFrame) -> DataFrame:
    """(id, h, odd) of texts that share a bucket with a text they differ from.  Only rows of buckets with more than one
    member are compared, each with one text of its bucket; ``named`` has the rows that have an id."""
    buckets = digested.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).filter("n > 1 and rep is not null")
    members = digested.filter("id is not null").join(buckets, "h").select("id", F.col("h").alias("mh"), "rep").distinct()
    # the bucket is compared in a column, not in the join: it would become a key, and the shuffle by id another one
    told = named.join(members, "id").select("id", "h", "rep", F.when(F.col("h") == F.col("mh"), canonical(F.col("t"))).alias("form")).filter("form is not null")
    heads = told.filter("id = rep").groupBy("h").agg(F.min("form").alias("head"))
    return told.join(heads, "h").filter(F.col("form") != F.col("head")).select("id", "h", F.sha2(F.col("form").cast("binary"), 256).alias("odd")).distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, h (two 64-bit values), odd.

    ``odd`` is null unless the text differs, byte by byte in its canonical form, from the text with the smallest id in
    its bucket; then it is the SHA-256 of the form.  Null and empty texts have the digest of the empty form.  Repeated
    rows are kept; rows with a null id are digested but not compared.  Other columns are ignored, whatever their names.
    An empty table gives an empty one.
    """
    keyed = _keyed(docs, id_col, text_col)
    digested = _digests(keyed)
    return digested.join(_odd(keyed.filter("id is not null"), digested), ["id", "h"], "left")


def following(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct ids in descending order, the last one followed by the first.

    Ids lie in as many ranges as the session has shuffle partitions, and no window runs over more than one of them; a
    table of one row for each range mends the seams.
    """
    ranged = stage_table(ids.select("id").repartitionByRange("id").select("id", F.spark_partition_id().alias("r")), "id-ranges")
    inside = ranged.withColumn("nx", F.lead("id").over(Window.partitionBy("r").orderBy(F.desc("id"))))
    tops = ranged.groupBy("r").agg(F.max("id").alias("top"))  # one row a range
    seams = tops.select("r", F.lag("top").over(Window.orderBy("r")).alias("below"), F.max("top").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    return inside.join(F.broadcast(seams), "r").select("id", F.coalesce("nx", "below", "first").alias("next_id"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every document, of its edited text and of the next document, in descending order of ids.

    The edited text has its last floor(n/3) code points replaced by the first as many of the next document.  Rows that
    share an id share a next document: the row with the smallest start among those with the next smaller id.  Rows with
    a null id have no next document and keep their text.  Two texts are alike (1.0) if their canonical forms are equal
    byte by byte, which is asked only where their hashes are.
    """
    keyed = _keyed(docs, id_col, text_col)
    digested = _digests(keyed)
    ids = digested.filter("id is not null").groupBy("id").agg((F.max("n_chars") / 3).cast("long").alias("need"))
    before = stage_table(following(ids.select("id")).join(ids, "id").select(F.col("id").alias("prev"), F.col("next_id").alias("id"), "need"), "order")
    # all three joins by id read one shuffle of the texts
    named = keyed.filter("id is not null")
    starts = (
        named.join(before, "id")
        .select("prev", F.expr("substring(t, 1, cast(need as int))").alias("start"), "h", "id")
        .groupBy(F.col("prev").alias("id"))
        .agg(F.min(F.struct("start", "h", "id")).alias("next"))
    )
    n = F.char_length("t")
    cut = F.floor(n / 3).cast("int")
    joined = named.join(starts, "id").select("id", "t", "h", F.col("next.h").alias("nh"), F.col("next.id").alias("nid"), F.concat(F.substring("t", F.lit(1), n - cut), F.substring("next.start", F.lit(1), cut)).alias("e"))
    nameless = keyed.filter("id is null").select("id", "t", "h", F.lit(None).cast(dict(keyed.dtypes)["h"]).alias("nh"), F.lit(None).cast("long").alias("nid"), F.col("t").alias("e"))

    def told(rows: DataFrame) -> DataFrame:
        hashed = rows.select("id", "t", "e", "h", "nh", "nid", canonical(F.col("e")).alias("form")).select("id", "t", "e", "form", "h", "nh", "nid", wide_hash(F.col("form")).alias("eh"))
        same = F.when(F.col("h") == F.col("eh"), (canonical(F.col("t")) == F.col("form")).cast("double")).otherwise(F.lit(0.0))
        return hashed.select("id", "h", "nh", "nid", "eh", F.char_length("t").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), same.alias("near_edited"))

    odd = stage_table(_odd(named, digested), "odd-texts")  # texts that share a bucket with another one: none, but by chance
    theirs = odd.select(F.col("id").alias("nid"), F.col("h").alias("nh"), F.col("odd").alias("nodd"))
    none = F.lit(None).cast("string")
    return (
        told(joined)
        .join(odd, ["id", "h"], "left")
        .join(theirs, ["nid", "nh"], "left")
        .unionByName(told(nameless).withColumn("odd", none).withColumn("nodd", none))
        .select(
            F.col("id").alias("doc_id"),
            "n_chars",
            "edited_sha256",
            F.concat_ws(":", _hex(F.col("h.h1"), F.col("h.h2")), "odd").alias("fingerprint"),
            _hex(F.col("eh.h1"), F.col("eh.h2")).alias("edited_fingerprint"),
            "near_edited",
            F.when((F.col("h") == F.col("nh")) & F.col("odd").eqNullSafe(F.col("nodd")), 1.0).otherwise(0.0).alias("near_next"),
        )
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(read(spark, sf_dir, "documents"))
