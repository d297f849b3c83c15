"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, distributed components.

Equal vectors are one class first.  Each class has one bucket in each table, named by the signs of its products with
that table's hyperplanes.  Members of a bucket are compared, in blocks, by cosine in double precision; a pair
that meets in several tables counts in the first one.  Blocks give counts and a spanning forest, never lists of pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stage_table
from .components import BLOCK, by_row, compare, deal

COSINE, RECALL, SEED = 0.95, 0.9995, 20240229
_planes: dict = {}


def shape(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of the number of vectors; tables follow from the recall of a pair
    right at the threshold, 1 - (1 - p^bits)^tables, where p = 1 - angle / pi."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, n))) + 4))
    p = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def buckets_of(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """An (n, tables) array of bucket numbers."""
    key = (vectors.shape[1], bits, tables)
    if key not in _planes:
        _planes[key] = np.random.default_rng([SEED, *key]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ _planes[key] > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype="i8"))


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows id, digest, vec (little-endian doubles); vectors that cannot be compared have no digest."""

    def run(batches):
        for batch in batches:
            digests, raws = [], []
            for v in batch.column(1).to_pylist():
                x = None if not v or any(c is None for c in v) else np.asarray(v, "<f8") + 0.0  # -0.0 is 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    digests.append(None)
                    raws.append(None)
                else:
                    raws.append(x.tobytes())
                    digests.append(hashlib.blake2b(raws[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["id", "digest", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, digest binary, vec binary")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links join vectors of the same length with a cosine of ``cosine`` or more, whatever their ids; vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.  Rows that repeat, id included, count
    each.  component_id is the least id reachable, null where all are null; ``kept`` is then false.  No pair is listed:
    n_links comes from counts.  An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stage_table(_classes(vectors, id_col, vec_col), "vectors")
    classes = stage_table(rows.filter("digest is not null").groupBy("digest", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")), "vector-classes")
    bits, tables = shape(classes.count(), cosine, recall)
    kind = "<i4" if bits < 32 else "<i8"

    def hash_them(batches):
        for batch in batches:
            raws = batch.column(1).to_pylist()
            out: list = [None] * len(raws)
            for size in {len(r) for r in raws}:
                at = [i for i, r in enumerate(raws) if len(r) == size]
                for i, b in zip(at, buckets_of(np.frombuffer(b"".join(raws[i] for i in at), "<f8").reshape(len(at), -1), bits, tables), strict=True):
                    out[i] = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o.astype(kind).tobytes() for o in out], pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["digest", "vec", "copies", "sig", "buckets"])

    hashed = stage_table(classes.select("digest", "vec", "copies").mapInArrow(hash_them, "digest binary, vec binary, copies long, sig binary, buckets array<long>"), "buckets")
    placed = hashed.select(F.posexplode("buckets").alias("t", "bucket"), F.concat_ws(":", F.length("vec"), "bucket").alias("node"), "digest").select("t", "node", "digest")

    def keys(raw: list[bytes]):
        return np.frombuffer(b"".join(raw), kind).reshape(len(raw), tables), None

    def near(raw: list[bytes]):
        x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        like = x @ x.T
        return like >= cosine, like

    dealt, _ = deal(placed, BLOCK, 1, "vectors")
    met = dealt.withColumnsRenamed({"a": "lo", "b": "hi"}).join(hashed.select("digest", "sig", "copies", F.col("vec").alias("bytes")), "digest")
    found = compare(met, keys, near, "vectors")
    return by_row(rows, classes, found, "vec_id").drop("digest")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u), c AS (SELECT u, min(w) AS w FROM r GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(w, vec_id)) AS component_id, vec_id <= coalesce(w, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
