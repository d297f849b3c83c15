"""The star-schema tables lowered to a property graph, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.tables import cut, dense_ids, read
from plinth.operators.graph import Graph

KINDS = (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("order", "o_orderkey", "o_orderstatus"), ("part", "p_partkey", "p_name"), ("region", "r_regionkey", "r_name"), ("supplier", "s_suppkey", "s_name"))
TABLE = {"order": "orders"}

_cache: dict = {}


def nodes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, key, name in KINDS:
        rows = read(spark, d, TABLE.get(kind, kind)).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("natural_key"), F.col(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return dense_ids(out, ["kind", "natural_key"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    specs = [
        (read(spark, d, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "InRegion"),
        (read(spark, d, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "InNation"),
        (read(spark, d, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "InNation"),
        (o, "order", "o_orderkey", "customer", "o_custkey", "PlacedBy"),
        (li, "order", "l_orderkey", "part", "l_partkey", "OfPart"),
        (li, "order", "l_orderkey", "supplier", "l_suppkey", "FromSupplier"),
    ]
    out = None
    for table, a, ka, b, kb, kind in specs:
        rows = table.select(F.lit(a).alias("sk"), F.col(ka).cast("long").alias("sn"), F.lit(b).alias("dk"), F.col(kb).cast("long").alias("dn"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _version(spark: SparkSession, d: str) -> tuple:
    """Names, sizes and times of the files behind the tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for kind in (*(k for k, _, _ in KINDS), "lineitem"):
        at = jvm.org.apache.hadoop.fs.Path(f"{d}/{TABLE.get(kind, kind)}.parquet")
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(conf).listStatus(at)]
    return tuple(sorted(found))


def graph(spark: SparkSession, d: str) -> Graph:
    """The graph of a folder of tables; checkpointed once in a session for the files as they are."""
    key = (spark.sparkContext.applicationId, d, _version(spark, d))
    if key not in _cache:
        n = cut(nodes(spark, d))
        ids = n.select("kind", "natural_key", "node_id")
        src = ids.select(F.col("kind").alias("sk"), F.col("natural_key").alias("sn"), F.col("node_id").alias("src"))
        dst = ids.select(F.col("kind").alias("dk"), F.col("natural_key").alias("dn"), F.col("node_id").alias("dst"))
        e = cut(_pairs(spark, d).join(src, ["sk", "sn"]).join(dst, ["dk", "dn"]).select("src", "dst", "kind"))
        _cache.clear()
        _cache[key] = Graph(n, e)
    return _cache[key]


N_SQL = "n AS (SELECT row_number() OVER (ORDER BY kind, natural_key)::BIGINT AS node_id, kind, natural_key, name FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {key}::BIGINT AS natural_key, {name} AS name FROM {TABLE.get(k, k)}" for k, key, name in KINDS) + "))"
E_SQL = """e AS (SELECT s.node_id AS src, t.node_id AS dst, p.kind FROM (
  SELECT 'nation' sk, n_nationkey::BIGINT sn, 'region' dk, n_regionkey::BIGINT dn, 'InRegion' kind FROM nation
  UNION SELECT 'customer', c_custkey, 'nation', c_nationkey, 'InNation' FROM customer
  UNION SELECT 'supplier', s_suppkey, 'nation', s_nationkey, 'InNation' FROM supplier
  UNION SELECT 'order', o_orderkey, 'customer', o_custkey, 'PlacedBy' FROM orders
  UNION SELECT 'order', l_orderkey, 'part', l_partkey, 'OfPart' FROM lineitem
  UNION SELECT 'order', l_orderkey, 'supplier', l_suppkey, 'FromSupplier' FROM lineitem) p
  JOIN n s ON s.kind = p.sk AND s.natural_key = p.sn JOIN n t ON t.kind = p.dk AND t.natural_key = p.dn)"""
G_SQL = f"WITH RECURSIVE {N_SQL}, {E_SQL}"
