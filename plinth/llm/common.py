"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one of our own only on a local master (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="plinth-shared-"))
    return _own_dir[0]


def stage_table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and any executor can be lost after it.

    The committer makes the write atomic per task attempt, so ids given inside a task are stable afterwards.  The
    table goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plinth-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


atexit.register(_remove_written)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches that Python workers get, unless the session names another bound, and let the workers
    import this package from where the driver has it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_mod(ident: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty string."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % k


class TwoGenerations:
    """A bounded cache: at ``cap`` new entries the young generation becomes the old one and the old one goes."""

    def __init__(self, cap: int):
        self.cap, self.young, self.old = cap, {}, {}

    def take(self, keys) -> tuple[dict, list]:
        """The known entries among ``keys`` and the list of the unknown ones."""
        known, missing = {}, []
        young, old = self.young, self.old
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                young[k] = v
            known[k] = v
        return known, missing

    def put(self, new: dict) -> None:
        self.young.update(new)
        self.turn()

    def turn(self) -> None:
        if len(self.young) > self.cap:
            self.old, self.young = self.young, {}
