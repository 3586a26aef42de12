"""Shared storage: intermediate tables that outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a statement when it ends, on all executors; a settled table never reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that were written and not yet deleted; what is left goes when the program ends.
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors see.

    Where none is configured: a temporary folder if driver and executors are one process, otherwise one beside the
    tables of the warehouse, which a cluster shares.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] == "local":
            where = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_corvane"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, on shared storage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _LEFT:
        atexit.register(sweep)
    _LEFT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def forget(*tables: DataFrame | None) -> None:
    """Delete settled tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "settled_path", None)
        if path:
            _delete(df.sparkSession, path)
            _LEFT.pop(path, None)


def sweep() -> None:
    """Delete all settled tables that are left; the results made of them can't be read afterwards."""
    for path, spark in list(_LEFT.items()):
        _LEFT.pop(path)
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
