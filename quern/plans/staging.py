"""Tables written between the steps of one operator.

A step whose result is read more than once, or that must not be computed again when an executor is lost, is written as
parquet below the folder named by ``spark.checkpoint.dir``, or else by ``setCheckpointDir``, which all executors of a cluster
share. Where neither is set, a temporary folder is made if all runs on this machine (a local master); elsewhere that is an
error, since every executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables of this application, below the shared folder that the session names."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="quern-")
        _roots[app] = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once and read it back: the lineage ends here, and any number of readers cost a scan each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is (the planner then picks a shuffle join)."""
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).collect()) <= max_rows else df


def at_most(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """df for a broadcast, or an error if it has more than max_rows rows: for products of small sets, where no other way would
    be cheaper."""
    if len(df.limit(max_rows + 1).select(F.lit(1)).collect()) > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return F.broadcast(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over at least as many partitions as there are cores, before work that is far dearer than its rows: one small file
    would else be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def free_name(base: str, *dfs: DataFrame) -> str:
    """base, with underscores before it until no column of the tables is called so."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
