"""Session settings the library relies on, and the folder used to cut lineage."""
from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # streaming state lives on disk, not in the heap, and only its changes are written per micro-batch
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (time zone) and that skew handling needs; Python workers find this package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = spark.conf.get("tracewell.local.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("tracewell.local.dir", folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; a store that cannot be read is an error, not an absent one."""
    folder, store = _at(spark, path)
    return store.exists(folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote and nothing reads any more."""
    folder, store = _at(spark, path)
    store.delete(folder, True)


def _at(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and has fixed partitions."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
