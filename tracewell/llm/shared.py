"""Files in the folder that the driver and all executors share, and the session settings of this subpackage."""
from __future__ import annotations

import gc
import os
import re
import uuid
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import session

ROOT = str(Path(__file__).resolve().parents[2])
ARROW_ROWS = 1000  # rows of an Arrow batch; texts may be long


def configure(spark: SparkSession) -> SparkSession:
    """Settings for Arrow batches of long texts; lets Python workers find this package where it is installed."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{session.shared_dir(spark).rstrip('/')}/tracewell/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps.

    Its cleaner does so when the driver has collected the objects that stood for them, which may be far later; the
    steps here end in written tables, so nothing reads those files again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: a fixed result that survives lost executors."""
    spark = df.sparkSession
    release(spark)
    folder = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_staged(staged: DataFrame) -> None:
    """Deletes the folders of tables that ``stage`` wrote and ``staged`` reads, when nothing else reads them any more.

    Only folders below this library's own scratch folder go; any other source of ``staged`` is left alone.
    """
    spark = staged.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = re.compile(r"/tracewell/[^/]+-[0-9a-f]{12}\Z")
    for folder in {x.rsplit("/", 1)[0] for x in staged.inputFiles()}:
        if own.search(folder):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def replace(old: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """Stages ``df``, which is made from the staged table ``old`` alone, and deletes ``old``."""
    new = stage(df, name)
    drop_staged(old)
    return new


def prefix_base(parts: DataFrame, key: str, size: Column, out: str) -> DataFrame:
    """Sum of ``size`` over the parts before each one. ``parts`` has one row per partition, so one task may order it."""
    earlier = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(size).over(earlier), F.lit(0).cast("bigint")))


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder: file:, hdfs:, s3: or a plain path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_once(store: fs.FileSystem, path: str, chunks) -> None:
    """Writes under a name of this attempt, then moves it into place: a lost or repeated task leaves one whole file."""
    context = TaskContext.get()
    attempt = f"{path}.{context.taskAttemptId() if context else 0}.{uuid.uuid4().hex[:8]}.tmp"
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(attempt) as sink:
        for chunk in chunks:
            sink.write(chunk)
    store.move(attempt, path)


def free_name(columns, wanted: str) -> str:
    """``wanted``, or with underscores before it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as text without nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    return column


def spans(sizes, most: int) -> list[tuple[int, int]]:
    """Cuts rows into runs of at most ``most`` in total (a larger row is a run of its own)."""
    out, begin, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            out.append((begin, i))
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
