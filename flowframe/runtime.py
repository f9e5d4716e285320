"""What several operators need from the session: the shared folder, tables written there, code on the executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the session is
    local, as in tests, a folder of our own under the system's temporary folder becomes the checkpoint folder; on a
    cluster that would be another folder on each machine, so there the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowframe-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there goes when the application ends."""
    folder = f"{shared_dir(spark)}/flowframe-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(place):
        files.deleteOnExit(place)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Returns the table and its path, for :func:`drop_path` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    context = spark.sparkContext
    with _LOCK:
        if getattr(context, "_flowframe_shipped", False):
            return
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="flowframe-code-"), "flowframe_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(target)
        context._flowframe_shipped = True


def small_arrow_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Bound the Arrow batches that go to Python stages by bytes, so that long texts go in few rows at once.

    Spark's default is 64 MB. A bound in bytes leaves batches of short rows, of this or another query of the session,
    as they were: up to ``maxRecordsPerBatch`` rows.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > size:
        spark.conf.set(name, str(size))
