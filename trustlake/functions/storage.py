"""The folder that all executors share, written tables that cut a plan's lineage, and cleaning up."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The setting by which Spark deletes an action's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folders of this process's sessions, by the id of their application.
_FOLDERS: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and the authority that Spark reads and writes it under."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``; checkpoints go there too.

    Only a local session without that setting gets a temporary folder; on a cluster that is an error, since no executor
    would see the driver's. The folder is deleted when the driver ends, or before that by ``release``.
    """
    context = spark.sparkContext
    known = _FOLDERS.get(context.applicationId)
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-trustlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    own = _FOLDERS[context.applicationId] = f"{qualified(spark, folder)}/trustlake/{context.applicationId}"
    atexit.register(release, spark)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a re-run of what stands above. So the shuffle files of the
    write go at once; else they stay on disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder if it lies in this application's shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.makeQualified(hadoop).toString().startswith(f"{shared_folder(spark)}/"):
        files.delete(hadoop, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file that is there whole or not at all: it is written beside its place and then renamed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(place, False)
    if not files.rename(beside, place):
        raise OSError(f"{path} could not be written")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder, sorted; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that an operator keeps itself, such as a segment that no manifest names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written``, once nothing that is still to be computed reads them. Other files stay."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder. Results that read it cannot be computed any more."""
    own = _FOLDERS.pop(spark.sparkContext.applicationId, None) if spark._jsc is not None else None
    if own:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except (Py4JError, OSError):
            pass  # The JVM has ended before; the folder is left behind.
