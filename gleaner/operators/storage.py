"""Tables that cut lineage, in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. A session on a cluster
without that setting is refused; a local one (a test) gets a folder of its own.
What a session wrote lies in one folder of the application, which ``cleanup``
deletes when its results are no longer read, and the end of the process anyway
if the folder was the session's own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return context.getCheckpointDir().get().rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gleaner/{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete all that this application has materialised; results that read it must be done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later steps reread the files, so a lost executor costs no recomputation,
    and the planner sees a plain scan without inherited partitioning.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a materialised table that nothing reads any more, or of the parts of it that ``part`` names."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gleaner/" in folder and part in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
