"""Session settings and the shared work folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that hold at any size.  Numbers of partitions belong to the cluster:
# AQE coalesces a generous shuffle count to what the data needs.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stack traces for every column expression make building wide plans slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def make_session(app="vectormart", master=None, settings=None) -> SparkSession:
    """Build a session; a cluster passes its own master and partition counts."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session running in local mode may fall back to a temporary folder: on a
    cluster that folder would exist on one machine only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def work_folder(spark: SparkSession, label="work") -> str:
    """A new, unused folder name under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def measured(df):
    """Write a derived table that is thought to be small, so its true size decides the join.

    Spark can only guess the size of derived rows, and a high guess would make it shuffle
    the large side as well.  Read back from files, few rows are broadcast and many are not.
    """
    return written(df, "measured")


def written(df, label="table"):
    """Write a table to the shared folder and read it back, which cuts its lineage.

    Used where a later step must see exactly the same rows twice, for example when
    row positions are counted.  Survives the loss of executors.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    # Later steps may still read it, so it goes when the driver ends.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the file system that Spark uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
