"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir. Where none is set, a temporary one on a local master
    (tests), and an error on a cluster, whose executors could not read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets the folder for checkpoint() where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors.

    The files go when the driver's JVM ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Deletes what materialise() wrote for these frames. They and what was made of them lazily cannot be read again.

    Plans that only they needed are let go, so that Spark's cleaner can drop their shuffle files.
    """
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(file)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        jvm.System.gc()
