"""Session construction and the few settings that every plan relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "quillmap", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session. On a cluster the master and sizes come from spark-submit; both arguments are for local runs."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # a union that claims its children's partitioning fails where AQE coalesces them to unequal numbers
    builder = builder.config("spark.sql.unionOutputPartitioning", "false")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("QUILLMAP_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the context's own, or the one that spark.checkpoint.dir names.

    Only where neither is set and the master is local is a temporary one made; on a cluster that is an error, since
    executors would write each to their own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = os.path.join(tempfile.gettempdir(), "checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df):
    """df as a table in the shared folder: later plans are short, and a lost executor loses nothing.

    A written table rather than a checkpoint: it is read by column, and claims no partitioning. It goes with the driver.
    """
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    atexit.register(_forget, spark, path)
    return stored(df, path)


def stored(df, path: str):
    """df as a Parquet table at a path. Columns without a type become strings."""
    df = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove_folder(spark, path)
    except Exception:  # the session has gone: whoever set the folder clears it
        pass
