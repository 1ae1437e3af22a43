"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
}


def local_session(cores: int | str = "*", memory: str = "12g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks, with a work folder of its own. A cluster job passes its own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("prismal")
    builder = builder.config("spark.driver.memory", memory)
    folder = {} if "spark.checkpoint.dir" in extra else {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="prismal-")}
    for key, value in {**LOCAL_SETTINGS, **folder, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without the setting a temporary folder serves where one machine is the whole
    cluster; on any other master this raises, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="prismal-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str = "step"):
    """Cut lineage by writing to the shared folder and reading the table back.

    The written table survives the loss of executors, and later steps read it
    without repeating the work before it.
    """
    path = work_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
