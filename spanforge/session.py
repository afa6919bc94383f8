"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "spanforge") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spanforge-shared-"))
        .config("spark.driver.memory", os.environ.get("SPANFORGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shuffle_width(df: DataFrame) -> int:
    """Default block count: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine (``local[...]``) that lacks the setting gets a folder
    of its own; on a cluster a missing setting is an error, since no other machine
    would see a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanforge-")
    return f"{base.rstrip('/')}/spanforge-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Later readers prune columns and push filters into the table, and a lost
    executor costs a re-read, not a recomputation.
    """
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
