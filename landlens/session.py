"""Session defaults for tests and benches, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("landlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # call sites are recorded by several round trips per column expression: most of the time of building a large plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that the cluster names.

    Only a local master may fall back to a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="landlens-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key over the session's shuffle partitions, however few bytes they are now."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage through a parquet table that outlives lost executors. ``options`` are the writer's."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
