"""Session defaults and the shared folder for intermediate tables."""

import uuid

from pyspark.sql import SparkSession


def local_session(cpus="*", **extra):
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mailtables")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # A member that a reply names twice has its last value.
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark, purpose):
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach."""
    root = checkpoint_dir(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_dir(spark):
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
