"""Session settings shared by tests, the benchmark and standalone use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larkspur")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.cache.maxEntries", "500")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))  # one machine: any folder is shared
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """Folder for intermediate tables, under the shared checkpoint folder; it goes when the application ends."""
    root = f"{checkpoint_dir(spark)}/larkspur-{spark.sparkContext.applicationId}"
    if not hasattr(spark, "_larkspur_root"):
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark._larkspur_root = root
    return f"{root}/{name}"


def unique_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run under `work_dir`."""
    return f"{work_dir(spark, name)}-{uuid.uuid4().hex[:8]}"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the session. Only a local session may go without."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark, "_larkspur_ckpt"):
        spark._larkspur_ckpt = tempfile.mkdtemp(prefix="spark-")
    return spark._larkspur_ckpt


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read several times, and return the written copy.

    It cuts lineage without depending on any executor: a lost task re-reads the
    files instead of recomputing the whole chain.
    """
    path = unique_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_larkspur_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "larkspur_package.zip")
        with zipfile.ZipFile(target, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(target)
    context._larkspur_shipped = True
