"""Session settings the library relies on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

STATE_STORE = ("org.apache.spark.sql.execution.streaming.state."
               "RocksDBStateStoreProvider")
#: Bytes of a method above which HotSpot does not compile it.
JIT_LIMIT = 8000
#: Tasks per core that adaptive execution leaves of a shuffle: with about one,
#: a second wave of one slow parse doubles a stage.
TASKS_PER_CORE = 4


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time options results depend on (UTC), adaptive plans with
    several tasks per core, and no generated method beyond what the JVM
    compiles: larger ones would be interpreted, row by row."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum",
                   str(TASKS_PER_CORE
                       * spark.sparkContext.defaultParallelism))
    return spark


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("lotwise")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               # small local inputs: let small shuffles still use every core
               .config("spark.sql.adaptive.coalescePartitions."
                       "minPartitionSize", "128KB"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or a test folder if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def cut_lineage(df):
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(
            os.path.join(checkpoint_folder(spark), "lineage"))
    return df.checkpoint(eager=True)
