"""What the operators of this folder share: scratch tables, worker set-up and hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, so long texts come few at a time.
BATCH_BYTES = 2 << 20
#: Whether the shuffle files of a finished job go; so they do for the tables that operators write.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound the size of their batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:  # the caller's own jobs keep the caller's setting
        spark.conf.set(CLEANUP, before)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim(spark: SparkSession) -> None:
    """Give native memory that the driver's JVM has freed back to the system. Compiling the plans of some hundred
    jobs leaves about 200 MB in the allocator, beside the heap, that no other process could use. It takes
    60 ms; a JVM without this command is left alone."""
    jvm = spark._jvm
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    methods = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() in ("invoke", "isRegistered", "getMBeanInfo")}

    def call(method: str, *given: object) -> object:  # by the interface: the bean server's own class isn't open to others
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(given))
        for i, x in enumerate(given):
            args[i] = x
        return methods[method].invoke(beans, args)

    if call("isRegistered", bean) and "systemTrimNativeHeap" in {x.getName() for x in call("getMBeanInfo", bean).getOperations()}:
        call("invoke", bean, "systemTrimNativeHeap", None, None)


class Scratch:
    """stash() for the steps within an operator: their tables go when the block ends, so what the
    block gives must have been stashed outside it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return stash(df, name, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Mark df for broadcast if its counted rows are at most `most`; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def utf8(col: str = "text") -> Column:
    """A text's UTF-8 bytes; null is empty. Workers then never decode what they needn't."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))
