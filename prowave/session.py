"""Session helpers shared by the bench, the tests and the entry module."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "prowave", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; a cluster passes its own and never calls this."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. A local master (tests, the
    bench) may do without: all its tasks see a temporary folder. Elsewhere a
    missing setting is an error. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes
    checkpoints that are no longer in use.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prowave-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to now; else they stay until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared checkpoint folder, and what deletes it; for tables that are read several times and then not again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def delete() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), delete
